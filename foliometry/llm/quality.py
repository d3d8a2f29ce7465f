"""Quality rules in DataFrame functions only: base rules and a hashed n-gram log-likelihood ratio.

Uni- and bigrams of words are hashed into a fixed number of buckets. Their counts over
trusted documents and over the whole corpus give two smoothed multinomials; a document's
score is the mean log ratio of its n-grams. Every document gets a verdict from fixed
thresholds. No Python runs on the executors.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Buckets of hashed n-grams, trusted documents used at most, added to each bucket's count,
#: and the mean log ratio below which a document goes.
BUCKETS, TRUSTED_DOCS, SMOOTHING, THRESHOLD = 1 << 14, 4_096, 1.0, -0.08
SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once."""
    return F.transform(F.array(value), body)[0]


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, f"[{SPACES}]+"), lambda w: w != "")


def _pairs(a: Column, b: Column, of: Callable[[Column, Column], Column], ahead: int = 1) -> Column:
    """``of`` each item of ``a`` and the one of ``b`` that is ``ahead`` places further."""
    n = F.greatest(F.size(b) - ahead, F.lit(0))
    return F.zip_with(F.slice(a, 1, n), F.slice(b, 1 + ahead, n), of)


def with_hashes(words: Column, body: Callable[[Column, Column], Column]) -> Column:
    """``body`` of the hashes of all words and those of all two successive ones."""
    hashes = F.transform(words, lambda w: F.xxhash64(w))
    return let(hashes, lambda h: let(_pairs(h, h, lambda x, y: F.xxhash64(x, y)), lambda two: body(h, two)))


def ngram_buckets(h: Column, two: Column, buckets: int = BUCKETS) -> Column:
    return F.transform(F.concat(h, two), lambda x: F.pmod(x, F.lit(buckets)).cast("int"))


def repeated_words(h: Column, two: Column) -> Column:
    """Words inside 3-word windows that stand twice or more in the text."""

    def covered(windows: Column) -> Column:
        tagged = F.sort_array(F.transform(windows, lambda w, i: F.struct(w.alias("w"), i.alias("i"))))
        none = F.array().cast("array<int>")
        twins = let(tagged, lambda s: F.flatten(_pairs(s, s, lambda a, b: F.when(a["w"] == b["w"], F.array(a["i"], b["i"])).otherwise(none))))
        start = F.struct(F.lit(-3).alias("last"), F.lit(0).cast("long").alias("n"))
        step = lambda acc, p: F.struct(p.alias("last"), (acc["n"] + F.least(F.lit(3), p - acc["last"])).alias("n"))
        return F.aggregate(F.sort_array(F.array_distinct(twins)), start, step, lambda acc: acc["n"])

    windows = _pairs(two, h, lambda x, y: F.xxhash64(x, y), 2)
    return let(windows, lambda w: F.when(F.size(F.array_distinct(w)) < F.size(w), covered(w)).otherwise(F.lit(0).cast("long")))


def duplicate_lines(text: Column) -> Column:
    lines = F.filter(F.split(text, "\n"), lambda line: F.trim(line, F.lit(SPACES)) != "")
    return let(lines, lambda a: (F.size(a) - F.size(F.array_distinct(a))).cast("long"))


def trusted_ids(labels: DataFrame, most: int = TRUSTED_DOCS) -> DataFrame:
    """``doc_id`` of at most ``most`` documents labelled good and not toxic, picked by a hash."""
    good = labels.where((F.col("quality") == 1) & (F.coalesce(F.col("toxic"), F.lit(0)) == 0) & F.col("doc_id").isNotNull())
    return good.select(F.col("doc_id").cast("long").alias("trusted")).distinct().orderBy(F.xxhash64("trusted"), "trusted").limit(most)


def log_ratios(docs: DataFrame, trusted: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """bucket, ratio: log of the bucket's share in trusted documents over its share in all."""
    rows = docs.join(F.broadcast(trusted), F.col("doc_id") == F.col("trusted"), "left")  # at most TRUSTED_DOCS ids
    grams = rows.select(F.explode(with_hashes(words_of(F.col("text")), lambda h, two: ngram_buckets(h, two, buckets))).alias("bucket"), F.col("trusted").isNotNull().cast("long").alias("mine"))
    counts = grams.groupBy("bucket").agg(F.count(F.lit(1)).alias("raw"), F.sum("mine").alias("good"))
    every = docs.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket"))
    counts = every.join(counts, "bucket", "left").select("bucket", *(F.coalesce(F.col(c), F.lit(0)).alias(c) for c in ("raw", "good")))
    totals = Window.partitionBy()  # over the buckets, of which there is a fixed number
    share = lambda n: (n + F.lit(SMOOTHING)) / (F.sum(n).over(totals) + F.lit(SMOOTHING * buckets))
    ratio = F.when(F.sum("good").over(totals) == 0, F.lit(0.0)).otherwise(F.log(share(F.col("good"))) - F.log(share(F.col("raw"))))
    return counts.select("bucket", ratio.alias("ratio"))


def constant(values: list[float]) -> Column:
    """An array of a fixed length as one literal."""
    return F.split(F.lit(" ".join(map(repr, values))), " ").cast("array<double>")


def assess(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, score.

    Words are split at space and U+0009 to U+000D. A null text has none: all counts 0,
    base_failed. ``kept`` is false if a base rule fails (under 50 words, or over half of them in
    repeated windows), or the mean log ratio is below ``threshold``. Without labelled
    documents all ratios are 0. Repeated rows and null ids count and are judged as any
    other row; no rows give no rows; other columns are ignored. ``score`` is 0 without words.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    found = {r["bucket"]: r["ratio"] for r in log_ratios(docs, trusted_ids(labels)).collect()}  # BUCKETS rows
    ratios = constant([found[b] for b in range(BUCKETS)])

    def score(buckets: Column) -> Column:
        return let(ratios, lambda r: F.aggregate(buckets, F.lit(0.0), lambda acc, b: acc + r[b]) / F.greatest(F.size(buckets), F.lit(1)))

    def features(words: Column) -> Column:
        hashed = with_hashes(words, lambda h, two: F.struct(repeated_words(h, two).alias("n_repeat_words"), let(ngram_buckets(h, two), score).alias("score")))
        return F.struct(F.size(words).cast("long").alias("n_words"), F.char_length(F.array_join(words, "")).cast("long").alias("word_chars"), hashed.alias("h"))

    text = F.col("text")
    f = let(words_of(text), features)
    out = docs.select("doc_id", F.regexp_count(text, F.lit(f"[{SYMBOLS}]")).cast("long").alias("n_symbols"), duplicate_lines(text).alias("n_dup_lines"), f.alias("f"))
    out = out.select("doc_id", F.col("f.n_words").alias("n_words"), F.col("f.word_chars").alias("word_chars"), "n_symbols", "n_dup_lines", F.col("f.h.n_repeat_words").alias("n_repeat_words"), F.col("f.h.score").alias("score"))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & (F.col("score") >= threshold)).alias("kept"), "score")
