"""Language identification by compression with per-language zstandard dictionaries.

A text compresses best against raw content of its own language. The dictionaries
are filled from a bounded sample of labelled documents; every whole text is then
encoded once per language, in blocks, and the smallest encoding wins. When the
runner-up is too close, the text is marked as rejected. A block sees the dictionary and
itself only, so each part of a text counts alike and the margin does not shrink with length.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small_batches

#: Documents sampled for each language (half as many again are drawn), characters taken of each, and bytes of its dictionary at most.
SAMPLE_DOCS, SAMPLE_CHARS, DICT_BYTES = 256, 4_000, 120_000
LEVEL = 7
#: Bytes of a text that are encoded together at most.
BLOCK_BYTES = 8_192
#: A text is rejected if the runner-up's encoding is larger by less than this share of the best.
MARGIN = 0.004


@dataclass
class Model:
    #: language -> raw lower-case content, at most DICT_BYTES each; the most frequent language first
    content: dict[str, bytes]
    level: int = LEVEL

    def encoders(self) -> list[tuple[str, zstandard.ZstdCompressor]]:
        out = []
        for lang, raw in self.content.items():
            d = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=self.level)
            out.append((lang, zstandard.ZstdCompressor(level=self.level, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False)))
        return out


def learnable(doc_id: Column) -> Column:
    """Documents that may be learned from: crc32 of the id as text, modulo 4, is not 2."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 4 != 2


def fit(docs: DataFrame, sample_docs: int = SAMPLE_DOCS) -> Model:
    """Fills the dictionaries from pieces of documents picked by a hash of the id, in its order.

    About one and a half times ``sample_docs`` documents a language are drawn, of each a piece of
    ``SAMPLE_CHARS`` characters at a hashed place; those go in that fit into ``DICT_BYTES``. Counts
    are over all documents; only the drawn pieces reach the driver. Null texts, languages and ids teach nothing.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    rows = rows.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.coalesce(learnable(F.col("doc_id")), F.lit(False)))
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return Model({})
    space = 1 << 30
    limits = F.create_map(*(F.lit(x) for lang, n in sorted(counts.items()) for x in (lang, min(space, space * sample_docs * 3 // (2 * n) + 1))))
    draw = F.pmod(F.xxhash64(F.lit("dictionary"), F.col("doc_id")), F.lit(space))
    places = F.greatest(F.length("text") - SAMPLE_CHARS, F.lit(0)) + 1
    place = (F.pmod(F.xxhash64(F.lit("piece"), F.col("doc_id")), places) + 1).cast("int")
    piece = F.col("text").substr(place, F.lit(SAMPLE_CHARS))
    found = rows.where(draw < limits[F.col("lang")]).select("lang", draw.alias("draw"), piece.alias("text")).collect()
    parts: dict[str, list[bytes]] = {}
    size: dict[str, int] = {}
    for r in sorted(found, key=lambda r: (r["draw"], r["text"])):
        raw = r["text"].lower().encode()
        if size.get(r["lang"], 0) + len(raw) <= DICT_BYTES:
            parts.setdefault(r["lang"], []).append(raw)
            size[r["lang"]] = size.get(r["lang"], 0) + len(raw) + 1
    often = sorted(parts, key=lambda lang: (-counts[lang], lang))
    return Model({lang: b"\n".join(reversed(parts[lang])) for lang in often})


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def encoded_sizes(raw: bytes, encoders: list) -> np.ndarray:
    """Bytes of ``raw`` in each language: the sum over its blocks, which are equally long."""
    n = max(1, -(-len(raw) // BLOCK_BYTES))
    blocks = [raw[len(raw) * i // n : len(raw) * (i + 1) // n] for i in range(n)]
    return np.array([sum(len(c.compress(b)) for b in blocks) for _, c in encoders], float)


def classify(texts: list[str | None], encoders: list) -> tuple[list[str], list[float], list[bool]]:
    """Language, score and rejection of each text; ``und`` (score 0, rejected) without a letter."""
    langs, scores, rejected = [], [], []
    for text in texts:
        if text is None or not encoders or not has_letter(text):
            langs.append("und"), scores.append(0.0), rejected.append(True)
            continue
        sizes = encoded_sizes(text.lower().encode(), encoders)
        best = int(np.argmin(sizes))
        others = np.delete(sizes, best)
        langs.append(encoders[best][0])
        margin = (others.min() - sizes[best]) / sizes[best] if len(others) else 1.0
        scores.append(float(1 / np.exp((sizes[best] - sizes) * 0.35).sum()))
        rejected.append(bool(margin < MARGIN))
    return langs, scores, rejected


def judged(text: Column, model: Model) -> Column:
    """A struct of lang_pred, score and rejected for each text.

    Null texts and texts without a letter are ``und``, score 0, rejected. Case is ignored.
    Ties go to the more frequent language.
    """

    def judge(batches: Iterator) -> Iterator:
        encoders = model.encoders()
        for column in batches:
            langs, scores, rejected = classify(column.to_pylist(), encoders)
            yield pa.StructArray.from_arrays([pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(rejected, pa.bool_())], ["lang_pred", "score", "rejected"])

    judge.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(judge, "lang_pred string, score double, rejected boolean")(text.cast("string"))


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score, rejected of every document, learned from the documents not held out.

    Rows with a null doc_id are judged, but never learned from. Repeated rows are judged
    alike; no rows give no rows; other columns are ignored.
    """
    small_batches(docs.sparkSession)
    model = fit(docs)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), judged(F.col("text"), model).alias("judged"))
    return rows.select("doc_id", F.coalesce(~learnable(F.col("doc_id")), F.lit(False)).alias("held_out"), "judged.lang_pred", "judged.score", "judged.rejected")


def accepted(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """The rows of ``docs`` whose language is told with a clear margin; all columns stay as they are."""
    small_batches(docs.sparkSession)
    return docs.where(~judged(F.col("text"), model or fit(docs))["rejected"])
