"""Whole operators against plain restatements of what they must give, and cases left open before."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from foliometry.llm import decontaminate, jaccard, langid, packing, pii, suffix_dedup, textops

corpus_pipeline = pytest.importorskip("corpus_pipeline")
SF = "/root/testdata/sf0.001"


# suffix-array dedup


@pytest.mark.parametrize("length", [0, 19, 84, 300])
def test_lengths_that_cannot_be_right_are_refused(spark, length):
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    with pytest.raises(ValueError, match="length must be"):
        suffix_dedup.deduplicated(docs, length)


@pytest.mark.parametrize("length", [20, 83])
def test_the_least_and_the_greatest_length(spark, length):
    rng = random.Random(length)
    passages = ["".join(rng.choice("abcd ") for _ in range(rng.randint(60, 120))) for _ in range(5)]
    texts = ["".join(rng.choice(passages)[rng.randrange(30) :] for _ in range(rng.randint(0, 4))) for _ in range(30)]
    first: dict[str, int] = {}
    for i, t in enumerate(texts):
        for p in range(len(t) - length + 1):
            first.setdefault(t[p : p + length], i)
    expected = []
    for i, t in enumerate(texts):
        gone = set()
        for p in range(len(t) - length + 1):
            if first[t[p : p + length]] < i:
                gone |= set(range(p, p + length))
        expected.append("".join(c for k, c in enumerate(t) if k not in gone))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: bytes(r.kept).decode() for r in suffix_dedup.deduplicated(docs, length).collect()}
    assert [got[i] for i in range(len(texts))] == expected


# personal data

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def passes(kind, found):
    digits = [int(d) for d in re.sub("[^0-9]", "", found)]
    if kind == "ip":
        return all(int(x) <= 255 for x in found.split("."))
    if kind == "card":
        doubled = [d if k % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d) for k, d in enumerate(reversed(digits))]
        return 16 <= len(digits) <= 19 and sum(doubled) % 10 == 0
    return kind == "email" or 8 <= len(digits) <= 15


def test_personal_data_against_the_plain_rules(spark):
    rng = random.Random(12)
    bits = ["a.b@c.org", "x@y", "joe [At] mail [dot] org", "10.0.0.1", "300.1.1.1", "1.2.3.4.5", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (212) 555-0100", "+44 20", "212-555-0199", "call", "server", "é", "\n", "version", "card", "7"]
    texts = [rng.choice(["", " "]).join(rng.choice(bits) for _ in range(rng.randrange(12))) for _ in range(300)] + [None, "", "x " * 200_000 + "mail a.b@c.org"]
    docs = spark.createDataFrame([*enumerate(texts), (None, "a.b@c.org"), (0, texts[0])], "doc_id long, text string").withColumn("spans", docs_column())
    got = Counter((r.doc_id, r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) for r in pii.find(docs).collect())
    expected = Counter()
    for i, t in [*enumerate(texts), (None, "a.b@c.org"), (0, texts[0])]:
        spans = [(k, *m.span()) for k, p in PATTERNS.items() for m in re.finditer(p, t or "") if passes(k, m[0])]
        n = Counter(s[0] for s in spans)
        digest = hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in spans).encode()).hexdigest()
        expected[i, n["email"], n["ip"], n["card"], n["phone"], digest] += 1
    assert got == expected


def docs_column():
    from pyspark.sql import functions as F

    return F.lit("a column of the result's name")


def test_added_spans_of_labelled_look_alikes(spark):
    """All true look-alikes are added and no false one: numbers of orders, versions and invoices, and labels that no domain ends in."""
    rng = random.Random(30)
    n = lambda k: "".join(rng.choice("23456789") for _ in range(k))
    name = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    base = [lambda: f"mail {name()}@{name()}.org today", lambda: f"call +1 ({n(3)}) {n(3)}-{n(4)} office", lambda: f"server 10.{n(2)}.{n(2)}.1 port"]
    true = [lambda: f"contact {name()} [at] {name()} [dot] org", lambda: f"mail {name()} (at) {name()}.com today", lambda: f"call {n(3)}-{n(3)}-{n(4)} office", lambda: f"tel ({n(3)}) {n(3)}-{n(4)} ext 4"]
    false = [lambda: f"order 1{n(2)}-0{n(2)}-{n(4)} pieces", lambda: f"version 3{n(2)}.{n(3)}.1.2 beta", lambda: f"invoice {n(13)} items", lambda: f"version {name()} (at) {name()}.7 beta"]
    rows = [(rng.choice(base)(), None) for _ in range(400)] + [(rng.choice(kinds)(), label) for label, kinds in ((True, true), (False, false)) for _ in range(120)]
    docs = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(rows)], "doc_id long, text string")
    spans = {r.doc_id: r.spans for r in pii.find(docs).collect()}
    got = Counter((label, bool(spans[i])) for i, (_, label) in enumerate(rows))
    assert got == {(None, True): 400, (True, True): 120, (False, False): 120}


# decontamination


def plain_tiles(p, t, least):
    """Greedy string tiling by its definition: the longest unmarked common run, the first of equal ones, again and again."""
    p, t, out = list(p), list(t), []
    while True:
        best = None
        for j in range(len(t)):
            for i in range(len(p)):
                k = 0
                while i + k < len(p) and j + k < len(t) and p[i + k] is not None and p[i + k] == t[j + k]:
                    k += 1
                if k >= least and (best is None or k > best[2]):
                    best = (i, j, k)
        if best is None:
            return out
        i, j, k = best
        out.append(best)
        p[i : i + k], t[j : j + k] = [None] * k, [None] * k


@given(st.integers(0, 10**6))
@settings(deadline=None, max_examples=60)
def test_tiles_are_those_of_plain_greedy_tiling(seed):
    rng = random.Random(seed)
    p, t = ([rng.randrange(3) for _ in range(rng.randint(20, 60))] for _ in range(2))
    assert decontaminate.tiles(p, t, 5) == plain_tiles(p, t, 5)


def test_decontamination_against_plain_tiling(spark):
    rng = random.Random(8)
    words = [f"w{k}" for k in range(10)]
    items = {k: " ".join(rng.choice(words) for _ in range(rng.randint(3, 22))) for k in range(8)}
    docs = []
    for i in range(50):
        parts = []
        for _ in range(rng.randint(1, 4)):
            own = items[rng.randrange(8)].split()
            a = rng.randrange(len(own))
            parts += [*own[a : a + rng.randint(4, 22)], f"x{rng.randrange(50)}"]
        docs.append((i if i else None, " ".join(parts)))
    docs += [docs[3], (90, None), (91, ""), (92, "X, y! " + items[1].upper().replace(" ", ", "))]
    expected = {}
    for i, text in docs:
        t = re.findall("[a-z0-9]+", (text or "").lower())
        for k, item in items.items():
            p = item.split()
            covered = sum(n for _, _, n in plain_tiles(p, t, 5))
            if len(p) >= 5 and 2 * covered >= len(p):
                expected[i, k] = covered
    noise = " ".join(f"z{k}" for k in range(60_000))
    docs.append((93, f"{noise} {items[2]} {noise}"))
    longest = items[2].split()
    for k, item in items.items():
        covered = sum(n for _, _, n in plain_tiles(item.split(), longest, 5))
        if len(item.split()) >= 5 and 2 * covered >= len(item.split()):
            expected[93, k] = covered
    schema = "doc_id long, text string, seeds int, other string, item_id long, print string"
    rows = spark.createDataFrame([(i, t, 1, "o", 7, "p") for i, t in docs], schema)
    bench = spark.createDataFrame([*((k, t, 5) for k, t in items.items()), (9, None, 5)], "item_id long, text string, tokens int")
    got = decontaminate.contaminated(rows, bench).collect()
    assert {(r.doc_id, r.item_id): r.covered for r in got} == expected and len(got) == len(expected)
    kept = decontaminate.clean(rows, bench)
    gone = {i for i, _ in expected}
    assert kept.columns == rows.columns
    assert Counter(r.doc_id for r in kept.collect()) == Counter(i for i, _ in docs if i not in gone)


# packing


def test_documents_follow_the_curve_over_all_partitions(spark, monkeypatch):
    monkeypatch.setattr(packing, "PARTITION_BYTES", 4_000)
    rng = random.Random(6)
    words = [[f"{topic}{k}" for k in range(30)] for topic in "abcdef"]
    texts = [" ".join(rng.choice(rng.choice(words)) for _ in range(rng.randint(1, 120))) for _ in range(90)] + [""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    pieces = sorted(packing.pack(docs, length=128).collect(), key=lambda r: (r.sequence_id, r.offset))
    order = list(dict.fromkeys(r.doc_id for r in pieces))
    data, offsets = textops.buffers(pa.array(texts))
    keys = packing.curve_keys(np.arange(len(texts)), data, offsets)
    assert len({r.sequence_id >> 40 for r in pieces}) > 3
    assert order == sorted(range(len(texts)), key=lambda i: (keys[i], i))


# language


def test_ties_go_to_the_more_frequent_language():
    raw = b"the same words in both languages " * 40
    model = langid.Model({"often": raw, "seldom": raw, "other": b"quite different content zzz qqq " * 40})
    langs, scores, rejected = langid.classify(["the same words in both"], model.encoders())
    assert langs == ["often"] and rejected == [True] and 0.4 < scores[0] <= 0.5


# n-gram Jaccard join


def test_links_come_from_the_t_occurrence_search():
    """Between two near copies stand twenty documents for each sixth of them: a guess at partners cannot meet them."""
    fresh = iter(range(10**6))
    take = lambda n: {next(fresh) for _ in range(n)}
    sets, pairs = [], []
    for _ in range(8):
        first = sorted(take(96))
        sets.append(set(first))
        for k in range(6):
            sets += [{*first[16 * k : 16 * k + 16], *take(80)} for _ in range(20)]
        sets.append({*first[4:], *take(4)})
        pairs.append((len(sets) - 122, len(sets) - 1))
    limit, union = jaccard.Threshold(8, 10), jaccard.Union(len(sets))
    links = jaccard.search([np.array(sorted(s), np.uint64) for s in sets], limit, union)
    assert links == len(pairs) and all(union.find(a) == union.find(b) for a, b in pairs)
    assert len({union.find(k) for k in range(len(sets))}) == len(sets) - len(pairs)


def test_a_large_group_of_near_copies_takes_one_link_each():
    base = list(range(0, 3000, 10))
    sets = [np.array(sorted([*base[:k], base[k] + 1, *base[k + 1 :]]), np.uint64) for k in range(300)] * 4
    union = jaccard.Union(len(sets))
    assert jaccard.search(sets, jaccard.Threshold(8, 10), union) == len(sets) - 1
    assert {union.find(k) for k in range(len(sets))} == {0}


# the pipeline's stages


def test_stages_take_an_empty_table(spark):
    none = spark.read.parquet(f"{SF}/documents.parquet").where("false")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, none, SF)
        assert out.collect() == [], name
        assert name == "packed" or out.columns == none.columns, name


def test_stages_keep_nulls_and_repeated_rows(spark):
    text = "the committee published a long report on the state of rivers and lakes in the region " * 3
    schema = spark.read.parquet(f"{SF}/documents.parquet").schema
    row = lambda i, t: tuple({"doc_id": i, "text": t}.get(f.name) for f in schema)
    docs = spark.createDataFrame([row(1, text), row(1, text), row(None, text + "null id"), row(None, None), row(5, None), row(6, "")], schema)
    steps = dict(corpus_pipeline.STAGES)
    assert Counter(r.doc_id for r in steps["near_duplicates"](spark, docs, SF).collect()) == Counter([1, None, None, 5, 6])
    for name in ("decontamination", "personal_data"):
        assert Counter(tuple(r) for r in steps[name](spark, docs, SF).collect()) == Counter(tuple(r) for r in docs.collect())
    pieces = steps["packed"](spark, docs, SF).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.doc_tokens > 1) for r in pieces if r.start == 0) == [(False, 1, True), (False, 1, True), (False, 5, False), (False, 6, False), (True, 0, False), (True, 0, True)]
