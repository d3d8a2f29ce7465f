"""Building blocks without Spark, against plain restatements."""

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from foliometry.llm import decontaminate, jaccard, packing, pii, sharding, suffix_dedup, textops

TEXTS = st.lists(st.text("aAbB é\n\t\x0b z", max_size=30), max_size=8)


def plain_words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text))


@given(TEXTS, st.integers(1, 4))
@settings(deadline=None, max_examples=150)
def test_shingle_sets(texts, n):
    data, offsets = textops.buffers(pa.array(texts, pa.string()))
    bounds, values = textops.shingle_sets(data, offsets, n)
    kinds = {}
    for i, t in enumerate(texts):
        w = plain_words(t)
        expected = {tuple(w[j : j + n]) for j in range(len(w) - n + 1)} or ({tuple(w)} if w else set())
        got = set(values[bounds[i] : bounds[i + 1]].tolist())
        assert len(got) == len(expected) == bounds[i + 1] - bounds[i]
        for s in expected:
            kinds.setdefault(s, []).append(got)
    for holders in kinds.values():
        assert set.intersection(*holders)


def test_buffers_of_slices_and_nulls():
    column = pa.array(["ab", None, "c", "dé"]).slice(1)
    data, offsets = textops.buffers(column)
    assert offsets.tolist() == [0, 0, 1, 4] and data.tobytes() == "cdé".encode()


@given(st.lists(st.binary(max_size=12), max_size=40))
@settings(deadline=None)
def test_multikey_sort(strings):
    rows = np.zeros((len(strings), 12), np.uint8)
    for i, s in enumerate(strings):
        rows[i, : len(s)] = list(s)
    order, group = suffix_dedup.multikey_sort(suffix_dedup.as_words(rows))
    ordered = [rows[i].tobytes() for i in order]
    assert ordered == sorted(ordered)
    assert [a == b for a, b in zip(ordered, ordered[1:], strict=False)] == [a == b for a, b in zip(group, group[1:], strict=False)]


@given(st.integers(0, 10**6), st.sampled_from([(9, 10), (8, 10), (90, 100)]), st.integers(1, 60))
@settings(deadline=None, max_examples=300)
def test_linked_sets_share_a_signature(seed, ratio, size):
    rng = random.Random(seed)
    limit = jaccard.Threshold(*ratio)
    a = [rng.getrandbits(64) for _ in range(size)]
    b = list(a)
    for _ in range(rng.randint(0, max(1, size // 6))):
        if rng.random() < 0.5 and len(b) > 1:
            b.pop(rng.randrange(len(b)))
        else:
            b.append(rng.getrandbits(64))
    common = len(set(a) & set(b))
    if not limit.linked(len(a), len(b), common):
        return
    sets = [np.array(sorted(x), np.uint64) for x in (a, b)]
    values = np.concatenate(sets)
    heavy = values % np.uint64(7) < np.uint64(rng.randrange(8))  # any choice by value must do
    sig, row = jaccard.signatures(np.array([0, len(a), len(a) + len(b)]), values, limit, heavy)
    assert set(sig[row == 0].tolist()) & set(sig[row == 1].tolist())


@given(st.lists(st.lists(st.integers(0, 12), max_size=10, unique=True).map(sorted), max_size=9), st.integers(1, 5))
@settings(deadline=None)
def test_occurring(lists, least):
    lists = [x for x in lists if x]
    count = Counter(v for x in lists for v in x)
    assert dict(jaccard.occurring(lists, least)) == {v: n for v, n in count.items() if n >= least}


@given(st.integers(0, 10**6))
@settings(deadline=None, max_examples=60)
def test_search_finds_all_links(seed):
    rng = random.Random(seed)
    limit = jaccard.Threshold(8, 10)
    pool = [set(rng.sample(range(40), rng.randint(5, 20))) for _ in range(4)]
    sets = []
    for _ in range(25):
        s = set(rng.choice(pool))
        for _ in range(rng.randint(0, 3)):
            s ^= {rng.randrange(60)}
        if s and s not in sets:
            sets.append(s)
    got, expected = jaccard.Union(len(sets)), jaccard.Union(len(sets))
    jaccard.search([np.array(sorted(s), np.uint64) for s in sets], limit, got)
    for i, a in enumerate(sets):
        for j in range(i):
            if limit.linked(len(a), len(sets[j]), len(a & sets[j])):
                expected.join(i, j)
    assert [got.find(i) for i in range(len(sets))] == [expected.find(i) for i in range(len(sets))]


def test_hilbert_is_a_curve():
    points = np.array([(x, y) for x in range(16) for y in range(16)])
    index = packing.hilbert(points, 4)
    assert sorted(index.tolist()) == list(range(256))
    path = points[np.argsort(index)]
    assert (np.abs(np.diff(path, axis=0)).sum(1) == 1).all()


@given(st.lists(st.tuples(st.integers(1, 60), st.integers(1, 9)), max_size=12, unique_by=lambda x: x[0]), st.integers(40, 120))
@settings(deadline=None)
def test_best_fit_decreasing(classes, capacity):
    packing_ = sharding.best_fit_decreasing(classes, capacity)
    bins, placed = [], Counter()
    for size in sorted((s for s, n in classes for _ in range(n)), reverse=True):
        fits = [(r, i) for i, r in enumerate(bins) if r >= size]
        if fits:
            bins[min(fits)[1]] -= size
            placed[size, min(fits)[1]] += 1
        else:
            bins.append(max(capacity, size) - size)
            placed[size, len(bins) - 1] += 1
    got = Counter()
    for size, low, high, b in packing_.runs:
        got[size, b] += high - low
    assert packing_.bins == len(bins) and got == placed


@given(st.lists(st.sampled_from("abcd"), max_size=30), st.lists(st.sampled_from("abcd"), max_size=30))
@settings(deadline=None)
def test_tiles_do_not_overlap_and_match(p, t):
    p, t = ([ord(x) for x in v] for v in (p, t))
    found = decontaminate.tiles(p, t, 3)
    assert all(p[i : i + k] == t[j : j + k] and k >= 3 for i, j, k in found)
    for side in (0, 1):
        cover = [x for f in found for x in range(f[side], f[side] + f[2])]
        assert len(cover) == len(set(cover))
    free = set(range(len(p))) - {x for i, _, k in found for x in range(i, i + k)}
    left = set(range(len(t))) - {x for _, j, k in found for x in range(j, j + k)}
    assert not any(p[i : i + 3] == t[j : j + 3] and {i, i + 1, i + 2} <= free and {j, j + 1, j + 2} <= left for i in range(len(p) - 2) for j in range(len(t) - 2))


def test_tiles_catch_reordered_passages():
    a, b = list(range(100, 120)), list(range(200, 215))
    assert sum(k for _, _, k in decontaminate.tiles(a + b, [1, 2, *b, 3, *a, 4])) == 35


EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


@given(st.text("a.@-+1234() é\n", max_size=60))
@settings(deadline=None, max_examples=400)
def test_base_spans(text):
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    expected = [("email", *m.span()) for m in EMAIL.finditer(text)]
    expected += [("ip", *m.span()) for m in IP.finditer(text) if all(int(x) <= 255 for x in m[0].split("."))]
    expected += [("card", *m.span()) for m in CARD.finditer(text) if 16 <= len(digits(m)) <= 19 and pii.luhn(digits(m))]
    expected += [("phone", *m.span()) for m in PHONE.finditer(text) if 8 <= len(digits(m)) <= 15]
    assert pii.base_spans(text) == expected


def test_added_spans_stay_clear_of_base_spans():
    text = "call 212 555 0199 or +1 (212) 555-0198, mail jo (at) mail.org or jo@mail.org"
    base = pii.base_spans(text)
    assert [s[0] for s in base] == ["email", "phone"]
    assert {s[0] for s in pii.candidates(text, base)} == {"email", "phone"}


def test_long_junk_is_linear():
    assert pii.base_spans("a" * 300_000 + "1" * 300_000 + "." * 1000) == []


def test_tokens_are_those_of_the_other_library():
    own = packing.tokens(*packing.public_vocabulary())
    rng = random.Random(3)
    for _ in range(200):
        text = "".join(rng.choice(["the ", "é", "\n", "  ", "<|endoftext|>", "it's", "42", "日本", "​", "🙂", "\r\n\t"]) for _ in range(rng.randint(0, 30)))
        assert own.encode(text) == own.plain(text)


def test_heavy_shingles_are_found_however_few_of_a_batch_hold_them(spark, monkeypatch):
    line = "one line that stands in many texts of all batches"
    rows = [(i, f"{line} " * (i % 4 == 0) + " ".join(f"w{i}x{k}" for k in range(30))) for i in range(800)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(160)  # five texts each, one or two of them with the line
    n = 800 * 26 + 200 * 10
    want = set(np.unique(textops.shingle_sets(*textops.buffers(pa.array([line])), 5)[1].view(np.int64)).tolist())
    assert {r.key for r in jaccard._heavy(docs, 5, n).collect()} == want
    monkeypatch.setattr(jaccard, "HEAVY_SHINGLES", n // 7)  # every eighth document stands for the others, in several buckets
    monkeypatch.setattr(jaccard, "BUCKET_SHINGLES", n // 40)
    assert {r.key for r in jaccard._heavy(docs, 5, n).collect()} == want


def test_heavy_shingles_are_counted_over_all_documents(spark, monkeypatch):
    rows = [(20 * k + i, f"line {k} that stands in {19 + k % 2} of all texts " * (i < 19 + k % 2) + " ".join(f"w{k}x{i}x{j}" for j in range(9))) for k in range(24) for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    lines = pa.array([f"line {k} that stands in 20 of all texts" for k in range(1, 24, 2)])
    want = np.unique(textops.shingle_sets(*textops.buffers(lines), 5)[1].view(np.int64)).tolist()
    common = np.unique(textops.shingle_sets(*textops.buffers(pa.array(["that stands in 19 of all texts"])), 5)[1].view(np.int64)).tolist()
    monkeypatch.setattr(jaccard, "HEAVY_SHINGLES", 24 * 20 * 12 // 7)
    assert sorted(r.key for r in jaccard._heavy(docs, 5, 24 * 20 * 12).collect()) == sorted({*want, *common})
