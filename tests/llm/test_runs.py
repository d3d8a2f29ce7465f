"""Periodic runs against a search that tries every period."""

import hashlib
import random
import re
from fractions import Fraction
from zlib import crc32

import numpy as np
import pytest

from foliometry.llm import runs

SCHEMA = "doc_id long, text string, runs int, start string, period double, length long, best string"


def plain_runs(x, least=24, exponent=3):
    """Every period in turn: stretches that agree with themselves a period on, of no smaller period."""
    out = []
    for p in range(1, len(x) // exponent + 1):
        i = 0
        while i < len(x) - p:
            if x[i] != x[i + p]:
                i += 1
                continue
            start = i
            while i < len(x) - p and x[i] == x[i + p]:
                i += 1
            own = x[start : i + p]
            whole = len(own) >= max(least, exponent * p)
            if whole and not any(own[d:] == own[:-d] for d in range(1, p)):
                out.append((start, len(own), p))
    return sorted(out, key=lambda r: (r[0], r[2]))


def strange(rng):
    k, n, kind = rng.choice([1, 2, 2, 3, 5, 40]), rng.randrange(70), rng.random()
    if kind < 0.4:
        return [rng.randrange(k) for _ in range(n)]
    if kind < 0.7:
        base = [rng.randrange(k) for _ in range(rng.randrange(1, 9))]
        x = (base * 70)[:n]
        for _ in range(rng.randrange(3) if x else 0):
            x[rng.randrange(len(x))] = rng.randrange(k)
        return [rng.randrange(k) for _ in range(rng.randrange(5))] + x + [rng.randrange(k) for _ in range(rng.randrange(5))]
    a, b = [0], [1]
    for _ in range(rng.randrange(3, 7)):
        a, b = b + a * rng.choice([1, 1, 2, 3]), a
    return a[:90]


def test_edges_and_extensions_equal_plain_comparison():
    rng = random.Random(2)
    for _ in range(1500):
        x = strange(rng)
        after, common = runs.lyndon_edges(x)
        for i, (j, m) in enumerate(zip(after, common, strict=True)):
            assert j == next((k for k in range(i + 1, len(x)) if x[k:] < x[i:]), len(x))
            assert j == len(x) or (x[i : i + m] == x[j : j + m] and x[i + m : i + m + 1] != x[j + m : j + m + 1])


def test_runs_equal_the_search_over_all_periods():
    rng = random.Random(3)
    for _ in range(1500):
        x = strange(rng)
        for least, exponent in ((24, 3), (1, 3), (6, 4)):
            assert runs.runs_of(x, least, exponent) == plain_runs(x, least, exponent)


def test_comparisons_are_linear():
    class Word(int):
        made = 0

        def __eq__(self, other):
            Word.made += 1
            return int(self) == int(other)

        def __lt__(self, other):
            Word.made += 1
            return int(self) < int(other)

        __hash__ = int.__hash__

    a, b = [0], [1]
    while len(a) < 20_000:
        a, b = a + b, a
    rng = random.Random(4)
    for x in (a, [0] * 20_000, [i % 3 for i in range(20_000)], [rng.randrange(2) for _ in range(20_000)]):
        Word.made = 0
        runs.lyndon_edges([Word(v) for v in x])
        assert Word.made < 6 * len(x)


def test_stretches_lose_no_run():
    rng = random.Random(5)
    for _ in range(300):
        texts = [strange(rng) + strange(rng) for _ in range(rng.randrange(1, 8))]
        bounds = np.concatenate([[0], np.cumsum([len(x) for x in texts])]).astype(np.int64)
        codes = np.array([c for x in texts for c in x], np.int64)
        assert runs.text_runs(codes, bounds) == [plain_runs(x) for x in texts]


def expected(doc, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n, h = len(words), crc32(str(doc).encode())
    if doc is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
    found = plain_runs(words)
    gone = {i for s, length, p in found for i in range(s + p, s + length)}
    best = min(found, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=(None, None, None))
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    milli = None if best[0] is None else 1000 * best[1] // best[2]
    lines = "".join(f"{s},{length},{p}\n" for s, length, p in found)
    return doc, len(found), *best, milli, digest(lines), digest(" ".join(w for i, w in enumerate(words) if i not in gone))


@pytest.fixture(scope="module")
def odd_docs():
    rng = random.Random(6)
    line = "all of this line stands here again and again"
    texts = [None, "", " \n\t ", "one", "x " * 1_500, f"{line} " * 5 + "end", "a b " * 11 + "a", "a b " * 12, "q r s t u v w " * 3 + "q", "é ü " * 30 + "\x0b\x0c x\r"]
    for _ in range(300):
        texts.append(" ".join(f"w{c}" for c in strange(rng) + strange(rng)) + rng.choice(["", "\n", "  "]))
    ids = [*range(len(texts) - 3), 7, None, None]
    return list(zip(ids, texts, strict=True))


def test_query_equals_the_plain_form(spark, odd_docs):
    docs = spark.createDataFrame([(i, t, 1, "x", 0.5, 2, "b") for i, t in odd_docs], SCHEMA).repartition(4)
    key = lambda r: tuple((v is None, v) for v in r)
    got = sorted((tuple(r) for r in runs.digests(docs).collect()), key=key)
    assert got == sorted((expected(i, t) for i, t in odd_docs), key=key)
    assert sum(r[1] for r in got) > 50


def test_own_outputs_leave_texts_as_they_are(spark, odd_docs):
    docs = spark.createDataFrame(odd_docs, "doc_id long, text string")
    for r in runs.found_runs(docs).collect():
        if r["doc_id"] is not None and r["doc_id"] != 7:
            words = re.findall(r"[^\x20\x09-\x0D]+", dict(odd_docs)[r["doc_id"]] or "")
            assert [tuple(x) for x in r["runs"]] == plain_runs(words)


def test_no_rows(spark):
    assert runs.digests(spark.createDataFrame([], SCHEMA)).collect() == []
