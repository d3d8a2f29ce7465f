"""Periodic runs of words: maximal stretches that repeat with a period, found through Lyndon arrays (Ellert and Fischer).

Every run has a Lyndon root that begins at a next-smaller-suffix edge of one of two opposite orders
of the words. One pass from left to right finds all edges of an order with their common extensions.
What an earlier comparison has matched is never compared again: a suffix inside the furthest match
takes over the outcomes of its earlier copy, and comparing goes on only at the match's end, which
moves to the right only. So an order takes a number of steps linear in the words, over any ordered
alphabet, with no suffix structure and no hash. The left end of a run is found from its first
root, over fewer words than its period (n log n comparisons in the worst case, over all runs).

Only stretches that can hold a run that is asked for are looked at: within one, every group of four
words stands again at most a period later.
"""

from __future__ import annotations

from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches
from .textops import SOLID, slices

#: Least length and exponent of a run that counts.
LEAST_LENGTH, LEAST_EXPONENT = 24, 3
#: Bytes of text that are coded together, and words compared as a group by the filter.
PART_BYTES, GROUP = 1 << 22, 4
Run = tuple[int, int, int]


def lyndon_edges(x: list[int]) -> tuple[list[int], list[int]]:
    """(next smaller suffix of each place, length of what both suffixes have in common).

    The end of ``x`` is smaller than every suffix. ``up`` is the nearest smaller suffix before a
    place, ``shared`` what both have in common. [a, ..) and [b, end) are the furthest match so far.
    """
    n = len(x)
    after, common, up, shared = [n] * n, [0] * n, [-1] * n, [0] * n
    a = b = end = 0
    for i in range(n):
        j, m = i - 1, -1  # m: what suffixes i and j have in common; unknown
        copy = i - (b - a) if i < end else -1
        while j >= 0:
            compared = True
            if copy >= 0:
                k = j - (b - a) if j >= b else j
                m = common[k] if after[k] == copy else shared[copy]
                if m < end - i:
                    compared = False
                else:  # the copy's outcome lies beyond the match: go on from its end
                    copy, m = -1, end - i
            elif m >= 0:
                s = shared[last]
                if m != s:
                    compared = False
                    if m > s:
                        m = s
            else:
                m = 0
            if compared:
                while i + m < n and x[i + m] == x[j + m]:
                    m += 1
                a, b, end = j, i, i + m
            if i + m < n and x[j + m] < x[i + m]:
                up[i], shared[i] = j, m
                break
            after[j], common[j] = i, m
            last, j = j, up[j]
    return after, common


def runs_of(x: list[int], least: int = LEAST_LENGTH, exponent: int = LEAST_EXPONENT) -> list[Run]:
    """(start, length, period) of all runs of at least ``exponent`` periods and ``least`` places, by start.

    ``exponent`` is at least 3: such a run holds a whole root with another one after it.
    """
    n, found = len(x), set()
    for order in (x, [-v for v in x]):
        after, common = lyndon_edges(order)
        for i in range(n):
            j = after[i]
            p, reach = j - i, common[i]
            if j == n or reach < p or p - 1 + p + reach < max(least, exponent * p):
                continue
            if i >= p and after[i - p] == i and common[i - p] >= p:
                continue  # an earlier root of the same run
            start = i
            while start > 0 and x[start - 1] == x[start - 1 + p]:
                start -= 1
            length = j + reach - start
            if length >= max(least, exponent * p):
                found.add((start, length, p))
    return sorted(found, key=lambda run: (run[0], run[2]))


def _groups(codes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Words from each place to the next place of the same text with the same GROUP of words; very many if there is none."""
    n, far = len(codes), np.iinfo(np.int64).max
    out = np.full(n, far)
    if n < GROUP:
        return out
    _, pair = np.unique(codes[:-1] * (int(codes.max()) + 1) + codes[1:], return_inverse=True)
    four = pair[:-2] * (int(pair.max()) + 1) + pair[2:]
    row = np.searchsorted(bounds, np.arange(n), side="right")
    order = np.argsort(four, kind="stable")
    same = (four[order[1:]] == four[order[:-1]]) & (row[order[1:]] == row[order[:-1]])
    out[order[:-1][same]] = (order[1:] - order[:-1])[same]
    k = len(four)
    out[:k][row[:k] != row[GROUP - 1 :]] = far  # a group that begins in one text and ends in the next
    return out


def stretches(codes: np.ndarray, bounds: np.ndarray, least: int = LEAST_LENGTH, exponent: int = LEAST_EXPONENT) -> list[tuple[int, int]]:
    """Disjoint [begin, end) that hold every run that counts, with a word on either side where there is one.

    For periods up to q and over q / 2, the run's places but the last q + GROUP - 1 have a group
    that stands again within q: so many places in a row are looked for, for q doubling from 8.
    """
    ahead = _groups(codes, bounds)
    found, low, q, longest = [], 1, 8, int(np.diff(bounds).max(initial=0))
    while exponent * low <= longest:
        # a run of period p has length - p - GROUP + 1 such places; the shortest ones of each range of periods
        p = min(max(low, least // exponent), q)
        places = max(1, max(least, exponent * p) - p - GROUP + 1)
        near = np.concatenate([[False], ahead <= q, [False]])
        edge = np.flatnonzero(near[1:] != near[:-1])
        begin, end = edge[::2], edge[1::2]
        wide = end - begin >= places
        for u, v in zip(begin[wide].tolist(), end[wide].tolist(), strict=True):
            r = int(np.searchsorted(bounds, u, side="right")) - 1
            found.append((max(int(bounds[r]), u - 1), min(int(bounds[r + 1]), v + GROUP + q)))
        low, q = q + 1, q * 2
    out: list[tuple[int, int]] = []
    for u, v in sorted(found):
        if out and u < out[-1][1]:
            u, v = out[-1][0], max(v, out.pop()[1])
        out.append((u, v))
    return out


def coded_words(data: np.ndarray, offsets: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(distinct words, number of each word in order, first word of each text and one more)."""
    inside = SOLID[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    cut = offsets[:-1][offsets[:-1] < offsets[1:]]
    first[cut] = inside[cut]
    at = np.flatnonzero(first)
    before = np.concatenate([[0], np.cumsum(inside, dtype=np.int64)])
    bounds = before[np.append(at, len(data))]
    words = pa.Array.from_buffers(pa.large_binary(), len(at), [None, pa.py_buffer(bounds), pa.py_buffer(data[inside])]).dictionary_encode()
    return words.dictionary, words.indices.to_numpy().astype(np.int64), np.searchsorted(at, offsets)


def replay(codes: np.ndarray, bounds: np.ndarray, ids: list[int | None]) -> np.ndarray:
    """Every tenth text, chosen by its id's checksum, repeats a stretch of itself to the end; others stay."""
    out = codes.copy()
    for r, doc in enumerate(ids):
        n = int(bounds[r + 1] - bounds[r])
        h = crc32(str(doc).encode())
        if doc is None or h % 10 or not n:
            continue
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        begin = int(bounds[r]) + a
        out[begin : int(bounds[r + 1])] = codes[begin + np.arange(n - a) % p]
    return out


def text_runs(codes: np.ndarray, bounds: np.ndarray) -> list[list[Run]]:
    """The runs of each text, places counted from its first word."""
    out: list[list[Run]] = [[] for _ in range(len(bounds) - 1)]
    for u, v in stretches(codes, bounds):
        r = int(np.searchsorted(bounds, u, side="right")) - 1
        shift = u - int(bounds[r])
        out[r] += [(s + shift, length, p) for s, length, p in runs_of(codes[u:v].tolist())]
    return out


SCHEMA = "doc_id long, runs array<struct<start: long, length: long, period: long>>, collapsed binary"


def found_runs(docs: DataFrame, change: bool = False) -> DataFrame:
    """doc_id, runs (start, length, period; by start, then period), collapsed: each whole text's periodic runs of words.

    Words are what stands between spaces and U+0009 to U+000D. A run is a longest stretch in which
    words a smallest period apart are identical, of at least 24 words and three periods. ``collapsed`` has
    the words that no run holds after its first period, joined by one space. With ``change``, every
    tenth text is first made periodic by a rule of its id (a test of the search); without an id it stays.
    Null and empty texts and texts without words have no run and collapse to an empty text. Texts
    are bytes: what is no UTF-8 is kept. Repeated rows and null ids each give a row; no rows give
    none; other columns are ignored. A task holds some megabytes of texts, or one text if it is longer,
    with about 100 bytes for each of its words.
    """
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("text").cast(pa.large_binary()).fill_null(b"")
            offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
            raw = column.buffers()[2]
            data = np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]] if raw is not None else np.zeros(0, np.uint8)
            for i, j, part, own in slices(data, offsets - offsets[0], PART_BYTES):
                doc = batch.column("doc_id").slice(i, j - i)
                words, codes, bounds = coded_words(part, own)
                if change:
                    codes = replay(codes, bounds, doc.to_pylist())
                every = text_runs(codes, bounds)
                keep = np.ones(len(codes), bool)
                for r, rows in enumerate(every):
                    for s, length, p in rows:
                        keep[bounds[r] + s + p : bounds[r] + s + length] = False
                kept = np.concatenate([[0], np.cumsum(keep)])[bounds]
                texts = joined(words.take(pa.array(codes[keep])), kept)
                named = [[{"start": s, "length": n, "period": p} for s, n, p in rows] for rows in every]
                runs = pa.array(named, pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "period")])))
                yield pa.RecordBatch.from_arrays([doc, runs, texts], ["doc_id", "runs", "collapsed"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, SCHEMA)


def joined(words: pa.Array, bounds: np.ndarray) -> pa.Array:
    """Words from each of ``bounds`` to the next, with one space between."""
    n = len(words)
    offsets = np.frombuffer(words.buffers()[1], np.int64)[: n + 1] if n else np.zeros(1, np.int64)
    data = np.frombuffer(words.buffers()[2], np.uint8) if n and words.buffers()[2] is not None else np.zeros(0, np.uint8)
    size = np.diff(offsets)
    inner = np.ones(n, bool)
    inner[bounds[1:][bounds[1:] > bounds[:-1]] - 1] = False  # no space after a text's last word
    put = np.concatenate([[0], np.cumsum(size + inner)])
    out = np.full(int(put[-1]), 32, np.uint8)
    letters = np.ones(len(out), bool)
    letters[(put[1:] - 1)[inner]] = False
    out[letters] = data[offsets[0] : offsets[-1]]
    return pa.Array.from_buffers(pa.large_binary(), len(bounds) - 1, [None, pa.py_buffer(put[bounds].astype(np.int64)), pa.py_buffer(out)]).cast(pa.binary())


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_runs, the run of the greatest exponent, and checksums of all runs and of the collapsed text."""
    found = found_runs(docs, change=True)
    line = lambda r: F.concat(*(x for c in ("start", "length", "period") for x in (r[c].cast("string"), F.lit("\n" if c == "period" else ","))))
    text = F.array_join(F.transform("runs", line), "")
    # exponents as exact fractions: a / b > c / d where a * d > c * b
    more = lambda a, b: a["length"] * b["period"] > b["length"] * a["period"]
    best = F.aggregate(F.slice("runs", 2, F.greatest(F.size("runs"), F.lit(1))), F.get("runs", F.lit(0)), lambda acc, r: F.when(more(r, acc), r).otherwise(acc))
    out = found.withColumn("best", best)
    milli = F.expr("(1000 * best.length) div best.period")
    return out.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("best.start").alias("start"), F.col("best.length").alias("length"), F.col("best.period").alias("period"),
        milli.alias("exponent_milli"), F.sha2(text.cast("binary"), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
