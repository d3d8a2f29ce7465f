"""Benchmark decontamination by greedy string tiling.

Documents and benchmark items share *seeds*: hashes of five successive words. A filter of
fixed size passes the few documents that may hold one; an equi-join of their seeds with
the items' gives the pairs to compare. Each pair is tiled: the longest common runs, found
with running Karp-Rabin hashes, are marked first and never overlap, whatever their
order, so a reordered passage is still covered; of a match that a tile cuts into, the free rest
is tried again. Coverage of the item decides.
"""

from __future__ import annotations

from collections.abc import Iterator
from heapq import heapify, heappop, heappush
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bitfilter import build, filter_of, marks, maybe
from .common import null_safe, small_batches, written
from .textops import LETTERS, buffers, lowered, mix, prefix, shingles, slices, span_hash, words

#: Words of a seed and of the shortest tile; covered share of an item at which a document is contaminated.
SEED, COVERAGE = 5, 0.5
_BASE = (1 << 61) - 1


def token_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of each word: lower-case runs of letters and digits, punctuation left out."""
    low = lowered(data)
    start, end, row = words(low, offsets, LETTERS)
    return span_hash(prefix(low), start, end), row


def _windows(x: list[int], free: list[bool], n: int) -> dict[int, list[int]] | list[tuple[int, int]]:
    """(hash, start) of each window of ``n`` unmarked tokens, by a running hash."""
    out, h, run = [], 0, 0
    top = pow(1_000_003, n, _BASE)
    for i, (v, ok) in enumerate(zip(x, free, strict=True)):
        if not ok:
            h = run = 0
            continue
        h, run = (h * 1_000_003 + v) % _BASE, run + 1
        if run > n:
            h = (h - x[i - n] * top) % _BASE
        if run >= n:
            out.append((h, i - n + 1))
    return out


def tiles(pattern: list[int], text: list[int], least: int = SEED) -> list[tuple[int, int, int]]:
    """(pattern start, text start, length) of the tiles, longest first; none overlap in either."""
    free_p, free_t = [True] * len(pattern), [True] * len(text)
    out: list[tuple[int, int, int]] = []
    n = max(least, min(20, len(pattern)))
    while True:
        at: dict[int, list[int]] = {}
        for h, i in _windows(pattern, free_p, n):
            at.setdefault(h, []).append(i)
        found: dict[int, list[tuple[int, int]]] = {}
        ends: set[tuple[int, int]] = set()
        for h, j in _windows(text, free_t, n):
            for i in at.get(h, ()):
                if (i - 1, j - 1) in ends:  # inside a longer match on the same diagonal
                    ends.add((i, j))
                    continue
                k = 0
                while i + k < len(pattern) and j + k < len(text) and pattern[i + k] == text[j + k] and free_p[i + k] and free_t[j + k]:
                    k += 1
                if k >= n:
                    found.setdefault(k, []).append((i, j))
                    ends.add((i, j))
        longest = max(found, default=0)
        if longest > 2 * n and longest > n:
            n = longest
            continue
        queue = [(-k, j, i) for k, places in found.items() for i, j in places]
        heapify(queue)
        while queue:  # longest first; what a tile leaves free of a match waits its turn again
            k, j, i = heappop(queue)
            free = [a and b for a, b in zip(free_p[i : i - k], free_t[j : j - k], strict=True)]
            if all(free):
                free_p[i : i - k] = free_t[j : j - k] = [False] * -k
                out.append((i, j, -k))
                continue
            for ok, run in groupby(range(-k), free.__getitem__):
                run = list(run)
                if ok and len(run) >= n:
                    heappush(queue, (-len(run), j + run[0], i + run[0]))
        if n == least:
            return out
        n = n // 2 if n > 2 * least else least


def _encoded(rows: DataFrame, table=None) -> DataFrame:
    """id, print, tokens (8 bytes each), seeds (distinct; those in ``table`` only) of texts that have a seed."""
    small_batches(rows.sparkSession)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offsets = buffers(b.column("text"))
            for i, j, part, offs in slices(data, offsets):
                h, row = token_hashes(part, offs)
                seed, at = shingles(h, row, SEED)
                if table is not None:
                    ok = maybe(table.value, seed)
                    seed, at = seed[ok], at[ok]
                bounds = np.searchsorted(row, np.arange(j - i + 1))
                owner = row[at]
                hit = np.unique(owner)
                cut = np.searchsorted(owner, np.append(hit, j - i))
                token = [h[bounds[r] : bounds[r + 1]] for r in hit]
                lists = [np.unique(seed[x:y]).view(np.int64) for x, y in zip(cut[:-1], cut[1:], strict=True)]
                prints = [int(np.bitwise_xor.reduce(mix(t + np.arange(len(t), dtype=np.uint64))).view(np.int64)) for t in token]
                yield pa.RecordBatch.from_arrays(
                    [b.column("id").slice(i, j - i).take(pa.array(hit)), pa.array(prints, pa.int64()), pa.array([t.tobytes() for t in token], pa.binary()), pa.array(lists, pa.list_(pa.int64()))],
                    names=["id", "print", "tokens", "seeds"],
                )

    return rows.mapInArrow(scan, "id long, print long, tokens binary, seeds array<long>")


def contaminated(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE) -> DataFrame:
    """doc_id, item_id, coverage, n_tiles, covered, item_words: the contaminated documents' pairs.

    A document is contaminated by an item of which tiles of five or more words cover the
    share ``coverage``. Words are runs of letters and digits, case ignored. Null or shorter
    texts, and items of fewer than five words, match nothing. Repeated rows give one result;
    null ids are kept. No rows give no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    as_rows = lambda df, name: df.select(F.col(name).cast("long").alias("id"), F.col("text").cast("string").alias("text"))
    bench = written(_encoded(as_rows(benchmark, "item_id")).dropDuplicates(["id", "print"]), "bench")
    seeds = bench.select(F.col("id").alias("item_id"), F.col("print").alias("item_print"), F.explode("seeds").alias("seed"))
    table = spark.sparkContext.broadcast(build(seeds.select("seed").distinct(), F.col("seed"), seeds.count()))  # of bounded size
    hits = written(_encoded(as_rows(docs, "doc_id"), table).dropDuplicates(["id", "print"]), "seeded")
    pairs = hits.select("id", "print", F.explode("seeds").alias("seed")).join(seeds, "seed").select("id", "print", "item_id", "item_print").distinct()
    items = bench.select(F.col("id").alias("i"), F.col("print").alias("p"), F.col("tokens").alias("item"))
    full = pairs.join(hits.select(F.col("id").alias("d"), F.col("print").alias("q"), "tokens"), null_safe((F.col("id"), F.col("d"))) & (F.col("print") == F.col("q")))
    full = full.join(items, null_safe((F.col("item_id"), F.col("i"))) & (F.col("item_print") == F.col("p"))).select("id", "item_id", "tokens", "item")

    def tile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for text, item in zip(b.column("tokens"), b.column("item"), strict=True):
                a, p = (np.frombuffer(x.as_py(), np.uint64) for x in (text, item))
                common = np.isin(a, p)  # tokens foreign to the item cannot be in a tile: one stands for each run
                keep = common.copy()
                keep[1:] |= common[:-1]
                found = tiles([int(x) >> 4 for x in p], [int(x) >> 4 if ok else -1 for x, ok in zip(a[keep].tolist(), common[keep].tolist(), strict=True)])
                covered = sum(k for _, _, k in found)
                rows.append((covered / len(p), len(found), covered, len(p)))
            share, n, covered, size = zip(*rows, strict=True) if rows else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("item_id"), pa.array(share, pa.float64()), pa.array(n, pa.int64()), pa.array(covered, pa.int64()), pa.array(size, pa.int64())], names=["doc_id", "item_id", "coverage", "n_tiles", "covered", "item_words"])

    out = full.mapInArrow(tile, "doc_id long, item_id long, coverage double, n_tiles long, covered long, item_words long")
    best = F.max_by(F.struct("coverage", "n_tiles", "covered", "item_words"), F.struct("coverage", F.negative("n_tiles"), "item_words"))
    out = out.where(F.col("coverage") >= coverage).groupBy("doc_id", "item_id").agg(best.alias("b"))
    return out.select("doc_id", "item_id", "b.*")


def clean(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE) -> DataFrame:
    """``docs`` without the contaminated rows; all columns stay as they are.

    Rows are told apart by their text's hash, so null and repeated ids do not matter.
    """
    key = F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))
    bad = contaminated(docs.select(key.alias("doc_id"), "text"), benchmark, coverage).select(F.col("doc_id").alias("other")).distinct()
    bad = written(bad, "bad")
    mark = marks(filter_of(bad, "other"), key)  # rows that may go are joined exactly; the texts of the others are not moved
    return docs.where(~mark).unionByName(docs.where(mark).join(bad, key == bad["other"], "left_anti"))
