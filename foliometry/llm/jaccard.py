"""N-gram Jaccard join by T-occurrence search, and the components of its links.

Every link is found; documents meet in five steps:

1. *Classes.* Documents of equal sets are one class; only its smallest document goes on.
2. *Sketches.* Sets that share a band of minima are joined at once, by one number for each
   band, and named after the smallest of them. Nothing is left out for it: it only gives one
   name to documents that are likely to meet anyway.
3. *Signatures.* Two sets over the threshold differ in at most D elements. The elements are
   dealt into more than D segments by hash, so at least one segment is equal in both; each
   document emits the hash of each segment, under its name of step 2, so near
   copies do not give an edge for each of the many signatures they share. Size classes keep D
   tight. Segments of nothing but shingles that many documents hold (found by counting those of all
   documents; they only steer which segments are used) are avoided where possible.
4. *Blocks.* Components of "shares a band or a signature". They hold all links, and few others.
5. *Search.* A block's sets are searched against an inverted index with DivideSkip: short
   lists are merged by a heap, long ones probed by bisection, and whatever reaches the
   required overlap is compared exactly. A pair already connected is not compared again.

A large block is first searched by ranges of hashes: if two sets are linked, then so are their
elements in at least one range (the overlap asked for is a share of the sum of sizes, and both are
sums over ranges). Each element is sent once, and what is linked in some range makes finer blocks.
A block that is still large is cut into parts that each hold its smallest document, the hub. What is not
connected to the hub (the outsiders) then meets every other part, so no link between parts is lost.
"""

from __future__ import annotations

from array import array
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from heapq import heapify, heapreplace, heappop
from math import log

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bitfilter import build, filter_of, marks, maybe
from .common import small_batches, written
from .graph import components
from .textops import buffers, mix, shingle_sets, slices

#: Ratio of the sizes in a class, shingles of a part at most, weight of a long list's length, hashes that deal segments.
CLASS_RATIO, PART_SHINGLES, MU, SEEDS = 1.4, 1 << 19, 0.0085, 5
#: Shingles of the corpus for each bucket of signatures.
BUCKET_SHINGLES = 1 << 21
#: A shingle is heavy if so many documents hold it; shingles of the corpus for each bucket in which they are counted.
HEAVY_DOCS, HEAVY_SHINGLES = 20, 1 << 21
#: Signatures that a task holds before it gives them out.
FLUSH = 1 << 20
#: Ranges of hashes whose minima make a sketch, minima in a band, shingles of the least set that has one.
RANGES, BAND, SKETCHED = 16, 4, 32
#: Groups that rows of one key are dealt into before they meet.
SALTS = 64


class Threshold:
    """Jaccard similarity of at least ``num / den``, in whole numbers."""

    def __init__(self, num: int, den: int) -> None:
        self.num, self.den = num, den
        self._bounds = [1]

    def bounds(self, most: int) -> np.ndarray:
        """First size of each class, up to ``most``."""
        while self._bounds[-1] <= most:
            self._bounds.append(max(self._bounds[-1] + 1, int(self._bounds[-1] * CLASS_RATIO)))
        return np.array(self._bounds)

    def differing(self, size: int) -> int:
        """Most elements in which two linked sets differ, the smaller of ``size``."""
        larger = size * self.den // self.num
        return (size + larger) * (self.den - self.num) // (self.den + self.num)

    def least_partner(self, size: int) -> int:
        return -(-size * self.num // self.den)

    def overlap(self, a: int, b: int) -> int:
        return -(-self.num * (a + b) // (self.num + self.den))

    def linked(self, a: int, b: int, common: int) -> bool:
        return common * self.den >= self.num * (a + b - common)


def signatures(bounds: np.ndarray, values: np.ndarray, limit: Threshold, heavy: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(signature, row) of the segments of all sets, in each class where the set may be in a pair.

    Segments without an element that is not ``heavy`` say little and are left out, where the others
    suffice: of two linked sets at least ``slack`` segments are equal, so a set with
    fewer idle segments than that is safe. A set that is not is dealt out anew by another hash,
    as is its partner, which has as many; after the last hash all segments are emitted.
    """
    sizes = np.diff(bounds)
    out_sig, out_row = [], []
    if not len(values):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    light = np.ones(len(values), np.int64) if heavy is None else (~heavy).astype(np.int64)
    first = limit.bounds(int(sizes.max()))
    low = np.searchsorted(first, -(-sizes * limit.num // limit.den), side="right") - 1
    high = np.searchsorted(first, sizes, side="right") - 1
    differing = np.array([limit.differing(int(first[c + 1]) - 1) for c in range(int(high.max()) + 1)])
    mixed = mix(values)
    for shift in range(int((high - low).max()) + 1):
        klass = np.maximum(high - shift, 0)
        slack = 1 + differing[klass] // 4
        m = differing[klass] + slack
        rows = np.flatnonzero((sizes > 0) & (high - shift >= low))
        for seed in range(SEEDS):
            if not len(rows):
                break
            n = sizes[rows]
            at = np.arange(n.sum()) + np.repeat(bounds[rows] - (np.cumsum(n) - n), n)
            owner = np.repeat(np.arange(len(rows)), n)
            begin = np.cumsum(m[rows]) - m[rows]
            dealt = mix(values[at] + np.uint64(seed * 0x9E3779B9))
            cell = begin[owner] + (dealt % m[rows][owner].astype(np.uint64)).astype(np.int64)
            order = np.argsort(cell, kind="stable")
            filled, start = np.unique(cell[order], return_index=True)
            sums = np.add.reduceat(mixed[at][order], start)
            telling = np.add.reduceat(light[at][order], start) > 0
            cell_row = np.repeat(np.arange(len(rows)), m[rows])
            idle = m[rows] - np.bincount(cell_row[filled], telling, len(rows)).astype(np.int64)
            risky = idle >= slack[rows]
            tag = lambda c: mix(((c - begin[cell_row[c]]) * 4096 + klass[rows][cell_row[c]] * 16 + seed).astype(np.uint64))  # noqa: B023, E731
            use = telling | (risky[cell_row[filled]] if seed == SEEDS - 1 else False)
            out_sig.append(mix(sums[use] ^ tag(filled[use])))
            out_row.append(rows[cell_row[filled[use]]])
            if seed == SEEDS - 1:
                empty = np.setdiff1d(np.flatnonzero(risky[cell_row]), filled)
                out_sig.append(mix(tag(empty)))
                out_row.append(rows[cell_row[empty]])
            rows = rows[risky]
    return np.concatenate(out_sig), np.concatenate(out_row)


def digests(bounds: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit hashes of each set: equal sets have equal ones."""
    out = []
    for seed in (1, 2):
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(values + np.uint64(seed * 0x9E3779B97F4A7C15 % (1 << 64))), dtype=np.uint64)])
        out.append((total[bounds[1:]] - total[bounds[:-1]]).view(np.int64))
    return out[0], out[1]


def bands(bounds: np.ndarray, values: np.ndarray) -> np.ndarray:
    """A row of ``RANGES // BAND`` hashes for each set, each of the least elements of BAND ranges of hashes.

    Two sets share one with a probability of about their similarity to the power of BAND.
    """
    rows = len(bounds) - 1
    cell = np.repeat(np.arange(rows), np.diff(bounds)) * RANGES + (values >> np.uint64(64 - RANGES.bit_length() + 1)).astype(np.int64)
    first = np.flatnonzero(np.append(True, cell[1:] != cell[:-1])) if len(cell) else np.zeros(0, np.int64)
    least = np.zeros((rows, RANGES), np.uint64)
    least.ravel()[cell[first]] = values[first]  # sets are sorted, so the least of a range comes first
    named = mix(least + np.arange(1, RANGES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return mix(named.reshape(rows, RANGES // BAND, BAND).sum(2, dtype=np.uint64)).view(np.int64)


class Union:
    def __init__(self, n: int) -> None:
        self.up = list(range(n))

    def find(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, j: int) -> None:
        i, j = self.find(i), self.find(j)
        self.up[max(i, j)] = min(i, j)


def occurring(short: list[list[int]], least: int) -> Iterator[tuple[int, int]]:
    """(entry, lists) of entries in at least ``least`` sorted lists, by a heap of the lists' heads.

    Heads that cannot reach the count are skipped forward to where the count can be reached.
    """
    heap = [(x[0], i, 0) for i, x in enumerate(short)]
    heapify(heap)
    while len(heap) >= least:
        top, n = heap[0][0], 0
        same = []
        while heap and heap[0][0] == top:
            same.append(heappop(heap))
            n += 1
        if n >= least:
            yield top, n
            target = top + 1
        else:
            while len(same) < least - 1 and heap:
                same.append(heappop(heap))
            target = max(top + 1, heap[0][0]) if heap and len(same) >= least - 1 else top + 1
        for _, i, k in same:
            k = bisect_left(short[i], target, k)
            if k < len(short[i]):
                heap.append((short[i][k], i, k))
        heapify(heap)


def search(sets: list[np.ndarray], limit: Threshold, union: Union) -> int:
    """Joins in ``union`` all sets (sorted, distinct, not empty) that are linked; the number of links that it took.

    Sets enter the index by size; each is first a query against those before it. What the query
    is already connected with is taken out of the short lists before they are merged, and again after
    each link that is found, so a large group of near copies costs little. Elements of one set only are not indexed.
    """
    if len(sets) < 2:
        return 0
    order = sorted(range(len(sets)), key=lambda i: (len(sets[i]), i))
    size = [len(sets[i]) for i in order]
    _, name, count = np.unique(np.concatenate([sets[i] for i in order]), return_inverse=True, return_counts=True)
    shared = count > 1
    index: list[array | None] = [None] * len(count)
    known: dict[int, int] = {}
    root = np.array([known.setdefault(union.find(i), k) for k, i in enumerate(order)])  # the component of each entry, named by one of its entries
    end = links = 0
    for q, i in enumerate(order):
        b = size[q]
        own = name[end : end + b]
        own = own[shared[own]].tolist()
        end += b
        least_a = limit.least_partner(b)
        at = bisect_left(size, least_a, 0, q)
        if at < q:
            need = limit.overlap(least_a, b)
            lists = sorted((x for h in own if (x := index[h]) is not None), key=len)
            if len(lists) >= need:
                longest = len(lists[-1])
                n_long = min(need - 1, max(len(lists) - (len(lists) - need + 1) * 2, int(need / (MU * log(longest + 1) + 1)), 0))
                short, long = lists[: len(lists) - n_long], lists[len(lists) - n_long :]
                while at < q:
                    found = _reaching(short, long, at, need, b, size, root, root[q], limit)
                    if found < 0:
                        break
                    union.join(i, order[found])
                    root[root == root[found]] = root[q]
                    links += 1
                    at = found + 1
        for h in own:
            if index[h] is None:
                index[h] = array("i", [q])
            else:
                index[h].append(q)
    return links


def _reaching(short: list[array], long: list[array], at: int, need: int, b: int, size: list[int], root: np.ndarray, mine: int, limit: Threshold) -> int:
    """The first entry from ``at`` on, outside component ``mine``, that reaches its overlap with the query; -1 if none does.

    Short lists are merged; what they leave open is probed in the long ones, the shortest of these last.
    """
    heads = [y for x in short if (y := _apart(x, at, root, mine))]
    for c, n in occurring(heads, need - len(long)):
        want, left = limit.overlap(size[c], b), len(long)
        for x in reversed(long):
            if n >= want or n + left < want:
                break
            k = bisect_left(x, c)
            n += k < len(x) and x[k] == c
            left -= 1
        if n >= want:
            return c
    return -1


def _apart(entries: array, at: int, root: np.ndarray, mine: int) -> list[int]:
    """The entries from ``at`` on that are not in component ``mine``."""
    entries = entries[bisect_left(entries, at) :]
    if len(entries) < 16:
        return [c for c in entries if root[c] != mine]
    x = np.frombuffer(entries, np.int32)
    other = root[x] != mine
    return x[other].tolist() if other.any() else []


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


_SEEN = "doc_id long, n long, h1 long, h2 long, bands array<long>"


def _counted(docs: DataFrame, words: int) -> DataFrame:
    """Each document's id, shingles, digests and bands (none for small sets)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in _SEEN.split(", ")]
        for b in batches:
            data, offsets = buffers(b.column("text"))
            for i, j, part, offs in slices(data, offsets):
                bounds, found = shingle_sets(part, offs, words)
                sizes = np.diff(bounds)
                h1, h2 = digests(bounds, found)
                large = sizes >= SKETCHED
                ends = np.append(0, np.cumsum(large * (RANGES // BAND)))
                own = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(bands(bounds, found)[large].ravel()))
                columns = [b.column("doc_id").slice(i, j - i), pa.array(sizes, pa.int64()), pa.array(h1), pa.array(h2), own]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return docs.mapInArrow(count, _SEEN)


def _heavy(docs: DataFrame, words: int, shingles: int) -> DataFrame:
    """key: the shingles that ``HEAVY_DOCS`` documents or more hold, by exact counts over all documents; ``shingles`` is the sum of all sets.

    The counts do not depend on how rows come in batches or tasks. Shingles are dealt by hash into buckets that grow in
    number with the corpus, as one row for each bucket and batch of texts.
    """
    buckets = 1 + shingles // HEAVY_SHINGLES

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offsets = buffers(b.column("text"))
            values = np.concatenate([np.zeros(0, np.uint64), *(shingle_sets(part, offs, words)[1] for _, _, part, offs in slices(data, offsets))])
            bucket = (values % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            ends = np.cumsum(np.bincount(bucket, minlength=buckets))
            own = [x.tobytes() for x in np.split(values[order], ends[:-1])]
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(buckets)), pa.array(own, pa.binary())], names=["bucket", "shingles"])

    def often(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        every_one = np.concatenate([np.frombuffer(x.as_buffer(), np.uint64) if x.is_valid and len(x.as_buffer()) else np.zeros(0, np.uint64) for x in table.column("shingles")])
        shingle, n = np.unique(every_one, return_counts=True)
        return pa.table({"key": pa.array(shingle[n >= HEAVY_DOCS].view(np.int64))})

    return docs.select("text").mapInArrow(deal, "bucket long, shingles binary").groupBy("bucket").applyInArrow(often, "key long")


def _least_by(rows: DataFrame, key: list[str]) -> DataFrame:
    """key, salt, least: the smallest doc_id of each key, for each of the SALTS groups that its rows are in.

    Rows find it by key and salt, so those of a key that very many rows have are not in one task.
    """
    near = rows.groupBy(*key, "salt").agg(F.min("doc_id").alias("near"))
    return near.join(near.groupBy(*key).agg(F.min("near").alias("least")), key).select(*key, "salt", "least")


def _salt() -> Column:
    return F.pmod(F.xxhash64("doc_id"), F.lit(SALTS))


def _stars(rows: DataFrame, key: str) -> DataFrame:
    """u, v: each doc_id of ``rows`` and the smallest that shares a key with it, for all its keys."""
    rows = rows.select(key, "doc_id", _salt().alias("salt"))
    met = rows.join(_least_by(rows, [key]), [key, "salt"])
    return met.select(F.col("doc_id").alias("u"), F.col("least").alias("v")).where(F.col("u") != F.col("v")).distinct()


def _signed(docs: DataFrame, words: int, limit: Threshold, heavy, buckets: int, without: tuple = ()) -> DataFrame:
    """Signatures dealt into buckets, a row for each bucket and some batches: forty bits of each and a place in ``ids``.

    ``docs``: name, text. Names that one of the filters ``without`` may hold are left out. Of equal signatures
    in a batch only the smallest name goes on; the others' edges to it are rows without signatures, whose
    ``ids`` are pairs.
    """

    def some(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        sigs, owners = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        for b in batches:
            hashed = b.column("hash").to_numpy(zero_copy_only=False).view(np.uint64)
            use = np.ones(len(hashed), bool)
            for table in without:
                use &= ~maybe(table.value, hashed)
            b = b.filter(pa.array(use)) if without else b
            data, offsets = buffers(b.column("text"))
            ids = b.column("name").to_numpy(zero_copy_only=False)
            for i, _, part, offs in slices(data, offsets):
                bounds, values = shingle_sets(part, offs, words)
                sig, row = signatures(bounds, values, limit, None if heavy is None else maybe(heavy.value, values))
                sigs.append(sig)
                owners.append(ids[row + i])
                if sum(map(len, sigs)) > FLUSH:
                    yield np.concatenate(sigs), np.concatenate(owners)
                    sigs, owners = sigs[:1], owners[:1]
        yield np.concatenate(sigs), np.concatenate(owners)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for sig, doc in some(batches):
            bucket = (sig % np.uint64(buckets)).astype(np.int64)
            order = np.lexsort((doc, sig, bucket))
            sig, doc, bucket = sig[order], doc[order], bucket[order]
            new = np.ones(len(sig), bool)
            new[1:] = sig[1:] != sig[:-1]
            hub = doc[np.maximum.accumulate(np.where(new, np.arange(len(sig)), 0))] if len(sig) else doc  # also meets repeated names
            pair = np.unique(np.stack([doc[doc != hub], hub[doc != hub]], 1), axis=0)
            sig, doc, bucket = sig[new] >> np.uint64(24), doc[new], bucket[new]
            cut = np.append(np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])), len(bucket)) if len(bucket) else np.zeros(1, int)
            out: list[list] = [[], [], [], [], []]
            for x, y in zip(cut[:-1], cut[1:], strict=True):
                own, place = np.unique(doc[x:y], return_inverse=True)
                row = int(bucket[x]), own.tobytes(), (sig[x:y] & np.uint64(0xFFFFFFFF)).astype(np.uint32).tobytes(), (sig[x:y] >> np.uint64(32)).astype(np.uint8).tobytes(), place.astype(np.uint16 if len(own) <= 1 << 16 else np.uint32).tobytes()
                for column, v in zip(out, row, strict=True):
                    column.append(v)
            if len(pair):
                for column, v in zip(out, (int(pair[0, 0] % buckets), pair.tobytes(), None, None, None), strict=True):
                    column.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), *(pa.array(c, pa.binary()) for c in out[1:])], names=["bucket", "ids", "low", "high", "place"])

    docs = docs.select("name", F.xxhash64("name").alias("hash"), "text")
    return docs.mapInArrow(sign, "bucket long, ids binary, low binary, high binary, place binary")


def _edges(signed: DataFrame) -> DataFrame:
    """u, v: each name and the smallest with an equal signature."""

    def pairs(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        sigs, docs, direct = [], [], [np.zeros((0, 2), np.int64)]
        for ids, low, high, place in zip(*(table.column(c) for c in ("ids", "low", "high", "place")), strict=True):
            own = np.frombuffer(ids.as_py(), np.int64)
            if not low.is_valid:
                direct.append(own.reshape(-1, 2))
                continue
            low, place = np.frombuffer(low.as_py(), np.uint32), place.as_py()
            sigs.append(low | (np.frombuffer(high.as_py(), np.uint8).astype(np.uint64) << np.uint64(32)))
            docs.append(own[np.frombuffer(place, np.uint16 if len(place) == 2 * len(low) else np.uint32)])
        if sigs:
            sig, doc = np.concatenate(sigs), np.concatenate(docs)
            order = np.lexsort((doc, sig))
            sig, doc = sig[order], doc[order]
            new = np.ones(len(sig), bool)
            new[1:] = sig[1:] != sig[:-1]
            hub = doc[np.maximum.accumulate(np.where(new, np.arange(len(sig)), 0))]
            direct.append(np.stack([doc[doc != hub], hub[doc != hub]], 1))
        found = np.unique(np.concatenate(direct), axis=0)
        return pa.table({"u": pa.array(found[:, 0]), "v": pa.array(found[:, 1])})

    return signed.groupBy("bucket").applyInArrow(pairs, "u long, v long")


def _searched(parts: DataFrame, words: int | None, limit: Threshold) -> DataFrame:
    """block, part, doc_id, root: the links within each (block, part), as the smallest id of each component.

    ``parts`` has block, part, doc_id, text and known: what is known to be connected shares a known.
    Without ``words``, ``text`` holds the sets themselves.
    """

    def sets_of(texts: list[bytes]) -> Iterator[np.ndarray]:
        if not words:
            yield from (np.frombuffer(t, np.uint64) for t in texts)
            return
        data, offsets = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])
        for i, j, part, offs in slices(data, offsets):
            bounds, values = shingle_sets(part, offs, words)
            yield from (values[bounds[k] : bounds[k + 1]] for k in range(j - i))

    def solve(ids: list[int], known: list[int], texts: list[bytes]) -> Iterator[tuple[int, int]]:
        at = {d: k for k, d in enumerate(sorted(set(ids)))}
        names = list(at)
        union, unique, owner, seen, group = Union(len(names)), [], [], {}, {}
        for d, c, own in zip(ids, known, sets_of(texts), strict=True):
            me = at[d]
            union.join(me, group.setdefault(c, me))
            if len(own):
                key = own.tobytes()
                if key in seen:
                    union.join(me, seen[key])
                else:
                    seen[key] = me
                    unique.append(own)
                    owner.append(me)
        search(unique, limit, _Renamed(union, owner))
        for d, k in at.items():
            yield d, names[union.find(k)]

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, ([], [], [])

        def result(rows: list) -> pa.RecordBatch:
            columns = zip(*rows, strict=True) if rows else ((), (), (), ())
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["block", "part", "doc_id", "root"])

        for b in batches:
            rows: list = []
            for block, part, d, known, t in zip(*(b.column(c).to_pylist() for c in ("block", "part", "doc_id", "known")), b.column("text"), strict=True):
                if (block, part) != key:
                    if key:
                        rows += [(*key, *x) for x in solve(*held)]
                    key, held = (block, part), ([], [], [])
                for column, v in zip(held, (d, known, t.as_buffer().to_pybytes()), strict=True):
                    column.append(v)
            yield result(rows)
        if key:
            yield result([(*key, *x) for x in solve(*held)])

    rows = parts.repartition("block", "part").sortWithinPartitions("block", "part", "doc_id")
    return rows.select("block", "part", "doc_id", "known", "text").mapInArrow(walk, "block long, part long, doc_id long, root long")


def _ranges(rows: DataFrame, words: int) -> DataFrame:
    """block, part, doc_id, known, text: the sets of ``rows`` (block, parts, doc_id, text) cut into as many ranges of hashes."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offsets = buffers(b.column("text"))
            block, parts, ids = (b.column(c).to_numpy() for c in ("block", "parts", "doc_id"))
            for i, _, part, offs in slices(data, offsets):
                bounds, values = shingle_sets(part, offs, words)
                row = np.repeat(np.arange(i, i + len(offs) - 1), np.diff(bounds))
                place = ((values >> np.uint64(32)) * parts[row].astype(np.uint64) >> np.uint64(32)).astype(np.int64)
                new = np.flatnonzero(np.append(True, (row[1:] != row[:-1]) | (place[1:] != place[:-1]))) if len(row) else row
                ends = np.append(new[1:], len(row)) if len(row) else row
                own = row[new]
                pieces = [values[x:y].tobytes() for x, y in zip(new, ends, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(block[own]), pa.array(place[new]), pa.array(ids[own]), pa.array(ids[own]), pa.array(pieces, pa.binary())], names=["block", "part", "doc_id", "known", "text"])

    return rows.select("block", "parts", "doc_id", "text").mapInArrow(cut, "block long, part long, doc_id long, known long, text binary")


class _Renamed:
    """A union seen through a list of its members."""

    def __init__(self, union: Union, names: list[int]) -> None:
        self.union, self.names = union, names

    def find(self, i: int) -> int:
        return self.union.find(self.names[i])

    def join(self, i: int, j: int) -> None:
        self.union.join(self.names[i], self.names[j])


def _classes(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows with salt and rep, classes): ``rep`` is the smallest doc_id of an equal set; null for rows without links.

    ``classes`` (h1, h2, salt, rep) tells it for each of SALTS groups, so a set of very many documents is met evenly.
    """
    key = ["h1", "h2"]
    linked = F.col("doc_id").isNotNull() & (F.col("n") > 0)
    rows = rows.withColumn("salt", _salt())
    classes = _least_by(rows.where(linked), key).withColumnRenamed("least", "rep")
    return rows.join(classes, [*key, "salt"], "left").withColumn("rep", F.when(linked, F.col("rep"))), classes


def _all_signed(known: DataFrame, ids: DataFrame, named: DataFrame, *how) -> DataFrame:
    """The signatures of the documents with a set of their own, by their name in ``named``, else their id.

    ``ids`` has doc_id and own, ``named`` doc_id and name. Filters of bounded size tell which rows have to be looked up; only these move.
    """
    copies = ids.where(~F.col("own")).select("doc_id")
    gone_table = filter_of(copies, "doc_id")
    mistaken = ids.where(F.col("own")).where(marks(gone_table, F.col("doc_id"))).select("doc_id", F.col("doc_id").alias("name"))  # no copies, though the filter says so
    named = named.union(mistaken).groupBy("doc_id").agg(F.min("name").alias("name"))
    named = written(named, "names")
    named_table = filter_of(named, "doc_id")
    alone = _signed(known.select(F.col("doc_id").alias("name"), "text"), *how, without=(gone_table, named_table))
    asked = known.where(marks(named_table, F.col("doc_id"))).repartition("doc_id").join(copies, "doc_id", "left_anti").join(named, "doc_id", "left")
    return alone.union(_signed(asked.select(F.coalesce("name", "doc_id").alias("name"), "text"), *how))


def _placed(blocks: DataFrame, ids: DataFrame) -> DataFrame:
    """doc_id, block, size, parts, own: the members of blocks (node, root), how many parts a block has, and which is a document's own."""
    rows = blocks.select(F.col("node").alias("doc_id"), F.col("root").alias("block")).union(blocks.select(F.col("root"), F.col("root")).distinct())
    rows = rows.join(ids.where("own").select("doc_id", F.col("n").alias("size")), "doc_id")
    parts = rows.groupBy("block").agg(F.greatest(F.ceil(F.sum("size") / PART_SHINGLES), F.lit(1)).cast("long").alias("parts"))
    rows = rows.join(parts, "block")
    return rows.select("doc_id", "block", "size", "parts", F.pmod(F.xxhash64("doc_id"), F.col("parts")).alias("own"))


def linked_components(docs: DataFrame, words: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """doc_id, n_shingles, component_id of every document.

    A document's set has its distinct shingles of ``words`` words (A-Z lower-cased, split at
    white space; fewer words: the whole sequence). Documents link when ``den`` times the
    common shingles are at least ``num`` times all; ``component_id`` is the smallest id
    reachable. A null text, or one without words, has an empty set and no links. Rows of
    one doc_id are one document of several sets, each row with its own n_shingles; a null
    id has no links and component null. No rows give no rows; other columns are ignored.
    """
    spark = small_batches(docs.sparkSession)
    limit = Threshold(num, den)
    docs = _texts(docs)
    known = docs.where(F.col("doc_id").isNotNull())
    seen = written(_counted(docs, words), "counts")
    sets, classes = _classes(seen)
    sets = written(sets, "sets")
    members = sets.where(F.col("rep").isNotNull())
    own = F.col("doc_id") == F.col("rep")
    ids = members.groupBy("doc_id").agg(F.max(own).alias("own"), F.sum(F.when(own, F.col("n"))).alias("n"), (F.min("rep") != F.max("rep")).alias("several"))
    ids = written(ids, "ids")
    several = members.join(ids.where("several").select("doc_id"), "doc_id", "left_semi").where(~own).select(F.col("doc_id").alias("u"), F.col("rep").alias("v"))

    alike = written(_stars(members.where(own).select("doc_id", F.explode("bands").alias("band")), "band"), "alike")
    shingles = ids.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    buckets = 1 + shingles // BUCKET_SHINGLES
    often = written(_heavy(known, words, shingles), "heavy")
    heavy = spark.sparkContext.broadcast(build(often, F.col("key"), often.count()))  # of bounded size
    edges = _edges(_all_signed(known, ids, alike.select(F.col("u").alias("doc_id"), F.col("v").alias("name")), words, limit, heavy, buckets))
    blocks = components(edges.union(alike))
    placed = written(_placed(blocks, ids), "members")
    large = placed.where(F.col("parts") > 1)
    if not large.isEmpty():
        rows = known.where(marks(filter_of(large, "doc_id"), F.col("doc_id"))).repartition("doc_id").join(large, "doc_id")
        finer = components(_searched(_ranges(rows, words), None, limit).select(F.col("doc_id").alias("u"), F.col("root").alias("v")))
        placed = written(placed.where(F.col("parts") == 1).union(_placed(finer, ids)), "members")
    hub, everywhere = F.col("doc_id") == F.col("block"), lambda n: F.sequence(F.lit(0).cast("long"), n - 1)
    texts = known.where(marks(filter_of(placed, "doc_id"), F.col("doc_id")))
    at = F.explode(F.when(hub & (F.col("parts") > 1), everywhere(F.col("parts"))).otherwise(F.array("own"))).alias("part")
    found = written(_searched(texts.join(placed.select("doc_id", "block", at), "doc_id").withColumn("known", F.col("doc_id")), words, limit), "links")
    links = found.select("doc_id", "root")
    # parts of large blocks: what the hub does not reach is dealt into chunks that meet every part, in groups of two parts at most
    cut = placed.where(F.col("parts") > 1)
    if not cut.isEmpty():
        reached = found.where(F.col("root") == F.col("block")).select("doc_id")
        outside = cut.where(~hub).join(reached, "doc_id", "left_anti")
        chunks = outside.groupBy("block").agg(F.ceil(F.sum("size") / PART_SHINGLES).cast("long").alias("chunks"))
        cut, outside = (x.join(chunks, "block") for x in (cut, outside))
        hosts = cut.select("doc_id", "block", F.explode(F.transform(everywhere(F.col("chunks")), lambda c: F.col("own") * F.col("chunks") + c)).alias("part"))
        chunk = F.pmod(F.xxhash64("doc_id", F.lit("chunk")), F.col("chunks"))
        guests = outside.select("doc_id", "block", F.explode(F.transform(everywhere(F.col("parts")), lambda p: p * F.col("chunks") + chunk)).alias("part"))
        meeting = written(hosts.union(guests).distinct(), "meeting")
        before = found.groupBy("doc_id").agg(F.min("root").alias("known"))
        again = known.where(marks(filter_of(meeting, "doc_id"), F.col("doc_id"))).join(meeting.join(before, "doc_id"), "doc_id")
        links = links.union(_searched(again, words, limit).select("doc_id", "root"))
    roots = components(links.toDF("u", "v").union(several))
    told = classes.join(roots, classes["rep"] == roots["node"], "left").select("h1", "h2", "salt", F.coalesce("root", "rep").alias("component"))
    out = sets.join(told, ["h1", "h2", "salt"], "left").withColumn("component", F.when(F.col("rep").isNotNull(), F.col("component")))
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))


def one_of_each(docs: DataFrame, words: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """``docs`` with the document of the smallest id only of each component of links.

    Of rows that repeat a doc_id one stays. Rows with a null id have no links and stay. All
    columns stay as they are.
    """
    found = linked_components(docs, words, num, den)
    rows = found.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.first("component_id").alias("c"), F.count(F.lit(1)).alias("n"))
    rows = written(rows, "roots")
    gone = rows.where(F.col("doc_id") != F.col("c")).select("doc_id")
    twice = rows.where((F.col("doc_id") == F.col("c")) & (F.col("n") > 1)).select("doc_id")
    key = F.col("doc_id").cast("long")
    drop, again = gone.union(twice), twice.toDF("other")
    mark = marks(filter_of(drop, "doc_id"), key)  # rows that may go are joined exactly; the texts of the others are not moved
    drop = drop.toDF("other")
    kept = docs.where(~mark).unionByName(docs.where(mark).join(drop, key == drop["other"], "left_anti"))
    if twice.isEmpty():
        return kept
    repeated = docs.join(again, key == again["other"], "left_semi").dropDuplicates(["doc_id"])
    return kept.unionByName(repeated)
