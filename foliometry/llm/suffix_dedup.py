"""Exact substring deduplication with a distributed, sparse suffix array.

A byte goes if a string of ``length`` bytes that covers it also starts in a document with
a smaller id. Suffixes are compared to that depth only.

* *Anchors.* Each window of ``length`` bytes has an anchor: its smallest hashed 20-byte word.
  Equal windows have equal anchors at equal places, and some sixteen neighbouring windows
  share one, so one record stands for the suffixes of that many positions.
* *Candidates.* Anchors that occur in one document only end here; nothing but four bytes of each
  has moved then.
* *Suffix array.* The candidates' suffixes are range-partitioned by their leading bytes at sampled
  splitters and sorted in each bucket by a multikey quicksort on words of eight bytes.
  Runs of equal suffixes yield the smallest document. A splitter is as long as an anchor, so
  equal suffixes are never on two sides of a boundary, and the comparison across boundaries has
  nothing to compare. Anchors with very many records are split further by a hash of each whole
  suffix, and ranges beyond ``MOST_RANGES`` by a hash of the anchor.
* *Chunks.* Documents are dealt into chunks of some megabytes by their id. A string that a third of
  all documents hold is one record for each chunk, and answers go back to chunks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches
from .textops import buffers, mix, prefix, span_hash

#: Bytes of an anchor, of a splitter, of a chunk; bytes of text for each bucket of anchors and of suffixes.
ANCHOR, CHUNK_BYTES, ANCHOR_BUCKET, SUFFIX_BUCKET = 20, 8 << 20, 16 << 20, 8 << 20
LEAD = ANCHOR
#: An anchor with so many records in all is split by its suffixes' hashes, into so many buckets.
HOT_RECORDS, HOT_PARTS = 16_384, 256
#: Documents sampled for the splitters at least, and for each range; ranges at most; windows looked at together.
SAMPLE_DOCS, RANGE_DOCS, MOST_RANGES, BLOCK = 2_000, 8, 1 << 14, 1 << 21
#: Windows that share an anchor are bits of one word.
MOST_LENGTH = ANCHOR + 63
_POS = 24  # bits for the place of a window's anchor within a block


def runs(data: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first window, last window, anchor, anchor's hash) of each run of windows with one anchor."""
    span, n = length - ANCHOR + 1, len(data) - length + 1
    found = []
    valid = np.zeros(max(n, 0), bool)
    for a, b in zip(offsets[:-1], offsets[1:], strict=True):
        valid[a : max(a, b - length + 1)] = True
    for at in range(0, max(n, 0), BLOCK):
        part = data[at : at + BLOCK + length - 1]
        sums = prefix(part)
        start = np.arange(len(part) - ANCHOR + 1)
        h = span_hash(sums, start, start + ANCHOR)
        low = (h >> np.uint64(_POS) << np.uint64(_POS)) | start.astype(np.uint64)
        width = 1
        while width * 2 <= span:  # smallest of each window, by doubling
            low = np.minimum(low[:-width], low[width:])
            width *= 2
        if width < span:
            low = np.minimum(low[: len(low) - (span - width)], low[span - width :])
        anchor = (low & np.uint64((1 << _POS) - 1)).astype(np.int64)
        ok = valid[at : at + len(anchor)]
        new = np.ones(len(anchor), bool)
        new[1:] = (anchor[1:] != anchor[:-1]) | (ok[1:] != ok[:-1])
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(anchor)) - 1
        use = ok[first]
        first, last = first[use], last[use]
        found.append((first + at, last + at, anchor[first] + at, h[anchor[first]]))
    if not found:
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.uint64))
    return tuple(map(np.concatenate, zip(*found, strict=True)))


def multikey_sort(columns: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(order, group): strings of words sorted one word at a time; equal strings share a group.

    Each level partitions only what is still tied after the words before.
    """
    order = np.argsort(columns[0])
    s = columns[0][order]
    new = np.ones(len(order), bool)
    new[1:] = s[1:] != s[:-1]
    for column in columns[1:]:
        tied = ~new
        tied[:-1] |= ~new[1:]
        at = np.flatnonzero(tied)
        if not len(at):
            break
        group = np.cumsum(new)[at]
        v = column[order[at]]
        o = np.lexsort((v, group))
        order[at] = order[at][o]
        v = v[o]
        new[at[1:][(v[1:] != v[:-1]) & (group[1:] == group[:-1])]] = True
    return order, np.cumsum(new) - 1


def as_words(rows: np.ndarray) -> list[np.ndarray]:
    """Columns of big-endian words of eight bytes of a byte matrix."""
    width = -(-rows.shape[1] // 8) * 8
    padded = np.zeros((len(rows), width), np.uint8)
    padded[:, : rows.shape[1]] = rows
    words = padded.view(">u8").astype(np.uint64)
    return [np.ascontiguousarray(words[:, i]) for i in range(words.shape[1])]


class Chunk:
    """A chunk's documents in a fixed order, their runs, and what goes to which bucket."""

    def __init__(self, table: pa.Table, length: int) -> None:
        docs = sorted(zip(table.column("doc").to_pylist(), (x.as_py() for x in table.column("text")), strict=True))
        self.ids = np.array([d for d, _ in docs], np.int64)
        self.texts = [t for _, t in docs]
        self.offsets = np.cumsum([0, *map(len, self.texts)])
        self.data = np.frombuffer(b"".join(self.texts), np.uint8)
        self.length = length
        self.first, self.last, self.anchor, self.hash = runs(self.data, self.offsets, length)
        self.row = np.searchsorted(self.offsets, self.first, side="right") - 1

    def anchor_keys(self, buckets: int) -> tuple[np.ndarray, np.ndarray]:
        return (self.hash % np.uint64(buckets)).astype(np.int64), (mix(self.hash) >> np.uint64(32)).astype(np.uint32)

    def anchors(self, buckets: int) -> Iterator[tuple[int, bytes, bytes]]:
        """(bucket, distinct keys, for each its records, 127 at most, plus 128 if several documents hold it)."""
        bucket, key = self.anchor_keys(buckets)
        context = span_hash(prefix(self.data), self.first, self.last + self.length)
        order = np.lexsort((context, key, bucket))
        b, k, r, c = bucket[order], key[order], self.ids[self.row[order]], context[order]
        new = np.ones(len(b), bool)
        new[1:] = (b[1:] != b[:-1]) | (k[1:] != k[:-1])
        start = np.flatnonzero(new)
        if not len(start):
            return
        other = new.copy()
        other[1:] |= c[1:] != c[:-1]
        several = np.maximum.reduceat(r, start) != np.minimum.reduceat(r, start)
        mark = (np.minimum(np.add.reduceat(other.astype(np.int64), start), 127) | (several.astype(np.int64) << 7)).astype(np.uint8)
        b, k = b[start], k[start]
        cut = np.append(np.flatnonzero(np.append(True, b[1:] != b[:-1])), len(b))
        for x, y in zip(cut[:-1], cut[1:], strict=True):
            yield int(b[x]), k[x:y].tobytes(), mark[x:y].tobytes()

    def candidates(self, repeated: np.ndarray, hot: np.ndarray, buckets: int, splitters: np.ndarray, suffix_buckets: int) -> None:
        """Keeps the runs whose anchor is in several documents; runs of hot anchors become single windows.

        A bucket is a range of anchors between two splitters, dealt by the anchor's hash if there are more buckets than ranges.
        """
        bucket, key = self.anchor_keys(buckets)
        full = (bucket.astype(np.uint64) << np.uint64(32)) | key.astype(np.uint64)
        at = np.minimum(np.searchsorted(repeated, full), max(len(repeated) - 1, 0))
        use = repeated[at] == full if len(repeated) else np.zeros(len(full), bool)
        is_hot = use.copy()
        is_hot[use] = hot[at[use]]
        split = np.flatnonzero(is_hot)
        n = self.last[split] - self.first[split] + 1
        each = np.repeat(split, n)
        window = self.first[each] + np.arange(len(each)) - np.repeat(np.cumsum(n) - n, n)
        plain = np.flatnonzero(use & ~is_hot)
        self.c_first = np.concatenate([self.first[plain], window])
        self.c_last = np.concatenate([self.last[plain], window])
        self.c_anchor = np.concatenate([self.anchor[plain], self.anchor[each]])
        self.c_doc = self.ids[np.concatenate([self.row[plain], self.row[each]])]
        sums = prefix(self.data)
        hashes = span_hash(sums, self.c_first, self.c_last + self.length)
        lead = np.ascontiguousarray(self._around(self.c_anchor, 0, LEAD)).view(f"S{LEAD}").ravel()
        deal = -(-suffix_buckets // (len(splitters) + 1)) if suffix_buckets > MOST_RANGES else 1
        anchor_hash = np.concatenate([self.hash[plain], self.hash[each]])
        self.c_bucket = np.searchsorted(splitters, lead, side="right").astype(np.int64) * deal + (anchor_hash % np.uint64(deal)).astype(np.int64)
        suffix_buckets = (len(splitters) + 1) * deal
        salt = (hashes[len(plain) :] % np.uint64(HOT_PARTS)).astype(np.int64)
        self.c_bucket[len(plain) :] = suffix_buckets + self.c_bucket[len(plain) :] * HOT_PARTS + salt
        # equal records of the chunk: the one of the smallest document goes on for all
        head = self._around(self.c_first, 0, 8).copy().view("<u8").ravel()
        order = np.lexsort((self.c_first, self.c_doc, self.c_last - self.c_first, self.c_anchor - self.c_first, head, hashes, self.c_bucket))
        same = np.ones(len(order), bool)
        for c in (self.c_bucket, hashes, head, self.c_anchor - self.c_first, self.c_last - self.c_first):
            same[1:] &= c[order[1:]] == c[order[:-1]]
        same[:1] = False
        self.lead_of = np.cumsum(~same) - 1  # for each record in order, its representative's number
        self.order, self.sent = order, order[~same]

    def _around(self, at: np.ndarray, before: int, after: int) -> np.ndarray:
        padded = np.concatenate([np.zeros(before, np.uint8), self.data, np.zeros(after, np.uint8)])
        return np.lib.stride_tricks.sliding_window_view(padded, before + after)[at]

    def cuts(self) -> tuple[np.ndarray, np.ndarray]:
        """The bucket of each record sent, and where each bucket's records begin, and the end."""
        bucket = self.c_bucket[self.sent]
        return bucket, np.append(np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])), len(bucket)) if len(bucket) else np.zeros(1, int)

    def records(self) -> Iterator[tuple[int, bytes, bytes, bytes, bytes]]:
        """(bucket, documents, bytes before, bytes from the anchor on, contexts) in the fixed order."""
        most, s = self.length - ANCHOR, self.sent
        before, after = self.c_anchor[s] - self.c_first[s], self.c_last[s] + self.length - self.c_anchor[s]
        context = self._around(self.c_anchor[s], most, self.length).copy()
        column = np.arange(most + self.length) - most
        context[(column < -before[:, None]) | (column >= after[:, None])] = 0
        doc, before, after = self.c_doc[s], before.astype(np.uint8), after.astype(np.uint8)
        bucket, cut = self.cuts()
        for x, y in zip(cut[:-1], cut[1:], strict=True):
            yield int(bucket[x]), doc[x:y].tobytes(), before[x:y].tobytes(), after[x:y].tobytes(), context[x:y].tobytes()

    def removed(self, answers: dict[int, bytes]) -> np.ndarray:
        """Marks the bytes to remove. ``answers``: for each bucket the windows of each record sent, as bits."""
        bucket, cut = self.cuts()
        masks = np.zeros(len(self.sent), np.uint64)
        for x, y in zip(cut[:-1], cut[1:], strict=True):
            masks[x:y] = np.frombuffer(answers[int(bucket[x])], np.uint64)
        mask = masks[self.lead_of]
        first, n = self.c_first[self.order], (self.c_last - self.c_first)[self.order] + 1
        later = self.c_doc[self.order] > self.c_doc[self.sent][self.lead_of]
        mask = np.where(later, ~np.uint64(0), mask)
        step = np.zeros(len(self.data) + 1, np.int64)
        for j in range(int(n.max()) if len(n) else 0):
            hit = first[(n > j) & ((mask >> np.uint64(j)) & np.uint64(1) == 1)] + j
            np.add.at(step, hit, 1)
            np.add.at(step, hit + self.length, -1)
        return np.cumsum(step[:-1]) > 0


def suffix_ranks(doc: np.ndarray, before: np.ndarray, after: np.ndarray, context: np.ndarray, length: int) -> np.ndarray:
    """For each record the windows (bits from its first) that also start in a smaller document."""
    mid = length - ANCHOR
    words = as_words(np.concatenate([context[:, mid:], context[:, :mid]], 1))  # the suffix from the anchor on comes first
    order, group = multikey_sort([*words, before.astype(np.uint64), after.astype(np.uint64)])
    start = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
    least = np.minimum.reduceat(doc[order], start)
    kind = np.empty(len(doc), np.int64)  # the distinct context of each record
    kind[order] = group
    n = before.astype(np.int64) + after.astype(np.int64) - length + 1
    every = (np.uint64(1) << n.astype(np.uint64)) - np.uint64(1)
    out = np.where(least[kind] < doc, every, np.uint64(0))
    sample = order[start]
    head = context[sample, mid : mid + ANCHOR]
    same = np.append(False, (head[1:] == head[:-1]).all(1))  # an anchor with several contexts: sorted, so they are neighbours
    several = np.flatnonzero(same | np.append(same[1:], False))
    if not len(several):
        return out
    m = n[sample[several]]
    owner = np.repeat(several, m)
    at = np.arange(len(owner)) - np.repeat(np.cumsum(m) - m, m)
    begin = mid - before[sample[owner]].astype(np.int64) + at
    flat = np.lib.stride_tricks.sliding_window_view(np.ascontiguousarray(context).ravel(), length)
    suffix = flat[sample[owner] * context.shape[1] + begin]
    w_order, w_group = multikey_sort(as_words(suffix))
    w_start = np.flatnonzero(np.append(True, w_group[1:] != w_group[:-1]))
    w_least = np.empty(len(owner), np.int64)
    w_least[w_order] = np.minimum.reduceat(least[owner][w_order], w_start)[w_group]
    base = np.full(len(start), -1)
    base[several] = np.cumsum(m) - m
    for r in np.flatnonzero(base[kind] >= 0):
        got = w_least[base[kind[r]] : base[kind[r]] + n[r]] < doc[r]
        out[r] = (got.astype(np.uint64) << np.arange(len(got), dtype=np.uint64)).sum()
    return out


def _table(columns: dict[str, tuple[list, pa.DataType]]) -> pa.Table:
    return pa.table({k: pa.array(v, t) for k, (v, t) in columns.items()})


def sampled_splitters(docs: DataFrame, buckets: int, n_docs: int, length: int) -> np.ndarray:
    """Leading bytes that cut the anchors of a sample of documents into equal shares.

    The sample grows with the buckets up to MOST_RANGES ranges, so the driver gets RANGE_DOCS *
    MOST_RANGES documents at most, and about sixteen anchors of each.
    """
    buckets = min(buckets, MOST_RANGES)
    limit = min(1 << 30, (1 << 30) * max(SAMPLE_DOCS, RANGE_DOCS * buckets) // max(1, n_docs) + 1)
    sample = docs.where(F.pmod(F.xxhash64("doc", F.lit("splitter")), F.lit(1 << 30)) < limit)

    def leads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offsets = buffers(b.column("text"))
            _, _, anchor, _ = runs(data, offsets, length)
            take = anchor[:: max(1, len(anchor) // (16 * b.num_rows))]
            out = [data[a : a + LEAD].tobytes() for a in take]
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["lead"])

    found = sample.select("text").mapInArrow(leads, "lead binary").toArrow().column("lead").to_pylist()
    found = np.sort(np.array(found, f"S{LEAD}"))
    return np.unique(found[np.arange(1, buckets) * len(found) // buckets]) if len(found) else found


def deduplicated(docs: DataFrame, length: int = 50) -> DataFrame:
    """doc_id, kept, spans of every document: the bytes that stay, and where in the text the others were.

    Texts are UTF-8 bytes, null is empty; matches never cross documents. Removed is each byte
    covered by a string of ``length`` bytes that also starts in a document with a smaller
    doc_id, judged on the input. ``spans`` are the runs of removed bytes as (start, length) in
    the order of the text; ``kept`` is binary, as a cut may lie within a character. Rows of one
    doc_id do not remove each other's bytes; a null doc_id is larger than all others. No rows
    give no rows; other columns are ignored. ``length`` is from ANCHOR to MOST_LENGTH; others raise a ValueError.
    """
    if not ANCHOR <= length <= MOST_LENGTH:
        raise ValueError(f"length must be from {ANCHOR} to {MOST_LENGTH} bytes, not {length}")
    spark = small_batches(docs.sparkSession)
    nobody = (1 << 63) - 1
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(nobody)).alias("doc"), F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("text"))
    n_docs, n_bytes = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("text").cast("long")), F.lit(0))).first()
    chunks, anchor_buckets, suffix_buckets = (max(1, -(-n_bytes // size)) for size in (CHUNK_BYTES, ANCHOR_BUCKET, SUFFIX_BUCKET))
    splitters = spark.sparkContext.broadcast(sampled_splitters(rows, suffix_buckets, n_docs, length))  # MOST_RANGES at most
    texts = rows.select(F.pmod(F.xxhash64("doc"), F.lit(chunks)).alias("chunk"), "doc", "text")

    def anchors(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        found = list(Chunk(table, length).anchors(anchor_buckets))
        n = len(found)
        return _table({"bucket": ([x[0] for x in found], pa.int64()), "chunk": ([key[0].as_py()] * n, pa.int64()), "keys": ([x[1] for x in found], pa.binary()), "marks": ([x[2] for x in found], pa.binary())})

    def repeated(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        keys = [np.frombuffer(x.as_py(), np.uint32) for x in table.column("keys")]
        every, marks = np.concatenate(keys), np.concatenate([np.frombuffer(x.as_py(), np.uint8) for x in table.column("marks")])
        values, at, n = np.unique(every, return_inverse=True, return_counts=True)
        again = (n > 1) | (np.bincount(at, marks >> 7, len(values)) > 0)
        hot = np.bincount(at, marks & 127, len(values)) >= HOT_RECORDS
        out_keys, out_hot, place = [], [], 0
        for k in keys:
            mine = at[place : place + len(k)]
            place += len(k)
            use = again[mine]
            out_keys.append(k[use].tobytes())
            out_hot.append(hot[mine[use]].tobytes())
        return _table({"chunk": (table.column("chunk").to_pylist(), pa.int64()), "bucket": ([key[0].as_py()] * len(keys), pa.int64()), "a": (out_keys, pa.binary()), "b": (out_hot, pa.binary())})

    def chunk_of(left: pa.Table, right: pa.Table) -> tuple[Chunk, dict[int, bytes]]:
        keys, hot, answers = [], [], {}
        for bucket, a, b in zip(right.column("bucket").to_pylist(), right.column("a"), right.column("b"), strict=True):
            if not b.is_valid:
                answers[bucket] = a.as_py()
                continue
            k = np.frombuffer(a.as_py(), np.uint32).astype(np.uint64)
            keys.append((np.uint64(bucket) << np.uint64(32)) | k)
            hot.append(np.frombuffer(b.as_py(), bool))
        chunk = Chunk(left, length)
        keys, hot = (np.concatenate(keys), np.concatenate(hot)) if keys else (np.zeros(0, np.uint64), np.zeros(0, bool))
        order = np.argsort(keys)
        chunk.candidates(keys[order], hot[order], anchor_buckets, splitters.value, suffix_buckets)
        return chunk, answers

    def suffixes(key: tuple[pa.Scalar, ...], left: pa.Table, right: pa.Table) -> pa.Table:
        found = list(chunk_of(left, right)[0].records()) if left.num_rows else []
        names = ("bucket", "docs", "before", "after", "context")
        return _table({"chunk": ([key[0].as_py()] * len(found), pa.int64())} | {n: ([x[i] for x in found], pa.binary() if i else pa.int64()) for i, n in enumerate(names)})

    def ranked(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        doc = [np.frombuffer(x.as_py(), np.int64) for x in table.column("docs")]
        before, after, context = (np.concatenate([np.frombuffer(x.as_py(), np.uint8) for x in table.column(c)]) for c in ("before", "after", "context"))
        masks = suffix_ranks(np.concatenate(doc), before, after, context.reshape(len(before), -1), length)
        parts = np.split(masks, np.cumsum([len(d) for d in doc])[:-1])
        return _table({"chunk": (table.column("chunk").to_pylist(), pa.int64()), "bucket": ([key[0].as_py()] * len(doc), pa.int64()), "a": ([x.tobytes() for x in parts], pa.binary()), "b": ([None] * len(doc), pa.binary())})

    def cut(key: tuple[pa.Scalar, ...], left: pa.Table, right: pa.Table) -> pa.Table:
        ids, kept, starts, sizes, counts = [], [], [], [], [0]
        if left.num_rows:
            chunk, answers = chunk_of(left, right)
            gone = chunk.removed(answers)
            for d, text, a, b in zip(chunk.ids.tolist(), chunk.texts, chunk.offsets[:-1], chunk.offsets[1:], strict=True):
                g = gone[a:b]
                edge = np.flatnonzero(np.diff(g, prepend=False, append=False))
                ids.append(None if d == nobody else d)
                kept.append(chunk.data[a:b][~g].tobytes() if len(edge) else text)
                starts.append(edge[::2])
                sizes.append(edge[1::2] - edge[::2])
                counts.append(len(edge) // 2)
        flat = [pa.array(np.concatenate(x) if x else np.zeros(0, np.int64), pa.int64()) for x in (starts, sizes)]
        spans = pa.ListArray.from_arrays(pa.array(np.cumsum(counts), pa.int32()), pa.StructArray.from_arrays(flat, ["start", "length"]))
        return pa.table({"doc_id": pa.array(ids, pa.int64()), "kept": pa.array(kept, pa.binary()), "spans": spans})

    answer = "chunk long, bucket long, a binary, b binary"
    first = texts.groupBy("chunk").applyInArrow(anchors, "bucket long, chunk long, keys binary, marks binary")
    shared = first.groupBy("bucket").applyInArrow(repeated, answer)
    records = texts.groupBy("chunk").cogroup(shared.groupBy("chunk")).applyInArrow(suffixes, "chunk long, bucket long, docs binary, before binary, after binary, context binary")
    answers = shared.union(records.groupBy("bucket").applyInArrow(ranked, answer))
    return texts.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(cut, "doc_id long, kept binary, spans array<struct<start: long, length: long>>")


def deduplicate(docs: DataFrame, length: int = 50) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every document, from ``deduplicated``."""
    n_removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["length"])
    return deduplicated(docs, length).select(
        "doc_id",
        (F.octet_length("kept") + n_removed).alias("n_bytes"),
        n_removed.alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )
