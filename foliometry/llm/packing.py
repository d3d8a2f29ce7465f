"""Packing along a space-filling curve: similar documents end in the same sequence.

Hashed word vectors are projected to four dimensions and placed on a Hilbert curve. Sampled
splitters range-partition documents by curve key; each partition is sorted by it, and
its token stream is cut into sequences of fixed length, so only the last sequence of a
partition is padded. A document is tokenised once.
"""

from __future__ import annotations

import base64
import math
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache
from json import load

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches
from .textops import buffers, prefix, slices, span_hash, words

#: Hashed features, dimensions of the projection, bits for each, bits that break ties by id.
FEATURES, DIMS, BITS, TIE_BITS = 512, 4, 12, 15
LENGTH, END_ID = 2048, 1
#: Documents sampled for the splitters at most, and bytes of text for each partition.
SAMPLE_DOCS, PARTITION_BYTES = 20_000, 24 << 20
_PROJECTION = np.random.default_rng(7).standard_normal((FEATURES, DIMS))


def hilbert(points: np.ndarray, bits: int) -> np.ndarray:
    """Index on the Hilbert curve of each row of unsigned coordinates below ``2 ** bits``."""
    x = [points[:, i].astype(np.uint64) for i in range(points.shape[1])]
    n, one = len(x), np.uint64(1)
    for b in range(bits - 1, 0, -1):  # undo the rotations of each level, coarse to fine
        bit, below = np.uint64(1 << b), np.uint64((1 << b) - 1)
        for i in range(n):
            set_ = (x[i] & bit) != 0
            swap = np.where(set_, 0, (x[0] ^ x[i]) & below).astype(np.uint64)
            x[0] = np.where(set_, x[0] ^ below, x[0] ^ swap)
            if i:
                x[i] = x[i] ^ swap
    for i in range(1, n):
        x[i] = x[i] ^ x[i - 1]
    t = np.zeros(len(points), np.uint64)
    for b in range(bits - 1, 0, -1):
        t = np.where((x[-1] >> np.uint64(b)) & one != 0, t ^ np.uint64((1 << b) - 1), t)
    x = [v ^ t for v in x]
    out = np.zeros(len(points), np.uint64)
    for b in range(bits - 1, -1, -1):
        for v in x:
            out = (out << one) | ((v >> np.uint64(b)) & one)
    return out


_erf = np.frompyfunc(math.erf, 1, 1)


def curve_keys(ids: np.ndarray, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """63-bit keys: the document vector's place on the curve, then a hash of the id."""
    out = np.zeros(len(ids), np.int64)
    for i, j, part, offs in slices(data, offsets):
        start, end, row = words(part, offs)
        h = span_hash(prefix(part), start, end)
        sign = ((h >> np.uint64(63)).astype(np.int64) * 2 - 1).astype(float)
        cell = row * FEATURES + (h % np.uint64(FEATURES)).astype(np.int64)
        vectors = np.bincount(cell, sign, (j - i) * FEATURES).reshape(j - i, FEATURES)
        norm = np.sqrt((vectors**2).sum(1, keepdims=True))
        z = (vectors @ _PROJECTION) / np.maximum(norm, 1e-9)
        unit = (1 + _erf(z / math.sqrt(2)).astype(float)) / 2
        points = np.minimum((unit * (1 << BITS)).astype(np.int64), (1 << BITS) - 1)
        salt = (ids[i:j].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - TIE_BITS)
        out[i:j] = ((hilbert(points, BITS) << np.uint64(TIE_BITS)) | salt).astype(np.int64)
    return out


class Tokens:
    """Token ids by a byte-level BPE; ``ranks`` and ``json`` hold the same vocabulary.

    The rank file's library is several times faster; a text that it cannot take, or that has one
    of the JSON file's added tokens in it, goes to the other.
    """

    def __init__(self, json: str, ranks: str, pattern: str) -> None:
        import tiktoken

        with open(ranks, "rb") as f:
            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        with open(json, encoding="utf-8") as f:
            added = [re.escape(t["content"]) for t in load(f).get("added_tokens", [])]
        self.json, self.slow = json, None
        self.added = re.compile("|".join(added) or r"(?!)")
        self.fast = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=table, special_tokens={})

    def encode(self, text: str) -> list[int]:
        if self.added.search(text):
            return self.plain(text)
        try:
            return self.fast.encode_ordinary(text)
        except BaseException as e:  # the Rust side panics on runs that exceed its regex limits
            if isinstance(e, (KeyboardInterrupt, SystemExit, MemoryError)):
                raise
            return self.plain(text)

    def plain(self, text: str) -> list[int]:
        if self.slow is None:
            from tokenizers import Tokenizer

            self.slow = Tokenizer.from_file(self.json)
        return self.slow.encode(text, add_special_tokens=False).ids


@lru_cache(2)
def tokens(json: str, ranks: str, pattern: str) -> Tokens:
    return Tokens(json, ranks, pattern)


def public_vocabulary(name: str = "byte_bpe_50k") -> tuple[str, str, str]:
    import public_tokenizers as p

    return str(p.path(f"{name}.json")), str(p.path(f"{name}.tiktoken")), p.PATTERN


PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def splitters(docs: DataFrame, parts: int, n_docs: int) -> np.ndarray:
    """Curve keys that cut a bounded sample of documents into ``parts`` equal shares of bytes."""
    limit = min(1 << 30, (1 << 30) * SAMPLE_DOCS // max(1, n_docs) + 1)
    sample = docs.where(F.pmod(F.xxhash64("doc_id", F.lit("curve")), F.lit(1 << 30)) < limit)

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offsets = buffers(b.column("text"))
            ids = b.column("doc_id").fill_null(-1).to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([pa.array(curve_keys(ids, data, offsets)), pa.array(np.diff(offsets))], names=["key", "n"])

    found = sample.mapInArrow(keys, "key long, n long").collect()
    if not found:
        return np.zeros(0, np.int64)
    key, n = np.array(sorted((r["key"], r["n"]) for r in found)).T
    share = np.cumsum(n + 1) / (n + 1).sum()
    return np.unique(key[np.searchsorted(share, np.arange(1, parts) / parts)])


def pack(docs: DataFrame, vocabulary: tuple[str, str, str] | None = None, length: int = LENGTH, with_ids: bool = True) -> DataFrame:
    """One row a piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids).

    A document is its text's token ids, then id 1; null is the empty text, whose only token is
    that. Documents are cut wherever a sequence of ``length`` is full. Repeated rows are packed
    each; a null doc_id is kept. Ties on the curve are ordered by id. No rows give no rows;
    other columns are ignored. ``vocabulary``: paths of the tokenizer's two files, and its pattern.
    """
    small_batches(docs.sparkSession)
    vocabulary = vocabulary or public_vocabulary()
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    n_docs, n_bytes = docs.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("text").cast("long")), F.lit(0))).first()
    parts = max(1, -(-n_bytes // PARTITION_BYTES))
    cuts = splitters(docs, parts, n_docs) if parts > 1 else np.zeros(0, np.int64)

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = tokens(*vocabulary)
        for b in batches:
            data, offsets = buffers(b.column("text"))
            known = b.column("doc_id").fill_null(-1).to_numpy(zero_copy_only=False)
            keys = curve_keys(known, data, offsets)
            for i, j, part, offs in slices(data, offsets, 4 << 20):
                raw = part.tobytes()
                ids = [np.array([*own.encode(raw[x:y].decode()), END_ID], "<u4") for x, y in zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True)]
                short = [x.astype("<u2") if x.max() < 65536 else x for x in ids]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.searchsorted(cuts, keys[i:j], side="right"), pa.int32()), pa.array(keys[i:j]), b.column("doc_id").slice(i, j - i), pa.array([len(x) for x in ids], pa.int64()), pa.array([x.tobytes() for x in short], pa.binary())],
                    names=["part", "key", "doc_id", "n", "ids"],
                )

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sequence = offset = 0
        for b in batches:
            out: list[list] = [[], [], [], [], [], [], [], []]
            for part, doc_id, n, raw in zip(b.column("part").to_pylist(), b.column("doc_id").to_pylist(), b.column("n").to_pylist(), b.column("ids"), strict=True):
                raw = raw.as_py()
                ids = np.frombuffer(raw, "<u4" if len(raw) == 4 * n else "<u2").astype("<u4")
                at = 0
                while at < n:
                    take = min(length - offset, n - at)
                    piece = ids[at : at + take].tobytes()
                    row = (doc_id, at, take, zlib.crc32(piece), n, (part << 40) | sequence, offset, piece)
                    for column, v in zip(out, row, strict=True):
                        column.append(v)
                    at, offset = at + take, offset + take
                    if offset == length:
                        sequence, offset = sequence + 1, 0
            arrays = [pa.array(c, pa.int64()) for c in out[:7]] + [pa.array(out[7], pa.binary())] * with_ids
            yield pa.RecordBatch.from_arrays(arrays, names=[x.split()[0] for x in PIECES.split(", ")] + ["ids"] * with_ids)

    rows = docs.mapInArrow(encoded, "part int, key long, doc_id long, n long, ids binary")
    sorted_rows = rows.repartitionById(parts, F.col("part")).sortWithinPartitions("key", "doc_id", "n")
    return sorted_rows.mapInArrow(cut, PIECES + ", ids binary" * with_ids)
