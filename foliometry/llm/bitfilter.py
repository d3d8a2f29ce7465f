"""A membership filter of bounded size: answers "maybe" or "certainly not" for 64-bit hashes.

It only spares work: what passes is joined exactly afterwards. The size grows with
the keys up to a fixed bound, beyond which more rows pass, never fewer.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .textops import mix

LEAST_BITS, MOST_BITS = 20, 28
#: Bytes that go to the driver as one row.
PAGE = 4096


def places(h: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    shift = np.uint64(64 - bits)
    return h >> shift, mix(h) >> shift


def build(keys: DataFrame, key: Column, count: int) -> np.ndarray:
    """The filter's bytes (``2 ** (MOST_BITS - 3)`` at most) for about ``count`` distinct long hashes.

    Executors put its pages together; the driver gets whole pages, 32 MB at most.
    """
    bits = min(max(LEAST_BITS, int(np.ceil(np.log2(16 * max(1, count))))), MOST_BITS)

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            h = b.column(0).to_numpy().view(np.uint64)
            place = np.unique(np.concatenate(places(h, bits)).astype(np.int64))
            byte, at = np.unique(place >> 3, return_index=True)
            value = np.bitwise_or.reduceat(np.left_shift(1, place & 7), at) if len(at) else at
            yield pa.RecordBatch.from_arrays([pa.array(byte // PAGE, pa.int64()), pa.array(byte, pa.int64()), pa.array(value.astype(np.int32), pa.int32())], names=["page", "byte", "bits"])

    def page(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        out = np.zeros(PAGE, np.uint8)
        out[rows.column("byte").to_numpy() % PAGE] = rows.column("bits").to_numpy()
        return pa.table({"page": pa.array([key[0].as_py()], pa.int64()), "content": pa.array([out.tobytes()], pa.binary())})

    filled = keys.select(key.alias("key")).where(F.col("key").isNotNull()).mapInArrow(fill, "page long, byte long, bits int")
    merged = filled.groupBy("page", "byte").agg(F.bit_or("bits").alias("bits"))
    out = np.zeros(1 << (bits - 3), np.uint8)
    for at, content in merged.groupBy("page").applyInArrow(page, "page long, content binary").collect():
        out[at * PAGE : (at + 1) * PAGE] = np.frombuffer(content, np.uint8)
    return out


def maybe(table: np.ndarray, h: np.ndarray) -> np.ndarray:
    bits = 3 + int(np.log2(len(table)))
    out = np.ones(len(h), bool)
    for place in places(h, bits):
        out &= (table[(place >> np.uint64(3)).astype(np.int64)] >> (place & np.uint64(7)).astype(np.uint8)) & 1 == 1
    return out


def filter_of(keys: DataFrame, key: str):
    """The filter of a long column's hashes as a broadcast variable: of bounded size."""
    return keys.sparkSession.sparkContext.broadcast(build(keys, F.xxhash64(key), keys.count()))


def marks(table, of: Column) -> Column:
    """A column that is true for rows whose long ``of`` is in the filter ``table``, and for few others; null is false."""

    def mark(hashes: Iterator) -> Iterator:
        for h in hashes:
            yield pa.array(maybe(table.value, h.to_numpy(zero_copy_only=False).view(np.uint64)))

    mark.__annotations__ = {"hashes": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.coalesce(F.arrow_udf(mark, "boolean")(F.xxhash64(of)) & of.isNotNull(), F.lit(False))
