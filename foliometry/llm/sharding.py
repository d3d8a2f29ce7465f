"""Shards of near equal bytes: best-fit-decreasing bin packing of indivisible groups.

Groups (equal texts) are counted by size class; the driver packs *runs* of equal
sized groups, largest first, each into the bin with the tightest remaining
capacity that still holds one, found in a balanced tree. Only the table of
classes, of a fixed greatest length, reaches the driver; groups are numbered
within their class on the executors and look their bin up by number.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written

#: Sizes below this are classes of their own; above, a class holds sizes within 1 / 1024.
EXACT_SIZES = 65_536
#: Numbers within a class or shard are counted in so many parts at least, and in one for so many rows of the table, and then shifted.
PARTS, PART_ROWS = 64, 1 << 20
#: So many runs of the packing are broadcast at most (some 30 bytes each); more of them meet their groups by a shuffle.
BROADCAST_RUNS = 1 << 18


class CapacityTree:
    """Balanced search tree (AA tree) of (remaining capacity, bin); ``tightest`` is O(log bins)."""

    __slots__ = ("root",)

    def __init__(self) -> None:
        self.root: list | None = None  # [key, level, left, right]

    @staticmethod
    def _skew(t: list | None) -> list | None:
        if t and t[2] and t[2][1] == t[1]:
            left = t[2]
            t[2], left[3] = left[3], t
            return left
        return t

    @staticmethod
    def _split(t: list | None) -> list | None:
        if t and t[3] and t[3][3] and t[3][3][1] == t[1]:
            right = t[3]
            t[3], right[2] = right[2], t
            right[1] += 1
            return right
        return t

    def add(self, key: tuple[int, int]) -> None:
        def put(t: list | None) -> list:
            if t is None:
                return [key, 1, None, None]
            side = 2 if key < t[0] else 3
            t[side] = put(t[side])
            return self._split(self._skew(t))

        self.root = put(self.root)

    def remove(self, key: tuple[int, int]) -> None:
        def level(t: list | None) -> int:
            return t[1] if t else 0

        def cut(t: list | None, key: tuple[int, int]) -> list | None:
            if t is None:
                return None
            if key < t[0]:
                t[2] = cut(t[2], key)
            elif key > t[0]:
                t[3] = cut(t[3], key)
            elif t[2] is None and t[3] is None:
                return None
            elif t[2] is None:
                low = t[3]
                while low[2]:
                    low = low[2]
                t[3], t[0] = cut(t[3], low[0]), low[0]
            else:
                high = t[2]
                while high[3]:
                    high = high[3]
                t[2], t[0] = cut(t[2], high[0]), high[0]
            want = min(level(t[2]), level(t[3])) + 1
            if want < t[1]:
                t[1] = want
                if t[3] and t[3][1] > want:
                    t[3][1] = want
            t = self._skew(t)
            t[3] = self._skew(t[3])
            if t[3]:
                t[3][3] = self._skew(t[3][3])
            t = self._split(t)
            t[3] = self._split(t[3])
            return t

        self.root = cut(self.root, key)

    def tightest(self, size: int) -> tuple[int, int] | None:
        """The smallest (remaining, bin) with remaining >= size."""
        t, best = self.root, None
        while t:
            if t[0][0] >= size:
                best, t = t[0], t[2]
            else:
                t = t[3]
        return best


@dataclass
class Packing:
    capacity: int
    bins: int = 0
    #: (class size, first number, number after the last, bin)
    runs: list[tuple[int, int, int, int]] = field(default_factory=list)


def best_fit_decreasing(classes: list[tuple[int, int]], capacity: int, most_bins: int | None = None) -> Packing | None:
    """Packs ``count`` items of each ``size``; None if that takes over ``most_bins`` bins.

    An item larger than the capacity gets a bin of its own.
    """
    out, tree = Packing(capacity), CapacityTree()
    for size, count in sorted(classes, reverse=True):
        done = 0
        while done < count:
            found = tree.tightest(size)
            if found:
                tree.remove(found)
            else:
                if most_bins is not None and out.bins >= most_bins:
                    return None
                found = (max(capacity, size), out.bins)
                out.bins += 1
            n = min(count - done, found[0] // size)
            out.runs.append((size, done, done + n, found[1]))
            tree.add((found[0] - n * size, found[1]))
            done += n
    return out


def fewest_bytes(classes: list[tuple[int, int]], n_shards: int) -> Packing:
    """The packing of the least capacity found that takes ``n_shards`` bins at most."""
    total, largest = sum(s * n for s, n in classes), max((s for s, _ in classes), default=1)
    least = max(-(-total // n_shards), largest)
    low, high, step = least - 1, least, 1
    while (found := best_fit_decreasing(classes, high, n_shards)) is None:
        low, high, step = high, high + step, step * 2
    while high - low > max(1, least // 1_000_000):
        mid = (low + high) // 2
        if (tried := best_fit_decreasing(classes, mid, n_shards)) is None:
            low = mid
        else:
            high, found = mid, tried
    return found


def numbered(df: DataFrame, by: list[str], order: list[str], name: str, n_rows: int) -> DataFrame:
    """Adds gapless numbers from 0 within ``by``, without one task for a large key.

    Rows are counted in parts by a hash of ``order``; each part's numbers start after those of
    the parts before it. The parts grow with ``n_rows``, the length of the table, so that a part
    has about ``PART_ROWS`` rows at most, even if one key has all.
    """
    parts = max(PARTS, -(-n_rows // PART_ROWS))
    part = F.pmod(F.xxhash64(*order), F.lit(parts)).cast("int")
    df = df.withColumn("_part", part)
    sums = df.groupBy(*by, "_part").agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = sums.select(*by, "_part", before.alias("_before"))
    own = F.row_number().over(Window.partitionBy(*by, "_part").orderBy(*order))
    return df.withColumn("_own", own).join(sums, [*by, "_part"]).withColumn(name, (F.col("_own") - 1 + F.col("_before")).cast("long")).drop("_part", "_own", "_before")


def shard_documents(docs: DataFrame, n_shards: int = 8) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard: each document's place.

    The law is ``bytes``: shards get near equal bytes, and equal texts share a shard.
    Size is the text's UTF-8 bytes plus 1; null counts as the empty text. A group
    larger than an even share (its copies stay together) raises the capacity to its
    own size, so its shard is larger and the law holds for the rest only. Repeated
    rows are rows of their own; a null doc_id is kept. No rows give no rows; other
    columns are ignored. Ties are broken by hash, then doc_id.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("grp"))
    rows = written(rows, "shard-rows")
    total = F.col("n") * F.col("size")
    fine = F.greatest(F.lit(0), F.floor(F.log2(total.cast("double"))) - 10).cast("int")
    step = F.expr("shiftleft(1L, fine)")
    groups = rows.groupBy("grp", "size").agg(F.count(F.lit(1)).alias("n")).withColumn("fine", fine)
    klass = F.when(total < EXACT_SIZES, total).otherwise(F.floor((total + step - 1) / step).cast("long") * step).cast("long")
    groups = written(groups.select("grp", "size", klass.alias("class")), "shard-groups")
    classes = [(r["class"], r["n"]) for r in groups.groupBy("class").agg(F.count(F.lit(1)).alias("n")).collect()]
    packing = fewest_bytes(classes, n_shards)
    spark = docs.sparkSession
    runs = spark.createDataFrame(packing.runs, "class long, low long, high long, shard int")
    runs = F.broadcast(runs) if len(packing.runs) <= BROADCAST_RUNS else runs
    placed = numbered(groups, ["class"], ["grp", "size"], "number", sum(n for _, n in classes)).join(runs, "class").where((F.col("number") >= F.col("low")) & (F.col("number") < F.col("high"))).select("grp", "size", "shard")
    out = written(rows.join(placed, ["grp", "size"]).select("doc_id", "size", "text_crc32", "grp", "shard"), "sharded")
    out = numbered(out, ["shard"], ["doc_id", "text_crc32", "grp"], "slot", out.count())
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
