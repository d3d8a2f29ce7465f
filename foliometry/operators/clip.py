"""Lines within labelled regions: length by region, runs and pixels.

A line is thought to be walked in equal steps of a quarter pixel or less; a step belongs to the region of the
pixel at its middle. No step becomes a row: middles move one way along a segment, so the steps on a
scanline, and those of them within a span, are one range, whose ends follow from the segment. Rows grow with
the scanlines and spans that a line crosses.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions.geometry import length
from . import polyline
from .spans import dealt_by_count

STEP = 0.25
#: Vertices of lines whose stretches one task has: some tens of rows each.
VERTICES = 1 << 15
#: Stretches, and pairs of stretch and span, that a worker has at once.
PAIRS = 1 << 20


def _middle(a: Column, b: Column, s: Column, n: Column) -> Column:
    """The place of step ``s`` of ``n`` on the way from ``a`` to ``b``."""
    return a + (s / n + (s + 1) / n) / 2 * (b - a)


def _first(a: Column, b: Column, n: Column, place: Column, guess: Column) -> Column:
    """The first step whose middle has come to ``place``: at it or beyond upwards, before it downwards; ``n`` if none has.

    Rounding can put the guess off by one, so it and the step before it are tried as they are walked.
    """
    come = lambda k: F.when(b > a, _middle(a, b, k, n) >= place).otherwise(_middle(a, b, k, n) < place)
    found = F.when((guess > 0) & come(guess - 1), guess - 1).when((guess >= n) | come(guess), guess).otherwise(guess + 1)
    return F.least(n.cast("long"), found)


def _ranged(df: DataFrame, a: Column, b: Column, low: Column, high: Column) -> DataFrame:
    """``df`` (with n) and a column r of the first and last step whose middle is in [low, high).

    The range is one element that is exploded, so a filter on it does not work it out anew.
    """
    n = F.col("n")
    ends = F.when(b > a, low).otherwise(high), F.when(b > a, high).otherwise(low)
    guess = lambda place: F.greatest(F.lit(0).cast("long"), F.least(n.cast("long"), F.ceil(n * (place - a) / F.nullif(b - a, F.lit(0.0)) - 0.5)))
    df = df.withColumns({f"_g{i}": guess(place) for i, place in enumerate(ends)})
    level = F.when((a >= low) & (a < high), F.lit(0).cast("long")).otherwise(n.cast("long"))
    first, after = (_first(a, b, n, place, F.col(f"_g{i}")) for i, place in enumerate(ends))
    of = F.struct(F.when(a == b, level).otherwise(first).alias("s0"), F.when(a == b, n.cast("long")).otherwise(after).alias("end"))
    return df.select("*", F.explode(F.array(of)).alias("r")).drop("_g0", "_g1")


def _numbered(lines: DataFrame, keys: list[str], px_w: float, px_h: float) -> DataFrame:
    """keys, seg (from 1), x, y, x2, y2, n, step_len: the segments with their number of steps, dealt out by line."""
    segs = polyline.segments(dealt_by_count(lines, VERTICES, *keys), keys)
    n = F.greatest(F.lit(1), F.ceil(F.col("len") / STEP)).cast("int")
    scaled = length((F.col("x2") - F.col("x")) * px_w, (F.col("y2") - F.col("y")) * px_h)
    number = F.row_number().over(Window.partitionBy(*keys).orderBy("idx"))
    return segs.select(*keys, number.alias("seg"), "x", "y", "x2", "y2", n.alias("n"), (scaled / n).alias("step_len"))


def stretches(lines: DataFrame, keys: list[str], px_w: float = 1.0, px_h: float = 1.0) -> DataFrame:
    """keys, seg (from 1), n, x, y, x2, y2, step_len, row, s0, s1: the steps s0 to s1 of a segment that are on a scanline.

    A step goes down by a quarter pixel at most, so every scanline between a segment's first and last has one.
    Lines are dealt out before they grow, by their number, as the stretches stay where they are made: what is sorted or
    grouped by line or scanline later on moves none of them.
    """
    out = _numbered(lines, keys, px_w, px_h)
    ends = [F.floor(_middle(F.col("y"), F.col("y2"), s, F.col("n"))).cast("int") for s in (F.lit(0), F.col("n") - 1)]
    out = out.select("*", F.explode(F.sequence(F.least(*ends), F.greatest(*ends))).alias("row"))
    row = F.col("row").cast("double")
    out = _ranged(out, F.col("y"), F.col("y2"), row, row + 1)
    return out.withColumn("s0", F.col("r.s0")).withColumn("s1", F.col("r.end") - 1).drop("r")


def labelled_stretches(walked: DataFrame, labelled: DataFrame, keys: list[str]) -> DataFrame:
    """Stretches within a region's spans, with its label; what is outside all regions has no row. Regions must not overlap."""
    names = [f"span_{k}" for k in keys]
    spans = labelled.select(*(F.col(k).alias(n) for k, n in zip(keys, names, strict=True)), F.col("y").alias("span_y"), F.col("x0").alias("span_x0"), F.col("x1").alias("span_x1"), "label")
    first, last = (_middle(F.col("x"), F.col("x2"), F.col(s), F.col("n")) for s in ("s0", "s1"))
    met = F.col("row") == F.col("span_y")
    for k, n in zip(keys, names, strict=True):
        met = met & (F.col(k) == F.col(n))
    met = met & (F.least(first, last) < F.col("span_x1")) & (F.greatest(first, last) >= F.col("span_x0"))
    both = walked.join(spans, met)
    both = _ranged(both, F.col("x"), F.col("x2"), F.col("span_x0").cast("double"), F.col("span_x1").cast("double"))
    both = both.withColumn("s0", F.greatest("s0", "r.s0")).withColumn("s1", F.least("s1", F.col("r.end") - 1))
    return both.where("s0 <= s1").select(*walked.columns, "label")


def _range(a: np.ndarray, b: np.ndarray, n: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first step whose middle is in [low, high) and the one after the last, as ``_ranged`` has them."""
    up, level = b > a, a == b
    span = np.where(level, 1.0, b - a)

    def first(place: np.ndarray) -> np.ndarray:
        guess = np.clip(np.ceil(n * (place - a) / span - 0.5), 0, n).astype(np.int64)
        middle = lambda k: _middle(a, b, k, n)
        come = lambda k: np.where(up, middle(k) >= place, middle(k) < place)
        before = (guess > 0) & come(guess - 1)
        return np.minimum(n, np.where(before, guess - 1, np.where((guess >= n) | come(guess), guess, guess + 1)))

    begin, after = first(np.where(up, low, high)), first(np.where(up, high, low))
    return np.where(level, np.where((a >= low) & (a < high), 0, n), begin), np.where(level, n, after)


def _met(low: np.ndarray, high: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(owner, place) of the whole numbers from ``low`` up to ``high`` of each row, some ``PAIRS`` at once; long ranges are cut."""
    count = np.maximum(high - low, 0)
    ends = np.cumsum(count)
    for at in range(0, int(ends[-1]) if len(ends) else 0, PAIRS):
        k = np.arange(at, min(at + PAIRS, int(ends[-1])))
        owner = np.searchsorted(ends, k, side="right")
        yield owner, low[owner] + k - (ends[owner] - count[owner])


def clipped(lines: DataFrame, labelled: DataFrame, keys: list[str], px_w: float = 1.0, px_h: float = 1.0) -> DataFrame:
    """``labelled_stretches`` of ``stretches``, made where a line meets the spans of its image; those of a segment that follow each other in a region are one.

    keys, seg, x, y, x2, y2, n, step_len, s0, s1, label. Only segments and spans are moved, by line, and what is left of a segment, not the
    many stretches. A worker has one line's segments, its image's spans and its result, and some ``PAIRS`` of what they grow to at once.
    """
    segs = _numbered(lines, keys, px_w, px_h).dropna(subset=[*keys, "x", "y", "x2", "y2"])
    other = [f"span_{k}" for k in keys]  # both sides may come from one table
    rows = labelled.dropna(subset=[*keys, "y", "x0", "x1"]).select(*(F.col(k).alias(o) for k, o in zip(keys, other, strict=True)), "y", "x0", "x1", "label")
    own = T._parse_datatype_string("seg int, x double, y double, x2 double, y2 double, n int, step_len double, s0 long, s1 long").fields
    schema = T.StructType([segs.schema[k] for k in keys] + own + [labelled.schema["label"]])
    arrow = to_arrow_schema(schema)

    def solve(key: tuple[pa.Scalar, ...], line: pa.Table, spans: pa.Table) -> pa.Table:
        if not line.num_rows or not spans.num_rows:
            return arrow.empty_table()
        x, y, x2, y2, n = (line.column(c).to_numpy() for c in ("x", "y", "x2", "y2", "n"))
        n = n.astype(np.int64)
        sy, left, right = (spans.column(c).to_numpy() for c in ("y", "x0", "x1"))
        _, name = np.unique(spans.column("label").to_numpy(zero_copy_only=False), return_inverse=True)
        order = np.lexsort((left, sy))
        sy, left, right, name = sy[order], left[order], right[order], name[order]
        ends = [np.floor(_middle(y, y2, s, n)) for s in (0, n - 1)]
        low, high = np.maximum(np.minimum(*ends), sy[0]).astype(np.int64), np.minimum(np.maximum(*ends), sy[-1]).astype(np.int64) + 1
        found = []
        for i, row in _met(low, high):
            begin, end = np.searchsorted(sy, row, side="left"), np.searchsorted(sy, row, side="right")
            some = np.flatnonzero(begin < end)
            i, row, begin, end = i[some], row[some], begin[some], end[some]
            s0, after = _range(y[i], y2[i], n[i], row.astype(float), row + 1.0)
            s1 = after - 1
            way = [_middle(x[i], x2[i], s, n[i]) for s in (s0, s1)]
            least, most = np.minimum(*way), np.maximum(*way)
            for j, k in _met(begin, end):
                use = (least[j] < right[k]) & (most[j] >= left[k])
                j, k = j[use], k[use]
                p = i[j]
                first, stop = _range(x[p], x2[p], n[p], left[k].astype(float), right[k].astype(float))
                first, last = np.maximum(s0[j], first), np.minimum(s1[j], stop - 1)
                use = first <= last
                found.append([c[use] for c in (p, first, last, name[k], k)])
        if not found:
            return arrow.empty_table()
        found = [np.concatenate(c) for c in zip(*found, strict=True)]
        along = np.lexsort((found[1], found[0]))
        p, first, last, of, k = (c[along] for c in found)
        new = np.append(True, (p[1:] != p[:-1]) | (of[1:] != of[:-1]) | (first[1:] != last[:-1] + 1))[: len(p)]
        p, first, k, last = p[new], first[new], order[k[new]], last[np.append(new[1:], True)[: len(p)]]
        columns = [pa.repeat(v, len(p)) for v in key] + line.select([f.name for f in own[:7]]).take(p).columns + [pa.array(first), pa.array(last), spans.column("label").take(k)]
        return pa.table([c.cast(f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

    return segs.groupBy(*keys).cogroup(rows.groupBy(*other)).applyInArrow(solve, schema)


def steps(s0: Column | str = "s0", s1: Column | str = "s1") -> Column:
    """Number of steps of a stretch."""
    return (F.col(s1) if isinstance(s1, str) else s1) - (F.col(s0) if isinstance(s0, str) else s0) + 1


def length_by_label(marked: DataFrame, keys: list[str]) -> DataFrame:
    return marked.groupBy(*keys, "label").agg(F.sum(steps() * F.col("step_len")).alias("length"))


def runs(marked: DataFrame, keys: list[str]) -> DataFrame:
    """keys, label, run, idx, x, y: maximal stretches within one region as polylines.

    Vertices of the line are kept; only the two ends of a run are interpolated, and all points
    pass single precision. Runs are numbered along the line within each region.
    """
    w = Window.partitionBy(*keys).orderBy("seg", "s0")
    before = lambda c: F.lag(c).over(w)
    same_segment = (before("seg") == F.col("seg")) & (before("s1") + 1 == F.col("s0"))
    over_vertex = (before("seg") + 1 == F.col("seg")) & (before("s1") + 1 == before("n")) & (F.col("s0") == 0)
    goes_on = (before("label") == F.col("label")) & (same_segment | over_vertex)
    m = marked.withColumn("change", F.when(goes_on, 0).otherwise(1))
    m = m.withColumn("island", F.sum("change").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    own = Window.partitionBy(*keys, "island").orderBy("seg", "s0")
    m = m.withColumn("first", F.row_number().over(own) == 1).withColumn("final", F.lead("s0").over(own).isNull())
    at = lambda t: F.struct((F.col("x") + t * (F.col("x2") - F.col("x"))).cast("float").cast("double").alias("x"), (F.col("y") + t * (F.col("y2") - F.col("y"))).cast("float").cast("double").alias("y"))
    begin, end = at(F.col("s0") / F.col("n")), at((F.col("s1") + 1) / F.col("n"))
    whole = F.col("s1") == F.col("n") - 1
    points = F.array_compact(F.array(F.when(F.col("first"), begin), F.when(whole | F.col("final"), end)))
    v = m.select(*keys, "label", "island", "seg", "s0", F.posexplode(points).alias("k", "p"))
    run = F.dense_rank().over(Window.partitionBy(*keys, "label").orderBy("island"))
    place = F.row_number().over(Window.partitionBy(*keys, "label", "island").orderBy("seg", "s0", "k")) - 1
    return v.select(*keys, "label", run.alias("run"), place.alias("idx"), "p.x", "p.y")


def pixels_visited(walked: DataFrame, keys: list[str]) -> DataFrame:
    """keys, px: distinct pixels under a line's steps; times the pixel's area, the line's area.

    Steps are shorter than a pixel, so a stretch covers all columns between those of its ends.
    """
    ends = [F.floor(_middle(F.col("x"), F.col("x2"), F.col(s), F.col("n"))) for s in ("s0", "s1")]
    p = walked.select(*keys, "row", F.least(*ends).alias("a"), (F.greatest(*ends) + 1).alias("b"))
    before = F.max("b").over(Window.partitionBy(*keys, "row").orderBy("a", "b").rowsBetween(Window.unboundedPreceding, -1))
    new = p.select(*keys, F.greatest(F.lit(0).cast("long"), F.col("b") - F.greatest("a", F.coalesce(before, F.col("a")))).alias("px"))
    return new.groupBy(*keys).agg(F.sum("px").alias("px"))
