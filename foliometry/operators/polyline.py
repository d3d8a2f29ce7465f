"""Lines as rows of vertices: lengths, positions along them, projections, strips and turns.

A table of lines has key columns, ``idx`` from 0, ``x`` and ``y``. One shuffle on the keys serves
all windows of a plan. Points are compared with segments of their own line only.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions.geometry import length, normalised, wrapped
from ..plans.store import stored

#: Pairs of point and segment looked at together; segments of a line up to which one worker takes it with all its points.
PAIRS, KERNEL_SIDES = 1 << 20, 1 << 16


def _along(keys: list[str]):
    return Window.partitionBy(*keys).orderBy("idx")


def segments(lines: DataFrame, keys: list[str], px_w: float = 1.0, px_h: float = 1.0, closed: bool = False) -> DataFrame:
    """keys, idx, x, y, x2, y2, len, cum0, cum1; lengths are scaled by the pixel's size."""
    w = _along(keys)
    nx, ny = F.lead("x").over(w), F.lead("y").over(w)
    if closed:
        whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        nx, ny = F.coalesce(nx, F.first("x").over(whole)), F.coalesce(ny, F.first("y").over(whole))
    out = lines.select(*keys, "idx", "x", "y", nx.alias("x2"), ny.alias("y2")).where(F.col("x2").isNotNull())
    out = out.withColumn("len", length((F.col("x2") - F.col("x")) * px_w, (F.col("y2") - F.col("y")) * px_h))
    cum = F.sum("len").over(w.rowsBetween(Window.unboundedPreceding, 0))
    return out.withColumn("cum1", cum).withColumn("cum0", F.coalesce(F.lag("cum1").over(w), F.lit(0.0)))


def cumulative(lines: DataFrame, keys: list[str]) -> DataFrame:
    """keys, idx, x, y, cum: running path length at each vertex."""
    w = _along(keys)
    step = length(F.col("x") - F.lag("x").over(w), F.col("y") - F.lag("y").over(w))
    out = lines.select(*keys, "idx", "x", "y", F.coalesce(step, F.lit(0.0)).alias("step"))
    return out.withColumn("cum", F.sum("step").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("step")


def total_length(lines: DataFrame, keys: list[str], px_w: float = 1.0, px_h: float = 1.0) -> DataFrame:
    """keys, n_vertices, length; each axis is scaled before the distance."""
    w = _along(keys)
    step = length((F.col("x") - F.lag("x").over(w)) * px_w, (F.col("y") - F.lag("y").over(w)) * px_h)
    steps = lines.select(*keys, step.alias("step"))
    return steps.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_vertices"), F.coalesce(F.sum("step"), F.lit(0.0)).alias("length"))


def bounds_diagonal(lines: DataFrame, keys: list[str]) -> DataFrame:
    w, h = F.max("x") - F.min("x"), F.max("y") - F.min("y")
    return lines.groupBy(*keys).agg(F.sqrt(w * w + h * h).alias("diagonal"))


def points_at(segs: DataFrame, arcs: DataFrame, keys: list[str]) -> DataFrame:
    """``arcs`` (keys, arc, ...) with px, py: the point at that length; clamped to the ends.

    ``segs`` comes from ``segments``. The first segment that ends at or beyond the arc has it.
    """
    rest = [c for c in arcs.columns if c not in keys]
    # one merge along each line: lengths asked for stand before a segment that begins at them
    none = F.lit(None)
    seg = F.struct(F.col("idx").cast("long").alias("s"), *(F.col(c) for c in ("x", "y", "x2", "y2", "len", "cum0", "cum1"))).alias("seg")
    starts = segs.select(*keys, F.col("cum0").alias("at"), F.lit(1).alias("kind"), F.col("idx").cast("long").alias("tie"), seg, *(none.cast(arcs.schema[c].dataType).alias(c) for c in rest))
    asked = arcs.select(*keys, F.col("arc").cast("double").alias("at"), F.lit(0).alias("kind"), F.lit(0).cast("long").alias("tie"), none.cast(starts.schema["seg"].dataType).alias("seg"), *rest)
    rows = starts.unionByName(asked)
    line = Window.partitionBy(*keys)
    before = F.last("seg", ignorenulls=True).over(line.orderBy("at", "kind", "tie").rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.select(*keys, *rest, "kind", before.alias("b"), F.max("seg.cum1").over(line).alias("all"), F.min_by("seg", "seg.s").over(line).alias("first"))
    rows = rows.where((F.col("kind") == 0) & F.col("all").isNotNull()).withColumn("b", F.coalesce("b", "first"))
    t = (F.col("arc") - F.col("b.cum0")) / F.when(F.col("b.len") < 1e-9, F.lit(1.0)).otherwise(F.col("b.len"))
    t = F.when((F.col("arc") <= 0) | (F.col("b.len") < 1e-9), F.lit(0.0)).otherwise(t)
    along = lambda c: F.when((F.col("arc") >= F.col("all")) & (F.col("arc") > 0), F.col(f"b.{c}2")).otherwise(F.col(f"b.{c}") + t * (F.col(f"b.{c}2") - F.col(f"b.{c}"))).alias(f"p{c}")
    return rows.select(*keys, *rest, along("x"), along("y"))


def nearest(segs: DataFrame, points: DataFrame, keys: list[str], point_keys: list[str], most_sides: int | None = KERNEL_SIDES) -> DataFrame:
    """keys, point_keys, arc, dist, nx, ny: the nearest place of the line or outline to (qx, qy).

    Of equally near segments the first counts. Points of equal keys have a row each; points and segments without a
    key or place have none. Lines of up to ``most_sides`` segments are compared in groups, longer ones by blocks;
    with None no line is known to be longer, and none is counted.
    """
    segs, points = segs.dropna(subset=[*keys, "x", "y", "x2", "y2"]), points.dropna(subset=[*keys, "qx", "qy"])
    long = None if most_sides is None else segs.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > most_sides).select(*keys)
    if long is None or long.isEmpty():
        return _nearest_in_group(segs, points, keys, point_keys)
    long = stored(long)
    parts = [(way, *(rows.join(long, keys, how) for rows in (segs, points))) for way, how in ((_nearest_in_group, "left_anti"), (_nearest_by_blocks, "left_semi"))]
    small, large = (way(s, p, keys, point_keys) for way, s, p in parts)
    return small.unionByName(large)


def _nearest_in_group(segs: DataFrame, points: DataFrame, keys: list[str], point_keys: list[str]) -> DataFrame:
    """A group is one line with its points; they are compared as arrays of PAIRS at most, so no row is made for a pair."""
    other = [f"{k}_of_point" for k in keys]  # both sides may come from one table
    left = segs.select(*keys, F.col("idx").cast("long").alias("s"), *(F.col(c).cast("double").alias(c) for c in ("x", "y", "x2", "y2", "cum0")))
    right = points.where(F.col("qx").isNotNull() & F.col("qy").isNotNull())
    right = right.select(*(F.col(k).alias(o) for k, o in zip(keys, other, strict=True)), *point_keys, F.col("qx").cast("double").alias("qx"), F.col("qy").cast("double").alias("qy"))
    schema = T.StructType([segs.schema[k] for k in keys] + [points.schema[k] for k in point_keys] + [T.StructField(c, T.DoubleType()) for c in ("arc", "dist", "nx", "ny")])
    arrow = to_arrow_schema(schema)

    def solve(key: tuple[pa.Scalar, ...], line: pa.Table, asked: pa.Table) -> pa.Table:
        if not line.num_rows or not asked.num_rows:
            return arrow.empty_table()
        order = np.argsort(line.column("s").to_numpy(), kind="stable")
        x, y, x2, y2, cum0 = (line.column(c).to_numpy()[order] for c in ("x", "y", "x2", "y2", "cum0"))
        qx, qy = (asked.column(c).to_numpy() for c in ("qx", "qy"))
        dx, dy = x2 - x, y2 - y
        square = dx * dx + dy * dy
        least, at_once = np.where(square < 1e-12, np.inf, square), max(1, PAIRS // len(x))
        found = []
        for i in range(0, len(qx), at_once):
            px, py = qx[i : i + at_once, None], qy[i : i + at_once, None]
            t = np.clip(((px - x) * dx + (py - y) * dy) / least, 0.0, 1.0)
            gx, gy = px - (x + t * dx), py - (y + t * dy)
            dist = np.sqrt(gx * gx + gy * gy)
            best = dist.argmin(1)
            row = np.arange(len(best))
            t, dist = t[row, best], dist[row, best]
            found.append((cum0[best] + t * np.sqrt(square[best]), dist, x[best] + t * dx[best], y[best] + t * dy[best]))
        columns = [pa.array([k.as_py()] * len(qx), arrow.field(i).type) for i, k in enumerate(key)]
        columns += [asked.column(k).cast(arrow.field(k).type) for k in point_keys]
        return pa.table([*columns, *(pa.array(np.concatenate(c)) for c in zip(*found, strict=True))], schema=arrow)

    return left.groupBy(*keys).cogroup(right.groupBy(*other)).applyInArrow(solve, schema)


def _nearest_by_blocks(segs: DataFrame, points: DataFrame, keys: list[str], point_keys: list[str]) -> DataFrame:
    """Segments are put in blocks of the root of their number, one after the other along the line, so a block's box is small.

    A point is compared with the boxes of its line, then with the segments of the blocks that may hold
    the nearest place: those whose box begins no farther than the farthest corner of the nearest one.
    """
    named = dict(zip(keys, (f"{k}_of_point" for k in keys), strict=True))  # both sides may come from one table
    line = Window.partitionBy(*keys)
    ends = ("x", "y", "x2", "y2")
    sides = segs.select(*keys, F.col("idx").cast("long").alias("s"), *(F.col(c).cast("double").alias(c) for c in (*ends, "cum0"))).dropna(subset=list(ends))
    in_block = F.ceil(F.sqrt(F.count(F.lit(1)).over(line)))
    sides = sides.withColumn("block", F.floor((F.row_number().over(line.orderBy("s")) - 1) / in_block))
    least = [F.min(F.least(c, f"{c}2")).alias(f"{c}_least") for c in "xy"]
    most = [F.max(F.greatest(c, f"{c}2")).alias(f"{c}_most") for c in "xy"]
    boxes = sides.groupBy(*keys, "block").agg(*least, *most)
    asked = points.where(F.col("qx").isNotNull() & F.col("qy").isNotNull())
    asked = asked.select(*(F.col(k).alias(o) for k, o in named.items()), *point_keys, F.col("qx").cast("double").alias("qx"), F.col("qy").cast("double").alias("qy"))
    point = [*named.values(), *point_keys, "qx", "qy"]
    asked = asked.groupBy(*point).agg(F.count(F.lit(1)).alias("times"))
    of_line = [F.col(k) == F.col(o) for k, o in named.items()]
    met = asked.join(boxes, of_line)
    short = [F.greatest(F.col(f"{c}_least") - F.col(f"q{c}"), F.col(f"q{c}") - F.col(f"{c}_most"), F.lit(0.0)) for c in "xy"]
    far = [F.greatest(F.abs(F.col(f"q{c}") - F.col(f"{c}_least")), F.abs(F.col(f"q{c}") - F.col(f"{c}_most"))) for c in "xy"]
    met = met.withColumn("begins", length(*short)).withColumn("within", F.min(length(*far)).over(Window.partitionBy(*point)))
    # a little more than the bound, as sums are rounded
    near = met.where(F.col("begins") <= F.col("within") * 1.000001 + 1e-6).select(*point, "times", F.col("block").alias("of_block"))
    pairs = near.join(sides, [*of_line, F.col("of_block") == F.col("block")])
    dx, dy = F.col("x2") - F.col("x"), F.col("y2") - F.col("y")
    pairs = pairs.withColumns({"dx": dx, "dy": dy}).withColumn("square", F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy"))
    along = ((F.col("qx") - F.col("x")) * F.col("dx") + (F.col("qy") - F.col("y")) * F.col("dy")) / F.col("square")
    pairs = pairs.withColumn("t", F.when(F.col("square") < 1e-12, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), along))))
    pairs = pairs.withColumns({f"n{c}": F.col(c) + F.col("t") * F.col(f"d{c}") for c in "xy"})
    gx, gy = F.col("qx") - F.col("nx"), F.col("qy") - F.col("ny")
    place = F.struct(length(gx, gy).alias("dist"), "s", (F.col("cum0") + F.col("t") * F.sqrt("square")).alias("arc"), "nx", "ny", "times")
    best = pairs.select(*point, place.alias("_p")).groupBy(*point).agg(F.min("_p").alias("_p"))
    out = best.select(*(F.col(o).alias(k) for k, o in named.items()), *point_keys, "_p", F.explode(F.sequence(F.lit(1).cast("long"), "_p.times")))
    return out.select(*keys, *point_keys, "_p.arc", "_p.dist", "_p.nx", "_p.ny")


def vertex_normals(lines: DataFrame, keys: list[str]) -> DataFrame:
    """keys, idx, x, y, nx, ny: at inner vertices across the mean direction of both segments."""
    w = _along(keys)
    ax, ay = F.col("x") - F.lag("x").over(w), F.col("y") - F.lag("y").over(w)
    bx, by = F.lead("x").over(w) - F.col("x"), F.lead("y").over(w) - F.col("y")
    d = lines.select(*keys, "idx", "x", "y", ax.alias("ax"), ay.alias("ay"), bx.alias("bx"), by.alias("by"))
    (d1x, d1y), (d2x, d2y) = normalised(F.col("ax"), F.col("ay")), normalised(F.col("bx"), F.col("by"))
    d = d.select(*keys, "idx", "x", "y", "ax", "bx", d1x.alias("d1x"), d1y.alias("d1y"), d2x.alias("d2x"), d2y.alias("d2y"))
    mx, my = F.col("d1x") + F.col("d2x"), F.col("d1y") + F.col("d2y")
    n = length(mx, my)
    back = n < 1e-9
    ux = F.when(F.col("ax").isNull(), F.col("d2x")).when(F.col("bx").isNull(), F.col("d1x")).when(back, F.col("d1x")).otherwise(mx / n)
    uy = F.when(F.col("ax").isNull(), F.col("d2y")).when(F.col("bx").isNull(), F.col("d1y")).when(back, F.col("d1y")).otherwise(my / n)
    alone = F.col("ax").isNull() & F.col("bx").isNull()
    return d.select(*keys, "idx", "x", "y", F.when(alone, F.lit(0.0)).otherwise(-uy).alias("nx"), F.when(alone, F.lit(1.0)).otherwise(ux).alias("ny"))


def strip(lines: DataFrame, keys: list[str], half_width: Column | float) -> DataFrame:
    """keys, idx, x, y of a polygon: the left side forward, then the right side backward."""
    h = half_width if isinstance(half_width, Column) else F.lit(float(half_width))
    n = vertex_normals(lines, keys)
    count = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    rank = F.row_number().over(_along(keys)) - 1
    n = n.withColumn("n", count).withColumn("k", rank)
    left = F.struct(F.col("k").cast("long").alias("idx"), (F.col("x") + F.col("nx") * h).alias("x"), (F.col("y") + F.col("ny") * h).alias("y"))
    right = F.struct((2 * F.col("n") - 1 - F.col("k")).cast("long").alias("idx"), (F.col("x") - F.col("nx") * h).alias("x"), (F.col("y") - F.col("ny") * h).alias("y"))
    return n.select(*keys, F.explode(F.array(left, right)).alias("v")).select(*keys, "v.idx", "v.x", "v.y")


def sweep_degrees(lines: DataFrame, keys: list[str], cx: Column, cy: Column) -> DataFrame:
    """keys, degrees: how far the line turns about a centre; clockwise on screen is positive."""
    angle = F.atan2(F.col("y") - cy, F.col("x") - cx)
    turns = lines.withColumn("angle", angle)
    turn = wrapped(F.col("angle") - F.lag("angle").over(_along(keys)))
    return turns.withColumn("turn", turn).groupBy(*keys).agg(F.degrees(F.coalesce(F.sum("turn"), F.lit(0.0))).alias("degrees"))


def sampled(lengths: DataFrame, keys: list[str], n: Column) -> DataFrame:
    """keys, k, arc: ``n`` + 1 equal steps along each line of ``length``."""
    steps = lengths.select(*keys, "length", n.cast("int").alias("n"))
    out = steps.select(*keys, "length", "n", F.explode(F.sequence(F.lit(0), F.col("n"))).alias("k"))
    return out.select(*keys, "k", (F.col("length") * F.col("k") / F.col("n")).alias("arc"))


def reverse(lines: DataFrame, keys: list[str]) -> DataFrame:
    most = F.max("idx").over(Window.partitionBy(*keys))
    return lines.withColumn("idx", most - F.col("idx"))
