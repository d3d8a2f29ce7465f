"""Cut lines: which end is outside, where they cross the reference line, and how they are extended."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import length, normalised
from . import polyline
from .spans import dealt_by_count, edges, points_in

#: Pixels of an extension's step; bounds of its length; samples along a cut.
STEP, LEAST_REACH, REACH_FACTOR, DIAGONAL_SHARE = 2.0, 15.0, 3.0, 0.30
LEAST_SAMPLES, MOST_SAMPLES = 20, 300
#: Vertices of cuts whose samples one task has: up to MOST_SAMPLES for a cut.
VERTICES = 1 << 13
DEPTHS = {"wm": 3, "gl": 2, "cb": 1}


def nesting_depth(points: DataFrame, spans: DataFrame, keys: list[str], point_keys: list[str]) -> DataFrame:
    """``points`` with depth: 3 in white matter, 2 in granular and white matter, 1 inside, 0 outside."""
    depth = F.create_map(*(F.lit(x) for kv in DEPTHS.items() for x in kv))
    found = points_in(points, spans, keys, point_keys).groupBy(*keys, *point_keys).agg(F.max(depth[F.col("layer")]).alias("depth"))
    return points.join(found, [*keys, *point_keys], "left").withColumn("depth", F.coalesce("depth", F.lit(0)))


def outline_segments(shapes: DataFrame, keys: list[str]) -> DataFrame:
    """The sides of outlines in the form of ``polyline.segments``; rings count one after the other."""
    order = F.shiftleft(F.col("ring_no").cast("long"), 32) + F.col("side_no")  # of equally near places the first counts
    return edges(shapes, keys, numbered=True).select(*keys, order.alias("idx"), F.col("ax").alias("x"), F.col("ay").alias("y"), F.col("bx").alias("x2"), F.col("by").alias("y2"), F.lit(0.0).alias("cum0"))


def line_ends(lines: DataFrame, keys: list[str]) -> DataFrame:
    """keys, a (first vertex), b (last vertex), last (index)."""
    v = F.struct("x", "y")
    return lines.groupBy(*keys).agg(F.min_by(v, "idx").alias("a"), F.max_by(v, "idx").alias("b"), F.max("idx").alias("last"))


def outer_end_first(lines: DataFrame, spans: DataFrame, shapes: DataFrame, keys: list[str], line_key: str, most_sides: int | None = polyline.KERNEL_SIDES) -> DataFrame:
    """keys, line_key, depth_a, depth_b, reversed: whether the last vertex is the outer end.

    The shallower end is outside. Of equal depths, the end farther from white matter (by over
    1e-6), then the one nearer the outline; the first vertex if still equal.
    """
    ends = line_ends(lines, [*keys, line_key])
    point = F.explode(F.array(F.struct(F.lit("a").alias("end"), F.col("a.x").alias("qx"), F.col("a.y").alias("qy")), F.struct(F.lit("b").alias("end"), F.col("b.x").alias("qx"), F.col("b.y").alias("qy"))))
    points = ends.select(*keys, line_key, point.alias("p")).select(*keys, line_key, "p.end", "p.qx", "p.qy")
    pk = [line_key, "end"]
    deep = nesting_depth(points, spans, keys, pk)
    for layer in ("wm", "cb"):
        near = polyline.nearest(outline_segments(shapes.where(F.col("layer") == layer), keys), points, keys, pk, most_sides)
        deep = deep.join(near.select(*keys, *pk, F.col("dist").alias(f"to_{layer}")), [*keys, *pk], "left")
    side = lambda end: [F.max(F.when(F.col("end") == end, F.col(c))).alias(f"{n}_{end}") for c, n in (("depth", "depth"), ("to_wm", "wm"), ("to_cb", "cb"))]
    both = deep.groupBy(*keys, line_key).agg(*side("a"), *side("b"))
    by_wm = F.abs(F.col("wm_a") - F.col("wm_b")) > 1e-6
    first = F.when(F.col("depth_a") != F.col("depth_b"), F.col("depth_a") < F.col("depth_b")).when(by_wm, F.col("wm_a") > F.col("wm_b")).otherwise(F.coalesce(F.col("cb_a") <= F.col("cb_b"), F.lit(True)))
    return both.select(*keys, line_key, "depth_a", "depth_b", (~first).alias("reversed"))


def oriented(lines: DataFrame, decisions: DataFrame, keys: list[str], line_key: str) -> DataFrame:
    """The lines with their outer end first."""
    most = F.max("idx").over(Window.partitionBy(*keys, line_key))
    out = lines.join(decisions.select(*keys, line_key, "reversed"), [*keys, line_key])
    return out.withColumn("idx", F.when(F.col("reversed"), most - F.col("idx")).otherwise(F.col("idx"))).drop("reversed")


def crossing_arcs(lines: DataFrame, reference: DataFrame, keys: list[str], line_key: str) -> DataFrame:
    """keys, line_key, arc, dist: where a cut comes nearest the reference line.

    Cuts are dealt out by image before they grow to samples, which meet the reference line where they are made.
    """
    own = [*keys, line_key]
    segs = polyline.segments(dealt_by_count(lines, VERTICES, *keys), own)
    lengths = segs.groupBy(*own).agg(F.max("cum1").alias("length"))
    n = F.floor(F.greatest(F.lit(float(LEAST_SAMPLES)), F.least(F.lit(float(MOST_SAMPLES)), F.col("length"))))
    points = polyline.points_at(segs, polyline.sampled(lengths, own, n), own)
    points = points.select(*own, "k", F.col("px").alias("qx"), F.col("py").alias("qy"))
    near = polyline.nearest(polyline.segments(reference, keys), points, keys, [line_key, "k"])
    return near.groupBy(*own).agg(F.min_by(F.struct("arc", "dist"), F.struct("dist", "k")).alias("b")).select(*own, "b.arc", "b.dist")


def _extended(lines: DataFrame, spans: DataFrame, reach: DataFrame, keys: list[str], line_key: str, at_start: bool, layer: str, inside: bool) -> DataFrame:
    """Adds a vertex beyond one end: the first step along its direction that is (not) in a layer.

    A line that already ends there, or cannot get there within its reach, stays.
    """
    own = [*keys, line_key]
    ranked = lines.withColumn("r", F.row_number().over(Window.partitionBy(*own).orderBy(F.col("idx") if at_start else F.desc("idx"))))
    tips = ranked.where("r <= 2").groupBy(*own).agg(F.max_by(F.struct("x", "y", "idx"), F.when(F.col("r") == 1, 1).otherwise(0)).alias("tip"), F.max_by(F.struct("x", "y"), "r").alias("next"), F.count(F.lit(1)).alias("n"))
    ux, uy = normalised(F.col("tip.x") - F.col("next.x"), F.col("tip.y") - F.col("next.y"))
    tips = tips.where("n = 2").join(reach, own).withColumn("ux", ux).withColumn("uy", uy)
    steps = F.explode(F.sequence(F.lit(0), F.floor(F.col("reach") / STEP).cast("int"))).alias("k")
    tried = tips.select(*own, "tip", "ux", "uy", steps)
    moved = F.col("k") * F.lit(STEP)
    tried = tried.select(*own, "k", F.col("tip.idx").alias("idx"), (F.col("tip.x") + F.col("ux") * moved).alias("qx"), (F.col("tip.y") + F.col("uy") * moved).alias("qy"))
    hit = points_in(tried, spans.where(F.col("layer") == layer), keys, [line_key, "k"])
    marked = tried.join(hit, [*own, "k"], "left").where(F.col("layer").isNotNull() if inside else F.col("layer").isNull())
    first = marked.groupBy(*own).agg(F.min_by(F.struct("k", "idx", "qx", "qy"), "k").alias("p")).where("p.k > 0")
    new_idx = F.col("p.idx") - 1 if at_start else F.col("p.idx") + 1
    return lines.select(*own, "idx", "x", "y").unionByName(first.select(*own, new_idx.alias("idx"), F.col("p.qx").alias("x"), F.col("p.qy").alias("y")))


def reaches(lines: DataFrame, shapes: DataFrame, diagonals: DataFrame, keys: list[str], line_key: str, at_start: bool, layer: str, most_sides: int | None = polyline.KERNEL_SIDES) -> DataFrame:
    """keys, line_key, reach: how far an end may be extended."""
    own = [*keys, line_key]
    ends = line_ends(lines, own)
    end = "a" if at_start else "b"
    points = ends.select(*own, F.col(f"{end}.x").alias("qx"), F.col(f"{end}.y").alias("qy"))
    near = polyline.nearest(outline_segments(shapes.where(F.col("layer") == layer), keys), points, keys, [line_key], most_sides)
    cap = F.least(F.lit(DIAGONAL_SHARE) * F.col("diagonal"), F.greatest(F.lit(LEAST_REACH), F.lit(REACH_FACTOR) * F.col("dist")))
    return near.join(diagonals, keys).select(*own, cap.alias("reach"))


def diagonals(spans: DataFrame, keys: list[str]) -> DataFrame:
    """keys, diagonal of the outline's bounding box in pixels."""
    w, h = F.max("x1") - F.min("x0"), F.max("y") + 1 - F.min("y")
    return spans.where(F.col("layer") == "cb").groupBy(*keys).agg(F.sqrt((w * w + h * h).cast("double")).alias("diagonal"))


def spanning_cuts(lines: DataFrame, spans: DataFrame, shapes: DataFrame, keys: list[str], line_key: str, keep=lambda df: df, most_sides: int | None = polyline.KERNEL_SIDES) -> DataFrame:
    """keys, line_key, idx, x, y of oriented lines that begin outside the outline and end in white matter.

    Each end is looked at several times; ``keep`` stores the lines in between.
    """
    d, lines = diagonals(spans, keys), keep(lines)
    out = keep(_extended(lines, spans, reaches(lines, shapes, d, keys, line_key, True, "cb", most_sides), keys, line_key, True, "cb", False))
    return _extended(out, spans, reaches(out, shapes, d, keys, line_key, False, "wm", most_sides), keys, line_key, False, "wm", True)


def with_white_matter(lines: DataFrame, shapes: DataFrame, keys: list[str]) -> DataFrame:
    """The lines of sections that have white matter: only these are cut into parts."""
    return lines.join(shapes.where(F.col("layer") == "wm").select(*keys).distinct(), keys, "left_semi")


def path_lengths(lines: DataFrame, keys: list[str], line_key: str) -> DataFrame:
    own = [*keys, line_key]
    return polyline.total_length(lines, own).select(*own, "length")


def mean_cut_length(lines: DataFrame, keys: list[str], line_key: str) -> DataFrame:
    return path_lengths(lines, keys, line_key).groupBy(*keys).agg(F.avg("length").alias("mean_length"))


def distance(a: Column, b: Column) -> Column:
    return length(a["x"] - b["x"], a["y"] - b["y"])
