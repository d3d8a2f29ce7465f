"""Regions as spans of pixels: rasterizing, region algebra and areas.

A span is a row (keys, y, x0, x1) of the pixels x0 <= x < x1. A pixel belongs to a region if its
centre does (even-odd rule). Work is by scanline, so the shuffle key is (section, y).
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import pixel_from
from ..plans.store import unsized

#: Crossings of sides and scanlines that one row's array holds, about.
CROSSINGS = 1 << 16


def edges(shapes: DataFrame, keys: list[str], numbered: bool = False) -> DataFrame:
    """keys, ax, ay, bx, by: the sides of all rings of shapes with a ``rings`` column; ring_no and side_no too if ``numbered``."""
    ring = F.col("ring")
    closed = F.zip_with(ring, F.concat(F.slice(ring, 2, F.greatest(F.size(ring) - 1, F.lit(0))), F.slice(ring, 1, 1)), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    sides = shapes.select(*keys, F.posexplode("rings").alias("ring_no", "ring")).select(*keys, "ring_no", F.posexplode(closed).alias("side_no", "e"))
    return sides.select(*keys, *(["ring_no", "side_no"] if numbered else []), F.col("e.a.x").alias("ax"), F.col("e.a.y").alias("ay"), F.col("e.b.x").alias("bx"), F.col("e.b.y").alias("by"))


def rasterize_edges(sides: DataFrame, keys: list[str]) -> DataFrame:
    """keys, y, x0, x1 of the regions that closed sides enclose."""
    low, high = pixel_from(F.least("ay", "by")), pixel_from(F.greatest("ay", "by")) - 1
    rows = sides.where(F.col("ay") != F.col("by")).withColumn("low", low).withColumn("high", high).where("low <= high")
    rows = rows.select(*keys, "ax", "ay", "bx", "by", F.explode(F.sequence("low", "high")).alias("y"))
    cross = F.col("ax") + (F.col("y") + F.lit(0.5) - F.col("ay")) * (F.col("bx") - F.col("ax")) / (F.col("by") - F.col("ay"))
    lines = rows.select(*keys, "y", cross.alias("c")).groupBy(*keys, "y").agg(F.sort_array(F.collect_list("c")).alias("c"))
    pair = lambda i: F.struct(pixel_from(F.get(F.col("c"), i)).alias("x0"), pixel_from(F.get(F.col("c"), i + 1)).alias("x1"))
    pairs = F.transform(F.sequence(F.lit(0), F.size("c") - 2, F.lit(2)), pair)
    out = lines.where(F.size("c") >= 2).select(*keys, "y", F.explode(pairs).alias("s"))
    return out.select(*keys, "y", "s.x0", "s.x1").where("x0 < x1")


#: Tasks a core that ``dealt`` makes, as far as Spark is set to shuffle into as many.
TASKS_A_CORE = 4


def dealt(rows: DataFrame, *keys: str) -> DataFrame:
    """``rows`` by ``keys`` in a fixed number of tasks, however small they are.

    Few bytes that grow to many rows would otherwise be left in one task, or put there as Spark sees only the bytes.
    """
    spark = rows.sparkSession
    most = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(min(most, TASKS_A_CORE * spark.sparkContext.defaultParallelism), *keys)


def dealt_by_count(rows: DataFrame, each: int, *keys: str) -> DataFrame:
    """``rows`` by ``keys`` in as many tasks as there are times ``each`` rows, as ``each`` of them grow to what one task sorts in memory."""
    return rows.repartition(max(1, rows.sparkSession.sparkContext.defaultParallelism, -(-rows.count() // each)), *keys)


def _placed(ring: Column) -> Column:
    """A ring without the vertices that have no place."""
    return F.filter(ring, lambda v: v["x"].isNotNull() & v["y"].isNotNull() & ~F.isnan(v["x"]) & ~F.isnan(v["y"]))


def _closed(ring: Column) -> Column:
    """The sides of a ring that cross scanlines, with the first and last of those."""
    after = F.concat(F.slice(ring, 2, F.greatest(F.size(ring) - 1, F.lit(0))), F.slice(ring, 1, 1))
    ends = lambda a, b: (pixel_from(F.least(a["y"], b["y"])).alias("low"), (pixel_from(F.greatest(a["y"], b["y"])) - 1).alias("high"))
    sides = F.zip_with(ring, after, lambda a, b: F.struct(*ends(a, b), a["x"].alias("ax"), a["y"].alias("ay"), b["x"].alias("bx"), b["y"].alias("by")))
    return F.filter(sides, lambda s: s["low"] <= s["high"])


def rasterize(shapes: DataFrame, keys: list[str]) -> DataFrame:
    """keys, y, x0, x1 of the regions that ``rings`` enclose; rows of equal keys are one region.

    Outlines are dealt out by the first key, the image, and their spans stay where they are made: what is grouped by image and
    scanline later on moves none of them. A region's crossings are sorted as an array, in bands of scanlines with about ``CROSSINGS``
    each; closed rings cross a scanline an even number of times, so sorted crossings pair up.
    """
    rings = F.flatten(F.collect_list(F.filter("rings", lambda r: r.isNotNull())))
    whole = dealt(shapes.select(*keys, "rings"), *keys[:1]).groupBy(*keys).agg(rings.alias("rings"))
    whole = whole.select(*keys, F.flatten(F.transform(F.transform("rings", _placed), _closed)).alias("_sides"))
    n = F.aggregate("_sides", F.lit(0).cast("long"), lambda n, s: n + s["high"] - s["low"] + 1)
    top, bottom = F.array_min(F.transform("_sides", lambda s: s["low"])), F.array_max(F.transform("_sides", lambda s: s["high"]))
    whole = whole.select(*keys, "_sides", top.alias("_top"), bottom.alias("_bottom"), F.greatest(F.ceil(n / CROSSINGS), F.lit(1)).alias("_bands"))
    high = F.ceil((F.col("_bottom") - F.col("_top") + 1) / F.col("_bands")).cast("int")
    band = whole.withColumn("_high", high).select("*", F.explode(F.sequence("_top", "_bottom", "_high")).alias("_y0"))
    first, last = F.col("_y0"), F.least(F.col("_y0") + F.col("_high") - 1, F.col("_bottom"))
    at = lambda s, y: s["ax"] + (y + F.lit(0.5) - s["ay"]) * (s["bx"] - s["ax"]) / (s["by"] - s["ay"])
    own = F.filter("_sides", lambda s: (s["low"] <= last) & (s["high"] >= first))
    met = F.transform(own, lambda s: F.transform(F.sequence(F.greatest(s["low"], first), F.least(s["high"], last)), lambda y: F.struct(y.alias("y"), at(s, y).alias("c"))))
    lines = band.select(*keys, F.sort_array(F.flatten(met)).alias("_c"))  # no filter here: it would sort again
    of = lambda i: F.get(F.col("_c"), i)
    pair = lambda i: F.struct(of(2 * i)["y"].alias("y"), pixel_from(of(2 * i)["c"]).alias("x0"), pixel_from(of(2 * i + 1)["c"]).alias("x1"))
    out = lines.select(*keys, F.explode(F.transform(F.sequence(F.lit(0), (F.size("_c") / 2).cast("int") - 1), pair)).alias("s"))
    return out.select(*keys, "s.y", "s.x0", "s.x1").where("x0 < x1")


def clip(spans: DataFrame, width: Column, height: Column) -> DataFrame:
    """Spans within the canvas; lines outside it go."""
    out = spans.withColumn("x0", F.greatest("x0", F.lit(0))).withColumn("x1", F.least("x1", width))
    return out.where((F.col("y") >= 0) & (F.col("y") < height) & (F.col("x0") < F.col("x1")))


def cells(spans: DataFrame, keys: list[str], layers: list[str]) -> DataFrame:
    """keys, y, x0, x1 and a boolean for each layer: scanlines cut wherever a layer begins or ends.

    ``spans`` has a column ``layer``. A sweep along each scanline counts a layer up where one of its
    spans begins and down where one ends, so its spans may overlap, nest and touch. A layer without spans
    (a region that was not traced) is false everywhere.
    """
    ends = F.explode(F.array(F.struct(F.col("x0").alias("x"), F.lit(1).alias("d")), F.struct(F.col("x1").alias("x"), F.lit(-1).alias("d")))).alias("e")
    events = spans.where("x0 < x1").select(*keys, "y", "layer", ends).select(*keys, "y", "layer", "e.x", "e.d")
    line = Window.partitionBy(*keys, "y").orderBy("x")
    depth = line.rangeBetween(Window.unboundedPreceding, Window.currentRow)  # all that begins or ends at a place counts there
    flags = [(F.sum(F.when(F.col("layer") == layer, F.col("d")).otherwise(0)).over(depth) > 0).alias(layer) for layer in layers]
    out = events.select(*keys, "y", F.col("x").alias("x0"), F.lead("x").over(line).alias("x1"), *flags)
    return out.where(reduce(or_, map(F.col, layers)) & (F.col("x0") < F.col("x1")))


def joined_cells(cut: DataFrame, keys: list[str]) -> DataFrame:
    """keys, y, x0, x1: cells that touch, as one span."""
    line = Window.partitionBy(*keys, "y").orderBy("x0")
    begins = F.when(F.lag("x1").over(line) == F.col("x0"), 0).otherwise(1)
    run = cut.select(*keys, "y", "x0", "x1", begins.alias("_new"))
    run = run.withColumn("_run", F.sum("_new").over(line.rowsBetween(Window.unboundedPreceding, 0)))
    return run.groupBy(*keys, "y", "_run").agg(F.min("x0").alias("x0"), F.max("x1").alias("x1")).drop("_run")


def _both(first: DataFrame, second: DataFrame, keys: list[str]) -> DataFrame:
    """Cells of two regions: flags _a and _b."""
    of = lambda rows, name: rows.select(*keys, "y", "x0", "x1", F.lit(name).alias("layer"))
    return cells(of(first, "_a").unionByName(of(second, "_b")), keys, ["_a", "_b"])


def derived_layers(cut: DataFrame) -> DataFrame:
    """Adds grey, granular and molecular to cells with cb, gl and wm."""
    grey, granular = F.col("cb") & ~F.col("wm"), F.col("gl") & ~F.col("wm")
    return cut.withColumn("grey", grey).withColumn("granular", granular).withColumn("molecular", grey & ~granular)


def intersect(first: DataFrame, second: DataFrame, keys: list[str]) -> DataFrame:
    """keys, y, x0, x1 of the pixels in both regions, as the longest spans; spans of one region may overlap."""
    return joined_cells(_both(first, second, keys).where("_a AND _b"), keys)


def subtract(first: DataFrame, second: DataFrame, keys: list[str]) -> DataFrame:
    """keys, y, x0, x1 of the pixels in the first region only, as the longest spans; an empty second region takes nothing."""
    return joined_cells(_both(first, second, keys).where("_a AND NOT _b"), keys)


def pixels(flag: Column) -> Column:
    """Aggregate: pixels of the cells where ``flag`` holds."""
    return F.coalesce(F.sum(F.when(flag, (F.col("x1") - F.col("x0")).cast("long"))), F.lit(0)).alias("px")


def area(flag: Column, px_w: Column, px_h: Column) -> Column:
    return pixels(flag) * px_w * px_h


def layer_pixels(cut: DataFrame, keys: list[str]) -> DataFrame:
    """keys and pixel counts of the traced and derived layers, in one pass."""
    names = ("cb", "grey", "granular", "molecular")
    return derived_layers(cut).groupBy(*keys).agg(*(pixels(F.col(n)).alias(n) for n in names))


def outside(cut: DataFrame, keys: list[str], inner: str, outer: str, tolerated: float) -> DataFrame:
    """keys, inner_px, outside_px, percent of the inner regions that reach notably beyond the outer one."""
    t = cut.groupBy(*keys).agg(pixels(F.col(inner)).alias("inner_px"), pixels(F.col(inner) & ~F.col(outer)).alias("outside_px"))
    t = t.where(F.col("outside_px") > F.greatest(F.col("inner_px") * F.lit(tolerated), F.lit(1e-9)))
    return t.withColumn("percent", F.col("outside_px") * F.lit(100.0) / F.col("inner_px"))


def points_in(points: DataFrame, spans: DataFrame, keys: list[str], point_keys: list[str]) -> DataFrame:
    """keys, point_keys, layer for each layer that holds the pixel of (qx, qy); an equi-join on the scanline."""
    p = points.select(*keys, *point_keys, F.floor("qx").cast("int").alias("px"), F.floor("qy").cast("int").alias("y"))
    hit = p.join(unsized(spans), [*keys, "y"]).where((F.col("x0") <= F.col("px")) & (F.col("px") < F.col("x1")))
    return hit.select(*keys, *point_keys, "layer").distinct()
