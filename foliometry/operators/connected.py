"""Components, holes, outlines, growth and completed partitions of any size of image, as loops of joins.

The grouped kernels of ``raster`` take one image into one worker. What is here gives the same rows with
no group larger than a scanline's spans or a wave's pixels: spans are the nodes of a graph,
contraction joins them into components, and growth goes wave by wave. All images go through the same
rounds, so rounds are paid once. Each round is written by ``keep`` (which must write: what it
returns is read back), and what it counted is observed while it is written.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from . import polyline, raster, spans
from .components import component_table

Keep = Callable[[DataFrame], DataFrame]
#: Columns begin with "_" so that they clash with no key.
_NODE, _ROOT = "_node", "_root"


def counted(df: DataFrame, keep: Keep, *more: Column) -> tuple[DataFrame, dict]:
    """``df`` kept, with its number of rows (n) and further aggregates, from the same pass."""
    seen = Observation()
    out = keep(df.observe(seen, F.count(F.lit(1)).alias("n"), *more))
    return out, {"n": 0} | {k: v for k, v in seen.get.items() if v is not None}


def node_of(y: Column, x: Column) -> Column:
    """One number for a place, in the order of lines and then columns."""
    return F.shiftleft(y.cast("long"), 32) + (x.cast("long") + F.lit(1 << 31))


def with_nodes(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Spans with the node of the stretch they belong to: spans of one line that overlap or touch are one."""
    line = Window.partitionBy(*keys, "y").orderBy("x0", "x1")
    reach = F.max("x1").over(line.rowsBetween(Window.unboundedPreceding, -1))
    first = F.when(reach.isNull() | (F.col("x0") > reach), node_of(F.col("y"), F.col("x0")))
    return rows.withColumn("_first", first).withColumn(_NODE, F.max("_first").over(line.rowsBetween(Window.unboundedPreceding, 0))).drop("_first")


def touching(nodes: DataFrame, keys: list[str], diagonal: bool = True) -> DataFrame:
    """keys, a, b: nodes of successive lines that touch; at most two edges for a node and line.

    ``nodes`` has disjoint stretches (y, x0, x1, _node). Of two that touch, the later one to begin finds the other as the last
    that began before it on the other line, so one ordered pass finds every pair and no others are made.
    """
    both = F.explode(F.array(F.struct(F.col("y").alias("pair"), F.lit(0).alias("side")), F.struct((F.col("y") - 1).alias("pair"), F.lit(1).alias("side")))).alias("p")
    rows = nodes.select(*keys, "x0", "x1", _NODE, both).select(*keys, "x0", "x1", _NODE, "p.pair", "p.side")
    order = Window.partitionBy(*keys, "pair").orderBy("x0", "side").rowsBetween(Window.unboundedPreceding, -1)
    last = lambda side: F.last(F.when(F.col("side") == side, F.struct("x1", _NODE)), ignorenulls=True).over(order)
    met = rows.withColumn("upper", last(0)).withColumn("lower", last(1))
    other = F.when(F.col("side") == 0, F.col("lower")).otherwise(F.col("upper"))
    met = met.select(*keys, "x0", F.col(_NODE).alias("a"), other.alias("o")).where(F.col("o").isNotNull())
    meets = F.col("x0") <= F.col("o.x1") if diagonal else F.col("x0") < F.col("o.x1")
    return met.where(meets).select(*keys, "a", F.col(f"o.{_NODE}").alias("b"))


def contracted(edges: DataFrame, keys: list[str], keep: Keep) -> DataFrame:
    """keys, _node, _root: the smallest node of its component for every node on an edge.

    Alternating star contraction: every node's larger neighbours, then its smaller ones, are tied to
    the smallest of them, until only stars are left; rounds grow with the logarithm of a component.
    """
    u, v = F.greatest("a", "b"), F.least("a", "b")
    now, seen = counted(edges.select(*keys, u.alias("u"), v.alias("v")).where("u > v").distinct(), keep, _mark(keys))
    while seen["n"]:
        around = now.unionByName(now.select(*keys, F.col("v").alias("u"), F.col("u").alias("v")))
        least = around.groupBy(*keys, "u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = around.where("v > u").join(least, [*keys, "u"]).select(*keys, F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy(*keys, "u").agg(F.min("v").alias("m"))
        down = large.join(least, [*keys, "u"])
        small = down.where("v > m").select(*keys, F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select(*keys, "u", F.col("m").alias("v")))
        after, then = counted(small.distinct(), keep, _mark(keys))
        now, before, seen = after, seen, then
        if before == then:
            break
    roots = now.select(*keys, F.col("v").alias(_NODE)).distinct().select("*", F.col(_NODE).alias(_ROOT))
    return now.select(*keys, F.col("u").alias(_NODE), F.col("v").alias(_ROOT)).unionByName(roots)


def _mark(keys: list[str]) -> Column:
    return F.bit_xor(F.xxhash64(*keys, "u", "v")).alias("mark")


def _rooted(rows: DataFrame, keys: list[str], diagonal: bool, keep: Keep, extra: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """``rows`` with the root of each span's component; ``extra`` gives further edges."""
    rows = keep(with_nodes(rows, keys))
    nodes = rows.groupBy(*keys, "y", _NODE).agg(F.min("x0").alias("x0"), F.max("x1").alias("x1"))
    edges = touching(nodes, keys, diagonal)
    if extra:
        edges = edges.unionByName(extra(rows))
    roots = contracted(edges, keys, keep)
    return rows.join(roots, [*keys, _NODE], "left").withColumn(_ROOT, F.coalesce(_ROOT, _NODE))


def label_spans(rows: DataFrame, keys: list[str], keep: Keep, diagonal: bool = True) -> DataFrame:
    """keys, y, x0, x1, label: components numbered by their first pixel, row by row; the same rows as the kernel's."""
    rooted = keep(_rooted(rows.select(*keys, "y", "x0", "x1"), keys, diagonal, keep))
    number = (F.row_number().over(Window.partitionBy(*keys).orderBy(_ROOT)) - 1).cast("int")
    names = rooted.select(*keys, _ROOT).distinct().select(*keys, _ROOT, number.alias("label"))
    return rooted.join(names, [*keys, _ROOT]).select(*keys, "y", "x0", "x1", "label")


def gaps(rows: DataFrame, keys: list[str]) -> DataFrame:
    """keys, y, x0, x1 of the background in a region's bounds with one pixel more on each side; ``border`` marks what reaches it.

    Lines without a span, the two beyond the bounds among them, are one gap.
    """
    box = rows.groupBy(*keys).agg(F.min("y").alias("top"), F.max("y").alias("bottom"), (F.min("x0") - 1).alias("left"), (F.max("x1") + 1).alias("right"))
    lines = box.select(*keys, "left", "right", F.explode(F.sequence(F.col("top") - 1, F.col("bottom") + 1)).alias("y"))
    stops = lines.select(*keys, "y", F.col("left").alias("x0"), F.col("left").alias("x1"), F.lit(True).alias("side"))
    stops = stops.unionByName(lines.select(*keys, "y", F.col("right").alias("x0"), F.col("right").alias("x1"), F.lit(True).alias("side")))
    every = rows.select(*keys, "y", "x0", "x1", F.lit(False).alias("side")).unionByName(stops)
    line = Window.partitionBy(*keys, "y").orderBy("x0", "x1").rowsBetween(Window.unboundedPreceding, -1)
    every = every.withColumn("from", F.max("x1").over(line)).withColumn("first", F.count_if("side").over(line) == 1)
    left = F.col("first") & (F.count(F.lit(1)).over(line) == 1)
    out = every.withColumn("border", left | F.col("side")).where(F.col("from") < F.col("x0"))
    return out.select(*keys, "y", F.col("from").alias("x0"), F.col("x0").alias("x1"), "border")


def holes(rows: DataFrame, keys: list[str], keep: Keep) -> DataFrame:
    """keys, enclosed, ring: background pixels that no 4-connected path joins with the border.

    Gaps that reach the border are tied to the first gap of all, which stands for the outside.
    """
    spare = keep(gaps(rows.select(*keys, "y", "x0", "x1"), keys))

    def border(nodes: DataFrame) -> DataFrame:
        first = nodes.groupBy(*keys).agg(F.min(_NODE).alias("b"))
        return nodes.where("border").join(first, keys).select(*keys, F.col(_NODE).alias("a"), "b")

    rooted = _rooted(spare, keys, False, keep, border)
    first = rooted.groupBy(*keys).agg(F.min(_ROOT).alias("_out"))
    inner = F.sum(F.when(F.col(_ROOT) != F.col("_out"), (F.col("x1") - F.col("x0")).cast("long")))
    out = rooted.join(first, keys).groupBy(*keys).agg(F.coalesce(inner, F.lit(0)).alias("enclosed"))
    return out.withColumn("ring", F.col("enclosed") > raster.HOLE_PIXELS)


def corners(rows: DataFrame, keys: list[str]) -> DataFrame:
    """keys, y, x of the places where an outline turns, with the corner that is next to each along its line (_beside) and along its column (_below).

    Each stretch of pixels has four corners; of those that meet in one place an even number cancels out. Along any line
    or column corners then come in pairs, and between the two of a pair runs a side of the outline. Where two pixels touch
    by a corner only, both sides go straight on, so every corner is on one ring.
    """
    nodes = with_nodes(rows.select(*keys, "y", "x0", "x1"), keys).groupBy(*keys, "y", _NODE).agg(F.min("x0").alias("x0"), F.max("x1").alias("x1"))
    four = F.explode(F.array(*(F.struct((F.col("y") + d).alias("y"), F.col(c).alias("x")) for d in (0, 1) for c in ("x0", "x1")))).alias("v")
    odd = nodes.select(*keys, four).groupBy(*keys, F.col("v.y").alias("y"), F.col("v.x").alias("x")).agg(F.count(F.lit(1)).alias("n")).where("n % 2 = 1").drop("n")
    out = odd.withColumn(_NODE, node_of(F.col("y"), F.col("x")))
    for name, along, by in (("_beside", "y", "x"), ("_below", "x", "y")):
        line = Window.partitionBy(*keys, along).orderBy(by)
        out = out.withColumn(name, F.when(F.row_number().over(line) % 2 == 1, F.lead(_NODE).over(line)).otherwise(F.lag(_NODE).over(line)))
    return out


def outline_vertices(rows: DataFrame, keys: list[str], keep: Keep) -> DataFrame:
    """keys, ring, idx, x, y: closed rings around a region of spans; filling them by the even-odd rule gives its pixels back.

    Rings are numbered by their first corner, row by row, begin there and run to the right. From a corner along its line
    and then its column leads a step that visits every second corner of a ring; pointers over one, two, four ... steps find the
    first corner of the circle and how far it is, in as many joins as the longest ring has bits. Of a ring's
    two circles, one each way round, the one with the ring's first corner is kept.
    """
    at = keep(corners(rows, keys))
    step = at.select(*keys, F.col(_NODE).alias("_beside"), F.col("_below").alias("_to"))
    now = keep(at.join(step, [*keys, "_beside"]).select(*keys, _NODE, "_to", F.col(_NODE).alias(_ROOT), F.lit(0).cast("long").alias("_far")))
    reach, moved = 1, True
    while moved:
        ahead = now.select(*keys, F.col(_NODE).alias("_to"), F.col("_to").alias("_next"), F.col(_ROOT).alias("_r"), F.col("_far").alias("_f"))
        less = F.col("_r") < F.col(_ROOT)
        both = now.join(ahead, [*keys, "_to"]).withColumn("_less", less)
        both = both.select(*keys, _NODE, F.col("_next").alias("_to"), F.least(_ROOT, "_r").alias(_ROOT), F.when(F.col("_less"), F.col("_f") + reach).otherwise(F.col("_far")).alias("_far"), "_less")
        both, seen = counted(both, keep, F.count_if("_less").alias("moved"))
        now, reach, moved = both.drop("_less"), 2 * reach, bool(seen.get("moved"))
    placed = at.join(now.select(*keys, _NODE, _ROOT, "_far"), [*keys, _NODE])
    other = placed.select(*keys, F.col(_NODE).alias("_beside"), F.col(_ROOT).alias("_r"), F.col("x").alias("_x"))
    own = placed.join(other, [*keys, "_beside"]).where(F.col(_ROOT) < F.col("_r"))
    place = F.row_number().over(Window.partitionBy(*keys, _ROOT).orderBy(F.col("_far") != 0, -F.col("_far"))) - 1
    ring = (F.dense_rank().over(Window.partitionBy(*keys).orderBy(_ROOT)) - 1).alias("ring")
    pair = F.explode(F.array(F.struct((2 * F.col("k")).alias("idx"), "x", "y"), F.struct((2 * F.col("k") + 1).alias("idx"), F.col("_x").alias("x"), "y"))).alias("v")
    return own.withColumn("k", place).select(*keys, ring, "k", "x", "_x", "y").select(*keys, "ring", pair).select(*keys, "ring", "v.idx", "v.x", "v.y")


def outlines(rows: DataFrame, keys: list[str], keep: Keep) -> DataFrame:
    """keys, rings: ``outline_vertices`` in the form of traced regions; the rings of a region must fit a row."""
    of_ring = F.sort_array(F.collect_list(F.struct("idx", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))))
    rings = outline_vertices(rows, keys, keep).groupBy(*keys, "ring").agg(of_ring.alias("v"))
    rings = rings.select(*keys, "ring", F.transform("v", lambda v: F.struct(v["x"].alias("x"), v["y"].alias("y"))).alias("v"))
    return rings.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("ring", "v"))).alias("r")).select(*keys, F.col("r.v").alias("rings"))


def pixels_of(rows: DataFrame, keys: list[str], *more: str) -> DataFrame:
    return rows.select(*keys, "y", F.explode(F.sequence("x0", F.col("x1") - 1)).alias("x"), *more)


def _around(towards: bool) -> Column:
    """The eight neighbours in the order of growth: d, and the place that a step leads to, or that it comes from."""
    sign = 1 if towards else -1
    places = [F.struct(F.lit(d).alias("d"), (F.col("x") + sign * dx).alias("nx"), (F.col("y") + sign * dy).alias("ny")) for d, (dx, dy) in enumerate(raster.AROUND)]
    return F.explode(F.array(*places)).alias("s")


def beside(pixels: DataFrame, labelled: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``pixels`` with d, nx, ny and label of every labelled pixel around them."""
    near = pixels.select("*", _around(False)).select(*pixels.columns, "s.d", "s.nx", "s.ny")
    other = labelled.select(*keys, F.col("y").alias("ny"), F.col("x0").alias("_x0"), F.col("x1").alias("_x1"), "label")
    return near.join(other, [*keys, "ny"]).where((F.col("_x0") <= F.col("nx")) & (F.col("nx") < F.col("_x1"))).drop("_x0", "_x1")


def grown(labelled: DataFrame, open_: DataFrame, keys: list[str], keep: Keep) -> DataFrame:
    """keys, y, x, label of the open pixels that labels reach, breadth first.

    ``labelled`` has spans, ``open_`` pixels (y, x). Labelled pixels come row by row and their neighbours in a fixed order, as from a
    queue; a pixel's rank is that of the one that reached it first, then the direction.
    """
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy("o")).alias("rank")
    first = beside(open_, labelled, keys).withColumn("o", F.struct(F.col("ny").alias("i"), F.col("nx").alias("j"), "d"))
    first = first.groupBy(*keys, "y", "x").agg(F.min(F.struct("o", "label")).alias("m")).select(*keys, "y", "x", "m.label", F.col("m.o").alias("o"))
    wave, seen = counted(first.select(*keys, "y", "x", "label", rank), keep)
    waves, left = [], open_
    while seen["n"]:
        waves.append(wave)
        left = keep(left.join(wave.select(*keys, "y", "x"), [*keys, "y", "x"], "left_anti"))
        step = wave.select(*keys, "label", "rank", _around(True).alias("s"), "x", "y").select(*keys, "label", "rank", "s.d", F.col("s.nx").alias("x"), F.col("s.ny").alias("y"))
        step = step.join(left, [*keys, "y", "x"], "left_semi").withColumn("o", F.struct(F.col("rank").alias("i"), F.col("d").alias("j")))
        step = step.groupBy(*keys, "y", "x").agg(F.min(F.struct("o", "label")).alias("m")).select(*keys, "y", "x", "m.label", F.col("m.o").alias("o"))
        wave, seen = counted(step.select(*keys, "y", "x", "label", rank), keep)
    out = wave
    for w in waves:
        out = out.unionByName(w)
    return out.select(*keys, "y", "x", "label")


def merged(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Disjoint labelled spans as the longest spans of one label."""
    line = Window.partitionBy(*keys, "y").orderBy("x0")
    begins = F.when((F.lag("x1").over(line) == F.col("x0")) & (F.lag("label").over(line) == F.col("label")), 0).otherwise(1)
    run = rows.withColumn("_new", begins).withColumn("_run", F.sum("_new").over(line.rowsBetween(Window.unboundedPreceding, 0)))
    return run.groupBy(*keys, "y", "_run").agg(F.min("x0").alias("x0"), F.max("x1").alias("x1"), F.first("label").alias("label")).select(*keys, "y", "x0", "x1", "label")


def complete(parts: DataFrame, region: DataFrame, least: DataFrame, keys: list[str], keep: Keep) -> DataFrame:
    """keys, y, x0, x1, label: every pixel of the region that can be reached gets the label of a kept component.

    ``parts`` are labelled components, ``least`` (keys, least) the pixels that make one worth keeping. Kept ones grow
    around the slivers; then each sliver goes whole to the label it touches most (lowest of
    equals). Components do not touch each other, so no sliver's choice depends on another's. Growth then fills the rest.
    """
    sizes = parts.groupBy(*keys, "label").agg(F.sum((F.col("x1") - F.col("x0")).cast("long")).alias("size")).join(least, keys)
    name = F.when(F.col("size") >= F.col("least"), F.sum((F.col("size") >= F.col("least")).cast("int")).over(Window.partitionBy(*keys).orderBy("label")) - 1)
    named = keep(parts.join(sizes.select(*keys, "label", name.cast("int").alias("name")), [*keys, "label"]))
    kept = named.where(F.col("name").isNotNull()).select(*keys, "y", "x0", "x1", F.col("name").alias("label"))
    slivers = named.where(F.col("name").isNull()).select(*keys, "y", "x0", "x1", "label")
    free = keep(pixels_of(spans.subtract(region, parts, keys), keys))
    one = lambda p: p.select(*keys, "y", F.col("x").alias("x0"), (F.col("x") + 1).alias("x1"), "label")
    owned = keep(kept.unionByName(one(grown(kept, free, keys, keep))))
    votes = beside(pixels_of(slivers, keys, F.col("label").alias("sliver")), owned, keys).groupBy(*keys, "sliver", "label").agg(F.count(F.lit(1)).alias("n"))
    chosen = votes.groupBy(*keys, "sliver").agg(F.max_by("label", F.struct("n", -F.col("label"))).alias("name"))
    joined = slivers.join(chosen.withColumnRenamed("sliver", "label"), [*keys, "label"]).select(*keys, "y", "x0", "x1", F.col("name").alias("label"))
    owned = keep(owned.unionByName(joined))
    rest = keep(pixels_of(spans.subtract(region, owned, keys), keys))
    return merged(owned.unionByName(one(grown(owned, rest, keys, keep))), keys)


def partition(grey: DataFrame, cuts: DataFrame, keys: list[str], keep: Keep) -> DataFrame:
    """The rows of ``partition.partition`` for regions of any size.

    Widths are tried from the thinnest on; after each, the regions that came apart as expected are taken out, so wider
    strips are drawn only where they are needed.
    """
    grey = keep(grey.select(*keys, "y", "x0", "x1").join(cuts.select(*keys).distinct(), keys, "left_semi"))
    lines = keep(cuts.select(*keys, "cut_id", "idx", "x", "y").join(grey.select(*keys).distinct(), keys, "left_semi"))
    length = polyline.total_length(lines, [*keys, "cut_id"]).groupBy(*keys).agg(F.sum("length").alias("s"), F.count(F.lit(1)).alias("n"))
    n = F.sum((F.col("x1") - F.col("x0")).cast("long")).alias("area")
    wide, high = F.max("x1") - F.min("x0"), F.max("y") - F.min("y") + 1
    margin = F.greatest(F.lit(50), F.floor(F.greatest(wide, high) * F.lit(0.08))).cast("int")
    of = grey.groupBy(*keys).agg(n, (F.min("x0") - margin).alias("ox"), (F.min("y") - margin).alias("oy"))
    of = of.join(length, keys).join(holes(grey, keys, keep).select(*keys, "ring"), keys)
    expected = (F.col("n") + F.when(F.col("ring"), 0).otherwise(1)).cast("int")
    least = F.floor(F.col("area") * F.lit(raster.SLIVER_SHARE)).cast("long")
    todo = every = keep(of.select(*keys, "area", "ox", "oy", "ring", expected.alias("expected"), least.alias("least"), (F.col("s") / F.col("n")).alias("mean")))
    tries, found = [], []
    for k, share in enumerate(raster.WIDTHS):
        half = F.greatest(F.lit(raster.LEAST_HALF_WIDTH), F.col("mean") * F.lit(share))
        region = grey.join(todo.select(*keys), keys, "left_semi")
        labelled = keep(label_spans(spans.subtract(region, strips(lines, todo.withColumn("half", half), keys), keys), keys, keep))
        sizes = component_table(labelled, keys).select(*keys, "size").join(todo.select(*keys, "least"), keys).where(F.col("size") >= F.col("least"))
        sizes = sizes.groupBy(*keys).agg(F.count(F.lit(1)).cast("int").alias("kept"), F.sum("size").alias("kept_area"))
        tried = todo.join(sizes, keys, "left").withColumn("kept", F.coalesce("kept", F.lit(0))).withColumn("kept_area", F.coalesce("kept_area", F.lit(0).cast("long")))
        clean = (F.col("kept") == F.col("expected")) & (F.col("kept_area") >= F.col("area") * F.lit(raster.KEPT_SHARE))
        tried, seen = counted(tried.select("*", clean.alias("clean"), half.alias("half_width"), F.lit(k).alias("k")), keep, F.count_if(~F.col("clean")).alias("bad"))
        tries.append(tried)
        found.append(labelled.withColumn("k", F.lit(k)))
        if not seen.get("bad"):
            break
        todo = keep(todo.join(tried.where("clean").select(*keys), keys, "left_anti"))
    rows, labelled = tries[0], found[0]
    for more, spans_of in zip(tries[1:], found[1:], strict=True):
        rows, labelled = rows.unionByName(more), labelled.unionByName(spans_of)
    best = Window.partitionBy(*keys).orderBy(~F.col("clean"), F.abs(F.col("kept") - F.col("expected")), -F.col("kept_area"), "k")
    how = keep(rows.withColumn("_r", F.row_number().over(best)).where("_r = 1").drop("_r"))
    parts = keep(labelled.join(how.select(*keys, "k"), [*keys, "k"], "left_semi").drop("k"))
    out = keep(complete(parts, grey, every.select(*keys, "least"), keys, keep))
    assigned = out.groupBy(*keys).agg(F.sum((F.col("x1") - F.col("x0")).cast("long")).alias("assigned"))
    how = how.join(assigned, keys).select(*keys, "ring", "expected", "kept", "clean", "half_width", "area", "assigned")
    return out.join(how, keys)


def strips(lines: DataFrame, of: DataFrame, keys: list[str]) -> DataFrame:
    """keys, y, x0, x1 of the strips around cuts; ``of`` has each region's canvas (ox, oy) and half width.

    Corners pass single precision in the canvas's coordinates.
    """
    own = [*keys, "cut_id"]
    moved = lines.join(of.select(*keys, "ox", "oy", "half"), keys)
    moved = moved.select(*own, "idx", (F.col("x") - F.col("ox")).alias("x"), (F.col("y") - F.col("oy")).alias("y"), "half")
    normals = polyline.vertex_normals(moved, own).join(of.select(*keys, "half"), keys)
    rank = F.row_number().over(Window.partitionBy(*own).orderBy("idx"))
    corner = lambda i, sign: F.struct(i.alias("i"), *((F.col(c) + sign * F.col(f"n{c}") * F.col("half")).cast("float").cast("double").alias(c) for c in "xy"))
    sides = F.explode(F.array(corner(F.col("k"), 1), corner(-F.col("k") + F.lit(1 << 40), -1))).alias("v")
    corners = normals.withColumn("k", rank.cast("long")).select(*own, sides)
    ring = F.transform(F.sort_array(F.collect_list("v")), lambda v: F.struct(v["x"].alias("x"), v["y"].alias("y")))
    drawn = spans.rasterize(corners.groupBy(*own).agg(F.array(ring).alias("rings")), own)
    back = drawn.join(of.select(*keys, "ox", "oy"), keys)
    return back.select(*keys, (F.col("y") + F.col("oy")).alias("y"), (F.col("x0") + F.col("ox")).alias("x0"), (F.col("x1") + F.col("ox")).alias("x1"))
