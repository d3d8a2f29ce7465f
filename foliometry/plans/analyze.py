"""From traced images to measured sections: validate, analyze, combine.

Everything is keyed by (section_id, instance). Sections with problems are set aside with
their problems as rows; the others are measured. Regions become spans once, and
totals, sections, clipping and reports all read those.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import area_unit, length_unit
from ..operators import classify, clip, fissure, polyline, results, spans
from ..operators.partition import partition, section_areas
from ..sources.model import line_vertices
from .store import stored

KEYS = ["section_id", "instance"]
_LAYER = {"CEREBELLUM": "cb", "GRANULAR_WM": "gl", "WHITE_MATTER": "wm"}


@dataclass
class Analysis:
    problems: DataFrame  # section_id, instance, code, n, message
    good: DataFrame  # regions and lines of sections without problems, with category and instance
    cells: DataFrame  # spans cut at all layers, with derived layers
    cuts: DataFrame  # spanning cuts: KEYS, cut_id, idx, x, y
    labelled: DataFrame  # spans with label and how the cutting went
    totals: DataFrame  # KEYS, six measures, units, joined
    parts: DataFrame  # KEYS, ord, name, label, granular, molecular, purkinje
    runs: DataFrame  # KEYS, label, run, idx, x, y
    notes: DataFrame  # KEYS, level, code, percent


def validate(rois: DataFrame, sections: DataFrame | None = None, marker: str = classify.OUTPUT_PROPERTY, keep=lambda df: df) -> tuple[DataFrame, DataFrame]:
    """(measurable rows with category and instance, problems). The names are read once, the checks once, if ``keep`` stores them."""
    named = keep(classify.narrow(rois, marker))
    problems = keep(classify.problems_of(named, sections))
    return classify.measured_rows(rois, problems, marker), problems


def _most_sides(good: DataFrame) -> int | None:
    """The bound of ``polyline.nearest`` if an outline or line has more vertices, else None: they are counted once for all its calls."""
    n = F.aggregate("rings", F.lit(0).cast("long"), lambda n, ring: n + F.coalesce(F.size(ring), F.lit(0)))
    many = good.groupBy(*KEYS, "category").agg(F.sum(n).alias("n")).where(F.col("n") > polyline.KERNEL_SIDES)
    return None if many.isEmpty() else polyline.KERNEL_SIDES


def analyze(rois: DataFrame, sections: DataFrame, keep=stored, marker: str = classify.OUTPUT_PROPERTY) -> Analysis:
    """Measures every valid piece. ``keep`` stores the tables that later steps read several times."""
    good, problems = validate(rois, sections, marker, keep)
    good = keep(good)
    most_sides = _most_sides(good)
    names = F.create_map(*(F.lit(x) for kv in _LAYER.items() for x in kv))
    shapes = good.where(F.col("category").isin(*_LAYER)).select(*KEYS, names[F.col("category")].alias("layer"), "rings")
    scale = sections.select("section_id", "width", "height", "px_w", "px_h", "unit")
    filled = spans.rasterize(shapes, [*KEYS, "layer"]).join(scale.select("section_id", "width", "height"), "section_id")
    filled = keep(spans.clip(filled, F.col("width"), F.col("height")).drop("width", "height"))
    cells = keep(spans.derived_layers(spans.cells(filled, KEYS, ["cb", "gl", "wm"])))
    lines = line_vertices(good.where(F.col("category") == "PURKINJE"), KEYS)
    traced = fissure.with_white_matter(good.where(F.col("category") == "FISSURE"), shapes, KEYS)
    traced = line_vertices(traced.select(*KEYS, F.col("roi_idx").alias("cut_id"), "rings"), [*KEYS, "cut_id"])
    decisions = fissure.outer_end_first(traced, filled, shapes, KEYS, "cut_id", most_sides)
    cuts = keep(fissure.spanning_cuts(fissure.oriented(traced, decisions, KEYS, "cut_id"), filled, shapes, KEYS, "cut_id", keep, most_sides))
    grey = cells.where("grey").select(*KEYS, "y", "x0", "x1")
    labelled = keep(partition(grey, cuts, KEYS))

    # the line: sampled by length for the order of sections, walked in small steps for lengths
    segs = polyline.segments(lines, KEYS)
    lengths = segs.groupBy(*KEYS).agg(F.max("cum1").alias("length"))
    samples = polyline.points_at(segs, polyline.sampled(lengths, KEYS, F.greatest(F.lit(1), F.ceil("length"))), KEYS)
    where = labelled.select(*KEYS, "y", "x0", "x1", "label", F.col("label").alias("layer"))
    points = samples.select(*KEYS, "k", "arc", F.col("px").alias("qx"), F.col("py").alias("qy"))
    samples = keep(spans.points_in(points, where, KEYS, ["k", "arc"]).withColumnRenamed("layer", "label"))
    joined = results.ends_joined(samples, KEYS).select(*KEYS, "joined")
    order = results.line_order(samples, KEYS)
    size = labelled.groupBy(*KEYS, "label").agg(F.sum(F.col("x1") - F.col("x0")).alias("n"), *((F.sum((F.col("x1") - F.col("x0")) * v) / F.sum(F.col("x1") - F.col("x0")) + 0.5).alias(q) for v, q in (((F.col("x0") + F.col("x1") - 1) / 2, "qx"), (F.col("y"), "qy"))))
    beside = polyline.nearest(segs, size.join(order, [*KEYS, "label"], "left_anti"), KEYS, ["label"], most_sides).select(*KEYS, "label", F.col("arc").alias("order_arc"))
    ordered = order.unionByName(beside).join(joined, KEYS, "left").withColumn("joined", F.coalesce("joined", F.lit(False)))
    ordered = results.labelled(ordered, KEYS, F.col("joined"))

    marked = keep(clip.clipped(lines, labelled, KEYS))
    across, down = (F.col("x2") - F.col("x")) * F.col("px_w"), (F.col("y2") - F.col("y")) * F.col("px_h")
    size_of = F.sqrt(across * across + down * down)
    within = clip.length_by_label(marked.join(scale, "section_id").withColumn("step_len", size_of / F.col("n")), KEYS)
    pixel = F.col("px_w") * F.col("px_h")
    parts = ordered.join(section_areas(cells, labelled, KEYS), [*KEYS, "label"], "left").join(within, [*KEYS, "label"], "left").join(scale, "section_id")
    parts = keep(parts.select(*KEYS, "ord", "name", "label", *((F.coalesce(c, F.lit(0)) * pixel).alias(c) for c in ("granular", "molecular")), F.coalesce("length", F.lit(0.0)).alias("purkinje")))
    whole = segs.join(scale, "section_id").groupBy(*KEYS).agg(F.sum(size_of).alias("purkinje_len"))
    visited = clip.pixels_visited(clip.stretches(lines, KEYS), KEYS)
    pieces = good.select(*KEYS).distinct()
    totals = pieces.join(spans.layer_pixels(cells, KEYS), KEYS, "left").join(whole, KEYS, "left").join(visited, KEYS, "left").join(joined, KEYS, "left").join(scale, "section_id")
    area = lambda c: (F.coalesce(c, F.lit(0)) * pixel).alias("cerebellum" if c == "cb" else c)
    totals = keep(totals.select(*KEYS, *map(area, ("cb", "grey", "granular", "molecular")), "purkinje_len", (F.col("px") * pixel).alias("purkinje_area"), F.coalesce("joined", F.lit(False)).alias("joined"), area_unit(F.col("unit")).alias("area_unit"), length_unit(F.col("unit")).alias("length_unit")))
    notes = results.coverage(totals, parts, KEYS)
    return Analysis(problems, good, cells, cuts, labelled, totals, parts, clip.runs(marked, KEYS), notes)


def combine(analysis: Analysis) -> tuple[DataFrame, DataFrame]:
    """(totals, parts) for each section image, its pieces pooled."""
    return results.pool(analysis.totals, analysis.parts)
