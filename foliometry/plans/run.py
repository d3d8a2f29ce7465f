"""A whole run over many section images: problems, measurements, messages, regions, draw items, files."""

from __future__ import annotations

import os
import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

from ..functions.text import file_base
from ..operators import classify, components, fissure, messages, polyline, report, spans
from ..sources import sinks
from ..sources.model import line_vertices
from .analyze import KEYS, Analysis, analyze, combine
from .store import stored


@dataclass(frozen=True)
class Options:
    """What a run makes. ``marker`` is the property that marks what a run adds; another program's may be given."""

    overlay: bool = True
    section_fills: bool = True
    add_regions: bool = True
    results_table: bool = True
    save_csv: bool = False
    save_workbook: bool = False
    file_name: str | None = None
    folder: str = ""
    marker: str = classify.OUTPUT_PROPERTY


@dataclass
class Run:
    analysis: Analysis
    problems: DataFrame  # section_id, instance, code, n, message: why an image was not measured
    totals: DataFrame  # pooled over the pieces of an image
    parts: DataFrame
    messages: DataFrame  # section_id, seq, instance, level, code, message
    info: DataFrame  # section_id, seq, field, value
    seen: dict[str, Observation]  # what was counted while tables were written
    grid: DataFrame | None = None  # the results as text cells
    table: DataFrame | None = None  # the results as numbers
    regions: DataFrame | None = None  # in the form of the input, marked, so another run skips them
    overlay: DataFrame | None = None
    files: list[DataFrame] = field(default_factory=list)  # section_id, path

    def counts(self) -> dict[str, int]:
        """measured, pooled and set_aside images, problems, notes, warnings: counted as the run's tables were written, by no job of their own.

        Waits for the first write of those tables if ``run`` was given a ``keep`` that does not write.
        """
        return {k: v for o in self.seen.values() for k, v in o.get.items()}


def run(rois: DataFrame, sections: DataFrame, options: Options = Options(), keep=stored, drawn: DataFrame | None = None) -> Run:
    """Measures all images that have no problems, and makes what ``options`` ask for.

    ``drawn`` has the items that are drawn on images already (section_id, z, name, marked, ...): the overlay
    takes the place of those of earlier runs and keeps all others.
    """
    a = analyze(rois, sections, keep, options.marker)
    seen = {name: Observation(f"{name}-{uuid.uuid4().hex}") for name in ("totals", "problems", "messages")}
    one = lambda c: F.count(F.when(c, 1))
    pooled, parts = combine(a)
    totals, parts = keep(pooled.observe(seen["totals"], F.count(F.lit(1)).alias("measured"), one(F.col("pieces") > 1).alias("pooled"))), keep(parts)
    first = F.row_number().over(Window.partitionBy("section_id").orderBy("code", "message")) == 1
    problems = a.problems.withColumn("first", first).observe(seen["problems"], F.count(F.lit(1)).alias("problems"), one(F.col("first")).alias("set_aside"))
    problems = keep(problems).drop("first")
    good = a.good
    n_sections = a.parts.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("n"))
    said = [
        messages.of_names(rois, options.marker),
        messages.of_containment(a.cells),
        messages.of_cutting(a.labelled),
        messages.of_direction(_sweeps(good, a.cells), a.parts),
        messages.of_ends(a.totals),
        messages.of_coverage(a.notes),
        messages.of_pooling(totals, parts),
    ]
    told = messages.collected(said, classify.pieces(rois, options.marker))
    told = keep(told.observe(seen["messages"], one(F.col("level") == "NOTE").alias("notes"), one(F.col("level") == "WARNING").alias("warnings")))
    images = sections.join(totals.select("section_id"), "section_id", "left_semi")
    out = Run(a, problems, totals, parts, told, _info(images, a, n_sections, told), seen)
    if options.results_table:
        out.grid, out.table = report.results_grid(totals, parts), report.results_table(totals, parts)
    if options.add_regions:
        out.regions = measured_regions(a, options.marker)
    if options.overlay:
        arcs = keep(_cut_arcs(a, good))
        out.overlay = report.overlay_items(a.totals, arcs, a.parts, options.section_fills, keep(_drawn_shapes(images, a, good, arcs)))
        if drawn is not None:
            out.overlay = report.merged_overlay(drawn, out.overlay)
    if options.save_csv or options.save_workbook:
        if not options.folder:
            raise ValueError("files are wanted but no folder is named")
        base = images.sparkSession.range(1).select(file_base(F.lit(options.file_name).cast("string"))).first()[0]
        if options.save_csv:
            path = os.path.join(options.folder, f"{base}.csv")
            sinks.write_csv(report.results_grid(totals, parts), path)
            out.files.append(totals.select("section_id", F.lit(path).alias("path")))
        if options.save_workbook:
            sinks.write_workbooks(sinks.workbooks(totals, parts, out.info, told), options.folder, base)
            out.files.append(sinks.workbook_paths(totals, options.folder, base))
    return out


def _sweeps(good: DataFrame, cells: DataFrame) -> DataFrame:
    """keys, degrees: how far each line turns about the middle of the white matter's pixels."""
    n = F.col("x1") - F.col("x0")
    middle = cells.where("wm").groupBy(*KEYS).agg((F.sum(n * (F.col("x0") + F.col("x1")) / 2) / F.sum(n)).alias("cx"), (F.sum(n * (F.col("y") + 0.5)) / F.sum(n)).alias("cy"))
    lines = line_vertices(good.where(F.col("category") == "PURKINJE"), KEYS).join(middle, KEYS)
    return polyline.sweep_degrees(lines, KEYS, F.col("cx"), F.col("cy"))


def _cut_arcs(a: Analysis, good: DataFrame) -> DataFrame:
    line = line_vertices(good.where(F.col("category") == "PURKINJE"), KEYS)
    return fissure.crossing_arcs(a.cuts, line, KEYS, "cut_id")


def _drawn_shapes(images: DataFrame, a: Analysis, good: DataFrame, arcs: DataFrame) -> DataFrame:
    """Outlines, lines and labels' places of all that was measured."""
    on = F.array(*(F.struct(F.lit(i).alias("k"), F.col(c).alias("on")) for i, c in enumerate(("grey", "granular", "molecular"))))
    whole = a.cells.select(*KEYS, "y", "x0", "x1", F.explode(on).alias("l")).where("l.on").select(*KEYS, "l.k", "y", "x0", "x1")
    own = a.labelled.join(a.parts.select(*KEYS, "label", "ord"), [*KEYS, "label"]).select(*KEYS, F.col("ord").alias("label"), "y", "x0", "x1")
    sections = components.outlines(own, [*KEYS, "label"]).withColumnRenamed("label", "ord")
    anchors = components.interior_pixels(own, KEYS).withColumnRenamed("label", "ord")
    ring = F.array(F.transform(F.sort_array(F.collect_list(F.struct("idx", "x", "y"))), lambda v: F.struct(v["x"].alias("x"), v["y"].alias("y"))))
    cuts = a.cuts.groupBy(*KEYS, "cut_id").agg(ring.alias("rings")).join(arcs.select(*KEYS, "cut_id", "arc"), [*KEYS, "cut_id"])
    line = good.where(F.col("category") == "PURKINJE").select(*KEYS, "rings")
    return report.drawn_shapes(images, components.outlines(whole, [*KEYS, "k"]), line, cuts, sections, anchors)


def _info(images: DataFrame, a: Analysis, n_sections: DataFrame, told: DataFrame) -> DataFrame:
    cuts = a.cuts.groupBy(*KEYS).agg(F.countDistinct("cut_id").alias("fissures"))
    ring = a.labelled.groupBy(*KEYS).agg(F.first("ring").alias("ring"))
    wm = a.cells.groupBy(*KEYS).agg(F.bool_or("wm").alias("has_wm"))
    pieces = a.totals.select(*KEYS, "joined").join(n_sections, KEYS, "left").join(cuts, KEYS, "left").join(ring, KEYS, "left").join(wm, KEYS, "left")
    zero, no = F.lit(0).cast("long"), F.lit(False)
    pieces = pieces.select(*KEYS, F.coalesce("n", zero).alias("sections"), F.coalesce("has_wm", no).alias("has_wm"), F.coalesce("fissures", zero).alias("fissures"), F.coalesce("ring", no).alias("ring"), "joined")
    warnings = told.where(F.col("level") == "WARNING").groupBy("section_id").agg(F.count(F.lit(1)).alias("n"))
    return report.run_info(images, pieces, warnings)


def measured_regions(a: Analysis, marker: str = classify.OUTPUT_PROPERTY) -> DataFrame:
    """All regions and line stretches that were measured, in the form of the input and marked.

    Outlines have exactly the pixels that were counted, so they measure the same again.
    """
    item = [*KEYS, "ord", "k"]
    layers = F.array(*(F.struct(F.lit(i).alias("k"), F.col(c).alias("on")) for i, c in enumerate(("grey", "granular", "molecular"))))
    whole = a.cells.select(*KEYS, "y", "x0", "x1", F.explode(layers).alias("l")).where("l.on").select(*KEYS, F.lit(0).alias("ord"), "l.k", "y", "x0", "x1")
    both = F.array(*(F.struct(F.lit(i).alias("k"), F.col(c).alias("on")) for i, c in enumerate(("granular", "molecular"))))
    own = a.cells.where("granular OR molecular").select(*KEYS, "y", F.col("x0").alias("a0"), F.col("x1").alias("a1"), both.alias("both"))
    cut = a.labelled.join(a.parts.select(*KEYS, "label", "ord"), [*KEYS, "label"]).select(*KEYS, "ord", "y", "x0", "x1")
    met = own.join(cut, [*KEYS, "y"]).where((F.col("a0") < F.col("x1")) & (F.col("x0") < F.col("a1")))
    met = met.select(*KEYS, "ord", "y", F.greatest("a0", "x0").alias("x0"), F.least("a1", "x1").alias("x1"), F.explode("both").alias("l")).where("l.on").select(*KEYS, "ord", "l.k", "y", "x0", "x1")
    areas = components.outlines(whole.unionByName(met), item).withColumn("kind", F.lit("COMPOSITE"))
    runs = a.runs.join(a.parts.select(*KEYS, "label", "ord"), [*KEYS, "label"])
    ring = F.array(F.transform(F.sort_array(F.collect_list(F.struct("idx", "x", "y"))), lambda v: F.struct(v["x"].alias("x"), v["y"].alias("y"))))
    lines = runs.groupBy(*KEYS, "ord", (F.col("run") + 1).alias("k")).agg(ring.alias("rings")).withColumn("kind", F.lit("POLYLINE"))
    shapes = areas.unionByName(lines)
    names = report.named_regions(a.totals.select(*KEYS), a.parts, a.runs.select(*KEYS, "label", "run").distinct().join(a.parts.select(*KEYS, "label", "ord"), [*KEYS, "label"]))
    marked = F.create_map(F.lit(marker), F.lit("true")).alias("props")
    return names.join(shapes, item).select("section_id", F.col("seq").cast("int").alias("roi_idx"), "name", "kind", marked, "rings")


def pixels_of(regions: DataFrame) -> DataFrame:
    """section_id, name, px of areas in ``regions``, counted anew."""
    areas = regions.where(F.col("kind").isin(*classify.AREAS))
    filled = spans.rasterize(areas.select("section_id", "name", "rings"), ["section_id", "name"])
    return filled.groupBy("section_id", "name").agg(F.sum(F.col("x1") - F.col("x0")).alias("px"))
