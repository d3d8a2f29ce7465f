"""What a run has to say about each section image: notes and warnings, as rows with texts.

Rows have section_id, instance (null for the image as a whole), stage, level, code, message. Messages about
one of several pieces begin with its number.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import classify, results, spans
from .classify import prefix

#: Share of grey matter that may stay without a section.
ASSIGNED = 0.995
KEYS = ["section_id", "instance"]
NAMES = {"cb": "Cerebellum", "gl": "Granular+WM", "wm": "White Matter"}
COLUMNS = ("section_id", "instance", "stage", "level", "code", "message")


def percent(share: Column) -> Column:
    return F.format_string("%.1f%%", share.cast("double"))


def _row(df: DataFrame, stage: int, level: str, code: Column | str, message: Column, instance: Column | None = None) -> DataFrame:
    code = F.lit(code) if isinstance(code, str) else code
    none = F.lit(None).cast("int")
    return df.select("section_id", (none if instance is None else instance).alias("instance"), F.lit(stage).alias("stage"), F.lit(level).alias("level"), code.alias("code"), message.alias("message"))


def _text(*parts: Column | str) -> Column:
    return F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))


def of_names(rois: DataFrame, marker: str) -> DataFrame:
    """Regions of earlier runs, names without a role, and what becomes of fissures."""
    n = F.col("n").cast("string")
    skipped = _row(classify.skipped_outputs(rois, marker), 0, "NOTE", "SKIPPED", _text("Left out ", n, " region(s) or line(s) that an earlier run has added."))
    ignored = _row(classify.ignored_names(rois, marker), 1, "NOTE", "IGNORED", _text("The names of ", n, " region(s) or line(s) fit no layer: ", F.col("shown"), "."))
    said = classify.fissure_requirement(rois, marker).where(F.col("note").isNotNull())
    code = F.when(F.col("note").startswith("fissures ignored"), "FISSURES_IGNORED").when(F.col("note").endswith("no White Matter"), "NO_WHITE_MATTER").otherwise("NO_FISSURES_TRACED")
    text = F.concat(F.when(F.col("fissures") > 0, F.concat(F.col("fissures").cast("string"), F.lit(" line(s): "))).otherwise(F.lit("")), F.col("note"), F.lit("."))
    return skipped.unionByName(ignored).unionByName(_row(said, 2, "NOTE", code, text, F.col("instance")))


def of_containment(cells: DataFrame) -> DataFrame:
    """Regions that reach notably beyond the one around them."""
    out = None
    for inner, outer in (("gl", "cb"), ("wm", "gl")):
        found = spans.outside(cells, KEYS, inner, outer, classify.TOLERATED_OUTSIDE)
        text = _text(percent(F.col("percent")), f" of {NAMES[inner]} is outside {NAMES[outer]}. That is right where white matter leaves the section; otherwise check both outlines.")
        rows = _row(found, 3, "NOTE", f"OUTSIDE_{outer.upper()}", text, F.col("instance"))
        out = rows if out is None else out.unionByName(rows)
    return out


def of_cutting(labelled: DataFrame) -> DataFrame:
    """Cuts that did not give the number of sections expected, and grey matter that no section got."""
    how = labelled.groupBy(*KEYS).agg(*(F.first(c).alias(c) for c in ("expected", "kept", "clean", "area", "assigned")))
    odd = _row(how.where(~F.col("clean")), 4, "WARNING", "SECTION_COUNT", _text("The cuts give ", F.col("kept").cast("string"), " section(s) where ", F.col("expected").cast("string"), " are expected; check that each cut crosses the grey matter."), F.col("instance"))
    left = how.where(F.col("assigned") < F.col("area") * ASSIGNED)
    share = (F.col("area") - F.col("assigned")) * 100.0 / F.col("area")
    return odd.unionByName(_row(left, 5, "NOTE", "UNASSIGNED", _text(percent(share), " of the grey matter cannot be reached from any section and is in none."), F.col("instance")))


def of_direction(sweeps: DataFrame, parts: DataFrame) -> DataFrame:
    """Lines traced against the clock: sections are numbered along the line."""
    found = results.reversed_lines(sweeps, parts, KEYS)
    return _row(found, 6, "WARNING", "DIRECTION", F.lit("The Purkinje line runs against the clock, so the sections are numbered from its other end; reverse it if it should not."), F.col("instance"))


def of_ends(totals: DataFrame) -> DataFrame:
    """Pieces whose first and last section are one."""
    return _row(totals.where("joined"), 6, "WARNING", "JOINED", F.lit("The first and last sections are one, connected around the base: a cut across the base, or white matter that reaches the outline there, would part them."), F.col("instance"))


def of_coverage(notes: DataFrame) -> DataFrame:
    """The checks of ``results.coverage`` as texts."""
    area = _text("The sections hold ", percent(F.col("percent")), " of the grey matter, so their areas do not add up to the totals.")
    line = _text(percent(F.col("percent")), " of the Purkinje line is in no section; it counts in the total length only.")
    text = F.when(F.col("code") == "SECTION_AREA", area).otherwise(line)
    return notes.select("section_id", "instance", F.lit(7).alias("stage"), "level", "code", text.alias("message"))


def of_pooling(totals: DataFrame, parts: DataFrame) -> DataFrame:
    """Images of several pieces, and standard names that were withheld. ``totals`` and ``parts`` are pooled ones."""
    many = totals.where(F.col("pieces") > 1)
    found = _row(many, 8, "NOTE", "POOLED", _text(F.col("pieces").cast("string"), " pieces were measured apart and pooled as parts of one section image."))
    held = parts.where("withheld").select("section_id").distinct()
    return found.unionByName(_row(held, 9, "WARNING", "NAMES_WITHHELD", F.lit("The pieces make eight sections, but the first and last of some piece are joined, so the sections are numbered and not named.")))


def collected(parts: list[DataFrame], pieces: DataFrame) -> DataFrame:
    """section_id, seq, instance, level, code, message of all rows in order; ``pieces`` has a row for each piece."""
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    n = pieces.select(*KEYS).distinct().groupBy("section_id").agg(F.count(F.lit(1)).alias("n_inst"))
    every = every.join(n, "section_id", "left")
    lead = F.when(F.col("instance").isNotNull(), prefix(F.col("instance"), F.coalesce("n_inst", F.lit(1)))).otherwise(F.lit(""))
    seq = F.row_number().over(Window.partitionBy("section_id").orderBy("stage", "instance", "code", "message")) - 1
    return every.select("section_id", seq.alias("seq"), "instance", "level", "code", F.concat(lead, "message").alias("message"))
