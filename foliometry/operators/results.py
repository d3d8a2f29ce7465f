"""Measurements: totals, sections in order, labels, coverage, and pooling of pieces."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import STANDARD_LABELS, section_labels

#: Shares of grey matter and of the line below which sections do not cover them; degrees of a reversed line.
AREA_COVERAGE, LINE_COVERAGE, COUNTERCLOCKWISE = 0.99, 0.99, 90.0


def upper_median(values: Column) -> Column:
    """Of n sorted values the one at n div 2, counted from 0."""
    s = F.array_sort(F.collect_list(values))
    return F.get(s, F.floor(F.size(s) / 2).cast("int"))


def line_order(samples: DataFrame, keys: list[str]) -> DataFrame:
    """keys, label, order_arc from labelled samples (k, arc, label) of the reference line."""
    return samples.where(F.col("label").isNotNull()).groupBy(*keys, "label").agg(upper_median(F.col("arc")).alias("order_arc"))


def ends_joined(samples: DataFrame, keys: list[str]) -> DataFrame:
    """keys, n_labels, first_label, last_label, joined: whether the line starts and ends in one of several sections."""
    hit = samples.where(F.col("label").isNotNull())
    out = hit.groupBy(*keys).agg(F.countDistinct("label").alias("n_labels"), F.min_by("label", "k").alias("first_label"), F.max_by("label", "k").alias("last_label"))
    return out.withColumn("joined", (F.col("n_labels") > 1) & (F.col("first_label") == F.col("last_label")))


def labelled(ordered: DataFrame, keys: list[str], joined: Column) -> DataFrame:
    """Adds ord (from 1) and name to sections with order_arc and label."""
    count = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    number = F.row_number().over(Window.partitionBy(*keys).orderBy("order_arc", "label"))
    out = ordered.withColumn("ord", number).withColumn("n_sections", count)
    return out.withColumn("name", section_labels(F.col("n_sections"), F.col("ord"), joined)).drop("n_sections")


def coverage(totals: DataFrame, parts: DataFrame, keys: list[str]) -> DataFrame:
    """keys, level, code, percent: where sections cover less than nearly all of grey matter or line."""
    sums = parts.groupBy(*keys).agg(F.sum(F.col("granular") + F.col("molecular")).alias("area"), F.sum("purkinje").alias("line"))
    t = totals.join(sums, keys)
    low = (F.col("grey") > 0) & (F.col("area") < F.col("grey") * AREA_COVERAGE)
    off = (F.col("purkinje_len") > 0) & (F.col("line") < F.col("purkinje_len") * LINE_COVERAGE)
    area_note = F.when(low, F.struct(F.lit("WARNING").alias("level"), F.lit("SECTION_AREA").alias("code"), (F.col("area") * 100.0 / F.col("grey")).alias("percent")))
    line_note = F.when(off, F.struct(F.lit("NOTE").alias("level"), F.lit("LINE_OUTSIDE").alias("code"), ((F.col("purkinje_len") - F.col("line")) * 100.0 / F.col("purkinje_len")).alias("percent")))
    return t.select(*keys, F.explode(F.array_compact(F.array(area_note, line_note))).alias("n")).select(*keys, "n.level", "n.code", "n.percent")


def reversed_lines(sweeps: DataFrame, sections: DataFrame, keys: list[str]) -> DataFrame:
    """keys, degrees of lines traced against the clock, in pieces of several sections."""
    many = sections.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(*keys)
    return sweeps.join(many, keys).where(F.col("degrees") < -COUNTERCLOCKWISE)


TOTALS = ("cerebellum", "grey", "granular", "molecular", "purkinje_len", "purkinje_area")


def pool(totals: DataFrame, parts: DataFrame, section: str = "section_id") -> tuple[DataFrame, DataFrame]:
    """(totals, parts) of each section image over all its pieces.

    ``totals`` has instance, the six measures, units and joined; ``parts`` instance, ord, name,
    granular, molecular, purkinje. One piece alone is unchanged. Of several, an unsplit
    piece counts as one section, all are numbered through, and standard names are withheld if the
    ends of any piece are joined.
    """
    first = F.min_by(F.struct("area_unit", "length_unit"), "instance").alias("u")
    pooled = totals.groupBy(section).agg(*(F.sum(c).alias(c) for c in TOTALS), F.count(F.lit(1)).alias("pieces"), F.bool_or("joined").alias("joined"), first)
    pooled = pooled.select(section, *TOTALS, "pieces", "joined", "u.area_unit", "u.length_unit")
    split = parts.select(section, "instance").distinct()
    many = pooled.where("pieces > 1").select(section)
    alone = totals.join(split, [section, "instance"], "left_anti").join(many, section, "left_semi")
    whole = alone.select(section, "instance", F.lit(1).alias("ord"), F.lit("").alias("name"), "granular", "molecular", F.col("purkinje_len").alias("purkinje"))
    every = parts.select(section, "instance", "ord", "name", "granular", "molecular", "purkinje").unionByName(whole)
    every = every.join(pooled.select(section, "pieces", "joined"), section)
    number = F.row_number().over(Window.partitionBy(section).orderBy("instance", "ord"))
    count = F.count(F.lit(1)).over(Window.partitionBy(section))
    out = every.withColumn("number", number).withColumn("n", count)
    name = F.when(F.col("pieces") == 1, F.col("name")).otherwise(section_labels(F.col("n"), F.col("number"), F.col("joined")))
    withheld = (F.col("pieces") > 1) & F.col("joined") & (F.col("n") == len(STANDARD_LABELS))
    return pooled, out.select(section, "instance", F.col("number").alias("ord"), name.alias("name"), "granular", "molecular", "purkinje", withheld.alias("withheld"))
