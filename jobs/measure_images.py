"""Measures all traced images of a table and writes their results, parted by where the images come from.

The given tables carry no outlines: an image's regions, lines and cuts are derived from its supplier's key, and
the supplier's nation stands for the lab. Images with problems are in the result with the problems' codes
and without numbers. A run replaces the partitions it writes, so running it again gives the same.

    python -m jobs.measure_images --suppliers supplier.parquet --nations nation.parquet --out measured
"""

from __future__ import annotations

import logging
from typing import Any

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from foliometry.plans.analyze import analyze, combine
from foliometry.plans.store import Scratch
from foliometry.sources.tables import traced_images

from .settings import arguments, read_text, settings

log = logging.getLogger(__name__)
MEASURES = ("cerebellum", "grey", "granular", "molecular", "purkinje_len", "purkinje_area")


def images_of(suppliers: DataFrame, config: dict[str, Any]) -> DataFrame:
    """The images in the form of ``model.SECTIONS``; all have the size and pixels of the settings."""
    key = F.col("s_suppkey").cast("long").cast("string")
    size = (F.lit(config["width"]).alias("width"), F.lit(config["height"]).alias("height"), F.lit(float(config["pixel_width"])).alias("px_w"), F.lit(float(config["pixel_height"])).alias("px_h"))
    return suppliers.select(key.alias("section_id"), *size, F.lit(config["unit"]).alias("unit"), F.col("s_name").alias("title"), F.lit(None).cast("string").alias("file"))


def run(spark: SparkSession, suppliers: str, nations: str, out: str, config: dict[str, Any] | None = None) -> int:
    """Writes ``<out>/images`` (one row an image) and ``<out>/sections`` (one row a section of grey matter); the number of images."""
    config = settings("measure_images") | (config or {})
    part = config["partition_by"]
    made = spark.read.parquet(suppliers)
    nation = spark.read.parquet(nations).select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_name").alias(part))
    lab = made.join(nation, "s_nationkey", "left").select(F.col("s_suppkey").cast("long").cast("string").alias("section_id"), part)
    with Scratch(spark) as keep:
        analysis = analyze(keep(traced_images(made)), images_of(made, config), keep)
        totals, parts = combine(analysis)
        found = analysis.problems.groupBy("section_id").agg(F.array_join(F.sort_array(F.collect_set("code")), ",").alias("problems"))
        n = parts.groupBy("section_id").agg(F.count(F.lit(1)).alias("n_sections"))
        images = lab.join(found, "section_id", "left").join(totals.select("section_id", *MEASURES, "area_unit", "length_unit"), "section_id", "left").join(n, "section_id", "left")
        images = images.withColumn("problems", F.coalesce("problems", F.lit(""))).withColumn("n_sections", F.coalesce("n_sections", F.lit(0).cast("long")))
        seen = Observation("images")
        images = images.observe(seen, F.count(F.lit(1)).alias("rows"), F.count_if(F.col("problems") != "").alias("bad"))
        replace(images, part, f"{out}/images")
        replace(parts.drop("withheld").join(lab, "section_id"), part, f"{out}/sections")
    got = seen.get
    log.info("read %d images from %s, %d with problems; wrote %s/images and %s/sections", got["rows"], suppliers, got["bad"], out, out)
    return got["rows"]


def replace(rows: DataFrame, part: str, path: str) -> None:
    """Writes the partitions that ``rows`` has; others stay."""
    rows.repartition(part).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(part).parquet(path)


def result(spark: SparkSession, out: str) -> DataFrame:
    return spark.read.parquet(f"{out}/images")


def main() -> None:
    given = arguments(__doc__, ("suppliers", "Parquet table of images' keys"), ("nations", "Parquet table of labs"), ("out", "folder for results"))
    spark = SparkSession.builder.appName("measure_images").getOrCreate()
    try:
        run(spark, given.suppliers, given.nations, given.out, settings("measure_images", given.config and read_text(spark, given.config)))
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
