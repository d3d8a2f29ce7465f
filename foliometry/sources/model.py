"""Schemas of traced images and scans of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SECTIONS = "section_id string, width int, height int, px_w double, px_h double, unit string, title string, file string"
ROIS = "section_id string, roi_idx int, name string, kind string, props map<string, string>, rings array<array<struct<x: double, y: double>>>"


def read_sections(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SECTIONS).parquet(path)


def read_rois(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(ROIS).parquet(path)


def sections_without_rois(sections: DataFrame, rois: DataFrame) -> DataFrame:
    """Images of which nothing is traced: they cannot be measured."""
    return sections.join(rois.select("section_id").distinct(), "section_id", "left_anti")


def line_vertices(rois: DataFrame, keys: list[str]) -> DataFrame:
    """keys, idx, x, y of lines; straight lines are lines of two vertices."""
    v = F.posexplode(F.get("rings", F.lit(0))).alias("idx", "v")
    return rois.select(*keys, v).select(*keys, "idx", "v.x", "v.y")
