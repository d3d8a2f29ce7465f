"""Sections of grey matter: cuts of the region, completed so that every pixel has a section."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from ..plans.store import stored
from . import connected, raster
from .components import _schema

HOW = "ring boolean, expected int, kept int, clean boolean, half_width double, area long, assigned long"


#: Pixels of a region's bounds up to which one worker cuts it, at some ten bytes each; larger ones go through joins.
KERNEL_PIXELS = 1 << 27


def partition(grey: DataFrame, cuts: DataFrame, keys: list[str], most_pixels: int = KERNEL_PIXELS) -> DataFrame:
    """keys, y, x0, x1, label and how it went, repeated: the labelled spans of each region with cuts.

    ``grey`` has spans, ``cuts`` has cut_id, idx, x, y. One group is one traced piece; pieces
    are independent of each other and run in parallel. Regions without cuts are left out. Regions whose
    bounds hold more than ``most_pixels`` go through ``connected.partition``.
    """
    box = (F.max("x1") - F.min("x0")).cast("long") * (F.max("y") - F.min("y") + 1)
    many = grey.groupBy(*keys).agg(box.alias("_n")).where(F.col("_n") > most_pixels).select(*keys)
    if many.isEmpty():
        return _partition(grey, cuts, keys)
    many = stored(many)
    large = connected.partition(grey.join(many, keys, "left_semi"), cuts, keys, stored)
    return _partition(grey.join(many, keys, "left_anti"), cuts, keys).unionByName(large)


def _partition(grey: DataFrame, cuts: DataFrame, keys: list[str]) -> DataFrame:
    schema = _schema(grey, keys, f"y int, x0 int, x1 int, label int, {HOW}")
    arrow = to_arrow_schema(schema)

    def solve(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return arrow.empty_table()
        y, x0, x1 = (left.column(c).to_numpy() for c in ("y", "x0", "x1"))
        w, h = int(x1.max() - x0.min()), int(y.max() - y.min() + 1)
        margin = int(max(50, 0.08 * max(w, h)))
        ox, oy = int(x0.min()) - margin, int(y.min()) - margin
        mask = raster.mask_of(y - oy, x0 - ox, x1 - ox, (h + 2 * margin, w + 2 * margin))
        cut, idx, cx, cy = (right.column(c).to_numpy() for c in ("cut_id", "idx", "x", "y"))
        order = np.lexsort((idx, cut))
        points, cut = np.stack([cx, cy], 1)[order] - (ox, oy), cut[order]
        labels, how = raster.split(mask, np.split(points, np.flatnonzero(np.diff(cut)) + 1))
        sy, sx0, sx1, label = raster.spans_of(labels.astype(np.int32))
        n = len(sy)
        columns = [[k.as_py()] * n for k in key] + [sy + oy, sx0 + ox, sx1 + ox, label] + [[how[x.split()[0]]] * n for x in HOW.split(", ")]
        return pa.table([pa.array(c, f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

    other = [f"{k}_of_cut" for k in keys]  # both sides may come from one table
    lines = cuts.select(*(F.col(k).alias(o) for k, o in zip(keys, other, strict=True)), "cut_id", "idx", "x", "y")
    return grey.select(*keys, "y", "x0", "x1").groupBy(*keys).cogroup(lines.groupBy(*other)).applyInArrow(solve, schema)


def section_areas(cut: DataFrame, labelled: DataFrame, keys: list[str]) -> DataFrame:
    """keys, label, granular, molecular: pixels of both layers in each section, joined by scanline."""
    a = cut.select(*keys, "y", F.col("x0").alias("a0"), F.col("x1").alias("a1"), "granular", "molecular")
    b = labelled.select(*keys, "y", "x0", "x1", "label")
    n = (F.least("a1", "x1") - F.greatest("a0", "x0")).cast("long")
    both = a.join(b, [*keys, "y"]).where((F.col("a0") < F.col("x1")) & (F.col("x0") < F.col("a1")))
    return both.groupBy(*keys, "label").agg(*(F.coalesce(F.sum(F.when(F.col(c), n)), F.lit(0)).alias(c) for c in ("granular", "molecular")))
