"""Connected components and holes of regions given as spans, for many sections at once."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..plans.store import stored
from . import raster

#: Spans of an image up to which one worker labels it; larger ones go through joins (``connected``).
KERNEL_SPANS = 1 << 22


def by_size(rows: DataFrame, keys: list[str], most: int, small, large) -> DataFrame:
    """``small`` of the images with up to ``most`` rows, ``large`` of the others; one count decides whether there are any."""
    many = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > most).select(*keys)
    if many.isEmpty():
        return small(rows)
    many = stored(many)
    return small(rows.join(many, keys, "left_anti")).unionByName(large(rows.join(many, keys, "left_semi")))


def _schema(df: DataFrame, keys: list[str], rest: str) -> T.StructType:
    return T.StructType([df.schema[k] for k in keys] + T._parse_datatype_string(rest).fields)


def plain_keys(pdf: pd.DataFrame, keys: list[str]) -> pd.DataFrame:
    """Text keys as plain objects: Arrow-backed ones come in chunks, which the way back does not take."""
    return pdf.astype({k: object for k in keys if not pd.api.types.is_numeric_dtype(pdf[k])})


def label_spans(spans: DataFrame, keys: list[str], diagonal: bool = True, most_spans: int = KERNEL_SPANS) -> DataFrame:
    """keys, y, x0, x1, label: 8-connected components, numbered by first pixel, row by row.

    A group is one region of one image, so its size does not grow with the number of images; images of more than
    ``most_spans`` spans are labelled by ``connected.label_spans``.
    """
    from . import connected

    large = lambda rows: connected.label_spans(rows, keys, stored, diagonal)
    return by_size(spans.select(*keys, "y", "x0", "x1"), keys, most_spans, lambda rows: _label_spans(rows, keys, diagonal), large)


def _label_spans(spans: DataFrame, keys: list[str], diagonal: bool) -> DataFrame:

    def label(pdf: pd.DataFrame) -> pd.DataFrame:
        n = raster.label_runs(*(pdf[c].to_numpy() for c in ("y", "x0", "x1")), diagonal)
        return plain_keys(pdf.assign(label=n.astype(np.int32)), keys)

    schema = _schema(spans, keys, "y int, x0 int, x1 int, label int")
    return spans.select(*keys, "y", "x0", "x1").groupBy(*keys).applyInPandas(label, schema)


def component_table(labelled: DataFrame, keys: list[str]) -> DataFrame:
    """keys, label, size, cx, cy: pixels and centroid of each component."""
    n = (F.col("x1") - F.col("x0")).cast("long")
    sx = (F.col("x0") + F.col("x1") - 1).cast("long") * n / 2
    return labelled.groupBy(*keys, "label").agg(F.sum(n).alias("size"), (F.sum(sx) / F.sum(n)).alias("cx"), (F.sum(F.col("y") * n) / F.sum(n)).alias("cy"))


def interior_pixels(labelled: DataFrame, keys: list[str]) -> DataFrame:
    """keys, label, x, y: the pixel nearest the centroid, the first row by row of equals."""
    c = component_table(labelled, keys)
    near = F.least(F.greatest(F.round("cx").cast("int"), F.col("x0")), F.col("x1") - 1)
    both = F.array_distinct(F.array(near, F.greatest(near - 1, F.col("x0")), F.least(near + 1, F.col("x1") - 1)))
    p = labelled.join(c, [*keys, "label"]).select(*keys, "label", "y", "cx", "cy", F.explode(both).alias("x"))
    d = (F.col("x") - F.col("cx")) * (F.col("x") - F.col("cx")) + (F.col("y") - F.col("cy")) * (F.col("y") - F.col("cy"))
    return p.groupBy(*keys, "label").agg(F.min_by(F.struct("x", "y"), F.struct(d, F.col("y"), F.col("x"))).alias("p")).select(*keys, "label", "p.x", "p.y")


def holes(spans: DataFrame, keys: list[str], most_spans: int = KERNEL_SPANS) -> DataFrame:
    """keys, enclosed, ring: background pixels inside the region; over 32 of them make it a ring."""
    from . import connected

    return by_size(spans.select(*keys, "y", "x0", "x1"), keys, most_spans, lambda rows: _holes(rows, keys), lambda rows: connected.holes(rows, keys, stored))


def _holes(spans: DataFrame, keys: list[str]) -> DataFrame:

    def count(pdf: pd.DataFrame) -> pd.DataFrame:
        y, x0, x1 = (pdf[c].to_numpy() for c in ("y", "x0", "x1"))
        top, left = y.min(), x0.min()
        n = raster.enclosed(raster.mask_of(y - top, x0 - left, x1 - left, (int(y.max() - top) + 1, int(x1.max() - left))))
        return plain_keys(pdf.loc[:, keys].head(1).assign(enclosed=n, ring=n > raster.HOLE_PIXELS), keys)

    schema = _schema(spans, keys, "enclosed long, ring boolean")
    return spans.select(*keys, "y", "x0", "x1").groupBy(*keys).applyInPandas(count, schema)


def outlines(spans: DataFrame, keys: list[str], most_spans: int = KERNEL_SPANS) -> DataFrame:
    """keys, rings: clean outlines with exactly the region's pixels."""
    from . import connected

    return by_size(spans.select(*keys, "y", "x0", "x1"), keys, most_spans, lambda rows: _outlines(rows, keys), lambda rows: connected.outlines(rows, keys, stored))


def _outlines(spans: DataFrame, keys: list[str]) -> DataFrame:

    def trace(pdf: pd.DataFrame) -> pd.DataFrame:
        y, x0, x1 = (pdf[c].to_numpy() for c in ("y", "x0", "x1"))
        top, left = int(y.min()), int(x0.min())
        rings = raster.outline(raster.mask_of(y - top, x0 - left, x1 - left, (int(y.max()) - top + 1, int(x1.max()) - left)))
        value = [[{"x": float(a + left), "y": float(b + top)} for a, b in r] for r in rings]
        return plain_keys(pdf.loc[:, keys].head(1).assign(rings=[value]), keys)

    schema = _schema(spans, keys, "rings array<array<struct<x: double, y: double>>>")
    return spans.select(*keys, "y", "x0", "x1").groupBy(*keys).applyInPandas(trace, schema)


def outline_vertices(spans: DataFrame, keys: list[str], most_spans: int = KERNEL_SPANS) -> DataFrame:
    """keys, ring, idx, x, y: the rows of ``connected.outline_vertices``, which takes the images of more than ``most_spans`` spans."""
    from . import connected

    return by_size(spans.select(*keys, "y", "x0", "x1"), keys, most_spans, lambda rows: _outline_vertices(rows, keys), lambda rows: connected.outline_vertices(rows, keys, stored))


def _outline_vertices(spans: DataFrame, keys: list[str]) -> DataFrame:
    schema = _schema(spans, keys, "ring int, idx int").add("x", spans.schema["x0"].dataType).add("y", spans.schema["y"].dataType)
    arrow = to_arrow_schema(schema)

    def trace(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        found = raster.ring_corners(*(rows.column(c).to_numpy() for c in ("y", "x0", "x1")))
        columns = [pa.repeat(k, len(found[0])) for k in key] + [pa.array(c) for c in found]
        return pa.table([c.cast(f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

    return spans.groupBy(*keys).applyInArrow(trace, schema)
