"""Synthetic traced images of concentric circles, as many as wanted, built on the executors."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.geometry import single

WIDTH, HEIGHT, CX, CY = 1200, 1000, 600.0, 500.0
#: Radii of outline, granular and white matter, white matter, line; vertices of a circle.
RADII, VERTICES = {"CB": 380.0, "GL+WM": 270.0, "WM": 170.0, "PL": 280.0}, 720
START, TURN, STALK = 120.0, 300.0, (540.0, 660.0, 920.0)


@dataclass(frozen=True)
class Phantom:
    """What is traced: a ring, or a ribbon pinched open by a stalk of white matter."""

    pinched: bool = True
    fissures: int = 7
    line_step: float = 1.0
    radii: tuple[float, float] = (386.0, 164.0)
    base_fissure: bool = False
    counterclockwise: bool = False
    pixel: float = 1.0
    unit: str = "pixel"


def _at(radius: float, degrees: Column) -> Column:
    a = F.radians(degrees)
    return F.struct(single(F.lit(CX) + F.lit(radius) * F.cos(a)).alias("x"), single(F.lit(CY) + F.lit(radius) * F.sin(a)).alias("y"))


def _point(x: float, y: float) -> Column:
    return F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y"))


def _arc(radius: float, first: float, last: float, step: float) -> Column:
    n = max(1, math.ceil((last - first) / step - 1e-9))
    return F.transform(F.sequence(F.lit(0), F.lit(n)), lambda i: _at(radius, F.least(F.lit(first) + i * F.lit(step), F.lit(last))))


def _on_ray(angle: Column):
    dx, dy = F.cos(F.radians(angle)), F.sin(F.radians(angle))
    return lambda r: F.struct(single(F.lit(CX) + r * dx).alias("x"), single(F.lit(CY) + r * dy).alias("y"))


def _region(name: str, pinched: bool) -> Column:
    r = RADII[name]
    if not pinched or name == "CB":
        return F.transform(F.sequence(F.lit(0), F.lit(VERTICES - 1)), lambda i: _at(r, i * F.lit(360.0 / VERTICES)))
    half, (left, right, bottom) = STALK[1] - CX, STALK
    open_ = math.degrees(math.acos(half / r))
    return F.concat(_arc(r, 180 - open_, 360 + open_, 360.0 / VERTICES), F.array(_point(right, bottom), _point(left, bottom)))


def phantoms(spark: SparkSession, n: int, what: Phantom = Phantom(), prefix: str = "p") -> tuple[DataFrame, DataFrame]:
    """(sections, rois) of ``n`` equal images."""
    ids = spark.range(n).select(F.concat(F.lit(prefix), F.col("id").cast("string")).alias("section_id"))
    sections = ids.select("section_id", F.lit(WIDTH).alias("width"), F.lit(HEIGHT).alias("height"), F.lit(what.pixel).alias("px_w"), F.lit(what.pixel).alias("px_h"), F.lit(what.unit).alias("unit"), F.concat("section_id", F.lit(".tif")).alias("title"), F.lit(None).cast("string").alias("file"))
    rows = [(name, "POLYGON", _region(name, what.pinched)) for name in ("CB", "GL+WM", "WM")]
    line = _arc(RADII["PL"], START, START + TURN, what.line_step)
    rows.append(("PL", "POLYLINE", F.reverse(line) if what.counterclockwise else line))
    outer, inner = what.radii
    for k in range(1, what.fissures + 1):
        angle = F.lit(START + TURN * k / (what.fissures + 1))
        steps = F.transform(F.sequence(F.lit(0), F.lit(8)), lambda i: F.lit(outer) + (F.lit(inner) - F.lit(outer)) * i / 8)
        cut = F.transform(steps, _on_ray(angle))
        rows.append((f"FL{k}", "POLYLINE", cut))
    if what.base_fissure:
        rows.append((f"FL{what.fissures + 1}", "POLYLINE", F.array(_at(outer, F.lit(90.0)), _at(inner, F.lit(90.0)))))
    each = F.array(*(F.struct(F.lit(i).alias("roi_idx"), F.lit(name).alias("name"), F.lit(kind).alias("kind"), F.array(ring).alias("rings")) for i, (name, kind, ring) in enumerate(rows)))
    drawn = F.broadcast(spark.range(1).select(each.alias("each")))  # once, as all images are equal
    rois = ids.crossJoin(drawn).select("section_id", F.explode("each").alias("r")).select("section_id", "r.roi_idx", "r.name", "r.kind", F.lit(None).cast("map<string,string>").alias("props"), "r.rings")
    return sections, rois
