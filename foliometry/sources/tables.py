"""Regions and lines derived from the benchmark tables, in Spark and as SQL of the same meaning.

The tables carry no outlines. Names come from ``customer`` keys, nested octagons with a line and
cuts from ``supplier`` keys, and polylines from ``events`` (a user's events in order of time).
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..plans.store import unsized

#: Names by position in the section, five variants each, and what may stand around them.
NAMES = (
    "CB", "Cerebellum", "cb left", "CBx", "cerebellum_1",
    "GL+WM", "GLWM", "gl-wm 2", "Granular layer", "wm with gl",
    "WM", "white matter", "WM_a", "flow field", "wmx",
    "PL", "Purkinje", "pl-1", "PLs", "purkinje line",
    "FL1", "fissure 1", "FL_2", "fl", "Fissure",
    "notes", "2Cb_Granular", "Section 3_Purkinje", "[2] Grey Matter", "CB wm",
)
PREFIXES = ("", "", "2", "0", "12345", "3", "199901_", "10", "2")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def named_rois(spark: SparkSession, sf_dir: str) -> DataFrame:
    """section_id, roi_idx, name, kind: six to a section."""
    k = F.col("c_custkey").cast("long")
    place, group = k % 6, F.floor(k / 6).cast("long")
    pick = lambda values, i: F.get(F.array(*map(F.lit, values)), i.cast("int"))
    before = F.when(k % 4 == 0, pick(PREFIXES, group % len(PREFIXES))).otherwise(F.lit(""))
    line = place.isin(3, 4) != (k % 11 == 0)
    kind = F.when(line, F.when(k % 2 == 0, "POLYLINE").otherwise("LINE")).otherwise(F.when(k % 2 == 0, "POLYGON").otherwise("COMPOSITE"))
    return table(spark, sf_dir, "customer").select(group.alias("section_id"), place.cast("int").alias("roi_idx"), F.concat(before, pick(NAMES, place * 5 + group % 5)).alias("name"), kind.alias("kind"))


def _list(values: tuple[str, ...]) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


NAMED_SQL = f"""
named AS (
  SELECT k // 6 AS section_id, CAST(k % 6 AS INTEGER) AS roi_idx,
         CASE WHEN k % 4 = 0 THEN ({_list(PREFIXES)})[CAST((k // 6) % {len(PREFIXES)} + 1 AS INTEGER)] ELSE '' END
           || ({_list(NAMES)})[CAST((k % 6) * 5 + (k // 6) % 5 + 1 AS INTEGER)] AS name,
         CASE WHEN ((k % 6) IN (3, 4)) <> (k % 11 = 0) THEN CASE WHEN k % 2 = 0 THEN 'POLYLINE' ELSE 'LINE' END
              ELSE CASE WHEN k % 2 = 0 THEN 'POLYGON' ELSE 'COMPOSITE' END END AS kind
  FROM (SELECT CAST(c_custkey AS BIGINT) AS k FROM customer))"""


def event_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """line_id, idx, x (hours since 2024-01-01), y (value): one line for each user."""
    micros = F.timestamp_diff("MICROSECOND", F.lit("2024-01-01").cast("timestamp_ntz"), F.col("ts").cast("timestamp_ntz"))
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    idx = (F.row_number().over(order) - 1).cast("int")
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("line_id"), idx.alias("idx"), (micros / F.lit(3.6e9)).alias("x"), F.col("value").alias("y"))


EVENTS_SQL = """
v AS (
  SELECT user_id AS line_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS INTEGER) AS idx,
         (epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) / 3.6e9 AS x, value AS y
  FROM events),
seg AS (
  SELECT *, sum(len) OVER (PARTITION BY line_id ORDER BY idx) AS cum1,
         coalesce(sum(len) OVER (PARTITION BY line_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS cum0
  FROM (SELECT line_id, idx, x, y, x2, y2, sqrt((x2 - x) * (x2 - x) + (y2 - y) * (y2 - y)) AS len
        FROM (SELECT *, lead(x) OVER w AS x2, lead(y) OVER w AS y2 FROM v WINDOW w AS (PARTITION BY line_id ORDER BY idx))
        WHERE x2 IS NOT NULL))"""

#: Half sizes of the nested octagons and the centre, as SQL that both engines read.
SIZES = {"cb": "(200 + s_suppkey * 37 % 150)", "gl": "(140 + s_suppkey * 37 % 150 - s_suppkey * 13 % 30)", "wm": "(80 + s_suppkey * 37 % 150 - s_suppkey * 13 % 30 - s_suppkey * 7 % 25)"}
CX, CY = 600.25, 500.375
_OCTAGON = ((-0.5, -1), (0.5, -1), (1, -0.5), (1, 0.5), (0.5, 1), (-0.5, 1), (-1, 0.5), (-1, -0.5))


def octagons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return octagons_of(table(spark, sf_dir, "supplier"))


def octagons_of(suppliers: DataFrame) -> DataFrame:
    """section_id, layer, rings: cb around gl around wm; every third section has no wm."""
    s = suppliers.select(F.col("s_suppkey").cast("long").alias("s_suppkey"))
    sized = s.select(F.col("s_suppkey").alias("section_id"), F.explode(F.array(*(F.struct(F.lit(n).alias("layer"), F.expr(f"CAST({e} AS DOUBLE)").alias("r")) for n, e in SIZES.items()))).alias("l"))
    sized = sized.select("section_id", "l.layer", "l.r").where((F.col("layer") != "wm") | (F.col("section_id") % 3 != 0))
    ring = F.array(*(F.struct((F.lit(CX) + F.col("r") * F.lit(float(a))).alias("x"), (F.lit(CY) + F.col("r") * F.lit(float(b))).alias("y")) for a, b in _OCTAGON))
    return unsized(sized.select("section_id", "layer", "r", F.array(ring).alias("rings")))


SPANS_SQL = f"""
size AS (
  SELECT CAST(s_suppkey AS BIGINT) AS section_id, unnest(['cb', 'gl', 'wm']) AS layer,
         CAST(unnest([{", ".join(SIZES.values())}]) AS DOUBLE) AS r FROM supplier),
corner(k, a, b) AS (VALUES {", ".join(f"({i}, CAST({a} AS DOUBLE), CAST({b} AS DOUBLE))" for i, (a, b) in enumerate(_OCTAGON))}),
vert AS (
  SELECT section_id, layer, k, {CX} + r * a AS x, {CY} + r * b AS y FROM size, corner
  WHERE layer <> 'wm' OR section_id % 3 <> 0),
side AS (
  SELECT section_id, layer, x AS ax, y AS ay, coalesce(lead(x) OVER w, first_value(x) OVER w) AS ex,
         coalesce(lead(y) OVER w, first_value(y) OVER w) AS ey FROM vert WINDOW w AS (PARTITION BY section_id, layer ORDER BY k)),
crossing AS (
  SELECT section_id, layer, row_y AS y, ax + (row_y + 0.5 - ay) * (ex - ax) / (ey - ay) AS c
  FROM (SELECT *, unnest(range(CAST(ceil(least(ay, ey) - 0.5) AS BIGINT), CAST(ceil(greatest(ay, ey) - 0.5) AS BIGINT))) AS row_y
        FROM side WHERE ay <> ey)),
paired AS (
  SELECT section_id, layer, y, CAST(ceil(c - 0.5) AS INTEGER) AS x0,
         CAST(ceil(lead(c) OVER w - 0.5) AS INTEGER) AS x1, row_number() OVER w AS n
  FROM crossing WINDOW w AS (PARTITION BY section_id, layer, y ORDER BY c)),
span AS MATERIALIZED (SELECT section_id, layer, CAST(y AS INTEGER) AS y, x0, x1 FROM paired WHERE n % 2 = 1 AND x0 < x1)"""


#: Directions of seven cuts and of the reference line's vertices, as shares of the half size; reach of the cuts' ends.
CUT_DIRECTIONS = ((1.0, 0.125), (1.0, -0.375), (0.25, 1.0), (-0.375, 1.0), (-1.0, 0.25), (-1.0, -0.125), (0.125, -1.0))


def _sized(suppliers: DataFrame) -> DataFrame:
    s = suppliers.select(F.col("s_suppkey").cast("long").alias("s_suppkey"))
    return s.select(F.col("s_suppkey").alias("section_id"), *(F.expr(f"CAST({e} AS DOUBLE)").alias(n) for n, e in SIZES.items()))


def cut_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cuts_of(table(spark, sf_dir, "supplier"))


def cuts_of(suppliers: DataFrame) -> DataFrame:
    """section_id, cut_id, idx, x, y: seven radial cuts of three vertices in every section, with white matter or without.

    Every other one stops short of the outline, every third short of white matter, and half are
    traced from the inside.
    """
    cut = F.explode(F.array(*(F.struct(F.lit(f).alias("cut_id"), F.lit(a).alias("a"), F.lit(b).alias("b")) for f, (a, b) in enumerate(CUT_DIRECTIONS)))).alias("c")
    s = _sized(suppliers).select("*", cut).select("section_id", "cb", "wm", "c.*")
    outer = F.col("cb") * F.when(F.col("cut_id") % 2 == 0, 0.96875).otherwise(1.0625)
    inner = F.col("wm") * F.when(F.col("cut_id") % 3 == 0, 1.0625).otherwise(0.875)
    s = s.withColumn("outer", outer).withColumn("inner", inner)
    reach = F.array(F.col("outer"), (F.col("outer") + F.col("inner")) / 2, F.col("inner"))
    v = s.select("section_id", "cut_id", "a", "b", F.posexplode(reach).alias("k", "r"))
    idx = F.when((F.col("section_id") + F.col("cut_id")) % 2 == 1, 2 - F.col("k")).otherwise(F.col("k"))
    return unsized(v.select("section_id", "cut_id", idx.alias("idx"), (F.lit(CX) + F.col("a") * F.col("r")).alias("x"), (F.lit(CY) + F.col("b") * F.col("r")).alias("y")))


def reference_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return references_of(table(spark, sf_dir, "supplier"))


def references_of(suppliers: DataFrame) -> DataFrame:
    """section_id, idx, x, y: an open line just outside the middle octagon."""
    corner = F.posexplode(F.array(*(F.struct(F.lit(float(a)).alias("a"), F.lit(float(b)).alias("b")) for a, b in _OCTAGON))).alias("idx", "c")
    v = _sized(suppliers).select("section_id", F.col("gl").alias("r"), corner)
    return unsized(v.select("section_id", "idx", (F.lit(CX) + F.col("c.a") * F.col("r") * 1.0625).alias("x"), (F.lit(CY) + F.col("c.b") * F.col("r") * 1.0625).alias("y")))


def traced_images(suppliers: DataFrame) -> DataFrame:
    """Regions and lines of one image for each supplier, in the form of ``model.ROIS``.

    Every eleventh image lacks its line and every thirteenth has its outline twice, so they cannot be measured.
    """
    names = F.create_map(*(F.lit(x) for pair in (("cb", "CB"), ("gl", "GL+WM"), ("wm", "WM")) for x in pair))
    areas = octagons_of(suppliers).select("section_id", names[F.col("layer")].alias("name"), F.lit("POLYGON").alias("kind"), "rings")
    again = areas.where((F.col("name") == "CB") & (F.col("section_id") % 13 == 0)).withColumn("name", F.lit("cb again"))
    ring = F.array(F.transform(F.sort_array(F.collect_list(F.struct("idx", "x", "y"))), lambda v: F.struct(v["x"].alias("x"), v["y"].alias("y"))))
    lines = references_of(suppliers).where(F.col("section_id") % 11 != 0).groupBy("section_id").agg(ring.alias("rings"))
    lines = lines.select("section_id", F.lit("PL").alias("name"), F.lit("POLYLINE").alias("kind"), "rings")
    cuts = cuts_of(suppliers).groupBy("section_id", "cut_id").agg(ring.alias("rings"))
    cuts = cuts.select("section_id", F.concat(F.lit("FL"), (F.col("cut_id") + 1).cast("string")).alias("name"), F.lit("POLYLINE").alias("kind"), "rings")
    every = areas.unionByName(again).unionByName(lines).unionByName(cuts)
    order = F.row_number().over(Window.partitionBy("section_id").orderBy("name")) - 1
    none = F.lit(None).cast("map<string, string>")
    return every.select(F.col("section_id").cast("string").alias("section_id"), order.alias("roi_idx"), "name", "kind", none.alias("props"), "rings")


CUTS_SQL = f"""
sized AS (
  SELECT CAST(s_suppkey AS BIGINT) AS section_id, CAST({SIZES["cb"]} AS DOUBLE) AS cb, CAST({SIZES["gl"]} AS DOUBLE) AS gl, CAST({SIZES["wm"]} AS DOUBLE) AS wm FROM supplier),
direction(cut_id, a, b) AS (VALUES {", ".join(f"({i}, CAST({a} AS DOUBLE), CAST({b} AS DOUBLE))" for i, (a, b) in enumerate(CUT_DIRECTIONS))}),
ends AS (
  SELECT section_id, cut_id, a, b, cb * CASE WHEN cut_id % 2 = 0 THEN 0.96875 ELSE 1.0625 END AS o, wm * CASE WHEN cut_id % 3 = 0 THEN 1.0625 ELSE 0.875 END AS i
  FROM sized, direction),
reach AS (SELECT section_id, cut_id, a, b, k, CASE k WHEN 0 THEN o WHEN 1 THEN (o + i) / 2 ELSE i END AS r FROM ends, (VALUES (0), (1), (2)) AS t(k)),
cut AS (
  SELECT section_id, cut_id, CAST(CASE WHEN (section_id + cut_id) % 2 = 1 THEN 2 - k ELSE k END AS INTEGER) AS idx, {CX} + a * r AS x, {CY} + b * r AS y FROM reach),
ref AS (SELECT section_id, k AS idx, {CX} + a * gl * 1.0625 AS x, {CY} + b * gl * 1.0625 AS y FROM sized, corner)"""
