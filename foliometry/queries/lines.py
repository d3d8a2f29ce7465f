"""Queries over polylines: lengths, positions, projections, strips and turns."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import polyline
from ..sources.tables import EVENTS_SQL, event_lines

KEYS = ["line_id"]
PX_W, PX_H = 2.0, 0.5


def _rounded(df, *columns):
    return df.withColumns({c: F.round(F.col(c), 6) for c in columns})


def polyline_length(spark, sf_dir):
    return _rounded(polyline.total_length(event_lines(spark, sf_dir), KEYS, PX_W, PX_H), "length")


def polyline_cumulative(spark, sf_dir):
    return _rounded(polyline.cumulative(event_lines(spark, sf_dir), KEYS).select("line_id", "idx", "cum"), "cum")


def bounds_diagonal(spark, sf_dir):
    return _rounded(polyline.bounds_diagonal(event_lines(spark, sf_dir), KEYS), "diagonal")


def point_at_arc(spark, sf_dir):
    segs = polyline.segments(event_lines(spark, sf_dir), KEYS)
    lengths = segs.groupBy("line_id").agg(F.max("cum1").alias("length"))
    arcs = polyline.sampled(lengths, KEYS, F.lit(8))
    return _rounded(polyline.points_at(segs, arcs, KEYS).select("line_id", "k", "px", "py"), "px", "py")


def _queries_points(spark, sf_dir):
    """Five fixed points for each line."""
    lines = event_lines(spark, sf_dir).select("line_id").distinct()
    point = F.explode(F.array(*(F.struct(F.lit(i).alias("p"), F.lit(x).alias("qx"), F.lit(y).alias("qy")) for i, (x, y) in enumerate(POINTS)))).alias("q")
    return lines.select("line_id", point).select("line_id", "q.p", "q.qx", "q.qy")


POINTS = ((10.0, 5.0), (200.5, 100.25), (360.0, 20.0), (500.0, 300.0), (719.0, 1.0))


def project_point(spark, sf_dir):
    segs = polyline.segments(event_lines(spark, sf_dir), KEYS)
    return _rounded(polyline.nearest(segs, _queries_points(spark, sf_dir), KEYS, ["p"]).select("line_id", "p", "arc", "dist"), "arc", "dist")


def nearest_on_polygon(spark, sf_dir):
    segs = polyline.segments(event_lines(spark, sf_dir), KEYS, closed=True)
    return _rounded(polyline.nearest(segs, _queries_points(spark, sf_dir), KEYS, ["p"]).select("line_id", "p", "dist", "nx", "ny"), "dist", "nx", "ny")


def sweep_degrees(spark, sf_dir):
    return _rounded(polyline.sweep_degrees(event_lines(spark, sf_dir), KEYS, F.lit(360.0), F.lit(25.0)), "degrees")


def polyline_strip(spark, sf_dir):
    return _rounded(polyline.strip(event_lines(spark, sf_dir), KEYS, 4.5), "x", "y")


QUERIES = {f.__name__: f for f in (polyline_length, polyline_cumulative, bounds_diagonal, point_at_arc, project_point, nearest_on_polygon, sweep_degrees, polyline_strip)}

_W = "PARTITION BY line_id ORDER BY idx"
_POINT = "pt(p, qx, qy) AS (VALUES " + ", ".join(f"({i}, CAST({x} AS DOUBLE), CAST({y} AS DOUBLE))" for i, (x, y) in enumerate(POINTS)) + ")"
_NEAR = """
near AS (
  SELECT *, x + t * (x2 - x) AS nx, y + t * (y2 - y) AS ny FROM (
    SELECT *, greatest(0, least(1, CASE WHEN sq < 1e-12 THEN 0 ELSE ((qx - x) * (x2 - x) + (qy - y) * (y2 - y)) / sq END)) AS t
    FROM (SELECT *, (x2 - x) * (x2 - x) + (y2 - y) * (y2 - y) AS sq FROM {segs}, pt))),
best AS (
  SELECT *, row_number() OVER (PARTITION BY line_id, p ORDER BY dist, idx) AS rn FROM (
    SELECT *, sqrt((qx - nx) * (qx - nx) + (qy - ny) * (qy - ny)) AS dist FROM near))"""
ORACLES = {
    "polyline_length": f"""WITH {EVENTS_SQL}, s AS (SELECT line_id, sqrt(((x - lag(x) OVER w) * {PX_W}) * ((x - lag(x) OVER w) * {PX_W}) + ((y - lag(y) OVER w) * {PX_H}) * ((y - lag(y) OVER w) * {PX_H})) AS step
        FROM v WINDOW w AS ({_W})) SELECT line_id, count(*) AS n_vertices, round(coalesce(sum(step), 0), 6) AS length FROM s GROUP BY 1""",
    "polyline_cumulative": f"""WITH {EVENTS_SQL}, s AS (SELECT line_id, idx, coalesce(sqrt((x - lag(x) OVER w) * (x - lag(x) OVER w) + (y - lag(y) OVER w) * (y - lag(y) OVER w)), 0) AS step
        FROM v WINDOW w AS ({_W})) SELECT line_id, idx, round(sum(step) OVER (PARTITION BY line_id ORDER BY idx), 6) AS cum FROM s""",
    "bounds_diagonal": f"WITH {EVENTS_SQL} SELECT line_id, round(sqrt((max(x) - min(x)) * (max(x) - min(x)) + (max(y) - min(y)) * (max(y) - min(y))), 6) AS diagonal FROM v GROUP BY 1",
    "point_at_arc": f"""WITH {EVENTS_SQL}, total AS (SELECT line_id, max(cum1) AS length FROM seg GROUP BY 1),
        arcs AS (SELECT line_id, length, k, length * k / 8 AS arc FROM total, (SELECT unnest(range(9)) AS k)),
        hit AS (SELECT a.line_id, a.k, a.arc, a.length, s.*, row_number() OVER (PARTITION BY a.line_id, a.k ORDER BY s.idx) AS rn
                FROM arcs a JOIN seg s ON s.line_id = a.line_id AND (s.cum1 >= a.arc OR (a.arc >= a.length AND s.cum1 = a.length)))
        SELECT line_id, CAST(k AS INTEGER) AS k, round(CASE WHEN arc >= length THEN x2 ELSE x + t * (x2 - x) END, 6) AS px, round(CASE WHEN arc >= length THEN y2 ELSE y + t * (y2 - y) END, 6) AS py
        FROM (SELECT *, CASE WHEN arc <= 0 OR len < 1e-9 THEN 0 ELSE (arc - cum0) / len END AS t FROM hit WHERE rn = 1)""",
    "project_point": f"WITH {EVENTS_SQL}, {_POINT}, {_NEAR.format(segs='seg')} SELECT line_id, p, round(cum0 + t * sqrt(sq), 6) AS arc, round(dist, 6) AS dist FROM best WHERE rn = 1",
    "nearest_on_polygon": f"""WITH {EVENTS_SQL}, ring AS (SELECT line_id, idx, x, y, coalesce(lead(x) OVER w, first_value(x) OVER w) AS x2, coalesce(lead(y) OVER w, first_value(y) OVER w) AS y2 FROM v WINDOW w AS ({_W})),
        {_POINT}, {_NEAR.format(segs="ring")} SELECT line_id, p, round(dist, 6) AS dist, round(nx, 6) AS nx, round(ny, 6) AS ny FROM best WHERE rn = 1""",
    "sweep_degrees": f"""WITH {EVENTS_SQL}, a AS (SELECT line_id, idx, atan2(y - 25.0, x - 360.0) AS a FROM v), d AS (SELECT line_id, a - lag(a) OVER ({_W}) AS d FROM a)
        SELECT line_id, round(degrees(coalesce(sum(CASE WHEN d > pi() THEN d - 2 * pi() WHEN d < -pi() THEN d + 2 * pi() ELSE d END), 0)), 6) AS degrees FROM d GROUP BY 1""",
    "polyline_strip": f"""WITH {EVENTS_SQL},
        d AS (SELECT line_id, idx, x, y, len, (x2 - x) AS dx, (y2 - y) AS dy FROM seg),
        u AS (SELECT line_id, idx, CASE WHEN len < 1e-9 THEN 1 ELSE dx / len END AS ux, CASE WHEN len < 1e-9 THEN 0 ELSE dy / len END AS uy FROM d),
        n AS (SELECT v.line_id, v.idx, v.x, v.y, a.ux AS ax, a.uy AS ay, b.ux AS bx, b.uy AS b2, count(*) OVER (PARTITION BY v.line_id) AS n
              FROM v LEFT JOIN u a ON a.line_id = v.line_id AND a.idx = v.idx - 1 LEFT JOIN u b ON b.line_id = v.line_id AND b.idx = v.idx),
        m AS (SELECT *, sqrt((ax + bx) * (ax + bx) + (ay + b2) * (ay + b2)) AS ml FROM n),
        q AS (SELECT *, CASE WHEN ax IS NULL AND bx IS NULL THEN 1 WHEN ax IS NULL THEN bx WHEN bx IS NULL OR ml < 1e-9 THEN ax ELSE (ax + bx) / ml END AS ux,
                     CASE WHEN ax IS NULL AND bx IS NULL THEN 0 WHEN ax IS NULL THEN b2 WHEN bx IS NULL OR ml < 1e-9 THEN ay ELSE (ay + b2) / ml END AS uy FROM m)
        SELECT line_id, CAST(idx AS BIGINT) AS idx, round(x - uy * 4.5, 6) AS x, round(y + ux * 4.5, 6) AS y FROM q
        UNION ALL SELECT line_id, CAST(2 * n - 1 - idx AS BIGINT), round(x + uy * 4.5, 6), round(y - ux * 4.5, 6) FROM q""",
}
