"""Queries over cuts and components: depth, direction, crossings, extension, sections."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import components, fissure, partition, results, spans
from ..plans.analyze import analyze, combine
from ..plans.store import stored
from ..sources.phantom import phantoms
from ..sources.tables import CUTS_SQL, SPANS_SQL, cut_lines, event_lines, octagons, reference_lines, table

KEYS = ["section_id"]


def _layers(spark, sf_dir):
    shapes = octagons(spark, sf_dir)
    return shapes, spans.rasterize(shapes, ["section_id", "layer"])


def nesting_depth(spark, sf_dir):
    points = cut_lines(spark, sf_dir).select("section_id", "cut_id", "idx", F.col("x").alias("qx"), F.col("y").alias("qy"))
    return fissure.nesting_depth(points, _layers(spark, sf_dir)[1], KEYS, ["cut_id", "idx"]).select("section_id", "cut_id", "idx", "depth")


def orient_fissure(spark, sf_dir):
    shapes, filled = _layers(spark, sf_dir)
    return fissure.outer_end_first(cut_lines(spark, sf_dir), filled, shapes, KEYS, "cut_id")


def crossing_arc(spark, sf_dir):
    arcs = fissure.crossing_arcs(cut_lines(spark, sf_dir), reference_lines(spark, sf_dir), KEYS, "cut_id")
    return arcs.select("section_id", "cut_id", F.round("arc", 6).alias("arc"))


def _oriented(spark, sf_dir):
    shapes, filled = _layers(spark, sf_dir)
    lines = cut_lines(spark, sf_dir)
    return fissure.oriented(lines, fissure.outer_end_first(lines, filled, shapes, KEYS, "cut_id"), KEYS, "cut_id"), filled, shapes


def spanning_cut(spark, sf_dir):
    lines, filled, shapes = _oriented(spark, sf_dir)
    out = fissure.spanning_cuts(lines, filled, shapes, KEYS, "cut_id", stored)
    return out.select("section_id", "cut_id", "idx", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


def mean_cut_length(spark, sf_dir):
    return fissure.mean_cut_length(cut_lines(spark, sf_dir), KEYS, "cut_id").select("section_id", F.round("mean_length", 6).alias("mean_length"))


def _grid(spark, sf_dir):
    """Users' points on a coarse grid, as spans of one cell."""
    cells = event_lines(spark, sf_dir).select("line_id", F.floor(F.col("x") / 24).cast("int").alias("x0"), F.floor(F.col("y") / 4).cast("int").alias("y")).distinct()
    return cells.select("line_id", "y", "x0", (F.col("x0") + 1).alias("x1"))


def connected_components(spark, sf_dir):
    labelled = components.label_spans(_grid(spark, sf_dir), ["line_id"])
    sizes = components.component_table(labelled, ["line_id"])
    return sizes.select("line_id", "label", "size", F.round("cx", 6).alias("cx"), F.round("cy", 6).alias("cy"))


def has_hole(spark, sf_dir):
    """Grey matter is a ring exactly where white matter lies inside it."""
    cut = spans.derived_layers(spans.cells(_layers(spark, sf_dir)[1], KEYS, ["cb", "gl", "wm"]))
    return components.holes(cut.where("grey").select("section_id", "y", "x0", "x1"), KEYS)


def _sections(spark, sf_dir):
    lines, filled, shapes = _oriented(spark, sf_dir)
    lines = fissure.with_white_matter(lines, shapes, KEYS)
    cut = spans.derived_layers(spans.cells(filled, KEYS, ["cb", "gl", "wm"]))
    return cut, partition.partition(cut.where("grey"), fissure.spanning_cuts(lines, filled, shapes, KEYS, "cut_id", stored), KEYS)


def complete_partition(spark, sf_dir):
    """How each section image was cut; all grey matter must be assigned."""
    labelled = _sections(spark, sf_dir)[1]
    n = F.sum(F.col("x1") - F.col("x0")).alias("n")
    return labelled.groupBy("section_id", "ring", "expected", "kept", "clean", "area", "assigned").agg(n, F.countDistinct("label").alias("labels"))


def section_areas(spark, sf_dir):
    cut, labelled = _sections(spark, sf_dir)
    return partition.section_areas(cut, labelled, KEYS)


def upper_median_order(spark, sf_dir):
    """The upper median of the hours of each user's events by type, in that order."""
    rows = event_lines(spark, sf_dir).withColumn("label", F.floor(F.col("y") / 10).cast("int")).select("line_id", "idx", F.col("x").alias("arc"), "label")
    out = results.labelled(results.line_order(rows, ["line_id"]), ["line_id"], F.lit(False))
    return out.select("line_id", "label", F.round("order_arc", 6).alias("order_arc"), "ord", "name")


def phantom_sections(spark, sf_dir):
    """Names and measures of the sections of synthetic images, one for every supplier."""
    n = table(spark, sf_dir, "supplier").count()
    images, rois = phantoms(spark, n)
    return combine(analyze(rois, images))[1].select("section_id", "ord", "name", "granular", "molecular", F.round("purkinje", 6).alias("purkinje"))


QUERIES = {f.__name__: f for f in (phantom_sections, nesting_depth, orient_fissure, crossing_arc, spanning_cut, mean_cut_length, connected_components, has_hole, complete_partition, section_areas, upper_median_order)}

_DEPTH = """
depth AS (
  SELECT c.section_id, c.cut_id, c.idx, c.x, c.y, coalesce(max(CASE s.layer WHEN 'wm' THEN 3 WHEN 'gl' THEN 2 WHEN 'cb' THEN 1 END), 0) AS depth
  FROM cut c LEFT JOIN span s ON s.section_id = c.section_id AND s.y = floor(c.y) AND s.x0 <= floor(c.x) AND floor(c.x) < s.x1 GROUP BY ALL),
turned AS (
  SELECT section_id, cut_id, max(CASE WHEN idx = 0 THEN depth END) AS depth_a, max(CASE WHEN idx = 2 THEN depth END) AS depth_b FROM depth GROUP BY ALL)"""
_HEAD = f"WITH {SPANS_SQL}, {CUTS_SQL}, {_DEPTH}"
_ROUTE = """
o AS (SELECT c.section_id, c.cut_id, CASE WHEN depth_a > depth_b THEN 2 - idx ELSE idx END AS idx, x, y FROM cut c JOIN turned USING (section_id, cut_id)),
box AS (SELECT section_id, sqrt(CAST((max(x1) - min(x0)) * (max(x1) - min(x0)) + (max(y) + 1 - min(y)) * (max(y) + 1 - min(y)) AS DOUBLE)) AS diagonal FROM span WHERE layer = 'cb' GROUP BY 1),
tip AS (
  SELECT a.section_id, a.cut_id, e.layer, e.pos, a.x, a.y, (a.x - b.x) / sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) AS ux,
         (a.y - b.y) / sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) AS uy
  FROM (VALUES ('cb', 0, 1), ('wm', 2, 1)) AS e(layer, pos, nxt) JOIN o a ON a.idx = e.pos JOIN o b ON b.section_id = a.section_id AND b.cut_id = a.cut_id AND b.idx = e.nxt),
near AS (
  SELECT t.section_id, t.cut_id, t.pos, min(sqrt((t.x - px) * (t.x - px) + (t.y - py) * (t.y - py))) AS dist FROM (
    SELECT t.*, ax + f * (ex - ax) AS px, ay + f * (ey - ay) AS py FROM (
      SELECT t.*, s.ax, s.ay, s.ex, s.ey, greatest(0, least(1, ((t.x - ax) * (ex - ax) + (t.y - ay) * (ey - ay)) / ((ex - ax) * (ex - ax) + (ey - ay) * (ey - ay)))) AS f
      FROM tip t JOIN side s ON s.section_id = t.section_id AND s.layer = t.layer) t) t GROUP BY ALL),
tried AS (
  SELECT t.section_id, t.cut_id, t.layer, t.pos, k, t.x + ux * (k * 2.0) AS x, t.y + uy * (k * 2.0) AS y FROM (
    SELECT t.*, unnest(range(CAST(floor(least(0.30 * diagonal, greatest(15.0, 3.0 * dist)) / 2) AS BIGINT) + 1)) AS k
    FROM tip t JOIN near USING (section_id, cut_id, pos) JOIN box USING (section_id)) t),
hit AS (
  SELECT t.*, EXISTS (SELECT 1 FROM span s WHERE s.section_id = t.section_id AND s.layer = t.layer AND s.y = floor(t.y) AND s.x0 <= floor(t.x) AND floor(t.x) < s.x1) AS inside FROM tried t),
first AS (SELECT *, row_number() OVER (PARTITION BY section_id, cut_id, pos ORDER BY k) AS rn FROM hit WHERE inside = (layer = 'wm'))"""

ORACLES = {
    "nesting_depth": f"{_HEAD} SELECT section_id, cut_id, idx, depth FROM depth",
    # ends of these cuts never lie equally deep
    "orient_fissure": f"{_HEAD} SELECT section_id, cut_id, depth_a, depth_b, depth_a > depth_b AS reversed FROM turned",
    "crossing_arc": f"""{_HEAD},
        cs AS (SELECT *, sum(len) OVER w AS cum1, sum(len) OVER w - len AS cum0 FROM (SELECT section_id, cut_id, idx, x, y, x2, y2, sqrt((x2 - x) * (x2 - x) + (y2 - y) * (y2 - y)) AS len
               FROM (SELECT *, lead(x) OVER v AS x2, lead(y) OVER v AS y2 FROM cut WINDOW v AS (PARTITION BY section_id, cut_id ORDER BY idx)) WHERE x2 IS NOT NULL) WINDOW w AS (PARTITION BY section_id, cut_id ORDER BY idx)),
        tot AS (SELECT section_id, cut_id, max(cum1) AS total, CAST(floor(greatest(20, least(300, max(cum1)))) AS BIGINT) AS n FROM cs GROUP BY ALL),
        arc AS (SELECT section_id, cut_id, total, k, total * k / n AS arc FROM (SELECT *, unnest(range(n + 1)) AS k FROM tot)),
        spot AS (SELECT a.section_id, a.cut_id, k, CASE WHEN arc >= total THEN x2 ELSE x + (arc - cum0) / len * (x2 - x) END AS qx, CASE WHEN arc >= total THEN y2 ELSE y + (arc - cum0) / len * (y2 - y) END AS qy,
               row_number() OVER (PARTITION BY a.section_id, a.cut_id, k ORDER BY idx) AS rn FROM arc a JOIN cs ON cs.section_id = a.section_id AND cs.cut_id = a.cut_id AND (cum1 >= arc OR (arc >= total AND cum1 = total))),
        rs AS (SELECT *, sum(len) OVER w - len AS cum0 FROM (SELECT section_id, idx, x, y, x2, y2, sqrt((x2 - x) * (x2 - x) + (y2 - y) * (y2 - y)) AS len
               FROM (SELECT *, lead(x) OVER v AS x2, lead(y) OVER v AS y2 FROM ref WINDOW v AS (PARTITION BY section_id ORDER BY idx)) WHERE x2 IS NOT NULL) WINDOW w AS (PARTITION BY section_id ORDER BY idx)),
        pr AS (SELECT *, sqrt((qx - x - t * (x2 - x)) * (qx - x - t * (x2 - x)) + (qy - y - t * (y2 - y)) * (qy - y - t * (y2 - y))) AS dist FROM (
               SELECT spot.section_id, cut_id, k, qx, qy, rs.idx, rs.x, rs.y, rs.x2, rs.y2, rs.len, rs.cum0, greatest(0, least(1, ((qx - x) * (x2 - x) + (qy - y) * (y2 - y)) / (len * len))) AS t FROM spot JOIN rs ON rs.section_id = spot.section_id WHERE rn = 1))
        SELECT section_id, cut_id, round(cum0 + t * len, 6) AS arc FROM (SELECT *, row_number() OVER (PARTITION BY section_id, cut_id ORDER BY dist, k, idx) AS best FROM pr) WHERE best = 1""",
    "spanning_cut": f"""{_HEAD}, {_ROUTE} SELECT section_id, cut_id, CAST(idx AS INTEGER) AS idx, round(x, 6) AS x, round(y, 6) AS y FROM o
        UNION ALL SELECT section_id, cut_id, CAST(CASE WHEN pos = 0 THEN -1 ELSE 3 END AS INTEGER), round(x, 6), round(y, 6) FROM first WHERE rn = 1 AND k > 0""",
    "mean_cut_length": f"""WITH {SPANS_SQL}, {CUTS_SQL}, l AS (SELECT section_id, cut_id, sum(d) AS len FROM (SELECT section_id, cut_id, sqrt((x - lag(x) OVER w) * (x - lag(x) OVER w) + (y - lag(y) OVER w) * (y - lag(y) OVER w)) AS d
        FROM cut WINDOW w AS (PARTITION BY section_id, cut_id ORDER BY idx)) GROUP BY ALL) SELECT section_id, round(avg(len), 6) AS mean_length FROM l GROUP BY 1""",
    "connected_components": """
        WITH RECURSIVE g AS (SELECT DISTINCT user_id AS line_id, CAST(floor((epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) / 3.6e9 / 24) AS BIGINT) AS x, CAST(floor(value / 4) AS BIGINT) AS y FROM events),
        n AS (SELECT *, y * 100000 + x AS cell FROM g),
        e AS (SELECT a.line_id, a.cell AS u, b.cell AS v FROM n a JOIN n b ON a.line_id = b.line_id AND abs(a.x - b.x) <= 1 AND abs(a.y - b.y) <= 1),
        r(line_id, u, v) AS (SELECT line_id, u, v FROM e UNION SELECT r.line_id, r.u, e.v FROM r JOIN e ON e.line_id = r.line_id AND e.u = r.v),
        root AS (SELECT line_id, u AS cell, min(v) AS first FROM r GROUP BY ALL)
        SELECT line_id, CAST(label AS INTEGER) AS label, count(*) AS size, round(sum(x) / count(*), 6) AS cx, round(sum(y) / count(*), 6) AS cy
        FROM (SELECT root.line_id, x, y, dense_rank() OVER (PARTITION BY root.line_id ORDER BY first) - 1 AS label FROM root JOIN n ON n.line_id = root.line_id AND n.cell = root.cell) GROUP BY ALL""",
    "has_hole": f"""WITH {SPANS_SQL}, c AS (SELECT section_id, max(CASE WHEN layer = 'wm' THEN 1 ELSE 0 END) AS wm FROM span GROUP BY 1), w AS (SELECT section_id, sum(x1 - x0) AS px FROM span WHERE layer = 'wm' GROUP BY 1)
        SELECT c.section_id, CAST(coalesce(px, 0) AS BIGINT) AS enclosed, coalesce(px, 0) > 32 AS ring FROM c LEFT JOIN w USING (section_id)""",
    "upper_median_order": """
        WITH v AS (SELECT user_id AS line_id, (epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) / 3.6e9 AS x, CAST(floor(value / 10) AS INTEGER) AS label FROM events),
        m AS (SELECT line_id, label, list_sort(list(x)) AS l FROM v GROUP BY ALL),
        o AS (SELECT line_id, label, l[len(l) // 2 + 1] AS a FROM m)
        SELECT line_id, label, round(a, 6) AS order_arc, CAST(row_number() OVER w AS INTEGER) AS ord,
               CASE WHEN count(*) OVER (PARTITION BY line_id) = 8 THEN (['2Cb', '3Cb', '4/5Cb', '6Cb', '7Cb', '8Cb', '9Cb', '10Cb'])[row_number() OVER w] ELSE 'Section ' || row_number() OVER w END AS name
        FROM o WINDOW w AS (PARTITION BY line_id ORDER BY a, label)""",
}
