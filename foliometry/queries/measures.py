"""Queries over clipped lines, results and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import clip, report, results
from ..sources.tables import EVENTS_SQL, event_lines, table
from ..sources.sinks import csv_lines

LINE = ["line_id"]
KEYS = ["section_id", "instance"]
#: (name, marked) of items that images bear already.
DRAWN = (("scale bar", False), ("Grey Matter", False), ("[2] Fissure11", None), ("grey matter", False), ("arrow", True), ("4/5Cb", False), (None, None))
#: (label, x0, y0, x1, y1) of regions that lines are clipped to.
REGIONS = ((0, 0, 0, 150, 12), (1, 180, 3, 330, 30), (2, 360, 0, 510, 8), (3, 540, 5, 700, 60))


def _marked(spark, sf_dir):
    lines = event_lines(spark, sf_dir)
    region = F.explode(F.array(*(F.struct(F.lit(i).alias("label"), F.lit(a).alias("x0"), F.lit(b).alias("x1"), F.sequence(F.lit(c), F.lit(d - 1)).alias("rows")) for i, a, c, b, d in REGIONS))).alias("r")
    spans = lines.select("line_id").distinct().select("line_id", region).select("line_id", "r.label", "r.x0", "r.x1", F.explode("r.rows").alias("y"))
    return clip.clipped(lines, spans, LINE, 2.0, 0.5)


def line_length_by_region(spark, sf_dir):
    return clip.length_by_label(_marked(spark, sf_dir), LINE).withColumn("length", F.round("length", 6))


def line_runs(spark, sf_dir):
    """Runs of each line in each region, with sums of their points' coordinates."""
    runs = clip.runs(_marked(spark, sf_dir), LINE)
    sums = (F.round(F.sum(F.col(c) * F.col("idx")), 2).alias(f"sum_{c}") for c in "xy")
    return runs.groupBy("line_id", "label", "run").agg(F.count(F.lit(1)).alias("n_points"), *sums)


def line_pixels(spark, sf_dir):
    return clip.pixels_visited(clip.stretches(event_lines(spark, sf_dir), LINE), LINE)


def ends_joined(spark, sf_dir):
    samples = event_lines(spark, sf_dir).select("line_id", F.col("idx").alias("k"), F.when(F.col("y") < 30, F.floor(F.col("y") / 10).cast("int")).alias("label"))
    return results.ends_joined(samples, LINE)


def _pieces(spark, sf_dir):
    """Totals and parts of up to three pieces for each section, from supplier keys; all values are quarters."""
    k = F.col("k")
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("long").alias("k"))
    base = [F.floor(k / 3).cast("long").alias("section_id"), (k % 3 + 1).cast("int").alias("instance")]
    sizes = {"cerebellum": k * 4 + 0.25, "grey": k * 3 + 0.5, "granular": k + 0.25, "molecular": k * 2 + 0.25, "purkinje_len": k * 0.5, "purkinje_area": k * 0.25}
    totals = s.select("k", *base, *(e.cast("double").alias(n) for n, e in sizes.items()), (k % 7 == 0).alias("joined"), F.lit("µm²").alias("area_unit"), F.lit("µm").alias("length_unit"))
    n = (k * 5 % 6).cast("int")
    parts = totals.where(k * 5 % 6 > 0).withColumn("ord", F.explode(F.sequence(F.lit(1), n)))
    share = F.when(k % 4 == 0, F.lit(0.5)).otherwise(F.lit(1.0)) / n
    parts = parts.select("section_id", "instance", "ord", F.concat(F.lit("Section "), F.col("ord").cast("string")).alias("name"), *((F.floor(F.col(c) * share * 4) / 4).alias(c) for c in ("granular", "molecular")), (F.floor(F.col("purkinje_len") * share * 4) / 4).alias("purkinje"))
    return totals, parts.drop("k")


def pool_instances(spark, sf_dir):
    return results.pool(*_pieces(spark, sf_dir))[1]


def pooled_totals(spark, sf_dir):
    return results.pool(*_pieces(spark, sf_dir))[0]


def coverage_checks(spark, sf_dir):
    out = results.coverage(*_pieces(spark, sf_dir), KEYS)
    return out.withColumn("percent", F.round("percent", 6))


def results_grid(spark, sf_dir):
    return report.results_grid(*results.pool(*_pieces(spark, sf_dir)))


def results_csv(spark, sf_dir):
    return csv_lines(results_grid(spark, sf_dir))


def measurement_roi_names(spark, sf_dir):
    totals, parts = _pieces(spark, sf_dir)
    runs = parts.where(F.col("purkinje") > 0).select(*KEYS, "ord", F.explode(F.sequence(F.lit(1), (F.col("ord") % 2 + 1).cast("int"))).alias("run"))
    return report.region_names(totals.select(*KEYS), parts, runs)


def overlay_items(spark, sf_dir):
    totals, parts = _pieces(spark, sf_dir)
    cuts = parts.select(*KEYS, F.col("ord").alias("cut_id"), (-F.col("ord")).cast("double").alias("arc"))
    # every fifth piece has no molecular layer, so none is drawn
    flat = totals.withColumn("molecular", F.when(F.col("k") % 5 == 0, 0.0).otherwise(F.col("molecular")))
    return report.overlay_items(flat, cuts, parts)


def overlay_merged(spark, sf_dir):
    """Images that bear others' items and those of an earlier run; every fourth image is not measured again."""
    own = overlay_items(spark, sf_dir).where("section_id % 4 <> 0").select("section_id", "z", "name", "kind")
    before = F.array(*(F.struct(F.lit(i).alias("z"), F.lit(n).alias("name"), F.lit(m).alias("marked")) for i, (n, m) in enumerate(DRAWN)))
    old = table(spark, sf_dir, "supplier").select(F.floor(F.col("s_suppkey") / 3).cast("long").alias("section_id")).distinct()
    old = old.select("section_id", F.explode(before).alias("i")).select("section_id", "i.*", F.lit("area").alias("kind"))
    return report.merged_overlay(old, own)


def run_info(spark, sf_dir):
    totals, parts = _pieces(spark, sf_dir)
    n = parts.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("sections"))
    pieces = totals.join(n, KEYS, "left").select(*KEYS, F.coalesce("sections", F.lit(0)).alias("sections"), (F.col("section_id") % 2 == 0).alias("has_wm"), F.coalesce("sections", F.lit(0)).alias("fissures"), F.lit(True).alias("ring"), "joined")
    image = totals.select("section_id").distinct().select("section_id", F.concat(F.lit("image "), F.col("section_id").cast("string")).alias("title"), F.lit(None).cast("string").alias("file"), F.lit(6000).alias("width"), F.lit(5000).alias("height"), F.lit(0.5).alias("px_w"), F.lit(0.25).alias("px_h"), F.when(F.col("section_id") % 2 == 0, "µm").alias("unit"))
    warnings = totals.where("joined").groupBy("section_id").agg(F.count(F.lit(1)).alias("n"))
    return report.run_info(image, pieces, warnings)


QUERIES = {f.__name__: f for f in (line_length_by_region, line_runs, line_pixels, ends_joined, pool_instances, pooled_totals, coverage_checks, results_grid, results_csv, measurement_roi_names, overlay_items, overlay_merged, run_info)}

_STEPS = f"""{EVENTS_SQL},
region(label, x0, y0, x1, y1) AS (VALUES {", ".join(map(str, REGIONS))}),
step AS (
  SELECT line_id, idx, s, n, x, y, x2, y2, x + m * (x2 - x) AS mx, y + m * (y2 - y) AS my, sqrt(((x2 - x) * 2) * ((x2 - x) * 2) + ((y2 - y) * 0.5) * ((y2 - y) * 0.5)) / n AS step_len
  FROM (SELECT *, (CAST(s AS DOUBLE) / n + CAST(s + 1 AS DOUBLE) / n) / 2 AS m FROM (
        SELECT *, unnest(range(n)) AS s FROM (SELECT *, greatest(1, CAST(ceil(len / 0.25) AS BIGINT)) AS n FROM seg)))),
marked AS (
  SELECT step.*, r.label FROM step LEFT JOIN region r ON floor(mx) >= r.x0 AND floor(mx) < r.x1 AND floor(my) >= r.y0 AND floor(my) < r.y1)"""
_PIECES = """
p AS (
  SELECT CAST(s_suppkey AS BIGINT) AS k, CAST(s_suppkey // 3 AS BIGINT) AS section_id, CAST(s_suppkey % 3 + 1 AS INTEGER) AS instance, s_suppkey * 4 + 0.25::DOUBLE AS cerebellum, s_suppkey * 3 + 0.5::DOUBLE AS grey,
         s_suppkey + 0.25::DOUBLE AS granular, s_suppkey * 2 + 0.25::DOUBLE AS molecular, s_suppkey * 0.5::DOUBLE AS purkinje_len, s_suppkey * 0.25::DOUBLE AS purkinje_area,
         s_suppkey % 7 = 0 AS joined, CAST(s_suppkey * 5 % 6 AS INTEGER) AS n FROM supplier),
part_ AS (
  SELECT section_id, instance, CAST(o AS INTEGER) AS ord, 'Section ' || o AS name, floor(granular * share * 4) / 4 AS granular, floor(molecular * share * 4) / 4 AS molecular, floor(purkinje_len * share * 4) / 4 AS purkinje
  FROM (SELECT *, unnest(range(1, n + 1)) AS o, CASE WHEN k % 4 = 0 THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END / n AS share FROM p WHERE n > 0)),
tot AS (
  SELECT section_id, sum(cerebellum) AS cerebellum, sum(grey) AS grey, sum(granular) AS granular, sum(molecular) AS molecular, sum(purkinje_len) AS purkinje_len, sum(purkinje_area) AS purkinje_area,
         count(*) AS pieces, bool_or(joined) AS joined FROM p GROUP BY 1),
every AS (
  SELECT section_id, instance, ord, name, granular, molecular, purkinje FROM part_
  UNION ALL SELECT p.section_id, p.instance, 1, '', p.granular, p.molecular, p.purkinje_len FROM p JOIN tot t USING (section_id) WHERE n = 0 AND t.pieces > 1),
num AS (
  SELECT e.*, t.pieces, t.joined, row_number() OVER (PARTITION BY e.section_id ORDER BY instance, ord) AS i, count(*) OVER (PARTITION BY e.section_id) AS c FROM every e JOIN tot t USING (section_id)),
pool AS (
  SELECT section_id, instance, CAST(i AS INTEGER) AS ord, CASE WHEN pieces = 1 THEN name WHEN c = 8 AND NOT joined THEN (['2Cb', '3Cb', '4/5Cb', '6Cb', '7Cb', '8Cb', '9Cb', '10Cb'])[i] ELSE 'Section ' || i END AS name,
         granular, molecular, purkinje, pieces > 1 AND joined AND c = 8 AS withheld FROM num)"""
_UNITS = "'µm²' AS area_unit, 'µm' AS length_unit"
_GRID = """
grid AS (
  SELECT section_id, 0 AS row_idx, 'Measurement' AS measurement, 'Cerebellum (µm²)' AS cerebellum, 'Grey Matter (µm²)' AS grey, 'Granular Layer (µm²)' AS granular, 'Molecular Layer (µm²)' AS molecular, 'Purkinje (µm)' AS purkinje FROM tot
  UNION ALL SELECT section_id, 1, 'Area', printf('%.4f', cerebellum), printf('%.4f', grey), printf('%.4f', granular), printf('%.4f', molecular), printf('%.4f', purkinje_area) FROM tot
  UNION ALL SELECT section_id, 2, 'Length', NULL, NULL, NULL, NULL, printf('%.4f', purkinje_len) FROM tot
  UNION ALL SELECT section_id, ord + 2, name, NULL, NULL, printf('%.4f', granular), printf('%.4f', molecular), printf('%.4f', purkinje) FROM pool)"""
_NAMED = """
named AS (SELECT section_id, instance, joined, n, CASE WHEN count(*) OVER (PARTITION BY section_id) > 1 THEN '[' || instance || '] ' ELSE '' END AS pre FROM p)"""


def _values(rows) -> str:
    return ", ".join("(" + ", ".join("NULL" if v is None else repr(v) for v in row) + ")" for row in rows)


_LAYERS = _values((i, name, report.rgba(rgb), stroke) for i, (name, rgb, stroke) in enumerate(report.LAYER_FILLS))
_COLOURS = "[" + ", ".join(repr(report.rgba(c)) for c in report.SECTION_FILLS) + "]"
_OVERLAY = f"""
own AS (SELECT part_.*, pre FROM part_ JOIN named USING (section_id, instance)),
item AS (
  SELECT section_id, instance, 0 AS g, i AS k, pre || what AS name, 'area' AS kind, fill, stroke, 1.0::DOUBLE AS width, NULL AS text FROM named JOIN p USING (section_id, instance), (VALUES {_LAYERS}) AS l(i, what, fill, stroke) WHERE i <> 2 OR p.k % 5 <> 0
  UNION ALL SELECT section_id, instance, 1, 0, pre || 'Purkinje', 'line', NULL, '#FF0000', 1.5, NULL FROM named
  UNION ALL SELECT section_id, instance, 2, num, pre || 'Fissure' || num, 'line', NULL, '#FFFFFF', 1.5, NULL FROM (SELECT *, row_number() OVER (PARTITION BY section_id, instance ORDER BY ord DESC) AS num FROM own)
  UNION ALL SELECT section_id, instance, 3, ord * 2, pre || name, 'area', ({_COLOURS})[(ord - 1) % {len(report.SECTION_FILLS)} + 1], NULL, NULL, NULL FROM own
  UNION ALL SELECT section_id, instance, 3, ord * 2 + 1, pre || name || ' label', 'text', '#0000008C', '#FFFFFF', NULL, name FROM own),
drawn AS (SELECT section_id, CAST(row_number() OVER (PARTITION BY section_id ORDER BY instance, g, k) - 1 AS INTEGER) AS z, name, kind, fill, stroke, width, text FROM item)"""
ORACLES = {
    "measurement_roi_names": f"""WITH {_PIECES}, {_NAMED}, own AS (SELECT part_.*, pre FROM part_ JOIN named USING (section_id, instance)),
        item AS (
          SELECT section_id, instance, 0 AS ord, k, pre || what AS name FROM named, (VALUES {_LAYERS}) AS l(k, what, fill, stroke)
          UNION ALL SELECT section_id, instance, ord, 0, pre || name || '_Granular' FROM own WHERE granular > 0
          UNION ALL SELECT section_id, instance, ord, 1, pre || name || '_Molecular' FROM own WHERE molecular > 0
          UNION ALL SELECT section_id, instance, ord, run + 1, pre || name || CASE WHEN ord % 2 = 0 THEN '_Purkinje' ELSE '_Purkinje_' || run END
            FROM (SELECT *, unnest(range(1, ord % 2 + 2)) AS run FROM own WHERE purkinje > 0))
        SELECT section_id, CAST(row_number() OVER (PARTITION BY section_id ORDER BY instance, ord, k) - 1 AS INTEGER) AS seq, name FROM item""",
    "overlay_items": f"WITH {_PIECES}, {_NAMED}, {_OVERLAY} SELECT * FROM drawn",
    "overlay_merged": f"""WITH {_PIECES}, {_NAMED}, {_OVERLAY}, image AS (SELECT DISTINCT section_id FROM p),
        before(z, name, marked) AS (VALUES (0, 'scale bar', false), (1, 'Grey Matter', false), (2, '[2] Fissure11', NULL), (3, 'grey matter', false), (4, 'arrow', true), (5, '4/5Cb', false), (6, NULL, NULL)),
        both_ AS (
          SELECT section_id, 0 AS new, z, name, 'area' AS kind, coalesce(marked, false) AS marked FROM image, before WHERE section_id % 4 = 0 OR z IN (0, 3, 6)
          UNION ALL SELECT section_id, 1, z, name, kind, true FROM drawn WHERE section_id % 4 <> 0)
        SELECT section_id, CAST(row_number() OVER (PARTITION BY section_id ORDER BY new, z) - 1 AS INTEGER) AS z, name, marked, kind FROM both_""",
    "run_info": f"""WITH {_PIECES}, {_NAMED}, image AS (SELECT section_id, count(*) AS pieces, count(CASE WHEN joined THEN 1 END) AS warned FROM named GROUP BY 1),
        item AS (
          SELECT section_id, 0 AS k, 0 AS i, 'Image' AS field, 'image ' || section_id AS value FROM image
          UNION ALL SELECT section_id, 1, 0, 'Image size', '6000 × 5000 pixels' FROM image
          UNION ALL SELECT section_id, 2, 0, 'Pixel size', CASE WHEN section_id % 2 = 0 THEN '0.5 × 0.25 µm' ELSE 'not calibrated (areas in pixel², lengths in pixels)' END FROM image
          UNION ALL SELECT section_id, 3, 0, 'Traced pieces', CAST(pieces AS VARCHAR) FROM image
          UNION ALL SELECT section_id, 4, instance, 'Piece ' || instance, CASE WHEN n = 0 AND section_id % 2 = 0 THEN 'not split into sections (no fissures traced)' WHEN n = 0 THEN 'not split into sections (no White Matter)'
              ELSE n || ' fissure(s), ' || n || ' section(s); grey matter is a closed ring' || CASE WHEN joined THEN '; first and last sections joined' ELSE '' END END FROM named
          UNION ALL SELECT section_id, 5, 0, 'Warnings', CAST(warned AS VARCHAR) FROM image)
        SELECT section_id, CAST(row_number() OVER (PARTITION BY section_id ORDER BY k, i) - 1 AS INTEGER) AS seq, field, value FROM item""",
    "line_length_by_region": f"WITH {_STEPS} SELECT line_id, label, round(sum(step_len), 6) AS length FROM marked WHERE label IS NOT NULL GROUP BY ALL",
    # a point where a run begins, at the end of each segment within it, and where it ends; all through single precision
    "line_runs": f"""WITH {_STEPS}, c AS (SELECT *, CASE WHEN lag(label) OVER w IS DISTINCT FROM label OR row_number() OVER w = 1 THEN 1 ELSE 0 END AS change,
            lead(label) OVER w IS DISTINCT FROM label OR lead(s) OVER w IS NULL AS stop FROM marked WINDOW w AS (PARTITION BY line_id ORDER BY idx, s)),
        isle AS (SELECT *, sum(change) OVER (PARTITION BY line_id ORDER BY idx, s) AS island FROM c),
        point AS (
          SELECT line_id, label, island, idx, s, 0 AS k, CAST(s AS DOUBLE) / n AS t, x, y, x2, y2 FROM isle WHERE label IS NOT NULL AND change = 1
          UNION ALL SELECT line_id, label, island, idx, s, 1, CAST(s + 1 AS DOUBLE) / n, x, y, x2, y2 FROM isle WHERE label IS NOT NULL AND (stop OR s = n - 1)),
        placed AS (
          SELECT line_id, label, dense_rank() OVER (PARTITION BY line_id, label ORDER BY island) AS run, row_number() OVER (PARTITION BY line_id, island ORDER BY idx, s, k) - 1 AS place,
                 CAST(CAST(x + t * (x2 - x) AS FLOAT) AS DOUBLE) AS px, CAST(CAST(y + t * (y2 - y) AS FLOAT) AS DOUBLE) AS py FROM point)
        SELECT line_id, label, CAST(run AS INTEGER) AS run, count(*) AS n_points, round(sum(px * place), 2) AS sum_x, round(sum(py * place), 2) AS sum_y FROM placed GROUP BY ALL""",
    "line_pixels": f"WITH {_STEPS} SELECT line_id, count(*) AS px FROM (SELECT DISTINCT line_id, floor(mx) AS a, floor(my) AS b FROM step) GROUP BY 1",
    "ends_joined": f"""WITH {EVENTS_SQL}, l AS (SELECT line_id, idx, CASE WHEN y < 30 THEN CAST(floor(y / 10) AS INTEGER) END AS label FROM v),
        a AS (SELECT line_id, count(DISTINCT label) AS n_labels, arg_min(label, idx) AS first_label, arg_max(label, idx) AS last_label FROM l WHERE label IS NOT NULL GROUP BY 1)
        SELECT *, n_labels > 1 AND first_label = last_label AS joined FROM a""",
    "pool_instances": f"WITH {_PIECES} SELECT * FROM pool",
    "pooled_totals": f"WITH {_PIECES} SELECT *, {_UNITS} FROM tot",
    "coverage_checks": f"""WITH {_PIECES}, s AS (SELECT section_id, instance, sum(granular + molecular) AS area, sum(purkinje) AS line FROM part_ GROUP BY ALL), t AS (SELECT * FROM p JOIN s USING (section_id, instance))
        SELECT section_id, instance, 'WARNING' AS level, 'SECTION_AREA' AS code, round(area * 100.0 / grey, 6) AS percent FROM t WHERE grey > 0 AND area < grey * 0.99
        UNION ALL SELECT section_id, instance, 'NOTE', 'LINE_OUTSIDE', round((purkinje_len - line) * 100.0 / purkinje_len, 6) FROM t WHERE purkinje_len > 0 AND line < purkinje_len * 0.99""",
    "results_grid": f"WITH {_PIECES}, {_GRID} SELECT * FROM grid",
    "results_csv": f"""WITH {_PIECES}, {_GRID} SELECT section_id, row_idx, concat_ws(',', {", ".join(f"coalesce({c}, '')" for c in report.GRID)}) AS line FROM grid""",
}
