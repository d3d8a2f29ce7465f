"""Queries over regions: spans, region algebra, areas and containment."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import components, spans
from ..sources.tables import SPANS_SQL, octagons

LAYERS = ["cb", "gl", "wm"]


def _spans(spark, sf_dir):
    return spans.rasterize(octagons(spark, sf_dir), ["section_id", "layer"])


def _cells(spark, sf_dir):
    return spans.cells(_spans(spark, sf_dir), ["section_id"], LAYERS)


def rasterize_polygon(spark, sf_dir):
    return _spans(spark, sf_dir)


def phantom_layer_areas(spark, sf_dir):
    return spans.layer_pixels(_cells(spark, sf_dir), ["section_id"])


def _layer(filled, name):
    return filled.where(F.col("layer") == name).drop("layer")


def span_and(spark, sf_dir):
    filled = _spans(spark, sf_dir)
    return spans.intersect(_layer(filled, "cb"), _layer(filled, "gl"), ["section_id"])


def span_not(spark, sf_dir):
    filled = _spans(spark, sf_dir)
    return spans.subtract(_layer(filled, "cb"), _layer(filled, "gl"), ["section_id"])


def containment_note(spark, sf_dir):
    """Regions compared with their parents' outlines, shrunk in every second section so that some reach out."""
    shapes = octagons(spark, sf_dir)
    small = F.transform("rings", lambda ring: F.transform(ring, lambda v: F.struct(((v["x"] - 600.25) * 0.5 + 600.25).alias("x"), ((v["y"] - 500.375) * 0.5 + 500.375).alias("y"))))
    shapes = shapes.withColumn("rings", F.when((F.col("layer") == "cb") & (F.col("section_id") % 2 == 0), small).otherwise(F.col("rings")))
    cut = spans.cells(spans.rasterize(shapes, ["section_id", "layer"]), ["section_id"], LAYERS)
    out = spans.outside(cut, ["section_id"], "gl", "cb", 0.005)
    return out.withColumn("percent", F.round("percent", 6))


def region_outlines(spark, sf_dir):
    """Both rings of the layer between the two outer octagons, corner by corner."""
    filled = _spans(spark, sf_dir)
    between = spans.subtract(_layer(filled, "cb"), _layer(filled, "gl"), ["section_id"])
    return components.outline_vertices(between, ["section_id"])


QUERIES = {f.__name__: f for f in (phantom_layer_areas, rasterize_polygon, span_and, span_not, containment_note, region_outlines)}

_PX = """
px AS (
  SELECT section_id, layer, sum(x1 - x0) AS px FROM span GROUP BY ALL),
cut AS (
  SELECT a.section_id, a.layer AS la, b.layer AS lb, sum(greatest(0, least(a.x1, b.x1) - greatest(a.x0, b.x0))) AS px
  FROM span a JOIN span b ON a.section_id = b.section_id AND a.y = b.y AND a.layer < b.layer GROUP BY ALL)"""
ORACLES = {
    "rasterize_polygon": f"WITH {SPANS_SQL} SELECT section_id, layer, y, x0, x1 FROM span",
    # the octagons are nested: areas follow from those of the layers
    "phantom_layer_areas": f"""WITH {SPANS_SQL}, {_PX}, t AS (SELECT section_id, max(CASE WHEN layer = 'cb' THEN px END) AS cb, max(CASE WHEN layer = 'gl' THEN px END) AS gl,
          coalesce(max(CASE WHEN layer = 'wm' THEN px END), 0) AS wm FROM px GROUP BY 1),
        o AS (SELECT section_id, coalesce(max(CASE WHEN la = 'cb' AND lb = 'gl' THEN px END), 0) AS cb_gl, coalesce(max(CASE WHEN la = 'cb' AND lb = 'wm' THEN px END), 0) AS cb_wm,
          coalesce(max(CASE WHEN la = 'gl' AND lb = 'wm' THEN px END), 0) AS gl_wm FROM cut GROUP BY 1)
        SELECT section_id, CAST(cb AS BIGINT) AS cb, CAST(cb - cb_wm AS BIGINT) AS grey, CAST(gl - gl_wm AS BIGINT) AS granular, CAST(cb - cb_gl AS BIGINT) AS molecular FROM t JOIN o USING (section_id)""",
    "span_and": f"""WITH {SPANS_SQL}, m AS (SELECT a.section_id, a.y, greatest(a.x0, b.x0) AS x0, least(a.x1, b.x1) AS x1
          FROM (SELECT * FROM span WHERE layer = 'cb') a JOIN (SELECT * FROM span WHERE layer = 'gl') b ON a.section_id = b.section_id AND a.y = b.y)
        SELECT * FROM m WHERE x0 < x1""",
    # octagons are convex: one span of each on a scanline, so at most a piece on either side is left
    "span_not": f"""WITH {SPANS_SQL}, m AS (SELECT a.section_id, a.y, a.x0, a.x1, b.x0 AS b0, b.x1 AS b1
          FROM (SELECT * FROM span WHERE layer = 'cb') a LEFT JOIN (SELECT * FROM span WHERE layer = 'gl') b ON a.section_id = b.section_id AND a.y = b.y)
        SELECT * FROM (SELECT section_id, y, x0, CASE WHEN b0 IS NULL THEN x1 ELSE least(b0, x1) END AS x1 FROM m UNION ALL SELECT section_id, y, greatest(b1, x0), x1 FROM m WHERE b0 IS NOT NULL) WHERE x0 < x1""",
    # an octagon has one span on a line: its ring runs along the top, down the right ends and up the left ones
    "region_outlines": f"""WITH {SPANS_SQL}, e AS (
          SELECT section_id, layer, y, x0, x1, lag(x0) OVER w AS p0, lag(x1) OVER w AS p1, lead(x0) OVER w AS n0, lead(x1) OVER w AS n1 FROM span WHERE layer IN ('cb', 'gl') WINDOW w AS (PARTITION BY section_id, layer ORDER BY y)),
        c AS (
          SELECT section_id, layer, -1 AS side, 0 AS step, x0 AS x, y FROM e WHERE p0 IS NULL
          UNION ALL SELECT section_id, layer, 0, 2 * y, x1, y FROM e WHERE p1 IS DISTINCT FROM x1
          UNION ALL SELECT section_id, layer, 0, 2 * y + 1, x1, y + 1 FROM e WHERE n1 IS DISTINCT FROM x1
          UNION ALL SELECT section_id, layer, 1, -2 * y - 1, x0, y + 1 FROM e WHERE n0 IS DISTINCT FROM x0
          UNION ALL SELECT section_id, layer, 1, -2 * y, x0, y FROM e WHERE p0 IS NOT NULL AND p0 <> x0)
        SELECT section_id, CASE layer WHEN 'cb' THEN 0 ELSE 1 END AS ring, CAST(row_number() OVER (PARTITION BY section_id, layer ORDER BY side, step) - 1 AS INTEGER) AS idx, x, y FROM c""",
    "containment_note": "WITH " + SPANS_SQL.replace(
        "600.25 + r * a AS x, 500.375 + r * b AS y", "600.25 + r * a * CASE WHEN layer = 'cb' AND section_id % 2 = 0 THEN 0.5 ELSE 1.0 END AS x, 500.375 + r * b * CASE WHEN layer = 'cb' AND section_id % 2 = 0 THEN 0.5 ELSE 1.0 END AS y"
    ) + f""", {_PX}, t AS (SELECT p.section_id, CAST(p.px AS BIGINT) AS inner_px, CAST(p.px - coalesce(c.px, 0) AS BIGINT) AS outside_px
          FROM px p LEFT JOIN cut c ON c.section_id = p.section_id AND c.la = 'cb' AND c.lb = 'gl' WHERE p.layer = 'gl')
        SELECT section_id, inner_px, outside_px, round(outside_px * 100.0 / inner_px, 6) AS percent FROM t WHERE outside_px > greatest(inner_px * 0.005, 1e-9)""",
}
