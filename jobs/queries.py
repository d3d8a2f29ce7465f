"""The jobs as queries: each runs twice into one new folder and gives the whole output, with SQL of the same meaning."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliometry.plans.store import folder
from foliometry.sources.tables import SPANS_SQL

from . import measure_images, name_audit


def _new(spark: SparkSession, job: str) -> str:
    return f"{folder(spark)}/foliometry-jobs/{job}-{uuid.uuid4().hex}"


def job1_name_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = _new(spark, "name_audit")
    for _ in range(2):  # the second run finds nothing new
        name_audit.run(spark, os.path.join(sf_dir, "documents.parquet"), f"{at}/out", f"{at}/checkpoint")
    return name_audit.result(spark, f"{at}/out").drop("batch")


def job2_measure_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = _new(spark, "measure_images")
    for _ in range(2):  # the second run replaces every partition by the same
        measure_images.run(spark, os.path.join(sf_dir, "supplier.parquet"), os.path.join(sf_dir, "nation.parquet"), f"{at}/out")
    rows = measure_images.result(spark, f"{at}/out")
    return rows.select(*(F.round(c, 6).alias(c) if c in measure_images.MEASURES else F.col(c) for c in rows.columns))


QUERIES = {f.__name__: f for f in (job1_name_audit, job2_measure_images)}

_WORD = r"(^|[^\p{L}\p{Nd}])TOKEN($|[^\p{L}\p{Nd}])"


def _word(token: str) -> str:
    return _WORD.replace("TOKEN", token)


ORACLES = {
    "job1_name_audit": rf"""
        WITH name AS (
          SELECT doc_id, source, lang, i, trim(names[i]) AS name FROM (
            SELECT *, unnest(range(1, len(names) + 1)) AS i FROM (SELECT doc_id, source, lang, string_split_regex(text, '\r?\n|[|]') AS names FROM documents WHERE text <> ''))),
        seen AS (
          SELECT *, regexp_replace(lower(name), '^\p{{Nd}}*', '') AS n, regexp_extract(lower(name), '^(\p{{Nd}}*)', 1) AS digits,
                 regexp_matches(name, '^(\[\d+\] .*|(\d+(/\d+)?Cb|Section \d+)_(Granular|Molecular|Purkinje))$', 'i') AS output FROM name),
        role AS (
          SELECT *, CASE WHEN output OR NOT (digits = '' OR (regexp_matches(digits, '^[0-9]{{1,4}}$') AND TRY_CAST(digits AS INTEGER) > 0)) THEN NULL
              WHEN regexp_matches(n, 'fissure|(^|[^\p{{L}}\p{{Nd}}])fl($|[^\p{{L}}])') THEN 'FISSURE'
              WHEN n LIKE '%purkinje%' OR regexp_matches(n, '{_word("pl")}') THEN 'PURKINJE'
              WHEN regexp_matches(n, 'granular|gl\+wm|glwm|gl_wm|gl-wm|gl wm') OR (regexp_matches(n, '{_word("gl")}') AND regexp_matches(n, '{_word("wm")}')) THEN 'GRANULAR_WM'
              WHEN n LIKE '%cerebellum%' OR regexp_matches(n, '{_word("cb")}') THEN 'CEREBELLUM'
              WHEN n LIKE '%white%' OR regexp_matches(n, '{_word("wm")}') THEN 'WHITE_MATTER' END AS role FROM seen),
        numbered AS (SELECT *, CASE WHEN NOT output AND role IS NULL THEN row_number() OVER (PARTITION BY doc_id, NOT output AND role IS NULL ORDER BY i) END AS k FROM role),
        list AS (
          SELECT doc_id, count(*) AS n_names, count(*) FILTER (name = '') AS n_unnamed, count(*) FILTER (output) AS n_output, count(k) AS n_ignored, count(*) - count(DISTINCT name) AS n_twice,
                 count(*) FILTER (role = 'CEREBELLUM') AS n_cerebellum, count(*) FILTER (role = 'GRANULAR_WM') AS n_granular_wm, count(*) FILTER (role = 'WHITE_MATTER') AS n_white_matter,
                 count(*) FILTER (role = 'PURKINJE') AS n_purkinje, count(*) FILTER (role = 'FISSURE') AS n_fissure,
                 coalesce(string_agg(CASE WHEN name = '' THEN '(unnamed)' ELSE name END, ', ' ORDER BY i) FILTER (k <= 10), '') || CASE WHEN count(k) > 10 THEN ', …' ELSE '' END AS shown
          FROM numbered GROUP BY doc_id)
        SELECT d.doc_id, d.source, d.lang, {", ".join(f"coalesce({c}, 0) AS {c}" for c in ("n_names", "n_unnamed", "n_output", "n_ignored", "n_twice", "n_cerebellum", "n_granular_wm", "n_white_matter", "n_purkinje", "n_fissure"))},
               concat_ws(',', CASE WHEN coalesce(n_cerebellum, 0) = 0 THEN 'CEREBELLUM' END, CASE WHEN coalesce(n_granular_wm, 0) = 0 THEN 'GRANULAR_WM' END, CASE WHEN coalesce(n_purkinje, 0) = 0 THEN 'PURKINJE' END) AS missing,
               coalesce(shown, '') AS shown
        FROM documents d LEFT JOIN list USING (doc_id)""",
    # the octagons are nested and convex, so the areas between them are differences; seven cuts part a ring into seven
    "job2_measure_images": f"""
        WITH {SPANS_SQL},
        px AS (SELECT section_id, sum(CASE WHEN layer = 'cb' THEN x1 - x0 ELSE 0 END) AS cb, sum(CASE WHEN layer = 'gl' THEN x1 - x0 ELSE 0 END) AS gl,
                      sum(CASE WHEN layer = 'wm' THEN x1 - x0 ELSE 0 END) AS wm FROM span GROUP BY 1),
        seg AS (
          SELECT section_id, k, x, y, lead(x) OVER w AS x2, lead(y) OVER w AS y2
          FROM (SELECT section_id, k, 600.25 + r * a * 1.0625 AS x, 500.375 + r * b * 1.0625 AS y FROM size, corner WHERE layer = 'gl') WINDOW w AS (PARTITION BY section_id ORDER BY k)),
        n AS (SELECT *, greatest(1, CAST(ceil(sqrt((x2 - x) * (x2 - x) + (y2 - y) * (y2 - y)) / 0.25) AS BIGINT)) AS n FROM seg WHERE x2 IS NOT NULL),
        step AS (SELECT section_id, x, y, x2, y2, (CAST(s AS DOUBLE) / n + CAST(s + 1 AS DOUBLE) / n) / 2 AS m FROM (SELECT *, unnest(range(n)) AS s FROM n)),
        visited AS (SELECT section_id, count(*) AS px FROM (SELECT DISTINCT section_id, floor(x + m * (x2 - x)) AS a, floor(y + m * (y2 - y)) AS b FROM step) GROUP BY 1),
        line AS (SELECT section_id, sum(sqrt(((x2 - x) * 0.5) * ((x2 - x) * 0.5) + ((y2 - y) * 0.25) * ((y2 - y) * 0.25))) AS len FROM n GROUP BY 1),
        image AS (
          SELECT CAST(s_suppkey AS BIGINT) AS section_id, n_name AS nation,
                 concat_ws(',', CASE WHEN s_suppkey % 13 = 0 THEN 'DUPLICATE_CB' END, CASE WHEN s_suppkey % 11 = 0 THEN 'MISSING_PL' END) AS problems
          FROM supplier LEFT JOIN nation ON n_nationkey = s_nationkey)
        SELECT CAST(i.section_id AS VARCHAR) AS section_id, nation, problems, round(cb * 0.125, 6) AS cerebellum, round((cb - wm) * 0.125, 6) AS grey, round((gl - wm) * 0.125, 6) AS granular,
               round((cb - gl) * 0.125, 6) AS molecular, round(len, 6) AS purkinje_len, round(v.px * 0.125, 6) AS purkinje_area,
               CASE WHEN problems = '' THEN 'µm²' END AS area_unit, CASE WHEN problems = '' THEN 'µm' END AS length_unit,
               CASE WHEN problems = '' AND wm > 0 THEN 7 ELSE 0 END AS n_sections
        FROM image i LEFT JOIN px p ON p.section_id = i.section_id AND problems = '' LEFT JOIN line l ON l.section_id = i.section_id AND problems = ''
          LEFT JOIN visited v ON v.section_id = i.section_id AND problems = ''""",
}
