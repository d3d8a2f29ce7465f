"""Queries over names: roles, pieces and what keeps a section from being measured."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import FISSURE, GRANULAR, file_base, word
from ..operators import classify
from ..sources.tables import NAMED_SQL, named_rois, table

_ROLE = rf"""
role AS (
  SELECT *, CASE WHEN NOT output THEN CASE
      WHEN regexp_matches(n, '{FISSURE}') THEN 'FISSURE'
      WHEN n LIKE '%purkinje%' OR regexp_matches(n, '{word("pl")}') THEN 'PURKINJE'
      WHEN regexp_matches(n, '{GRANULAR}') OR (regexp_matches(n, '{word("gl")}') AND regexp_matches(n, '{word("wm")}')) THEN 'GRANULAR_WM'
      WHEN n LIKE '%cerebellum%' OR regexp_matches(n, '{word("cb")}') THEN 'CEREBELLUM'
      WHEN n LIKE '%white%' OR regexp_matches(n, '{word("wm")}') THEN 'WHITE_MATTER' END END AS found
  FROM (SELECT *, regexp_replace(lower(name), '^\p{{Nd}}*', '') AS n, regexp_extract(lower(name), '^(\p{{Nd}}*)', 1) AS digits,
               regexp_matches(trim(name), '^(\[\d+\] .*|(\d+(/\d+)?Cb|Section \d+)_(Granular|Molecular|Purkinje))$', 'i') AS output FROM named)),
known AS (
  SELECT *, CASE WHEN digits = '' THEN 1 WHEN regexp_matches(digits, '^[0-9]{{1,4}}$') AND CAST(digits AS BIGINT) > 0 THEN CAST(digits AS INTEGER) END AS num FROM role),
cls AS (
  SELECT section_id, roi_idx, name, kind, output, CASE WHEN num IS NOT NULL THEN found END AS category,
         CASE WHEN found IS NOT NULL THEN num END AS instance FROM known)"""
_PIECE = """
ranked AS (
  SELECT *, lag(name) OVER (PARTITION BY section_id, instance, category ORDER BY roi_idx) AS before,
         kind IN ('POLYGON', 'RECTANGLE', 'OVAL', 'COMPOSITE') AS area FROM cls WHERE category IS NOT NULL),
piece AS (
  SELECT *, count(*) OVER (PARTITION BY section_id) AS n_inst FROM (
    SELECT section_id, instance, {roles},
           count(*) FILTER (category = 'FISSURE') AS fissures, count(*) FILTER (category = 'FISSURE' AND area) AS fissure_areas,
           string_agg(name, '", "' ORDER BY roi_idx) FILTER (category = 'FISSURE' AND area) AS fissure_names
    FROM ranked GROUP BY ALL))"""
_PIECE = _PIECE.replace("{roles}", ", ".join(f"arg_max(area, roi_idx) FILTER (category = '{role}') AS {s}, arg_max(name, roi_idx) FILTER (category = '{role}') AS {s}_name" for role, s in classify.SINGLE.items()))


def _named(f, *columns):
    return lambda spark, sf_dir: f(named_rois(spark, sf_dir)).select(*columns)


def file_base_name(spark, sf_dir):
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("long").alias("k"))
    name = F.concat(F.get(F.array(*map(F.lit, (" ", "", ".", "a/b:"))), (F.col("k") % 4).cast("int")), F.when(F.col("k") % 5 == 0, "").otherwise(F.col("k").cast("string")), F.get(F.array(*map(F.lit, (".csv", ".XLSX", " ", "?", ".csv.xlsx"))), (F.col("k") % 5).cast("int")))
    return p.select("k", name.alias("typed")).select("k", file_base(F.col("typed")).alias("base"))


QUERIES = {
    "classify_roi_names": _named(classify.classified, "section_id", "roi_idx", "name", "output", "category", "instance"),
    "skip_outputs": _named(classify.skipped_outputs, "section_id", "n"),
    "ignored_names": _named(classify.ignored_names, "section_id", "n", "shown"),
    "validation_problems": _named(classify.problems, "section_id", "instance", "code", "n", "message"),
    "fissure_requirement": _named(classify.fissure_requirement, "section_id", "instance", "fissures", "used", "required", "note"),
    "measurable_sections": lambda spark, sf_dir: classify.measurable(named_rois(spark, sf_dir)).select("section_id", "roi_idx", "category", "instance"),
    "file_base_name": file_base_name,
}

_HINT = f"CASE WHEN n_inst > 1 THEN replace('{classify.NUMBER_HINT}', '%s', CAST(instance AS VARCHAR)) END"
#: code -> (how often, what the message is about)
_CHECKS = {
    **{f"MISSING_{s.upper()}": (f"CAST({s} IS NULL AS BIGINT)", _HINT) for s in ("cb", "gl", "pl")},
    **{f"{s.upper()}_NOT_AREA": (f"CAST(coalesce(NOT {s}, false) AS BIGINT)", f"{s}_name") for s in ("cb", "gl", "wm")},
    "PL_NOT_LINE": ("CAST(coalesce(pl, false) AS BIGINT)", "pl_name"),
    "NO_FISSURES": ("CAST(instance = 1 AND wm IS NOT NULL AND fissures = 0 AS BIGINT)", "NULL"),
    "FISSURE_NOT_LINE": ("CASE WHEN wm IS NOT NULL THEN fissure_areas ELSE 0 END", "fissure_names"),
}
_LAYERS = ", ".join(f"'{x}'" for x in classify.WHOLE_LAYERS)
_TEXTS = ", ".join(f"('{code}', '{text}')" for code, text in classify.MESSAGES.items())
_PROBLEM = f"""
own AS (
  {" UNION ALL ".join(f"SELECT section_id, instance, n_inst, '{c}' AS code, {n} AS n, {about} AS about FROM piece WHERE {n} > 0" for c, (n, about) in _CHECKS.items())}
  UNION ALL SELECT section_id, r.instance, p.n_inst, CASE r.category {" ".join(f"WHEN '{role}' THEN 'DUPLICATE_{s.upper()}'" for role, s in classify.SINGLE.items())} END, 1,
      '"' || before || '" and "' || name || '"' || CASE WHEN lower(trim(before)) IN ({_LAYERS}) OR lower(trim(name)) IN ({_LAYERS}) THEN '{classify.LAYER_HINT}' ELSE '' END
    FROM ranked r JOIN piece p USING (section_id, instance) WHERE before IS NOT NULL AND r.category <> 'FISSURE'),
every AS (
  SELECT * FROM own
  UNION ALL SELECT DISTINCT section_id, CAST(NULL AS INTEGER), 1, 'SEVERAL_PIECES', n_inst, CAST(n_inst AS VARCHAR) FROM own WHERE n_inst > 1
  UNION ALL SELECT section_id, CAST(NULL AS INTEGER), 1, 'NO_NAMES', count(*), NULL FROM cls GROUP BY section_id HAVING count(category) = 0),
said(code, text) AS (VALUES {_TEXTS}),
bad AS (
  SELECT section_id, instance, code, n, CASE WHEN instance IS NOT NULL AND n_inst > 1 THEN '[Instance ' || instance || '] ' ELSE '' END || replace(text, '%s', coalesce(about, '')) AS message
  FROM every JOIN said USING (code))"""
_HEAD = f"WITH {NAMED_SQL}, {_ROLE}"

ORACLES = {
    "classify_roi_names": f"{_HEAD} SELECT section_id, roi_idx, name, output, category, CASE WHEN category IS NOT NULL THEN instance END AS instance FROM cls",
    "skip_outputs": f"{_HEAD} SELECT section_id, count(*) AS n FROM cls WHERE output GROUP BY 1",
    "ignored_names": f"""{_HEAD} SELECT section_id, count(*) AS n, string_agg(CASE WHEN name = '' THEN '(unnamed)' ELSE name END, ', ' ORDER BY roi_idx) AS shown
        FROM cls WHERE NOT output AND category IS NULL GROUP BY 1""",
    "validation_problems": f"{_HEAD}, {_PIECE}, {_PROBLEM} SELECT * FROM bad",
    "fissure_requirement": f"""{_HEAD}, {_PIECE} SELECT section_id, instance, fissures, CASE WHEN wm IS NOT NULL THEN fissures ELSE 0 END AS used,
        instance = 1 AND wm IS NOT NULL AS required,
        CASE WHEN wm IS NULL AND fissures > 0 THEN 'fissures ignored: no White Matter' WHEN wm IS NULL THEN 'not split: no White Matter'
             WHEN fissures = 0 AND instance <> 1 THEN 'not split: no fissures' END AS note FROM piece""",
    "measurable_sections": f"{_HEAD}, {_PIECE}, {_PROBLEM} SELECT section_id, roi_idx, category, instance FROM cls WHERE category IS NOT NULL AND section_id NOT IN (SELECT section_id FROM bad)",
    "file_base_name": r"""
        WITH t AS (SELECT CAST(p_partkey AS BIGINT) AS k, ([' ', '', '.', 'a/b:'])[CAST(p_partkey % 4 + 1 AS INTEGER)] || CASE WHEN p_partkey % 5 = 0 THEN '' ELSE CAST(p_partkey AS VARCHAR) END
                     || (['.csv', '.XLSX', ' ', '?', '.csv.xlsx'])[CAST(p_partkey % 5 + 1 AS INTEGER)] AS typed FROM part),
        a AS (SELECT k, regexp_replace(trim(typed), '\.(csv|xlsx)$', '', 'i') AS b FROM t),
        b AS (SELECT k, regexp_replace(regexp_replace(b, '[\\/:*?"<>|\x00-\x1f\x7f]', '_', 'g'), '^[.\s]+|[.\s]+$', '', 'g') AS b FROM a)
        SELECT k, CASE WHEN b = '' THEN 'Output' ELSE b END AS base FROM b""",
}
