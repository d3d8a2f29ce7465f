"""Names, pieces, problems and text functions."""

import pytest
from pyspark.sql import functions as F

from foliometry.functions import text
from foliometry.operators import classify

#: Abbreviations and words that the naming convention fixes, with own additions around them.
NAMES = {
    ("CEREBELLUM", 1): ["CB", "the cerebellum", "left-cb", "cb (traced twice)"],
    ("CEREBELLUM", 7): ["7 Cerebellum", "0007cb"],
    ("GRANULAR_WM", 1): ["GL+WM", "glwm", "outer GL-WM", "wm below gl", "granular, rough"],
    ("GRANULAR_WM", 12): ["12gl_wm"],
    ("WHITE_MATTER", 1): ["WM", "white core", "wm.v2"],
    ("PURKINJE", 1): ["PL", "Purkinje cells", "redrawn pl"],
    ("PURKINJE", 3): ["3pl"],
    ("FISSURE", 1): ["FL", "fl7", "primary fissure", "deep-fl_2"],
    (None, None): ["floor", "cbm", "scalebar", "98765 pl", "00 wm", "", "42"],
}
OUTPUTS = ["3Cb_Granular", "Section 11_Purkinje", "[4] anything at all", "  9cb_molecular", "4/5CB_purkinje"]
ROI = "section_id string, roi_idx int, name string, kind string, props map<string,string>"


def rois(spark, *rows):
    return spark.createDataFrame([(s, i, n, k, p) for i, (s, n, k, p) in enumerate(rows)], ROI)


def test_roles_and_pieces(spark):
    rows = [("s", n, "POLYGON", None) for names in NAMES.values() for n in names]
    got = [(r.category, r.instance) for r in classify.classified(rois(spark, *rows)).orderBy("roi_idx").collect()]
    assert got == [key for key, names in NAMES.items() for _ in names]


def test_outputs_of_earlier_runs_are_skipped(spark):
    rows = [("s", n, "POLYGON", None) for n in OUTPUTS] + [("s", "CB", "POLYGON", {classify.OUTPUT_PROPERTY: "true"}), ("s", "CB", "POLYGON", {"other": "true"}), ("s", None, "POLYGON", None)]
    got = [r.output for r in classify.classified(rois(spark, *rows)).orderBy("roi_idx").collect()]
    assert got == [True] * (len(OUTPUTS) + 1) + [False, False]
    other = [r.output for r in classify.classified(rois(spark, *rows), marker="other").orderBy("roi_idx").collect()]
    assert other == [True] * len(OUTPUTS) + [False, True, False]
    assert classify.skipped_outputs(rois(spark, *rows)).first().n == len(OUTPUTS) + 1


def test_ignored_names_are_listed_up_to_ten(spark):
    few = classify.ignored_names(rois(spark, ("a", "x", "POLYGON", None), ("a", "", "POLYGON", None))).first()
    many = classify.ignored_names(rois(spark, *(("b", f"n{i}", "POLYGON", None) for i in range(12)))).first()
    assert (few.n, few.shown) == (2, "x, (unnamed)")
    assert many.n == 12 and many.shown == ", ".join(f"n{i}" for i in range(10)) + ", …"


def test_problems_come_all_at_once(spark):
    rows = [("bad", "CB", "POLYLINE", None), ("bad", "PL", "POLYGON", None), ("bad", "WM", "POLYGON", None), ("bad", "WM", "POLYGON", None), ("bad", "2CB", "POLYGON", None)]
    rows += [("good", n, k, None) for n, k in (("CB", "POLYGON"), ("GLWM", "COMPOSITE"), ("PL", "LINE"))]
    rows += [("lines", n, k, None) for n, k in (("CB", "POLYGON"), ("GLWM", "OVAL"), ("WM", "POLYGON"), ("PL", "LINE"), ("FL1", "POLYGON"))]
    got = {(r.section_id, r.instance, r.code): r for r in classify.problems(rois(spark, *rows)).collect()}
    assert set(got) == {("bad", 1, c) for c in ("CB_NOT_AREA", "MISSING_GL", "PL_NOT_LINE", "DUPLICATE_WM", "NO_FISSURES")} | {("bad", 2, "MISSING_GL"), ("bad", 2, "MISSING_PL"), ("bad", None, "SEVERAL_PIECES"), ("lines", 1, "FISSURE_NOT_LINE")}
    assert got["bad", 2, "MISSING_PL"].message == "[Instance 2] The Purkinje line is missing (for this piece, names begin with 2)."
    assert got["lines", 1, "FISSURE_NOT_LINE"].message == 'A fissure line is a closed area: "FL1".'
    assert got["bad", 1, "DUPLICATE_WM"].message == '[Instance 1] More than one region matches White Matter: "WM" and "WM".'
    assert {r.section_id for r in classify.measurable(rois(spark, *rows)).collect()} == {"good"}


def test_lines_without_points_are_problems(spark):
    none, empty, there = None, [[]], [[(1.0, 2.0)]]
    rows = [("a", "CB", "POLYGON", there), ("a", "GLWM", "POLYGON", there), ("a", "WM", "POLYGON", there), ("a", "PL", "LINE", none), ("a", "FL1", "POLYLINE", empty), ("a", "FL2", "POLYLINE", []), ("a", "FL3", "LINE", there)]
    rows += [("b", "CB", "POLYGON", there), ("b", "GLWM", "POLYGON", there), ("b", "PL", "LINE", there), ("b", "FL1", "LINE", empty)]
    rows = [(s, i, n, k, None, r) for i, (s, n, k, r) in enumerate(rows)]
    df = spark.createDataFrame(rows, f"{ROI}, rings array<array<struct<x: double, y: double>>>")
    got = sorted((r.section_id, r.code, r.message) for r in classify.problems(df).collect())
    assert got == [("a", "FISSURE_UNREADABLE", f'The fissure line "FL{i}" has no points.') for i in (1, 2)] + [("a", "PL_UNREADABLE", 'The Purkinje line "PL" has no points.')]
    assert {r.section_id for r in classify.measurable(df).collect()} == {"b"}  # without white matter its fissure is not used


def test_each_extra_region_is_a_problem_of_its_own(spark):
    rows = [("s", n, "POLYGON", None) for n in ("CB", "cb again", "GL+WM", "Granular Layer", "cerebellum third")] + [("s", "PL", "LINE", None)]
    got = [r.message for r in classify.problems(rois(spark, *rows)).orderBy("code", "message").collect()]
    assert got == [
        'More than one region matches Cerebellum: "CB" and "cb again".',
        'More than one region matches Cerebellum: "cb again" and "cerebellum third".',
        f'More than one region matches Granular+WM: "GL+WM" and "Granular Layer"{classify.LAYER_HINT}.',
    ]


def test_images_without_names_or_regions_are_problems(spark):
    images = spark.createDataFrame([("named",), ("nameless",), ("bare",)], "section_id string")
    rows = [("named", n, k, None) for n, k in (("CB", "POLYGON"), ("GLWM", "POLYGON"), ("PL", "LINE"))] + [("nameless", n, "POLYGON", None) for n in ("x", "y", "[1] CB")]
    got = {(r.section_id, r.code, r.n, r.instance) for r in classify.problems(rois(spark, *rows), images).collect()}
    assert got == {("nameless", "NO_NAMES", 3, None), ("bare", "NO_REGIONS", 0, None)}


def test_fissures_are_required_only_with_white_matter_in_piece_one(spark):
    rows = [("s", n, "POLYGON", None) for n in ("CB", "WM", "2CB", "2WM", "3CB")] + [("s", "3FL1", "LINE", None)]
    got = {r.instance: (r.used, r.required, r.note) for r in classify.fissure_requirement(rois(spark, *rows)).collect()}
    assert got == {1: (0, True, None), 2: (0, False, "not split: no fissures"), 3: (0, False, "fissures ignored: no White Matter")}


@pytest.mark.parametrize(("typed", "base"), [(None, "Output"), ("\t ", "Output"), (".xlsx", "Output"), (" slide 4 left ", "slide 4 left"), ("day1\\day2?", "day1_day2_"), ("areas.CSV", "areas"), (". final. ", "final")])
def test_file_base(spark, typed, base):
    assert spark.range(1).select(text.file_base(F.lit(typed).cast("string")).alias("b")).first().b == base


def test_numbers_and_cells(spark):
    one = spark.range(1)
    show = lambda c: one.select(c.alias("v")).first().v
    assert [show(text.fixed4(F.lit(x))) for x in (0.00005, 2718.28185, float("nan"), float("inf"), None)][:4] == ["0.0001", "2718.2819", None, None]
    assert [show(text.short_number(F.lit(x))) for x in (0.5, 2.0, 0.1234567)] == ["0.5", "2", "0.123457"]
    assert [show(text.csv_cell(F.lit(x).cast("string"))) for x in ("a", 'a"b', "a,b", None)] == ["a", '"a""b"', '"a,b"', ""]
    labels = [show(text.section_labels(F.lit(n), F.lit(2), F.lit(j))) for n, j in ((8, False), (8, True), (7, False))]
    assert labels == ["3Cb", "Section 2", "Section 2"]
