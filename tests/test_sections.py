"""Whole analyses of synthetic images, pooling, reports, files and the stream."""

import os
import zipfile
from dataclasses import replace
from decimal import ROUND_HALF_UP, Decimal
from functools import reduce
from xml.etree import ElementTree

import pytest
from pyspark.sql import functions as F

from foliometry.operators import clip, polyline, report, results
from foliometry.plans.analyze import KEYS, _most_sides, analyze, combine
from foliometry.plans.store import Scratch
from foliometry.sources import sinks, tables
from foliometry.sources.files import folder_name
from foliometry.sources.phantom import Phantom, phantoms
from foliometry.streaming.batches import measure_stream

RING = Phantom(pinched=False)
CASES = {
    "ribbon": Phantom(), "ring": RING, "base": replace(RING, base_fissure=True), "eight": replace(RING, fissures=8), "short": Phantom(radii=(376.0, 275.0)),
    "coarse": Phantom(line_step=15.0), "scaled": Phantom(pixel=0.5, unit="µm"), "back": Phantom(counterclockwise=True),
}
#: Pixels of granular and molecular layer of each section: regression values.
RIBBON = [(19779, 35424), (14402, 23406), (14417, 23426), (14420, 23424), (14420, 23424), (14417, 23426), (14402, 23406), (19779, 35424)]
NAMES = ["2Cb", "3Cb", "4/5Cb", "6Cb", "7Cb", "8Cb", "9Cb", "10Cb"]


@pytest.fixture(scope="module")
def measured(spark):
    made = [phantoms(spark, 1, what, f"{name}-") for name, what in CASES.items()]
    images, rois = (reduce(lambda a, b: a.unionByName(b), part) for part in zip(*made, strict=True))
    # two more pieces beside the ribbon: its own outline again, not split
    extra = rois.where("section_id = 'ribbon-0' AND name IN ('CB', 'GL+WM', 'PL')").withColumn("name", F.concat(F.lit("2"), "name")).withColumn("roi_idx", F.col("roi_idx") + 100).withColumn("section_id", F.lit("pieces-0"))
    first = rois.where("section_id = 'ribbon-0'").withColumn("section_id", F.lit("pieces-0"))
    rois = rois.unionByName(first).unionByName(extra)
    images = images.unionByName(images.where("section_id = 'ribbon-0'").withColumn("section_id", F.lit("pieces-0")))
    a = analyze(rois, images)
    parts = {}
    for r in a.parts.orderBy("section_id", "instance", "ord").collect():
        parts.setdefault((r.section_id.split("-")[0], r.instance), []).append(r)
    totals = {(r.section_id.split("-")[0], r.instance): r for r in a.totals.collect()}
    return a, totals, parts


def test_totals(measured):
    a, totals, _ = measured
    assert a.problems.count() == 0
    t = totals["ribbon", 1]
    assert (t.cerebellum, t.grey, t.granular, t.molecular) == (453660, 337396, 126036, 211360)
    assert t.purkinje_len == pytest.approx(1466.058, abs=1e-3)
    t = totals["ring", 1]
    assert (t.cerebellum, t.grey, t.granular, t.molecular) == (453660, 362836, 138196, 224640)
    scaled = totals["scaled", 1]
    assert scaled.grey == pytest.approx(337396 / 4) and scaled.purkinje_len == pytest.approx(1466.058 / 2, abs=1e-3) and (scaled.area_unit, scaled.length_unit) == ("µm²", "µm")
    assert totals["coarse", 1].purkinje_len == pytest.approx(1461.893, abs=1e-3)


def test_ribbon_has_eight_named_sections(measured):
    _, totals, parts = measured
    got = parts["ribbon", 1]
    assert [r.name for r in got] == NAMES and [(r.granular, r.molecular) for r in got] == RIBBON
    t = totals["ribbon", 1]
    assert sum(r.granular + r.molecular for r in got) == pytest.approx(t.grey, rel=0.002)
    assert sum(r.purkinje for r in got) == pytest.approx(t.purkinje_len, rel=0.002)
    assert all(r.purkinje == pytest.approx(183.257, rel=0.01) for r in got[1:-1])
    assert [r.name for r in parts["short", 1]] == NAMES and [r.name for r in parts["coarse", 1]] == NAMES


def test_ring_joins_its_ends(measured):
    _, totals, parts = measured
    ring = parts["ring", 1]
    assert totals["ring", 1].joined and [r.name for r in ring] == [f"Section {i}" for i in range(1, 8)]
    assert sorted((r.granular, r.molecular) for r in ring)[-1] == (51718, 84128)
    assert totals["eight", 1].joined and [r.name for r in parts["eight", 1]] == [f"Section {i}" for i in range(1, 9)]
    assert not totals["base", 1].joined and [r.name for r in parts["base", 1]] == NAMES


def test_direction_decides_the_numbering(measured):
    _, _, parts = measured
    assert [(r.granular, r.molecular) for r in parts["back", 1]] == RIBBON[::-1]


def test_pieces_are_pooled(spark, measured):
    a, totals, parts = measured
    assert ("pieces", 2) in totals and ("pieces", 2) not in parts
    pooled, rows = combine(a)
    t = {r.section_id: r for r in pooled.collect()}["pieces-0"]
    one, two = totals["pieces", 1], totals["pieces", 2]
    assert t.grey == one.grey + two.grey and t.purkinje_len == pytest.approx(one.purkinje_len + two.purkinje_len) and t.pieces == 2
    got = rows.where("section_id = 'pieces-0'").orderBy("ord").collect()
    assert [r.name for r in got] == [f"Section {i}" for i in range(1, 10)] and got[-1].granular == two.granular
    alone = rows.where("section_id = 'ribbon-0'").orderBy("ord").collect()
    assert [r.name for r in alone] == NAMES


def test_runs_follow_the_sections(measured):
    a, _, parts = measured
    runs = a.runs.where("section_id = 'ribbon-0'").groupBy("label", "run").agg(F.count(F.lit(1)).alias("n")).collect()
    assert {r.label for r in runs} == {r.label for r in parts["ribbon", 1]} and all(r.n >= 2 for r in runs)
    names = report.region_names(a.totals.select(*KEYS), a.parts, a.runs.select(*KEYS, "label", "run").distinct().join(a.parts.select(*KEYS, "label", "ord"), [*KEYS, "label"]))
    assert names.where("section_id = 'ribbon-0'").count() == 3 + 8 * 2 + len(runs)


#: Six measures and three sections of own choice; texts follow from them by rounding to four places.
MEASURES = (91.00005, 70.25, 31.5, 38.75, 12.3456789, None)
SECTIONS = [(f"part {k}", 10.5 + k / 7, 12.25 * k, k / 3) for k in (1, 2, 3)]


def shown(*values):
    return ",".join("" if v is None else str(Decimal(repr(v)).quantize(Decimal("0.0001"), ROUND_HALF_UP)) for v in values)


def test_grid_and_files(spark, tmp_path):
    totals = spark.createDataFrame([("s", *MEASURES, "µm²", "µm")], "section_id string, cerebellum double, grey double, granular double, molecular double, purkinje_len double, purkinje_area double, area_unit string, length_unit string")
    of = "section_id string, ord int, name string, granular double, molecular double, purkinje double"
    parts = spark.createDataFrame([("s", i, *row) for i, row in enumerate(SECTIONS, 1)], of)
    grid = report.results_grid(totals, parts)
    lines = [r.line for r in sinks.csv_lines(grid).orderBy("row_idx").collect()]
    assert lines[0].endswith("Purkinje (µm)") and lines[1] == f"Area,{shown(*MEASURES[:4], MEASURES[5])}" and lines[2] == f"Length,,,,,{shown(MEASURES[4])}"
    assert lines[3:] == [f"{name},,,{shown(*row)}" for name, *row in SECTIONS]
    sinks.write_csv(grid, str(tmp_path / "csv"))
    assert {r.value for r in spark.read.text(str(tmp_path / "csv")).collect()} == set(lines)
    info = spark.createDataFrame([("s", 0, "Image", "a <b>\x01.tif")], "section_id string, seq int, field string, value string")
    said = spark.createDataFrame([("s", 0, "WARNING", "look \ufffe here")], "section_id string, seq int, level string, message string")
    books = sinks.workbooks(totals, parts, info, said)
    for _ in range(2):  # a second run replaces the file
        sinks.write_workbooks(books, str(tmp_path), "book")
    (written,) = sinks.workbook_paths(totals, str(tmp_path), "book").collect()
    assert written.path == str(tmp_path / "s" / "book.xlsx") and [p.name for p in (tmp_path / "s").iterdir()] == ["book.xlsx"]
    with zipfile.ZipFile(written.path) as z:
        parts_of = {n: ElementTree.fromstring(z.read(n)) for n in z.namelist()}
    main = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"

    def cells(i):
        for c in parts_of[f"xl/worksheets/sheet{i}.xml"].iter(f"{main}c"):
            text, value = c.find(f"{main}is/{main}t"), c.find(f"{main}v")
            yield c.get("r"), list(sinks.LOOKS)[int(c.get("s"))], text.text if text is not None else None if value is None else float(value.text)

    table, about = ({r: (look, v) for r, look, v in cells(i)} for i in (1, 2))
    assert table["A1"] == ("header", "Measurement") and table["F1"] == ("header", "Purkinje (µm)")
    assert table["B2"] == ("bold number", MEASURES[0]) and table["F3"] == ("bold number", MEASURES[4]) and table["B3"] == ("bold", None) and "F2" in table
    assert table["A4"] == ("italic", SECTIONS[0][0]) and table["D4"] == ("number", SECTIONS[0][1]) and "B4" not in table
    assert about == {"A1": ("header", "Field"), "B1": ("header", "Value"), "A2": ("bold", "Image"), "B2": ("wrapped", "a <b>.tif"), "A3": ("bold", "Warning"), "B3": ("wrapped", "look  here")}
    pane = parts_of["xl/worksheets/sheet1.xml"].find(f"{main}sheetViews/{main}sheetView/{main}pane")
    assert (pane.get("xSplit"), pane.get("ySplit"), pane.get("state")) == ("1", "1", "frozen")
    assert len(parts_of["xl/styles.xml"].find(f"{main}cellXfs")) == 7 and parts_of["xl/styles.xml"].find(f"{main}numFmts/{main}numFmt").get("formatCode") == "0.0000"
    assert [sinks.reference(0, c) for c in (0, 25, 26, 701, 702)] == ["A1", "Z1", "AA1", "ZZ1", "AAA1"]


def test_run_information(spark):
    image = spark.createDataFrame([("s", "t.tif", None, 6000, 5000, 0.5, 0.5, "µm")], "section_id string, title string, file string, width int, height int, px_w double, px_h double, unit string")
    pieces = spark.createDataFrame([("s", 1, 8, True, 7, False, False), ("s", 2, 0, False, 0, False, False)], "section_id string, instance int, sections int, has_wm boolean, fissures int, ring boolean, joined boolean")
    got = [(r.field, r.value) for r in report.run_info(image, pieces, spark.createDataFrame([], "section_id string, n long")).orderBy("seq").collect()]
    assert got == [("Image", "t.tif"), ("Image size", "6000 × 5000 pixels"), ("Pixel size", "0.5 × 0.5 µm"), ("Traced pieces", "2"), ("Piece 1", "7 fissure(s), 8 section(s); grey matter pinched open at the peduncle"), ("Piece 2", "not split into sections (no White Matter)"), ("Warnings", "0")]


def test_overlay(spark):
    pieces = spark.createDataFrame([("s", 1)], "section_id string, instance int")
    cuts = spark.createDataFrame([("s", 1, 4, 9.0), ("s", 1, 5, 2.0)], "section_id string, instance int, cut_id int, arc double")
    parts = spark.createDataFrame([("s", 1, i, f"Section {i}") for i in range(1, 14)], "section_id string, instance int, ord int, name string")
    got = report.overlay_items(pieces, cuts, parts).orderBy("z").collect()
    assert [r.name for r in got[:6]] == ["Grey Matter", "Granular Layer", "Molecular Layer", "Purkinje", "Fissure1", "Fissure2"] and len(got) == 6 + 26
    fills = [r.fill for r in got if r.kind == "area"][3:]
    assert fills[0] == "#FF64503C" == fills[12]
    assert [r.name for r in report.overlay_items(pieces, cuts, parts, fills=False).collect()][-1] == "Fissure2"
    flat = pieces.withColumn("grey", F.lit(2.0)).withColumn("granular", F.lit(0.0)).withColumn("molecular", F.lit(None).cast("double"))
    assert [r.name for r in report.overlay_items(flat, cuts, parts).orderBy("z").collect()][:3] == ["Grey Matter", "Purkinje", "Fissure1"]
    old = [("s", 4, "Grey Matter", False), ("s", 3, "[2] Purkinje", None), ("s", 2, "grey matter", False), ("s", 1, "mine", False), ("s", 0, "x", True), ("t", 0, "Section 3", True), ("t", 9, None, None)]
    old = spark.createDataFrame(old, "section_id string, z int, name string, marked boolean")
    merged = report.merged_overlay(old, pieces.select("section_id", F.lit(7).alias("z"), F.lit("Grey Matter").alias("name"), F.lit("area").alias("kind")))
    assert [tuple(r) for r in merged.select("section_id", "z", "name", "marked", "kind").orderBy("section_id", "z").collect()] == [
        ("s", 0, "mine", False, None), ("s", 1, "grey matter", False, None), ("s", 2, "Grey Matter", True, "area"), ("t", 0, "Section 3", True, None), ("t", 1, None, False, None),
    ]
    assert spark.range(1).select(report.font_size(F.lit(6000), F.lit(5000)).alias("a"), report.font_size(F.lit(100), F.lit(90)).alias("b")).first() == (125, 12)


def test_order_and_coverage(spark):
    samples = spark.createDataFrame([(1, k, float(k + 1), lab) for k, lab in enumerate([0, 0, 0, 0, None, 1, 0])], "p int, k int, arc double, label int")
    assert {r.label: r.order_arc for r in results.line_order(samples, ["p"]).collect()} == {0: 3.0, 1: 6.0}
    ends = results.ends_joined(samples, ["p"]).first()
    assert (ends.n_labels, ends.first_label, ends.last_label, ends.joined) == (2, 0, 0, True)
    totals = spark.createDataFrame([(1, 100.0, 50.0), (2, 100.0, 50.0)], "p int, grey double, purkinje_len double")
    parts = spark.createDataFrame([(1, 40.0, 58.0, 50.0), (2, 40.0, 59.5, 40.0)], "p int, granular double, molecular double, purkinje double")
    assert sorted((r.p, r.level, round(r.percent, 6)) for r in results.coverage(totals, parts, ["p"]).collect()) == [(1, "WARNING", 98.0), (2, "NOTE", 20.0)]
    sweeps = spark.createDataFrame([(1, -120.0), (2, -60.0)], "p int, degrees double")
    assert [r.p for r in results.reversed_lines(sweeps, spark.createDataFrame([(1,), (1,), (2,), (2,)], "p int"), ["p"]).collect()] == [1]


def test_stream_of_files(spark, tmp_path):
    images, rois = phantoms(spark, 1, Phantom(pinched=False, fissures=2), "f")
    rois.coalesce(1).write.parquet(str(tmp_path / "in"))
    query = measure_stream(spark, str(tmp_path / "in"), images, str(tmp_path / "out"), str(tmp_path / "state"))
    query.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out/totals")).first().grey == 362836
    assert spark.read.parquet(str(tmp_path / "out/parts")).count() == 2
    assert spark.read.parquet(str(tmp_path / "out/problems")).count() == 0
    scratch = spark.conf.get("spark.checkpoint.dir").removeprefix("file://")
    before = set(os.listdir(f"{scratch}/foliometry"))
    # the next file has an image without its line: it is among the problems, and no table between stages is left
    more = rois.where("name <> 'PL'").withColumn("section_id", F.lit("bad"))
    more.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    bad = images.unionByName(images.withColumn("section_id", F.lit("bad")))
    measure_stream(spark, str(tmp_path / "in"), bad, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    found = spark.read.parquet(str(tmp_path / "out/problems")).where("section_id = 'bad'").collect()
    assert [r.code for r in found] == ["MISSING_PL"] and spark.read.parquet(str(tmp_path / "out/totals")).count() == 1
    assert set(os.listdir(f"{scratch}/foliometry")) == before


def test_files_of_other_sections_stay(spark, tmp_path):
    of = lambda *ids: spark.createDataFrame([(i, 0, *["x"] * 6) for i in ids], f"section_id string, row_idx int, {', '.join(f'{c} string' for c in sinks.GRID)}")
    for ids in (("a", "b"), ("b",), ("c/d",)):
        sinks.write_csv(of(*ids), str(tmp_path / "all.csv"))
    assert {r.section_id for r in spark.read.text(str(tmp_path / "all.csv")).collect()} == {"a", "b", "c/d"}
    names = ["a/b", "a_b", "a%2Fb", "..", ".", "", "...", "a.b", "é", "a b", "%", "%2E"]
    made = [folder_name(n) for n in names]
    assert len(set(made)) == len(names) and not any("/" in m or m in ("", ".", "..") for m in made)
    books = spark.createDataFrame([(n, b"x") for n in ("a/b", "a_b", "..")], "section_id string, content binary")
    sinks.write_workbooks(books, str(tmp_path / "books"), "all")
    paths = [r.path for r in sinks.workbook_paths(books, str(tmp_path / "books"), "all").collect()]
    assert len(set(paths)) == 3 and all(os.path.realpath(p).startswith(str(tmp_path / "books")) for p in paths)


def test_a_failed_write_leaves_the_files_as_they_were(spark, tmp_path):
    of = lambda *rows: spark.createDataFrame(rows, "section_id string, content binary").repartition(4, "section_id")
    put = lambda df: sinks.write_workbooks(df, str(tmp_path), "x")
    put(of(("a", b"old"), ("b", b"old"), (None, b"lost"), ("c", None)))
    broken = of(("a", b"new"), ("b", b"new"), ("d", b"new"))
    with pytest.raises(Exception, match="broken on purpose"):
        put(broken.withColumn("content", F.when(F.col("section_id") == "b", F.raise_error(F.lit("broken on purpose")).cast("binary")).otherwise(F.col("content"))))
    files = lambda: {str(p.relative_to(tmp_path)): p.read_bytes() for p in tmp_path.rglob("*") if p.is_file()}
    assert files() == {"a/x.xlsx": b"old", "b/x.xlsx": b"old"} and {p.name for p in tmp_path.iterdir()} == {"a", "b"}
    put(broken)
    assert files() == {"a/x.xlsx": b"new", "b/x.xlsx": b"new", "d/x.xlsx": b"new"}
    put(of())
    with pytest.raises(Exception, match="append"):
        broken.write.format("section_files").mode("overwrite").option("folder", str(tmp_path)).option("file", "x").save()


def test_rows_that_few_keys_grow_to_are_not_broadcast(spark):
    """Spark takes outlines and cuts for as small as their suppliers' keys."""
    suppliers = spark.read.parquet("/root/testdata/sf0.001/supplier.parquet")
    joined = tables.cuts_of(suppliers).join(tables.octagons_of(suppliers).drop("rings"), "section_id")
    assert "BroadcastHashJoin" not in joined._jdf.queryExecution().executedPlan().toString()


def test_a_plan_walks_and_counts_what_it_needs_once(spark, monkeypatch):
    """One query counts the sides for all calls of nearest, the stretches are read by one only, and samples are placed once."""
    counted, walked, placed = [], [], []
    for module, name, seen in ((polyline, "nearest", counted), (clip, "stretches", walked), (polyline, "points_at", placed)):
        plain = getattr(module, name)
        monkeypatch.setattr(module, name, lambda *a, plain=plain, seen=seen, **k: seen.append((a, k)) or plain(*a, **k))
    images, rois = phantoms(spark, 2)
    kept = []
    with Scratch(spark) as scratch:
        got = analyze(rois, images, lambda df: kept.append(df) or scratch(df))
        assert got.parts.count() == 16
        assert len(counted) == 5 and all(a[-1] is None for a, _ in counted) and len(walked) == 1
        samples = [df for df in kept if {"k", "arc", "label"} <= set(df.columns)]
        assert len(samples) == 1 and samples[0]._jdf.queryExecution().optimizedPlan().toString().count("Join") == 1
        assert not any({"s0", "row"} <= set(df.columns) for df in kept)
        monkeypatch.setattr(polyline, "KERNEL_SIDES", 700)  # outlines beyond the bound are told
        assert _most_sides(got.good) == 700
