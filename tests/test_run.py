"""Whole runs: messages, files, and regions that measure the same again."""

from dataclasses import replace
from functools import reduce

import pytest
from pyspark.sql import functions as F

from foliometry.operators import classify, spans
from foliometry.plans.run import Options, pixels_of, run
from foliometry.plans.store import stored
from foliometry.sources.phantom import Phantom, phantoms

RING = Phantom(pinched=False)


@pytest.fixture(scope="module")
def done(spark, tmp_path_factory):
    cases = {"ribbon": Phantom(), "back": Phantom(counterclockwise=True), "eight": replace(RING, fissures=8)}
    made = [phantoms(spark, 1, what, f"{name}-") for name, what in cases.items()]
    images, rois = (reduce(lambda a, b: a.unionByName(b), part) for part in zip(*made, strict=True))
    ribbon = rois.where("section_id = 'ribbon-0'")
    # one with a cut less, one with other names and regions of an earlier run, one with two pieces, two that cannot be measured
    far = ribbon.withColumn("section_id", F.lit("far-0")).where("name <> 'FL4'")
    odd = ribbon.where("name IN ('CB', 'GL+WM', 'PL', 'FL1')").withColumn("section_id", F.lit("odd-0"))
    odd = odd.unionByName(odd.where("name = 'CB'").withColumn("name", F.explode(F.array(F.lit("scale bar"), F.lit("Section 1_Granular")))).withColumn("roi_idx", F.lit(50)))
    two = ribbon.withColumn("section_id", F.lit("two-0"))
    two = two.unionByName(two.where("name IN ('CB', 'GL+WM', 'PL')").withColumn("name", F.concat(F.lit("2"), "name")).withColumn("roi_idx", F.col("roi_idx") + 100))
    nameless = ribbon.where("name = 'CB'").withColumns({"section_id": F.lit("nameless-0"), "name": F.lit("x")})
    rois = reduce(lambda a, b: a.unionByName(b), (rois, far, odd, two, nameless))
    image = images.where("section_id = 'ribbon-0'")
    images = reduce(lambda a, b: a.unionByName(b), (images, *(image.withColumn("section_id", F.lit(f"{n}-0")) for n in ("far", "odd", "two", "nameless", "bare"))))
    folder = tmp_path_factory.mktemp("out")
    rois, images = stored(rois), stored(images)  # the images are made once, not in each stage that reads them
    drawn = spark.createDataFrame([("ribbon-0", 0, "arrow", None), ("ribbon-0", 1, "2Cb", None), ("bare-0", 0, "Purkinje", True)], "section_id string, z int, name string, marked boolean")
    return run(rois, images, Options(save_csv=True, save_workbook=True, file_name="all.xlsx", folder=str(folder)), drawn=drawn), rois, images, folder


def test_messages_and_problems(done):
    out, *_ = done
    said = {}
    for r in out.messages.orderBy("section_id", "seq").collect():
        said.setdefault(r.section_id.split("-")[0], []).append((r.level, r.code))
    # the ribbon's granular region reaches out of the section at its base, the ring's does not
    beyond = ("NOTE", "OUTSIDE_CB")
    assert said == {
        "ribbon": [beyond],
        "far": [beyond],
        "back": [beyond, ("WARNING", "DIRECTION")],
        "eight": [("WARNING", "JOINED")],
        "odd": [("NOTE", "SKIPPED"), ("NOTE", "IGNORED"), ("NOTE", "FISSURES_IGNORED"), beyond],
        "two": [("NOTE", "NO_WHITE_MATTER"), beyond, beyond, ("NOTE", "POOLED")],
        "nameless": [("NOTE", "IGNORED")],
    }
    assert {(r.section_id, r.code) for r in out.problems.collect()} == {("nameless-0", "NO_NAMES"), ("bare-0", "NO_REGIONS")}
    texts = {r.code: r.message for r in out.messages.where("section_id IN ('odd-0', 'two-0')").collect()}
    assert texts["SKIPPED"].startswith("Left out 1 ") and "scale bar" in texts["IGNORED"] and texts["NO_WHITE_MATTER"].startswith("[Instance 2] ")


def test_counts_are_observed_without_a_job(spark, done):
    out, *_ = done
    context = spark.sparkContext
    context.setJobGroup("counts", "")
    counts = out.counts()
    assert not context.statusTracker().getJobIdsForGroup("counts")
    levels = {r.level: r.n for r in out.messages.groupBy("level").agg(F.count(F.lit(1)).alias("n")).collect()}
    context.setLocalProperty("spark.jobGroup.id", None)
    assert counts == {"measured": 6, "pooled": 1, "problems": 2, "set_aside": 2, "notes": levels["NOTE"], "warnings": levels["WARNING"]}


def test_regions_measure_the_same_again_and_are_skipped(spark, done):
    out, rois, images, _ = done
    regions = out.regions
    px = {(r.section_id, r.name): r.px for r in pixels_of(regions).collect()}
    totals = {r.section_id: r for r in out.totals.collect()}
    assert (px["ribbon-0", "Grey Matter"], px["ribbon-0", "Granular Layer"], px["ribbon-0", "Molecular Layer"]) == (totals["ribbon-0"].grey, totals["ribbon-0"].granular, totals["ribbon-0"].molecular)
    parts = out.parts.where("section_id IN ('ribbon-0', 'eight-0')").collect()
    for p in parts:
        assert (px[p.section_id, f"{p.name}_Granular"], px[p.section_id, f"{p.name}_Molecular"]) == (p.granular, p.molecular)
    lines = regions.where("section_id = 'ribbon-0' AND kind = 'POLYLINE'").select("name", F.size(F.get("rings", F.lit(0))).alias("n")).collect()
    assert len(lines) == 8 and all(r.n >= 2 for r in lines)
    again = rois.unionByName(regions.withColumn("roi_idx", F.col("roi_idx") + 1000))
    ids = ["ribbon-0", "two-0"]
    a = classify.measurable(again.where(F.col("section_id").isin(ids))).select("section_id", "roi_idx", "category").collect()
    b = classify.measurable(rois.where(F.col("section_id").isin(ids))).select("section_id", "roi_idx", "category").collect()
    assert sorted(a) == sorted(b)


def test_tables_and_files(done):
    out, _, _, folder = done
    numbers = {r.measurement: r for r in out.table.where("section_id = 'ribbon-0'").collect()}
    assert numbers["Area"].grey == 337396 and numbers["Length"].grey is None and len(numbers) == 10
    assert out.grid.where("section_id = 'ribbon-0'").count() == 11
    assert (folder / "all.csv" / "section_id=ribbon-0").is_dir() and (folder / "ribbon-0" / "all.xlsx").is_file()
    info = {r.field: r.value for r in out.info.where("section_id = 'two-0'").collect()}
    assert info["Traced pieces"] == "2" and info["Piece 1"].startswith("7 fissure(s), 8 section(s)") and info["Piece 2"] == "not split into sections (no White Matter)"
    items = out.overlay.where("section_id = 'ribbon-0'").orderBy("z").collect()
    assert items[0].name == "arrow" and not items[0].marked and [r.z for r in items] == list(range(len(items)))
    items = items[1:]
    assert [r.name for r in items[4:11]] == [f"Fissure{i}" for i in range(1, 8)] and len(items) == 4 + 7 + 16 and all(r.marked for r in items)
    assert [r.name for r in out.overlay.where("section_id = 'bare-0'").collect()] == ["Purkinje"]
    # areas that are drawn have the pixels that were measured, labels lie in their sections
    areas = out.overlay.where("section_id = 'ribbon-0' AND kind = 'area' AND rings IS NOT NULL").select("section_id", "name", "rings")
    filled = spans.rasterize(areas, ["section_id", "name"]).collect()
    totals = out.totals.where("section_id = 'ribbon-0'").first()
    px = lambda name: sum(r.x1 - r.x0 for r in filled if r.name == name)
    assert (px("Grey Matter"), px("Granular Layer"), px("Molecular Layer")) == (totals.grey, totals.granular, totals.molecular)
    labels = [r for r in items if r.kind == "text"]
    assert [r.text for r in labels] == ["2Cb", "3Cb", "4/5Cb", "6Cb", "7Cb", "8Cb", "9Cb", "10Cb"] and all(r.rings is None and r.font >= 12 for r in labels)
    for label in labels:
        assert any(r.name == label.text and r.y == int(label.y) and r.x0 <= int(label.x) < r.x1 for r in filled)
    lines = [r for r in items if r.kind == "line"]
    assert len(lines) == 8 and all(len(r.rings[0]) >= 2 and r.x is None for r in lines)
    assert {r.path for f in out.files for r in f.collect()} >= {str(folder / "two-0" / "all.xlsx")}


def test_files_need_a_folder(spark, done):
    _, rois, images, _ = done
    with pytest.raises(ValueError):
        run(rois.where("section_id = 'ribbon-0'"), images.where("section_id = 'ribbon-0'"), Options(overlay=False, add_regions=False, save_csv=True))
