"""The jobs over growing copies of small inputs, run again, and after a failure."""

import glob
import os
import shutil
import time

import pytest
from pyspark.sql import functions as F

from foliometry.operators import classify
from jobs import measure_images, name_audit, settings

LISTS = "doc_id long, text string, lang string, source string, n_chars long"
FIRST = [
    (1, "CB\nGL+WM | PL\nFL1\r\nfissure 2\nWM", "en", "lab a", 0),
    (2, "2CB\nnotes\nnotes\n\n[1] Grey Matter\nSection 3_Purkinje\n0pl", "en", "lab a", 0),
    (3, None, None, None, None),
    (4, "", "de", "lab/b=1", 0),
    (5, "\n".join(f"spot {i}" for i in range(12)), "de", "lab/b=1", 0),
]
LATER = [(6, "cerebellum|white matter", "fr", "lab c", 0), (1, "PL", "fr", "lab a", 0)]


def put(spark, rows, schema, path, name):
    made = f"{path}-{name}"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(made)
    os.makedirs(path, exist_ok=True)
    (part,) = glob.glob(f"{made}/part-*.parquet")
    shutil.copy(part, f"{path}/{name}.parquet")


def lists(spark, out):
    return sorted((r.asDict() for r in name_audit.result(spark, out).drop("batch").collect()), key=str)


@pytest.fixture()
def at(tmp_path):
    return {k: str(tmp_path / k) for k in ("lists", "out", "seen")}


def test_lists_are_judged(spark, at):
    put(spark, FIRST, LISTS, at["lists"], "first")
    assert name_audit.run(spark, at["lists"], at["out"], at["seen"]) == 5
    rows = {r["doc_id"]: r for r in lists(spark, at["out"])}
    whole, odd, none, empty, many = (rows[i] for i in (1, 2, 3, 4, 5))
    assert (whole["n_names"], whole["n_fissure"], whole["n_white_matter"], whole["n_ignored"], whole["missing"], whole["shown"]) == (6, 2, 1, 0, "", "")
    assert (odd["n_names"], odd["n_unnamed"], odd["n_output"], odd["n_ignored"], odd["n_twice"], odd["n_cerebellum"]) == (7, 1, 2, 4, 1, 1)
    assert odd["shown"] == "notes, notes, (unnamed), 0pl" and odd["missing"] == "GRANULAR_WM,PURKINJE"
    assert none["n_names"] == empty["n_names"] == 0 and none["source"] is None and empty["source"] == "lab/b=1"
    assert many["n_ignored"] == 12 and many["shown"] == ", ".join(f"spot {i}" for i in range(10)) + ", …"


def test_a_long_list_takes_time_as_it_is_long(spark, at):
    n = 60_000  # comparing each name with each other takes over half a minute
    names = [f"spot {i} of the plate" for i in range(n)] + ["PL", "spot 7 of the plate"]
    rows = spark.createDataFrame([(1, "\n".join(names), "en", "lab a", 0)], LISTS)
    began = time.time()
    (got,) = name_audit.audited(rows, settings.settings("name_audit")).collect()
    assert time.time() - began < 15
    assert (got["n_names"], got["n_twice"], got["n_ignored"], got["n_purkinje"], got["missing"]) == (n + 2, 1, n + 1, 1, "CEREBELLUM,GRANULAR_WM")


def test_names_whose_patterns_are_not_tried_have_no_role(spark):
    tokens = ["fl", "pl", "gl", "wm", "cb", "gl+wm", "glwm", "gl_wm", "gl-wm", "gl wm", "wm gl", "fissure", "Purkinje", "granular", "Cerebellum", "White", "FL", "Pl", "spot", ""]
    around = ["", " ", "2", "0", "12345", "x", "ß", "é", "٣", "𐐨", "😀", "_", "-", "fl", "\r", "\u2028", "[1] "]
    names = [a + t + b for t in tokens for a in around for b in around] + ["a 2cb", "flow gl", "2\u03a3cb", "PURK\u0130NJE", "wm2gl2", "Section 3_Purkinje", "2Cb_Granular"]
    df = spark.createDataFrame([(n,) for n in names], "name string")
    plain = F.when(~classify.is_output(F.col("name")), classify.category_of(F.col("name")))
    given = F.array(F.struct("name", F.lower("name").alias("lower")))
    rows = df.select("name", plain.alias("want"), name_audit.judged(given)[0].alias("got")).collect()
    assert [(r["name"], r["want"]) for r in rows if r["got"]["role"] != r["want"]] == []
    found = {r["want"] for r in rows}
    assert found == {*name_audit.ROLES, None} and sum(r["want"] is None for r in rows) > 1000


def test_a_second_run_takes_only_what_is_new(spark, at):
    put(spark, FIRST, LISTS, at["lists"], "first")
    assert name_audit.run(spark, at["lists"], at["out"], at["seen"]) == 5
    before = lists(spark, at["out"])
    assert name_audit.run(spark, at["lists"], at["out"], at["seen"]) == 0 and lists(spark, at["out"]) == before
    put(spark, LATER, LISTS, at["lists"], "later")
    assert name_audit.run(spark, at["lists"], at["out"], at["seen"]) == 2
    after = lists(spark, at["out"])
    assert [r for r in after if r in before] == before and sorted(r["doc_id"] for r in after) == [1, 1, 2, 3, 4, 5, 6]
    sums = {r["source"]: (r["lists"], r["n_names"], r["incomplete"]) for r in spark.read.parquet(f"{at['out']}/sources").collect()}
    assert sums == {"lab a": (3, 14, 2), None: (1, 0, 1), "lab/b=1": (2, 12, 2), "lab c": (1, 2, 1)}


def test_a_batch_that_was_not_committed_is_taken_again_and_replaced(spark, at):
    put(spark, FIRST, LISTS, at["lists"], "first")
    name_audit.run(spark, at["lists"], at["out"], at["seen"])
    before = lists(spark, at["out"])
    for left in glob.glob(f"{at['seen']}/commits/*0*"):  # as after a failure between writing and committing
        os.remove(left)
    for left in glob.glob(f"{at['seen']}/commits/.*0*"):
        os.remove(left)
    assert name_audit.run(spark, at["lists"], at["out"], at["seen"]) == 5 and lists(spark, at["out"]) == before


def test_one_file_is_an_input_too(spark, at):
    put(spark, FIRST, LISTS, at["lists"], "first")
    assert name_audit.run(spark, f"{at['lists']}/first.parquet", at["out"], at["seen"]) == 5
    assert name_audit.pattern("/a/b/") == "/a/[b]" and name_audit.pattern("/a/*.parquet") == "/a/*.parquet"


def test_unknown_settings_are_refused():
    assert settings.settings("name_audit", '{"partition_by": "lang"}')["partition_by"] == "lang"
    with pytest.raises(ValueError, match="colour"):
        settings.settings("name_audit", '{"colour": 1}')


def test_images_are_measured_and_partitions_replaced(spark, tmp_path):
    makers = lambda keys: [(k, f"Supplier {k}", k % 3) for k in keys]
    paths = {n: str(tmp_path / n) for n in ("one", "two", "nations", "out")}
    spark.createDataFrame(makers([1, 3, 11, 13]), "s_suppkey long, s_name string, s_nationkey int").write.parquet(paths["one"])
    spark.createDataFrame(makers([4, 7]), "s_suppkey long, s_name string, s_nationkey int").write.parquet(paths["two"])
    spark.createDataFrame([(0, "north"), (1, "south")], "n_nationkey int, n_name string").write.parquet(paths["nations"])
    images = lambda: {r["section_id"]: r for r in measure_images.result(spark, paths["out"]).collect()}
    assert measure_images.run(spark, paths["one"], paths["nations"], paths["out"]) == 4
    got = images()
    assert {k: (r["nation"], r["problems"], r["n_sections"]) for k, r in got.items()} == {
        "1": ("south", "", 7), "3": ("north", "", 0), "11": (None, "MISSING_PL", 0), "13": ("south", "DUPLICATE_CB", 0)
    }
    assert got["13"]["cerebellum"] is None and got["3"]["cerebellum"] == got["3"]["grey"] and got["1"]["grey"] == got["1"]["granular"] + got["1"]["molecular"]
    parts = spark.read.parquet(f"{paths['out']}/sections").groupBy("section_id").sum("granular").collect()
    assert len(parts) == 1 and abs(parts[0][1] - got["1"]["granular"]) < 1e-6
    # the second table has images of one lab only: that lab's partition is replaced, others stay
    assert measure_images.run(spark, paths["two"], paths["nations"], paths["out"]) == 2
    again = images()
    assert set(again) == {"3", "11", "4", "7"} and again["3"] == got["3"]
    scratch = spark.conf.get("spark.checkpoint.dir").removeprefix("file://")
    kept = set(os.listdir(f"{scratch}/foliometry"))
    assert measure_images.run(spark, paths["two"], paths["nations"], paths["out"]) == 2 and images() == again
    assert set(os.listdir(f"{scratch}/foliometry")) == kept  # no table between stages is left
