"""Images whose regions come in several files of a stream."""

import time

from pyspark.sql import functions as F

from foliometry.plans.store import stored
from foliometry.sources.phantom import Phantom, phantoms
from foliometry.streaming.batches import measure_stream


def test_regions_of_several_files_are_measured_once(spark, tmp_path):
    images, rois = (stored(x) for x in phantoms(spark, 1, Phantom(pinched=False, fissures=2), "f"))
    lines = rois.where("name = 'PL' OR name LIKE 'FL%'")
    first = rois.where("name IN ('CB', 'GL+WM', 'WM')")
    n = rois.count()
    every = images.withColumn("regions", F.lit(n))
    every = every.unionByName(every.withColumn("section_id", F.lit("never"))).unionByName(every.withColumns({"section_id": F.lit("uncounted"), "regions": F.lit(None).cast("int")}))
    into, out = str(tmp_path / "in"), str(tmp_path / "out")
    read = lambda what: spark.read.parquet(f"{out}/{what}")

    def step(rows, wait=3600.0):
        rows.coalesce(1).write.mode("append").parquet(into)
        query = measure_stream(spark, into, every, out, str(tmp_path / "state"), wait_seconds=wait)
        query.awaitTermination()

    named = lambda rows, name: rows.withColumn("section_id", F.lit(name))
    step(first.unionByName(named(first, "never")).unionByName(named(first, None)))
    assert {(r.section_id, r.code, r.n) for r in read("problems").collect()} == {(None, "INCOMPLETE", 3)}
    assert not (tmp_path / "out/totals").exists()  # all wait
    step(first.where("name = 'CB'").unionByName(lines).unionByName(named(rois, "uncounted")))  # one region comes twice
    totals = {r.section_id: r for r in read("totals").collect()}
    assert len(totals) == 2 and "never" not in totals
    assert len({(r.grey, r.purkinje_len) for r in totals.values()}) == 1 and read("parts").count() == 4
    time.sleep(1.5)
    step(lines.where("name = 'PL'"), wait=1.0)  # this image is measured already, and the other has waited for long
    found = [(r.section_id, r.code, r.n) for r in read("problems").where("section_id IS NOT NULL").collect()]
    assert sorted(found) == [("f0", "LATE", 1), ("never", "INCOMPLETE", 3)] and read("totals").count() == 2
    assert read("aside").where("status = 'incomplete' AND section_id = 'never' AND rings IS NOT NULL").count() == 3
