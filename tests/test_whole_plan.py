"""The query over the whole plan has an image for each supplier."""

from foliometry import queries as sections


def test_an_image_for_each_supplier(spark, tmp_path):
    spark.range(3).withColumnRenamed("id", "s_suppkey").write.parquet(str(tmp_path / "supplier.parquet"))
    got = sections.QUERIES["phantom_sections"](spark, str(tmp_path)).collect()
    assert len({r.section_id for r in got}) == 3 and len(got) == 24
