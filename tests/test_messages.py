"""Texts of messages that no synthetic image calls for."""

from pyspark.sql import functions as F

from foliometry.operators import messages

WHO = "section_id string, instance int"


def texts(df):
    return sorted((r.section_id, r.level, r.code, r.message) for r in df.collect())


def test_cuttings_that_went_wrong(spark):
    rows = [("whole", 1, 8, 8, True, 1000, 1000), ("few", 1, 8, 6, False, 1000, 1000), ("left", 1, 8, 8, True, 1000, 980), ("just", 1, 8, 8, True, 1000, 995)]
    labelled = spark.createDataFrame(rows, f"{WHO}, expected int, kept int, clean boolean, area long, assigned long")
    doubled = labelled.unionByName(labelled)  # a piece has many spans and is told of once
    assert texts(messages.of_cutting(doubled)) == [
        ("few", "WARNING", "SECTION_COUNT", "The cuts give 6 section(s) where 8 are expected; check that each cut crosses the grey matter."),
        ("left", "NOTE", "UNASSIGNED", "2.0% of the grey matter cannot be reached from any section and is in none."),
    ]
    assert texts(messages.of_cutting(labelled.where(F.lit(False)))) == []


def test_sections_that_do_not_cover(spark):
    notes = spark.createDataFrame([("a", 1, "WARNING", "SECTION_AREA", 97.04), ("a", 1, "NOTE", "LINE_OUTSIDE", 1.25)], f"{WHO}, level string, code string, percent double")
    told = texts(messages.of_coverage(notes))
    assert told[0][2:] == ("LINE_OUTSIDE", "1.3% of the Purkinje line is in no section; it counts in the total length only.")
    assert told[1][2:] == ("SECTION_AREA", "The sections hold 97.0% of the grey matter, so their areas do not add up to the totals.")


def test_pieces_are_named_where_there_are_several(spark):
    notes = spark.createDataFrame([("a", 2, "NOTE", "LINE_OUTSIDE", 1.0), ("b", 1, "NOTE", "LINE_OUTSIDE", 1.0)], f"{WHO}, level string, code string, percent double")
    pieces = spark.createDataFrame([("a", 1), ("a", 2), ("b", 1)], WHO)
    got = {r.section_id: r.message for r in messages.collected([messages.of_coverage(notes)], pieces).collect()}
    assert got["a"].startswith("[Instance 2] 1.0% of") and got["b"].startswith("1.0% of")
