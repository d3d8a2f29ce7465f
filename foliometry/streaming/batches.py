"""Traced images as they arrive: each micro-batch of files is analyzed and its results are written."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import classify, messages
from ..plans.analyze import analyze, combine
from ..plans.store import Scratch
from ..sources.model import ROIS
from .waiting import INCOMPLETE, LATE, READY, gathered


def measure_stream(
    spark: SparkSession, rois_dir: str, sections: DataFrame, out_dir: str, checkpoint: str, available_now: bool = True, wait_seconds: float = 3600.0
) -> StreamingQuery:
    """Reads region files from a folder and measures each image once its regions are there.

    If ``sections`` says how many ``regions`` an image has, they may come in several files: they are held as state
    until all are there (``waiting.gathered``). Otherwise an image's regions must come in one file.

    Writes ``totals``, ``parts``, ``problems`` (why a section was not measured) and ``messages`` under ``out_dir``, and
    ``aside``: regions that came too late, or whose image had no others for ``wait_seconds``; those are problems
    too. Results of a batch are written under its number, so a batch that is run again after a failure replaces its
    own output. Tables between the stages are removed with each batch.
    """

    def measure(batch: DataFrame, number: int) -> None:
        with Scratch(batch.sparkSession) as keep:
            came = keep(batch)
            rois, aside = came.where(F.col("status") == READY).drop("status", "expected"), came.where(F.col("status") != READY)
            not_whole = _not_whole(aside)
            if rois.isEmpty():  # nothing is complete, so there is nothing to plan
                for name, rows in (("problems", not_whole), ("aside", aside)):
                    rows.write.mode("overwrite").parquet(f"{out_dir}/{name}/batch={number}")
                return
            images = sections.drop("regions").join(rois.select("section_id").distinct(), "section_id", "left_semi")  # others may still come
            analysis = analyze(rois, images, keep)
            totals, parts = (keep(x) for x in combine(analysis))
            said = [messages.of_names(rois, classify.OUTPUT_PROPERTY), messages.of_containment(analysis.cells), messages.of_cutting(analysis.labelled)]
            said += [messages.of_ends(analysis.totals), messages.of_coverage(analysis.notes), messages.of_pooling(totals, parts)]
            told = messages.collected(said, classify.pieces(rois))
            problems = analysis.problems.unionByName(not_whole)
            for name, rows in (("totals", totals), ("parts", parts), ("problems", problems), ("messages", told), ("aside", aside)):
                rows.write.mode("overwrite").parquet(f"{out_dir}/{name}/batch={number}")

    stream = spark.readStream.schema(ROIS).parquet(rois_dir)
    if "regions" in sections.columns:
        stream = gathered(stream, sections, wait_seconds)
    else:
        stream = stream.withColumns({"status": F.lit(READY), "expected": F.lit(None).cast("long")})
    writer = stream.writeStream.foreachBatch(measure).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def _not_whole(aside: DataFrame) -> DataFrame:
    """The problems of images whose regions did not come, or came too late."""
    n = aside.groupBy("section_id", "status").agg(F.count(F.lit(1)).alias("n"), F.first("expected", ignorenulls=True).alias("expected"))
    came = F.concat(F.lit("Of "), F.col("expected").cast("string"), F.lit(" regions only "), F.col("n").cast("string"), F.lit(" came."))
    late = F.concat(F.col("n").cast("string"), F.lit(" region(s) came after the image was measured."))
    text = F.when(F.col("status") == LATE, late).when(F.col("section_id").isNull(), F.lit("Regions do not say which image they are of.")).otherwise(came)
    code = F.when(F.col("status") == INCOMPLETE, "INCOMPLETE").otherwise("LATE")
    return n.select("section_id", F.lit(None).cast("int").alias("instance"), code.alias("code"), "n", text.alias("message"))
