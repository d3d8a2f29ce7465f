"""Checks lists of region names before images are measured, taking only lists that are new.

Labs keep the names of what they trace as texts, one name a line (or parted by a bar). For every list the
job says which layers and lines its names stand for, which names the measuring will leave out, which stand
there twice and what is missing. Files of lists that a run has taken are remembered by the
stream's checkpoint; a run takes the rest and ends.

    python -m jobs.name_audit --documents lists.parquet --out audit --checkpoint audit-checkpoint
"""

from __future__ import annotations

import logging
from typing import Any

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from foliometry.operators import classify

from .settings import arguments, read_text, settings

log = logging.getLogger(__name__)
ROLES = ("CEREBELLUM", "GRANULAR_WM", "WHITE_MATTER", "PURKINJE", "FISSURE")


def names_of(text: Column, separators: str) -> Column:
    """The names of a list in order, without spaces around them; a null or empty text has none."""
    names = F.transform(F.split(text, separators), lambda name: F.trim(name))
    return F.when(F.coalesce(text, F.lit("")) == "", F.array().cast("array<string>")).otherwise(names)


def judged(names: Column) -> Column:
    """name, output and role of each name of a list (name, lower).

    Nothing is shared within a lambda, so each step that the next one reads several times is an array of its
    own; patterns are tried only on names that may have a role. Null for the role of output and unknown names.
    """
    may = lambda x: ~x["output"] & classify.may_have_role(x["lower"]) & classify.instance_of(x["name"]).isNotNull()
    marked = F.transform(names, lambda x: F.struct(x["name"], x["lower"], classify.is_output(x["name"]).alias("output")))
    bared = F.transform(marked, lambda x: F.struct(x["name"], x["output"], F.when(may(x), classify.bare_name(x["name"])).alias("bare")))
    return F.transform(bared, lambda x: F.struct(x["name"], x["output"], F.when(x["bare"].isNotNull(), classify.role_of(x["bare"])).alias("role")))


def audited(lists: DataFrame, config: dict[str, Any]) -> DataFrame:
    """doc_id, lang, n_names, n_unnamed, n_output, n_ignored, n_twice, one count a role, missing, shown, and the partition's column.

    ``shown`` has the first ignored names, ``missing`` the required roles that no name has, both as
    texts. One row a list, in one pass without a shuffle; a list is one row's array.
    """
    part = config["partition_by"]

    names = F.transform(names_of(F.col("text"), config["separators"]), lambda name: F.struct(name.alias("name"), F.lower(name).alias("lower")))
    rows = lists.select("doc_id", F.col(part).cast("string").alias(part), "lang", judged(names).alias("n"))
    n, ignored = F.col("n"), F.filter("n", lambda x: ~x["output"] & x["role"].isNull())
    count = lambda test: F.size(F.filter(n, test)).cast("long")
    has = lambda role: lambda x: F.coalesce(x["role"] == role, F.lit(False))
    of = {role: count(has(role)) for role in ROLES}
    shown = F.transform(F.slice(ignored, 1, classify.MOST_LISTED), lambda x: F.when(x["name"] == "", "(unnamed)").otherwise(x["name"]))
    more = F.when(F.size(ignored) > classify.MOST_LISTED, F.lit(", …")).otherwise(F.lit(""))
    return rows.select(
        "doc_id", part, "lang", F.size(n).cast("long").alias("n_names"), count(lambda x: x["name"] == "").alias("n_unnamed"), count(lambda x: x["output"]).alias("n_output"),
        F.size(ignored).cast("long").alias("n_ignored"), (F.size(n) - F.size(F.array_distinct("n.name"))).cast("long").alias("n_twice"),
        *(c.alias(f"n_{role.lower()}") for role, c in of.items()),
        F.array_join(F.array_compact(F.array(*(F.when(of[role] == 0, F.lit(role)) for role in config["required"]))), ",").alias("missing"),
        F.concat(F.array_join(shown, ", "), more).alias("shown"),
    )


def run(spark: SparkSession, documents: str, out: str, checkpoint: str, config: dict[str, Any] | None = None) -> int:
    """Takes what is new under ``documents`` into ``out`` and returns the number of lists taken.

    ``documents`` is a folder of Parquet files, or a file. Each batch of files is written to its own
    ``<out>/lists/batch=<number>``, parted by a column; a batch that is begun again after a failure has the
    same number and files, so it replaces what it left. ``<out>/sources`` sums all batches up.
    """
    config = settings("name_audit") | (config or {})
    part, taken = config["partition_by"], []
    schema = spark.read.parquet(documents).schema

    def take(batch: DataFrame, number: int) -> None:
        seen = Observation("lists")
        rows = audited(batch, config).observe(seen, F.count(F.lit(1)).alias("rows"), F.sum("n_names").alias("names"), F.sum("n_ignored").alias("ignored"))
        path = f"{out}/lists/batch={number}"
        rows.write.mode("overwrite").partitionBy(part).parquet(path)
        got = seen.get
        taken.append(got["rows"])
        log.info("batch %d: read %d lists of %s names, wrote %s, %s names ignored", number, got["rows"], got["names"] or 0, path, got["ignored"] or 0)

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", config["files_per_batch"]).parquet(pattern(documents))
    query = stream.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    if taken:
        sources(spark, out, part)
    log.info("read %s, took %d new lists", documents, sum(taken))
    return sum(taken)


def pattern(path: str) -> str:
    """The path as a pattern for itself: a stream takes a folder, but a file only by a pattern."""
    path = path.rstrip("/")
    return path if any(c in path for c in "*?[{") else f"{path[:-1]}[{path[-1]}]"


def result(spark: SparkSession, out: str) -> DataFrame:
    """All lists judged so far."""
    return spark.read.parquet(f"{out}/lists")


def sources(spark: SparkSession, out: str, part: str) -> None:
    """Lists, names and ignored names of each partition, over all batches."""
    rows = result(spark, out).groupBy(part).agg(F.count(F.lit(1)).alias("lists"), *(F.sum(c).alias(c) for c in ("n_names", "n_ignored", "n_twice")), F.count_if(F.col("missing") != "").alias("incomplete"))
    rows.write.mode("overwrite").parquet(f"{out}/sources")
    log.info("wrote %s/sources", out)


def main() -> None:
    given = arguments(__doc__, ("documents", "folder of Parquet files with lists"), ("out", "folder for results"), ("checkpoint", "folder that remembers what was taken"))
    spark = SparkSession.builder.appName("name_audit").getOrCreate()
    try:
        run(spark, given.documents, given.out, given.checkpoint, settings("name_audit", given.config and read_text(spark, given.config)))
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
