"""Connected components of an edge table by alternating large-star and small-star steps.

Kiveris et al., Connected Components in MapReduce and Beyond, 2014. Edges lead from the larger node u
to the smaller v. A large-star step hangs u on the least neighbour of v; it needs only v's own
smaller neighbours, so the roots of large groups, which have none, are looked up in vain and
their many edges may be split at will (an outer join, which adaptive execution does split). A
small-star step works on u, which has few smaller neighbours. Every round is written to the
shared folder, and the one before removed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import remove, tables_written, written


def _both_stars(edges: DataFrame) -> DataFrame:
    low = edges.groupBy(F.col("u").alias("v")).agg(F.min("v").alias("m"))
    large = edges.join(low, "v", "left").select("u", F.coalesce("m", "v").alias("v")).repartition("u").distinct()
    least = large.withColumn("m", F.min("v").over(Window.partitionBy("u")))
    ends = F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")
    return least.select(ends).select("e.u", "e.v").where(F.col("u") != F.col("v")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, root (the smallest node reachable) of every node that some edge (u, v) touches, but for the roots."""
    spark = edges.sparkSession
    edges = written(edges.where(F.col("u") != F.col("v")).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    state = None
    while True:
        before = tables_written()[-1]
        edges = written(_both_stars(edges), "edges")
        remove(spark, [before])
        now = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
        if now == state or now[0] == 0:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        state = now
