"""Chat formatting: collapse of logged snapshots to maximal conversations, then rendering.

A chat log often holds every growing state of a conversation. Each turn gets the
hash of the conversation up to and with it; a conversation whose last hash is some
other one's earlier hash is a snapshot of that one and goes (anti-join). Prefix
hashes are running XORs of hashes that contain the turn's position, so they can be
summed by segment: no task needs a whole conversation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import null_safe, written

#: Turns in a rendered row; longer conversations give several rows.
SEGMENT = 256


def chatml(role: Column, text: Column) -> Column:
    return F.concat(F.lit("<|im_start|>"), F.coalesce(role, F.lit("")), F.lit("\n"), F.coalesce(text, F.lit("")), F.lit("<|im_end|>\n"))


def _before(value: Column, by: list[str], order: str) -> Column:
    return value.over(Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1))


def turn_prefixes(conversations: DataFrame) -> DataFrame:
    """conv_id, pos, seg, role, text, p1, p2: each turn with the hash of all up to it.

    Turns are ordered by (turn, role, text); positions count from 0, so logs that number
    their turns differently still match. Null turns come first; null and empty texts differ.
    """
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    rows = rows.withColumn("block", F.coalesce(F.floor(F.col("turn") / SEGMENT), F.lit(-(1 << 60))).cast("long"))
    counts = rows.groupBy("conv_id", "block").agg(F.count(F.lit(1)).alias("n"))
    counts = counts.select(F.col("conv_id").alias("c"), F.col("block").alias("b"), F.coalesce(_before(F.sum("n"), ["conv_id"], "block"), F.lit(0)).alias("start"))
    own = F.row_number().over(Window.partitionBy("conv_id", "block").orderBy("turn", "role", "text"))
    rows = rows.withColumn("own", own).join(counts, null_safe((F.col("conv_id"), F.col("c")), (F.col("block"), F.col("b"))))
    rows = rows.withColumn("pos", F.col("start") + F.col("own") - 1).withColumn("seg", F.floor(F.col("pos") / SEGMENT).cast("long"))
    item = ["pos", "role", "text", "no_role", "no_text"]
    rows = rows.withColumn("no_role", F.col("role").isNull()).withColumn("no_text", F.col("text").isNull())
    rows = rows.withColumn("t1", F.xxhash64(*item)).withColumn("t2", F.xxhash64(F.lit("second"), *item))
    inside = Window.partitionBy("conv_id", "seg").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    sums = rows.groupBy("conv_id", "seg").agg(F.bit_xor("t1").alias("x1"), F.bit_xor("t2").alias("x2"))
    sums = sums.select(F.col("conv_id").alias("c2"), F.col("seg").alias("s2"), *(F.coalesce(_before(F.bit_xor(x), ["conv_id"], "seg"), F.lit(0)).alias(f"before{x}") for x in ("x1", "x2")))
    rows = rows.withColumns({"r1": F.bit_xor("t1").over(inside), "r2": F.bit_xor("t2").over(inside)})
    rows = rows.join(sums, null_safe((F.col("conv_id"), F.col("c2")), (F.col("seg"), F.col("s2"))))
    return rows.select("conv_id", "pos", "seg", "role", "text", F.col("r1").bitwiseXOR(F.col("beforex1")).alias("p1"), F.col("r2").bitwiseXOR(F.col("beforex2")).alias("p2"))


def maximal_conversations(conversations: DataFrame, render=chatml) -> DataFrame:
    """conv_id, segment, n_turns, n_copies, rendered: the conversations that no longer one begins with.

    Of equal conversations the smallest conv_id stays (null last); ``n_copies`` counts
    them. Rows with a null conv_id form one conversation. Repeated rows are repeated
    turns. A conversation of more than 256 turns gives a row for each 256 of them.
    No rows give no rows; other columns are ignored.
    """
    turns = written(turn_prefixes(conversations), "turns")
    lengths = turns.groupBy("conv_id").agg((F.max("pos") + 1).alias("n_turns")).select(F.col("conv_id").alias("c"), "n_turns")
    ends = turns.select("conv_id", "pos", "p1", "p2").join(lengths, F.col("conv_id").eqNullSafe(F.col("c")))
    last = F.col("pos") == F.col("n_turns") - 1
    whole = ends.where(last).groupBy("pos", "p1", "p2").agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_copies"))
    inner = ends.where(~last).select("pos", "p1", "p2").distinct()
    kept = whole.join(inner, ["pos", "p1", "p2"], "left_anti").select(F.col("conv_id").alias("k"), (F.col("pos") + 1).alias("n_turns"), "n_copies")
    texts = turns.join(kept, F.col("conv_id").eqNullSafe(F.col("k")))
    piece = F.struct("pos", render(F.col("role"), F.col("text")).alias("piece"))
    out = texts.groupBy("conv_id", "seg").agg(F.first("n_turns").alias("n_turns"), F.first("n_copies").alias("n_copies"), F.sort_array(F.collect_list(piece)).alias("pieces"))
    return out.select("conv_id", F.col("seg").alias("segment"), "n_turns", "n_copies", F.array_join(F.col("pieces.piece"), "").alias("rendered"))


ORACLE = """
WITH t AS (
  SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) - 1 AS pos,
         count(*) OVER (PARTITION BY conv_id) AS n_turns,
         string_agg(md5(coalesce('r' || role, '') || '|' || coalesce('t' || text, '')), ',') OVER (
             PARTITION BY conv_id ORDER BY turn, role, text ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS prefix
  FROM conversations),
whole AS (SELECT prefix, min(conv_id) AS conv_id, count(*) AS n_copies FROM t WHERE pos = n_turns - 1 GROUP BY prefix),
kept AS (SELECT * FROM whole WHERE prefix NOT IN (SELECT prefix FROM t WHERE pos < n_turns - 1))
SELECT t.conv_id, CAST(t.pos // 256 AS BIGINT) AS segment, t.n_turns, k.n_copies,
       string_agg('<|im_start|>' || coalesce(role, '') || chr(10) || coalesce(text, '') || '<|im_end|>' || chr(10), '' ORDER BY pos) AS rendered
FROM t JOIN kept k USING (conv_id) GROUP BY ALL
"""
