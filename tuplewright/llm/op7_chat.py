"""Chat formatting by cumulative-snapshot collapse.

Chat logs often hold a conversation again and again, each time with a few more
turns.  A rolling hash of the turns identifies every turn prefix; a conversation
whose whole is a proper prefix of another goes (an anti-join on length and hash),
and of equal conversations the one with the smallest id stays (a null id only where all
are null).  Only then are the rest joined to their turns again and rendered.  DataFrame functions only.

Defined results: turns are ordered by (turn, role, text), nulls first, so ties
and repeated rows have one order and repeated turn rows stay; a null conv_id is
one conversation; a null role renders as ``unknown`` and a null text as empty, but
nulls and empty texts differ when conversations are compared; an empty table gives
no rows; columns besides the four named are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table


def turn_prefixes(conversations: DataFrame) -> DataFrame:
    """Every turn with its place, the 128-bit hash of the turns up to it, and whether more turns follow."""
    t = conversations.select("conv_id", "turn", "role", "text")
    by_turn = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    upto = by_turn.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    t = t.withColumn("place", F.row_number().over(by_turn)).withColumn("more", F.lead(F.lit(True)).over(by_turn).isNotNull())
    fields = ["place", F.col("role").isNull(), "role", F.col("text").isNull(), "text"]
    for name in ("h1", "h2"):
        t = t.withColumn(name, F.bit_xor(F.xxhash64(F.lit(name), *fields)).over(upto))
    return t


def render(role, text):
    return F.concat(F.lit("<|im_start|>"), F.coalesce(role, F.lit("unknown")), F.lit("\n"), F.coalesce(text, F.lit("")), F.lit("<|im_end|>\n"))


def maximal_chats(conversations: DataFrame) -> DataFrame:
    """(conv_id, n_turns, n_copies, text): the conversations that prefix no longer one, rendered; n_copies counts equal ones."""
    t = turn_prefixes(conversations)
    whole = t.groupBy("conv_id").agg(
        F.max("place").alias("n_turns"),
        F.max_by("h1", "place").alias("h1"),
        F.max_by("h2", "place").alias("h2"),
    )
    kept = whole.groupBy("n_turns", "h1", "h2").agg(F.min("conv_id").alias("id"), F.count("*").alias("n_copies"))
    shorter = t.where("more").select(F.col("place").alias("n_turns"), "h1", "h2").distinct()
    kept = kept.join(shorter, ["n_turns", "h1", "h2"], "left_anti").select("id", F.col("n_turns").cast("long").alias("n_turns"), "n_copies")
    turns = conversations.select("conv_id", "turn", "role", "text").join(kept, F.col("conv_id").eqNullSafe(F.col("id")))
    shown = F.struct("turn", "role", "text", render(F.col("role"), F.col("text")).alias("shown"))
    text = F.array_join(F.transform(F.sort_array(F.collect_list(shown)), lambda x: x["shown"]), "")
    return turns.groupBy("conv_id", "n_turns", "n_copies").agg(text.alias("text"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maximal_chats(table(spark, sf_dir, "conversations"))


ORACLE = """
WITH t AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS place, role, text FROM conversations),
c AS (
  SELECT conv_id, count(*) AS n_turns,
    string_agg(coalesce(length(role)::VARCHAR || ':' || role, '-') || coalesce(length(text)::VARCHAR || ':' || text, '-') || ';', '' ORDER BY place) AS code,
    string_agg('<|im_start|>' || coalesce(role, 'unknown') || chr(10) || coalesce(text, '') || '<|im_end|>' || chr(10), '' ORDER BY place) AS text
  FROM t GROUP BY conv_id),
k AS (SELECT min(conv_id) AS conv_id, n_turns, count(*) AS n_copies, code, min(text) AS text FROM c GROUP BY n_turns, code)
SELECT conv_id, n_turns, n_copies, text FROM k
WHERE NOT EXISTS (SELECT 1 FROM k AS o WHERE o.n_turns > k.n_turns AND starts_with(o.code, k.code))
"""
