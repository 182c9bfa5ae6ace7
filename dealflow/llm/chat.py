"""Chat formatting with cumulative-snapshot collapse (operator 5, DataFrame operations only).

A logger that writes a conversation again after every turn leaves many
conversations that are prefixes of a longer one.  Every turn gets a rolling
prefix hash; a conversation whose full hash is a proper prefix hash of another is removed by an
anti-join, of equal conversations the smallest ``conv_id`` stays, and what is
left is rendered.

The prefix hash at position k is the sum over positions i <= k of hashes of
(i, role, text), in four 32-bit lanes.  A sum can be built from the sums of
blocks, so a conversation of any length is cut into blocks of ``BLOCK`` turn numbers and later
``BLOCK`` positions, and no task ever needs a whole one.  A rendered
conversation is returned as parts of at most ``BLOCK`` turns.

Null and odd input: rows equal in all four columns are one turn logged again.
Turns with one number follow by role and text; a null number comes last.  A
null role is ``user``, a null text empty, and a null ``conv_id`` is one
conversation without id.  Extra columns are ignored.  An empty table gives an
empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written

BLOCK = 256
_LANES = ("a", "b", "c", "d")


def turn_prefixes(conversations: DataFrame) -> DataFrame:
    """conv_id, role, text, pos (from 1), n_turns and the prefix hash lanes a-d of every distinct turn."""
    turns = conversations.select(
        "conv_id", F.col("turn").cast("bigint").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("user")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    turns = (turns.dropDuplicates().withColumn("no_turn", F.col("turn").isNull())
             .withColumn("block", F.floor(F.coalesce("turn", F.lit(0)) / F.lit(BLOCK))))
    block = ["conv_id", "no_turn", "block"]
    by_block = Window.partitionBy("conv_id").orderBy("no_turn", "block").rowsBetween(Window.unboundedPreceding, -1)
    all_blocks = Window.partitionBy("conv_id")
    # where each block begins, from its number of turns
    begins = (turns.groupBy(*block).agg(F.count(F.lit(1)).alias("held"))
              .withColumn("before", F.coalesce(F.sum("held").over(by_block), F.lit(0)))
              .withColumn("n_turns", F.sum("held").over(all_blocks)).drop("held"))
    inside = Window.partitionBy(*block).orderBy("turn", "role", "text")
    placed = _same(turns.withColumn("rank", F.row_number().over(inside)), begins, block) \
        .withColumn("pos", F.col("before") + F.col("rank")).drop("before", "rank")
    first, second = F.xxhash64("pos", "role", "text"), F.xxhash64(F.lit("again"), "text", "role", "pos")
    low = F.lit(0xFFFFFFFF).cast("bigint")
    placed = (placed.withColumn("a", first.bitwiseAND(low)).withColumn("b", F.shiftrightunsigned(first, 32))
              .withColumn("c", second.bitwiseAND(low)).withColumn("d", F.shiftrightunsigned(second, 32)))
    # running sums: of whole blocks before, then inside the block
    sums = placed.groupBy(*block).agg(*(F.sum(x).alias(x) for x in _LANES))
    sums = sums.select(*block, *(F.coalesce(F.sum(x).over(by_block), F.lit(0)).alias(f"{x}_before") for x in _LANES))
    running = Window.partitionBy(*block).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    placed = placed.select("conv_id", "no_turn", "block", "role", "text", "pos", "n_turns",
                           *(F.sum(x).over(running).alias(x) for x in _LANES))
    placed = _same(placed, sums, block)
    return placed.select("conv_id", "role", "text", "pos", "n_turns",
                         *((F.col(x) + F.col(f"{x}_before")).alias(x) for x in _LANES))


def _same(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """Inner join on equal or both null ``on``."""
    right = right.select(*(F.col(c).alias(f"__{c}") if c in on else F.col(c) for c in right.columns))
    match = F.lit(True)
    for c in on:
        match = match & F.col(c).eqNullSafe(F.col(f"__{c}"))
    return left.join(right, match).drop(*(f"__{c}" for c in on))


def maximal_conversations(prefixes: DataFrame) -> DataFrame:
    """conv_id of every conversation that is no prefix of another (the smallest id of equal ones)."""
    whole = prefixes.filter(F.col("pos") == F.col("n_turns")).select("conv_id", "pos", *_LANES)
    proper = prefixes.filter(F.col("pos") < F.col("n_turns")).select("pos", *_LANES).dropDuplicates()
    return (whole.join(proper, ["pos", *_LANES], "left_anti")
            .groupBy("pos", *_LANES).agg(F.min("conv_id").alias("conv_id")).select("conv_id"))


def format_chats(conversations: DataFrame) -> DataFrame:
    """conv_id, part, n_turns, rendered: the maximal conversations, in parts of at most BLOCK turns."""
    prefixes = written(turn_prefixes(conversations), "chat-prefixes")
    kept = maximal_conversations(prefixes).withColumnRenamed("conv_id", "__kept")
    piece = F.concat(F.lit("<|im_start|>"), "role", F.lit("\n"), "text", F.lit("<|im_end|>\n"))
    turns = prefixes.join(kept, F.col("conv_id").eqNullSafe(F.col("__kept")), "left_semi").select(
        "conv_id", ((F.col("pos") - 1) / BLOCK).cast("bigint").alias("part"), "n_turns", F.struct("pos", piece.alias("piece")).alias("turn"))
    return turns.groupBy("conv_id", "part", "n_turns").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list("turn")), lambda t: t["piece"]), "").alias("rendered"))


CHAT_SQL = f"""
WITH turns AS (SELECT DISTINCT conv_id, turn, coalesce(role, 'user') AS role, coalesce(text, '') AS text FROM conversations),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS LAST, role, text) AS pos,
         count(*) OVER (PARTITION BY conv_id) AS n_turns FROM turns),
prefixed AS (
  SELECT *, string_agg(md5(role || chr(1) || text), '') OVER (PARTITION BY conv_id ORDER BY pos) AS prefix FROM placed),
whole AS (
  SELECT min(conv_id) AS conv_id FROM prefixed
  WHERE pos = n_turns AND prefix NOT IN (SELECT prefix FROM prefixed WHERE pos < n_turns) GROUP BY prefix)
SELECT p.conv_id, ((pos - 1) // {BLOCK})::BIGINT AS part, n_turns,
       string_agg('<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10), '' ORDER BY pos) AS rendered
FROM placed p WHERE EXISTS (SELECT 1 FROM whole w WHERE w.conv_id IS NOT DISTINCT FROM p.conv_id)
GROUP BY p.conv_id, part, n_turns
"""
