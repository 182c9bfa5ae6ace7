"""Mixing sources to target weights by weighted fair queueing (operator 2, DataFrame operations only).

Every source queues its documents in a shuffled order (by a digest of seed,
``doc_id`` and text), up to ``max_epochs`` times over.  A queued document's
virtual finish time is the source's words queued up to and including it,
divided by the source's weight.  All queues are merged by finish time and the
merged queue is cut where the next document would pass the budget (all words).
Fair queueing shares the budget by weight; a source that runs out leaves the rest
to the others, which is the targets' rule.

At scale: running sums never gather a source in one task.  The shuffled order
is cut into 4096 buckets by the digest's first three hex digits; sums by bucket
give each bucket's start, and only a bucket's rows are sorted together.  The
merged queue is cut into ranges of finish time in the same way: one histogram finds the range that holds
the cut, and only that range's rows are ranked.  The cut (one row) and the
sources (a row each) are all that is carried over; texts are never shuffled.

Null and odd input: a null text has size 0; sizes 0 are taken 0 words.  A null
source is a source of its own, last in order.  Rows equal in ``doc_id`` and
text take the same place in the queue and are taken together.  A null
``doc_id`` counts as an id.  Extra columns are kept by ``mix`` and ignored by
``mix_report``.  An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.joins import join_small
from .common import packed, written

FINISH_RANGES = 16384


def size_of(text: Column) -> Column:
    """Number of runs of characters other than blank, tab, line feed, vertical tab, form feed and return."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("bigint")


def shuffle_key(seed: str, doc_id: Column, text: Column) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"),
                          F.md5(F.coalesce(text, F.lit("")))))


def source_targets(sized: DataFrame, max_epochs: int = 3, weights: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """source, place, weight, source_size, budget, target: one row for each source.

    With ``level`` words for each unit of weight, a source gets
    min(max_epochs * size, level * weight).  In order of the level at which
    sources run out, each prefix of run-out sources bounds the level from below, and the
    right prefix meets it, so the level is the largest of these bounds.
    """
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    everything = Window.partitionBy()
    place = F.row_number().over(Window.orderBy(F.asc_nulls_last("source"))) - 1
    per = (per.withColumn("place", place)
           .withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("place") % len(weights) + 1).cast("int")))
           .withColumn("cap", F.col("source_size") * max_epochs)
           .withColumn("budget", F.sum("source_size").over(everything)))
    before = Window.orderBy(F.col("cap") / F.col("weight"), "place").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("bigint")
    spent, gone = F.coalesce(F.sum("cap").over(before), zero), F.coalesce(F.sum("weight").over(before), zero)
    per = per.withColumn("bound", (F.col("budget") - spent).cast("double")
                         / (F.sum("weight").over(everything) - gone).cast("double"))
    return (per.withColumn("level", F.max("bound").over(everything))
            .withColumn("target", F.least(F.col("cap").cast("double"), F.col("level") * F.col("weight")))
            .withColumn("last_finish", F.max(F.col("cap") / F.col("weight")).over(everything))
            .select("source", "place", "weight", "source_size", "budget", "target", "last_finish"))


def _queued(sized: DataFrame, targets: DataFrame) -> DataFrame:
    """sized with its source's columns and ``cum``, the source's words up to and including the row."""
    sized = sized.withColumn("bucket", F.substring("key", 1, 3))
    blocks = (sized.groupBy("source", "bucket").agg(F.sum("size").alias("held"))
              .withColumn("before", F.sum("held").over(Window.partitionBy("source").orderBy("bucket")) - F.col("held")))
    blocks = blocks.alias("b").join(targets.alias("t"), F.col("b.source").eqNullSafe(F.col("t.source"))) \
        .select("b.source", "b.bucket", "b.before", "t.place", "t.weight", "t.source_size", "t.budget", "t.target",
                "t.last_finish")
    # equal keys share a place, hence the range frame
    cum = F.sum("size").over(Window.partitionBy("source", "bucket").orderBy("key"))
    rows = sized.withColumn("cum", cum)
    return (rows.alias("r").join(blocks.alias("b"), F.col("r.source").eqNullSafe(F.col("b.source"))
                                 & (F.col("r.bucket") == F.col("b.bucket")))
            .select("r.*", "b.place", "b.weight", "b.source_size", "b.budget", "b.target", "b.last_finish",
                    (F.col("b.before") + F.col("r.cum")).alias("queued")).drop("cum", "bucket"))


def _finish(epoch: int | Column) -> Column:
    epoch = F.lit(epoch) if isinstance(epoch, int) else epoch
    return (epoch * F.col("source_size") + F.col("queued")).cast("double") / F.col("weight")


def _range_of(finish: Column) -> Column:
    width = F.col("last_finish") / F.lit(float(FINISH_RANGES))
    return F.when(F.col("last_finish") > 0, F.floor(finish / width)).otherwise(F.lit(0)).cast("bigint")


def _cut(queued: DataFrame, max_epochs: int) -> tuple | None:
    """The merged queue's last place within budget, as (range, finish, place, epoch, key); None if all fit."""
    items = (queued.withColumn("epoch", F.explode(F.array(*map(F.lit, range(max_epochs)))))
             .withColumn("finish", _finish(F.col("epoch"))).withColumn("range", _range_of(F.col("finish"))))
    spans = (items.groupBy("range").agg(F.sum("size").alias("held"), F.max("budget").alias("budget"))
             .withColumn("upto", F.sum("held").over(Window.orderBy("range"))))
    span = spans.filter(F.col("upto") > F.col("budget")).orderBy("range").first()
    if span is None:
        return None
    inside = Window.partitionBy("range").orderBy("finish", "place", "epoch", "key")
    room = span["budget"] - (span["upto"] - span["held"])
    last = (items.filter(F.col("range") == span["range"]).withColumn("total", F.sum("size").over(inside))
            .filter(F.col("total") <= room)
            .orderBy(F.desc("finish"), F.desc("place"), F.desc("epoch"), F.desc("key")).first())
    if last is None:
        return span["range"], -1.0, -1, -1, ""
    return span["range"], last["finish"], last["place"], last["epoch"], last["key"]


def mix_plan(sized: DataFrame, max_epochs: int = 3, weights: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """sized (doc_id, source, key, size; best written before) with source_size, target and ``copies`` taken."""
    queued = _queued(sized, source_targets(sized, max_epochs, weights))
    cut = _cut(queued, max_epochs)
    copies = F.lit(0)
    for epoch in range(max_epochs):
        kept = F.lit(True)
        if cut is not None:
            span, *place = cut
            here = F.struct(_finish(epoch).alias("f"), F.col("place").cast("int").alias("p"), F.lit(epoch).alias("e"),
                            F.col("key").alias("k"))
            last = F.struct(*(F.lit(v).cast(t).alias(n) for v, t, n in
                              zip(place, ("double", "int", "int", "string"), "fpek")))
            in_range = _range_of(_finish(epoch))
            kept = (in_range < span) | ((in_range == span) & (here <= last))
        copies = copies + kept.cast("int")
    return queued.withColumn("copies", copies).withColumn("taken", F.col("size") * F.col("copies"))


def sized_documents(docs: DataFrame, seed: str = "mix") -> DataFrame:
    text = F.col("text").cast("string")
    return written(packed(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("source").cast("string").alias("source"),
                               shuffle_key(seed, F.col("doc_id"), text).alias("key"), size_of(text).alias("size"))),
                   "mix-sizes")


def mix_report(docs: DataFrame, seed: str = "mix", max_epochs: int = 3,
               weights: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """doc_id, size, source_size, target, taken, source, copies for every row of ``docs``."""
    plan = mix_plan(sized_documents(docs, seed), max_epochs, weights)
    return plan.select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


def mix(docs: DataFrame, seed: str = "mix", max_epochs: int = 3, weights: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """The mixture itself: every row of ``docs``, with all its columns, as often as the mix takes it.

    What a source gives is the start of its shuffled order in every epoch, so a
    key for each source and epoch (``cuts``) decides a row where it lies.
    """
    plan = mix_plan(sized_documents(docs, seed), max_epochs, weights)
    cuts = plan.groupBy("source").agg(
        *(F.max(F.when(F.col("copies") > e, F.col("key"))).alias(f"__mix_cut_{e}") for e in range(max_epochs)))
    cuts = written(cuts.withColumn("__mix_source", F.col("source")).drop("source"), "mix-cuts")
    keyed = docs.withColumn("__mix_key", shuffle_key(seed, F.col("doc_id"), F.col("text").cast("string")))
    on = F.col("source").cast("string").eqNullSafe(F.col("__mix_source"))
    joined = join_small(keyed, cuts, on, max_rows=100_000)
    copies = sum((F.coalesce((F.col("__mix_key") <= F.col(f"__mix_cut_{e}")).cast("int"), F.lit(0))
                  for e in range(max_epochs)), F.lit(0))
    return (joined.withColumn("__mix_copy", F.explode(F.array_repeat(F.lit(1), copies)))
            .select(*(F.col(f"`{c}`") for c in docs.columns)))


def mix_sql(seed: str = "mix", max_epochs: int = 3, weights: tuple[int, ...] = (1, 2, 3)) -> str:
    """The same mix as DuckDB SQL over ``documents``, with plain windows."""
    epochs = ", ".join(f"({e})" for e in range(max_epochs))
    return rf"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         md5('{seed}:' || coalesce(doc_id::VARCHAR, '') || ':' || md5(coalesce(text, ''))) AS key
  FROM documents),
per AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
placed AS (
  SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS place, source_size * {max_epochs} AS cap FROM per),
weighted AS (SELECT *, ([{", ".join(map(str, weights))}])[(place % {len(weights)} + 1)::INT] AS weight FROM placed),
bounds AS (
  SELECT *, (SELECT sum(source_size) FROM weighted) AS budget,
    ((SELECT sum(source_size) FROM weighted) - coalesce(sum(cap) OVER w, 0))::DOUBLE
    / ((SELECT sum(weight) FROM weighted) - coalesce(sum(weight) OVER w, 0))::DOUBLE AS bound
  FROM weighted
  WINDOW w AS (ORDER BY cap::DOUBLE / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
targets AS (
  SELECT *, least(cap::DOUBLE, (SELECT max(bound) FROM bounds) * weight) AS target FROM bounds),
queued AS (
  SELECT s.doc_id, s.size, s.key, t.*, sum(s.size) OVER (PARTITION BY t.place ORDER BY s.key) AS cum
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source),
items AS (
  SELECT q.*, e.epoch, (e.epoch * source_size + cum)::DOUBLE / weight AS finish
  FROM queued q CROSS JOIN (VALUES {epochs}) e(epoch)),
merged AS (SELECT *, sum(size) OVER (ORDER BY finish, place, epoch, key) AS total FROM items)
SELECT doc_id, size, source_size, target, (size * count(*) FILTER (total <= budget))::BIGINT AS taken, source,
       count(*) FILTER (total <= budget)::INT AS copies
FROM merged GROUP BY doc_id, key, size, source_size, target, source
"""
