"""Chronological holdout, walk-forward folds and their reports.

Global row order at scale.  ``row_number().over(orderBy(..))`` without a
partition plans ``Exchange SinglePartition``, so it is never used on deals.
Instead ``global_index`` range-sorts the table (a hot date is split across
ranges by the deal id tie-break), tags rows with
``monotonically_increasing_id`` (partition index in the high bits, position
in the low bits), checkpoints that to pin the assignment (and cut lineage,
surviving executor loss), counts rows per partition -- one row per
partition -- and adds the prefix sum of the counts.  Every step is a
distributed job; the only broadcast is the partition-count table, bounded by
the number of partitions.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import checkpoint, materialize
from .joins import join_small

TIME_COL = "asof_date"
TARGET = "noi_next12"
_LOW_BITS = 33


def global_index(df: DataFrame, order: Sequence[str], name: str = "row_ix") -> DataFrame:
    """0-based position of every row in ``order`` (ties must be broken by ``order``)."""
    tagged = df.orderBy(*order).withColumn("__gi_mid", F.monotonically_increasing_id())
    tagged = checkpoint(tagged)
    tagged = tagged.withColumns({
        "__gi_pid": F.shiftright(F.col("__gi_mid"), _LOW_BITS),
        "__gi_pos": F.col("__gi_mid").bitwiseAND(F.lit((1 << _LOW_BITS) - 1)),
    })
    counts = tagged.groupBy("__gi_pid").agg(F.count(F.lit(1)).alias("__gi_cnt"))
    # one row per partition: a window over this tiny table is cheap
    offsets = counts.select(
        "__gi_pid", (F.sum("__gi_cnt").over(Window.orderBy("__gi_pid").rowsBetween(Window.unboundedPreceding, -1)))
        .alias("__gi_off"))
    offsets = offsets.fillna(0, ["__gi_off"])
    out = join_small(tagged, offsets, "__gi_pid", max_rows=1_000_000)
    return out.withColumn(name, (F.col("__gi_off") + F.col("__gi_pos")).cast("long")).drop("__gi_mid", "__gi_pid", "__gi_pos", "__gi_off")


def split_index(n: int, test_frac: float = 0.2) -> int:
    """T1 boundary: ``int(n * (1 - test_frac))`` clamped to [1, n - 1]."""
    if n < 3:
        raise ValueError("a train/test split takes 3 rows or more")
    idx = int(n * (1 - test_frac))
    return max(1, min(idx, n - 1))


def time_split(df: DataFrame, test_frac: float = 0.2, order: Sequence[str] = (TIME_COL, "deal_id")) -> DataFrame:
    """Adds ``row_ix`` and ``split`` ('train' | 'test') in (date, id) order.

    The only driver-side value is the row count (one number).  The rows are written
    before they are sorted, as the sort reads them twice (for its ranges, and to sort).
    """
    indexed = global_index(materialize(df, "rows-to-split"), order)
    n = indexed.count()
    cut = split_index(n, test_frac)
    return indexed.withColumn("split", F.when(F.col("row_ix") < cut, F.lit("train")).otherwise(F.lit("test")))


def fold_bounds(n_train: int, n_splits: int = 8) -> list[tuple[int, int, int]]:
    """(fold, val_start, val_end_exclusive) of an expanding-window split.

    ``n_splits = max(2, min(n_splits, n - 1))``; validation windows have
    ``n // (n_splits + 1)`` rows and end at the last row.
    """
    k = max(2, min(n_splits, n_train - 1))
    size = n_train // (k + 1)
    if size < 1:
        raise ValueError(f"Cannot make {k} folds from {n_train} rows.")
    return [(i, n_train - (k - i + 1) * size, n_train - (k - i) * size) for i in range(1, k + 1)]


def walk_forward(split_df: DataFrame, n_splits: int = 8) -> DataFrame:
    """One row per (fold, train row) with ``role`` 'train' or 'val'.

    Runs on the TRAIN split only.  Each train row is replicated into the
    folds it belongs to (at most ``n_splits`` copies, a constant factor) by
    exploding the matching fold numbers -- no join.
    """
    train = split_df.filter(F.col("split") == "train")
    n_train = train.count()
    bounds = fold_bounds(n_train, n_splits)
    ix = F.col("row_ix")
    roles = F.array(*[
        F.when(ix < F.lit(s), F.struct(F.lit(i).alias("fold"), F.lit("train").alias("role")))
        .when(ix < F.lit(e), F.struct(F.lit(i).alias("fold"), F.lit("val").alias("role")))
        for i, s, e in bounds])
    return train.withColumn("_fr", F.explode(F.filter(roles, lambda x: x.isNotNull()))).select(
        "*", F.col("_fr.fold").alias("fold"), F.col("_fr.role").alias("role")).drop("_fr")


def fold_report(folds: DataFrame, pred_col: str | None = None, target: str = TARGET) -> DataFrame:
    """T3 (+A3 per fold): train/val sizes and date ranges, validation metrics.

    One grouped aggregation over the fold rows (partial aggregation first, so
    a large fold never lands on one task).
    """
    is_tr, is_va = F.col("role") == "train", F.col("role") == "val"
    aggs = [
        F.count_if(is_tr).alias("train_n"), F.count_if(is_va).alias("val_n"),
        F.min(F.when(is_tr, F.col(TIME_COL))).alias("train_start"),
        F.max(F.when(is_tr, F.col(TIME_COL))).alias("train_end"),
        F.min(F.when(is_va, F.col(TIME_COL))).alias("val_start"),
        F.max(F.when(is_va, F.col(TIME_COL))).alias("val_end"),
    ]
    if pred_col is not None:
        e = F.when(is_va, F.col(target) - F.col(pred_col))
        y = F.when(is_va, F.col(target))
        aggs += [F.avg(F.abs(e)).alias("_mae"), F.avg(e * e).alias("_mse"), F.var_pop(y).alias("_var")]
    rep = folds.groupBy("fold").agg(*aggs)
    if pred_col is None:
        return rep
    return rep.select(
        "fold", "train_n", "val_n", "train_start", "train_end", "val_start", "val_end",
        F.col("_mae").alias("mae"), F.sqrt("_mse").alias("rmse"),
        F.when((F.col("val_n") >= 2) & (F.col("_var") != 0), F.lit(1.0) - F.col("_mse") / F.col("_var")).alias("r2"),
    )


def split_profile(split_df: DataFrame, target: str = TARGET) -> DataFrame:
    """T4: rows, date range and ``describe()`` of the target per split (quartiles from counted values)."""
    from .order_stats import quantiles

    y = F.col(target)
    plain = split_df.groupBy("split").agg(
        F.count(F.lit(1)).alias("rows"),
        F.min(TIME_COL).alias("date_min"), F.max(TIME_COL).alias("date_max"),
        F.count(y).alias("target_count"), F.avg(y).alias("target_mean"), F.stddev_samp(y).alias("target_std"),
        F.min(y).alias("target_min"), F.max(y).alias("target_max"))
    ranks = quantiles(split_df.select("split", y.cast("double").alias("value")), ["split"], [0.25, 0.5, 0.75])
    quartiles = ranks.groupBy(F.col("split").alias("of_split")).agg(*[
        F.max(F.when(F.col("prob") == p, F.col("quantile"))).alias(f"target_p{int(p * 100)}") for p in (0.25, 0.5, 0.75)])
    return plain.join(F.broadcast(quartiles), F.col("split").eqNullSafe(F.col("of_split")), "left").drop("of_split")
