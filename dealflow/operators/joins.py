"""Join helpers with an explicit, checked broadcast decision."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fits(df: DataFrame, max_rows: int) -> bool:
    """True when ``df`` has at most ``max_rows`` rows.

    Runs ``limit(max_rows + 1).count()``: the scan stops early, so the check
    costs at most ``max_rows + 1`` rows however large ``df`` is.
    """
    return df.limit(max_rows + 1).count() <= max_rows


def join_small(big: DataFrame, small: DataFrame, on, how: str = "inner",
               max_rows: int = 100_000) -> DataFrame:
    """Join, broadcasting ``small`` only after its row count is proven bounded.

    Beyond the bound the join is left to the planner (shuffle join, AQE may
    still switch strategy at run time from real sizes).
    """
    if fits(small, max_rows):
        return big.join(F.broadcast(small), on, how)
    return big.join(small, on, how)


def col_or_lit(x) -> Column:
    if isinstance(x, Column):
        return x
    if isinstance(x, str):
        return F.col(x)
    return F.lit(x)
