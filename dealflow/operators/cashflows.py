"""R4 over long cash-flow tables: (key, period, amount) rows -> IRR per key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.irr import irr


def irr_from_long(df: DataFrame, key: str, period: str, amount: str) -> DataFrame:
    """Regroup a long cash-flow table per key in period order and solve the IRR.

    One series per key is one deal's horizon (at most 31 periods under the
    request rules), so the per-key array is small and bounded; the groupBy
    is the only shuffle.
    """
    series = df.groupBy(key).agg(
        F.array_sort(F.collect_list(F.struct(F.col(period).alias("t"), F.col(amount).alias("cf")))).alias("_s"),
        F.count(F.lit(1)).alias("periods"),
    )
    cfs = F.transform(F.col("_s"), lambda x: x["cf"])
    return series.select(key, "periods", cfs.alias("cash_flows")).withColumn(
        "_irr", irr("cash_flows")).select(
        key, "periods", "cash_flows", F.col("_irr").alias("irr"), F.col("_irr").isNotNull().alias("irr_ok"))
