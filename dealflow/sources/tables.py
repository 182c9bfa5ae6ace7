"""Sources: the driver's parquet tables and the ``deals`` view built from them.

No driver table is a deal table, so every deal query starts from ``deals``:
orders joined with per-order lineitem totals, customer, nation and region.
All derived columns are deterministic functions of the keys, so the same
view can be stated in DuckDB SQL (``DEALS_SQL``) for the oracles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.joins import join_small

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem",
    "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)

# Order priority -> property type (the five reference types).
PRIORITY_TO_TYPE = [
    ("1-URGENT", "Multifamily"),
    ("2-HIGH", "Industrial"),
    ("3-MEDIUM", "Retail"),
    ("4-NOT SPECIFIED", "Office"),
]
OTHER_TYPE = "SelfStorage"

DEAL_COLUMNS = (
    "deal_id", "asof_date", "property_type", "city", "state", "zip", "year_built",
    "gross_leasable_sqft", "units", "purchase_price", "noi_t12", "occupancy_t12",
    "opex_t12", "gross_rent_t12", "ltv", "interest_rate", "amort_years", "noi_next12",
)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _mod(c: Column, m: int) -> Column:
    return c % F.lit(m).cast("bigint")


def deals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 18-column deal snapshot table: the orders of ``intake`` with lineitems, so with numbers."""
    return intake(spark, sf_dir, priced=True)


def intake(spark: SparkSession, sf_dir: str, priced: bool = False) -> DataFrame:
    """Deal requests as they come in: one row per order; one without lineitems has no rent, size, price or NOI."""
    orders = read_table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority")
    lineitem = read_table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_extendedprice", "l_quantity")
    customer = read_table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    nation = read_table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey")
    region = read_table(spark, sf_dir, "region").select("r_regionkey", "r_name")

    # Partial (map-side) aggregation, then one shuffle on the order key; the
    # join with orders reuses that partitioning.
    totals = lineitem.groupBy("l_orderkey").agg(
        (F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).cast("double") * F.lit(3.0)).alias("rent"),
        F.sum(F.col("l_quantity").cast("bigint")).alias("qty"),
    )
    geo = join_small(nation, region, nation.n_regionkey == region.r_regionkey, max_rows=10_000)
    base = (orders.join(totals, orders.o_orderkey == totals.l_orderkey, "inner" if priced else "left")
            .join(customer, orders.o_custkey == customer.c_custkey))
    base = join_small(base, geo, base.c_nationkey == geo.n_nationkey, max_rows=10_000)

    k, ck = F.col("o_orderkey"), F.col("o_custkey")
    rent = F.col("rent")
    opexr = F.lit(0.18) + _mod(k, 38) * F.lit(0.01)
    cap = F.lit(0.045) + _mod(ck, 50) * F.lit(0.001)
    noi = rent - rent * opexr
    ptype = F.lit(OTHER_TYPE)
    for prio, name in reversed(PRIORITY_TO_TYPE):
        ptype = F.when(F.col("o_orderpriority") == prio, F.lit(name)).otherwise(ptype)

    return base.select(
        F.concat(F.lit("D"), F.lpad(k.cast("string"), 9, "0")).alias("deal_id"),
        F.col("o_orderdate").cast("date").alias("asof_date"),
        ptype.alias("property_type"),
        F.col("n_name").alias("city"),
        F.col("r_name").alias("state"),
        F.lpad(F.col("n_nationkey").cast("string"), 5, "0").alias("zip"),
        (F.lit(1965) + _mod(k, 58)).cast("int").alias("year_built"),
        (F.col("qty") * F.lit(1000.0)).alias("gross_leasable_sqft"),
        F.when(F.col("o_orderpriority") == "1-URGENT",
               (F.lit(40) + _mod(k, 281)).cast("double")).alias("units"),
        (noi / cap).alias("purchase_price"),
        noi.alias("noi_t12"),
        (F.lit(0.65) + _mod(k, 35) * F.lit(0.01)).alias("occupancy_t12"),
        (rent * opexr).alias("opex_t12"),
        rent.alias("gross_rent_t12"),
        (F.lit(0.5) + _mod(k, 31) * F.lit(0.01)).alias("ltv"),
        (F.lit(0.045) + _mod(ck, 46) * F.lit(0.001)).alias("interest_rate"),
        (F.lit(20) + F.lit(5) * _mod(k, 3)).cast("int").alias("amort_years"),
        (noi * (F.lit(0.97) + _mod(k, 101) * F.lit(0.001))).alias("noi_next12"),
    )


# The same view for DuckDB (used by the oracles).  Kept textually close to the
# DataFrame plan above so that both engines do the same float operations.
DEALS_SQL = """
intake AS (
  SELECT
    CONCAT('D', LPAD(CAST(o.o_orderkey AS VARCHAR), 9, '0')) AS deal_id,
    CAST(o.o_orderdate AS DATE) AS asof_date,
    CASE o.o_orderpriority WHEN '1-URGENT' THEN 'Multifamily' WHEN '2-HIGH' THEN 'Industrial'
         WHEN '3-MEDIUM' THEN 'Retail' WHEN '4-NOT SPECIFIED' THEN 'Office' ELSE 'SelfStorage' END AS property_type,
    n.n_name AS city,
    r.r_name AS state,
    LPAD(CAST(n.n_nationkey AS VARCHAR), 5, '0') AS zip,
    CAST(1965 + o.o_orderkey % 58 AS INTEGER) AS year_built,
    t.qty * 1000.0e0 AS gross_leasable_sqft,
    CASE WHEN o.o_orderpriority = '1-URGENT' THEN CAST(40 + o.o_orderkey % 281 AS DOUBLE) END AS units,
    (t.rent - t.rent * (18e-2 + (o.o_orderkey % 38) * 1e-2)) / (45e-3 + (o.o_custkey % 50) * 1e-3) AS purchase_price,
    t.rent - t.rent * (18e-2 + (o.o_orderkey % 38) * 1e-2) AS noi_t12,
    65e-2 + (o.o_orderkey % 35) * 1e-2 AS occupancy_t12,
    t.rent * (18e-2 + (o.o_orderkey % 38) * 1e-2) AS opex_t12,
    t.rent AS gross_rent_t12,
    5e-1 + (o.o_orderkey % 31) * 1e-2 AS ltv,
    45e-3 + (o.o_custkey % 46) * 1e-3 AS interest_rate,
    CAST(20 + 5 * (o.o_orderkey % 3) AS INTEGER) AS amort_years,
    (t.rent - t.rent * (18e-2 + (o.o_orderkey % 38) * 1e-2)) * (97e-2 + (o.o_orderkey % 101) * 1e-3) AS noi_next12
  FROM orders o
  LEFT JOIN (SELECT l_orderkey,
               CAST(SUM(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) * 3e0 AS rent,
               SUM(CAST(l_quantity AS BIGINT)) AS qty
        FROM lineitem GROUP BY l_orderkey) t ON o.o_orderkey = t.l_orderkey
  JOIN customer c ON o.o_custkey = c.c_custkey
  JOIN nation n ON c.c_nationkey = n.n_nationkey
  JOIN region r ON n.n_regionkey = r.r_regionkey
),
deals AS (SELECT * FROM intake WHERE gross_rent_t12 IS NOT NULL)
"""


def with_deals(sql_body: str, *extra_ctes: str, recursive: bool = False) -> str:
    """Prefix an oracle query with the ``deals`` CTE (and optional more CTEs)."""
    ctes = ",\n".join([DEALS_SQL.strip(), *[c.strip().rstrip(",") for c in extra_ctes]])
    return f"WITH {'RECURSIVE ' if recursive else ''}{ctes}\n{sql_body}"
