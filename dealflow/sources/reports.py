"""Deal-table scans with load checks, report sinks and scans.

Reports are small (one row per model, fold or feature); they are still
written with DataFrame writers so that they land on the same storage as the
data and are produced by the same jobs.
"""

from __future__ import annotations

import json
from datetime import datetime, timezone

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.ridge import RidgeModel

TIME_COL = "asof_date"
TARGET = "noi_next12"

DEAL_SCHEMA = T.StructType([
    T.StructField("deal_id", T.StringType()), T.StructField("asof_date", T.StringType()),
    T.StructField("property_type", T.StringType()), T.StructField("city", T.StringType()),
    T.StructField("state", T.StringType()), T.StructField("zip", T.StringType()),
    T.StructField("year_built", T.IntegerType()), T.StructField("gross_leasable_sqft", T.DoubleType()),
    T.StructField("units", T.DoubleType()), T.StructField("purchase_price", T.DoubleType()),
    T.StructField("noi_t12", T.DoubleType()), T.StructField("occupancy_t12", T.DoubleType()),
    T.StructField("opex_t12", T.DoubleType()), T.StructField("gross_rent_t12", T.DoubleType()),
    T.StructField("ltv", T.DoubleType()), T.StructField("interest_rate", T.DoubleType()),
    T.StructField("amort_years", T.IntegerType()), T.StructField(TARGET, T.DoubleType()),
])


class DealLoadError(ValueError):
    pass


def load_deals(spark: SparkSession, path: str, fmt: str = "csv") -> DataFrame:
    """S1 + S2: read a deal table, bind its columns by name and check them.

    Columns may come in any order; known ones are cast to their type, others
    are kept as they are.  In this order: a missing time column, values that are no dates, a
    missing target and values that don't fit their column's type are errors,
    with up to 5 bad rows (a ``limit(5)`` job, not a collect of the table).
    """
    df = spark.read.option("header", True).csv(path) if fmt == "csv" else spark.read.format(fmt).load(path)
    if TIME_COL not in df.columns:
        raise DealLoadError(f"the deal table has no {TIME_COL} column")
    bad = df.filter(F.try_to_date(F.col(TIME_COL).cast("string")).isNull()).limit(5).collect()
    if bad:
        raise DealLoadError(f"{TIME_COL}: values that are no dates, such as\n" + "\n".join(map(str, bad)))
    if TARGET not in df.columns:
        raise DealLoadError(f"the deal table has no {TARGET} column to learn from")
    typed = [f for f in DEAL_SCHEMA.fields if f.name in df.columns and f.name != TIME_COL]
    unfit = F.lit(False)
    for f in typed:
        unfit = unfit | (F.col(f.name).isNotNull() & F.col(f.name).cast("string").try_cast(f.dataType).isNull())
    bad = df.filter(unfit).limit(5).collect()
    if bad:
        raise DealLoadError("values that don't fit their column's type, such as\n" + "\n".join(map(str, bad)))
    return df.withColumns({TIME_COL: F.try_to_date(F.col(TIME_COL).cast("string")),
                           **{f.name: F.col(f.name).cast("string").try_cast(f.dataType) for f in typed}})


def export_chronological(df: DataFrame, path: str) -> None:
    """S3: deals sorted by (date, id) -- a range-partitioned sort -- as CSV with ISO dates."""
    (df.withColumn(TIME_COL, F.date_format(TIME_COL, "yyyy-MM-dd"))
     .orderBy(TIME_COL, "deal_id").write.mode("overwrite").option("header", True).csv(path))


def write_csv_report(df: DataFrame, path: str) -> None:
    """Small report table as one CSV file with a header."""
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def write_json_report(df: DataFrame, path: str) -> None:
    """Report rows as JSON lines in one file."""
    df.coalesce(1).write.mode("overwrite").json(path)


def record_frame(spark: SparkSession, record: dict) -> DataFrame:
    """A one-row DataFrame from a small report record (metadata, not data)."""
    return spark.read.json(spark.sparkContext.parallelize([json.dumps(record, default=str)]))


IMPORTANCE_ROW = T.StructType([
    T.StructField("feature", T.StringType()), T.StructField("importance_mean", T.DoubleType()),
    T.StructField("importance_std", T.DoubleType())])
IMPORTANCE_REPORT = T.StructType([
    T.StructField("target", T.StringType()), T.StructField("method", T.StringType()),
    T.StructField("scoring", T.StringType()), T.StructField("n_repeats", T.LongType()),
    T.StructField("rows_test", T.LongType()),
    T.StructField("rows", T.ArrayType(IMPORTANCE_ROW)),
    T.StructField("feature_importance", T.ArrayType(IMPORTANCE_ROW)),
    T.StructField("dataset_hash", T.StringType()), T.StructField("model_version", T.StringType()),
    T.StructField("trained_at_utc", T.StringType()),
])
SNAPSHOT = T.StructType([
    T.StructField("model_version", T.StringType()), T.StructField("trained_at_utc", T.StringType()),
    T.StructField("model_path", T.StringType()), T.StructField("best_model_name", T.StringType()),
    T.StructField("dataset_hash", T.StringType()),
])


def read_importance_report(spark: SparkSession, path: str) -> DataFrame:
    """``rows``, else ``feature_importance``, else an error; absent trace keys -> null."""
    r = spark.read.schema(IMPORTANCE_REPORT).option("multiLine", True).json(path)
    rows = F.coalesce(F.col("rows"), F.col("feature_importance"))
    return r.select(
        "method", "n_repeats", "scoring", "model_version", "trained_at_utc", "dataset_hash",
        F.when(rows.isNull(), F.raise_error(F.lit("importance report: neither rows nor feature_importance is there")))
        .otherwise(rows).alias("rows"))


def read_snapshot_lenient(spark: SparkSession, path: str) -> DataFrame:
    """Model snapshot, missing or corrupt -> one all-null record (PERMISSIVE)."""
    try:
        snap = spark.read.schema(SNAPSHOT).option("mode", "PERMISSIVE").option("multiLine", True).json(path)
        if snap.limit(1).count():
            return snap.limit(1)
    except AnalysisException as e:
        # a missing file is a normal state here; storage errors are not
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
    return spark.createDataFrame([tuple([None] * len(SNAPSHOT.fields))], SNAPSHOT)


def importance_report(spark: SparkSession, importance: DataFrame, snapshot: DataFrame, dataset_hash: str | None,
                      n_test: int, ridge_coefs: DataFrame | None = None) -> DataFrame:
    """importance rows + provenance (dataset hash falls back to the snapshot's).

    The snapshot contributes three metadata strings; the coefficient list is
    at most 50 rows (model parameters), so both are read as literals.
    """
    snap = snapshot.limit(1).collect()
    meta = snap[0].asDict() if snap else {}
    cols = [
        F.lit(TARGET).alias("target"), F.lit("permutation_importance").alias("method"),
        F.lit("neg_mean_absolute_error").alias("scoring"), F.lit(10).alias("n_repeats"),
        F.lit(n_test).alias("rows_test"), "rows", F.col("rows").alias("feature_importance"),
        F.lit(dataset_hash or meta.get("dataset_hash")).alias("dataset_hash"),
        F.lit(meta.get("model_version")).alias("model_version"),
        F.lit(meta.get("trained_at_utc")).alias("trained_at_utc"),
    ]
    if ridge_coefs is not None:
        coefs = [F.struct(F.lit(r["feature"]).alias("feature"), F.lit(float(r["coefficient"])).alias("coefficient"))
                 for r in ridge_coefs.limit(50).collect()]
        cols.append(F.array(*coefs).alias("ridge_coefficients"))
    ordered = importance.select(F.struct((-F.col("importance_mean")).alias("k"), "feature", "importance_mean",
                                         "importance_std").alias("s"))
    rows = ordered.agg(F.transform(F.array_sort(F.collect_list("s")), lambda x: F.struct(
        x["feature"].alias("feature"), x["importance_mean"].alias("importance_mean"),
        x["importance_std"].alias("importance_std"))).alias("rows"))
    return rows.select(*cols)


def model_snapshot(spark: SparkSession, best_name: str, metrics: DataFrame, dataset_hash: str | None,
                   model_path: str) -> DataFrame:
    """one-row snapshot with the holdout metrics of every candidate."""
    return metrics.agg(F.collect_list(F.struct(*metrics.columns)).alias("holdout_metrics")).select(
        F.lit("v1").alias("model_version"),
        F.lit(datetime.now(timezone.utc).isoformat()).alias("trained_at_utc"),
        F.lit(model_path).alias("model_path"), F.lit(best_name).alias("best_model_name"),
        F.lit(dataset_hash).alias("dataset_hash"), "holdout_metrics")


def save_model(fitted, path: str) -> None:
    """A ridge model as one JSON record; a tree model as its pipeline and feature statistics."""
    spark = SparkSession.getActiveSession()
    if isinstance(fitted, RidgeModel):
        spec = {"name": fitted.name, "record": json.dumps(fitted.record())}
    else:
        fitted.model.write().overwrite().save(f"{path}/pipeline")
        spec = dict(fitted.spec.__dict__, name=fitted.name)
    record_frame(spark, spec).coalesce(1).write.mode("overwrite").json(f"{path}/spec")


def load_model(path: str):
    """Load what ``save_model`` wrote, or fail with a clear message."""
    from pyspark.ml import PipelineModel

    from ..operators.models import FeatureSpec, FittedModel
    spark = SparkSession.getActiveSession()
    try:
        spec = spark.read.json(f"{path}/spec").first().asDict(recursive=True)
        if spec.get("record"):
            return RidgeModel.from_record(json.loads(spec["record"]))
        model = PipelineModel.load(f"{path}/pipeline")
    except Exception as e:  # noqa: BLE001
        raise FileNotFoundError(f"no saved model at {path}") from e
    name = spec.pop("name")
    spec = {k: v for k, v in spec.items() if k in FeatureSpec.__dataclass_fields__}
    return FittedModel(name, FeatureSpec(**spec), model)
