"""Streaming scoring of incoming deal requests (re-aim of request-at-a-time serving).

``readStream`` of JSON lines -> typed fields or errors (S10) -> validation (P1,
P2) -> anchor prediction -> ROI (R3) -> ``foreachBatch`` writing accepted and
quarantined rows.  Each micro-batch overwrites its own ``batch_id=<n>``
folder, so a batch replayed after a failure replaces, never duplicates, its
output; progress lives in the query checkpoint on shared storage.  Requests
are independent (stateless map), so no watermark is needed.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.loan import ROI_FIELDS, roi_columns
from ..functions.text import parse_document_paths
from ..operators.validate import validate
from ..session import ensure_checkpoint_dir

REQUEST_SCHEMA = T.StructType([
    T.StructField("deal_id", T.StringType()),
    T.StructField("asof_date", T.StringType()),
    T.StructField("property_type", T.StringType()),
    T.StructField("city", T.StringType()),
    T.StructField("state", T.StringType()),
    T.StructField("zip", T.StringType()),
    T.StructField("year_built", T.IntegerType()),
    T.StructField("gross_leasable_sqft", T.DoubleType()),
    T.StructField("units", T.DoubleType()),
    T.StructField("purchase_price", T.DoubleType()),
    T.StructField("noi_t12", T.DoubleType()),
    T.StructField("occupancy_t12", T.DoubleType()),
    T.StructField("opex_t12", T.DoubleType()),
    T.StructField("gross_rent_t12", T.DoubleType()),
    T.StructField("unstructured_text", T.StringType()),
    T.StructField("deal_notes", T.StringType()),
    T.StructField("document_paths", T.ArrayType(T.StringType())),
    T.StructField("ltv", T.DoubleType()),
    T.StructField("interest_rate", T.DoubleType()),
    T.StructField("amort_years", T.IntegerType()),
    T.StructField("exit_cap_rate", T.DoubleType()),
    T.StructField("selling_cost_pct", T.DoubleType()),
])


def parse_requests(lines: DataFrame, column: str = "value") -> DataFrame:
    """One JSON object per line -> typed columns, ``raw`` and ``type_errors``; no line is lost.

    Every field is read as text first and then cast, so a value of the wrong type is an
    error of its own row with the field's name; a line that is no JSON object has one error.
    """
    texts = T.StructType([T.StructField(f.name, T.StringType()) for f in REQUEST_SCHEMA] + [T.StructField("_corrupt", T.StringType())])
    parsed = F.from_json(F.col(column), texts, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    rows = lines.select(F.col(column).alias("raw"), parsed.alias("_r")).withColumn(
        "_broken", F.col("_r").isNull() | F.col("_r._corrupt").isNotNull() | ~F.col("raw").rlike(r"^\s*\{"))
    kinds = {"int": "a whole number", "double": "a number"}
    out, errors = {}, []
    for f in REQUEST_SCHEMA:
        given = F.when(~F.col("_broken"), F.col(f"_r.{f.name}"))
        name = f.dataType.simpleString()
        if name in kinds:
            out[f.name] = given.try_cast(f.dataType)
            errors.append(F.when(given.isNotNull() & out[f.name].isNull(), F.lit(f"{f.name}: not {kinds[name]}")))
        else:
            out[f.name] = parse_document_paths(given) if name.startswith("array") else given
    found = F.filter(F.array(F.when(F.col("_broken"), F.lit("not a JSON object")), *errors), lambda x: x.isNotNull())
    return rows.select("raw", *[c.alias(n) for n, c in out.items()], found.alias("type_errors"))


def score_requests(requests: DataFrame, predictor) -> DataFrame:
    """E1 on any (batch or streaming) request frame: status, errors, prediction, ROI.

    ``type_errors`` of parsed requests come first; such a field isn't reported as missing too,
    and a line that couldn't be read has no other error.  Rejected lines keep their ``raw`` text.
    """
    v = validate(requests)
    if "type_errors" in requests.columns:
        typed = F.col("type_errors")
        named = F.transform(typed, lambda e: F.concat(F.substring_index(e, ":", 1), F.lit(" is required")))
        rest = F.when(F.array_contains(typed, "not a JSON object"), F.array().cast("array<string>")).otherwise(
            F.filter("errors", lambda e: ~F.array_contains(named, e)))
        v = v.withColumn("errors", F.concat(typed, rest)).withColumn(
            "status", F.when(F.size("errors") == 0, F.lit("accepted")).otherwise(F.lit("quarantined")))
    scored = predictor(v)
    roi = roi_columns("purchase_price", "predicted_noi_next12", "ltv", "interest_rate", "amort_years",
                      "exit_cap_rate", "selling_cost_pct")
    ok = F.col("status") == "accepted"
    return scored.select(
        "deal_id", "status", F.array_join("errors", "; ").alias("errors"),
        F.when(ok, F.col("predicted_noi_next12")).alias("predicted_noi_next12"),
        *[F.when(ok, roi[k]).alias(k) for k in ROI_FIELDS], *[F.when(~ok, F.col("raw")).alias("raw") for c in requests.columns if c == "raw"])


def start_scoring_stream(spark: SparkSession, source_dir: str, out_dir: str, checkpoint_dir: str, predictor,
                         available_now: bool = True, max_files_per_trigger: int | None = None):
    """Start the stream; returns the StreamingQuery."""
    reader = spark.readStream
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    scored = score_requests(parse_requests(reader.text(source_dir)), predictor)

    def write_batch(batch: DataFrame, batch_id: int) -> None:
        # accepted and quarantined rows land in status=<...> sub-folders of
        # this batch's folder; a replayed batch overwrites exactly that folder
        batch.write.mode("overwrite").partitionBy("status").parquet(f"{out_dir}/batch_id={batch_id}")

    w = scored.writeStream.foreachBatch(write_batch).option("checkpointLocation", checkpoint_dir)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="10 seconds")
    return w.start()


def scratch_root(spark: SparkSession, name: str) -> str:
    """A fresh folder under the cluster's shared checkpoint directory."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
