"""Token counts with a digest cache (operator 3).

Each text is normalised (null is the empty text; nothing else changes, since
any other change could change the count) and digested.  Digests with the
digest of the tokenizer file are looked up in a stored table; only distinct
texts it lacks are encoded, and their counts are appended to it.

Copies: a text with many copies moves once per input partition, because equal
digests are combined before the shuffle.  The final join brings narrow rows
(no text) to the counts; a hot digest is split there by adaptive execution.

Null and odd input: null and empty texts have 0 bytes and 0 tokens.  Repeated
rows, repeated or null ``doc_id`` give a row each; extra columns are ignored.
An empty table gives an empty result.  A cache with repeated digests (two
writers at once) gives the same result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import PIECE, shared_folder, slices
from .pieces import PieceEncoder, worker_encoder

CACHE_SCHEMA = "content_digest binary, n_tokens bigint, tokenizer_digest string"


def tokenizer_digest(path: str) -> str:
    with open(path, "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()


def _load(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def read_cache(spark: SparkSession, cache: str, version: str) -> DataFrame:
    """Stored counts of one tokenizer version; empty if the table does not exist yet."""
    try:
        rows = spark.read.schema(CACHE_SCHEMA).parquet(cache)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        rows = spark.createDataFrame([], CACHE_SCHEMA)
    return rows.filter(F.col("tokenizer_digest") == version).drop("tokenizer_digest")


def count_tokens(docs: DataFrame, path: str, cache: str | None = None, limit: int = 512) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for every row; ``cache`` is a Parquet table that grows.

    Without ``cache`` a new one is made in the shared folder.
    """
    spark = docs.sparkSession
    cache = cache or shared_folder(spark, "token-counts")
    version = tokenizer_digest(path)
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"),
                        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    texts = texts.withColumn("content_digest", F.unhex(F.sha2(F.col("text"), 256)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_encoder(("counts", path), lambda: PieceEncoder(_load(path), len))
        for batch in slices(batches, "text", PIECE):
            counts = [sum(parts) for parts in encoder.encode(batch.column("text").to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column("content_digest"), pa.array(counts, pa.int64())],
                                             ["content_digest", "n_tokens"])

    distinct = texts.select("content_digest", "text").dropDuplicates(["content_digest"])
    misses = distinct.join(read_cache(spark, cache, version).select("content_digest"), "content_digest", "left_anti")
    (misses.mapInArrow(run, "content_digest binary, n_tokens bigint")
     .withColumn("tokenizer_digest", F.lit(version))
     .write.mode("append").partitionBy("tokenizer_digest").parquet(cache))

    counts = read_cache(spark, cache, version).groupBy("content_digest").agg(F.max("n_tokens").alias("n_tokens"))
    rows = texts.select("doc_id", "content_digest", F.octet_length("text").cast("bigint").alias("n_bytes"))
    return rows.join(counts, "content_digest").select(
        "doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
