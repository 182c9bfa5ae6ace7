"""Token ids as ORC files (operator 7).

Documents are range-partitioned and sorted by ``doc_id`` and encoded where
they lie, so the files follow each other in ascending order.  Each ORC stripe
keeps the ids as run-length-coded integers, with row indexes and a Bloom filter
on ``doc_id``: readers split files by stripes, and a lookup of a few documents
skips stripes and row groups by metadata (``read_token_orc``).

File columns: ``part`` (number of the file in order), ``doc_id``,
``start_in_part`` (ids before the document in its file), ``n_tokens``, ``ids``.
A document's global start is its part's start plus ``start_in_part``.

Null and odd input: a null or empty text has only the end id.  Null ``doc_id``
comes last; rows with equal ``doc_id`` follow each other in the order of their
text's hash and the text, each as a document of its own.  Extra columns are not written.
An empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import shared_folder, slices
from .pieces import WordEncoder, worker_encoder

FILE_SCHEMA = "part int, doc_id bigint, start_in_part bigint, n_tokens bigint, ids array<int>"


def _load(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def write_token_orc(docs: DataFrame, path: str, tokenizer_path: str, end_id: int, word_end: str = "</w>") -> None:
    """Encode every whole text, append ``end_id`` and write the files to ``path`` (which must not exist).

    The tokenizer drops blanks, lower-cases, and ends words with tokens that have the suffix ``word_end``.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_encoder(("ids", tokenizer_path), lambda: WordEncoder(_load(tokenizer_path), word_end))
        part, begin = TaskContext.get().partitionId(), 0
        for batch in slices(batches, "text"):
            flat, ends = encoder.encode(batch.column("text"))
            # the end id goes behind each document's ids
            flat = np.insert(flat, ends[1:], end_id).astype(np.int32)
            bounds = ends + np.arange(len(ends))
            counts = np.diff(bounds)
            ids = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(flat))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(counts), part, np.int32)), batch.column("doc_id"), pa.array(begin + bounds[:-1]),
                 pa.array(counts), ids], ["part", "doc_id", "start_in_part", "n_tokens", "ids"])
            begin += int(bounds[-1])

    keyed = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"),
                        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    order = [F.asc_nulls_last("doc_id"), F.asc("tie"), F.asc("text")]
    (keyed.withColumn("tie", F.xxhash64("text")).repartitionByRange(*order[:2]).sortWithinPartitions(*order)
     .select("doc_id", "text").mapInArrow(run, FILE_SCHEMA)
     .write.option("compression", "zstd").option("orc.create.index", "true")
     .option("orc.bloom.filter.columns", "doc_id").option("orc.bloom.filter.fpp", "0.01").orc(path))


def read_token_orc(spark: SparkSession, path: str, doc_ids: list[int] | None = None) -> DataFrame:
    """The files' rows; ``doc_ids`` prunes stripes and row groups by their index and Bloom filter."""
    rows = spark.read.schema(FILE_SCHEMA).orc(path)
    return rows if doc_ids is None else rows.filter(F.col("doc_id").isin([int(d) for d in doc_ids]))


def token_index(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document, from the files."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("ids")
            values = ids.flatten().to_numpy(zero_copy_only=False).astype("<u4")
            lengths = pa.compute.list_value_length(ids).to_numpy(zero_copy_only=False).astype(np.int64)
            bounds = np.concatenate([[0], np.cumsum(lengths)])
            crcs = [zlib.crc32(values[a:b]) for a, b in zip(bounds[:-1], bounds[1:])]
            yield pa.RecordBatch.from_arrays(
                [batch.column("part"), batch.column("doc_id"), batch.column("start_in_part"), pa.array(lengths),
                 pa.array(crcs, pa.int64())], ["part", "doc_id", "start_in_part", "n_tokens", "ids_crc32"])

    files = read_token_orc(spark, path)
    # One row for each file: its number of ids, then the ids before it.
    before = (files.groupBy("part").agg(F.sum("n_tokens").alias("held"))
              .withColumn("part_start", F.sum("held").over(Window.orderBy("part")) - F.col("held"))
              .select("part", "part_start"))
    rows = files.select("part", "doc_id", "start_in_part", "ids").mapInArrow(
        run, "part int, doc_id bigint, start_in_part bigint, n_tokens bigint, ids_crc32 bigint")
    return rows.join(before, "part").select(
        "doc_id", (F.col("part_start") + F.col("start_in_part")).alias("start"), "n_tokens", "ids_crc32")


def encode_to_orc(docs: DataFrame, tokenizer_path: str, end_id: int, path: str | None = None) -> DataFrame:
    """Write all documents (to a new shared folder unless ``path`` is given) and return ``token_index`` of the files."""
    spark = docs.sparkSession
    path = path or shared_folder(spark, "token-orc")
    write_token_orc(docs, path, tokenizer_path, end_id)
    return token_index(spark, path)
