"""Helpers shared by the training-data operators: tables, written intermediates, Arrow batches."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute  # noqa: F401 - makes pa.compute available
from pyspark.sql import DataFrame, SparkSession

from ..session import ensure_checkpoint_dir, ship_package


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession, what: str) -> str:
    """A new folder name below the shared checkpoint folder, which every executor can reach."""
    return f"{ensure_checkpoint_dir(spark)}/{what}-{uuid.uuid4().hex}"


#: A packed table gets a file for so many bytes that its rows are made of, and some for each core in any case.
FILE_BYTES, FILES_A_CORE = 1 << 20, 2


def _files(df: DataFrame) -> int:
    """Files of a packed table, by the size of the folders that ``df`` reads."""
    sc = df.sparkSession.sparkContext
    size = 0
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = sc._jvm.org.apache.hadoop.fs.Path(sc._jvm.java.net.URI(folder))
        size += path.getFileSystem(sc._jsc.hadoopConfiguration()).getContentSummary(path).getLength()
    return max(FILES_A_CORE * sc.defaultParallelism, -(-size // FILE_BYTES))


def written(df: DataFrame, what: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back.

    This cuts the lineage: later jobs, and retries after a lost executor, read
    the files instead of running the plan again.
    """
    spark = df.sparkSession
    path = shared_folder(spark, what)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def packed(df: DataFrame) -> DataFrame:
    """``df`` for ``written`` with small partitions together, as each file costs requests (and on a local disk some processes, ``chmod``)."""
    return df.coalesce(_files(df))


#: Bytes of text that are made Python objects at a time where these take many times the room of the text; a
#: worker keeps much of the room it once took, also while it has nothing to do.
PIECE = 1 << 19


def slices(batches: Iterator[pa.RecordBatch], column: str, max_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that ``column`` holds about ``max_bytes`` in each piece.

    A single value over the limit is a piece of its own, so that memory follows
    the longest text and never the batch.  An empty batch yields nothing.
    """
    for batch in batches:
        col = batch.column(batch.schema.get_field_index(column))
        sizes = pa.compute.fill_null(pa.compute.binary_length(col), 0).to_numpy(zero_copy_only=False)
        begin, held = 0, 0
        for i, n in enumerate(sizes):
            if held and held + n > max_bytes:
                yield batch.slice(begin, i - begin)
                begin, held = i, 0
            held += int(n)
        if begin < len(sizes):
            yield batch.slice(begin)
