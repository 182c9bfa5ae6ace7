"""Vector code compression by tries over distinct parts (operator 11).

Components become integers, vectors are cut into equal parts, and each part is
replaced by the index of its nearest codebook entry.  The distinct parts of each
position and their numbers of copies are one table, range-sorted, so that every task holds
neighbouring leaves of a lexicographic trie.  A depth-first traversal keeps, for
each node, the distances of its prefix to all entries: a child adds one squared
difference for each entry to its parent's vector, once for all parts below it.  Leaves take
the nearest entry, and their components, weighted by copies, go into the sums
from which the next round's entries are made.

Null and odd input: vectors that are null or hold null or non-finite components
are dropped, and so are those whose length isn't the most frequent (ties: the smaller)
of the lengths that can be cut into equal, non-empty parts.  Zero vectors are kept.  A component
beyond +-2^26 (a value beyond +-262144) counts as that bound, so that every error is a long.
Rows are coded one by one: repeated rows and ids have rows of their own; null ids come last
and equal ids are in the order of their components when the first codebook is taken.
With fewer rows than entries the codebook is as short as the table.  Null labels are one group; a group's
sum beyond a long is null.  Extra columns are ignored.  An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.joins import join_small
from .common import written

BOUND = 1 << 26
BIAS = 1 << 31


def finite(vector: Column) -> Column:
    """True for a vector without null, NaN or infinite components."""
    return vector.isNotNull() & F.forall(vector, lambda x: F.coalesce(F.abs(x) < F.lit(float("inf")), F.lit(False)))


def quantized(column: pa.Array, dims: int, scale: int) -> np.ndarray:
    """Integer components, a row for each vector."""
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dims)
    return np.clip(np.floor(x * scale), -BOUND, BOUND).astype(np.int64)


def pack(parts: np.ndarray) -> pa.Array:
    """Parts as binary strings whose order is the lexicographic order of the components."""
    n, width = parts.shape
    offsets = np.arange(n + 1, dtype=np.int32) * (4 * width)
    data = (parts + BIAS).astype(">u4").tobytes()
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(data)])


def unpack(column: pa.Array, width: int) -> np.ndarray:
    data = b"".join(column.to_pylist())
    return np.frombuffer(data, ">u4").astype(np.int64).reshape(-1, width) - BIAS


def distinct(parts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct parts, their copies, and the place of every given part among them."""
    order = np.lexsort(parts.T[::-1])
    ordered = parts[order]
    fresh = np.append(True, (ordered[1:] != ordered[:-1]).any(axis=1)) if len(parts) else np.zeros(0, bool)
    place = np.empty(len(parts), np.int64)
    place[order] = np.cumsum(fresh) - 1
    return ordered[fresh], np.bincount(place, minlength=int(fresh.sum())), place


def nearest(parts: np.ndarray, entries: np.ndarray, leaves: int = 4096) -> tuple[np.ndarray, np.ndarray]:
    """Nearest entry (ties: the lower index) and its squared distance for sorted distinct parts.

    Sorted order is the order in which a depth-first traversal meets the leaves.
    It goes over ``leaves`` of them at a time; a node's vector of distances is
    made once from its parent's, however many leaves lie below it.
    """
    codes, errors = np.empty(len(parts), np.int64), np.empty(len(parts), np.int64)
    for begin in range(0, len(parts), leaves):
        own = parts[begin:begin + leaves]
        opens = np.zeros(len(own), bool)  # the leaf is the first below its node
        opens[0] = True
        node = np.zeros(len(own), np.int64)
        sums = np.zeros((1, len(entries)), np.int64)
        for depth in range(own.shape[1]):
            opens[1:] |= own[1:, depth] != own[:-1, depth]
            first = np.flatnonzero(opens)
            sums = sums[node[first]] + (own[first, depth][:, None] - entries[:, depth]) ** 2
            node = np.cumsum(opens) - 1
        codes[begin:begin + leaves] = sums.argmin(axis=1)
        errors[begin:begin + leaves] = sums.min(axis=1)
    return codes, errors


def distinct_parts(vectors: DataFrame, dims: int, n_parts: int, scale: int) -> DataFrame:
    """position, part, copies: distinct parts of all vectors, counted in each batch first."""
    width = dims // n_parts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                whole = quantized(batch.column("vector"), dims, scale)
                for position in range(n_parts):
                    own, copies, _ = distinct(whole[:, position * width:(position + 1) * width])
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), position, np.int32)), pack(own), pa.array(copies)],
                                                     ["position", "part", "copies"])

    found = vectors.select("vector").mapInArrow(run, "position int, part binary, copies bigint")
    return found.groupBy("position", "part").agg(F.sum("copies").alias("copies"))


def next_codebooks(parts: DataFrame, books: np.ndarray) -> np.ndarray:
    """One round: every distinct part to its nearest entry, entries to the floor of their parts' mean.

    What comes back to the driver is a sum for each entry and component.
    """
    n_parts, n_entries, width = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            positions = batch.column("position").to_numpy()
            for position in np.unique(positions):
                own = batch.filter(pa.array(positions == position))
                values, copies = unpack(own.column("part"), width), own.column("copies").to_numpy()
                codes, _ = nearest(values, books[position])
                # the last column counts the copies
                sums = np.zeros((n_entries, width + 1), np.int64)
                np.add.at(sums, codes, np.column_stack([values * copies[:, None], copies]))
                entry, axis = (x.ravel().astype(np.int32) for x in np.indices(sums.shape))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(sums.size, position, np.int32)), pa.array(entry), pa.array(axis),
                                                  pa.array(sums.ravel())], ["position", "entry", "axis", "total"])

    sums = np.zeros((n_parts, n_entries, width + 1), object)
    for r in parts.mapInArrow(run, "position int, entry int, axis int, total bigint").groupBy("position", "entry", "axis") \
            .agg(F.sum("total").alias("total")).collect():
        sums[r["position"], r["entry"], r["axis"]] = int(r["total"])
    out = books.copy()
    for position, entry in np.argwhere(sums[:, :, width] > 0):
        out[position, entry] = [s // sums[position, entry, width] for s in sums[position, entry, :width]]
    return out


def assign(vectors: DataFrame, books: np.ndarray, scale: int) -> DataFrame:
    """The vectors' columns but ``vector``, with ``code`` and ``error``: a trie for each position of each batch."""
    n_parts, _, width = books.shape
    others = [f for f in vectors.schema.fields if f.name != "vector"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            whole = quantized(batch.column("vector"), n_parts * width, scale)
            codes, error = np.empty((len(whole), n_parts), np.uint8), np.zeros(len(whole), np.int64)
            for position in range(n_parts):
                own, _, place = distinct(whole[:, position * width:(position + 1) * width])
                code, distance = nearest(own, books[position])
                codes[:, position] = code[place]
                error += distance[place]
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in others), pa.array([row.tobytes().hex() for row in codes], pa.string()),
                                              pa.array(error)], [*(f.name for f in others), "code", "error"])

    schema = T.StructType([*others, T.StructField("code", T.StringType()), T.StructField("error", T.LongType())])
    return vectors.mapInArrow(run, schema)


def fit(vectors: DataFrame, dims: int, n_parts: int, n_entries: int, rounds: int, scale: int) -> np.ndarray:
    """Codebooks (position, entry, component), started from the rows with the smallest ids."""
    first = vectors.select("vec_id", F.transform("vector", lambda x: F.greatest(F.lit(float(-BOUND)), F.least(
        F.lit(float(BOUND)), F.floor(x.cast("double") * scale).cast("double"))).cast("bigint")).alias("whole"))
    seeds = [r["whole"] for r in first.orderBy(F.asc_nulls_last("vec_id"), "whole").limit(n_entries).collect()]
    books = np.array(seeds, np.int64).reshape(len(seeds), n_parts, dims // n_parts).transpose(1, 0, 2)
    # neighbouring leaves lie together, in files that all rounds read
    parts = written(distinct_parts(vectors, dims, n_parts, scale).repartitionByRange("position", "part")
                    .sortWithinPartitions("position", "part"), "vector-parts")
    for _ in range(rounds):
        books = next_codebooks(parts, books)
    return books


def digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(str(x) for x in books.ravel().tolist()).encode()).hexdigest()


def compress(rows: DataFrame, n_parts: int = 16, n_entries: int = 64, rounds: int = 2, scale: int = 256) -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256, label of each kept row of (vec_id, embedding, label)."""
    spark = rows.sparkSession
    if not 0 < n_entries <= 256:
        raise ValueError("codes are two hex digits: 1 to 256 entries")
    given = rows.select("vec_id", "label", F.col("embedding").alias("vector")).filter(finite(F.col("vector")))
    sizes = (given.filter((F.size("vector") > 0) & (F.size("vector") % n_parts == 0)).groupBy(F.size("vector").alias("dims"))
             .agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "dims").first())
    if sizes is None:
        return spark.createDataFrame([], T.StructType([
            rows.schema["vec_id"], T.StructField("code", T.StringType()), T.StructField("error", T.LongType()),
            T.StructField("label_error", T.LongType()), T.StructField("codebooks_sha256", T.StringType()), rows.schema["label"]]))
    dims = sizes["dims"]
    vectors = given.filter(F.size("vector") == dims)
    books = fit(vectors, dims, n_parts, n_entries, rounds, scale)
    coded = written(assign(vectors, books, scale), "vector-codes")
    totals = coded.groupBy(F.col("label").alias("of_label")).agg(F.try_sum("error").alias("label_error"))
    out = join_small(coded, totals, F.col("label").eqNullSafe(F.col("of_label")), "left")
    return out.select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"), "label")


def codes_sql(n_parts: int = 16, n_entries: int = 64, rounds: int = 2, scale: int = 256) -> str:
    """DuckDB SQL for the query's rows: every part against every entry."""
    steps = []
    for k in range(rounds + 1):
        steps.append(f"""
near{k} AS (
  SELECT vec_id, p, min(distance * {n_entries} + e) AS best FROM (
    SELECT x.vec_id, x.p, b.e, sum((x.value - b.value) * (x.value - b.value)) AS distance
    FROM parts x JOIN book{k} b ON x.p = b.p AND x.i = b.i GROUP BY x.vec_id, x.p, b.e)
  GROUP BY vec_id, p)""")
        if k < rounds:
            steps.append(f"""
book{k + 1} AS (
  SELECT b.p, b.e, b.i, coalesce(m.value, b.value) AS value FROM book{k} b LEFT JOIN (
    SELECT n.p, CAST(n.best % {n_entries} AS BIGINT) AS e, x.i, CAST(floor(CAST(sum(x.value) AS DOUBLE) / count(*)) AS BIGINT) AS value
    FROM near{k} n JOIN parts x ON n.vec_id = x.vec_id AND n.p = x.p GROUP BY ALL) m
  ON b.p = m.p AND b.e = m.e AND b.i = m.i)""")
    return f"""
WITH kept AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT)) AS whole
  FROM embeddings WHERE len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
parts AS (
  SELECT vec_id, (i - 1) // (len(whole) // {n_parts}) AS p, (i - 1) % (len(whole) // {n_parts}) AS i, whole[i] AS value
  FROM (SELECT *, unnest(range(1, len(whole) + 1)) AS i FROM kept)),
firsts AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS e FROM kept ORDER BY vec_id LIMIT {n_entries}),
book0 AS (SELECT x.p, f.e, x.i, x.value FROM parts x JOIN firsts f USING (vec_id)),
{",".join(steps)},
coded AS (
  SELECT vec_id, string_agg(lpad(lower(to_hex(CAST(best % {n_entries} AS BIGINT))), 2, '0'), '' ORDER BY p) AS code,
         CAST(sum(best // {n_entries}) AS BIGINT) AS error
  FROM near{rounds} GROUP BY vec_id)
SELECT c.vec_id, c.code, c.error, CAST(sum(c.error) OVER (PARTITION BY k.label) AS BIGINT) AS label_error,
       (SELECT sha256(string_agg(CAST(value AS VARCHAR), ',' ORDER BY p, e, i)) FROM book{rounds}) AS codebooks_sha256, k.label
FROM coded c JOIN kept k USING (vec_id)
"""
