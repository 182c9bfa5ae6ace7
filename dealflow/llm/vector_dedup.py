"""Near-duplicate embeddings by spherical-cap filters (operator 8).

Filters are unit directions; a vector exceeds a filter if its inner product
with it passes a threshold, and two vectors that exceed one filter are
candidates.  Directions are structured: in each of ``TABLES`` random rotations a
direction is a pair of codewords, one for each half of the coordinates, so
k * k directions need 2 k codewords, and all exceeding pairs are listed by
going through the codewords of one half in order of their products (list
decoding) until the other half can no longer reach the threshold.

Threshold and code size follow from the number n of distinct vectors and the
two constants ``PER_FILTER`` (vectors that exceed a filter, of n random ones)
and ``PER_VECTOR`` (filters that a vector exceeds), at every n by the same
formula, so candidates grow with n and not with its square.

Near copies in great number: each filter's members are first compared with its
least member.  Those within half the threshold angle of one hub form a ball, all of
whose pairs are links by the triangle inequality, and are counted without being
listed.  Pairs of different balls are listed, asked for 128 sign bits first,
and verified by their cosine in double precision.

Null and odd input: vectors that are null, empty, zero or hold null or
non-finite components, and rows without a label, link with nothing.  Vectors of different
lengths don't link.  Rows with equal label and vector are one class and
link with each other, also if their ``vec_id`` is equal or null; a null id is never a
component's id unless all its ids are null.  Extra columns are ignored.  An
empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written
from .links import components, with_roots

TABLES, PER_FILTER, PER_VECTOR, LEAST = 6, 10, 60, 4000
WIDEST = 0.65
SIGN_WORDS = 2


def cap_share(dims: int, height: float) -> float:
    """Share of the unit sphere in ``dims`` dimensions whose product with a fixed direction is at least ``height``."""
    if dims == 1:
        return 0.5
    angles = np.linspace(0, math.pi, 20001)
    weights = np.sin(angles) ** (dims - 2)
    return float(weights[np.cos(angles) >= height].sum() / weights.sum())


def filter_plan(n: int, dims: int) -> tuple[int, float]:
    """Codewords of a half and the threshold of the product, for n vectors; in few dimensions caps stay wide enough to cover."""
    low, high = 0.0, WIDEST
    for _ in range(40):
        middle = (low + high) / 2
        low, high = (middle, high) if cap_share(dims, middle) > PER_FILTER / max(n, LEAST) else (low, middle)
    return math.ceil(math.sqrt(PER_VECTOR / TABLES / cap_share(dims, low))), low


def usable(vector: Column) -> Column:
    """True for vectors that are not null, empty or zero and have finite components only."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def unit_rows(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Lengths, and the vectors padded with zeros to the longest, scaled to length 1."""
    lengths = pa.compute.list_value_length(column).to_numpy(zero_copy_only=False).astype(np.int64)
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    rows = np.zeros((len(lengths), int(lengths.max(initial=0))))
    rows[np.arange(rows.shape[1]) < lengths[:, None]] = values
    rows /= np.abs(rows).max(axis=1, initial=1e-300, keepdims=True)
    return lengths, rows / np.sqrt((rows * rows).sum(axis=1, keepdims=True))


def _rotation(dims: int, seed: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng([seed, dims]).standard_normal((dims, dims)))
    return q * np.sign(np.diag(r))


def _codewords(dims: int, k: int, seed: int) -> np.ndarray:
    words = np.random.default_rng([seed, dims, k]).standard_normal((k, dims))
    return words / np.sqrt((words * words).sum(axis=1, keepdims=True))


def exceeding(rows: np.ndarray, k: int, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """(row, filter) of all filters that the rows (of one length, scaled to 1) exceed."""
    dims = rows.shape[1]
    half = (dims + 1) // 2
    least = threshold * math.sqrt(2)  # a filter's direction is its two codewords over sqrt(2)
    found_rows, found = [], []
    for table in range(TABLES):
        turned = rows @ _rotation(dims, table)
        one = turned[:, :half] @ _codewords(half, k, 2 * table + 100).T
        other = turned[:, half:] @ _codewords(dims - half, k, 2 * table + 101).T if dims > half else np.zeros((len(rows), k))
        order = np.argsort(-other, axis=1)
        ranked = np.take_along_axis(other, order, axis=1)
        # the r-th best codeword of one half with all of the other, until no row can reach the threshold
        for r in range(k):
            hit = one + ranked[:, r, None] >= least
            if not hit.any():
                break
            at, word = np.nonzero(hit)
            found_rows.append(at)
            found.append((table * k + word) * k + order[at, r])
    return (np.concatenate(found_rows), np.concatenate(found)) if found else (np.zeros(0, int), np.zeros(0, int))


def _signs(rows: np.ndarray) -> list[np.ndarray]:
    """Packed signs of products with fixed random directions: SIGN_WORDS arrays of longs."""
    out = []
    for word in range(SIGN_WORDS):
        planes = np.random.default_rng([7, word, rows.shape[1]]).standard_normal((rows.shape[1], 63))
        out.append((rows @ planes > 0).astype(np.int64) @ (np.int64(1) << np.arange(63, dtype=np.int64)))
    return out


def _members(classes: DataFrame, n: int) -> DataFrame:
    """bucket, node and sign words: a row for each filter that a class exceeds."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plans: dict[int, tuple[int, float]] = {}
        for batch in batches:
            for begin in range(0, batch.num_rows, 512):
                part = batch.slice(begin, 512)
                lengths, rows = unit_rows(part.column("vector"))
                for dims in np.unique(lengths):
                    which = np.flatnonzero(lengths == dims)
                    own = rows[which, :dims]
                    if dims not in plans:
                        plans[dims] = filter_plan(n, int(dims))
                    at, filters = exceeding(own, *plans[dims])
                    take = pa.array(which[at])
                    signs = _signs(own)
                    yield pa.RecordBatch.from_arrays(
                        [part.column("node").take(take), part.column("label").take(take),
                         pa.array(np.full(len(at), dims, np.int32)), pa.array(filters.astype(np.int64)),
                         *(pa.array(s[at]) for s in signs)], ["node", "label", "dims", "filter", "s0", "s1"])

    rows = classes.select("node", "label", "vector").mapInArrow(
        run, "node bigint, label string, dims int, filter bigint, s0 bigint, s1 bigint")
    return rows.select(F.xxhash64("label", "dims", "filter").alias("bucket"), "node", "s0", "s1")


def _sign_room(cosine: float) -> int:
    """Sign bits that may differ at this cosine: the mean and seven deviations."""
    p, bits = math.acos(cosine) / math.pi, 63 * SIGN_WORDS
    return math.ceil(bits * p + 7 * math.sqrt(bits * p * (1 - p)))


def _near(x: str, y: str, room: int) -> Column:
    return sum((F.bit_count(F.col(f"{x}.s{i}").bitwiseXOR(F.col(f"{y}.s{i}"))) for i in range(SIGN_WORDS)), F.lit(0)) <= room


def _verified(pairs: DataFrame, classes: DataFrame, cosine: float) -> DataFrame:
    """The pairs (a, b) of classes with equal label whose cosine is at least ``cosine``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, 2048):
                part = batch.slice(begin, 2048)
                (n_a, a), (n_b, b) = (unit_rows(part.column(c)) for c in ("va", "vb"))
                width = min(a.shape[1], b.shape[1])
                good = ((a[:, :width] * b[:, :width]).sum(axis=1) >= cosine) & (n_a == n_b)
                good &= np.array(part.column("la").to_pylist(), object) == np.array(part.column("lb").to_pylist(), object)
                yield part.select(["a", "b"]).filter(pa.array(good))

    ends = {s: classes.select(F.col("node").alias(s), F.col("vector").alias(f"v{s}"), F.col("label").alias(f"l{s}")) for s in "ab"}
    both = pairs.join(ends["a"], "a").join(ends["b"], "b").select("a", "b", "va", "vb", "la", "lb")
    return both.mapInArrow(run, "a bigint, b bigint")


def near_vectors(embeddings: DataFrame, cosine: float = 0.93, vector: str = "embedding") -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of ``embeddings`` (vec_id, vector, label)."""
    rows = embeddings.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col(vector).cast("array<double>").alias("vector"),
                             F.col("label").cast("string").alias("label"))
    rows = rows.withColumn("good", usable(F.col("vector")) & F.col("label").isNotNull())
    classes = rows.filter("good").groupBy("label", "vector").agg(
        F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("copies"))
    order = [F.asc_nulls_last("rep"), F.xxhash64("label", "vector")]
    classes = written(classes.repartitionByRange(*order).sortWithinPartitions(*order)
                      .withColumn("node", F.monotonically_increasing_id()), "vector-classes")
    members = written(_members(classes, classes.count()), "filter-members")

    # balls: the least hub within half the angle (less a hair for rounding)
    half = math.cos(math.acos(cosine) / 2 - 1e-9)
    hubs = members.groupBy("bucket").agg(F.min("node").alias("hub"), F.max("node").alias("last")).filter("hub <> last")
    signs = members.groupBy("node").agg(F.first("s0").alias("s0"), F.first("s1").alias("s1"))
    to_hub = members.join(hubs, "bucket").filter("hub <> node").select(F.col("hub").alias("a"), F.col("node").alias("b"), "s0", "s1").distinct()
    to_hub = to_hub.alias("x").join(signs.alias("y"), F.col("x.a") == F.col("y.node")).filter(_near("x", "y", _sign_room(half)))
    balls = written(_verified(to_hub.select("a", "b"), classes, half).groupBy("b").agg(F.min("a").alias("root"))
                    .withColumnRenamed("b", "node"), "balls")
    balled = written(with_roots(members, balls).withColumnRenamed("root", "ball"), "balled-members")
    weighted = with_roots(classes.select("node", "copies"), balls).withColumnRenamed("root", "ball")

    # links between balls, listed and verified
    x, y = balled.alias("x"), balled.alias("y")
    pairs = x.join(y, F.col("x.bucket") == F.col("y.bucket")) \
        .filter((F.col("x.node") < F.col("y.node")) & (F.col("x.ball") != F.col("y.ball")) & _near("x", "y", _sign_room(cosine))) \
        .select(F.col("x.node").alias("a"), F.col("y.node").alias("b")).distinct()
    links = written(_verified(pairs, classes, cosine), "vector-links")
    roots = components(links.unionByName(balls.select(F.col("root").alias("a"), F.col("node").alias("b"))))

    in_ball = weighted.groupBy("ball").agg(F.sum("copies").alias("in_ball"))
    both_ways = links.union(links.select("b", "a")).toDF("node", "other")
    across = both_ways.join(classes.select(F.col("node").alias("other"), "copies"), "other") \
        .groupBy("node").agg(F.sum("copies").alias("across"))
    counted = weighted.join(in_ball, "ball").join(across, "node", "left") \
        .select("node", (F.col("in_ball") - 1 + F.coalesce("across", F.lit(0))).alias("n_links"))
    named = with_roots(counted, roots).join(classes.select(F.col("node").alias("root"), F.col("rep").alias("component_id")), "root")
    named = named.join(classes.select("node", F.col("label").alias("l"), F.col("vector").alias("v")), "node") \
        .select("l", "v", "n_links", "component_id", F.lit(True).alias("linked"))
    keyed = rows.withColumn("l", F.when(F.col("good"), F.col("label"))).withColumn("v", F.when(F.col("good"), F.col("vector")))
    found = keyed.drop("label", "vector").join(named, ["l", "v"], "left")
    component = F.when(F.col("linked"), F.col("component_id")).otherwise(F.col("vec_id"))
    return found.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), component.alias("component_id")) \
        .withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
