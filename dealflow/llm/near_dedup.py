"""Near-duplicate documents by fast similarity sketches, banding and exact verification (operator 6).

Documents with equal shingle sets form a class; one member stands for it.  A
class's sketch (96 coordinates) is cut into 24 bands of 4; classes that share
a band are candidates, which a true pair at the threshold of 0.8 misses with
probability (1 - 0.8^4)^24, about 3 in a million, and a closer pair less.
``link_buckets`` compares each band's members with one hub.  What is then still
apart is compared pair by pair, in large groups only where what both have and
lack of the hub (exact bits) leaves room for a link, so a group of thousands
of near copies costs few comparisons more than it has members.  A comparison counts the intersection of the full shingle sets.

Before a comparison two cheap conditions are asked: sizes must allow the
similarity, and of 96 one-bit sketch coordinates at most 30 may differ (a true
link differs in 9.6 on average with deviation 2.9; seven deviations are allowed).

Only texts of classes with a candidate move; signatures are small.

Null and odd input: a null, empty or blank text has an empty set and links
with nothing; its component is its own ``doc_id``.  Rows equal in text, also
with one ``doc_id``, are members of one class.  A null ``doc_id`` belongs to
its class but is never a component's id unless all ids in it are null; then the id
is null.  Extra columns are ignored (``near_duplicates``) or kept
(``deduplicate``).  An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.joins import join_small
from .common import PIECE, packed, slices, written
from .links import link_buckets, with_roots
from .shingles import bands, low_bits, set_digest, shingle_set, sketch

BANDS, ROWS, MAX_DIFFERING = 24, 4, 30
NEW_BITS = 252
_SIGNATURE = ("doc_id bigint, k1 bigint, k2 bigint, n_shingles bigint, digest binary, bits1 bigint, bits2 bigint, "
              "bands array<bigint>")


def text_keys(text: Column) -> tuple[Column, Column]:
    """128 bits that tell texts apart."""
    return F.xxhash64(text).alias("k1"), F.xxhash64(F.lit("second"), text).alias("k2")


def signatures(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """doc_id, text keys, set size, set digest, one-bit sketch and bands of every document, from its whole text."""
    # a set smaller than this is only ever linked with its equals
    alone = next(n for n in range(1, 10_000) if 100 * n >= percent * (n + 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", PIECE):
            sizes, digests, ones, others, keys = [], [], [], [], []
            for text in batch.column("text").to_pylist():
                items = shingle_set(text, width)
                sizes.append(len(items))
                digests.append(set_digest(items) if len(items) else None)
                if len(items) < alone:
                    ones.append(0), others.append(0), keys.append(None)
                    continue
                least = sketch(items, BANDS * ROWS)
                one, other = low_bits(least)
                ones.append(one), others.append(other), keys.append(bands(least, ROWS))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("doc_id", "k1", "k2")), pa.array(sizes, pa.int64()),
                 pa.array(digests, pa.binary()), pa.array(ones, pa.int64()), pa.array(others, pa.int64()),
                 pa.array(keys, pa.list_(pa.int64()))],
                ["doc_id", "k1", "k2", "n_shingles", "digest", "bits1", "bits2", "bands"])

    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), *text_keys(text), text.alias("text"))
    return rows.mapInArrow(run, _SIGNATURE)


def _classes(signed: DataFrame) -> DataFrame:
    """One row for each shingle set: node (a long that grows with rep), rep (least doc_id) and the set's signature."""
    classes = signed.filter("n_shingles > 0").groupBy("digest").agg(
        F.min("doc_id").alias("rep"), *(F.first(c).alias(c) for c in ("k1", "k2", "n_shingles", "bits1", "bits2", "bands")))
    classes = classes.repartitionByRange(F.asc_nulls_last("rep"), "digest").sortWithinPartitions(F.asc_nulls_last("rep"), "digest")
    return written(packed(classes.withColumn("node", F.monotonically_increasing_id())), "classes")


def _may_link(percent: int):
    def condition(x: str, y: str) -> Column:
        small, large = F.least(x + "n_shingles", y + "n_shingles"), F.greatest(x + "n_shingles", y + "n_shingles")
        differ = sum((F.bit_count(F.col(f"{x}{c}").bitwiseXOR(F.col(f"{y}{c}"))) for c in ("bits1", "bits2")), F.lit(0))
        return (100 * small >= percent * large) & (differ <= MAX_DIFFERING)
    return condition


def _words(places: np.ndarray, n: int) -> np.ndarray:
    """Places below n as bits in longs of 63 bits."""
    bits = np.zeros((n + 62) // 63 * 63, np.int64)
    bits[places] = 1
    return bits.reshape(-1, 63) @ (np.int64(1) << np.arange(63, dtype=np.int64))


def _against_hub(held: np.ndarray, other: np.ndarray) -> tuple[int, dict]:
    """Size of the intersection with the hub's set, and what bounds the other's intersection with third sets.

    ``gone``: the hub's items that are missing, exactly, a bit for each; ``new``: items outside the
    hub, hashed to NEW_BITS bits, of which ``extra`` fell on a bit that was taken.
    """
    at = np.minimum(np.searchsorted(held, other), len(held) - 1)
    inside = held[at] == other
    missing = np.ones(len(held), bool)
    missing[at[inside]] = False
    places = np.unique((other[~inside] % np.uint64(NEW_BITS)).astype(np.int64))
    n = int(inside.sum())
    return n, {"hub_size": len(held), "size": len(other), "gone": _words(np.flatnonzero(missing), len(held)),
               "new": _words(places, NEW_BITS), "extra": len(other) - n - len(places)}


def _bounded(percent: int):
    """Whether two sets that were compared with one hub can be as similar as percent.

    Inside the hub they share what neither lacks; outside, at most a set's bits that
    meet and its extra items, or all its new items.
    """
    def bits(both: Column) -> Column:
        return F.aggregate(both, F.lit(0), lambda total, word: total + F.bit_count(word))

    def condition(x: str, y: str) -> Column:
        inside = F.col(f"{x}hub_size") - bits(F.zip_with(f"{x}gone", f"{y}gone", lambda p, q: p.bitwiseOR(q)))
        meeting = bits(F.zip_with(f"{x}new", f"{y}new", lambda p, q: p.bitwiseAND(q))) + F.least(f"{x}extra", f"{y}extra")
        most = inside + F.least(meeting, *(F.col(f"{z}extra") + bits(F.col(f"{z}new")) for z in (x, y)))
        return (100 + percent) * most >= percent * (F.col(f"{x}size") + F.col(f"{y}size"))

    return condition


def _compare(width: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, None
        for batch in slices(batches, "text_a", 1 << 20):
            linked, against = [], []
            for a, split, text_a, text_b in zip(*(batch.column(c).to_pylist() for c in ("a", "split", "text_a", "text_b"))):
                if a != last:
                    last, held = a, shingle_set(text_a, width)
                other = shingle_set(text_b, width)
                n, bounds = _against_hub(held, other)
                linked.append(100 * n >= percent * (len(held) + len(other) - n))
                against.append(bounds if split else dict.fromkeys(bounds))
            kinds = {"hub_size": pa.int64(), "size": pa.int64(), "gone": pa.list_(pa.int64()), "new": pa.list_(pa.int64()),
                     "extra": pa.int64()}
            yield pa.RecordBatch.from_arrays(
                [batch.column("a"), batch.column("b"), batch.column("split"), pa.array(linked, pa.bool_()),
                 *(pa.array([x[k] for x in against], t) for k, t in kinds.items())], ["a", "b", "split", "linked", *kinds])

    return run


def _comparer(docs: DataFrame, classes: DataFrame, width: int, percent: int):
    def prepare(nodes: DataFrame):
        wanted = written(packed(classes.join(nodes, "node").select("node", F.col("k1").alias("c1"), F.col("k2").alias("c2"))), "wanted")
        text = F.coalesce(F.col("text").cast("string"), F.lit(""))
        keyed = docs.select(*text_keys(text), text.alias("text"))
        texts = join_small(keyed, wanted, (F.col("k1") == F.col("c1")) & (F.col("k2") == F.col("c2")), max_rows=100_000)
        texts = written(packed(texts.select("node", "text").dropDuplicates(["node"])), "candidate-texts")
        run = _compare(width, percent)

        def compare(pairs: DataFrame) -> DataFrame:
            return (pairs.join(texts.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b")
                    .join(texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a")
                    .select("a", "b", "split", "text_a", "text_b")
                    .mapInArrow(run, "a bigint, b bigint, split boolean, linked boolean, hub_size bigint, size bigint, "
                                     "gone array<bigint>, new array<bigint>, extra bigint"))

        return compare

    return prepare


def _grouped(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """Signature rows with ``component_id`` and ``root`` (both null where a text has no words)."""
    signed = written(packed(signatures(docs, width, percent)), "signatures")
    classes = _classes(signed)
    payload = ["n_shingles", "bits1", "bits2"]
    members = classes.filter("bands is not null").select(
        F.explode("bands").alias("bucket"), "node", *payload)
    roots = link_buckets(members, payload, _may_link(percent), _comparer(docs, classes, width, percent), _bounded(percent))
    rooted = with_roots(classes.select("digest", "node"), roots)
    # nodes grow with rep, so the root holds the least doc_id of its component
    named = rooted.join(classes.select(F.col("node").alias("root"), F.col("rep").alias("component_id")), "root") \
        .select("digest", "root", "component_id")
    return signed.select("doc_id", "k1", "k2", "n_shingles", "digest").join(named, "digest", "left")


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of ``docs`` (doc_id, text)."""
    rows = _grouped(docs, width, percent)
    component = F.when(F.col("root").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return rows.select("doc_id", "n_shingles", component.alias("component_id")) \
        .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))


def deduplicate(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` without those near-duplicate to a kept one; of a group the least doc_id (then text) stays.

    Rows equal in doc_id and text are one document and stay or go together.
    """
    rows = written(packed(_grouped(docs, width, percent).filter("root is not null")
                   .select("root", "doc_id", "k1", "k2")), "grouped")
    place = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "k1", "k2")
    first = rows.groupBy("root").agg(F.min(place).alias("first"))
    gone = rows.join(first, "root").filter(place != F.col("first")).select(
        F.col("doc_id").alias("__doc_id"), F.col("k1").alias("__k1"), F.col("k2").alias("__k2")).distinct()
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    k1, k2 = text_keys(text)
    match = F.col("doc_id").cast("bigint").eqNullSafe(F.col("__doc_id")) & (k1 == F.col("__k1")) & (k2 == F.col("__k2"))
    return join_small(docs, written(packed(gone), "gone"), match, "left_anti", max_rows=100_000)
