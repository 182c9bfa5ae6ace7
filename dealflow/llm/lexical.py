"""Ranked lexical search with pair bounds (operator 12).

The index holds documents in blocks of like size (a power of two of bytes), with
a posting list for each term of a block.  For the items of a search, each pair of
terms that follow each other in an item's order of weight gets an intersection list: in every
block where both occur, the largest impact they reach together in one document.  A block's bound for
an item is the least sum that covers its terms by single maxima and joint maxima of pairs, found by a
recurrence along the item's terms; with random co-occurrence it lies well below the sum of the single maxima.

Three passes over the blocks: bounds; the two best blocks of each item, whose
k-th score is a threshold no result lies below; then every block whose bound reaches the
threshold.  Within a block, lists are added up while documents not seen yet could still reach the
threshold, and after that only probed at the documents that still can, by the same bounds.

Items are searched in groups with at most ``terms_at_once`` terms; a group's terms,
weights and thresholds go to all tasks, and nothing else does.

Null and odd input: a null text, or one without terms, counts in neither N nor L and is never found.
An item without terms, or whose terms occur nowhere, has no rows.  Rows of one doc_id are documents of their own;
a null doc_id comes last on ties.  Repeated rows of items count once; rows of one item_id with different terms are
ranked one by one.  Extra columns are ignored.  An empty table on either side gives no rows.  A text goes through memory whole;
one longer than a block is a block of its own.
"""

from __future__ import annotations

import math
import re
import string
from array import array
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.joins import join_small
from .common import shared_folder, slices, written

#: Fixed values of the ranking: term pattern, scale of weights and impacts, saturation and length shares.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
WEIGHT_SCALE, IMPACT_SCALE, TF_SCALE, SATURATION, LENGTH_SHARE = 1000, 1_000_000_000, 1000, 8, 90

#: TERM over UTF-8, whose bytes beyond ASCII belong to characters beyond ASCII.
TERM_BYTES = re.compile(rb"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = bytes.maketrans(string.ascii_uppercase.encode(), string.ascii_lowercase.encode())
NO_ID = (1 << 63) - 1  # stands for a null doc_id: comes last on ties
LISTS = "block bigint, term string, at array<int>, tf array<int>, docs array<bigint>"
BLOCKS = "block bigint, docs array<bigint>, ids array<int>, starts array<int>, largest array<bigint>, joint array<bigint>, at array<int>, impacts array<bigint>"


def counted(text: bytes) -> Counter[bytes]:
    """Terms of a UTF-8 text and how often each occurs."""
    return Counter(TERM_BYTES.findall(text.translate(LOWER)))


def weight(n_docs: int, df: int) -> int:
    return math.floor(WEIGHT_SCALE * math.log((2 * n_docs + 2) / (2 * df + 1)))


# -- index ------------------------------------------------------------------

class _Block:
    """The documents of one block while they are read, and their postings."""

    def __init__(self, block: int):
        self.block, self.docs, self.sizes, self.numbers = block, [], [], {}
        self.term, self.at, self.tf = array("i"), array("i"), array("i")

    def add(self, doc_id: int | None, text: bytes) -> None:
        terms, numbers = counted(text), self.numbers
        if terms:
            self.term.extend([numbers.setdefault(t, len(numbers)) for t in terms])
            self.at.extend([len(self.docs)] * len(terms))
            self.tf.extend(terms.values())
            self.docs.append(doc_id)
            self.sizes.append(terms.total())

    def batches(self) -> Iterator[pa.RecordBatch]:
        if not self.docs:
            return
        yield _rows(self.block, pa.nulls(1, pa.string()), np.zeros(2), np.zeros(0), np.array([0, len(self.sizes)]), np.array(self.sizes), [self.docs])
        # postings by term; within a term they stay in the order of the documents
        term = np.frombuffer(self.term, np.int32)
        order = np.argsort(term, kind="stable")
        bounds = np.concatenate([[0], np.cumsum(np.bincount(term, minlength=len(self.numbers)))])
        yield _rows(self.block, pa.array(list(self.numbers), pa.binary()).cast(pa.string()), bounds, np.frombuffer(self.at, np.int32)[order],
                    bounds, np.frombuffer(self.tf, np.int32)[order], None)


def _rows(block: int, term: pa.Array, at_bounds: np.ndarray, at: np.ndarray, tf_bounds: np.ndarray, tf: np.ndarray, docs: list | None) -> pa.RecordBatch:
    def lists(bounds, values):
        return pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(values.astype(np.int32)))

    n = len(term)
    return pa.RecordBatch.from_arrays(
        [pa.array(np.full(n, block, np.int64)), term, lists(at_bounds, at), lists(tf_bounds, tf),
         pa.nulls(n, pa.list_(pa.int64())) if docs is None else pa.array(docs, pa.list_(pa.int64()))], ["block", "term", "at", "tf", "docs"])


def build_index(docs: DataFrame, folder: str | None = None, block_docs: int = 2048, block_bytes: int = 4 << 20) -> str:
    """Write the posting lists of all documents (doc_id, text) to ``folder`` (a new shared one) and return it.

    ``lists``: block, term, at (ordinals in the block), tf.  ``documents``: block, docs (ids), tf (terms of each document).
    """
    folder = folder or shared_folder(docs.sparkSession, "lexical-index")
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).filter("text is not null")
    rows = rows.withColumn("bytes", F.octet_length("text").cast("bigint")).withColumn("size_class", F.floor(F.log2(F.col("bytes") + 1)).cast("int"))
    # at most 32 rows: how many blocks the documents of each size need
    classes = rows.groupBy("size_class").agg(F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("bytes")).collect()
    slots = F.lit(1)
    for c in classes:
        needed = max(math.ceil(c["n"] / block_docs), math.ceil(c["bytes"] / block_bytes), 1)
        slots = F.when(F.col("size_class") == c["size_class"], F.lit(needed)).otherwise(slots)
    dealt = rows.withColumn("slot", F.pmod(F.xxhash64("doc_id", "text"), slots.cast("bigint")))
    dealt = dealt.select(F.shiftleft(F.col("size_class").cast("bigint"), 56).bitwiseOR(F.shiftleft("slot", 16)).alias("slot"), "doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, slot, n_bytes = None, None, 0
        for batch in slices(batches, "text"):
            for s, doc_id, text in zip(batch.column("slot").to_pylist(), batch.column("doc_id").to_pylist(), batch.column("text")):
                data = text.as_buffer().to_pybytes()
                # slots are filled by a hash: one that got far more than its share is cut
                full = s == slot and (len(held.docs) >= 2 * block_docs or n_bytes >= 2 * block_bytes)
                if s != slot or full:
                    if held is not None:
                        yield from held.batches()
                    held, n_bytes = _Block(held.block + 1 if full else s), 0
                    slot = s
                held.add(doc_id, data)
                n_bytes += len(data)
        if held is not None:
            yield from held.batches()

    (dealt.repartition("slot").sortWithinPartitions("slot", "doc_id").mapInArrow(run, LISTS)
     .withColumn("holds", F.when(F.col("term").isNull(), F.lit("documents")).otherwise(F.lit("lists")))
     .write.partitionBy("holds").parquet(folder))
    return folder


def _read(spark: SparkSession, folder: str, what: str) -> DataFrame:
    return spark.read.schema(LISTS + ", holds string").parquet(folder).filter(F.col("holds") == what).drop("holds")


# -- bounds -----------------------------------------------------------------

@dataclass
class _Items:
    """A group of items: term ids by falling weight, and the pairs that follow each other in them."""
    ids: list[int | None]
    chains: list[list[int]]
    weights: dict[int, int]

    def __post_init__(self):
        self.pairs: dict[tuple[int, int], int] = {}
        for chain in self.chains:
            chain.sort(key=lambda t: (-self.weights.get(t, 0), t))
            for pair in zip(chain, chain[1:]):
                self.pairs.setdefault(pair, len(self.pairs))


def rest_bounds(chain: list[int], largest: dict[int, int], joint: list[int], pairs: dict[tuple[int, int], int]) -> list[int]:
    """For each place in ``chain``, a bound on what the terms from there on add to a document of the block.

    A term alone adds its maximum at most; two that follow each other add the
    largest of their maxima and their joint maximum.  The least cover is taken.
    """
    out = [0] * (len(chain) + 2)
    for i in range(len(chain) - 1, -1, -1):
        own = largest.get(chain[i], 0)
        out[i] = own + out[i + 1]
        if i + 1 < len(chain):
            both = max(own, largest.get(chain[i + 1], 0), joint[pairs[chain[i], chain[i + 1]]])
            out[i] = min(out[i], both + out[i + 2])
    return out


def best_in_block(chain: list[int], lists: dict[int, tuple[np.ndarray, np.ndarray]], bounds: list[int], docs: np.ndarray, least: int,
                  k: int) -> list[tuple[int, int]]:
    """(doc, score) of the block's k best documents with ``least`` (1 or more) at least."""
    score = np.zeros(len(docs), np.int64)
    left: np.ndarray | None = None
    for i, term in enumerate(chain):
        if left is None and bounds[i] < least:
            left = np.flatnonzero(score + bounds[i] >= least)
        if left is not None:
            left = left[score[left] + bounds[i] >= least]
            if not len(left):
                return []
        if term not in lists:
            continue
        at, impacts = lists[term]
        if left is None:
            score[at] += impacts
        else:
            place = np.minimum(np.searchsorted(at, left), len(at) - 1)
            score[left] += np.where(at[place] == left, impacts[place], 0)
    if left is None:
        left = np.arange(len(docs))
    left = left[score[left] >= least]
    first = left[np.lexsort((docs[left], -score[left]))[:k]]
    return list(zip(docs[first].tolist(), score[first].tolist()))


# -- search -----------------------------------------------------------------

def _impact_blocks(lists: DataFrame, documents: DataFrame, items: _Items, n_docs: int, n_terms: int) -> DataFrame:
    """One row for each block: the items' lists with impacts, their maxima, and the joint maximum of every asked pair."""
    weights, pairs = items.weights, items.pairs

    def run(key, left: pa.Table, right: pa.Table) -> pa.Table:
        rows = []
        if left.num_rows and right.num_rows:
            docs = right.column("docs").combine_chunks().flatten()
            shares = np.array([100 - LENGTH_SHARE + LENGTH_SHARE * n * n_docs // n_terms
                               for n in right.column("tf").combine_chunks().flatten().to_pylist()], np.int64)
            ids, lists_at, lists_impact = left.column("id").to_pylist(), [], []
            whole: dict[int, np.ndarray] = {}
            for t, at, tf in zip(ids, left.column("at"), left.column("tf")):
                at, tf = at.values.to_numpy(), tf.values.to_numpy().astype(np.int64)
                lists_at.append(at)
                lists_impact.append(weights[t] * (IMPACT_SCALE * tf // (TF_SCALE * tf + SATURATION * shares[at])))
                whole[t] = np.zeros(len(shares), np.int64)
                whole[t][at] = lists_impact[-1]
            joint = []
            for a, b in pairs:
                x, y = whole.get(a), whole.get(b)
                joint.append(0 if x is None or y is None else int(((x + y) * ((x > 0) & (y > 0))).max()))
            starts = np.concatenate([[0], np.cumsum([len(x) for x in lists_at])])
            rows.append({"block": key[0].as_py(), "docs": docs.to_pylist(), "ids": ids, "starts": starts, "largest": [int(x.max()) for x in lists_impact],
                         "joint": joint, "at": np.concatenate(lists_at), "impacts": np.concatenate(lists_impact)})
        return pa.Table.from_pylist(rows, _BLOCK_SCHEMA)

    met = lists.groupBy("block").cogroup(documents.select("block", "docs", "tf").groupBy("block"))
    return written(met.applyInArrow(run, BLOCKS), "lexical-impacts")


_BLOCK_SCHEMA = pa.schema([("block", pa.int64()), ("docs", pa.list_(pa.int64())), ("ids", pa.list_(pa.int32())), ("starts", pa.list_(pa.int32())),
                           ("largest", pa.list_(pa.int64())), ("joint", pa.list_(pa.int64())), ("at", pa.list_(pa.int32())),
                           ("impacts", pa.list_(pa.int64()))])


def _bounds(blocks: DataFrame, items: _Items) -> DataFrame:
    """item, block, bound of every item in every block that holds one of its terms."""
    chains, pairs = items.chains, items.pairs

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                largest = dict(zip(row["ids"], row["largest"]))
                bounds = [rest_bounds(c, largest, row["joint"], pairs)[0] for c in chains]
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(bounds), dtype=np.int32)), pa.array([row["block"]] * len(bounds), pa.int64()),
                                                  pa.array(bounds, pa.int64())], ["item", "block", "bound"])

    return blocks.select("block", "ids", "largest", "joint").mapInArrow(run, "item int, block bigint, bound bigint").filter("bound > 0")


def _found(blocks: DataFrame, items: _Items, k: int, least: list[int], only: dict[int, list[int]] | None = None) -> DataFrame:
    """item, doc, score: each block's best documents for the items (``only``: for the named ones of the named blocks)."""
    chains, pairs = items.chains, items.pairs
    if only is not None:
        blocks = blocks.filter(F.col("block").isin(list(only)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = {n: batch.column(n)[i].values for n in ("docs", "ids", "starts", "largest", "joint", "at", "impacts")}
                docs = row["docs"].fill_null(NO_ID).to_numpy()
                ids, starts, at, impacts = (row[n].to_numpy() for n in ("ids", "starts", "at", "impacts"))
                largest, joint = dict(zip(ids.tolist(), row["largest"].to_pylist())), row["joint"].to_pylist()
                lists = {t: (at[a:b], impacts[a:b]) for t, a, b in zip(ids.tolist(), starts[:-1], starts[1:])}
                out: list[tuple[int, int, int]] = []
                for item in range(len(chains)) if only is None else only[batch.column("block")[i].as_py()]:
                    bounds = rest_bounds(chains[item], largest, joint, pairs)
                    if bounds[0] >= least[item]:
                        out += [(item, d, s) for d, s in best_in_block(chains[item], lists, bounds, docs, least[item], k)]
                items_, docs_, scores = zip(*out) if out else ((), (), ())
                yield pa.RecordBatch.from_arrays([pa.array(items_, pa.int32()), pa.array(docs_, pa.int64()), pa.array(scores, pa.int64())],
                                                 ["item", "doc", "score"])

    return blocks.mapInArrow(run, "item int, doc bigint, score bigint")


def _best(found: DataFrame, k: int) -> DataFrame:
    place = Window.partitionBy("item").orderBy(F.desc("score"), "doc")
    return found.withColumn("rank", F.row_number().over(place)).filter(F.col("rank") <= k)


def search(spark: SparkSession, folder: str, items: DataFrame, k: int = 10, terms_at_once: int = 200_000) -> DataFrame:
    """item_id, rank, doc_id, score: the k documents of the index with the highest scores for each item (item_id, text)."""
    def terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            own = [sorted(t.decode() for t in counted(x.encode())) for x in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("item_id"), pa.array(own, pa.list_(pa.string()))], ["item_id", "terms"])

    asked = items.select(F.col("item_id").cast("bigint").alias("item_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    asked = written(asked.mapInArrow(terms, "item_id bigint, terms array<string>").filter(F.size("terms") > 0).distinct(), "lexical-items")
    lists, documents = _read(spark, folder, "lists"), _read(spark, folder, "documents")
    total = documents.agg(F.sum(F.size("docs")).alias("n_docs"),
                          F.sum(F.aggregate("tf", F.lit(0).cast("bigint"), lambda a, x: a + x)).alias("n_terms")).first()
    size = asked.agg(F.sum(F.size("terms")).alias("n")).first()["n"]
    result = spark.createDataFrame([], "item_id bigint, rank int, doc_id bigint, score bigint")
    if not size or not total["n_docs"]:
        return result
    groups = math.ceil(size / terms_at_once)
    for group in range(groups):
        some = asked.filter(F.pmod(F.xxhash64("item_id", "terms"), F.lit(groups).cast("bigint")) == group).orderBy("item_id", "terms").collect()
        if some:
            found = _search_group(spark, lists, documents, [(r["item_id"], r["terms"]) for r in some], total["n_docs"], total["n_terms"], k)
            result = found if group == 0 else result.unionByName(found)
    return result


def _search_group(spark: SparkSession, lists: DataFrame, documents: DataFrame, asked: list[tuple], n_docs: int, n_terms: int, k: int) -> DataFrame:
    numbers: dict[str, int] = {}
    chains = [[numbers.setdefault(t, len(numbers)) for t in terms] for _, terms in asked]
    known = spark.createDataFrame([(t, i) for t, i in numbers.items()], "term string, id int")
    own = join_small(lists, known, "term", max_rows=1_000_000).select("block", "id", "at", "tf")
    df = {r["id"]: r["df"] for r in own.groupBy("id").agg(F.sum(F.size("at")).alias("df")).collect()}
    items = _Items([i for i, _ in asked], chains, {t: weight(n_docs, n) for t, n in df.items()})
    blocks = _impact_blocks(own, documents, items, n_docs, n_terms)

    # the k-th score in an item's two best blocks is a threshold for all others
    place = Window.partitionBy("item").orderBy(F.desc("bound"), "block")
    first: dict[int, list[int]] = {}
    for r in _bounds(blocks, items).withColumn("place", F.row_number().over(place)).filter("place <= 2").collect():
        first.setdefault(r["block"], []).append(r["item"])
    least = [1] * len(asked)
    for r in _best(_found(blocks, items, k, least, first), k).filter(F.col("rank") == k).collect():
        least[r["item"]] = max(1, r["score"])
    best = _best(_found(blocks, items, k, least), k)
    names = spark.createDataFrame([(n, i) for n, i in enumerate(items.ids)], "item int, item_id bigint")
    return best.join(F.broadcast(names), "item").select("item_id", "rank", F.nullif("doc", F.lit(NO_ID)).alias("doc_id"), "score")


def rank_documents(docs: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """Index all documents, then search every item."""
    return search(docs.sparkSession, build_index(docs), items, k)


def _terms_sql(column: str) -> str:
    return (f"unnest(regexp_extract_all(translate({column}, '{string.ascii_uppercase}', '{string.ascii_lowercase}'), "
            f"'{TERM}'))")


LEXICAL_SQL = f"""
WITH posting AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, {_terms_sql('text')} AS term FROM documents) GROUP BY ALL),
size AS (SELECT doc_id, CAST(sum(tf) AS BIGINT) AS n FROM posting GROUP BY doc_id),
total AS (SELECT count(*) AS n_docs, CAST(sum(n) AS BIGINT) AS n_terms FROM size),
frequency AS (SELECT term, count(*) AS df FROM posting GROUP BY term),
wanted AS (SELECT DISTINCT item_id, {_terms_sql('text')} AS term FROM benchmark),
scored AS (
  SELECT i.item_id, p.doc_id, CAST(sum(
    CAST(floor(1000 * ln((2 * t.n_docs + 2) / (2 * f.df + 1))) AS BIGINT)
    * ((1000000000 * p.tf) // (1000 * p.tf + 8 * (100 - 90 + (90 * s.n * t.n_docs) // t.n_terms)))) AS BIGINT) AS score
  FROM wanted i JOIN posting p USING (term) JOIN frequency f USING (term) JOIN size s USING (doc_id), total t
  GROUP BY i.item_id, p.doc_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS place FROM scored WHERE score > 0)
SELECT item_id, CAST(place AS INTEGER) AS rank, doc_id, score FROM ranked WHERE place <= 10
"""
