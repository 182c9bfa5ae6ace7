"""Corpus pipeline: documents to token ids in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is
written as Parquet and read again as the next stage's ``docs``.  All stages but
the last return the columns of ``documents``; rows are kept or dropped whole,
except that line dedup shortens texts (and recounts ``n_chars``).

Null and odd input, in every stage: see the operators.  A null or wordless
text is rejected by the first stage (no language), so are texts with no clear one.
Empty tables pass through every stage as empty tables.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dealflow.llm.byte_bpe import round_trip
from dealflow.llm.common import read_table, ship_package, written
from dealflow.llm.language import fit_languages, held_out, predict_languages
from dealflow.llm.line_dedup import dedup_lines
from dealflow.llm.mixing import mix
from dealflow.llm.near_dedup import deduplicate

#: A text is rejected if the probability of its best language is lower.
MIN_LANGUAGE_SCORE = 0.5
#: Bytes of an Arrow batch that a worker is handed (Spark's own limits are 10 000 rows and 64 MB); JVM and worker hold a few of them.
BATCH_BYTES = 4 << 20


def _prepare(spark: SparkSession) -> None:
    """Ship the package and bound the session's Arrow batches."""
    ship_package(spark)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a recognised language; the model learns from labelled rows that aren't held out."""
    _prepare(spark)
    model = fit_languages(docs.filter(~held_out(F.col("doc_id"))).select("doc_id", "text", "lang"))
    named = predict_languages(docs, model)
    return named.filter((F.col("lang_pred") != "und") & (F.col("score") >= MIN_LANGUAGE_SCORE)).select(*docs.columns)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without repeated lines; one that had words and has none left is a copy and goes."""
    _prepare(spark)
    lines = dedup_lines(docs, short_copies=True)
    emptied = (F.col("n_dropped") > 0) & ~F.col("text").rlike(r"\S")
    return lines.filter(~emptied).withColumn("n_chars", F.when(F.col("n_dropped") > 0, F.length("text").cast("bigint"))
                                             .otherwise(F.col("n_chars"))).select(*docs.columns)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group: five-word shingles, similarity of 0.8 or more."""
    _prepare(spark)
    return deduplicate(docs, width=5, percent=80).select(*docs.columns)


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources mixed to their target weights; a document is repeated as often as the mix takes it."""
    _prepare(spark)
    return mix(docs).select(*docs.columns)


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, n_tokens, ids of every document, and whether the ids decode to its text."""
    _prepare(spark)
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    texts = docs.select("doc_id", "source", "text")
    coded = round_trip(texts, path, public_tokenizers.PATTERN)
    return coded.select("doc_id", "source", F.size("ids").alias("n_tokens"), "ids", "round_trip")


STAGES = [("language", language_stage), ("line_dedup", line_stage), ("near_dedup", near_stage), ("mixing", mix_stage),
          ("byte_bpe", bpe_stage)]

#: Sketches, a learned model and a tokenizer can't be written in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order over ``documents``; each result is written to the shared folder and read again."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
