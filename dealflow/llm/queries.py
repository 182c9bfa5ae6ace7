"""Registered queries of the training-data operators; each reads its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .chat import CHAT_SQL, format_chats
from .common import read_table
from .lexical import LEXICAL_SQL
from .mixing import mix_report, mix_sql
from .vector_codes import codes_sql
from .warc import WARC_SQL

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def register(name: str, oracle: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn
    return deco


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@register("op3_token_counts")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_counts import count_tokens

    return count_tokens(read_table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


@register("op7_token_orc")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_orc import encode_to_orc

    return encode_to_orc(read_table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"), end_id=2)


@register("op9_byte_bpe")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .byte_bpe import round_trip_digests

    return round_trip_digests(read_table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.tiktoken"),
                              public_tokenizers.PATTERN)


@register("op1_language")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .language import identify

    return identify(read_table(spark, sf_dir, "documents"))


@register("op2_mixing", mix_sql())
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_report(read_table(spark, sf_dir, "documents"))


@register("op5_chat", CHAT_SQL)
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return format_chats(read_table(spark, sf_dir, "conversations"))


@register("op6_near_dedup")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .near_dedup import near_duplicates

    return near_duplicates(read_table(spark, sf_dir, "documents"), width=4)


@register("op4_line_dedup")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .line_dedup import dedup_lines

    return dedup_lines(read_table(spark, sf_dir, "documents").select("doc_id", "text"), short_copies=True)


@register("op8_vector_dedup")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .vector_dedup import near_vectors

    return near_vectors(read_table(spark, sf_dir, "embeddings"))


@register("op10_vector_search")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .vector_search import search

    rows = read_table(spark, sf_dir, "embeddings")
    return search(rows.filter("vec_id % 20 = 0"), rows)


@register("op11_vector_codes", codes_sql())
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .vector_codes import compress

    return compress(read_table(spark, sf_dir, "embeddings"))


@register("op12_lexical_search", LEXICAL_SQL)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .lexical import rank_documents

    return rank_documents(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


@register("op13_warc", WARC_SQL)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc import round_trip

    return round_trip(read_table(spark, sf_dir, "pages"))
