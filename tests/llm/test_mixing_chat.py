import duckdb
import pytest

from llm_fixtures import SF_SMALL, no_docs, odd_docs, shipped  # noqa: F401
from dealflow.llm.chat import CHAT_SQL, format_chats
from dealflow.llm.mixing import mix, mix_report, mix_sql
from dealflow.llm.queries import QUERIES


def _same(df, sql, **tables):
    con = duckdb.connect()
    for name, rows in tables.items():
        con.register(name, rows)
    want = con.execute(sql)
    names = sorted(df.columns)
    assert names == sorted(d[0] for d in want.description)
    at = [[d[0] for d in want.description].index(c) for c in names]
    got = df.collect()
    assert sorted((tuple(r[c] for c in names) for r in got), key=repr) == sorted((tuple(r[i] for i in at) for r in want.fetchall()), key=repr)
    return got


def _arrow(df):
    return df.toArrow()


def test_mix_matches_sql_on_odd_rows(spark, odd_docs):
    distinct = odd_docs.dropDuplicates(["doc_id", "text"])  # equal rows are one place in the queue
    got = _same(mix_report(distinct), mix_sql(), documents=_arrow(distinct.select("doc_id", "text", "source")))
    assert all(r.taken <= 3 * r["size"] for r in got)


def test_mix_near_targets_and_repeatable(spark):
    rows = [(i, " ".join(["w"] * (1 + i % 7)), None if i % 11 == 0 else f"s{i % 5 if i % 3 else 0}") for i in range(1500)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string").repartition(7)
    got = mix_report(docs).toPandas()
    by = got.groupby("source", dropna=False).agg(target=("target", "first"), taken=("taken", "sum"))
    assert (by["taken"] - by["target"]).abs().max() <= 14 and got["taken"].sum() <= got["size"].sum()
    again = mix_report(docs.repartition(3)).toPandas()
    assert got.sort_values("doc_id")["taken"].tolist() == again.sort_values("doc_id")["taken"].tolist()
    mixed = mix(docs).groupBy("doc_id").count().toPandas().set_index("doc_id")["count"]
    want = got[got["copies"] > 0].set_index("doc_id")["copies"]
    assert mixed.sort_index().tolist() == want.sort_index().tolist() and len(mixed) == len(want)


def test_small_sources_are_repeated_and_capped(spark):
    rows = [(i, "w " * 10, "a") for i in range(300)] + [(1000 + i, "w " * 10, "b") for i in range(20)]
    got = mix_report(spark.createDataFrame(rows, "doc_id bigint, text string, source string")).toPandas()
    by = got.groupby("source")["taken"].sum()
    assert got[got.source == "b"]["target"].iloc[0] == 600 and by["b"] == 600 and by["a"] == 2600


def test_mix_empty(spark, no_docs, odd_docs):
    assert mix_report(no_docs).count() == 0 and mix(no_docs).count() == 0
    assert mix(odd_docs).columns == odd_docs.columns
    silent = spark.createDataFrame([(1, None, "a"), (2, "", None)], "doc_id bigint, text string, source string")
    assert [(r.taken, r.target) for r in mix_report(silent).collect()] == [(0, 0.0)] * 2


CHATS = [
    (1, 0, "user", "hi"), (1, 1, "assistant", "hello"),
    (2, 0, "user", "hi"), (2, 1, "assistant", "hello"), (2, 2, "user", "bye"),
    (3, 10, "user", "hi"), (3, 20, "assistant", "hello"), (3, 30, "user", "bye"),  # equal to 2, other turn numbers
    (4, 0, "user", "hi"), (4, 1, "assistant", "other"),
    (5, 0, "user", "hi"), (5, 0, "user", "hi"),  # logged twice
    (6, 0, None, None), (6, None, "user", "last"), (6, None, "assistant", "a tie"),
    (None, 0, "user", "no id"), (7, 0, "user", "h"), (7, 1, "user", "i"),
]
CHAT_SCHEMA = "conv_id bigint, turn bigint, role string, text string"


def test_chat_matches_sql(spark):
    long = [(100, i, "user", f"t{i}") for i in range(700)] + [(101, i, "user", f"t{i}") for i in range(600)]
    df = spark.createDataFrame(CHATS + long, CHAT_SCHEMA)
    got = _same(format_chats(df.selectExpr("*", "1 AS pos", "2 AS a", "'x' AS block")), CHAT_SQL, conversations=_arrow(df))
    assert {r.conv_id for r in got} == {2, 4, 6, 7, 100, None} and sum(r.conv_id == 100 for r in got) == 3
    assert next(r.rendered for r in got if r.conv_id == 4) == "<|im_start|>user\nhi<|im_end|>\n<|im_start|>assistant\nother<|im_end|>\n"


def test_chat_empty(spark):
    assert format_chats(spark.createDataFrame([], CHAT_SCHEMA)).count() == 0


@pytest.mark.parametrize("name", ["op2_mixing", "op5_chat"])
def test_query_matches_oracle(spark, name):
    from dealflow.llm.queries import ORACLES

    tables = {t: duckdb.connect().execute(f"SELECT * FROM '{SF_SMALL}/{t}.parquet'").to_arrow_table() for t in ("documents", "conversations")}
    _same(QUERIES[name](spark, SF_SMALL), ORACLES[name], **tables)
