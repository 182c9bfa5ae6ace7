import zlib

import pytest

from dealflow.llm.language import family_of, features, fit_languages, identify, predict_languages
from llm_fixtures import SF_SMALL, no_docs, odd_docs, shipped  # noqa: F401


@pytest.fixture(scope="module")
def found(spark):
    from dealflow.llm.queries import QUERIES

    return QUERIES["op1_language"](spark, SF_SMALL).collect()


def test_held_out_accuracy(spark, found):
    given = {r.doc_id: r for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()}
    assert len(found) == len(given)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in found)
    held = [r for r in found if r.held_out and r.lang_pred != "und"]
    assert len(held) > 20 and sum(r.lang_pred == given[r.doc_id].lang for r in held) >= 0.95 * len(held)
    assert all(0 <= r.score <= 1 for r in found)


def test_labels_are_no_input(spark):
    """Changed labels, sources and ids of documents outside training change no prediction."""
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    model = fit_languages(docs.select("doc_id", "text", "lang"), sample_per_language=30)
    one = predict_languages(docs, model).select("doc_id", "lang_pred").collect()
    other = predict_languages(docs.selectExpr("doc_id", "text", "'xx' AS lang", "'yy' AS source", "-doc_id AS n_chars"), model)
    assert sorted(one) == sorted(other.select("doc_id", "lang_pred").collect())


def test_odd_rows(spark, odd_docs, no_docs):
    rows = identify(odd_docs).collect()
    texts = sorted(((r.doc_id or -1), r.text or "") for r in odd_docs.collect())
    assert len(rows) == len(texts)
    silent = {4, 5, 6, 7, -1}
    for r in rows:
        if (r.doc_id or -1) in silent - {-1}:
            assert (r.lang_pred, r.score) == ("und", 0.0)
        elif r.doc_id is not None:
            assert r.lang_pred in {"en", "de", "fr", "es"}
    assert sum(r.doc_id is None and r.lang_pred == "und" for r in rows) == 1
    assert identify(no_docs).count() == 0
    unlabelled = odd_docs.selectExpr("doc_id", "text", "CAST(NULL AS string) AS lang")
    assert {r.lang_pred for r in identify(unlabelled).collect()} == {"und"}
    one = odd_docs.filter("lang = 'en'").selectExpr("doc_id", "text", "lang")
    assert {r.lang_pred for r in identify(one).collect()} == {"en", "und"}


def test_features_use_the_whole_text():
    assert family_of("de") == family_of("en") != family_of("fr") and family_of("xx") == "xx"
    start = "ab " * 20000
    assert (features(start + "zq" * 3000) != features(start)).any()


def test_feature_batches_are_bounded_by_rows():
    """A text of one word has thousands of features like a long one."""
    import pyarrow as pa

    from dealflow.llm.language import DIMS, _feature_batches

    batch = pa.record_batch([pa.array(["en"] * 1000), pa.array([f"w{i}" for i in range(1000)])], ["lang", "text"])
    out = list(_feature_batches(iter([batch])))
    assert max(b.nbytes for b in out) < 4 << 20
    rows = [x for b in out for x in b.column("x").to_pylist()]
    assert len(rows) == 1000 and len(rows[999]) == DIMS and rows[999] == list(features("w999"))
