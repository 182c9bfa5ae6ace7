"""Driver contract and Spark-vs-DuckDB oracle agreement on the smallest data set."""

import duckdb
import pytest

import __spark_entry__ as entry
from conftest import SF_SMALL
from dealflow.sources.tables import TABLES

FAST = ["roi_snapshot", "underwrite_summary", "irr_portfolio", "proforma_summary", "whatif_simple",
        "whatif_inst_topn", "validate_quarantine", "conditional_roi_map", "time_split", "fold_report",
        "normalize_text", "path_list", "combine_text", "tfidf_top_terms", "tfidf_matrix", "row_fingerprint", "whatif_inst_outcomes", "validate_requests", "proforma_varied", "request_rejects",
        "document_status", "ridge_coefficients", "ridge_backtest", "model_holdout_metrics", "feature_importance", "score_deals",
        "whatif_simple_model", "whatif_inst_model", "split_profile",
        "regression_metrics", "impute_scale_stats"]


def test_entry_and_registry(spark):
    df = entry.entry(spark)
    assert df.count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return con


def _canon(pdf):
    import math
    cols = sorted(pdf.columns)
    def norm(v):
        if isinstance(v, float) and math.isnan(v):
            return "nan"
        if v is None:
            return None
        return v.item() if hasattr(v, "item") else v
    return cols, sorted((tuple(norm(x) for x in r) for r in pdf[cols].itertuples(index=False, name=None)), key=repr)


@pytest.mark.parametrize("name", FAST)
def test_oracle(spark, duck, name):
    s = _canon(entry.queries()[name](spark, SF_SMALL).toPandas())
    d = _canon(duck.sql(entry.oracle_sql()[name]).df())
    assert s[0] == d[0]
    assert len(s[1]) == len(d[1])
    assert s[1] == d[1]
