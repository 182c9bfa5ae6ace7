"""S1-S8 scans/sinks and the E7 train -> validate -> explain job."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from dealflow.plans.catalog import CATEGORICAL_FEATURES, NUMERIC_FEATURES
from dealflow.plans.training import train_validate_explain
from dealflow.sources.reports import (DealLoadError, export_chronological, load_deals, load_model,
                                      read_importance_report, read_snapshot_lenient)
from dealflow.sources.tables import deals


def test_importance_report_fallback_and_missing_keys(spark, tmp_path):
    p = tmp_path / "fi.json"
    p.write_text(json.dumps({"method": "permutation_importance", "n_repeats": 10,
                             "feature_importance": [{"feature": "ltv", "importance_mean": 1.0,
                                                     "importance_std": 0.1}]}))
    r = read_importance_report(spark, str(p)).first()
    assert r.rows[0].feature == "ltv" and r.model_version is None and r.dataset_hash is None


def test_snapshot_lenient(spark, tmp_path):
    assert read_snapshot_lenient(spark, str(tmp_path / "absent.json")).first().model_version is None
    bad = tmp_path / "bad.json"
    bad.write_text("{not json")
    assert read_snapshot_lenient(spark, str(bad)).first().model_version is None


def test_export_and_load_checks(spark, tmp_path):
    d = deals(spark, SF_SMALL)
    export_chronological(d, str(tmp_path / "deals_csv"))
    back = load_deals(spark, str(tmp_path / "deals_csv"))
    assert back.count() == d.count()
    first = back.orderBy("asof_date", "deal_id").first()
    assert first.asof_date == d.agg(F.min("asof_date")).first()[0]
    bad = tmp_path / "bad.csv"
    bad.write_text("deal_id,asof_date,noi_next12\nD1,not-a-date,1.0\n")
    with pytest.raises(DealLoadError, match="no dates"):
        load_deals(spark, str(bad))


def test_columns_bind_by_name(spark, tmp_path):
    p = tmp_path / "mixed.csv"
    p.write_text("noi_next12,extra,property_type,asof_date,deal_id\n5.5,x,Office,2024-01-31,D1\n,y,Retail,2024-02-29,D2\n")
    rows = load_deals(spark, str(p)).orderBy("deal_id").collect()
    assert [(r.deal_id, r.noi_next12, r.property_type, r.extra, str(r.asof_date)) for r in rows] == [
        ("D1", 5.5, "Office", "x", "2024-01-31"), ("D2", None, "Retail", "y", "2024-02-29")]
    for text, message in (("deal_id,noi_next12\nD1,1\n", "asof_date"), ("deal_id,asof_date\nD1,2024-01-31\n", "noi_next12"),
                          ("asof_date,noi_next12\n2024-01-31,much\n", "fit their column")):
        p = tmp_path / f"{len(text)}.csv"
        p.write_text(text)
        with pytest.raises(DealLoadError, match=message):
            load_deals(spark, str(p))


def test_train_validate_explain(spark, tmp_path):
    # roles come from the schema
    res = train_validate_explain(deals(spark, SF_SMALL), str(tmp_path / "run"), gbt_iter=3, cv_model="ridge", n_splits=3,
                                 source=f"{SF_SMALL}/orders.parquet")
    digest = hashlib.sha256(open(f"{SF_SMALL}/orders.parquet", "rb").read()).hexdigest()
    assert spark.read.csv(str(tmp_path / "run" / "dataset_files"), header=True).first().dataset_hash == digest
    assert res["best_model"] in ("ridge", "gbt")
    rep = read_importance_report(spark, str(tmp_path / "run" / "feature_importance_json")).first()
    assert len(rep.rows) == len(CATEGORICAL_FEATURES) + len(NUMERIC_FEATURES)
    assert rep.dataset_hash == res["dataset_hash"]
    folds = spark.read.json(str(tmp_path / "run" / "ts_cv_report")).orderBy("split").collect()
    assert [r.split for r in folds] == [1, 2, 3] and all(r.train_end <= r.val_start and r.rmse > 0 for r in folds)
    meta = spark.read.json(str(tmp_path / "run" / "dataset_metadata")).first()
    assert meta["columns"][0] == "deal_id" and len(meta["columns"]) == 18 and meta.dataset_hash
    m = load_model(str(tmp_path / "run" / "model"))
    scored = m(deals(spark, SF_SMALL).limit(5))
    assert scored.filter(F.col("predicted_noi_next12").isNull()).count() == 0


def test_cv_backtest_fits_the_tree_model(spark, monkeypatch):
    from dealflow.operators import models
    from dealflow.plans.catalog import QUERIES

    trees = models.gbt
    monkeypatch.setattr(models, "gbt", lambda max_iter: trees(max_iter=1))  # the query's 100 take minutes
    rows = QUERIES["cv_backtest"](spark, SF_SMALL).collect()
    assert sorted((r.model, r.split) for r in rows) == [("gbt", i) for i in range(1, 9)]
