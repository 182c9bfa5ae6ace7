"""Order statistics, Gram-matrix ridge, permutations and the text stage against plain computations."""

import numpy as np
import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.sql import functions as F

from conftest import SF_SMALL
from dealflow.operators.features import numeric_stats
from dealflow.operators.models import fit_candidate, permutation_importance, tree_backtest
from dealflow.operators.order_stats import quantiles
from dealflow.operators.permute import keys_literal, permuted, rectangle, round_keys
from dealflow.operators.ridge import RidgeModel, fit_ridge, gram_table, medians_of, solve
from dealflow.operators.split import time_split
from dealflow.operators.text_stage import TfidfText, has_text
from dealflow.plans.catalog import CATEGORICAL_FEATURES, NUMERIC_FEATURES
from dealflow.sources.reports import load_model, save_model
from dealflow.sources.tables import deals


def test_quantiles_of_hot_and_rare_values(spark):
    rng = np.random.default_rng(1)
    values = {"hot": np.concatenate([np.full(500, 3.0), rng.normal(size=91)]), "one": np.array([7.5]), "two": np.array([1.0, 4.0]),
              "many": rng.normal(size=1000), "signs": np.array([-0.0, 0.0, -1.0, 1.0])}
    rows = [(g, float(v), i % 3) for g, vs in values.items() for i, v in enumerate(vs)]
    rows += [("hot", None, 0), ("hot", float("nan"), 1), ("none", None, 0)]
    df = spark.createDataFrame(rows, "g string, value double, part int").repartition(5)
    probs = [0.0, 0.1, 0.25, 0.5, 0.9, 1.0]
    got = {(r.g, r.weight, r.prob): (r.n, r.quantile) for r in quantiles(df, ["g"], probs, {"all": F.lit(True), "first": F.col("part") == 0}).collect()}
    for g, vs in values.items():
        for weight, own in (("all", vs), ("first", vs[::3])):
            for p in probs:
                n, x = got[g, weight, p]
                assert n == len(own) and x == pytest.approx(np.quantile(own, p), rel=1e-12, abs=1e-12)
    assert not any(k[0] == "none" for k in got)


def test_numeric_stats_of_the_filled_column(spark):
    df = spark.createDataFrame([(1.0, 5.0), (2.0, 5.0), (None, 5.0), (10.0, None), (float("nan"), 5.0)], "a double, b double")
    got = {r.feature: r for r in numeric_stats(df, ["a", "b"]).collect()}
    filled = np.array([1.0, 2.0, 2.0, 10.0, 2.0])
    assert (got["a"]["median"], got["a"]["mean"]) == (2.0, pytest.approx(filled.mean()))
    assert got["a"]["scale"] == pytest.approx(filled.std()) and got["b"]["scale"] == 1.0


def closed_form(rows, cats, nums, y):
    import pandas as pd
    p, names, columns = pd.DataFrame(rows), [], []
    for c in cats:
        v = p[c].fillna(p[c].mode().min())
        for level in sorted(v.unique()):
            names.append(f"{c}_{level}"), columns.append((v == level).astype(float))
    for c in nums:
        x = p[c].astype(float).fillna(p[c].median())
        sd = x.std(ddof=0)
        names.append(c), columns.append(x / (sd if sd > 0 else 1.0))
    x, t = np.array(columns).T, p[y].to_numpy()
    mu = x.mean(axis=0)
    w = np.linalg.solve((x - mu).T @ (x - mu) + np.eye(x.shape[1]), (x - mu).T @ (t - t.mean()))
    return dict(zip(names, w)), t.mean() - mu @ w, x @ w + t.mean() - mu @ w


def test_ridge_with_nulls_against_the_closed_form(spark):
    rng = np.random.default_rng(2)
    rows = [{"c": None if i % 9 == 0 else "xyz"[i % 3], "d": "k" if i % 4 else "m", "a": None if i % 7 == 0 else float(rng.normal(50, 2)),
             "b": float(rng.normal(0, 1e6)), "same": 3.0, "noi_next12": float(rng.normal(1e5, 1e4))} for i in range(200)]
    df = spark.createDataFrame(rows, "c string, d string, a double, b double, same double, noi_next12 double").repartition(3)
    model = fit_ridge(df, ["c", "d"], ["a", "b", "same"])
    want, intercept, predicted = closed_form(rows, ["c", "d"], ["a", "b", "same"], "noi_next12")
    got = dict(model.coefficients())
    assert got.keys() == want.keys()
    assert all(got[k] == pytest.approx(want[k], rel=1e-6, abs=1e-5) for k in want)
    assert model.intercept == pytest.approx(intercept, rel=1e-8)
    scored = sorted(r.predicted_noi_next12 for r in model(df).collect())
    assert scored == pytest.approx(sorted(predicted), rel=1e-9)
    unknown = df.limit(1).withColumns({"c": F.lit("new"), "d": F.lit("k"), "a": F.lit(50.0), "b": F.lit(0.0), "same": F.lit(3.0)})
    assert np.isfinite(model(unknown).first().predicted_noi_next12)
    again = RidgeModel.from_record(model.record())
    assert again == model
    # segments add up to the whole
    table = gram_table(df, ["c", "d"], ["a", "b", "same"], segment=F.when(F.col("b") > 0, 1).otherwise(0))
    assert solve(table, medians_of(df, ["a", "b", "same"])["all"]).intercept == pytest.approx(model.intercept, rel=1e-9)


@pytest.mark.parametrize("n", [1, 2, 3, 7, 100, 1009])
def test_permutations_are_one_to_one(spark, n):
    a, b = rectangle(n)
    assert n <= a * b < n + a + b
    seen = []
    for repeat in range(2):
        keys = keys_literal(round_keys(42, "x", repeat))
        seen.append([r.p for r in spark.range(n).repartition(3).select(permuted(F.col("id"), n, keys).alias("p"), "id").orderBy("id").collect()])
        assert sorted(seen[-1]) == list(range(n))
    assert n < 100 or seen[0] != seen[1]


def test_additive_and_general_importance_agree(spark):
    s = time_split(deals(spark, SF_SMALL))
    train, test = s.filter("split = 'train'"), s.filter("split = 'test'")
    model = fit_candidate("ridge", train, CATEGORICAL_FEATURES, NUMERIC_FEATURES)

    class Plain:
        transform = staticmethod(model.transform)

    features = ["noi_t12", "property_type", "units"]
    a = {r.feature: r for r in permutation_importance(model, test, features, 3).collect()}
    b = {r.feature: r for r in permutation_importance(Plain(), test, features, 3).collect()}
    for f in features:
        assert a[f].importance_mean == pytest.approx(b[f].importance_mean, rel=1e-6, abs=1e-4)
        assert a[f].importance_std == pytest.approx(b[f].importance_std, rel=1e-6, abs=1e-4)
    assert a["noi_t12"].importance_mean > a["units"].importance_mean


def test_tree_backtest_learns_and_counts_its_windows(spark):
    s = time_split(deals(spark, SF_SMALL))
    rows = sorted(tree_backtest(s, CATEGORICAL_FEATURES, NUMERIC_FEATURES, n_splits=3, gbt_iter=5).collect(), key=lambda r: r.split)
    n = s.filter("split = 'train'").count()
    size = n // 4
    assert [(r.split, r.train_n, r.val_n) for r in rows] == [(k, n - (4 - k) * size, size) for k in (1, 2, 3)]
    assert all(r.r2 > 0.5 for r in rows)


def test_text_stage_saves_loads_and_is_left_out_when_blank(spark, tmp_path):
    texts = ["lease renewal near station", "new roof, lease ends", None, "station nearby: new lease", ""] * 6
    rows = [(f"D{i}", "ab"[i % 2], float(i), t, 100.0 * i + (50.0 if t and "roof" in t else 0.0)) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "deal_id string, c string, x double, unstructured_text string, noi_next12 double")
    fitted = Pipeline(stages=[TfidfText(minDF=2, maxFeatures=50)]).fit(df)
    vectors = fitted.transform(df).select("text_features").collect()
    assert all(abs(v.text_features.norm(2) - 1) < 1e-12 or v.text_features.numNonzeros() == 0 for v in vectors)
    fitted.write().overwrite().save(str(tmp_path / "stage"))
    assert [r.text_features for r in PipelineModel.load(str(tmp_path / "stage")).transform(df).collect()] == [r.text_features for r in vectors]

    model = fit_candidate("gbt", df, ["c"], ["x"], gbt_iter=2, text_col="unstructured_text")
    save_model(model, str(tmp_path / "model"))
    a, b = (sorted(r.predicted_noi_next12 for r in m.transform(df).collect()) for m in (model, load_model(str(tmp_path / "model"))))
    assert a == b
    with_text = fit_candidate("ridge", df, ["c"], ["x"], text_col="unstructured_text")
    plain = fit_candidate("ridge", df, ["c"], ["x"])
    error = [df_.agg(F.avg(F.abs(F.col("noi_next12") - F.col("predicted_noi_next12")))).first()[0] for df_ in (with_text.transform(df), plain.transform(df))]
    assert error[0] < error[1]
    blank = df.withColumn("unstructured_text", F.lit("  "))
    assert not has_text(blank, "unstructured_text") and isinstance(fit_candidate("ridge", blank, ["c"], ["x"], text_col="unstructured_text"), RidgeModel)


def test_permutation_is_compiled_and_its_join_sorts_nothing(spark):
    d = spark.range(1000).select(F.col("id").alias("p"))
    plan = d.select(permuted(F.col("p"), 1000, keys_literal(round_keys(1, 2, 3))).alias("q"))._jdf.queryExecution().executedPlan().toString()
    assert plan.index("CASE WHEN") < plan.index("aggregate(")  # the loop is for walks only


def test_tree_rows_are_dealt_out_by_number(spark, monkeypatch):
    from dealflow.operators import models

    rows = spark.range(0, 100, 1, 2)
    assert models._tree_rows(rows, 100) is rows
    monkeypatch.setattr(models, "TREE_ROWS", 10)
    dealt = models._tree_rows(rows, 100)
    assert dealt.rdd.getNumPartitions() == 10 and dealt.count() == 100


def test_split_sorts_written_rows(spark):
    from dealflow.operators import split

    d = spark.createDataFrame([(f"D{i}", f"2024-01-{1 + i % 5:02d}") for i in range(50)], "deal_id string, asof_date string")
    calls = spark.sparkContext.accumulator(0)

    def seen(batches):
        for b in batches:
            calls.add(b.num_rows)
            yield b

    got = split.time_split(d.mapInArrow(seen, d.schema))
    assert got.count() == 50 and calls.value == 50
