"""Validation rules (P1-P5) and split / fold invariants."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from conftest import SF_SMALL
from dealflow.operators.split import fold_bounds, global_index, split_index, time_split, walk_forward
from dealflow.operators.validate import normalize_year_map, sort_key_error, validate
from dealflow.sources.tables import deals


def test_rules_and_defaults(spark):
    df = spark.createDataFrame([("a", 1.5, 0.05, 0, None), ("b", 0.6, 0.05, 25, 0.07)],
                               "deal_id string, ltv double, interest_rate double, amort_years int, exit_cap_rate double")
    v = {r.deal_id: r for r in validate(df, required=("ltv",)).collect()}
    assert v["a"].status == "quarantined"
    assert v["a"].errors == ["ltv must be between 0.0 and 1.0", "amort_years must be between 1 and 40"]
    assert v["a"].exit_cap_rate == 0.065 and v["b"].exit_cap_rate == 0.07
    assert v["b"].status == "accepted" and v["b"].selling_cost_pct == 0.02


def test_year_map_and_sort_key(spark):
    df = spark.createDataFrame([({"2": "250000"},), ({},), ({"x": "1"},)], "m map<string,string>")
    val, err = normalize_year_map(F.col("m"))
    rows = df.select(val.alias("v"), err.alias("e"), sort_key_error(F.lit("bogus")).alias("s")).collect()
    assert rows[0].v == {2: 250000.0} and rows[0].e is None
    assert rows[1].v is None and rows[1].e is None
    assert rows[2].v is None and "value_add_capex" in rows[2].e
    assert rows[0].s.startswith("sort_by: none of")


def test_global_index_equals_row_number(spark):
    d = deals(spark, SF_SMALL)
    gi = global_index(d.repartition(7), ["asof_date", "deal_id"]).select("deal_id", "row_ix")
    rn = d.select("deal_id", (F.row_number().over(Window.orderBy("asof_date", "deal_id")) - 1).alias("rn"))
    assert gi.join(rn, "deal_id").filter(F.col("row_ix") != F.col("rn")).count() == 0
    assert gi.count() == d.count()


def test_split_and_folds(spark):
    assert split_index(10) == 8 and split_index(3) == 2
    b = fold_bounds(100, 8)
    assert len(b) == 8 and b[-1][2] == 100 and all(e - s == 100 // 9 for _, s, e in b)
    s = time_split(deals(spark, SF_SMALL))
    n = s.count()
    assert s.filter("split = 'train'").count() == split_index(n)
    f = walk_forward(s)
    per = {r.fold: r for r in f.groupBy("fold").agg(
        F.count_if(F.col("role") == "train").alias("tr"), F.count_if(F.col("role") == "val").alias("va"),
        F.max(F.when(F.col("role") == "train", F.col("row_ix"))).alias("tr_max"),
        F.min(F.when(F.col("role") == "val", F.col("row_ix"))).alias("va_min")).collect()}
    assert len(per) == 8
    for r in per.values():
        assert r.tr_max < r.va_min                 # no leakage: train strictly before validation
