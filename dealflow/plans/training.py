"""The train -> validate -> explain batch job over a deal table.

Steps (each a set of distributed jobs): dataset metadata and fingerprint,
chronological split, fit/compare the candidates on the holdout, persist the
best model and a snapshot, walk-forward backtest on the train split, and the
permutation-importance report with provenance.  Reports go to ``out_dir``
(shared storage) through DataFrame writers.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.features import feature_roles
from ..operators.metrics import dataset_profile, file_fingerprints, table_fingerprint
from ..operators.ridge import RidgeModel
from ..operators.models import holdout_compare, permutation_importance, ridge_coefficients, walk_forward_backtest
from ..operators.split import fold_report, time_split, walk_forward
from ..sources.reports import (importance_report, model_snapshot, read_snapshot_lenient, save_model,
                               write_csv_report, write_json_report)


def train_validate_explain(deals: DataFrame, out_dir: str, categorical: Sequence[str] | None = None, numeric: Sequence[str] | None = None,
                           gbt_iter: int = 100, cv_model: str = "gbt", n_splits: int = 8, text_col: str | None = "unstructured_text",
                           source: str | None = None) -> dict:
    """Without column lists, roles come from the schema (P7).  ``text_col`` joins the features if it
    is there and not blank; ``source`` is the path the deals came from, whose files' digests are reported."""
    spark = deals.sparkSession
    out = out_dir.rstrip("/")
    roles = feature_roles(deals)
    categorical, numeric = categorical or roles[0], numeric or roles[1]

    profile = dataset_profile(deals)
    fp = table_fingerprint(deals, [F.col(c).cast("string") for c in deals.columns]).first()["fingerprint"]
    write_json_report(profile.withColumns({"dataset_hash": F.lit(fp), "path": F.lit(source), "columns": F.split("columns", ",")}),
                      f"{out}/dataset_metadata")

    if source is not None:
        write_csv_report(file_fingerprints(spark, source), f"{out}/dataset_files")

    split = time_split(deals)
    train, test = split.filter(F.col("split") == "train"), split.filter(F.col("split") == "test")

    text_col = text_col if text_col in deals.columns else None
    fitted, metrics = holdout_compare(train, test, categorical, numeric, gbt_iter=gbt_iter, text_col=text_col)
    write_csv_report(metrics, f"{out}/metrics")
    best_name = metrics.filter("best").first()["model"]
    best = fitted[best_name]
    save_model(best, f"{out}/model")
    snapshot = model_snapshot(spark, best_name, metrics, fp, f"{out}/model")
    write_json_report(snapshot, f"{out}/model_snapshot")

    cv = walk_forward_backtest(split, categorical, numeric, model=cv_model, n_splits=n_splits, gbt_iter=gbt_iter)
    write_csv_report(cv, f"{out}/ts_cv_metrics")
    windows = fold_report(walk_forward(split, n_splits)).withColumnRenamed("fold", "split").drop("train_n", "val_n")
    write_json_report(windows.join(cv, "split").orderBy("split"), f"{out}/ts_cv_report")
    summary = cv.groupBy("model").agg(F.avg("mae").alias("mae_mean"), F.stddev_samp("mae").alias("mae_std"),
                                      F.avg("rmse").alias("rmse_mean"), F.stddev_samp("rmse").alias("rmse_std"))
    write_csv_report(summary, f"{out}/ts_cv_summary")

    imp = permutation_importance(best, test, [*categorical, *numeric, *([text_col] if text_col else [])])
    fi = imp.orderBy(F.col("importance_mean").desc(), F.col("feature"))
    write_csv_report(fi.drop("n_test"), f"{out}/feature_importance")
    coefs = ridge_coefficients(best, spark) if isinstance(best, RidgeModel) else None
    snap = read_snapshot_lenient(spark, f"{out}/model_snapshot")
    report = importance_report(spark, imp, snap, fp, test.count(), coefs)
    write_json_report(report, f"{out}/feature_importance_json")
    return {"best_model": best_name, "dataset_hash": fp, "out_dir": out}
