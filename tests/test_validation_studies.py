"""The validation studies run every model; small models stand in for the full ones."""
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from fixture_paths import SMALL
from riverlens.operators import boosting as B
from riverlens.operators import models as ML
from riverlens.plans import queries_models as Q
from riverlens.session import materialize, release_tables

MODELS = ["boosted", "gradient_boosting", "random_forest"]


@pytest.fixture(autouse=True)
def small_models(monkeypatch):
    monkeypatch.setitem(ML.CLASSIFIER_PARAMS, "random_forest", {**ML.CLASSIFIER_PARAMS["random_forest"], "numTrees": 5})
    for name, rounds in (("boosted", 2), ("gradient_boosting", 1)):
        monkeypatch.setitem(B.LEARNERS, name, replace(B.LEARNERS[name], rounds=rounds))
    monkeypatch.setattr(Q, "FRACTIONS", [0.5, 1.0])


@pytest.mark.parametrize("query,rows", [("validation_cv_summary", 2), ("validation_time_folds", 1), ("validation_noise", 1),
                                        ("validation_noise_regression", 1), ("validation_learning_curve", 2)])
def test_every_study_has_rows_of_every_model(spark, query, rows):
    out = getattr(Q, query)(spark, SMALL)
    got = {r.model: r["count"] for r in out.groupBy("model").count().collect()}
    assert {m: got.get(m) for m in MODELS} == {m: rows for m in MODELS}


def _study(spark, monkeypatch, tables):
    """Prediction tables that stand in for the fitted studies'."""
    made = {name: spark.createDataFrame(rows, schema) for name, (rows, schema) in tables.items()}
    monkeypatch.setattr(Q, "_once", lambda name, *_: made[name])


def _classes(share):
    """Predictions of two classes, of which the first ``share`` of ten rows a class are right."""
    return [(y, y if i < share else "ab"[y == "a"]) for y in "ab" for i in range(10)]


def _made(noise_right):
    cv = {"random_forest": (9, 10), "boosted": (8, 10), "gradient_boosting": (7, 8)}
    r2 = {"random_forest": 1.0, "boosted": 2.0, "gradient_boosting": 30.0}
    return {
        "cv": ([(m, k, role, *c) for m, n in cv.items() for k in range(5) for role, right in zip(("test", "train"), n, strict=True) for c in _classes(right)],
               "model string, cv_fold int, role string, y string, pred string"),
        "time": ([(m, k, *c) for m in cv for k in range(5) for c in _classes(6 + k % 2)], "model string, time_fold int, y string, pred string"),
        "noise": ([(m, s, *c) for m in cv for s in Q.CLASS_SIGMAS for c in _classes(noise_right[m] if s else 9)],
                  "model string, sigma double, y string, pred string"),
        "noise-r2": ([(m, s, float(y), y + e * (1 + s) * (-1) ** i) for m, e in r2.items() for s in Q.NUMBER_SIGMAS for i, y in enumerate((0, 20, 40, 60))],
                     "model string, sigma double, y double, p double"),
    }


def test_verdict_counts_noise_and_r2(spark, monkeypatch):
    _study(spark, monkeypatch, _made({"random_forest": 2, "boosted": 8, "gradient_boosting": 8}))
    rows = {(r.task, r.model): r for r in Q.validation_cv_summary(spark, SMALL).collect()}
    assert len(rows) == 6
    forest, boosted = rows["classification", "random_forest"], rows["classification", "boosted"]
    assert forest.cv_mean > 0.6 and forest.gap < 0.4 and forest.noise_f1 < 0.5
    assert (forest.validated, forest.noise_ok) == (False, False) and (boosted.validated, boosted.noise_ok) == (True, True)
    assert forest.r2_ok is None
    good, bad = rows["regression", "random_forest"], rows["regression", "gradient_boosting"]
    assert (good.r2_ok, good.validated, bad.r2_ok, bad.validated) == (True, True, False, False)


def test_summary_takes_its_best_models_and_values_from_the_studies(spark, monkeypatch):
    made = _made({"random_forest": 6, "boosted": 7, "gradient_boosting": 8})
    _study(spark, monkeypatch, made)
    got = {(r.task, r.metric): (r.model, r.value) for r in Q.validation_summary(spark, SMALL).collect()}
    want = {"cv_f1_mean": 0.9, "cv_f1_std": 0.0, "time_f1_mean": 0.64, "time_f1_std": 0.24 ** 0.5 / 10, "noise_f1_0_05": 0.6, "gap": 0.1}
    assert {m: v for (t, m), (_, v) in got.items() if t == "classification"} == pytest.approx(want)
    want = {"r2": 1 - 4 / 2000, "rmse": 1.0, "mae": 1.0, "noise_r2_0_05": 1 - 4 * 1.05 ** 2 / 2000}
    assert {m: v for (t, m), (_, v) in got.items() if t == "regression"} == pytest.approx(want)
    assert {m for m, _ in got.values()} == {"random_forest"} and len(got) == 10


def test_a_study_is_made_again_for_rewritten_input_and_after_release(spark, tmp_path):
    def run(spark, sf_dir):
        return materialize(spark.read.parquet(f"{sf_dir}/events.parquet"), "study")

    def rows():
        return Q._once("test", run, spark, str(tmp_path)).count()

    spark.range(10).write.parquet(f"{tmp_path}/events.parquet")
    first = Q._once("test", run, spark, str(tmp_path))
    assert rows() == 10 and Q._once("test", run, spark, str(tmp_path)) is first
    spark.range(20).write.mode("overwrite").parquet(f"{tmp_path}/events.parquet")
    assert rows() == 20
    release_tables(spark)
    assert rows() == 20


def test_release_deletes_all_that_queries_wrote(spark, tmp_path):
    import os

    from riverlens.session import WRITTEN, ensure_checkpoint_dir
    root = ensure_checkpoint_dir(spark).removeprefix("file:")
    for name in WRITTEN:
        spark.range(3).write.mode("overwrite").parquet(f"{ensure_checkpoint_dir(spark)}/{name}/probe")
        assert os.path.isdir(f"{root}/{name}")
    release_tables(spark)
    assert not any(os.path.isdir(f"{root}/{name}") for name in WRITTEN) and os.path.isdir(root)


def test_studies_side_by_side_share_one_feature_table(spark, monkeypatch):
    release_tables(spark)
    made, plain = [], Q.model_input
    monkeypatch.setattr(Q, "model_input", lambda *at: (made.append(at), plain(*at))[1])
    assert Q.validation_cv_summary(spark, SMALL).count() == 6 and Q.validation_noise(spark, SMALL).count() == 3
    assert len(made) == 1
    release_tables(spark)


def test_anomaly_forest_of_dealt_rows(spark, monkeypatch):
    """Beyond ``FEW_ROWS`` a forest's rows are sorted, which must go by a column that the anomaly forest has."""
    release_tables(spark)
    monkeypatch.setattr(ML, "FEW_ROWS", 100)
    monkeypatch.setattr(ML, "fit_one_class", lambda normal, feats, nu, plain=ML.fit_one_class: plain(normal, feats, nu, n_components=32, iterations=1))
    assert {r.model for r in Q.model_anomaly_comparison(spark, SMALL).collect()} == {"isolation_forest", "rf_smote", "one_class"}
    timeline = Q.model_anomaly_timeline(spark, SMALL)
    assert Q.model_anomaly_events(spark, SMALL).count() == timeline.filter("y = 1").count() and timeline.count() > 0
    release_tables(spark)
