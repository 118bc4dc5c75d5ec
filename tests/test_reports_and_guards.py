"""Leak guard, ties between models, run log, report tables, pair counts and threshold sets."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from fixture_paths import SMALL
from riverlens.operators import boosting as B
from riverlens.operators import models as ML
from riverlens.operators import quality as Q
from riverlens.operators import survey as V
from riverlens.sources import io
from riverlens.sources.adapters import load_survey


def test_leaking_features_are_refused_before_training(spark):
    df = spark.range(50).selectExpr("id as reading_id", "cast(id % 7 as double) as a", "cast(id % 2 as double) as b", "cast(id % 2 as int) as anomaly", "id as wqi")
    Q.guard_leakage(df, ["a"])
    with pytest.raises(Q.QualityError, match="b .correlation 1.0"):
        Q.guard_leakage(df, ["a", "b"])
    with pytest.raises(Q.QualityError, match="turbidity_lag1"):
        Q.guard_leakage(df, ["a", "turbidity_lag1"])
    for build in (lambda: ML.regression_pipeline(ML.make_regressor(), ["a", "wqi"]), lambda: ML.classification_pipeline(ML.make_classifier(), ["anomaly"], "x"),
                  lambda: B.fit_many(df, ["a", "wqi"], F.col("anomaly"), {}, 2)):
        with pytest.raises(Q.QualityError, match="leak the target"):
            build()


def test_enforce_tells_how_many_rules_fail(spark):
    report = spark.range(50).selectExpr("id as rule", "id % 2 as n_bad")
    with pytest.raises(Q.QualityError, match="^25 rules fail"):
        Q.enforce(report)


@pytest.mark.parametrize("partitions", [1, 4])
def test_ties_go_to_the_first_model_of_the_order(spark, partitions):
    rows = [("b", 0.5), ("c", 0.9), ("a", 0.9), ("d", None)]
    for table in (rows, rows[::-1]):
        df = spark.createDataFrame(table, "model string, f1 double").repartition(partitions)
        assert ML.best_model(df, "f1", ("c", "b", "a")).first()["best"] == "c"
        assert ML.best_model(df, "f1", ("a", "c")).first()["best"] == "a"
        assert ML.best_model(df, "f1", ()).first()["best"] == "a"


def test_a_repeated_run_stands_once_in_the_log(spark, tmp_path):
    path = str(tmp_path / "log")
    for run, n in (("r1", 1), ("r2", 2), ("r1", 3)):
        io.write_run(spark.createDataFrame([(n,)], "n long"), path, run)
    schema = spark.createDataFrame([], "n long").schema
    assert sorted((r.run_id, r.n) for r in io.read_runs(spark, path, schema).collect()) == [("r1", 3), ("r2", 2)]
    with pytest.raises(ValueError):
        io.write_run(spark.createDataFrame([(1,)], "n long"), path, "../r3")


def test_reports_are_read_back(spark, tmp_path):
    out = io.save_reports({"a": spark.range(3), "b": spark.range(0).selectExpr("id", "id as x")}, str(tmp_path))
    assert sorted(map(tuple, out.collect())) == [("a", 1, 3), ("b", 2, 0)]


def test_pair_counts_of_odd_levels(spark, monkeypatch):
    monkeypatch.setattr(V, "PAIR_BATCH", 7)
    rng = np.random.default_rng(4)
    rows = [tuple(None if rng.random() < 0.1 else int(x) for x in rng.integers(-2, 3, 3)) for _ in range(200)]
    df = spark.createDataFrame(rows, "a int, b int, c int").repartition(3)
    got = {(r.var1, r.var2, r.v1, r.v2): r.n for r in V.pair_contingency(df, [("a", "b"), ("c", "a"), ("b", "b")]).collect()}
    want = {}
    for row in rows:
        for x, y in (("a", "b"), ("c", "a"), ("b", "b")):
            v, w = row["abc".index(x)], row["abc".index(y)]
            if v is not None and w is not None:
                want[x, y, v, w] = want.get((x, y, v, w), 0) + 1
    assert got == want
    assert V.pair_contingency(df.limit(0), [("a", "b")]).count() == 0


def test_threshold_sets_and_the_fallback(spark):
    tests = V.pair_tests(load_survey(spark, SMALL), V.all_pairs(["L1", "L2", "L3", "L5", "L9", "L10"])).cache()
    sets = {}
    for r in V.significant_sets(tests).collect():
        sets.setdefault(r["set"], []).append((r.place, r.var1, r.var2))
    assert set(sets) <= set(V.SIGNIFICANT) and set(p[1:] for p in sets.get("strong", [])) <= set(p[1:] for p in sets["excellent"])
    assert all([p[0] for p in sorted(rows)] == list(range(1, len(rows) + 1)) for rows in sets.values())
    some, none = V.top_significant_pairs(tests, 0.05, 0.2, k=2).collect(), V.top_significant_pairs(tests, 0.0, 0.99, k=2).collect()
    assert some and all(r.filtered for r in some) and len(none) == 2 and not any(r.filtered for r in none)


@pytest.mark.parametrize("items,expected", [(["x", "y"], 1.0)])
def test_factor_adequacy_of_known_matrices(spark, items, expected):
    """Two items of correlation r have KMO .5, eigenvalues 1 + r and 1 - r, and Bartlett's -(n - 1 - 9/6) ln(1 - r^2)."""
    rng = np.random.default_rng(6)
    x = rng.normal(size=400)
    y = 0.6 * x + 0.8 * rng.normal(size=400)
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(x, y)], "x double, y double")
    r = np.corrcoef(x, y)[0, 1]
    fs = V.factor_summary(df, items)
    assert fs["kmo"] == pytest.approx(0.5) and fs["eigenvalues"] == pytest.approx([1 + r, 1 - r])
    assert fs["bartlett_chi2"] == pytest.approx(-(400 - 1 - (2 * 2 + 5) / 6) * np.log(1 - r * r)) and fs["bartlett_dof"] == 1
    assert np.abs(fs["loadings"][:, 0]) == pytest.approx([np.sqrt((1 + r) / 2)] * 2) and sum(fs["proportion"]) <= expected


def test_scores_are_taken_from_written_rows(spark, capsys):
    """The score's bounds and the rows are read from one table; the windows are not planned a second time."""
    from riverlens.plans import queries_features as QF
    alerts = QF.scored_alerts(spark, SMALL)
    alerts.explain()
    assert "Window" not in capsys.readouterr().out and all("/scored-" in f for f in alerts.inputFiles())
