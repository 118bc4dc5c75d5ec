"""Isolation-forest sampling and the one-class detector against an exact kernel solution."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from fixture_paths import SMALL
from riverlens.operators import models as ML
from riverlens.plans import queries_models as Q
from riverlens.operators import splits as P
from riverlens.schema import features_no_leak


def test_rows_leap_to_their_trees_at_the_given_rate():
    keys = np.arange(40_000)
    for trees in (50, 400):
        rows, tree = ML.drawn_trees(keys, trees, 0.01, 7)
        assert len(set(zip(rows, tree))) == len(rows)
        assert abs(len(rows) / (len(keys) * trees) - 0.01) < 3e-4
        per_tree = np.bincount(tree, minlength=trees)
        assert abs(per_tree - 400).max() < 5.5 * 20 and abs(np.corrcoef(rows[:-1] % 7, tree[:-1])[0, 1]) < 0.02
    few = set(zip(*ML.drawn_trees(keys, 50, 0.01, 7)))
    assert few == {(r, t) for r, t in zip(*ML.drawn_trees(keys, 400, 0.01, 7)) if t < 50}      # more trees change nothing for the first ones
    assert len(ML.drawn_trees(keys[:10], 6, 1.5, 7)[0]) == 60


def test_trees_do_not_depend_on_partitions(spark):
    df = Q.model_input(spark, SMALL)
    feats = features_no_leak()[:6]

    def trees(rows):
        return sorted(ML.fit_isolation_forest(rows, feats, n_trees=20, sample_size=64).collect())
    first = trees(df)
    assert first == trees(df.repartition(7, "ph")) and len({r.tree for r in first}) == 20 and max(r["size"] for r in first) <= 64
    assert {r.psi for r in first} == {64}


def exact_dual(k, nu, steps=3000):
    """min a'Ka / 2 over the box [0, 1/(nu n)] and sum 1, by accelerated projected gradient."""
    n = len(k)
    top, step = 1 / (nu * n), 1 / np.linalg.eigvalsh(k)[-1]
    a = ahead = np.full(n, 1 / n)
    t = 1.0
    for _ in range(steps):
        raw = ahead - step * (k @ ahead)
        low, high = raw.min() - 1, raw.max()
        for _ in range(60):
            mid = (low + high) / 2
            low, high = (mid, high) if np.clip(raw - mid, 0, top).sum() > 1 else (low, mid)
        new = np.clip(raw - high, 0, top)
        grown = (1 + (1 + 4 * t * t) ** 0.5) / 2
        ahead, a, t = new + (t - 1) / grown * (new - a), new, grown
    return a


@pytest.mark.parametrize("nu", [0.05, 0.2])
def test_one_class_equals_the_exact_kernel_solution(spark, nu):
    feats = features_no_leak()
    df = Q.model_input(spark, "/root/testdata/sf0.01").filter("anomaly = 0").orderBy("reading_id").limit(2000)
    rows = Q.materialize(P.apply_standardizer(df, P.fit_standardizer(df, feats), feats).select("reading_id", *feats), "normal")
    model = ML.fit_one_class(rows, feats, nu)
    got = ML.score_one_class(rows, model).orderBy("reading_id").toPandas()
    x = got[feats].to_numpy(float)
    gap = (x * x).sum(axis=1)[:, None] + (x * x).sum(axis=1) - 2 * x @ x.T
    k = np.exp(-model["gamma"] * np.maximum(gap, 0))
    exact = -(k @ exact_dual(k, nu))
    assert np.corrcoef(exact, got["ocsvm_score"])[0, 1] > 0.99
    assert abs((got["ocsvm_score"] > 0).mean() - nu) <= 0.1 * nu


def test_several_nu_share_one_pass_an_iteration_and_get_the_same_models(spark, monkeypatch):
    """A pass reads every row once, whatever the number of nu; scores are written before their quantiles are taken."""
    feats = features_no_leak()[:5]
    df = Q.model_input(spark, SMALL).filter("anomaly = 0")
    rows = Q.materialize(P.apply_standardizer(df, P.fit_standardizer(df, feats), feats).select("reading_id", *feats), "normal")
    nus = (0.05, 0.1, 0.3)
    models = ML.fit_one_classes(rows, feats, nus, n_components=64, iterations=4)
    for nu, model in zip(nus, models, strict=True):
        alone = ML.fit_one_class(rows, feats, nu, n_components=64, iterations=4)
        assert np.allclose(alone["w"], model["w"], atol=1e-9) and abs(alone["rho"] - model["rho"]) < 1e-9
        x = np.array(rows.select(*feats).collect(), dtype=float)
        assert np.allclose(model["kernel"].scores(x, model["w"]), model["kernel"](x) @ model["w"])


def test_forest_scores_equal_a_walk_through_each_tree(spark):
    feats = features_no_leak()[:4]
    rows = Q.model_input(spark, SMALL).select("reading_id", *feats).limit(300)
    trees = ML.fit_isolation_forest(rows, feats, n_trees=7, sample_size=32)
    nodes = {(r.tree, r.node): r for r in trees.collect()}
    psi = trees.first().psi

    def path(x, tree):
        at = nodes[tree, 0]
        while at.feature >= 0:
            at = nodes[tree, at.left if x[at.feature] < at.threshold else at.right]
        return at.depth + ML._c(at["size"])
    for r in ML.score_isolation_forest(rows, trees, feats).collect():
        x = [r[f] for f in feats]
        assert abs(r.iso_score - 2 ** (-np.mean([path(x, t) for t in range(7)]) / ML._c(psi))) < 1e-12
