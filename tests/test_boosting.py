"""Boosted trees against a brute-force version, and lockstep growth against single fits."""
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from riverlens.operators import boosting as B

FEATURES = ["a", "b", "c"]


@pytest.fixture(scope="module")
def table(spark):
    """Three classes of unequal size, ties and a constant column."""
    rng = np.random.default_rng(1)
    a, b = rng.integers(0, 12, 600) / 4, rng.normal(size=600)
    y = (a + b > 2).astype(int) + (a - b > 2.5)
    rows = [(i, float(a[i]), float(b[i]), 1.0, int(y[i]), float(a[i] * 3 - b[i] ** 2)) for i in range(600)]
    return spark.createDataFrame(rows, "reading_id long, a double, b double, c double, y int, t double").repartition(5).checkpoint()


def small(kind, **change):
    return replace(B.LEARNERS[kind], **{"rounds": 4, "depth": 3, **change})


def same(one, other):
    for a, b in zip(one.trees, other.trees, strict=True):
        assert (a.feature == b.feature).all() and (a.bin == b.bin).all() and (a.value == b.value).all()


@pytest.mark.parametrize("label,classes", [("y", 3), ("t", 0)])
def test_lockstep_over_blocks_equals_growth_in_one_block(spark, table, monkeypatch, label, classes):
    monkeypatch.setattr(B, "KEEP", 2)       # margins are written and read on the way
    cuts = B.find_cuts(table, FEATURES)
    fits = {f"{kind}-{k}": (small(kind), F.col("reading_id") % 3 != k) for kind in B.LEARNERS for k in range(3)}
    one = B.fit_many(table, FEATURES, F.col(label), fits, classes, cuts=cuts)
    many = B.fit_many(table, FEATURES, F.col(label), fits, classes, cuts=cuts, block_rows=64)
    assert any((t.feature >= 0).any() for t in one.trees)
    same(one, many)


def test_fits_do_not_depend_on_their_company_or_on_partitions(spark, table):
    cuts = B.find_cuts(table, FEATURES)
    rows = F.col("reading_id") % 4 != 1
    alone = B.fit_many(table, FEATURES, F.col("y"), {"x": (small("boosted"), rows)}, 3, cuts=cuts)
    fits = {"z": (small("gradient_boosting"), F.lit(True)), "x": (small("boosted"), rows)}
    among = B.fit_many(table.repartition(2).withColumn("y", F.col("y") + 0), FEATURES, F.col("y"), fits, 3, cuts=cuts)
    same(alone, B.Ensemble(among.fits[1:], among.trees[1:], cuts))


def brute(x, y, cuts, learner, classes, out):
    """Margins after every round by plain enumeration of all splits, all rows and columns drawn."""
    n = len(y)
    counts = np.bincount(y, minlength=classes)
    margins = np.tile(np.zeros(classes) if learner.newton else np.log(counts / n), (n, 1))

    def leaf(g, h):
        if learner.newton:
            return -g.sum() / (h.sum() + 1) * learner.rate
        e = (np.abs(g) * (1 - np.abs(g))).sum()
        return -(classes - 1) / classes * g.sum() / e * learner.rate if e > 1e-12 else 0.0

    def gain(g, h, left):
        if learner.newton:
            score = lambda m: g[m].sum() ** 2 / (h[m].sum() + 1)
            if min(h[left].sum(), h[~left].sum()) < 1:
                return -1.0
            return score(left) + score(~left) - score(left | ~left)
        if not left.any() or left.all():
            return -1.0
        return left.sum() * (~left).sum() / n_here(left) * (g[left].mean() - g[~left].mean()) ** 2

    def n_here(left):
        return len(left)

    def grow(rows, g, h, depth, k):
        value = leaf(g[rows], h[rows])
        best = (1e-9, None)
        if depth < learner.depth:
            for j, points in enumerate(cuts):
                for point in points:
                    left = x[rows, j] <= point
                    found = gain(g[rows], h[rows], left)
                    if found > best[0] * (1 + 1e-9):
                        best = (found, left)
        if best[1] is None:
            margins[rows, k] += value
            return
        grow(rows[best[1]], g, h, depth + 1, k)
        grow(rows[~best[1]], g, h, depth + 1, k)

    for _ in range(learner.rounds):
        p = np.exp(margins)
        p /= p.sum(axis=1, keepdims=True)
        start = margins.copy()
        for k in range(classes):
            g = np.exp(start[:, k]) / np.exp(start).sum(axis=1) - (y == k)
            q = np.exp(start[:, k]) / np.exp(start).sum(axis=1)
            grow(np.arange(n), g, 2 * q * (1 - q), 0, k)
        out.append(margins.copy())
    return margins


@pytest.mark.parametrize("kind", ["boosted", "gradient_boosting"])
def test_trees_equal_plain_enumeration(spark, table, kind):
    learner = small(kind, rounds=3, depth=2, rows=1.0, columns=1.0)
    fitted = B.fit_many(table, FEATURES, F.col("y"), {"m": (learner, F.lit(True))}, 3)
    pdf = table.orderBy("reading_id").toPandas()
    margins = brute(pdf[FEATURES].to_numpy(), pdf["y"].to_numpy(), fitted.cuts.points, learner, 3, [])
    got = fitted.trees[0].add(B.first_margins(fitted.fits[0], len(pdf)), fitted.cuts.bins(pdf), fitted.fits[0], range(3))
    assert np.allclose(got, margins, atol=1e-5)


@pytest.mark.parametrize("kind", ["boosted", "gradient_boosting"])
def test_log_loss_falls_and_probabilities_sum_to_one(spark, table, kind):
    fitted = B.fit_many(table, FEATURES, F.col("y"), {"m": (small(kind, rounds=12, rows=1.0), F.lit(True))}, 3)
    pdf = table.toPandas()
    fit, trees, bins = fitted.fits[0], fitted.trees[0], fitted.cuts.bins(pdf)
    margins, losses = B.first_margins(fit, len(pdf)), []
    for r in range(12):
        p = np.exp(trees.add(margins, bins, fit, [r]))
        p /= p.sum(axis=1, keepdims=True)
        losses.append(-np.log(p[np.arange(len(pdf)), pdf["y"]]).mean())
    assert all(b < a for a, b in zip(losses, losses[1:]))
    out = fitted.predict(table, ["reading_id", "y"]).toPandas()
    assert np.allclose([sum(o) for o in out["output"]], 1)
    assert (np.array([np.argmax(o) for o in out["output"]]) == out["y"]).mean() > 0.9


def test_columns_are_drawn_per_tree_and_rows_per_round():
    learner = B.LEARNERS["boosted"]
    drawn = {tuple(B.columns_of(learner, 45, r, k)) for r in range(5) for k in range(3)}
    assert len(drawn) == 15 and all(len(d) == 36 for d in drawn)
    share = B.uniform(np.arange(100_000), 42, 3)
    assert 0.79 < (share < 0.8).mean() < 0.81 and abs(np.corrcoef(share, B.uniform(np.arange(100_000), 42, 4))[0, 1]) < 0.02


def test_odd_rows(spark, table):
    """Nulls and NaN sort last, rows without key, label or membership do not train, a missing class stays unlikely."""
    odd = table.select("reading_id", "a", "b", F.lit(None).cast("double").alias("c"), "y").unionByName(spark.createDataFrame(
        [(None, 1.0, 1.0, 1.0, 1), (900, 1.0, 1.0, 1.0, None), (901, float("nan"), None, 1.0, 0)], "reading_id long, a double, b double, c double, y int"))
    fitted = B.fit_many(odd, FEATURES, F.col("y"), {"m": (small("gradient_boosting"), F.col("y") < 2), "n": (small("boosted"), F.col("y") < 2)}, 3)
    out = fitted.predict(odd, ["reading_id"]).toPandas()
    assert len(out) == 2 * odd.count() and all(o[2] < 0.34 for o in out["output"]) and out["output"].map(lambda o: np.isfinite(o).all()).all()
    with pytest.raises(ValueError, match="no row"):
        B.fit_many(table, FEATURES, F.col("y"), {"m": (small("boosted"), F.col("y") > 7)}, 3)
    assert fitted.predict(odd.limit(0), ["reading_id"]).count() == 0


def test_rows_beyond_one_block_are_dealt_over_all_cores(spark, table, monkeypatch):
    """A little more than one block: every core gets rows, also where the input is one partition."""
    monkeypatch.setattr(B, "BLOCK_ROWS", 400)
    monkeypatch.setattr(B, "SMALL_BLOCK", 8, raising=False)
    cuts, cores = B.find_cuts(table, FEATURES), spark.sparkContext.defaultParallelism
    blocks = B.bin_rows(table.coalesce(1), cuts, "reading_id", F.col("y"), [F.lit(True)])
    assert blocks.count() >= 2 * cores and len(blocks.inputFiles()) >= cores and blocks.agg(F.sum("n")).first()[0] == 600
    fits = {kind: (small(kind), F.col("reading_id") % 3 != 1) for kind in B.LEARNERS}
    many = B.fit_many(table, FEATURES, F.col("y"), fits, 3, cuts=cuts)
    monkeypatch.setattr(B, "BLOCK_ROWS", 1000)
    same(B.fit_many(table, FEATURES, F.col("y"), fits, 3, cuts=cuts), many)


def test_fits_that_one_task_can_hold_are_binned_over_all_cores_and_need_no_job_per_level(spark, table, monkeypatch):
    """Below BLOCK_ROWS rows the blocks are many, and each fit meets in a task of its own; trees with early leaves are the same."""
    monkeypatch.setattr(B, "SMALL_BLOCK", 8)
    cuts = B.find_cuts(table, FEATURES)
    blocks = B.bin_rows(table.coalesce(1), cuts, "reading_id", F.col("y"), [F.lit(True)])
    assert blocks.count() >= 2 * spark.sparkContext.defaultParallelism
    fits = {kind: (small(kind, rounds=2, depth=6, rows=1.0), F.col("reading_id") % 5 != 1) for kind in B.LEARNERS}
    many = B.fit_many(table, FEATURES, F.col("y"), fits, 3, cuts=cuts, block_rows=64)
    monkeypatch.setattr(B, "_in_lockstep", None)
    same(B.fit_many(table, FEATURES, F.col("y"), fits, 3, cuts=cuts), many)


@pytest.mark.parametrize("slots,width,picked", [(1, 5, False), (3, 4, True), (2, 1, False)])
def test_histograms_of_column_pairs_are_exact_and_halve_the_sums(monkeypatch, slots, width, picked):
    rng = np.random.default_rng(5)
    n = 60_000
    bins, slot = rng.integers(0, B.BINS, (width + 2, n)).astype(np.uint8), rng.integers(0, slots, n)
    columns, weights = np.sort(rng.permutation(width + 2)[:width]), np.rint(rng.normal(size=(2, n)) / B.QUANTUM)
    rows = np.sort(rng.permutation(n)) if picked else None
    want = np.zeros((2, slots, width, B.BINS), dtype=np.int64)
    for c in range(2):
        for j, column in enumerate(columns):
            np.add.at(want[c, :, j], (slot, bins[column]), weights[c].astype(np.int64))
    calls, plain = [], np.bincount
    monkeypatch.setattr(B.np, "bincount", lambda at, *rest: (calls.append(len(at)), plain(at, *rest))[1])
    assert (B.histogram(bins.T, rows, columns, slot, slots, weights) == want).all()
    assert sum(calls) <= 2 * n * -(-width // 2)


def test_leaf_weights_are_summed_by_node_and_not_by_column(monkeypatch):
    """Alone, a residual class fit sums two channels by column and bin; counts need no weights, and leaves are those of all three channels."""
    rng = np.random.default_rng(3)
    n, fit = 3000, replace(B.Fit("m", B.LEARNERS["gradient_boosting"], 0, 3, (0.0, 0.1, -0.1), 1.0, 3000), learner=small("gradient_boosting", rounds=3, rows=1.0))
    bins, y = rng.integers(0, B.BINS, (4, n)).astype(np.uint8), rng.integers(0, 3, n).astype(float)
    seen, plain, weighted = [], B.histogram, []
    monkeypatch.setattr(B, "histogram", lambda *args: (seen.append(len(args[-1])), plain(*args))[1])
    counted = np.bincount
    monkeypatch.setattr(np, "bincount", lambda x, weights=None, minlength=0: (weighted.append(weights is not None), counted(x, weights, minlength))[1])
    trees = B.grow_alone(fit, np.arange(n), bins, y)
    assert set(seen) == {2} and weighted.count(False) > len(weighted) / 3
    monkeypatch.setattr(np, "bincount", counted)
    margins, checked = B.first_margins(fit, n), 0
    for r in range(3):
        said = B.expected(fit, margins)
        for k in range(3):
            at, weights = trees.route(bins.T, r, k, np.arange(n), fit.learner.depth), B.channels(fit, y, said, k)
            for leaf in np.unique(at):
                assert trees.value[r, k, leaf] == float(B.leaf_values(fit, weights[:, at == leaf].sum(axis=1)))
                checked += 1
        trees.add(margins, bins.T, fit, [r])
    assert checked > 9


def test_every_block_is_a_file_of_its_own(spark, table, monkeypatch):
    """Readers share blocks out by size, also where a task has written several."""
    cuts = B.find_cuts(table, FEATURES)
    blocks = B.bin_rows(table.coalesce(1), cuts, "reading_id", F.col("y"), [F.lit(True)], block_rows=50)
    assert len(blocks.inputFiles()) == blocks.count() == 12
    fit = B.prepared(blocks, [B.Fit("m", small("boosted"), 0, 3)], len(FEATURES))
    state = B._written(blocks, fit, [B.Trees.empty(fit[0])], len(FEATURES), 0, 1)
    assert len(state.inputFiles()) == state.count() == 12
