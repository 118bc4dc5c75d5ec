"""Models M1-M15 on Spark ML, plus the detectors Spark ML lacks.

* Classifiers/regressors are Spark ML estimators inside a ``Pipeline`` whose
  first stage assembles features *by name* from the stored feature list.
* The isolation forest samples rows per tree with a hash, grows the trees in
  parallel with ``groupBy(tree).applyInPandas`` and scores with
  ``mapInPandas`` against a tree table whose size is fixed by the parameters
  (trees x 2 x sample size), never by the data.
* SMOTE finds the exact k nearest minority neighbours through a box index
  (``neighbours``), then interpolates.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.stats import exact_quantiles
from ..plans.ordering import SEQ, sequence_index
from ..session import materialize
from .boosting import uniform
from .neighbours import nearest
from .quality import guard_names

# ------------------------------------------------------------------ estimators
# Hyper-parameters that must match (those of boosted trees: ``boosting.LEARNERS``).
CLASSIFIER_PARAMS = {
    "random_forest": dict(numTrees=200, minInstancesPerNode=3),
}
REGRESSOR_PARAMS = CLASSIFIER_PARAMS


def make_classifier(kind: str = "random_forest", seed: int = 42, weight_col: str | None = "weight", **override):
    """M1: random forest, balanced weights. M2 and M3 are grown by ``boosting``."""
    est = RandomForestClassifier(featuresCol="features", labelCol="label_index", seed=seed, **{**CLASSIFIER_PARAMS[kind], **override})
    return est.setWeightCol(weight_col) if weight_col else est


def make_regressor(kind: str = "random_forest", seed: int = 42, **override):
    """M4. M5 and M6 are grown by ``boosting``."""
    return RandomForestRegressor(featuresCol="features", labelCol="target", seed=seed, **{**REGRESSOR_PARAMS[kind], **override})


def classification_pipeline(estimator, features: list[str], label: str) -> Pipeline:
    """Assemble by name (fixes positional drift), encode labels alphabetically, fit; features that leak a target are refused (Q9)."""
    guard_names(features)
    return Pipeline(stages=[
        StringIndexer(inputCol=label, outputCol="label_index", stringOrderType="alphabetAsc"),
        VectorAssembler(inputCols=features, outputCol="features", handleInvalid="keep"),
        estimator])


def regression_pipeline(estimator, features: list[str]) -> Pipeline:
    guard_names(features)
    return Pipeline(stages=[VectorAssembler(inputCols=features, outputCol="features", handleInvalid="keep"),
                            estimator])


FEW_ROWS = 1 << 15      # up to these a forest's rows stay as they are
DEALT_ROWS = 1 << 17    # a forest keeps about 1 KB a row: its bins and how often each tree draws it


def dealt(df: DataFrame, *order: str) -> DataFrame:
    """Training rows dealt evenly for a forest: some parts for every core, none above ``DEALT_ROWS``; a small table stays as it is.

    Each part is sorted by ``order``: rows that follow each other then add to the same nodes and bins of a tree, which stay in the processor's cache.
    """
    n, cores = df.count(), df.sparkSession.sparkContext.defaultParallelism
    if n <= FEW_ROWS:
        return df
    parts = df.repartition(max(3 * cores, math.ceil(n / DEALT_ROWS)))
    return parts.sortWithinPartitions(*order) if order else parts


def class_probability(pred: DataFrame, model, label_value: str, label: str, out: str = "prob") -> DataFrame:
    """Probability of ``label_value`` picked by name from the fitted indexer."""
    return pred.withColumn(out, vector_to_array("probability")[model.stages[0].labels.index(label_value)])


def feature_importances(model, features: list[str], spark) -> DataFrame:
    """Importance per feature, ranked, with % of the total (tree models)."""
    est = model.stages[-1]
    imp = est.featureImportances.toArray()
    rows = [(f, float(v)) for f, v in zip(features, imp)]
    df = spark.createDataFrame(rows, "feature string, importance double")
    w = Window.orderBy(F.desc("importance"), "feature")  # one row per feature: a small result
    return df.select("feature", "importance", (F.col("importance") * 100 / F.lit(float(imp.sum() or 1))).alias("pct"),
                     F.row_number().over(w).alias("rank"))


def top_importances(imp: DataFrame, k: int = 15) -> DataFrame:
    """M13."""
    return imp.orderBy(F.desc("importance"), "feature").limit(k)


def best_model(metrics: DataFrame, metric: str, order: Sequence[str], name: str = "model") -> DataFrame:
    """Argmax of a metric; on ties the model that stands first in ``order`` (models outside it come last, by name)."""
    place = F.coalesce(F.nullif(F.array_position(F.array(*[F.lit(m) for m in order]), F.col(name)), F.lit(0)), F.lit(len(order) + 1))
    first = F.struct(F.col(metric).isNull().alias("none"), (-F.col(metric)).alias("down"), place.alias("place"), F.col(name).alias("name"))
    return metrics.agg(F.min_by(F.struct(name, metric), first).alias("b")).select(F.col(f"b.{name}").alias("best"), F.col(f"b.{metric}").alias(metric))


# ------------------------------------------------------------- isolation forest
def _c(n: float) -> float:
    """Average path length of an unsuccessful BST search over n points."""
    if n <= 1:
        return 0.0
    if n == 2:
        return 1.0
    return 2.0 * (math.log(n - 1) + 0.5772156649015329) - 2.0 * (n - 1) / n


TREE_SCHEMA = ("tree int, node int, feature int, threshold double, left int, right int, "
               "size long, depth int, psi int")


def _grow(tree_id: int, x: np.ndarray, max_depth: int, seed: int) -> list[tuple]:
    rng = np.random.default_rng([seed, tree_id])
    nodes: list[tuple] = []
    stack = [(0, np.arange(len(x)), 0)]
    next_id = 1
    while stack:
        node, idx, depth = stack.pop()
        sub = x[idx]
        if depth >= max_depth or len(idx) <= 1:
            nodes.append((tree_id, node, -1, 0.0, -1, -1, len(idx), depth))
            continue
        lo, hi = sub.min(axis=0), sub.max(axis=0)
        usable = np.flatnonzero(hi > lo)
        if usable.size == 0:
            nodes.append((tree_id, node, -1, 0.0, -1, -1, len(idx), depth))
            continue
        f = int(rng.choice(usable))
        thr = float(rng.uniform(lo[f], hi[f]))
        left, right = next_id, next_id + 1
        next_id += 2
        nodes.append((tree_id, node, f, thr, left, right, len(idx), depth))
        mask = sub[:, f] < thr
        stack.append((left, idx[mask], depth + 1))
        stack.append((right, idx[~mask], depth + 1))
    return nodes


def drawn_trees(keys: np.ndarray, n_trees: int, rate: float, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, tree) pairs: every row joins every tree with probability ``rate``, by its key alone.

    A row leaps from one of its trees to the next by geometric gaps, so it
    costs one draw plus one per tree it joins, however many trees there are.
    """
    if rate >= 1:
        rows, trees = np.divmod(np.arange(len(keys) * n_trees), n_trees)
        return rows, trees
    rows, at, draw, out = np.arange(len(keys)), np.full(len(keys), -1.0), 0, []
    while len(rows):
        u = uniform(keys[rows], seed, draw)
        at = at + 1 + np.floor(np.log1p(-u) / math.log1p(-rate))
        inside = at < n_trees
        rows, at, draw = rows[inside], at[inside], draw + 1
        out.append((rows, at.astype(np.int64)))
    return np.concatenate([o[0] for o in out]), np.concatenate([o[1] for o in out])


def fit_isolation_forest(df: DataFrame, features: list[str], key: str = "reading_id", n_trees: int = 200,
                         sample_size: int = 256, seed: int = 42) -> DataFrame:
    """M7 training: returns the tree table (tree, node, feature, threshold, left, right, size, depth).

    Rows join trees at a rate that over-samples by half (``drawn_trees``); each
    tree keeps the ``sample_size`` smallest hashes of its rows. Both depend on
    keys only: any partitioning gives the same trees. A row without a key joins none.
    """
    n = df.count()
    psi = min(sample_size, n)
    rate = 1.5 * psi / max(n, 1)
    max_depth = int(math.ceil(math.log2(max(psi, 2))))
    rows = df.select(F.col(key).cast("long").alias("_key"), *[F.col(f).cast("double").alias(f) for f in features]).filter("_key is not null")

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            keys = batch["_key"].to_numpy(np.int64)
            at, tree = drawn_trees(keys, n_trees, rate, seed)
            picked = batch.iloc[at].assign(tree=tree.astype(np.int32))
            picked["_h"] = uniform(keys[at] * 1_000_003 + tree, seed + 1, 0)
            yield picked

    sample = rows.mapInPandas(draw, T.StructType([*rows.schema.fields, T.StructField("tree", T.IntegerType()), T.StructField("_h", T.DoubleType())]))

    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        tid = int(pdf["tree"].iloc[0])
        kept = pdf.sort_values(["_h", "_key"]).head(psi)        # about 1.5 x sample_size rows come in
        x = kept[features].to_numpy(dtype=float)
        return pd.DataFrame(_grow(tid, x, max_depth, seed),
                            columns=["tree", "node", "feature", "threshold", "left", "right", "size", "depth"]).assign(psi=psi)

    return materialize(sample.groupBy("tree").applyInPandas(grow, TREE_SCHEMA), "trees")


SCORED = 2048   # rows scored at a time


def _flat_tree(nodes: pd.DataFrame) -> tuple:
    """Arrays by node (column, threshold, left, right, path length) and the tree's depth; a leaf leads to itself."""
    g = nodes.sort_values("node")       # a tree's nodes are numbered from 0 without gaps
    leaf, own = g["feature"].to_numpy() < 0, np.arange(len(g))
    column, left, right = (g[c].to_numpy().astype(np.int64) for c in ("feature", "left", "right"))
    path = g["depth"].to_numpy() + np.array([_c(n) for n in g["size"]])
    return np.where(leaf, 0, column), g["threshold"].to_numpy(), np.where(leaf, own, left), np.where(leaf, own, right), path, int(g["depth"].max())


def score_isolation_forest(df: DataFrame, trees: DataFrame, features: list[str], out: str = "iso_score") -> DataFrame:
    """M7 scoring: anomaly score 2^(-E[h(x)] / c(psi)) for every row, in Arrow batches; psi is the trees' sample size."""
    table = trees.orderBy("tree", "node").toPandas()  # size fixed by n_trees x nodes, not by the data
    bc = df.sparkSession.sparkContext.broadcast(table)
    denom = _c(int(table["psi"].iloc[0]))
    schema = T.StructType(df.schema.fields + [T.StructField(out, T.DoubleType())])

    def score(batches):
        forest = [_flat_tree(g) for _, g in bc.value.groupby("tree")]
        for pdf in batches:
            x = pdf[features].to_numpy(dtype=float)
            total = np.zeros(len(pdf))
            for start in range(0, len(pdf), SCORED):     # a slice's values stay in the processor's cache
                values = x[start:start + SCORED].ravel(order="F")
                rows = np.arange(len(x[start:start + SCORED]))
                for column, threshold, left, right, path, depth in forest:
                    at, node = column * len(rows), np.zeros(len(rows), dtype=np.int64)
                    for _ in range(depth):
                        node = np.where(values[at[node] + rows] < threshold[node], left[node], right[node])
                    total[start:start + SCORED] += path[node]
            pdf[out] = np.power(2.0, -(total / len(forest)) / denom)
            yield pdf

    return df.mapInPandas(score, schema)


# ------------------------------------------------------------------------ SMOTE
def smote(df: DataFrame, features: list[str], label: str = "anomaly", key: str = "reading_id",
          k: int = 3, seed: int = 42) -> DataFrame:
    """Balance the minority class 1:1 with interpolated synthetic rows.

    k = min(3, max(1, n_pos - 1)); every synthetic row interpolates a
    minority row towards one of its k nearest minority neighbours with a
    hash-seeded gap in [0, 1). Output: original rows plus synthetic ones
    (``synthetic`` = true), columns ``key``, features, label.
    """
    counts = df.groupBy(label).count().collect()  # one row per class
    n = {int(r[label]): int(r["count"]) for r in counts}
    n_pos, n_neg = n.get(1, 0), n.get(0, 0)
    base = df.select(key, *features, F.col(label).cast("int").alias(label), F.lit(False).alias("synthetic"))
    if n_neg <= n_pos:
        return base
    if n_pos < 2:
        raise ValueError("SMOTE needs at least two minority rows to place a new one between them")
    k = min(k, max(1, n_pos - 1))
    minority = sequence_index(df.filter(F.col(label) == 1).select(key, *features).withColumn("_one", F.lit(1)),
                              key="_one", order=key, tiebreak=key).select(F.col(SEQ).alias("pid"), key, *features)
    minority = minority.checkpoint()
    nbrs, _ = nearest(minority.select("pid", *features), features, k, "pid", seed)
    n_syn = n_neg - n_pos
    per, extra = divmod(n_syn, n_pos)
    gen = (minority.withColumn("_cnt", F.lit(per) + F.when(F.col("pid") < extra, 1).otherwise(0))
                   .filter(F.col("_cnt") > 0)
                   .withColumn("j", F.explode(F.sequence(F.lit(0), F.col("_cnt") - 1)))
                   .withColumn("rank", (F.pmod(F.xxhash64("pid", "j", F.lit(seed)), F.lit(k)) + 1).cast("int"))
                   .withColumn("gap", F.pmod(F.xxhash64("pid", "j", F.lit(seed), F.lit(1)), F.lit(1 << 30))
                               / float(1 << 30)))
    nb_feats = minority.select(F.col("pid").alias("nb"), *[F.col(f).alias(f"n_{f}") for f in features])
    syn = (gen.join(nbrs.select("pid", "rank", "nb"), ["pid", "rank"]).join(nb_feats, "nb")
              .select((-F.shiftrightunsigned(F.xxhash64("pid", "j"), 1) - 1).alias(key),
                      *[(F.col(f) + F.col("gap") * (F.col(f"n_{f}") - F.col(f))).alias(f) for f in features],
                      F.lit(1).alias(label), F.lit(True).alias("synthetic")))
    return base.unionByName(syn)


# ------------------------------------------------------------ one-class detector
def _least_norm(atoms: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Weights of the convex combination of ``atoms`` with the smallest norm (projected gradient on a small simplex)."""
    gram = atoms @ atoms.T
    step = 1.0 / max(float(np.linalg.eigvalsh(gram)[-1]), 1e-300)
    lam, ahead, t = start, start, 1.0
    for _ in range(2000):
        raw = ahead - step * (gram @ ahead)
        down = np.sort(raw)[::-1]
        over = (np.cumsum(down) - 1) / np.arange(1, len(down) + 1)
        new = np.maximum(0.0, raw - over[np.flatnonzero(down > over)[-1]])
        grown = (1 + math.sqrt(1 + 4 * t * t)) / 2
        ahead, moved = new + (t - 1) / grown * (new - lam), float(np.abs(new - lam).max())
        lam, t = new, grown
        if moved < 1e-12:
            break
    return lam


class KernelMap:
    """Nystroem features of the RBF kernel: z(x) = K(x, landmarks) K(landmarks, landmarks)^(-1/2)."""

    STEP = 256      # rows whose kernel values are held at a time

    def __init__(self, landmarks: np.ndarray, gamma: float):
        self.landmarks, self.gamma = landmarks, gamma
        values, vectors = np.linalg.eigh(self.kernel(landmarks))
        keep = values > 1e-10 * values[-1]
        self.root = vectors[:, keep] / np.sqrt(values[keep])

    def kernel(self, x: np.ndarray) -> np.ndarray:
        out = x @ (2 * self.landmarks.T)        # in place from here on
        out -= (self.landmarks * self.landmarks).sum(axis=1)
        out -= (x * x).sum(axis=1)[:, None]
        np.minimum(out, 0.0, out=out)
        out *= self.gamma
        return np.exp(out, out=out)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return self.kernel(x) @ self.root

    def slices(self, x: np.ndarray) -> Iterator[tuple[slice, np.ndarray]]:
        """Kernel values of some rows at a time. Scores K (root w) and sums root' (K' weights) come from them
        without the features themselves, which cost landmarks x width a row."""
        for start in range(0, len(x), self.STEP):
            yield slice(start, start + self.STEP), self.kernel(x[start:start + self.STEP])

    def scores(self, x: np.ndarray, w: np.ndarray) -> np.ndarray:
        """z(x) . w of every row."""
        out, folded = np.empty(len(x)), self.root @ w
        for part, k in self.slices(x):
            out[part] = k @ folded
        return out


def fit_one_class(normal: DataFrame, features: list[str], nu: float, **options) -> dict:
    """M9 for one nu: see ``fit_one_classes``."""
    return fit_one_classes(normal, features, [nu], **options)[0]


def fit_one_classes(normal: DataFrame, features: list[str], nus: Sequence[float], n_components: int = 512,
                    seed: int = 42, iterations: int = 40, bins: int = 1024, tolerance: float = 1e-4) -> list[dict]:
    """M9: one-class SVM with RBF kernel on Nystroem features, gamma = 1 / (p * var) as sklearn's 'scale'; a model per nu.

    Landmarks are ``n_components`` rows by hash. The dual's feasible set is the
    hull of the means of nu n rows; given weights, the mean of the nu n lowest
    scores is the vertex that improves most. One iteration finds it in one
    pass, which all nu share (counts and sums of the kernel values by score bin:
    a bin's are one row) and then takes the point
    of least norm in the hull of all vertices so far, until the gap between
    primal and dual is below ``tolerance`` of the dual. The offset is the exact quantile
    of the training scores, so about nu of them lie outside.
    """
    p = len(features)
    # sklearn's gamma='scale' uses the variance of all values; with per-column
    # moments that is mean(var_j) + var(mean_j).
    stats = normal.select(*features).agg(*[F.var_pop(f).alias(f"v_{f}") for f in features],
                                         *[F.avg(f).alias(f"m_{f}") for f in features],
                                         F.count(F.lit(1)).alias("_n")).first()
    means = np.array([stats[f"m_{f}"] or 0.0 for f in features])
    total_var = float(np.mean([stats[f"v_{f}"] or 0.0 for f in features]) + means.var())
    gamma = 1.0 / (p * total_var) if total_var > 0 else 1.0
    n = int(stats["_n"])
    # every pass reads these rows: all cores get an even share
    data = materialize(normal.select(*[F.col(f).cast("double").alias(f) for f in features])
                       .repartition(2 * normal.sparkSession.sparkContext.defaultParallelism), "one-class")
    picked = data.orderBy(F.xxhash64(*features, F.lit(seed)), *features).limit(n_components).collect()
    kernel = KernelMap(np.unique(np.array([list(r) for r in picked], dtype=float), axis=0), gamma)
    landmarks = len(kernel.landmarks)

    def place(score: np.ndarray, reach: float) -> np.ndarray:
        return np.clip(((score / reach + 1) / 2 * bins).astype(int), 0, bins - 1)

    def binned(weights: dict[int, np.ndarray]) -> dict[int, tuple[np.ndarray, np.ndarray]]:
        """By fit: number of rows and sums of their kernel values by score bin, from one pass."""
        folded = {i: (kernel.root @ w, float(np.linalg.norm(w)) + 1e-12) for i, w in weights.items()}     # |z| is at most 1

        def run(batches):
            counts = {i: np.zeros(bins, dtype=np.int64) for i in folded}
            sums = {i: np.zeros((bins, landmarks)) for i in folded}
            for pdf in batches:
                for _, k in kernel.slices(pdf.to_numpy(float)):
                    for i, (w, reach) in folded.items():
                        at = place(k @ w, reach)
                        order = np.argsort(at, kind="stable")
                        found, first = np.unique(at[order], return_index=True)
                        sums[i][found] += np.add.reduceat(k[order], first, axis=0)
                        counts[i] += np.bincount(at, minlength=bins)
            for i in folded:
                used = np.flatnonzero(counts[i])
                yield pd.DataFrame({"fit": i, "bin": used, "cnt": counts[i][used], "sums": [x.tobytes() for x in sums[i][used]]})

        def add(batches):
            total: dict[tuple[int, int], list] = {}
            for pdf in batches:
                for i, at, cnt, part in zip(pdf["fit"], pdf["bin"], pdf["cnt"], pdf["sums"], strict=True):
                    have = total.setdefault((i, at), [0, np.zeros(landmarks)])
                    have[0] += cnt
                    have[1] += np.frombuffer(part)
            yield pd.DataFrame([(*key, cnt, x.tobytes()) for key, (cnt, x) in total.items()], columns=["fit", "bin", "cnt", "sums"])

        schema = "fit int, bin int, cnt long, sums binary"
        out = {i: (np.zeros(bins, dtype=np.int64), np.zeros((bins, landmarks))) for i in folded}
        for r in data.mapInPandas(run, schema).repartition("fit", "bin").mapInPandas(add, schema).collect():    # a row per fit and bin
            out[r.fit][0][r.bin], out[r.fit][1][r.bin] = r.cnt, np.frombuffer(r.sums)
        return out

    def vertex(nu: float, found: np.ndarray, sums: np.ndarray) -> np.ndarray:
        upto = np.cumsum(found)
        cut = int(np.searchsorted(upto, nu * n))
        part = (nu * n - (upto[cut] - found[cut])) / found[cut]
        return (sums[:cut].sum(axis=0) + float(part) * sums[cut]) @ kernel.root / (nu * n)

    centre = binned({0: np.zeros(kernel.root.shape[1])})[0][1].sum(axis=0) @ kernel.root / n      # the mean of all rows: the solution for nu = 1
    hulls = {i: (centre[None, :], np.ones(1), centre) for i in range(len(nus))}       # vertices, their weights, the point
    growing = set(hulls)
    for _ in range(iterations):
        for i, (found, sums) in binned({i: hulls[i][2] for i in growing}).items():
            atoms, lam, w = hulls[i]
            g = vertex(nus[i], found, sums)
            if w @ w - g @ w < tolerance * (w @ w):
                growing.discard(i)
                continue
            atoms = np.concatenate([atoms, g[None, :]])
            lam = _least_norm(atoms, np.append(lam, 0.0))
            used = lam > 1e-9
            hulls[i] = atoms[used], lam[used] / lam[used].sum(), lam @ atoms
        if not growing:
            break
    models = []
    for i, nu in enumerate(nus):
        model = {"kernel": kernel, "w": hulls[i][2], "rho": 0.0, "features": features, "gamma": gamma}
        scores = materialize(score_one_class(data, model).select("ocsvm_score"), "scores")      # quantiles take several passes
        model["rho"] = -exact_quantiles(scores, ["ocsvm_score"], [1 - nu]).first()["value"]
        models.append(model)
    return models


def score_one_class(df: DataFrame, model: dict, out: str = "ocsvm_score") -> DataFrame:
    """M9 scoring: decision value rho - w.z(x); positive = outlier side."""
    shared = df.sparkSession.sparkContext.broadcast((model["kernel"], model["w"], model["rho"]))     # landmarks and weights
    feats = model["features"]
    schema = T.StructType(df.schema.fields + [T.StructField(out, T.DoubleType())])

    def score(batches):
        kernel, w, rho = shared.value
        for pdf in batches:
            pdf[out] = rho - kernel.scores(pdf[feats].to_numpy(float), w)
            yield pdf

    return df.mapInPandas(score, schema)


# ------------------------------------------------------------ alert scoring
class AlertModels:
    """Classifier and isolation forest as the alert layers use them: class probability and a score
    normalised by the training rows' smallest and largest score (M11, T6)."""

    def __init__(self, classifier, label: str, trees: DataFrame, features: list[str], moments: dict, bounds: tuple[float, float]):
        self.classifier, self.label, self.trees = classifier, label, trees
        self.features, self.moments, self.bounds = features, moments, bounds

    def raw(self, df: DataFrame) -> DataFrame:
        """Adds iso_score, on features standardised by the training moments."""
        z = [((F.col(f) - F.lit(self.moments[f][0])) / F.lit(self.moments[f][1] or 1.0)).alias(f"{f}__z") for f in self.features]
        scored = score_isolation_forest(df.select("*", *z).withColumnsRenamed({f: f"{f}__own" for f in self.features})
                                          .withColumnsRenamed({f"{f}__z": f for f in self.features}), self.trees, self.features)
        return scored.drop(*self.features).withColumnsRenamed({f"{f}__own": f for f in self.features})

    def score(self, df: DataFrame, label_value: str = "ACEPTABLE") -> DataFrame:
        """Adds prob_aceptable and anomaly_score to a (batch or streaming) feature table."""
        out = class_probability(self.classifier.transform(df), self.classifier, label_value, self.label, "prob_aceptable")
        out = self.raw(out.select(*df.columns, "prob_aceptable"))
        low, high = self.bounds
        return out.withColumn("anomaly_score", (F.col("iso_score") - F.lit(low)) / (F.lit(high) - F.lit(low) + 1e-9))
