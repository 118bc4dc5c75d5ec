"""Evaluation metrics E1-E15 as grouped aggregates over prediction tables.

Every metric takes a long prediction table and a list of grouping columns
(e.g. ``["model"]`` or ``["model", "fold"]``), so many models and folds are
scored by one job.  Curve metrics (PR, AP, AUC) first collapse rows to one
row per distinct score and rank those with a range-partitioned prefix sum,
so no window ever spans a whole model in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.ordering import weighted_prefix


def _div(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def confusion_matrix(preds: DataFrame, by: list[str], y: str = "y", pred: str = "pred") -> DataFrame:
    """(by..., y, pred, n, row_pct) over the full label grid (zeros kept)."""
    counts = preds.groupBy(*by, y, pred).agg(F.count(F.lit(1)).alias("n"))
    labels = (counts.select(*by, F.col(y).alias("label"))
                    .unionByName(counts.select(*by, F.col(pred).alias("label"))).distinct())
    grid = labels.withColumnRenamed("label", y).join(labels.withColumnRenamed("label", pred), by)
    full = grid.join(counts, [*by, y, pred], "left").fillna(0, subset=["n"])
    row_tot = full.groupBy(*by, y).agg(F.sum("n").alias("_row"))
    return (full.join(row_tot, [*by, y])
                .select(*by, y, pred, F.col("n").cast("long").alias("n"),
                        F.round(_div(F.col("n") * 100.0, F.col("_row")), 6).alias("row_pct")))


def binary_counts(preds: DataFrame, by: list[str], y: str = "y", pred: str = "pred") -> DataFrame:
    """TP, FP, FN, TN."""
    yy, pp = F.col(y) == 1, F.col(pred) == 1
    return preds.groupBy(*by).agg(F.count_if(yy & pp).alias("tp"), F.count_if(~yy & pp).alias("fp"),
                                  F.count_if(yy & ~pp).alias("fn"), F.count_if(~yy & ~pp).alias("tn"))


def per_class(preds: DataFrame, by: list[str], y: str = "y", pred: str = "pred") -> DataFrame:
    """Precision, recall, F1 and support per class (0 where undefined)."""
    cm = confusion_matrix(preds, by, y, pred)
    tp = cm.filter(F.col(y) == F.col(pred)).select(*by, F.col(y).alias("label"), F.col("n").alias("tp"))
    sup = cm.groupBy(*by, F.col(y).alias("label")).agg(F.sum("n").alias("support"))
    npred = cm.groupBy(*by, F.col(pred).alias("label")).agg(F.sum("n").alias("n_pred"))
    t = tp.join(sup, [*by, "label"]).join(npred, [*by, "label"])
    prec = _div(F.col("tp").cast("double"), F.col("n_pred"))
    rec = _div(F.col("tp").cast("double"), F.col("support"))
    return t.select(*by, "label", prec.alias("precision"), rec.alias("recall"),
                    _div(2 * prec * rec, prec + rec).alias("f1"), F.col("support").cast("long").alias("support"))


def classification_summary(preds: DataFrame, by: list[str], y: str = "y", pred: str = "pred") -> DataFrame:
    """Accuracy, F1-macro (labels in y or pred), F1-weighted (by support)."""
    pc = per_class(preds, by, y, pred)
    f1 = pc.groupBy(*by).agg(F.avg("f1").alias("f1_macro"),
                             _div(F.sum(F.col("f1") * F.col("support")), F.sum("support")).alias("f1_weighted"))
    acc = preds.groupBy(*by).agg(F.avg((F.col(y) == F.col(pred)).cast("double")).alias("accuracy"),
                                 F.count(F.lit(1)).alias("n"))
    return acc.join(f1, by)


def _score_table(preds: DataFrame, by: list[str], y: str, score: str) -> DataFrame:
    """One row per (by..., distinct score) with positive and negative counts."""
    return preds.groupBy(*by, score).agg(F.count_if(F.col(y) == 1).alias("pos"),
                                         F.count_if(F.col(y) != 1).alias("neg"))


def pr_curve(preds: DataFrame, by: list[str], y: str = "y", score: str = "score") -> DataFrame:
    """E5: precision and recall at every distinct score (predict positive when score >= threshold)."""
    st = (_score_table(preds, by, y, score).withColumn("_w", F.col("pos") + F.col("neg"))
          .withColumn("_neg_score", -F.col(score)))
    c = weighted_prefix(st, by, "_neg_score", ["pos", "_w"])
    totals = st.groupBy(*by).agg(F.sum("pos").alias("n_pos"))
    c = c.join(totals, by)
    tp = F.col("cum_before_pos") + F.col("pos")
    predicted = F.col("cum_before__w") + F.col("_w")
    return c.select(*by, F.col(score).alias("threshold"), "pos", tp.alias("tp"), (predicted - tp).alias("fp"),
                    _div(tp.cast("double"), predicted).alias("precision"),
                    F.when(F.col("n_pos") > 0, tp / F.col("n_pos")).otherwise(F.lit(1.0)).alias("recall"))


def average_precision(preds: DataFrame, by: list[str], y: str = "y", score: str = "score") -> DataFrame:
    """Step-rule AP = sum over thresholds (descending) of (R_n - R_{n-1}) * P_n."""
    # Recall rises by pos/n_pos at each threshold, so (R_n - R_{n-1}) = pos_n / n_pos.
    curve = pr_curve(preds, by, y, score)
    return curve.groupBy(*by).agg(_div(F.sum(F.col("pos") * F.col("precision")), F.sum("pos"))
                                  .alias("average_precision"))


def best_f1_threshold(preds: DataFrame, by: list[str], y: str = "y", score: str = "score") -> DataFrame:
    """The threshold maximising F1 = 2PR/(P+R+1e-9) on the PR curve (first maximum).

    The curve's closing (precision 1, recall 0) point is never a candidate,
    and ties go to the lowest threshold, i.e. the first in ascending order.
    """
    c = pr_curve(preds, by, y, score).withColumn(
        "f1", 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall") + 1e-9))
    best = c.groupBy(*by).agg(F.max_by(F.struct("threshold", "f1"),
                                       F.struct(F.col("f1"), -F.col("threshold"))).alias("b"))
    return best.select(*by, F.col("b.threshold").alias("threshold"), F.col("b.f1").alias("f1"))


def roc_auc(preds: DataFrame, by: list[str], y: str = "y", score: str = "score") -> DataFrame:
    """Binary ROC-AUC by the rank-sum rule with average ranks for ties."""
    st = _score_table(preds, by, y, score).withColumn("_w", F.col("pos") + F.col("neg"))
    ranked = weighted_prefix(st, by, score, "_w")
    avg_rank = F.col("cum_before") + (F.col("_w") + 1) / 2.0
    agg = ranked.groupBy(*by).agg(F.sum(F.col("pos") * avg_rank).alias("_rsum"),
                                  F.sum("pos").alias("_p"), F.sum("neg").alias("_n"))
    p, n = F.col("_p").cast("double"), F.col("_n").cast("double")   # the products overflow a long
    auc = F.try_divide(F.col("_rsum") - p * (p + 1) / 2.0, p * n)
    return agg.select(*by, auc.alias("roc_auc"))


def roc_auc_ovr(scores: DataFrame, by: list[str], label: str = "label", is_class: str = "is_class",
                score: str = "score") -> DataFrame:
    """One-vs-rest macro AUC from a long table (by..., label, is_class, score)."""
    per = roc_auc(scores, [*by, label], is_class, score)
    return per.groupBy(*by).agg(F.avg("roc_auc").alias("roc_auc_ovr"))


def regression_metrics(preds: DataFrame, by: list[str], y: str = "y", p: str = "p",
                       critical_below: float = 85.0) -> DataFrame:
    """RMSE, MAE, R², MAPE % (+1e-9) and critical-zone RMSE (y < 85) in one aggregate."""
    err = F.col(y) - F.col(p)
    return preds.groupBy(*by).agg(
        F.sqrt(F.avg(err * err)).alias("rmse"), F.avg(F.abs(err)).alias("mae"),
        (1 - F.sum(err * err) / (F.count(F.lit(1)) * F.var_pop(y))).alias("r2"),
        (F.avg(F.abs(err / (F.col(y) + 1e-9))) * 100).alias("mape"),
        F.sqrt(F.avg(F.when(F.col(y) < critical_below, err * err))).alias("rmse_critical"))


def cv_summary(fold_metrics: DataFrame, by: list[str], fold: str = "fold", value: str = "test",
               train: str | None = "train", folds: list | None = None) -> DataFrame:
    """Mean and population std over folds, train mean and gap, one column per fold."""
    aggs = [F.avg(value).alias("cv_mean"), F.stddev_pop(value).alias("cv_std")]
    if train:
        aggs += [F.avg(train).alias("train_mean"), (F.avg(train) - F.avg(value)).alias("gap")]
    s = fold_metrics.groupBy(*by).agg(*aggs)
    wide = fold_metrics.groupBy(*by).pivot(fold, folds).agg(F.first(value))
    wide = wide.select(*by, *[F.col(f"`{c}`").alias(f"{fold}_{c}") for c in wide.columns if c not in by])
    return s.join(wide, by).withColumn("consistent", F.col("cv_std") < 0.10)


def noise_table(noise_metrics: DataFrame, by: list[str], sigma: str = "sigma", value: str = "f1",
                sigmas: list[float] | None = None, limit: float = 0.15) -> DataFrame:
    """Metric per noise level (pivot), absolute and relative degradation, robust flag."""
    sigmas = sigmas or [0.0, 0.01, 0.02, 0.05, 0.10]
    keyed = noise_metrics.withColumn("_s", F.format_string("s%.2f", F.col(sigma)))
    names = [f"s{s:.2f}" for s in sigmas]
    wide = keyed.groupBy(*by).pivot("_s", names).agg(F.first(value))
    first, last = F.col(f"`{names[0]}`"), F.col(f"`{names[-1]}`")
    return wide.select(*by, *[F.col(f"`{n}`").alias(f"{value}_{n.replace('.', '_')}") for n in names],
                       (first - last).alias("degradation_abs"),
                       F.try_divide(first - last, first).alias("degradation_rel"),
                       ((first - last) < limit).alias("robust"))


def learning_curve(curve_metrics: DataFrame, by: list[str], fraction: str = "fraction",
                   train: str = "train", test: str = "test") -> DataFrame:
    """Per fraction the train/validation mean and population std, and the gap."""
    t = curve_metrics.groupBy(*by, fraction).agg(
        F.avg(train).alias("train_mean"), F.stddev_pop(train).alias("train_std"),
        F.avg(test).alias("val_mean"), F.stddev_pop(test).alias("val_std"))
    return t.withColumn("gap", F.col("train_mean") - F.col("val_mean"))


def verdicts(summary: DataFrame, cv: str = "cv_mean", gap: str = "gap", noise: str | None = None,
             r2: str | None = None, std: str | None = "cv_std", gap_limit: float = 0.40) -> DataFrame:
    """Acceptance rules over a summary row (limits are parameters)."""
    out = summary
    rule = (F.col(cv) > 0.60) & (F.col(gap) < gap_limit)
    if noise:
        rule = rule & (F.col(noise) > 0.50)
        out = out.withColumn("noise_ok", F.col(noise) > 0.55)
    out = out.withColumn("validated", rule).withColumn("gap_ok", F.col(gap) < 0.25)
    if r2:
        out = out.withColumn("r2_ok", F.col(r2) > 0.70)
    if std:
        out = out.withColumn("stable", F.col(std) < 0.10)
    return out
