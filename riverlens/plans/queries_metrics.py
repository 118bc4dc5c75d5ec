"""Registered queries: metrics over the prediction fixture (E*, M14)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import metrics as M
from ..sources.adapters import class_scores, load_predictions
from . import sql as S
from .catalog import register

P = f"({S.PREDICTIONS})"
BY = ["model"]


def _r6(*cols):
    return [F.round(c, 6).alias(c) for c in cols]


def _cls(spark, sf_dir):
    return load_predictions(spark, sf_dir).select("model", "fold", "row_id", F.col("y_class").alias("y"),
                                                  F.col("pred_class").alias("pred"))


@register("metrics_confusion", sql=f"""
WITH p AS (SELECT model, y_class AS y, pred_class AS pred FROM {P} x),
cm AS (SELECT model, y, pred, count(*) AS n FROM p GROUP BY ALL),
lab AS (SELECT DISTINCT model, y AS label FROM cm UNION SELECT DISTINCT model, pred FROM cm),
g AS (SELECT a.model, a.label AS y, b.label AS pred FROM lab a JOIN lab b ON a.model = b.model),
f AS (SELECT g.model, g.y, g.pred, coalesce(cm.n, 0) AS n FROM g LEFT JOIN cm USING (model, y, pred))
SELECT model, y, pred, CAST(n AS BIGINT) AS n,
  round(coalesce(n * 100.0 / nullif(sum(n) OVER (PARTITION BY model, y), 0), 0), 6) AS row_pct FROM f""")
def metrics_confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Confusion matrix with zero cells and row %."""
    return M.confusion_matrix(_cls(spark, sf_dir), BY, "y", "pred")


@register("metrics_binary_counts", sql=f"""
SELECT model, count(*) FILTER (WHERE y_bin = 1 AND score >= 0.5) AS tp, count(*) FILTER (WHERE y_bin <> 1 AND score >= 0.5) AS fp,
  count(*) FILTER (WHERE y_bin = 1 AND NOT score >= 0.5) AS fn, count(*) FILTER (WHERE y_bin <> 1 AND NOT score >= 0.5) AS tn
FROM {P} x GROUP BY model""")
def metrics_binary_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TP/FP/FN/TN at score >= .5."""
    p = load_predictions(spark, sf_dir).withColumn("pred", (F.col("score") >= 0.5).cast("int"))
    return M.binary_counts(p, BY, "y_bin", "pred")


@register("metrics_per_class", sql=f"""
WITH p AS (SELECT model, y_class AS y, pred_class AS pred FROM {P} x), {S.f1_ctes('p', ['model'])}
SELECT model, label, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1,
  CAST(support AS BIGINT) AS support FROM pc""")
def metrics_per_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per-class precision, recall, F1, support."""
    pc = M.per_class(_cls(spark, sf_dir), BY, "y", "pred")
    return pc.select("model", "label", *_r6("precision", "recall", "f1"), "support")


@register("metrics_classification", sql=f"""
WITH p AS (SELECT model, y_class AS y, pred_class AS pred FROM {P} x), {S.f1_ctes('p', ['model'])}
SELECT a.model, round(a.accuracy, 6) AS accuracy, a.n, round(f.f1_macro, 6) AS f1_macro, round(f.f1_weighted, 6) AS f1_weighted
FROM (SELECT model, avg(CAST(y = pred AS DOUBLE)) AS accuracy, count(*) AS n FROM p GROUP BY model) a
JOIN (SELECT model, avg(f1) AS f1_macro, sum(f1 * support) / sum(support) AS f1_weighted FROM pc GROUP BY model) f USING (model)""")
def metrics_classification(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accuracy, F1-macro, F1-weighted."""
    s = M.classification_summary(_cls(spark, sf_dir), BY, "y", "pred")
    return s.select("model", *_r6("accuracy"), "n", *_r6("f1_macro", "f1_weighted"))


_CURVE_SQL = f"""
WITH st AS (SELECT model, score, count(*) FILTER (WHERE y_bin = 1) AS pos, count(*) FILTER (WHERE y_bin <> 1) AS neg
            FROM {P} x GROUP BY model, score),
c AS (SELECT *, sum(pos) OVER (PARTITION BY model ORDER BY score DESC) AS tp,
        sum(pos + neg) OVER (PARTITION BY model ORDER BY score DESC) AS predicted,
        sum(pos) OVER (PARTITION BY model) AS n_pos FROM st),
curve AS (SELECT model, score AS threshold, pos, tp, predicted - tp AS fp,
  CASE WHEN predicted > 0 THEN CAST(tp AS DOUBLE) / predicted ELSE 0 END AS precision,
  CASE WHEN n_pos > 0 THEN CAST(tp AS DOUBLE) / n_pos ELSE 1 END AS recall FROM c)"""


@register("metrics_pr_curve", sql=_CURVE_SQL + """
SELECT model, threshold, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, round(precision, 6) AS precision,
  round(recall, 6) AS recall FROM curve""")
def metrics_pr_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E5: precision-recall curve at every distinct score."""
    c = M.pr_curve(load_predictions(spark, sf_dir), BY, "y_bin", "score")
    return c.select("model", "threshold", F.col("tp").cast("long").alias("tp"), F.col("fp").cast("long").alias("fp"),
                    *_r6("precision", "recall"))


@register("metrics_average_precision", sql=_CURVE_SQL + """
SELECT model, round(coalesce(sum(pos * precision) / nullif(sum(pos), 0), 0), 6) AS average_precision FROM curve GROUP BY model""")
def metrics_average_precision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Step-rule average precision."""
    return M.average_precision(load_predictions(spark, sf_dir), BY, "y_bin", "score").select(
        "model", *_r6("average_precision"))


@register("metrics_best_threshold", sql=_CURVE_SQL + """
, f AS (SELECT *, 2 * precision * recall / (precision + recall + 1e-9) AS f1 FROM curve)
SELECT model, threshold, round(f1, 6) AS f1 FROM (
  SELECT *, row_number() OVER (PARTITION BY model ORDER BY f1 DESC, threshold ASC) AS rn FROM f) t WHERE rn = 1""")
def metrics_best_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Threshold that maximises F1 on the PR curve."""
    b = M.best_f1_threshold(load_predictions(spark, sf_dir), BY, "y_bin", "score")
    return b.select("model", "threshold", *_r6("f1"))


def _auc_sql(src: str, g: list[str], y: str) -> str:
    gs = ", ".join(g)
    return f"""
WITH rk AS (SELECT {gs}, {y} AS y, (rank() OVER (PARTITION BY {gs} ORDER BY score) + rank() OVER (PARTITION BY {gs} ORDER BY score)
            + count(*) OVER (PARTITION BY {gs}, score) - 1) / 2.0 AS rnk FROM {src} x)
SELECT {gs}, (sum(rnk) FILTER (WHERE y = 1) - count(*) FILTER (WHERE y = 1) * (count(*) FILTER (WHERE y = 1) + 1) / 2.0)
  / (count(*) FILTER (WHERE y = 1) * count(*) FILTER (WHERE y <> 1)) AS roc_auc FROM rk GROUP BY {gs}"""


@register("metrics_roc_auc", sql=f"SELECT model, round(roc_auc, 6) AS roc_auc FROM ({_auc_sql(P, ['model'], 'y_bin')}) a")
def metrics_roc_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Binary ROC-AUC with tie-averaged ranks."""
    return M.roc_auc(load_predictions(spark, sf_dir), BY, "y_bin", "score").select("model", *_r6("roc_auc"))


_CLASS_SCORES_SQL = f"""(SELECT model, row_id, label, CAST(y_class = label AS INT) AS is_class,
  CASE label WHEN 'EXCELENTE' THEN least(1.0, greatest(0.0, (shifted - 70) / 30))
             WHEN 'BUENA' THEN least(1.0, greatest(0.0, 1 - abs(shifted - 85) / 15))
             ELSE least(1.0, greatest(0.0, (90 - shifted) / 30)) END AS score
 FROM {P} p, (VALUES ('EXCELENTE'), ('BUENA'), ('ACEPTABLE')) l(label))"""


@register("metrics_roc_auc_ovr", sql=f"""
SELECT model, round(avg(roc_auc), 6) AS roc_auc_ovr FROM ({_auc_sql(_CLASS_SCORES_SQL, ['model', 'label'], 'is_class')}) a GROUP BY model""")
def metrics_roc_auc_ovr(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One-vs-rest macro ROC-AUC over the three classes."""
    cs = class_scores(load_predictions(spark, sf_dir))
    return M.roc_auc_ovr(cs, BY, "label", "is_class", "score").select("model", *_r6("roc_auc_ovr"))


@register("metrics_regression", sql=f"""
SELECT model, round(sqrt(avg(power(y_reg - p_reg, 2))), 6) AS rmse, round(avg(abs(y_reg - p_reg)), 6) AS mae,
  round(1 - sum(power(y_reg - p_reg, 2)) / (count(*) * var_pop(y_reg)), 6) AS r2,
  round(avg(abs((y_reg - p_reg) / (y_reg + 1e-9))) * 100, 6) AS mape,
  round(sqrt(avg(power(y_reg - p_reg, 2)) FILTER (WHERE y_reg < 85)), 6) AS rmse_critical
FROM {P} x GROUP BY model""")
def metrics_regression(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RMSE, MAE, R², MAPE, critical-zone RMSE."""
    r = M.regression_metrics(load_predictions(spark, sf_dir), BY, "y_reg", "p_reg")
    return r.select("model", *_r6("rmse", "mae", "r2", "mape", "rmse_critical"))


def fold_metrics(preds: DataFrame, k: int = 5) -> DataFrame:
    """Per (model, fold): F1-macro on the held-out fold and on the other folds."""
    roles = F.explode(F.array(*[F.struct(F.lit(i).alias("cv_fold"),
                                         F.when(F.col("fold") == i, "test").otherwise("train").alias("role"))
                                for i in range(k)])).alias("x")
    ex = preds.select("model", "y", "pred", "fold", roles).select("model", "y", "pred", "x.cv_fold", "x.role")
    s = M.classification_summary(ex, ["model", "cv_fold", "role"], "y", "pred")
    return s.groupBy("model", "cv_fold").pivot("role", ["test", "train"]).agg(F.first("f1_macro"))


@register("metrics_cv_summary", sql=f"""
WITH p AS (SELECT model, k AS cv_fold, CASE WHEN x.fold = k THEN 'test' ELSE 'train' END AS role,
  y_class AS y, pred_class AS pred FROM {P} x, range(5) t(k)),
{S.f1_ctes('p', ['model', 'cv_fold', 'role'])},
fm AS (SELECT model, cv_fold, avg(f1) FILTER (WHERE role = 'test') AS test, avg(f1) FILTER (WHERE role = 'train') AS train
  FROM pc GROUP BY model, cv_fold)
SELECT model, round(avg(test), 6) AS cv_mean, round(stddev_pop(test), 6) AS cv_std, round(avg(train), 6) AS train_mean,
  round(avg(train) - avg(test), 6) AS gap, {', '.join(f'round(max(test) FILTER (WHERE cv_fold = {i}), 6) AS cv_fold_{i}' for i in range(5))},
  stddev_pop(test) < 0.10 AS consistent FROM fm GROUP BY model""")
def metrics_cv_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """5-fold F1-macro mean, population std, train mean, gap and per-fold columns."""
    fm = fold_metrics(_cls(spark, sf_dir))
    s = M.cv_summary(fm, BY, "cv_fold", "test", "train", list(range(5)))
    return s.select("model", *_r6("cv_mean", "cv_std", "train_mean", "gap"),
                    *[F.round(f"cv_fold_{i}", 6).alias(f"cv_fold_{i}") for i in range(5)], "consistent")


# Noise levels and training fractions of the studies.
SIGMAS = [0.0, 0.01, 0.02, 0.05, 0.10]
FRACTIONS = [0.25, 0.5, 1.0]
_FM_SQL = f"""p AS (SELECT model, k AS cv_fold, CASE WHEN x.fold = k THEN 'test' ELSE 'train' END AS role,
  y_class AS y, pred_class AS pred FROM {P} x, range(5) t(k)),
{S.f1_ctes('p', ['model', 'cv_fold', 'role'])},
fm AS (SELECT model, cv_fold, avg(f1) FILTER (WHERE role = 'test') AS test, avg(f1) FILTER (WHERE role = 'train') AS train
  FROM pc GROUP BY model, cv_fold)"""


@register("metrics_time_summary", sql=f"""
WITH p AS (SELECT model, fold AS time_fold, y_class AS y, pred_class AS pred FROM {P} x), {S.f1_ctes('p', ['model', 'time_fold'])},
fm AS (SELECT model, time_fold, avg(f1) AS test FROM pc GROUP BY model, time_fold)
SELECT model, round(avg(test), 6) AS cv_mean, round(stddev_pop(test), 6) AS cv_std,
  {', '.join(f'round(max(test) FILTER (WHERE time_fold = {i}), 6) AS time_fold_{i}' for i in range(5))},
  stddev_pop(test) < 0.10 AS consistent FROM fm GROUP BY model""")
def metrics_time_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean, population std and consistency over the folds of the prediction fixture."""
    folds = _cls(spark, sf_dir).withColumnRenamed("fold", "time_fold")
    s = M.classification_summary(folds, ["model", "time_fold"], "y", "pred").withColumnRenamed("f1_macro", "test")
    out = M.cv_summary(s, BY, "time_fold", "test", None, list(range(5)))
    return out.select("model", *_r6("cv_mean", "cv_std", *[f"time_fold_{i}" for i in range(5)]), "consistent")


def _worse(sigma: Column) -> Column:
    """Stands for a prediction under noise: more rows lose their class as sigma grows."""
    return F.when(F.col("row_id") % 100 < sigma * 500, F.lit("BUENA")).otherwise(F.col("pred"))


@register("metrics_noise_table", sql=f"""
WITH p AS (SELECT model, s AS sigma, y_class AS y, CASE WHEN row_id % 100 < s * 500 THEN 'BUENA' ELSE pred_class END AS pred
  FROM {P} x, (VALUES {', '.join(f"(CAST({s} AS DOUBLE))" for s in SIGMAS)}) v(s)), {S.f1_ctes('p', ['model', 'sigma'])},
f AS (SELECT model, sigma, avg(f1) AS f1 FROM pc GROUP BY model, sigma),
w AS (SELECT model, {', '.join(f"max(f1) FILTER (WHERE sigma = {s}) AS f1_s{f'{s:.2f}'.replace('.', '_')}" for s in SIGMAS)} FROM f GROUP BY model)
SELECT model, {', '.join(f"round(f1_s{f'{s:.2f}'.replace('.', '_')}, 6) AS f1_s{f'{s:.2f}'.replace('.', '_')}" for s in SIGMAS)},
  round(f1_s0_00 - f1_s0_10, 6) AS degradation_abs, round((f1_s0_00 - f1_s0_10) / nullif(f1_s0_00, 0), 6) AS degradation_rel,
  f1_s0_00 - f1_s0_10 < 0.15 AS robust FROM w""")
def metrics_noise_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F1 by noise level, degradation and robustness, over the prediction fixture made worse step by step."""
    sigmas = F.explode(F.array(*[F.lit(s) for s in SIGMAS])).alias("sigma")
    noisy = _cls(spark, sf_dir).select("*", sigmas).withColumn("pred", _worse(F.col("sigma")))
    s = M.classification_summary(noisy, ["model", "sigma"], "y", "pred").withColumnRenamed("f1_macro", "f1")
    out = M.noise_table(s, BY, "sigma", "f1", SIGMAS)
    return out.select("model", *_r6(*[c for c in out.columns if c not in ("model", "robust")]), "robust")


@register("metrics_learning_curve", sql=f"""
WITH p AS (SELECT model, fr AS fraction, k AS cv_fold, CASE WHEN x.fold = k THEN 'test' ELSE 'train' END AS role, y_class AS y, pred_class AS pred
  FROM {P} x, range(5) t(k), (VALUES {', '.join(f"(CAST({f} AS DOUBLE))" for f in FRACTIONS)}) v(fr)
  WHERE x.fold = k OR row_id % 100 < fr * 100), {S.f1_ctes('p', ['model', 'fraction', 'cv_fold', 'role'])},
fm AS (SELECT model, fraction, cv_fold, avg(f1) FILTER (WHERE role = 'test') AS test, avg(f1) FILTER (WHERE role = 'train') AS train
  FROM pc GROUP BY model, fraction, cv_fold)
SELECT model, fraction, round(avg(train), 6) AS train_mean, round(stddev_pop(train), 6) AS train_std, round(avg(test), 6) AS val_mean,
  round(stddev_pop(test), 6) AS val_std, round(avg(train) - avg(test), 6) AS gap FROM fm GROUP BY model, fraction""")
def metrics_learning_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Train and validation mean and std per fraction, over growing parts of the prediction fixture."""
    grid = F.explode(F.array(*[F.struct(F.lit(f).alias("fraction"), F.lit(k).alias("cv_fold")) for f in FRACTIONS for k in range(5)])).alias("g")
    rows = _cls(spark, sf_dir).select("*", grid).select("model", "row_id", "fold", "y", "pred", "g.*")
    rows = rows.filter((F.col("fold") == F.col("cv_fold")) | (F.col("row_id") % 100 < F.col("fraction") * 100))
    rows = rows.withColumn("role", F.when(F.col("fold") == F.col("cv_fold"), "test").otherwise("train"))
    s = M.classification_summary(rows, ["model", "fraction", "cv_fold", "role"], "y", "pred")
    wide = s.groupBy("model", "fraction", "cv_fold").pivot("role", ["test", "train"]).agg(F.first("f1_macro"))
    return M.learning_curve(wide, BY, "fraction", "train", "test").select("model", "fraction", *_r6("train_mean", "train_std", "val_mean", "val_std", "gap"))


@register("metrics_verdicts", sql=f"""
WITH {_FM_SQL},
cv AS (SELECT model, avg(test) AS cv_mean, stddev_pop(test) AS cv_std, avg(train) - avg(test) AS gap FROM fm GROUP BY model),
nf AS (SELECT model, avg(f1) AS noise_f1 FROM (
  WITH q AS (SELECT model, y_class AS y, CASE WHEN row_id % 100 < 25 THEN 'BUENA' ELSE pred_class END AS pred FROM {P} x), {S.f1_ctes('q', ['model'])}
  SELECT model, f1 FROM pc) z GROUP BY model),
rg AS (SELECT model, 1 - sum(power(y_reg - p_reg, 2)) / (count(*) * var_pop(y_reg)) AS r2 FROM {P} x GROUP BY model)
SELECT model, round(cv_mean, 6) AS cv_mean, round(cv_std, 6) AS cv_std, round(gap, 6) AS gap, round(noise_f1, 6) AS noise_f1, round(r2, 6) AS r2,
  cv_mean > 0.60 AND gap < 0.40 AND noise_f1 > 0.50 AS validated, gap < 0.25 AS gap_ok, noise_f1 > 0.55 AS noise_ok, r2 > 0.70 AS r2_ok, cv_std < 0.10 AS stable
FROM cv JOIN nf USING (model) JOIN rg USING (model)""")
def metrics_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every verdict over one summary row per model of the prediction fixture."""
    preds = _cls(spark, sf_dir)
    cv = M.cv_summary(fold_metrics(preds), BY, "cv_fold", "test", "train", list(range(5))).select("model", "cv_mean", "cv_std", "gap")
    noisy = preds.withColumn("pred", _worse(F.lit(0.05)))
    noise = M.classification_summary(noisy, BY, "y", "pred").select("model", F.col("f1_macro").alias("noise_f1"))
    r2 = M.regression_metrics(load_predictions(spark, sf_dir), BY, "y_reg", "p_reg").select("model", "r2")
    out = M.verdicts(cv.join(noise, "model").join(r2, "model"), noise="noise_f1", r2="r2")
    return out.select("model", *_r6("cv_mean", "cv_std", "gap", "noise_f1", "r2"), "validated", "gap_ok", "noise_ok", "r2_ok", "stable")


@register("metrics_best_model", sql=f"""
WITH s AS (SELECT model, sqrt(avg(power(y_reg - p_reg, 2))) AS rmse, round(1 - sum(power(y_reg - p_reg, 2)) / (count(*) * var_pop(y_reg)), 0) AS level
  FROM {P} x GROUP BY model)
SELECT model AS best, level FROM s ORDER BY level DESC, CASE model WHEN 'm2' THEN 0 ELSE 1 END, model LIMIT 1""")
def metrics_best_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best model by a rounded R², on which models tie; the first of a given order wins."""
    from ..operators.models import best_model
    r = M.regression_metrics(load_predictions(spark, sf_dir), BY, "y_reg", "p_reg").select("model", F.round("r2", 0).alias("level"))
    return best_model(r, "level", ("m2", "m1"))
