import numpy as np
from pyspark.sql import functions as F

from fixture_paths import SMALL
from riverlens.operators import metrics as M
from riverlens.sources.adapters import load_predictions


def _brute_auc(y, s):
    pos, neg = s[y == 1], s[y == 0]
    wins = (pos[:, None] > neg[None, :]).sum() + 0.5 * (pos[:, None] == neg[None, :]).sum()
    return wins / (len(pos) * len(neg))


def test_auc_and_ap_against_brute_force(spark):
    p = load_predictions(spark, SMALL)
    auc = {r.model: r.roc_auc for r in M.roc_auc(p, ["model"], "y_bin", "score").collect()}
    ap = {r.model: r.average_precision for r in M.average_precision(p, ["model"], "y_bin", "score").collect()}
    pdf = p.select("model", "y_bin", "score").toPandas()
    for m, g in pdf.groupby("model"):
        y, s = g.y_bin.to_numpy(), g.score.to_numpy()
        assert abs(auc[m] - _brute_auc(y, s)) < 1e-9
        order = np.argsort(-s, kind="stable")
        thresholds = np.unique(s)[::-1]
        prev_r, total = 0.0, 0.0
        for t in thresholds:
            sel = s >= t
            tp = (y[sel] == 1).sum()
            prec, rec = tp / sel.sum(), tp / (y == 1).sum()
            total += (rec - prev_r) * prec
            prev_r = rec
        assert abs(ap[m] - total) < 1e-9


def test_confusion_matrix_sums_to_rows(spark):
    p = load_predictions(spark, SMALL).select("model", F.col("y_class").alias("y"), F.col("pred_class").alias("pred"))
    cm = M.confusion_matrix(p, ["model"])
    assert cm.groupBy("model").agg(F.sum("n")).collect()[0][1] == 1000
    assert cm.groupBy("model").count().collect()[0][1] == 9  # 3 x 3 grid with zeros


def test_regression_metrics(spark):
    p = load_predictions(spark, SMALL)
    r = {x.model: x for x in M.regression_metrics(p, ["model"], "y_reg", "p_reg").collect()}
    pdf = p.filter("model = 'm1'").select("y_reg", "p_reg").toPandas()
    err = pdf.y_reg - pdf.p_reg
    assert abs(r["m1"].rmse - np.sqrt((err ** 2).mean())) < 1e-9
    assert abs(r["m1"].r2 - (1 - (err ** 2).sum() / ((pdf.y_reg - pdf.y_reg.mean()) ** 2).sum())) < 1e-9
