import numpy as np
from pyspark.sql import functions as F

from fixture_paths import SMALL
from riverlens.operators import features as FE
from riverlens.operators import models as ML
from riverlens.operators import splits as P
from riverlens.operators.neighbours import nearest
from riverlens.plans.ordering import SEQ
from riverlens.schema import features_no_leak
from riverlens.sources.adapters import load_readings


def _feats(spark):
    return FE.build_features(load_readings(spark, SMALL)).drop(SEQ, "block").checkpoint()


def test_folds_partition_rows_and_are_deterministic(spark):
    f = _feats(spark)
    a = P.stratified_folds(f, "quality_class").select("reading_id", "fold")
    b = P.stratified_folds(f.repartition(3), "quality_class").select("reading_id", "fold")
    assert a.count() == f.count() and a.select("reading_id").distinct().count() == f.count()
    assert a.exceptAll(b).count() == 0


def test_stratified_split_sizes(spark):
    f = _feats(spark)
    s = P.stratified_split(f, "quality_class")
    for r in s.groupBy("quality_class").agg(F.count_if(F.col("split") == "train").alias("t"),
                                           F.count(F.lit(1)).alias("n")).collect():
        assert r.t == int(np.ceil(0.8 * r.n))


def test_knn_exact_and_smote_balanced(spark):
    f = _feats(spark)
    feats = features_no_leak()[:6]
    pts = f.filter("anomaly = 1").select(F.col("reading_id").alias("pid"), *feats)
    nb = nearest(pts, feats, 3, "pid")[0].toPandas()
    pdf = pts.toPandas()
    X = pdf[feats].to_numpy(float)
    D = np.sqrt(((X[:, None] - X[None]) ** 2).sum(-1))
    np.fill_diagonal(D, np.inf)
    for i, pid in enumerate(pdf.pid):
        assert np.allclose(sorted(D[i])[:3], sorted(nb[nb.pid == pid].dist))
    sm = ML.smote(f, feats, "anomaly", "reading_id", k=3)
    counts = {r.anomaly: r["count"] for r in sm.groupBy("anomaly").count().collect()}
    assert counts[0] == counts[1]


def test_isolation_forest_scores(spark):
    f = _feats(spark)
    feats = features_no_leak()[:8]
    trees = ML.fit_isolation_forest(f, feats, n_trees=10, sample_size=64)
    s = ML.score_isolation_forest(f, trees, feats)
    lo, hi = s.agg(F.min("iso_score"), F.max("iso_score")).first()
    assert 0 < lo <= hi <= 1


def test_forest_rows_are_dealt_over_all_cores(spark):
    """Rows of one partition are dealt evenly over parts of bounded size; a small table stays as it is."""
    cores = spark.sparkContext.defaultParallelism
    parts = ML.dealt(spark.range(0, 100_000, 1, 1)).rdd.glom().map(len).collect()
    assert len(parts) >= 3 * cores and sum(parts) == 100_000 and max(parts) < 2 * 100_000 / len(parts)
    assert ML.dealt(spark.range(0, 100, 1, 1)).rdd.getNumPartitions() == 1


def test_noise_moments_need_one_row_per_draw(spark, monkeypatch):
    from riverlens.plans import queries_models as Q
    monkeypatch.setattr(Q, "feature_frame", lambda spark, sf_dir: spark.range(50).withColumnRenamed("id", "reading_id"))
    out = Q.split_noise(spark, "")
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.split("Aggregate", 1)[1].count("Generate") == 1     # one row per draw is summed, not one per draw and sigma
    rows = out.collect()
    assert len(rows) == len(Q.CLASS_SIGMAS) and {r.n for r in rows} == {50 * 26}
    monkeypatch.setattr(Q, "feature_frame", lambda spark, sf_dir: spark.range(0).withColumnRenamed("id", "reading_id"))
    assert Q.split_noise(spark, "").count() == 0


def test_noisy_rows_are_drawn_and_written_once(spark):
    """Every level holds the rows of ``with_noise``; models read them without drawing again, also where keys are null or come twice."""
    from riverlens.plans import queries_models as Q
    columns = [*features_no_leak()[:3], "turbidity"]
    rows = spark.createDataFrame([(1, 0.5, None, -1.0, 2.0), (2, 1.5, 0.0, 3.0, 4.0), (2, 1.5, 0.0, 3.0, 4.0), (None, 2.5, 1.0, 0.0, 6.0)],
                                 "reading_id long, " + ", ".join(f"{c} double" for c in columns))
    out = P.with_noises(rows, columns[:3], [0.0, 0.01, 0.1])
    for s in (0.0, 0.01, 0.1):
        want = P.with_noise(rows, columns[:3], s).select("reading_id", *columns)
        got = out.filter(F.col("sigma") == s).select("reading_id", *columns)
        assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    assert P.with_noises(rows.limit(0), columns[:3], [0.0, 0.1]).count() == 0 and out.count() == 12
    full = _feats(spark).limit(20)
    noisy = Q._noisy(full, [0.0, 0.05], ["quality_class", *features_no_leak()])
    assert noisy.count() == 40 and "md5" not in noisy._jdf.queryExecution().optimizedPlan().toString()


def test_rows_of_a_forest_part_are_sorted(spark):
    """Like rows follow each other in every part; no row is lost."""
    rows = spark.range(0, 40_000, 1, 1).select((F.col("id") % 3).alias("y"), F.col("id"))
    parts = ML.dealt(rows, "y", "id").rdd.glom().map(lambda p: [tuple(r) for r in p]).collect()
    assert sum(map(len, parts)) == 40_000 and all(p == sorted(p) for p in parts)
    assert ML.dealt(rows.limit(10), "y", "id").collect() == rows.limit(10).collect()
