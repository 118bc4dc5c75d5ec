"""The block/halo plan must give the same answers as one window per station."""

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from fixture_paths import MEDIUM, SMALL
from riverlens.operators import alerts as A
from riverlens.operators import features as FE
from riverlens.plans.ordering import SEQ, sequence_index, weighted_prefix
from riverlens.schema import features_full
from riverlens.sources.adapters import load_readings


def test_sequence_index_matches_row_number(spark):
    r = load_readings(spark, SMALL)
    got = sequence_index(r, partitions=7).select("reading_id", SEQ)
    w = Window.partitionBy("station_id").orderBy("ts", "reading_id")
    exp = r.select("reading_id", (F.row_number().over(w) - 1).alias("exp"))
    assert got.join(exp, "reading_id").filter(F.col(SEQ) != F.col("exp")).count() == 0


def test_features_independent_of_block_size(spark):
    r = load_readings(spark, SMALL)
    cols = ["reading_id", *features_full()]
    big = FE.build_features(r).select(*cols).toPandas().sort_values("reading_id").reset_index(drop=True)
    small = FE.build_features(r, block_rows=20).select(*cols).toPandas().sort_values("reading_id").reset_index(drop=True)
    assert len(big) == len(small) == 1000 - 5 * 16
    assert np.allclose(big.to_numpy(float), small.to_numpy(float), atol=1e-9, equal_nan=True)


def test_episodes_independent_of_block_size(spark):
    r = load_readings(spark, SMALL)
    al = A.with_alerts(FE.build_features(r, dropna=False).withColumn("prob_aceptable", F.lit(0.0)))
    cols = ["station_id", "start_ts", "end_ts", "n_readings", "worst_level"]
    a = A.episodes(al.drop("block", SEQ), "level_layer1").select(*cols)
    b = A.episodes(al.drop("block", SEQ), "level_layer1", block_rows=17).select(*cols)
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0
    non_green = al.filter(F.col("level_layer1") != "VERDE").count()
    assert a.agg(F.sum("n_readings")).first()[0] == non_green


def test_weighted_prefix(spark):
    df = spark.createDataFrame([("a", 1.0, 2), ("a", 2.0, 3), ("a", 3.0, 1), ("b", 1.0, 5)], "k string, v double, n int")
    got = {(r.k, r.v): r.cum_before for r in weighted_prefix(df, ["k"], "v", "n", partitions=3).collect()}
    assert got == {("a", 1.0): 0, ("a", 2.0): 2, ("a", 3.0): 5, ("b", 1.0): 0}


def test_feature_plan_reads_written_ranges_and_runs_no_python(spark):
    plan = FE.build_features(load_readings(spark, SMALL))._jdf.queryExecution().executedPlan().toString()
    assert "BatchEvalPython" not in plan and "ArrowEvalPython" not in plan
    # the ranges were written beforehand, and nothing is cached on executor disks
    assert "rangepartitioning" not in plan.lower() and "InMemoryTableScan" not in plan


def test_episode_counts_match_fixture_measurement(spark):
    """FIXTURES.md measured 1,916 layer-1 episodes over 4,070 non-green readings at sf0.01."""
    r = load_readings(spark, MEDIUM)
    al = A.with_alerts(FE.build_features(r, dropna=False).withColumn("prob_aceptable", F.lit(0.0)))
    ep = A.episodes(al, "level_layer1").agg(F.count(F.lit(1)).alias("n"), F.sum("n_readings").alias("rows")).first()
    assert ep["n"] == 1916 and ep["rows"] == 4070


def test_prefix_sums_survive_ranges_that_are_sampled_anew(spark):
    """AUC over many distinct scores: with two exchanges of unequal bounds the slices and rows would not belong together."""
    from riverlens.operators import metrics as M
    old = spark.conf.get("spark.sql.execution.rangeExchange.sampleSizePerPartition", "100")
    spark.conf.set("spark.sql.execution.rangeExchange.sampleSizePerPartition", "5")
    try:
        preds = spark.range(300_000).selectExpr("'m' as model", "xxhash64(id) as score", "cast(pmod(xxhash64(id, 1), 3) = 0 as int) as y")
        auc = M.roc_auc(preds, ["model"]).first()["roc_auc"]
        pdf = preds.toPandas()
        ranks = pdf["score"].rank()
        p, n = int((pdf["y"] == 1).sum()), int((pdf["y"] == 0).sum())
        assert abs(auc - (ranks[pdf["y"] == 1].sum() - p * (p + 1) / 2) / (p * n)) < 1e-12
    finally:
        spark.conf.set("spark.sql.execution.rangeExchange.sampleSizePerPartition", old)


def test_written_table_is_dealt_over_files(spark):
    """A table of few partitions is read again by many tasks."""
    from riverlens.session import materialize
    back = materialize(spark.range(600).coalesce(1), "dealt", file_rows=100)
    assert len(back.inputFiles()) == 6 and back.count() == 600
