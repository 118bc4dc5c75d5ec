import numpy as np

from pyspark.sql import functions as F

from fixture_paths import SMALL
import __spark_entry__ as E
from riverlens.operators import alerts as A
from riverlens.operators import features as FE
from riverlens.sources.adapters import load_readings
from riverlens.streaming import alerts as T


def test_stream_equals_batch_for_levels(spark):
    s1 = T.run_to_table(T.alert_stream(T.readings_stream(spark, SMALL)), "tst1")
    b1 = A.with_variable_levels(load_readings(spark, SMALL))
    cols = ["reading_id", "level_global"]
    assert s1.select(*cols).exceptAll(b1.select(*cols)).count() == 0 and s1.count() == b1.count()


def test_features_across_micro_batches_equal_batch(spark):
    readings = load_readings(spark, SMALL)
    cols = ["reading_id", *T.FEATURE_COLS]
    b5 = FE.build_features(readings, dropna=False).select(*cols).toPandas().sort_values("reading_id").reset_index(drop=True)
    for chunks in (1, 5):
        s5 = T.run_features(T.staged_readings(readings, chunks=chunks)).select(*cols).toPandas() \
            .sort_values("reading_id").reset_index(drop=True)
        assert len(s5) == len(b5) == 1000
        assert np.allclose(s5.to_numpy(float), b5.to_numpy(float), atol=1e-9, equal_nan=True)


def test_repeats_within_and_across_micro_batches_are_removed(spark):
    readings = load_readings(spark, SMALL)
    stream = T.staged_readings(readings, repeats=True)
    assert T.run_to_table(stream, "all").count() > 1100
    assert T.run_to_table(T.dedupe_stream(T.staged_readings(readings, repeats=True)), "once").count() == 1000


def test_heartbeat_closes_every_window(spark):
    readings = load_readings(spark, SMALL)
    out = T.run_to_table(T.level_counts_stream(T.alert_stream(T.staged_readings(readings, heartbeat=True))), "counts")
    assert out.filter(F.col("station_id") != T.HEARTBEAT).agg(F.sum("n")).first()[0] == 1000


def test_entry_and_registry(spark):
    out = E.entry(spark)
    assert out.count() == 5
    qs, sql = E.queries(), E.oracle_sql()
    assert set(sql) <= set(qs)
    assert len(qs) >= 90


def test_all_pairs_reads_survey_once(spark):
    from riverlens.operators import survey as V
    from riverlens.sources.adapters import load_survey
    plan = V.pair_contingency(load_survey(spark, SMALL), V.all_pairs(["SEX", "L1", "L2", "L3"])) \
        ._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == 1


def test_alert_rules_stay_in_the_jvm(spark):
    al = A.with_alerts(FE.build_features(load_readings(spark, SMALL)).withColumn("prob_aceptable", F.lit(0.0)))
    plan = al._jdf.queryExecution().executedPlan().toString()
    assert "BatchEvalPython" not in plan and "ArrowEvalPython" not in plan


def test_top_pairs_is_a_top_k(spark):
    from riverlens.operators import survey as V
    from riverlens.sources.adapters import load_survey
    sv = load_survey(spark, SMALL)
    cont = V.cramers_v(V.chi_square(V.pair_contingency(sv, V.all_pairs(["L1", "L2", "L3", "L4"]))))
    plan = V.top_pairs(cont, "v_plain", 3)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan
