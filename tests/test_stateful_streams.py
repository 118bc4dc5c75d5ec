"""Keyed stream state: features and episodes equal the batch, also after a restart and with late readings."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from fixture_paths import SMALL
from riverlens.operators import alerts as A
from riverlens.operators import features as FE
from riverlens.operators import models as ML
from riverlens.plans import queries_models as Q
from riverlens.plans import queries_streaming as QS
from riverlens.sources.adapters import load_readings
from riverlens.streaming import alerts as T
from riverlens.streaming import stateful as ST

COLS = ["reading_id", *T.FEATURE_COLS]


def table(df):
    return df.select(*COLS).toPandas().sort_values("reading_id").reset_index(drop=True)


@pytest.fixture(scope="module")
def readings(spark):
    """Readings with a null sensor, and two at the same time."""
    r = load_readings(spark, SMALL)
    r = r.withColumn("turbidity", F.when(F.col("reading_id") % 50 != 7, F.col("turbidity")))
    twin = r.filter("reading_id % 90 = 4").withColumn("reading_id", F.col("reading_id") + 1_000_000)
    return r.unionByName(twin).checkpoint()


def chunk(readings, folder, number, rows):
    readings.filter(rows).coalesce(1).write.parquet(f"{folder}/chunk={number:02d}")


def source(spark, readings, folder):
    return spark.readStream.schema(readings.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/chunk=*")


def heartbeat(spark, readings, folder, number):
    last = readings.agg(F.max("ts")).first()[0]
    row = {"station_id": F.lit(T.HEARTBEAT), "ts": F.lit(last) + F.expr("INTERVAL 60 DAYS")}
    spark.range(1).select(*[row.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in readings.schema]) \
        .write.parquet(f"{folder}/chunk={number:02d}")


def test_late_readings_and_a_restart_leave_the_features_of_the_batch(spark, readings, tmp_path):
    low, high = readings.agg(F.min("ts"), F.max("ts")).first()
    edges = [low + (high - low) / 4 * i for i in (1, 2, 3)]
    part = F.when(F.col("ts") < edges[0], 0).when(F.col("ts") < edges[1], 1).when(F.col("ts") < edges[2], 2).otherwise(3)
    near = F.lit(False)
    for e in edges:     # every second reading of the last 50 minutes of a chunk arrives with the next one
        near = near | ((F.col("ts") < e) & (F.col("ts") >= F.lit(e) - F.expr("INTERVAL 50 MINUTES")))
    arrives = part + F.when(near & (F.col("reading_id") % 2 == 0), 1).otherwise(0)
    assert readings.filter(near & (F.col("reading_id") % 2 == 0)).count() > 0
    out = str(tmp_path / "out")
    for i in (0, 1):
        chunk(readings, tmp_path / "in", i, arrives == i)
    T.run_to_table(ST.features_stream(source(spark, readings, tmp_path / "in")), "x", out)
    for i in (2, 3):
        chunk(readings, tmp_path / "in", i, arrives == i)
    heartbeat(spark, readings, tmp_path / "in", 4)
    got = table(T.run_to_table(ST.features_stream(source(spark, readings, tmp_path / "in")), "x", out))
    want = table(FE.build_features(readings, dropna=False))
    assert len(got) == len(want) == readings.count()
    assert np.array_equal(got.to_numpy(float), want.to_numpy(float), equal_nan=True)        # to the last bit


def test_readings_without_station_or_time_are_ignored(spark, readings, tmp_path):
    odd = readings.limit(40).unionByName(readings.limit(3).withColumn("station_id", F.lit(None).cast("string"))) \
        .unionByName(readings.limit(3).withColumn("ts", F.lit(None).cast("timestamp")))
    chunk(odd, tmp_path / "in", 0, F.lit(True))
    heartbeat(spark, readings, tmp_path / "in", 1)
    assert T.run_to_table(ST.features_stream(source(spark, odd, tmp_path / "in")), "odd").count() == 40


def batch_episodes(readings):
    return A.episodes(T.with_layer1(readings), "level_layer1").select("station_id", "start_ts", "end_ts", "n_readings", "worst_level", "max_turbidity", "min_wqi")


def runs(df):
    stamp = "yyyy-MM-dd HH:mm:ss.SSSSSS"
    return df.select("station_id", F.date_format("start_ts", stamp).alias("start_ts"), F.date_format("end_ts", stamp).alias("end_ts"), "n_readings",
                     F.when(F.col("worst") == 3, "ROJO").otherwise("AMARILLO").alias("worst_level"),
                     F.round("max_turbidity", 6).alias("max_turbidity"), F.round("min_wqi", 6).alias("min_wqi"))


def test_episodes_on_a_feed_with_gaps_equal_the_batch(spark, readings):
    gaps = readings.filter(F.pmod(F.floor(F.unix_timestamp("ts") / 7200), F.lit(3)) != 1)      # hours without readings
    out = runs(T.run_to_table(ST.episodes_stream(T.with_layer1(T.staged_readings(gaps, heartbeat=True, silence="60 DAYS"))), "runs"))
    want = batch_episodes(gaps)
    assert out.count() == want.count() > 10 and out.exceptAll(want).count() == 0


def test_only_the_state_machine_tells_gaps_from_green(spark):
    """Two red readings two hours apart without a green one between are one run, but two sessions."""
    rows = [(i, "a", f"2026-04-01 {h}:00", t, 70.0) for i, (h, t) in enumerate((("00:00", 9.0), ("02:00", 9.0), ("02:15", 1.0), ("02:30", 9.0), ("02:45", 1.0)))]
    feed = spark.createDataFrame(rows, "reading_id long, station_id string, ts string, turbidity double, wqi double") \
        .withColumn("ts", F.to_timestamp("ts")).withColumn("wqi", F.lit(99.0))
    out = T.run_to_table(ST.episodes_stream(T.with_layer1(T.staged_readings(feed, chunks=2, heartbeat=True, silence="60 DAYS"))), "one")
    assert sorted(r.n_readings for r in out.collect()) == [1, 2]
    assert sorted(r.n_readings for r in A.episodes(T.with_layer1(feed), "level_layer1").collect()) == [1, 2]
    sessions = T.run_to_table(T.episode_stream(T.staged_readings(feed, chunks=2, heartbeat=True)), "sessions")
    starts = {(r.start_ts.hour, r.n_readings) for r in sessions.filter(F.col("station_id") != T.HEARTBEAT).collect()}
    assert starts == {(0, 1), (2, 1)}


def test_a_silent_station_closes_its_episode_by_a_timer(spark, readings):
    rows = [(i, "a", f"2026-04-01 {h:02d}:00:00", 9.0, 70.0) for i, h in enumerate((0, 1, 5, 6))]
    feed = spark.createDataFrame(rows, "reading_id long, station_id string, ts string, turbidity double, wqi double").withColumn("ts", F.to_timestamp("ts"))
    stream = T.with_layer1(T.staged_readings(feed, chunks=2, heartbeat=True))
    out = T.run_to_table(ST.episodes_stream(stream, watermark="10 minutes", idle="3 hours"), "idle").orderBy("start_ts").collect()
    assert [(r.start_ts.hour, r.end_ts.hour, r.n_readings) for r in out] == [(0, 1, 2), (5, 6, 2)]


def test_scores_of_one_chained_query_equal_batch_scores(spark, monkeypatch):
    monkeypatch.setitem(ML.CLASSIFIER_PARAMS, "random_forest", {**ML.CLASSIFIER_PARAMS["random_forest"], "numTrees": 5})
    models = Q.fitted_alert_models(spark, SMALL)
    readings = load_readings(spark, SMALL)
    cols = ["reading_id", "prob_aceptable", "anomaly_score", "level_layer1", "level_layer2"]
    batch = A.with_alerts(models.score(FE.build_features(readings)), prob="prob_aceptable", score="anomaly_score").select(cols).toPandas()
    stream = T.run_to_table(QS.scoring_stream(T.staged_readings(readings, heartbeat=True), models).select(cols), "t6").toPandas()
    batch, stream = (t.sort_values("reading_id").reset_index(drop=True) for t in (batch, stream))
    assert len(batch) == len(stream) > 900 and (batch[cols[3:]] == stream[cols[3:]]).all().all()
    assert np.allclose(batch[cols[:3]].to_numpy(float), stream[cols[:3]].to_numpy(float), atol=1e-9)


def test_pending_readings_are_pieces_and_due_ones_come_in_slices(monkeypatch):
    """The state holds a piece per batch, not a row per reading; slices give the order, nulls first, and leave what is not due."""
    import pandas as pd
    from types import SimpleNamespace
    from pyspark.sql import types as T
    monkeypatch.setattr(ST, "SLICE", 4)

    class State(list):
        appendValue = list.append

        def get(self):
            return iter(list(self))

        def put(self, rows):
            self[:] = rows

    class Keep(ST.InOrder):
        def ordered(self, key, rows, passed):
            return rows.to_pandas(integer_object_nulls=True)

    schema = T.StructType([T.StructField("reading_id", T.LongType()), T.StructField("station_id", T.StringType()),
                           T.StructField("ts", T.TimestampType()), T.StructField("ph", T.DoubleType())])
    state = Keep(schema)
    state.pending, state.handle = State(), SimpleNamespace(registerTimer=lambda at: None)
    minutes = [5, 3, 3, 3, 9, 1, 2, 4, 60, None]
    batch = pd.DataFrame({"reading_id": pd.array([1, 8, None, 4, 5, 6, 7, 2, 9, 10], dtype="Int64"), "station_id": "a",
                          "ts": pd.to_datetime([None if m is None else f"2024-01-01 00:{m % 60:02d}:00" if m < 60 else "2024-01-01 01:00:00" for m in minutes]),
                          "ph": [1.0, None, 3.0, 4.0, 5.0, 6.0, 7.0, 8.0, 9.0, 10.0]})
    list(state.handleInputRows(("a",), iter([batch[:4], batch[4:]]), None))
    assert len(state.pending) == 2
    watermark = SimpleNamespace(getCurrentWatermarkInMs=lambda: int(pd.Timestamp("2024-01-01 00:30:00").timestamp() * 1000))
    out = list(state.handleExpiredTimer(("a",), watermark, None))
    assert [len(o) for o in out] == [4, 4]
    ids = pd.concat(out)["reading_id"].tolist()
    assert ids[:2] == [6, 7] and pd.isna(ids[2]) and ids[3:] == [4, 8, 2, 1, 5]
    assert len(state.pending) == 1 and [r for _, r in state.pending] and state.pending[0][0] == int(pd.Timestamp("2024-01-01 01:00:00").value // 1000)
