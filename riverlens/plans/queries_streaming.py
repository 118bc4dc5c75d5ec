"""Registered queries: the streaming alert engine run to completion (T*).

Each query replays the readings as several micro-batches, runs a Structured
Streaming job over them into a Parquet table in the shared checkpoint folder
and returns that table, so the stream's output is checked against the batch
oracle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import alerts as A
from ..schema import features_full
from ..sources.adapters import load_readings
from ..streaming import alerts as T
from ..streaming import stateful as ST
from . import sql as S
from .catalog import register


@register("stream_alert_levels", sql=f"""
SELECT reading_id, station_id, level_ph, level_do, level_turbidity, level_temperature, level_global, vars_in_alert
FROM ({S.alerts_sql(f'SELECT *, CAST(NULL AS DOUBLE) AS turbidity_delta1_abs FROM ({S.READINGS}) r')}) a""")
def stream_alert_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per-reading levels and reasons computed on a stream."""
    out = T.run_to_table(T.alert_stream(T.readings_stream(spark, sf_dir)), "t1")
    return out.select("reading_id", "station_id", "level_ph", "level_do", "level_turbidity", "level_temperature",
                      "level_global", "vars_in_alert")


@register("stream_dedupe", sql=f"SELECT DISTINCT reading_id, station_id FROM ({S.READINGS}) r")
def stream_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readings after duplicate removal within the watermark; repeats come in and across micro-batches."""
    stream = T.staged_readings(load_readings(spark, sf_dir), repeats=True)
    return T.run_to_table(T.dedupe_stream(stream), "t2").select("reading_id", "station_id")


@register("stream_level_counts", sql=f"""
SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS window_start, station_id, level_global, CAST(count(*) AS BIGINT) AS n
FROM ({S.alerts_sql(f'SELECT *, CAST(NULL AS DOUBLE) AS turbidity_delta1_abs FROM ({S.READINGS}) r')}) a GROUP BY ALL""")
def stream_level_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly global-level counts per station; the heartbeat closes the last windows."""
    stream = T.staged_readings(load_readings(spark, sf_dir), heartbeat=True)
    out = T.run_to_table(T.level_counts_stream(T.alert_stream(stream)), "t3").filter(F.col("station_id") != T.HEARTBEAT)
    return out.select(F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("window_start"),
                      "station_id", "level_global", "n")


_T4_PROB = "least(CAST(1 AS DOUBLE), greatest(CAST(0 AS DOUBLE), (85 - wqi) / 20))"


@register("stream_episodes", sql=f"""
WITH hot AS (SELECT * FROM ({S.READINGS}) r WHERE turbidity > 5.0 OR {_T4_PROB} > 0.20),
g AS (SELECT *, CASE WHEN ts <= lag(ts) OVER w + INTERVAL 20 MINUTE THEN 0 ELSE 1 END AS opens FROM hot WINDOW w AS (PARTITION BY station_id ORDER BY ts, reading_id)),
e AS (SELECT *, sum(opens) OVER (PARTITION BY station_id ORDER BY ts, reading_id) AS episode FROM g)
SELECT station_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S.%f') AS start_ts, CAST(count(*) AS BIGINT) AS n_readings,
  round(max(turbidity), 6) AS max_turbidity, round(min(wqi), 6) AS min_wqi FROM e GROUP BY station_id, episode""")
def stream_episodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T4: session-window episodes of readings whose layer level is not green (20-minute gap)."""
    stream = T.staged_readings(load_readings(spark, sf_dir), heartbeat=True)
    out = T.run_to_table(T.episode_stream(stream), "t4").filter(F.col("station_id") != T.HEARTBEAT)
    return out.select("station_id", F.date_format("start_ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("start_ts"), "n_readings",
                      F.round("max_turbidity", 6).alias("max_turbidity"), F.round("min_wqi", 6).alias("min_wqi"))


@register("stream_episode_runs", sql=f"""
WITH l AS (SELECT *, CASE WHEN turbidity > 5.0 THEN 3 WHEN {_T4_PROB} > 0.20 THEN 2 ELSE 1 END AS severity FROM ({S.READINGS}) r),
g AS (SELECT *, sum(CASE WHEN severity = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY station_id ORDER BY ts, reading_id) AS island FROM l)
SELECT station_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S.%f') AS start_ts, strftime(max(ts), '%Y-%m-%d %H:%M:%S.%f') AS end_ts,
  CAST(count(*) AS BIGINT) AS n_readings, CASE max(severity) WHEN 3 THEN 'ROJO' ELSE 'AMARILLO' END AS worst_level,
  round(max(turbidity), 6) AS max_turbidity, round(min(wqi), 6) AS min_wqi
FROM g WHERE severity > 1 GROUP BY station_id, island""")
def stream_episode_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T4 = A16: runs of consecutive non-green readings as a state machine on the stream, whatever the gaps between readings."""
    stream = T.with_layer1(T.staged_readings(load_readings(spark, sf_dir), heartbeat=True, silence="60 DAYS"))
    out = T.run_to_table(ST.episodes_stream(stream), "t4-runs")
    stamp = "yyyy-MM-dd HH:mm:ss.SSSSSS"
    return out.select("station_id", F.date_format("start_ts", stamp).alias("start_ts"), F.date_format("end_ts", stamp).alias("end_ts"), "n_readings",
                      F.when(F.col("worst") == 3, "ROJO").otherwise("AMARILLO").alias("worst_level"),
                      F.round("max_turbidity", 6).alias("max_turbidity"), F.round("min_wqi", 6).alias("min_wqi"))


_T5_COLS = ["reading_id", "station_id"] + T.FEATURE_COLS


@register("stream_features", sql="SELECT " + ", ".join(
    [c if c in ("reading_id", "station_id") else f"round({c}, 6) AS {c}" for c in _T5_COLS])
    + f" FROM ({S.features_sql(False)}) f")
def stream_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T5: lags, differences and rolling features from keyed state over several micro-batches; equal to the batch features."""
    out = T.run_to_table(ST.features_stream(T.staged_readings(load_readings(spark, sf_dir), heartbeat=True)), "t5")
    return out.select("reading_id", "station_id", *[F.round(c, 6).alias(c) for c in T.FEATURE_COLS])


@register("stream_features_backfill", sql="SELECT " + ", ".join(
    [c if c in ("reading_id", "station_id") else f"round({c}, 6) AS {c}" for c in _T5_COLS])
    + f" FROM ({S.features_sql(False)}) f")
def stream_features_backfill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T5 as a backfill: the batch plan on each micro-batch, stations split into blocks."""
    out = T.run_features(T.staged_readings(load_readings(spark, sf_dir)))
    return out.select("reading_id", "station_id", *[F.round(c, 6).alias(c) for c in T.FEATURE_COLS])


def scoring_stream(readings: DataFrame, models) -> DataFrame:
    """One streaming query from readings to both layer levels: feature state, classifier, isolation forest, frozen bounds, rules."""
    complete = ST.features_stream(readings).dropna(subset=features_full())
    # a station's features come from one task: dealt again, every core scores
    complete = complete.repartition(readings.sparkSession.sparkContext.defaultParallelism)
    return A.with_alerts(models.score(complete), prob="prob_aceptable", score="anomaly_score")


@register("stream_scoring")
def stream_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The saved classifier and isolation forest, fitted on the training rows, score the readings of a stream in one chained
    query; class probability, frozen min-max score and both layer levels of every complete reading."""
    from .queries_models import fitted_alert_models
    models = fitted_alert_models(spark, sf_dir)
    scored = scoring_stream(T.staged_readings(load_readings(spark, sf_dir), heartbeat=True), models)
    return T.run_to_table(scored.select("reading_id", "station_id", "prob_aceptable", "anomaly_score", "level_layer1", "level_layer2"), "t6")
