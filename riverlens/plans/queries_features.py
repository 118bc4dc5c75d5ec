"""Registered queries: the feature table and per-reading alert evaluation."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import alerts as A
from ..operators import features as FE
from ..operators import quality as Q
from ..schema import LAYER_LEVELS, LEVELS, SENSORS, THRESHOLD_TABLE, features_full, features_no_leak
from ..session import ensure_checkpoint_dir, materialize
from ..sources import io
from ..sources.adapters import load_readings
from . import sql as S
from .catalog import register

_ID_COLS = ["reading_id", "station_id", "quality_class"]


def _rounded(df: DataFrame, keep: list[str]) -> DataFrame:
    """Timestamp as text, doubles rounded to 6 places: the stable output form."""
    cols = []
    for f in df.schema.fields:
        if f.name not in keep:
            continue
        if f.name == "ts":
            cols.append(F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("ts"))
        elif isinstance(f.dataType, T.DoubleType):
            cols.append(F.round(f.name, 6).alias(f.name))
        else:
            cols.append(F.col(f.name))
    return df.select(*cols)


def _rounded_sql(source: str, keep: list[str], doubles: set[str]) -> str:
    cols = []
    for c in keep:
        if c == "ts":
            cols.append("strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS ts")
        elif c in doubles:
            cols.append(f"round({c}, 6) AS {c}")
        else:
            cols.append(c)
    return f"SELECT {', '.join(cols)} FROM ({source}) z"


FEATURE_OUT = (_ID_COLS + ["ts", "wqi", "weekday", "day_of_month"] + features_full()
               + ["anomaly", "turbidity_delta1_abs"])
_INTS = {"reading_id", "station_id", "quality_class", "ts", "weekday", "day_of_month", "anomaly"}


@register("features_table", sql=_rounded_sql(S.features_sql(True), FEATURE_OUT,
                                             set(FEATURE_OUT) - _INTS))
def features_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 45-feature table (rows with a full 16-row history)."""
    return _rounded(FE.build_features(load_readings(spark, sf_dir)), FEATURE_OUT)


@register("feature_lists", sql=f"WITH f AS MATERIALIZED ({S.features_sql(True)}) " + " UNION ALL ".join(
    f"SELECT {i} AS position, '{c}' AS feature, {c in features_no_leak()} AS in_anomaly_set, "
    f"CAST(count({c}) AS BIGINT) AS n_present, round(var_samp({c}), 4) AS variance FROM f" for i, c in enumerate(features_full())))
def feature_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """the ordered 45/26 feature lists with values present and variance in the built table."""
    return Q.feature_set_report(FE.build_features(load_readings(spark, sf_dir)))


@register("feature_leakage", sql=" UNION ALL ".join(
    f"SELECT '{c}' AS feature, round(corr({c}, CAST(anomaly AS DOUBLE)), 6) AS corr, "
    f"{'turb' in c.lower()} AS leak_by_name, coalesce(abs(corr({c}, CAST(anomaly AS DOUBLE))), 0) >= 0.95 AS leak_by_corr "
    f"FROM ({S.features_sql(True)}) f" for c in features_full()))
def feature_leakage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q9: correlation of all 45 features with the label and the name rule."""
    return Q.leakage_report(FE.build_features(load_readings(spark, sf_dir)), feature_cols=features_full())


#: What the alert rules and reports read of the feature table.
SCORED_COLUMNS = ["reading_id", "station_id", "ts", *SENSORS, "wqi", "quality_class", "anomaly", "turbidity_delta1_abs", "ph_delta1", "prob_rule", "raw_score"]


def scored_frame(spark: SparkSession, sf_dir: str, dropna: bool = True) -> DataFrame:
    """Readings with their label and changes, a rule probability and a min-max rule score standing in for models.

    Written once: the score's bounds come from all rows, so the windows would be computed for them and again for the rows.
    """
    feats = FE.build_features(load_readings(spark, sf_dir), dropna=dropna)
    feats = (feats.withColumn("prob_rule", F.least(F.lit(1.0), F.greatest(F.lit(0.0), (85 - F.col("wqi")) / 20)))
                  .withColumn("raw_score", F.abs(F.col("ph") - 7.5) + F.abs(F.col("dissolved_oxygen") - 9.0) / 3))
    return A.with_min_max_score(materialize(feats.select(*SCORED_COLUMNS), "scored"), "raw_score", "anomaly_score")


def scored_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.with_alerts(scored_frame(spark, sf_dir), prob="prob_rule")


SCORED_ALERTS_SQL = S.alerts_sql(S.scored_sql(True), prob="prob_rule", score="anomaly_score")
EVAL_OUT = ["reading_id", "station_id", "ts", *SENSORS, "level_ph", "level_do", "level_turbidity",
            "level_temperature", "level_global", "level_layer1", "level_layer2", "vars_in_alert"]


@register("alert_evaluation", sql=_rounded_sql(SCORED_ALERTS_SQL, EVAL_OUT, set(SENSORS)))
def alert_evaluation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per-reading levels, layers and reasons."""
    return _rounded(scored_alerts(spark, sf_dir), EVAL_OUT)


@register("alert_reason_texts", sql=f"""
SELECT reading_id, {', '.join(S.reason_columns_sql())}
FROM ({S.alerts_sql(f'SELECT *, CAST(NULL AS DOUBLE) AS turbidity_delta1_abs FROM ({S.READINGS}) r')}) a""")
def alert_reason_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A5: all four reason texts for every reading."""
    lv = A.with_variable_levels(load_readings(spark, sf_dir))
    return A.with_reason_texts(lv).select("reading_id", *[f"reason_{v}" for v in SENSORS])


@register("alert_score_minmax", sql=f"SELECT reading_id, round(anomaly_score, 6) AS anomaly_score FROM ({S.scored_sql(True)}) s")
def alert_score_minmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A10: batch min-max normalised score."""
    return scored_frame(spark, sf_dir).select("reading_id", F.round("anomaly_score", 6).alias("anomaly_score"))


@register("alert_scored_level_distribution",
          sql=S.distribution_sql(SCORED_ALERTS_SQL, ["level_layer1", "level_layer2"], LAYER_LEVELS).replace(
              "SELECT *, ", "SELECT *, round((n_amarillo + n_rojo) * 100.0 / n_total, 6) AS activation_pct, ", 1))
def alert_scored_level_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A13 with both layers (layer 2 driven by the rule score)."""
    return A.layer_distribution(scored_alerts(spark, sf_dir))


@register("alert_recall", sql=f"""
WITH a AS ({SCORED_ALERTS_SQL})
SELECT layer, n_anomalies, detected_red, detected_any,
  round(CASE WHEN n_anomalies = 0 THEN NULL ELSE detected_red * 100.0 / n_anomalies END, 6) AS recall_red_pct,
  round(CASE WHEN n_anomalies = 0 THEN NULL ELSE detected_any * 100.0 / n_anomalies END, 6) AS recall_any_pct
FROM (
  SELECT 'level_layer1' AS layer, CAST(sum(anomaly) AS BIGINT) AS n_anomalies,
    CAST(count(*) FILTER (WHERE anomaly = 1 AND level_layer1 = 'ROJO') AS BIGINT) AS detected_red,
    CAST(count(*) FILTER (WHERE anomaly = 1 AND level_layer1 IN ('AMARILLO', 'ROJO')) AS BIGINT) AS detected_any FROM a
  UNION ALL
  SELECT 'level_layer2', CAST(sum(anomaly) AS BIGINT),
    CAST(count(*) FILTER (WHERE anomaly = 1 AND level_layer2 = 'ROJO') AS BIGINT),
    CAST(count(*) FILTER (WHERE anomaly = 1 AND level_layer2 IN ('AMARILLO', 'ROJO')) AS BIGINT) FROM a) t""")
def alert_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recall per layer against the turbidity label."""
    return A.layer_recall(scored_alerts(spark, sf_dir))


@register("alert_active", sql=f"""
SELECT station_id, reading_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts,
  CAST(printf('%.2f', ph) AS DOUBLE) AS ph, CAST(printf('%.2f', dissolved_oxygen) AS DOUBLE) AS dissolved_oxygen,
  CAST(printf('%.2f', turbidity) AS DOUBLE) AS turbidity, CAST(printf('%.2f', temperature) AS DOUBLE) AS temperature,
  CAST(printf('%.1f', wqi) AS DOUBLE) AS wqi, level_global, level_layer2, vars_in_alert
FROM ({SCORED_ALERTS_SQL}) a
WHERE level_global IN ('MALA', 'CRÍTICO') OR level_layer2 IN ('AMARILLO', 'ROJO')""")
def alert_active(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Active-alert table."""
    return A.active_alerts(scored_alerts(spark, sf_dir))


EPISODES_SQL = f"""
WITH a AS ({S.alerts_sql(S.features_sql(False))}),
i AS (SELECT *, sum(CASE WHEN level_layer1 = 'VERDE' THEN 1 ELSE 0 END) OVER
        (PARTITION BY station_id ORDER BY ts, reading_id ROWS UNBOUNDED PRECEDING) AS island FROM a)
SELECT station_id,
  strftime(min(ts), '%Y-%m-%d %H:%M:%S.%f') AS start_ts, strftime(max(ts), '%Y-%m-%d %H:%M:%S.%f') AS end_ts,
  CAST(count(*) AS BIGINT) AS n_readings, round(count(*) * 0.25, 6) AS duration_h,
  CASE max(CASE level_layer1 WHEN 'ROJO' THEN 3 WHEN 'AMARILLO' THEN 2 ELSE 1 END)
    WHEN 3 THEN 'ROJO' WHEN 2 THEN 'AMARILLO' ELSE 'VERDE' END AS worst_level,
  round(max(turbidity), 6) AS max_turbidity, round(min(wqi), 6) AS min_wqi
FROM i WHERE level_layer1 <> 'VERDE' GROUP BY station_id, island"""


@register("alert_episodes", sql=EPISODES_SQL)
def alert_episodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of consecutive non-green layer-1 readings (all readings, P = 0)."""
    feats = FE.build_features(load_readings(spark, sf_dir), dropna=False)
    alerts = A.with_alerts(feats.withColumn("prob_aceptable", F.lit(0.0)))
    return A.episodes(alerts, "level_layer1")


@register("alert_critical_records", sql=f"""
WITH s AS ({S.scored_sql(True)}),
c AS (SELECT *, coalesce(abs(ph_delta1) >= 0.15, false) AS fast,
  CASE WHEN turbidity > 10.0 OR (turbidity > 5.0 AND wqi < 80.0) THEN 'CRITICO'
       WHEN turbidity > 5.0 OR anomaly_score >= 0.65 OR (wqi < 80.0 AND coalesce(abs(ph_delta1) >= 0.15, false)) THEN 'ROJO'
  END AS legacy_level FROM s),
t AS (SELECT *, concat_ws(', ',
    CASE WHEN turbidity > 5.0 THEN 'Turbidez=' || printf('%.2f', turbidity) || ' NTU' END,
    CASE WHEN wqi < 80.0 AND NOT (turbidity > 10.0) THEN 'ICA=' || printf('%.1f', wqi) END) AS thr FROM c)
SELECT reading_id, legacy_level, concat_ws(' | ',
    CASE WHEN thr <> '' THEN 'Umbral: ' || thr END,
    CASE WHEN fast THEN 'Velocidad: ΔpH=' || printf('%.3f', abs(ph_delta1)) || '/15min' END,
    CASE WHEN anomaly_score >= 0.35 THEN 'Score IA: ' || printf('%.3f', anomaly_score) END) AS legacy_reasons
FROM t WHERE legacy_level IS NOT NULL""")
def alert_critical_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Legacy CRITICO/ROJO records with grouped reasons (inferred rules)."""
    return A.critical_records(scored_frame(spark, sf_dir)).select("reading_id", "legacy_level", "legacy_reasons")


@register("alert_anomaly_events", sql=f"""
SELECT reading_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, round(turbidity, 6) AS turbidity,
  round(anomaly_score, 6) AS anomaly_score, CASE WHEN anomaly_score >= 0.65 THEN 'ROJO' ELSE 'AMARILLO' END AS event_level
FROM ({S.scored_sql(True)}) s WHERE anomaly = 1""")
def alert_anomaly_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled anomalies with a two-way level."""
    ev = A.anomaly_events(scored_frame(spark, sf_dir))
    return ev.select("reading_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ts"),
                     F.round("turbidity", 6).alias("turbidity"), F.round("anomaly_score", 6).alias("anomaly_score"),
                     "event_level")


_LEVEL_COLUMN = {"pH": "level_ph", "Oxígeno Disuelto": "level_do", "Turbidez": "level_turbidity", "Temperatura": "level_temperature"}
_RAW_ALERTS_SQL = S.alerts_sql(f"SELECT *, CAST(NULL AS DOUBLE) AS turbidity_delta1_abs FROM ({S.READINGS}) r")


@register("alert_threshold_table", sql=f"""
SELECT t.*, d.* EXCLUDE (variable) FROM ({S.distribution_sql(_RAW_ALERTS_SQL, A.LEVEL_OUTPUTS, LEVELS)}) d
JOIN (VALUES {', '.join("('" + _LEVEL_COLUMN[row[0]] + "', " + ', '.join(f"'{v}'" for v in row) + ')' for row in THRESHOLD_TABLE)})
  t(level_column, variable, unit, normal, buena, mala, critico, action) ON t.level_column = d.variable""")
def alert_threshold_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Threshold reference table with each variable's observed level counts."""
    counts = A.level_distribution(A.with_alerts(
        load_readings(spark, sf_dir).withColumn("turbidity_delta1_abs", F.lit(None).cast("double"))
                                    .withColumn("prob_aceptable", F.lit(0.0))))
    names = spark.createDataFrame(list(_LEVEL_COLUMN.items()), "variable string, level_column string")
    return (A.threshold_table(spark).join(F.broadcast(names), "variable")
             .join(counts.withColumnRenamed("variable", "level_column"), "level_column", "left"))


@register("alert_status_codes", sql=f"""
SELECT reading_id, CASE quality_class WHEN 'EXCELENTE' THEN 'verde' WHEN 'BUENA' THEN 'amarillo'
  WHEN 'ACEPTABLE' THEN 'rojo' END AS class_status,
  CASE level_layer2 WHEN 'VERDE' THEN 1 WHEN 'AMARILLO' THEN 2 WHEN 'ROJO' THEN 3 END AS layer_number
FROM ({SCORED_ALERTS_SQL}) a""")
def alert_status_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class colour and layer number lookups."""
    return A.with_status(scored_alerts(spark, sf_dir), "level_layer2").select(
        "reading_id", "class_status", "layer_number")


_RUN_SQL = f"""
WITH a AS ({SCORED_ALERTS_SQL})
SELECT CAST(count(*) AS BIGINT) AS n_records,
  CAST(count(*) FILTER (WHERE level_global = 'NORMAL') AS BIGINT) AS global_normal,
  CAST(count(*) FILTER (WHERE level_global = 'BUENA') AS BIGINT) AS global_buena,
  CAST(count(*) FILTER (WHERE level_global = 'MALA') AS BIGINT) AS global_mala,
  CAST(count(*) FILTER (WHERE level_global = 'CRÍTICO') AS BIGINT) AS global_critico,
  CAST(count(*) FILTER (WHERE level_layer2 = 'VERDE') AS BIGINT) AS layer2_verde,
  CAST(count(*) FILTER (WHERE level_layer2 = 'AMARILLO') AS BIGINT) AS layer2_amarillo,
  CAST(count(*) FILTER (WHERE level_layer2 = 'ROJO') AS BIGINT) AS layer2_rojo,
  round(CAST(count(*) FILTER (WHERE anomaly = 1 AND level_layer1 IN ('AMARILLO','ROJO')) AS DOUBLE) * 100 / nullif(sum(anomaly), 0), 6) AS recall_layer1_pct,
  round(CAST(count(*) FILTER (WHERE anomaly = 1 AND level_layer2 IN ('AMARILLO','ROJO')) AS DOUBLE) * 100 / nullif(sum(anomaly), 0), 6) AS recall_layer2_pct
FROM a"""


@register("alert_run_summary", sql=_RUN_SQL)
def alert_run_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One summary row per alert run."""
    return A.run_summary(scored_alerts(spark, sf_dir))


@register("alert_run_log", sql=f"SELECT r.run_id, s.* FROM ({_RUN_SQL}) s, (VALUES ('run-1'), ('run-2')) r(run_id)")
def alert_run_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three runs enter the log, the third repeats the first one's id and replaces its (doubled) entry: two rows are read back."""
    path = f"{ensure_checkpoint_dir(spark)}/tables/run-log-{uuid.uuid4().hex[:8]}"
    alerts = materialize(scored_alerts(spark, sf_dir).select("level_global", "level_layer1", "level_layer2", "anomaly"), "alerts")
    summary = A.run_summary(alerts)
    for run_id, rows in (("run-1", alerts.unionByName(alerts)), ("run-2", alerts), ("run-1", alerts)):
        io.write_run(A.run_summary(rows), path, run_id)
    return io.read_runs(spark, path, summary.schema)


@register("alert_report_tables", sql=" UNION ALL ".join(
    f"SELECT '{name}' AS report, {columns} AS n_columns, CAST(count(*) AS BIGINT) AS n_rows FROM ({sql}) x" for name, columns, sql in (
        ("evaluation", len(EVAL_OUT), f"SELECT reading_id FROM ({SCORED_ALERTS_SQL}) a"),
        ("levels", 2 + 2 * len(LEVELS), "SELECT 1 FROM range(5)"),
        ("layers", 3 + 2 * len(LAYER_LEVELS), "SELECT 1 FROM range(2)"),
        ("active", 11, f"SELECT 1 FROM ({SCORED_ALERTS_SQL}) a WHERE level_global IN ('MALA', 'CRÍTICO') OR level_layer2 IN ('AMARILLO', 'ROJO')"),
        ("events", 5, f"SELECT 1 FROM ({S.scored_sql(True)}) s WHERE anomaly = 1"),
        ("thresholds", 17, "SELECT 1 FROM range(4)"),
        ("summary", 10, "SELECT 1 FROM range(1)"))))
def alert_report_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report set of an alert run (R6-R9, A13, A19, S7) written as tables and read back: columns and rows of each."""
    alerts = materialize(scored_alerts(spark, sf_dir), "alerts")
    events = A.anomaly_events(alerts).select("reading_id", "ts", "turbidity", "anomaly_score", "event_level")
    return io.save_reports({
        "evaluation": _rounded(alerts, EVAL_OUT), "levels": A.level_distribution(alerts), "layers": A.layer_distribution(alerts),
        "active": A.active_alerts(alerts), "events": events, "thresholds": alert_threshold_table(spark, sf_dir), "summary": A.run_summary(alerts),
    }, f"{ensure_checkpoint_dir(spark)}/tables/alert-reports-{uuid.uuid4().hex[:8]}")
