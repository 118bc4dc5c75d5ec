"""Alert engine A1-A20 as column expressions and small aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import levels as L
from ..functions.text import display_round, fixed
from ..plans.ordering import BLOCK, DEFAULT_BLOCK_ROWS, SEQ, carry_max, sequence_index
from ..schema import (ALL_NORMAL_TEXT, LAYER_LEVELS, LEVELS, REASON_SEPARATOR, SENSORS,
                      THRESHOLD_TABLE)

LEVEL_OUTPUTS = ["level_ph", "level_do", "level_turbidity", "level_temperature", "level_global"]


def with_min_max_score(df: DataFrame, raw: str = "raw_score", out: str = "anomaly_score",
                       bounds: tuple[float, float] | None = None) -> DataFrame:
    """A10: (s - min) / (max - min + 1e-9).

    Batch mode joins a one-row min/max aggregate (a broadcast of one row);
    ``bounds`` freezes the train min/max instead (streaming, T6).
    """
    if bounds is not None:
        lo, hi = bounds
        return df.withColumn(out, (F.col(raw) - F.lit(lo)) / (F.lit(hi) - F.lit(lo) + 1e-9))
    mm = df.agg(F.min(raw).alias("_smin"), F.max(raw).alias("_smax"))
    return (df.crossJoin(F.broadcast(mm))
              .withColumn(out, (F.col(raw) - F.col("_smin")) / (F.col("_smax") - F.col("_smin") + 1e-9))
              .drop("_smin", "_smax"))


def alert_reasons(df: DataFrame) -> Column:
    """Reasons of variables at severity >= 2 joined by ' | ', else 'Todas normales'."""
    parts = [F.when(L.severity(F.col(L.LEVEL_COLUMNS[v])) >= 2,
                    L.reason(v, F.col(L.LEVEL_COLUMNS[v]))) for v in SENSORS]
    joined = F.concat_ws(REASON_SEPARATOR, *parts)
    return F.coalesce(F.nullif(joined, F.lit("")), F.lit(ALL_NORMAL_TEXT))


def with_variable_levels(df: DataFrame) -> DataFrame:
    """One level column per sensor plus the global level."""
    out = df.select("*", *[fn(F.col(v)).alias(L.LEVEL_COLUMNS[v]) for v, fn in L.LEVEL_FUNCTIONS.items()])
    return out.withColumn("level_global", L.global_level(*[L.LEVEL_COLUMNS[v] for v in SENSORS]))


def with_alerts(df: DataFrame, prob: str = "prob_aceptable", score: str = "anomaly_score",
                abs_delta: str = "turbidity_delta1_abs") -> DataFrame:
    """A1-A9, A11 on each row: variable levels, global level, both layers, reasons."""
    out = with_variable_levels(df)
    cols = [alert_reasons(out).alias("vars_in_alert"),
            L.layer1_level("turbidity", abs_delta, prob).alias("level_layer1")]
    if score in df.columns:
        cols.append(L.layer2_level(score, prob, abs_delta).alias("level_layer2"))
    return out.select("*", *cols)


def with_reason_texts(df: DataFrame) -> DataFrame:
    """A5: every variable's reason text (whatever its level)."""
    return df.select("*", *[L.reason(v, F.col(L.LEVEL_COLUMNS[v])).alias(f"reason_{v}")
                            for v in SENSORS])


def _distribution(df: DataFrame, columns: list[str], levels: list[str]) -> DataFrame:
    """Counts and shares per (variable, level), zero cells kept, one row per variable."""
    long = df.select(*columns).unpivot([], columns, "variable", "level")
    wide = long.groupBy("variable").pivot("level", levels).count().fillna(0, subset=levels)
    total = sum(F.col(f"`{lv}`") for lv in levels)
    out = wide.select("variable", *[F.col(f"`{lv}`").cast("long").alias(f"n_{_plain(lv)}") for lv in levels],
                      total.cast("long").alias("n_total"))
    return out.select("*", *[F.round(F.col(f"n_{_plain(lv)}") * 100.0 / F.col("n_total"), 6)
                             .alias(f"pct_{_plain(lv)}") for lv in levels])


def _plain(level: str) -> str:
    return level.replace("Í", "I").lower()


def level_distribution(alerts: DataFrame) -> DataFrame:
    """NORMAL/BUENA/MALA/CRÍTICO counts and % per variable and global."""
    return _distribution(alerts, LEVEL_OUTPUTS, LEVELS)


def layer_distribution(alerts: DataFrame, layers: list[str] | None = None) -> DataFrame:
    """VERDE/AMARILLO/ROJO per layer, plus activation rate (AMARILLO + ROJO share)."""
    layers = layers or [c for c in ("level_layer1", "level_layer2") if c in alerts.columns]
    out = _distribution(alerts, layers, LAYER_LEVELS)
    return out.withColumn("activation_pct",
                          F.round((F.col("n_amarillo") + F.col("n_rojo")) * 100.0 / F.col("n_total"), 6))


def layer_recall(alerts: DataFrame, label: str = "anomaly", layers: list[str] | None = None) -> DataFrame:
    """Recall of labelled anomalies per layer, ROJO and AMARILLO+ROJO."""
    layers = layers or [c for c in ("level_layer1", "level_layer2") if c in alerts.columns]
    aggs = [F.sum(label).cast("long").alias("n_anomalies")]
    for lay in layers:
        aggs += [F.count_if((F.col(label) == 1) & (F.col(lay) == "ROJO")).alias(f"{lay}_red"),
                 F.count_if((F.col(label) == 1) & F.col(lay).isin("AMARILLO", "ROJO")).alias(f"{lay}_any")]
    agg = alerts.agg(*aggs)
    rows = [F.struct(F.lit(lay).alias("layer"),
                     F.col(f"{lay}_red").alias("detected_red"),
                     F.col(f"{lay}_any").alias("detected_any")) for lay in layers]
    return (agg.select("n_anomalies", F.explode(F.array(*rows)).alias("r"))
               .select("r.layer", "n_anomalies", "r.detected_red", "r.detected_any",
                       F.round(F.try_divide(F.col("r.detected_red") * 100.0, F.col("n_anomalies")), 6)
                        .alias("recall_red_pct"),
                       F.round(F.try_divide(F.col("r.detected_any") * 100.0, F.col("n_anomalies")), 6)
                        .alias("recall_any_pct")))


def active_alerts(alerts: DataFrame, layer: str = "level_layer2") -> DataFrame:
    """Readings whose global level is MALA/CRÍTICO or whose layer is AMARILLO/ROJO."""
    cond = F.col("level_global").isin("MALA", "CRÍTICO")
    if layer in alerts.columns:
        cond = cond | F.col(layer).isin("AMARILLO", "ROJO")
    cols = ["station_id", "reading_id",
            F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ts"),
            *[display_round(v, 2).alias(v) for v in SENSORS],
            display_round("wqi", 1).alias("wqi"), "level_global"]
    if layer in alerts.columns:
        cols.append(layer)
    cols.append("vars_in_alert")
    return alerts.filter(cond).select(*cols)


def episodes(alerts: DataFrame, level: str = "level_layer1", green: str = "VERDE",
             key: str = "station_id", block_rows: int = DEFAULT_BLOCK_ROWS,
             step_hours: float = 0.25) -> DataFrame:
    """Maximal runs of consecutive non-green readings per station.

    Each non-green row is anchored to the position of the last green row
    before it: a running max inside its block plus the max carried over from
    earlier blocks (a table with one row per block). No task ever holds a
    whole station, and the grouping by anchor combines map-side.
    """
    df = alerts if SEQ in alerts.columns else sequence_index(alerts, key=key)
    if BLOCK not in df.columns:
        df = df.withColumn(BLOCK, F.floor(F.col(SEQ) / block_rows))
    green_seq = F.when(F.col(level) == green, F.col(SEQ))
    df = df.withColumn("_gseq", green_seq)
    upto = Window.partitionBy(key, BLOCK).orderBy(SEQ).rowsBetween(Window.unboundedPreceding, 0)
    carry = carry_max(df, "_gseq", key)
    anchored = (df.withColumn("_in_block", F.max("_gseq").over(upto))
                  .filter(F.col(level) != green)
                  .join(carry, [key, BLOCK], "left")
                  .withColumn("episode_anchor",
                              F.coalesce("_in_block", "_gseq_carry", F.lit(-1)).cast("long")))
    sev = L.layer_number(F.col(level))
    ep = anchored.groupBy(key, "episode_anchor").agg(
        F.min("ts").alias("_start"), F.max("ts").alias("_end"),
        F.count(F.lit(1)).alias("n_readings"),
        F.max(sev).alias("_worst"),
        F.max("turbidity").alias("max_turbidity"),
        F.min("wqi").alias("min_wqi"))
    worst = F.when(F.col("_worst") == 3, "ROJO").when(F.col("_worst") == 2, "AMARILLO").otherwise(green)
    return ep.select(key,
                     F.date_format("_start", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("start_ts"),
                     F.date_format("_end", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("end_ts"),
                     "n_readings",
                     F.round(F.col("n_readings") * step_hours, 6).alias("duration_h"),
                     worst.alias("worst_level"),
                     F.round("max_turbidity", 6).alias("max_turbidity"),
                     F.round("min_wqi", 6).alias("min_wqi"))


# Inferred legacy rules (X12): default parameters.
LEGACY = {"crit_turbidity": 10.0, "red_turbidity": 5.0, "index": 80.0,
          "ph_rate": 0.15, "red_score": 0.65, "score_note": 0.35}


def critical_records(df: DataFrame, score: str = "anomaly_score", ph_rate: str = "ph_delta1",
                     p=LEGACY) -> DataFrame:
    """Legacy two-level record list (CRITICO / ROJO) with grouped reasons."""
    turb, idx, s = F.col("turbidity"), F.col("wqi"), F.col(score)
    dph = F.abs(F.col(ph_rate))
    fast = F.coalesce(dph >= p["ph_rate"], F.lit(False))
    lvl = (F.when((turb > p["crit_turbidity"]) | ((turb > p["red_turbidity"]) & (idx < p["index"])), "CRITICO")
            .when((turb > p["red_turbidity"]) | (s >= p["red_score"]) | ((idx < p["index"]) & fast), "ROJO"))
    threshold_parts = F.concat_ws(", ",
        F.when(turb > p["red_turbidity"], F.concat(F.lit("Turbidez="), fixed(turb, 2), F.lit(" NTU"))),
        F.when((idx < p["index"]) & ~(turb > p["crit_turbidity"]), F.concat(F.lit("ICA="), fixed(idx, 1))))
    groups = F.concat_ws(REASON_SEPARATOR,
        F.when(threshold_parts != "", F.concat(F.lit("Umbral: "), threshold_parts)),
        F.when(fast, F.concat(F.lit("Velocidad: ΔpH="), fixed(dph, 3), F.lit("/15min"))),
        F.when(s >= p["score_note"], F.concat(F.lit("Score IA: "), fixed(s, 3))))
    return (df.withColumn("legacy_level", lvl)
              .filter(F.col("legacy_level").isNotNull())
              .withColumn("legacy_reasons", groups))


def anomaly_events(df: DataFrame, score: str = "anomaly_score", label: str = "anomaly",
                   red: float = 0.65) -> DataFrame:
    """Labelled anomalies with a two-way level (score >= .65 ROJO else AMARILLO)."""
    return (df.filter(F.col(label) == 1)
              .withColumn("event_level", F.when(F.col(score) >= red, "ROJO").otherwise("AMARILLO")))


def threshold_table(spark: SparkSession) -> DataFrame:
    """The threshold reference table (variable x level bounds x action)."""
    cols = ["variable", "unit", "normal", "buena", "mala", "critico", "action"]
    return spark.createDataFrame(THRESHOLD_TABLE, cols)


def with_status(df: DataFrame, layer: str = "level_layer1") -> DataFrame:
    """Class status colour and layer level number."""
    return (df.withColumn("class_status", L.class_status("quality_class"))
              .withColumn("layer_number", L.layer_number(layer)))


def run_summary(alerts: DataFrame, label: str = "anomaly") -> DataFrame:
    """Record count, global and layer-2 level counts, recall of both layers, one row."""
    aggs = [F.count(F.lit(1)).alias("n_records")]
    aggs += [F.count_if(F.col("level_global") == lv).alias(f"global_{_plain(lv)}") for lv in LEVELS]
    aggs += [F.count_if(F.col("level_layer2") == lv).alias(f"layer2_{_plain(lv)}") for lv in LAYER_LEVELS]
    n_pos = F.sum(label)
    for i, lay in ((1, "level_layer1"), (2, "level_layer2")):
        hit = F.count_if((F.col(label) == 1) & F.col(lay).isin("AMARILLO", "ROJO"))
        aggs.append(F.round(F.try_divide(hit.cast("double") * 100, n_pos), 6).alias(f"recall_layer{i}_pct"))
    return alerts.agg(*aggs)
