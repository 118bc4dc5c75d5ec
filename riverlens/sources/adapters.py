"""Adapters that derive the domain tables from the driver's parquet tables.

Each adapter is a pure projection of one scan (no shuffle), so filters and
column pruning applied downstream reach the parquet reader.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table_path

# Per-item loadings (a) and noise multipliers (b) of the survey adapter.
ITEM_A = [1, 1, 2, 2, 1, 1, 1, 3, 3, 3, 3, 2]
ITEM_B = [1, 2, 3, 5, 7, 11, 13, 17, 19, 23, 29, 30]


def _d(x) -> Column:
    return F.lit(x).cast("double")


def _wqi_raw(value: Column, eid: Column) -> Column:
    return 100 - value / 12 - F.abs((eid % 21) - 10).cast("double") / 2


def readings_from_events(events: DataFrame, faults: bool = False,
                         turbidity_divisor: float = 30.0) -> DataFrame:
    """events -> readings (one reading per event, station = event_type).

    ``faults=True`` adds the injected defects used by the quality checks:
    nulls where ``event_id % 101 = 0`` and a duplicate of every row with
    ``event_id % 103 = 0``.
    """
    eid = F.col("event_id")
    value = F.col("value")
    raw = _wqi_raw(value, eid)
    out = events.select(
        eid.alias("reading_id"),
        F.col("event_type").alias("station_id"),
        F.col("ts").cast("timestamp").alias("ts"),
        ((630 + (eid % 49) * 5).cast("double") / 100).alias("ph"),
        ((45 + (eid * 7) % 76).cast("double") / 10).alias("dissolved_oxygen"),
        (value / turbidity_divisor).alias("turbidity"),
        ((30 + (eid * 11) % 341).cast("double") / 10).alias("temperature"),
        F.greatest(_d(0), raw).alias("wqi"),
        F.when(eid % 997 == 0, "BUENA")
         .when(raw >= 90, "EXCELENTE")
         .when(raw >= 80, "BUENA")
         .otherwise("ACEPTABLE").alias("quality_class"),
    )
    if not faults:
        return out
    holed = out.select(
        "reading_id", "station_id", "ts",
        *[F.when(F.col("reading_id") % 101 == 0, F.lit(None).cast("double"))
           .otherwise(F.col(c)).alias(c)
          for c in ["ph", "dissolved_oxygen", "turbidity", "temperature", "wqi"]],
        "quality_class",
    )
    return holed.unionByName(holed.filter(F.col("reading_id") % 103 == 0))


def survey_from_orders(orders: DataFrame) -> DataFrame:
    """orders -> survey (one respondent per order, 12 Likert items)."""
    ok, ck = F.col("o_orderkey"), F.col("o_custkey")
    items = [
        F.least(F.lit(5), F.greatest(F.lit(1), 1 + (ck * a) % 5 + ((ok * b) % 31) % 3 - 1))
         .cast("int").alias(f"L{i + 1}")
        for i, (a, b) in enumerate(zip(ITEM_A, ITEM_B))
    ]
    return orders.select(
        ok.alias("respondent_id"),
        (1 + (ck + ok) % 2).cast("int").alias("SEX"),
        (1 + ck % 3).cast("int").alias("AGE"),
        F.when(ok % 13 == 0, 2).otherwise(1).cast("int").alias("ZONE"),
        *items,
    )


def predictions_from_readings(readings: DataFrame) -> DataFrame:
    """Prediction fixture for the metric operators: two rule "models" per reading.

    Columns: model, row_id, fold, y_class, pred_class, shifted, y_bin, score, y_reg, p_reg.
    Scores are built from integers (hundredths), so every engine sees the
    same ties.
    """
    eid = F.col("reading_id")
    wqi = F.col("wqi")
    t_milli = F.round(F.col("turbidity") * 1000).cast("long")

    def idiv(a: Column, b: int) -> Column:
        return (a / b).cast("long")

    def cls(x: Column) -> Column:
        return F.when(x >= 90, "EXCELENTE").when(x >= 80, "BUENA").otherwise("ACEPTABLE")

    s1 = (idiv((eid * 37) % 1000, 20) + F.least(F.lit(50), idiv(t_milli, 100))).cast("double") / 100
    s2 = (idiv((eid * 53) % 1000, 25) + F.least(F.lit(60), idiv(t_milli, 80))).cast("double") / 100
    models = F.explode(F.array(
        F.struct(F.lit("m1").alias("model"), (wqi + 2).alias("shifted"), s1.alias("score"),
                 (wqi + ((eid % 13) - 6).cast("double") / 4).alias("p_reg")),
        F.struct(F.lit("m2").alias("model"), (wqi - 2).alias("shifted"), s2.alias("score"),
                 (wqi - ((eid % 7) - 3).cast("double") / 2).alias("p_reg")),
    )).alias("m")
    return (readings
            .select(eid, "quality_class", "turbidity", "wqi", models)
            .select(
                F.col("m.model").alias("model"),
                eid.alias("row_id"),
                (eid % 5).cast("int").alias("fold"),
                F.col("quality_class").alias("y_class"),
                cls(F.col("m.shifted")).alias("pred_class"),
                F.col("m.shifted").alias("shifted"),
                (F.col("turbidity") > 5.0).cast("int").alias("y_bin"),
                F.col("m.score").alias("score"),
                wqi.alias("y_reg"),
                F.col("m.p_reg").alias("p_reg"),
            ))


def class_scores(preds: DataFrame) -> DataFrame:
    """Per-class scores for one-vs-rest AUC: (model, row_id, label, is_class, score)."""
    x = F.col("shifted")

    def clamp(c: Column) -> Column:
        return F.least(F.lit(1.0), F.greatest(F.lit(0.0), c))

    per = F.explode(F.array(
        F.struct(F.lit("EXCELENTE").alias("label"), clamp((x - 70) / 30).alias("score")),
        F.struct(F.lit("BUENA").alias("label"), clamp(1 - F.abs(x - 85) / 15).alias("score")),
        F.struct(F.lit("ACEPTABLE").alias("label"), clamp((90 - x) / 30).alias("score")),
    )).alias("c")
    return preds.select("model", "row_id", "y_class", per).select(
        "model", "row_id", F.col("c.label").alias("label"),
        (F.col("y_class") == F.col("c.label")).cast("int").alias("is_class"), F.col("c.score").alias("score"))


def load_readings(spark: SparkSession, sf_dir: str, **kw) -> DataFrame:
    return readings_from_events(spark.read.parquet(table_path(sf_dir, "events")), **kw)


def load_survey(spark: SparkSession, sf_dir: str) -> DataFrame:
    return survey_from_orders(spark.read.parquet(table_path(sf_dir, "orders")))


def load_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return predictions_from_readings(load_readings(spark, sf_dir))
