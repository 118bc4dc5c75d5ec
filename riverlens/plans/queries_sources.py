"""Registered queries: readers and writers (S1-S4, S6, S7) round trips through the shared folder."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import features as FE
from ..schema import SURVEY_VARS
from ..session import ensure_checkpoint_dir
from ..sources import io
from ..sources.adapters import load_readings, load_survey
from . import sql as S
from .catalog import register

STAMP = "dd/MM/yyyy HH:mm:ss.SSSSSS"


def _folder(spark: SparkSession, name: str) -> str:
    return f"{ensure_checkpoint_dir(spark)}/tables/{name}-{uuid.uuid4().hex[:8]}"


@register("sources_readings_csv", sql=f"""
SELECT reading_id, station_id, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS ts, round(ph, 6) AS ph, round(turbidity, 6) AS turbidity, quality_class
FROM ({S.READINGS}) r""")
def sources_readings_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readings written as CSV with a day-first time format and read back by the typed reader."""
    path = _folder(spark, "readings-csv")
    io.save_table(load_readings(spark, sf_dir).withColumn("ts", F.date_format("ts", STAMP)), path, "csv")
    out = io.read_readings(spark, path, "csv", ts_format=STAMP)
    return out.select("reading_id", "station_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("ts"),
                      F.round("ph", 6).alias("ph"), F.round("turbidity", 6).alias("turbidity"), "quality_class")


@register("sources_survey_csv", sql=" UNION ALL ".join(
    f"SELECT '{c}' AS variable, {c} AS level, CAST(count(*) AS BIGINT) AS n FROM ({S.SURVEY}) s GROUP BY {c}" for c in SURVEY_VARS))
def sources_survey_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S3: survey responses written as CSV and read back with the integer schema; answers per level of every item."""
    path = _folder(spark, "survey-csv")
    io.save_table(load_survey(spark, sf_dir), path, "csv")
    back = io.read_survey(spark, path, "csv")
    items = [c for c in back.columns if c != "respondent_id"]
    return back.unpivot(["respondent_id"], items, "variable", "level").groupBy("variable", "level").agg(F.count(F.lit(1)).alias("n"))


@register("sources_feature_table", sql=f"""
SELECT station_id, CAST(count(*) AS BIGINT) AS n, round(sum(turbidity_mean_16), 4) AS sum_mean_16, round(sum(turbidity_lag16), 4) AS sum_lag16
FROM ({S.features_sql(True)}) f GROUP BY station_id""")
def sources_feature_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The feature set written as Parquet by station and loaded again."""
    path = _folder(spark, "features")
    io.save_table(FE.build_features(load_readings(spark, sf_dir)).drop("seq", "block"), path, partition_by=["station_id"])
    back = io.load_table(spark, path)
    return back.groupBy("station_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("turbidity_mean_16"), 4).alias("sum_mean_16"),
                                          F.round(F.sum("turbidity_lag16"), 4).alias("sum_lag16"))
