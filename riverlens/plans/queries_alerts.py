"""Registered queries: features, alert rules, distributions, episodes (F*, A*)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import alerts as A
from ..operators import features as FE
from ..schema import LAYER_LEVELS, LEVELS
from ..sources.adapters import load_readings
from . import sql as S
from .catalog import register


def alert_frame(spark: SparkSession, sf_dir: str, dropna: bool = True) -> DataFrame:
    """readings -> features -> rule-based alerts (no model: P(ACEPTABLE) = 0)."""
    feats = FE.build_features(load_readings(spark, sf_dir), dropna=dropna)
    return A.with_alerts(feats.withColumn("prob_aceptable", F.lit(0.0)))


ALERTS_SQL = S.alerts_sql(S.features_sql(dropna=True))
ALERTS_ALL_SQL = S.alerts_sql(S.features_sql(dropna=False))


@register("alert_level_distribution",
          sql=S.distribution_sql(ALERTS_SQL, A.LEVEL_OUTPUTS, LEVELS))
def alert_level_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A12 over the full feature pipeline (the flagship query)."""
    return A.level_distribution(alert_frame(spark, sf_dir))


@register("alert_layer_distribution",
          sql=S.distribution_sql(ALERTS_SQL, ["level_layer1"], LAYER_LEVELS).replace(
              "SELECT *, ", "SELECT *, round((n_amarillo + n_rojo) * 100.0 / n_total, 6) AS activation_pct, ", 1))
def alert_layer_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A13."""
    return A.layer_distribution(alert_frame(spark, sf_dir))
