"""Registered queries: data-quality checks (Q*) and period/describe summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import quality as Q
from ..schema import LIKERT_ITEMS, SENSORS
from ..sources.adapters import load_readings, load_survey
from . import sql as S
from ..session import table_path
from .catalog import register

R, RF, SV = f"({S.READINGS})", f"({S.READINGS_FAULTY})", f"({S.SURVEY})"
_ALL_READING_COLS = ["reading_id", "station_id", "ts", "ph", "dissolved_oxygen", "turbidity",
                     "temperature", "wqi", "quality_class"]


@register("quality_nulls", sql=" UNION ALL ".join(
    f"SELECT 'null' AS rule, '{c}' AS column, CAST(count(*) FILTER (WHERE {c} IS NULL) AS BIGINT) AS n_bad FROM {RF} x"
    for c in _ALL_READING_COLS))
def quality_nulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q1 on the fault-injected readings."""
    return Q.null_counts(load_readings(spark, sf_dir, faults=True))


@register("quality_duplicates", sql=f"""
SELECT 'duplicate' AS rule, '*' AS column, CAST(sum(n - 1) AS BIGINT) AS n_bad, CAST(sum(n) AS BIGINT) AS n_rows
FROM (SELECT count(*) AS n FROM {RF} x GROUP BY ALL_COLS) g""".replace("ALL_COLS", ", ".join(_ALL_READING_COLS)))
def quality_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q2 on the fault-injected readings."""
    return Q.duplicate_rows(load_readings(spark, sf_dir, faults=True))


# The source columns that the readings are derived from.
EVENTS_CONTRACT = [("event_id", "bigint"), ("ts", "timestamp_ntz"), ("user_id", "bigint"), ("event_type", "string"), ("value", "double"), ("props", "string")]


@register("quality_schema", sql=" UNION ALL ".join(
    f"SELECT {i} AS position, '{n}' AS expected, '{t}' AS expected_type, '{t}' AS actual_type, "
    f"'{n}' IN (SELECT column_name FROM (DESCRIBE events)) AS ok, CAST(count({n}) AS BIGINT) AS n_present FROM events"
    for i, (n, t) in enumerate(EVENTS_CONTRACT)))
def quality_schema(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q3: names, types and filled rows of the source table's columns."""
    return Q.schema_contract(spark.read.parquet(table_path(sf_dir, "events")), EVENTS_CONTRACT)


@register("quality_gaps", sql=f"""
SELECT station_id, reading_id, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS ts,
       strftime(prev_ts, '%Y-%m-%d %H:%M:%S.%f') AS prev_ts,
       round(epoch_us(ts) / 1e6 - epoch_us(prev_ts) / 1e6, 6) AS gap_seconds
FROM (SELECT station_id, reading_id, ts, lag(ts) OVER {S.W} AS prev_ts FROM {R} x) g
WHERE prev_ts IS NOT NULL AND epoch_us(ts) / 1e6 - epoch_us(prev_ts) / 1e6 <> 900""")
def quality_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q4: every off-cadence step (times are irregular here, so most steps are listed)."""
    g = Q.cadence_gaps(load_readings(spark, sf_dir))
    return g.select("station_id", "reading_id",
                    F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("ts"),
                    F.date_format("prev_ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("prev_ts"),
                    F.round("gap_seconds", 6).alias("gap_seconds"))


@register("quality_gap_summary", sql=f"""
SELECT station_id, CAST(count(*) AS BIGINT) AS n_bad, round(max(gap), 6) AS max_gap_seconds
FROM (SELECT station_id, epoch_us(ts) / 1e6 - epoch_us(lag(ts) OVER {S.W}) / 1e6 AS gap FROM {R} x) g
WHERE gap IS NOT NULL AND gap <> 900 GROUP BY station_id""")
def quality_gap_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.gap_summary(Q.cadence_gaps(load_readings(spark, sf_dir)))


_RANGES = {"ph": (6.5, 8.5), "dissolved_oxygen": (7.0, 14.0), "turbidity": (0.0, 50.0),
           "temperature": (20.0, 30.0), "wqi": (0.0, 100.0)}


@register("quality_ranges", sql=" UNION ALL ".join(
    f"SELECT 'range' AS rule, '{c}' AS column, CAST({lo} AS DOUBLE) AS lo, CAST({hi} AS DOUBLE) AS hi, "
    f"CAST(count(*) FILTER (WHERE {c} < {lo} OR {c} > {hi}) AS BIGINT) AS n_bad FROM {RF} x"
    for c, (lo, hi) in _RANGES.items()))
def quality_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q5 on the fault-injected readings."""
    return Q.range_violations(load_readings(spark, sf_dir, faults=True))


@register("quality_class_consistency", sql=f"""
SELECT 'class_vs_index' AS rule, 'quality_class' AS column,
  CAST(count(*) FILTER (WHERE (CASE WHEN wqi >= 90 THEN 'EXCELENTE' WHEN wqi >= 80 THEN 'BUENA'
       ELSE 'ACEPTABLE' END) <> quality_class) AS BIGINT) AS n_bad, CAST(count(*) AS BIGINT) AS n_rows
FROM {R} x""")
def quality_class_consistency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q6."""
    return Q.class_consistency(load_readings(spark, sf_dir))


@register("quality_likert_range", sql=" UNION ALL ".join(
    f"SELECT 'range' AS rule, '{c}' AS column, CAST(1 AS DOUBLE) AS lo, CAST(5 AS DOUBLE) AS hi, "
    f"CAST(count(*) FILTER (WHERE {c} < 1 OR {c} > 5) AS BIGINT) AS n_bad FROM {SV} x" for c in LIKERT_ITEMS))
def quality_likert_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q7."""
    return Q.likert_range(load_survey(spark, sf_dir))


@register("quality_code_domain", sql=" UNION ALL ".join(
    f"""SELECT '{c}' AS column, array_to_string(list_sort(list_distinct(list({c}))), ',') AS observed,
    '{exp}' AS expected,
    array_to_string(list_sort(list_filter(list_distinct(list({c})), lambda v: NOT list_contains([{exp}], v))), ',') AS unexpected,
    array_to_string(list_filter([{exp}], lambda v: NOT list_contains(list({c}), v)), ',') AS missing,
    CAST(len(list_filter(list_distinct(list({c})), lambda v: NOT list_contains([{exp}], v))) AS BIGINT) AS n_bad
    FROM {SV} x""" for c, exp in [("SEX", "1,2"), ("AGE", "1,2,3"), ("ZONE", "1,2")]))
def quality_code_domain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q8."""
    return Q.code_domain(load_survey(spark, sf_dir))


@register("quality_class_distribution", sql=f"""
SELECT quality_class, CAST(count(*) AS BIGINT) AS n,
  round(count(*) * 100.0 / sum(count(*)) OVER (), 6) AS pct FROM {R} x GROUP BY quality_class""")
def quality_class_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q10."""
    return Q.class_distribution(load_readings(spark, sf_dir))


@register("quality_describe", sql=" UNION ALL ".join(
    f"""SELECT '{c}' AS variable, CAST(count({c}) AS BIGINT) AS count, round(avg({c}), 6) AS mean,
    round(stddev_samp({c}), 6) AS std, round(min({c}), 6) AS min,
    round(quantile_cont({c}, 0.25), 6) AS p25, round(quantile_cont({c}, 0.5), 6) AS p50,
    round(quantile_cont({c}, 0.75), 6) AS p75, round(max({c}), 6) AS max FROM {R} x""" for c in SENSORS))
def quality_describe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q11."""
    return Q.describe(load_readings(spark, sf_dir))


@register("quality_period", sql=f"""
SELECT strftime(min(CAST(ts AS DATE)), '%Y-%m-%d') AS first_date,
       strftime(max(CAST(ts AS DATE)), '%Y-%m-%d') AS last_date, CAST(count(*) AS BIGINT) AS n_rows FROM {R} x""")
def quality_period(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q12."""
    return Q.period_bounds(load_readings(spark, sf_dir))


@register("lineitem_describe", sql=" UNION ALL ".join(
    f"""SELECT '{c}' AS variable, CAST(count({c}) AS BIGINT) AS count, round(avg({c}), 6) AS mean,
    round(stddev_samp({c}), 6) AS std, round(min({c}), 6) AS min,
    round(quantile_cont({c}, 0.25), 6) AS p25, round(quantile_cont({c}, 0.5), 6) AS p50,
    round(quantile_cont({c}, 0.75), 6) AS p75, round(max({c}), 6) AS max FROM lineitem"""
    for c in ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]))
def lineitem_describe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q11 at volume: describe of the four lineitem measures (exact quartiles)."""
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return Q.describe(li, ["l_quantity", "l_extendedprice", "l_discount", "l_tax"])
