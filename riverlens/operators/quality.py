"""Data-quality checks Q1-Q12: each returns a report DataFrame; ``enforce`` raises."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.levels import class_from_index
from ..functions.stats import quantile_columns
from ..plans.ordering import SEQ, block_window, framed, sequence_index, HALO, BLOCK
from ..schema import (DEMO_DOMAINS, LIKERT_ITEMS, READINGS_COLUMNS, SENSORS, VALID_RANGES,
                      features_full, features_no_leak)


class QualityError(AssertionError):
    pass


def enforce(report: DataFrame, bad_col: str = "n_bad") -> None:
    """Raise when any rule of a report has failures (the reference stops on assert)."""
    failing = report.filter(F.col(bad_col) > 0)
    shown = failing.limit(20).collect()
    if shown:
        raise QualityError(f"{failing.count()} rules fail: " + "; ".join(str(r.asDict()) for r in shown))


def null_counts(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Q1: (rule, column, n_bad) nulls per column, one aggregate."""
    columns = columns or df.columns
    agg = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
    return (agg.unpivot([], columns, "column", "n_bad")
               .select(F.lit("null").alias("rule"), "column", F.col("n_bad").cast("long")))


def duplicate_rows(df: DataFrame) -> DataFrame:
    """Q2: full-row duplicates (each repeat after the first counts).

    Grouping on every column combines map-side, so hot duplicate groups stay cheap.
    """
    groups = df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("_n"))
    return groups.agg(F.sum("_n").cast("long").alias("n_rows"),
                      F.sum(F.col("_n") - 1).cast("long").alias("n_bad")) \
                 .select(F.lit("duplicate").alias("rule"), F.lit("*").alias("column"), "n_bad", "n_rows")


def schema_contract(df: DataFrame, expected: list[tuple[str, str]]) -> DataFrame:
    """Q3: expected columns (name, type) against a source table: found, same type, and rows with a value."""
    actual = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    counts = df.agg(*[(F.count(n) if n in actual else F.lit(0)).cast("long").alias(n) for n, _ in expected])
    rows = [F.struct(F.lit(i).alias("position"), F.lit(n).alias("expected"), F.lit(t).alias("expected_type"), F.lit(actual.get(n)).alias("actual_type"),
                     F.lit(actual.get(n) == t).alias("ok"), F.col(n).alias("n_present")) for i, (n, t) in enumerate(expected)]
    return counts.select(F.inline(F.array(*rows)))


def cadence_gaps(readings: DataFrame, minutes: int = 15, key: str = "station_id") -> DataFrame:
    """Q4: consecutive readings of a station whose spacing is not ``minutes``."""
    frame = framed(sequence_index(readings, key=key), key=key, halo=1)
    prev = F.lag("ts", 1).over(block_window(key))
    gaps = (frame.select(key, "reading_id", "ts", SEQ, HALO, prev.alias("prev_ts"))
                 .filter(~F.col(HALO) & F.col("prev_ts").isNotNull())
                 .withColumn("gap_seconds",
                             F.unix_micros("ts") / 1e6 - F.unix_micros("prev_ts") / 1e6))
    return gaps.filter(F.col("gap_seconds") != minutes * 60).drop(HALO)


def gap_summary(gaps: DataFrame, key: str = "station_id") -> DataFrame:
    return gaps.groupBy(key).agg(F.count(F.lit(1)).alias("n_bad"),
                                 F.round(F.max("gap_seconds"), 6).alias("max_gap_seconds"))


def range_violations(df: DataFrame, ranges: dict[str, tuple[float, float]] | None = None) -> DataFrame:
    """Q5 / Q7: values outside inclusive bounds, one aggregate for all columns."""
    ranges = ranges or VALID_RANGES
    agg = df.agg(*[F.count_if((F.col(c) < lo) | (F.col(c) > hi)).alias(c) for c, (lo, hi) in ranges.items()])
    long = agg.unpivot([], list(ranges), "column", "n_bad")
    bounds = df.sparkSession.createDataFrame([(c, float(lo), float(hi)) for c, (lo, hi) in ranges.items()],
                                             "column string, lo double, hi double")
    return (long.join(F.broadcast(bounds), "column")
                .select(F.lit("range").alias("rule"), "column", "lo", "hi", F.col("n_bad").cast("long")))


def likert_range(df: DataFrame, items: list[str] | None = None, lo: int = 1, hi: int = 5) -> DataFrame:
    """Q7."""
    return range_violations(df, {c: (lo, hi) for c in (items or LIKERT_ITEMS)})


def class_consistency(df: DataFrame, wqi: str = "wqi", cls: str = "quality_class") -> DataFrame:
    """Q6: stored class vs class derived from the index."""
    return df.agg(F.count_if(class_from_index(wqi) != F.col(cls)).cast("long").alias("n_bad"),
                  F.count(F.lit(1)).alias("n_rows")) \
             .select(F.lit("class_vs_index").alias("rule"), F.lit(cls).alias("column"), "n_bad", "n_rows")


def code_domain(df: DataFrame, domains: dict[str, list[int]] | None = None) -> DataFrame:
    """Q8: sorted distinct codes vs the expected domain, per variable."""
    domains = domains or DEMO_DOMAINS
    agg = df.agg(*[F.array_sort(F.collect_set(c)).alias(c) for c in domains])
    rows = [F.struct(F.lit(c).alias("column"), F.col(c).alias("observed"),
                     F.array(*[F.lit(v) for v in dom]).alias("expected")) for c, dom in domains.items()]
    out = agg.select(F.explode(F.array(*rows)).alias("r")).select("r.*")
    return out.select(
        "column",
        F.array_join("observed", ",").alias("observed"),
        F.array_join("expected", ",").alias("expected"),
        F.array_join(F.array_except("observed", "expected"), ",").alias("unexpected"),
        F.array_join(F.array_except("expected", "observed"), ",").alias("missing"),
        F.size(F.array_except("observed", "expected")).cast("long").alias("n_bad"))


def leakage_report(features: DataFrame, label: str = "anomaly", feature_cols: list[str] | None = None,
                   name_token: str = "turb", corr_limit: float = 0.95) -> DataFrame:
    """Q9: every feature's correlation with the label plus the name rule, one aggregate."""
    feature_cols = feature_cols or features_no_leak()
    agg = features.agg(*[F.corr(F.col(c), F.col(label).cast("double")).alias(c) for c in feature_cols])
    long = agg.unpivot([], feature_cols, "feature", "corr")
    return long.select(
        "feature", F.round("corr", 6).alias("corr"),
        F.lower("feature").contains(name_token).alias("leak_by_name"),
        (F.coalesce(F.abs("corr"), F.lit(0.0)) >= corr_limit).alias("leak_by_corr"))


#: Columns that tell the answer, and the mark of columns derived from the sensor that defines anomalies.
TARGET_COLUMNS = {"anomaly", "quality_class", "wqi"}
ANOMALY_TOKEN = "turb"


def guard_names(feature_cols: list[str], targets: set[str] | None = None, token: str | None = None) -> None:
    """Q9 by name, before any vector is built: no target among the features, no column with ``token`` in its name."""
    found = sorted((TARGET_COLUMNS if targets is None else targets) & set(feature_cols))
    found += [c for c in feature_cols if token and token in c.lower()]
    if found:
        raise QualityError(f"features that leak the target: {', '.join(found)}")


def guard_leakage(features: DataFrame, feature_cols: list[str], label: str = "anomaly", token: str | None = ANOMALY_TOKEN,
                  corr_limit: float = 0.95) -> None:
    """Q9 before training: by name, and by each feature's correlation with the label (one aggregate)."""
    guard_names(feature_cols, token=token)
    found = leakage_report(features, label, feature_cols, token or ANOMALY_TOKEN, corr_limit).filter("leak_by_corr").collect()     # a row per feature
    if found:
        raise QualityError("features that leak the target: " + ", ".join(f"{r.feature} (correlation {r['corr']})" for r in found))


def class_distribution(df: DataFrame, cls: str = "quality_class") -> DataFrame:
    """Q10: count and share per class (descending)."""
    counts = df.groupBy(cls).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("_t"))
    return (counts.crossJoin(F.broadcast(total))
                  .select(cls, "n", F.round(F.col("n") * 100.0 / F.col("_t"), 6).alias("pct"))
                  .orderBy(F.desc("n"), cls))


def describe(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Q11: count, mean, std, min, quartiles (exact, linear), max per column."""
    columns = columns or SENSORS
    moments = df.agg(*[F.struct(F.count(c).alias("count"), F.avg(c).alias("mean"),
                                F.stddev_samp(c).alias("std"), F.min(c).alias("min"),
                                F.max(c).alias("max")).alias(c) for c in columns])
    long = moments.unpivot([], columns, "variable", "m").select("variable", "m.*")
    qs = quantile_columns(df, columns, {"p25": 0.25, "p50": 0.5, "p75": 0.75})
    return long.join(qs, "variable").select(
        "variable", F.col("count").cast("long").alias("count"),
        *[F.round(c, 6).alias(c) for c in ["mean", "std", "min", "p25", "p50", "p75", "max"]])


def period_bounds(df: DataFrame, ts: str = "ts") -> DataFrame:
    """Q12: first and last date and the row count."""
    return df.agg(F.date_format(F.min(F.to_date(ts)), "yyyy-MM-dd").alias("first_date"),
                  F.date_format(F.max(F.to_date(ts)), "yyyy-MM-dd").alias("last_date"),
                  F.count(F.lit(1)).alias("n_rows"))


def feature_set_report(features: DataFrame) -> DataFrame:
    """F11 / Q9 by name: the ordered feature list with its membership flag, values present and variance per feature."""
    full, no_leak = features_full(), set(features_no_leak())
    stats = features.agg(*[F.struct(F.count(c).alias("n"), F.var_samp(c).alias("v")).alias(c) for c in full])
    rows = [F.struct(F.lit(i).alias("position"), F.lit(c).alias("feature"), F.lit(c in no_leak).alias("in_anomaly_set"),
                     F.col(c)["n"].alias("n_present"), F.round(F.col(c)["v"], 4).alias("variance")) for i, c in enumerate(full)]
    return stats.select(F.inline(F.array(*rows)))
