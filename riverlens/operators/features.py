"""Temporal features F1-F12: one exchange, one sort, many window columns."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.ordering import (BLOCK, DEFAULT_BLOCK_ROWS, HALO, SEQ, block_window,
                              framed, sequence_index)
from ..schema import (ANOMALY_TURBIDITY, LAG_ORDER, LAGS, MAX_LOOKBACK, ROLLING_WINDOWS,
                      TURBIDITY_DIFFS, features_full, features_no_leak)

__all__ = ["with_cyclic_hour", "with_calendar", "with_lags", "with_deltas", "with_rolling",
           "with_log_turbidity", "with_label", "drop_incomplete", "with_abs_delta",
           "build_features", "features_full", "features_no_leak", "ordered_frame"]


def with_cyclic_hour(df: DataFrame, ts: str = "ts") -> DataFrame:
    """hour of day on the unit circle."""
    angle = 2 * math.pi * F.hour(ts) / 24
    return df.withColumn("hour_sin", F.sin(angle)).withColumn("hour_cos", F.cos(angle))


def with_calendar(df: DataFrame, ts: str = "ts") -> DataFrame:
    """weekday (Monday = 0) and day of month."""
    return (df.withColumn("weekday", F.weekday(ts))
              .withColumn("day_of_month", F.dayofmonth(ts)))


def _lag_columns(w: Window) -> list[Column]:
    return [F.lag(s, k).over(w).alias(f"{s}_lag{k}") for k in LAGS for s in LAG_ORDER]


def _delta_columns(w: Window) -> list[Column]:
    cols = [(F.col("turbidity") - F.lag("turbidity", d).over(w)).alias(f"turbidity_delta{d}")
            for d in TURBIDITY_DIFFS]
    cols += [(F.col(s) - F.lag(s, 1).over(w)).alias(f"{s}_delta1")
             for s in ["ph", "dissolved_oxygen", "temperature"]]
    return cols


def _full(agg: Column, n: int, w: Window) -> Column:
    """Rolling aggregate that is null until the frame holds ``n`` rows (min_periods = n).

    ``seq`` is the row's position in its station, so the frame is full exactly
    when seq >= n - 1 (block frames see the previous block through the halo);
    no extra counting window is needed.
    """
    frame = w.rowsBetween(-(n - 1), 0)
    return F.when(F.col(SEQ) >= n - 1, agg.over(frame))


def _rolling_columns(w: Window) -> list[Column]:
    cols = []
    for n in ROLLING_WINDOWS:
        cols += [
            _full(F.avg("turbidity"), n, w).alias(f"turbidity_mean_{n}"),
            _full(F.stddev_samp("turbidity"), n, w).alias(f"turbidity_std_{n}"),
            _full(F.max("turbidity"), n, w).alias(f"turbidity_max_{n}"),
            _full(F.avg("dissolved_oxygen"), n, w).alias(f"dissolved_oxygen_mean_{n}"),
        ]
    return cols


def ordered_frame(readings: DataFrame, key: str = "station_id", halo: int = MAX_LOOKBACK,
                  block_rows: int = DEFAULT_BLOCK_ROWS) -> DataFrame:
    """readings + seq/block/is_halo, ready for ``block_window``."""
    return framed(sequence_index(readings, key=key), key=key, halo=halo, block_rows=block_rows)


def _apply_window_columns(readings: DataFrame, builders, key: str, block_rows: int) -> DataFrame:
    frame = ordered_frame(readings, key=key, block_rows=block_rows)
    w = block_window(key)
    cols = [c for b in builders for c in b(w)]
    return frame.select("*", *cols).filter(~F.col(HALO)).drop(HALO)


def with_lags(df: DataFrame, key: str = "station_id", block_rows: int = DEFAULT_BLOCK_ROWS) -> DataFrame:
    """row lags 1, 2, 4, 8, 16 of the four sensors."""
    return _apply_window_columns(df, [_lag_columns], key, block_rows)


def with_deltas(df: DataFrame, key: str = "station_id", block_rows: int = DEFAULT_BLOCK_ROWS) -> DataFrame:
    """turbidity differences 1/4/8 and first differences of the other sensors."""
    return _apply_window_columns(df, [_delta_columns], key, block_rows)


def with_rolling(df: DataFrame, key: str = "station_id", block_rows: int = DEFAULT_BLOCK_ROWS) -> DataFrame:
    """Full-window rolling mean/std/max (4, 8, 16 rows)."""
    return _apply_window_columns(df, [_rolling_columns], key, block_rows)


def with_log_turbidity(df: DataFrame) -> DataFrame:
    """F8."""
    return df.withColumn("turbidity_log", F.log1p("turbidity"))


def with_label(df: DataFrame, threshold: float = ANOMALY_TURBIDITY) -> DataFrame:
    """anomaly = turbidity > threshold (0/1)."""
    return df.withColumn("anomaly", (F.col("turbidity") > threshold).cast("int"))


def drop_incomplete(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """drop rows with a null in any feature (the first 16 of each station)."""
    return df.dropna(subset=columns)


def with_abs_delta(df: DataFrame) -> DataFrame:
    """absolute first difference of turbidity."""
    return df.withColumn("turbidity_delta1_abs", F.abs("turbidity_delta1"))


def build_features(readings: DataFrame, key: str = "station_id", dropna: bool = True,
                   block_rows: int = DEFAULT_BLOCK_ROWS) -> DataFrame:
    """F1-F10 and F12 in one pass: all window columns share one (key, block) window."""
    out = _apply_window_columns(readings, [_lag_columns, _delta_columns, _rolling_columns],
                                key, block_rows)
    out = with_label(with_log_turbidity(with_calendar(with_cyclic_hour(out))))
    out = with_abs_delta(out)
    if dropna:
        out = drop_incomplete(out, features_full())
    return out
