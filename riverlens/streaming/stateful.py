"""Stateful stream operators: readings in event-time order, per station.

``InOrder`` buffers a station's readings until the watermark has passed them
(later arrivals are behind the watermark and are dropped by Spark), then hands
them on in the order of (ts, reading_id), the order of the batch plans. So a
reading that is late within the watermark still takes its place.

* ``features_stream`` (T5): the 45 features; state is the last 16 readings.
* ``episodes_stream`` (T4 = A16): runs of consecutive non-green readings as a
  state machine; an open episode is closed by a green reading, or by a timer
  when its station stays silent.

State is bounded per station: the readings of one watermark delay, packed a
batch to a piece (values, no Python objects), and 16 readings or one episode;
due readings are handed on ``SLICE`` at a time. It lives in the state store under the stream's
checkpoint, so a restarted stream goes on where it stopped. One task handles a
station at a time; ``alerts.run_features`` is the way for backfills, where a
station may hold a large share of all rows (it splits stations into blocks).

Nulls and ties: readings without a station or a time are ignored; equal times
go by reading_id (nulls first); a null sensor value is ignored by rolling
means, deviations and maxima as in the batch plan.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..functions import levels as L
from ..operators.features import with_abs_delta, with_calendar, with_cyclic_hour, with_label, with_log_turbidity
from ..schema import LAG_ORDER, LAGS, MAX_LOOKBACK, ROLLING_WINDOWS, TURBIDITY_DIFFS

SLICE = 1 << 15     # readings handed on at a time
PIECE = T.StructType([T.StructField("low", T.LongType()), T.StructField("rows", T.BinaryType())])
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def state_store(spark: SparkSession):
    """The state store that these operators need, for streams started inside."""
    before = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        yield
    finally:
        spark.conf.set(PROVIDER, before)


def _fields(schema: T.StructType) -> T.StructType:
    """State schema of a reading: its columns without the key, the time as microseconds first."""
    own = [f for f in schema.fields if f.name not in ("station_id", "ts")]
    return T.StructType([T.StructField("at", T.LongType()), *[T.StructField(f.name, f.dataType) for f in own]])


def _pack(table: pa.Table) -> tuple[int, bytes]:
    """A piece of the state: the earliest time and the readings."""
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, table.schema) as writer:
        writer.write_table(table)
    return pc.min(table["at"]).as_py(), out.getvalue().to_pybytes()


class InOrder(StatefulProcessor):
    """Hands a station's readings on in time order once the watermark has passed them."""

    def __init__(self, schema: T.StructType):
        self.fields = _fields(schema)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pending = handle.getListState("pending", PIECE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        schema = to_arrow_schema(self.fields)
        for batch in rows:
            batch = batch[batch["ts"].notna()]
            if len(batch) and key[0] is not None:
                at = pa.array(batch["ts"].astype("datetime64[us]").astype("int64"))
                piece = _pack(pa.table([at, *(pa.array(batch[f.name], type=f.type, from_pandas=True) for f in list(schema)[1:])], schema=schema))
                self.pending.appendValue(piece)
                self._wake(piece[0])
        return iter(())

    def _wake(self, at: int) -> None:
        """A timer at the first millisecond after a time in microseconds."""
        self.handle.registerTimer(at // 1000 + 1)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        due = self._due(passed)
        for start in range(0, max(len(due), 1), SLICE):
            part = due.slice(start, SLICE)
            # a slice's end is as far as is known until the last one
            upto = passed if start + SLICE >= len(due) else part["at"][-1].as_py()
            out = self.ordered(key, part, upto)
            if out is not None and len(out):
                yield out

    def _due(self, passed: int) -> pa.Table:
        """The readings up to a time, in order; the others stay in the state."""
        due, later = [to_arrow_schema(self.fields).empty_table()], []
        for low, rows in (tuple(r) for r in self.pending.get()):
            if low > passed:
                later.append((low, bytes(rows)))
                continue
            table = pa.ipc.open_stream(rows).read_all()
            reached = pc.less_equal(table["at"], passed)
            due.append(table.filter(reached))
            rest = table.filter(pc.invert(reached))
            if len(rest):
                later.append(_pack(rest))
        if len(due) > 1:
            if later:
                self.pending.put(later)
                self._wake(min(low for low, _ in later))
            else:
                self.pending.clear()
        found = pa.concat_tables(due)
        return found.take(pc.sort_indices(found, sort_keys=[(n, "ascending") for n in self.fields.names[:2]], null_placement="at_start"))

    def ordered(self, key, rows: pa.Table, passed: int) -> pd.DataFrame | None:
        raise NotImplementedError

    def close(self) -> None:
        pass


def _times(at: np.ndarray) -> pd.Series:
    return pd.Series(pd.to_datetime(at, unit="us"))


# ------------------------------------------------------------------- T5
def frame_statistics(frames: np.ndarray) -> dict[str, np.ndarray]:
    """Mean, sample deviation and maximum of each frame's known values.

    Values are taken one after the other, as the batch plan's aggregates take
    them, so both give the same bits and models the same scores.
    """
    n, total = np.zeros(len(frames)), np.zeros(len(frames))
    mean, m2, top = np.zeros(len(frames)), np.zeros(len(frames)), np.full(len(frames), -np.inf)
    for x in frames.T:
        known = ~np.isnan(x)
        x = np.where(known, x, 0.0)
        n += known
        total += x
        gap = np.where(known, x - mean, 0.0)
        step = gap / np.maximum(n, 1)
        mean += step
        m2 += gap * (gap - step)
        top = np.where(known, np.maximum(top, x), top)
    some, more = n > 0, n > 1
    return {"mean": np.where(some, total / np.maximum(n, 1), np.nan), "std": np.where(more, np.sqrt(m2 / np.maximum(n - 1, 1)), np.nan),
            "max": np.where(some, top, np.nan)}


def series_features(values: dict[str, np.ndarray], start: int) -> dict[str, np.ndarray]:
    """Lags, differences and rolling statistics of the readings from ``start`` on; a frame is full once it lies within ``values``."""
    n = len(next(iter(values.values())))
    rows = np.arange(start, n)

    def lag(name: str, k: int) -> np.ndarray:
        return np.where(rows >= k, values[name][np.maximum(rows - k, 0)], np.nan)

    out = {f"{s}_lag{k}": lag(s, k) for k in LAGS for s in LAG_ORDER}
    out |= {f"turbidity_delta{d}": values["turbidity"][rows] - lag("turbidity", d) for d in TURBIDITY_DIFFS}
    out |= {f"{s}_delta1": values[s][rows] - lag(s, 1) for s in ("ph", "dissolved_oxygen", "temperature")}
    for w in ROLLING_WINDOWS:
        full = rows >= w - 1
        for sensor, statistics in (("turbidity", ("mean", "std", "max")), ("dissolved_oxygen", ("mean",))):
            padded = np.concatenate([np.full(w - 1, np.nan), values[sensor]])
            frames = np.lib.stride_tricks.sliding_window_view(padded, w)[rows]
            found = frame_statistics(frames)
            for statistic in statistics:
                out[f"{sensor}_{statistic}_{w}"] = np.where(full, found[statistic], np.nan)
    return out


class SeriesFeatures(InOrder):
    """State: the last 16 readings of a station, oldest first."""

    def __init__(self, schema: T.StructType, columns: list[str]):
        super().__init__(schema)
        self.columns = columns

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.last = handle.getListState("last", self.fields)

    def ordered(self, key, rows: pa.Table, passed: int) -> pd.DataFrame | None:
        if not len(rows):
            return None
        before = [tuple(r) for r in self.last.get()] if self.last.exists() else []
        every = pa.concat_tables([pa.Table.from_pylist([dict(zip(rows.column_names, r, strict=True)) for r in before], schema=rows.schema), rows])
        self.last.put([tuple(r.values()) for r in every.slice(max(0, len(every) - MAX_LOOKBACK)).to_pylist()])
        sensors = {s: every[s].cast(pa.float64()).to_numpy() for s in LAG_ORDER}
        # fewer than 16 readings before: these are among the station's first
        features = series_features(sensors, len(before))
        out = rows.drop_columns(["at"]).to_pandas(integer_object_nulls=True)
        out.insert(0, "ts", _times(rows["at"].to_numpy()))
        out.insert(0, "station_id", key[0])
        return pd.concat([out, pd.DataFrame(features)], axis=1)[self.columns]


def features_stream(readings: DataFrame, watermark: str = "1 hour") -> DataFrame:
    """T5: the features of a stream of readings, as columns of the same streaming query (all 45 and the label)."""
    probe = series_features({s: np.zeros(1) for s in LAG_ORDER}, 0)
    schema = T.StructType([*readings.schema.fields, *[T.StructField(c, T.DoubleType()) for c in probe]])
    out = readings.withWatermark("ts", watermark).groupBy("station_id").transformWithStateInPandas(
        statefulProcessor=SeriesFeatures(readings.schema, schema.names), outputStructType=schema, outputMode="Append", timeMode="EventTime")
    out = out.select(*readings.columns, *[F.nanvl(F.col(c), F.lit(None).cast("double")).alias(c) for c in probe])
    return with_abs_delta(with_label(with_log_turbidity(with_calendar(with_cyclic_hour(out)))))


# ------------------------------------------------------------------- T4
EPISODE = T.StructType([T.StructField("start_at", T.LongType()), T.StructField("end_at", T.LongType()), T.StructField("n", T.LongType()),
                        T.StructField("worst", T.IntegerType()), T.StructField("max_turbidity", T.DoubleType()), T.StructField("min_wqi", T.DoubleType())])
EPISODES = "station_id string, start_ts timestamp, end_ts timestamp, n_readings long, worst int, max_turbidity double, min_wqi double"


def _widest(pick, *values):
    known = [v for v in values if v is not None]
    return pick(known) if known else None


class Episodes(InOrder):
    """State: the open episode of a station. Rows carry ``severity``: 1 for green, more for worse levels."""

    def __init__(self, schema: T.StructType, idle_ms: int):
        super().__init__(schema)
        self.idle = idle_ms * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.open = handle.getValueState("open", EPISODE)

    def ordered(self, key, rows: pa.Table, passed: int) -> pd.DataFrame | None:
        names = self.fields.names
        severity, turbidity, wqi = (names.index(c) for c in ("severity", "turbidity", "wqi"))
        run = tuple(self.open.get()) if self.open.exists() else None
        had, closed = run, []
        for r in zip(*(c.to_pylist() for c in rows.columns), strict=True):
            if run and r[0] - run[1] > self.idle:       # the timer would have closed it
                closed.append(run)
                run = None
            if r[severity] is None or r[severity] <= 1:
                if run:
                    closed.append(run)
                run = None
            elif run:
                run = (run[0], r[0], run[2] + 1, max(run[3], r[severity]), _widest(max, run[4], r[turbidity]), _widest(min, run[5], r[wqi]))
            else:
                run = (r[0], r[0], 1, r[severity], r[turbidity], r[wqi])
        if run and passed - run[1] > self.idle:
            closed.append(run)
            run = None
        if run:
            self.open.update(run)
            self._wake(run[1] + self.idle)
        elif had:
            self.open.clear()
        if not closed:
            return None
        out = pd.DataFrame(closed, columns=["start_ts", "end_ts", "n_readings", "worst", "max_turbidity", "min_wqi"])
        for c in ("start_ts", "end_ts"):
            out[c] = _times(out[c].to_numpy())
        out.insert(0, "station_id", key[0])
        return out


def episodes_stream(leveled: DataFrame, level: str = "level_layer1", watermark: str = "2 hours", idle: str = "30 days") -> DataFrame:
    """T4: the episodes of A16 on a stream of readings with a level; one row when an episode closes.

    A station that stays silent for longer than ``idle`` closes its episode.
    """
    rows = leveled.withColumn("severity", L.layer_number(F.col(level)).cast("int")).select("station_id", "ts", "reading_id", "turbidity", "wqi", "severity")
    idle_ms = int(pd.Timedelta(idle).total_seconds() * 1000)
    return rows.withWatermark("ts", watermark).groupBy("station_id").transformWithStateInPandas(
        statefulProcessor=Episodes(rows.schema, idle_ms), outputStructType=EPISODES, outputMode="Append", timeMode="EventTime")
