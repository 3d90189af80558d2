"""Stream forms of the time-based monitors.

X8: file stream source with an explicit schema -> event-time watermark ->
windowed aggregation in *update* mode (state older than the watermark is
dropped) -> ``foreachBatch`` sink that appends every updated row tagged with its
batch id. Readers take the latest row per key, so a replayed micro-batch (after
a failure) is harmless and the final table equals the batch computation.

X3 and X9: tasks add scored rows up to daily sums, so that a model's rows meet as
a few sums however many there are. State is kept per model: the sums of days that
the watermark has not closed, a ring of the last closed days' sums, and the last
breach flag. When the watermark closes a day, by new rows or by a timer, it
becomes one row with its rolling WMAPE and, where the flag turns on, the
retraining edge; the file sink writes it exactly once. Rows of a closed day are
late: they are left out and counted on the next day that is written.

Checkpoints live under the cluster's shared checkpoint directory.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from hindcast.operators.monitor import BREACH_RATIO

EVENTS_SCHEMA = T.StructType(
    [
        T.StructField("event_id", T.LongType()),
        T.StructField("ts", T.TimestampNTZType()),
        T.StructField("user_id", T.LongType()),
        T.StructField("event_type", T.StringType()),
        T.StructField("value", T.DoubleType()),
        T.StructField("props", T.StringType()),
    ]
)

SCORED_SCHEMA = T.StructType(
    [
        T.StructField("model", T.StringType()),
        T.StructField("ds", T.DateType()),
        T.StructField("y_true", T.DoubleType()),
        T.StructField("p50", T.DoubleType()),
    ]
)


def _upsert_sink(path: str):
    def write(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("batch_id", F.lit(batch_id).cast("long")).write.mode("append").parquet(path)

    return write


def latest(path: str, spark: SparkSession, keys: list[str]) -> DataFrame:
    """Final table of an update-mode sink: the last version of every key."""
    df = spark.read.parquet(path)
    w = Window.partitionBy(*keys).orderBy(F.col("batch_id").desc())
    return df.withColumn("__rn", F.row_number().over(w)).where(F.col("__rn") == 1).drop("__rn", "batch_id")


def hourly_volume_stream(
    spark: SparkSession,
    source_dir: str,
    sink_path: str,
    checkpoint: str,
    *,
    glob: str = "events.parquet",
    watermark: str = "2 hours",
    available_now: bool = True,
    max_files_per_trigger: int = 1000,
) -> StreamingQuery:
    """X8 on a stream: requests per (one-hour window, event_type)."""
    src = (
        spark.readStream.schema(EVENTS_SCHEMA)
        .option("pathGlobFilter", glob)
        .option("maxFilesPerTrigger", max_files_per_trigger)
        .parquet(source_dir)
    )
    agg = (
        src.withColumn("ets", F.col("ts").cast("timestamp"))
        .withWatermark("ets", watermark)
        .groupBy(F.window("ets", "1 hour"), "event_type")
        .agg(F.count(F.lit(1)).alias("n"))
        .select(F.col("window.start").cast("timestamp_ntz").alias("hour"), "event_type", "n")
    )
    w = agg.writeStream.outputMode("update").foreachBatch(_upsert_sink(sink_path)).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="1 minute")
    return w.start()


_STATE = (
    "open_days array<int>, open_err array<double>, open_y array<double>, open_unscored array<long>, "
    "ring_days array<int>, ring_err array<double>, ring_y array<double>, breach boolean, wmape double, late long, wmape_validation double"
)
ROLLED = (
    "model string, day date, n_unscored long, n_late long, wmape_rolling double, wmape_validation double, breach boolean, "
    "retrain boolean, wmape_before double"
)
_SUMS = "model string, day int, ets timestamp, abs_err double, abs_y double, n_unscored long, n long"
_EPOCH = dt.date(1970, 1, 1)
_DAY_MS = 86_400_000


def _daily(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A partition's scored rows as sums per model and day."""
    parts: list[pa.Table] = []
    for batch in batches:
        y, p = batch.column("y_true").to_numpy(zero_copy_only=False), batch.column("p50").to_numpy(zero_copy_only=False)
        there = ~np.isnan(y) & ~np.isnan(p)
        cols = {
            "model": batch.column("model"),
            "day": batch.column("ds").cast(pa.int32()),
            "abs_err": np.where(there, np.abs(y - p), 0.0),
            "abs_y": np.where(there, np.abs(y), 0.0),
            "n_unscored": (~there).astype(np.int64),
            "n": np.ones(len(y), dtype=np.int64),
        }
        table = pa.table(cols).filter(pc.is_valid(batch.column("ds")))
        parts = [_added(pa.concat_tables([*parts, table]))]
    for table in parts:
        if not len(table):
            continue
        # Spark drops rows by their event time before the state is asked, and does not count what they
        # stand for. Sums have none, so none is dropped; a row without sums carries the latest to the watermark
        latest_day = pc.max(table.column("day")).as_py()
        mark = {"model": table.column("model")[:1], "day": pa.nulls(1, pa.int32()), "abs_err": [0.0], "abs_y": [0.0], "n_unscored": [0], "n": [0]}
        table = pa.concat_tables([table, pa.table(mark).cast(table.schema)])
        at = pa.array([None] * (len(table) - 1) + [latest_day * 1000 * _DAY_MS], pa.int64()).cast(pa.timestamp("us", tz="UTC"))
        yield from table.append_column("ets", at).select([c.split()[0] for c in _SUMS.split(", ")]).combine_chunks().to_batches()


def _added(table: pa.Table) -> pa.Table:
    names = ["abs_err", "abs_y", "n_unscored", "n"]
    return table.group_by(["model", "day"]).aggregate([(n, "sum") for n in names]).rename_columns(["model", "day", *names])


class _Model:
    """The state of one model."""

    def __init__(self, held):
        if held is None:
            self.open, self.ring, self.breach, self.wmape, self.late, self.limit = {}, [], False, None, 0, None
            return
        d, e, y, u, rd, re, ry, self.breach, self.wmape, self.late, self.limit = held
        self.open = {k: [a, b, c] for k, a, b, c in zip(d, e, y, u)}
        self.ring = list(zip(rd, re, ry))

    def held(self):
        days = sorted(self.open)
        opened = [[self.open[k][i] for k in days] for i in range(3)]
        return (days, *opened, *([x[i] for x in self.ring] for i in range(3)), self.breach, self.wmape, self.late, self.limit)

    def add(self, day: int, err: float, y: float, unscored: int) -> None:
        sums = self.open.setdefault(day, [0.0, 0.0, 0])
        for i, v in enumerate((err, y, unscored)):
            sums[i] += v

    def close(self, model: str, watermark: int, days: int, ratio: float) -> list[tuple]:
        """The rows of all days that end by the watermark."""
        out = []
        for day in sorted(d for d in self.open if (d + 1) * _DAY_MS <= watermark):
            err, y, unscored = self.open.pop(day)
            self.ring = [x for x in self.ring if x[0] > day - days] + [(day, err, y)]
            total = sum(x[2] for x in self.ring)
            wmape = sum(x[1] for x in self.ring) / total if total else None
            now = wmape is not None and self.limit is not None and wmape > ratio * self.limit
            out.append((model, _EPOCH + dt.timedelta(days=day), unscored, self.late, wmape, self.limit, now, now and not self.breach, self.wmape))
            self.breach, self.wmape, self.late = now, wmape, 0
        return out


def _roll(key, frames: Iterator[pd.DataFrame], state: GroupState, days: int, ratio: float, keep_days: int) -> Iterator[pd.DataFrame]:
    watermark = state.getCurrentWatermarkMs()
    m = _Model(state.get if state.exists else None)
    out = m.close(key[0], watermark, days, ratio)
    if state.hasTimedOut and not m.open and not out:
        state.remove()  # silent for keep_days
        return
    for r in (r for f in frames for r in f.itertuples()):
        m.limit = None if pd.isna(r.wmape_validation) else float(r.wmape_validation)
        if pd.isna(r.day):
            continue
        if (r.day + 1) * _DAY_MS <= watermark:
            m.late += int(r.n)
        else:
            m.add(int(r.day), float(r.abs_err), float(r.abs_y), int(r.n_unscored))
    state.update(m.held())
    # the timer: when the first open day closes, or the model has been silent for long
    due = (min(m.open) + 1) * _DAY_MS - 1 if m.open else ((m.ring[-1][0] if m.ring else 0) + keep_days) * _DAY_MS
    state.setTimeoutTimestamp(max(due, watermark + 1))
    if out:
        yield pd.DataFrame(out, columns=[c.split()[0] for c in ROLLED.split(", ")])


def rolling_wmape_stream(
    spark: SparkSession,
    source_dir: str,
    sink_path: str,
    checkpoint: str,
    validation: DataFrame,
    *,
    days: int = 30,
    ratio: float = BREACH_RATIO,
    watermark: str = "31 days",
    keep_days: int = 366,
    available_now: bool = True,
    max_files_per_trigger: int = 1000,
) -> StreamingQuery:
    """X3 and X9 on a stream of scored rows ``(model, ds, y_true, p50)``: a row
    per model and day once the watermark has closed the day, equal to the batch
    frame ``RANGE BETWEEN days-1 PRECEDING AND CURRENT ROW``; ``retrain`` marks
    days on which the breach flag turns on, ``n_late`` counts rows that came
    after their day was closed. ``validation``: (model, wmape). Rows without a
    date are left out; a model that is silent for ``keep_days`` loses its state."""
    src = spark.readStream.schema(SCORED_SCHEMA).option("maxFilesPerTrigger", max_files_per_trigger).parquet(source_dir)
    sums = src.mapInArrow(_daily, _SUMS).withWatermark("ets", watermark)
    sums = sums.join(validation.select("model", F.col("wmape").cast("double").alias("wmape_validation")), "model", "left")
    roll = partial(_roll, days=days, ratio=ratio, keep_days=keep_days)
    out = sums.groupBy("model").applyInPandasWithState(roll, ROLLED, _STATE, "append", GroupStateTimeout.EventTimeTimeout)
    w = out.writeStream.outputMode("append").format("parquet").option("path", sink_path).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="1 minute")
    return w.start()
