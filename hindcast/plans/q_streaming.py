"""Queries: the stream forms of X3 and X8, run to completion with an
``availableNow`` trigger over files staged from the driver's tables, and
compared with the batch SQL (batch = stream)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from hindcast.operators.features import build_feature_matrix
from hindcast.operators.monitor import daily_sums
from hindcast.operators.split import panel_cutoff
from hindcast.plans.catalog import register
from hindcast.plans.q_monitor import _ROLL_SQL
from hindcast.plans.sqlgen import rounded
from hindcast.session import checkpoint_dir, cut_lineage
from hindcast.sources.panels import materialized
from hindcast.sources.readers import read_table
from hindcast.streaming.monitor_stream import hourly_volume_stream, latest, rolling_wmape_stream

#: scored rows of one staged file at most; eight files at least
ROWS_PER_FILE = 5_000_000
WATERMARK_DAYS = 31


def _stage(rows, order: str, path: str) -> None:
    """Files in the order of time, one after another, as a log would grow: the
    source takes them by their age."""
    n = max(8, -(-rows.count() // ROWS_PER_FILE))
    edges = rows.select(F.percentile_approx(F.col(order).cast("timestamp").cast("double"), [k / n for k in range(1, n)], 1000)).first()[0] or []
    at = F.col(order).cast("timestamp").cast("double")
    bounds = [None, *sorted(set(edges)), None]
    for lo, hi in zip(bounds, bounds[1:]):
        part = rows if lo is None else rows.where(at > lo)
        (part if hi is None else part.where(at <= hi)).coalesce(1).write.mode("append").parquet(path)


def _dirs(spark, name: str) -> tuple[str, str, str]:
    base = f"{checkpoint_dir(spark).rstrip('/')}/hindcast-stream/{name}-{uuid.uuid4().hex}"
    return f"{base}/source", f"{base}/sink", f"{base}/checkpoint"


@register(
    "stream_hourly_requests",
    ("X8",),
    "SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS n FROM events WHERE ts IS NOT NULL GROUP BY ALL",
    note="events replayed as files in the order of time, one per micro-batch, under the shipped watermark",
)
def q_stream_hourly_requests(spark, sf_dir):
    source, sink, ckpt = _dirs(spark, "hourly")
    _stage(read_table(spark, sf_dir, "events").where(F.col("ts").isNotNull()), "ts", source)
    q = hourly_volume_stream(spark, source, sink, ckpt, glob="*.parquet", max_files_per_trigger=1)
    q.awaitTermination()
    return latest(sink, spark, ["hour", "event_type"])


_CLOSED = f"SELECT rw.*, 0 AS n_late FROM rw, (SELECT max(day) AS last FROM rw) WHERE day + 1 <= last - {WATERMARK_DAYS}"


def _rolled(spark, sf_dir):
    df, spec = materialized("P2", spark, sf_dir)
    fm, _ = build_feature_matrix(df, spec)
    scored = fm.select(
        F.lit("roll7").alias("model"),
        F.col("ds"),
        F.col("y").alias("y_true"),
        F.col("roll_mean_7").alias("p50"),
        (F.col("ds") < panel_cutoff(fm, spec.horizon)).alias("is_train"),
    )
    scored = cut_lineage(scored)
    source, sink, ckpt = _dirs(spark, "rolling")
    _stage(scored.drop("is_train"), "ds", source)
    val = scored.where("is_train").groupBy("model").agg(*daily_sums()).select("model", (F.col("abs_err") / F.col("abs_y")).alias("wmape"))
    q = rolling_wmape_stream(spark, source, sink, ckpt, cut_lineage(val), max_files_per_trigger=1)
    q.awaitTermination()
    return spark.read.parquet(sink)


@register(
    "stream_rolling_wmape",
    ("X3",),
    rounded(_ROLL_SQL + _CLOSED, ["wmape_rolling", "wmape_validation"], ["model", "day", "n_unscored", "n_late", "breach"]),
    note="scored rows replayed in micro-batches under the shipped watermark; every closed day once, from a ring of daily sums",
)
def q_stream_rolling_wmape(spark, sf_dir):
    return _rolled(spark, sf_dir).drop("retrain", "wmape_before").withColumn("n_late", F.col("n_late").cast("int"))


@register(
    "stream_retrain_trigger",
    ("X9",),
    rounded(
        _ROLL_SQL
        + f""", ev AS (
  SELECT model, day, breach, lag(breach) OVER (PARTITION BY model ORDER BY day) AS prev_breach,
         lag(wmape_rolling) OVER (PARTITION BY model ORDER BY day) AS wmape_before, wmape_rolling AS wmape_after
  FROM rw
)
SELECT model, day, wmape_before, wmape_after FROM ev, (SELECT max(day) AS last FROM rw)
WHERE day + 1 <= last - {WATERMARK_DAYS} AND breach AND NOT coalesce(prev_breach, false)""",
        ["wmape_before", "wmape_after"],
        ["model", "day"],
    ),
    note="breach onsets raised by the stream's state",
)
def q_stream_retrain_trigger(spark, sf_dir):
    rolled = _rolled(spark, sf_dir).where("retrain")
    return rolled.select("model", "day", "wmape_before", F.col("wmape_rolling").alias("wmape_after"))
