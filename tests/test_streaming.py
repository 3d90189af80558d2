"""The stateful stream of rolling WMAPE: late rows, bounded state, days once."""

from __future__ import annotations

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from hindcast.operators import monitor as MON
from hindcast.streaming.monitor_stream import SCORED_SCHEMA, _Model, rolling_wmape_stream

START = dt.date(2024, 1, 1)


def scored(spark, days, models=("a", "b"), per_day=3, seed=0):
    rng = np.random.default_rng(seed)
    rows = []
    for m in models:
        for d in days:
            for _ in range(per_day):
                y = float(rng.uniform(5, 15))
                off = float(rng.normal(0, 1 if d < 60 else 4))
                rows.append((m, START + dt.timedelta(days=int(d)), y if rng.random() > 0.1 else None, y + off))
    return spark.createDataFrame(rows, SCORED_SCHEMA)


def replay(spark, tmp_path, files, val, **kw):
    source, sink = str(tmp_path / "source"), str(tmp_path / "sink")
    queries = []
    for df in files:  # one file, then one run: the checkpoint carries the state on
        df.coalesce(1).write.mode("append").parquet(source)
        q = rolling_wmape_stream(spark, source, sink, str(tmp_path / "ckpt"), val, max_files_per_trigger=1, **kw)
        q.awaitTermination()
        queries.append(q)
    return spark.read.parquet(sink), queries


def test_days_are_written_once_and_equal_the_batch(spark, tmp_path):
    days = [d for d in range(100) if d not in (30, 31, 50)]
    whole = scored(spark, days).cache()
    val = spark.createDataFrame([("a", 0.1)], "model string, wmape double")  # none for b
    at = [START + dt.timedelta(days=k) for k in (0, 35, 70, 100)]
    files = [whole.where((F.col("ds") >= F.lit(lo)) & (F.col("ds") < F.lit(hi))) for lo, hi in zip(at, at[1:])]
    got, _ = replay(spark, tmp_path, files, val, watermark="10 days")
    got = {(r["model"], r["day"]): r for r in got.collect()}
    last = max(START + dt.timedelta(days=d) for d in days) - dt.timedelta(days=10)
    want = {(r["model"], r["day"]): r for r in MON.rolling_wmape(whole, val).collect() if r["day"] + dt.timedelta(days=1) <= last}
    assert set(got) == set(want) and len(got) > 160
    for k, w in want.items():
        assert got[k]["n_unscored"] == w["n_unscored"] and got[k]["n_late"] == 0 and got[k]["breach"] == w["breach"]
        assert got[k]["wmape_rolling"] == pytest.approx(w["wmape_rolling"], rel=1e-12)
    edges = {k for k, r in got.items() if r["retrain"]}
    want_edges = {(r["model"], r["day"]) for r in MON.retrain_events(MON.rolling_wmape(whole, val), 1000).collect() if (r["model"], r["day"]) in want}
    assert edges == want_edges and edges and {m for m, _ in edges} == {"a"}


def test_late_rows_are_counted_and_left_out(spark, tmp_path):
    val = spark.createDataFrame([("a", 0.1)], "model string, wmape double")
    first, late = scored(spark, range(0, 60), ("a",)), scored(spark, [5, 6], ("a",), 4, seed=9)
    later = scored(spark, range(60, 90), ("a",), seed=1)
    got, _ = replay(spark, tmp_path, [first, late.unionByName(later)], val, watermark="10 days")
    rows = {r["day"]: r for r in got.collect()}
    assert sum(r["n_late"] for r in rows.values()) == 8
    want = {r["day"]: r for r in MON.rolling_wmape(first.unionByName(later), val).collect()}
    assert all(r["wmape_rolling"] == pytest.approx(want[d]["wmape_rolling"], rel=1e-12) for d, r in rows.items())


def test_state_is_bounded():
    m = _Model(None)
    for day in range(2000):
        m.add(day, 1.0, 10.0, 0)
        m.close("a", (day - 9) * 86_400_000, 30, 1.2)
        m = _Model(m.held())
        assert len(m.ring) <= 30 and len(m.open) <= 11


def test_silent_model_loses_its_state(spark, tmp_path):
    val = spark.createDataFrame([("a", 0.1)], "model string, wmape double")
    files = [scored(spark, range(0, 20), ("a", "b")), scored(spark, range(20, 120), ("b",)), scored(spark, range(120, 140), ("b",))]
    got, queries = replay(spark, tmp_path, files, val, watermark="5 days", keep_days=40)
    assert queries[-1].lastProgress["stateOperators"][0]["numRowsTotal"] == 1
    assert got.where("model = 'a'").count() == 20
