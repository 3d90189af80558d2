"""Monitoring operators (X1-X12) and profile checks."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from hindcast.operators import monitor as MON
from hindcast.operators.profile import column_profile, profile_violations


def test_psi_zero_for_same_distribution(spark):
    df = spark.range(1000).select((F.col("id") % 37).cast("double").alias("x"))
    p = MON.psi(df, df, ["x"]).first()["psi"]
    assert p == pytest.approx(0.0, abs=1e-12)


def test_psi_flags_shift(spark):
    ref = spark.range(1000).select((F.col("id") % 100).cast("double").alias("x"))
    cur = spark.range(1000).select((F.col("id") % 100 + 60).cast("double").alias("x"))
    s = MON.psi_status(MON.psi(ref, cur, ["x"])).first()
    assert s["psi"] > 0.2 and s["status"] == "red" and s["drift"]


def test_profile_and_violations(spark):
    a = spark.createDataFrame([(1.0, dt.date(2020, 1, 1), "x"), (5.0, dt.date(2020, 2, 1), "y")], "v double, d date, s string")
    b = spark.createDataFrame([(0.0, dt.date(2020, 3, 1), 1)], "v double, d date, extra int")
    pa = column_profile(a)
    rows = {r["column"]: r for r in pa.collect()}
    assert rows["v"]["min_num"] == 1.0 and rows["v"]["max_num"] == 5.0
    assert rows["d"]["max_str"] == "2020-02-01" and rows["s"]["min_num"] is None
    v = {(r["column"], r["kind"]) for r in profile_violations(pa, column_profile(b)).collect()}
    assert ("s", "missing") in v and ("extra", "extra") in v
    assert ("v", "below_min") in v and ("d", "above_max") in v


def test_promotion_gate(spark):
    board = spark.createDataFrame([("new", 0.09), ("prod", 0.10)], "model string, wmape double")
    assert MON.promotion_gate(board, "new", "prod", 0.05).first()["promote"]
    assert not MON.promotion_gate(board, "new", "prod", 0.2).first()["promote"]


def test_shadow_split_is_deterministic_and_near_ten_percent(spark):
    df = spark.range(20000).select(F.col("id").alias("k"))
    a = df.select(MON.shadow_arm(F.col("k")).alias("arm")).groupBy("arm").count().collect()
    b = df.select(MON.shadow_arm(F.col("k")).alias("arm")).groupBy("arm").count().collect()
    assert sorted(map(tuple, a)) == sorted(map(tuple, b))
    share = {r["arm"]: r["count"] for r in a}["shadow"] / 20000
    assert 0.08 < share < 0.12


def test_rolling_wmape_and_trigger(spark):
    rows = []
    for i in range(60):
        day = dt.date(2024, 1, 1) + dt.timedelta(days=i)
        err = 1.0 if i < 30 else 5.0
        rows.append(("m", day, 10.0, 10.0 + err))
    scored = spark.createDataFrame(rows, "model string, ds date, y_true double, p50 double")
    val = spark.createDataFrame([("m", 0.1)], "model string, wmape double")
    r = MON.rolling_wmape(scored, val).orderBy("day").collect()
    assert r[0]["wmape_rolling"] == pytest.approx(0.1)
    assert r[-1]["wmape_rolling"] == pytest.approx(0.5)
    ev = MON.retrain_events(MON.rolling_wmape(scored, val)).collect()
    assert len(ev) == 1 and ev[0]["wmape_before"] <= 0.12


def test_request_volume(spark):
    base = dt.datetime(2024, 1, 10, 12)
    rows = [(base - dt.timedelta(hours=h),) for h in (0, 1, 23, 25, 24 * 6, 24 * 8)]
    df = spark.createDataFrame(rows, "ts timestamp_ntz")
    r = MON.request_volume(df).first()
    assert (r["n_24h"], r["n_7d"]) == (3, 5)


def test_psi_quantile_edges(spark):
    ref = spark.range(1000).select((F.col("id") % 100).cast("double").alias("x"))
    same = MON.psi_flagged(ref.withColumn("r", F.lit(True)).unionByName(ref.withColumn("r", F.lit(False))), "r", ["x"], edges="quantile")
    assert same.first()["psi"] == pytest.approx(0.0, abs=1e-12)
    cur = spark.range(1000).select((F.col("id") % 100 + 60).cast("double").alias("x"))
    both = ref.withColumn("r", F.lit(True)).unionByName(cur.withColumn("r", F.lit(False)))
    assert MON.psi_flagged(both, "r", ["x"], edges="quantile").first()["psi"] > 0.2
