"""Mergeable states, as-of joins, Kolmogorov-Smirnov distance."""

from __future__ import annotations

import datetime as dt
import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from hindcast.operators import monitor as MON
from hindcast.operators.asof import as_of_join
from hindcast.operators.distribution import ks_distance
from hindcast.operators.states import feature_states, label_drift, merge_profiles, merge_states, profile_of, profile_state, psi_of_states

# -- states ---------------------------------------------------------------------


@pytest.fixture(scope="module")
def days(spark):
    rng = np.random.default_rng(3)
    rows = [(d, float(rng.normal(d / 20, 2)), float(rng.integers(0, 7)), 5.0, None if rng.random() < 0.2 else float("nan") if rng.random() < 0.1 else 1.0 * d) for d in range(40) for _ in range(300)]
    return spark.createDataFrame(rows, "day int, x double, k double, flat double, holes double").cache()


@pytest.mark.parametrize("edges", ["uniform", "quantile"])
def test_psi_of_states_is_near_that_of_rows(days, edges):
    names = ["x", "k", "flat"]
    states = feature_states(days, names, ["day"])
    got = {r["feature"]: r for r in psi_of_states(states, F.col("day") < 30, edges=edges).collect()}
    want = {r["feature"]: r["psi"] for r in MON.psi_flagged(days.withColumn("r", F.col("day") < 30), "r", names, edges=edges).collect()}
    assert set(got) == set(want)
    for f, p in want.items():
        assert got[f]["psi"] == pytest.approx(p, abs=0.01) and (got[f]["n_ref"], got[f]["n_cur"]) == (9000, 3000)


def test_states_merge_in_any_order_and_late(days):
    names = ["x", "holes"]
    whole = {r["feature"]: r for r in feature_states(days, names).collect()}
    early, late = days.where("day <> 7"), days.where("day = 7")
    once = merge_states(feature_states(early, names, ["day"]))
    got = {r["feature"]: r for r in merge_states(once.unionByName(merge_states(feature_states(late, names, ["day"])))).collect()}
    for f, w in whole.items():
        assert all(got[f][c] == w[c] for c in ("n", "n_missing", "lo", "hi"))
    assert got["holes"]["n_missing"] > 2000 and got["holes"]["n"] + got["holes"]["n_missing"] == 12000
    middle = merge_states(feature_states(days, names, ["day"])).select("feature", F.kll_sketch_get_quantile_double("q", F.lit(0.5)).alias("m"))
    m = {r["feature"]: r["m"] for r in middle.collect()}["x"]
    assert abs(days.where(F.col("x") <= m).count() / 12000 - 0.5) < 0.005


def test_states_of_nothing(days):
    none = feature_states(days.limit(0), ["x"], ["day"])
    assert none.collect() == [] and psi_of_states(none, F.col("day") < 3).collect() == []
    one = psi_of_states(feature_states(days, ["x"], ["day"]), F.lit(True)).collect()
    assert one[0]["n_cur"] == 0 and one[0]["psi"] is None


def test_profile_of_union_is_merge_of_profiles(spark):
    rng = np.random.default_rng(1)
    rows = [(int(k), float(rng.normal()) if k % 7 else float("nan"), dt.date(2024, 1, 1) + dt.timedelta(days=int(k % 90)), f"l{min(int(rng.exponential(3)), 9)}" if k % 11 else None, bool(k % 2)) for k in range(3000)]
    df = spark.createDataFrame(rows, "id int, v double, d date, label string, flag boolean").cache()
    parts = [df.where(F.col("id") % 3 == k) for k in range(3)]
    states = profile_state(parts[0], "a").unionByName(profile_state(parts[1], "b")).unionByName(profile_state(parts[2], "c"))
    got = {r["column"]: r for r in profile_of(merge_profiles(states)).collect()}
    want = {r["column"]: r for r in profile_of(merge_profiles(profile_state(df, "all"))).collect()}
    plain = lambda r: [r[c] for c in ("dtype", "n", "n_null", "min_num", "max_num", "min_str", "max_str")]
    for c, w in want.items():
        # a merged sketch estimates by another rule than one that saw all values
        assert plain(got[c]) == plain(w) and got[c]["n_distinct"] == pytest.approx(w["n_distinct"], rel=0.03)
        assert Counter(map(tuple, got[c]["top_labels"] or [])) == Counter(map(tuple, w["top_labels"] or []))
    assert abs(got["id"]["n_distinct"] - 3000) < 150 and got["v"]["n_null"] == len([k for k in range(3000) if k % 7 == 0])
    counts = Counter(r[3] for r in rows if r[3])
    assert {x["item"]: x["count"] for x in got["label"]["top_labels"] if x["item"]} == counts


def test_label_drift_names_new_gone_and_moved_labels(spark):
    ref = spark.createDataFrame([("a",)] * 50 + [("b",)] * 40 + [("old",)] * 10 + [(None,)] * 30, "c string")
    cur = spark.createDataFrame([("a",)] * 30 + [("b",)] * 42 + [("new",)] * 28, "c string")
    states = [merge_profiles(profile_state(x, n)) for x, n in ((ref, "r"), (cur, "c"))]
    got = {(r["label"], r["kind"]): (r["ref_share"], r["cur_share"]) for r in label_drift(*states).collect()}
    assert got == {("a", "share"): (0.5, 0.3), ("old", "gone"): (0.1, 0.0), ("new", "new"): (0.0, 0.28)}


# -- as-of ------------------------------------------------------------------------


@pytest.mark.parametrize("stretch", [None, 5, 1000])
def test_as_of_join_equals_brute_force(spark, stretch):
    rng = np.random.default_rng(8)
    start = dt.datetime(2024, 1, 1)
    when = lambda: start + dt.timedelta(hours=int(rng.integers(0, 24 * 60)))
    hot = lambda: "hot" if rng.random() < 0.6 else str(rng.integers(0, 5))
    left = [(hot(), when(), int(k)) for k in range(400)] + [("hot", None, 1000), (None, when(), 1001), ("none", when(), 1002)]
    left += left[:3]
    right = [(hot(), when(), int(rng.integers(0, 50)), None if rng.random() < 0.1 else float(k)) for k in range(300)] + [("hot", None, 1, 1.0), (None, start, 1, 1.0)]
    right += [("hot", left[0][1], 49, 7.5), ("hot", left[0][1], 49, 8.5), ("hot", left[0][1], 3, 9.5)]
    L = spark.createDataFrame(left, "key string, asked timestamp, n int").repartition(4)
    R = spark.createDataFrame(right, "key string, made timestamp, v int, w double").repartition(3)
    got = Counter((r["key"], r["asked"], r["n"], r["made"], r["v"], r["w"]) for r in as_of_join(L, R, ["key"], "asked", "made", ["v", "w"], stretch).collect())
    want = Counter()
    for key, asked, n in left:
        hits = [r for r in right if key is not None and asked is not None and r[0] == key and r[1] is not None and r[1] <= asked]
        best = max(hits, key=lambda r: (r[1], r[2], r[3] is not None, r[3] or 0.0), default=(None,) * 4)
        want[(key, asked, n, *best[1:])] += 1
    assert got == want
    assert as_of_join(L.limit(0), R, ["key"], "asked", "made", ["v", "w"], stretch).collect() == []
    assert as_of_join(L, R.limit(0), ["key"], "asked", "made", ["v"], stretch).where("v IS NOT NULL").count() == 0


def test_as_of_join_has_no_range_condition_in_a_join(spark):
    L = spark.createDataFrame([("a", dt.date(2024, 1, 1))], "key string, asked date")
    R = spark.createDataFrame([("a", dt.date(2024, 1, 1), 1)], "key string, made date, v int")
    plan = as_of_join(L, R, ["key"], "asked", "made", ["v"], 7)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" in plan and not any(op in line for line in plan.splitlines() if "Join" in line for op in ("<=", ">=", " < ", " > "))
    with pytest.raises(ValueError, match="repeat"):
        as_of_join(L.withColumn("v", F.lit(1)), R, ["key"], "asked", "made", ["v"])


# -- distances --------------------------------------------------------------------


def brute_ks(a, b):
    a, b = np.sort(a), np.sort(b)
    values = np.union1d(a, b)
    gaps = np.abs(np.searchsorted(a, values, "right") / len(a) - np.searchsorted(b, values, "right") / len(b))
    return gaps.max(), values[int(np.flatnonzero(gaps >= gaps.max() - 1e-15)[0])]


def test_ks_distance_equals_brute_force(spark):
    rng = np.random.default_rng(4)
    rows = []
    for g, shift in (("x", 0.0), ("y", 0.7), (None, 0.3)):
        for _ in range(800):
            first = bool(rng.random() < 0.3)
            v = 1.0 if rng.random() < 0.35 else float(np.round(rng.normal(shift if first else 0.0), 2))  # a third is one value
            rows.append((g, v, first))
    rows += [("x", None, True), ("x", math.nan, False), ("x", 1.0, None), ("alone", 1.0, True), ("x", -0.0, True), ("x", 0.0, False)]
    df = spark.createDataFrame(rows, "g string, v double, first boolean").repartition(5)
    got = {r["g"]: r for r in ks_distance(df, "v", F.col("first"), ["g"]).collect()}
    for g in ("x", "y", None):
        side = lambda s: np.array([v for h, v, f in rows if h == g and f is s and v is not None and not math.isnan(v)])
        distance, at = brute_ks(side(True), side(False))
        assert got[g]["distance"] == pytest.approx(distance, abs=1e-12) and got[g]["at"] == pytest.approx(at)
        assert (got[g]["n_first"], got[g]["n_second"]) == (len(side(True)), len(side(False)))
    assert got["alone"]["distance"] is None and got["alone"]["at"] is None
    assert ks_distance(df, "v", F.col("first")).count() == 1
    assert ks_distance(df.limit(0), "v", F.col("first"), ["g"]).collect() == []
