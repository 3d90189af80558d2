"""Metric semantics (M1-M7): definitions on small vectors, undefined cases
and weights; property tests hold the pooled metrics against numpy."""

from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from hindcast.operators import metrics as M
from hindcast.spec import metric_name

FORECASTS = "model string, series_id string, ds int, y_true double, p10 double, p50 double, p90 double"


def _rows(spark, series, model="m"):
    """``series``: name -> [(actual, forecast), ...]; p10 and p90 lie 3 around."""
    rows = []
    for sid, pairs in series.items():
        rows += [(model, sid, i, y, None if p is None else p - 3.0, p, None if p is None else p + 3.0) for i, (y, p) in enumerate(pairs)]
    return spark.createDataFrame(rows, FORECASTS)


def _past(spark, series):
    rows = [(sid, i, float(v)) for sid, values in series.items() for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "series_id string, ds int, y double")


def _weights(spark, **w):
    return spark.createDataFrame([(k, float(v)) for k, v in w.items()], "series_id string, weight double")


PAIRS = [
    [(4.0, 5.5), (9.0, 7.0), (2.5, 2.5)],
    [(0.0, 1.0), (-6.0, -2.0), (12.0, 17.0), (3.0, 0.5)],
]


@pytest.mark.parametrize("pairs", PAIRS)
def test_pooled_metrics_equal_their_definitions(spark, pairs):
    f = _rows(spark, {"s": pairs})
    err = [p - y for y, p in pairs]
    assert M.wmape(f).first()["wmape"] == pytest.approx(sum(map(abs, err)) / sum(abs(y) for y, _ in pairs))
    assert M.bias(f).first()["bias"] == pytest.approx(sum(err) / len(err))
    got = M.pinball(f).first()
    for q, shift in ((0.1, -3.0), (0.5, 0.0), (0.9, 3.0)):
        miss = [y - (p + shift) for y, p in pairs]
        want = sum(q * d if d > 0 else (q - 1) * d for d in miss) / len(miss)
        assert got[metric_name(q)] == pytest.approx(want)


def test_exact_forecasts_have_no_error(spark):
    f = _rows(spark, {"s": [(7.0, 7.0), (1.0, 1.0)]})
    assert M.wmape(f).first()["wmape"] == 0.0 and M.bias(f).first()["bias"] == 0.0
    assert M.rmsse(f, _past(spark, {"s": [5, 1, 4]})).first()["rmsse"] == 0.0


def test_wmape_of_zero_actuals_is_an_error(spark):
    with pytest.raises(Exception, match="no denominator"):
        M.wmape(_rows(spark, {"s": [(0.0, 3.0)]})).collect()


@pytest.mark.parametrize("q", [0.0, 1.0, -0.2])
def test_quantile_outside_the_open_interval(q):
    with pytest.raises(ValueError):
        metric_name(q)
    with pytest.raises(ValueError):
        M.pinball_expr(F.col("a"), F.col("b"), q)


def test_a_missing_forecast_makes_the_pooled_metric_null(spark):
    f = _rows(spark, {"s": [(8.0, 6.0), (5.0, None)]})
    assert M.wmape(f).first()["wmape"] is None and M.bias(f).first()["bias"] is None


def test_rmsse_scales_by_the_one_step_changes_of_the_past(spark):
    f = _rows(spark, {"s": [(10.0, 13.0), (20.0, 16.0)], "flat": [(1.0, 4.0)], "new": [(1.0, 4.0)]})
    past = _past(spark, {"s": [2, 5, 5, 1], "flat": [6, 6, 6], "new": [9]})
    got = {r["series_id"]: (r["rmsse"], r["n_hist"]) for r in M.rmsse(f, past).collect()}
    assert got["s"] == (pytest.approx(math.sqrt(((9 + 16) / 2) / ((9 + 0 + 16) / 3))), 4)
    assert got["flat"] == (None, 3) and got["new"] == (None, 1)


def _two_errors(spark):
    """Past changes of 2 in both series; squared errors 36 and 4: RMSSE 3 and 1."""
    f = _rows(spark, {"a": [(50.0, 56.0)], "b": [(50.0, 48.0)], "flat": [(50.0, 51.0)]})
    return M.rmsse(f, _past(spark, {"a": [1, 3, 5], "b": [8, 6, 8], "flat": [4, 4, 4]}))


@pytest.mark.parametrize("a,b,want", [(1, 1, 2.0), (7, 1, 2.75), (0, 5, 1.0), (0, 0, 2.0)])
def test_wrmsse_weighs_defined_series_and_counts_them(spark, a, b, want):
    r = M.wrmsse(_two_errors(spark), _weights(spark, a=a, b=b, flat=100)).first()
    assert r["wrmsse"] == pytest.approx(want) and r["n_scored"] == 2


def test_wrmsse_without_a_defined_series(spark):
    only = _two_errors(spark).where("series_id = 'flat'")
    w = _weights(spark, flat=2)
    with pytest.raises(Exception, match="RMSSE scale is zero or missing"):
        M.wrmsse(only, w).collect()
    assert M.wrmsse(only, w, on_undefined="null").first()["wrmsse"] is None


def test_leaderboard_ranks_bundles_and_ties_share_a_rank(spark):
    actual = [20.0, 40.0]
    f = _rows(spark, {"s": [(y, y + 6) for y in actual]}, "far")
    for name, shift in (("near", 3), ("below", -3)):
        f = f.unionByName(_rows(spark, {"s": [(y, y + shift) for y in actual]}, name))
    b = M.metric_bundle(f, _past(spark, {"s": [1, 2, 4, 7]}), _weights(spark, s=1))
    first = b.where("model = 'near'").first()
    assert first["n_series"] == 1.0 and first["wmape"] == pytest.approx(0.1) and first["bias"] == pytest.approx(3.0)
    board = M.leaderboard(b)
    assert {r["model"]: r["rank"] for r in board.collect()} == {"near": 1, "below": 1, "far": 3}
    assert board.columns == ["model", *M.LEADERBOARD_METRICS, "rank"]


def test_unscorable_rows_are_counted_or_make_the_metrics_null(spark):
    rows = [("a", 0, 4.0, 2.0), ("a", 1, 6.0, 5.0), ("a", 2, 8.0, None), ("a", 3, 9.0, 7.0)]
    fm = spark.createDataFrame(rows, "series_id string, ds int, y double, p double").withColumn("w", F.lit(1.0))
    models = {"m": {0.1: "p", 0.5: "p", 0.9: "p"}}
    got = M.score_feature_forecasts(fm, F.lit(2), models, "w", unscorable="count").first()
    assert got["n_unscored"] == 1 and got["wmape"] == pytest.approx(2 / 9)
    strict = M.score_feature_forecasts(fm, F.lit(2), models, "w", on_undefined="null").first()
    assert strict["wmape"] is None


# --- property test: pooled metrics equal the numpy definitions ---------------

import numpy as np  # noqa: E402
from hypothesis import HealthCheck, given, settings  # noqa: E402
from hypothesis import strategies as st  # noqa: E402


@settings(max_examples=10, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(
    st.lists(
        st.tuples(st.sampled_from(["A", "B", "C"]), st.floats(1, 1000), st.floats(-50, 50), st.floats(0, 30), st.floats(0, 30)),
        min_size=2,
        max_size=40,
    )
)
def test_bundle_matches_numpy(spark, rows):
    data = []
    for i, (sid, y, e, lo, hi) in enumerate(rows):
        data.append(("m", sid, i, float(y), float(y + e - lo), float(y + e), float(y + e + hi)))
    f = spark.createDataFrame(data, "model string, series_id string, ds int, y_true double, p10 double, p50 double, p90 double")
    hist_rows = [(s, i, float(v)) for s in "ABC" for i, v in enumerate([1.0, 3.0, 2.0, 5.0])]
    h = spark.createDataFrame(hist_rows, "series_id string, ds int, y double")
    w = spark.createDataFrame([("A", 1.0), ("B", 2.0), ("C", 3.0)], "series_id string, weight double")
    got = M.metric_bundle(f, h, w).first()
    y = np.array([r[3] for r in data])
    p10, p50, p90 = (np.array([r[k] for r in data]) for k in (4, 5, 6))
    assert got["wmape"] == pytest.approx(np.abs(y - p50).sum() / np.abs(y).sum(), rel=1e-9)
    assert got["bias"] == pytest.approx(np.mean(p50 - y), rel=1e-9, abs=1e-9)
    for q, p in ((0.1, p10), (0.5, p50), (0.9, p90)):
        d = y - p
        assert got[metric_name(q)] == pytest.approx(np.mean(np.maximum(q * d, (q - 1) * d)), rel=1e-9, abs=1e-12)
    scale = np.mean(np.diff([1.0, 3.0, 2.0, 5.0]) ** 2)
    sids = sorted({r[1] for r in data})
    wts = {"A": 1.0, "B": 2.0, "C": 3.0}
    rm = {s: np.sqrt(np.mean([(r[3] - r[5]) ** 2 for r in data if r[1] == s]) / scale) for s in sids}
    exp = sum(wts[s] * rm[s] for s in sids) / sum(wts[s] for s in sids)
    assert got["wrmsse"] == pytest.approx(exp, rel=1e-9)
    assert got["n_series"] == float(len(sids))


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.floats(1, 500), min_size=12, max_size=30), st.integers(3, 6))
def test_fused_and_long_scoring_agree(spark, values, horizon):
    from pyspark.sql import Window

    rows = [(s, i, float(v * (1 + k)), float(v) / 10) for k, s in enumerate("AB") for i, v in enumerate(values)]
    fm = spark.createDataFrame(rows, "series_id string, ds int, y double, w double")
    w = Window.partitionBy("series_id").orderBy("ds")
    fm = fm.withColumn("p_mid", F.avg("y").over(w.rowsBetween(-2, -1))).withColumn(
        "p_lo", F.min("y").over(w.rowsBetween(-2, -1))
    ).withColumn("p_hi", F.max("y").over(w.rowsBetween(-2, -1)))
    cutoff = F.lit(len(values) - horizon)
    models = {"m": {0.1: "p_lo", 0.5: "p_mid", 0.9: "p_hi"}}
    fused = M.score_feature_forecasts(fm, cutoff, models, "w", on_undefined="null").first().asDict()
    test = fm.where(F.col("ds") >= cutoff)
    fc = test.select(F.lit("m").alias("model"), "series_id", "ds", F.col("y").alias("y_true"),
                     F.col("p_lo").alias("p10"), F.col("p_mid").alias("p50"), F.col("p_hi").alias("p90"))
    train = fm.where(F.col("ds") < cutoff)
    weights = train.groupBy("series_id").agg(F.sum(F.abs("w")).alias("weight"))
    long = M.metric_bundle(fc, train.select("series_id", "ds", "y"), weights, on_undefined="null").first().asDict()
    for k in ("wmape", "bias", "pinball_p10", "pinball_p50", "pinball_p90", "wrmsse", "n_series"):
        if long[k] is None:  # e.g. a flat history leaves WRMSSE undefined on both paths
            assert fused[k] is None, k
        else:
            assert fused[k] == pytest.approx(long[k], rel=1e-9, abs=1e-9), k
