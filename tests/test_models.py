"""Model invariants (K1-K8): quantiles never cross, every series covers its
test dates, no training row at or after the cutoff, same seed => same model,
no leakage from future targets, recursive step 1 = direct prediction."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from hindcast.models.additive import AdditiveParams, additive_forecast
from hindcast.models.design import fit_design
from hindcast.models.quantile_boost import BoostParams, fit_quantile_models
from hindcast.models.recursive import recursive_forecast, trimmed_history
from hindcast.operators.features import build_feature_matrix, prepare_panel
from hindcast.operators.split import panel_cutoff
from hindcast.plans.comparison import run_comparison, univariate_baseline
from hindcast.session import cut_lineage
from hindcast.sources.sinks import load_quantile_model, save_quantile_model
from hindcast.spec import FeatureSpec
from tests.helpers import shop_panel, shop_spec, to_spark

FAST = BoostParams(n_rounds=6, learning_rate=0.3, n_leaves=8, min_instances_per_node=5, refresh_every=2, checkpoint_every=2)


def _noisy_panel(n=60):
    pdf = shop_panel(n)
    rng = np.random.default_rng(0)
    pdf["sales"] = pdf["sales"] + rng.normal(0, 2, len(pdf))
    return pdf


@pytest.fixture(scope="module")
def fitted(spark):
    spec = shop_spec(horizon=6)
    d = prepare_panel(to_spark(spark, _noisy_panel()), spec).cache()
    c = panel_cutoff(d, spec.horizon)
    fm, fspec = build_feature_matrix(d, spec, prepared=True)
    model = fit_quantile_models(fm.where(F.col("ds") < c), fspec, params=FAST)
    return spec, d, c, fm, model


def test_recursive_quantiles_cover_horizon_and_never_cross(fitted):
    spec, d, c, fm, model = fitted
    fc = recursive_forecast(d, spec, model, c).toPandas()
    assert len(fc) == 2 * spec.horizon
    assert (fc.groupby("series_id").size() == spec.horizon).all()
    assert ((fc["p10"] <= fc["p50"]) & (fc["p50"] <= fc["p90"])).all()
    assert fc["y_true"].notna().all()


def test_trimmed_history_masks_horizon(fitted):
    spec, d, c, fm, model = fitted
    t = trimmed_history(d, spec, c)
    cut = d.agg(F.min(F.when(F.col("ds") >= c, F.col("ds")))).first()[0]
    assert t.where((F.col("ds") >= F.lit(cut)) & F.col("y").isNotNull()).count() == 0
    per = t.where(F.col("ds") < F.lit(cut)).groupBy("series_id").count().collect()
    assert all(r["count"] == spec.max_lookback for r in per)


def test_recursive_first_step_equals_direct_prediction(fitted):
    spec, d, c, fm, model = fitted
    fc = recursive_forecast(d, spec, model, c)
    first = fc.agg(F.min("ds")).first()[0]
    rec = {r["series_id"]: r["p50"] for r in fc.where(F.col("ds") == F.lit(first)).collect()}
    direct = model.predict(fm.where(F.col("ds") == F.lit(first)), keep=["series_id"])
    dd = {r["series_id"]: r["p50"] for r in direct.collect()}
    for k in rec:
        assert rec[k] == pytest.approx(dd[k], rel=1e-12)


def _stepwise(d, spec, model, c):
    """The recursion over the panel itself: features of all rows, one date after another."""
    dates = sorted(r["ds"] for r in d.where(F.col("ds") >= c).select("ds").distinct().collect())
    work = cut_lineage(trimmed_history(d, spec, c).withColumn("p50", F.lit(None).cast("double")))
    for dt in dates:
        fm, _ = build_feature_matrix(work.drop("y_true", "p50"), spec, prepared=True)
        made = model.predict(fm.where(F.col("ds") == F.lit(dt)), keep=["series_id", "ds"]).select("series_id", "ds", F.col("p50").alias("new"))
        work = cut_lineage(work.join(made, ["series_id", "ds"], "left").withColumns({"y": F.coalesce("y", "new"), "p50": F.coalesce("p50", "new")}).drop("new"))
    return {(r["series_id"], r["ds"]): r["p50"] for r in work.where(F.col("ds") >= c).collect()}


@pytest.mark.parametrize("step_rows", [1, 200_000])
def test_recursion_on_state_equals_steps_over_the_panel(spark, step_rows, monkeypatch):
    """Ragged series, missing targets in the history, a series without history
    and one without some of the horizon's dates."""
    from hindcast.models import recursive

    monkeypatch.setattr(recursive, "STEP_ROWS", step_rows)
    pdf = pd.concat([_noisy_panel(40).assign(channel=k) for k in ("till", "web", "post")], ignore_index=True)
    weeks = sorted(pdf["week"].unique())
    rng = np.random.default_rng(1)
    pdf.loc[rng.choice(len(pdf), 30, replace=False), "sales"] = np.nan
    new = (pdf["shop"] == "market") & (pdf["channel"] == "post")
    pdf = pdf[~(new & (pdf["week"] < weeks[-4]))]
    pdf = pdf[~((pdf["channel"] == "web") & pdf["week"].isin([weeks[-5], weeks[-2], weeks[20]]))]
    spec = shop_spec(horizon=6, lags=(1, 2, 5), rolling_windows=(2, 4, 7))
    d = prepare_panel(to_spark(spark, pdf), spec).cache()
    c = panel_cutoff(d, spec.horizon)
    fm, fspec = build_feature_matrix(d, spec, prepared=True)
    model = fit_quantile_models(fm.where(F.col("ds") < c), fspec, params=FAST)
    got = {(r["series_id"], r["ds"]): r["p50"] for r in recursive_forecast(d, spec, model, c).collect()}
    assert got == _stepwise(d, spec, model, c) and len(got) > 25


def test_same_seed_same_model(spark, fitted):
    spec, d, c, fm, model = fitted
    again = fit_quantile_models(fm.where(F.col("ds") < c), build_feature_matrix(d, spec, prepared=True)[1], params=FAST)
    assert again.init == model.init
    for q in model.quantiles:
        assert [t.value.tolist() for t in again.trees[q]] == [t.value.tolist() for t in model.trees[q]]


def test_features_do_not_leak_future_targets(spark):
    spec = shop_spec()
    pdf = shop_panel(30)
    fm1, fs = build_feature_matrix(to_spark(spark, pdf), spec)
    pdf2 = pdf.copy()
    cut = pdf2["week"].sort_values().unique()[20]
    pdf2.loc[pdf2["week"] >= cut, "sales"] += 1000.0
    fm2, _ = build_feature_matrix(to_spark(spark, pdf2), spec)
    cols = ["series_id", "ds", *fs.numeric]
    a = fm1.select(*cols).where(F.col("ds") <= F.lit(cut.date())).toPandas().sort_values(["series_id", "ds"])
    b = fm2.select(*cols).where(F.col("ds") <= F.lit(cut.date())).toPandas().sort_values(["series_id", "ds"])
    pd.testing.assert_frame_equal(a.reset_index(drop=True), b.reset_index(drop=True))


def test_partitioning_does_not_change_the_model(spark, fitted):
    spec, d, c, fm, model = fitted
    fspec = build_feature_matrix(d, spec, prepared=True)[1]
    # in rounds over many partitions instead of in one task
    small = BoostParams(**{**FAST.__dict__, "rows_per_partition": 7, "local_cells": 0})
    again = fit_quantile_models(fm.where(F.col("ds") < c).repartition(5), fspec, params=small)
    for q in model.quantiles:
        for a, b in zip(again.trees[q], model.trees[q], strict=True):
            assert a.feature.tolist() == b.feature.tolist() and a.cut.tolist() == b.cut.tolist()
            assert a.left.tolist() == b.left.tolist() and a.groups.tolist() == b.groups.tolist()
            np.testing.assert_allclose(a.threshold, b.threshold, rtol=1e-9)
            np.testing.assert_allclose(a.value, b.value, rtol=1e-9)


def test_category_means_leave_the_rows_own_fold_out(spark):
    rng = np.random.default_rng(6)
    pdf = pd.DataFrame({"num": rng.normal(size=120), "cat": rng.choice(["a", "b"], 120), "y": rng.normal(size=120)})
    pdf.loc[0, "cat"] = "alone"
    design, rows = fit_design(spark.createDataFrame(pdf), FeatureSpec(numeric=["num"], categorical=["cat"]), max_categories=2)
    got = rows.withColumn("fold", F.pmod("__row", F.lit(5))).toPandas().merge(pdf, on="num")
    assert len(got) == 120
    for r in got.itertuples():
        others = got[(got["cat"] == r.cat) & (got["fold"] != r.fold)]["y_y"]
        assert (np.isnan(r.cat__te) and others.empty) or r.cat__te == pytest.approx(others.mean())
    whole = {r["cat"]: r["cat__te"] for r in design.encodings["cat"].collect()}
    assert whole["a"] == pytest.approx(pdf[pdf["cat"] == "a"]["y"].mean())


def test_listed_input_that_is_absent_is_an_error(spark):
    with pytest.raises(ValueError, match="not in the feature matrix"):
        fit_design(spark.createDataFrame([(1.0, 2.0)], "num double, y double"), FeatureSpec(numeric=["num"], categorical=["cat"]))


def test_model_save_load_roundtrip(spark, fitted, tmp_path):
    spec, d, c, fm, model = fitted
    path = str(tmp_path / "model")
    save_quantile_model(spark, model, path)
    back = load_quantile_model(spark, path)
    rows = fm.where(F.col("ds") >= c)
    a = model.predict(rows, keep=["series_id", "ds"]).orderBy("series_id", "ds").collect()
    b = back.predict(rows, keep=["series_id", "ds"]).orderBy("series_id", "ds").collect()
    assert [tuple(r) for r in a] == [tuple(r) for r in b]


def test_additive_forecast_per_series(spark):
    spec = shop_spec(horizon=6)
    d = prepare_panel(to_spark(spark, _noisy_panel()), spec)
    fc = additive_forecast(d, spec, AdditiveParams()).toPandas()
    assert (fc.groupby("series_id").size() == 6).all()
    assert ((fc["p10"] <= fc["p50"]) & (fc["p50"] <= fc["p90"])).all()
    # a linear trend is recovered closely
    err = (fc["p50"] - fc["y_true"]).abs() / fc["y_true"].abs()
    assert err.mean() < 0.2


def test_additive_skips_short_series(spark):
    pdf = shop_panel(20)
    pdf = pdf[~((pdf["shop"] == "market") & (pdf["week"] < pdf["week"].max()))]  # market: one row, in the test window
    spec = shop_spec(horizon=3)
    fc = additive_forecast(prepare_panel(to_spark(spark, pdf), spec), spec).toPandas()
    assert set(fc["series_id"]) == {"harbour|till"}


def test_univariate_baseline(spark):
    pdf = shop_panel(40)
    spec = shop_spec(horizon=12, default_series={"shop": "harbour", "channel": "till"})
    metrics, table = univariate_baseline(to_spark(spark, pdf), spec)
    m = metrics.first()
    assert 0 <= m["wmape"] < 1.0 and m["bias"] is not None
    assert table.count() == 12


def test_comparison_leaderboard(spark, tmp_path):
    spec = shop_spec(horizon=6)
    runs = str(tmp_path / "runs")
    res = run_comparison(to_spark(spark, _noisy_panel()), spec, FAST, AdditiveParams(), runs_path=runs)
    kinds = {r["kind"] for r in spark.read.parquet(runs).collect()}
    assert kinds == {"param", "tag", "metric"}
    assert {r["column"] for r in res.profile.collect()} >= {"ds", "y", "lag_1"}
    lb = res.leaderboard.toPandas()
    assert set(lb["model"]) == {"quantile_boost", "additive"}
    assert (lb["wmape"] < 0.3).all() and (lb["wrmsse"] > 0).all()
    assert sorted(lb["rank"]) == [1, 2]


def test_spark_prediction_equals_numpy_design(spark):
    from hindcast.models.additive import _design, _flags, fit_additive, predict_additive

    spec = shop_spec(horizon=6)
    params = AdditiveParams(weekly_seasonality=True)
    d = prepare_panel(to_spark(spark, _noisy_panel()), spec)
    coefs = fit_additive(d, spec, params)
    rows = d.select("series_id", "ds")
    got = predict_additive(coefs, rows, spec, params).toPandas()
    cf = {r["series_id"]: r for r in coefs.collect()}
    flags = {r["ds"]: r["f"] for r in d.select("ds", _flags(spec, params).alias("f")).collect()}
    for sid, g in got.groupby("series_id"):
        c = cf[sid]
        t = np.array([(x - pd.Timestamp("1970-01-01").date()).days for x in g["ds"]], dtype=float)
        X = _design(t, c["t0"], c["span"], np.array(c["cps"]), np.array([flags[x] for x in g["ds"]]), params)
        exp = X @ np.array(c["beta"]) * c["scale"]
        np.testing.assert_allclose(g["p50"].to_numpy(), exp, rtol=1e-9)


def test_additive_fit_is_the_minimum(spark):
    """Conditions of optimality on every series, long and short, and no
    neighbouring coefficients do better."""
    from hindcast.models.additive import _design, _flags, fit_additive, optimality

    spec, params = shop_spec(horizon=6), AdditiveParams()
    pdf = _noisy_panel(120)
    pdf.loc[(pdf["shop"] == "market") & (pdf["week"] > pd.Timestamp("2019-01-01")), "sales"] *= 1.5
    d = prepare_panel(to_spark(spark, pd.concat([pdf, _noisy_panel(3).assign(channel="new")])), spec)
    coefs = fit_additive(d, spec, params).cache()
    off = {r["series_id"]: (r["n_train"], r["off"]) for r in optimality(coefs, d, spec, params).collect()}
    assert len(off) == 4 and all(o < 1e-7 for _, o in off.values()) and sorted(n for n, _ in off.values()) == [3, 3, 120, 120]
    rng = np.random.default_rng(0)
    for r in coefs.collect():
        rows = d.where(F.col("series_id") == r["series_id"]).orderBy("ds").select("ds", "y").collect()
        t = np.array([(x["ds"] - pd.Timestamp("1970-01-01").date()).days for x in rows], dtype=float)
        y = np.array([x["y"] for x in rows]) / r["scale"]
        flags = np.array([x["f"] for x in d.where(F.col("series_id") == r["series_id"]).orderBy("ds").select(_flags(spec, params).alias("f")).collect()])
        X, k = _design(t, r["t0"], r["span"], np.array(r["cps"]), flags, params), len(r["cps"])

        def cost(b):
            return ((y - X @ b) ** 2).sum() / 2 + r["slope_penalty"] * np.abs(b[2 : 2 + k]).sum() + r["term_penalty"] * (b[2 + k :] ** 2).sum() / 2

        b = np.array(r["beta"])
        assert all(cost(b) <= cost(b + rng.normal(0, s, len(b))) + 1e-12 for s in (1e-4, 1e-3, 1e-2) for _ in range(20))
        if k == 25:
            assert 0 < (b[2:27] != 0).sum() < 20  # most changes are exactly zero


def test_slopes_of_sparse_series_reach_the_minimum_without_long_sweeps():
    """Few rows for many changepoints: coordinate descent needs thousands of
    sweeps there, the exact solves do not."""
    from hindcast.models.additive import sparse_slopes, violation

    rng = np.random.default_rng(3)
    t = np.sort(rng.random((40, 29)), axis=1)
    H = np.maximum(t[:, :, None] - np.linspace(0, 0.8, 27)[1:-1], 0.0)
    y = np.cumsum(rng.normal(0, 0.2, t.shape), axis=1)
    G, c = H.swapaxes(1, 2) @ H, np.einsum("snk,sn->sk", H, y)
    penalty = np.full(40, 1e-3)
    d = sparse_slopes(G, c, penalty, sweeps=25)
    assert (violation(c - np.einsum("sij,sj->si", G, d), d, penalty) < 1e-9).all() and (d != 0).any(axis=1).all()
    # a start with other signs ends there too
    again = sparse_slopes(G, c, penalty, sweeps=25, start=-d)
    assert (violation(c - np.einsum("sij,sj->si", G, again), again, penalty) < 1e-9).all()


def test_additive_interval_widens_as_simulated_slopes_do(spark):
    """The trend's spread beyond the history against simulated changes of slope."""
    from hindcast.models.additive import Z90, predict_additive

    spec, params = shop_spec(horizon=6, holiday_country=None), AdditiveParams(yearly_order=0)
    cps = np.linspace(0, 0.8, 27)[1:-1].tolist()
    coefs = spark.createDataFrame([("a", 0.0, 1000.0, 10.0, 0.02, 200, cps, [1.0, 0.5, *[0.0] * 25], 1.0, 1.0, 0.04)], "series_id string, t0 double, span double, scale double, sigma double, n_train long, cps array<double>, beta array<double>, slope_penalty double, term_penalty double, change_size double")
    rows = spark.createDataFrame([("a", pd.Timestamp("1970-01-01").date() + pd.Timedelta(days=d)) for d in (500, 1000, 1300, 1800)], "series_id string, ds date")
    got = predict_additive(coefs, rows, spec, params).orderBy("ds").collect()
    rng = np.random.default_rng(1)
    widths = [(r["p90"] - r["p10"]) / 2 for r in got]
    assert widths[0] == widths[1] < widths[2] < widths[3]
    for r, h in ((got[2], 0.3), (got[3], 0.8)):
        sims = []
        for _ in range(4000):
            at = rng.uniform(0, h, rng.poisson(25 * h))
            sims.append((rng.laplace(0, 0.04, len(at)) * (h - at)).sum() + rng.normal(0, 0.02))
        assert (r["p90"] - r["p50"]) / 10.0 == pytest.approx(Z90 * np.std(sims), rel=0.08)
        share = np.mean(np.abs(sims) <= (r["p90"] - r["p50"]) / 10.0)
        assert 0.76 <= share <= 0.86


def test_exogenous_hold_mode_uses_last_training_value(spark):
    spec = shop_spec(horizon=4, exogenous_mode="hold")
    pdf = shop_panel(20)
    d = prepare_panel(to_spark(spark, pdf), spec)
    c = panel_cutoff(d, spec.horizon)
    t = trimmed_history(d, spec, c).toPandas().sort_values(["series_id", "ds"])
    for _, g in t.groupby("series_id"):
        train = g[g["y"].notna()]
        test = g[g["y"].isna()]
        assert (test["foot traffic"] == train["foot traffic"].iloc[-1]).all()
    known = trimmed_history(d, shop_spec(horizon=4), c).toPandas()
    assert known["foot traffic"].nunique() > t["foot traffic"].nunique()


def test_high_cardinality_ids_are_target_encoded_and_saved(spark, tmp_path):
    rng = np.random.default_rng(2)
    frames = []
    for k in range(80):  # 80 series > max_bins 64
        n = 30
        frames.append(
            pd.DataFrame(
                {
                    "week": pd.date_range("2020-01-05", periods=n, freq="W"),
                    "sales": 10.0 * k + np.arange(n) + rng.normal(0, 1, n),
                    "shop": f"r{k}",
                    "channel": "t",
                }
            )
        )
    pdf = pd.concat(frames, ignore_index=True)
    spec = shop_spec(exogenous_cols=(), horizon=3, lags=(1,), rolling_windows=(2,), fourier=())
    d = prepare_panel(to_spark(spark, pdf), spec)
    c = panel_cutoff(d, spec.horizon)
    fm, fs = build_feature_matrix(d, spec, prepared=True)
    model = fit_quantile_models(fm.where(F.col("ds") < c), fs, params=BoostParams(**{**FAST.__dict__, "max_categories": 60}))
    assert model.design.encoded == ["shop"] and model.design.native == {"channel": ["t"]}
    path = str(tmp_path / "m")
    save_quantile_model(spark, model, path)
    back = load_quantile_model(spark, path)
    rows = fm.where(F.col("ds") >= c)
    a = model.predict(rows, keep=["series_id", "ds"]).orderBy("series_id", "ds").collect()
    b = back.predict(rows, keep=["series_id", "ds"]).orderBy("series_id", "ds").collect()
    assert [tuple(r) for r in a] == [tuple(r) for r in b]


def test_forecast_future_from_stored_coefficients(spark, tmp_path):
    from hindcast.models.additive import fit_additive, forecast_future

    spec = shop_spec(horizon=5)
    d = prepare_panel(to_spark(spark, _noisy_panel()), spec)
    path = str(tmp_path / "coefs")
    fit_additive(d, spec).write.parquet(path)
    req = spark.createDataFrame([("harbour|till",)], "series_id string")
    fc = forecast_future(d, spark.read.parquet(path), spec, requested=req).orderBy("ds").collect()
    last = d.where(F.col("series_id") == "harbour|till").agg(F.max("ds")).first()[0]
    assert [(r["ds"] - last).days for r in fc] == [7, 14, 21, 28, 35]
    assert all(r["lower"] <= r["point"] <= r["upper"] for r in fc)
