"""Integration on the driver's sf0.001 tables (skipped without them), after
the reference's integration tests: one forecast per series, every forecast
covers the horizon and all quantiles, WMAPE within the sanity bounds,
WRMSSE positive."""

from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

from hindcast.models.additive import AdditiveParams
from hindcast.models.quantile_boost import BoostParams
from hindcast.plans.comparison import run_comparison, univariate_baseline
from hindcast.sources.panels import orders_weekly
from tests.conftest import SF_SMALL

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_SMALL), reason="no test data")


def test_global_and_local_models_on_orders_panel(spark):
    raw, spec = orders_weekly(spark, SF_SMALL)
    res = run_comparison(raw, spec, BoostParams(n_rounds=6, learning_rate=0.3, n_leaves=8), AdditiveParams())
    fc = res.forecasts.toPandas()
    assert set(fc["model"]) == {"quantile_boost", "additive"}
    per = fc.groupby(["model", "series_id"]).size()
    assert (per <= spec.horizon).all()
    assert fc[["p10", "p50", "p90"]].notna().all().all()
    assert ((fc["p10"] <= fc["p50"]) & (fc["p50"] <= fc["p90"])).all()
    assert fc.groupby("model")["series_id"].nunique().nunique() == 1  # same series (D7)
    lb = {r["model"]: r for r in res.leaderboard.collect()}
    assert lb["quantile_boost"]["wmape"] < 1.0 and lb["quantile_boost"]["wrmsse"] > 0
    assert lb["additive"]["wrmsse"] > 0


def test_univariate_baseline_on_orders_panel(spark):
    raw, spec = orders_weekly(spark, SF_SMALL)
    metrics, table = univariate_baseline(raw, spec)
    m = metrics.first()
    assert 0 <= m["wmape"] < 1.0 and m["bias"] is not None
    assert table.count() == spec.horizon
    assert table.where(F.col("y_pred").isNull()).count() == 0


def test_skip_rule_on_ragged_panel(spark):
    from hindcast.operators.features import prepare_panel
    from hindcast.operators.split import panel_cutoff, series_eligibility
    from hindcast.sources.panels import orders_status_weekly

    raw, spec = orders_status_weekly(spark, SF_SMALL)
    d = prepare_panel(raw, spec)
    el = series_eligibility(d, panel_cutoff(d, spec.horizon)).collect()
    assert len(el) == 15
    assert sum(1 for r in el if r["eligible"]) == sum(1 for r in el if r["n_test"] >= 1) == 14
