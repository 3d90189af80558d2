"""End-to-end plans: the model comparison (K8) and the univariate baseline (K6)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hindcast.models.additive import AdditiveParams, additive_forecast, fit_additive, predict_additive
from hindcast.models.quantile_boost import BoostParams, QuantileBoostModel
from hindcast.models.recursive import recursive_forecast
from hindcast.models.quantile_boost import fit_quantile_models
from hindcast.operators import metrics as M
from hindcast.operators.features import build_feature_matrix, prepare_panel
from hindcast.operators.profile import column_profile
from hindcast.operators.select import check_unique, select_series, to_ds_y
from hindcast.operators.split import first_n_series, panel_cutoff, tail_part
from hindcast.session import cut_lineage
from hindcast.spec import DEFAULT_QUANTILES, PanelSpec


@dataclass
class ComparisonResult:
    forecasts: DataFrame
    bundle: DataFrame
    leaderboard: DataFrame
    profile: DataFrame | None = None
    models: dict | None = None


def run_comparison(
    df: DataFrame,
    spec: PanelSpec,
    boost: BoostParams = BoostParams(),
    additive: AdditiveParams = AdditiveParams(),
    max_series: int | None = None,
    quantiles=DEFAULT_QUANTILES,
    runs_path: str | None = None,
    leaderboard_path: str | None = None,
    fitted: QuantileBoostModel | None = None,
) -> ComparisonResult:
    """K8: global quantile model (recursive) and local additive model scored
    on one harness. Both models are restricted to the same series (D7).

    The feature matrix is checkpointed once and serves both the fit and the
    feature profile (S6). With ``runs_path`` the comparison is appended to
    the run log (parent + one child run per model, S8); with
    ``leaderboard_path`` the leaderboard is written (S7). ``fitted`` is a global
    model that was fitted on this panel's training rows before; then ``boost``
    and ``quantiles`` are those of that model."""
    if fitted is not None:
        boost, quantiles = fitted.params, fitted.quantiles
    d = cut_lineage(prepare_panel(df, spec))
    check_unique(d)  # T6: row-based lags need one row per (series, date)
    if max_series is not None:
        d = cut_lineage(first_n_series(d, max_series))
    c = panel_cutoff(d, spec.horizon)
    fm, fspec = build_feature_matrix(d, spec, prepared=True)
    fm = cut_lineage(fm)  # built once: fit and profile both read it
    profile = column_profile(fm, ["ds", "y", *fspec.numeric])
    model = fitted or fit_quantile_models(fm.where(F.col("ds") < c), fspec, quantiles, boost)
    fc_global = recursive_forecast(d, spec, model, c, "quantile_boost")
    coefs = cut_lineage(fit_additive(d.where(F.col("ds") < c), spec, additive))
    test = d.where(F.col("ds") >= c).select("series_id", "ds", F.col("y").alias("y_true"))
    fc_local = cut_lineage(
        predict_additive(coefs, test, spec, additive).select(
            F.lit("additive").alias("model"), "series_id", "ds", "y_true", "p10", "p50", "p90"
        )
    )
    common = fc_global.select("series_id").distinct().join(fc_local.select("series_id").distinct(), "series_id")
    forecasts = cut_lineage(
        fc_global.join(common, "series_id", "left_semi").unionByName(fc_local.join(common, "series_id", "left_semi"))
    )
    train = d.where(F.col("ds") < c)
    bundle = M.metric_bundle(forecasts, train.select("series_id", "ds", "y"), M.series_weight(train, spec), quantiles)
    board = M.leaderboard(bundle)
    if runs_path:
        from hindcast.sources.sinks import log_comparison, new_run_id

        log_comparison(
            df.sparkSession,
            bundle,
            runs_path,
            parent_id=new_run_id(),
            params={"dataset": spec.name, "horizon": spec.horizon, "n_features": fspec.n_inputs},
            tags={"phase": "2"},
            model_params={"quantile_boost": boost.__dict__, "additive": additive.__dict__},
        )
    if leaderboard_path:
        from hindcast.sources.sinks import write_table

        write_table(board, leaderboard_path)
    return ComparisonResult(
        forecasts, bundle, board, profile=profile, models={"quantile_boost": model, "additive": coefs}
    )


def univariate_baseline(
    df: DataFrame, spec: PanelSpec, selectors: dict | None = None, params: AdditiveParams | None = None
) -> tuple[DataFrame, DataFrame]:
    """K6: one series (F1), ``[ds, y]`` (F2), positional tail split (W7),
    additive fit with weekly seasonality on (D8), forecast of the test dates,
    scored with WMAPE and bias. Returns (metrics, forecast-vs-actual table)."""
    p = params or AdditiveParams(weekly_seasonality=True)
    one = to_ds_y(select_series(df, spec, selectors), spec).withColumn("series_id", F.lit(spec.name))
    one = cut_lineage(one)  # one row per date: the panel is scanned once, with the selection pushed into it
    if one.isEmpty():
        raise ValueError(f"dataset {spec.name!r} has no rows for the selected series")
    # the tail split defines the cutoff: the earliest of the last H dates
    cutoff = tail_part(one, spec.horizon).where(F.col("part") == "test").agg(F.min("ds")).scalar()
    fc = additive_forecast(one.select("series_id", "ds", "y"), spec, p, cutoff, "additive_univariate")
    table = fc.select("ds", "y_true", F.col("p50").alias("y_pred"))
    metrics = fc.groupBy("model").agg(
        M.wmape_expr(F.col("y_true"), F.col("p50")).alias("wmape"),
        M.bias_expr(F.col("y_true"), F.col("p50")).alias("bias"),
    )
    return metrics, table
