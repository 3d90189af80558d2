"""hindcast: Spark-native panel forecasting and analytics.

Every public function takes and returns DataFrames (or column expressions);
nothing is collected unless stated. Typical flow::

    from hindcast import PanelSpec, read_panel, prepare_panel, build_feature_matrix
    from hindcast import panel_cutoff, metric_bundle, leaderboard, run_comparison
"""

from hindcast.models.additive import AdditiveParams, additive_forecast, fit_additive, forecast_future, predict_additive
from hindcast.models.quantile_boost import BoostParams, fit_quantile_models
from hindcast.models.recursive import recursive_forecast, train_and_forecast
from hindcast.operators.features import build_feature_matrix, prepare_panel
from hindcast.operators.metrics import (
    bias,
    leaderboard,
    metric_bundle,
    pinball,
    rmsse,
    score_feature_forecasts,
    series_weight,
    wmape,
    wrmsse,
)
from hindcast.operators.profile import column_profile, profile_violations
from hindcast.operators.select import check_unique, select_series, to_ds_y
from hindcast.operators.split import (
    densify,
    future_dates,
    mask_horizon,
    panel_cutoff,
    panel_split,
    skip_short_series,
    tail_split,
)
from hindcast.plans.comparison import run_comparison, univariate_baseline
from hindcast.presets import load_preset
from hindcast.sources.readers import read_panel
from hindcast.spec import FeatureSpec, FourierTerm, PanelSpec

__all__ = [
    "AdditiveParams",
    "BoostParams",
    "FeatureSpec",
    "FourierTerm",
    "PanelSpec",
    "additive_forecast",
    "bias",
    "build_feature_matrix",
    "check_unique",
    "column_profile",
    "densify",
    "fit_additive",
    "fit_quantile_models",
    "forecast_future",
    "future_dates",
    "leaderboard",
    "load_preset",
    "mask_horizon",
    "metric_bundle",
    "panel_cutoff",
    "panel_split",
    "pinball",
    "predict_additive",
    "prepare_panel",
    "profile_violations",
    "read_panel",
    "recursive_forecast",
    "rmsse",
    "run_comparison",
    "score_feature_forecasts",
    "select_series",
    "series_weight",
    "skip_short_series",
    "tail_split",
    "to_ds_y",
    "train_and_forecast",
    "univariate_baseline",
    "wmape",
    "wrmsse",
]
