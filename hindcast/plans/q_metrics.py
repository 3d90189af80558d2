"""Queries: scoring.

The SQL-checkable forecasts are the one-step rolling baselines of the
minimum slice (SURVEY §7.2) on the P1 weekly panel: at every test date
``p50 = roll_mean_w``, ``p10 = roll_min_w``, ``p90 = roll_max_w`` for
w in {4, 8}. They see actuals up to the previous step, so they are a check
input for the scoring operators, not a forecasting model.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hindcast.operators import metrics as M
from hindcast.operators.features import build_feature_matrix
from hindcast.operators.quantiles import sort_quantiles
from hindcast.operators.split import panel_cutoff
from hindcast.plans.catalog import register
from hindcast.plans.sqlgen import PANEL_SQL, cutoff_sql, features_cte, rounded
from hindcast.sources.panels import PANEL_COLUMNS, SPECS, materialized

P1 = SPECS["P1"]
BASELINE_WINDOWS = (4, 8)


def baseline_inputs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(forecasts, history, weights) for the rolling baselines on P1."""
    df, spec = materialized("P1", spark, sf_dir)
    fm, _ = build_feature_matrix(df, spec)
    c = panel_cutoff(fm, spec.horizon)
    test = fm.where(F.col("ds") >= c)
    # one pass over the test rows emits every model's row (U2: pooled long table)
    per_model = F.explode(
        F.array(
            *[
                F.struct(
                    F.lit(f"roll{w}").alias("model"),
                    F.col(f"roll_min_{w}").alias("p10"),
                    F.col(f"roll_mean_{w}").alias("p50"),
                    F.col(f"roll_max_{w}").alias("p90"),
                )
                for w in BASELINE_WINDOWS
            ]
        )
    ).alias("__m")
    forecasts = test.select("series_id", "ds", F.col("y").alias("y_true"), per_model).select(
        "__m.model", "series_id", "ds", "y_true", "__m.p10", "__m.p50", "__m.p90"
    )
    train = fm.where(F.col("ds") < c)
    history = train.select("series_id", "ds", "y")
    weights = M.series_weight(train, spec)
    return forecasts, history, weights


def baseline_sql(panel: str, weight_col: str, test_filter: str = "") -> str:
    """CTE chain ``feat, cut, fc, hist, wts, sc, er, rm, wr0, wr`` for the
    rolling baselines on ``panel`` (caller appends pooled/bundle CTEs)."""
    spec = SPECS[panel]
    extra = " AND (" + test_filter + ")" if test_filter else ""
    fc = "\n  UNION ALL\n  ".join(
        f"SELECT 'roll{w}' AS model, series_id, ds, y AS y_true, roll_min_{w} AS p10, roll_mean_{w} AS p50, roll_max_{w} AS p90 "
        f"FROM feat WHERE ds >= (SELECT c FROM cut){extra.format(w=w)}"
        for w in BASELINE_WINDOWS
    )
    return (
        features_cte(PANEL_SQL[panel], spec, PANEL_COLUMNS[panel])
        + f""", cut AS (SELECT {cutoff_sql('feat', spec.horizon)} AS c),
fc AS (
  {fc}
),
hist AS (SELECT series_id, ds, y, {weight_col} AS wsrc FROM feat WHERE ds < (SELECT c FROM cut)),
wts AS (SELECT series_id, CAST(coalesce(sum(abs(wsrc)), 0) AS DOUBLE) AS weight FROM hist GROUP BY series_id),
sc AS (
  SELECT series_id, count(*) AS n_hist, CASE WHEN count(y) = count(*) THEN avg(d * d) END AS scale
  FROM (SELECT series_id, y, y - lag(y) OVER (PARTITION BY series_id ORDER BY ds) AS d FROM hist) GROUP BY series_id
),
er AS (
  SELECT model, series_id,
         CASE WHEN count(*) = count(CASE WHEN y_true IS NOT NULL AND p50 IS NOT NULL THEN 1 END)
              THEN avg((y_true - p50) * (y_true - p50)) END AS mse
  FROM fc GROUP BY model, series_id
),
rm AS (
  SELECT er.model, er.series_id,
         CASE WHEN sc.n_hist >= 2 AND sc.scale > 0 THEN sqrt(er.mse / sc.scale) END AS rmsse,
         coalesce(sc.n_hist, 0) AS n_hist
  FROM er LEFT JOIN sc ON er.series_id = sc.series_id
),
wr0 AS (
  SELECT model,
         CASE WHEN sum(coalesce(weight, 0)) = 0 THEN avg(rmsse)
              ELSE sum(coalesce(weight, 0) * rmsse) / sum(coalesce(weight, 0)) END AS wrmsse,
         count(*) AS n_scored
  FROM rm LEFT JOIN wts ON rm.series_id = wts.series_id WHERE rmsse IS NOT NULL GROUP BY model
),
wr AS (
  SELECT m.model, CASE WHEN wr0.wrmsse IS NULL THEN error('RMSSE scale is zero or missing') ELSE wr0.wrmsse END AS wrmsse,
         coalesce(wr0.n_scored, 0) AS n_scored
  FROM (SELECT DISTINCT model FROM rm) m LEFT JOIN wr0 ON m.model = wr0.model
),
"""
    )


_FC_SQL = baseline_sql("P1", "n_orders")


def _strict_sql(expr: str, *cols: str) -> str:
    cond = " AND ".join(f"{c} IS NOT NULL" for c in cols)
    return f"CASE WHEN count(*) = count(CASE WHEN {cond} THEN 1 END) THEN {expr} END"


_WMAPE = _strict_sql(
    "CASE WHEN sum(abs(y_true)) = 0 THEN error('WMAPE has no denominator') ELSE sum(abs(y_true - p50)) / sum(abs(y_true)) END",
    "y_true",
    "p50",
)
_BIAS = _strict_sql("avg(p50 - y_true)", "y_true", "p50")


def _pinball(q: float, col: str) -> str:
    d = f"(y_true - {col})"
    return _strict_sql(f"avg(greatest({q!r} * {d}, {q - 1.0!r} * {d}))", "y_true", col)


_PINBALLS = ", ".join(f"{_pinball(q, c)} AS pinball_{c}" for q, c in ((0.1, "p10"), (0.5, "p50"), (0.9, "p90")))
_POOLED = (
    f"pooled AS (SELECT model, {_WMAPE} AS wmape, {_BIAS} AS bias, {_PINBALLS}, "
    "CAST(count(DISTINCT series_id) AS DOUBLE) AS n_series FROM fc GROUP BY model),\n"
    "bundle AS (SELECT pooled.*, wr.wrmsse FROM pooled LEFT JOIN wr ON pooled.model = wr.model)\n"
)
_SQL = _FC_SQL + _POOLED


@register("wmape", ("M1",), rounded(_SQL + f"SELECT model, {_WMAPE} AS wmape FROM fc GROUP BY model", ["wmape"], ["model"]))
def q_wmape(spark, sf_dir):
    f, _, _ = baseline_inputs(spark, sf_dir)
    return M.wmape(f)


@register("bias", ("M2",), rounded(_SQL + f"SELECT model, {_BIAS} AS bias FROM fc GROUP BY model", ["bias"], ["model"]))
def q_bias(spark, sf_dir):
    f, _, _ = baseline_inputs(spark, sf_dir)
    return M.bias(f)


@register(
    "pinball",
    ("M3", "C10"),
    rounded(
        _SQL + f"SELECT model, {_PINBALLS} FROM fc GROUP BY model",
        ["pinball_p10", "pinball_p50", "pinball_p90"],
        ["model"],
    ),
)
def q_pinball(spark, sf_dir):
    f, _, _ = baseline_inputs(spark, sf_dir)
    return M.pinball(f)


@register(
    "naive_scale",
    ("W9", "M4"),
    rounded(_SQL + "SELECT series_id, n_hist, scale FROM sc", ["scale"], ["series_id", "n_hist"]),
)
def q_naive_scale(spark, sf_dir):
    _, h, _ = baseline_inputs(spark, sf_dir)
    return M.naive_scale(h)


@register("rmsse", ("M4", "C9"), rounded(_SQL + "SELECT model, series_id, rmsse, n_hist FROM rm", ["rmsse"], ["model", "series_id", "n_hist"]))
def q_rmsse(spark, sf_dir):
    f, h, _ = baseline_inputs(spark, sf_dir)
    return M.rmsse(f, h)


@register("series_weight", ("A3",), rounded(_SQL + "SELECT series_id, weight FROM wts", ["weight"], ["series_id"]))
def q_series_weight(spark, sf_dir):
    _, _, w = baseline_inputs(spark, sf_dir)
    return w


@register(
    "wrmsse",
    ("M5", "J6"),
    rounded(_SQL + "SELECT model, wrmsse, n_scored FROM wr", ["wrmsse"], ["model", "n_scored"]),
)
def q_wrmsse(spark, sf_dir):
    f, h, w = baseline_inputs(spark, sf_dir)
    return M.wrmsse(M.rmsse(f, h), w)


_BUNDLE_COLS = ["wmape", "bias", "pinball_p10", "pinball_p50", "pinball_p90", "n_series", "wrmsse"]


@register(
    "metric_bundle",
    ("M6", "A5", "U2"),
    rounded(_SQL + "SELECT * FROM bundle", _BUNDLE_COLS, ["model"]),
    note="flagship: P1 -> features -> cutoff -> baselines -> pooled metrics",
)
def q_metric_bundle(spark, sf_dir):
    """One aggregate over the feature matrix scores both baselines."""
    df, spec = materialized("P1", spark, sf_dir)
    fm, _ = build_feature_matrix(df, spec)
    c = panel_cutoff(fm, spec.horizon)
    return M.score_feature_forecasts(fm, c, _BASELINE_COLS, M.weight_source(spec))


_BASELINE_COLS = {f"roll{w}": {0.1: f"roll_min_{w}", 0.5: f"roll_mean_{w}", 0.9: f"roll_max_{w}"} for w in BASELINE_WINDOWS}


@register(
    "metric_bundle_long",
    ("M6", "A5", "U2", "J6"),
    rounded(_SQL + "SELECT * FROM bundle", _BUNDLE_COLS, ["model"]),
    note="same bundle through the generic long-table API (forecasts, history, weights)",
)
def q_metric_bundle_long(spark, sf_dir):
    f, h, w = baseline_inputs(spark, sf_dir)
    return M.metric_bundle(f, h, w)


@register(
    "leaderboard",
    ("M7", "X5", "C11"),
    rounded(
        _SQL
        + "SELECT model, wmape, wrmsse, pinball_p10, pinball_p50, pinball_p90, bias, "
        "CAST(rank() OVER (ORDER BY wmape ASC NULLS LAST) AS INTEGER) AS rank FROM bundle",
        ["wmape", "wrmsse", "pinball_p10", "pinball_p50", "pinball_p90", "bias"],
        ["model", "rank"],
    ),
)
def q_leaderboard(spark, sf_dir):
    return M.leaderboard(q_metric_bundle(spark, sf_dir))


@register(
    "noncrossing_quantiles",
    ("O3", "K2"),
    rounded(
        features_cte(PANEL_SQL["P1"], P1, PANEL_COLUMNS["P1"])
        + f""", cut AS (SELECT {cutoff_sql('feat', P1.horizon)} AS c),
raw AS (SELECT series_id, ds, lag_1 AS a, roll_mean_4 AS b, lag_2 AS c FROM feat WHERE ds >= (SELECT c FROM cut))
SELECT series_id, ds, least(a, b, c) AS p10, greatest(least(a, b), least(greatest(a, b), c)) AS p50, greatest(a, b, c) AS p90 FROM raw""",
        ["p10", "p50", "p90"],
        ["series_id", "ds"],
    ),
    note="crossing inputs (lag_1, roll_mean_4, lag_2) sorted row-wise",
)
def q_noncrossing_quantiles(spark, sf_dir):
    df, spec = materialized("P1", spark, sf_dir)
    fm, _ = build_feature_matrix(df, spec)
    c = panel_cutoff(fm, spec.horizon)
    raw = fm.where(F.col("ds") >= c).select(
        "series_id", "ds", F.col("lag_1").alias("p10"), F.col("roll_mean_4").alias("p50"), F.col("lag_2").alias("p90")
    )
    return sort_quantiles(raw, ["p10", "p50", "p90"])
