"""Checked summaries of the local model, the baseline, the comparison and the
batch forecast (K5-K8, X6, J4): what must hold of a fit and of the tables made
with it, next to what SQL says of the same rows."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from hindcast.models.additive import AdditiveParams, additive_forecast, fit_additive, forecast_future, optimality, predict_additive
from hindcast.operators.features import prepare_panel
from hindcast.operators.metrics import qcol
from hindcast.operators.split import panel_cutoff
from hindcast.plans.catalog import register
from hindcast.plans.comparison import run_comparison, univariate_baseline
from hindcast.plans.q_models import _fit_p1
from hindcast.plans.sqlgen import PANEL_SQL, cutoff_sql, prepared_sql, rounded
from hindcast.session import cut_lineage
from hindcast.sources.panels import PANELS, SPECS, materialized
from hindcast.sources.sinks import write_table

_P1, _P3 = SPECS["P1"], SPECS["P3"]
_BASE1 = f"WITH base AS ({prepared_sql(PANEL_SQL['P1'], _P1)})\n"
_BASE3 = f"WITH base AS ({prepared_sql(PANEL_SQL['P3'], _P3)})\n"
_CUT1, _CUT3 = cutoff_sql("base", _P1.horizon), cutoff_sql("base", _P3.horizon)
#: distance from a minimum that passes, per training row of a series scaled to 1
_OFF = 1e-6


def _interval_faults():
    missing = F.col("p10").isNull() | F.col("p50").isNull() | F.col("p90").isNull()
    return F.count(F.when(missing | (F.col("p10") > F.col("p50")) | (F.col("p50") > F.col("p90")), 1)).cast("int")


@register(
    "additive_fit_check",
    ("K5", "F11"),
    _BASE3 + f"SELECT series_id, count(y) AS n_train, true AS at_minimum FROM base WHERE ds < {_CUT3} GROUP BY series_id HAVING count(y) >= 2",
    note="every series' coefficients meet the conditions of the minimum of squared error plus priors, evaluated by Spark on the training rows",
)
def q_additive_fit_check(spark, sf_dir):
    df, spec = materialized("P3", spark, sf_dir)
    d = prepare_panel(df, spec)
    train = d.where(F.col("ds") < panel_cutoff(d, spec.horizon))
    coefs = cut_lineage(fit_additive(train, spec))
    return optimality(coefs, train, spec).select("series_id", "n_train", (F.col("off") <= _OFF).alias("at_minimum"))


@register(
    "additive_forecast_check",
    ("K5", "F11", "J4"),
    rounded(
        _BASE3
        + f""", fit AS (SELECT series_id FROM base WHERE ds < {_CUT3} GROUP BY series_id HAVING count(y) >= 2)
SELECT series_id, count(*) AS n_dates, min(ds) AS first_ds, max(ds) AS last_ds, sum(y) AS y_true_sum, 0 AS n_faults, true AS widens
FROM base WHERE ds >= {_CUT3} AND series_id IN (SELECT series_id FROM fit) GROUP BY series_id""",
        ["y_true_sum"],
        ["series_id", "n_dates", "first_ds", "last_ds", "n_faults", "widens"],
    ),
    note="every fitted series covers its test dates with its own targets; intervals are ordered and never narrow with the horizon",
)
def q_additive_forecast_check(spark, sf_dir):
    df, spec = materialized("P3", spark, sf_dir)
    made = additive_forecast(prepare_panel(df, spec), spec, AdditiveParams())
    widths = F.transform(F.array_sort(F.collect_list(F.struct("ds", (F.col("p90") - F.col("p10")).alias("w")))), lambda x: x["w"])
    widens = F.forall(F.zip_with(widths, F.slice(widths, 2, F.size(widths)), lambda a, b: F.coalesce(b >= a * (1 - 1e-9), F.lit(True))), lambda x: x)
    return made.groupBy("series_id").agg(
        F.count(F.lit(1)).alias("n_dates"),
        F.min("ds").alias("first_ds"),
        F.max("ds").alias("last_ds"),
        F.sum("y_true").alias("y_true_sum"),
        _interval_faults().alias("n_faults"),
        widens.alias("widens"),
    )


@register(
    "univariate_baseline_check",
    ("K6", "F1", "F2", "W7", "J4"),
    rounded(
        _BASE1
        + f"""SELECT 'additive_univariate' AS model, count(*) AS n_dates, min(ds) AS first_ds, max(ds) AS last_ds, sum(y) AS y_true_sum,
  true AS wmape_agrees, true AS bias_agrees, true AS below_one
FROM (SELECT * FROM base WHERE o_orderpriority = '{dict(_P1.default_series)["o_orderpriority"]}' ORDER BY ds DESC LIMIT {_P1.horizon})""",
        ["y_true_sum"],
        ["model", "n_dates", "first_ds", "last_ds", "wmape_agrees", "bias_agrees", "below_one"],
    ),
    note="the last H dates of the default series; the metrics agree with those of the written forecast table",
)
def q_univariate_baseline_check(spark, sf_dir):
    from hindcast.plans.q_sinks import _out

    df, spec = PANELS["P1"](spark, sf_dir)
    metrics, table = univariate_baseline(df, spec)
    path = _out(spark, "baseline")
    write_table(table, path)
    back = spark.read.parquet(path)
    error = F.col("y_pred") - F.col("y_true")
    summary = back.withColumn("model", F.lit("additive_univariate")).groupBy("model").agg(
        F.count(F.lit(1)).alias("n_dates"),
        F.min("ds").alias("first_ds"),
        F.max("ds").alias("last_ds"),
        F.sum("y_true").alias("y_true_sum"),
        (F.sum(F.abs(error)) / F.sum(F.abs("y_true"))).alias("w"),
        F.avg(error).alias("b"),
    )
    near = lambda a, b: F.abs(F.col(a) - F.col(b)) <= F.lit(1e-9) * (1 + F.abs(b))
    return metrics.join(summary, "model").select(
        "model", "n_dates", "first_ds", "last_ds", "y_true_sum",
        near("wmape", "w").alias("wmape_agrees"), near("bias", "b").alias("bias_agrees"), (F.col("wmape") < 1).alias("below_one"),
    )


@register(
    "model_comparison_check",
    ("K8", "M6", "M7", "D7"),
    rounded(
        _BASE1
        + f"""SELECT model, count(*) AS n_rows, count(DISTINCT series_id) AS n_series, sum(y) AS y_true_sum, 0 AS n_faults,
  true AS metrics_agree, true AS rank_agrees, true AS below_one
FROM base, (VALUES ('quantile_boost'), ('additive')) AS m(model) WHERE ds >= {_CUT1} GROUP BY model""",
        ["y_true_sum"],
        ["model", "n_rows", "n_series", "n_faults", "metrics_agree", "rank_agrees", "below_one"],
    ),
    note="both models forecast the same rows; WMAPE, bias and pinball losses agree with the forecasts, ranks with WMAPE; WMAPE below 1",
)
def q_model_comparison_check(spark, sf_dir):
    df, spec = PANELS["P1"](spark, sf_dir)
    *_, model = _fit_p1(spark, sf_dir)
    res = run_comparison(df, spec, additive=AdditiveParams(), fitted=model)
    loss = lambda q, c: F.avg(F.greatest(F.lit(q) * (F.col("y_true") - F.col(c)), F.lit(q - 1) * (F.col("y_true") - F.col(c))))
    own = res.forecasts.groupBy("model").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_distinct("series_id").alias("n_rows_series"),
        F.sum("y_true").alias("y_true_sum"),
        _interval_faults().alias("n_faults"),
        (F.sum(F.abs(F.col("y_true") - F.col("p50"))) / F.sum(F.abs("y_true"))).alias("own_wmape"),
        F.avg(F.col("p50") - F.col("y_true")).alias("own_bias"),
        *[loss(q, qcol(q)).alias(f"own_pinball_{qcol(q)}") for q in model.quantiles],
    )
    names = ["wmape", "bias", *(f"pinball_{qcol(q)}" for q in model.quantiles)]
    agree = F.lit(True)
    for n in names:
        agree = agree & (F.abs(F.col(n) - F.col(f"own_{n}")) <= 1e-9 * (1 + F.abs(f"own_{n}")))
    board = res.leaderboard.select("model", "rank", *names)
    # a row per model
    place = F.rank().over(Window.orderBy("own_wmape"))
    return board.join(own, "model").select(
        "model", "n_rows", F.col("n_rows_series").alias("n_series"), "y_true_sum", "n_faults",
        agree.alias("metrics_agree"), (F.col("rank") == place).alias("rank_agrees"), (F.col("own_wmape") < 1).alias("below_one"),
    )


@register(
    "batch_forecast_check",
    ("X6", "K5", "K7", "S9"),
    _BASE3
    + f"""SELECT series_id, {_P3.horizon} AS n_dates, CAST(max(ds) + 7 AS DATE) AS first_ds, CAST(max(ds) + 7 * {_P3.horizon} AS DATE) AS last_ds,
  0 AS n_faults, true AS at_minimum, true AS as_fitted
FROM base GROUP BY series_id HAVING count(y) >= 2""",
    note="the next H weeks of every series from the stored coefficients: dates, ordered intervals, coefficients at the minimum, points as the coefficients give them",
)
def q_batch_forecast_check(spark, sf_dir):
    from hindcast.plans.q_sinks import _out

    df, spec = materialized("P3", spark, sf_dir)
    d = prepare_panel(df, spec)
    path = _out(spark, "additive-coefs")
    fit_additive(d, spec, AdditiveParams()).write.parquet(path)
    coefs = spark.read.parquet(path)
    made = forecast_future(d, coefs, spec, AdditiveParams())
    again = predict_additive(coefs, made.select("series_id", "ds"), spec).select("series_id", "ds", F.col("p50").alias("again"))
    fault = F.col("point").isNull() | (F.col("lower") > F.col("point")) | (F.col("point") > F.col("upper"))
    rows = made.join(again, ["series_id", "ds"], "left").groupBy("series_id").agg(
        F.count(F.lit(1)).cast("int").alias("n_dates"),
        F.to_date(F.min("ds")).alias("first_ds"),
        F.to_date(F.max("ds")).alias("last_ds"),
        F.count(F.when(fault, 1)).cast("int").alias("n_faults"),
        F.min(F.coalesce(F.abs(F.col("point") - F.col("again")) <= 1e-9 * F.abs("again"), F.lit(False))).alias("as_fitted"),
    )
    return rows.join(optimality(coefs, d, spec).select("series_id", (F.col("off") <= _OFF).alias("at_minimum")), "series_id")
