"""Queries: sinks written by executors and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from hindcast.plans.catalog import register
from hindcast.plans.q_metrics import _BUNDLE_COLS, _SQL, baseline_inputs, q_leaderboard, q_metric_bundle
from hindcast.plans.q_monitor import FEAT1, _p1_features, _profile_sql
from hindcast.operators.profile import column_profile
from hindcast.plans.sqlgen import rounded
from hindcast.session import checkpoint_dir
from hindcast.sources import sinks


def _out(spark, name: str) -> str:
    """A fresh folder under the cluster's shared checkpoint directory."""
    return f"{checkpoint_dir(spark).rstrip('/')}/hindcast-out/{name}-{uuid.uuid4().hex}"


@register(
    "forecast_sink",
    ("S5",),
    rounded(_SQL + "SELECT model, series_id, ds, y_true, p10, p50, p90 FROM fc", ["y_true", "p10", "p50", "p90"], ["model", "series_id", "ds"]),
    note="forecasts written partitioned by model, read back",
)
def q_forecast_sink(spark, sf_dir):
    f, _, _ = baseline_inputs(spark, sf_dir)
    path = _out(spark, "forecasts")
    sinks.write_forecasts(f, path)
    return spark.read.parquet(path)


@register(
    "leaderboard_sink",
    ("S7",),
    rounded(
        _SQL
        + "SELECT model, wmape, wrmsse, pinball_p10, pinball_p50, pinball_p90, bias, "
        "CAST(rank() OVER (ORDER BY wmape ASC NULLS LAST) AS INTEGER) AS rank FROM bundle",
        ["wmape", "wrmsse", "pinball_p10", "pinball_p50", "pinball_p90", "bias"],
        ["model", "rank"],
    ),
)
def q_leaderboard_sink(spark, sf_dir):
    path = _out(spark, "leaderboard")
    sinks.write_table(q_leaderboard(spark, sf_dir), path)
    return spark.read.parquet(path)


@register(
    "profile_sink",
    ("S6", "A6"),
    rounded(FEAT1 + _profile_sql("feat"), ["min_num", "max_num"], ["column", "dtype", "min_str", "max_str"]),
)
def q_profile_sink(spark, sf_dir):
    fm, fspec, _ = _p1_features(spark, sf_dir)
    path = _out(spark, "profile")
    sinks.write_table(column_profile(fm, ["ds", "y", *fspec.numeric]), path)
    return spark.read.parquet(path)


_RUN_PARAMS = {"horizon": 12, "n_features": 38}
_RUN_TAGS = {"dataset": "orders_weekly", "phase": "2"}
_MODEL_PARAMS = {"roll4": {"window": 4}, "roll8": {"window": 8}}

_RUN_SQL = (
    _SQL
    + "\nUNION ALL\n".join(
        f"SELECT 'cmp:' || model AS run_id, 'cmp' AS parent_id, model, 'metric' AS kind, '{c}' AS key, "
        f"CAST({c} AS DOUBLE) AS value_num, CAST(NULL AS VARCHAR) AS value_text FROM bundle"
        for c in _BUNDLE_COLS
    )
    + "\nUNION ALL\n"
    + "\nUNION ALL\n".join(
        [f"SELECT 'cmp', NULL, 'comparison', 'param', '{k}', NULL, '{v}'" for k, v in _RUN_PARAMS.items()]
        + [f"SELECT 'cmp', NULL, 'comparison', 'tag', '{k}', NULL, '{v}'" for k, v in _RUN_TAGS.items()]
        + [
            f"SELECT 'cmp:{m}', 'cmp', '{m}', 'param', '{k}', NULL, '{v}'"
            for m, mp in _MODEL_PARAMS.items()
            for k, v in mp.items()
        ]
        + [f"SELECT 'cmp:{m}', 'cmp', '{m}', 'tag', 'model_family', NULL, '{m}'" for m in _MODEL_PARAMS]
    )
)


@register(
    "run_log",
    ("S8",),
    rounded(_RUN_SQL, ["value_num"], ["run_id", "parent_id", "model", "kind", "key", "value_text"]),
    note="parent run (params, tags) + child run per model (params, tag, every bundle metric), read back",
)
def q_run_log(spark, sf_dir):
    path = _out(spark, "runs")
    sinks.log_comparison(
        spark,
        q_metric_bundle(spark, sf_dir),
        path,
        parent_id="cmp",
        params=_RUN_PARAMS,
        tags=_RUN_TAGS,
        model_params=_MODEL_PARAMS,
    )
    runs = spark.read.parquet(path)
    metric = F.col("kind") == "metric"
    return runs.select(
        "run_id",
        "parent_id",
        "model",
        "kind",
        "key",
        F.when(metric, F.col("value").cast("double")).alias("value_num"),
        F.when(~metric, F.col("value")).alias("value_text"),
    )


@register(
    "csv_panel_scan",
    ("S1", "S2", "S3", "F3"),
    rounded(
        "SELECT p.*, o_orderpriority AS series_id, week AS ds, total_price AS y FROM (" + __import__("hindcast.plans.sqlgen", fromlist=["P1"]).P1 + ") AS p",
        ["total_price", "y"],
        ["o_orderpriority", "week", "n_orders", "series_id", "ds"],
    ),
    note="P1 written as CSV text, scanned back with an explicit schema in FAILFAST mode, dates parsed",
)
def q_csv_panel_scan(spark, sf_dir):
    from hindcast.operators.features import prepare_panel
    from hindcast.sources.panels import PANELS
    from hindcast.sources.readers import read_panel

    df, spec = PANELS["P1"](spark, sf_dir)
    path = _out(spark, "panel-csv")
    df.select(F.col("o_orderpriority"), F.col("week").cast("string").alias("week"), "total_price", "n_orders").write.option(
        "header", True
    ).csv(path)
    schema = "o_orderpriority string, week string, total_price double, n_orders bigint"
    return prepare_panel(read_panel(spark, path, spec, fmt="csv", schema=schema), spec)


@register("model_artifact", ("S9", "K1"), note="boosters saved as node tables, loaded back, predictions compared row by row")
def q_model_artifact(spark, sf_dir):
    from hindcast.plans.q_models import _fit_p1

    d, spec, c, fm, model = _fit_p1(spark, sf_dir)
    path = _out(spark, "model")
    sinks.save_quantile_model(spark, model, path)
    back = sinks.load_quantile_model(spark, path)
    test = fm.where(F.col("ds") >= c)
    a = model.predict(test, keep=["series_id", "ds"])
    b = back.predict(test, keep=["series_id", "ds"]).select(
        "series_id", "ds", *[F.col(q).alias(f"loaded_{q}") for q in ("p10", "p50", "p90")]
    )
    j = a.join(b, ["series_id", "ds"])
    return j.withColumn(
        "identical", (F.col("p10") == F.col("loaded_p10")) & (F.col("p50") == F.col("loaded_p50")) & (F.col("p90") == F.col("loaded_p90"))
    )
