"""Sinks: forecasts, profiles, leaderboards, the run log and model artifacts
(S5-S9). Everything is written by executors as Parquet; nothing but small
parameter dictionaries passes through the driver."""

from __future__ import annotations

import datetime as dt
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hindcast.models.design import Design
from hindcast.models.quantile_boost import BoostParams, QuantileBoostModel
from hindcast.models.trees import Tree

RUNS_SCHEMA = "run_id string, parent_id string, model string, kind string, key string, value string, logged_at timestamp"


def write_forecasts(forecasts: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Forecast-vs-actual table, one folder per model."""
    forecasts.write.mode(mode).partitionBy("model").parquet(path)


def write_table(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Profile or leaderboard."""
    df.write.mode(mode).parquet(path)


def new_run_id() -> str:
    return uuid.uuid4().hex


def run_rows(
    spark: SparkSession,
    run_id: str,
    model: str,
    params: dict | None = None,
    tags: dict | None = None,
    parent_id: str | None = None,
) -> DataFrame:
    """Params and tags of one run as long rows (small, driver-side dicts)."""
    now = dt.datetime.now(dt.timezone.utc).replace(tzinfo=None)
    rows = [(run_id, parent_id, model, "param", k, str(v), now) for k, v in (params or {}).items()]
    rows += [(run_id, parent_id, model, "tag", k, str(v), now) for k, v in (tags or {}).items()]
    return spark.createDataFrame(rows, RUNS_SCHEMA)


def metric_rows(bundle: DataFrame, run_ids: DataFrame | None = None, parent_id: str | None = None) -> DataFrame:
    """Metrics of a bundle (one row per model) as long run-log rows,
    unpivoted on the executors. ``run_ids`` maps model -> run_id; default:
    run id = parent id + model."""
    metric_cols = [c for c in bundle.columns if c != "model"]
    long = bundle.unpivot(["model"], [F.col(c).cast("double").alias(c) for c in metric_cols], "key", "v")
    if run_ids is not None:
        long = long.join(run_ids, "model", "left")
    else:
        long = long.withColumn("run_id", F.concat_ws(":", F.lit(parent_id or "run"), F.col("model")))
    return long.select(
        "run_id",
        F.lit(parent_id).cast("string").alias("parent_id"),
        "model",
        F.lit("metric").alias("kind"),
        "key",
        F.col("v").cast("string").alias("value"),
        F.current_timestamp().alias("logged_at"),
    )


def append_runs(rows: DataFrame, path: str) -> None:
    """Append to the long run table ``runs(run_id, parent_id, model, kind, key, value, logged_at)``."""
    rows.write.mode("append").parquet(path)


TREES_SCHEMA = (
    "quantile double, round int, depth int, feature array<int>, threshold array<double>, cut array<int>, "
    "missing_left array<boolean>, left array<int>, right array<int>, groups array<binary>, grouped array<boolean>, value array<double>"
)


def save_quantile_model(spark: SparkSession, model: QuantileBoostModel, path: str) -> None:
    """Every quantile's trees (one row per tree), start values and the
    input encoding. Bounded: rounds x quantiles trees of 2 * leaves nodes."""
    rows = [
        (
            float(q), r, t.depth, t.feature.tolist(), t.threshold.tolist(), t.cut.tolist(), t.missing_left.tolist(),
            t.left.tolist(), t.right.tolist(), [g.tobytes() for g in t.groups], t.grouped.tolist(), t.value.tolist(),
        )
        for q, trees in model.trees.items()
        for r, t in enumerate(trees)
    ]
    spark.createDataFrame(rows, TREES_SCHEMA).write.mode("overwrite").parquet(f"{path}/trees")
    meta = [(float(q), float(v)) for q, v in model.init.items()]
    spark.createDataFrame(meta, "quantile double, init double").write.mode("overwrite").parquet(f"{path}/init")
    # the order of the inputs is the numbering that the trees split on
    kinds = [(c, "number") for c in model.design.numeric] + [(c, "labels") for c in model.design.native] + [(c, "means") for c in model.design.encoded]
    inputs = [(i, c, kind) for i, (c, kind) in enumerate(kinds)]
    spark.createDataFrame(inputs, "position int, input string, kind string").write.mode("overwrite").parquet(f"{path}/inputs")
    for c, labels in model.design.native.items():
        numbered = spark.createDataFrame(list(enumerate(labels, 1))) if labels else spark.createDataFrame([], "_1 long, _2 string")
        numbered.toDF("number", "label").write.mode("overwrite").parquet(f"{path}/labels/{c}")
    for c in model.design.encoded:  # target means, written by executors
        model.design.encodings[c].write.mode("overwrite").parquet(f"{path}/encoding/{c}")
    p = model.params
    spark.createDataFrame([(k, str(v)) for k, v in p.__dict__.items()], "key string, value string").write.mode(
        "overwrite"
    ).parquet(f"{path}/params")


def load_quantile_model(spark: SparkSession, path: str) -> QuantileBoostModel:
    """Inverse of :func:`save_quantile_model`."""
    inputs = spark.read.parquet(f"{path}/inputs").orderBy("position").collect()
    of_kind = {kind: [r["input"] for r in inputs if r["kind"] == kind] for kind in ("number", "labels", "means")}
    design = Design(
        numeric=of_kind["number"],
        native={c: [r["label"] for r in spark.read.parquet(f"{path}/labels/{c}").orderBy("number").collect()] for c in of_kind["labels"]},
        encoded=of_kind["means"],
        encodings={c: spark.read.parquet(f"{path}/encoding/{c}") for c in of_kind["means"]},
    )
    kv = {r["key"]: r["value"] for r in spark.read.parquet(f"{path}/params").collect()}
    defaults = BoostParams()
    params = BoostParams(**{k: type(getattr(defaults, k))(v) for k, v in kv.items()})
    init = {r["quantile"]: r["init"] for r in spark.read.parquet(f"{path}/init").collect()}
    trees: dict[float, list[Tree]] = {q: [] for q in init}
    for r in spark.read.parquet(f"{path}/trees").orderBy("quantile", "round").collect():
        trees[r["quantile"]].append(
            Tree(
                np.array(r["feature"], np.int16),
                np.array(r["threshold"]),
                np.array(r["cut"], np.uint8),
                np.array(r["missing_left"], bool),
                np.array(r["left"], np.int32),
                np.array(r["right"], np.int32),
                np.frombuffer(b"".join(r["groups"]), np.uint8).reshape(len(r["groups"]), -1),
                np.array(r["grouped"], bool),
                np.array(r["value"]),
                r["depth"],
            )
        )
    return QuantileBoostModel(tuple(sorted(init)), design, params, init, trees)


def log_comparison(
    spark: SparkSession,
    bundle: DataFrame,
    path: str,
    *,
    parent_id: str,
    params: dict,
    tags: dict,
    model_params: dict[str, dict] | None = None,
) -> None:
    """One parent run (params + tags) and one child run per model
    (``parent_id:model``) holding its params and every bundle metric,
    appended to the long run table at ``path``."""
    rows = run_rows(spark, parent_id, "comparison", params, tags, parent_id=None)
    for model, mp in (model_params or {}).items():
        rows = rows.unionByName(run_rows(spark, f"{parent_id}:{model}", model, mp, {"model_family": model}, parent_id))
    # a handful of rows: one file per append (coalesce only narrows the last,
    # tiny stage; the scoring stages upstream keep their parallelism)
    append_runs(rows.unionByName(metric_rows(bundle, parent_id=parent_id)).coalesce(1), path)
