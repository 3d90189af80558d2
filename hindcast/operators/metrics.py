"""Forecast scoring as grouped aggregates.

Inputs are long tables, never nested arrays:

* ``forecasts(model, series_id, ds, y_true, p10, p50, p90)``
* ``history(series_id, ds, y)`` -- training rows, for the RMSSE scale
* ``weights(series_id, weight)``

Every metric is an algebraic aggregate (sums and counts), so Spark combines
partial results map-side and a model or series holding a third of all rows
never lands whole in one task. Missing values follow the reference's numpy
semantics (T9): any null input makes the pooled metric null instead of being
skipped silently.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hindcast.spec import DEFAULT_QUANTILES, PanelSpec, metric_name


def qcol(q: float) -> str:
    """Forecast column holding quantile ``q`` (``p10`` for 0.1)."""
    return f"p{int(round(q * 100)):02d}"


def _strict(value: Column, *inputs: Column) -> Column:
    """Null unless every row had all inputs present (numpy propagates NaN)."""
    cond = inputs[0].isNotNull()
    for c in inputs[1:]:
        cond = cond & c.isNotNull()
    return F.when(F.count(F.when(cond, 1)) == F.count(F.lit(1)), value)


def wmape_expr(y: Column, p: Column) -> Column:
    """M1: sum|y - p| / sum|y|; a zero denominator is an error."""
    den = F.sum(F.abs(y))
    val = F.when(den == 0, F.raise_error(F.lit("WMAPE has no denominator: every actual value is zero"))).otherwise(
        F.sum(F.abs(y - p)) / den
    )
    return _strict(val, y, p)


def bias_expr(y: Column, p: Column) -> Column:
    """M2: mean(p - y); positive = over-forecast."""
    return _strict(F.avg(p - y), y, p)


def pinball_expr(y: Column, p: Column, q: float) -> Column:
    """M3: mean(max(q * d, (q - 1) * d)) with d = y - p."""
    if not 0.0 < q < 1.0:
        raise ValueError(f"quantile must be in (0, 1), got {q}")
    d = y - p
    return _strict(F.avg(F.greatest(F.lit(q) * d, F.lit(q - 1.0) * d)), y, p)


def wmape(forecasts: DataFrame, by: Sequence[str] = ("model",), y: str = "y_true", p: str = "p50") -> DataFrame:
    return forecasts.groupBy(*by).agg(wmape_expr(F.col(y), F.col(p)).alias("wmape"))


def bias(forecasts: DataFrame, by: Sequence[str] = ("model",), y: str = "y_true", p: str = "p50") -> DataFrame:
    return forecasts.groupBy(*by).agg(bias_expr(F.col(y), F.col(p)).alias("bias"))


def pinball(
    forecasts: DataFrame, quantiles: Sequence[float] = DEFAULT_QUANTILES, by: Sequence[str] = ("model",), y: str = "y_true"
) -> DataFrame:
    return forecasts.groupBy(*by).agg(
        *[pinball_expr(F.col(y), F.col(qcol(q)), q).alias(metric_name(q)) for q in quantiles]
    )


def naive_scale(history: DataFrame) -> DataFrame:
    """W9 + M4 denominator: per series, mean squared one-step difference of
    the training history (in date order). Null when any history value is
    missing (NaN in the reference); ``n_hist`` counts rows."""
    w = Window.partitionBy("series_id").orderBy("ds")
    d = history.select("series_id", (F.col("y") - F.lag("y", 1).over(w)).alias("diff"), F.col("y"))
    return d.groupBy("series_id").agg(
        F.count(F.lit(1)).alias("n_hist"),
        F.when(F.count("y") == F.count(F.lit(1)), F.avg(F.col("diff") * F.col("diff"))).alias("scale"),
    )


def rmsse(forecasts: DataFrame, history: DataFrame, y: str = "y_true", p: str = "p50") -> DataFrame:
    """M4 per (model, series): sqrt(mean((y-p)^2) / scale).

    Null when the scale is 0 or undefined, and when the series has fewer than
    two history rows (the reference raises for the global model and skips for
    the local one; we skip and report it in ``n_hist``, T10/T11).
    """
    err = forecasts.groupBy("model", "series_id").agg(
        _strict(F.avg((F.col(y) - F.col(p)) * (F.col(y) - F.col(p))), F.col(y), F.col(p)).alias("mse")
    )
    s = naive_scale(history)
    j = err.join(s, "series_id", "left")
    val = F.when(
        (F.col("n_hist") >= 2) & (F.col("scale") > 0),
        F.sqrt(F.col("mse") / F.col("scale")),
    )
    return j.select("model", "series_id", val.alias("rmsse"), F.coalesce(F.col("n_hist"), F.lit(0)).alias("n_hist"))


def weight_source(spec: PanelSpec) -> str:
    """A3 / D3: explicit weight column, else the first exogenous column, else the target."""
    if spec.weight_col:
        return spec.weight_col
    return spec.exogenous_cols[0] if spec.exogenous_cols else spec.target_col


def series_weight(train: DataFrame, spec: PanelSpec) -> DataFrame:
    """A3: per series, sum of |weight source| over training rows; all-null sums to 0."""
    src = weight_source(spec)
    c = F.col(src) if src in train.columns else F.col("y")
    return train.groupBy("series_id").agg(F.coalesce(F.sum(F.abs(c)), F.lit(0.0)).cast("double").alias("weight"))


def wrmsse(per_series: DataFrame, weights: DataFrame, *, on_undefined: str = "error") -> DataFrame:
    """M5 per model: sum(w * s) / sum(w) over series with a defined RMSSE; equal
    weights when those weights sum to 0; no defined series is an error (or
    null with ``on_undefined='null'``). ``n_scored`` shows silent drops (T10)."""
    j = per_series.join(weights, "series_id", "left").where(F.col("rmsse").isNotNull())
    w = F.coalesce(F.col("weight"), F.lit(0.0))
    sw = F.sum(w)
    val = F.when(sw == 0, F.avg("rmsse")).otherwise(F.sum(w * F.col("rmsse")) / sw)
    out = j.groupBy("model").agg(val.alias("wrmsse"), F.count(F.lit(1)).alias("n_scored"))
    models = per_series.select("model").distinct()
    res = models.join(out, "model", "left").withColumn("n_scored", F.coalesce(F.col("n_scored"), F.lit(0)))
    if on_undefined == "error":
        res = res.withColumn(
            "wrmsse",
            F.when(
                F.col("wrmsse").isNull(),
                F.raise_error(F.concat(F.lit("RMSSE scale is zero or missing in every series of model "), F.col("model"))),
            ).otherwise(F.col("wrmsse")),
        )
    return res


# --------------------------------------------------------------------------
# Two-level scoring: algebraic partial sums per (model, series), then a tiny
# per-model combine. The forecasts are read once and the history once; a
# model or a series holding a third of all rows is reduced map-side.
# --------------------------------------------------------------------------


def _partial_aggs(y: Column, p50: Column, qcols: dict[float, Column], valid: Column, rows: Column) -> list[Column]:
    """Sums over the rows selected by ``rows`` (a boolean column)."""

    def s(e: Column) -> Column:
        return F.sum(F.when(rows, e))

    d = y - p50
    out = [
        F.count(F.when(rows, 1)).alias("n"),
        F.count(F.when(rows & valid, 1)).alias("n_valid"),
        s(F.abs(d)).alias("sae"),
        s(F.abs(y)).alias("say"),
        s(p50 - y).alias("se"),
        s(d * d).alias("sse"),
    ]
    for q, pc in qcols.items():
        dq = y - pc
        out.append(s(F.greatest(F.lit(q) * dq, F.lit(q - 1.0) * dq)).alias(f"pl_{qcol(q)}"))
    return out


def forecast_partials(forecasts: DataFrame, quantiles: Sequence[float] = DEFAULT_QUANTILES) -> DataFrame:
    """Per (model, series): counts and sums every pooled metric is built from."""
    y, p = F.col("y_true"), F.col("p50")
    cols = [y, p] + [F.col(qcol(q)) for q in quantiles]
    valid = cols[0].isNotNull()
    for c in cols[1:]:
        valid = valid & c.isNotNull()
    qc = {q: F.col(qcol(q)) for q in quantiles}
    return forecasts.groupBy("model", "series_id").agg(*_partial_aggs(y, p, qc, valid, F.lit(True)))


def history_stats(history: DataFrame, weight_col: str | None = None) -> DataFrame:
    """Per series: ``n_hist``, the naive scale and (optionally) the weight."""
    w = Window.partitionBy("series_id").orderBy("ds")
    diff = F.col("y") - F.lag("y", 1).over(w)
    cols = [F.col("y"), diff.alias("diff")]
    if weight_col:
        cols.append(F.col(weight_col).alias("__w"))
    h = history.select("series_id", *cols)
    aggs = [
        F.count(F.lit(1)).alias("n_hist"),
        F.when(F.count("y") == F.count(F.lit(1)), F.avg(F.col("diff") * F.col("diff"))).alias("scale"),
    ]
    if weight_col:
        aggs.append(F.coalesce(F.sum(F.abs(F.col("__w"))), F.lit(0.0)).cast("double").alias("weight"))
    return h.groupBy("series_id").agg(*aggs)


def bundle_from_partials(
    partials: DataFrame,
    hstats: DataFrame,
    quantiles: Sequence[float] = DEFAULT_QUANTILES,
    *,
    on_undefined: str = "error",
) -> DataFrame:
    """Combine per-(model, series) partials with per-series history stats
    (which must carry ``weight``) into the M6 bundle, one row per model."""
    return _combine(partials.join(hstats, "series_id", "left"), quantiles, on_undefined)


def _combine(j: DataFrame, quantiles: Sequence[float], on_undefined: str, extra: Sequence[Column] = ()) -> DataFrame:
    """Per-model combine of rows ``(model, series_id, partials..., n_hist, scale, weight)``."""
    strict = F.col("n_valid") == F.col("n")
    mse = F.when(strict, F.col("sse") / F.col("n"))
    rm = F.when((F.col("n_hist") >= 2) & (F.col("scale") > 0), F.sqrt(mse / F.col("scale")))
    j = j.withColumn("rmsse", rm).withColumn("__w", F.when(F.col("rmsse").isNotNull(), F.coalesce("weight", F.lit(0.0))))
    n, nv = F.sum("n"), F.sum("n_valid")
    ok = nv == n
    say = F.sum("say")
    wmape_v = F.when(say == 0, F.raise_error(F.lit("WMAPE has no denominator: every actual value is zero"))).otherwise(F.sum("sae") / say)
    sw = F.sum("__w")
    wr = F.when(sw == 0, F.avg("rmsse")).otherwise(F.sum(F.col("__w") * F.col("rmsse")) / sw)
    out = j.groupBy("model").agg(
        F.when(ok, wmape_v).alias("wmape"),
        F.when(ok, F.sum("se") / n).alias("bias"),
        *[F.when(ok, F.sum(f"pl_{qcol(q)}") / n).alias(metric_name(q)) for q in quantiles],
        F.count(F.when(F.col("n") > 0, 1)).cast("double").alias("n_series"),
        wr.alias("wrmsse"),
        F.count("rmsse").alias("n_scored"),
        *extra,
    )
    if on_undefined == "error":
        out = out.withColumn(
            "wrmsse",
            F.when(
                F.col("wrmsse").isNull(),
                F.raise_error(F.concat(F.lit("RMSSE scale is zero or missing in every series of model "), F.col("model"))),
            ).otherwise(F.col("wrmsse")),
        )
    return out


def metric_bundle(
    forecasts: DataFrame,
    history: DataFrame,
    weights: DataFrame,
    quantiles: Sequence[float] = DEFAULT_QUANTILES,
    *,
    on_undefined: str = "error",
) -> DataFrame:
    """M6: one row per model with wmape, bias, pinball per quantile, wrmsse
    and n_series (A5). Pooled metrics weigh every observation the same."""
    hs = history_stats(history).join(weights, "series_id", "left")
    b = bundle_from_partials(forecast_partials(forecasts, quantiles), hs, quantiles, on_undefined=on_undefined)
    return b.drop("n_scored")


def score_feature_forecasts(
    fm: DataFrame,
    cutoff: Column,
    models: dict[str, dict[float, str]],
    weight_col: str,
    quantiles: Sequence[float] = DEFAULT_QUANTILES,
    *,
    on_undefined: str = "error",
    unscorable: str = "null",
) -> DataFrame:
    """Score forecasts that are columns of the feature matrix itself.

    ``models`` maps a model name to ``{quantile: column}``. Training history
    stats, weights and every model's test-row partials come out of ONE
    grouped aggregate on ``series_id`` -- the partitioning the feature window
    already produced, so no further shuffle of the panel is needed.

    A test row without target or forecast makes the metrics null; with
    ``unscorable='count'`` they cover the other rows, and ``n_unscored`` says
    how many were left out.
    """
    if unscorable not in ("null", "count"):
        raise ValueError("unscorable must be 'null' or 'count'")
    count = unscorable == "count"
    w = Window.partitionBy("series_id").orderBy("ds")
    y = F.col("y")
    # evaluate the cutoff comparison once (one scalar subquery in the plan)
    d = fm.withColumn("__train", F.col("ds") < cutoff).withColumn("__diff", y - F.lag(y, 1).over(w))
    train = F.col("__train")
    test = ~train
    aggs = [
        F.count(F.when(train, 1)).alias("n_hist"),
        F.when(
            F.count(F.when(train, y)) == F.count(F.when(train, 1)),
            F.avg(F.when(train, F.col("__diff") * F.col("__diff"))),
        ).alias("scale"),
        F.coalesce(F.sum(F.when(train, F.abs(F.col(weight_col)))), F.lit(0.0)).cast("double").alias("weight"),
    ]
    structs = []
    for name, qmap in models.items():
        cols = [y] + [F.col(qmap[q]) for q in quantiles]
        valid = cols[0].isNotNull()
        for c in cols[1:]:
            valid = valid & c.isNotNull()
        qc = {q: F.col(qmap[q]) for q in quantiles}
        part = _partial_aggs(y, F.col(qmap[0.5]), qc, valid, test & valid if count else test)
        part.append(F.count(F.when(test & ~valid, 1)))
        aliased = [c.alias(f"{name}__{i}") for i, c in enumerate(part)]
        aggs += aliased
        names = ["n", "n_valid", "sae", "say", "se", "sse"] + [f"pl_{qcol(q)}" for q in quantiles] + ["n_unscored"]
        structs.append(
            F.struct(F.lit(name).alias("model"), *[F.col(f"{name}__{i}").alias(nm) for i, nm in enumerate(names)])
        )
    per_series = d.groupBy("series_id").agg(*aggs)
    stacked = per_series.select(
        "series_id", "n_hist", "scale", "weight", F.explode(F.array(*structs)).alias("__m")
    ).select("series_id", "n_hist", "scale", "weight", "__m.*")
    extra = [F.sum("n_unscored").alias("n_unscored")] if count else []
    return _combine(stacked, quantiles, on_undefined, extra).drop("n_scored")


LEADERBOARD_METRICS = ("wmape", "wrmsse", "pinball_p10", "pinball_p50", "pinball_p90", "bias")


def leaderboard(bundle: DataFrame) -> DataFrame:
    """One row per model with the six metrics (n_series excluded),
    ranked by WMAPE (ties share a rank)."""
    cols = [c for c in LEADERBOARD_METRICS if c in bundle.columns]
    return bundle.select("model", *cols).withColumn(
        "rank", F.rank().over(Window.orderBy(F.col("wmape").asc_nulls_last()))
    )
