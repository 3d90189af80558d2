"""Monitoring over tables: drift, residuals, rolling accuracy, gates,
request volume and shadow traffic (X1-X4, X6-X10, X12).

Every operator is a grouped aggregate or a partitioned window over
*pre-aggregated* data (daily sums, bucket counts), so the rows that reach a
window are bounded by the calendar, not by the request volume.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed values from the specification: PSI above 0.2 flags drift; a rolling
# WMAPE 20% worse than validation triggers retraining; ~10% shadow traffic.
PSI_RED = 0.2
PSI_YELLOW = 0.1  # our choice for the intermediate status
BREACH_RATIO = 1.2
SHADOW_PERCENT = 10
PSI_EPS = 1e-4


# --- X1 / X12: population stability index ----------------------------------


def long_features(df: DataFrame, features: Sequence[str], extra: Sequence[str] = ()) -> DataFrame:
    """(…extra, feature, value) -- one row per (row, feature), nulls dropped."""
    st = F.explode(
        F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("value")) for f in features])
    ).alias("__kv")
    return df.select(*extra, st).select(*extra, "__kv.feature", "__kv.value").where(F.col("value").isNotNull())


def psi(reference: DataFrame, current: DataFrame, features: Sequence[str], bins: int = 10) -> DataFrame:
    """PSI per feature, ``sum((a - e) * ln(a / e))`` over ``bins``
    equal-width buckets spanning the reference range (values outside are
    clipped into the edge buckets; empty shares become ``1e-4``)."""
    cols = list(features)
    both = reference.select(*cols, F.lit(True).alias("__ref")).unionByName(current.select(*cols, F.lit(False).alias("__ref")))
    return psi_flagged(both, "__ref", cols, bins)


def psi_flagged(df: DataFrame, is_ref: str, features: Sequence[str], bins: int = 10, edges: str = "uniform", accuracy: int = 100_000) -> DataFrame:
    """PSI where one frame holds both windows (``is_ref`` marks the reference
    rows). Two passes over the frame and no join: one wide aggregate gives the
    bucket edges of all features as a single row, read as a scalar; then each
    (feature, side, bucket) is counted, and only the partial counts are
    shuffled.

    ``edges='uniform'``: equal-width buckets over the reference min..max.
    ``edges='quantile'``: edges at the reference deciles (for ``bins=10``)
    from ``percentile_approx`` -- a sketch per feature bounded by
    ``accuracy`` -- and a value
    falls in the bucket given by the number of edges below it. A feature
    without reference values has no row."""
    vals = {f: F.col(f).cast("double") for f in features}
    if edges == "uniform":
        def cuts(v: Column) -> Column:
            return F.array(F.min(v), F.max(v))
    elif edges == "quantile":
        probs = [i / bins for i in range(1, bins)]

        def cuts(v: Column) -> Column:
            return F.percentile_approx(v, probs, accuracy)
    else:
        raise ValueError("edges must be 'uniform' or 'quantile'")
    row = df.agg(F.array(*[cuts(F.when(F.col(is_ref), v)) for v in vals.values()]).alias("cuts")).scalar()
    wide = df.select(F.col(is_ref).alias("__side"), *[v.alias(f"__v{k}") for k, v in enumerate(vals.values())], row.alias("__cuts"))
    each = [
        F.struct(F.lit(f).alias("feature"), F.col(f"__v{k}").alias("value"), F.col("__cuts")[k].alias("cuts")) for k, f in enumerate(vals)
    ]
    j = wide.select("__side", F.explode(F.array(*each)).alias("__kv")).select("__side", "__kv.*")
    j = j.where(F.col("value").isNotNull() & F.col("cuts")[0].isNotNull())
    if edges == "uniform":
        lo, width = F.col("cuts")[0], F.col("cuts")[1] - F.col("cuts")[0]
        b = F.when(width <= 0, F.lit(0)).otherwise(F.floor((F.col("value") - lo) / width * bins))
        b = F.least(F.greatest(b, F.lit(0)), F.lit(bins - 1)).cast("int")
    else:
        b = F.size(F.filter(F.col("cuts"), lambda e: F.col("value") > e)).cast("int")
    counts = j.groupBy("feature", "__side", b.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    shares = counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("feature", "__side")))
    per_bucket = shares.groupBy("feature", "bucket").agg(
        F.max(F.when(F.col("__side"), F.col("share"))).alias("e"),
        F.max(F.when(~F.col("__side"), F.col("share"))).alias("a"),
    )
    ee = F.greatest(F.coalesce(F.col("e"), F.lit(0.0)), F.lit(PSI_EPS))
    aa = F.greatest(F.coalesce(F.col("a"), F.lit(0.0)), F.lit(PSI_EPS))
    return per_bucket.groupBy("feature").agg(F.sum((aa - ee) * F.log(aa / ee)).alias("psi"))


def psi_status(psi_df: DataFrame) -> DataFrame:
    """Red / yellow / green ladder over PSI."""
    s = F.when(F.col("psi") > PSI_RED, "red").when(F.col("psi") > PSI_YELLOW, "yellow").otherwise("green")
    return psi_df.withColumn("status", s).withColumn("drift", F.col("psi") > PSI_RED)


# --- X2: residual distribution over time --------------------------------------


def residual_drift(forecasts: DataFrame, period: str = "month", quantiles: Sequence[float] = (0.1, 0.5, 0.9)) -> DataFrame:
    """Residual ``p50 - y_true`` summarised per model and period, with its
    quantiles from a bounded sketch (exact for groups of up to 10,000 rows).
    ``n_unscored`` counts rows without forecast or actual value."""
    r = forecasts.select(
        "model",
        F.to_date(F.date_trunc(period, F.col("ds").cast("timestamp"))).alias("period"),
        (F.col("p50") - F.col("y_true")).alias("residual"),
    )
    aggs = [
        F.count("residual").alias("n"),
        F.avg("residual").alias("mean_residual"),
        F.stddev_samp("residual").alias("std_residual"),
        F.min("residual").alias("min_residual"),
        F.max("residual").alias("max_residual"),
    ]
    aggs += [F.percentile_approx("residual", q, 20000).alias(f"residual_p{round(q * 100):02d}") for q in quantiles]
    aggs.append(F.count(F.when(F.col("residual").isNull(), 1)).alias("n_unscored"))
    return r.groupBy("model", "period").agg(*aggs)


# --- X3: rolling WMAPE and breach flag -----------------------------------------


def rolling_wmape(
    scored: DataFrame, validation: DataFrame, days: int = 30, ratio: float = BREACH_RATIO
) -> DataFrame:
    """X3 (batch): per model and day, WMAPE over the trailing ``days`` days
    (range frame on the day number, so gaps are respected) and a breach flag
    when it exceeds ``ratio`` x the model's validation WMAPE.

    ``scored``: (model, ds, y_true, p50) rows; ``validation``: (model, wmape).
    Rows are first reduced to daily sums, so the window sees one row per
    model-day however many predictions were logged. Rows without a target or
    without a prediction are not scored; ``n_unscored`` counts them per day, and
    the WMAPE is null while the window holds no scored row.
    """
    w = Window.partitionBy("model").orderBy(F.unix_date(F.col("day"))).rangeBetween(-(days - 1), 0)
    rolled = scored.groupBy("model", F.to_date("ds").alias("day")).agg(*daily_sums()).select(
        "model",
        "day",
        "n_unscored",
        (F.sum("abs_err").over(w) / F.sum("abs_y").over(w)).alias("wmape_rolling"),
    )
    v = validation.select("model", F.col("wmape").alias("wmape_validation"))
    return rolled.join(v, "model", "left").withColumn(
        "breach", F.coalesce(F.col("wmape_rolling") > F.lit(ratio) * F.col("wmape_validation"), F.lit(False))
    )


def daily_sums() -> list[Column]:
    """A day's absolute error and target over its scored rows, and how many
    rows are not."""
    there = F.col("y_true").isNotNull() & F.col("p50").isNotNull()
    return [
        F.sum(F.when(there, F.abs(F.col("y_true") - F.col("p50")))).alias("abs_err"),
        F.sum(F.when(there, F.abs("y_true"))).alias("abs_y"),
        F.count(F.when(~there, 1)).alias("n_unscored"),
    ]


# --- X9: retraining trigger ---------------------------------------------------


def retrain_events(rolling: DataFrame, last_n: int = 5) -> DataFrame:
    """A retraining event is a day whose breach flag turns on (edge via
    ``lag``); keep the last ``last_n`` per model with the rolling WMAPE the
    day before and the day of the event."""
    w = Window.partitionBy("model").orderBy("day")
    e = rolling.select(
        "model",
        "day",
        "breach",
        F.lag("breach", 1).over(w).alias("prev_breach"),
        F.lag("wmape_rolling", 1).over(w).alias("wmape_before"),
        F.col("wmape_rolling").alias("wmape_after"),
    ).where(F.col("breach") & ~F.coalesce(F.col("prev_breach"), F.lit(False)))
    rn = F.row_number().over(Window.partitionBy("model").orderBy(F.col("day").desc()))
    return e.withColumn("__rn", rn).where(F.col("__rn") <= last_n).select("model", "day", "wmape_before", "wmape_after")


# --- X4: predictions vs actuals --------------------------------------------------


def forecast_history(predictions: DataFrame, actuals: DataFrame, series: Column | None = None) -> DataFrame:
    """Latest prediction per (model, series_id, ds) -- by ``made_at`` --
    joined to the actual value, with the error."""
    p = predictions if series is None else predictions.where(series)
    # latest version per key as an aggregate (partial max_by map-side; no sort)
    payload = [c for c in p.columns if c not in ("model", "series_id", "ds")]
    latest = p.groupBy("model", "series_id", "ds").agg(
        F.max_by(F.struct(*[F.col(c) for c in payload]), F.col("made_at")).alias("__v")
    ).select("model", "series_id", "ds", "__v.*")
    j = latest.join(actuals.select("series_id", "ds", F.col("y").alias("y_true")), ["series_id", "ds"], "left")
    return j.withColumn("error", F.col("p50") - F.col("y_true"))


# --- X7: promotion gate ----------------------------------------------------------


def promotion_gate(board: DataFrame, candidate: str, production: str, threshold: float = 0.05) -> DataFrame:
    """Promote when the candidate's WMAPE is at least ``threshold``
    (relative) better than production's. One conditional aggregate over the
    leaderboard -- no join."""
    m = F.col("model")
    one = board.where(m.isin(candidate, production)).agg(
        F.max(F.when(m == candidate, F.col("wmape"))).alias("candidate_wmape"),
        F.max(F.when(m == production, F.col("wmape"))).alias("production_wmape"),
    )
    return one.select(
        F.lit(candidate).alias("candidate"),
        F.lit(production).alias("production"),
        "candidate_wmape",
        "production_wmape",
        (F.col("candidate_wmape") <= F.col("production_wmape") * F.lit(1.0 - threshold)).alias("promote"),
        (1 - F.col("candidate_wmape") / F.col("production_wmape")).alias("improvement"),
    )


# --- X8: request volume and prediction histogram ------------------------------


def request_volume(requests: DataFrame, by: Sequence[str] = (), ts: str = "ts") -> DataFrame:
    """Request counts in the last 24 hours and 7 days before the latest
    request (the anchor is a scalar subquery, not a collect)."""
    anchor = requests.agg(F.max(ts)).scalar()
    t = requests.select(*by, F.col(ts).alias("__ts")).withColumn("__anchor", anchor)
    age = F.col("__anchor").cast("timestamp").cast("double") - F.col("__ts").cast("timestamp").cast("double")
    return t.groupBy(*by).agg(
        F.count(F.when(age < 86400, 1)).alias("n_24h"),
        F.count(F.when(age < 7 * 86400, 1)).alias("n_7d"),
    )


def hourly_counts(requests: DataFrame, by: Sequence[str] = (), ts: str = "ts") -> DataFrame:
    """Requests per hour (tumbling one-hour event-time windows)."""
    return requests.groupBy(F.date_trunc("hour", F.col(ts)).alias("hour"), *by).agg(F.count(F.lit(1)).alias("n"))


def prediction_histogram(requests: DataFrame, value: str, width: float, ts: str = "ts") -> DataFrame:
    """Hourly histogram of predicted values in fixed-width buckets."""
    b = F.floor(F.col(value) / F.lit(width)).cast("long")
    return requests.groupBy(F.date_trunc("hour", F.col(ts)).alias("hour"), b.alias("bucket")).agg(
        F.count(F.lit(1)).alias("n")
    ).withColumn("bucket_lo", F.col("bucket") * F.lit(width))


# --- X10: shadow split -----------------------------------------------------------


def shadow_arm(key: Column, percent: int = SHADOW_PERCENT, by_hash: bool = True) -> Column:
    """Deterministic routing: 'shadow' for ~``percent``% of keys.
    ``by_hash`` uses the first 32 bits of the key's MD5 (stable across runs
    and engines, unlike rand);
    ``by_hash=False`` uses the key's own modulus (integer keys)."""
    k = F.conv(F.substring(F.md5(key.cast("string")), 1, 8), 16, 10).cast("long") if by_hash else key
    return F.when(F.pmod(k, F.lit(100)) < percent, F.lit("shadow")).otherwise(F.lit("primary"))


def shadow_compare(requests: DataFrame, key: str, value: str, percent: int = SHADOW_PERCENT, by_hash: bool = True) -> DataFrame:
    """Distribution summary of ``value`` per arm."""
    arm = shadow_arm(F.col(key), percent, by_hash)
    return requests.groupBy(arm.alias("arm")).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(value).alias("mean"),
        F.stddev_samp(value).alias("std"),
        F.min(value).alias("min"),
        F.max(value).alias("max"),
    )


# --- X6: batch forecast for requested items --------------------------------------


def batch_forecast(forecasts: DataFrame, requested: DataFrame) -> DataFrame:
    """Point + interval for the requested series (semi join)."""
    return forecasts.join(requested.select("series_id").distinct(), "series_id", "left_semi").select(
        "model", "series_id", "ds", F.col("p50").alias("point"), F.col("p10").alias("lower"), F.col("p90").alias("upper")
    )
