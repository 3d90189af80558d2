"""Queries: profile, drift and monitoring."""

from __future__ import annotations

from pyspark.sql import functions as F

from hindcast.models.additive import AdditiveParams
from hindcast.operators import monitor as MON
from hindcast.operators.features import build_feature_matrix, prepare_panel
from hindcast.operators.profile import column_profile, sided_violations
from hindcast.operators.split import panel_cutoff
from hindcast.plans.catalog import register
from hindcast.plans.q_metrics import _SQL as BASELINE_SQL
from hindcast.plans.q_metrics import q_leaderboard
from hindcast.plans.sqlgen import PANEL_SQL, cutoff_sql, feature_names_sql, features_cte, rounded
from hindcast.sources.panels import PANEL_COLUMNS, PANELS, SPECS, materialized
from hindcast.sources.readers import read_table

P1, P2 = SPECS["P1"], SPECS["P2"]
FEAT1 = features_cte(PANEL_SQL["P1"], P1, PANEL_COLUMNS["P1"])
FEAT2 = features_cte(PANEL_SQL["P2"], P2, PANEL_COLUMNS["P2"])

# --- A6 / X11 -------------------------------------------------------------------

_INT_COLS = {"month", "weekofyear", "quarter", "dayofweek", "is_weekend", "is_holiday"}
_BIGINT_COLS = {"n_orders_lag1"}


def _dtype(c: str) -> str:
    if c == "ds":
        return "date"
    if c in _INT_COLS:
        return "int"
    if c in _BIGINT_COLS:
        return "bigint"
    return "double"


PROFILE_COLS = ["ds", "y", *feature_names_sql(P1, PANEL_COLUMNS["P1"])]


def _profile_sql(src: str, where: str = "") -> str:
    parts = []
    for c in PROFILE_COLS:
        if _dtype(c) == "date":
            parts.append(
                f"SELECT '{c}' AS \"column\", 'date' AS dtype, CAST(NULL AS DOUBLE) AS min_num, CAST(NULL AS DOUBLE) AS max_num, "
                f"CAST(min({c}) AS VARCHAR) AS min_str, CAST(max({c}) AS VARCHAR) AS max_str FROM {src} {where}"
            )
        else:
            parts.append(
                f"SELECT '{c}' AS \"column\", '{_dtype(c)}' AS dtype, CAST(min({c}) AS DOUBLE) AS min_num, CAST(max({c}) AS DOUBLE) AS max_num, "
                f"CAST(NULL AS VARCHAR) AS min_str, CAST(NULL AS VARCHAR) AS max_str FROM {src} {where}"
            )
    return "\nUNION ALL\n".join(parts)


def _p1_features(spark, sf_dir):
    df, spec = materialized("P1", spark, sf_dir)
    fm, fspec = build_feature_matrix(df, spec)
    return fm, fspec, spec


@register(
    "column_profile",
    ("A6", "S6"),
    rounded(FEAT1 + _profile_sql("feat"), ["min_num", "max_num"], ["column", "dtype", "min_str", "max_str"]),
    note="profile of [ds, y, numeric features] over all rows (reference parity, D6)",
)
def q_column_profile(spark, sf_dir):
    fm, fspec, _ = _p1_features(spark, sf_dir)
    return column_profile(fm, ["ds", "y", *fspec.numeric])


_VIOL_SQL = (
    FEAT1
    + f""", cut AS (SELECT {cutoff_sql('feat', P1.horizon)} AS c),
ref AS ({_profile_sql('feat', 'WHERE ds < (SELECT c FROM cut)')}),
cur AS ({_profile_sql('feat', 'WHERE ds >= (SELECT c FROM cut)')}),
j AS (SELECT r."column" AS rc, r.dtype AS rd, r.min_num AS rmin, r.max_num AS rmax, r.min_str AS rmins, r.max_str AS rmaxs,
             c."column" AS cc, c.dtype AS cd, c.min_num AS cmin, c.max_num AS cmax, c.min_str AS cmins, c.max_str AS cmaxs
      FROM ref r FULL OUTER JOIN cur c ON r."column" = c."column")
SELECT coalesce(rc, cc) AS "column", 'missing' AS kind, CAST(NULL AS VARCHAR) AS detail, CAST(NULL AS DOUBLE) AS ref_value, CAST(NULL AS DOUBLE) AS cur_value FROM j WHERE cc IS NULL
UNION ALL SELECT coalesce(rc, cc), 'extra', NULL, NULL, NULL FROM j WHERE rc IS NULL
UNION ALL SELECT rc, 'dtype', rd || ' -> ' || cd, NULL, NULL FROM j WHERE rc IS NOT NULL AND cc IS NOT NULL AND rd <> cd
UNION ALL SELECT rc, 'below_min', CASE WHEN cmins IS NOT NULL THEN rmins || ' -> ' || cmins END, rmin, cmin FROM j
  WHERE rc IS NOT NULL AND cc IS NOT NULL AND (cmin < rmin OR cmins < rmins)
UNION ALL SELECT rc, 'above_max', CASE WHEN cmaxs IS NOT NULL THEN rmaxs || ' -> ' || cmaxs END, rmax, cmax FROM j
  WHERE rc IS NOT NULL AND cc IS NOT NULL AND (cmax > rmax OR cmaxs > rmaxs)"""
)


@register(
    "profile_violations",
    ("X11", "A6", "D6"),
    rounded(_VIOL_SQL, ["ref_value", "cur_value"], ["column", "kind", "detail"]),
    note="training-window profile vs validation-window profile",
)
def q_profile_violations(spark, sf_dir):
    fm, fspec, spec = _p1_features(spark, sf_dir)
    flagged = fm.withColumn("__train", F.col("ds") < panel_cutoff(fm, spec.horizon))
    cols = ["ds", "y", *fspec.numeric]
    # both windows profiled by ONE grouped aggregate, compared without a join
    return sided_violations(column_profile(flagged, cols, by="__train"), "__train")


# --- X1 / X12: PSI -----------------------------------------------------------------

PSI_FEATURES = ["lag_1", "lag_7", "roll_mean_7", "roll_std_7", "roll_mean_28", "dayofweek"]


def _psi_sql(bins: int = 10) -> str:
    longs = "\nUNION ALL\n".join(
        f"SELECT '{f}' AS feature, CAST({f} AS DOUBLE) AS value, ds < (SELECT c FROM cut) AS is_ref FROM feat WHERE {f} IS NOT NULL"
        for f in PSI_FEATURES
    )
    return (
        FEAT2
        + f""", cut AS (SELECT {cutoff_sql('feat', P2.horizon)} AS c),
lf AS ({longs}),
rng AS (SELECT feature, min(value) AS lo, max(value) AS hi FROM lf WHERE is_ref GROUP BY feature),
bk AS (
  SELECT lf.feature, is_ref,
         CAST(least(greatest(CASE WHEN hi - lo <= 0 THEN 0 ELSE floor((value - lo) / (hi - lo) * {bins}) END, 0), {bins - 1}) AS INTEGER) AS bucket
  FROM lf JOIN rng ON lf.feature = rng.feature
),
cnt AS (SELECT feature, is_ref, bucket, count(*) AS n FROM bk GROUP BY ALL),
sh AS (SELECT feature, is_ref, bucket, n / sum(n) OVER (PARTITION BY feature, is_ref) AS share FROM cnt),
e AS (SELECT feature, bucket, share AS e FROM sh WHERE is_ref),
a AS (SELECT feature, bucket, share AS a FROM sh WHERE NOT is_ref),
j AS (SELECT coalesce(e.feature, a.feature) AS feature,
             greatest(coalesce(e.e, 0.0), 1e-4) AS ee, greatest(coalesce(a.a, 0.0), 1e-4) AS aa
      FROM e FULL OUTER JOIN a ON e.feature = a.feature AND e.bucket = a.bucket),
psi AS (SELECT feature, sum((aa - ee) * ln(aa / ee)) AS psi FROM j GROUP BY feature)
"""
    )


def _psi_df(spark, sf_dir):
    df, spec = materialized("P2", spark, sf_dir)
    fm, _ = build_feature_matrix(df, spec)
    flagged = fm.withColumn("__ref", F.col("ds") < panel_cutoff(fm, spec.horizon))
    return MON.psi_flagged(flagged, "__ref", PSI_FEATURES)


@register("psi", ("X1",), rounded(_psi_sql() + "SELECT feature, psi FROM psi", ["psi"], ["feature"]))
def q_psi(spark, sf_dir):
    """PSI of six features: training window vs the last H days."""
    return _psi_df(spark, sf_dir)


def _psi_quantile_sql(bins: int = 10) -> str:
    """As :func:`_psi_sql`, with edges at the exact reference deciles (the
    sketch is exact while the reference has fewer values than its accuracy)."""
    probs = ", ".join(str(i / bins) for i in range(1, bins))
    uniform = _psi_sql(bins)
    head, rest = uniform[: uniform.index("rng AS (")], uniform[uniform.index("cnt AS (") :]
    return (
        head
        + f"""rng AS (SELECT feature, quantile_disc(value, [{probs}]) AS edges FROM lf WHERE is_ref GROUP BY feature),
bk AS (
  SELECT lf.feature, is_ref, len(list_filter(edges, lambda e: value > e)) AS bucket
  FROM lf JOIN rng ON lf.feature = rng.feature
),
"""
        + rest
    )


_STATUS_SQL = "SELECT feature, psi, CASE WHEN psi > 0.2 THEN 'red' WHEN psi > 0.1 THEN 'yellow' ELSE 'green' END AS status, psi > 0.2 AS drift FROM psi"


@register(
    "psi_quantile_bins",
    ("X1",),
    rounded(_psi_quantile_sql() + _STATUS_SQL, ["psi"], ["feature", "status", "drift"]),
    note="PSI with bucket edges at the reference deciles (approximate sketch)",
)
def q_psi_quantile_bins(spark, sf_dir):
    df, spec = materialized("P2", spark, sf_dir)
    fm, _ = build_feature_matrix(df, spec)
    flagged = fm.withColumn("__ref", F.col("ds") < panel_cutoff(fm, spec.horizon))
    return MON.psi_status(MON.psi_flagged(flagged, "__ref", PSI_FEATURES, edges="quantile"))


@register(
    "psi_status",
    ("X12", "X1"),
    rounded(
        _psi_sql()
        + "SELECT feature, psi, CASE WHEN psi > 0.2 THEN 'red' WHEN psi > 0.1 THEN 'yellow' ELSE 'green' END AS status, psi > 0.2 AS drift FROM psi",
        ["psi"],
        ["feature", "status", "drift"],
    ),
)
def q_psi_status(spark, sf_dir):
    return MON.psi_status(_psi_df(spark, sf_dir))


# --- X2: residual drift -----------------------------------------------------------


_RESIDUAL = ["mean_residual", "std_residual", "min_residual", "max_residual", "residual_p10", "residual_p50", "residual_p90"]


@register(
    "residual_drift",
    ("X2",),
    rounded(
        FEAT1
        + """SELECT 'roll4' AS model, CAST(date_trunc('month', ds) AS DATE) AS period, count(roll_mean_4 - y) AS n,
       avg(roll_mean_4 - y) AS mean_residual, stddev_samp(roll_mean_4 - y) AS std_residual,
       min(roll_mean_4 - y) AS min_residual, max(roll_mean_4 - y) AS max_residual,
       quantile_disc(roll_mean_4 - y, 0.1) AS residual_p10, quantile_disc(roll_mean_4 - y, 0.5) AS residual_p50,
       quantile_disc(roll_mean_4 - y, 0.9) AS residual_p90,
       count(*) - count(roll_mean_4 - y) AS n_unscored
FROM feat GROUP BY ALL""",
        _RESIDUAL,
        ["model", "period", "n", "n_unscored"],
    ),
    note="monthly residual distribution of the one-step rolling-mean forecast; weeks without one are counted",
)
def q_residual_drift(spark, sf_dir):
    fm, _, _ = _p1_features(spark, sf_dir)
    scored = fm.select(
        F.lit("roll4").alias("model"), "series_id", "ds", F.col("y").alias("y_true"), F.col("roll_mean_4").alias("p50")
    )
    return MON.residual_drift(scored)


# --- X3 / X9: rolling WMAPE, breach, retraining trigger -----------------------------


def _rolling_df(spark, sf_dir):
    df, spec = materialized("P2", spark, sf_dir)
    fm, _ = build_feature_matrix(df, spec)
    scored = fm.select(
        F.lit("roll7").alias("model"), "ds", F.col("y").alias("y_true"), F.col("roll_mean_7").alias("p50"),
        (F.col("ds") < panel_cutoff(fm, spec.horizon)).alias("__train"),
    )
    val = scored.where(F.col("__train")).groupBy("model").agg(*MON.daily_sums()).select("model", (F.col("abs_err") / F.col("abs_y")).alias("wmape"))
    return MON.rolling_wmape(scored.drop("__train"), val)


_ROLL_SQL = (
    FEAT2
    + f""", cut AS (SELECT {cutoff_sql('feat', P2.horizon)} AS c),
sc AS (SELECT 'roll7' AS model, ds, y AS y_true, roll_mean_7 AS p50, ds < (SELECT c FROM cut) AS is_train, y IS NOT NULL AND roll_mean_7 IS NOT NULL AS is_scored FROM feat),
val AS (SELECT model, sum(abs(y_true - p50)) / sum(abs(y_true)) AS wmape_validation FROM sc WHERE is_train AND is_scored GROUP BY model),
daily AS (
  SELECT model, CAST(ds AS DATE) AS day, sum(abs(y_true - p50)) FILTER (WHERE is_scored) AS abs_err, sum(abs(y_true)) FILTER (WHERE is_scored) AS abs_y,
         count(*) FILTER (WHERE NOT is_scored) AS n_unscored
  FROM sc GROUP BY ALL
),
rolled AS (
  SELECT model, day, n_unscored,
         sum(abs_err) OVER w / sum(abs_y) OVER w AS wmape_rolling
  FROM daily
  WINDOW w AS (PARTITION BY model ORDER BY datediff('day', DATE '1970-01-01', day) RANGE BETWEEN 29 PRECEDING AND CURRENT ROW)
),
rw AS (SELECT rolled.model, day, n_unscored, wmape_rolling, wmape_validation, coalesce(wmape_rolling > 1.2 * wmape_validation, false) AS breach
       FROM rolled LEFT JOIN val ON rolled.model = val.model)
"""
)


@register(
    "rolling_wmape",
    ("X3",),
    rounded(_ROLL_SQL + "SELECT * FROM rw", ["wmape_rolling", "wmape_validation"], ["model", "day", "n_unscored", "breach"]),
    note="30-day trailing WMAPE per day with a 20%-worse-than-validation breach flag; rows without a forecast are counted",
)
def q_rolling_wmape(spark, sf_dir):
    return _rolling_df(spark, sf_dir)


@register(
    "retrain_trigger",
    ("X9",),
    rounded(
        _ROLL_SQL
        + """, ev AS (
  SELECT model, day, breach, lag(breach) OVER (PARTITION BY model ORDER BY day) AS prev_breach,
         lag(wmape_rolling) OVER (PARTITION BY model ORDER BY day) AS wmape_before, wmape_rolling AS wmape_after
  FROM rw
), on_edges AS (SELECT * FROM ev WHERE breach AND NOT coalesce(prev_breach, false))
SELECT model, day, wmape_before, wmape_after FROM (
  SELECT *, row_number() OVER (PARTITION BY model ORDER BY day DESC) AS rn FROM on_edges) WHERE rn <= 5""",
        ["wmape_before", "wmape_after"],
        ["model", "day"],
    ),
    note="breach onsets (edge detection) -- the last five per model",
)
def q_retrain_trigger(spark, sf_dir):
    return MON.retrain_events(_rolling_df(spark, sf_dir))


# --- X4: forecast history -----------------------------------------------------------


@register(
    "forecast_history",
    ("X4",),
    rounded(
        FEAT1
        + """, log AS (
  SELECT 'roll' AS model, series_id, ds, roll_mean_8 AS p50, CAST(ds - 14 AS DATE) AS made_at FROM feat
  UNION ALL
  SELECT 'roll' AS model, series_id, ds, roll_mean_4 AS p50, CAST(ds - 7 AS DATE) AS made_at FROM feat
), latest AS (SELECT model, series_id, ds, arg_max_null(p50, made_at) AS p50, max(made_at) AS made_at FROM log GROUP BY ALL)
SELECT l.model, l.series_id, l.ds, l.p50, l.made_at, f.y AS y_true, l.p50 - f.y AS error
FROM latest l LEFT JOIN feat f ON l.series_id = f.series_id AND l.ds = f.ds""",
        ["p50", "y_true", "error"],
        ["model", "series_id", "ds", "made_at"],
    ),
    note="a log with two forecast origins per target date; the latest one wins",
)
def q_forecast_history(spark, sf_dir):
    fm, _, _ = _p1_features(spark, sf_dir)
    log = fm.select(
        F.explode(
            F.array(
                F.struct(F.col("roll_mean_8").alias("p50"), F.date_sub("ds", 14).alias("made_at")),
                F.struct(F.col("roll_mean_4").alias("p50"), F.date_sub("ds", 7).alias("made_at")),
            )
        ).alias("v"),
        "series_id",
        "ds",
    ).select(F.lit("roll").alias("model"), "series_id", "ds", "v.p50", "v.made_at")
    return MON.forecast_history(log, fm.select("series_id", "ds", "y"))


# --- X7: promotion gate -------------------------------------------------------------


@register(
    "promotion_gate",
    ("X7", "X5"),
    rounded(
        BASELINE_SQL
        + """SELECT 'roll4' AS candidate, 'roll8' AS production, c.wmape AS candidate_wmape, p.wmape AS production_wmape,
       c.wmape <= p.wmape * 0.95 AS promote, 1 - c.wmape / p.wmape AS improvement
FROM (SELECT wmape FROM bundle WHERE model = 'roll4') c, (SELECT wmape FROM bundle WHERE model = 'roll8') p""",
        ["candidate_wmape", "production_wmape", "improvement"],
        ["candidate", "production", "promote"],
    ),
)
def q_promotion_gate(spark, sf_dir):
    return MON.promotion_gate(q_leaderboard(spark, sf_dir), "roll4", "roll8", 0.05)


# --- X8: request volume, hourly counts, prediction histogram ------------------------


@register(
    "request_volume",
    ("X8",),
    """SELECT event_type,
       count(CASE WHEN epoch(m) - epoch(ts) < 86400 THEN 1 END) AS n_24h,
       count(CASE WHEN epoch(m) - epoch(ts) < 604800 THEN 1 END) AS n_7d
FROM events, (SELECT max(ts) AS m FROM events) GROUP BY event_type""",
)
def q_request_volume(spark, sf_dir):
    return MON.request_volume(read_table(spark, sf_dir, "events"), by=["event_type"])


@register(
    "hourly_requests",
    ("X8",),
    "SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS n FROM events GROUP BY ALL",
)
def q_hourly_requests(spark, sf_dir):
    out = MON.hourly_counts(read_table(spark, sf_dir, "events"), by=["event_type"])
    return out.withColumn("hour", F.col("hour").cast("timestamp_ntz"))


@register(
    "prediction_histogram",
    ("X8",),
    rounded(
        "SELECT date_trunc('hour', ts) AS hour, CAST(floor(value / 10.0) AS BIGINT) AS bucket, count(*) AS n, "
        "CAST(floor(value / 10.0) AS BIGINT) * 10.0 AS bucket_lo FROM events GROUP BY ALL",
        ["bucket_lo"],
        ["hour", "bucket", "n"],
    ),
)
def q_prediction_histogram(spark, sf_dir):
    out = MON.prediction_histogram(read_table(spark, sf_dir, "events"), "value", 10.0)
    return out.withColumn("hour", F.col("hour").cast("timestamp_ntz"))


# --- X10: shadow split --------------------------------------------------------------


@register(
    "shadow_split",
    ("X10",),
    rounded(
        """SELECT CASE WHEN event_id % 100 < 10 THEN 'shadow' ELSE 'primary' END AS arm, count(*) AS n,
       avg(value) AS mean, stddev_samp(value) AS std, min(value) AS min, max(value) AS max
FROM events GROUP BY 1""",
        ["mean", "std", "min", "max"],
        ["arm", "n"],
    ),
    note="routing on the integer request id's modulus (oracle-comparable)",
)
def q_shadow_split(spark, sf_dir):
    return MON.shadow_compare(read_table(spark, sf_dir, "events"), "event_id", "value", by_hash=False)


@register(
    "shadow_split_hash",
    ("X10",),
    rounded(
        """SELECT CASE WHEN CAST('0x' || substr(md5(CAST(event_id AS VARCHAR)), 1, 8) AS BIGINT) % 100 < 10 THEN 'shadow' ELSE 'primary' END AS arm, count(*) AS n,
       avg(value) AS mean, stddev_samp(value) AS std, min(value) AS min, max(value) AS max
FROM events GROUP BY 1""",
        ["mean", "std", "min", "max"],
        ["arm", "n"],
    ),
    note="routing by the MD5 of the request id",
)
def q_shadow_split_hash(spark, sf_dir):
    return MON.shadow_compare(read_table(spark, sf_dir, "events"), "event_id", "value", by_hash=True)


# --- X6: batch forecast -------------------------------------------------------------


@register(
    "batch_forecast",
    ("X6", "K5", "K7", "S9"),
    note="local models fitted on the full history, stored as a coefficient table, reloaded, "
    "and used to forecast the next H weeks (point + 80% interval) for every requested series "
    "(here: all series of the panel)",
)
def q_batch_forecast(spark, sf_dir):
    import uuid

    from hindcast.models.additive import fit_additive, forecast_future
    from hindcast.session import checkpoint_dir

    df, spec = materialized("P3", spark, sf_dir)
    d = prepare_panel(df, spec)
    coefs = fit_additive(d, spec, AdditiveParams())
    path = f"{checkpoint_dir(spark).rstrip('/')}/hindcast-out/additive-coefs-{uuid.uuid4().hex}"
    coefs.write.parquet(path)  # S9: the local model artifact
    requested = d.select("series_id").distinct()
    return forecast_future(d, spark.read.parquet(path), spec, AdditiveParams(), requested)
