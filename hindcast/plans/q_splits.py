"""Queries: cutoff, splits, masking, eligibility, future dates, write-back
(W6-W8, F5-F9, F11, J2, J5, U3, A4, O2, K7)."""

from __future__ import annotations

from pyspark.sql import functions as F

from hindcast.operators.features import build_feature_matrix, prepare_panel
from hindcast.operators.select import drop_missing_target
from hindcast.operators.split import (
    cutoff_frame,
    date_membership,
    future_dates,
    horizon_dates,
    mask_horizon,
    panel_cutoff,
    panel_split,
    series_eligibility,
    skip_short_series,
    tail_part,
)
from hindcast.plans.catalog import register
from hindcast.plans.sqlgen import PANEL_SQL, cutoff_sql, features_cte, prepared_sql, rounded
from hindcast.sources.panels import PANEL_COLUMNS, PANELS, SPECS, materialized

P3 = SPECS["P3"]
H = P3.horizon
BASE3 = f"WITH base AS ({prepared_sql(PANEL_SQL['P3'], P3)})\n"


def _p3(spark, sf_dir):
    df, spec = materialized("P3", spark, sf_dir)
    return prepare_panel(df, spec).select("series_id", "ds", "y")


@register("panel_cutoff", ("W6", "A4", "O2"), BASE3 + f"SELECT {cutoff_sql('base', H)} AS cutoff")
def q_panel_cutoff(spark, sf_dir):
    """H-th largest distinct date (global, over all series)."""
    return cutoff_frame(_p3(spark, sf_dir), H)


@register("horizon_dates", ("A4", "O2"), BASE3 + f"SELECT DISTINCT ds FROM base WHERE ds >= {cutoff_sql('base', H)}")
def q_horizon_dates(spark, sf_dir):
    return horizon_dates(_p3(spark, sf_dir), H)


@register(
    "panel_split",
    ("W8", "F5", "T7"),
    rounded(
        BASE3 + f"SELECT series_id, ds, y, CASE WHEN ds < {cutoff_sql('base', H)} THEN 'train' ELSE 'test' END AS part FROM base",
        ["y"],
        ["series_id", "ds", "part"],
    ),
)
def q_panel_split(spark, sf_dir):
    d = _p3(spark, sf_dir)
    train, test = panel_split(d, H)
    return train.withColumn("part", F.lit("train")).unionByName(test.withColumn("part", F.lit("test")))


@register(
    "split_counts",
    ("W8", "F11", "T7"),
    BASE3
    + f"""SELECT series_id, count(CASE WHEN ds < {cutoff_sql('base', H)} THEN 1 END) AS n_train,
       count(CASE WHEN ds >= {cutoff_sql('base', H)} THEN 1 END) AS n_test,
       (count(CASE WHEN ds < {cutoff_sql('base', H)} THEN 1 END) >= 2 AND count(CASE WHEN ds >= {cutoff_sql('base', H)} THEN 1 END) >= 1) AS eligible
FROM base GROUP BY series_id""",
    note="ragged series get fewer than H test rows under the global cutoff",
)
def q_split_counts(spark, sf_dir):
    d = _p3(spark, sf_dir)
    return series_eligibility(d, panel_cutoff(d, H))


@register(
    "tail_split",
    ("W7",),
    rounded(
        BASE3
        + f"SELECT series_id, ds, y, CASE WHEN row_number() OVER (PARTITION BY series_id ORDER BY ds DESC) <= {H} THEN 'test' ELSE 'train' END AS part FROM base",
        ["y"],
        ["series_id", "ds", "part"],
    ),
)
def q_tail_split(spark, sf_dir):
    """Positional split: the last H rows of every series."""
    return tail_part(_p3(spark, sf_dir), H)


@register(
    "mask_horizon",
    ("F8",),
    rounded(
        BASE3 + f"SELECT series_id, ds, CASE WHEN ds < {cutoff_sql('base', H)} THEN y END AS y FROM base",
        ["y"],
        ["series_id", "ds"],
    ),
)
def q_mask_horizon(spark, sf_dir):
    d = _p3(spark, sf_dir)
    return mask_horizon(d, panel_cutoff(d, H))


@register(
    "fit_rows",
    ("F7", "F8"),
    rounded(
        BASE3 + f"SELECT series_id, ds, y FROM (SELECT series_id, ds, CASE WHEN ds < {cutoff_sql('base', H)} THEN y END AS y FROM base) WHERE y IS NOT NULL",
        ["y"],
        ["series_id", "ds"],
    ),
)
def q_fit_rows(spark, sf_dir):
    d = _p3(spark, sf_dir)
    return drop_missing_target(mask_horizon(d, panel_cutoff(d, H)))


@register(
    "skip_short_series",
    ("F11",),
    rounded(
        f"WITH base AS ({prepared_sql(PANEL_SQL['P2'], SPECS['P2'])}),\n"
        f"ok AS (SELECT series_id FROM base GROUP BY series_id HAVING count(CASE WHEN ds < {cutoff_sql('base', SPECS['P2'].horizon)} THEN 1 END) >= 2 "
        f"AND count(CASE WHEN ds >= {cutoff_sql('base', SPECS['P2'].horizon)} THEN 1 END) >= 1)\n"
        "SELECT series_id, ds, y FROM base WHERE series_id IN (SELECT series_id FROM ok)",
        ["y"],
        ["series_id", "ds"],
    ),
)
def q_skip_short_series(spark, sf_dir):
    df, spec = materialized("P2", spark, sf_dir)
    d = prepare_panel(df, spec).select("series_id", "ds", "y")
    return skip_short_series(d, panel_cutoff(d, spec.horizon))


@register(
    "horizon_semi_anti",
    ("F6", "J2", "U3"),
    BASE3
    + f"""SELECT series_id,
       count(CASE WHEN ds IN (SELECT DISTINCT ds FROM base WHERE ds >= {cutoff_sql('base', H)}) THEN 1 END) AS n_in,
       count(CASE WHEN ds NOT IN (SELECT DISTINCT ds FROM base WHERE ds >= {cutoff_sql('base', H)}) THEN 1 END) AS n_out
FROM base GROUP BY series_id""",
)
def q_horizon_semi_anti(spark, sf_dir):
    """Date-set membership and its complement via semi / anti joins."""
    d = _p3(spark, sf_dir)
    hd = horizon_dates(d, H)
    inside = date_membership(d, hd, keep=True).groupBy("series_id").agg(F.count(F.lit(1)).alias("n_in"))
    outside = date_membership(d, hd, keep=False).groupBy("series_id").agg(F.count(F.lit(1)).alias("n_out"))
    ids = d.select("series_id").distinct()
    return (
        ids.join(inside, "series_id", "left")
        .join(outside, "series_id", "left")
        .select("series_id", F.coalesce("n_in", F.lit(0)).alias("n_in"), F.coalesce("n_out", F.lit(0)).alias("n_out"))
    )


P1 = SPECS["P1"]


@register(
    "future_dates",
    ("K7",),
    f"""WITH base AS ({prepared_sql(PANEL_SQL['P1'], P1)}),
last AS (SELECT series_id, max(ds) AS l FROM base GROUP BY series_id)
SELECT series_id, ds, false AS is_future FROM base
UNION ALL
SELECT series_id, CAST(l + CAST(7 * i AS INTEGER) AS DATE) AS ds, true AS is_future FROM last, (SELECT unnest(range(1, {P1.horizon + 1})) AS i)""",
)
def q_future_dates(spark, sf_dir):
    """History dates plus H weekly periods past each series' last date."""
    df, spec = materialized("P1", spark, sf_dir)
    return future_dates(prepare_panel(df, spec), spec)


@register(
    "feedback_write_back",
    ("F9", "J5"),
    rounded(
        features_cte(PANEL_SQL["P1"], P1, PANEL_COLUMNS["P1"])
        + f""", cut AS (SELECT {cutoff_sql('feat', P1.horizon)} AS c),
pred AS (SELECT series_id, ds, roll_mean_4 AS p50 FROM feat WHERE ds = (SELECT c FROM cut))
SELECT f.series_id, f.ds, CASE WHEN f.ds < (SELECT c FROM cut) THEN f.y ELSE pred.p50 END AS y
FROM feat f LEFT JOIN pred ON f.series_id = pred.series_id AND f.ds = pred.ds""",
        ["y"],
        ["series_id", "ds"],
    ),
    note="mask the horizon, then write one step's p50 back as history",
)
def q_feedback_write_back(spark, sf_dir):
    df, spec = materialized("P1", spark, sf_dir)
    fm, _ = build_feature_matrix(df, spec)
    c = panel_cutoff(fm, spec.horizon)
    preds = fm.where(F.col("ds") == c).select("series_id", "ds", F.col("roll_mean_4").alias("p50"))
    masked = mask_horizon(fm.select("series_id", "ds", "y"), c)
    j = masked.join(preds, ["series_id", "ds"], "left")
    return j.select("series_id", "ds", F.coalesce(F.col("y"), F.col("p50")).alias("y"))


@register(
    "densify_panel",
    ("T4", "K7"),
    rounded(
        f"""WITH base AS ({prepared_sql(PANEL_SQL['P3'], P3)}),
span AS (SELECT series_id, min(ds) AS lo, max(ds) AS hi FROM base GROUP BY series_id),
grid AS (SELECT series_id, CAST(lo + CAST(7 * i AS INTEGER) AS DATE) AS ds
         FROM span, LATERAL (SELECT unnest(range(0, CAST(datediff('day', lo, hi) / 7 AS INTEGER) + 1)) AS i))
SELECT coalesce(g.series_id, b.series_id) AS series_id, coalesce(g.ds, b.ds) AS ds, b.y
FROM grid g FULL JOIN base b ON g.series_id = b.series_id AND g.ds = b.ds""",
        ["y"],
        ["series_id", "ds"],
    ),
    note="every series gets one row per week between its first and last week (missing weeks: null y)",
)
def q_densify_panel(spark, sf_dir):
    from hindcast.operators.split import densify

    return densify(_p3(spark, sf_dir), P3).select("series_id", "ds", "y")


@register(
    "densify_off_grid",
    ("T4", "K7"),
    rounded(
        f"""WITH base AS ({prepared_sql(PANEL_SQL['P2'], SPECS['P2'])}),
span AS (SELECT series_id, min(ds) AS lo, max(ds) AS hi FROM base GROUP BY series_id),
ends AS (SELECT series_id, hi, CAST(date_trunc('month', lo) + to_months(CAST(i AS INTEGER) + 1) - INTERVAL 1 DAY AS DATE) AS ds
         FROM span, LATERAL (SELECT unnest(range(0, datediff('month', lo, hi) + 1)) AS i)),
grid AS (SELECT series_id, ds FROM ends WHERE ds <= hi UNION SELECT series_id, lo FROM span)
SELECT coalesce(g.series_id, b.series_id) AS series_id, coalesce(g.ds, b.ds) AS ds, b.y
FROM grid g FULL JOIN base b ON g.series_id = b.series_id AND g.ds = b.ds""",
        ["y"],
        ["series_id", "ds"],
    ),
    note="month ends join a daily panel: days off the month-end calendar stay",
)
def q_densify_off_grid(spark, sf_dir):
    from hindcast.operators.split import densify

    df, spec = materialized("P2", spark, sf_dir)
    return densify(prepare_panel(df, spec), spec.with_(freq="ME")).select("series_id", "ds", "y")


@register(
    "future_period_ends",
    ("K7",),
    f"""WITH base AS ({prepared_sql(PANEL_SQL['P1'], P1)}),
last AS (SELECT series_id, max(ds) AS l FROM base GROUP BY series_id),
days AS (SELECT series_id, l, CAST(l + CAST(j AS INTEGER) AS DATE) AS ds FROM last, (SELECT unnest(range(1, 1200)) AS j)),
marked AS (SELECT series_id, ds, 'ME' AS freq FROM days WHERE ds = last_day(ds)
           UNION ALL SELECT series_id, ds, 'QE' FROM days WHERE ds = last_day(ds) AND month(ds) % 3 = 0
           UNION ALL SELECT series_id, ds, 'MS' FROM days WHERE day(ds) = 1
           UNION ALL SELECT series_id, ds, 'B' FROM days WHERE dayofweek(ds) BETWEEN 1 AND 5
           UNION ALL SELECT series_id, ds, 'W-SUN' FROM days WHERE dayofweek(ds) = 0)
SELECT freq, series_id, ds FROM marked QUALIFY row_number() OVER (PARTITION BY freq, series_id ORDER BY ds) <= 8""",
    note="the next eight month ends, quarter ends, month starts, business days and Sundays of every series",
)
def q_future_period_ends(spark, sf_dir):
    from functools import reduce

    df, spec = materialized("P1", spark, sf_dir)
    d = prepare_panel(df, spec)
    frames = [
        future_dates(d, spec.with_(freq=f, horizon=8), include_history=False).select(F.lit(f).alias("freq"), "series_id", "ds")
        for f in ("ME", "QE", "MS", "B", "W-SUN")
    ]
    return reduce(lambda a, b: a.unionByName(b), frames)
