"""Queries: mergeable states (X1, X11, X12), as-of joins (X4) and distances
between distributions (X10)."""

from __future__ import annotations

from pyspark.sql import functions as F

from hindcast.operators import monitor as MON
from hindcast.operators.asof import as_of_join
from hindcast.operators.distribution import ks_distance
from hindcast.operators.features import build_feature_matrix
from hindcast.operators.split import panel_cutoff
from hindcast.operators.states import feature_states, label_drift, merge_profiles, merge_states, profile_of, profile_state, psi_of_states
from hindcast.plans.catalog import register
from hindcast.plans.q_monitor import FEAT1, FEAT2, P2, PSI_FEATURES, _p1_features, _psi_sql
from hindcast.plans.q_sinks import _out
from hindcast.plans.sqlgen import cutoff_sql, rounded
from hindcast.session import cut_lineage
from hindcast.sources.panels import materialized
from hindcast.sources.readers import read_table


@register(
    "psi_of_daily_states",
    ("X1", "X12"),
    rounded(
        _psi_sql()
        + ", side AS (SELECT feature, count(*) FILTER (WHERE is_ref) AS n_ref, count(*) FILTER (WHERE NOT is_ref) AS n_cur FROM lf GROUP BY feature) "
        "SELECT psi.feature, n_ref, n_cur, psi, true AS sketch_agrees FROM psi JOIN side ON psi.feature = side.feature",
        ["psi"],
        ["feature", "n_ref", "n_cur", "sketch_agrees"],
    ),
    note="states per day merged into two windows: counts exact, the sketches' PSI within 0.01 of the rows' PSI",
)
def q_psi_of_daily_states(spark, sf_dir):
    df, spec = materialized("P2", spark, sf_dir)
    fm = cut_lineage(build_feature_matrix(df, spec)[0].select("ds", *PSI_FEATURES))
    path = _out(spark, "feature-states")
    feature_states(fm, PSI_FEATURES, ("ds",)).write.parquet(path)
    states = spark.read.parquet(path)
    merged = psi_of_states(states, F.col("ds") < panel_cutoff(states, spec.horizon))
    exact = MON.psi_flagged(fm.withColumn("__ref", F.col("ds") < panel_cutoff(fm, spec.horizon)), "__ref", PSI_FEATURES)
    agrees = F.abs(F.col("psi") - F.col("sketched")) <= 0.01
    return exact.join(merged.withColumnRenamed("psi", "sketched"), "feature").select("feature", "n_ref", "n_cur", "psi", agrees.alias("sketch_agrees"))


@register(
    "feature_state_days",
    ("X1", "X12"),
    rounded(
        FEAT2
        + "SELECT date_trunc('month', ds)::DATE AS month, feature, count(value) AS n, count(*) - count(value) AS n_missing, min(value) AS lo, max(value) AS hi, true AS median_near\nFROM ("
        + "\nUNION ALL\n".join(f"SELECT ds, '{f}' AS feature, CAST({f} AS DOUBLE) AS value FROM feat" for f in PSI_FEATURES)
        + ") GROUP BY ALL",
        ["lo", "hi"],
        ["month", "feature", "n", "n_missing", "median_near"],
    ),
    note="daily states merged into months, a late day added to its month without a rescan; the sketched median holds half of the values within 1%",
)
def q_feature_state_days(spark, sf_dir):
    df, spec = materialized("P2", spark, sf_dir)
    fm = cut_lineage(build_feature_matrix(df, spec)[0].select("ds", *PSI_FEATURES))
    month = F.to_date(F.date_trunc("month", F.col("ds").cast("timestamp"))).alias("month")
    late = F.dayofmonth("ds") == 15
    path = _out(spark, "state-days")
    for part in (fm.where(~late), fm.where(late)):
        feature_states(part, PSI_FEATURES, ("ds",)).write.mode("append").parquet(path)
    merged = merge_states(spark.read.parquet(path).withColumn("month", month), ("month",))
    middle = F.when(F.col("n") > 0, F.kll_sketch_get_quantile_double("q", F.lit(0.5)))
    values = MON.long_features(fm.withColumn("month", month), PSI_FEATURES, ("month",)).join(merged.select("month", "feature", middle.alias("middle")), ["month", "feature"])
    share = values.groupBy("month", "feature").agg(F.avg((F.col("value") < F.col("middle")).cast("double")).alias("below"), F.avg((F.col("value") <= F.col("middle")).cast("double")).alias("upto"))
    near = F.coalesce((F.col("below") <= 0.51) & (F.col("upto") >= 0.49), F.lit(True))
    return merged.join(share, ["month", "feature"], "left").select("month", "feature", "n", "n_missing", "lo", "hi", near.alias("median_near"))


_COLUMNS = ("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority", "o_totalprice", "o_orderdate")


def _column_sql(c: str) -> str:
    num, time = c in ("o_orderkey", "o_custkey", "o_totalprice"), c == "o_orderdate"
    text = f"CAST(CAST({{}}({c}) AS {'DATE' if time else 'VARCHAR'}) AS VARCHAR)"
    lo, hi = (f"CAST({f}({c}) AS DOUBLE)" if num else "CAST(NULL AS DOUBLE)" for f in ("min", "max"))
    slo, shi = (text.format(f) if time else "CAST(NULL AS VARCHAR)" for f in ("min", "max"))
    label = f"(SELECT {c} FROM orders WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY count(*) DESC, {c} LIMIT 1)" if not num and not time else "CAST(NULL AS VARCHAR)"
    return (
        f"SELECT '{c}' AS \"column\", count(*) AS n, count(*) - count({c}) AS n_null, {lo} AS min_num, {hi} AS max_num, {slo} AS min_str, {shi} AS max_str, "
        f"{label} AS top_label, true AS distinct_near FROM orders"
    )


@register(
    "profile_merge",
    ("X11", "A6"),
    rounded("\nUNION ALL\n".join(map(_column_sql, _COLUMNS)), ["min_num", "max_num"], ["column", "n", "n_null", "min_str", "max_str", "top_label", "distinct_near"]),
    note="profile states of four loads of orders merged: counts and extremes exact, the most frequent label, distinct values within 5%",
)
def q_profile_merge(spark, sf_dir):
    orders = read_table(spark, sf_dir, "orders").select(*_COLUMNS).withColumn("o_orderdate", F.to_date("o_orderdate"))
    path = _out(spark, "profile-states")
    for k in range(4):
        load = orders.where(F.pmod(F.xxhash64("o_orderkey"), F.lit(4)) == k)
        profile_state(load, f"load-{k}", _COLUMNS).write.mode("append").parquet(path)
    merged = profile_of(merge_profiles(spark.read.parquet(path)))
    exact = orders.agg(F.array(*[F.struct(F.lit(c).alias("column"), F.count_distinct(c).alias("d")) for c in _COLUMNS]).alias("a"))
    exact = exact.select(F.explode("a").alias("x")).select("x.column", "x.d")
    near = F.abs(F.col("n_distinct") - F.col("d")) <= F.greatest(F.col("d") * 0.05, F.lit(0.5))
    top = F.array_sort(F.transform("top_labels", lambda x: F.struct((-x["count"]).alias("n"), x["item"].alias("item"))))
    label = F.filter(top, lambda x: x["item"].isNotNull())[0]["item"]
    return merged.join(exact, "column").select("column", "n", "n_null", "min_num", "max_num", "min_str", "max_str", label.alias("top_label"), near.alias("distinct_near"))


@register(
    "label_drift",
    ("X11",),
    rounded(
        """WITH s AS (SELECT o_orderstatus AS label, o_orderdate < DATE '1995-06-17' AS is_ref FROM orders WHERE o_orderstatus IS NOT NULL),
t AS (SELECT count(*) FILTER (WHERE is_ref) AS nr, count(*) FILTER (WHERE NOT is_ref) AS nc FROM s),
g AS (SELECT label, count(*) FILTER (WHERE is_ref) / max(nr) AS ref_share, count(*) FILTER (WHERE NOT is_ref) / max(nc) AS cur_share FROM s, t GROUP BY label),
k AS (SELECT *, CASE WHEN ref_share = 0 AND cur_share >= 0.001 THEN 'new' WHEN cur_share = 0 AND ref_share >= 0.001 THEN 'gone' WHEN abs(ref_share - cur_share) >= 0.0005 THEN 'share' END AS kind FROM g)
SELECT 'o_orderstatus' AS "column", label, kind, ref_share, cur_share FROM k WHERE kind IS NOT NULL""",
        ["ref_share", "cur_share"],
        ["column", "label", "kind"],
    ),
    note="order states before and after a date: new, gone and moved labels from merged profile states",
)
def q_label_drift(spark, sf_dir):
    orders = read_table(spark, sf_dir, "orders").select("o_orderstatus", "o_orderdate")
    before = F.to_date("o_orderdate") < F.lit("1995-06-17").cast("date")
    ref, cur = (profile_state(orders.where(p), n, ["o_orderstatus"]) for p, n in ((before, "before"), (~before, "after")))
    return label_drift(merge_profiles(ref), merge_profiles(cur), least=0.001, moved=0.0005)


@register(
    "shadow_distance",
    ("X10",),
    rounded(
        """WITH s AS (SELECT event_type, value AS v, event_id % 100 < 10 AS first FROM events WHERE value IS NOT NULL AND event_id IS NOT NULL),
n AS (SELECT event_type, count(*) FILTER (WHERE first) AS n_first, count(*) FILTER (WHERE NOT first) AS n_second FROM s GROUP BY event_type),
c AS (SELECT event_type, v, count(*) FILTER (WHERE first) AS a, count(*) FILTER (WHERE NOT first) AS b FROM s GROUP BY event_type, v),
r AS (SELECT event_type, v, sum(a) OVER w AS ca, sum(b) OVER w AS cb FROM c WINDOW w AS (PARTITION BY event_type ORDER BY v))
SELECT r.event_type, max(n_first) AS n_first, max(n_second) AS n_second, max(abs(ca / n_first - cb / n_second)) AS distance
FROM r JOIN n ON r.event_type IS NOT DISTINCT FROM n.event_type GROUP BY r.event_type""",
        ["distance"],
        ["event_type", "n_first", "n_second"],
    ),
    note="exact Kolmogorov-Smirnov distance between the shadow and the primary arm per event type",
)
def q_shadow_distance(spark, sf_dir):
    events = read_table(spark, sf_dir, "events").where(F.col("event_id").isNotNull())
    return ks_distance(events, "value", F.pmod("event_id", F.lit(100)) < 10, ["event_type"]).drop("at")


_AS_OF = (
    FEAT1
    + """, log AS (
  SELECT series_id, ds, roll_mean_8 AS p50, ds - 14 AS made_at FROM feat
  UNION ALL SELECT series_id, ds, roll_mean_4 AS p50, ds - 7 AS made_at FROM feat
), known AS (SELECT series_id, ds, y, ds + 10 AS known_at FROM feat),
asks AS (SELECT series_id, ds, ds + d AS asked_at FROM feat, (VALUES (-20), (-14), (-10), (-3), (10)) AS t(d)),
p AS (SELECT a.series_id, a.ds, a.asked_at, max(l.made_at) AS made_at FROM asks a LEFT JOIN log l ON a.series_id = l.series_id AND a.ds = l.ds AND l.made_at <= a.asked_at GROUP BY ALL)
SELECT p.series_id, p.ds, CAST(p.asked_at AS DATE) AS asked_at, CAST(p.made_at AS DATE) AS made_at, l.p50, CASE WHEN k.known_at <= p.asked_at THEN k.y END AS y_true
FROM p LEFT JOIN log l ON p.series_id = l.series_id AND p.ds = l.ds AND p.made_at = l.made_at LEFT JOIN known k ON p.series_id = k.series_id AND p.ds = k.ds"""
)


@register(
    "forecast_as_of",
    ("X4",),
    rounded(_AS_OF, ["p50", "y_true"], ["series_id", "ds", "asked_at", "made_at"]),
    note="revised predictions and late actuals as they were known at five times around each date",
)
def q_forecast_as_of(spark, sf_dir):
    fm, _, _ = _p1_features(spark, sf_dir)
    fm = cut_lineage(fm.select("series_id", "ds", "y", "roll_mean_4", "roll_mean_8"))
    made = F.array(
        F.struct(F.col("roll_mean_8").alias("p50"), F.date_sub("ds", 14).alias("made_at")), F.struct(F.col("roll_mean_4").alias("p50"), F.date_sub("ds", 7).alias("made_at"))
    )
    log = fm.select("series_id", "ds", F.explode(made).alias("v")).select("series_id", "ds", "v.*")
    asks = fm.select("series_id", "ds", F.explode(F.array(*[F.date_add("ds", k) for k in (-20, -14, -10, -3, 10)])).alias("asked_at"))
    known = fm.select("series_id", "ds", F.col("y").alias("y_true"), F.date_add("ds", 10).alias("known_at"))
    out = as_of_join(asks, log, ["series_id", "ds"], "asked_at", "made_at", ["p50"])
    return as_of_join(out, known, ["series_id", "ds"], "asked_at", "known_at", ["y_true"]).drop("known_at")
