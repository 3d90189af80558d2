"""Queries: feature engineering."""

from __future__ import annotations

from pyspark.sql import functions as F

from hindcast.functions.holidays import holiday_table, is_holiday, year_range
from hindcast.operators.features import build_feature_matrix, prepare_panel
from hindcast.plans.catalog import register
from hindcast.plans.sqlgen import PANEL_SQL, calendars_sql, feature_names_sql, features_cte, holiday_ctes, prepared_sql, rounded
from hindcast.sources.panels import PANEL_COLUMNS, PANELS, SPECS

_DOUBLE_SOURCE = {"total_price", "total_value", "revenue", "quantity"}


def _features(panel: str, cols: list[str] | None = None):
    def fn(spark, sf_dir):
        df, spec = PANELS[panel](spark, sf_dir)
        fm, _ = build_feature_matrix(df, spec)
        return fm if cols is None else fm.select("series_id", "ds", *cols)

    return fn


def _features_sql(panel: str, cols: list[str] | None, doubles: set[str]) -> str:
    spec = SPECS[panel]
    present = PANEL_COLUMNS[panel]
    names = feature_names_sql(spec, present)
    if cols is None:
        out = [*present, "series_id", *names, "ds", "y"]
    else:
        out = ["series_id", "ds", *cols]
    inner = features_cte(PANEL_SQL[panel], spec, present) + f"SELECT {', '.join(out)} FROM feat"
    dbl = [c for c in out if c in doubles]
    return rounded(inner, dbl, [c for c in out if c not in doubles])


def _doubles(spec) -> set[str]:
    d = set(_DOUBLE_SOURCE) | {"y"}
    for w in spec.rolling_windows:
        d |= {f"roll_{s}_{w}" for s in ("mean", "std", "min", "max")}
    d |= {f"lag_{L}" for L in spec.lags}
    for i, t in enumerate(spec.fourier):
        for k in range(1, t.order + 1):
            d |= {f"fourier{i}_sin{k}", f"fourier{i}_cos{k}"}
    d |= {"quantity_lag1"}
    return d


def _reg(name, ids, panel, cols, note=""):
    spec = SPECS[panel]
    register(name, ids, _features_sql(panel, cols, _doubles(spec)), note=note)(_features(panel, cols))


P1 = SPECS["P1"]
_reg("lag_features", ("W1", "O1"), "P1", [f"lag_{L}" for L in P1.lags], "lags by rows within a series")
_reg("rolling_mean", ("W2", "T5"), "P1", [f"roll_mean_{w}" for w in P1.rolling_windows], "frame (-w, -1), min_periods max(2, w//2)")
_reg("rolling_std", ("W3",), "P1", [f"roll_std_{w}" for w in P1.rolling_windows])
_reg(
    "rolling_minmax",
    ("W4",),
    "P1",
    [f"roll_{s}_{w}" for w in P1.rolling_windows for s in ("min", "max")],
)
_reg("exog_lag", ("W5",), "P5", ["quantity_lag1"], "exogenous column lagged by exogenous_lag rows")
_reg(
    "calendar_features",
    ("C1", "C2", "C3", "C4", "C5"),
    "P2",
    ["month", "weekofyear", "quarter", "dayofweek", "is_weekend"],
    "daily panel so weekends occur",
)
_reg("holiday_flag", ("C6", "J1"), "P2", ["is_holiday"], "US federal rules, evaluated inline (no join)")
_reg("fourier_features", ("C7", "C8"), "P2", [c for c in feature_names_sql(SPECS["P2"], []) if c.startswith("fourier")])
_reg("feature_matrix", ("W1", "W2", "W3", "W4", "W5", "C1", "C6", "C8", "F12"), "P1", None, "flagship weekly panel, full layout")
_reg("feature_matrix_daily", ("W1", "W2", "W3", "W4", "C1", "C8"), "P2", None, "daily panel, two Fourier terms")
_reg("feature_matrix_lineitem", ("W1", "W2", "W5", "C8"), "P5", None, "two id columns and a float exogenous")


@register(
    "holiday_calendar",
    ("A2", "J1"),
    "WITH base AS (" + prepared_sql(PANEL_SQL["P2"], SPECS["P2"]) + "),\n" + holiday_ctes("base") + "\nSELECT DISTINCT d AS date FROM hol",
    note="holiday dimension sized by the panel's year range",
)
def q_holiday_calendar(spark, sf_dir):
    df, spec = PANELS["P2"](spark, sf_dir)
    d = prepare_panel(df, spec)
    yr = year_range(d, "ds").first()  # one row, two integers
    return holiday_table(spark, int(yr["min_year"]), int(yr["max_year"])).select("date").distinct()


@register(
    "panel_year_range",
    ("A2",),
    "SELECT CAST(min(year(week)) AS INTEGER) AS min_year, CAST(max(year(week)) AS INTEGER) AS max_year FROM (" + PANEL_SQL["P1"] + ")",
)
def q_panel_year_range(spark, sf_dir):
    df, spec = PANELS["P1"](spark, sf_dir)
    return year_range(df, spec.date_col)


@register(
    "feature_rows_on_holidays",
    ("J1", "C6"),
    rounded(
        features_cte(PANEL_SQL["P1"], SPECS["P1"], PANEL_COLUMNS["P1"])
        + "SELECT series_id, ds, y FROM feat WHERE is_holiday = 1",
        ["y"],
        ["series_id", "ds"],
    ),
)
def q_feature_rows_on_holidays(spark, sf_dir):
    df, spec = PANELS["P1"](spark, sf_dir)
    fm, _ = build_feature_matrix(df, spec)
    return fm.where(F.col("is_holiday") == 1).select("series_id", "ds", "y")


_CALENDARS = ("DE", "FR", "GB", "US")


@register(
    "holiday_calendars",
    ("C6", "J1", "A2"),
    calendars_sql(PANEL_SQL["P2"]),
    note="holidays of four countries over the panel's years: movable feasts, observed days, years of validity",
)
def q_holiday_calendars(spark, sf_dir):
    df, _ = PANELS["P2"](spark, sf_dir)
    yr = year_range(df, "day").first()
    parts = [
        holiday_table(spark, int(yr["min_year"]), int(yr["max_year"]), c).select(F.lit(c).alias("country"), "date").distinct() for c in _CALENDARS
    ]
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out


@register(
    "feature_rows_on_holidays_abroad",
    ("C6", "J1"),
    calendars_sql(PANEL_SQL["P2"], prefix=f"base AS ({prepared_sql(PANEL_SQL['P2'], SPECS['P2'])}),\n", select="""
SELECT c.country, base.series_id, base.ds, base.y FROM base JOIN calendar AS c ON c.date = base.ds"""),
    note="inline flags of every country hold exactly on its calendar's dates",
)
def q_feature_rows_on_holidays_abroad(spark, sf_dir):
    df, spec = PANELS["P2"](spark, sf_dir)
    d = prepare_panel(df, spec)
    flags = F.array(*[F.when(is_holiday(F.col("ds"), c) == 1, F.lit(c)) for c in _CALENDARS])
    return d.select(F.explode(F.array_compact(flags)).alias("country"), "series_id", "ds", "y")
