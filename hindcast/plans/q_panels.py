"""Queries: sources, panels, selection and series identity."""

from __future__ import annotations

from pyspark.sql import functions as F

from hindcast.functions.keys import series_key
from hindcast.operators.features import prepare_panel
from hindcast.operators.select import select_series, to_ds_y
from hindcast.operators.split import first_n_series
from hindcast.plans.catalog import register
from hindcast.plans.sqlgen import P1, P2, P3, P4, P5, prepared_sql, rounded
from hindcast.sources.panels import PANELS, materialized
from hindcast.sources.readers import read_table
from hindcast.spec import PanelSpec


def _panel(name: str):
    def fn(spark, sf_dir):
        df, spec = PANELS[name](spark, sf_dir)
        return prepare_panel(df, spec)

    return fn


def _panel_sql(panel_sql: str, spec_cols: list[str], id_cols: tuple[str, ...], date_col: str, target: str, doubles: list[str]) -> str:
    spec = PanelSpec(name="x", date_col=date_col, target_col=target, series_id_cols=id_cols)
    others = [c for c in spec_cols if c not in doubles] + ["series_id", "ds"]
    return rounded(prepared_sql(panel_sql, spec), doubles + ["y"], others)


register(
    "panel_weekly",
    ("S1", "S3", "F3", "A1"),
    _panel_sql(P1, ["o_orderpriority", "week", "total_price", "n_orders"], ("o_orderpriority",), "week", "total_price", ["total_price"]),
    note="P1: weekly order value per priority from a pruned parquet scan",
)(_panel("P1"))

register(
    "panel_daily",
    ("S1", "S3", "F3"),
    _panel_sql(P2, ["o_orderpriority", "day", "total_price"], ("o_orderpriority",), "day", "total_price", ["total_price"]),
    note="P2: daily, ragged",
)(_panel("P2"))

register(
    "panel_two_keys",
    ("S1", "F3"),
    _panel_sql(
        P3,
        ["o_orderpriority", "o_orderstatus", "week", "total_price"],
        ("o_orderpriority", "o_orderstatus"),
        "week",
        "total_price",
        ["total_price"],
    ),
    note="P3: 15 series keyed by two columns",
)(_panel("P3"))

register(
    "panel_events",
    ("S1", "S3", "F3"),
    _panel_sql(P4, ["event_type", "day", "total_value", "n_events"], ("event_type",), "day", "total_value", ["total_value"]),
    note="P4: daily event value per type",
)(_panel("P4"))

register(
    "panel_lineitem",
    ("S1", "S3", "F3"),
    _panel_sql(
        P5,
        ["l_returnflag", "l_linestatus", "week", "revenue", "quantity"],
        ("l_returnflag", "l_linestatus"),
        "week",
        "revenue",
        ["revenue", "quantity"],
    ),
    note="P5: weekly shipped value per flag/status, quantity exogenous",
)(_panel("P5"))


@register(
    "series_select",
    ("F1", "F2", "A1"),
    rounded(
        f"SELECT week AS ds, avg(total_price) AS y FROM ({P3}) AS p "
        "WHERE o_orderpriority = '1-URGENT' AND o_orderstatus = 'F' AND week IS NOT NULL GROUP BY week",
        ["y"],
        ["ds"],
    ),
)
def q_series_select(spark, sf_dir):
    """Conjunctive selectors on two id columns, then the [ds, y] projection."""
    df, spec = PANELS["P3"](spark, sf_dir)
    one = select_series(df, spec, {"o_orderpriority": "1-URGENT", "o_orderstatus": "F"})
    return to_ds_y(one, spec)


@register(
    "date_mean_collapse",
    ("A1", "F1"),
    rounded(
        f"SELECT week AS ds, avg(total_price) AS y FROM ({P3}) AS p "
        "WHERE o_orderpriority = '1-URGENT' AND week IS NOT NULL GROUP BY week",
        ["y"],
        ["ds"],
    ),
)
def q_date_mean_collapse(spark, sf_dir):
    """A selector that leaves several rows per date: mean per date."""
    df, spec = PANELS["P3"](spark, sf_dir)
    return to_ds_y(select_series(df, spec, {"o_orderpriority": "1-URGENT"}), spec)


_NULL_KEY_SQL = """SELECT coalesce(CAST(o_orderpriority AS VARCHAR), 'None') || '|' || coalesce(CAST(status AS VARCHAR), 'None') AS series_id,
       COUNT(*) AS n_rows
FROM (SELECT o_orderpriority, CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_orderstatus END AS status FROM orders) AS o
GROUP BY 1"""


@register("series_key_nulls", ("F3", "U1"), _NULL_KEY_SQL, note="T3: a null id part is written 'None' and never collapses")
def q_series_key_nulls(spark, sf_dir):
    o = read_table(spark, sf_dir, "orders").select(
        "o_orderpriority", F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus")).alias("status")
    )
    spec = PanelSpec(name="x", date_col="d", target_col="y", series_id_cols=("o_orderpriority", "status"))
    return o.groupBy(series_key(spec).alias("series_id")).agg(F.count(F.lit(1)).alias("n_rows"))


@register(
    "first_n_series",
    ("F10", "O4", "U1"),
    rounded(
        f"""WITH base AS ({prepared_sql(P3, PanelSpec(name='x', date_col='week', target_col='total_price', series_id_cols=('o_orderpriority', 'o_orderstatus')))}),
keep AS (SELECT series_id FROM (SELECT series_id, min(ds) AS f FROM base GROUP BY series_id) ORDER BY f, series_id LIMIT 4)
SELECT series_id, ds, y FROM base WHERE series_id IN (SELECT series_id FROM keep)""",
        ["y"],
        ["series_id", "ds"],
    ),
)
def q_first_n_series(spark, sf_dir):
    """The first 4 series by (first date, id), all their rows."""
    df, spec = materialized("P3", spark, sf_dir)
    d = prepare_panel(df, spec)
    return first_n_series(d, 4).select("series_id", "ds", "y")
