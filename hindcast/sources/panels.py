"""Panels derived from the driver's tables (FIXTURES.md P1-P5).

Each builder is one grouped aggregate over a pruned parquet scan: Spark reads
only the referenced columns and combines partial sums map-side, so a hot
series id costs one partial row per input partition, never a whole group in
one task. Money is summed as exact integer cents and converted once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hindcast.functions.calendar import week_start
from hindcast.session import cut_lineage
from hindcast.sources.readers import read_table
from hindcast.spec import FourierTerm, PanelSpec


def cents(c: Column) -> Column:
    """Whole cents, halves away from zero, as ``round`` makes them, which writes
    every value out in decimal digits."""
    x = c * 100
    near = F.rint(x)
    return F.when(F.abs(x - near) == 0.5, x + F.signum(x) * 0.5).otherwise(near).cast("bigint")


def cents_to_double(c: Column) -> Column:
    return c.cast("double") / 100


# Feature recipes suggested for the weekly and daily panels.
WEEKLY_FEATURES = dict(
    lags=(1, 2, 3, 4, 8, 12, 52),
    rolling_windows=(4, 8, 12, 52),
    fourier=(FourierTerm(52.143, 4),),
    horizon=12,
    freq="W",
)
DAILY_FEATURES = dict(
    lags=(1, 7, 14, 28),
    rolling_windows=(7, 28),
    fourier=(FourierTerm(7, 3), FourierTerm(365.25, 6)),
    horizon=28,
    freq="D",
)


P1_SPEC = PanelSpec(
    name="orders_weekly",
    date_col="week",
    target_col="total_price",
    series_id_cols=("o_orderpriority",),
    exogenous_cols=("n_orders",),
    holiday_country="US",
    default_series={"o_orderpriority": "1-URGENT"},
    **WEEKLY_FEATURES,
)

P2_SPEC = PanelSpec(
    name="orders_daily",
    date_col="day",
    target_col="total_price",
    series_id_cols=("o_orderpriority",),
    holiday_country="US",
    **DAILY_FEATURES,
)

P3_SPEC = PanelSpec(
    name="orders_status_weekly",
    date_col="week",
    target_col="total_price",
    series_id_cols=("o_orderpriority", "o_orderstatus"),
    holiday_country="US",
    **WEEKLY_FEATURES,
)

P4_SPEC = PanelSpec(
    name="events_daily",
    date_col="day",
    target_col="total_value",
    series_id_cols=("event_type",),
    exogenous_cols=("n_events",),
    horizon=7,
    freq="D",
    lags=(1, 7),
    rolling_windows=(7,),
    fourier=(FourierTerm(7, 3),),
)

P5_SPEC = PanelSpec(
    name="lineitem_weekly",
    date_col="week",
    target_col="revenue",
    series_id_cols=("l_returnflag", "l_linestatus"),
    exogenous_cols=("quantity",),
    holiday_country="US",
    **WEEKLY_FEATURES,
)

P6_SPEC = PanelSpec(
    name="parts_weekly",
    date_col="week",
    target_col="revenue",
    series_id_cols=("l_partkey",),
    exogenous_cols=("quantity",),
    holiday_country="US",
    **WEEKLY_FEATURES,
)


def orders_weekly(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, PanelSpec]:
    """Weekly order value per priority, order count as exogenous."""
    o = read_table(spark, sf_dir, "orders").where(F.col("o_orderdate").isNotNull())
    df = o.groupBy("o_orderpriority", week_start(F.to_date("o_orderdate")).alias("week")).agg(
        cents_to_double(F.sum(cents(F.col("o_totalprice")))).alias("total_price"),
        F.count(F.lit(1)).alias("n_orders"),
    )
    return df, P1_SPEC


def orders_daily(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, PanelSpec]:
    """Daily order value per priority (ragged)."""
    o = read_table(spark, sf_dir, "orders").where(F.col("o_orderdate").isNotNull())
    df = o.groupBy("o_orderpriority", F.to_date("o_orderdate").alias("day")).agg(
        cents_to_double(F.sum(cents(F.col("o_totalprice")))).alias("total_price")
    )
    return df, P2_SPEC


def orders_status_weekly(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, PanelSpec]:
    """Priority x status, 15 ragged weekly series with two id columns."""
    o = read_table(spark, sf_dir, "orders").where(F.col("o_orderdate").isNotNull())
    df = o.groupBy(
        "o_orderpriority", "o_orderstatus", week_start(F.to_date("o_orderdate")).alias("week")
    ).agg(cents_to_double(F.sum(cents(F.col("o_totalprice")))).alias("total_price"))
    return df, P3_SPEC


def events_daily(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, PanelSpec]:
    """Daily event value per event type, event count as exogenous."""
    e = read_table(spark, sf_dir, "events").where(F.col("ts").isNotNull())
    df = e.groupBy("event_type", F.to_date("ts").alias("day")).agg(
        cents_to_double(F.sum(cents(F.col("value")))).alias("total_value"),
        F.count(F.lit(1)).alias("n_events"),
    )
    return df, P4_SPEC


def lineitem_weekly(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, PanelSpec]:
    """P5: weekly shipped value per (return flag, line status); quantity is
    the exogenous column and therefore the WRMSSE weight source."""
    li = read_table(spark, sf_dir, "lineitem").where(F.col("l_shipdate").isNotNull())
    df = li.groupBy(
        "l_returnflag", "l_linestatus", week_start(F.to_date("l_shipdate")).alias("week")
    ).agg(
        cents_to_double(F.sum(cents(F.col("l_extendedprice")))).alias("revenue"),
        cents_to_double(F.sum(cents(F.col("l_quantity")))).alias("quantity"),
    )
    return df, P5_SPEC


def parts_weekly(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, PanelSpec]:
    """Weekly shipped value per part -- a sparse, ragged panel whose
    number of series grows with the data (the volume panel)."""
    li = read_table(spark, sf_dir, "lineitem").where(F.col("l_shipdate").isNotNull())
    df = li.groupBy("l_partkey", week_start(F.to_date("l_shipdate")).alias("week")).agg(
        cents_to_double(F.sum(cents(F.col("l_extendedprice")))).alias("revenue"),
        cents_to_double(F.sum(cents(F.col("l_quantity")))).alias("quantity"),
    )
    return df, P6_SPEC


PANELS = {
    "P1": orders_weekly,
    "P2": orders_daily,
    "P3": orders_status_weekly,
    "P4": events_daily,
    "P5": lineitem_weekly,
    "P6": parts_weekly,
}

SPECS = {"P1": P1_SPEC, "P2": P2_SPEC, "P3": P3_SPEC, "P4": P4_SPEC, "P5": P5_SPEC, "P6": P6_SPEC}

# Source columns of each panel (what the builder emits), in order.
PANEL_COLUMNS = {
    "P1": ["o_orderpriority", "week", "total_price", "n_orders"],
    "P2": ["o_orderpriority", "day", "total_price"],
    "P3": ["o_orderpriority", "o_orderstatus", "week", "total_price"],
    "P4": ["event_type", "day", "total_value", "n_events"],
    "P5": ["l_returnflag", "l_linestatus", "week", "revenue", "quantity"],
    "P6": ["l_partkey", "week", "revenue", "quantity"],
}


def materialized(key: str, spark: SparkSession, sf_dir: str) -> tuple[DataFrame, PanelSpec]:
    """The panel aggregated ONCE and reliably checkpointed into the shared
    checkpoint folder. Plans that need the panel more than once -- e.g. the
    global cutoff (a scalar subquery over the panel's dates) next to the
    features -- then read the small aggregated panel instead of scanning and
    shuffling the raw table again."""
    df, spec = PANELS[key](spark, sf_dir)
    return cut_lineage(df), spec
