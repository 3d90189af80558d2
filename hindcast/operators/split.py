"""Time splits, horizon masking and series eligibility.

The global cutoff is a *scalar subquery*: Spark evaluates "the H-th largest
distinct date" as a tiny separate job (distinct dates are pre-aggregated
map-side, then a bounded top-H) and inlines the value into the filter, so
no panel-wide unpartitioned window and no cross join appear in the plan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hindcast.spec import PanelSpec, freq_anchor, parse_freq


def horizon_dates(df: DataFrame, horizon: int, ds: str = "ds") -> DataFrame:
    """O2 / A4: the last ``horizon`` distinct dates of the panel."""
    if horizon < 1:
        raise ValueError("horizon must be >= 1")
    return df.select(F.col(ds).alias("ds")).where(F.col("ds").isNotNull()).distinct().orderBy(F.col("ds").desc()).limit(horizon)


def cutoff_frame(df: DataFrame, horizon: int, ds: str = "ds") -> DataFrame:
    """One row: the cutoff (H-th largest distinct date) and the number of
    distinct dates seen in the top H. Fewer than H distinct dates is an error,
    as indexing ``unique()[-H]`` is in the reference."""
    top = horizon_dates(df, horizon, ds)
    n = F.count(F.lit(1))
    return top.agg(
        F.when(n < F.lit(horizon), F.raise_error(F.lit(f"panel has fewer than {horizon} distinct dates")))
        .otherwise(F.min("ds"))
        .alias("cutoff")
    )


def panel_cutoff(df: DataFrame, horizon: int, ds: str = "ds") -> Column:
    """The global cutoff as a scalar-subquery column."""
    return cutoff_frame(df, horizon, ds).scalar()


def panel_split(df: DataFrame, horizon: int, ds: str = "ds", cutoff: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """train = dates before the cutoff, test = from the cutoff on, for
    every series (global cutoff, T7)."""
    c = panel_cutoff(df, horizon, ds) if cutoff is None else cutoff
    return df.where(F.col(ds) < c), df.where(F.col(ds) >= c)


def tail_part(df: DataFrame, horizon: int, *, on_short: str = "error") -> DataFrame:
    """W7 in one pass: ``part`` is ``test`` on the last ``horizon`` rows of a
    series and ``train`` before them (one window over one ordering).

    A series with ``rows <= horizon`` raises, or, with ``on_short='skip'``, is
    left out.
    """
    if horizon < 1:
        raise ValueError("horizon must be >= 1")
    late_first = Window.partitionBy("series_id").orderBy(F.col("ds").desc())
    whole = late_first.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    tagged = df.withColumns({"__rn": F.row_number().over(late_first), "__n": F.count(F.lit(1)).over(whole)})
    part = F.when(F.col("__rn") <= F.lit(horizon), F.lit("test")).otherwise(F.lit("train"))
    if on_short == "error":
        message = F.concat(F.lit("series "), F.col("series_id"), F.lit(f" has too few rows for horizon {horizon}"))
        part = F.when(F.col("__n") <= F.lit(horizon), F.raise_error(message).cast("string")).otherwise(part)
    else:
        tagged = tagged.where(F.col("__n") > F.lit(horizon))
    return tagged.withColumn("part", part).drop("__rn", "__n")


def tail_split(df: DataFrame, horizon: int, *, on_short: str = "error") -> tuple[DataFrame, DataFrame]:
    """W7 as two frames (see :func:`tail_part`)."""
    parts = tail_part(df, horizon, on_short=on_short)
    train, test = (parts.where(F.col("part") == F.lit(name)).drop("part") for name in ("train", "test"))
    return train, test


def mask_horizon(df: DataFrame, cutoff: Column, target: str = "y", ds: str = "ds") -> DataFrame:
    """F8: hide the target inside the horizon."""
    return df.withColumn(target, F.when(F.col(ds) < cutoff, F.col(target)))


def series_eligibility(df: DataFrame, cutoff: Column, ds: str = "ds") -> DataFrame:
    """Per series: training rows, test rows and whether it can be scored
    (F11: at least 2 training rows and at least one test row)."""
    flagged = df.select("series_id", (F.col(ds) < cutoff).alias("__train"))
    agg = flagged.groupBy("series_id").agg(
        F.count(F.when(F.col("__train"), 1)).alias("n_train"),
        F.count(F.when(~F.col("__train"), 1)).alias("n_test"),
    )
    return agg.withColumn("eligible", (F.col("n_train") >= 2) & (F.col("n_test") >= 1))


def skip_short_series(df: DataFrame, cutoff: Column, ds: str = "ds", min_train: int = 2) -> DataFrame:
    """keep rows of series with >= ``min_train`` training rows and at
    least one test row (semi join against a per-series aggregate)."""
    ok = (
        df.select("series_id", (F.col(ds) < cutoff).alias("__train"))
        .groupBy("series_id")
        .agg(
            F.count(F.when(F.col("__train"), 1)).alias("n_train"),
            F.count(F.when(~F.col("__train"), 1)).alias("n_test"),
        )
        .where((F.col("n_train") >= min_train) & (F.col("n_test") >= 1))
        .select("series_id")
    )
    return df.join(ok, "series_id", "left_semi")


def first_n_series(df: DataFrame, n: int, ds: str = "ds") -> DataFrame:
    """The first ``n`` series by (first date, series_id) -- a
    deterministic stand-in for the reference's encounter order (T6). The top-n
    is a bounded TakeOrderedAndProject; the semi join is against <= n keys."""
    if n < 1:
        raise ValueError("n must be >= 1")
    firsts = df.groupBy("series_id").agg(F.min(ds).alias("__first"))
    keep = firsts.orderBy("__first", "series_id").limit(n).select("series_id")
    return df.join(keep, "series_id", "left_semi")


_MONTHS = {"M": 1, "Q": 3, "Y": 12}


def date_step(d: Column, i: Column, freq: str) -> Column:
    """``d`` advanced by ``i >= 0`` periods of ``freq``. Where ``freq`` names
    certain dates (period starts or ends, business days, a weekday), the first
    step from another date goes to the next of them."""
    mult, unit = parse_freq(freq)
    at = freq_anchor(freq)
    if at is None:
        return F.date_add(d, (i * mult * (7 if unit == "W" else 1)).cast("int"))
    # the latest such date that is not after d, and the date n of them later
    if at == "business":
        last = F.date_sub(d, F.greatest(F.weekday(d) - 4, F.lit(0)))
    elif unit == "W":
        last = F.date_sub(d, F.pmod(F.weekday(d) - at, F.lit(7)))
    else:
        first = F.trunc(d, {"M": "month", "Q": "quarter", "Y": "year"}[unit])
        end = F.last_day(F.add_months(first, _MONTHS[unit] - 1))
        last = first if at == "start" else F.when(end == d, d).otherwise(F.date_sub(first, 1))
    n = F.when(last == d, i * mult).otherwise((i - 1) * mult + 1).cast("int")
    if at == "business":
        day = F.weekday(last) + n
        to = F.date_add(last, (F.floor(day / 5) * 7 + F.pmod(day, F.lit(5)) - F.weekday(last)).cast("int"))
    elif unit == "W":
        to = F.date_add(last, n * 7)
    else:
        to = F.add_months(last, n * _MONTHS[unit])
        to = F.last_day(to) if at == "end" else to
    return F.when(i == 0, d).otherwise(to)


def future_dates(df: DataFrame, spec: PanelSpec, ds: str = "ds", include_history: bool = True) -> DataFrame:
    """K7: per series, history dates plus ``horizon`` periods after the last."""
    last = df.groupBy("series_id").agg(F.max(ds).alias("__last"))
    fut = last.select(
        "series_id",
        F.explode(F.sequence(F.lit(1), F.lit(spec.horizon))).alias("__i"),
        "__last",
    ).select("series_id", date_step(F.col("__last"), F.col("__i"), spec.freq).alias("ds"))
    fut = fut.withColumn("is_future", F.lit(True))
    if not include_history:
        return fut
    hist = df.select("series_id", F.col(ds).alias("ds")).withColumn("is_future", F.lit(False))
    return hist.unionByName(fut)


def date_membership(df: DataFrame, dates: DataFrame, keep: bool = True, ds: str = "ds") -> DataFrame:
    """Rows whose date is (not) among ``dates`` -- semi / anti
    join; keeps duplicates, unlike EXCEPT."""
    d = dates.select(F.col(ds).alias(ds)).distinct()
    return df.join(d, ds, "left_semi" if keep else "left_anti")


def densify(df: DataFrame, spec: PanelSpec, ds: str = "ds") -> DataFrame:
    """T4 helper (opt-in): give every series one row per period between its
    first and last date, with null target where the period was missing, so
    that row-based lags become period-based. The calendar of a series is
    generated with ``sequence`` (bounded by the series' span) and joined to the
    panel on (series_id, ds). No row of the panel is lost: one that lies off
    the calendar stays next to it."""
    mult, unit = parse_freq(spec.freq)
    shortest = mult * {"D": 1, "W": 7, "M": 28, "Q": 90, "Y": 365}[unit]
    span = df.groupBy("series_id").agg(F.min(ds).alias("__lo"), F.max(ds).alias("__hi"))
    # a first step to the calendar may be shorter than a period
    steps = (F.datediff("__hi", "__lo") / F.lit(shortest)).cast("int") + 1
    grid = span.select("series_id", "__lo", "__hi", F.explode(F.sequence(F.lit(0), steps)).alias("__i"))
    grid = grid.withColumn(ds, date_step(F.col("__lo"), F.col("__i"), spec.freq)).where(F.col(ds) <= F.col("__hi"))
    return grid.select("series_id", ds).join(df, ["series_id", ds], "full_outer")
