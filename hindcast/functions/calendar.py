"""Calendar and Fourier column expressions.

All are built-in Catalyst expressions: they stay inside whole-stage codegen
and the Fourier constants are folded at plan time.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from hindcast.spec import FOURIER_EPOCH, PanelSpec


def week_start(d: Column) -> Column:
    """Monday of the ISO week containing date ``d``."""
    return F.date_sub(d, F.weekday(d))


def weekday_mon0(d: Column) -> Column:
    """Day of week with Monday = 0 (``dayofweek`` would be Sunday = 1)."""
    return F.weekday(d)


def calendar_columns(ds: Column) -> list[Column]:
    """month, ISO week, quarter, day of week, weekend flag -- in contract order."""
    return [
        F.month(ds).alias("month"),
        F.weekofyear(ds).alias("weekofyear"),
        F.quarter(ds).alias("quarter"),
        weekday_mon0(ds).alias("dayofweek"),
        (weekday_mon0(ds) >= 5).cast("int").alias("is_weekend"),
    ]


def days_since_epoch(ds: Column, sub_daily: bool = False) -> Column:
    """Whole days since the Fourier epoch, floored (negative before it)."""
    if sub_daily:
        secs = F.unix_seconds(ds.cast("timestamp")) - F.unix_seconds(F.lit(FOURIER_EPOCH).cast("timestamp"))
        return F.floor(secs / 86400)
    return F.datediff(ds, F.lit(FOURIER_EPOCH).cast("date"))


def fourier_columns(ds: Column, spec: PanelSpec, sub_daily: bool = False) -> list[Column]:
    """``fourier{i}_sin{k}``, ``fourier{i}_cos{k}`` for every term and harmonic."""
    t = days_since_epoch(ds, sub_daily).cast("double")
    out: list[Column] = []
    for i, term in enumerate(spec.fourier):
        period_days = term.period * spec.step_days
        for k in range(1, term.order + 1):
            ang = t * F.lit(2.0 * math.pi * k / period_days)
            out.append(F.sin(ang).alias(f"fourier{i}_sin{k}"))
            out.append(F.cos(ang).alias(f"fourier{i}_cos{k}"))
    return out


def fourier_names(spec: PanelSpec) -> list[str]:
    return [
        f"fourier{i}_{fn}{k}"
        for i, term in enumerate(spec.fourier)
        for k in range(1, term.order + 1)
        for fn in ("sin", "cos")
    ]


CALENDAR_NAMES = ["month", "weekofyear", "quarter", "dayofweek", "is_weekend", "is_holiday"]
