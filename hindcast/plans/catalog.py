"""Registry of named queries: a Spark plan and its DuckDB oracle.

Each entry reads the driver's tables (or data Spark derives from them), so
its work grows with the scale factor. ``for_check`` applies the check-layer
rounding ``round(x + 1e-7, 4)`` to double columns on the Spark side; the SQL
side applies the same rounding (SURVEY T19) -- the library itself never rounds.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

QueryFn = Callable[[SparkSession, str], DataFrame]


@dataclass
class Query:
    name: str
    ids: tuple[str, ...]
    run: QueryFn
    sql: str | None = None
    note: str = ""
    tags: tuple[str, ...] = field(default_factory=tuple)


REGISTRY: dict[str, Query] = {}


def rounded(c: Column, digits: int = 4) -> Column:
    """``round(c, digits)`` of a double, bit for bit, without writing each value
    out in decimal digits as ``round`` does.

    Below 1e10 a tie has at most 15 digits, so a value is at or above it exactly
    if it is not less than the double nearest to the tie. The rest goes through
    ``round``, in a lambda: its code is not made part of the projection's, which
    for some thirty columns would be a method too long for the JVM to compile."""
    unit = F.lit(10.0**digits)
    size = F.abs(c)
    below = F.floor(size * unit).cast("double")
    up = F.when(size >= (below + 0.5) / unit, below + 1.0).otherwise(below)
    exact = F.transform(F.array(c), lambda x: F.round(x, digits))[0]
    return F.when(size < F.lit(1e10), F.signum(c) * up / unit).otherwise(exact)


def for_check(df: DataFrame) -> DataFrame:
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            # "+ 0.0" normalises a negative zero after rounding
            cols.append((rounded(F.col(f.name).cast("double") + F.lit(1e-7)) + F.lit(0.0)).alias(f.name))
        else:
            cols.append(F.col(f.name))
    return df.select(*cols)


def register(name: str, ids: tuple[str, ...], sql: str | None = None, note: str = "", tags=()):
    def deco(fn: QueryFn) -> QueryFn:
        if name in REGISTRY:
            raise ValueError(f"duplicate query {name}")

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return for_check(fn(spark, sf_dir))

        run.__name__ = fn.__name__
        run.__doc__ = fn.__doc__
        REGISTRY[name] = Query(name, ids, run, sql, note, tuple(tags))
        return fn

    return deco


def load_all() -> dict[str, Query]:
    # importing the modules registers their queries
    from hindcast.plans import q_features, q_panels  # noqa: F401

    for mod in ("q_splits", "q_metrics", "q_models", "q_model_checks", "q_monitor", "q_sinks", "q_states", "q_streaming", "q_volume"):
        try:
            __import__(f"hindcast.plans.{mod}")
        except ModuleNotFoundError as e:  # pragma: no cover - during development
            if e.name != f"hindcast.plans.{mod}":
                raise
    return REGISTRY
