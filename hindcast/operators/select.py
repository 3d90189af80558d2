"""Series selection and role projections."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hindcast.sources.readers import require_columns
from hindcast.spec import PanelSpec


def select_series(df: DataFrame, spec: PanelSpec, selectors: dict | None = None, *, check_empty: bool = False) -> DataFrame:
    """F1 + A1: keep rows matching every ``column == value`` selector (the
    spec's ``default_series`` when None) and return one row per date with the
    mean target, as ``[date_col, target_col]``.

    Unknown columns raise before any job. Selector literals are cast to the
    column's type (T12). The emptiness check costs a job and is opt-in.
    """
    sel = dict(spec.default_series) if selectors is None else dict(selectors)
    for c in sel:
        if c not in df.columns:
            raise KeyError(f"series-id column {c!r} not in data; have {df.columns}")
    cond = reduce(lambda a, b: a & b, [F.col(c) == F.lit(v).cast(df.schema[c].dataType) for c, v in sel.items()], F.lit(True))
    sub = df.where(cond)
    out = (
        sub.where(F.col(spec.date_col).isNotNull())
        .groupBy(spec.date_col)
        .agg(F.avg(F.col(spec.target_col)).alias(spec.target_col))
    )
    if check_empty and out.isEmpty():
        raise ValueError(f"no rows for series {sel!r} in dataset {spec.name!r}")
    return out


def to_ds_y(df: DataFrame, spec: PanelSpec) -> DataFrame:
    """role projection to ``[ds, y]``."""
    require_columns(df, [spec.date_col, spec.target_col])
    return df.select(F.col(spec.date_col).alias("ds"), F.col(spec.target_col).cast("double").alias("y"))


def drop_missing_target(df: DataFrame, y: str = "y") -> DataFrame:
    """rows without a target cannot be fitted."""
    return df.dropna(subset=[y])


def check_unique(df: DataFrame, keys=("series_id", "ds")) -> None:
    """Duplicate (series, date) rows make row-based lags ambiguous.
    One aggregate job; raises on the first duplicate found."""
    dup = df.groupBy(*keys).count().where(F.col("count") > 1).limit(1).collect()
    if dup:
        raise ValueError(f"duplicate rows for key {dict(zip(keys, dup[0][: len(keys)]))}")
