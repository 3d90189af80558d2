"""Scans of raw panels (CSV / Parquet) with the load-time checks."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hindcast.spec import PanelSpec

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def path_exists(spark: SparkSession, path: str) -> bool:
    """Existence check through the Hadoop file system (local, HDFS, object stores)."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return bool(fs.exists(p))


def table_path(sf_dir: str, name: str) -> str:
    return os.path.join(sf_dir, f"{name}.parquet")


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's parquet tables; column pruning and filter pushdown
    happen in the scan as soon as a plan projects/filters it."""
    path = table_path(sf_dir, name)
    if not path_exists(spark, path):
        raise FileNotFoundError(f"table {name!r} not found at {path}")
    return spark.read.parquet(path)


def require_columns(df: DataFrame, cols, what: str = "panel") -> None:
    """Fail before any job runs when a role column is absent."""
    missing = [c for c in cols if c not in df.columns]
    if missing:
        raise KeyError(f"expected column(s) {missing} in {what}; got columns {df.columns}")


def nan_to_null(c: Column) -> Column:
    """pandas treats NaN as missing; Spark aggregates count it. Normalise once."""
    return F.when(~F.isnan(c), c)


def parse_dates(df: DataFrame, col: str, *, lenient: bool = False, sub_daily: bool = False) -> DataFrame:
    """Date parse (S3). Strict by default: a malformed value fails the job
    (ANSI mode), as ``pd.to_datetime`` raises; ``lenient`` yields null."""
    dt = df.schema[col].dataType
    if isinstance(dt, T.DateType) and not sub_daily:
        return df
    if isinstance(dt, (T.TimestampType, T.TimestampNTZType)):
        parsed = F.col(col).cast("timestamp_ntz") if sub_daily else F.to_date(F.col(col))
    elif isinstance(dt, T.StringType):
        fn = F.try_to_timestamp if lenient else F.to_timestamp_ntz
        ts = fn(F.col(col))
        parsed = ts.cast("timestamp_ntz") if sub_daily else F.to_date(ts)
    else:
        parsed = F.col(col).cast("timestamp_ntz" if sub_daily else "date")
    return df.withColumn(col, parsed)


def read_panel(
    spark: SparkSession,
    path: str,
    spec: PanelSpec,
    *,
    fmt: str = "parquet",
    schema: T.StructType | str | None = None,
) -> DataFrame:
    """Load a raw panel (S1-S3). CSV is read with an explicit schema in
    FAILFAST mode when one is given; the date column is parsed; NaN targets
    and exogenous values become null. No sort is materialised (S4): order
    lives in each window specification."""
    if not path_exists(spark, path):
        raise FileNotFoundError(f"raw data for {spec.name!r} not found at {path}")
    reader = spark.read
    if schema is not None:
        reader = reader.schema(schema)
    if fmt == "csv":
        df = reader.option("header", True).option("mode", "FAILFAST").csv(path)
    else:
        df = reader.format(fmt).load(path)
    require_columns(df, [spec.date_col], what=path)
    df = parse_dates(df, spec.date_col)
    numeric = (T.FloatType, T.DoubleType)
    for c in (spec.target_col, *spec.exogenous_cols):
        if c in df.columns and isinstance(df.schema[c].dataType, numeric):
            df = df.withColumn(c, nan_to_null(F.col(c)))
    return df
