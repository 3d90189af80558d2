"""Distances between distributions.

The two-sample Kolmogorov-Smirnov distance is the largest gap between two
cumulative shares. Values are counted first, so a frequent value is one row; the
counted values are dealt out by ranges, and every range adds the counts of the
ranges before it, which come from a table of one row per range. No task orders
all values.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hindcast.session import checkpoint_dir


def ks_distance(rows: DataFrame, value: str, is_first: Column, by: Sequence[str] = ()) -> DataFrame:
    """Per group ``by``: ``n_first``, ``n_second``, the exact ``distance``
    between the distributions of ``value`` in the rows where ``is_first`` holds
    and in the others, and ``at``, the smallest value where it is reached. Null
    and NaN values, and rows whose side is null, take no part; a group with one
    side only has distance null."""
    names = [f"__b{i}" for i in range(len(by))]
    side = rows.select(*[F.col(b).alias(n) for b, n in zip(by, names)], F.col(value).cast("double").alias("v"), is_first.alias("s"))
    side = side.where(F.col("s").isNotNull() & F.col("v").isNotNull() & ~F.isnan("v")).withColumn("v", F.col("v") + F.lit(0.0))
    counted = side.groupBy(*names, "v").agg(F.count_if("s").alias("a"), F.count_if(~F.col("s")).alias("b"))
    # the written table fixes which range a value is in
    path = f"{checkpoint_dir(rows.sparkSession).rstrip('/')}/ranges-{uuid.uuid4().hex}"
    counted.repartitionByRange(*names, "v").withColumn("range", F.spark_partition_id()).write.parquet(path)
    held = rows.sparkSession.read.parquet(path)
    whole = held.groupBy(*names, "range").agg(F.sum("a").alias("ra"), F.sum("b").alias("rb"))
    upto = Window.partitionBy(*names).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    of_group = Window.partitionBy(*names)
    sums = whole.select(
        *[F.col(n).alias(f"{n}r") for n in names], F.col("range").alias("r"),
        *[F.coalesce(F.sum(c).over(upto), F.lit(0)).alias(f"{c}_past") for c in ("ra", "rb")], *[F.sum(c).over(of_group).alias(f"{c}_all") for c in ("ra", "rb")],
    )
    inside = Window.partitionBy(*names, "range").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    same = F.col("range") == F.col("r")
    for n in names:
        same = same & F.col(n).eqNullSafe(F.col(f"{n}r"))
    run = held.withColumn("ca", F.sum("a").over(inside)).withColumn("cb", F.sum("b").over(inside)).join(sums, same)
    gap = F.abs((F.col("ca") + F.col("ra_past")) / F.col("ra_all") - (F.col("cb") + F.col("rb_past")) / F.col("rb_all"))
    out = run.withColumn("gap", F.when((F.col("ra_all") > 0) & (F.col("rb_all") > 0), gap)).groupBy(*names).agg(
        F.max("ra_all").alias("n_first"), F.max("rb_all").alias("n_second"), F.max("gap").alias("distance"),
        F.min_by("v", F.struct(-F.col("gap"), F.col("v"))).alias("nearest"), F.max("gap").isNull().alias("none"),
    )
    return out.select(*[F.col(n).alias(b) for n, b in zip(names, by)], "n_first", "n_second", "distance", F.when(~F.col("none"), F.col("nearest")).alias("at"))
