"""As-of joins: what was known at a time.

For every row of the left side, the last row of the right side with the same key
and a time at or before the left row's. Both sides are unioned and the last right
value is carried down each key in the order of time: a sort and one pass, with no
range condition in a join. A key with many rows is cut into stretches of time; a
stretch begins with the last value of the stretches before it, which comes from a
table of one row per key and stretch, so no task holds more than a stretch.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def as_of_join(
    left: DataFrame, right: DataFrame, keys: Sequence[str], left_time: str, right_time: str, values: Sequence[str], stretch_days: float | None = None
) -> DataFrame:
    """``left`` with the columns ``right_time`` and ``values`` of the matching
    right row, null where there is none. Times may be dates or timestamps.

    Of several right rows at one time the one with the largest values, in their
    order, counts. Right rows without a time never match; left rows without a
    time or with a null key match nothing; repeated left rows all stay. With
    ``stretch_days`` keys are cut into stretches of so many days."""
    taken = {*keys, right_time, *values}
    clash = [c for c in left.columns if c in taken and c not in keys]
    if clash:
        raise ValueError(f"columns of the left side that the result would repeat: {clash}")
    at = lambda c: F.col(c).cast("timestamp")
    known = F.struct(F.col(right_time).alias("t"), *[F.col(v).alias(f"v{i}") for i, v in enumerate(values)])
    rows = right.where(F.col(right_time).isNotNull()).select(*keys, at(right_time).alias("__at"), known.alias("__known"), F.lit(None).alias("__row"))
    asks = left.select(*keys, at(left_time).alias("__at"), F.lit(None).alias("__known"), F.struct(*[F.col(f"`{c}`") for c in left.columns]).alias("__row"))
    asks = asks.withColumn("__known", F.col("__known").cast(rows.schema["__known"].dataType))
    rows = rows.withColumn("__row", F.col("__row").cast(asks.schema["__row"].dataType))
    both = rows.unionByName(asks)
    stretch: Column = F.lit(0).cast("long")
    if stretch_days:
        stretch = F.floor(F.col("__at").cast("double") / F.lit(86400.0 * stretch_days)).cast("long")
    both = both.withColumn("__stretch", stretch)
    # at one time right rows come first, the smaller values before the larger
    order = [F.col("__at").asc_nulls_first(), F.col("__row").isNotNull().asc(), F.col("__known").asc_nulls_first()]
    w = Window.partitionBy(*keys, "__stretch").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = both.withColumn("__last", F.last("__known", ignorenulls=True).over(w)).where(F.col("__row").isNotNull())
    if stretch_days:
        ends = both.groupBy(*keys, "__stretch").agg(F.max_by("__known", F.when(F.col("__known").isNotNull(), F.struct("__at", "__known"))).alias("__end"))
        past = Window.partitionBy(*keys).orderBy(F.col("__stretch").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
        carried = ends.select(*keys, "__stretch", F.last("__end", ignorenulls=True).over(past).alias("__carried"))
        out = out.join(carried, [*keys, "__stretch"], "left").withColumn("__last", F.coalesce("__last", "__carried"))
    lives = F.col("__at").isNotNull()
    for k in keys:
        lives = lives & F.col(k).isNotNull()
    last = F.when(lives, F.col("__last"))
    return out.select("__row.*", last["t"].alias(right_time), *[last[f"v{i}"].alias(v) for i, v in enumerate(values)])
