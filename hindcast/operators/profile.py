"""Column profile and schema/range drift check.

The profile is ONE aggregate job: min and max of every numeric and
date/time column are computed in a single pass with map-side partial
aggregation, then the one-row result is unpivoted into
``profile(column, dtype, min_num, max_num, min_str, max_str)``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)
_TEMPORAL = (T.DateType, T.TimestampType, T.TimestampNTZType)

PROFILE_SCHEMA = "column string, dtype string, min_num double, max_num double, min_str string, max_str string"


def column_profile(df: DataFrame, columns: list[str] | None = None, by: str | None = None) -> DataFrame:
    """Dtype for every column; min/max for numeric (as double) and
    date/time columns (as ISO text) only. With ``by``, one profile per value
    of that column -- still a single aggregate over the data."""
    cols = columns or [c for c in df.columns if c != by]
    aggs = []
    entries = []
    for c in cols:
        dt = df.schema[c].dataType
        kind = "num" if isinstance(dt, _NUMERIC) else "time" if isinstance(dt, _TEMPORAL) else "other"
        if kind == "num":
            aggs += [F.min(F.col(c)).cast("double").alias(f"{c}__min"), F.max(F.col(c)).cast("double").alias(f"{c}__max")]
        elif kind == "time":
            aggs += [F.min(F.col(c)).cast("string").alias(f"{c}__min"), F.max(F.col(c)).cast("string").alias(f"{c}__max")]
        entries.append((c, dt.simpleString(), kind))
    if not aggs:
        aggs = [F.count(F.lit(1)).alias("__n")]
    one = df.groupBy(by).agg(*aggs) if by else df.agg(*aggs)
    structs = []
    for c, dtype, kind in entries:
        num = kind == "num"
        tim = kind == "time"
        structs.append(
            F.struct(
                F.lit(c).alias("column"),
                F.lit(dtype).alias("dtype"),
                (F.col(f"`{c}__min`") if num else F.lit(None).cast("double")).alias("min_num"),
                (F.col(f"`{c}__max`") if num else F.lit(None).cast("double")).alias("max_num"),
                (F.col(f"`{c}__min`") if tim else F.lit(None).cast("string")).alias("min_str"),
                (F.col(f"`{c}__max`") if tim else F.lit(None).cast("string")).alias("max_str"),
            )
        )
    keep = [by] if by else []
    return one.select(*keep, F.explode(F.array(*structs)).alias("p")).select(*keep, "p.*")


def profile_violations(reference: DataFrame, current: DataFrame) -> DataFrame:
    """X11: compare a current profile with the stored one. Emits
    ``(column, kind, detail, ref_value, cur_value)`` for missing and extra
    columns, dtype changes, and values below the reference minimum or above
    its maximum. Both profiles are tiny (one row per column)."""
    both = reference.withColumn("__ref", F.lit(True)).unionByName(current.withColumn("__ref", F.lit(False)))
    return sided_violations(both, "__ref")


def sided_violations(both: DataFrame, is_ref: str) -> DataFrame:
    """Violations from one profile table holding both sides (``is_ref``
    marks the reference rows): the sides are pivoted by one conditional
    aggregate on ``column`` -- no self-join, so a profile computed with
    ``column_profile(df, by=...)`` is evaluated once."""
    side = F.col(is_ref)

    def pick(cond, c):
        return F.max(F.when(cond, F.col(c)))

    g = both.groupBy("column").agg(
        F.max(F.when(side, F.lit(True))).alias("in_ref"),
        F.max(F.when(~side, F.lit(True))).alias("in_cur"),
        *[pick(side, c).alias(f"r_{c}") for c in ("dtype", "min_num", "max_num", "min_str", "max_str")],
        *[pick(~side, c).alias(f"c_{c}") for c in ("dtype", "min_num", "max_num", "min_str", "max_str")],
    )
    in_ref = F.coalesce(F.col("in_ref"), F.lit(False))
    in_cur = F.coalesce(F.col("in_cur"), F.lit(False))
    both_sides = in_ref & in_cur
    null_d, null_s = F.lit(None).cast("double"), F.lit(None).cast("string")
    # (condition, kind, detail, reference value, current value)
    checks = [
        (~in_cur, "missing", null_s, null_d, null_d),
        (~in_ref, "extra", null_s, null_d, null_d),
        (
            both_sides & (F.col("r_dtype") != F.col("c_dtype")),
            "dtype",
            F.concat(F.col("r_dtype"), F.lit(" -> "), F.col("c_dtype")),
            null_d,
            null_d,
        ),
        (
            both_sides & ((F.col("c_min_num") < F.col("r_min_num")) | (F.col("c_min_str") < F.col("r_min_str"))),
            "below_min",
            F.when(F.col("c_min_str").isNotNull(), F.concat(F.col("r_min_str"), F.lit(" -> "), F.col("c_min_str"))),
            F.col("r_min_num"),
            F.col("c_min_num"),
        ),
        (
            both_sides & ((F.col("c_max_num") > F.col("r_max_num")) | (F.col("c_max_str") > F.col("r_max_str"))),
            "above_max",
            F.when(F.col("c_max_str").isNotNull(), F.concat(F.col("r_max_str"), F.lit(" -> "), F.col("c_max_str"))),
            F.col("r_max_num"),
            F.col("c_max_num"),
        ),
    ]
    arr = F.array(
        *[
            F.when(
                cond,
                F.struct(
                    F.lit(kind).alias("kind"), detail.alias("detail"), rv.alias("ref_value"), cv.alias("cur_value")
                ),
            )
            for cond, kind, detail, rv, cv in checks
        ]
    )
    return (
        g.select("column", F.explode(F.filter(arr, lambda x: x.isNotNull())).alias("v"))
        .select("column", "v.kind", "v.detail", "v.ref_value", "v.cur_value")
    )
