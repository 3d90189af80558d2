"""Mergeable states for drift and profiles.

A load, or a day, is summarised once: counts, extremes and sketches per column.
Summaries of any set of loads merge without their rows, in any order, so a window
of days is a merge and a late load is one more summary, not a rescan.

Quantiles come from KLL sketches, distinct counts from HyperLogLog, frequent
labels from the built-in top-k sketch. A KLL sketch of size ``k`` holds ranks to
about ``2.3 / k`` of its rows (and exactly up to ``k`` rows); counts and extremes
are exact. States are bounded whatever the rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hindcast.operators.monitor import PSI_EPS
from hindcast.operators.profile import _NUMERIC, _TEMPORAL

KLL_SIZE = 4096
#: evenly spaced ranks that a sketch is read at
GRID = 2000
HLL_SIZE = 12
TOP = 20
TOP_TRACKED = 1000


# -- drift: a state per feature and day ----------------------------------------


def feature_states(df: DataFrame, features: Sequence[str], by: Sequence[str] = (), size: int = KLL_SIZE) -> DataFrame:
    """Per group ``by`` (a day, say) and feature: ``n`` values, ``n_missing``
    (null or NaN), ``lo``, ``hi`` and the sketch ``q``. One aggregate, combined
    before the shuffle."""
    values = F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("value")) for f in features])
    long = df.select(*by, F.explode(values).alias("__v")).select(*by, "__v.feature", F.nullif("__v.value", F.lit(float("nan"))).alias("value"))
    return long.groupBy(*by, "feature").agg(
        F.count("value").alias("n"),
        F.count_if(F.col("value").isNull()).alias("n_missing"),
        F.min("value").alias("lo"),
        F.max("value").alias("hi"),
        F.kll_sketch_agg_double("value", F.lit(size)).alias("q"),
    )


def merge_states(states: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """States of the same features added up over ``by``."""
    return states.groupBy(*by, "feature").agg(
        F.sum("n").alias("n"), F.sum("n_missing").alias("n_missing"), F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.kll_merge_agg_double("q").alias("q")
    )


def psi_of_states(states: DataFrame, is_ref: Column, bins: int = 10, edges: str = "uniform") -> DataFrame:
    """PSI per feature between the merged reference states and the others:
    ``feature``, ``n_ref``, ``n_cur``, ``psi``. Buckets as in
    :func:`~hindcast.operators.monitor.psi_flagged`; their shares are
    differences of ranks, each within the sketches' error and ``1 / GRID``. A
    feature without reference values has no row, one without current values a
    null."""
    both = merge_states(states.withColumn("__ref", is_ref).where(F.col("__ref").isNotNull()), ("__ref",))
    # one row per feature and side
    sides = both.groupBy("feature").agg(
        *[F.max(F.when(F.col("__ref") == F.lit(s), F.col(c))).alias(f"{c}_{n}") for s, n in ((True, "ref"), (False, "cur")) for c in ("n", "lo", "hi", "q")]
    )
    sides = sides.where(F.col("n_ref") > 0)
    if edges == "uniform":
        step = (F.col("hi_ref") - F.col("lo_ref")) / bins
        # a value on an edge belongs to the bucket above it, up to rounding
        cuts = F.transform(F.sequence(F.lit(1), F.lit(bins - 1)), lambda i: F.col("lo_ref") + i * step - step * 1e-9)
        flat = F.col("hi_ref") <= F.col("lo_ref")
    elif edges == "quantile":
        cuts = F.kll_sketch_get_quantile_double("q_ref", F.array(*[F.lit(i / bins) for i in range(1, bins)]))
        flat = F.lit(False)
    else:
        raise ValueError("edges must be 'uniform' or 'quantile'")
    cut = sides.withColumn("cuts", cuts).withColumn("flat", flat)

    # ranks of the edges, read from quantiles at evenly spaced ranks
    grid = F.array(*[F.lit((i + 0.5) / GRID) for i in range(GRID)])
    below = (lambda x, e: x < e) if edges == "uniform" else (lambda x, e: x <= e)

    def shares(q: str) -> Column:
        held = F.kll_sketch_get_quantile_double(q, grid)
        upto = F.transform("cuts", lambda e: F.size(F.filter(held, lambda x: below(x, e))) / F.lit(float(GRID)))
        upto = F.concat(F.array(F.lit(0.0)), upto, F.array(F.lit(1.0)))
        return F.zip_with(F.slice(upto, 1, bins), F.slice(upto, 2, bins), lambda a, b: F.greatest(b - a, F.lit(0.0)))

    # one bucket holds all where the reference has one value
    term = lambda a, e: (F.greatest(a, F.lit(PSI_EPS)) - F.greatest(e, F.lit(PSI_EPS))) * F.log(F.greatest(a, F.lit(PSI_EPS)) / F.greatest(e, F.lit(PSI_EPS)))
    total = F.aggregate(F.zip_with(shares("q_cur"), shares("q_ref"), term), F.lit(0.0), lambda s, x: s + x)
    psi = F.when(F.col("n_cur") > 0, F.when(F.col("flat"), F.lit(0.0)).otherwise(total))
    return cut.select("feature", "n_ref", F.coalesce("n_cur", F.lit(0).cast("long")).alias("n_cur"), psi.alias("psi"))


# -- profiles: a state per column and load -------------------------------------


def profile_state(df: DataFrame, load: str, columns: Sequence[str] | None = None) -> DataFrame:
    """One row per column of a load: ``load``, ``column``, ``dtype``, ``n``,
    ``n_null`` (NaN counts as null), ``min_num``/``max_num`` or
    ``min_str``/``max_str`` (numbers; dates and times as text), ``distinct``
    (HyperLogLog of the values as text) and ``top`` (frequent values of text and
    boolean columns). One aggregate over the load."""
    cols = list(columns or df.columns)
    aggs, entries = [F.count(F.lit(1)).alias("__n")], []
    none_d, none_s = F.lit(None).cast("double"), F.lit(None).cast("string")
    for k, c in enumerate(cols):
        kind = df.schema[c].dataType
        value = F.nullif(F.col(f"`{c}`"), F.lit(float("nan"))) if isinstance(kind, (T.FloatType, T.DoubleType)) else F.col(f"`{c}`")
        num, time = isinstance(kind, _NUMERIC), isinstance(kind, _TEMPORAL)
        label = not num and not time
        text = value.cast("string")
        aggs += [F.count(value).alias(f"__c{k}"), F.hll_sketch_agg(text, F.lit(HLL_SIZE)).alias(f"__d{k}")]
        aggs += [f(value.cast("double") if num else text if time else none_s).alias(f"__{n}{k}") for f, n in ((F.min, "lo"), (F.max, "hi"))]
        if label:
            aggs.append(F.call_function("approx_top_k_accumulate", text, F.lit(TOP_TRACKED)).alias(f"__t{k}"))
        entries.append((k, c, kind.simpleString(), num, time, label))
    one = df.agg(*aggs)
    top_type = next((one.schema[f"__t{k}"].dataType for k, *_, label in entries if label), None)
    structs = [
        F.struct(
            F.lit(c).alias("column"), F.lit(dtype).alias("dtype"), F.col("__n").alias("n"), (F.col("__n") - F.col(f"__c{k}")).alias("n_null"),
            (F.col(f"__lo{k}") if num else none_d).alias("min_num"), (F.col(f"__hi{k}") if num else none_d).alias("max_num"),
            (F.col(f"__lo{k}") if time else none_s).alias("min_str"), (F.col(f"__hi{k}") if time else none_s).alias("max_str"),
            F.col(f"__d{k}").alias("distinct"), *([(F.col(f"__t{k}") if label else F.lit(None).cast(top_type)).alias("top")] if top_type else []),
        )
        for k, c, dtype, num, time, label in entries
    ]
    return one.select(F.lit(load).alias("load"), F.explode(F.array(*structs)).alias("p")).select("load", "p.*")


def merge_profiles(states: DataFrame) -> DataFrame:
    """The state of all loads together, one row per column and type."""
    aggs = [
        F.sum("n").alias("n"), F.sum("n_null").alias("n_null"), F.min("min_num").alias("min_num"), F.max("max_num").alias("max_num"),
        F.min("min_str").alias("min_str"), F.max("max_str").alias("max_str"), F.hll_union_agg("distinct").alias("distinct"),
    ]
    out = states.groupBy("column", "dtype").agg(*aggs)
    if "top" in states.columns:
        tops = states.where(F.col("top").isNotNull()).groupBy("column", "dtype").agg(F.call_function("approx_top_k_combine", F.col("top"), F.lit(TOP_TRACKED)).alias("top"))
        out = out.join(tops, ["column", "dtype"], "left")
    return out


def profile_of(state: DataFrame, top: int = TOP) -> DataFrame:
    """A readable profile of a state: ``n_distinct`` estimated, ``top_labels``
    as (item, count), the most frequent first."""
    labels = F.when(F.col("top").isNotNull(), F.call_function("approx_top_k_estimate", F.col("top"), F.lit(top))) if "top" in state.columns else F.lit(None)
    return state.select(
        "column", "dtype", "n", "n_null", F.hll_sketch_estimate("distinct").alias("n_distinct"), "min_num", "max_num", "min_str", "max_str", labels.alias("top_labels")
    )


def label_drift(reference: DataFrame, current: DataFrame, least: float = 0.01, moved: float = 0.05, top: int = TOP) -> DataFrame:
    """Frequent labels whose share changed, from two profile states: ``column``,
    ``label``, ``kind`` (``new``, ``gone``, ``share``), ``ref_share``,
    ``cur_share``. A label is frequent from a share of ``least`` on; a change of
    ``moved`` or more counts. Shares are of rows that are not null."""

    def shares(state: DataFrame, name: str) -> DataFrame:
        held = profile_of(state, top).where(F.col("top_labels").isNotNull() & (F.col("n") > F.col("n_null")))
        rows = held.select("column", (F.col("n") - F.col("n_null")).alias("there"), F.explode("top_labels").alias("x"))
        return rows.where(F.col("x.item").isNotNull()).select("column", F.col("x.item").alias("label"), (F.col("x.count") / F.col("there")).alias(name))

    j = shares(reference, "ref_share").join(shares(current, "cur_share"), ["column", "label"], "full")
    r, c = (F.coalesce(x, F.lit(0.0)) for x in ("ref_share", "cur_share"))
    kind = F.when((r == 0) & (c >= least), "new").when((c == 0) & (r >= least), "gone").when(F.abs(r - c) >= moved, "share")
    return j.select("column", "label", kind.alias("kind"), r.alias("ref_share"), c.alias("cur_share")).where(F.col("kind").isNotNull())
