"""Leakage-free feature matrix over a panel.

All lag and rolling expressions share ONE window specification
``partitionBy(series_id).orderBy(ds)`` and are added in ONE projection, so
the physical plan has a single Exchange (hash on series_id), a single Sort
and a single Window node regardless of how many features are requested.
Features of the date alone follow in a second one, behind the window.
Lag/rolling units are rows (T4); the rolling frame ends at the previous row
so the current target never leaks (T5).

A window partition is one series, at most one row per period. For very long
series pass ``split_rows``: rows are numbered per series and cut into chunks
that carry a halo of ``max_lookback`` preceding rows, so one long series is
spread over many tasks and the result is identical (see :func:`_chunked_frame`).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hindcast.functions.calendar import CALENDAR_NAMES, calendar_columns, fourier_columns, fourier_names
from hindcast.functions.holidays import is_holiday
from hindcast.functions.keys import series_key
from hindcast.sources.readers import nan_to_null, parse_dates, require_columns
from hindcast.spec import FeatureSpec, PanelSpec, sanitize

_NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)


def series_window(order_cols=("ds",), partition_cols=("series_id",)) -> WindowSpec:
    return Window.partitionBy(*partition_cols).orderBy(*order_cols)


def min_periods(w: int) -> int:
    return max(2, w // 2)


def lag_columns(spec: PanelSpec, w: WindowSpec, y: str = "y") -> list[Column]:
    """``lag_{L}`` = target L rows earlier in the same series."""
    return [F.lag(F.col(y), L).over(w).alias(f"lag_{L}") for L in spec.lags]


def rolling_columns(spec: PanelSpec, w: WindowSpec, y: str = "y") -> list[Column]:
    """Mean / sample std / min / max of the previous ``w`` rows, null
    until ``max(2, w // 2)`` non-missing values are in the frame."""
    out: list[Column] = []
    for win in spec.rolling_windows:
        frame = w.rowsBetween(-win, -1)
        enough = F.count(F.col(y)).over(frame) >= min_periods(win)
        for stat, fn in (("mean", F.avg), ("std", F.stddev_samp), ("min", F.min), ("max", F.max)):
            out.append(F.when(enough, fn(F.col(y)).over(frame)).alias(f"roll_{stat}_{win}"))
    return out


def exogenous_columns(df: DataFrame, spec: PanelSpec, w: WindowSpec) -> tuple[list[Column], list[str], list[str]]:
    """Each present exogenous column shifted by ``exogenous_lag`` rows.

    Numeric columns become numeric inputs; string columns are routed to the
    categorical inputs instead of being treated as numbers (D2).
    """
    cols: list[Column] = []
    numeric: list[str] = []
    categorical: list[str] = []
    if not spec.use_exogenous:
        return cols, numeric, categorical
    k = spec.exogenous_lag
    for c in spec.exogenous_cols:
        if c not in df.columns:
            continue  # absent columns are skipped, as in the reference
        name = f"{sanitize(c)}_lag{k}"
        expr = F.col(c) if k == 0 else F.lag(F.col(c), k).over(w)
        cols.append(expr.alias(name))
        if isinstance(df.schema[c].dataType, _NUMERIC):
            numeric.append(name)
        else:
            categorical.append(name)
    return cols, numeric, categorical


def prepare_panel(df: DataFrame, spec: PanelSpec) -> DataFrame:
    """Date parse, NaN -> null, and the ``series_id`` / ``ds`` / ``y`` roles."""
    require_columns(df, [spec.date_col, spec.target_col, *spec.series_id_cols])
    d = parse_dates(df, spec.date_col)
    if isinstance(d.schema[spec.target_col].dataType, (T.FloatType, T.DoubleType)):
        y = nan_to_null(F.col(spec.target_col))
    else:
        y = F.col(spec.target_col).cast("double")
    # a NaN input is a missing one, also where it serves as a weight
    inputs = {*spec.exogenous_cols, spec.weight_col}
    floats = {f.name for f in d.schema.fields if isinstance(f.dataType, (T.FloatType, T.DoubleType))}
    return d.select(
        *[nan_to_null(F.col(c)).alias(c) if c in inputs & floats else F.col(c) for c in d.columns],
        series_key(spec).alias("series_id"),
        F.col(spec.date_col).alias("ds"),
        y.alias("y"),
    )


def feature_names(df: DataFrame, spec: PanelSpec) -> FeatureSpec:
    numeric = [f"lag_{L}" for L in spec.lags]
    for win in spec.rolling_windows:
        numeric += [f"roll_{s}_{win}" for s in ("mean", "std", "min", "max")]
    _, exo_num, exo_cat = exogenous_columns(df, spec, series_window())
    numeric += exo_num + CALENDAR_NAMES + fourier_names(spec)
    return FeatureSpec(numeric=numeric, categorical=list(spec.series_id_cols) + exo_cat)


def _with_features(src: DataFrame, spec: PanelSpec, w: WindowSpec, keep: list[str]) -> DataFrame:
    """The columns ``keep`` of ``src`` and the features of its rows in ``w``.

    What follows from the date alone is added after the window: in the same
    projection it would be made before it, and shuffled, sorted and buffered
    with every row."""
    exo_cols, _, _ = exogenous_columns(src, spec, w)
    past = src.select(*keep, *lag_columns(spec, w), *rolling_columns(spec, w), *exo_cols)
    ds = F.col("ds")
    return past.select(
        "*",
        *calendar_columns(ds),
        is_holiday(ds, spec.holiday_country).alias("is_holiday"),
        *fourier_columns(ds, spec),
    )


def build_feature_matrix(
    df: DataFrame,
    spec: PanelSpec,
    *,
    prepared: bool = False,
    split_rows: int | None = None,
) -> tuple[DataFrame, FeatureSpec]:
    """Full feature matrix: source columns, ``series_id``, numeric features in
    contract order, then ``ds`` and ``y`` (layout of SURVEY §1.4)."""
    d = df if prepared else prepare_panel(df, spec)
    fspec = feature_names(d, spec)
    source_cols = [c for c in d.columns if c not in ("series_id", "ds", "y")]
    if split_rows:
        out = _chunked_frame(d, spec, split_rows)
    else:
        out = _with_features(d, spec, series_window(("ds", *spec.tiebreak_cols)), d.columns)
    # lagged string exogenous columns are categorical inputs made here, unlike the id columns
    lagged_labels = [c for c in fspec.categorical if c not in source_cols]
    ordered = [*source_cols, "series_id", *fspec.numeric, *lagged_labels, "ds", "y"]
    return out.select(*ordered), fspec


# --------------------------------------------------------------------------
# Skew-safe variant: split long series into row chunks with a halo.
# --------------------------------------------------------------------------


def _chunked_frame(d: DataFrame, spec: PanelSpec, split_rows: int) -> DataFrame:
    """Exact features with no task holding more than ~``split_rows`` rows of
    one series.

    1. Row rank within the series without a whole-series window: rows are
       cut into date blocks of ``split_rows`` periods; ``row_number`` runs
       per (series, block), and each block's offset is the running sum of
       the row counts of the earlier blocks (a window over a per-block count
       aggregate -- one row per block).
    2. Row chunk = rank // split_rows; a row is also emitted into the next
       chunk when it lies within ``max_lookback`` rows of its chunk's end
       (the halo) and the series goes on in that chunk.
    3. Features are evaluated per (series_id, chunk) ordered by rank, and
       halo copies are dropped, so every row keeps the exact values of the
       single-window plan.
    """
    K = spec.max_lookback
    if split_rows <= K:
        raise ValueError(f"split_rows must exceed the largest lookback ({K})")
    # Step 1: block the series by date so that the numbering window is split.
    # Block width is chosen in days; numbering inside a block uses a window
    # partitioned by (series_id, block); block offsets come from a per-block
    # count aggregate (one row per block, small) joined back.
    block_days = max(1, int(split_rows * spec.step_days))
    if isinstance(d.schema["ds"].dataType, T.DateType):
        days = F.unix_date(F.col("ds")).cast("double")
    else:
        days = F.unix_seconds(F.col("ds").cast("timestamp")) / F.lit(86400.0)
    day = F.floor(days / F.lit(block_days))
    blocked = d.withColumn("__blk", day.cast("long"))
    in_block = Window.partitionBy("series_id", "__blk").orderBy("ds", *spec.tiebreak_cols)
    numbered = blocked.withColumn("__r0", F.row_number().over(in_block) - 1)
    counts = blocked.groupBy("series_id", "__blk").agg(F.count(F.lit(1)).alias("__n"))
    offs = counts.withColumn(
        "__off",
        F.coalesce(
            F.sum("__n").over(Window.partitionBy("series_id").orderBy("__blk").rowsBetween(Window.unboundedPreceding, -1)),
            F.lit(0),
        ),
    ).withColumn("__total", F.sum("__n").over(Window.partitionBy("series_id"))).drop("__n")
    ranked = numbered.join(offs, ["series_id", "__blk"]).withColumn("__rank", F.col("__r0") + F.col("__off"))
    # Step 2: chunk + halo copies
    exploded = _with_halo(ranked, split_rows, K)
    # Step 3: features per chunk
    w = Window.partitionBy("series_id", "__chunk").orderBy("__rank")
    feats = _with_features(exploded, spec, w, [*d.columns, "__own"])
    return feats.where(F.col("__own")).drop("__own")


def _with_halo(ranked: DataFrame, split_rows: int, lookback: int) -> DataFrame:
    """Rows with their ``__chunk``, from their ``__rank`` in a series of
    ``__total`` rows; copies for the next chunk are not ``__own``."""
    chunk = (F.col("__rank") / F.lit(split_rows)).cast("long")
    pos = F.col("__rank") % F.lit(split_rows)
    goes_on = (chunk + 1) * F.lit(split_rows) < F.col("__total")
    targets = F.when((pos >= F.lit(split_rows - lookback)) & goes_on, F.array(chunk, chunk + 1)).otherwise(F.array(chunk))
    return ranked.withColumn("__chunk", F.explode(targets)).withColumn("__own", F.col("__chunk") == chunk)
