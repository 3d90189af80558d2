"""Local additive model, one fit per series (K5, K6).

Structure after Taylor & Letham (2018): piecewise-linear trend with hinge
changepoints over the first 80% of the history, yearly Fourier seasonality
(order 10), optional weekly seasonality (order 3) and one regressor per holiday
of the country. The fit is the posterior mode: squared error plus Laplace priors
on the changes of slope, which make most of them exactly zero, and normal priors
on the seasonal and holiday terms; the noise's variance is fitted with them. It
does not reproduce the sampler-based library's numbers.

Changes of slope by an active set on the normal equations from which the other
coefficients have been eliminated, for all series of a bucket at once: a handful
of small exact solves per series, and coordinate descent for series that these
leave off the minimum. The 80% interval is that of the noise
plus that of changes of slope to come: they arrive at the rate of the past
changepoints with Laplace sizes of the mean past change, so the trend's variance
``h`` beyond the history is ``2 * size^2 * rate * h^3 / 3``.

Distribution: the fit is one grouped map over hash buckets of series -- one
shuffle brings each series' training rows to one task, which returns ONE
coefficient row per series (the model artifact). A series' length is bounded by
the number of periods in the calendar (the panel key ``(series_id, ds)`` is
unique) and a bucket by a fixed number of series, so no group grows with the
data volume. Prediction is pure Spark: rows join their coefficient row and the
design row and ``x . beta`` are column expressions.
"""

from __future__ import annotations

from dataclasses import dataclass

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hindcast.functions.holidays import holiday_flags
from hindcast.operators.split import panel_cutoff
from hindcast.spec import PanelSpec

Z90 = 1.2815515655446004  # standard normal 0.9 quantile (80% central interval)


@dataclass(frozen=True)
class AdditiveParams:
    n_changepoints: int = 25
    changepoint_range: float = 0.8
    yearly_order: int = 10
    weekly_order: int = 3
    weekly_seasonality: bool = False
    use_holidays: bool = True
    #: scales of the priors: Laplace of a change of slope, normal of the other terms
    changepoint_scale: float = 0.05
    term_scale: float = 10.0
    #: rounds of coefficients and noise in turn, and most sweeps of coordinate descent in each
    noise_rounds: int = 3
    sweeps: int = 2000


COEF_SCHEMA = (
    "series_id string, t0 double, span double, scale double, sigma double, n_train long, "
    "cps array<double>, beta array<double>, slope_penalty double, term_penalty double, change_size double"
)

_EMPTY = pd.DataFrame(columns=[c.split()[0] for c in COEF_SCHEMA.split(", ")])


def _design(t_days: np.ndarray, t0, span, cps: np.ndarray, flags: np.ndarray, p: AdditiveParams):
    """Design rows of one series (``t_days`` [n], ``flags`` [n, f]), or of many
    of equal length (another axis in front, also of ``t0`` and ``span``)."""
    ts = (t_days - t0) / span
    cols = [np.ones_like(ts), ts]
    for c in cps:
        cols.append(np.maximum(ts - c, 0.0))
    for k in range(1, p.yearly_order + 1):
        a = 2 * np.pi * k * t_days / 365.25
        cols += [np.sin(a), np.cos(a)]
    if p.weekly_seasonality:
        for k in range(1, p.weekly_order + 1):
            a = 2 * np.pi * k * t_days / 7.0
            cols += [np.sin(a), np.cos(a)]
    return np.concatenate([np.stack(cols, axis=-1), flags], axis=-1)


def sparse_slopes(G: np.ndarray, c: np.ndarray, penalty: np.ndarray, sweeps: int, start: np.ndarray | None = None) -> np.ndarray:
    """Minimise ``d'Gd / 2 - c'd + penalty |d|_1`` for every series (rows of
    ``G`` [S, k, k] and ``c`` [S, k]): by an active set first, and where that
    misses the conditions of optimality by coordinate descent, then the exact
    solution for the signs found, taken where it satisfies them better. Series
    that satisfy them leave the sweeps."""
    S, k = c.shape
    if not k:
        return np.zeros((S, k))
    best = _active_set(G, c, penalty, np.zeros((S, k)) if start is None else start)
    worst = violation(c - np.einsum("sij,sj->si", G, best), best, penalty)
    lost = np.isnan(worst)
    best[lost], worst[lost] = 0.0, np.inf
    left = np.flatnonzero(worst > 1e-9 * (1.0 + penalty))
    if not len(left):
        return best
    G, c, penalty, d = G[left], c[left], penalty[left], best[left].copy()
    g = c - np.einsum("sij,sj->si", G, d)
    diag = np.maximum(G[:, np.arange(k), np.arange(k)], 1e-300)
    for sweep in range(sweeps):
        for j in range(k):
            u = g[:, j] + diag[:, j] * d[:, j]
            new = np.sign(u) * np.maximum(np.abs(u) - penalty, 0.0) / diag[:, j]
            step = new - d[:, j]
            g -= G[:, :, j] * step[:, None]
            d[:, j] = new
        if sweep % 25 == 24 or sweep == sweeps - 1:
            for tried in (d, _exact(G, c, penalty, d)):
                off = violation(c - np.einsum("sij,sj->si", G, tried), tried, penalty)
                better = off < worst[left]
                best[left[better]], worst[left[better]] = tried[better], off[better]
            open_ = worst[left] > 1e-9 * (1.0 + penalty)
            if not open_.any():
                break
            if not open_.all():
                left, G, c, penalty, d, g, diag = (x[open_] for x in (left, G, c, penalty, d, g, diag))
    return best


def _active_set(G: np.ndarray, c: np.ndarray, penalty: np.ndarray, start: np.ndarray) -> np.ndarray:
    """The same minimum by exact solves for the coordinates held: each step
    moves to the stationary point of their signs or to the first sign that
    turns on the way, which is let go; at a stationary point the coordinate
    that misses its condition most is taken up, until none does. Series are
    left as they are after ``4 k + 20`` steps."""
    S, k = c.shape
    out = start.copy()
    left, d, sign = np.arange(S), start.copy(), np.sign(start)
    for _ in range(4 * k + 20):
        held = sign != 0
        size = max(int(held.sum(axis=1).max()), 1)
        # the coordinates held come first; the others of the small system are the unit's
        at = np.argsort(~held, axis=1, kind="stable")[:, :size]
        row = np.arange(len(left))[:, None]
        on, way = held[row, at], sign[row, at]
        A = np.where(on[:, :, None] & on[:, None, :], G[row[:, :, None], at[:, :, None], at[:, None, :]], 0.0)
        j = np.arange(size)
        A[:, j, j] = np.where(on, A[:, j, j] + 1e-12 * (1 + A[:, j, j]), 1.0)
        here = d[row, at]
        goal = np.linalg.solve(A, np.where(on, c[row, at] - penalty[:, None] * way, 0.0)[..., None])[..., 0]
        turns = on & (goal * way <= 0)
        part = np.where(turns, here / np.where(turns & (here != goal), here - goal, 1.0), 1.0)
        share = np.minimum(part.min(axis=1), 1.0)
        gone = turns & (part <= share[:, None])
        d[row, at] = np.where(gone, 0.0, here + share[:, None] * (goal - here))
        sign[row, at] = np.where(gone, 0.0, way)
        g = c - np.einsum("sij,sj->si", G, d)
        over = np.where(sign == 0, np.abs(g) - penalty[:, None], -np.inf)
        most = over.argmax(axis=1)
        whole = ~gone.any(axis=1)
        more = whole & (over[row[:, 0], most] > 1e-10 * (1.0 + penalty))
        sign[row[more, 0], most[more]] = np.sign(g[row[more, 0], most[more]])
        out[left] = d
        open_ = more | ~whole
        if not open_.any():
            break
        if not open_.all():
            left, G, c, penalty, d, sign = (x[open_] for x in (left, G, c, penalty, d, sign))
    return out


def _exact(G: np.ndarray, c: np.ndarray, penalty: np.ndarray, d: np.ndarray) -> np.ndarray:
    """The stationary point for the signs of ``d``; coordinates whose sign
    turns there are zero."""
    sign = np.sign(d)
    held = sign != 0
    A = np.where(held[:, :, None] & held[:, None, :], G, 0.0)
    k = np.arange(G.shape[1])
    A[:, k, k] = np.where(held, A[:, k, k] + 1e-12 * (1 + A[:, k, k]), 1.0)
    out = np.linalg.solve(A, np.where(held, c - penalty[:, None] * sign, 0.0)[..., None])[..., 0]
    return np.where(np.sign(out) == sign, out, 0.0)


def violation(g: np.ndarray, d: np.ndarray, penalty: np.ndarray) -> np.ndarray:
    """How far the conditions of optimality are missed: ``g = penalty * sign(d)``
    where ``d`` is not zero, ``|g| <= penalty`` elsewhere."""
    lam = penalty[:, None]
    return np.where(d != 0, np.abs(g - lam * np.sign(d)), np.maximum(np.abs(g) - lam, 0.0)).max(axis=1)


def _solve_all(A: np.ndarray, b: np.ndarray, yy: np.ndarray, n: np.ndarray, k: int, p: AdditiveParams):
    """Coefficients [S, m] and penalties of series with ``k`` changepoints,
    from their normal equations. Columns 0 and 1 are not shrunk."""
    m = A.shape[1]
    hinge = np.zeros(m, bool)
    hinge[2 : 2 + k] = True
    z, h = np.flatnonzero(~hinge), np.flatnonzero(hinge)
    ridge = np.where(z < 2, 0.0, 1.0)
    Azz, Azh, Ahh = A[:, z][:, :, z], A[:, z][:, :, h], A[:, h][:, :, h]

    def others(term: np.ndarray, rhs: np.ndarray) -> np.ndarray:
        # the first two columns coincide where all rows share one date: as little as needed holds them apart
        P = Azz + np.eye(len(z)) * (ridge[None, :] * term[:, None] + 1e-10 * n[:, None])[:, :, None]
        return np.linalg.solve(P, rhs)

    def noise(beta: np.ndarray) -> np.ndarray:
        rss = yy - 2 * (beta * b).sum(1) + np.einsum("si,sij,sj->s", beta, A, beta)
        return np.maximum(rss / np.maximum(n - 1, 1), 1e-6)

    beta = np.zeros((len(A), m))
    beta[:, z] = others(np.full(len(A), 1e-2), b[:, z, None])[..., 0]
    for _ in range(p.noise_rounds):
        variance = noise(beta)
        slope, term = variance / p.changepoint_scale, variance / p.term_scale**2
        if k:
            both = others(term, np.concatenate((Azh, b[:, z, None]), axis=2))
            G = Ahh - np.einsum("szi,szj->sij", Azh, both[:, :, :-1])
            c = b[:, h] - np.einsum("szi,sz->si", Azh, both[:, :, -1])
            d = sparse_slopes((G + G.swapaxes(1, 2)) / 2, c, slope, p.sweeps, beta[:, h])
            beta[:, h] = d
            beta[:, z] = both[:, :, -1] - np.einsum("szi,si->sz", both[:, :, :-1], d)
        else:
            beta[:, z] = others(term, b[:, z, None])[..., 0]
    return beta, np.sqrt(noise(beta)), slope, term


def fit_bucket(pdf: pd.DataFrame, p: AdditiveParams, n_flags: int) -> pd.DataFrame:
    """One coefficient row for every series of a bucket that has two training
    rows at least (F11). Series of equal length share one array of design
    rows, and those with equally many changepoints are solved together."""
    pdf = pdf[pdf["y"].notna() & pdf["series_id"].notna()]
    code, sids = pd.factorize(pdf["series_id"])
    t = pdf["t"].to_numpy(dtype=float)
    order = np.lexsort((t, code))
    t, y, bits = t[order], pdf["y"].to_numpy(dtype=float)[order], pdf["flags"].to_numpy()[order]
    n_rows = np.bincount(code, minlength=len(sids))
    first = np.cumsum(n_rows) - n_rows
    alike: dict[int, list] = {}
    for n in np.unique(n_rows[n_rows >= 2]).tolist():
        which = np.flatnonzero(n_rows == n)
        at = first[which][:, None] + np.arange(n)
        ts, ys = t[at], y[at]
        flags = (bits[at][:, :, None] >> np.arange(n_flags) & 1).astype(float)
        t0 = ts.min(axis=1)
        span = np.maximum(ts.max(axis=1) - t0, 1.0)
        k = min(p.n_changepoints, max(n - 2, 0))
        cps = np.linspace(0, p.changepoint_range, k + 2)[1:-1] if k else np.array([])
        X = _design(ts, t0[:, None], span[:, None], cps, flags, p)
        scale = np.maximum(np.abs(ys).max(axis=1), 1e-12)
        ys = ys / scale[:, None]
        # series by series: the products of one matrix with itself are rounded alike whatever shares its bucket
        A, b, yy = np.stack([x.T @ x for x in X]), np.stack([x.T @ v for x, v in zip(X, ys)]), np.array([v @ v for v in ys])
        alike.setdefault(k, []).append(
            (which, t0, span, scale, np.full(len(which), n), np.tile(cps, (len(which), 1)), A, b, yy)
        )
    rows = []
    for k, found in alike.items():
        which, t0, span, scale, n, cps, A, b, yy = (np.concatenate(x) for x in zip(*found))
        beta, sigma, slope, term = _solve_all(A, b, yy, n.astype(float), k, p)
        size = np.abs(beta[:, 2 : 2 + k]).mean(axis=1) if k else np.zeros(len(beta))
        rows += zip(sids[which], *(x.tolist() for x in (t0, span, scale, sigma, n, cps, beta, slope, term, size)))
    return pd.DataFrame(rows, columns=_EMPTY.columns) if rows else _EMPTY


def _day_number(ds: Column) -> Column:
    return F.datediff(F.to_date(ds), F.lit("1970-01-01").cast("date")).cast("double")


def fit_additive(
    d: DataFrame,
    spec: PanelSpec,
    params: AdditiveParams = AdditiveParams(),
    cutoff=None,
    series_per_group: int = 256,
) -> DataFrame:
    """K5 fit: one coefficient row per series (the local model's artifact,
    S9). Rows at or after ``cutoff`` are not used; ``cutoff=None`` fits on the
    whole history (for forecasting past its end). Holidays are flagged by
    Spark before the shuffle; only the solves run in Python.

    Series are hashed into ``ceil(n_series / series_per_group)`` buckets (the
    count is one ``approx_count_distinct``), and each bucket is one grouped-map
    call that solves its series together: a group is bounded by
    ``series_per_group`` series of calendar-bounded length, and the per-call
    Arrow/pandas overhead is paid per bucket, not per series."""
    rows = d if cutoff is None else d.where(F.col("ds") < cutoff)
    inp = rows.select("series_id", F.col("y").cast("double").alias("y"), _day_number(F.col("ds")).alias("t"), _flag_bits(spec, params).alias("flags"))
    n_flags = len(_holidays(spec, params))
    n_series = inp.agg(F.approx_count_distinct("series_id").alias("n")).first()["n"] or 1
    # at least one group per core of the cluster, so that few series do not share one task
    cores = rows.sparkSession.sparkContext.defaultParallelism
    buckets = max(1, -(-int(n_series) // series_per_group), min(int(n_series), cores))
    keyed = inp.withColumn("__bucket", F.pmod(F.xxhash64("series_id"), F.lit(buckets)))

    return keyed.groupBy("__bucket").applyInPandas(lambda pdf: fit_bucket(pdf, params, n_flags), COEF_SCHEMA)


def _holidays(spec: PanelSpec, params: AdditiveParams) -> list[Column]:
    return [f for _, f in holiday_flags(F.col("ds"), spec.holiday_country if params.use_holidays else None)]


def _flags(spec: PanelSpec, params: AdditiveParams) -> Column:
    """A 0/1 per holiday of the country."""
    return F.array(*[f.cast("double") for f in _holidays(spec, params)]).cast("array<double>")


def _flag_bits(spec: PanelSpec, params: AdditiveParams) -> Column:
    """The same as bits of one number, which is cheaper to hand to Python."""
    bits = F.lit(0).cast("long")
    for k, f in enumerate(_holidays(spec, params)):
        bits = bits + F.when(f, F.lit(1 << k).cast("long")).otherwise(F.lit(0).cast("long"))
    return bits


def design_row(spec: PanelSpec, params: AdditiveParams) -> Column:
    """The design of a row that has been joined to its coefficients, in the
    order of ``beta``."""
    t = _day_number(F.col("ds"))
    ts = (t - F.col("t0")) / F.col("span")
    waves = [(k, 365.25) for k in range(1, params.yearly_order + 1)]
    if params.weekly_seasonality:
        waves += [(k, 7.0) for k in range(1, params.weekly_order + 1)]
    angles = [t * F.lit(2 * math.pi * k / period) for k, period in waves]
    seasons = [f(a) for a in angles for f in (F.sin, F.cos)]
    hinges = F.transform("cps", lambda c: F.greatest(ts - c, F.lit(0.0)))
    return F.concat(F.array(F.lit(1.0), ts), hinges, F.array(*seasons).cast("array<double>"), _flags(spec, params))


def predict_additive(
    coefs: DataFrame, rows: DataFrame, spec: PanelSpec, params: AdditiveParams = AdditiveParams()
) -> DataFrame:
    """K5 predict: ``rows`` (series_id, ds, ...) joined to their series'
    coefficients; the design row (trend, hinges, Fourier, holidays) and
    ``x . beta`` are built with Spark expressions, so scoring needs no Python.
    The interval widens beyond the history. Series without coefficients get no
    prediction (inner join)."""
    j = rows.join(coefs, "series_id")
    products = F.zip_with(design_row(spec, params), F.col("beta"), lambda x, b: x * b)
    p50 = F.aggregate(products, F.lit(0.0), lambda a, x: a + x) * F.col("scale")
    ahead = F.greatest((_day_number(F.col("ds")) - F.col("t0")) / F.col("span") - 1.0, F.lit(0.0))
    trend = 2.0 * F.pow("change_size", F.lit(2.0)) * F.size("cps") * F.pow(ahead, F.lit(3.0)) / 3.0
    half = F.lit(Z90) * F.sqrt(F.pow("sigma", F.lit(2.0)) + trend) * F.col("scale")
    keep = [c for c in rows.columns]
    return j.select(*keep, (p50 - half).alias("p10"), p50.alias("p50"), (p50 + half).alias("p90"))


def optimality(coefs: DataFrame, train: DataFrame, spec: PanelSpec, params: AdditiveParams = AdditiveParams()) -> DataFrame:
    """Per series of ``coefs``, from its training rows: ``n_train`` and
    ``off``, how far the fit misses the conditions of a minimum, as a share of a
    training row. The gradient of squared error is zero on intercept and slope,
    ``term_penalty * beta`` on seasonal and holiday terms, ``slope_penalty``
    times the sign on changes of slope that are not zero, and within it on those
    that are."""
    j = train.where(F.col("y").isNotNull()).join(coefs, "series_id").withColumn("x", design_row(spec, params))
    fitted = F.aggregate(F.zip_with("x", "beta", lambda x, b: x * b), F.lit(0.0), lambda a, x: a + x)
    j = j.withColumn("r", F.col("y") / F.col("scale") - fitted)
    parts = j.select("series_id", "r", "slope_penalty", "term_penalty", F.size("cps").alias("k"), F.posexplode(F.arrays_zip("x", "beta")).alias("at", "c"))
    g = parts.groupBy("series_id", "at", F.col("c.beta").alias("b"), "k", "slope_penalty", "term_penalty").agg(F.sum(F.col("r") * F.col("c.x")).alias("g"), F.count(F.lit(1)).alias("n"))
    change = (F.col("at") >= 2) & (F.col("at") < F.col("k") + 2)
    off = (
        F.when(F.col("at") < 2, F.abs("g"))
        .when(change & (F.col("b") != 0), F.abs(F.col("g") - F.col("slope_penalty") * F.signum("b")))
        .when(change, F.greatest(F.abs("g") - F.col("slope_penalty"), F.lit(0.0)))
        .otherwise(F.abs(F.col("g") - F.col("term_penalty") * F.col("b")))
    )
    return g.groupBy("series_id").agg(F.max("n").alias("n_train"), (F.max(off) / F.max("n")).alias("off"))


def additive_forecast(
    d: DataFrame,
    spec: PanelSpec,
    params: AdditiveParams = AdditiveParams(),
    cutoff=None,
    model_name: str = "additive",
) -> DataFrame:
    """K5 over a prepared panel: fit on rows before the cutoff, predict the
    test rows. ``forecasts(model, series_id, ds, y_true, p10, p50, p90)`` for
    every series with >= 2 training rows and at least one test row (F11)."""
    c = panel_cutoff(d, spec.horizon) if cutoff is None else cutoff
    flagged = d.select("series_id", "ds", "y", (F.col("ds") < c).alias("__train"))
    coefs = fit_additive(flagged.where(F.col("__train")).drop("__train"), spec, params)
    test = flagged.where(~F.col("__train")).select("series_id", "ds", F.col("y").alias("y_true"))
    out = predict_additive(coefs, test, spec, params)
    return out.select(F.lit(model_name).alias("model"), "series_id", "ds", "y_true", "p10", "p50", "p90")


def forecast_future(
    d: DataFrame,
    coefs: DataFrame,
    spec: PanelSpec,
    params: AdditiveParams = AdditiveParams(),
    requested: DataFrame | None = None,
    model_name: str = "additive",
) -> DataFrame:
    """Point forecast and 80% interval for the next ``horizon``
    periods after each (requested) series' last date, from stored
    coefficients. ``requested`` (series_id) restricts the series by a semi join."""
    from hindcast.operators.split import future_dates

    hist = d if requested is None else d.join(requested.select("series_id").distinct(), "series_id", "left_semi")
    fut = future_dates(hist, spec, include_history=False).select("series_id", "ds")
    pred = predict_additive(coefs, fut, spec, params)
    return pred.select(
        F.lit(model_name).alias("model"),
        "series_id",
        "ds",
        F.col("p50").alias("point"),
        F.col("p10").alias("lower"),
        F.col("p90").alias("upper"),
    )
