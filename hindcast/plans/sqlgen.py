"""DuckDB oracle SQL fragments.

These strings are the *independent* check of the Spark plans: they are plain
ANSI/DuckDB SQL over the driver's views (``orders``, ``lineitem``, ...), built
from the same PanelSpec parameters but sharing no code path with Spark.
"""

from __future__ import annotations

import math

from hindcast.spec import FOURIER_EPOCH, PanelSpec, sanitize

# "+ 0.0" turns a rounded -0.0 (DuckDB) into 0.0, as Spark returns
ROUND = "(round({c} + 1e-7, 4) + 0.0)"


def rounded(inner: str, doubles: list[str], others: list[str]) -> str:
    """Outer projection that applies the check-layer rounding to doubles."""
    cols = [f'"{c}"' for c in others] + [f'{ROUND.format(c=chr(34) + c + chr(34))} AS "{c}"' for c in doubles]
    return f"SELECT {', '.join(cols)} FROM (\n{inner}\n) AS q"


# --- panels (FIXTURES P1-P5) -------------------------------------------------

P1 = """SELECT o_orderpriority,
       CAST(date_trunc('week', o_orderdate) AS DATE) AS week,
       CAST(SUM(CAST(round(o_totalprice * 100) AS BIGINT)) AS DOUBLE) / 100 AS total_price,
       COUNT(*) AS n_orders
FROM orders WHERE o_orderdate IS NOT NULL GROUP BY 1, 2"""

P2 = """SELECT o_orderpriority,
       CAST(o_orderdate AS DATE) AS day,
       CAST(SUM(CAST(round(o_totalprice * 100) AS BIGINT)) AS DOUBLE) / 100 AS total_price
FROM orders WHERE o_orderdate IS NOT NULL GROUP BY 1, 2"""

P3 = """SELECT o_orderpriority, o_orderstatus,
       CAST(date_trunc('week', o_orderdate) AS DATE) AS week,
       CAST(SUM(CAST(round(o_totalprice * 100) AS BIGINT)) AS DOUBLE) / 100 AS total_price
FROM orders WHERE o_orderdate IS NOT NULL GROUP BY 1, 2, 3"""

P4 = """SELECT event_type,
       CAST(ts AS DATE) AS day,
       CAST(SUM(CAST(round(value * 100) AS BIGINT)) AS DOUBLE) / 100 AS total_value,
       COUNT(*) AS n_events
FROM events WHERE ts IS NOT NULL GROUP BY 1, 2"""

P5 = """SELECT l_returnflag, l_linestatus,
       CAST(date_trunc('week', l_shipdate) AS DATE) AS week,
       CAST(SUM(CAST(round(l_extendedprice * 100) AS BIGINT)) AS DOUBLE) / 100 AS revenue,
       CAST(SUM(CAST(round(l_quantity * 100) AS BIGINT)) AS DOUBLE) / 100 AS quantity
FROM lineitem WHERE l_shipdate IS NOT NULL GROUP BY 1, 2, 3"""

P6 = """SELECT l_partkey,
       CAST(date_trunc('week', l_shipdate) AS DATE) AS week,
       CAST(SUM(CAST(round(l_extendedprice * 100) AS BIGINT)) AS DOUBLE) / 100 AS revenue,
       CAST(SUM(CAST(round(l_quantity * 100) AS BIGINT)) AS DOUBLE) / 100 AS quantity
FROM lineitem WHERE l_shipdate IS NOT NULL GROUP BY 1, 2"""

PANEL_SQL = {"P1": P1, "P2": P2, "P3": P3, "P4": P4, "P5": P5, "P6": P6}


def series_key_sql(spec: PanelSpec) -> str:
    if not spec.series_id_cols:
        return f"'{spec.name}'"
    parts = [f"coalesce(CAST({c} AS VARCHAR), 'None')" for c in spec.series_id_cols]
    return " || '|' || ".join(parts)


def prepared_sql(panel: str, spec: PanelSpec) -> str:
    """Panel plus ``series_id``, ``ds`` and ``y``."""
    return (
        f"SELECT p.*, {series_key_sql(spec)} AS series_id, {spec.date_col} AS ds, "
        f"CAST({spec.target_col} AS DOUBLE) AS y FROM ({panel}) AS p"
    )


def holiday_ctes(base: str) -> str:
    """CTEs ``yrs`` and ``hol(d)``: US federal holidays (and observed days)
    over the years present in ``base`` (which must have a ``ds`` column)."""
    return f"""yrs AS (
  SELECT unnest(range(min(year(ds)), max(year(ds)) + 1)) AS y FROM {base}
),
hfixed(m, dd, since) AS (VALUES (1, 1, 0), (6, 19, 2021), (7, 4, 0), (11, 11, 0), (12, 25, 0)),
hnth(m, wd, n, since) AS (VALUES (1, 1, 3, 1986), (2, 1, 3, 0), (9, 1, 1, 0), (10, 1, 2, 0), (11, 4, 4, 0)),
hfixed_d AS (SELECT make_date(CAST(y AS INTEGER), m, dd) AS d FROM yrs, hfixed WHERE y >= since),
hol AS (
  SELECT d FROM hfixed_d
  UNION SELECT CASE isodow(d) WHEN 6 THEN d - 1 WHEN 7 THEN d + 1 ELSE d END FROM hfixed_d
  UNION SELECT make_date(CAST(y AS INTEGER), m, 1) + CAST((wd - isodow(make_date(CAST(y AS INTEGER), m, 1)) + 7) % 7 + 7 * (n - 1) AS INTEGER)
        FROM yrs, hnth WHERE y >= since
  UNION SELECT last_day(make_date(CAST(y AS INTEGER), 5, 1)) - CAST((isodow(last_day(make_date(CAST(y AS INTEGER), 5, 1))) - 1) % 7 AS INTEGER) FROM yrs
  UNION SELECT make_date(CAST(y AS INTEGER) + 1, 1, 1) - 1 FROM yrs WHERE isodow(make_date(CAST(y AS INTEGER) + 1, 1, 1)) = 6
)"""


def _win(frame: str = "") -> str:
    return f"(PARTITION BY series_id ORDER BY ds {frame})".replace(" )", ")")


def lag_sql(spec: PanelSpec) -> list[str]:
    return [f"lag(y, {L}) OVER {_win()} AS lag_{L}" for L in spec.lags]


def rolling_sql(spec: PanelSpec) -> list[str]:
    out = []
    for w in spec.rolling_windows:
        frame = _win(f"ROWS BETWEEN {w} PRECEDING AND 1 PRECEDING")
        minp = max(2, w // 2)
        for stat, fn in (("mean", "avg"), ("std", "stddev_samp"), ("min", "min"), ("max", "max")):
            out.append(f"CASE WHEN count(y) OVER {frame} >= {minp} THEN {fn}(y) OVER {frame} END AS roll_{stat}_{w}")
    return out


def exog_sql(spec: PanelSpec, present: list[str]) -> list[str]:
    if not spec.use_exogenous:
        return []
    k = spec.exogenous_lag
    out = []
    for c in spec.exogenous_cols:
        if c in present:
            expr = c if k == 0 else f"lag({c}, {k}) OVER {_win()}"
            out.append(f"{expr} AS {sanitize(c)}_lag{k}")
    return out


def calendar_sql(spec: PanelSpec) -> list[str]:
    hol = "CASE WHEN ds IN (SELECT d FROM hol) THEN 1 ELSE 0 END" if spec.holiday_country else "0"
    return [
        "CAST(month(ds) AS INTEGER) AS month",
        "CAST(weekofyear(ds) AS INTEGER) AS weekofyear",
        "CAST(quarter(ds) AS INTEGER) AS quarter",
        "CAST(isodow(ds) - 1 AS INTEGER) AS dayofweek",
        "CAST(isodow(ds) >= 6 AS INTEGER) AS is_weekend",
        f"CAST({hol} AS INTEGER) AS is_holiday",
    ]


def fourier_sql(spec: PanelSpec) -> list[str]:
    out = []
    t = f"CAST(datediff('day', DATE '{FOURIER_EPOCH}', ds) AS DOUBLE)"
    for i, term in enumerate(spec.fourier):
        period_days = term.period * spec.step_days
        for k in range(1, term.order + 1):
            c = repr(2.0 * math.pi * k / period_days)
            out.append(f"sin({t} * {c}) AS fourier{i}_sin{k}")
            out.append(f"cos({t} * {c}) AS fourier{i}_cos{k}")
    return out


def feature_names_sql(spec: PanelSpec, present: list[str]) -> list[str]:
    names = [f"lag_{L}" for L in spec.lags]
    for w in spec.rolling_windows:
        names += [f"roll_{s}_{w}" for s in ("mean", "std", "min", "max")]
    if spec.use_exogenous:
        names += [f"{sanitize(c)}_lag{spec.exogenous_lag}" for c in spec.exogenous_cols if c in present]
    names += ["month", "weekofyear", "quarter", "dayofweek", "is_weekend", "is_holiday"]
    for i, term in enumerate(spec.fourier):
        for k in range(1, term.order + 1):
            names += [f"fourier{i}_sin{k}", f"fourier{i}_cos{k}"]
    return names


def features_cte(panel: str, spec: PanelSpec, present: list[str]) -> str:
    """``WITH base AS (...), <holidays>, feat AS (...)`` -- caller appends SELECT."""
    cols = lag_sql(spec) + rolling_sql(spec) + exog_sql(spec, present) + calendar_sql(spec) + fourier_sql(spec)
    hol = (holiday_ctes("base") + ",\n") if spec.holiday_country else ""
    return (
        f"WITH base AS (\n{prepared_sql(panel, spec)}\n),\n{hol}"
        f"feat AS (\nSELECT base.*, {', '.join(cols)} FROM base\n)\n"
    )


def cutoff_sql(src: str, horizon: int) -> str:
    """Scalar: H-th largest distinct date of ``src``."""
    return f"(SELECT min(ds) FROM (SELECT DISTINCT ds FROM {src} WHERE ds IS NOT NULL ORDER BY ds DESC LIMIT {horizon}))"


def calendars_sql(panel: str, prefix: str = "", select: str = "\nSELECT DISTINCT country, date FROM calendar") -> str:
    """Holidays of four countries over the years of a daily panel. Easter by the
    epact and the Sunday number, in integers."""
    return f"""
WITH {prefix}yrs AS (SELECT unnest(range(min(year(day)), max(year(day)) + 1))::INTEGER AS y FROM ({panel}) AS p),
e1 AS (SELECT y, y % 19 + 1 AS golden, y // 100 + 1 AS c FROM yrs),
e2 AS (SELECT *, 3 * c // 4 - 12 AS leap, (8 * c + 5) // 25 - 5 AS lunar FROM e1),
e3 AS (SELECT *, 5 * y // 4 - leap - 10 AS sun, (11 * golden + 20 + lunar - leap) % 30 AS e FROM e2),
e4 AS (SELECT *, CASE WHEN (e = 25 AND golden > 11) OR e = 24 THEN e + 1 ELSE e END AS epact FROM e3),
e5 AS (SELECT *, CASE WHEN 44 - epact < 21 THEN 74 - epact ELSE 44 - epact END AS moon FROM e4),
feast AS (SELECT y, make_date(y, 3, 1) + (moon + 7 - (sun + moon) % 7 - 1)::INTEGER AS sunday FROM e5),
moved(country, after) AS (VALUES ('GB', -2), ('GB', 1), ('DE', -2), ('DE', 1), ('DE', 39), ('DE', 50), ('FR', 1), ('FR', 39), ('FR', 50)),
fixed(country, m, d, sat, sun, since, until) AS (VALUES
  ('US', 1, 1, -1, 1, 0, 9999), ('US', 6, 19, -1, 1, 2021, 9999), ('US', 7, 4, -1, 1, 0, 9999), ('US', 11, 11, -1, 1, 0, 9999), ('US', 12, 25, -1, 1, 0, 9999),
  ('GB', 1, 1, 2, 1, 0, 9999), ('GB', 12, 25, 2, 2, 0, 9999), ('GB', 12, 26, 2, 2, 0, 9999),
  ('DE', 1, 1, 0, 0, 0, 9999), ('DE', 5, 1, 0, 0, 0, 9999), ('DE', 10, 3, 0, 0, 0, 9999), ('DE', 10, 31, 0, 0, 2017, 2017), ('DE', 12, 25, 0, 0, 0, 9999), ('DE', 12, 26, 0, 0, 0, 9999),
  ('FR', 1, 1, 0, 0, 0, 9999), ('FR', 5, 1, 0, 0, 0, 9999), ('FR', 5, 8, 0, 0, 0, 9999), ('FR', 7, 14, 0, 0, 0, 9999), ('FR', 8, 15, 0, 0, 0, 9999), ('FR', 11, 1, 0, 0, 0, 9999), ('FR', 11, 11, 0, 0, 0, 9999), ('FR', 12, 25, 0, 0, 0, 9999)),
-- a weekday (Monday 1) of a month: at or after the given day, or within the seven days up to it
floating(country, m, wd, upto, since, until) AS (VALUES
  ('US', 1, 1, 21, 1986, 9999), ('US', 2, 1, 21, 0, 9999), ('US', 5, 1, 31, 0, 9999), ('US', 9, 1, 7, 0, 9999), ('US', 10, 1, 14, 0, 9999), ('US', 11, 4, 28, 0, 9999),
  ('GB', 5, 1, 7, 0, 9999), ('GB', 5, 1, 31, 0, 9999), ('GB', 8, 1, 31, 0, 9999), ('DE', 11, 3, 22, 0, 1994)),
days AS (SELECT country, make_date(y, m, d) AS date, sat, sun FROM yrs, fixed WHERE y BETWEEN since AND until),
calendar AS (
  SELECT country, date FROM days
  UNION SELECT country, date + CASE isodow(date) WHEN 6 THEN sat WHEN 7 THEN sun ELSE 0 END FROM days
  UNION SELECT 'US', make_date(y + 1, 1, 1) - 1 FROM yrs WHERE isodow(make_date(y + 1, 1, 1)) = 6
  UNION SELECT country, make_date(y, m, upto) - ((isodow(make_date(y, m, upto)) - wd + 7) % 7)::INTEGER FROM yrs, floating WHERE y BETWEEN since AND until
  UNION SELECT country, sunday + after FROM feast, moved
){select}"""
