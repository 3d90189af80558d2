"""Holiday calendars as column expressions and as a small dimension.

A calendar is a list of rules: fixed days, n-th and last weekdays of a month,
weekdays on or before a day, and feasts at an offset from Easter, with the years
in which they hold and the day on which they are observed when they fall on a
weekend. Rules become expressions of the year; ``is_holiday(ds)`` compares the
date's month, day and weekday with those they mark inline: one codegen'd expression
per row, with no shuffle and no broadcast. A user-supplied calendar goes through
:func:`holiday_flag_from_table`, a left join on distinct dates that AQE turns
into a broadcast only when the calendar is measured small at runtime.
"""

from __future__ import annotations

import calendar
import datetime as dt
from dataclasses import dataclass
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MON, TUE, WED, THU, FRI, SAT, SUN = range(7)


@dataclass(frozen=True)
class Rule:
    """``kind``: ``date`` (``month``, ``day``), ``nth`` (``n``-th ``weekday`` of
    ``month``), ``last`` (``weekday`` of ``month``), ``before`` (``weekday`` on or
    before ``month``, ``day``) or ``easter`` (``day`` days after Easter Sunday).

    ``shift``: where a day on a weekend is observed besides: ``nearest`` (Friday
    before a Saturday, Monday after a Sunday), ``next`` (the next Monday) or
    ``two`` (two days later, for the first of two days in a row and the second).
    ``since`` and ``until``: first and last year."""

    name: str
    kind: str
    month: int = 0
    day: int = 0
    weekday: int = 0
    n: int = 0
    shift: str = ""
    since: int | None = None
    until: int | None = None


# Public holidays as published in the countries' laws.
# US federal holidays, valid for years from 1978
US_FEDERAL_RULES = (
    Rule("New Year's Day", "date", 1, 1, shift="nearest"),
    Rule("Martin Luther King Jr. Day", "nth", 1, weekday=MON, n=3, since=1986),
    Rule("Washington's Birthday", "nth", 2, weekday=MON, n=3),
    Rule("Memorial Day", "last", 5, weekday=MON),
    Rule("Juneteenth National Independence Day", "date", 6, 19, shift="nearest", since=2021),
    Rule("Independence Day", "date", 7, 4, shift="nearest"),
    Rule("Labor Day", "nth", 9, weekday=MON, n=1),
    Rule("Columbus Day", "nth", 10, weekday=MON, n=2),
    Rule("Veterans Day", "date", 11, 11, shift="nearest"),
    Rule("Thanksgiving", "nth", 11, weekday=THU, n=4),
    Rule("Christmas Day", "date", 12, 25, shift="nearest"),
)
# England and Wales, valid for years from 1978; days proclaimed for one year only are left out
GB_RULES = (
    Rule("New Year's Day", "date", 1, 1, shift="next"),
    Rule("Good Friday", "easter", day=-2),
    Rule("Easter Monday", "easter", day=1),
    Rule("Early May Bank Holiday", "nth", 5, weekday=MON, n=1),
    Rule("Spring Bank Holiday", "last", 5, weekday=MON),
    Rule("Summer Bank Holiday", "last", 8, weekday=MON),
    Rule("Christmas Day", "date", 12, 25, shift="two"),
    Rule("Boxing Day", "date", 12, 26, shift="two"),
)
# Germany, days that hold in all states, valid for years from 1991
DE_RULES = (
    Rule("Neujahr", "date", 1, 1),
    Rule("Karfreitag", "easter", day=-2),
    Rule("Ostermontag", "easter", day=1),
    Rule("Tag der Arbeit", "date", 5, 1),
    Rule("Christi Himmelfahrt", "easter", day=39),
    Rule("Pfingstmontag", "easter", day=50),
    Rule("Tag der Deutschen Einheit", "date", 10, 3),
    Rule("Reformationstag", "date", 10, 31, since=2017, until=2017),
    Rule("Buss- und Bettag", "before", 11, 22, weekday=WED, until=1994),
    Rule("Erster Weihnachtstag", "date", 12, 25),
    Rule("Zweiter Weihnachtstag", "date", 12, 26),
)
# France, valid for years from 1982
FR_RULES = (
    Rule("Jour de l'an", "date", 1, 1),
    Rule("Lundi de Paques", "easter", day=1),
    Rule("Fete du travail", "date", 5, 1),
    Rule("Fete de la Victoire", "date", 5, 8),
    Rule("Ascension", "easter", day=39),
    Rule("Lundi de Pentecote", "easter", day=50),
    Rule("Fete nationale", "date", 7, 14),
    Rule("Assomption", "date", 8, 15),
    Rule("Toussaint", "date", 11, 1),
    Rule("Armistice", "date", 11, 11),
    Rule("Noel", "date", 12, 25),
)

SUPPORTED_COUNTRIES = {"US": US_FEDERAL_RULES, "GB": GB_RULES, "DE": DE_RULES, "FR": FR_RULES}


def rules_of(country: str) -> tuple[Rule, ...]:
    rules = SUPPORTED_COUNTRIES.get(country.upper())
    if rules is None:
        raise ValueError(f"no built-in holiday rules for {country!r}; use holiday_flag_from_table")
    return rules


def easter(year: Column) -> Column:
    """Easter Sunday of the Gregorian calendar: the Sunday after the paschal
    full moon, which follows from the year's place in the lunar cycle of 19
    years, the century's leap days and its lunar correction."""

    def div(x: Column, n: int) -> Column:
        return F.floor(x / F.lit(n)).cast("int")

    century = div(year, 100) + 1
    golden = F.pmod(year, F.lit(19))
    # days from 21 March to the full moon; two rare values are one less
    moon = F.pmod(F.lit(19) * golden + century - 1 - div(century - 1, 4) - div(F.lit(8) * (century - 1) + 13, 25) + 15, F.lit(30))
    moon = F.when((moon == 29) | ((moon == 28) & (golden > 10)), moon - 1).otherwise(moon)
    full = F.date_add(F.make_date(year, F.lit(3), F.lit(21)), moon.cast("int"))
    return F.date_add(full, F.lit(7) - F.pmod(F.weekday(full) + 1, F.lit(7)).cast("int"))


def _weekday_on_or_before(day: Column, weekday: int) -> Column:
    return F.date_sub(day, F.pmod(F.weekday(day) - F.lit(weekday), F.lit(7)).cast("int"))


def _day(rule: Rule, year: Column) -> Column:
    if rule.kind == "date":
        return F.make_date(year, F.lit(rule.month), F.lit(rule.day))
    if rule.kind == "easter":
        return F.date_add(easter(year), rule.day)
    if rule.kind == "nth":
        return _weekday_on_or_before(F.make_date(year, F.lit(rule.month), F.lit(7 * rule.n)), rule.weekday)
    if rule.kind == "last":
        return _weekday_on_or_before(F.last_day(F.make_date(year, F.lit(rule.month), F.lit(1))), rule.weekday)
    if rule.kind == "before":
        return _weekday_on_or_before(F.make_date(year, F.lit(rule.month), F.lit(rule.day)), rule.weekday)
    raise ValueError(f"unknown kind of holiday rule {rule.kind!r}")


def _observed(day: Column, shift: str) -> Column:
    """The day on which a holiday on a weekend is observed; other days stay."""
    after = {"nearest": (-1, 1), "next": (2, 1), "two": (2, 2)}[shift]
    wd = F.weekday(day)
    return F.when(wd == SAT, F.date_add(day, after[0])).when(wd == SUN, F.date_add(day, after[1])).otherwise(day)


def _holds(rule: Rule, year: Column) -> Column | None:
    terms = [year >= rule.since] if rule.since else []
    terms += [year <= rule.until] if rule.until else []
    return terms[0] if len(terms) == 1 else terms[0] & terms[1] if terms else None


def rule_dates(rule: Rule, year: Column) -> list[Column]:
    """The dates a rule marks for ``year``: the day and, where another one may be
    observed, that; null in years in which it does not hold. The Friday before a
    New Year's Day on a Saturday is a date of the year that ends as well."""
    day = _day(rule, year)
    dates = [day]
    if rule.shift:
        dates.append(_observed(day, rule.shift))
    if rule.shift == "nearest" and (rule.month, rule.day) == (1, 1):
        following = _day(rule, year + 1)
        dates.append(F.when(F.weekday(following) == SAT, F.date_sub(following, 1)))
    holds = _holds(rule, year)
    return dates if holds is None else [F.when(holds, d) for d in dates]


def holiday_dates(year: Column, country: str = "US") -> Column:
    """array<struct<name, date>> of holidays (and observed days) of ``year``."""
    items = [F.struct(F.lit(r.name).alias("name"), d.alias("date")) for r in rules_of(country) for d in rule_dates(r, year)]
    return F.filter(F.array(*items), lambda x: x["date"].isNotNull())


def holiday_flags(ds: Column, country: str | None) -> list[tuple[str, Column]]:
    """Per holiday of the country, its name and a flag; none without country."""
    if not country:
        return []
    d = F.to_date(ds)
    year = F.year(d)
    return [(r.name, F.coalesce(_any([d == x for x in rule_dates(r, year)]), F.lit(False))) for r in rules_of(country)]


def _any(terms: list[Column]) -> Column:
    out = F.lit(False)
    for t in terms:
        out = out | F.coalesce(t, F.lit(False))
    return out


def _spans(rule: Rule, year: int) -> list[tuple[int | None, int, int]]:
    """Days that a rule marks, as a weekday (or any) between two days of the
    year, each written ``100 * month + day``."""

    def at(month: int, day: int, shift: int = 0) -> int:
        d = dt.date(year, month, day) + dt.timedelta(days=shift)
        return 100 * d.month + d.day

    if rule.kind == "date":
        days = [(None, 0)] + {"": [], "nearest": [(FRI, -1), (MON, 1)], "next": [(MON, 1), (MON, 2)], "two": [(MON, 2), (TUE, 2)]}[rule.shift]
        return [(weekday, *[at(rule.month, rule.day, shift)] * 2) for weekday, shift in days]
    if rule.kind == "nth":
        last = at(rule.month, 7 * rule.n)
    elif rule.kind == "last":
        last = at(rule.month, calendar.monthrange(year, rule.month)[1])
    elif rule.kind == "before":
        last = at(rule.month, rule.day)
    else:
        raise ValueError(f"unknown kind of holiday rule {rule.kind!r}")
    return [(rule.weekday, at(last // 100, last % 100, -6), last)]


def _rule_hits(rules: tuple[Rule, ...], year: Column, weekday: Column, day: Column) -> list[Column]:
    """Whether a date is marked, from its year, weekday and ``100 * month + day``:
    one term per weekday and years of validity."""
    days: dict[tuple, list[tuple[int, int]]] = {}
    years: dict[tuple, Column | None] = {}
    for r in rules:
        spans = _spans(r, 2001)
        if spans != _spans(r, 2000):
            raise ValueError(f"{r.name!r} depends on leap days; use holiday_flag_from_table")
        for on, first, last in spans:
            days.setdefault((on, r.since, r.until), []).append((first, last))
            years[on, r.since, r.until] = _holds(r, year)
    hits = []
    for (on, since, until), found in days.items():
        single = [first for first, last in found if first == last]
        terms = [day.between(first, last) for first, last in found if first < last] + ([day.isin(single)] if single else [])
        when = [] if on is None else [weekday == on]
        when += [] if years[on, since, until] is None else [years[on, since, until]]
        hits.append(reduce(and_, when + [reduce(or_, terms)]))
    return hits


def is_holiday(ds: Column, country: str | None) -> Column:
    """0/1 flag; 0 everywhere when no country is configured.

    A plain OR of comparisons of the date's month, day and weekday with those
    the rules mark -- no array, no lambda, no date to make per rule -- so it
    stays short inside whole-stage codegen (the JVM leaves long methods
    uncompiled), and needs no join or broadcast. All feasts that move with
    Easter share one comparison."""
    if not country:
        return F.lit(0)
    d = F.to_date(ds)
    year = F.year(d)
    rules = rules_of(country)
    hits = _rule_hits(tuple(r for r in rules if r.kind != "easter"), year, F.weekday(d), F.month(d) * 100 + F.dayofmonth(d))
    offsets = [r.day for r in rules if r.kind == "easter"]
    if offsets:
        hits.append(F.datediff(d, easter(year)).isin(offsets))
    return F.coalesce(reduce(or_, hits), F.lit(False)).cast("int")


def holiday_table(spark: SparkSession, first_year: int, last_year: int, country: str = "US") -> DataFrame:
    """Holiday dimension ``(name, date)`` for a bounded year range."""
    if last_year < first_year:
        raise ValueError("empty year range")
    years = spark.range(first_year, last_year + 1).select(F.col("id").cast("int").alias("year"))
    return (
        years.select(F.explode(holiday_dates(F.col("year"), country)).alias("h"))
        .select(F.col("h.name").alias("name"), F.col("h.date").alias("date"))
        .dropDuplicates(["date", "name"])
    )


def year_range(df: DataFrame, date_col: str) -> DataFrame:
    """A2: one row ``(min_year, max_year)`` of a panel -- sizes the calendar."""
    y = F.year(F.col(date_col))
    return df.agg(F.min(y).alias("min_year"), F.max(y).alias("max_year"))


def holiday_flag_from_table(df: DataFrame, ds_col: str, calendar: DataFrame, out: str = "is_holiday") -> DataFrame:
    """J1 with a user calendar: left join on the date, flag = matched."""
    cal = calendar.select(F.to_date(F.col("date")).alias("__hdate")).distinct().withColumn("__hit", F.lit(1))
    j = df.join(cal, F.to_date(F.col(ds_col)) == F.col("__hdate"), "left")
    return j.withColumn(out, F.coalesce(F.col("__hit"), F.lit(0))).drop("__hdate", "__hit")
