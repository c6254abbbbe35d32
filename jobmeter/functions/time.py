"""Expressions over times, periods and durations."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import as_column


def hours_between(start: Column | str, end: Column | str) -> Column:
    return (F.unix_micros(as_column(end)) - F.unix_micros(as_column(start))) / F.lit(3.6e9)


def period_start(ts: Column | str, grain: str, week_anchor: str = "monday") -> Column:
    """First day of the period holding ``ts``, as a date.

    ``week_anchor='tuesday'`` gives weeks from Tuesday to Monday.
    """
    ts = as_column(ts)
    if grain == "week" and week_anchor == "tuesday":
        return F.date_add(F.date_trunc("week", F.date_sub(ts.cast("date"), 1)).cast("date"), 1)
    return F.date_trunc(grain, ts).cast("date")


def with_periods(df: DataFrame, base: str) -> DataFrame:
    """Add ``<base>Day/Week/Month/Year``, weekday name, week and month number and ISO year."""
    ts = F.col(base)
    return df.withColumns({
        f"{base}Day": ts.cast("date"),
        f"{base}Week": period_start(ts, "week"),
        f"{base}Month": period_start(ts, "month"),
        f"{base}Year": F.year(ts),
        f"{base}WeekDay": F.date_format(ts, "EEEE"),
        f"{base}WeekNo": F.weekofyear(ts),
        f"{base}MonthNo": F.month(ts),
        f"{base}IsoYear": F.extract(F.lit("YEAROFWEEK"), ts).cast("int"),
    })


def week_to_date(year_week: Column | str) -> Column:
    """Date of 'YYYY-WW', counting weeks from the Monday on or before 1 January (not ISO)."""
    parts = F.split(as_column(year_week), "-")
    jan1 = F.make_date(parts[0].cast("int"), F.lit(1), F.lit(1))
    return F.date_add(F.date_trunc("week", jan1).cast("date"), (parts[1].cast("int") - 1) * 7)


def month_to_date(year_month: Column | str) -> Column:
    return F.to_date(F.concat(as_column(year_month), F.lit("-01")), "yyyy-MM-dd")


def elapsed_to_hours(text: Column | str) -> Column:
    """Hours in 'D-HH:MM:SS', 'HH:MM:SS' or 'MM:SS'; text that does not parse is 0."""
    text = as_column(text)
    day_split = F.split(text, "-")
    has_days = F.size(day_split) == 2
    days = F.when(has_days, day_split[0].try_cast("int")).when(F.size(day_split) == 1, 0)
    clock = F.split(F.element_at(day_split, -1), ":")
    n = F.size(clock)
    part = lambda i, kind: F.get(clock, F.lit(i)).try_cast(kind)
    seconds = (F.when(n == 3, part(0, "int") * 3600 + part(1, "int") * 60 + part(2, "double"))
               .when(n == 2, part(0, "int") * 60 + part(1, "double"))
               .otherwise(0.0))
    return F.coalesce((days * 86400 + seconds) / 3600, F.lit(0.0))


# Duration categories, as (label, upper bound in hours); the last one is open.
DURATION_CATEGORIES = [
    ("<5s", 5 / 3600), ("<1min", 1 / 60), ("<5min", 5 / 60), ("<30min", 30 / 60), ("<1h", 1),
    ("<5h", 5), ("<10h", 10), ("<24h", 24), (">=24h", None),
]
# The second label set, which starts at 0 and has 15 minutes as its third bound.
DURATION_CATEGORIES_FROM_ZERO = [
    ("<5s", 5 / 3600), ("<1min", 1 / 60), ("<15min", 15 / 60), ("<30min", 30 / 60), ("<1h", 1),
    ("<5h", 5), ("<10h", 10), ("<24h", 24), (">=24h", None),
]


def duration_category(hours: Column | str, from_zero: bool = False) -> Column:
    """Struct (label, rank) of a duration; null stays null, and so does a negative value when ``from_zero``."""
    hours = as_column(hours)
    rank = F.lit(None).cast("int")
    table = DURATION_CATEGORIES_FROM_ZERO if from_zero else DURATION_CATEGORIES
    for i, (_, upper) in reversed(list(enumerate(table))):
        rank = F.when(hours.isNotNull(), i) if upper is None else F.when(hours < upper, i).otherwise(rank)
    if from_zero:
        rank = F.when(hours >= 0, rank)
    label = F.get(F.array(*[F.lit(name) for name, _ in table]), rank)
    return F.struct(label.alias("label"), rank.alias("rank"))


def range_hours(start: dt.date | str, end: dt.date | str) -> Column:
    """Hours in a range of days, both ends included."""
    first, last = F.lit(str(start)).cast("date"), F.lit(str(end)).cast("date")
    return (F.datediff(last, first) + 1) * F.lit(24.0)


def data_range_hours(submit: Column | str = "Submit") -> Column:
    """Aggregate: hours spanned by the submit times, counted in started days."""
    submit = as_column(submit)
    span = F.unix_micros(F.max(submit)) - F.unix_micros(F.min(submit))
    return (F.floor(span / F.lit(86400 * 10**6)) + 1) * F.lit(24.0)


# Measures that need no grouping --------------------------------------------------------------------

def resource_hours(hours: Column | str, units: Column | str) -> Column:
    return F.coalesce(as_column(hours), F.lit(0.0)) * F.coalesce(as_column(units), F.lit(0))


def percent_change(current: Column | str, previous: Column | str, digits: int = 1) -> Column:
    """Change in percent; from 0 it is 100 if the current value is positive, else 0."""
    current, previous = as_column(current), as_column(previous)
    change = (F.when(previous > 0, F.try_divide(current - previous, previous) * 100)
              .when(current > 0, 100.0).otherwise(0.0))
    return F.round(change, digits)


def utilisation(hours: Column | str, capacity: Column | str, total_hours: Column | str | float) -> Column:
    """Percent of ``capacity * total_hours`` used, at most 100; 0 without capacity."""
    total = F.lit(total_hours) if isinstance(total_hours, (int, float)) else as_column(total_hours)
    room = as_column(capacity) * total
    return F.when(room > 0, F.least(F.lit(100.0), F.try_divide(as_column(hours), room) * 100)).otherwise(0.0)
