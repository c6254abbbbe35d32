"""Row filters and dimension value lists."""

from __future__ import annotations

import datetime as dt
import logging
from collections.abc import Callable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import account_prefix, partition_list
from ..functions.time import period_start
from .metadata import dimension_values

log = logging.getLogger(__name__)


def submit_between(df: DataFrame, start=None, end=None) -> DataFrame:
    """Jobs submitted in a range of days, both ends included; either side may be open.

    Bounds on the year and month of Submit are added where those columns exist, so that partitions are pruned.
    """
    if start is not None:
        first = dt.date.fromisoformat(str(start))
        df = df.where(F.col("Submit") >= F.lit(first).cast("timestamp"))
        df = _prune(df, lambda key, value: F.col(key) >= F.lit(value), first)
    if end is not None:
        last = dt.date.fromisoformat(str(end))
        df = df.where(F.col("Submit") < F.lit(last + dt.timedelta(days=1)).cast("timestamp"))
        df = _prune(df, lambda key, value: F.col(key) <= F.lit(value), last)
    return df


def _prune(df: DataFrame, test: Callable, day: dt.date) -> DataFrame:
    bounds = {"SubmitYear": day.year, "SubmitMonth": day.replace(day=1)}
    for key, value in bounds.items():
        if key in df.columns:
            df = df.where(test(key, value))
    return df


def in_partitions(df: DataFrame, partitions: Sequence[str]) -> DataFrame:
    """Jobs whose comma list of partitions names one of ``partitions``."""
    wanted = F.array(*[F.lit(p) for p in partitions])
    return df.where(F.arrays_overlap(partition_list("Partition"), wanted))


def complete_only(df: DataFrame, grain: str, as_of: dt.date | str | None = None) -> DataFrame:
    """Drop jobs of the month, week or year that holds ``as_of`` and later ones; the day grain keeps all.

    The bound is a plain one on Submit, so that it reaches the scan, and on its year and month where those are columns.
    """
    if grain == "day":
        return df
    today = dt.date.today() if as_of is None else dt.date.fromisoformat(str(as_of))
    first = {"week": today - dt.timedelta(days=today.weekday()), "month": today.replace(day=1), "year": today.replace(month=1, day=1)}[grain]
    return submit_between(df, end=first - dt.timedelta(days=1))


def complete_periods(df: DataFrame, grain: str, as_of: dt.date | str | None = None) -> DataFrame:
    """Submit periods with jobs that lie wholly before ``as_of``, in order."""
    return complete_only(df, grain, as_of).select(period_start("Submit", grain).alias("period")).distinct() \
        .orderBy("period")


def format_accounts(df: DataFrame, formatter: int | Callable[[Column], Column] | None = 3) -> DataFrame:
    """Shorten account names to a number of segments, or by a caller's expression.

    A formatter that fails leaves the names as they are.
    """
    if formatter is None:
        return df
    try:
        value = formatter(F.col("Account")) if callable(formatter) else account_prefix("Account", formatter)
        return df.withColumn("Account", value)
    except (AnalysisException, ArithmeticError, LookupError, TypeError, ValueError) as error:
        log.warning("account formatter failed, names kept: %s", error)
        return df


def filter_jobs(df: DataFrame, *, clusters: Sequence[str] | None = None, start=None, end=None,
                partitions: Sequence[str] | None = None, accounts: Sequence[str] | None = None,
                users: Sequence[str] | None = None, qos: Sequence[str] | None = None,
                states: Sequence[str] | None = None, complete: str | None = None, as_of=None,
                formatter: int | Callable[[Column], Column] | None = None) -> DataFrame:
    """All filters together: AND between dimensions, OR within one. ``complete`` names a grain.

    Accounts are matched before names are shortened.
    """
    df = submit_between(df, start, end)
    if partitions:
        df = in_partitions(df, partitions)
    for column, wanted in (("cluster", clusters), ("Account", accounts), ("User", users), ("QOS", qos),
                           ("State", states)):
        if wanted:
            df = df.where(F.col(column).isin(list(wanted)))
    if complete:
        df = complete_only(df, complete, as_of)
    return format_accounts(df, formatter)


def keep_values(df: DataFrame, column: str, positive: bool = False) -> DataFrame:
    """Rows with a value in ``column``, and above zero if ``positive``."""
    return df.where(F.col(column) > 0) if positive else df.where(F.col(column).isNotNull())


def search_values(df: DataFrame, pattern: str, selected: DataFrame | None = None) -> DataFrame:
    """Dimension values containing ``pattern`` in any case, joined with values selected before (dimension, value)."""
    hits = dimension_values(df).where(F.contains(F.lower("value"), F.lit(pattern.lower())))
    return hits.unionByName(selected).distinct() if selected is not None else hits


def count_matches(df: DataFrame, pattern: str) -> DataFrame:
    return search_values(df, pattern).groupBy("dimension").agg(F.count(F.lit(1)).alias("matches"))
