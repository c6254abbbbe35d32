"""Sums, counts and means over periods and dimensions. Results are long: one row per point."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.quantiles import exact_stats
from ..functions.time import period_start
from ..functions.weights import job_count
from .topn import top_n, top_n_others


def period_column(base: str, grain: str, week_anchor: str = "monday") -> Column:
    """Period of a job as a date, from the stored column where there is one."""
    if grain == "week" and week_anchor != "monday":
        return period_start(base, "week", week_anchor)
    if grain == "year":
        return F.make_date(F.col(f"{base}Year"), F.lit(1), F.lit(1))
    return F.col(f"{base}{grain.capitalize()}")


def summary(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*by).agg(
        F.coalesce(job_count(df), F.lit(0)).alias("jobs"), F.coalesce(F.sum("CPUHours"), F.lit(0.0)).alias("cpu_hours"),
        F.coalesce(F.sum("GPUHours"), F.lit(0.0)).alias("gpu_hours"), F.count_distinct("User").alias("users"))


def cluster_stats(df: DataFrame) -> DataFrame:
    """Summary per cluster, with the distinct raw partition entries as a sorted array."""
    return df.groupBy("cluster").agg(
        F.count(F.lit(1)).alias("jobs"), F.coalesce(F.sum("CPUHours"), F.lit(0.0)).alias("cpu_hours"),
        F.coalesce(F.sum("GPUHours"), F.lit(0.0)).alias("gpu_hours"), F.count_distinct("User").alias("users"),
        F.sort_array(F.collect_set("Partition")).alias("partitions"))


# Timelines -----------------------------------------------------------------------------------------

def _aggregate(agg: str, value: str | None, df: DataFrame) -> Column:
    if agg == "count":
        return job_count(df)
    return {"sum": F.sum, "mean": F.avg, "nunique": F.count_distinct}[agg](value)


def timeline(df: DataFrame, value: str | None, grain: str, agg: str, base: str = "Submit",
             color_by: str | None = None, not_null: bool = False, positive: bool = False,
             week_anchor: str = "monday", dense: bool = False) -> DataFrame:
    """(period, value), or (period, series, value) when grouped by a dimension.

    ``agg`` is sum, mean, nunique or count. Jobs without the period or the group are left out. ``dense`` adds zeros
    for absent points.
    """
    df = df.withColumn("period", period_column(base, grain, week_anchor)).where(F.col("period").isNotNull())
    if not_null:
        df = df.where(F.col(value).isNotNull())
    if positive:
        df = df.where(F.col(value) > 0)
    if not color_by:
        return df.groupBy("period").agg(_aggregate(agg, value, df).alias("value"))
    long = df.where(F.col(color_by).isNotNull()).groupBy("period", F.col(color_by).alias("series")) \
        .agg(_aggregate(agg, value, df).alias("value"))
    return dense_grid(long) if dense else long


def dense_grid(long: DataFrame) -> DataFrame:
    """Every series at every period, absent points as 0, from rows (period, series, value).

    The list of periods comes in as one array and each series adds the points it lacks: both are at most as long as the
    calendar. There is no join.
    """
    # The maximum is not used. It keeps the value column in this aggregate, so that it reads the same shuffle as the points.
    calendar = long.agg(F.collect_set("period").alias("periods"), F.max("value").alias("unused"))
    periods = calendar.select(F.struct("periods", "unused")).scalar()["periods"]
    zero = F.lit(0).cast(long.schema["value"].dataType)
    points = long.groupBy("series").agg(F.collect_list(F.struct("period", F.coalesce("value", zero).alias("value"))).alias("known"))
    points = points.withColumn("periods", periods)
    absent = F.transform(F.array_except("periods", F.col("known.period")),
                         lambda p: F.struct(p.alias("period"), zero.alias("value")))
    return points.select("series", F.inline(F.concat("known", absent))).select("period", "series", "value")


def cpu_usage_over_time(df, grain="month", color_by=None, **options):
    return timeline(df, "CPUHours", grain, "sum", "Start", color_by, **options)


def gpu_usage_over_time(df, grain="month", color_by=None, **options):
    return timeline(df, "GPUHours", grain, "sum", "Start", color_by, **options)


def active_users_over_time(df, grain="month", color_by=None, **options):
    """Distinct users; only Account is meaningful as a group, others are ignored."""
    return timeline(df, "User", grain, "nunique", "Submit", color_by if color_by == "Account" else None, **options)


def jobs_over_time(df, grain="month", color_by=None, **options):
    return timeline(df, None, grain, "count", "Submit", color_by, **options)


def waiting_times_over_time(df, grain="month", color_by=None, **options):
    return timeline(df, "WaitingTimeHours", grain, "mean", "Submit", color_by, not_null=True, **options)


def job_duration_over_time(df, grain="month", color_by=None, **options):
    return timeline(df, "ElapsedHours", grain, "mean", "Submit", color_by, not_null=True, positive=True, **options)


def series_order(df: DataFrame, value: str | None, agg: str, color_by: str, grain: str = "month",
                 base: str = "Submit") -> DataFrame:
    """Groups in legend order: total for sums and counts, mean of the period means, distinct count over all jobs.

    Distinct counts do not add up over periods, so they are taken from the rows again.
    """
    if agg == "nunique":
        rows = df.where(F.col(color_by).isNotNull())
        scored = rows.groupBy(F.col(color_by).alias("series")).agg(F.count_distinct(value).alias("score"))
    else:
        points = timeline(df, value, grain, agg, base, color_by)
        scored = points.groupBy("series").agg((F.avg if agg == "mean" else F.sum)("value").alias("score"))
    return scored.orderBy(F.desc("score"), "series")


def collapse_series(long: DataFrame) -> DataFrame:
    return long.groupBy("period").agg(F.sum("value").alias("value"))


# Totals by dimension -------------------------------------------------------------------------------

def _totals(df: DataFrame, dim: str, metric: Column) -> DataFrame:
    return df.where(F.col(dim).isNotNull()).groupBy(F.col(dim).alias("label")).agg(metric.alias("value"))


def by_dimension(df: DataFrame, dim: str, metric: str = "count", top: int = 10) -> DataFrame:
    """Jobs, CPU-hours or GPU-hours per group: the top groups and one row for the others."""
    measure = job_count(df) if metric == "count" else F.sum(metric)
    return top_n_others(_totals(df, dim, measure), top)


def jobs_by(df: DataFrame, dim: str, top: int | None = 10) -> DataFrame:
    totals = _totals(df, dim, job_count(df))
    return totals.orderBy(F.desc("value"), "label") if top is None else top_n(totals, top)


def hours_by_account(df: DataFrame, metric: str = "CPUHours", top: int = 10) -> DataFrame:
    """Accounts with most hours; for GPU-hours only jobs that used a GPU count."""
    rows = df.where(F.col(metric) > 0) if metric == "GPUHours" else df
    return top_n(_totals(rows, "Account", F.sum(metric)), top)


def jobs_distribution(df: DataFrame, dim: str, top: int = 15) -> DataFrame:
    return by_dimension(df, dim, "count", top)


def users_per_account(df: DataFrame, top: int = 15) -> DataFrame:
    """Distinct users per account; the others row adds up the counts of its accounts."""
    return top_n_others(_totals(df, "Account", F.count_distinct("User")), top)


def active_periods(df: DataFrame, grain: str = "month", base: str = "Submit", by: Sequence[str] = ("User",)):
    """Distinct periods in which each group has jobs."""
    df = df.withColumn("period", period_column(base, grain))
    for key in by:
        df = df.where(F.col(key).isNotNull())
    return df.groupBy(*by).agg(F.count_distinct("period").alias("periods"))


def periods_per_user(df: DataFrame, grain: str = "month", base: str = "Start", top: int = 15) -> DataFrame:
    counts = active_periods(df, grain, base).select(F.col("User").alias("label"), F.col("periods").alias("value"))
    return top_n_others(counts, top)


def activity_by_group(df: DataFrame, dim: str, grain: str = "day", top: int = 15) -> DataFrame:
    """Active periods of a group, summed over its users, with the number of periods and users in the data."""
    if dim == "User":
        counts = active_periods(df, grain).select(F.col("User").alias("label"), F.col("periods").alias("value"))
        unit = "users"
    else:
        per_user = active_periods(df, grain, by=[dim, "User"])
        counts = per_user.groupBy(F.col(dim).alias("label")).agg(F.sum("periods").alias("value"))
        unit = f"{dim.lower()}s"
    shown = top_n_others(counts, top, unit=unit)
    return with_activity_totals(shown, df, grain)


def with_activity_totals(shown: DataFrame, df: DataFrame, grain: str) -> DataFrame:
    counts = df.select(period_column("Submit", grain).alias("period"), "User").agg(
        F.count_distinct("period").alias("total_periods"), F.count_distinct("User").alias("total_users"))
    totals = counts.select(F.struct("total_periods", "total_users")).scalar()
    return shown.withColumn("_t", totals).select(*shown.columns, "_t.total_periods", "_t.total_users")


def hours_by_group(df: DataFrame, value: str, dim: str, positive: bool = False, top: int = 15) -> DataFrame:
    """Total waiting or elapsed hours per group, with mean and median over all jobs that have a value."""
    rows = df.where(F.col(value).isNotNull())
    if positive:
        rows = rows.where(F.col(value) > 0)
    stats = exact_stats(rows, value, {"median": 0.5}).select(F.struct("mean", "median")).scalar()
    shown = top_n_others(_totals(rows, dim, F.sum(value)), top)
    return shown.withColumn("_s", stats).select(*shown.columns, F.col("_s.mean").alias("mean"),
                                                F.col("_s.median").alias("median"))


def resources_per_job(df: DataFrame, column: str, positive: bool = True, limit: int | None = 20) -> DataFrame:
    """How many jobs use each number of CPUs, GPUs or nodes: the ``limit`` smallest numbers."""
    rows = df.where(F.col(column) > 0) if positive else df.where(F.col(column).isNotNull())
    counts = rows.groupBy(F.col(column).alias("units")).agg(job_count(df).alias("jobs")).orderBy("units")
    return counts.limit(limit) if limit else counts


def describe_by_period(df: DataFrame, value: str, grain: str = "month", base: str = "Submit",
                       dim: str | None = None) -> DataFrame:
    """Count, mean, standard deviation, minimum, quartiles and maximum per period, or per group and period."""
    by = ["period"] + ([dim] if dim else [])
    rows = df.withColumn("period", period_column(base, grain))
    for key in by:
        rows = rows.where(F.col(key).isNotNull())
    quartiles = exact_stats(rows, value, {"p25": 0.25, "p50": 0.5, "p75": 0.75}, by)
    spread = rows.where(F.col(value).isNotNull()).groupBy(*by).agg(F.stddev_samp(value).alias("std"))
    return quartiles.join(spread, by).select(*by, "count", "mean", "std", "min", "p25", "p50", "p75", "max")


# Categories ----------------------------------------------------------------------------------------

def category_order(df: DataFrame, dim: str) -> DataFrame:
    """Values of a dimension by falling number of jobs."""
    return jobs_by(df, dim, None).select(F.col("label").alias(dim), F.col("value").alias("jobs"))


def fill_categories(totals: DataFrame, categories: DataFrame, dim: str, value: str = "value") -> DataFrame:
    """All known categories, with 0 for those absent from ``totals``; unknown ones stay."""
    zero = F.lit(0).cast(totals.schema[value].dataType)
    return categories.select(dim).join(totals, dim, "full_outer").select(dim, F.coalesce(value, zero).alias(value))
