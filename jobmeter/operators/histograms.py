"""Binned distributions and percentile trends."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import bins as B
from ..functions.quantiles import exact_stats, stats_of_counts, value_counts
from ..functions.weights import WEIGHT, job_count
from .measures import active_periods, dense_grid, period_column, with_activity_totals

# The statistics of a trend chart.
TREND_PROBS = {"median": 0.5, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p90": 0.9, "p95": 0.95, "p99": 0.99}


def _with_center(df: DataFrame, counted: DataFrame, names=("mean", "median")) -> DataFrame:
    """Add mean and median of the counted values to every row."""
    stats = stats_of_counts(counted, {"median": 0.5}).select(F.struct("mean", "median")).scalar()
    keep = df.columns
    return df.withColumn("_s", stats).select(
        *keep, F.col("_s.mean").alias(names[0]), F.col("_s.median").alias(names[1]))


def _stack(binned: DataFrame, by: Sequence[str], bins: B.Bins, weight: str | None = None,
           of_all: bool = False) -> DataFrame:
    """Counts and percents of every bin within each group, from rows with a column ``bin`` (null is out of range).

    One aggregate with a conditional count per bin, turned into rows afterwards: no grid join, one shuffle.
    """
    one = F.col(weight) if weight else F.lit(1)
    count = lambda test: F.coalesce(F.sum(F.when(test, one)), F.lit(0)).cast("long")
    in_range = F.lit(True) if of_all else F.col("bin").isNotNull()
    wide = binned.groupBy(*by).agg(
        count(in_range).alias("total"), *[count(F.col("bin") == i).alias(f"_n{i}") for i in range(len(bins))])
    cells = F.array(*[
        F.struct(F.lit(i).alias("bin"), F.lit(name).alias("label"), F.col(f"_n{i}").alias("count"))
        for i, (name, _) in enumerate(bins)])
    long = wide.select(*by, "total", F.inline(cells))
    return long.withColumn("percent", F.try_divide(F.col("count") * 100.0, F.col("total")))


def value_histogram(df: DataFrame, value: str, bins: B.Bins = B.HISTOGRAM_BINS, positive: bool = False) -> DataFrame:
    """Percent of jobs per fixed bin, over jobs that fall in some bin, with mean and median over all jobs counted."""
    counted = value_counts(df.where(F.col(value) > 0) if positive else df, value)
    shown = _stack(counted.withColumn("bin", B.bin_index("_v", bins)), [], bins, "_n")
    return _with_center(shown.fillna(0.0, ["percent"]), counted)


def fine_histogram(df: DataFrame, value: str, bins: B.Bins, dim: str | None = None) -> DataFrame:
    """Percent of jobs per bin, of all jobs in some bin or, with ``dim``, of the group's jobs in some bin."""
    rows = df.withColumn("bin", B.bin_index(value, bins)).where(F.col("bin").isNotNull())
    if dim is None:
        return _stack(rows, [], bins).fillna(0.0, ["percent"])
    return _stack(rows.where(F.col(dim).isNotNull()).withColumnRenamed(dim, "series"), ["series"], bins)


def stacked_bins(df: DataFrame, value: str, grain: str, bins: B.Bins, base: str = "Start") -> DataFrame:
    """Percent of jobs per bin in each period; jobs outside all bins do not count, a period without any gives null."""
    rows = df.withColumn("period", period_column(base, grain)).where(F.col("period").isNotNull())
    return _stack(rows.withColumn("bin", B.bin_index(value, bins)), ["period"], bins, WEIGHT if WEIGHT in df.columns else None)


def job_duration_stacked(df: DataFrame, grain: str = "month") -> DataFrame:
    return stacked_bins(df, "ElapsedHours", grain, B.DURATION_BINS)


def waiting_times_stacked(df: DataFrame, grain: str = "month") -> DataFrame:
    return stacked_bins(df.where(F.col("WaitingTimeHours").isNotNull()), "WaitingTimeHours", grain, B.WAITING_BINS)


def stacked_bins_of_all(df: DataFrame, value: str, grain: str, bins: B.Bins, base: str = "Submit") -> DataFrame:
    """As ``stacked_bins``, but in percent of all jobs of the period, with or without a value."""
    rows = df.withColumn("period", period_column(base, grain)).where(F.col("period").isNotNull())
    return _stack(rows.withColumn("bin", B.bin_index(value, bins)), ["period"], bins, of_all=True)


def pivot_bins(stacked: DataFrame, bins: B.Bins, value: str = "percent") -> DataFrame:
    """One column per bin, one row per period."""
    labels = [name for name, _ in bins]
    return stacked.groupBy("period").pivot("label", labels).agg(F.first(value)).fillna(0.0, labels)


def trends(df: DataFrame, value: str, grain: str, base: str = "Start", positive: bool = False) -> DataFrame:
    """Mean, median, maximum and six percentiles of ``value`` per period."""
    rows = df.withColumn("period", period_column(base, grain))
    if positive:
        rows = rows.where(F.col(value) > 0)
    return exact_stats(rows, value, TREND_PROBS, ["period"]).select("period", "mean", "max", *TREND_PROBS)


def trend_by_group(df: DataFrame, value: str, grain: str, dim: str, stat: str = "median", base: str = "Start",
                   positive: bool = False) -> DataFrame:
    """One statistic per group and period, 0 where a group has no jobs."""
    rows = df.withColumn("period", period_column(base, grain))
    if positive:
        rows = rows.where(F.col(value) > 0)
    simple = stat in ("mean", "max")
    prob = 0.5 if simple or stat == "median" else int(stat[1:]) / 100
    rows = rows.withColumnRenamed(dim, "series")
    if simple:
        clean = rows.where(F.col("series").isNotNull() & F.col("period").isNotNull() & F.col(value).isNotNull())
        points = clean.groupBy("period", "series").agg((F.avg if stat == "mean" else F.max)(value).alias("value"))
    else:
        points = exact_stats(rows, value, {"value": prob}, ["period", "series"]).select("period", "series", "value")
    return dense_grid(points)


def timing_kpis(trend: DataFrame) -> DataFrame:
    """Mean over periods of the median and of p95, and the largest maximum."""
    return trend.agg(F.avg("median").alias("median"), F.avg("p95").alias("p95"), F.max("max").alias("max"))


def column_stats(df: DataFrame, value: str) -> DataFrame:
    """Mean, median, quartiles, p90, minimum and maximum in one row; all 0 without values."""
    names = ["mean", "median", "p25", "p75", "p90", "min", "max"]
    found = exact_stats(df, value, {"median": 0.5, "p25": 0.25, "p75": 0.75, "p90": 0.9})
    return found.agg(*[F.coalesce(F.max(c), F.lit(0.0)).alias(c) for c in names])


# Histograms of totals ------------------------------------------------------------------------------

def period_distribution(df: DataFrame, grain: str, agg: Column, base: str = "Start",
                        n_bins: Column | None = None) -> DataFrame:
    """Equal-width histogram of one aggregate per period. ``agg`` is any aggregate expression.

    Without ``n_bins`` there is a bin per period, but at least 5 and at most 20.
    """
    rows = df.withColumn("period", period_column(base, grain)).where(F.col("period").isNotNull())
    values = rows.groupBy("period").agg(agg.cast("double").alias("value"))
    if n_bins is None:
        n_bins = F.least(F.lit(20), F.greatest(F.lit(5), F.count(F.lit(1))))
    return _with_center(B.equal_width(values, "value", n_bins), value_counts(values, "value"))


def usage_histogram(df: DataFrame, metric: str, grain: str = "month") -> DataFrame:
    """20 equal bins over the CPU- or GPU-hours of each period."""
    return period_distribution(df, grain, F.sum(metric), n_bins=F.lit(20))


def active_users_histogram(df: DataFrame, grain: str = "month") -> DataFrame:
    return period_distribution(df, grain, F.count_distinct("User"))


def jobs_histogram(df: DataFrame, grain: str = "month") -> DataFrame:
    return period_distribution(df, grain, job_count(df))


def jobs_per_user_histogram(df: DataFrame) -> DataFrame:
    """Equal-width histogram of jobs per user, with the square root of the number of users as bins, from 10 to 30."""
    per_user = df.where(F.col("User").isNotNull()).groupBy("User").agg(job_count(df).alias("value"))
    n_bins = F.least(F.lit(30), F.greatest(F.lit(10), F.ceil(F.sqrt(F.count(F.lit(1)))).cast("int")))
    shown = B.equal_width(per_user, "value", n_bins)
    label = F.concat(F.col("lower").cast("long").cast("string"), F.lit("-"),
                     F.col("upper").cast("long").cast("string"))
    return _with_center(shown.withColumn("label", label), value_counts(per_user, "value"))


def activity_histogram(df: DataFrame, grain: str = "day") -> DataFrame:
    """Users by the number of periods they were active in.

    Bins are 1 period wide up to 10 periods, 5 up to 30, else 10; the last bin ends at the largest number.
    """
    counts = active_periods(df, grain).where(F.col("periods") > 0)
    most = F.max("periods")
    frame = counts.agg(most.alias("most"), F.when(most <= 10, 1).when(most <= 30, 5).otherwise(10).alias("width"))
    frame = frame.where(F.col("most").isNotNull())
    scale = frame.select(F.struct("most", "width")).scalar()
    placed = counts.select("periods", scale.alias("_s")).groupBy(
        F.floor((F.col("periods") - 1) / F.col("_s.width")).cast("int").alias("bin")) \
        .agg(F.count(F.lit(1)).alias("users"))
    last_bin = F.floor((F.col("most") - 1) / F.col("width")).cast("int")
    grid = frame.select(F.explode(F.sequence(F.lit(0), last_bin)).alias("bin"), "most", "width")
    low = (F.col("bin") * F.col("width") + 1).cast("long")
    grid = grid.select("bin", low.alias("low"), F.least(low + F.col("width") - 1, "most").alias("high"), "width")
    label = F.when(F.col("width") == 1, F.col("low").cast("string")).otherwise(
        F.concat(F.col("low").cast("string"), F.lit("-"), F.col("high").cast("string")))
    shown = grid.join(placed, "bin", "left").select(
        "bin", label.alias("label"), F.coalesce("users", F.lit(0)).cast("long").alias("users"))
    shown = _with_center(shown, value_counts(counts, "periods"), ("average", "median"))
    return with_activity_totals(shown, df, grain)
