"""Fixed bins and equal-width bins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import as_column

Bins = Sequence[tuple[str, float]]

# Fixed values: (label, lower bound in hours); each bin ends where the next begins, the last is open.
HISTOGRAM_BINS = [
    ("< 1h", 0), ("1h - 4h", 1), ("4h - 12h", 4), ("12h - 24h", 12), ("1d - 3d", 24), ("3d - 7d", 72), ("> 7d", 168)]
DURATION_BINS = [
    ("< 1h", 0), ("1h-4h", 1), ("4h-12h", 4), ("12h-24h", 12), ("1d-3d", 24), ("3d-7d", 72), ("> 7d", 168)]
WAITING_BINS = [
    ("< 30min", 0), ("30min-1h", 0.5), ("1h-4h", 1), ("4h-12h", 4), ("12h-24h", 12), ("> 24h", 24)]
SPACED_WAITING_BINS = [
    ("< 30min", 0), ("30min - 1h", 0.5), ("1h - 4h", 1), ("4h - 12h", 4), ("12h - 24h", 12), ("> 24h", 24)]
FINE_WAITING_BINS = [
    ("< 15min", 0), ("15-30min", 0.25), ("30min-1h", 0.5), ("1-2h", 1), ("2-4h", 2), ("4-8h", 4), ("8-12h", 8),
    ("12-24h", 12), ("1-2 days", 24), ("> 2 days", 48)]
FINE_DURATION_BINS = [
    ("< 15min", 0), ("15-30min", 0.25), ("30min-1h", 0.5), ("1-2h", 1), ("2-4h", 2), ("4-8h", 4), ("8-12h", 8),
    ("12-24h", 12), ("1-2 days", 24), ("2-3 days", 48), ("3-7 days", 72), ("> 7 days", 168)]


def bin_index(value: Column | str, bins: Bins) -> Column:
    """0-based bin of a value, closed below and open above; null below the first bound."""
    value = as_column(value)
    index = F.lit(None).cast("int")
    for i, (_, lower) in enumerate(bins):
        index = F.when(value >= lower, i).otherwise(index)
    return index


def bin_table(bins: Bins) -> Column:
    """Array of (bin, label), for exploding into one row per bin."""
    return F.array(*[F.struct(F.lit(i).alias("bin"), F.lit(name).alias("label")) for i, (name, _) in enumerate(bins)])


def equal_width(values: DataFrame, column: str, n_bins: Column) -> DataFrame:
    """Equal-width histogram of ``column``: one row (bin, lower, upper, center, count) per bin, empty bins included.

    ``n_bins`` is an aggregate expression over ``values``, or a literal. Bounds come from one scalar subquery, so no
    data reaches the driver. Constant input is widened by 0.5 on both sides; the last bin is closed above.
    """
    v = F.col(column).cast("double")
    values = values.where(v.isNotNull())
    low, high = F.min(v), F.max(v)
    flat = low == high
    frame = values.agg(
        F.when(flat, low - 0.5).otherwise(low).alias("lo"),
        F.when(flat, high + 0.5).otherwise(high).alias("hi"),
        n_bins.cast("int").alias("n"), F.count(F.lit(1)).alias("rows"))
    frame = frame.where(F.col("rows") > 0).withColumn("w", (F.col("hi") - F.col("lo")) / F.col("n"))
    scale = frame.select(F.struct("lo", "hi", "n", "w")).scalar()

    placed = values.select(v.alias("_v"), scale.alias("_s"))
    edge = lambda i: F.when(i == F.col("_s.n"), F.col("_s.hi")).otherwise(F.col("_s.lo") + i * F.col("_s.w"))
    guess = F.least(F.floor((F.col("_v") - F.col("_s.lo")) / F.col("_s.w")).cast("int"), F.col("_s.n") - 1)
    # One step up or down where the division and the edge disagree in the last bit.
    step = F.when(F.col("_v") < edge(guess), -1).when(
        (F.col("_v") >= edge(guess + 1)) & (guess < F.col("_s.n") - 1), 1).otherwise(0)
    counts = placed.groupBy((guess + step).alias("bin")).agg(F.count(F.lit(1)).alias("count"))

    grid = frame.select(F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("bin"), "lo", "hi", "n", "w")
    upper = F.when(F.col("bin") == F.col("n") - 1, F.col("hi")).otherwise(F.col("lo") + (F.col("bin") + 1) * F.col("w"))
    grid = grid.select("bin", (F.col("lo") + F.col("bin") * F.col("w")).alias("lower"), upper.alias("upper"))
    return grid.join(counts, "bin", "left").select(
        "bin", "lower", "upper", ((F.col("lower") + F.col("upper")) / 2).alias("center"),
        F.coalesce("count", F.lit(0)).cast("long").alias("count"))
