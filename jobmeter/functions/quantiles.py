"""Exact percentiles that never hold a whole group in one task.

Values are counted first. A monotone bucket of each value gives a short cumulative table per group
that tells in which bucket each wanted rank lies. Those buckets are cut into slices the same way, and
only the values of the slices that hold a rank are put in order.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .weights import job_count

BUCKETS_PER_OCTAVE = 512  # a bucket spans 0.14 % of its value: about 2 minutes at one day
SMALLEST = 4096  # values below 1/4096 share few buckets
SLICES = 4096  # of a bucket, equally wide


def _bucket(value: Column) -> Column:
    octaves = F.log1p(F.abs(value) * SMALLEST) / math.log(2)
    step = F.floor(octaves * BUCKETS_PER_OCTAVE)
    return F.when(value < 0, -step).otherwise(step)


def value_counts(df: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """How often each value occurs: (by, _v, _n). Null values and null group keys are left out; rows may stand for several jobs."""
    v = F.col(value).cast("double")
    clean = df.where(v.isNotNull() & ~F.isnan(v))
    for key in by:
        clean = clean.where(F.col(key).isNotNull())
    # The join on the bucket adds this test to its side; with it on both sides the counts are made only once.
    clean = clean.where(_bucket(v).isNotNull())
    return clean.groupBy(*by, v.alias("_v")).agg(job_count(clean).alias("_n"))


def exact_stats(df: DataFrame, value: str, probs: Mapping[str, float], by: Sequence[str] = ()) -> DataFrame:
    """Per group: count, mean, min, max and linearly interpolated percentiles of ``value``.

    ``probs`` maps an output column to its probability.
    """
    return stats_of_counts(value_counts(df, value, by), probs, by)


def stats_of_counts(counted: DataFrame, probs: Mapping[str, float], by: Sequence[str] = ()) -> DataFrame:
    """``exact_stats`` from a table made by ``value_counts``."""
    by = list(by)
    counted = counted.withColumn("_b", _bucket(F.col("_v")))
    buckets = counted.groupBy(*by, "_b").agg(
        F.sum("_n").alias("_bn"), F.sum(F.col("_v") * F.col("_n")).alias("_bs"),
        F.min("_v").alias("_bmin"), F.max("_v").alias("_bmax"))
    # One group has at most some 100,000 buckets however many values it has, so these windows stay small.
    whole = Window.partitionBy(*by)
    running = whole.orderBy("_b").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    marks = buckets.select(
        *by, "_b", "_bn", "_bmin", "_bmax",
        (F.sum("_bn").over(running) - F.col("_bn")).alias("_before"),
        F.sum("_bn").over(whole).alias("count"),
        (F.sum("_bs").over(whole) / F.sum("_bn").over(whole)).alias("mean"),
        F.min("_bmin").over(whole).alias("min"),
        F.max("_bmax").over(whole).alias("max"))

    def holds(rank: Column, start: str, size: str) -> Column:
        return (F.col(start) <= rank) & (rank < F.col(start) + F.col(size))

    position = {p: (F.col("count") - 1) * F.lit(float(p)) for p in probs.values()}
    wanted = F.lit(False)
    for pos in position.values():
        wanted = wanted | holds(F.floor(pos), "_before", "_bn") | holds(F.ceil(pos), "_before", "_bn")
    marks = marks.where(wanted)

    width = F.greatest(F.col("_bmax") - F.col("_bmin"), F.lit(1e-300))
    sliced = counted.join(marks, by + ["_b"]).withColumn("_s", F.floor((F.col("_v") - F.col("_bmin")) / width * SLICES))
    slices = sliced.groupBy(*by, "_b", "_s").agg(F.sum("_n").alias("_sn"), F.first("_before").alias("_before"), F.first("count").alias("count"))
    running = Window.partitionBy(*by, "_b").orderBy("_s").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    slices = slices.withColumn("_start", F.col("_before") + F.sum("_sn").over(running) - F.col("_sn"))
    wanted = F.lit(False)
    for pos in position.values():
        wanted = wanted | holds(F.floor(pos), "_start", "_sn") | holds(F.ceil(pos), "_start", "_sn")
    slices = slices.where(wanted).select(*by, "_b", "_s", "_start")

    inside = Window.partitionBy(*by, "_b", "_s").orderBy("_v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = sliced.join(slices, by + ["_b", "_s"]).withColumn(
        "_first", F.col("_start") + F.sum("_n").over(inside) - F.col("_n"))
    aggs = [F.max(c).alias(c) for c in ("count", "mean", "min", "max")]
    for i, pos in enumerate(position.values()):
        aggs.append(F.max(F.when(holds(F.floor(pos), "_first", "_n"), F.col("_v"))).alias(f"_lo{i}"))
        aggs.append(F.max(F.when(holds(F.ceil(pos), "_first", "_n"), F.col("_v"))).alias(f"_hi{i}"))
    found = ranked.groupBy(*by).agg(*aggs)
    if not by:
        found = found.where(F.col("count").isNotNull())
    between = {p: F.col(f"_lo{i}") + (F.col(f"_hi{i}") - F.col(f"_lo{i}")) * (pos - F.floor(pos))
               for i, (p, pos) in enumerate(position.items())}
    return found.select(*by, "count", "mean", "min", "max", *[between[p].alias(name) for name, p in probs.items()])
