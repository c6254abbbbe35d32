"""Running totals, peaks and alignment over short timelines, and differences between snapshots."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def cumulative(timeline: DataFrame, metrics: Sequence[str], date: str = "date", by: Sequence[str] = ()) -> DataFrame:
    """Running totals. A timeline has one row per period (and group), so a window holds calendar rows only."""
    running = Window.partitionBy(*by).orderBy(date).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return timeline.withColumns({f"cumulative_{m}": F.sum(m).over(running) for m in metrics})


def peaks(timeline: DataFrame, metrics: Sequence[str] = ("jobs", "cpu_hours", "gpu_hours"), date: str = "date",
          by: Sequence[str] = ()) -> DataFrame:
    """Peak value, its first date, and the mean over the periods, per metric."""
    aggs = [F.count(F.lit(1)).alias("periods")]
    for m in metrics:
        first_on_top = F.max_by(date, F.struct(F.col(m), -F.unix_date(date)))
        aggs += [F.max(m).alias(f"peak_{m}"), first_on_top.alias(f"peak_{m}_date"),
                 (F.sum(m) / F.count(F.lit(1))).alias(f"mean_{m}")]
    return timeline.groupBy(*by).agg(*aggs)


def align_previous(current: DataFrame, previous: DataFrame, metrics: Sequence[str], date: str = "date",
                   by: Sequence[str] = ()) -> DataFrame:
    """Current timeline with the previous period's metrics at the same position; the shorter side gives null."""
    place = F.row_number().over(Window.partitionBy(*by).orderBy(date))
    cur = current.select(*by, date, *metrics, place.alias("position"))
    prev = previous.select(*by, *[F.col(m).alias(f"previous_{m}") for m in metrics], place.alias("position"))
    return cur.join(prev, [*by, "position"], "left")


def snapshot_diff(previous: DataFrame, current: DataFrame, key: str = "JobID") -> DataFrame:
    """Keys that are new in ``current`` or gone from it."""
    before, now = previous.select(key).distinct(), current.select(key).distinct()
    new = now.join(before, key, "left_anti").withColumn("change", F.lit("new"))
    gone = before.join(now, key, "left_anti").withColumn("change", F.lit("gone"))
    return new.unionByName(gone)
