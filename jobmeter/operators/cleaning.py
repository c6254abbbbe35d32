"""Ordered fill and deduplication that hold up when one file or one job has a large share of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Place of a line: start of its file split, then its number within the split.
LINE_ORDER = ["_split", "_line"]


def fill_forward(df: DataFrame, columns: Sequence[str], file: str = "_file") -> DataFrame:
    """Replace nulls by the last value above them in the same file.

    Windows run inside one file split, whose size the reader bounds. What a split inherits comes from a table with
    one row per split.
    """
    in_split = Window.partitionBy(file, "_split").orderBy("_line").rowsBetween(Window.unboundedPreceding, 0)
    last_of_split = df.groupBy(file, "_split").agg(*[
        F.max_by(c, F.when(F.col(c).isNotNull(), F.col("_line"))).alias(f"_in_{c}") for c in columns])
    above = Window.partitionBy(file).orderBy("_split").rowsBetween(Window.unboundedPreceding, -1)
    carried = last_of_split.select(
        file, "_split", *[F.last(f"_in_{c}", ignorenulls=True).over(above).alias(f"_in_{c}") for c in columns])
    filled = df.withColumns({c: F.last(c, ignorenulls=True).over(in_split) for c in columns})
    return (filled.join(carried, [file, "_split"], "left")
            .withColumns({c: F.coalesce(c, f"_in_{c}") for c in columns})
            .select(*df.columns))


def keep_last(df: DataFrame, keys: Sequence[str] = ("cluster", "JobID"), order: Sequence[str] = ("ingest_seq", "arrival")) -> DataFrame:
    """One row per key: the last one by the columns of ``order`` that are there.

    A record without ``ingest_seq`` comes before those that have one. Only the order is compared; rows that share it, or have none, are
    told apart by a hash of their values, so that the answer is the same in each run. An aggregate rather than a window, so copies of a hot key are
    reduced before the shuffle.
    """
    order = [c for c in order if c in df.columns]
    rest = [c for c in df.columns if c not in keys]
    hashed = F.xxhash64(*[c for c in rest if c not in order]) if set(rest) - set(order) else F.lit(0)
    best = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order, hashed)).alias("_best"))
    return best.select(*[F.col(c) if c in keys else F.col(f"_best.`{c}`").alias(c) for c in df.columns])
