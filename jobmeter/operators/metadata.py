"""What a jobs table holds: dates, dimension values and nodes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.nodes import expand_nodelist
from ..functions.text import partition_list
from ..functions.weights import submit_bounds
from ..schema import DIMENSIONS


def date_range(df: DataFrame, by: Sequence[str] = ("cluster",)) -> DataFrame:
    first, last = submit_bounds(df)
    return df.groupBy(*by).agg(first.cast("date").alias("min_date"), last.cast("date").alias("max_date"))


def dimension_values(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Distinct (dimension, value) over all five dimensions in one scan; partition lists are split."""
    entry = lambda name, value: F.struct(F.lit(name).alias("dimension"), value.alias("value"))
    single = [F.array(entry(d, F.col(d))) for d in DIMENSIONS if d != "Partition"]
    split = F.transform(F.coalesce(partition_list("Partition"), F.array().cast("array<string>")),
                        lambda p: entry("Partition", p))
    # Each task reduces its rows to distinct values before the one shuffle, so a value that most jobs share costs nothing.
    return (df.select(*by, F.explode(F.concat(split, *single)).alias("e"))
            .select(*by, "e.*").where(F.col("value").isNotNull()).distinct())


def node_names(df: DataFrame) -> Column:
    """Array of the trimmed node names of a job, from a node list stored as text or as an array."""
    names = F.col("NodeList")
    if not isinstance(df.schema["NodeList"].dataType, T.ArrayType):
        names = expand_nodelist(names)
    trimmed = F.transform(names, lambda n: F.trim(n))
    return F.filter(trimmed, lambda n: n.isNotNull() & ~n.isin("", "None assigned"))


def with_nodes(df: DataFrame, column: str = "node") -> DataFrame:
    """One row per job and node."""
    return df.withColumn(column, F.explode(node_names(df)))


def distinct_nodes(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Distinct node names. Each distinct node list is expanded once."""
    return with_nodes(df.select(*by, "NodeList").distinct()).select(*by, "node").distinct()


def union_nodes(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select("node").union(b.select("node")).distinct()


def explode_partitions(df: DataFrame) -> DataFrame:
    """One row per job and listed partition, for charts that should not treat 'a,b' as a group of its own."""
    return df.withColumn("Partition", F.explode(partition_list("Partition")))
