"""Top groups, shares and orderings. Ties are broken by label."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.nodes import natural_key


def top_n(agg: DataFrame, n: int, label: str = "label", value: str | Column = "value") -> DataFrame:
    score = F.col(value) if isinstance(value, str) else value
    return agg.orderBy(score.desc(), label).limit(n)


def top_n_others(agg: DataFrame, n: int, label: str = "label", value: str = "value", unit: str = "",
                 name: str | None = None) -> DataFrame:
    """The ``n`` largest groups with their rank, and one row 'Others (k)' for the other ``k`` if its sum is above 0.

    Only the ``n`` top rows are ever gathered; the remainder is summed where it lies.
    """
    head = top_n(agg, n, label, value)
    rank = F.row_number().over(Window.orderBy(F.desc(value), label))
    shown = head.select(rank.alias("rank"), label, value)
    # Conditions inside the aggregates, not a filter: a filter on the label would move below ``agg`` and compute it again.
    is_rest = ~F.array_contains(head.agg(F.collect_list(label)).scalar(), F.col(label))
    rest = agg.agg(F.count_if(is_rest).alias("_k"), F.sum(F.when(is_rest, F.col(value))).alias("_sum")) \
        .where(F.col("_sum") > 0)
    tail = f" {unit})" if unit else ")"
    title = F.lit(name) if name else F.concat(F.lit("Others ("), F.col("_k").cast("string"), F.lit(tail))
    others = rest.select(F.lit(n + 1).alias("rank"), title.alias(label),
                         F.col("_sum").cast(agg.schema[value].dataType).alias(value))
    return shown.unionByName(others)


def pie_top(agg: DataFrame, n: int = 8, label: str = "label", value: str = "value") -> DataFrame:
    """``n`` slices at most: the n-1 largest groups and 'Other'."""
    return top_n_others(agg, n - 1, label, value, name="Other")


def top_by_sum(agg: DataFrame, columns: Sequence[str], n: int, label: str = "label") -> DataFrame:
    """Top groups by the sum of several metrics."""
    total = F.lit(0.0)
    for c in columns:
        total = total + F.coalesce(F.col(c), F.lit(0))
    return top_n(agg, n, label, total)


def share(agg: DataFrame, value: str = "value") -> DataFrame:
    """Add each group's percent of the total; null when the total is 0."""
    total = agg.agg(F.sum(value)).scalar()
    return agg.withColumn("percent", F.try_divide(F.col(value) * 100.0, total))


def order_nodes(usage: DataFrame, mode: str = "name", node: str = "node", value: str = "value") -> DataFrame:
    """Nodes by 'name', by 'natural' name, or by falling 'value' (hours or percent)."""
    if mode == "value":
        return usage.orderBy(F.desc(value), node)
    return usage.orderBy(natural_key(node) if mode == "natural" else F.col(node), node)


def chronological(df: DataFrame, period: str = "period", *rest: str) -> DataFrame:
    return df.orderBy(period, *rest)


def by_metric(df: DataFrame, metric: str, label: str) -> DataFrame:
    return df.orderBy(F.desc(metric), label)
