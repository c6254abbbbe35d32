"""Cluster registry and display labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def active_clusters(df: DataFrame, registry: DataFrame | None) -> DataFrame:
    """Rows of clusters marked active; without a registry all rows stay."""
    if registry is None:
        return df
    return df.join(registry.where("active").select("cluster"), "cluster", "left_semi")


def with_labels(df: DataFrame, dims: dict[str, DataFrame]) -> DataFrame:
    """Add display names of account, partition and cluster; the key itself where none is configured."""
    account = dims["account"].select("cluster", "Account", F.col("display_name").alias("_a"),
                                     F.col("short_name").alias("_s"))
    partition = dims["partition"].select("cluster", "Partition", F.col("display_name").alias("_p"),
                                         F.col("description").alias("_d"))
    cluster = dims["cluster"].select("cluster", F.col("display_name").alias("_c"))
    joined = (df.join(account, ["cluster", "Account"], "left")
              .join(partition, ["cluster", "Partition"], "left").join(cluster, "cluster", "left"))
    return joined.select(
        *df.columns,
        F.coalesce("_a", "Account").alias("account_label"), F.coalesce("_s", "Account").alias("account_short"),
        F.coalesce("_p", "Partition").alias("partition_label"),
        F.coalesce("_d", F.concat("Partition", F.lit(" partition"))).alias("partition_description"),
        F.coalesce("_c", "cluster").alias("cluster_label"))


def node_labels(nodes: DataFrame, dims: dict[str, DataFrame]) -> DataFrame:
    """Add type and description of each (cluster, node), with the configured default type."""
    known = dims["node"].select("cluster", "node", F.col("type").alias("_t"), F.col("description").alias("_d"))
    default_type = dims["settings"].agg(F.first("default_node_type")).scalar()
    return nodes.join(known, ["cluster", "node"], "left").select(
        *nodes.columns, F.coalesce("_t", default_type, F.lit("cpu")).alias("type"),
        F.coalesce("_d", F.concat(F.lit("Node "), F.col("node"))).alias("description"))
