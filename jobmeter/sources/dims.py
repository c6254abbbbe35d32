"""Cluster configuration as small tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import nodes as N
from ..functions.text import account_short_name, partition_title
from ..operators.metadata import dimension_values, distinct_nodes

_HARDWARE = "struct<cpu:struct<cores:int>,gpus:array<struct<count:int>>>"
CONFIG = (
    "clusters map<string,struct<display_name:string,description:string,"
    f"node_labels:map<string,struct<synonyms:array<string>,type:string,description:string,hardware:{_HARDWARE}>>,"
    "account_labels:map<string,struct<display_name:string,short_name:string>>,"
    "partition_labels:map<string,struct<display_name:string,description:string>>,active:boolean>>,"
    "settings struct<default_node_type:string,case_sensitive:boolean,auto_generate_labels:boolean,"
    "hardware_defaults:map<string,struct<cpu_cores:int,gpu_count:int>>,"
    "node_type_patterns:array<struct<name:string,pattern:string,cpu_cores:int,gpu_count:int>>>"
)


def load_dims(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """Tables node, synonym, account, partition, cluster, pattern, type_default and settings from a JSON config.

    Patterns are a list, because their order decides which one applies.
    """
    config = spark.read.schema(CONFIG).option("multiLine", "true").json(path)
    clusters = config.select(F.explode("clusters").alias("cluster", "c"))
    nodes = clusters.select("cluster", F.explode("c.node_labels").alias("node", "n"))
    cores = F.col("n.hardware.cpu.cores")
    gpus = F.coalesce(F.get("n.hardware.gpus", F.lit(0))["count"], F.lit(0))
    node = nodes.select(
        "cluster", "node", F.col("n.type").alias("type"), F.col("n.description").alias("description"),
        F.when(cores > 0, cores).alias("cpu_cores"), F.when(cores > 0, gpus).alias("gpu_count"))
    names = F.array_distinct(F.concat(F.array("node"), F.coalesce("n.synonyms", F.array().cast("array<string>"))))
    settings = config.select("settings.*")
    pattern = settings.select(F.posexplode("node_type_patterns").alias("priority", "p")).select(
        "priority", "p.name", "p.pattern", F.coalesce("p.cpu_cores", F.lit(48)).alias("cpu_cores"),
        F.coalesce("p.gpu_count", F.lit(0)).alias("gpu_count"))
    defaults = settings.select(F.explode("hardware_defaults").alias("type", "d")).select("type", "d.*")
    return {
        "node": node,
        "synonym": nodes.select("cluster", F.explode(names).alias("name"), "node"),
        "account": clusters.select("cluster", F.explode("c.account_labels").alias("Account", "a"))
        .select("cluster", "Account", "a.*"),
        "partition": clusters.select("cluster", F.explode("c.partition_labels").alias("Partition", "p"))
        .select("cluster", "Partition", "p.*"),
        "cluster": clusters.select("cluster", F.coalesce("c.display_name", "cluster").alias("display_name"),
                                   F.coalesce("c.active", F.lit(True)).alias("active")),
        "pattern": pattern,
        "type_default": defaults,
        "settings": settings.select(F.coalesce("default_node_type", F.lit("cpu")).alias("default_node_type"),
                                    F.coalesce("case_sensitive", F.lit(False)).alias("case_sensitive"),
                                    F.coalesce("auto_generate_labels", F.lit(False)).alias("auto_generate_labels")),
    }


def generate_dims(jobs: DataFrame) -> dict[str, DataFrame]:
    """Node, account and partition tables made from the data of each cluster, and their sizes."""
    nodes = distinct_nodes(jobs, by=["cluster"]).where(N.valid_node("node"))
    kind = N.node_type("node")
    node = nodes.select("cluster", "node", kind.alias("type"),
                        F.concat(F.upper(kind), F.lit(" Node "), F.col("node")).alias("description"))
    values = dimension_values(jobs, by=["cluster"])
    accounts = values.where(F.col("dimension") == "Account").withColumnRenamed("value", "Account")
    account = accounts.select("cluster", "Account", F.col("Account").alias("display_name"),
                              account_short_name("Account").alias("short_name"))
    partitions = values.where(F.col("dimension") == "Partition").withColumnRenamed("value", "Partition")
    partition = partitions.select("cluster", "Partition", partition_title("Partition").alias("display_name"),
                                  F.concat("Partition", F.lit(" partition")).alias("description"))
    sized = [t.groupBy("cluster").agg(F.count(F.lit(1)).alias("rows")).withColumn("table", F.lit(name))
             for name, t in (("node", node), ("account", account), ("partition", partition))]
    return {"node": node, "account": account, "partition": partition,
            "stats": sized[0].unionByName(sized[1]).unionByName(sized[2])}


def write_dims(dims: dict[str, DataFrame], path: str) -> None:
    for name, table in dims.items():
        table.write.mode("overwrite").parquet(f"{path}/{name}")
