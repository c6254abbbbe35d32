"""Usage per node, hardware lookup and utilisation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.time import utilisation
from .metadata import distinct_nodes, node_names, with_nodes

HOURS = ["CPUHours", "GPUHours"]


def _cluster_key(*frames: DataFrame) -> list[str]:
    """Node names are unique within a cluster only: the cluster is part of the key where all of ``frames`` have it."""
    return ["cluster"] if all("cluster" in f.columns for f in frames) else []


def canonical_node(df: DataFrame, synonyms: DataFrame, column: str = "node", case_sensitive: bool = False) -> DataFrame:
    """Replace node names by their canonical name; unknown names stay. ``synonyms`` has (name, node), names included.

    An exact match wins over one that ignores case. Where both have a cluster, names are those of the row's cluster.
    """
    by = _cluster_key(df, synonyms)
    exact = synonyms.groupBy(*by, F.col("name").alias("_name")).agg(F.min("node").alias("_exact"))
    out = df.withColumn("_name", F.col(column)).join(exact, [*by, "_name"], "left").drop("_name")
    found = [F.col("_exact")]
    if not case_sensitive:
        folded = synonyms.groupBy(*by, F.lower("name").alias("_low")).agg(F.min("node").alias("_folded"))
        out = out.withColumn("_low", F.lower(column)).join(folded, [*by, "_low"], "left").drop("_low")
        found.append(F.col("_folded"))
    return out.withColumn(column, F.coalesce(*found, F.col(column))).select(*df.columns)


def with_hardware(nodes: DataFrame, dims: dict[str, DataFrame], cluster: str | None = None) -> DataFrame:
    """Add cpu_cores and gpu_count: the node's own entry, else the first matching pattern, else its type's default.

    The patterns are one small config array; each node name is tested against it in place, so no join pairs every
    node with every pattern. A type without defaults gets 64 cores and no GPU. ``nodes`` with a cluster column are looked up
    in their own cluster; without one, ``cluster`` names the cluster that all are in.
    """
    synonym, node = dims["synonym"], dims["node"]
    if cluster is not None:
        synonym, node = synonym.where(F.col("cluster") == cluster), node.where(F.col("cluster") == cluster)
    by = _cluster_key(nodes, node)
    own = node.select(*by, F.col("node").alias("_entry"), F.col("type").alias("_type"),
                      F.col("cpu_cores").alias("_own_cpu"), F.col("gpu_count").alias("_own_gpu"))
    patterns = dims["pattern"].agg(F.sort_array(F.collect_list(
        F.struct("priority", "pattern", "cpu_cores", "gpu_count"))).alias("all")).scalar()
    kinds = dims["type_default"].select(F.col("type").alias("_type"), F.col("cpu_cores").alias("_type_cpu"),
                                        F.col("gpu_count").alias("_type_gpu"))
    default_type = dims["settings"].agg(F.first("default_node_type")).scalar()

    named = canonical_node(nodes.withColumn("_entry", F.col("node")), synonym, "_entry")
    matching = F.filter(F.col("_patterns"), lambda p: F.regexp_like(
        "node", F.concat(F.lit("(?i)^(?:"), p["pattern"], F.lit(")"))))
    looked = (named.join(own, [*by, "_entry"], "left")
              .withColumn("_type", F.coalesce("_type", default_type, F.lit("cpu")))
              .join(kinds, "_type", "left")
              .withColumn("_patterns", patterns)
              .withColumn("_hit", F.get(matching, F.lit(0))))
    pick = lambda own_value, field, type_value, last: F.when(
        F.col("_own_cpu").isNotNull(), F.col(own_value)).when(
        F.col("_hit").isNotNull(), F.col(f"_hit.{field}")).otherwise(F.coalesce(type_value, F.lit(last)))
    return looked.select(*nodes.columns,
                         pick("_own_cpu", "cpu_cores", "_type_cpu", 64).cast("int").alias("cpu_cores"),
                         pick("_own_gpu", "gpu_count", "_type_gpu", 0).cast("int").alias("gpu_count"))


def with_legacy_resources(nodes: DataFrame, entries: DataFrame, patterns: DataFrame, default_cpus: int = 1,
                          default_gpus: int = 0) -> DataFrame:
    """Add cpus and gpus from exact entries (node, cpus, gpus), else the first '*' pattern, else the defaults.

    ``patterns`` has (priority, pattern, cpus, gpus). An entry or pattern without a count means 1 CPU, no GPU.
    """
    own = entries.select("node", F.lit(True).alias("_own"), F.coalesce("cpus", F.lit(1)).alias("_own_cpus"),
                         F.coalesce("gpus", F.lit(0)).alias("_own_gpus"))
    listed = patterns.agg(F.sort_array(F.collect_list(F.struct(
        "priority", F.concat(F.lit("^"), F.regexp_replace("pattern", r"\*", ".*"), F.lit("$")).alias("regex"),
        F.coalesce("cpus", F.lit(1)).alias("cpus"), F.coalesce("gpus", F.lit(0)).alias("gpus")))).alias("all")).scalar()
    looked = nodes.join(own, "node", "left").withColumn("_patterns", listed)
    looked = looked.withColumn("_hit", F.get(
        F.filter(F.col("_patterns"), lambda p: F.regexp_like("node", p["regex"])), F.lit(0)))
    value = lambda name, default: F.when(F.col("_own"), F.col(f"_own_{name}")).otherwise(
        F.coalesce(f"_hit.{name}", F.lit(default))).cast("int")
    return looked.select(*nodes.columns, value("cpus", default_cpus).alias("cpus"),
                         value("gpus", default_gpus).alias("gpus"))


def unknown_nodes(df: DataFrame, synonyms: DataFrame, case_sensitive: bool = False, by_cluster: bool = False) -> DataFrame:
    """Nodes in the data that the config names neither directly nor as a synonym; ``by_cluster`` in their own cluster."""
    fold = (lambda c: F.col(c)) if case_sensitive else (lambda c: F.lower(c))
    by = ["cluster"] if by_cluster else []
    known = synonyms.select(*by, fold("name").alias("_known")).distinct()
    if not by_cluster:
        nodes = distinct_nodes(df)
    else:
        nodes = with_nodes(df.select("cluster", "NodeList").distinct()).select("cluster", "node").distinct()
    return nodes.withColumn("_known", fold("node")).join(known, [*by, "_known"], "left_anti").select(*by, "node")


def node_usage(df: DataFrame, color_by: str | None = None, hide_unused: bool = False, split: bool = False,
               total_only: bool = False, by_cluster: bool = False) -> DataFrame:
    """CPU- and GPU-hours per node and resource: rows (resource, node[, series], value).

    Jobs of several clusters need ``by_cluster``, which adds their cluster to the rows: names of nodes may be the same in
    different clusters.

    Hours are first summed per node list, so a list is expanded once and not once per job. Every node of a job gets
    the job's full hours; ``split`` divides them by the number of nodes.
    """
    cluster = ["cluster"] if by_cluster else []
    keys = [*cluster, "NodeList"] + ([color_by] if color_by else [])
    rows = df.where(F.col(color_by).isNotNull()) if color_by else df
    per_list = rows.groupBy(*keys).agg(*[F.sum(h).alias(h) for h in HOURS])
    if split:
        size = F.greatest(F.size(node_names(per_list)), F.lit(1))
        per_list = per_list.withColumns({h: F.col(h) / size for h in HOURS})
    usage = with_nodes(per_list)
    by = [*cluster, "node"] + ([color_by] if color_by else [])
    summed = usage.groupBy(*by).agg(*[F.sum(h).alias(h) for h in HOURS])
    series = [F.col(color_by).alias("series")] if color_by else []
    long = summed.select(*cluster, "node", *series, F.inline(F.array(
        F.struct(F.lit("cpu").alias("resource"), F.col("CPUHours").alias("value")),
        F.struct(F.lit("gpu").alias("resource"), F.col("GPUHours").alias("value")))))
    return hide_idle(long) if hide_unused else long


def hide_idle(usage: DataFrame) -> DataFrame:
    return usage.where(F.col("value") > 0)


def node_utilisation(usage: DataFrame, dims: dict[str, DataFrame], total_hours, cluster: str | None = None) -> DataFrame:
    """Node usage in percent of what the node could do in ``total_hours``. Hardware is looked up once per node.

    Usage by cluster takes the hardware of each cluster; else ``cluster`` names the one that the jobs are of.
    """
    by = [*_cluster_key(usage), "node"]
    hardware = with_hardware(usage.select(*by).distinct(), dims, cluster)
    capacity = F.when(F.col("resource") == "cpu", F.col("cpu_cores")).otherwise(F.col("gpu_count"))
    total = F.lit(float(total_hours)) if isinstance(total_hours, (int, float)) else total_hours
    return usage.join(hardware, by).withColumn("hours", F.col("value")).withColumn(
        "value", utilisation("hours", capacity, total))


def usage_per_core(usage: DataFrame, resources: DataFrame) -> DataFrame:
    """Hours per CPU or GPU of the node; nodes without GPU keep their GPU-hours."""
    count = F.when(F.col("resource") == "cpu", F.col("cpus")).otherwise(F.col("gpus"))
    return usage.join(resources, "node").withColumn("value", F.col("value") / F.greatest(count, F.lit(1))) \
        .select(*usage.columns)


def cluster_utilisation(utilised: DataFrame, idle: DataFrame | None = None) -> DataFrame:
    """Mean over nodes of their (stacked) utilisation, per resource and, where usage is by cluster, per cluster.

    ``idle`` adds nodes (node, and cluster where usage has it) that had no jobs.
    """
    by = _cluster_key(utilised)
    per_node = utilised.groupBy(*by, "resource", "node").agg(F.sum("value").alias("value"))
    if idle is not None:
        unused = idle.select(*by, "node", F.explode(F.array(F.lit("cpu"), F.lit("gpu"))).alias("resource"))
        unused = unused.join(per_node, [*by, "resource", "node"], "left_anti").withColumn("value", F.lit(0.0))
        per_node = per_node.unionByName(unused)
    return per_node.groupBy(*by, "resource").agg(F.avg("value").alias("percent"))
