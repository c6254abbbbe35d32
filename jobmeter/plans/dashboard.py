"""All charts of the dashboard for one filter, from one reduced table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.time import data_range_hours, range_hours
from ..operators import histograms as H
from ..operators import measures as M
from ..operators.filters import filter_jobs
from ..operators.metadata import date_range, dimension_values
from ..operators.nodes import node_usage
from ..operators.reduce import MEASURES, reduce_by
from ..session import file_system, scratch_path
from ..sources.digests import read_digest

# The columns that the charts read; everything else is pruned from the scan.
CHART_COLUMNS = [
    "cluster", "Submit", "User", "Account", "Partition", "QOS", "State", "CPUs", "GPUs", "Nodes", "NodeList", "CPUHours",
    "GPUHours", "WaitingTimeHours", "ElapsedHours", "SubmitDay", "SubmitWeek", "SubmitMonth", "SubmitYear",
    "StartDay", "StartWeek", "StartMonth", "StartYear"]


def _key_sets(grain: str, color_by: str | None) -> dict[str, list[str]]:
    """The keys by which jobs are counted and hours summed; each chart reads one of these sets."""
    color = [color_by] if color_by else []
    sets = {
        "submitted": [f"Submit{grain.capitalize()}", *color, "User"], "started": [f"Start{grain.capitalize()}", *color, "User"],
        "partition": ["Partition"], "state": ["State"], "cpus": ["CPUs"], "gpus": ["GPUs"], "nodes": ["Nodes"],
        "waiting": [f"Start{grain.capitalize()}", "WaitingTimeHours"], "duration": [f"Start{grain.capitalize()}", "ElapsedHours"],
        "lists": ["cluster", "NodeList", *color]}
    return {name: list(dict.fromkeys(keys)) for name, keys in sets.items()}


def reduce_jobs(jobs: DataFrame, sets: dict[str, list[str]]) -> dict[str, DataFrame]:
    """One table per set of keys, all filled by a single pass over ``jobs``.

    The columns are named as those of jobs, so that operators on jobs take a reduced table too: hours are sums, and ``_jobs`` tells how many jobs a
    row stands for. The tables lie in the shared folder until the session ends.
    """
    cube = reduce_by(jobs, sets)
    spark = jobs.sparkSession
    path = scratch_path(spark, "dashboard")
    cube.write.partitionBy("set").parquet(path)
    fs, folder = file_system(spark, path)
    fs.deleteOnExit(folder)
    stored = spark.read.schema(cube.schema).parquet(path)
    return {name: stored.where(F.col("set") == name).select(*keys, *MEASURES) for name, keys in sets.items()}


def _mean_over_time(submitted: DataFrame, grain: str, total: str, n: str) -> DataFrame:
    rows = submitted.withColumn("period", M.period_column("Submit", grain)).where(F.col("period").isNotNull())
    return rows.groupBy("period").agg((F.sum(total) / F.nullif(F.sum(n), F.lit(0))).alias("value")).where(F.col("value").isNotNull())


def dashboard(jobs: DataFrame, grain: str = "month", color_by: str | None = None, persist: bool = False,
              charts: Sequence[str] | None = None, start=None, end=None, **filters) -> dict[str, DataFrame]:
    """One table per chart over the same filtered jobs; ``charts`` names those wanted.

    The jobs are read once, when this is called: they are reduced by all sets of keys that the wanted charts need, and charts are lazy queries on the
    result. Grouped timelines have every series at every period. ``total_hours`` are those of the range of days, or else of the data. Node usage
    is told by cluster. ``persist`` keeps the filtered jobs on the executors, for raw rows beside the charts; the caller releases them
    through ``result['jobs'].unpersist()``.
    """
    df = filter_jobs(jobs, start=start, end=end, **filters).select(*[c for c in CHART_COLUMNS if c in jobs.columns])
    if persist:
        df = df.persist(StorageLevel.MEMORY_AND_DISK)
    dense = {"dense": True} if color_by else {}
    by_cluster = "cluster" in df.columns

    def hours(t: DataFrame) -> DataFrame:
        given = range_hours(start, end) if start is not None and end is not None else None
        ends = t.agg(F.min("_first").alias("a"), F.max("_last").alias("b"))
        spread = ends.select(F.explode(F.array("a", "b")).alias("t")).agg(data_range_hours("t").alias("total_hours"))
        return spread if given is None else spread.select(given.alias("total_hours"))

    build = {
        "summary": ("submitted", M.summary),
        "total_hours": ("submitted", hours),
        "cpu_usage_over_time": ("started", lambda t: M.cpu_usage_over_time(t, grain, color_by, **dense)),
        "gpu_usage_over_time": ("started", lambda t: M.gpu_usage_over_time(t, grain, color_by, **dense)),
        "active_users_over_time": ("submitted", lambda t: M.active_users_over_time(t, grain, color_by, **dense)),
        "jobs_over_time": ("submitted", lambda t: M.jobs_over_time(t, grain, color_by, **dense)),
        "waiting_times_over_time": ("submitted", lambda t: _mean_over_time(t, grain, "_waited", "_waits")),
        "job_duration_over_time": ("submitted", lambda t: _mean_over_time(t, grain, "_ran", "_runs")),
        "jobs_by_partition": ("partition", lambda t: M.jobs_by(t, "Partition")),
        "jobs_by_state": ("state", lambda t: M.jobs_by(t, "State", None)),
        "waiting_times_hist": ("waiting", lambda t: H.value_histogram(t, "WaitingTimeHours")),
        "job_duration_hist": ("duration", lambda t: H.value_histogram(t, "ElapsedHours", positive=True)),
        "job_duration_stacked": ("duration", lambda t: H.job_duration_stacked(t, grain)),
        "waiting_times_stacked": ("waiting", lambda t: H.waiting_times_stacked(t, grain)),
        "waiting_times_trends": ("waiting", lambda t: H.trends(t, "WaitingTimeHours", grain)),
        "job_duration_trends": ("duration", lambda t: H.trends(t, "ElapsedHours", grain, positive=True)),
        "cpus_per_job": ("cpus", lambda t: M.resources_per_job(t, "CPUs", positive=False)),
        "gpus_per_job": ("gpus", lambda t: M.resources_per_job(t, "GPUs")),
        "nodes_per_job": ("nodes", lambda t: M.resources_per_job(t, "Nodes")),
        "node_usage": ("lists", lambda t: node_usage(t, color_by, by_cluster=by_cluster).withColumn("total_hours", hours(t).scalar())),
    }
    if color_by:
        build |= {
            "jobs_by_dimension": ("submitted", lambda t: M.by_dimension(t, color_by)),
            "cpu_hours_by_dimension": ("submitted", lambda t: M.by_dimension(t, color_by, "CPUHours")),
            "gpu_hours_by_dimension": ("submitted", lambda t: M.by_dimension(t, color_by, "GPUHours")),
            "jobs_distribution": ("submitted", lambda t: M.jobs_distribution(t, color_by)),
        }
    else:
        build |= {
            "jobs_per_user": ("submitted", H.jobs_per_user_histogram),
            "cpu_hours_per_period": ("started", lambda t: H.usage_histogram(t, "CPUHours", grain)),
            "gpu_hours_per_period": ("started", lambda t: H.usage_histogram(t, "GPUHours", grain)),
            "jobs_distribution": ("started", lambda t: H.jobs_histogram(t, grain)),
        }
    build["active_users_distribution"] = {
        "Account": ("submitted", M.users_per_account), "User": ("started", lambda t: M.periods_per_user(t, grain))}.get(
        color_by, ("started", lambda t: H.active_users_histogram(t, grain)))
    grouped = color_by in ("User", "Account", "Partition", "QOS")
    build["user_activity_frequency"] = ("submitted", lambda t: (
        M.activity_by_group(t, color_by, grain) if grouped else H.activity_histogram(t, grain)))

    wanted = {name: part for name, part in build.items() if charts is None or name in charts}
    sets = _key_sets(grain, color_by)
    if not by_cluster:
        sets["lists"].remove("cluster")
    needed = {part[0] for part in wanted.values()}
    tables = reduce_jobs(df, {name: keys for name, keys in sets.items() if name in needed}) if needed else {}
    return {"jobs": df} | {name: make(tables[of]) for name, (of, make) in wanted.items()}


def metadata(jobs: DataFrame, start=None, end=None) -> DataFrame:
    """Per cluster: dimension values of a range of days as sorted arrays, and the first and last day of all data."""
    return _metadata(filter_jobs(jobs, start=start, end=end), jobs)


def digest_metadata(spark: SparkSession, digests: str, start=None, end=None) -> DataFrame:
    """``metadata`` from the digests of a store; the range is one of whole months."""
    return _metadata(read_digest(spark, digests, "groups", start, end), read_digest(spark, digests, "groups"))


def _metadata(in_range: DataFrame, everything: DataFrame) -> DataFrame:
    values = dimension_values(in_range, by=["cluster"])
    return values.join(date_range(everything), "cluster", "right").select("cluster", "min_date", "max_date", "dimension", "value")


def filter_rows(jobs: DataFrame, columns: Sequence[str] | None = None, **filters) -> tuple[DataFrame, DataFrame]:
    """Filtered jobs and their summary."""
    df = filter_jobs(jobs, **filters)
    return (df.select(*columns) if columns else df), M.summary(df)
