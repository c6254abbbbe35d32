"""Job records uploaded as JSON, and the steps shared by all ways into the canonical table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import nodes as N
from ..functions.text import as_column
from ..functions.time import hours_between, period_start, resource_hours
from ..schema import JOBS, RECORD

REQUIRED = ("JobID", "User", "Account", "Partition", "State", "Submit")
RESOURCE_NAMES = {"AllocNodes": "Nodes", "AllocCPUS": "CPUs", "AllocGPUS": "GPUs"}


def parse_time(text: Column | str, strict: bool = True) -> Column:
    """ISO time text as timestamp; unreadable text is an error, or null when not ``strict``."""
    text = as_column(text)
    return text.cast("timestamp") if strict else text.try_cast("timestamp")


def arrival(place: Column | None = None) -> Column:
    """The place of a row in the order of arrival, for rows that come straight from a file reader.

    Readers cut files into splits and deliver the rows of a split in the order in which they stand; ``place`` is their number, counted here unless given. Streams
    can't count, so theirs is null where the format has none, and is counted where a batch is taken in.
    """
    place = F.monotonically_increasing_id() if place is None else place
    return F.struct(
        F.col("_metadata.file_modification_time").alias("time"), F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").cast("long").alias("split"), place.cast("long").alias("place")).alias("arrival")


def _parsed(spark: SparkSession, path: str) -> DataFrame:
    """Every line as a record, with ``_line`` where it is no JSON object, and ``reason`` where it can't be taken."""
    schema = T.StructType([*RECORD.fields, T.StructField("_line", T.StringType())])
    lines = spark.read.schema(schema).option("columnNameOfCorruptRecord", "_line").json(path).select("*", arrival())
    reason = F.when(F.col("_line").isNotNull(), F.lit("broken line"))
    for name in REQUIRED:
        reason = reason.when(F.col(name).isNull(), F.lit(f"no {name}"))
    return lines.withColumn("reason", reason)


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """Uploaded records, one JSON object per line; absent hours and counts become 0.

    Broken lines and records without a required field are left out; ``rejected_records`` lists them. Column ``arrival`` tells which of several
    records of a job came last.
    """
    return _parsed(spark, path).where(F.col("reason").isNull()).drop("_line", "reason").fillna(
        {"CPUHours": 0.0, "GPUHours": 0.0, "AllocCPUS": 0, "AllocGPUS": 0, "AllocNodes": 0})


def rejected_records(spark: SparkSession, path: str) -> DataFrame:
    """Lines that ``read_records`` leaves out: what could be read of them, the text of broken lines (``_line``), and why."""
    return _parsed(spark, path).where(F.col("reason").isNotNull())


def with_resource_names(df: DataFrame) -> DataFrame:
    """Rename AllocNodes, AllocCPUS and AllocGPUS unless the short name is there already."""
    return df.withColumnsRenamed(
        {old: new for old, new in RESOURCE_NAMES.items() if old in df.columns and new not in df.columns})


def with_hours(df: DataFrame) -> DataFrame:
    """Waiting and elapsed hours where absent, then resource-hours where absent."""
    have = set(df.columns)
    if "WaitingTimeHours" not in have:
        df = df.withColumn("WaitingTimeHours", hours_between("Submit", "Start"))
    if "ElapsedHours" not in have:
        df = df.withColumn("ElapsedHours", hours_between("Start", "End"))
    if "CPUHours" not in have:
        df = df.withColumn("CPUHours", resource_hours("ElapsedHours", "CPUs"))
    if "GPUHours" not in have:
        df = df.withColumn("GPUHours", resource_hours("ElapsedHours", "GPUs"))
    return df


def with_job_periods(df: DataFrame) -> DataFrame:
    """Day, week, month (period starts) and year of Submit and Start."""
    new = {}
    for base in ("Submit", "Start"):
        ts = F.col(base)
        new[f"{base}Day"] = ts.cast("date")
        new[f"{base}Week"] = period_start(ts, "week")
        new[f"{base}Month"] = period_start(ts, "month")
        new[f"{base}Year"] = F.year(ts)
    return df.withColumns(new)


def with_node_array(df: DataFrame) -> DataFrame:
    """NodeList as an array of names, whether it was stored as text or as an array."""
    kind = df.schema["NodeList"].dataType
    if isinstance(kind, T.ArrayType):
        return df.withColumn("NodeList", F.coalesce("NodeList", F.array().cast("array<string>")))
    return df.withColumn("NodeList", N.expand_nodelist("NodeList"))


def conform(df: DataFrame) -> DataFrame:
    """Project to the canonical columns; absent ones become null. The order of ``arrival`` is carried along where there is one."""
    have = set(df.columns)
    extra = [F.col("arrival")] if "arrival" in have else []
    return df.select([
        (F.col(f"`{f.name}`") if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in JOBS] + extra)


def normalize_records(df: DataFrame, cluster: str | Column | None = None) -> DataFrame:
    """Uploaded records as canonical jobs."""
    if cluster is not None:
        df = df.withColumn("cluster", F.lit(cluster) if isinstance(cluster, str) else cluster)
    times = {c: parse_time(c) for c in ("Submit", "Start", "End")}
    df = with_resource_names(df.withColumns(times))
    return conform(with_node_array(with_job_periods(with_hours(df))))
