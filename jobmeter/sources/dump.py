"""Pipe-separated accounting dumps, with one line per job and per job step."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .records import arrival, conform, parse_time, with_job_periods, with_node_array
from ..functions import nodes as N
from ..functions.text import clean_text, is_present, job_state, parse_tres
from ..functions.time import elapsed_to_hours, hours_between, resource_hours
from ..operators.cleaning import LINE_ORDER, fill_forward
from ..schema import DUMP, DUMP_FIELDS, STEP_METRICS

NON_FINAL = ["RUNNING", "Unknown", "PENDING"]


def read_dump(spark: SparkSession, path: str) -> DataFrame:
    """Dump lines as text columns, with the file, the split and the line's place in the split."""
    lines = (spark.read.schema(DUMP).option("sep", "|").option("header", "true").option("quote", "")
             .option("encoding", "ISO-8859-1").csv(path))
    return lines.select(*DUMP_FIELDS, arrival()).select(
        "*", F.col("arrival.file").alias("_file"), F.col("arrival.split").alias("_split"), F.col("arrival.place").alias("_line"))


def drop_non_final(df: DataFrame, whole_line: bool = False) -> DataFrame:
    """Leave out jobs that have not ended; ``whole_line`` looks for RUNNING or Unknown in any field instead."""
    if whole_line:
        line = F.concat_ws("|", *[F.col(c) for c in DUMP_FIELDS if c in df.columns])
        return df.where(~line.rlike("RUNNING|Unknown"))
    return df.where(F.col("State").isNull() | ~F.col("State").isin(NON_FINAL))


def drop_steps(df: DataFrame) -> DataFrame:
    return df.where(~F.col("JobID").contains("."))


def drop_malformed(df: DataFrame) -> DataFrame:
    """Leave out rows without a user or a partition."""
    return df.where(is_present("User") & is_present("Partition"))


def fill_from_steps(lines: DataFrame) -> DataFrame:
    """Job lines, with blank step metrics filled from the first of the job's own steps that has them."""
    order = F.struct(*LINE_ORDER)
    steps = lines.where(F.col("JobID").contains(".")).withColumn("_job", F.substring_index("JobID", ".", 1))
    firsts = steps.groupBy(F.col("_file").alias("_step_file"), "_job").agg(*[
        F.min_by(m, F.when(F.col(m).isNotNull(), order)).alias(f"_step_{m}") for m in STEP_METRICS])
    joined = drop_steps(lines).join(
        firsts, (F.col("JobID") == F.col("_job")) & (F.col("_file") == F.col("_step_file")), "left")
    return joined.withColumns({m: F.coalesce(m, f"_step_{m}") for m in STEP_METRICS}).select(*lines.columns)


def normalize_dump(df: DataFrame, fill: str | None = "steps", start=None, end=None) -> DataFrame:
    """Dump lines as canonical jobs.

    ``fill`` is 'steps' (each job from its own steps), 'file' (last value above it in the file) or None. ``start`` and
    ``end`` keep jobs submitted in that range of days.
    """
    lines = drop_non_final(df)
    if fill == "steps":
        lines = fill_from_steps(lines)
    elif fill == "file":
        lines = fill_forward(lines, DUMP_FIELDS)
    jobs = drop_malformed(drop_steps(lines))
    jobs = jobs.withColumns({c: parse_time(c, strict=False) for c in ("Submit", "Start", "End")})
    jobs = jobs.where(F.col("Submit").isNotNull())
    if start is not None:
        jobs = jobs.where(F.col("Submit") >= F.lit(str(start)).cast("date"))
    if end is not None:
        jobs = jobs.where(F.col("Submit") < F.date_add(F.lit(str(end)).cast("date"), 1))
    tres = parse_tres("AllocTRES")
    jobs = jobs.withColumns({
        "User": clean_text("User"), "Account": clean_text("Account"), "Partition": clean_text("Partition"),
        "QOS": clean_text("QOS", None), "State": job_state("State"),
        "CPUs": tres["cpus"], "GPUs": tres["gpus"],
        "Nodes": F.greatest(tres["nodes"], N.node_pieces("NodeList")),
        "WaitingTimeHours": hours_between("Submit", "Start"),
        "ElapsedHours": elapsed_to_hours("Elapsed"),
        "cluster": clean_text("Cluster"),
    })
    jobs = jobs.withColumns({
        "CPUHours": resource_hours("ElapsedHours", "CPUs"), "GPUHours": resource_hours("ElapsedHours", "GPUs")})
    return conform(with_job_periods(with_node_array(jobs)))


def with_chunks(jobs: DataFrame, start, days: int = 7) -> DataFrame:
    """Number (from 0) of the ``days``-long chunk, counted from ``start``, in which a job was submitted."""
    offset = F.datediff(F.col("Submit"), F.lit(str(start)).cast("date"))
    return jobs.withColumn("chunk", F.floor(offset / days).cast("int"))


def batch_summary(jobs: DataFrame, start, days: int = 7) -> DataFrame:
    """Jobs and resource-hours per submit chunk, with a total row whose chunk is null."""
    return with_chunks(jobs, start, days).rollup("chunk").agg(
        F.count(F.lit(1)).alias("jobs"), F.sum("CPUHours").alias("cpu_hours"), F.sum("GPUHours").alias("gpu_hours"))
