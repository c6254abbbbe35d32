"""Stored Parquet history in any of its three column dialects."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
import pyarrow.fs  # noqa: F401
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import file_system, keep_versions
from .records import conform, with_hours, with_job_periods, with_node_array, with_resource_names

# Column names of older files and the canonical name each stands for.
OLD_NAMES = {
    "CPU-hours": "CPUHours", "GPU-hours": "GPUHours", "WaitingTime [h]": "WaitingTimeHours",
    "WaitingTime": "WaitingTimeHours", "Elapsed [h]": "ElapsedHours",
}
DATA_FOLDERS = ("data", "weekly-data")  # the first one that has files is used
CATALOGUE = "file string, size long, time long, columns map<string,string>"  # time in milliseconds


def list_clusters(spark: SparkSession, root: str) -> list[str]:
    """Names of the sub-directories of ``root``; each one is a cluster."""
    fs, path = file_system(spark, root)
    return sorted(s.getPath().getName() for s in fs.listStatus(path) if s.isDirectory())


def history_files(spark: SparkSession, root: str, clusters: list[str] | None = None) -> list[str]:
    """Parquet files of the clusters, from ``data/`` or else from ``weekly-data/``."""
    found = []
    for cluster in clusters if clusters is not None else list_clusters(spark, root):
        for folder in DATA_FOLDERS:
            fs, pattern = file_system(spark, f"{root}/{cluster}/{folder}/*.parquet")
            files = sorted(s.getPath().toString() for s in fs.globStatus(pattern) or [])
            if files:
                found += files
                break
    return found


def _status(spark: SparkSession, paths: list[str]) -> DataFrame:
    """``file, size, time`` of files, from one listing of each folder."""
    wanted, rows = set(paths), []
    for folder in sorted({p.rpartition("/")[0] for p in paths}):
        fs, path = file_system(spark, folder)
        for s in fs.listStatus(path):
            if (name := s.getPath().toString()) in wanted:
                rows.append((name, s.getLen(), s.getModificationTime()))
    return spark.createDataFrame(rows, "file string, size long, time long")


def _footers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The type of each column of the files, told by the Parquet types below it; only footers are read."""
    for batch in batches:
        found = []
        for file in batch.column(0).to_pylist():
            store, path = pa.fs.FileSystem.from_uri(re.sub("^s3[an]:", "s3:", re.sub("^file:/+", "file:///", file)))
            with store.open_input_file(path) as stream:
                schema = pq.ParquetFile(stream).schema
            types: dict[str, list[str]] = {}
            for leaf in (schema.column(k) for k in range(len(schema))):
                types.setdefault(leaf.path.split(".")[0], []).append(f"{leaf.path} {leaf.physical_type} {leaf.logical_type}")
            found.append(sorted((name, ", ".join(sorted(t))) for name, t in types.items()))
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.map_(pa.string(), pa.string()))], [*batch.schema.names, "columns"])


def file_catalogue(spark: SparkSession, paths: list[str], at: str | None = None) -> DataFrame:
    """``file, size, time, columns`` of Parquet files, ``columns`` giving the type of each; footers are read in one parallel job.

    With a folder ``at`` the catalogue is kept there for any number of scans, and only footers of files that are new or have another size or
    time are read. What a failed run left out is read again.
    """
    files = _status(spark, paths)
    if not at:
        return _with_types(files, len(paths))
    versions = keep_versions(spark, at, "v")
    kept = spark.read.schema(CATALOGUE).parquet(f"{at}/v{versions[-1]}") if versions else spark.createDataFrame([], CATALOGUE)
    fresh = files.join(kept, ["file", "size", "time"], "left_anti")
    if not fresh.isEmpty():
        number = versions[-1] + 1 if versions else 0
        kept.join(fresh, "file", "left_anti").unionByName(_with_types(fresh, len(paths))).write.parquet(f"{at}/v{number}")
        kept = spark.read.schema(CATALOGUE).parquet(f"{at}/v{number}")
    return kept.join(files, ["file", "size", "time"], "left_semi")


def _with_types(files: DataFrame, n: int) -> DataFrame:
    tasks = max(1, min(n // 8, 4 * files.sparkSession.sparkContext.defaultParallelism))
    return files.repartition(tasks).mapInArrow(_footers, CATALOGUE)


def schema_groups(spark: SparkSession, paths: list[str], catalogue: str | None = None) -> list[list[str]]:
    """Split files into groups whose column types agree; the number of jobs doesn't grow with the files or how their types alternate.

    ``catalogue`` is the folder of a kept ``file_catalogue``.
    """
    found = file_catalogue(spark, paths, catalogue)
    # Maps can't be grouped; their entries in order can. A row per combination of types, not per file, is compared here.
    entries = F.array_sort(F.map_entries("columns")).alias("types")
    kinds = found.groupBy(entries).agg(F.array_sort(F.collect_list("file")).alias("files")).collect()
    groups: list[tuple[dict[str, str], list[str]]] = []
    for types, members in sorted((sorted((e["key"], e["value"]) for e in r["types"]), r["files"]) for r in kinds):
        for known, placed in groups:
            if all(known.get(name, kind) == kind for name, kind in types):
                known.update(types)
                placed.extend(members)
                break
        else:
            groups.append((dict(types), list(members)))
    return [sorted(members) for _, members in groups]


def _with_cluster(df: DataFrame) -> DataFrame:
    folder = "|".join(DATA_FOLDERS)
    name = F.regexp_extract(F.col("_metadata.file_path"), f"/([^/]+)/(?:{folder})/[^/]+$", 1)
    return df.select("*", name.alias("cluster"))


def scan_history(spark: SparkSession, root: str, clusters: list[str] | None = None, catalogue: str | None = None) -> DataFrame:
    """All stored history as canonical jobs; files may differ in columns and in column types.

    ``catalogue`` names a folder in which the types of known files are kept, so that a later scan reads footers of new files only.
    """
    paths = history_files(spark, root, clusters)
    if not paths:
        raise FileNotFoundError(f"no Parquet files below {root}")
    named, unnamed = [], []
    for group in schema_groups(spark, paths, catalogue):
        part = _with_cluster(spark.read.option("mergeSchema", "true").parquet(*group))
        (named if "JobID" in part.columns else unnamed).append(_canonical(part))
    # Equal rows are numbered across files, so that ids don't depend on how rows are dealt to files.
    union = lambda parts: reduce(DataFrame.unionByName, parts)
    return union(named + ([with_made_ids(union(unnamed))] if unnamed else []))


def with_made_ids(jobs: DataFrame) -> DataFrame:
    """``JobID`` made from a job's values and, as tasks of an array may be equal, its number among equal jobs.

    The files that hold the rows and their order make no difference. Without use of the id nothing is shuffled.
    """
    values = [c for c in jobs.columns if c not in ("JobID", "ingest_seq", "arrival")]
    jobs = jobs.withColumn("_values", F.xxhash64(*[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in values]))
    number = F.row_number().over(Window.partitionBy("_values").orderBy("_values"))
    return jobs.withColumn("JobID", F.concat(F.lit("h"), F.hex(F.xxhash64("_values", number)))).drop("_values")


def merge_old_names(df: DataFrame) -> DataFrame:
    """Fold old column names into the canonical ones, preferring the canonical value."""
    present = {}
    for old, new in OLD_NAMES.items():
        if old in df.columns:
            present.setdefault(new, []).append(old)
    for new, olds in present.items():
        sources = ([new] if new in df.columns else []) + olds
        df = df.withColumn(new, F.coalesce(*[F.col(f"`{c}`").cast("double") for c in sources])).drop(*olds)
    return df


def _canonical(df: DataFrame) -> DataFrame:
    """One file dialect as canonical jobs; ``JobID`` stays null where the files have none."""
    df = with_resource_names(merge_old_names(df))
    df = df.withColumns({c: F.col(c).cast("timestamp") for c in ("Submit", "Start", "End") if c in df.columns})
    if "End" not in df.columns:
        df = df.withColumn("End", F.lit(None).cast("timestamp"))
    if "NodeList" in df.columns:
        df = with_node_array(df)
    return conform(with_job_periods(with_hours(df)))


def normalize_history(df: DataFrame) -> DataFrame:
    """One file dialect as canonical jobs; those without JobID get one made from their values."""
    return _canonical(df) if "JobID" in df.columns else with_made_ids(_canonical(df))
