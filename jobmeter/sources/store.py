"""The job store: Parquet partitioned by cluster and submit year, kept free of duplicates."""

from __future__ import annotations

import datetime as dt
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.cleaning import keep_last
from ..operators.filters import submit_between
from ..schema import JOBS
from ..session import file_system, small_splits, staged
from .digests import LARGE, PER_TASK, SPREAD, bucket_of, changed_buckets, write_digests

STORE_KEYS = ["cluster", "SubmitYear", "SubmitMonth"]
ROW_KEYS = ["cluster", "SubmitYear", "JobID"]
_NO_VALUE = "__HIVE_DEFAULT_PARTITION__"  # how Spark names the folder of a null


def read_store(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(JOBS).parquet(path)


def drop_partitions(spark: SparkSession, path: str, partitions) -> None:
    """Delete the folders of the given (cluster, year, month) partitions."""
    escape = spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName
    for values in partitions:
        named = "/".join(f"{k}={_NO_VALUE if v is None else escape(str(v))}" for k, v in zip(STORE_KEYS, values))
        fs, folder = file_system(spark, f"{path}/{named}")
        fs.delete(folder, True)


def write_store(jobs: DataFrame, path: str, gathered: bool = False) -> None:
    """Replace the partitions that ``jobs`` has rows for; only the columns of the store are written.

    Rebalancing gathers each month into files of the advisory size and splits months that are too large for one task. ``gathered`` jobs, which
    already come month by month, as those read from a store do, are written where they are. Jobs of a user stand together, which packs better.
    """
    jobs = jobs.drop("arrival")
    if not gathered:
        jobs = jobs.hint("rebalance", *[F.col(k) for k in STORE_KEYS])
    with small_splits(jobs.sparkSession):
        (jobs.sortWithinPartitions(*STORE_KEYS, "Account", "User", "Submit")
         .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "zstd")
         .partitionBy(*STORE_KEYS).parquet(path))


def _partitions(df: DataFrame) -> set[tuple]:
    """Partition values present in ``df``: metadata of at most clusters x months rows."""
    return {tuple(r) for r in df.select(*STORE_KEYS).distinct().collect()}


def _within(partitions: set[tuple], depth: int) -> Column:
    """Predicate on the first ``depth`` partition columns, which prunes folders at planning time."""
    key = F.concat_ws("/", *[F.coalesce(F.col(k).cast("string"), F.lit(_NO_VALUE)) for k in STORE_KEYS[:depth]])
    return key.isin(sorted({"/".join(_NO_VALUE if v is None else str(v) for v in p[:depth]) for p in partitions}))


def _same(left: DataFrame, right: DataFrame) -> Column:
    """Equal row keys; nulls are equal to each other."""
    condition = F.lit(True)
    for k in ROW_KEYS:
        condition = condition & left[k].eqNullSafe(right[k])
    return condition


def _without(stored: DataFrame, gone: DataFrame, newer: DataFrame) -> DataFrame:
    """``stored`` without the jobs of ``gone``, and ``newer``, gathered by month.

    Whole jobs are shuffled once, which both drops the old ones and suits the folders. Months of more than LARGE jobs are dealt to several tasks, by job.
    """
    marked = reduce(DataFrame.unionAll, [
        df.withColumn("_mark", F.lit(mark)) for df, mark in (
            (stored, "stored"), (newer.select(*stored.columns), "new"),
            (gone.select(*[F.col(c) if c in ROW_KEYS + STORE_KEYS else F.lit(None).cast(stored.schema[c].dataType).alias(c) for c in stored.columns]), "gone"))])
    # Metadata of at most clusters x months rows.
    counts = [tuple(r) for r in stored.select(*STORE_KEYS).unionAll(newer.select(*STORE_KEYS)).groupBy(*STORE_KEYS).count().collect()]
    part = F.lit(0)
    for *values, n in counts:
        if n > LARGE:
            month = reduce(and_, [F.col(k).eqNullSafe(F.lit(v)) for k, v in zip(STORE_KEYS, values)])
            part = F.when(month, F.pmod(F.xxhash64("JobID"), F.lit(-(-n // LARGE))).cast("int")).otherwise(part)
    tasks = max(1, -(-sum(n for *_, n in counts) * SPREAD // PER_TASK))
    keys = [*STORE_KEYS, "_part"]
    old = F.max(F.col("_mark") == "gone").over(Window.partitionBy(*keys, "JobID"))
    return (marked.withColumn("_part", part).repartition(tasks, *keys).withColumn("_old", old)
            .where((F.col("_mark") == "new") | ((F.col("_mark") == "stored") & ~F.col("_old"))).select(*stored.columns))


def upsert_jobs(new: DataFrame, path: str, digests: str | None = None) -> DataFrame:
    """Merge canonical jobs into the store; a job's record in the batch replaces those stored for its cluster and year.

    A stored record stays only where both name their order and its ``ingest_seq`` is higher: a late load of older records. Within
    the batch the highest ``ingest_seq`` counts, then the last ``arrival``, which the readers add. Stored rows are not sorted or grouped again.
    Months that hold neither a new job nor an older record of one are not touched. The merged rows go to the shared folder first, because a
    partition cannot be overwritten by a plan that reads it. Returns the months rewritten. The digests kept at ``digests`` follow; should the run end in between, the
    same batch sets both right.
    """
    spark = new.sparkSession
    given = new.select(*JOBS.fieldNames(), *[c for c in ("arrival",) if c in new.columns])
    last = keep_last(given, ROW_KEYS).drop("arrival")
    fs, folder = file_system(spark, path)
    if not fs.exists(folder):  # nothing to merge with, so nothing to stage
        write_store(last, path)
        if digests:
            build_digests(spark, path, digests)
        return read_store(spark, path)
    with small_splits(spark), staged(last, "batch") as batch:
        touched = _partitions(batch)
        merged = batch
        if touched:
            store = read_store(spark, path)
            # A narrow scan of the years finds the months in which earlier records of the new jobs lie.
            earlier = store.where(_within(touched, 2)).select("JobID", "ingest_seq", *STORE_KEYS)
            touched |= _partitions(earlier.join(batch, _same(earlier, batch), "left_semi"))
            earlier, stored = earlier.where(_within(touched, 3)), store.where(_within(touched, 3))
            newer = batch.join(earlier, _same(batch, earlier) & (earlier["ingest_seq"] > batch["ingest_seq"]), "left_anti")
            merged = _without(stored, earlier.join(newer, _same(earlier, newer), "left_semi"), newer)
        with staged(merged, "merged") as result:
            write_store(result, path, gathered=True)
            emptied = touched - _partitions(result)
            drop_partitions(spark, path, emptied)
            if digests:
                write_digests(read_store(spark, path).where(_within(touched, 3)), digests)  # in the order of the store, which packs better than that of the copy
                drop_partitions(spark, digests, emptied)
    return read_store(spark, path).where(_within(touched, 3))


def build_digests(spark: SparkSession, path: str, digests: str) -> None:
    """Digests of everything in the store, for one that has had none; upserts keep them from then on."""
    write_digests(read_store(spark, path), digests)


def compact(spark: SparkSession, source: DataFrame, path: str) -> DataFrame:
    """Merge many small loads into the store, one partition per cluster and year of Submit."""
    return upsert_jobs(source, path)


def file_years(jobs: DataFrame, file: str = "_file") -> DataFrame:
    """Year of a file: the most frequent year of Submit in it, the earliest on a tie."""
    counts = jobs.where(F.col("Submit").isNotNull()).groupBy(file, F.year("Submit").alias("year")) \
        .agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy(file).agg(F.max_by("year", F.struct("n", -F.col("year"))).alias("year"))


def write_weekly(jobs: DataFrame, path: str) -> None:
    """One partition per cluster, ISO year and week of Submit, replaced as a whole; each is gathered into files of the advisory size.

    Jobs without column ``cluster`` are taken as those of one cluster, whose folder ``path`` is.
    """
    ts = F.col("Submit")
    weekly = jobs.withColumns({"iso_year": F.extract(F.lit("YEAROFWEEK"), ts).cast("int"), "iso_week": F.weekofyear(ts)})
    keys = [k for k in ("cluster", "iso_year", "iso_week") if k in weekly.columns]
    weekly.hint("rebalance", *[F.col(k) for k in keys]).write.mode("overwrite").option("partitionOverwriteMode", "dynamic") \
        .partitionBy(*keys).parquet(path)


def retention_cutoff(keep_months: int, as_of: dt.date | str) -> Column:
    return F.date_sub(F.lit(str(as_of)).cast("date"), keep_months * 30)


def retention_plan(jobs: DataFrame, keep_months: int, as_of) -> DataFrame:
    """What a clean-up would drop: rows and CPU-hours by cluster and submit week."""
    last = dt.date.fromisoformat(str(as_of)) - dt.timedelta(days=keep_months * 30 + 1)
    old = submit_between(jobs, end=last)
    return old.groupBy("cluster", "SubmitYear", "SubmitWeek").agg(
        F.count(F.lit(1)).alias("jobs"), F.sum("CPUHours").alias("cpu_hours"))


def apply_retention(spark: SparkSession, path: str, keep_months: int, as_of, digests: str | None = None) -> DataFrame:
    """Drop old jobs from the store, and from its digests: months before the cutoff go as folders, the cutoff month is rewritten."""
    cutoff = dt.date.fromisoformat(str(as_of)) - dt.timedelta(days=keep_months * 30)
    first = cutoff.replace(day=1)
    store = read_store(spark, path)
    old = _partitions(store.where(F.col("SubmitMonth") <= F.lit(first)))
    edge = store.where((F.col("SubmitMonth") == F.lit(first)) & (F.col("Submit") >= F.lit(cutoff)))
    with staged(edge, "retained") as kept:
        write_store(kept, path)
        gone = old - _partitions(kept)
        drop_partitions(spark, path, gone)
        if digests:
            write_digests(kept, digests)
            drop_partitions(spark, digests, gone)
    return read_store(spark, path)


def diff_loads(old: DataFrame, new: DataFrame, keys=("cluster", "JobID")) -> DataFrame:
    """Jobs that are new, deleted or modified between two loads; each load holds one row per key.

    Only the key and a hash of the other columns are shuffled.
    """
    keys = list(keys)
    payload = [c for c in sorted(old.columns) if c not in keys and c in new.columns]
    short = lambda df, name: df.select(*keys, F.xxhash64(*payload).alias(name))
    both = short(old, "_old").join(short(new, "_new"), keys, "full_outer")
    change = (F.when(F.col("_old").isNull(), "new").when(F.col("_new").isNull(), "deleted")
              .when(F.col("_old") != F.col("_new"), "modified"))
    return both.select(*keys, change.alias("change")).where(F.col("change").isNotNull())


def diff_stores(spark: SparkSession, old: str, old_digests: str, new: str, new_digests: str) -> DataFrame:
    """``diff_loads`` of two stores that have digests, reading only what differs.

    Hashes of months and their buckets are compared first; jobs are read of the months that differ, and of those only the buckets that differ
    are compared. A job that moved to another month is in a bucket that differs in both.
    """
    buckets = changed_buckets(spark, old_digests, new_digests)
    with staged(buckets, "changed") as found:
        months = _partitions(found)

    def rows(path: str) -> DataFrame:
        table = read_store(spark, path)
        if not months:
            return table.limit(0)
        # Buckets of a month are few, and so are all that differ unless the stores have little in common; then Spark doesn't broadcast them.
        keys = [*STORE_KEYS, "bucket"]
        there = buckets.select(*[F.col(k).alias(f"_{k}") for k in keys])
        table, same = table.where(_within(months, 3)).withColumn("bucket", bucket_of()), F.lit(True)
        for k in keys:
            same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
        return table.join(there, same, "left_semi").drop("bucket")

    return diff_loads(rows(old), rows(new))


def missing_weeks(jobs: DataFrame, start, end) -> DataFrame:
    """Mondays of the weeks from ``start`` to ``end`` for which no job is stored, week 53 included.

    Each bound is a day or an ISO (year, week).
    """
    start, end = [dt.date.fromisocalendar(*b, 1) if isinstance(b, tuple) else b for b in (start, end)]
    spark = jobs.sparkSession
    day = lambda d: F.date_trunc("week", F.lit(str(d)).cast("date")).cast("date")
    weeks = spark.range(1).select(F.explode(F.sequence(day(start), day(end), F.expr("interval 7 days"))).alias("week"))
    monday = lambda d: d - dt.timedelta(days=d.weekday())
    first, last = [monday(dt.date.fromisoformat(str(b))) for b in (start, end)]
    jobs = submit_between(jobs, first, last + dt.timedelta(days=6))
    stored = jobs.select(F.date_trunc("week", "Submit").cast("date").alias("week")).distinct()
    return weeks.join(stored, "week", "left_anti").select(
        "week", F.extract(F.lit("YEAROFWEEK"), F.col("week")).cast("int").alias("iso_year"),
        F.weekofyear("week").alias("iso_week"))


def recent_weeks(jobs: DataFrame, as_of, weeks: int = 4) -> DataFrame:
    """``missing_weeks`` over the last ``weeks`` weeks before the one holding ``as_of``."""
    monday = dt.date.fromisoformat(str(as_of))
    monday -= dt.timedelta(days=monday.weekday())
    return missing_weeks(jobs, monday - dt.timedelta(weeks=weeks), monday - dt.timedelta(days=1))


def submission_stats(audit: DataFrame) -> DataFrame:
    """Last submission and jobs submitted so far per cluster, from (cluster, ingest_ts, n_jobs) rows."""
    return audit.groupBy("cluster").agg(
        F.max("ingest_ts").alias("last_submission"), F.sum("n_jobs").alias("total_jobs"))
