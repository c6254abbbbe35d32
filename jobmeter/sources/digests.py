"""Digests beside the store: each month's jobs reduced to what reports, percentiles, distinct counts and listings need.

A digest is kept per cluster and submit month and replaced whenever the store rewrites that month. Digests of months add up: value counts give exact
percentiles of any number of months, (day, user) rows exact distinct users of any days, and so on. Its rows are reduced jobs, which the operators on
jobs take as they are, so answers over whole months read no job files.
"""

from __future__ import annotations

import calendar
import datetime as dt
from collections.abc import Iterable, Sequence
from functools import reduce
from operator import and_

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.weights import WEIGHT
from ..operators.filters import submit_between
from ..operators.reduce import MEASURES, reduce_by
from ..schema import JOBS
from ..session import small_splits

MONTH_KEYS = ["cluster", "SubmitYear", "SubmitMonth"]
#: The sets of keys by which a month is reduced, beside the month itself.
SETS = {
    "groups": ["StartMonth", "StartYear", "Partition", "Account", "User", "QOS", "State"],
    "days": ["SubmitDay", "SubmitWeek", "Account", "User"],
    "waiting": ["StartMonth", "StartYear", "WaitingTimeHours"],
    "duration": ["StartMonth", "StartYear", "ElapsedHours"],
    "lists": ["NodeList"],
    "rows": ["bucket"],
}
#: Buckets of a month, by a hash of (cluster, JobID); each has the combined hash of its rows, so two stores can be told apart without their jobs.
BUCKETS = 256
#: Jobs of a month beyond which it is not reduced in one task, and jobs that a task reduces.
LARGE = 500_000
PER_TASK = 100_000
#: Hash partitions for the jobs of one task, so that few months fall into the same one by chance: a month of many jobs is to be alone.
SPREAD = 8
#: Columns of a job that its reduction by sets takes; a bucket and a hash are made from all.
_NEEDED = list(dict.fromkeys([*MONTH_KEYS, *[k for name, keys in SETS.items() if name != "rows" for k in keys],
                              "Submit", "WaitingTimeHours", "ElapsedHours", "CPUHours", "GPUHours"]))
_KEYS = list(dict.fromkeys(k for keys in SETS.values() for k in keys))
_OWN = {"bucket": T.StructField("bucket", T.IntegerType())}
_MEASURE_TYPES = {WEIGHT: T.LongType(), "_waits": T.LongType(), "_runs": T.LongType(), "_first": T.TimestampType(), "_last": T.TimestampType()}
SCHEMA = T.StructType(
    [_OWN[k] if k in _OWN else JOBS[k] for k in _KEYS] + [T.StructField(m, _MEASURE_TYPES.get(m, T.DoubleType())) for m in MEASURES]
    + [T.StructField("_hash", T.LongType()), T.StructField("set", T.StringType())] + [JOBS[k] for k in MONTH_KEYS])


def write_digests(months: DataFrame, path: str) -> None:
    """Replace the digests of the months in ``months``, which must hold all jobs of those months.

    Folders are those of the store. In the files rows stand by set, so a reader of one set skips the row groups of others.
    """
    with small_splits(months.sparkSession):
        _write_digests(months, path)


def _write_digests(months: DataFrame, path: str) -> None:
    payload = [c for c in sorted(months.columns) if c not in ("cluster", "JobID")]
    hashed = months.withColumns({"bucket": bucket_of(), "_row": F.xxhash64("cluster", "JobID", *payload)})
    extra = [F.bit_xor("_row").alias("_hash")]
    # Metadata of at most clusters x months rows.
    counts = [tuple(r) for r in months.groupBy(*MONTH_KEYS).count().collect()]
    large, some = F.lit(False), False
    for *values, n in counts:
        if n > LARGE:
            some, large = True, large | reduce(and_, [F.col(k).eqNullSafe(F.lit(v)) for k, v in zip(MONTH_KEYS, values)])
    # Months of usual size are gathered once, and kept on local disks while each set in turn is reduced from its own columns: a task that made the rows of
    # all sets at once would hold several wide rows for each job. Buckets are few, so they are reduced before they are shuffled and need no hash of each job there.
    tasks = max(1, -(-sum(n for *_, n in counts if n <= LARGE) * SPREAD // PER_TASK))
    usual = lambda df: df.where(~large) if some else df
    gathered = usual(months).select(*_NEEDED).repartition(tasks, *MONTH_KEYS).persist(StorageLevel.DISK_ONLY)
    try:
        sets = [reduce_by(gathered, {name: keys}, MONTH_KEYS, gathered=True) for name, keys in SETS.items() if name != "rows"]
        sets.append(reduce_by(usual(hashed), {"rows": SETS["rows"]}, MONTH_KEYS, extra).repartition(tasks, *MONTH_KEYS))
        _write(_together(sets), path)
    finally:
        gathered.unpersist()
    if some:  # A large month is reduced by all tasks, again by one set after the other.
        sets = [reduce_by(hashed.where(large), {name: keys}, MONTH_KEYS, extra if name == "rows" else ()) for name, keys in SETS.items()]
        _write(_together(sets).hint("rebalance", *[F.col(k) for k in MONTH_KEYS]), path)


def _together(sets: Iterable[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), sets)


def _same_as() -> dict[str, Column]:
    """What a measure is in most rows, which then leave it out: those of one job."""
    waited, ran = F.col("WaitingTimeHours"), F.col("ElapsedHours")
    return {"_last": F.col("_first"), "_waited": F.when(F.col("set") == "waiting", waited), "_ran": F.when((F.col("set") == "duration") & (ran > 0), ran)}


def _write(reduced: DataFrame, path: str) -> None:
    short = {m: F.when(~F.col(m).eqNullSafe(c), F.col(m)) for m, c in _same_as().items()}
    short["_hash"] = F.when(F.col("set") == "rows", F.col("_hash"))
    (reduced.withColumns(short).select(*SCHEMA.fieldNames()).sortWithinPartitions(*MONTH_KEYS, "set")
     .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "zstd").partitionBy(*MONTH_KEYS).parquet(path))


def whole_months(start, end) -> bool:
    """Whether a range of days, or an open one, begins and ends with a month."""
    start, end = (dt.date.fromisoformat(str(d)) if d is not None else None for d in (start, end))
    return (start is None or start.day == 1) and (end is None or end.day == calendar.monthrange(end.year, end.month)[1])


def _months_between(start, end) -> Column:
    """Predicate on the partition columns, which prunes folders."""
    test = F.lit(True)
    for bound, after in ((start, True), (end, False)):
        if bound is not None:
            day = dt.date.fromisoformat(str(bound))
            year, month = F.col("SubmitYear"), F.col("SubmitMonth")
            first = F.lit(day.replace(day=1))
            test = test & ((year >= day.year) & (month >= first) if after else (year <= day.year) & (month <= first))
    return test


def read_digest(spark: SparkSession, path: str, name: str, start=None, end=None, clusters: Iterable[str] | None = None) -> DataFrame:
    """The rows of one set in a range of submit days, both ends included.

    The range must be one of whole months, but for set ``days``.
    """
    if name != "days" and not whole_months(start, end):
        raise ValueError(f"set {name} is kept by month, and {start} to {end} are not whole months; see digest_range")
    rows = spark.read.schema(SCHEMA).parquet(path).where((F.col("set") == name) & _months_between(start, end))
    if name == "days":
        if start is not None:
            rows = rows.where(F.col("SubmitDay") >= F.lit(str(start)).cast("date"))
        if end is not None:
            rows = rows.where(F.col("SubmitDay") <= F.lit(str(end)).cast("date"))
    if clusters is not None:
        rows = rows.where(F.col("cluster").isin(list(clusters)))
    rows = rows.withColumns({m: F.coalesce(m, c) for m, c in _same_as().items()})
    return rows.select(*MONTH_KEYS, *SETS[name], *MEASURES, *(["_hash"] if name == "rows" else []))


def bucket_of() -> Column:
    """The bucket of a job in its month."""
    return F.pmod(F.xxhash64("cluster", "JobID"), F.lit(BUCKETS)).cast("int")


def changed_buckets(spark: SparkSession, old: str, new: str) -> DataFrame:
    """(cluster, year, month, bucket) in which the rows of two stores differ, from their digests."""
    side = lambda path, name: read_digest(spark, path, "rows").select(
        *[F.col(k).alias(f"_{name}_{k}") for k in MONTH_KEYS], F.col("bucket").alias(f"_{name}_bucket"), F.struct(WEIGHT, "_hash").alias(f"_{name}"))
    keys = [*MONTH_KEYS, "bucket"]
    same = F.lit(True)
    for k in keys:  # a month may be null
        same = same & F.col(f"_old_{k}").eqNullSafe(F.col(f"_new_{k}"))
    both = side(old, "old").join(side(new, "new"), same, "full_outer").where(~F.col("_old").eqNullSafe(F.col("_new")))
    return both.select(*[F.coalesce(f"_old_{k}", f"_new_{k}").alias(k) for k in keys])


def digest_range(jobs: DataFrame, path: str, name: str, start=None, end=None, clusters: Sequence[str] | None = None) -> DataFrame:
    """``read_digest`` for any range of days: whole months come from the digests, and only the months that the range cuts from ``jobs``."""
    spark = jobs.sparkSession
    if name == "days" or whole_months(start, end):
        return read_digest(spark, path, name, start, end, clusters)
    start, end = (dt.date.fromisoformat(str(d)) if d is not None else None for d in (start, end))
    last = lambda d: d.replace(day=calendar.monthrange(d.year, d.month)[1])
    day = dt.timedelta(days=1)
    inner_start = start if start is None or start.day == 1 else last(start) + day
    inner_end = end if end is None or end == last(end) else end.replace(day=1) - day
    if clusters is not None:
        jobs = jobs.where(F.col("cluster").isin(list(clusters)))
    edges = []
    if inner_start is not None and inner_end is not None and inner_start > inner_end:
        edges.append((start, end))  # less than a month, or the parts of two
        whole = None
    else:
        whole = read_digest(spark, path, name, inner_start, inner_end, clusters)
        if start != inner_start:
            edges.append((start, inner_start - day))
        if end != inner_end:
            edges.append((inner_end + day, end))
    for a, b in edges:
        part = reduce_by(submit_between(jobs, a, b), {name: SETS[name]}, MONTH_KEYS).select(*MONTH_KEYS, *SETS[name], *MEASURES)
        whole = part if whole is None else whole.unionByName(part)
    return whole

