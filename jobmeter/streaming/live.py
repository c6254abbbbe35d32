"""Totals that stay current while jobs arrive, and are right when jobs are sent again."""

from __future__ import annotations

import pickle
from collections import defaultdict
from collections.abc import Iterator, Sequence
from decimal import Context, Decimal

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.time import period_start
from ..operators.cleaning import keep_last
from ..session import keep_versions

# Sums must give back exactly what was added, so hours are decimals of the precision of a double.
_HOURS = "decimal(38,18)"
_DELTA = f"period date, series string, jobs long, cpu_hours {_HOURS}"
_STATE = "jobs binary"
_EXACT = Context(prec=38)
#: Buckets of jobs, each a row of state: few for jobs that come by millions at once, many so that a job sent again rewrites a short row. They stay for a checkpoint.
BUCKETS = 1 << 15
_KEYS = ["cluster", "JobID"]
_ORDER = ["seq", "time", "file", "split", "place"]


def _entries(jobs: DataFrame, grain: str, dim: str | None) -> DataFrame:
    """What a record adds to the totals, and where it comes in the order of records."""
    have, null = set(jobs.columns), F.lit(None)
    series = F.col(dim).cast("string") if dim else null.cast("string")
    came = {"time": F.unix_micros("arrival.time"), "file": F.col("arrival.file"), "split": F.col("arrival.split"), "place": F.col("arrival.place")}
    if "arrival" not in have:
        came = {"time": null.cast("long"), "file": null.cast("string"), "split": null.cast("long"), "place": null.cast("long")}
    return jobs.select(
        (F.col("cluster") if "cluster" in have else F.lit("")).alias("cluster"), (F.col("JobID") if "JobID" in have else null.cast("string")).alias("JobID"),
        period_start("Submit", grain).alias("period"), series.alias("series"), F.coalesce(F.col("CPUHours"), F.lit(0.0)).cast(_HOURS).alias("cpu_hours"),
        (F.col("ingest_seq") if "ingest_seq" in have else null.cast("long")).alias("seq"), *[c.alias(name) for name, c in came.items()])


def _count_places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Numbers the rows of a task where the reader of the stream did not."""
    seen = 0
    for batch in batches:
        counted = pa.array(range(seen, seen + len(batch)), pa.int64())
        seen += len(batch)
        at = batch.schema.get_field_index("place")
        yield batch.set_column(at, batch.schema.field(at), pc.coalesce(batch.column(at), counted))


def _replace(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """The changes that new records of a bucket's jobs make: a job's last record comes in, and the one known before goes out."""
    last = {}
    for batch in batches:
        given = [[None if v is None or v != v else v for v in batch[c]] for c in (*_KEYS, *_ORDER, "period", "series", "cpu_hours")]
        for cluster, job, seq, time, file, split, place, *adds in zip(*given):
            order = tuple((v is not None, 0 if v is None else v) for v in (seq, time, file, split, place))
            if (cluster, job) not in last or order >= last[cluster, job][0]:
                last[cluster, job] = order, None if seq is None else int(seq), adds
    known = pickle.loads(state.get[0]) if state.exists else {}
    changes = defaultdict(lambda: [0, Decimal(0)])
    for job, (_, seq, adds) in last.items():
        if job in known:
            *before, known_seq = known[job]
            if seq is not None and known_seq is not None and known_seq > seq:
                continue
            _add(changes, before, -1)
        _add(changes, adds, 1)
        known[job] = (*adds, seq)
    state.update((pickle.dumps(known),))
    if changes:
        yield pd.DataFrame([(*group, *sums) for group, sums in changes.items()], columns=["period", "series", "jobs", "cpu_hours"])


def _add(changes: dict, record: Sequence, sign: int) -> None:
    period, series, hours = record
    total = changes[period, series]
    total[0] += sign
    total[1] = _EXACT.add(total[1], hours if sign > 0 else hours.copy_negate())


def total_changes(stream: DataFrame, grain: str = "month", dim: str | None = None, buckets: int = BUCKETS) -> DataFrame:
    """Additions to and retractions from the totals, as a stream.

    State holds what the last record of each (cluster, JobID) added, one row for each of ``buckets`` buckets of jobs: a call of the Python function costs
    milliseconds, and takes all new records of a bucket. The last record counts by ``ingest_seq`` where both have one, then by
    batch, then by ``arrival`` in the batch. Records without JobID can't be told again and count each.
    """
    entries = _entries(stream, grain, dim)
    entries = entries.mapInArrow(_count_places, entries.schema)
    bucket = F.pmod(F.xxhash64(*_KEYS), F.lit(buckets)).alias("bucket")
    named = entries.where(F.col("JobID").isNotNull()).select("*", bucket).groupBy("bucket").applyInPandasWithState(
        _replace, _DELTA, _STATE, "update", GroupStateTimeout.NoTimeout)
    single = entries.where(F.col("JobID").isNull()).select("period", "series", F.lit(1).cast("long").alias("jobs"), "cpu_hours")
    return (named.unionByName(single) if "JobID" in stream.columns else single)


def live_totals(jobs: DataFrame, grain: str = "month", dim: str | None = None) -> DataFrame:
    """The same totals over a table: jobs and CPU-hours per submit period (and group), each job by its last record."""
    entries = _entries(jobs, grain, dim)
    if "JobID" in jobs.columns:
        last = keep_last(entries.where(F.col("JobID").isNotNull()), _KEYS, _ORDER)
        entries = last.unionByName(entries.where(F.col("JobID").isNull()))
    return _shown(entries.groupBy("period", "series").agg(F.count(F.lit(1)).alias("jobs"), F.sum("cpu_hours").alias("cpu_hours")), dim)


def _shown(totals: DataFrame, dim) -> DataFrame:
    keys = ["period", "series"] if dim else ["period"]
    return totals.select(*keys, "jobs", F.col("cpu_hours").cast("double").alias("cpu_hours"))


def start_live_totals(stream: DataFrame, path: str, checkpoint: str, grain: str = "month", dim: str | None = None, once: bool = False) -> StreamingQuery:
    """Keep the totals after each of the last two triggers as ``path/batch=<n>``.

    A trigger adds its changes to the totals before it; a repeated one starts from the same totals and replaces its own folder. ``path`` and ``checkpoint``
    belong together.
    """
    spark = stream.sparkSession

    def save(batch: DataFrame, batch_id: int) -> None:
        older = [n for n in keep_versions(spark, path, "batch=") if n < batch_id]
        changes = batch.groupBy("period", "series").agg(F.sum("jobs").alias("jobs"), F.sum("cpu_hours").alias("cpu_hours"))
        if older:
            changes = changes.unionByName(spark.read.schema(_DELTA).parquet(f"{path}/batch={max(older)}"))
        totals = changes.groupBy("period", "series").agg(F.sum("jobs").alias("jobs"), F.sum("cpu_hours").cast(_HOURS).alias("cpu_hours"))
        totals.where("jobs != 0").write.mode("overwrite").parquet(f"{path}/batch={batch_id}")
        keep_versions(spark, path, "batch=")

    writer = total_changes(stream, grain, dim).writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(save)
    return (writer.trigger(availableNow=True) if once else writer).start()


def read_live_totals(spark, path: str, dim: str | None = None) -> DataFrame:
    """The totals of the latest trigger; give ``dim`` if they are grouped."""
    latest = max(keep_versions(spark, path, "batch="))
    return _shown(spark.read.schema(_DELTA).parquet(f"{path}/batch={latest}"), dim)
