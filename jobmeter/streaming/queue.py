"""Waiting times seen by polling the queue of pending jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..functions.text import array_job
from ..session import keep_versions, staged

# One row per job that a poll found pending, and one for the poll itself, without JobID: a marker that names the poll before it. So a poll that found
# nothing is known too. A marker without ``previous_ts`` begins a new series of polls.
SNAPSHOT = T.StructType([
    T.StructField("snapshot_ts", T.TimestampType()),
    T.StructField("JobID", T.StringType()),
    T.StructField("Submit", T.TimestampType()),
    T.StructField("User", T.StringType()),
    T.StructField("previous_ts", T.TimestampType()),
])

# What the monitor keeps between batches.
_ROWS = "snapshot_ts timestamp, JobID string, Submit timestamp, User string"
_MARKERS = "known timestamp, next_ts timestamp, follows timestamp"
_AHEAD = "JobID string, Submit timestamp, User string, next_ts timestamp"


def poll_markers(polls: DataFrame) -> DataFrame:
    """Marker rows for the times in column ``snapshot_ts``, each naming the one before it."""
    followed = _next_polls(polls).where(F.col("next_ts").isNotNull()).select(F.col("next_ts").alias("snapshot_ts"), F.col("snapshot_ts").alias("previous_ts"))
    first = polls.agg(F.min("snapshot_ts").alias("snapshot_ts")).withColumn("previous_ts", F.lit(None).cast("timestamp"))
    null = lambda name: F.lit(None).cast(SNAPSHOT[name].dataType).alias(name)
    return first.unionByName(followed).select("snapshot_ts", null("JobID"), null("Submit"), null("User"), "previous_ts")


def _next_polls(snapshots: DataFrame) -> DataFrame:
    """(snapshot_ts, next_ts): the list of polls, which has no row per job. Windows run inside a day, and over one row per day."""
    polls = snapshots.select("snapshot_ts", F.to_date("snapshot_ts").alias("_day")).distinct()
    days = polls.groupBy("_day").agg(F.min("snapshot_ts").alias("_first"))
    days = days.select("_day", F.lead("_first").over(Window.orderBy("_day")).alias("_after"))
    in_day = polls.withColumn("_next", F.lead("snapshot_ts").over(Window.partitionBy("_day").orderBy("snapshot_ts")))
    return in_day.join(days, "_day").select("snapshot_ts", F.coalesce("_next", "_after").alias("next_ts"))


def queue_waits(snapshots: DataFrame) -> DataFrame:
    """Jobs that were pending at one poll and gone at the next, with the seconds from submit to that next poll.

    A poll is known by its jobs or its marker. A job is looked up at (job, next poll) by an anti join, so no window runs over the rows of one job.
    """
    ahead = _jobs(snapshots).join(_next_polls(snapshots).where(F.col("next_ts").isNotNull()), "snapshot_ts")
    seen = _jobs(snapshots).select(F.col("JobID").alias("_id"), F.col("snapshot_ts").alias("_ts"))
    gone = ahead.join(seen, (F.col("JobID") == F.col("_id")) & (F.col("next_ts") == F.col("_ts")), "left_anti")
    return _waits(gone)


def _jobs(snapshots: DataFrame) -> DataFrame:
    return snapshots.where(F.col("JobID").isNotNull()).drop("previous_ts")


def _waits(gone: DataFrame) -> DataFrame:
    parts = array_job("JobID")
    seconds = F.floor((F.unix_micros("next_ts") - F.unix_micros("Submit")) / 1000000).cast("long")
    return gone.select(parts["JobID"].alias("JobID"), parts["TaskIndex"].alias("TaskIndex"), "User",
                       F.col("next_ts").alias("seen_gone"), seconds.alias("waiting_seconds"))


def queue_counts(snapshots: DataFrame) -> DataFrame:
    """Per poll: jobs waiting, new since the poll before, and started (gone) since then."""
    polls = _next_polls(snapshots)
    rows = _jobs(snapshots).join(polls, "snapshot_ts")
    waiting = rows.groupBy("snapshot_ts").agg(F.count(F.lit(1)).alias("waiting"))
    # Each row counts at its own poll and at the next; a job present at both meets itself there.
    here = rows.select("JobID", F.col("snapshot_ts").alias("ts"), F.lit(1).alias("now"), F.lit(0).alias("before"))
    next_ = rows.where(F.col("next_ts").isNotNull()).select(
        "JobID", F.col("next_ts").alias("ts"), F.lit(0).alias("now"), F.lit(1).alias("before"))
    meet = here.unionByName(next_).groupBy("JobID", "ts").agg(F.max("now").alias("now"), F.max("before").alias("before"))
    moves = meet.groupBy(F.col("ts").alias("snapshot_ts")).agg(
        F.count_if((F.col("now") == 1) & (F.col("before") == 0)).alias("new"),
        F.count_if((F.col("now") == 0) & (F.col("before") == 1)).alias("started"))
    return polls.select("snapshot_ts").join(waiting, "snapshot_ts", "left").join(moves, "snapshot_ts", "left").select(
        "snapshot_ts", F.coalesce("waiting", F.lit(0)).cast("long").alias("waiting"),
        F.coalesce("new", F.lit(0)).cast("long").alias("new"),
        F.coalesce("started", F.lit(0)).cast("long").alias("started"))


def _known(markers: DataFrame) -> DataFrame:
    """Markers with the poll that each makes known to have a next one, or its own where it begins a series."""
    return markers.select(F.coalesce("previous_ts", "snapshot_ts").alias("known"), F.col("snapshot_ts").alias("next_ts"), F.col("previous_ts").alias("follows"))


def _add_polls(spark: SparkSession, batch: DataFrame, batch_id: int, path: str, delay: str) -> None:
    """``queue_waits`` continued by a batch: what it settles goes to ``path/waits/batch=<n>``, what stays open to ``path/open/<table>/<n>``.

    Open are rows whose poll, or whose next poll, is not behind the watermark, and markers in the same way.
    """
    older = [n for n in keep_versions(spark, f"{path}/open/mark/") if n < batch_id]

    def before(table: str, schema: str) -> DataFrame:
        return spark.read.schema(schema).parquet(f"{path}/open/{table}/{max(older)}") if older else spark.createDataFrame([], schema)

    with staged(batch.select(*SNAPSHOT.fieldNames()), "polls", spark) as new:
        old_mark = before("mark", "mark long").agg(F.max("mark")).first()[0]
        behind = lambda c, mark: F.lit(False) if mark is None else F.coalesce(F.unix_micros(c) <= mark, F.lit(False))
        rows, markers = _jobs(new).where(~behind("snapshot_ts", old_mark)), _known(new.where(F.col("JobID").isNull())).where(~behind("known", old_mark))
        mark = markers.agg(F.unix_micros(F.max("known") - F.expr(f"interval {delay}"))).first()[0]
        mark = max((m for m in (old_mark, mark) if m is not None), default=None)
        old_rows, old_markers = before("rows", _ROWS), before("markers", _MARKERS)
        all_rows, all_markers = old_rows.unionByName(rows), old_markers.unionByName(markers)
        pairs = [_follow(rows, all_markers)] + ([_follow(old_rows, markers)] if older else [])
        ahead = before("ahead", _AHEAD)
        for p in pairs:
            ahead = ahead.unionByName(p)
        seen = all_rows.select(F.col("JobID").alias("_id"), F.col("snapshot_ts").alias("_ts"))
        here = (F.col("JobID") == F.col("_id")) & (F.col("next_ts") == F.col("_ts"))
        gone = ahead.where(behind("next_ts", mark)).join(seen, here, "left_anti")
        _waits(gone).write.mode("overwrite").parquet(f"{path}/waits/batch={batch_id}")
        kept = {"rows": all_rows.where(~behind("snapshot_ts", mark)), "markers": all_markers.where(~behind("known", mark)), "ahead": ahead.where(~behind("next_ts", mark)),
                "mark": spark.range(1).select(F.lit(mark).cast("long").alias("mark"))}
        for table, df in kept.items():  # the mark comes last: with it the state of this batch is whole
            df.write.mode("overwrite").parquet(f"{path}/open/{table}/{batch_id}")
    for table in kept:
        keep_versions(spark, f"{path}/open/{table}/")


def _follow(rows: DataFrame, markers: DataFrame) -> DataFrame:
    """Rows with the poll after theirs, where a marker names it."""
    return rows.join(markers, F.col("snapshot_ts") == F.col("follows")).select("JobID", "Submit", "User", "next_ts")


def start_queue_monitor(stream: DataFrame, path: str, checkpoint: str, delay: str = "10 minutes", once: bool = False) -> StreamingQuery:
    """``queue_waits`` over a stream of :data:`SNAPSHOT` rows with a marker for each poll; waits are added to ``path/waits`` as they are found.

    A job's row meets the marker that names its poll as the one before, which tells the next poll, and then the rows of that poll: without an equal job there it
    is gone. The watermark is ``delay`` behind the latest poll that is known to have a next one, however long after it that came. Rows and markers may come in any
    number of batches and files, a poll in several of them, as long as they are not behind the watermark. A wait is given out when the watermark has
    passed the poll that no longer had the job; rows of later polls are all that is kept from one batch to the next, as tables in ``path/open``. A batch is
    joined as a whole, so its cost is that of a join of its size. A repeated batch starts from the same tables and replaces its own output; ``path`` and
    ``checkpoint`` belong together.
    """
    writer = stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda batch, n: _add_polls(stream.sparkSession, batch, n, path, delay))
    return (writer.trigger(availableNow=True) if once else writer).start()


def read_waits(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/waits").drop("batch")


def export_waits(waits: DataFrame, path: str) -> None:
    """Append waits as CSV with the columns JobID, TaskIndex, Username and WaitingTime [s]."""
    waits.select("JobID", "TaskIndex", F.col("User").alias("Username"),
                 F.col("waiting_seconds").alias("WaitingTime [s]")).write.mode("append").option("header", "true").csv(path)
