"""Continuous ingest of arriving record files into the store."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.records import arrival, normalize_records
from ..sources.store import upsert_jobs


def record_stream(spark: SparkSession, path: str, schema, fmt: str = "parquet", max_files: int | None = None) -> DataFrame:
    """Arriving files as a stream of records; ``arrival`` tells the order of records that one batch brings."""
    reader = spark.readStream.schema(schema)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    place = F.col("_metadata.row_index") if fmt == "parquet" else F.lit(None)
    return reader.format(fmt).load(path).select("*", arrival(place))


def start_ingest(stream: DataFrame, store: str, checkpoint: str, cluster: str | None = None,
                 audit: str | None = None, once: bool = False, digests: str | None = None) -> StreamingQuery:
    """Merge each micro-batch into the store; its records replace stored ones of the same jobs.

    ``audit`` is a folder that gets one row per batch and cluster: (cluster, ingest_ts, n_jobs). ``digests`` names the digests of the store, if any.

    Arrival decides, so a new checkpoint, whose batches count from 0 again, does no harm; only records that bring their own
    ``ingest_seq`` give way to stored ones with a higher one. A repeated batch leaves the store as it is.
    """
    def merge(rows: DataFrame, batch_id: int) -> None:
        if rows.isEmpty():
            return
        if "arrival" in rows.columns:
            place = F.coalesce("arrival.place", F.monotonically_increasing_id())
            rows = rows.withColumn("arrival", F.col("arrival").withField("place", place))
        jobs = normalize_records(rows, cluster)
        upsert_jobs(jobs, store, digests)
        if audit:
            sizes = jobs.groupBy("cluster").agg(F.current_timestamp().alias("ingest_ts"), F.count(F.lit(1)).alias("n_jobs"))
            sizes.write.mode("overwrite").parquet(f"{audit}/batch={batch_id}")

    writer = stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(merge)
    return (writer.trigger(availableNow=True) if once else writer).start()
