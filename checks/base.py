"""Registry of queries and the jobs view that both engines share."""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from jobmeter.session import scratch_path
from jobmeter.sources.sample import SAMPLE_COLUMNS, sample_jobs, sample_records

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

_RAW = ", ".join(f"{sql} AS {name}" for name, sql in SAMPLE_COLUMNS.items())
# Jobs in standard SQL. Hours are taken from microseconds, periods are dates.
JOBS_SQL = f"""
WITH raw AS (
  SELECT o_orderkey AS k, {_RAW}
  FROM orders JOIN customer ON o_custkey = c_custkey
  JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
timed AS (
  SELECT k, cluster, JobID AS jobid, User_ AS usr, Account AS account, Partition_ AS part, QOS AS qos,
    RawState AS rawstate, CASE WHEN RawState LIKE 'CANCELLED%' THEN 'CANCELLED' ELSE RawState END AS state,
    Submit AS submit, Start_ AS start_, End_ AS end_, CPUs AS cpus, GPUs AS gpus, Nodes AS nodes, NodeList AS nodelist,
    (epoch_us(Start_) - epoch_us(Submit)) / 3.6e9 AS wait_h, (epoch_us(End_) - epoch_us(Start_)) / 3.6e9 AS el_h
  FROM raw),
jobs AS (
  SELECT *, coalesce(el_h, 0) * cpus AS cpu_h, coalesce(el_h, 0) * gpus AS gpu_h,
    CAST(submit AS DATE) AS sday, CAST(date_trunc('week', submit) AS DATE) AS sweek,
    CAST(date_trunc('month', submit) AS DATE) AS smonth, CAST(year(submit) AS INT) AS syear,
    CAST(start_ AS DATE) AS tday, CAST(date_trunc('week', start_) AS DATE) AS tweek,
    CAST(date_trunc('month', start_) AS DATE) AS tmonth, CAST(year(start_) AS INT) AS tyear
  FROM timed),
node_lists AS (
  SELECT * FROM (VALUES ('gpu[01-03,05]', 'gpu01'), ('gpu[01-03,05]', 'gpu02'), ('gpu[01-03,05]', 'gpu03'),
    ('gpu[01-03,05]', 'gpu05'), ('cpu7', 'cpu7'), ('cpu1,cpu2', 'cpu1'), ('cpu1,cpu2', 'cpu2'),
    ('ibex[1-2]', 'ibex1'), ('ibex[1-2]', 'ibex2')) AS t(nodelist, node)),
job_nodes AS (SELECT jobs.*, node FROM jobs JOIN node_lists USING (nodelist))
"""


class Context:
    """What a query may read: the tables of one scale factor and the job views made from them."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir
        spark.conf.set("spark.sql.session.timeZone", "UTC")

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def stream(self, name: str) -> DataFrame:
        """A table as a stream of files. A stream needs a folder, so a single file is picked out of its folder."""
        path = f"{self.sf_dir}/{name}.parquet"
        reader = self.spark.readStream.schema(self.table(name).schema)
        jpath = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        if jpath.getFileSystem(self.spark._jsc.hadoopConfiguration()).getFileStatus(jpath).isDirectory():
            return reader.parquet(path)
        return reader.option("pathGlobFilter", f"{name}.parquet").parquet(self.sf_dir)

    def scratch(self, label: str) -> str:
        return scratch_path(self.spark, label)

    @cached_property
    def jobs(self) -> DataFrame:
        return sample_jobs(self.spark, self.sf_dir)

    @cached_property
    def records(self) -> DataFrame:
        return sample_records(self.spark, self.sf_dir)

    @cached_property
    def key(self):
        """The order number of a job."""
        return F.col("JobID").cast("long")


def tidy(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles to ``digits`` digits, arrays as text, so that both engines compare by value."""
    out = []
    for f in df.schema:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = F.round(c.cast("double"), digits)
        elif isinstance(f.dataType, T.ArrayType):
            c = F.array_join(c, "|")
        out.append(c.alias(f.name))
    return df.select(*out)


def query(name: str, sql: str | None = None, jobs: bool = True, digits: int = 6):
    """Register a query and its SQL; ``jobs`` puts the jobs view in front of the SQL."""

    def register(build: Callable[[Context], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: tidy(build(Context(spark, sf_dir)), digits)
        if sql is not None:
            ORACLES[name] = (JOBS_SQL + sql) if jobs else sql
        return build

    return register
