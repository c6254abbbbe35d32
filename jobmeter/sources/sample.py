"""Job records derived from the sample tables: one order is one job."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .records import with_hours, with_job_periods
from ..functions.text import job_state

# The same expressions are valid Spark SQL and standard SQL; the checks use them for both engines.
SAMPLE_COLUMNS = {
    "cluster": "replace(lower(r_name), ' ', '_')",
    "JobID": "cast(o_orderkey as string)",
    "User_": "c_name",
    "Account": "concat(lower(r_name), '-', lower(n_name), '-', lower(c_mktsegment), '-g', cast(c_custkey % 3 as string))",
    "Partition_": "case o_orderkey % 4 when 0 then 'gpu' when 1 then 'cpu' when 2 then 'cpu,short' else 'gpu, long' end",
    "QOS": "o_orderpriority",
    "RawState": "case o_orderstatus when 'F' then 'COMPLETED' when 'O' then 'FAILED' "
                "else concat('CANCELLED by ', cast(o_custkey as string)) end",
    "Submit": "o_orderdate + (o_orderkey * 7919 % 86400) * interval '1' second",
    "Start_": "case when o_orderkey % 50 = 0 then null else o_orderdate + "
              "(o_orderkey * 7919 % 86400 + o_orderkey * 104729 % 180000) * interval '1' second end",
    "End_": "case when o_orderkey % 50 = 0 then null else o_orderdate + (o_orderkey * 7919 % 86400 + "
            "o_orderkey * 104729 % 180000 + o_orderkey * 15485863 % 900000) * interval '1' second end",
    "CPUs": "cast(power(2, o_orderkey % 6) as int)",
    "GPUs": "cast(case when o_orderkey % 4 = 0 then 1 + o_orderkey % 3 else 0 end as int)",
    "Nodes": "cast(case o_orderkey % 5 when 0 then 4 when 1 then 1 when 2 then 2 when 3 then 0 else 2 end as int)",
    "NodeList": "case o_orderkey % 5 when 0 then 'gpu[01-03,05]' when 1 then 'cpu7' when 2 then 'cpu1,cpu2' "
                "when 3 then 'None assigned' else 'ibex[1-2]' end",
}


def sample_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw job records: state with its tail, node list as text, times as timestamps."""
    read = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    wide = (read("orders")
            .withColumn("o_orderdate", F.col("o_orderdate").cast("timestamp"))
            .join(read("customer"), F.col("o_custkey") == F.col("c_custkey"))
            .join(read("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
            .join(read("region"), F.col("n_regionkey") == F.col("r_regionkey")))
    records = wide.selectExpr(*[f"{sql} as `{name}`" for name, sql in SAMPLE_COLUMNS.items()])
    return records.withColumnsRenamed({"User_": "User", "Partition_": "Partition", "Start_": "Start", "End_": "End"})


def sample_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same records with state, hours and periods derived; the node list stays text."""
    records = sample_records(spark, sf_dir).withColumn("State", job_state("RawState")).drop("RawState")
    return with_job_periods(with_hours(records))
