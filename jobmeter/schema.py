"""The canonical jobs table and the record types read at ingest."""

from __future__ import annotations

from pyspark.sql import types as T

# One row per finished job. Partition columns of the store come last.
JOBS = T.StructType([
    T.StructField("JobID", T.StringType()),
    T.StructField("User", T.StringType()),
    T.StructField("Account", T.StringType()),
    T.StructField("Partition", T.StringType()),
    T.StructField("QOS", T.StringType()),
    T.StructField("State", T.StringType()),
    T.StructField("Submit", T.TimestampType()),
    T.StructField("Start", T.TimestampType()),
    T.StructField("End", T.TimestampType()),
    T.StructField("CPUs", T.IntegerType()),
    T.StructField("GPUs", T.IntegerType()),
    T.StructField("Nodes", T.IntegerType()),
    T.StructField("NodeList", T.ArrayType(T.StringType())),
    T.StructField("WaitingTimeHours", T.DoubleType()),
    T.StructField("ElapsedHours", T.DoubleType()),
    T.StructField("CPUHours", T.DoubleType()),
    T.StructField("GPUHours", T.DoubleType()),
    T.StructField("SubmitDay", T.DateType()),
    T.StructField("SubmitWeek", T.DateType()),
    T.StructField("StartDay", T.DateType()),
    T.StructField("StartWeek", T.DateType()),
    T.StructField("StartMonth", T.DateType()),
    T.StructField("StartYear", T.IntegerType()),
    T.StructField("AveCPU", T.StringType()),
    T.StructField("TotalCPU", T.StringType()),
    T.StructField("AveDiskRead", T.StringType()),
    T.StructField("AveDiskWrite", T.StringType()),
    T.StructField("MaxRSS", T.StringType()),
    T.StructField("ingest_seq", T.LongType()),
    T.StructField("cluster", T.StringType()),
    T.StructField("SubmitYear", T.IntegerType()),
    T.StructField("SubmitMonth", T.DateType()),
])

# Where a row came in, in the order in which loads take effect: by time of the file, then its name, then the place in it. Readers add it as column
# ``arrival``; it decides between records of one job in a load and is not stored.
ARRIVAL = T.StructType([
    T.StructField("time", T.TimestampType()),
    T.StructField("file", T.StringType()),
    T.StructField("split", T.LongType()),
    T.StructField("place", T.LongType()),
])

# Step metrics carried along as text.
STEP_METRICS = ["AveDiskRead", "AveDiskWrite", "AveCPU", "MaxRSS", "TotalCPU"]

# Field order of an accounting dump (fixed by the scheduler's --parsable2 output).
DUMP_FIELDS = [
    "JobID", "User", "QOS", "Account", "Partition", "Submit", "Start", "End", "State", "Elapsed",
    "AveDiskRead", "AveDiskWrite", "AveCPU", "MaxRSS", "AllocCPUS", "TotalCPU", "NodeList", "AllocTRES", "Cluster",
]
DUMP = T.StructType([T.StructField(name, T.StringType()) for name in DUMP_FIELDS])

# A job record as uploaded; times stay text until they are parsed.
RECORD = T.StructType([
    T.StructField("JobID", T.StringType()),
    T.StructField("User", T.StringType()),
    T.StructField("Account", T.StringType()),
    T.StructField("Partition", T.StringType()),
    T.StructField("State", T.StringType()),
    T.StructField("QOS", T.StringType()),
    T.StructField("Submit", T.StringType()),
    T.StructField("Start", T.StringType()),
    T.StructField("End", T.StringType()),
    T.StructField("CPUHours", T.DoubleType()),
    T.StructField("GPUHours", T.DoubleType()),
    T.StructField("AllocCPUS", T.IntegerType()),
    T.StructField("AllocGPUS", T.IntegerType()),
    T.StructField("AllocNodes", T.IntegerType()),
    T.StructField("NodeList", T.StringType()),
])

DIMENSIONS = ["Partition", "Account", "User", "QOS", "State"]
GRAINS = ["day", "week", "month", "year"]
