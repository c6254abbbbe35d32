"""Sources, normalisation, the store, and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from jobmeter.functions import nodes as N
from jobmeter.functions import text as X
from jobmeter.functions import time as Z
from jobmeter.operators.cleaning import fill_forward, keep_last
from jobmeter.operators.metadata import with_nodes
from jobmeter.schema import DUMP_FIELDS
from jobmeter.sources import dump as U
from jobmeter.sources import history as Y
from jobmeter.sources import records as S
from jobmeter.sources import store as O
from jobmeter.streaming import ingest as I
from jobmeter.streaming import live as V
from jobmeter.streaming import queue as G

from .base import Context, query
from .measures import coarse

# History in several dialects -----------------------------------------------------------------------


def history_root(c: Context) -> str:
    """A history folder: two clusters in the older weekly dialect (one in the older folder), the others as ingested."""
    root = c.scratch("history")
    jobs = S.with_job_periods(S.with_hours(c.records.withColumn("State", X.job_state("RawState")).drop("RawState")))
    weekly = jobs.drop("JobID").withColumnsRenamed({
        "CPUHours": "CPU-hours", "GPUHours": "GPU-hours", "WaitingTimeHours": "WaitingTime [h]", "ElapsedHours": "Elapsed [h]"})
    weekly = weekly.withColumns({"NodeList": N.expand_nodelist("NodeList"), "SubmitMonth": F.col("SubmitMonth").cast("timestamp")})
    ingested = jobs.withColumnsRenamed({"CPUs": "AllocCPUS", "GPUs": "AllocGPUS", "Nodes": "AllocNodes"}) \
        .withColumn("SubmitMonth", F.date_format("SubmitMonth", "yyyy-MM"))
    places = {"africa": (weekly, "data"), "america": (weekly, "weekly-data"), "asia": (ingested, "data"),
              "europe": (ingested, "data"), "middle_east": (ingested, "data")}
    for cluster, (rows, folder) in places.items():
        rows.where(F.col("cluster") == cluster).drop("cluster").write.parquet(f"{root}/{cluster}/{folder}")
    return root


@query("s01_scan_history", """
SELECT cluster, syear AS "SubmitYear", count(*) AS jobs, round(sum(cpu_h), 4) AS cpu_hours, round(sum(wait_h), 4) AS wait_hours,
  CAST(sum(nodes) AS BIGINT) AS nodes FROM jobs GROUP BY ALL""")
def s01(c: Context):
    jobs = Y.scan_history(c.spark, history_root(c))
    return coarse(jobs.groupBy("cluster", "SubmitYear").agg(
        F.count("*").alias("jobs"), F.sum("CPUHours").alias("cpu_hours"), F.sum("WaitingTimeHours").alias("wait_hours"),
        F.sum("Nodes").alias("nodes")), "cpu_hours", "wait_hours")


@query("s02_list_clusters", "SELECT DISTINCT cluster FROM jobs")
def s02(c: Context):
    names = Y.list_clusters(c.spark, history_root(c))
    return c.spark.createDataFrame([(n,) for n in names], "cluster string")


@query("s04_mixed_nodelist", "SELECT cluster, node, count(*) AS jobs FROM job_nodes GROUP BY ALL")
def s04(c: Context):
    jobs = Y.scan_history(c.spark, history_root(c))
    return with_nodes(jobs).groupBy("cluster", "node").agg(F.count("*").alias("jobs"))


@query("s04_kept_catalogue", """
SELECT cluster, node, count(*) AS jobs FROM (SELECT cluster, node FROM job_nodes UNION ALL
  SELECT 'america', node FROM job_nodes WHERE cluster = 'asia') GROUP BY ALL""")
def s04_catalogue(c: Context):
    """A second scan, after files of another dialect came into a cluster's folder, reads the types of those files only."""
    root, kept = history_root(c), c.scratch("catalogue")
    Y.scan_history(c.spark, root, catalogue=kept)
    c.spark.read.parquet(f"{root}/asia/data").write.mode("append").parquet(f"{root}/america/weekly-data")
    jobs = Y.scan_history(c.spark, root, catalogue=kept)
    return with_nodes(jobs).groupBy("cluster", "node").agg(F.count("*").alias("jobs"))


@query("s22_normalize_history", """
SELECT cluster, CASE WHEN cluster IN ('africa', 'america') THEN 'made' ELSE jobid END AS "JobID", usr AS "User", account AS "Account",
  part AS "Partition", qos AS "QOS", state AS "State", submit AS "Submit", start_ AS "Start", end_ AS "End", cpus AS "CPUs",
  gpus AS "GPUs", nodes AS "Nodes", round(cpu_h, 6) AS "CPUHours", round(gpu_h, 6) AS "GPUHours", round(wait_h, 6) AS "WaitingTimeHours",
  round(el_h, 6) AS "ElapsedHours", sweek AS "SubmitWeek", smonth AS "SubmitMonth", syear AS "SubmitYear", tday AS "StartDay",
  (SELECT coalesce(string_agg(node, '|' ORDER BY node), '') FROM node_lists n WHERE n.nodelist = jobs.nodelist) AS "NodeList"
FROM jobs""")
def s22(c: Context):
    jobs = Y.scan_history(c.spark, history_root(c))
    made = F.col("JobID").rlike("^h[0-9A-F]+$")
    return jobs.withColumn("JobID", F.when(made, "made").otherwise(F.col("JobID"))).select(
        "cluster", "JobID", "User", "Account", "Partition", "QOS", "State", "Submit", "Start", "End", "CPUs", "GPUs", "Nodes",
        "CPUHours", "GPUHours", "WaitingTimeHours", "ElapsedHours", "SubmitWeek", "SubmitMonth", "SubmitYear", "StartDay", "NodeList")


@query("s22_ids_without_path", """
SELECT cluster, count(*) AS jobs, count(*) AS ids, count(*) AS known FROM jobs WHERE cluster IN ('africa', 'america') GROUP BY cluster""")
def s22_ids(c: Context):
    """Ids made for jobs without one are those of the same jobs in other files under other names."""
    root, moved = history_root(c), c.scratch("moved")
    for cluster, folder in (("africa", "data"), ("america", "weekly-data")):
        c.spark.read.parquet(f"{root}/{cluster}/{folder}").repartition(3, "Submit").write.parquet(f"{moved}/{cluster}/data")
    old, new = (Y.scan_history(c.spark, r, ["africa", "america"]).select("cluster", "JobID") for r in (root, moved))
    known = old.join(new.withColumnRenamed("JobID", "_id"), (F.col("JobID") == F.col("_id")) & (old["cluster"] == new["cluster"]), "left")
    return known.groupBy(old["cluster"]).agg(F.count("*").alias("jobs"), F.count_distinct("JobID").alias("ids"), F.count("_id").alias("known"))


@query("u01_union_by_name", "SELECT cluster, count(*) AS jobs, count(*) FILTER (WHERE cluster IN ('asia', 'europe')) AS with_id FROM jobs GROUP BY cluster")
def u01(c: Context):
    some = F.col("cluster").isin("asia", "europe")
    jobs = S.with_node_array(c.jobs)
    both = S.conform(jobs.where(some)).unionByName(S.conform(jobs.where(~some).drop("JobID")))
    return both.groupBy("cluster").agg(F.count("*").alias("jobs"), F.count("JobID").alias("with_id"))


# Accounting dump -----------------------------------------------------------------------------------

# Parts of a dump line that the jobs view does not have, as SQL that both engines read.
_STATE = ("case when o_orderkey % 11 = 0 then 'RUNNING' when o_orderkey % 13 = 0 then 'PENDING' "
          "when o_orderkey % 17 = 0 then '' else RawState end")


def dump_path(c: Context) -> str:
    """A dump of the sample jobs: a job line, a batch step and an extern step each, as '|'-separated text."""
    k = F.col("o_orderkey")
    iso = lambda t: F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss")
    secs = F.coalesce(F.unix_timestamp("End") - F.unix_timestamp("Start"), F.lit(0))
    days = F.floor(secs / 86400)
    clock = F.format_string("%02d:%02d:%02d", F.floor(secs % 86400 / 3600), F.floor(secs % 3600 / 60), secs % 60)
    base = c.records.withColumn("o_orderkey", F.col("JobID").cast("long")).withColumn("State", F.expr(_STATE))
    empty = F.lit("")
    job = {
        "JobID": F.col("JobID"), "User": F.when(k % 19 == 0, " ").otherwise(F.col("User")),
        "QOS": F.when(k % 23 == 0, "").otherwise(F.col("QOS")), "Account": F.when(k % 29 == 0, "nan").otherwise(F.col("Account")),
        "Partition": F.col("Partition"), "Submit": iso("Submit"), "Start": F.coalesce(iso("Start"), F.lit("None")),
        "End": F.coalesce(iso("End"), F.lit("None")), "State": F.col("State"),
        "Elapsed": F.when(days > 0, F.concat(days.cast("string"), F.lit("-"), clock)).otherwise(clock),
        "AveDiskRead": empty, "AveDiskWrite": empty, "AveCPU": empty,
        "MaxRSS": F.when(k % 3 == 0, F.concat(k.cast("string"), F.lit("K"))).otherwise(""),
        "AllocCPUS": F.col("CPUs").cast("string"), "TotalCPU": F.lit("00:00:01"), "NodeList": F.col("NodeList"),
        "AllocTRES": F.concat(F.lit("billing=1,cpu="), F.col("CPUs").cast("string"),
                              F.when(F.col("GPUs") > 0, F.concat(F.lit(",gres/gpu="), F.col("GPUs").cast("string"))).otherwise(""),
                              F.lit(",mem=16G,node="), F.col("Nodes").cast("string")),
        "Cluster": F.col("cluster")}
    blank = {"User": empty, "QOS": empty, "Partition": empty}
    batch = job | blank | {
        "JobID": F.concat("JobID", F.lit(".batch")), "AveDiskRead": F.concat((k % 7).cast("string"), F.lit("M")),
        "MaxRSS": F.concat((k + 1).cast("string"), F.lit("K"))}
    extern = job | blank | {
        "JobID": F.concat("JobID", F.lit(".extern")), "AveDiskRead": F.lit("9M"), "AveDiskWrite": F.lit("2M"), "MaxRSS": empty}
    line = lambda fields: F.struct(*[fields[f].cast("string").alias(f) for f in DUMP_FIELDS])
    rows = base.select(F.inline(F.array(line(job), line(batch), line(extern))))
    path = c.scratch("dump")
    rows.write.option("sep", "|").option("header", "true").option("quote", "").option("emptyValue", "") \
        .option("encoding", "ISO-8859-1").csv(path)
    return path


_DUMP_SQL = f"""
, d AS (SELECT jobs.*, o_orderkey, {_STATE.replace('RawState', 'rawstate')} AS raw FROM jobs JOIN (SELECT k AS o_orderkey FROM jobs) ON k = o_orderkey)
"""


@query("s05_read_dump", _DUMP_SQL + """
SELECT raw AS "State", count(*) * 3 AS "lines", count(*) * 2 AS steps, count(DISTINCT usr) AS users FROM d WHERE raw <> '' GROUP BY raw
UNION ALL SELECT NULL, count(*) * 3, count(*) * 2, count(DISTINCT usr) FROM d WHERE raw = ''""")
def s05(c: Context):
    lines = U.read_dump(c.spark, dump_path(c))
    job = F.regexp_extract("JobID", r"^\d+", 0).cast("long")
    names = c.jobs.select(F.col("JobID").cast("long").alias("_k"), F.col("User").alias("_user"))
    return lines.withColumn("_k", job).join(names, "_k").groupBy("State").agg(
        F.count("*").alias("lines"), F.count_if(F.col("JobID").contains(".")).alias("steps"), F.count_distinct("_user").alias("users"))


@query("s06_p15_final_jobs_only", _DUMP_SQL + """
SELECT jobid AS "JobID" FROM d WHERE raw NOT IN ('RUNNING', 'PENDING')""")
def s06(c: Context):
    return U.drop_steps(U.drop_non_final(U.read_dump(c.spark, dump_path(c)))).select("JobID")


@query("s06_whole_line_variant", _DUMP_SQL + """SELECT jobid AS "JobID" FROM d WHERE raw <> 'RUNNING'""")
def s06_line(c: Context):
    return U.drop_steps(U.drop_non_final(U.read_dump(c.spark, dump_path(c)), whole_line=True)).select("JobID")


@query("f07_drop_malformed", _DUMP_SQL + """SELECT jobid AS "JobID" FROM d WHERE o_orderkey % 19 <> 0""")
def f07(c: Context):
    return U.drop_malformed(U.read_dump(c.spark, dump_path(c))).select("JobID")


@query("f08_submit_window", _DUMP_SQL + """
SELECT jobid AS "JobID", submit AS "Submit" FROM d WHERE raw NOT IN ('RUNNING', 'PENDING') AND o_orderkey % 19 <> 0
  AND submit >= DATE '1996-03-01' AND submit < DATE '1997-01-01'""")
def f08(c: Context):
    lines = U.read_dump(c.spark, dump_path(c))
    return U.normalize_dump(lines, start="1996-03-01", end="1996-12-31").select("JobID", "Submit")


@query("s21_normalize_dump", _DUMP_SQL + """
SELECT jobid AS "JobID", cluster, usr AS "User", CASE WHEN o_orderkey % 29 = 0 THEN 'unknown' ELSE account END AS "Account",
  part AS "Partition", CASE WHEN o_orderkey % 23 = 0 THEN NULL ELSE qos END AS "QOS",
  CASE WHEN raw = '' THEN 'UNKNOWN' ELSE state END AS "State", submit AS "Submit", start_ AS "Start", end_ AS "End", cpus AS "CPUs",
  gpus AS "GPUs", greatest(nodes, CASE nodelist WHEN 'gpu[01-03,05]' THEN 2 WHEN 'cpu1,cpu2' THEN 2 ELSE 1 END) AS "Nodes",
  round(coalesce(el_h, 0), 6) AS "ElapsedHours", round(wait_h, 6) AS "WaitingTimeHours", round(cpu_h, 6) AS "CPUHours",
  round(gpu_h, 6) AS "GPUHours", CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey || 'K' ELSE (o_orderkey + 1) || 'K' END AS "MaxRSS",
  (o_orderkey % 7) || 'M' AS "AveDiskRead", '2M' AS "AveDiskWrite", CAST(NULL AS VARCHAR) AS "AveCPU", smonth AS "SubmitMonth", tweek AS "StartWeek",
  (SELECT coalesce(string_agg(node, '|' ORDER BY node), '') FROM node_lists n WHERE n.nodelist = d.nodelist) AS "NodeList"
FROM d WHERE raw NOT IN ('RUNNING', 'PENDING') AND o_orderkey % 19 <> 0""")
def s21(c: Context):
    return U.normalize_dump(U.read_dump(c.spark, dump_path(c))).select(
        "JobID", "cluster", "User", "Account", "Partition", "QOS", "State", "Submit", "Start", "End", "CPUs", "GPUs", "Nodes",
        "ElapsedHours", "WaitingTimeHours", "CPUHours", "GPUHours", "MaxRSS", "AveDiskRead", "AveDiskWrite", "AveCPU",
        "SubmitMonth", "StartWeek", "NodeList")


@query("w01_fill_forward", """
, l AS (SELECT k, cluster, CASE WHEN k % 5 = 0 THEN qos END AS a, CASE WHEN k % 997 = 0 THEN usr END AS b FROM jobs)
SELECT k AS line, cluster AS file, last_value(a IGNORE NULLS) OVER w AS a, last_value(b IGNORE NULLS) OVER w AS b FROM l
WINDOW w AS (PARTITION BY cluster ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""")
def w01(c: Context):
    lines = c.jobs.select(
        F.col("cluster").alias("_file"), (F.floor(c.key / 500) * 500).alias("_split"), c.key.alias("_line"),
        F.when(c.key % 5 == 0, F.col("QOS")).alias("a"), F.when(c.key % 997 == 0, F.col("User")).alias("b"))
    return fill_forward(lines, ["a", "b"]).select(F.col("_line").alias("line"), F.col("_file").alias("file"), "a", "b")


@query("s20_batch_summary", """
, w AS (SELECT CAST(floor((sday - DATE '1995-01-01') / 7) AS INT) AS chunk, cpu_h, gpu_h FROM jobs)
SELECT chunk, count(*) AS jobs, round(sum(cpu_h), 4) AS cpu_hours, round(sum(gpu_h), 4) AS gpu_hours FROM w GROUP BY chunk
UNION ALL SELECT NULL, count(*), round(sum(cpu_h), 4), round(sum(gpu_h), 4) FROM w""")
def s20(c: Context):
    return coarse(U.batch_summary(c.jobs, "1995-01-01"), "cpu_hours", "gpu_hours")


# Field expressions ---------------------------------------------------------------------------------


@query("s08_parse_time", """
SELECT jobid AS "JobID", submit AS strict, CASE WHEN k % 9 = 0 THEN NULL ELSE start_ END AS lenient FROM jobs""")
def s08(c: Context):
    iso = lambda t: F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss")
    text = F.when(c.key % 9 == 0, "Unknown").otherwise(iso("Start"))
    return c.jobs.select("JobID", S.parse_time(iso("Submit")).alias("strict"), S.parse_time(text, strict=False).alias("lenient"))


@query("p02_p03_p17_hours", """
SELECT jobid AS "JobID", round(wait_h, 6) AS wait, round(el_h, 6) AS elapsed, round(cpu_h, 6) AS cpu, round(gpu_h, 6) AS gpu FROM jobs""")
def p02(c: Context):
    return S.with_hours(c.records).select("JobID", F.col("WaitingTimeHours").alias("wait"), F.col("ElapsedHours").alias("elapsed"),
                                          F.col("CPUHours").alias("cpu"), F.col("GPUHours").alias("gpu"))


@query("p05_periods", """
SELECT jobid AS "JobID", sday AS "SubmitDay", sweek AS "SubmitWeek", smonth AS "SubmitMonth", syear AS "SubmitYear",
  dayname(submit) AS "SubmitWeekDay", CAST(weekofyear(submit) AS INT) AS "SubmitWeekNo", CAST(month(submit) AS INT) AS "SubmitMonthNo",
  CAST(isoyear(submit) AS INT) AS "SubmitIsoYear" FROM jobs""")
def p05(c: Context):
    return Z.with_periods(c.records.select("JobID", "Submit"), "Submit").drop("Submit")


@query("p06_p07_text_to_date", """
, t AS (SELECT DISTINCT syear AS y, CAST(weekofyear(submit) AS INT) AS w, smonth FROM jobs)
SELECT printf('%04d-%02d', y, w) AS year_week, CAST(date_trunc('week', make_date(y, 1, 1)) AS DATE) + (w - 1) * 7 AS week_date, smonth AS month_date
FROM t""")
def p06(c: Context):
    week = F.format_string("%04d-%02d", "SubmitYear", F.weekofyear("Submit"))
    keys = c.jobs.select(week.alias("year_week"), F.date_format("Submit", "yyyy-MM").alias("m")).distinct()
    return keys.select("year_week", Z.week_to_date("year_week").alias("week_date"), Z.month_to_date("m").alias("month_date"))


@query("p08_primary_partition", """
SELECT split_part(part, ',', 1) AS "partition", count(*) AS jobs FROM jobs GROUP BY 1""")
def p08(c: Context):
    return c.jobs.groupBy(X.primary_partition("Partition").alias("partition")).agg(F.count("*").alias("jobs"))


@query("p10_p11_tres", """
SELECT jobid AS "JobID", CASE WHEN k % 7 = 0 THEN 0 ELSE cpus END AS cpus, CASE WHEN k % 7 = 0 THEN 0 ELSE gpus END AS gpus,
  CASE WHEN k % 7 = 0 THEN 0 WHEN k % 2 = 0 THEN (k % 100) * 1024 ELSE k % 5000 END AS mem_mb,
  CASE WHEN k % 7 = 0 THEN 0 ELSE nodes END AS nodes,
  round(CASE WHEN k % 3 = 0 THEN k % 100 WHEN k % 3 = 1 THEN (k % 5000) / 1024.0 ELSE 0 END, 6)::DOUBLE AS gb FROM jobs""")
def p10(c: Context):
    k, s = c.key, (lambda x: x.cast("string"))
    mem = F.when(k % 2 == 0, F.concat(s(k % 100), F.lit("G"))).otherwise(F.concat(s(k % 5000), F.lit("M")))
    tres = F.concat(F.lit("billing=7,cpu="), s(F.col("CPUs")), F.lit(",gres/gpu="), s(F.col("GPUs")), F.lit(",mem="), mem,
                    F.lit(",node="), s(F.col("Nodes")))
    parsed = X.parse_tres(F.when(k % 7 != 0, tres))
    size = F.when(k % 3 == 0, F.concat(s(k % 100), F.lit("G"))).when(k % 3 == 1, F.concat(s(k % 5000), F.lit("M"))) \
        .otherwise(F.concat(s(k), F.lit("T")))
    return c.jobs.select("JobID", parsed.alias("p"), X.memory_gb(size).alias("gb")).select("JobID", "p.*", "gb")


@query("p12_elapsed_text", """
SELECT jobid AS "JobID", round(CASE k % 5 WHEN 0 THEN (k % 9) * 24 + (k % 24) + (k % 60) / 60.0 + (k % 50) / 3600.0
  WHEN 1 THEN (k % 24) + (k % 60) / 60.0 + (k % 50) / 3600.0 WHEN 2 THEN (k % 60) / 60.0 + (k % 50) / 3600.0 ELSE 0 END, 6)::DOUBLE AS hours
FROM jobs""")
def p12(c: Context):
    k = c.key
    text = (F.when(k % 5 == 0, F.format_string("%d-%02d:%02d:%02d", k % 9, k % 24, k % 60, k % 50))
            .when(k % 5 == 1, F.format_string("%02d:%02d:%02d", k % 24, k % 60, k % 50))
            .when(k % 5 == 2, F.format_string("%02d:%02d", k % 60, k % 50)).when(k % 5 == 3, "INVALID"))
    return c.jobs.select("JobID", Z.elapsed_to_hours(text).alias("hours"))


@query("p13_p14_text_fields", """
SELECT jobid AS "JobID", CASE WHEN k % 31 = 0 THEN 'UNKNOWN' ELSE state END AS state, CASE WHEN k % 31 = 0 THEN 'UNKNOWN' ELSE state END AS first_word,
  CASE k % 4 WHEN 0 THEN 'unknown' WHEN 1 THEN 'unknown' WHEN 2 THEN 'unknown' ELSE usr END AS "user",
  CASE WHEN k % 2 = 0 THEN NULL ELSE qos END AS qos FROM jobs""")
def p13(c: Context):
    df, k = c.records, F.col("JobID").cast("long")
    state = F.when(k % 31 == 0, " ").otherwise(F.col("RawState"))
    user = F.when(k % 4 == 0, "NaN").when(k % 4 == 1, "  ").when(k % 4 == 2, F.lit(None)).otherwise(F.concat(F.lit(" "), "User", F.lit(" ")))
    return df.select("JobID", X.job_state(state).alias("state"), X.job_state(state, first_word=True).alias("first_word"),
                     X.clean_text(user).alias("user"), X.clean_text(F.when(k % 2 == 0, "None").otherwise(F.col("QOS")), None).alias("qos"))


@query("p16_array_ids", """
SELECT jobid AS "JobID", CASE WHEN k % 3 = 0 THEN CAST(k % 10 AS VARCHAR) ELSE '' END AS "TaskIndex" FROM jobs""")
def p16(c: Context):
    full = F.when(c.key % 3 == 0, F.concat("JobID", F.lit("_"), (c.key % 10).cast("string"))).otherwise(F.col("JobID"))
    return c.jobs.select(X.array_job(full).alias("a")).select("a.*")


@query("p18_p19_nodelist", """
SELECT jobid AS "JobID", CASE nodelist WHEN 'gpu[01-03,05]' THEN 2 WHEN 'cpu1,cpu2' THEN 2 ELSE 1 END AS pieces,
  (SELECT coalesce(string_agg(node, '|' ORDER BY node), '') FROM node_lists n WHERE n.nodelist = jobs.nodelist) AS names FROM jobs""")
def p19(c: Context):
    return c.jobs.select("JobID", N.node_pieces("NodeList").alias("pieces"), N.expand_nodelist("NodeList").alias("names"))


@query("p19_generated_ranges", """
SELECT jobid AS "JobID", (SELECT string_agg('n' || lpad(CAST(i AS VARCHAR), CAST(greatest(3, length(CAST(i AS VARCHAR))) AS INT), '0'), '|' ORDER BY i)
  FROM (SELECT unnest(generate_series(k % 97, k % 97 + k % 13)) AS i)) || '|x-' || (k % 7) AS names FROM jobs""")
def p19_ranges(c: Context):
    text = F.concat(F.format_string("n[%03d-%d],x-", c.key % 97, c.key % 97 + c.key % 13), (c.key % 7).cast("string"))
    return c.jobs.select("JobID", N.expand_nodelist(text).alias("names"))


@query("p20_duration_category", """
, x AS (SELECT jobid, el_h * (CASE k % 4 WHEN 0 THEN 1 WHEN 1 THEN 0.1 WHEN 2 THEN 0.003 ELSE 0.00001 END) AS h FROM jobs)
SELECT jobid AS "JobID", CASE WHEN h IS NULL THEN NULL WHEN h < 5.0 / 3600 THEN '<5s' WHEN h < 1.0 / 60 THEN '<1min' WHEN h < 5.0 / 60 THEN '<5min'
  WHEN h < 0.5 THEN '<30min' WHEN h < 1 THEN '<1h' WHEN h < 5 THEN '<5h' WHEN h < 10 THEN '<10h' WHEN h < 24 THEN '<24h' ELSE '>=24h' END AS label,
  CASE WHEN h IS NULL THEN NULL WHEN h < 5.0 / 3600 THEN '<5s' WHEN h < 1.0 / 60 THEN '<1min' WHEN h < 0.25 THEN '<15min' WHEN h < 0.5 THEN '<30min'
  WHEN h < 1 THEN '<1h' WHEN h < 5 THEN '<5h' WHEN h < 10 THEN '<10h' WHEN h < 24 THEN '<24h' ELSE '>=24h' END AS from_zero FROM x""")
def p20(c: Context):
    factor = F.when(c.key % 4 == 0, 1.0).when(c.key % 4 == 1, 0.1).when(c.key % 4 == 2, 0.003).otherwise(0.00001)
    h = F.col("ElapsedHours") * factor
    return c.jobs.select("JobID", Z.duration_category(h)["label"].alias("label"), Z.duration_category(h, from_zero=True)["label"].alias("from_zero"))


@query("p21_natural_order", """
, n AS (SELECT DISTINCT 'cpu' || (k % 300) || 'b' || (k % 11) AS node, k % 300 AS i, k % 11 AS j FROM jobs)
SELECT node, CAST(row_number() OVER (ORDER BY i, j) AS INT) AS place FROM n""")
def p21(c: Context):
    from pyspark.sql import Window
    name = F.concat(F.lit("cpu"), (c.key % 300).cast("string"), F.lit("b"), (c.key % 11).cast("string"))
    names = c.jobs.select(name.alias("node")).distinct()
    return names.select("node", F.row_number().over(Window.orderBy(N.natural_key("node"))).alias("place"))


@query("p23_p24_node_names", """
SELECT jobid AS "JobID", k % 5 < 3 AS valid, CASE k % 5 WHEN 0 THEN 'gpu' WHEN 1 THEN 'login' WHEN 2 THEN 'storage' WHEN 3 THEN 'cpu' ELSE 'gpu' END AS kind
FROM jobs""")
def p23(c: Context):
    n = (c.key % 100).cast("string")
    name = (F.when(c.key % 5 == 0, F.concat(F.lit("GPU-"), n)).when(c.key % 5 == 1, F.concat(F.lit("login_"), n))
            .when(c.key % 5 == 2, F.concat(F.lit("nas"), n)).when(c.key % 5 == 3, F.concat(n, F.lit("-9")))
            .otherwise(F.concat(F.lit("gpu["), n)))
    return c.jobs.select("JobID", N.valid_node(name).alias("valid"), N.node_type(name).alias("kind"))


@query("p25_labels", """
SELECT DISTINCT account AS "Account", upper(split_part(account, '-', 4)) AS short_name, upper(part[1]) || part[2:] || ' Partition' AS title FROM jobs""")
def p25(c: Context):
    return c.jobs.select("Account", X.account_short_name("Account").alias("short_name"), X.partition_title("Partition").alias("title")).distinct()


# Records and the store -----------------------------------------------------------------------------


def _json_records(c: Context) -> str:
    """Uploaded records as JSON lines; some lack the fields that have defaults."""
    iso = lambda t: F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss")
    rows = c.jobs.select(
        "JobID", "User", "Account", "Partition", "State", "QOS", iso("Submit").alias("Submit"), iso("Start").alias("Start"),
        iso("End").alias("End"), "CPUHours", F.when(c.key % 4 == 0, F.col("GPUHours")).alias("GPUHours"),
        F.col("CPUs").alias("AllocCPUS"), F.when(c.key % 4 == 0, F.col("GPUs")).alias("AllocGPUS"),
        F.col("Nodes").alias("AllocNodes"), "NodeList")
    path = c.scratch("records")
    rows.write.option("compression", "gzip").json(path)
    return path


@query("s07_read_records", """
SELECT jobid AS "JobID", usr AS "User", qos AS "QOS", round(cpu_h, 6) AS "CPUHours", round(gpu_h, 6) AS "GPUHours", gpus AS "AllocGPUS",
  nodelist AS "NodeList" FROM jobs""")
def s07(c: Context):
    return S.read_records(c.spark, _json_records(c)).select("JobID", "User", "QOS", "CPUHours", "GPUHours", "AllocGPUS", "NodeList")


def _odd_records(c: Context) -> str:
    """Records of which some lines are cut off and some lack a required field."""
    whole = c.jobs.select(F.to_json(F.struct(
        F.when(c.key % 7 != 0, F.col("JobID")).alias("JobID"), "User", "Account", "Partition", "State",
        F.when(c.key % 5 != 0, F.date_format("Submit", "yyyy-MM-dd'T'HH:mm:ss")).alias("Submit"))).alias("value"), c.key.alias("k"))
    path = c.scratch("odd-records")
    whole.select(F.when(F.col("k") % 11 == 0, F.left("value", F.lit(20))).otherwise(F.col("value")).alias("value")).write.text(path)
    return path


@query("s07_odd_records", """
SELECT CASE WHEN k % 11 = 0 THEN 'broken line' WHEN k % 7 = 0 THEN 'no JobID' WHEN k % 5 = 0 THEN 'no Submit' ELSE 'taken' END AS reason,
  count(*) AS records FROM jobs GROUP BY ALL""")
def s07_odd(c: Context):
    path = _odd_records(c)
    taken = S.read_records(c.spark, path).select(F.lit("taken").alias("reason"), "JobID")
    return taken.unionByName(S.rejected_records(c.spark, path).select("reason", "JobID")).groupBy("reason").agg(F.count("*").alias("records"))


@query("s23_normalize_records", """
SELECT 'main' AS cluster, jobid AS "JobID", submit AS "Submit", start_ AS "Start", cpus AS "CPUs", gpus AS "GPUs", nodes AS "Nodes",
  round(wait_h, 6) AS "WaitingTimeHours", round(el_h, 6) AS "ElapsedHours", round(gpu_h, 6) AS "GPUHours", sday AS "SubmitDay", sweek AS "SubmitWeek",
  smonth AS "SubmitMonth", syear AS "SubmitYear", tmonth AS "StartMonth", tyear AS "StartYear",
  (SELECT coalesce(string_agg(node, '|' ORDER BY node), '') FROM node_lists n WHERE n.nodelist = jobs.nodelist) AS "NodeList" FROM jobs""")
def s23(c: Context):
    return S.normalize_records(S.read_records(c.spark, _json_records(c)), "main").select(
        "cluster", "JobID", "Submit", "Start", "CPUs", "GPUs", "Nodes", "WaitingTimeHours", "ElapsedHours", "GPUHours", "SubmitDay",
        "SubmitWeek", "SubmitMonth", "SubmitYear", "StartMonth", "StartYear", "NodeList")


def _loads(c: Context):
    """Two loads: all jobs, then every tenth again with another state, some of them submitted 40 days later."""
    first = c.records.withColumn("State", X.job_state("RawState")).drop("RawState").withColumn("ingest_seq", F.lit(1).cast("long"))
    again = first.where(c.key % 10 == 0).withColumns({"State": F.lit("TIMEOUT"), "ingest_seq": F.lit(2).cast("long")})
    later = F.col("Submit") + F.expr("interval 40 days")
    again = again.withColumn("Submit", F.when(c.key % 50 == 0, later).otherwise(F.col("Submit")))
    return first, again


_LOADS_SQL = """
, l AS (SELECT cluster, jobid, state, submit, 1 AS seq FROM jobs UNION ALL
  SELECT cluster, jobid, 'TIMEOUT', CASE WHEN k % 50 = 0 THEN submit + INTERVAL 40 DAY ELSE submit END, 2 FROM jobs WHERE k % 10 = 0),
kept AS (SELECT *, row_number() OVER (PARTITION BY cluster, year(submit), jobid ORDER BY seq DESC) AS r FROM l)
"""
_KEPT_SQL = _LOADS_SQL + """SELECT cluster, jobid AS "JobID", state AS "State", submit AS "Submit",
  CAST(date_trunc('month', submit) AS DATE) AS "SubmitMonth" FROM kept WHERE r = 1"""
_KEPT = ["cluster", "JobID", "State", "Submit", "SubmitMonth"]


@query("s09_upsert", _KEPT_SQL)
def s09(c: Context):
    path = c.scratch("store")
    for load in _loads(c):
        O.upsert_jobs(S.normalize_records(load), path)
    return O.read_store(c.spark, path).select(*_KEPT)


_LAST_SQL = """
SELECT jobid AS "JobID", CASE WHEN k % 2 = 0 THEN 'COMPLETED' ELSE 'RUNNING' END AS "State", round(cpu_h, 6) AS "CPUHours" FROM jobs"""


def _twice(c: Context, order: str):
    """Uploaded records that name each job as running and as completed; even jobs complete last, the others are sent in the other order.

    ``order`` is 'line': both in one file, or 'file': the later ones in files of their own.
    """
    rows = c.spark.read.json(_json_records(c))
    even = rows["JobID"].cast("long") % 2 == 0
    first, last = [rows.withColumn("State", F.when(even, a).otherwise(b)) for a, b in (("RUNNING", "COMPLETED"), ("COMPLETED", "RUNNING"))]
    path = c.scratch("twice")
    if order == "line":
        both = lambda state: F.struct(*[F.lit(state).alias("State") if n == "State" else F.col(n) for n in rows.columns])
        pair = F.when(even, F.array(both("RUNNING"), both("COMPLETED"))).otherwise(F.array(both("COMPLETED"), both("RUNNING")))
        rows.select(F.inline(pair)).write.option("compression", "gzip").json(path)
    else:
        first.write.option("compression", "gzip").json(path)
        last.write.mode("append").option("compression", "gzip").json(path)
    return S.normalize_records(S.read_records(c.spark, path), "main")


@query("s09_last_line_of_a_load", _LAST_SQL)
def s09_last_line(c: Context):
    path = c.scratch("store")
    O.upsert_jobs(_twice(c, "line"), path)
    return O.read_store(c.spark, path).select("JobID", "State", "CPUHours")


@query("s10_compact_last_file", _LAST_SQL)
def s10_last_file(c: Context):
    path = c.scratch("store")
    O.compact(c.spark, _twice(c, "file"), path)
    return O.read_store(c.spark, path).select("JobID", "State", "CPUHours")


@query("w02_last_line", _LAST_SQL)
def w02_last_line(c: Context):
    return keep_last(_twice(c, "line")).select("JobID", "State", "CPUHours")


@query("s10_compact", _KEPT_SQL)
def s10(c: Context):
    path = c.scratch("store")
    first, again = _loads(c)
    O.compact(c.spark, S.normalize_records(again.unionByName(first)), path)
    return O.read_store(c.spark, path).select(*_KEPT)


@query("s10_file_years", """
, n AS (SELECT k % 37 AS file, syear AS year, count(*) AS n FROM jobs GROUP BY ALL)
SELECT file, CAST(year AS INT) AS year FROM n QUALIFY row_number() OVER (PARTITION BY file ORDER BY n DESC, year) = 1""")
def s10_years(c: Context):
    return O.file_years(c.jobs.withColumn("file", c.key % 37), "file")


@query("w02_dedup", """
, l AS (SELECT cluster, jobid, state, 1 AS seq FROM jobs UNION ALL SELECT cluster, jobid, 'TIMEOUT', 2 FROM jobs WHERE k % 10 = 0)
SELECT cluster, jobid AS "JobID", state AS "State" FROM l QUALIFY row_number() OVER (PARTITION BY cluster, jobid ORDER BY seq DESC) = 1""")
def w02(c: Context):
    first, again = _loads(c)
    return keep_last(first.unionByName(again)).select("cluster", "JobID", "State")


@query("s11_write_weekly", """
SELECT CAST(isoyear(submit) AS INT) AS iso_year, CAST(weekofyear(submit) AS INT) AS iso_week, count(*) AS jobs FROM jobs GROUP BY ALL""")
def s11(c: Context):
    path = c.scratch("weekly")
    O.write_weekly(c.jobs, path)
    return c.spark.read.parquet(path).groupBy("iso_year", "iso_week").agg(F.count("*").alias("jobs"))


@query("s11_write_weekly_by_cluster", """
SELECT cluster, CAST(isoyear(submit) AS INT) AS iso_year, CAST(weekofyear(submit) AS INT) AS iso_week, count(*) AS jobs FROM jobs GROUP BY ALL""")
def s11_clusters(c: Context):
    """Clusters are written one after the other, the last one twice; each leaves the weeks of the others alone."""
    path = c.scratch("weekly")
    for name in ("africa", "america", "asia", "europe", "middle_east", "middle_east"):
        O.write_weekly(c.jobs.where(F.col("cluster") == name), path)
    return c.spark.read.parquet(path).groupBy("cluster", "iso_year", "iso_week").agg(F.count("*").alias("jobs"))


@query("s12_retention_dry_run", """
SELECT cluster, syear AS "SubmitYear", sweek AS "SubmitWeek", count(*) AS jobs, round(sum(cpu_h), 4) AS cpu_hours FROM jobs
WHERE submit < DATE '2000-06-30' - 540 GROUP BY ALL""")
def s12(c: Context):
    return coarse(O.retention_plan(c.jobs, 18, "2000-06-30"), "cpu_hours")


@query("s12_retention_applied", """
SELECT cluster, jobid AS "JobID", submit AS "Submit" FROM jobs WHERE submit >= DATE '2000-06-30' - 540""")
def s12_apply(c: Context):
    path = c.scratch("store")
    O.write_store(S.conform(S.with_node_array(c.jobs)), path)
    return O.apply_retention(c.spark, path, 18, "2000-06-30").select("cluster", "JobID", "Submit")


@query("s13_diff_loads", """
SELECT cluster, CASE WHEN k % 12 = 5 THEN jobid || 'n' ELSE jobid END AS "JobID",
  CASE WHEN k % 12 = 5 THEN 'new' WHEN k % 12 = 7 THEN 'deleted' ELSE 'modified' END AS change FROM jobs WHERE k % 12 IN (5, 7, 9)
UNION ALL SELECT cluster, jobid, 'deleted' FROM jobs WHERE k % 12 = 5""")
def s13(c: Context):
    new = c.jobs.where(c.key % 12 != 7).withColumns({
        "State": F.when(c.key % 12 == 9, "TIMEOUT").otherwise(F.col("State")),
        "JobID": F.when(c.key % 12 == 5, F.concat("JobID", F.lit("n"))).otherwise(F.col("JobID"))})
    return O.diff_loads(c.jobs, new)


@query("s14_missing_weeks", """
, w AS (SELECT CAST(unnest(generate_series(DATE '1994-10-31', DATE '2002-03-25', INTERVAL 7 DAY)) AS DATE) AS week)
SELECT week, CAST(isoyear(week) AS INT) AS iso_year, CAST(weekofyear(week) AS INT) AS iso_week FROM w
WHERE week NOT IN (SELECT sweek FROM jobs)""")
def s14(c: Context):
    return O.missing_weeks(c.jobs, "1994-11-02", "2002-03-31")


@query("s16_submission_stats", """
, a AS (SELECT cluster, sday, max(submit) AS ts, count(*) AS n FROM jobs GROUP BY ALL)
SELECT cluster, max(ts) AS last_submission, CAST(sum(n) AS BIGINT) AS total_jobs FROM a GROUP BY cluster""")
def s16(c: Context):
    audit = c.jobs.groupBy("cluster", "SubmitDay").agg(F.max("Submit").alias("ingest_ts"), F.count("*").alias("n_jobs"))
    return O.submission_stats(audit)


# Streams -------------------------------------------------------------------------------------------


def _polls(c: Context):
    """Every job at each six-hourly poll between its submit and its start."""
    step = 6 * 3600
    at = lambda secs: F.timestamp_seconds(secs)
    first = F.ceil(F.unix_timestamp("Submit") / step) * step
    last = F.floor((F.unix_timestamp("Start") - 1) / step) * step
    pending = c.jobs.withColumns({"_a": first, "_b": last}).where(F.col("_a") <= F.col("_b"))
    polls = F.sequence(F.col("_a"), F.col("_b"), F.lit(step).cast("long"))
    array_id = F.when(c.key % 3 == 0, F.concat("JobID", F.lit("_"), (c.key % 10).cast("string"))).otherwise(F.col("JobID"))
    return pending.select(F.explode(polls).alias("_t"), array_id.alias("JobID"), "Submit", "User").select(
        at(F.col("_t")).alias("snapshot_ts"), "JobID", "Submit", "User", F.lit(None).cast("timestamp").alias("previous_ts"))


def _every_poll(polls):
    """Markers for a poll each six hours, whether something was pending or not, until two days after the last job."""
    step = F.expr("interval 6 hours")
    times = polls.agg(F.min("snapshot_ts").alias("a"), (F.max("snapshot_ts") + F.expr("interval 2 days")).alias("b"))
    return G.poll_markers(times.select(F.explode(F.sequence("a", "b", step)).alias("snapshot_ts")))


_POLLS_SQL = """
, p AS (SELECT jobid, usr, submit, k, CAST(ceil(epoch(submit) / 21600) * 21600 AS BIGINT) AS a,
  CAST(floor((epoch(start_) - 1) / 21600) * 21600 AS BIGINT) AS b FROM jobs WHERE start_ IS NOT NULL),
s AS (SELECT jobid, usr, submit, k, unnest(generate_series(a, b, 21600)) AS t FROM p WHERE a <= b),
polls AS (SELECT t, lead(t) OVER (ORDER BY t) AS nxt FROM (SELECT DISTINCT t FROM s)),
gone AS (SELECT s.*, nxt FROM s JOIN polls USING (t) WHERE nxt IS NOT NULL
  AND NOT EXISTS (SELECT 1 FROM p WHERE p.jobid = s.jobid AND nxt BETWEEN p.a AND p.b))
"""
_WAITS_SQL = _POLLS_SQL + """
SELECT jobid AS "JobID", CASE WHEN k % 3 = 0 THEN CAST(k % 10 AS VARCHAR) ELSE '' END AS "TaskIndex", usr AS "User",
  CAST(nxt - epoch(submit) AS BIGINT) AS waiting_seconds FROM gone"""


@query("t01_queue_waits", _WAITS_SQL)
def t01(c: Context):
    return G.queue_waits(_polls(c)).drop("seen_gone")


@query("t01_queue_counts", _POLLS_SQL + """
, first AS (SELECT jobid, min(t) AS t FROM s GROUP BY jobid)
SELECT make_timestamp(polls.t * 1000000) AS snapshot_ts, (SELECT count(*) FROM s WHERE s.t = polls.t) AS waiting,
  (SELECT count(*) FROM first WHERE first.t = polls.t) AS new, (SELECT count(*) FROM gone WHERE gone.nxt = polls.t) AS started FROM polls""")
def t01_counts(c: Context):
    return G.queue_counts(_polls(c))


@query("t01_queue_stream", _WAITS_SQL)
def t01_stream(c: Context):
    polls = _polls(c)
    return _monitored(c, polls, G.poll_markers(polls.select("snapshot_ts")))


def _monitored(c: Context, polls, markers):
    """Polls as files cut without regard to polls, each a batch of its own, with a restart of the stream before the last two."""
    source, out, cuts = c.scratch("polls"), c.scratch("queue"), c.scratch("cuts")
    rows = polls.unionByName(markers).repartitionByRange(4, "snapshot_ts", "JobID")
    rows.withColumn("cut", F.spark_partition_id()).write.partitionBy("cut").parquet(cuts)
    end = rows.agg((F.max("snapshot_ts") + F.expr("interval 1 day")).alias("snapshot_ts"))
    null = lambda name: F.lit(None).cast(G.SNAPSHOT[name].dataType).alias(name)
    end = end.select("snapshot_ts", *[null(name) for name in G.SNAPSHOT.fieldNames()[1:]])
    files = [c.spark.read.schema(G.SNAPSHOT).parquet(f"{cuts}/cut={k}") for k in range(4)] + [end]
    for k, part in enumerate(files):
        part.coalesce(1).write.mode("append").parquet(source)
        if k in (2, 4):
            stream = c.spark.readStream.schema(G.SNAPSHOT).option("maxFilesPerTrigger", 1).parquet(source)
            G.start_queue_monitor(stream, out, f"{out}/checkpoint", once=True).awaitTermination()
    return G.read_waits(c.spark, out).drop("seen_gone")


_EVERY_POLL_SQL = _POLLS_SQL + """
, grid AS (SELECT unnest(generate_series(lo, hi, 21600)) AS t FROM (SELECT min(t) AS lo, max(t) + 172800 AS hi FROM s))
"""
_ALL_WAITS_SQL = _POLLS_SQL + """
SELECT jobid AS "JobID", CASE WHEN k % 3 = 0 THEN CAST(k % 10 AS VARCHAR) ELSE '' END AS "TaskIndex", usr AS "User",
  CAST(b + 21600 - epoch(submit) AS BIGINT) AS waiting_seconds FROM p WHERE a <= b"""


@query("t01_queue_waits_empty_polls", _ALL_WAITS_SQL)
def t01_empty(c: Context):
    polls = _polls(c)
    return G.queue_waits(polls.unionByName(_every_poll(polls))).drop("seen_gone")


@query("t01_queue_stream_empty_polls", _ALL_WAITS_SQL)
def t01_stream_empty(c: Context):
    polls = _polls(c)
    return _monitored(c, polls, _every_poll(polls))


@query("t01_queue_counts_empty_polls", _EVERY_POLL_SQL + """
SELECT make_timestamp(grid.t * 1000000) AS snapshot_ts, (SELECT count(*) FROM s WHERE s.t = grid.t) AS waiting,
  (SELECT count(*) FROM p WHERE a <= b AND a = grid.t) AS new, (SELECT count(*) FROM p WHERE a <= b AND b + 21600 = grid.t) AS started FROM grid""")
def t01_counts_empty(c: Context):
    polls = _polls(c)
    return G.queue_counts(polls.unionByName(_every_poll(polls)))


@query("t02_ingest_stream", _KEPT_SQL)
def t02(c: Context):
    source, path = c.scratch("loads"), c.scratch("store")
    first, again = _loads(c)
    schema = first.schema
    for load in (first, again):
        load.write.mode("append").parquet(source)
        stream = I.record_stream(c.spark, source, schema)
        I.start_ingest(stream, path, f"{path}-checkpoint", once=True).awaitTermination()
    return O.read_store(c.spark, path).select(*_KEPT)


@query("t02_ingest_stream_one_batch", _KEPT_SQL)
def t02_one_batch(c: Context):
    """Both loads come in one micro-batch; nothing but the order of the files tells which records are newer."""
    source, path = c.scratch("loads"), c.scratch("store")
    for load in _loads(c):
        load.drop("ingest_seq").write.mode("append").parquet(source)
    stream = I.record_stream(c.spark, source, load.drop("ingest_seq").schema)
    I.start_ingest(stream, path, f"{path}-checkpoint", once=True).awaitTermination()
    return O.read_store(c.spark, path).select(*_KEPT)


_RESENT_SQL = """
, l AS (SELECT cluster, jobid, state, submit, cpu_h, 1 AS seq FROM jobs UNION ALL
  SELECT cluster, jobid, 'TIMEOUT', CASE WHEN k % 50 = 0 THEN submit + INTERVAL 40 DAY ELSE submit END, coalesce(el_h, 0) * cpus, 2 FROM jobs WHERE k % 10 = 0),
kept AS (SELECT * FROM l QUALIFY row_number() OVER (PARTITION BY cluster, jobid ORDER BY seq DESC) = 1)
SELECT CAST(date_trunc('month', submit) AS DATE) AS period, state AS series, count(*) AS jobs, round(sum(cpu_h), 6) AS cpu_hours FROM kept GROUP BY ALL"""


@query("t03_live_totals_resent", _RESENT_SQL)
def t03_resent(c: Context):
    """Jobs sent again take back what they added before, some of them from another month and all from another state."""
    source, out = c.scratch("loads"), c.scratch("live")
    for load in _loads(c):
        load.drop("ingest_seq").write.mode("append").parquet(source)
        jobs = S.normalize_records(I.record_stream(c.spark, source, load.drop("ingest_seq").schema))
        V.start_live_totals(jobs, f"{out}/totals", f"{out}/checkpoint", "month", "State", once=True).awaitTermination()
    return V.read_live_totals(c.spark, f"{out}/totals", "State")


@query("t03_live_totals_resent_as_batch", _RESENT_SQL)
def t03_resent_batch(c: Context):
    first, again = _loads(c)
    return V.live_totals(S.normalize_records(first.unionByName(again)), "month", "State")


_LIVE_SQL = """
SELECT CAST(date_trunc('day', ts) AS DATE) AS period, event_type AS series, count(*) AS jobs, round(sum(value), 6) AS cpu_hours
FROM events GROUP BY ALL"""


def _event_jobs(df):
    return df.select(F.col("ts").cast("timestamp").alias("Submit"), F.col("event_type").alias("State"), F.col("value").alias("CPUHours"))


@query("t03_live_totals", _LIVE_SQL, jobs=False)
def t03(c: Context):
    out = c.scratch("live")
    stream = c.stream("events")
    V.start_live_totals(_event_jobs(stream), f"{out}/totals", f"{out}/checkpoint", "day", "State", once=True).awaitTermination()
    return V.read_live_totals(c.spark, f"{out}/totals", "State")


@query("t03_live_totals_as_batch", _LIVE_SQL, jobs=False)
def t03_batch(c: Context):
    return V.live_totals(_event_jobs(c.table("events")), "day", "State")
