"""Time the headline queries over stored jobs and print one JSON line.

The sample jobs are normalised and written to a partitioned job store (timed as ``ingest``); every query then reads that store.
Each query runs twice; the faster run counts.
"""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import functions as F

from jobmeter.operators import histograms as H
from jobmeter.operators import measures as M
from jobmeter.operators import metadata as D
from jobmeter.operators import nodes as N
from jobmeter.operators.cleaning import keep_last
from jobmeter.operators.filters import complete_only, filter_jobs
from jobmeter.plans import reports as R
from jobmeter.session import build_session, scratch_path
from jobmeter.functions.text import job_state
from jobmeter.sources.digests import read_digest
from jobmeter.sources.records import conform, with_hours, with_job_periods, with_node_array
from jobmeter.sources.sample import sample_records
from jobmeter.sources.store import build_digests, diff_loads, read_store, upsert_jobs, write_store

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
RUNS = 2


def main() -> None:
    spark = build_session("bench", f"local[{CPUS}]", spark__sql__shuffle__partitions=CPUS, spark__driver__memory="8g")
    spark.sparkContext.setLogLevel("ERROR")
    times = {}
    for run in range(RUNS):
        table = scratch_path(spark, "jobs")
        started = time.time()
        # The sample is one file and so one task; spread the raw records before the work on them.
        records = sample_records(spark, SF_DIR).repartition(int(CPUS)).withColumn("State", job_state("RawState"))
        jobs = conform(with_node_array(with_job_periods(with_hours(records))))
        write_store(jobs, table)
        spent = round(time.time() - started, 3)
        times["ingest"] = min(times.get("ingest", spent), spent)
    jobs = read_store(spark, table)
    batch = scratch_path(spark, "batch")
    jobs.where("SubmitMonth between '1997-01-01' and '1997-03-01'").withColumn("State", F.lit("TIMEOUT")).write.parquet(batch)
    months = spark.read.schema(jobs.schema).parquet(batch)
    year = {"start": "1997-01-01", "end": "1997-12-31"}
    digests = scratch_path(spark, "digests")
    started = time.time()
    build_digests(spark, table, digests)
    times["build_digests"] = round(time.time() - started, 3)
    digest = lambda name: read_digest(spark, digests, name)

    queries = {
        "summary": lambda: M.summary(jobs),
        "filter_one_year": lambda: M.summary(filter_jobs(jobs, **year, partitions=["cpu"], qos=["1-URGENT", "2-HIGH"])),
        "dimension_values": lambda: D.dimension_values(jobs),
        "cpu_usage_month": lambda: M.cpu_usage_over_time(jobs, "month"),
        "cpu_usage_day_by_account": lambda: M.cpu_usage_over_time(jobs, "day", "Account"),
        "active_users_week": lambda: M.active_users_over_time(jobs, "week"),
        "jobs_by_user_top": lambda: M.by_dimension(jobs, "User"),
        "wait_histogram": lambda: H.value_histogram(jobs, "WaitingTimeHours"),
        "wait_trends_month": lambda: H.trends(jobs, "WaitingTimeHours", "month"),
        "duration_stacked_month": lambda: H.job_duration_stacked(jobs, "month"),
        "jobs_per_user_histogram": lambda: H.jobs_per_user_histogram(jobs),
        "user_activity_days": lambda: H.activity_histogram(jobs, "day"),
        "activity_by_account": lambda: M.activity_by_group(jobs, "Account", "day"),
        "node_usage": lambda: N.node_usage(jobs),
        "report_summary_every_month": lambda: R.report_summary(jobs, ["SubmitMonth"]),
        "compare_every_month": lambda: R.compare_periods(jobs, "monthly"),
        "complete_months": lambda: M.summary(complete_only(jobs, "month", "1995-06-15")),
        "deduplicate": lambda: keep_last(jobs).groupBy("cluster").agg(F.count("*").alias("jobs")),
        "diff_loads": lambda: diff_loads(jobs, jobs.where("Submit < '2001-01-01'")).groupBy("change").count(),
        "digest_wait_trends_month": lambda: H.trends(digest("waiting"), "WaitingTimeHours", "month"),
        "digest_wait_histogram": lambda: H.value_histogram(digest("waiting"), "WaitingTimeHours"),
        "digest_user_activity_days": lambda: H.activity_histogram(digest("days"), "day"),
        "digest_dimension_values": lambda: D.dimension_values(digest("groups")),
        "digest_report_summary_every_month": lambda: R.report_summary(
            digest("groups"), ["SubmitMonth"], {"duration": digest("duration"), "wait": digest("waiting")}),
        # Last, because it replaces files that the others read.
        "upsert_three_months": lambda: upsert_jobs(months, table).groupBy("cluster").count(),
    }
    for name, build in queries.items():
        best = None
        for _ in range(RUNS):
            started = time.time()
            build().collect()
            spent = time.time() - started
            best = spent if best is None else min(best, spent)
        times[name] = round(best, 3)
    print(json.dumps({"metric": "total_query_time", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
                      "sf": os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf"), "cpus": int(CPUS), "runs": RUNS}))
    spark.stop()


if __name__ == "__main__":
    main()
