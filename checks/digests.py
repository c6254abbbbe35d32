"""Answers from the digests of a store against the SQL over the jobs themselves."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from jobmeter.functions.text import job_state
from jobmeter.functions import bins as B
from jobmeter.operators import filters as X
from jobmeter.operators import histograms as H
from jobmeter.operators import measures as M
from jobmeter.operators import metadata as D
from jobmeter.operators import nodes as N
from jobmeter.plans import dashboard as P
from jobmeter.plans import reports as R
from jobmeter.sources import digests as G
from jobmeter.sources import records as S
from jobmeter.sources import store as O

from .base import ORACLES, Context, query
from .distributions import _hist_sql, _trend_sql
from .measures import coarse
from .reports import HOURS, MEANS, report_lines

_BUILT: dict[tuple[str, str], tuple[str, str]] = {}


def stored(c: Context) -> tuple[str, str]:
    """Paths of a store of the sample jobs and of its digests, made by two upserts.

    A tenth of the jobs come first with another state and, most of them, in another month, and are then sent again as they are in the sample.
    """
    key = (c.spark.sparkContext.applicationId, c.sf_dir)
    if key not in _BUILT:
        store, digests = c.scratch("store"), c.scratch("digests")
        jobs = c.records.withColumn("State", job_state("RawState")).drop("RawState")
        again = c.key % 10 == 0
        moved = F.make_timestamp(F.year("Submit"), F.lit(1), F.lit(15), F.lit(0), F.lit(0), F.lit(0))
        first = jobs.withColumns({"State": F.when(again, "RUNNING").otherwise(F.col("State")), "Submit": F.when(again, moved).otherwise(F.col("Submit"))})
        O.upsert_jobs(S.normalize_records(first), store, digests)
        O.upsert_jobs(S.normalize_records(jobs.where(again)), store, digests)
        _BUILT[key] = store, digests
    return _BUILT[key]


def twin(of: str, digits: int = 6):
    """Registers ``<of>_from_digests``, which must give what query ``of`` gives."""
    def register(build):
        def run(c: Context):
            store, digests = stored(c)
            return build(lambda name, *span, **options: G.read_digest(c.spark, digests, name, *span, **options), c)

        query(f"{of}_from_digests", ORACLES[of], jobs=False, digits=digits)(run)
        return build

    return register


@query("s09_digests_follow_upserts", """
SELECT cluster, smonth AS "SubmitMonth", state AS "State", count(*) AS jobs, round(sum(cpu_h), 4) AS cpu_hours, min(submit) AS first,
  max(submit) AS last FROM jobs GROUP BY ALL""")
def s09_digests(c: Context):
    groups = G.read_digest(c.spark, stored(c)[1], "groups")
    return coarse(groups.groupBy("cluster", "SubmitMonth", "State").agg(
        F.sum("_jobs").alias("jobs"), F.sum("CPUHours").alias("cpu_hours"), F.min("_first").alias("first"), F.max("_last").alias("last")), "cpu_hours")


@query("h01_waiting_times_hist_any_range", _hist_sql(
    "wait_h", B.HISTOGRAM_BINS, "wait_h IS NOT NULL AND submit >= DATE '1996-03-15' AND submit < DATE '1998-05-21'"))
def h01_any_range(c: Context):
    """The whole months come from digests, parts of two months from the store."""
    store, digests = stored(c)
    rows = G.digest_range(O.read_store(c.spark, store), digests, "waiting", "1996-03-15", "1998-05-20")
    return H.value_histogram(rows, "WaitingTimeHours")


@query("a10_active_users_any_days_from_digests", """
SELECT sweek AS period, count(DISTINCT usr) AS value FROM jobs WHERE submit >= DATE '1996-03-15' AND submit < DATE '1998-05-21' GROUP BY ALL""")
def a10_days(c: Context):
    return M.active_users_over_time(G.read_digest(c.spark, stored(c)[1], "days", "1996-03-15", "1998-05-20"), "week")


@query("s13_diff_stores", """
SELECT cluster, CASE WHEN k % 12 = 5 THEN jobid || 'n' ELSE jobid END AS "JobID",
  CASE WHEN k % 12 = 5 THEN 'new' WHEN k % 12 = 7 THEN 'deleted' ELSE 'modified' END AS change FROM jobs
WHERE k % 12 IN (5, 7, 9) AND smonth = DATE '1997-03-01'
UNION ALL SELECT cluster, jobid, 'deleted' FROM jobs WHERE k % 12 = 5 AND smonth = DATE '1997-03-01'""")
def s13_stores(c: Context):
    """Two stores that differ in one month: its jobs only are read."""
    store, digests = stored(c)
    other, other_digests = c.scratch("store"), c.scratch("digests")
    table = O.read_store(c.spark, store)
    march = F.col("SubmitMonth") == F.lit("1997-03-01").cast("date")
    new = table.where(~(march & (c.key % 12 == 7))).withColumns({
        "State": F.when(march & (c.key % 12 == 9), "TIMEOUT").otherwise(F.col("State")),
        "JobID": F.when(march & (c.key % 12 == 5), F.concat("JobID", F.lit("n"))).otherwise(F.col("JobID"))})
    O.write_store(new, other, gathered=True)
    O.build_digests(c.spark, other, other_digests)
    return O.diff_stores(c.spark, store, digests, other, other_digests)


@twin("h01_job_duration_hist")
def h01_duration(read, c):
    return H.value_histogram(read("duration"), "ElapsedHours", positive=True)


@twin("h05_job_duration_trends", digits=9)
def h05(read, c):
    return H.trends(read("duration"), "ElapsedHours", "month", positive=True)


@twin("r01_report_summary")
def r01(read, c):
    return coarse(R.digest_report(c.spark, stored(c)[1], "annual", 1997)["summary"], *HOURS, *MEANS)


@twin("r01_summary_of_every_month")
def r01_months(read, c):
    values = {"duration": read("duration"), "wait": read("waiting")}
    return coarse(R.report_summary(read("groups"), ["SubmitMonth"], values), *HOURS, *MEANS)


@twin("r06_report")
def r06(read, c):
    return report_lines(R.digest_report(c.spark, stored(c)[1], "annual", 1997))


@twin("r05_compare_every_month")
def r05(read, c):
    return coarse(R.compare_periods(read("days"), "monthly"), *HOURS, "previous_cpu_hours", "previous_gpu_hours")


@twin("r08_available_periods")
def r08(read, c):
    return R.available_periods(read("groups"), dt.date(2001, 6, 15))


@twin("r09_metadata")
def r09(read, c):
    return P.digest_metadata(c.spark, stored(c)[1], "1998-01-01", "1998-12-31")


@twin("a01_date_range")
def a01(read, c):
    return D.date_range(read("groups"))


@twin("a02_dimension_values")
def a02(read, c):
    return D.dimension_values(read("groups"))


@twin("a04_distinct_nodes")
def a04(read, c):
    return D.distinct_nodes(read("lists"), by=["cluster"])


@twin("f11_search_counts")
def f11(read, c):
    return X.count_matches(read("groups"), "e")


@twin("a05_summary")
def a05(read, c):
    return coarse(M.summary(read("groups")), *HOURS)


@twin("a19_users_per_account")
def a19(read, c):
    return M.users_per_account(read("groups"))


@twin("h10_activity_days")
def h10(read, c):
    return H.activity_histogram(read("days"), "day")


@twin("a24_node_usage_by_cluster")
def a24(read, c):
    return coarse(N.node_usage(read("lists"), by_cluster=True), "value")
