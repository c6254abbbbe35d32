"""Reports, their comparisons and the dashboard bundle."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from jobmeter.operators.windows import align_previous, cumulative, peaks
from jobmeter.plans import dashboard as P
from jobmeter.plans import reports as R
from jobmeter.plans.export import export_report

from .base import Context, query
from .measures import coarse

_FOUR = """count(*) AS jobs, round(sum(cpu_h), 4) AS cpu_hours, round(sum(gpu_h), 4) AS gpu_hours,
  count(DISTINCT usr) AS users"""
_YEAR = "submit >= DATE '1997-01-01' AND submit < DATE '1998-01-01'"
_QUARTER = "submit >= DATE '1997-04-01' AND submit < DATE '1997-07-01'"
_MONTH = "submit >= DATE '1997-05-01' AND submit < DATE '1997-06-01'"
HOURS = ("cpu_hours", "gpu_hours")
MEANS = ("avg_duration", "avg_wait")  # like totals, they show the order of summation where 6 digits are compared

_SUMMARY = f"""{_FOUR}, count(*) FILTER (WHERE state = 'COMPLETED') AS completed_jobs,
  count(*) FILTER (WHERE state IN ('FAILED', 'TIMEOUT', 'CANCELLED')) AS failed_jobs,
  round(count(*) FILTER (WHERE state = 'COMPLETED') * 100.0 / count(*) FILTER (WHERE state IN ('COMPLETED', 'FAILED',
    'TIMEOUT', 'CANCELLED')), 6) AS success_rate,
  round(avg(el_h), 4) AS avg_duration, round(quantile_cont(el_h, 0.5), 6) AS median_duration,
  round(avg(wait_h), 4) AS avg_wait, round(quantile_cont(wait_h, 0.5), 6) AS median_wait"""


@query("r01_report_summary", f"SELECT {_SUMMARY} FROM jobs WHERE {_YEAR}")
def r01(c: Context):
    return coarse(R.report(c.jobs, "annual", 1997)["summary"], *HOURS, *MEANS)


@query("r01_summary_of_every_month", f"SELECT smonth AS \"SubmitMonth\", {_SUMMARY} FROM jobs GROUP BY smonth")
def r01_months(c: Context):
    return coarse(R.report_summary(c.jobs, ["SubmitMonth"]), *HOURS, *MEANS)


@query("p30_state_class", """
SELECT state AS "State", CASE state WHEN 'COMPLETED' THEN 'completed' ELSE 'failed' END AS class, count(*) AS jobs
FROM jobs GROUP BY ALL""")
def p30(c: Context):
    from jobmeter.functions.text import state_class
    return c.jobs.groupBy("State", state_class("State").alias("class")).agg(F.count("*").alias("jobs"))


@query("r02_by_account", f"SELECT account AS \"Account\", {_FOUR} FROM jobs WHERE {_QUARTER} GROUP BY account")
def r02(c: Context):
    return coarse(R.report(c.jobs, "quarterly", 1997, 2)["by_account"], *HOURS)


@query("r02_by_partition", f"SELECT part AS \"Partition\", {_FOUR} FROM jobs GROUP BY part")
def r02_partition(c: Context):
    return coarse(R.report_breakdown(c.jobs, "Partition"), *HOURS)


@query("r03_by_state", f"""
SELECT state AS "State", count(*) AS jobs, round(count(*) * 100.0 / (SELECT count(*) FROM jobs WHERE {_MONTH}), 6) AS percent
FROM jobs WHERE {_MONTH} GROUP BY state""")
def r03(c: Context):
    return R.report(c.jobs, "monthly", 1997, 5)["by_state"]


@query("r04_timeline_monthly", f"SELECT sday AS date, {_FOUR} FROM jobs WHERE {_MONTH} GROUP BY sday")
def r04(c: Context):
    return coarse(R.report(c.jobs, "monthly", 1997, 5)["timeline"], *HOURS)


@query("r04_timeline_quarterly", f"SELECT sweek AS date, {_FOUR} FROM jobs WHERE {_QUARTER} GROUP BY sweek")
def r04_quarter(c: Context):
    return coarse(R.report(c.jobs, "quarterly", 1997, 2)["timeline"], *HOURS)


@query("r04_timeline_annual_all_clusters", f"SELECT cluster, smonth AS date, {_FOUR} FROM jobs GROUP BY ALL")
def r04_year(c: Context):
    return coarse(R.report_timeline(c.jobs, "annual", ["cluster"]), *HOURS)


def _change(m: str) -> str:
    return (f"round(CASE WHEN p.{m} > 0 THEN (c.{m} - p.{m}) * 1.0 / p.{m} * 100 WHEN c.{m} > 0 THEN 100.0 ELSE 0.0 END, 1) "
            f"AS {m}_change_percent")


_METRICS = ("jobs", "cpu_hours", "gpu_hours", "users")
_BOTH = ", ".join([f"c.{m}, p.{m} AS previous_{m}, {_change(m)}" for m in _METRICS])


@query("r05_comparison", f"""
, c AS (SELECT {_FOUR} FROM jobs WHERE {_YEAR}),
p AS (SELECT {_FOUR} FROM jobs WHERE submit >= DATE '1996-01-02' AND submit < DATE '1997-01-01')
SELECT {_BOTH} FROM c, p""")
def r05(c: Context):
    out = R.report_comparison(c.jobs, *R.report_range("annual", 1997))
    return coarse(out, *HOURS, "previous_cpu_hours", "previous_gpu_hours")


_CALENDAR = """
, cal AS (SELECT s AS start_date, CAST(s + INTERVAL {n} MONTH AS DATE) - 1 AS end_date FROM (SELECT CAST(unnest(generate_series(
  (SELECT date_trunc('{grain}', min(submit)) FROM jobs), (SELECT date_trunc('{grain}', max(submit)) FROM jobs),
  INTERVAL {n} MONTH)) AS DATE) AS s)),
cal2 AS (SELECT *, start_date - 1 - CAST(end_date - start_date AS INT) AS previous_start, start_date - 1 AS previous_end FROM cal)
"""


@query("p31_report_calendar", _CALENDAR.format(grain="quarter", n=3) + """
SELECT start_date, CAST(end_date AS DATE) AS end_date, CAST(previous_start AS DATE) AS previous_start,
  CAST(previous_end AS DATE) AS previous_end FROM cal2""")
def p31(c: Context):
    return R.report_calendar(c.jobs, "quarterly")


@query("r05_compare_every_month", _CALENDAR.format(grain="month", n=1) + f"""
, c AS (SELECT start_date, {_FOUR} FROM cal2 JOIN jobs ON sday BETWEEN start_date AND end_date GROUP BY ALL),
p AS (SELECT start_date, {_FOUR} FROM cal2 JOIN jobs ON sday BETWEEN previous_start AND previous_end GROUP BY ALL)
SELECT start_date, {_BOTH} FROM c JOIN p USING (start_date)""")
def r05_all(c: Context):
    return coarse(R.compare_periods(c.jobs, "monthly"), *HOURS, "previous_cpu_hours", "previous_gpu_hours")


def _compare_kind(grain: str, n: int) -> str:
    return _CALENDAR.format(grain=grain, n=n) + f"""
, c AS (SELECT start_date, {_FOUR} FROM cal2 JOIN jobs ON sday BETWEEN start_date AND end_date GROUP BY ALL),
p AS (SELECT start_date, {_FOUR} FROM cal2 JOIN jobs ON sday BETWEEN previous_start AND previous_end GROUP BY ALL)
SELECT start_date, c.jobs, p.jobs AS previous_jobs, {_change('jobs')}, {_change('users')} FROM c JOIN p USING (start_date)"""


@query("p27_change_by_quarter", _compare_kind("quarter", 3))
def p27(c: Context):
    return R.compare_periods(c.jobs, "quarterly").select(
        "start_date", "jobs", "previous_jobs", "jobs_change_percent", "users_change_percent")


@query("j08_align_previous", f"""
, c AS (SELECT sday AS date, {_FOUR}, row_number() OVER (ORDER BY sday) AS position FROM jobs WHERE {_MONTH} GROUP BY sday),
p AS (SELECT count(*) AS previous_jobs, round(sum(cpu_h), 4) AS previous_cpu_hours, row_number() OVER (ORDER BY sday) AS position
  FROM jobs WHERE submit >= DATE '1997-03-31' AND submit < DATE '1997-05-01' GROUP BY sday)
SELECT CAST(position AS INT) AS position, date, jobs, cpu_hours, previous_jobs, previous_cpu_hours FROM c LEFT JOIN p USING (position)""")
def j08(c: Context):
    r = R.report(c.jobs, "monthly", 1997, 5)
    out = align_previous(r["timeline"], r["previous_timeline"], ["jobs", "cpu_hours"])
    return coarse(out, "cpu_hours", "previous_cpu_hours")


@query("w03_cumulative", """
, t AS (SELECT cluster, sday AS date, sum(cpu_h) AS cpu, sum(gpu_h) AS gpu FROM jobs GROUP BY ALL)
SELECT cluster, date, round(sum(cpu) OVER w, 4) AS cumulative_cpu_hours, round(sum(gpu) OVER w, 4) AS cumulative_gpu_hours
FROM t WINDOW w AS (PARTITION BY cluster ORDER BY date)""")
def w03(c: Context):
    timeline = R.report_timeline(c.jobs, "monthly", ["cluster"])
    out = cumulative(timeline, ["cpu_hours", "gpu_hours"], by=["cluster"])
    return coarse(out.select("cluster", "date", "cumulative_cpu_hours", "cumulative_gpu_hours"),
                  "cumulative_cpu_hours", "cumulative_gpu_hours")


@query("w05_peaks", """
, t AS (SELECT cluster, sday AS date, count(*) AS jobs, sum(cpu_h) AS cpu FROM jobs GROUP BY ALL)
SELECT cluster, count(*) AS periods, max(jobs) AS peak_jobs, round(max(cpu), 4) AS peak_cpu_hours,
  (SELECT min(date) FROM t AS i WHERE i.cluster = t.cluster AND i.jobs = (SELECT max(jobs) FROM t AS j WHERE j.cluster = t.cluster))
    AS peak_jobs_date,
  (SELECT min(date) FROM t AS i WHERE i.cluster = t.cluster AND i.cpu = (SELECT max(cpu) FROM t AS j WHERE j.cluster = t.cluster))
    AS peak_cpu_hours_date, round(sum(jobs) / count(*), 6) AS mean_jobs, round(sum(cpu) / count(*), 4) AS mean_cpu_hours
FROM t GROUP BY cluster""")
def w05(c: Context):
    timeline = R.report_timeline(c.jobs, "monthly", ["cluster"])
    return coarse(peaks(timeline, ["jobs", "cpu_hours"], by=["cluster"]), "peak_cpu_hours", "mean_cpu_hours")


@query("r06_report", f"""
, s AS (SELECT * FROM jobs WHERE {_YEAR})
SELECT 'by_account' AS section, account AS key, {_FOUR} FROM s GROUP BY account
UNION ALL SELECT 'by_partition', part, {_FOUR} FROM s GROUP BY part
UNION ALL SELECT 'by_state', state, count(*), NULL, NULL, NULL FROM s GROUP BY state
UNION ALL SELECT 'timeline', CAST(smonth AS VARCHAR), {_FOUR} FROM s GROUP BY smonth
UNION ALL SELECT 'summary', 'all', {_FOUR} FROM s
UNION ALL SELECT 'previous_timeline', CAST(smonth AS VARCHAR), {_FOUR} FROM jobs
  WHERE submit >= DATE '1996-01-02' AND submit < DATE '1997-01-01' GROUP BY smonth""")
def r06(c: Context):
    return report_lines(R.report(c.jobs, "annual", 1997))


def report_lines(r: dict):
    """The tables of a report as one long table."""
    none = F.lit(None)
    key = {"by_account": "Account", "by_partition": "Partition", "by_state": "State", "timeline": "date",
           "previous_timeline": "date", "summary": None}
    out = None
    for name, k in key.items():
        df = r[name]
        col = lambda m, t: (F.col(m) if m in df.columns else none).cast(t).alias(m)
        part = df.select(F.lit(name).alias("section"), (F.col(k) if k else F.lit("all")).cast("string").alias("key"),
                         col("jobs", "long"), col("cpu_hours", "double"), col("gpu_hours", "double"), col("users", "long"))
        out = part if out is None else out.unionByName(part)
    return coarse(out, *HOURS)


def _lines(charts: dict, names: dict) -> object:
    """Charts as one long table (chart, x, series, value)."""
    out = None
    for name, (x, series, value) in names.items():
        df = charts[name]
        part = df.select(F.lit(name).alias("chart"), (F.col(x) if x else F.lit("")).cast("string").alias("x"),
                         (F.col(series) if series else F.lit("")).cast("string").alias("series"),
                         F.col(value).cast("double").alias("value"))
        out = part if out is None else out.unionByName(part)
    return out


_CHART_SQL = f"""
, d AS (SELECT * FROM jobs WHERE submit >= DATE '1996-01-01' AND submit < DATE '2000-01-01' AND part LIKE '%cpu%'),
groups AS (SELECT DISTINCT qos FROM d),
charts AS (
  SELECT 'cpu_usage_over_time' AS chart, CAST(p.tmonth AS VARCHAR) AS x, g.qos AS series, coalesce(sum(cpu_h), 0) AS value
    FROM (SELECT DISTINCT tmonth FROM d WHERE tmonth IS NOT NULL) p CROSS JOIN groups g LEFT JOIN d ON d.tmonth = p.tmonth AND d.qos = g.qos GROUP BY ALL
  UNION ALL SELECT 'gpu_usage_over_time', CAST(p.tmonth AS VARCHAR), g.qos, coalesce(sum(gpu_h), 0)
    FROM (SELECT DISTINCT tmonth FROM d WHERE tmonth IS NOT NULL) p CROSS JOIN groups g LEFT JOIN d ON d.tmonth = p.tmonth AND d.qos = g.qos GROUP BY ALL
  UNION ALL SELECT 'active_users_over_time', CAST(smonth AS VARCHAR), '', count(DISTINCT usr) FROM d GROUP BY ALL
  UNION ALL SELECT 'jobs_over_time', CAST(p.smonth AS VARCHAR), g.qos, count(k)
    FROM (SELECT DISTINCT smonth FROM d) p CROSS JOIN groups g LEFT JOIN d ON d.smonth = p.smonth AND d.qos = g.qos GROUP BY ALL
  UNION ALL SELECT 'total_hours', '', '', 1461 * 24.0
  UNION ALL SELECT 'summary', '', '', count(DISTINCT usr) FROM d
  UNION ALL SELECT 'gpus_per_job', CAST(gpus AS VARCHAR), '', count(*) FROM d WHERE gpus > 0 GROUP BY ALL
  UNION ALL SELECT 'gpu_hours_by_dimension', qos, '', sum(gpu_h) FROM d GROUP BY ALL
  UNION ALL SELECT 'waiting_times_hist', bin, '', n FROM (SELECT CASE WHEN h < 1 THEN 0 WHEN h < 4 THEN 1 WHEN h < 12 THEN 2 WHEN h < 24 THEN 3
    WHEN h < 72 THEN 4 WHEN h < 168 THEN 5 ELSE 6 END AS b, count(*) AS n FROM (SELECT wait_h AS h FROM d WHERE wait_h >= 0) GROUP BY ALL)
    RIGHT JOIN (SELECT unnest([0, 1, 2, 3, 4, 5, 6]) AS b, CAST(b AS VARCHAR) AS bin) USING (b)
  UNION ALL SELECT 'node_usage', node, qos, sum(cpu_h + gpu_h) FROM job_nodes WHERE k IN (SELECT k FROM d) GROUP BY ALL
  UNION ALL SELECT 'waiting_times_over_time', CAST(smonth AS VARCHAR), '', avg(wait_h) FROM d WHERE wait_h IS NOT NULL GROUP BY ALL
  UNION ALL SELECT 'job_duration_over_time', CAST(smonth AS VARCHAR), '', avg(el_h) FROM d WHERE el_h > 0 GROUP BY ALL
  UNION ALL SELECT 'jobs_by_partition', part, '', count(*) FROM d GROUP BY ALL
  UNION ALL SELECT 'jobs_by_state', state, '', count(*) FROM d GROUP BY ALL
  UNION ALL SELECT 'waiting_times_trends', CAST(tmonth AS VARCHAR), '', quantile_cont(wait_h, 0.95) FROM d WHERE wait_h IS NOT NULL GROUP BY ALL
  UNION ALL SELECT 'job_duration_trends', CAST(tmonth AS VARCHAR), '', quantile_cont(el_h, 0.95) FROM d WHERE el_h > 0 GROUP BY ALL
  UNION ALL SELECT 'cpus_per_job', CAST(cpus AS VARCHAR), '', count(*) FROM d GROUP BY ALL
  UNION ALL SELECT 'nodes_per_job', CAST(nodes AS VARCHAR), '', count(*) FROM d WHERE nodes > 0 GROUP BY ALL
  UNION ALL SELECT 'jobs_by_dimension', qos, '', count(*) FROM d GROUP BY ALL
  UNION ALL SELECT 'cpu_hours_by_dimension', qos, '', sum(cpu_h) FROM d GROUP BY ALL
  UNION ALL SELECT 'jobs_distribution', qos, '', count(*) FROM d GROUP BY ALL
  UNION ALL SELECT 'user_activity_frequency', qos, '', sum(n) FROM (SELECT qos, usr, count(DISTINCT smonth) AS n FROM d GROUP BY ALL) GROUP BY ALL)
SELECT chart, x, series, CASE WHEN chart LIKE '%trends' OR chart IN ('waiting_times_over_time', 'job_duration_over_time')
  THEN round(value, 9) ELSE round(coalesce(value, 0), 4) END AS value FROM charts"""


@query("r07_dashboard", _CHART_SQL, digits=9)
def r07(c: Context):
    shown = {
        "cpu_usage_over_time": ("period", "series", "value"), "gpu_usage_over_time": ("period", "series", "value"),
        "active_users_over_time": ("period", None, "value"), "jobs_over_time": ("period", "series", "value"),
        "waiting_times_over_time": ("period", None, "value"), "job_duration_over_time": ("period", None, "value"),
        "jobs_by_partition": ("label", None, "value"), "jobs_by_state": ("label", None, "value"),
        "waiting_times_trends": ("period", None, "p95"), "job_duration_trends": ("period", None, "p95"),
        "cpus_per_job": ("units", None, "jobs"), "nodes_per_job": ("units", None, "jobs"), "gpus_per_job": ("units", None, "jobs"),
        "total_hours": (None, None, "total_hours"), "summary": (None, None, "users"), "waiting_times_hist": ("bin", None, "count"),
        "gpu_hours_by_dimension": ("label", None, "value"), "node_usage": ("node", "series", "value"),
        "jobs_by_dimension": ("label", None, "value"), "cpu_hours_by_dimension": ("label", None, "value"),
        "jobs_distribution": ("label", None, "value"), "user_activity_frequency": ("label", None, "value")}
    charts = P.dashboard(c.jobs, "month", "QOS", charts=list(shown), start="1996-01-01", end="1999-12-31", partitions=["cpu"])
    # Nodes come by cluster and resource; the SQL has them by name.
    charts["node_usage"] = charts["node_usage"].groupBy("node", "series").agg(F.sum("value").alias("value"))
    lines = _lines(charts, shown)
    fine = F.col("chart").endswith("trends") | F.col("chart").isin("waiting_times_over_time", "job_duration_over_time")
    return lines.withColumn("value", F.when(fine, F.col("value")).otherwise(F.round("value", 4)))


@query("r08_available_periods", """
, d AS (SELECT cluster, min(submit) AS a, max(submit) AS b FROM jobs GROUP BY cluster),
m AS (SELECT cluster, 'month' AS grain, CAST(unnest(generate_series(date_trunc('month', a), date_trunc('month', b), INTERVAL 1 MONTH)) AS DATE) AS period FROM d
  UNION ALL SELECT cluster, 'year', CAST(unnest(generate_series(date_trunc('year', a), date_trunc('year', b), INTERVAL 1 YEAR)) AS DATE) FROM d)
SELECT cluster, grain, period, period < CASE grain WHEN 'month' THEN DATE '2001-06-01' ELSE DATE '2001-01-01' END AS complete FROM m""")
def r08(c: Context):
    return R.available_periods(c.jobs, dt.date(2001, 6, 15))


@query("s17_export_csv", f"""
SELECT account AS "Account", count(*) AS jobs, count(DISTINCT usr) AS users, round(sum(cpu_h), 4) AS cpu_hours
FROM jobs WHERE {_YEAR} GROUP BY account""")
def s17(c: Context):
    path = c.scratch("report")
    export_report(R.report(c.jobs, "annual", 1997), path, "csv")
    back = c.spark.read.schema("Account string, jobs long, cpu_hours double, gpu_hours double, users long") \
        .option("header", "true").csv(f"{path}/by_account")
    return coarse(back.drop("gpu_hours"), "cpu_hours")


@query("s17_export_json", f"""
SELECT state AS "State", count(*) AS jobs, round(count(*) * 100.0 / (SELECT count(*) FROM jobs WHERE {_YEAR}), 6) AS percent
FROM jobs WHERE {_YEAR} GROUP BY state""")
def s17_json(c: Context):
    path = c.scratch("report")
    export_report(R.report(c.jobs, "annual", 1997), path, "json")
    return c.spark.read.schema("State string, jobs long, percent double").json(f"{path}/by_state")
