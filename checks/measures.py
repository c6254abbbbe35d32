"""Filters, aggregates, top groups and shares."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from jobmeter.functions.text import account_prefix
from jobmeter.operators import filters as X
from jobmeter.operators import measures as M
from jobmeter.operators import metadata as D
from jobmeter.operators import topn as L
from jobmeter.operators import windows as W
from jobmeter.plans import dashboard as P

from .base import Context, query

# Filters -------------------------------------------------------------------------------------------


@query("f01_submit_range", """
SELECT jobid AS "JobID", submit AS "Submit" FROM jobs WHERE submit >= DATE '1996-02-01' AND submit < DATE '1999-07-01'""")
def f01(c: Context):
    return X.submit_between(c.jobs, "1996-02-01", "1999-06-30").select("JobID", "Submit")


@query("f02_partition_member", """
SELECT part AS "Partition", count(*) AS jobs FROM jobs
WHERE list_has_any(list_transform(string_split(part, ','), lambda p: trim(p)), ['long', 'short']) GROUP BY part""")
def f02(c: Context):
    return X.in_partitions(c.jobs, ["long", "short"]).groupBy("Partition").agg(F.count("*").alias("jobs"))


@query("f03_dimension_lists", """
SELECT account AS "Account", qos AS "QOS", state AS "State", count(*) AS jobs FROM jobs
WHERE account LIKE 'asia-%' AND account IN (SELECT DISTINCT account FROM jobs WHERE account LIKE '%-machinery-g1')
  AND qos IN ('1-URGENT', '2-HIGH') AND state IN ('COMPLETED', 'CANCELLED') GROUP BY ALL""")
def f03(c: Context):
    nations = [f"asia-nation_{i}-machinery-g1" for i in range(25)]
    df = X.filter_jobs(c.jobs, accounts=nations, qos=["1-URGENT", "2-HIGH"], states=["COMPLETED", "CANCELLED"])
    return df.groupBy("Account", "QOS", "State").agg(F.count("*").alias("jobs"))


@query("f04_complete_periods_only", """
SELECT 'month' AS grain, count(*) AS jobs FROM jobs WHERE smonth < DATE '2000-05-01'
UNION ALL SELECT 'week', count(*) FROM jobs WHERE sweek < DATE '2000-05-15'
UNION ALL SELECT 'year', count(*) FROM jobs WHERE syear < 2000
UNION ALL SELECT 'day', count(*) FROM jobs""")
def f04(c: Context):
    parts = [X.complete_only(c.jobs, g, "2000-05-17").agg(F.count("*").alias("jobs")).select(
        F.lit(g).alias("grain"), "jobs") for g in ("month", "week", "year", "day")]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query("f05_complete_period_list", """
SELECT DISTINCT sweek AS period FROM jobs WHERE sweek < DATE '2000-05-15'""")
def f05(c: Context):
    return X.complete_periods(c.jobs, "week", dt.date(2000, 5, 17))


@query("f06_null_and_positive", """
SELECT count(*) FILTER (WHERE wait_h IS NOT NULL) AS with_wait, count(*) FILTER (WHERE el_h > 0) AS with_time FROM jobs""")
def f06(c: Context):
    a = X.keep_values(c.jobs, "WaitingTimeHours").agg(F.count("*").alias("with_wait"))
    b = X.keep_values(c.jobs, "ElapsedHours", positive=True).agg(F.count("*").alias("n")).scalar()
    return a.withColumn("with_time", b)


@query("f11_search_values", """
, v AS (SELECT 'Account' AS dimension, account AS value FROM jobs UNION SELECT 'User', usr FROM jobs
  UNION SELECT 'QOS', qos FROM jobs UNION SELECT 'State', state FROM jobs
  UNION SELECT 'Partition', trim(unnest(string_split(part, ','))) FROM jobs)
SELECT dimension, value FROM v WHERE contains(lower(value), 'or') UNION SELECT 'QOS', '5-LOW'""")
def f11(c: Context):
    chosen = X.search_values(c.jobs, "5-low")
    return X.search_values(c.jobs, "OR", chosen)


@query("f11_search_counts", """
, v AS (SELECT 'Account' AS dimension, account AS value FROM jobs UNION SELECT 'User', usr FROM jobs
  UNION SELECT 'QOS', qos FROM jobs UNION SELECT 'State', state FROM jobs
  UNION SELECT 'Partition', trim(unnest(string_split(part, ','))) FROM jobs)
SELECT dimension, count(*) AS matches FROM v WHERE contains(lower(value), 'e') GROUP BY dimension""")
def f11_counts(c: Context):
    return X.count_matches(c.jobs, "e")


# Metadata and summaries ----------------------------------------------------------------------------


@query("a01_date_range", """
SELECT cluster, CAST(min(submit) AS DATE) AS min_date, CAST(max(submit) AS DATE) AS max_date FROM jobs GROUP BY cluster""")
def a01(c: Context):
    return D.date_range(c.jobs)


_VALUES = """
SELECT 'Account' AS dimension, account AS value FROM {t} UNION SELECT 'User', usr FROM {t}
UNION SELECT 'QOS', qos FROM {t} UNION SELECT 'State', state FROM {t}
UNION SELECT 'Partition', trim(unnest(string_split(part, ','))) FROM {t}"""


@query("a02_dimension_values", _VALUES.format(t="jobs"))
def a02(c: Context):
    return D.dimension_values(c.jobs)


@query("a03_dimension_values_in_range", """
, r AS (SELECT * FROM jobs WHERE submit >= DATE '1997-03-01' AND submit < DATE '1997-03-16')""" + _VALUES.format(t="r"))
def a03(c: Context):
    return D.dimension_values(X.submit_between(c.jobs, "1997-03-01", "1997-03-15"))


@query("a04_distinct_nodes", "SELECT DISTINCT cluster, node FROM job_nodes")
def a04(c: Context):
    return D.distinct_nodes(c.jobs, by=["cluster"])


_SUMMARY = """count(*) AS jobs, round(sum(cpu_h), 4) AS cpu_hours, round(sum(gpu_h), 4) AS gpu_hours,
  count(DISTINCT usr) AS users"""


def coarse(df, *columns):
    """Grand totals are compared to 4 digits: at 6 they would show the order of summation."""
    return df.withColumns({c: F.round(c, 4) for c in columns})


@query("a05_summary", f"SELECT {_SUMMARY} FROM jobs")
def a05(c: Context):
    return coarse(M.summary(c.jobs), "cpu_hours", "gpu_hours")


@query("a06_cluster_stats", f"""
SELECT cluster, {_SUMMARY}, array_to_string(list_sort(list(DISTINCT part)), '|') AS partitions FROM jobs GROUP BY cluster""")
def a06(c: Context):
    return coarse(M.cluster_stats(c.jobs), "cpu_hours", "gpu_hours")


# Timelines -----------------------------------------------------------------------------------------


def _timeline_sql(measure: str, period: str, series: str = "", where: str = "true") -> str:
    group = f"{series} AS series, " if series else ""
    return (f"SELECT {period} AS period, {group}{measure} AS value FROM jobs "
            f"WHERE {period} IS NOT NULL AND {where} GROUP BY ALL")


@query("a07_timeline_year_mean", _timeline_sql("round(avg(cpu_h), 6)", "make_date(tyear, 1, 1)", "qos"))
def a07(c: Context):
    return M.timeline(c.jobs, "CPUHours", "year", "mean", "Start", "QOS")


@query("a07_timeline_tuesday_weeks", """
SELECT CAST(date_trunc('week', start_ - INTERVAL 1 DAY) AS DATE) + 1 AS period, round(sum(cpu_h), 4) AS value
FROM jobs WHERE start_ IS NOT NULL GROUP BY ALL""")
def a07_tuesday(c: Context):
    return coarse(M.cpu_usage_over_time(c.jobs, "week", week_anchor="tuesday"), "value")


@query("a08_cpu_usage_month", _timeline_sql("round(sum(cpu_h), 4)", "tmonth"))
def a08(c: Context):
    return coarse(M.cpu_usage_over_time(c.jobs, "month"), "value")


@query("a08_cpu_usage_day_by_state", _timeline_sql("round(sum(cpu_h), 4)", "tday", "state"))
def a08_day(c: Context):
    return coarse(M.cpu_usage_over_time(c.jobs, "day", "State"), "value")


@query("a09_gpu_usage_week_by_partition", _timeline_sql("round(sum(gpu_h), 4)", "tweek", "part"))
def a09(c: Context):
    return coarse(M.gpu_usage_over_time(c.jobs, "week", "Partition"), "value")


@query("a10_active_users_month", _timeline_sql("count(DISTINCT usr)", "smonth"))
def a10(c: Context):
    return M.active_users_over_time(c.jobs, "month", "Partition")


@query("a10_active_users_week_by_account", _timeline_sql("count(DISTINCT usr)", "sweek", "account"))
def a10_account(c: Context):
    return M.active_users_over_time(c.jobs, "week", "Account")


@query("a11_jobs_day", _timeline_sql("count(*)", "sday"))
def a11(c: Context):
    return M.jobs_over_time(c.jobs, "day")


@query("a12_mean_wait_month", _timeline_sql("round(avg(wait_h), 6)", "smonth", where="wait_h IS NOT NULL"))
def a12(c: Context):
    return M.waiting_times_over_time(c.jobs, "month")


@query("a13_mean_duration_month_by_qos", _timeline_sql("round(avg(el_h), 6)", "smonth", "qos", "el_h > 0"))
def a13(c: Context):
    return M.job_duration_over_time(c.jobs, "month", "QOS")


@query("a14_series_order_users", """
SELECT account AS series, count(DISTINCT usr) AS score FROM jobs GROUP BY account""")
def a14(c: Context):
    return M.series_order(c.jobs, "User", "nunique", "Account")


@query("a14_series_order_mean", """
, p AS (SELECT smonth, qos, avg(wait_h) AS v FROM jobs WHERE wait_h IS NOT NULL GROUP BY ALL)
SELECT qos AS series, round(avg(v), 6) AS score FROM p GROUP BY qos""")
def a14_mean(c: Context):
    return M.series_order(c.jobs.where("WaitingTimeHours is not null"), "WaitingTimeHours", "mean", "QOS")


@query("a29_collapse_series", _timeline_sql("count(*)", "smonth"))
def a29(c: Context):
    return M.collapse_series(M.jobs_over_time(c.jobs, "month", "Account"))


@query("j07_dense_grid", """
, g AS (SELECT * FROM (SELECT DISTINCT smonth AS period FROM jobs), (SELECT DISTINCT account AS series FROM jobs)),
v AS (SELECT smonth AS period, account AS series, count(*) AS value FROM jobs GROUP BY ALL)
SELECT period, series, coalesce(value, 0) AS value FROM g LEFT JOIN v USING (period, series)""")
def j07(c: Context):
    return M.jobs_over_time(c.jobs, "month", "Account", dense=True)


# Totals by dimension -------------------------------------------------------------------------------


def _others_sql(measure: str, label: str, n: int, where: str = "true", unit: str = "", digits: str = "value") -> str:
    return f"""
, t AS (SELECT {label} AS label, {measure} AS value FROM jobs WHERE {where} GROUP BY {label}),
r AS (SELECT *, row_number() OVER (ORDER BY value DESC, label) AS rank FROM t)
SELECT CAST(rank AS INT) AS rank, label, {digits} AS value FROM r WHERE rank <= {n}
UNION ALL SELECT {n + 1}, 'Others (' || count(*) || '{unit})', {digits.replace('value', 'sum(value)')} FROM r
WHERE rank > {n} HAVING sum(value) > 0"""


def bigint(sql: str) -> str:
    return sql.replace("sum(value) FROM", "CAST(sum(value) AS BIGINT) FROM")


@query("a15_jobs_by_account_others", bigint(_others_sql("count(*)", "account", 10)))
def a15(c: Context):
    return M.by_dimension(c.jobs, "Account")


@query("a15_cpu_hours_by_user_others", _others_sql("sum(cpu_h)", "usr", 10, digits="round(value, 4)"))
def a15_user(c: Context):
    return coarse(M.by_dimension(c.jobs, "User", "CPUHours"), "value")


@query("a16_jobs_by_partition", """
SELECT part AS label, count(*) AS value FROM jobs GROUP BY part ORDER BY value DESC, label LIMIT 10""")
def a16(c: Context):
    return M.jobs_by(c.jobs, "Partition")


@query("a16_jobs_by_state", "SELECT state AS label, count(*) AS value FROM jobs GROUP BY state")
def a16_state(c: Context):
    return M.jobs_by(c.jobs, "State", None)


@query("a17_cpu_hours_by_account", """
SELECT account AS label, round(sum(cpu_h), 4) AS value FROM jobs GROUP BY account ORDER BY sum(cpu_h) DESC, label LIMIT 10""")
def a17(c: Context):
    return coarse(M.hours_by_account(c.jobs), "value")


@query("a17_gpu_hours_by_account", """
SELECT account AS label, round(sum(gpu_h), 4) AS value FROM jobs WHERE gpu_h > 0 GROUP BY account
ORDER BY sum(gpu_h) DESC, label LIMIT 10""")
def a17_gpu(c: Context):
    return coarse(M.hours_by_account(c.jobs, "GPUHours"), "value")


@query("a18_jobs_distribution_user", bigint(_others_sql("count(*)", "usr", 15)))
def a18(c: Context):
    return M.jobs_distribution(c.jobs, "User")


@query("a19_users_per_account", bigint(_others_sql("count(DISTINCT usr)", "account", 15)))
def a19(c: Context):
    return M.users_per_account(c.jobs)


@query("a20_periods_per_user", bigint(_others_sql("count(DISTINCT tmonth)", "usr", 15)))
def a20(c: Context):
    return M.periods_per_user(c.jobs, "month")


@query("a21_activity_by_account", """
, u AS (SELECT account, usr, count(DISTINCT sday) AS n FROM jobs GROUP BY ALL),
t AS (SELECT account AS label, CAST(sum(n) AS BIGINT) AS value FROM u GROUP BY account),
r AS (SELECT *, row_number() OVER (ORDER BY value DESC, label) AS rank FROM t),
o AS (SELECT CAST(rank AS INT) AS rank, label, value FROM r WHERE rank <= 15 UNION ALL
  SELECT 16, 'Others (' || count(*) || ' accounts)', CAST(sum(value) AS BIGINT) FROM r WHERE rank > 15 HAVING sum(value) > 0)
SELECT o.*, (SELECT count(DISTINCT sday) FROM jobs) AS total_periods, (SELECT count(DISTINCT usr) FROM jobs) AS total_users
FROM o""")
def a21(c: Context):
    return M.activity_by_group(c.jobs, "Account", "day")


@query("a22_wait_by_account", _others_sql("sum(wait_h)", "account", 15, "wait_h IS NOT NULL", digits="round(value, 4)")
       .replace("SELECT CAST(rank", "SELECT s.*, m.* FROM (SELECT CAST(rank")
       + """) AS s, (SELECT round(avg(wait_h), 6) AS mean, round(quantile_cont(wait_h, 0.5), 6) AS median FROM jobs) AS m""")
def a22(c: Context):
    return coarse(M.hours_by_group(c.jobs, "WaitingTimeHours", "Account"), "value")


@query("a23_cpus_per_job", "SELECT cpus AS units, count(*) AS jobs FROM jobs GROUP BY cpus ORDER BY cpus LIMIT 20")
def a23(c: Context):
    return M.resources_per_job(c.jobs, "CPUs", positive=False)


@query("a23_gpus_per_job", "SELECT gpus AS units, count(*) AS jobs FROM jobs WHERE gpus > 0 GROUP BY gpus ORDER BY 1 LIMIT 20")
def a23_gpus(c: Context):
    return M.resources_per_job(c.jobs, "GPUs")


@query("a23_nodes_per_job_all", "SELECT nodes AS units, count(*) AS jobs FROM jobs GROUP BY nodes")
def a23_nodes(c: Context):
    return M.resources_per_job(c.jobs, "Nodes", positive=False, limit=None)


@query("a32_describe_by_period", """
SELECT smonth AS period, qos AS "QOS", count(wait_h) AS count, round(avg(wait_h), 9) AS mean,
  round(stddev_samp(wait_h), 9) AS std, round(min(wait_h), 9) AS min, round(quantile_cont(wait_h, 0.25), 9) AS p25,
  round(quantile_cont(wait_h, 0.5), 9) AS p50, round(quantile_cont(wait_h, 0.75), 9) AS p75, round(max(wait_h), 9) AS max
FROM jobs WHERE wait_h IS NOT NULL GROUP BY ALL""", digits=9)
def a32(c: Context):
    return M.describe_by_period(c.jobs, "WaitingTimeHours", "month", dim="QOS")


@query("j10_category_fill", """
SELECT account AS "Account", count(*) FILTER (WHERE syear = 1995 AND qos = '5-LOW') AS value FROM jobs GROUP BY account""")
def j10(c: Context):
    some = X.filter_jobs(c.jobs, end="1995-12-31", qos=["5-LOW"])
    totals = some.groupBy("Account").agg(F.count("*").alias("value"))
    return M.fill_categories(totals, M.category_order(c.jobs, "Account"), "Account")


# Top groups, shares, orders ------------------------------------------------------------------------


def _account_totals(c: Context):
    return c.jobs.groupBy(F.col("Account").alias("label")).agg(
        F.count("*").alias("value"), F.sum("CPUHours").alias("cpu"), F.sum("GPUHours").alias("gpu"))


@query("l01_top_others", bigint(_others_sql("count(*)", "qos", 3)))
def l01(c: Context):
    return L.top_n_others(c.jobs.groupBy(F.col("QOS").alias("label")).agg(F.count("*").alias("value")), 3)


@query("l02_top_n", "SELECT usr AS label, count(*) AS value FROM jobs GROUP BY usr ORDER BY value DESC, label LIMIT 25")
def l02(c: Context):
    return L.top_n(c.jobs.groupBy(F.col("User").alias("label")).agg(F.count("*").alias("value")), 25)


@query("l03_pie_top", bigint(_others_sql("count(*)", "account", 7)).replace(
    "'Others (' || count(*) || ')'", "'Other'"))
def l03(c: Context):
    return L.pie_top(c.jobs.groupBy(F.col("Account").alias("label")).agg(F.count("*").alias("value")), 8)


@query("l04_top_by_sum", """
SELECT account AS label, round(sum(cpu_h), 4) AS cpu, round(sum(gpu_h), 4) AS gpu FROM jobs GROUP BY account
ORDER BY sum(cpu_h) + sum(gpu_h) DESC, label LIMIT 12""")
def l04(c: Context):
    return coarse(L.top_by_sum(_account_totals(c), ["cpu", "gpu"], 12).drop("value"), "cpu", "gpu")


@query("l06_order_by_metric", "SELECT account AS label, count(*) AS value FROM jobs GROUP BY account")
def l06(c: Context):
    return L.by_metric(_account_totals(c).select("label", "value"), "value", "label")


@query("w04_share", """
SELECT state AS label, count(*) AS value, round(count(*) * 100.0 / (SELECT count(*) FROM jobs), 6) AS percent
FROM jobs GROUP BY state""")
def w04(c: Context):
    return L.share(M.jobs_by(c.jobs, "State", None))


# Callers' own pieces -------------------------------------------------------------------------------


@query("x02_account_formatter", """
SELECT upper(split_part(account, '-', 2)) AS "Account", count(*) AS jobs FROM jobs GROUP BY 1""")
def x02(c: Context):
    df = X.format_accounts(c.jobs, lambda a: F.upper(F.split_part(a, F.lit("-"), F.lit(2))))
    return df.groupBy("Account").agg(F.count("*").alias("jobs"))


@query("p09_account_prefix", """
SELECT account AS "Account", split_part(account, '-', 1) AS one, split_part(account, '-', 1) || '-' ||
  split_part(account, '-', 2) || '-' || split_part(account, '-', 3) AS three, count(*) AS jobs FROM jobs GROUP BY ALL""")
def p09(c: Context):
    return c.jobs.groupBy("Account", account_prefix("Account", 1).alias("one"), account_prefix("Account").alias("three")) \
        .agg(F.count("*").alias("jobs"))


# Set operations and bundles ------------------------------------------------------------------------


@query("u02_union_nodes", "SELECT DISTINCT node FROM job_nodes")
def u02(c: Context):
    from jobmeter.sources.records import with_node_array
    text = c.jobs.where(F.col("Partition").contains("cpu"))
    arrays = with_node_array(c.jobs.where(~F.col("Partition").contains("cpu")))
    return D.union_nodes(D.distinct_nodes(text), D.distinct_nodes(arrays))


@query("u03_snapshot_diff", """
, a AS (SELECT DISTINCT usr FROM jobs WHERE syear <= 1996), b AS (SELECT DISTINCT usr FROM jobs WHERE syear >= 1999)
SELECT usr AS "User", 'new' AS change FROM b WHERE usr NOT IN (SELECT usr FROM a)
UNION ALL SELECT usr, 'gone' FROM a WHERE usr NOT IN (SELECT usr FROM b)""")
def u03(c: Context):
    return W.snapshot_diff(c.jobs.where("SubmitYear <= 1996"), c.jobs.where("SubmitYear >= 1999"), "User")


@query("u04_explode_lists", """
SELECT trim(unnest(string_split(part, ','))) AS "partition", count(*) AS jobs FROM jobs GROUP BY 1""")
def u04(c: Context):
    jobs = D.explode_partitions(c.jobs)
    return jobs.groupBy(F.col("Partition").alias("partition")).agg(F.count("*").alias("jobs"))


@query("r09_metadata", """
, r AS (SELECT * FROM jobs WHERE submit >= DATE '1998-01-01' AND submit < DATE '1999-01-01'),
d AS (SELECT cluster, CAST(min(submit) AS DATE) AS min_date, CAST(max(submit) AS DATE) AS max_date FROM jobs GROUP BY cluster),
v AS (SELECT cluster, 'Account' AS dimension, account AS value FROM r UNION SELECT cluster, 'User', usr FROM r
  UNION SELECT cluster, 'QOS', qos FROM r UNION SELECT cluster, 'State', state FROM r
  UNION SELECT cluster, 'Partition', trim(unnest(string_split(part, ','))) FROM r)
SELECT * FROM d JOIN v USING (cluster)""")
def r09(c: Context):
    return P.metadata(c.jobs, "1998-01-01", "1998-12-31")


@query("r10_filter_rows", """
SELECT jobid AS "JobID", usr AS "User", account AS "Account", state AS "State", round(cpu_h, 6) AS "CPUHours" FROM jobs
WHERE submit >= DATE '1998-01-01' AND cluster IN ('asia', 'europe') AND state = 'FAILED'""")
def r10(c: Context):
    rows, _ = P.filter_rows(c.jobs, ["JobID", "User", "Account", "State", "CPUHours"], start="1998-01-01",
                            clusters=["asia", "europe"], states=["FAILED"])
    return rows


@query("r10_filter_summary", f"SELECT {_SUMMARY} FROM jobs WHERE part LIKE '%short%'")
def r10_summary(c: Context):
    _, summary = P.filter_rows(c.jobs, partitions=["short"])
    return coarse(summary, "cpu_hours", "gpu_hours")
