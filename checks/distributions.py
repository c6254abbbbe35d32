"""Histograms, percentile trends, node usage and lookups."""

from __future__ import annotations

from pyspark.sql import functions as F

from jobmeter.functions import bins as B
from jobmeter.functions.time import data_range_hours, range_hours
from jobmeter.operators import histograms as H
from jobmeter.operators import lookups as K
from jobmeter.operators import nodes as N
from jobmeter.operators.topn import order_nodes
from jobmeter.sources.dims import generate_dims, load_dims

from .base import Context, query
from .measures import coarse

# Fixed bins ----------------------------------------------------------------------------------------


def _values(bins) -> str:
    uppers = [b for _, b in bins[1:]] + ["1e300"]
    rows = ", ".join(f"({i}, '{name}', {lo}, {hi})" for i, ((name, lo), hi) in enumerate(zip(bins, uppers)))
    return f"bins AS (SELECT * FROM (VALUES {rows}) AS b(bin, label, lo, hi))"


def _hist_sql(column: str, bins, where: str) -> str:
    return f"""
, {_values(bins)}, x AS (SELECT {column} AS v FROM jobs WHERE {where}),
n AS (SELECT bin, label, count(v) AS count FROM bins LEFT JOIN x ON v >= lo AND v < hi GROUP BY ALL)
SELECT bin, label, count, (SELECT CAST(sum(count) AS BIGINT) FROM n) AS total,
  round(count * 100.0 / (SELECT sum(count) FROM n), 6) AS percent,
  (SELECT round(avg(v), 6) FROM x) AS mean, (SELECT round(quantile_cont(v, 0.5), 6) FROM x) AS median FROM n"""


@query("h01_waiting_times_hist", _hist_sql("wait_h", B.HISTOGRAM_BINS, "wait_h IS NOT NULL"))
def h01(c: Context):
    return H.value_histogram(c.jobs, "WaitingTimeHours")


@query("h01_job_duration_hist", _hist_sql("el_h", B.HISTOGRAM_BINS, "el_h > 0"))
def h01_duration(c: Context):
    return H.value_histogram(c.jobs, "ElapsedHours", positive=True)


def _stack_sql(column: str, bins, period: str, where: str, total: str) -> str:
    return f"""
, {_values(bins)}, x AS (SELECT {period} AS period, {column} AS v FROM jobs WHERE {period} IS NOT NULL AND {where}),
p AS (SELECT period, {total} AS total FROM x GROUP BY period),
n AS (SELECT period, total, bin, label, lo, hi FROM p, bins),
m AS (SELECT period, total, bin, label, (SELECT count(*) FROM x WHERE x.period = n.period AND v >= lo AND v < hi) AS count FROM n)
SELECT period, total, bin, label, count, round(count * 100.0 / total, 6) AS percent FROM m"""


@query("h02_job_duration_stacked", _stack_sql("el_h", B.DURATION_BINS, "tmonth", "true", "count(v)"))
def h02(c: Context):
    return H.job_duration_stacked(c.jobs, "month")


@query("h02_waiting_times_stacked", _stack_sql("wait_h", B.WAITING_BINS, "tmonth", "wait_h IS NOT NULL", "count(v)"))
def h02_wait(c: Context):
    return H.waiting_times_stacked(c.jobs, "month")


@query("h03_stacked_of_all_jobs", _stack_sql("wait_h", B.SPACED_WAITING_BINS, "sweek", "true", "count(*)"))
def h03(c: Context):
    return H.stacked_bins_of_all(c.jobs, "WaitingTimeHours", "week", B.SPACED_WAITING_BINS)


@query("h04_fine_wait_bins", f"""
, {_values(B.FINE_WAITING_BINS)},
n AS (SELECT bin, label, count(jobid) AS count FROM bins LEFT JOIN jobs ON wait_h >= lo AND wait_h < hi GROUP BY ALL)
SELECT bin, label, count, (SELECT CAST(sum(count) AS BIGINT) FROM n) AS total,
  round(count * 100.0 / (SELECT sum(count) FROM n), 6) AS percent FROM n""")
def h04(c: Context):
    return H.fine_histogram(c.jobs, "WaitingTimeHours", B.FINE_WAITING_BINS)


@query("h04_fine_duration_bins_by_qos", f"""
, {_values(B.FINE_DURATION_BINS)}, p AS (SELECT qos AS series, count(el_h) AS total FROM jobs GROUP BY qos),
m AS (SELECT series, total, bin, label, (SELECT count(*) FROM jobs WHERE qos = series AND el_h >= lo AND el_h < hi) AS count
  FROM p, bins)
SELECT *, round(count * 100.0 / total, 6) AS percent FROM m""")
def h04_duration(c: Context):
    return H.fine_histogram(c.jobs, "ElapsedHours", B.FINE_DURATION_BINS, "QOS")


@query("u05_pivot_bins", f"""
, {_values(B.WAITING_BINS)}, x AS (SELECT tmonth AS period, label FROM jobs JOIN bins ON wait_h >= lo AND wait_h < hi)
SELECT period, {", ".join(f'''round(count(*) FILTER (WHERE label = '{n}') * 100.0 / count(*), 6) AS "{n}"'''
                          for n, _ in B.WAITING_BINS)} FROM x GROUP BY period""")
def u05(c: Context):
    return H.pivot_bins(H.waiting_times_stacked(c.jobs, "month"), B.WAITING_BINS)


# Percentiles ---------------------------------------------------------------------------------------


def _trend_sql(column: str, period: str, where: str) -> str:
    quantiles = ", ".join(f"round(quantile_cont({column}, {p}), 9) AS {name}" for name, p in H.TREND_PROBS.items())
    return f"""SELECT {period} AS period, round(avg({column}), 9) AS mean, round(max({column}), 9) AS max, {quantiles}
FROM jobs WHERE {period} IS NOT NULL AND {where} GROUP BY ALL"""


@query("h05_waiting_times_trends", _trend_sql("wait_h", "tweek", "wait_h IS NOT NULL"), digits=9)
def h05(c: Context):
    return H.trends(c.jobs, "WaitingTimeHours", "week")


@query("h05_job_duration_trends", _trend_sql("el_h", "tmonth", "el_h > 0"), digits=9)
def h05_duration(c: Context):
    return H.trends(c.jobs, "ElapsedHours", "month", positive=True)


@query("h06_p90_by_state", """
, g AS (SELECT * FROM (SELECT DISTINCT tmonth AS period FROM jobs WHERE el_h > 0), (SELECT DISTINCT state AS series FROM jobs WHERE el_h > 0)),
v AS (SELECT tmonth AS period, state AS series, quantile_cont(el_h, 0.9) AS value FROM jobs WHERE el_h > 0 GROUP BY ALL)
SELECT period, series, round(coalesce(value, 0), 6) AS value FROM g LEFT JOIN v USING (period, series)""")
def h06(c: Context):
    return H.trend_by_group(c.jobs, "ElapsedHours", "month", "State", "p90", positive=True)


@query("h11_column_stats", """
SELECT round(avg(el_h), 6) AS mean, round(quantile_cont(el_h, 0.5), 6) AS median, round(quantile_cont(el_h, 0.25), 6) AS p25,
  round(quantile_cont(el_h, 0.75), 6) AS p75, round(quantile_cont(el_h, 0.9), 6) AS p90, round(min(el_h), 6) AS min,
  round(max(el_h), 6) AS max FROM jobs""")
def h11(c: Context):
    return H.column_stats(c.jobs, "ElapsedHours")


@query("a28_timing_kpis", """
, p AS (SELECT tmonth, quantile_cont(wait_h, 0.5) AS med, quantile_cont(wait_h, 0.95) AS p95, max(wait_h) AS top FROM jobs
  WHERE wait_h IS NOT NULL GROUP BY ALL)
SELECT round(avg(med), 6) AS median, round(avg(p95), 6) AS p95, round(max(top), 6) AS max FROM p""")
def a28(c: Context):
    return H.timing_kpis(H.trends(c.jobs, "WaitingTimeHours", "month"))


# Equal-width bins ----------------------------------------------------------------------------------


def _equal_sql(values: str, n_bins: str, label: str = "", digits: int = 6) -> str:
    """Bins from their edges: a value counts in the bin whose edges enclose it."""
    return f"""
, t AS ({values}), f AS (SELECT CASE WHEN min(v) = max(v) THEN min(v) - 0.5 ELSE min(v) END AS lo,
  CASE WHEN min(v) = max(v) THEN max(v) + 0.5 ELSE max(v) END AS hi, CAST({n_bins} AS INT) AS n FROM t),
e AS (SELECT CAST(b AS INT) AS bin, lo + b * ((hi - lo) / n) AS lower, CASE WHEN b = n - 1 THEN hi ELSE lo + (b + 1) * ((hi - lo) / n) END AS upper,
  b = n - 1 AS last FROM f, (SELECT unnest(range(0, 40)) AS b) WHERE b < n)
SELECT bin, round(lower, {digits}) AS lower, round(upper, {digits}) AS upper, round((lower + upper) / 2, {digits}) AS center,
  (SELECT count(*) FROM t WHERE v >= lower AND (v < upper OR (last AND v <= upper))) AS count, {label}
  (SELECT round(avg(v), {digits}) FROM t) AS mean, (SELECT round(quantile_cont(v, 0.5), {digits}) FROM t) AS median FROM e"""


@query("h07_cpu_hours_per_month_hist",
       _equal_sql("SELECT sum(cpu_h) AS v FROM jobs WHERE tmonth IS NOT NULL GROUP BY tmonth", "20", digits=3))
def h07(c: Context):
    return H.usage_histogram(c.jobs, "CPUHours", "month").withColumns(
        {k: F.round(k, 3) for k in ("lower", "upper", "center", "mean", "median")})


@query("h08_jobs_per_user_hist", _equal_sql(
    "SELECT CAST(count(*) AS DOUBLE) AS v FROM jobs GROUP BY usr", "least(30, greatest(10, ceil(sqrt(count(*)))))",
    "CAST(trunc(lower) AS BIGINT) || '-' || CAST(trunc(upper) AS BIGINT) AS label,"))
def h08(c: Context):
    return H.jobs_per_user_histogram(c.jobs)


@query("h09_active_users_hist", _equal_sql(
    "SELECT CAST(count(DISTINCT usr) AS DOUBLE) AS v FROM jobs WHERE tmonth IS NOT NULL GROUP BY tmonth",
    "least(20, greatest(5, count(*)))"))
def h09(c: Context):
    return H.active_users_histogram(c.jobs, "month")


@query("h09_jobs_per_year_hist", _equal_sql(
    "SELECT CAST(count(*) AS DOUBLE) AS v FROM jobs WHERE tyear IS NOT NULL GROUP BY tyear", "least(20, greatest(5, count(*)))"))
def h09_jobs(c: Context):
    return H.jobs_histogram(c.jobs, "year")


@query("x04_custom_aggregate_hist", _equal_sql(
    "SELECT CAST(max(cpus) * count(DISTINCT account) AS DOUBLE) AS v FROM jobs WHERE tweek IS NOT NULL GROUP BY tweek",
    "least(20, greatest(5, count(*)))"))
def x04(c: Context):
    return H.period_distribution(c.jobs, "week", F.max("CPUs") * F.count_distinct("Account"))


def _activity_sql(column: str) -> str:
    return f"""
, t AS (SELECT count(DISTINCT {column}) AS v FROM jobs GROUP BY usr),
f AS (SELECT max(v) AS top, CASE WHEN max(v) <= 10 THEN 1 WHEN max(v) <= 30 THEN 5 ELSE 10 END AS w FROM t),
e AS (SELECT CAST(b AS INT) AS bin, b * w + 1 AS low, least(b * w + w, top) AS high, w FROM f,
  (SELECT unnest(range(0, 1000)) AS b) WHERE b * w + 1 <= top)
SELECT bin, CASE WHEN w = 1 THEN CAST(low AS VARCHAR) ELSE low || '-' || high END AS label,
  (SELECT count(*) FROM t WHERE v BETWEEN low AND high) AS users, (SELECT round(avg(v), 6) FROM t) AS average,
  (SELECT round(quantile_cont(v, 0.5), 6) FROM t) AS median, (SELECT count(DISTINCT {column}) FROM jobs) AS total_periods,
  (SELECT count(DISTINCT usr) FROM jobs) AS total_users FROM e"""


@query("h10_activity_days", _activity_sql("sday"))
def h10(c: Context):
    return H.activity_histogram(c.jobs, "day")


@query("h10_activity_years", _activity_sql("syear"))
def h10_years(c: Context):
    return H.activity_histogram(c.jobs, "year")


# Nodes ---------------------------------------------------------------------------------------------

_USAGE = """
, u AS (SELECT node{series}, sum(cpu_h) AS cpu, sum(gpu_h) AS gpu FROM job_nodes GROUP BY ALL),
usage AS (SELECT node{name}, 'cpu' AS resource, cpu AS value FROM u UNION ALL SELECT node{name}, 'gpu', gpu FROM u)
"""
_PLAIN_USAGE = _USAGE.format(series="", name="")
_ACCOUNT_USAGE = _USAGE.format(series=", qos", name=", qos AS series")


@query("a24_node_usage", _PLAIN_USAGE + "SELECT node, resource, round(value, 4) AS value FROM usage")
def a24(c: Context):
    return coarse(N.node_usage(c.jobs), "value")


@query("a24_node_usage_by_qos", _ACCOUNT_USAGE + "SELECT node, series, resource, round(value, 4) AS value FROM usage WHERE value > 0")
def a24_qos(c: Context):
    return coarse(N.node_usage(c.jobs, "QOS", hide_unused=True), "value")


@query("a24_node_usage_split", """
, s AS (SELECT *, count(*) OVER (PARTITION BY k) AS n FROM job_nodes)
SELECT node, 'cpu' AS resource, round(sum(cpu_h / n), 4) AS value FROM s GROUP BY node
UNION ALL SELECT node, 'gpu', round(sum(gpu_h / n), 4) FROM s GROUP BY node""")
def a24_split(c: Context):
    return coarse(N.node_usage(c.jobs, split=True), "value")


@query("f09_hide_idle_nodes", _PLAIN_USAGE + "SELECT node, resource FROM usage WHERE value > 0")
def f09(c: Context):
    return N.hide_idle(N.node_usage(c.jobs)).select("node", "resource")


@query("l05_node_order", _PLAIN_USAGE + """
SELECT node, CAST(row_number() OVER (ORDER BY value DESC, node) AS INT) AS by_hours,
  CAST(row_number() OVER (ORDER BY regexp_extract(node, '^[a-z]+'), CAST(regexp_extract(node, '[0-9]+') AS INT)) AS INT) AS natural_place
FROM usage WHERE resource = 'cpu'""")
def l05(c: Context):
    from pyspark.sql import Window
    from jobmeter.functions.nodes import natural_key
    usage = order_nodes(N.node_usage(c.jobs).where("resource = 'cpu'"), "value")
    return usage.select("node", F.row_number().over(Window.orderBy(F.desc("value"), "node")).alias("by_hours"),
                        F.row_number().over(Window.orderBy(natural_key("node"))).alias("natural_place"))


def config_path(c: Context) -> str:
    """A cluster config made from the region, nation and node tables.

    Nodes gpu01 to gpu05 have their own hardware and a synonym; cpu7 is left out; ibex and cpu nodes have patterns.
    """
    region = c.table("region").select("r_regionkey", F.regexp_replace(F.lower("r_name"), " ", "_").alias("cluster"))
    nation = c.table("nation")
    seen = c.jobs.select("NodeList").distinct()
    from jobmeter.operators.metadata import distinct_nodes
    names = distinct_nodes(seen).where("node <> 'cpu7'")
    own = F.col("node").startswith("gpu")
    entry = F.struct(
        F.array(F.upper("node"), F.regexp_replace("node", "0", "-")).alias("synonyms"),
        F.when(own, "gpu").otherwise("cpu").alias("type"), F.concat(F.lit("node "), F.col("node")).alias("description"),
        F.when(own, F.struct(F.struct(F.lit(48).alias("cores")).alias("cpu"),
                             F.array(F.struct(F.lit(4).alias("count"))).alias("gpus"))).alias("hardware"))
    labels = names.agg(F.map_from_entries(F.collect_list(F.struct("node", entry))).alias("m")).scalar()
    accounts = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).groupBy("cluster").agg(
        F.map_from_entries(F.collect_list(F.struct(
            F.concat(F.regexp_replace("cluster", "_", " "), F.lit("-"), F.lower("n_name"), F.lit("-machinery-g1")),
            F.struct(F.concat(F.lit("Machinery "), F.col("n_name")).alias("display_name"),
                     F.concat(F.lit("M"), F.col("n_nationkey")).alias("short_name"))))).alias("account_labels"))
    partition = F.create_map(F.lit("gpu"), F.struct(F.lit("GPU Partition").alias("display_name"),
                                                    F.lit("all gpu nodes").alias("description")))
    clusters = accounts.select("cluster", F.struct(
        F.concat(F.initcap(F.regexp_replace("cluster", "_", " ")), F.lit(" Cluster")).alias("display_name"),
        labels.alias("node_labels"), "account_labels", partition.alias("partition_labels"),
        (F.col("cluster") != "africa").alias("active")).alias("c"))
    pattern = lambda name, regex, cpu, gpu: F.struct(F.lit(name).alias("name"), F.lit(regex).alias("pattern"),
                                                     F.lit(cpu).alias("cpu_cores"), F.lit(gpu).alias("gpu_count"))
    default = lambda cpu, gpu: F.struct(F.lit(cpu).alias("cpu_cores"), F.lit(gpu).alias("gpu_count"))
    settings = F.struct(
        F.lit("cpu").alias("default_node_type"), F.lit(False).alias("case_sensitive"),
        F.lit(True).alias("auto_generate_labels"),
        F.create_map(F.lit("gpu"), default(40, 3), F.lit("cpu"), default(36, 0)).alias("hardware_defaults"),
        F.array(pattern("ibex", r"^IBEX\d+", 96, 8), pattern("any", r"^i", 1, 1), pattern("one", r"^cpu1$", 32, 0))
        .alias("node_type_patterns"))
    whole = clusters.agg(F.map_from_entries(F.collect_list(F.struct("cluster", "c"))).alias("clusters")) \
        .withColumn("settings", settings)
    path = c.scratch("config")
    whole.write.json(path)
    return path


_HARDWARE = """
hw AS (SELECT * FROM (VALUES ('gpu01', 48, 4), ('gpu02', 48, 4), ('gpu03', 48, 4), ('gpu05', 48, 4), ('ibex1', 96, 8),
  ('ibex2', 96, 8), ('cpu1', 32, 0), ('cpu2', 36, 0), ('cpu7', 36, 0)) AS h(node, cpu_cores, gpu_count))
"""


@query("s19_load_dims", """
SELECT r.cluster, 'gpu' AS "Partition", a.account AS "Account", a.label AS display_name, n.node, n.type FROM
  (SELECT r_regionkey, replace(lower(r_name), ' ', '_') AS cluster FROM region) r
  JOIN (SELECT n_regionkey, 'Machinery ' || n_name AS label, (SELECT lower(r_name) FROM region WHERE r_regionkey = n_regionkey)
    || '-' || lower(n_name) || '-machinery-g1' AS account FROM nation) a ON n_regionkey = r_regionkey,
  (SELECT DISTINCT node, CASE WHEN node LIKE 'gpu%' THEN 'gpu' ELSE 'cpu' END AS type FROM node_lists WHERE node <> 'cpu7') n""")
def s19(c: Context):
    dims = load_dims(c.spark, config_path(c))
    return dims["account"].select("cluster", "Account", "display_name").join(
        dims["node"].select("cluster", "node", "type"), "cluster").join(dims["partition"].select("cluster", "Partition"), "cluster")


@query("j01_active_clusters", "SELECT cluster, count(*) AS jobs FROM jobs WHERE cluster <> 'africa' GROUP BY cluster")
def j01(c: Context):
    dims = load_dims(c.spark, config_path(c))
    return K.active_clusters(c.jobs, dims["cluster"]).groupBy("cluster").agg(F.count("*").alias("jobs"))


@query("j02_canonical_node", "SELECT cluster, node, count(*) AS jobs FROM job_nodes GROUP BY ALL")
def j02(c: Context):
    from jobmeter.operators.metadata import with_nodes
    dims = load_dims(c.spark, config_path(c))
    counts = with_nodes(c.jobs.groupBy("cluster", "NodeList").agg(F.count("*").alias("jobs")))
    # Names as they might arrive: in capitals, with '-' for '0', or in mixed case.
    odd = F.when(F.col("cluster") == "asia", F.upper("node")).when(
        F.col("cluster") == "europe", F.regexp_replace("node", "0", "-")).otherwise(F.initcap("node"))
    renamed = N.canonical_node(counts.withColumn("node", F.when(F.col("node") != "cpu7", odd).otherwise("cpu7")), dims["synonym"])
    return renamed.groupBy("cluster", "node").agg(F.sum("jobs").alias("jobs"))


@query("j03_hardware", "," + _HARDWARE + "SELECT DISTINCT node, cpu_cores, gpu_count FROM job_nodes JOIN hw USING (node)")
def j03(c: Context):
    from jobmeter.operators.metadata import distinct_nodes
    dims = load_dims(c.spark, config_path(c))
    return N.with_hardware(distinct_nodes(c.jobs), dims, "asia")


def _legacy(c: Context):
    """The older node config: exact entries and '*' patterns."""
    one = c.spark.range(1)
    entries = one.select(F.inline(F.array(
        F.struct(F.lit("gpu01").alias("node"), F.lit(64).alias("cpus"), F.lit(4).alias("gpus")),
        F.struct(F.lit("cpu7").alias("node"), F.lit(None).cast("int").alias("cpus"), F.lit(None).cast("int").alias("gpus")))))
    patterns = one.select(F.inline(F.array(
        F.struct(F.lit(0).alias("priority"), F.lit("gpu0*").alias("pattern"), F.lit(32).alias("cpus"), F.lit(8).alias("gpus")),
        F.struct(F.lit(1).alias("priority"), F.lit("*1").alias("pattern"), F.lit(128).alias("cpus"), F.lit(0).alias("gpus")))))
    return entries, patterns


_LEGACY = """
legacy AS (SELECT * FROM (VALUES ('gpu01', 64, 4), ('gpu02', 32, 8), ('gpu03', 32, 8), ('gpu05', 32, 8), ('ibex1', 128, 0),
  ('cpu1', 128, 0), ('cpu7', 1, 0), ('ibex2', 16, 2), ('cpu2', 16, 2)) AS h(node, cpus, gpus))
"""


@query("j04_legacy_resources", "," + _LEGACY + "SELECT DISTINCT node, cpus, gpus FROM (SELECT node FROM job_nodes) JOIN legacy USING (node)")
def j04(c: Context):
    from jobmeter.operators.metadata import distinct_nodes
    return N.with_legacy_resources(distinct_nodes(c.jobs), *_legacy(c), default_cpus=16, default_gpus=2)


@query("j05_labels", """
SELECT account AS "Account", part AS "Partition", cluster, count(*) AS jobs,
  CASE WHEN account LIKE '%-machinery-g1' THEN 'Machinery ' || upper(split_part(account, '-', 2)) ELSE account END AS account_label,
  CASE WHEN part = 'gpu' THEN 'GPU Partition' ELSE part END AS partition_label,
  CASE WHEN part = 'gpu' THEN 'all gpu nodes' ELSE part || ' partition' END AS partition_description,
  CASE cluster WHEN 'middle_east' THEN 'Middle East' ELSE upper(cluster[1]) || cluster[2:] END || ' Cluster' AS cluster_label
FROM jobs GROUP BY ALL""")
def j05(c: Context):
    dims = load_dims(c.spark, config_path(c))
    counts = c.jobs.groupBy("cluster", "Account", "Partition").agg(F.count("*").alias("jobs"))
    return K.with_labels(counts, dims).drop("account_short")


@query("j05_node_labels", """
SELECT DISTINCT cluster, node, CASE WHEN node LIKE 'gpu%' THEN 'gpu' ELSE 'cpu' END AS type,
  CASE WHEN node = 'cpu7' THEN 'Node cpu7' ELSE 'node ' || node END AS description FROM job_nodes""")
def j05_nodes(c: Context):
    from jobmeter.operators.metadata import distinct_nodes
    return K.node_labels(distinct_nodes(c.jobs, by=["cluster"]), load_dims(c.spark, config_path(c)))


@query("j06_unknown_nodes", "SELECT DISTINCT node FROM job_nodes WHERE node = 'cpu7'")
def j06(c: Context):
    return N.unknown_nodes(c.jobs, load_dims(c.spark, config_path(c))["synonym"])


_TOTAL = "(SELECT (floor((epoch_us(max(submit)) - epoch_us(min(submit))) / 86400000000) + 1) * 24 FROM jobs)"
_PERCENT = f"""CASE WHEN (CASE resource WHEN 'cpu' THEN cpu_cores ELSE gpu_count END) > 0 THEN
  least(100, value / ((CASE resource WHEN 'cpu' THEN cpu_cores ELSE gpu_count END) * {_TOTAL}) * 100) ELSE 0 END"""


@query("a25_node_utilisation", _PLAIN_USAGE + "," + _HARDWARE + f"""
SELECT node, resource, round(value, 4) AS hours, cpu_cores, gpu_count, round({_PERCENT}, 6) AS value
FROM usage JOIN hw USING (node)""")
def a25(c: Context):
    dims = load_dims(c.spark, config_path(c))
    total = c.jobs.agg(data_range_hours()).scalar()
    return coarse(N.node_utilisation(N.node_usage(c.jobs), dims, total, "asia"), "hours")


# Clusters that share names of nodes but not their hardware.
_CLUSTER_HARDWARE = "," + _HARDWARE.replace("hw AS", "shared AS").strip() + """,
hw AS (SELECT cluster, node, CASE WHEN node LIKE 'gpu%' THEN CAST(length(cluster) AS INT) ELSE cpu_cores END AS cpu_cores, gpu_count
  FROM shared, (SELECT DISTINCT cluster FROM jobs) c),
u AS (SELECT cluster, node, sum(cpu_h) AS cpu, sum(gpu_h) AS gpu FROM job_nodes GROUP BY ALL),
usage AS (SELECT cluster, node, 'cpu' AS resource, cpu AS value FROM u UNION ALL SELECT cluster, node, 'gpu', gpu FROM u)
"""


def _dims_by_cluster(c: Context) -> dict:
    dims = load_dims(c.spark, config_path(c))
    own = F.when(F.col("cpu_cores").isNotNull(), F.length("cluster"))
    return {**dims, "node": dims["node"].withColumn("cpu_cores", own)}


@query("a24_node_usage_by_cluster", _CLUSTER_HARDWARE + "SELECT cluster, node, resource, round(value, 4) AS value FROM usage")
def a24_cluster(c: Context):
    return coarse(N.node_usage(c.jobs, by_cluster=True), "value")


@query("a25_utilisation_by_cluster", _CLUSTER_HARDWARE + f"""
SELECT cluster, node, resource, round(value, 4) AS hours, cpu_cores, gpu_count, round({_PERCENT}, 6) AS value
FROM usage JOIN hw USING (cluster, node)""")
def a25_cluster(c: Context):
    total = c.jobs.agg(data_range_hours()).scalar()
    return coarse(N.node_utilisation(N.node_usage(c.jobs, by_cluster=True), _dims_by_cluster(c), total), "hours")


@query("a27_utilisation_of_each_cluster", _CLUSTER_HARDWARE + f"""
SELECT cluster, resource, round(avg({_PERCENT}), 6) AS percent FROM usage JOIN hw USING (cluster, node) GROUP BY ALL""")
def a27_cluster(c: Context):
    total = c.jobs.agg(data_range_hours()).scalar()
    return N.cluster_utilisation(N.node_utilisation(N.node_usage(c.jobs, by_cluster=True), _dims_by_cluster(c), total))


@query("j06_unknown_nodes_by_cluster", "SELECT DISTINCT cluster, node FROM job_nodes WHERE node = 'cpu7' OR cluster = 'europe'")
def j06_cluster(c: Context):
    known = load_dims(c.spark, config_path(c))["synonym"].where("cluster <> 'europe'")
    return N.unknown_nodes(c.jobs, known, by_cluster=True)


@query("a26_usage_per_core", _PLAIN_USAGE + "," + _LEGACY + """
SELECT node, resource, round(value / greatest(CASE resource WHEN 'cpu' THEN cpus ELSE gpus END, 1), 4) AS value
FROM usage JOIN legacy USING (node)""")
def a26(c: Context):
    usage = N.node_usage(c.jobs)
    resources = N.with_legacy_resources(usage.select("node").distinct(), *_legacy(c), default_cpus=16, default_gpus=2)
    return coarse(N.usage_per_core(usage, resources), "value")


@query("a27_cluster_utilisation", _PLAIN_USAGE + "," + _HARDWARE + f"""
SELECT resource, round(avg({_PERCENT}), 6) AS percent FROM usage JOIN hw USING (node) GROUP BY resource""")
def a27(c: Context):
    dims = load_dims(c.spark, config_path(c))
    total = c.jobs.agg(data_range_hours()).scalar()
    return N.cluster_utilisation(N.node_utilisation(N.node_usage(c.jobs), dims, total, "asia"))


@query("a27_stacked_utilisation", _ACCOUNT_USAGE + "," + _HARDWARE + f"""
, n AS (SELECT resource, node, sum({_PERCENT}) AS percent FROM usage JOIN hw USING (node) GROUP BY ALL)
SELECT resource, round(avg(percent), 6) AS percent FROM n GROUP BY resource""")
def a27_stacked(c: Context):
    dims = load_dims(c.spark, config_path(c))
    total = c.jobs.agg(data_range_hours()).scalar()
    return N.cluster_utilisation(N.node_utilisation(N.node_usage(c.jobs, "QOS"), dims, total, "asia"))


@query("a30_generate_dims", """
SELECT cluster, 'node' AS "table", count(DISTINCT node) AS "rows" FROM job_nodes GROUP BY cluster
UNION ALL SELECT cluster, 'account', count(DISTINCT account) FROM jobs GROUP BY cluster
UNION ALL SELECT cluster, 'partition', count(DISTINCT p) FROM (SELECT cluster, trim(unnest(string_split(part, ','))) AS p FROM jobs)
  GROUP BY cluster""")
def a30(c: Context):
    return generate_dims(c.jobs)["stats"]


@query("a30_generated_nodes", """
SELECT DISTINCT cluster, node, CASE WHEN node LIKE '%gpu%' THEN 'gpu' ELSE 'cpu' END AS type,
  CASE WHEN node LIKE '%gpu%' THEN 'GPU Node ' ELSE 'CPU Node ' END || node AS description FROM job_nodes""")
def a30_nodes(c: Context):
    return generate_dims(c.jobs)["node"]


@query("a30_generated_accounts", """
SELECT DISTINCT cluster, account AS "Account", account AS display_name, upper(split_part(account, '-', 4)) AS short_name FROM jobs""")
def a30_accounts(c: Context):
    return generate_dims(c.jobs)["account"]


@query("a30_generated_partitions", """
, p AS (SELECT DISTINCT cluster, trim(unnest(string_split(part, ','))) AS p FROM jobs)
SELECT cluster, p AS "Partition", upper(p[1]) || p[2:] || ' Partition' AS display_name, p || ' partition' AS description FROM p""")
def a30_partitions(c: Context):
    return generate_dims(c.jobs)["partition"]


@query("p28_p29_range_hours", f"""
SELECT {_TOTAL}::DOUBLE AS data_hours, 8784.0::DOUBLE AS year_hours, count(*) AS jobs FROM jobs""")
def p29(c: Context):
    return c.jobs.agg(data_range_hours().alias("data_hours"), F.first(range_hours("1996-01-01", "1996-12-31")).alias("year_hours"),
                      F.count("*").alias("jobs"))
