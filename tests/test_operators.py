import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import rows
from jobmeter.functions import bins as B
from jobmeter.functions.quantiles import exact_stats
from jobmeter.operators import filters as X
from jobmeter.operators import histograms as H
from jobmeter.operators import lookups as K
from jobmeter.operators import measures as M
from jobmeter.operators import nodes as N
from jobmeter.operators import topn as L
from jobmeter.operators import windows as W
from jobmeter.operators.cleaning import fill_forward, keep_last
from jobmeter.operators.metadata import dimension_values, distinct_nodes
from jobmeter.sources.records import with_hours, with_job_periods


def ts(text):
    return dt.datetime.fromisoformat(text)


@pytest.fixture(scope="module")
def jobs(spark):
    """1000 jobs over 30 days with null waits, null starts and a user who has a third of all jobs."""
    rng = np.random.default_rng(42)
    start = ts("2023-01-01")
    data = []
    for i in range(1000):
        submit = start + dt.timedelta(minutes=int(rng.integers(0, 30 * 1440)))
        begin = None if i % 40 == 0 else submit + dt.timedelta(seconds=int(rng.exponential(3600)))
        end = None if begin is None else begin + dt.timedelta(seconds=int(rng.exponential(4 * 3600)))
        user = "hot" if i % 3 == 0 else f"user{rng.integers(0, 20)}"
        data.append((f"{i}", user, f"dep-{rng.integers(0, 12)}-x-y", ["gpu", "cpu", "cpu, short"][i % 3],
                     ["normal", None][int(i % 7 == 0)], ["COMPLETED", "FAILED", "CANCELLED", "TIMEOUT"][i % 4],
                     submit, begin, end, int(2 ** rng.integers(0, 5)), int(rng.integers(0, 3)), int(rng.integers(0, 4)),
                     ["gpu[01-02]", "cpu1,cpu2", "None assigned", None][i % 4], "main"))
    df = spark.createDataFrame(data, "JobID string, User string, Account string, Partition string, QOS string, State string, "
                               "Submit timestamp, Start timestamp, End timestamp, CPUs int, GPUs int, Nodes int, NodeList string, cluster string")
    return with_job_periods(with_hours(df)).cache()


@pytest.fixture(scope="module")
def pdf(jobs):
    return jobs.toPandas()


# Filters -------------------------------------------------------------------------------------------


def test_date_boundary(spark):
    times = ["2023-12-31 08:00:00", "2023-12-31 23:59:59", "2024-01-01 00:00:00", "2024-01-01 12:00:00",
             "2024-01-31 23:59:59", "2024-02-01 00:00:00"]
    df = spark.createDataFrame([(ts(t),) for t in times], "Submit timestamp").withColumn("SubmitYear", F.year("Submit"))
    assert X.submit_between(df, "2023-01-01", "2023-12-31").count() == 2
    assert X.submit_between(df, "2024-01-01", "2024-01-31").count() == 3
    assert X.submit_between(df, end="2024-01-01").count() == 4
    assert X.submit_between(df, start="2024-02-01").count() == 1


def test_consecutive_ranges_partition_the_rows(jobs):
    parts = [X.submit_between(jobs, f"2023-01-{a:02d}", f"2023-01-{b:02d}").count() for a, b in ((1, 10), (11, 20), (21, 31))]
    assert sum(parts) == 1000


def test_dimension_filters(jobs, pdf):
    assert X.filter_jobs(jobs, partitions=["short"]).count() == (pdf.Partition == "cpu, short").sum()
    assert X.filter_jobs(jobs, partitions=["cpu"]).count() == pdf.Partition.isin(["cpu", "cpu, short"]).sum()
    got = X.filter_jobs(jobs, users=["hot"], states=["FAILED", "TIMEOUT"], qos=["normal"]).count()
    assert got == ((pdf.User == "hot") & pdf.State.isin(["FAILED", "TIMEOUT"]) & (pdf.QOS == "normal")).sum()


def test_complete_periods(spark):
    days = ["2022-12-30", "2023-01-15", "2023-02-03", "2023-02-13", "2023-02-15"]
    df = spark.createDataFrame([(ts(d),) for d in days], "Submit timestamp")
    as_of = dt.date(2023, 2, 16)
    assert rows(X.complete_periods(df, "month", as_of)) == [(dt.date(2022, 12, 1),), (dt.date(2023, 1, 1),)]
    assert [r[0] for r in rows(X.complete_periods(df, "week", as_of))][-1] == dt.date(2023, 1, 30)
    assert rows(X.complete_periods(df, "year", as_of)) == [(dt.date(2022, 1, 1),)]
    assert X.complete_only(df, "day", as_of).count() == 5


def test_account_formatting(jobs):
    assert X.format_accounts(jobs, 2).select("Account").distinct().where(~F.col("Account").rlike(r"^dep-\d+$")).count() == 0
    same = X.format_accounts(jobs, lambda a: 1 / 0)
    assert rows(same.select("Account").orderBy("JobID")) == rows(jobs.select("Account").orderBy("JobID"))


def test_search(jobs):
    found = {tuple(r) for r in X.search_values(jobs, "GP").collect()}
    assert found == {("Partition", "gpu")}


# Timelines and totals ------------------------------------------------------------------------------


@pytest.mark.parametrize("grain", ["day", "week", "month", "year"])
def test_series_add_up_to_the_total(jobs, grain):
    whole = dict(rows(M.jobs_over_time(jobs, grain)))
    by_state = M.jobs_over_time(jobs, grain, "State", dense=True)
    assert dict(rows(M.collapse_series(by_state))) == whole
    assert by_state.count() == len(whole) * 4


def test_start_based_timeline_skips_jobs_without_start(jobs, pdf):
    total = M.cpu_usage_over_time(jobs, "week").agg(F.sum("value")).first()[0]
    assert total == pytest.approx(pdf.CPUHours[pdf.Start.notna()].sum())


def test_mean_wait(jobs, pdf):
    got = dict(rows(M.waiting_times_over_time(jobs, "day")))
    want = pdf.dropna(subset=["WaitingTimeHours"]).groupby("SubmitDay").WaitingTimeHours.mean()
    assert got == pytest.approx(want.to_dict())


def test_empty_input(jobs):
    none = jobs.where("false")
    assert rows(M.summary(none)) == [(0, 0.0, 0.0, 0)]
    assert M.jobs_over_time(none, "day").count() == 0
    assert M.by_dimension(none, "User").count() == 0
    assert H.trends(none, "WaitingTimeHours", "month").count() == 0
    assert rows(H.column_stats(none, "ElapsedHours")) == [(0.0,) * 7]
    assert H.jobs_per_user_histogram(none).count() == 0
    assert H.activity_histogram(none).count() == 0
    assert set(rows(H.value_histogram(none, "WaitingTimeHours"), "count", "percent")) == {(0, 0.0)}


def test_active_periods_and_activity(jobs, pdf):
    got = dict(rows(M.activity_by_group(jobs, "Partition", "day"), "label", "value"))
    want = pdf.groupby(["Partition", "User"]).SubmitDay.nunique().groupby("Partition").sum()
    assert got == want.to_dict()
    per_user = dict(rows(M.periods_per_user(jobs, "day", "Submit", top=3), "label", "value"))
    counts = pdf.groupby("User").SubmitDay.nunique()
    assert per_user["hot"] == counts["hot"] and sum(per_user.values()) == counts.sum()


def test_orders(jobs, pdf):
    got = [tuple(r) for r in M.series_order(jobs, "User", "nunique", "State").collect()]
    assert got == sorted(got, key=lambda r: (-r[1], r[0])) and dict(got) == pdf.groupby("State").User.nunique().to_dict()
    totals_ = M.jobs_by(jobs, "Account", None)
    by = [r.value for r in L.by_metric(totals_, "value", "label").collect()]
    assert by == sorted(by, reverse=True)
    days = [r.period for r in L.chronological(M.jobs_over_time(jobs, "day")).collect()]
    assert days == sorted(days)
    assert [r.jobs for r in M.category_order(jobs, "State").collect()] == [250] * 4


def test_resources_per_job(jobs, pdf):
    got = dict(rows(M.resources_per_job(jobs, "GPUs")))
    assert got == pdf.GPUs[pdf.GPUs > 0].value_counts().to_dict()


def test_describe(jobs, pdf):
    got = {r.period: r for r in M.describe_by_period(jobs, "WaitingTimeHours", "week").collect()}
    want = pdf.groupby("SubmitWeek").WaitingTimeHours.describe()
    for period, w in want.iterrows():
        r = got[period]
        assert [r["count"], r.mean, r["std"], r["min"], r.p25, r.p50, r.p75, r["max"]] == pytest.approx(list(w))


# Top groups ----------------------------------------------------------------------------------------


def totals(spark, pairs, kind="long"):
    return spark.createDataFrame(pairs, f"label string, value {kind}")


def test_top_n_others(spark):
    agg = totals(spark, [("a", 5), ("b", 5), ("c", 3), ("d", 2), ("e", 1)])
    assert rows(L.top_n_others(agg, 3)) == [(1, "a", 5), (2, "b", 5), (3, "c", 3), (4, "Others (2)", 3)]
    assert rows(L.top_n_others(agg, 5), "label")[-1] == ("e",)
    assert rows(L.top_n_others(agg, 4), "label", "value")[-1] == ("Others (1)", 1)
    assert rows(L.pie_top(agg, 3), "label", "value") == [("a", 5), ("b", 5), ("Other", 6)]


def test_others_left_out_when_their_sum_is_zero(spark):
    agg = totals(spark, [("a", 5.0), ("b", 0.0), ("c", 0.0)], "double")
    assert rows(L.top_n_others(agg, 1), "label") == [("a",)]


def test_share_and_order(spark):
    agg = totals(spark, [("a", 1), ("b", 3)])
    assert dict(rows(L.share(agg), "label", "percent")) == {"a": 25.0, "b": 75.0}
    nodes = spark.createDataFrame([("cpu11", 1.0), ("cpu2", 9.0), ("gpu1", 5.0)], "node string, value double")
    assert [r.node for r in L.order_nodes(nodes, "name").collect()] == ["cpu11", "cpu2", "gpu1"]
    assert [r.node for r in L.order_nodes(nodes, "natural").collect()] == ["cpu2", "cpu11", "gpu1"]
    assert [r.node for r in L.order_nodes(nodes, "value").collect()] == ["cpu2", "gpu1", "cpu11"]


# Histograms and percentiles ------------------------------------------------------------------------


def test_exact_stats_against_numpy(spark):
    rng = np.random.default_rng(7)
    hot = np.concatenate([np.zeros(3000), rng.lognormal(2, 3, 2000), -rng.exponential(5, 500), [1e-9, 1e12, -1e12]])
    groups = {"hot": hot, "ties": rng.integers(0, 3, 501).astype(float), "one": np.array([4.25]), "two": np.array([1.0, 2.0])}
    data = [(g, float(v)) for g, vs in groups.items() for v in vs] + [("hot", None), (None, 1.0), ("nothing", None)]
    df = spark.createDataFrame(data, "g string, v double").repartition(5)
    probs = {f"q{i}": p for i, p in enumerate([0, 0.01, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99, 1])}
    got = {r.g: r for r in exact_stats(df, "v", probs, ["g"]).collect()}
    assert set(got) == set(groups)
    for g, vs in groups.items():
        assert [got[g][q] for q in probs] == pytest.approx(list(np.quantile(vs, list(probs.values()))))
        assert (got[g]["count"], got[g]["min"], got[g]["max"]) == (len(vs), vs.min(), vs.max())
    whole = exact_stats(df.where("g = 'ties'"), "v", probs).first()
    assert [whole[q] for q in probs] == pytest.approx(list(np.quantile(groups["ties"], list(probs.values()))))


def test_trends(jobs, pdf):
    got = {r.period: r for r in H.trends(jobs, "ElapsedHours", "week", positive=True).collect()}
    for period, g in pdf[pdf.ElapsedHours > 0].groupby("StartWeek").ElapsedHours:
        r = got[period]
        assert [r.mean, r["max"], r.median, r.p25, r.p90, r.p99] == pytest.approx(
            [g.mean(), g.max(), g.median(), g.quantile(.25), g.quantile(.9), g.quantile(.99)])


@pytest.mark.parametrize("stat", ["mean", "max", "median", "p75"])
def test_trend_by_group_is_dense(jobs, stat):
    got = H.trend_by_group(jobs, "WaitingTimeHours", "week", "State", stat)
    periods = got.select("period").distinct().count()
    assert got.count() == periods * 4 and got.where("value is null").count() == 0


def test_value_histogram(jobs, pdf):
    got = H.value_histogram(jobs, "WaitingTimeHours").orderBy("bin").collect()
    waits = pdf.WaitingTimeHours.dropna()
    counts, _ = np.histogram(waits, bins=[0, 1, 4, 12, 24, 72, 168, np.inf])
    assert [r["count"] for r in got] == list(counts)
    assert sum(r.percent for r in got) == pytest.approx(100)
    assert got[0].median == pytest.approx(waits.median())


def test_stacked_bins_add_up_to_100(jobs):
    for df in (H.job_duration_stacked(jobs, "day"), H.waiting_times_stacked(jobs, "week")):
        for (percent,) in rows(df.where("total > 0").groupBy("period").agg(F.sum("percent").alias("p")), "p"):
            assert percent == pytest.approx(100)


def test_negative_values_leave_the_denominator(spark):
    df = spark.createDataFrame([(dt.date(2024, 1, 1), -5.0), (dt.date(2024, 1, 1), 2.0), (dt.date(2024, 1, 1), None),
                                (dt.date(2024, 2, 1), -1.0)], "StartMonth date, v double").withColumn("SubmitMonth", F.col("StartMonth"))
    got = {(r.period.month, r.label): r.percent for r in H.stacked_bins(df, "v", "month", B.DURATION_BINS).collect()}
    assert got[(1, "1h-4h")] == 100.0 and got[(1, "< 1h")] == 0.0 and got[(2, "< 1h")] is None
    legacy = {(r.period.month, r.label): r.percent for r in H.stacked_bins_of_all(df, "v", "month", B.DURATION_BINS).collect()}
    assert legacy[(1, "1h-4h")] == pytest.approx(100 / 3)


@pytest.mark.parametrize("values, n", [
    ([1, 2, 3, 4, 5, 6, 7, 8, 9, 10], 5), ([3, 3, 3], 5), ([7], 20), (list(range(0, 101)), 20), ([0, 1, 1, 2, 29, 30, 30], 7)])
def test_equal_width_like_numpy(spark, values, n):
    df = spark.createDataFrame([(float(v),) for v in values], "v double")
    got = B.equal_width(df, "v", F.lit(n)).orderBy("bin").collect()
    counts, edges = np.histogram(values, bins=n)
    assert [r["count"] for r in got] == list(counts)
    assert [r.lower for r in got] + [got[-1].upper] == pytest.approx(list(edges))


def test_equal_width_random_integers(spark):
    rng = np.random.default_rng(3)
    for n in (10, 13, 30):
        values = rng.integers(0, 1000, 400)
        df = spark.createDataFrame([(int(v),) for v in values], "v int")
        got = [r["count"] for r in B.equal_width(df, "v", F.lit(n)).orderBy("bin").collect()]
        assert got == list(np.histogram(values, bins=n)[0])


@pytest.mark.parametrize("most, labels", [
    (3, ["1", "2", "3"]), (10, [str(i) for i in range(1, 11)]), (11, ["1-5", "6-10", "11-11"]),
    (12, ["1-5", "6-10", "11-12"]), (30, ["1-5", "6-10", "11-15", "16-20", "21-25", "26-30"]), (31, ["1-10", "11-20", "21-30", "31-31"])])
def test_activity_bins(spark, most, labels):
    first = dt.date(2024, 1, 1)
    data = [("busy", first + dt.timedelta(days=i)) for i in range(most)] + [("once", first)]
    df = spark.createDataFrame(data, "User string, SubmitDay date")
    got = H.activity_histogram(df, "day").orderBy("bin").collect()
    assert [r.label for r in got] == labels
    assert got[0].users + got[-1].users == 2 and sum(r.users for r in got) == 2
    assert got[0].total_periods == most and got[0].total_users == 2 and got[0].average == (most + 1) / 2


# Nodes and lookups ---------------------------------------------------------------------------------


def test_node_usage_credits_every_node(spark):
    data = [("gpu[01-02]", 4.0, 2.0), ("gpu01", 1.0, 0.0), ("None assigned", 9.0, 9.0), (None, 9.0, 9.0), ("cpu1", 0.0, 0.0)]
    df = spark.createDataFrame(data, "NodeList string, CPUHours double, GPUHours double")
    cpu = lambda u: dict(rows(u.where("resource = 'cpu'"), "node", "value"))
    assert cpu(N.node_usage(df)) == {"gpu01": 5.0, "gpu02": 4.0, "cpu1": 0.0}
    assert cpu(N.node_usage(df, hide_unused=True)) == {"gpu01": 5.0, "gpu02": 4.0}
    assert cpu(N.node_usage(df, split=True)) == {"gpu01": 3.0, "gpu02": 2.0, "cpu1": 0.0}
    arrays = spark.createDataFrame([(["gpu5"], 1.0, 0.0), (["gpu05", "gpu30"], 2.0, 0.0)], "NodeList array<string>, CPUHours double, GPUHours double")
    assert cpu(N.node_usage(arrays)) == {"gpu5": 1.0, "gpu05": 2.0, "gpu30": 2.0}


def small_dims(spark):
    make = spark.createDataFrame
    return {
        "synonym": make([("m", "gpu01", "gpu01"), ("m", "GPU1", "gpu01"), ("m", "login1", "login1")], "cluster string, name string, node string"),
        "node": make([("m", "gpu01", "gpu", "first", 48, 4), ("m", "login1", "login", "door", None, None)],
                     "cluster string, node string, type string, description string, cpu_cores int, gpu_count int"),
        "pattern": make([(0, "a", r"^ibex\d+", 96, 8), (1, "b", r"^inf", 1, 1)], "priority int, name string, pattern string, cpu_cores int, gpu_count int"),
        "type_default": make([("login", 8, 0)], "type string, cpu_cores int, gpu_count int"),
        "settings": make([("cpu", False, True)], "default_node_type string, case_sensitive boolean, auto_generate_labels boolean"),
        "account": make([("m", "a", "Alpha", "A")], "cluster string, Account string, display_name string, short_name string"),
        "partition": make([("m", "p", "Pi", "the p")], "cluster string, Partition string, display_name string, description string"),
        "cluster": make([("m", "Main", True), ("old", "Old", False)], "cluster string, display_name string, active boolean"),
    }


def test_hardware_lookup_order(spark):
    names = spark.createDataFrame([("gpu01",), ("GPU1",), ("gpu1",), ("IBEX7",), ("info",), ("login1",), ("other",)], "node string")
    got = {r.node: (r.cpu_cores, r.gpu_count) for r in N.with_hardware(names, small_dims(spark), "m").collect()}
    assert got == {"gpu01": (48, 4), "GPU1": (48, 4), "gpu1": (48, 4), "IBEX7": (96, 8), "info": (1, 1), "login1": (8, 0), "other": (64, 0)}


def test_synonyms_and_unknown_nodes(spark):
    dims = small_dims(spark)
    names = spark.createDataFrame([("Gpu1",), ("GPU1",), ("x",)], "node string")
    assert {r.node for r in N.canonical_node(names, dims["synonym"]).collect()} == {"gpu01", "x"}
    strict = N.canonical_node(names, dims["synonym"], case_sensitive=True)
    assert {r.node for r in strict.collect()} == {"Gpu1", "gpu01", "x"}
    df = spark.createDataFrame([("gpu[01-02],GPU1",)], "NodeList string")
    assert rows(N.unknown_nodes(df, dims["synonym"])) == [("gpu02",)]


def test_legacy_resources(spark):
    names = spark.createDataFrame([("n1",), ("gpu7",), ("n9",), ("z",)], "node string")
    entries = spark.createDataFrame([("n1", 64, 4)], "node string, cpus int, gpus int")
    patterns = spark.createDataFrame([(0, "gpu*", 32, 8), (1, "*9", 128, None)], "priority int, pattern string, cpus int, gpus int")
    got = {r.node: (r.cpus, r.gpus) for r in N.with_legacy_resources(names, entries, patterns, 16).collect()}
    assert got == {"n1": (64, 4), "gpu7": (32, 8), "n9": (128, 0), "z": (16, 0)}


def test_utilisation(spark):
    usage = spark.createDataFrame([("gpu01", "cpu", 480.0), ("gpu01", "gpu", 1e6), ("login1", "gpu", 5.0)], "node string, resource string, value double")
    used = N.node_utilisation(usage, small_dims(spark), 24, "m")
    assert {(r.node, r.resource): r.value for r in used.collect()} == pytest.approx(
        {("gpu01", "cpu"): 480 / (48 * 24) * 100, ("gpu01", "gpu"): 100.0, ("login1", "gpu"): 0.0})
    idle = spark.createDataFrame([("gpu01",), ("gpu09",)], "node string")
    mean = dict(rows(N.cluster_utilisation(used, idle)))
    assert mean["cpu"] == pytest.approx(480 / (48 * 24) * 100 / 2)
    assert mean["gpu"] == pytest.approx(100 / 3)


def test_labels_and_registry(spark):
    dims = small_dims(spark)
    df = spark.createDataFrame([("m", "a", "p"), ("m", "b", "q"), ("old", "a", "p")], "cluster string, Account string, Partition string")
    got = {(r.cluster, r.Account): tuple(r)[3:] for r in K.with_labels(df, dims).collect()}
    assert got[("m", "a")] == ("Alpha", "A", "Pi", "the p", "Main")
    assert got[("m", "b")] == ("b", "b", "q", "q partition", "Main")
    assert K.active_clusters(df, dims["cluster"]).count() == 2
    assert K.active_clusters(df, None).count() == 3


def test_dimension_values(jobs, pdf):
    got = {}
    for d, v in rows(dimension_values(jobs)):
        got.setdefault(d, set()).add(v)
    assert got["Partition"] == {"gpu", "cpu", "short"} and got["QOS"] == {"normal"}
    assert got["User"] == set(pdf.User) and len(got["State"]) == 4
    assert {r.node for r in distinct_nodes(jobs).collect()} == {"gpu01", "gpu02", "cpu1", "cpu2"}


# Ordered operators ---------------------------------------------------------------------------------


def test_fill_forward_over_files_and_splits(spark):
    data = [("f1", 0, 1, "a", None), ("f1", 0, 2, None, "x"), ("f1", 100, 1, None, None), ("f1", 200, 1, None, None),
            ("f1", 200, 2, "b", None), ("f1", 300, 5, None, None), ("f2", 0, 1, None, None), ("f2", 0, 2, "c", None)]
    df = spark.createDataFrame(data, "_file string, _split long, _line long, a string, b string").repartition(4)
    got = rows(fill_forward(df, ["a", "b"]).orderBy("_file", "_split", "_line"), "a", "b")
    assert got == [("a", None), ("a", "x"), ("a", "x"), ("a", "x"), ("b", "x"), ("b", "x"), (None, None), ("c", None)]


def test_keep_last(spark):
    data = [("m", "1", "A", 1), ("m", "1", "B", 3), ("m", "1", "C", 2), ("n", "1", "D", 1), ("m", "2", "E", 1), ("m", "2", "F", 1)]
    df = spark.createDataFrame(data, "cluster string, JobID string, State string, ingest_seq long")
    once = keep_last(df)
    assert set(rows(once, "cluster", "JobID", "State")) == {("m", "1", "B"), ("n", "1", "D"), ("m", "2", "F")}
    assert sorted(rows(keep_last(once))) == sorted(rows(once))


def test_running_totals_peaks_and_alignment(spark):
    day = lambda n: dt.date(2024, 1, n)
    line = spark.createDataFrame([(day(1), 2, 1.0), (day(2), 5, 4.0), (day(3), 5, 0.5)], "date date, jobs long, cpu_hours double")
    assert rows(W.cumulative(line, ["jobs"]).orderBy("date"), "cumulative_jobs") == [(2,), (7,), (12,)]
    peak = W.peaks(line, ["jobs", "cpu_hours"]).first()
    assert (peak.peak_jobs, peak.peak_jobs_date, peak.mean_jobs, peak.peak_cpu_hours_date) == (5, day(2), 4.0, day(2))
    before = spark.createDataFrame([(dt.date(2023, 12, 30), 9, 1.0), (dt.date(2023, 12, 31), 8, 1.0)], line.schema)
    got = rows(W.align_previous(line, before, ["jobs"]).orderBy("date"), "date", "jobs", "previous_jobs")
    assert got == [(day(1), 2, 9), (day(2), 5, 8), (day(3), 5, None)]


def test_snapshot_diff(spark):
    a = spark.createDataFrame([("1",), ("2",)], "JobID string")
    b = spark.createDataFrame([("2",), ("3",)], "JobID string")
    assert set(rows(W.snapshot_diff(a, b))) == {("3", "new"), ("1", "gone")}


def test_fill_categories(spark):
    totals_ = spark.createDataFrame([("a", 3), ("z", 1)], "State string, value long")
    known = spark.createDataFrame([("a",), ("b",)], "State string")
    assert dict(rows(M.fill_categories(totals_, known, "State"))) == {"a": 3, "b": 0, "z": 1}
