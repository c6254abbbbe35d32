import datetime as dt

import pytest
from pyspark.sql import functions as F

from conftest import rows
from jobmeter.operators import histograms as H
from jobmeter.operators import measures as M
from jobmeter.operators.filters import filter_jobs
from jobmeter.plans import dashboard as P
from jobmeter.plans import reports as R
from jobmeter.plans.export import export_report
from jobmeter.sources.sample import sample_jobs

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def jobs(spark):
    return sample_jobs(spark, SF).cache()


def test_ranges():
    assert R.report_range("monthly", 2024, 2) == (dt.date(2024, 2, 1), dt.date(2024, 2, 29))
    assert R.report_range("quarterly", 2023, 4) == (dt.date(2023, 10, 1), dt.date(2023, 12, 31))
    assert R.report_range("annual", 2023) == (dt.date(2023, 1, 1), dt.date(2023, 12, 31))
    assert R.previous_range(dt.date(2024, 2, 1), dt.date(2024, 2, 29)) == (dt.date(2024, 1, 3), dt.date(2024, 1, 31))
    with pytest.raises(ValueError):
        R.report_range("quarterly", 2024, 5)


def test_calendar_agrees_with_ranges(jobs):
    for kind, span in (("monthly", 1), ("quarterly", 3), ("annual", 12)):
        for start, end, prev_start, prev_end in rows(R.report_calendar(jobs, kind)):
            assert (start, end) == R.report_range(kind, start.year, (start.month - 1) // span + 1)
            assert (prev_start, prev_end) == R.previous_range(start, end)


def test_empty_report(jobs):
    report = R.report(jobs, "annual", 1980)
    assert set(report["summary"].first().asDict().values()) == {0}
    assert report["comparison"].count() == 0 and report["timeline"].count() == 0


def test_comparison_of_one_period_equals_that_of_all(jobs):
    every = {r.start_date: r for r in R.compare_periods(jobs, "annual").collect()}
    for year in (1996, 1999):
        one = R.report(jobs, "annual", year)["comparison"].first()
        both = every[dt.date(year, 1, 1)]
        for name in one.asDict():
            assert one[name] == pytest.approx(both[name])


def test_new_activity_counts_as_100_percent(spark):
    day = dt.datetime(2024, 2, 10)
    df = spark.createDataFrame([("u", day, 2.0, 1.0), ("u", day - dt.timedelta(days=20), 1.0, 0.0)],
                               "User string, Submit timestamp, CPUHours double, GPUHours double")
    got = R.report_comparison(df, dt.date(2024, 2, 1), dt.date(2024, 2, 29)).first()
    assert (got.cpu_hours_change_percent, got.gpu_hours_change_percent, got.users_change_percent) == (100.0, 100.0, 0.0)
    only = R.report_comparison(df.where("GPUHours > 0"), dt.date(2024, 2, 1), dt.date(2024, 2, 29))
    assert only.count() == 0


def test_breakdowns_add_up(jobs):
    report = R.report(jobs, "annual", 1997, cluster="asia")
    total = report["summary"].first()
    for section in ("by_account", "by_partition", "by_state", "timeline"):
        assert report[section].agg(F.sum("jobs")).first()[0] == total.jobs
    assert "User" not in {c for df in report.values() for c in df.columns}


def test_export(spark, jobs, tmp_path):
    report = R.report(jobs, "monthly", 1997, 3)
    for fmt in ("csv", "json"):
        assert len(export_report(report, str(tmp_path / fmt), fmt)) == 5
    back = spark.read.option("header", "true").csv(str(tmp_path / "csv" / "by_account"))
    assert back.count() == report["by_account"].count()


def test_available_periods(jobs):
    got = R.available_periods(jobs, dt.date(2001, 6, 15)).where("cluster = 'asia' and grain = 'month'").orderBy("period").collect()
    assert not got[-1].complete and got[0].complete


@pytest.mark.parametrize("color_by", [None, "Account", "User", "State"])
def test_dashboard(jobs, color_by):
    charts = P.dashboard(jobs, "month", color_by, start="1996-01-01", end="1997-12-31")
    assert len(charts) >= 24
    counted = charts["summary"].first().jobs
    assert charts["jobs_by_state"].agg(F.sum("value")).first()[0] == counted
    over_time = charts["jobs_over_time"].agg(F.sum("value")).first()[0]
    assert over_time == counted
    for name in ("active_users_distribution", "user_activity_frequency", "jobs_distribution"):
        assert charts[name].count() > 0


@pytest.mark.parametrize("color_by", [None, "Account", "User"])
def test_charts_of_the_reduced_table_are_those_of_the_jobs(jobs, color_by):
    filters = dict(start="1996-01-01", end="1997-12-31")
    charts, df = P.dashboard(jobs, "year", color_by, **filters), filter_jobs(jobs, **filters)
    dense = {"dense": True} if color_by else {}
    want = {
        "summary": M.summary(df), "cpu_usage_over_time": M.cpu_usage_over_time(df, "year", color_by, **dense),
        "jobs_over_time": M.jobs_over_time(df, "year", color_by, **dense), "active_users_over_time": M.active_users_over_time(df, "year", color_by, **dense),
        "waiting_times_over_time": M.waiting_times_over_time(df, "year"), "job_duration_over_time": M.job_duration_over_time(df, "year"),
        "jobs_by_partition": M.jobs_by(df, "Partition"), "job_duration_hist": H.value_histogram(df, "ElapsedHours", positive=True),
        "waiting_times_stacked": H.waiting_times_stacked(df, "year"), "job_duration_trends": H.trends(df, "ElapsedHours", "year", positive=True),
        "gpus_per_job": M.resources_per_job(df, "GPUs")}
    if color_by is None:
        want |= {"jobs_per_user": H.jobs_per_user_histogram(df), "cpu_hours_per_period": H.usage_histogram(df, "CPUHours", "year"),
                 "jobs_distribution": H.jobs_histogram(df, "year"), "active_users_distribution": H.active_users_histogram(df, "year"),
                 "user_activity_frequency": H.activity_histogram(df, "year")}
    else:
        want |= {"jobs_by_dimension": M.by_dimension(df, color_by), "cpu_hours_by_dimension": M.by_dimension(df, color_by, "CPUHours"),
                 "user_activity_frequency": M.activity_by_group(df, color_by, "year")}
    plain = lambda df, columns: sorted((tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in rows(df, *columns)), key=str)
    for name, df in want.items():
        assert plain(charts[name], df.columns) == plain(df, df.columns), name
    assert charts["total_hours"].first()[0] == 731 * 24.0 and charts["node_usage"].first().total_hours == 731 * 24.0


def test_charts_do_not_read_jobs_again(spark, jobs, tmp_path):
    jobs.write.parquet(str(tmp_path / "jobs"))
    charts = P.dashboard(spark.read.parquet(str(tmp_path / "jobs")), "month", "QOS")
    for name, df in charts.items():
        if name != "jobs":
            assert str(tmp_path) not in " ".join(df.inputFiles()), name
    # Without a range of days the hours are those of the data.
    ends = jobs.selectExpr("min(Submit) as a", "max(Submit) as b").first()
    assert charts["total_hours"].first()[0] == ((ends.b - ends.a).days + 1) * 24.0


def test_persisted_dashboard_gives_the_same(jobs):
    some = dict(charts=["summary", "jobs_by_state"], users=["Customer#000000001", "Customer#000000002"])
    kept, plain = P.dashboard(jobs, persist=True, **some), P.dashboard(jobs, **some)
    assert set(kept) == {"jobs", "summary", "jobs_by_state"}
    assert rows(kept["summary"]) == rows(plain["summary"])
    kept["jobs"].unpersist()


def test_metadata(jobs):
    got = P.metadata(jobs, "1997-01-01", "1997-01-31")
    assert got.where("min_date is null").count() == 0
    assert {r.cluster for r in got.select("cluster").distinct().collect()} == {r.cluster for r in jobs.select("cluster").distinct().collect()}
