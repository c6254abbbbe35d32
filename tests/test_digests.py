import datetime as dt

import pytest
from pyspark.sql import functions as F

from conftest import rows
from jobmeter.operators import histograms as H
from jobmeter.operators import measures as M
from jobmeter.operators.filters import submit_between
from jobmeter.plans import reports as R
from jobmeter.session import small_splits
from jobmeter.sources import digests as G
from jobmeter.sources import store as O
from jobmeter.sources.records import normalize_records

DAY = dt.datetime(2024, 1, 20)


def jobs(spark, *data):
    """Jobs from (id, user, days after the first, state, waiting hours)."""
    rows = [(j, u, "acc", "p", s, "q", DAY + dt.timedelta(days=d), DAY + dt.timedelta(days=d, hours=w), DAY + dt.timedelta(days=d, hours=w + 2), 8.0, 0.0, 4, 0, 1, "n1,n2")
            for j, u, d, s, w in data]
    return normalize_records(spark.createDataFrame(
        rows, "JobID string, User string, Account string, Partition string, State string, QOS string, Submit timestamp, Start timestamp, End timestamp, "
        "CPUHours double, GPUHours double, AllocCPUS int, AllocGPUS int, AllocNodes int, NodeList string"), "c")


@pytest.fixture(scope="module")
def kept(spark, tmp_path_factory):
    """A store after two upserts that change jobs, move one and empty a month, with its digests."""
    root = tmp_path_factory.mktemp("digests")
    store, digests = str(root / "store"), str(root / "digests")
    O.upsert_jobs(jobs(spark, ("1", "a", 0, "FAILED", 1), ("2", "b", 15, "COMPLETED", 5), ("3", "a", 16, "FAILED", 9), ("4", "c", 45, "COMPLETED", 2)), store, digests)
    O.upsert_jobs(jobs(spark, ("1", "a", 0, "COMPLETED", 1), ("4", "c", 17, "COMPLETED", 3), ("5", "a", 100, "COMPLETED", 7), ("6", "b", 130, "FAILED", 0)), store, digests)
    return store, digests


def same(a, b, *columns):
    columns = columns or b.columns
    assert sorted(rows(a, *columns), key=str) == sorted(rows(b, *columns), key=str)


def test_digests_follow_the_store(spark, kept, tmp_path):
    store, digests = kept
    O.build_digests(spark, store, str(tmp_path / "again"))
    for name in G.SETS:
        same(G.read_digest(spark, digests, name), G.read_digest(spark, str(tmp_path / "again"), name))
    months = {r[0] for r in rows(G.read_digest(spark, digests, "groups").select("SubmitMonth").distinct())}
    assert months == {dt.date(2024, 1, 1), dt.date(2024, 2, 1), dt.date(2024, 4, 1), dt.date(2024, 5, 1)}  # March is empty now


def test_answers_without_jobs(spark, kept):
    store, digests = kept
    table = O.read_store(spark, store)
    same(M.summary(G.read_digest(spark, digests, "groups")), M.summary(table))
    same(H.trends(G.read_digest(spark, digests, "waiting"), "WaitingTimeHours", "month"), H.trends(table, "WaitingTimeHours", "month"))
    same(H.activity_histogram(G.read_digest(spark, digests, "days"), "day"), H.activity_histogram(table, "day"))
    for kind, year, number in (("annual", 2024, 1), ("quarterly", 2024, 1), ("monthly", 2024, 2), ("monthly", 2024, 3)):
        direct, quick = R.report(table, kind, year, number), R.digest_report(spark, digests, kind, year, number)
        assert direct.keys() == quick.keys()
        for name, df in direct.items():
            same(quick[name], df)
            assert store not in " ".join(quick[name].inputFiles())


@pytest.mark.parametrize("start, end", [
    (None, None), ("2024-02-01", "2024-04-30"), ("2024-01-21", "2024-05-10"), ("2024-02-05", "2024-02-06"), ("2024-01-25", "2024-02-05"), (None, "2024-02-04"),
    ("2024-02-05", None), ("2024-02-01", "2024-02-05"), ("2024-01-10", "2024-01-31"), ("2030-01-05", "2030-01-08")])
def test_any_range(spark, kept, start, end):
    store, digests = kept
    table = O.read_store(spark, store)
    want = submit_between(table, start, end)
    found = G.digest_range(table, digests, "waiting", start, end)
    same(found.groupBy("WaitingTimeHours").agg(F.sum("_jobs").alias("n")), want.groupBy("WaitingTimeHours").agg(F.count("*").alias("n")))
    days = G.digest_range(table, digests, "days", start, end, ["c"])
    same(days.agg(F.count_distinct("User").alias("n")), want.agg(F.count_distinct("User").alias("n")))
    assert store not in " ".join(days.inputFiles()) and G.digest_range(table, digests, "groups", start, end, ["other"]).count() == 0


def test_only_cut_months_are_read_from_the_store(spark, kept):
    store, digests = kept
    found = G.digest_range(O.read_store(spark, store), digests, "waiting", "2024-01-21", "2024-05-10")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and len(found.inputFiles()) > 0
    with pytest.raises(ValueError):
        G.read_digest(spark, digests, "waiting", "2024-01-21", "2024-05-31")


def test_retention_drops_digests(spark, tmp_path):
    store, digests = str(tmp_path / "store"), str(tmp_path / "digests")
    O.upsert_jobs(jobs(spark, ("1", "a", 0, "FAILED", 1), ("2", "b", 15, "COMPLETED", 5), ("3", "a", 16, "FAILED", 9), ("4", "c", 60, "COMPLETED", 2)), store, digests)
    O.apply_retention(spark, store, 1, "2024-03-06", digests)  # keeps jobs from 5 February on
    same(M.summary(G.read_digest(spark, digests, "groups")), M.summary(O.read_store(spark, store)))
    assert G.read_digest(spark, digests, "days").agg(F.min("SubmitDay")).first()[0] == dt.date(2024, 2, 5)


def test_stores_that_differ(spark, kept, tmp_path):
    store, digests = kept
    other, other_digests = str(tmp_path / "store"), str(tmp_path / "digests")
    O.write_store(O.read_store(spark, store), other)
    O.build_digests(spark, other, other_digests)
    assert rows(O.diff_stores(spark, store, digests, other, other_digests)) == []
    # One job changes, one moves to another month, one is gone and one is new; nothing else is read than their months.
    O.upsert_jobs(jobs(spark, ("2", "b", 15, "TIMEOUT", 5), ("4", "c", 45, "COMPLETED", 3), ("7", "z", 16, "COMPLETED", 1)), other, other_digests)
    found = O.diff_stores(spark, store, digests, other, other_digests)
    assert sorted(rows(found)) == [("c", "2", "modified"), ("c", "4", "modified"), ("c", "7", "new")]
    assert sorted(rows(found)) == sorted(rows(O.diff_loads(O.read_store(spark, store), O.read_store(spark, other))))
    scanned = G.changed_buckets(spark, digests, other_digests).select("SubmitMonth").distinct()
    assert {r[0] for r in rows(scanned)} == {dt.date(2024, 2, 1), dt.date(2024, 3, 1)}
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "SubmitMonth" in plan[plan.index("PartitionFilters"):]
    back = O.diff_stores(spark, other, other_digests, store, digests)
    assert sorted(rows(back)) == [("c", "2", "modified"), ("c", "4", "modified"), ("c", "7", "deleted")]


def test_usual_months_are_gathered_once(spark, tmp_path, monkeypatch):
    """Jobs and not a row for each job and set are shuffled, once; months too large for one task are reduced by all, with the same rows."""
    table = jobs(spark, *[(str(k), f"u{k % 3}", k % 70, ("FAILED", "COMPLETED")[k % 2], k % 5) for k in range(200)])
    O.write_store(table, str(tmp_path / "store"))
    table = O.read_store(spark, str(tmp_path / "store"))
    whole, parts = str(tmp_path / "whole"), str(tmp_path / "parts")
    G.write_digests(table, whole)
    monkeypatch.setattr(G, "LARGE", 80)
    sizes = [r["count"] for r in table.groupBy(*G.MONTH_KEYS).count().collect()]
    assert min(sizes) <= 80 < max(sizes)
    G.write_digests(table, parts)
    for name in G.SETS:
        a, b = G.read_digest(spark, whole, name), G.read_digest(spark, parts, name)
        same(a, b)
        assert a.groupBy(*G.MONTH_KEYS, *G.SETS[name]).count().where("count > 1").isEmpty()
    sets = {name: keys for name, keys in G.SETS.items() if name != "rows"}
    gathered = G.reduce_by(table.repartition(3, *G.MONTH_KEYS), sets, G.MONTH_KEYS, gathered=True)
    assert gathered._jdf.queryExecution().executedPlan().toString().count("Exchange ") == 1
    same(gathered, G.reduce_by(table, sets, G.MONTH_KEYS), *gathered.columns)


def test_first_load_is_written_once(spark, tmp_path, monkeypatch):
    """Into an empty store a load goes without a staged copy."""
    calls = []
    kept = O.staged
    monkeypatch.setattr(O, "staged", lambda *a: calls.append(a[1]) or kept(*a))
    store, digests = str(tmp_path / "store"), str(tmp_path / "digests")
    for n, load in enumerate((jobs(spark, ("1", "a", 0, "FAILED", 1), ("1", "a", 0, "COMPLETED", 1)), jobs(spark, ("1", "a", 40, "COMPLETED", 1)))):
        O.upsert_jobs(load, store, digests)
        assert calls == ([], ["batch", "merged"])[n] and O.read_store(spark, store).count() == 1
    assert rows(G.read_digest(spark, digests, "groups"), "_jobs") == [(1,)]


def test_sets_are_reduced_one_at_a_time(spark, tmp_path, monkeypatch):
    """A task never makes the rows of all sets from each job at once, and rows of one job leave out what other columns tell."""
    table = jobs(spark, *[(str(k), f"u{k % 3}", k % 70, ("FAILED", "COMPLETED")[k % 2], k % 5) for k in range(60)])
    calls = []
    plain = G.reduce_by
    monkeypatch.setattr(G, "reduce_by", lambda df, sets, *a, **b: calls.append((len(sets), b.get("gathered", False))) or plain(df, sets, *a, **b))
    G.write_digests(table, str(tmp_path / "digests"))
    assert sorted(calls) == [(1, False)] + [(1, True)] * (len(G.SETS) - 1)
    raw = spark.read.schema(G.SCHEMA).parquet(str(tmp_path / "digests"))
    assert raw.where("_jobs = 1 and (_last is not null or set <> 'rows' and _hash is not null)").isEmpty()
    assert raw.where("set = 'waiting' and _jobs = 1 and _waited is not null or set = 'duration' and _jobs = 1 and _ran is not null").isEmpty()
    for name in ("groups", "days", "waiting", "duration", "lists"):
        want = plain(table, {name: G.SETS[name]}, G.MONTH_KEYS)
        same(G.read_digest(spark, str(tmp_path / "digests"), name), want, *G.MONTH_KEYS, *G.SETS[name], *G.MEASURES)


@pytest.mark.parametrize("large", (3, 500_000))
def test_merge_shuffles_whole_jobs_once(spark, monkeypatch, large):
    """Months of any size: old rows are dropped where the month is gathered."""
    monkeypatch.setattr(O, "LARGE", large)
    monkeypatch.setattr(O, "PER_TASK", 2)
    stored = jobs(spark, *[(str(k), "u", k % 2 * 40, "FAILED", 1) for k in range(20)], (None, "u", 0, "FAILED", 1))
    newer = jobs(spark, ("1", "u", 0, "COMPLETED", 2), (None, "u", 40, "COMPLETED", 2), ("30", "u", 0, "COMPLETED", 2))
    gone = stored.where("JobID = '1' or JobID is null")
    merged = O._without(stored, gone, newer)
    assert merged._jdf.queryExecution().executedPlan().toString().count("Exchange ") == 1
    want = stored.where("JobID <> '1'").unionByName(newer)
    same(merged, want)
    assert merged.columns == stored.columns


def test_gathered_months_are_not_shuffled(spark, tmp_path):
    """Written where they are, from small splits of files; the session's own setting comes back."""
    table = jobs(spark, *[(str(k), f"u{k % 3}", k % 70, "FAILED", 1) for k in range(30)])
    O.write_store(table, str(tmp_path / "one"))
    name = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(name)
    O.write_store(O.read_store(spark, str(tmp_path / "one")), str(tmp_path / "two"), gathered=True)
    with small_splits(spark, 1 << 20):
        assert spark.conf.get(name) == str(1 << 20)
    assert spark.conf.get(name) == before
    same(O.read_store(spark, str(tmp_path / "two")), O.read_store(spark, str(tmp_path / "one")))


def months_by_task(df):
    """The number of months of the tasks that have any."""
    return [r[0] for r in rows(df.groupBy(F.spark_partition_id().alias("task")).agg(F.count_distinct(*G.MONTH_KEYS).alias("n")), "n")]


def test_few_months_meet_in_a_task(spark, tmp_path, monkeypatch):
    """Months of a task's share each are gathered apart, for digests and for a merge, and not by chance several in one task."""
    table = jobs(spark, *[(f"{m}-{k}", "u", m * 31, "FAILED", 1) for m in range(40) for k in range(5)])
    monkeypatch.setattr(G, "PER_TASK", 5)
    monkeypatch.setattr(O, "PER_TASK", 5)
    found = []
    plain = G.reduce_by
    monkeypatch.setattr(G, "reduce_by", lambda df, *a, **b: (found.append(months_by_task(df)) if b.get("gathered") else None) or plain(df, *a, **b))
    G.write_digests(table, str(tmp_path / "digests"))
    merged = months_by_task(O._without(table, table.limit(0), table.limit(0)))
    assert len(found) == len(G.SETS) - 1 and sum(merged) == sum(found[0]) == 40
    assert min(len(found[0]), len(merged)) >= 32  # with as many partitions as shares, about 25 of 40 tasks have months


def test_a_large_month_is_reduced_by_one_set_after_the_other(spark, tmp_path, monkeypatch):
    table = jobs(spark, *[(str(k), f"u{k % 3}", k % 3, ("FAILED", "COMPLETED")[k % 2], k % 5) for k in range(60)])
    monkeypatch.setattr(G, "LARGE", 50)
    calls = []
    plain = G.reduce_by
    monkeypatch.setattr(G, "reduce_by", lambda df, sets, *a, **b: calls.append(list(sets)) or plain(df, sets, *a, **b))
    G.write_digests(table, str(tmp_path / "digests"))
    assert all(len(sets) == 1 for sets in calls)
    for name, keys in G.SETS.items():
        if name != "rows":
            same(G.read_digest(spark, str(tmp_path / "digests"), name), plain(table, {name: keys}, G.MONTH_KEYS), *G.MONTH_KEYS, *keys, *G.MEASURES)
    buckets = G.read_digest(spark, str(tmp_path / "digests"), "rows")
    assert buckets.agg(F.sum("_jobs")).first()[0] == 60 and buckets.where("_hash is null").isEmpty()


def test_partitions_of_a_load_are_not_joined_beyond_what_a_task_sorts(spark, tmp_path, monkeypatch):
    """A load behind joins comes in small partitions, and so do the months that digests are made from; the session's own setting comes back."""
    name = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    spark.conf.set(name, "64m")
    try:
        seen = []
        frame = type(spark.range(1))
        plain = frame.sortWithinPartitions  # called for the store and for its digests
        monkeypatch.setattr(frame, "sortWithinPartitions", lambda df, *a, **b: seen.append(spark.conf.get(name)) or plain(df, *a, **b))
        O.upsert_jobs(jobs(spark, ("1", "a", 0, "FAILED", 1)), str(tmp_path / "store"), str(tmp_path / "digests"))
        assert len(seen) >= 2 and {int(x) for x in seen} == {8 << 20}
        assert spark.conf.get(name) == "64m"
        spark.conf.set(name, "1m")
        with small_splits(spark):  # a lower one stays
            assert spark.conf.get(name) == "1m"
    finally:
        spark.conf.unset(name)
