import datetime as dt
import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from conftest import rows
from jobmeter.operators.metadata import with_nodes
from jobmeter.schema import DUMP_FIELDS, JOBS
from jobmeter.sources import dims as C
from jobmeter.sources import dump as U
from jobmeter.sources import history as Y
from jobmeter.sources import records as S
from jobmeter.sources import store as O


def ts(text):
    return dt.datetime.fromisoformat(text)


# History -------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def history(spark, tmp_path_factory):
    """Three clusters: weekly files with arrays, ingested files with text, and both dialects side by side."""
    root = tmp_path_factory.mktemp("history")
    old = spark.createDataFrame(
        [("u1", "a-b", "gpu", "q", "COMPLETED", ts("2024-01-01 01:00"), ts("2024-01-01 02:00"), 1.0, 2.0, 1, 4, 0,
          ["gpu01", "gpu02"], 8.0, 0.0, ts("2024-01-01"))],
        "User string, Account string, Partition string, QOS string, State string, Submit timestamp, Start timestamp, "
        "`WaitingTime [h]` double, `Elapsed [h]` double, Nodes int, CPUs int, GPUs int, NodeList array<string>, "
        "`CPU-hours` double, `GPU-hours` double, SubmitYearWeek timestamp")
    new = spark.createDataFrame(
        [("7", "u2", "a-c", "cpu", None, "FAILED", ts("2024-02-01 01:00"), ts("2024-02-01 01:30"), ts("2024-02-01 03:30"), 8, 1, 2,
          "cpu[1-2]", 16.0, 2.0, "2024-01-29")],
        "JobID string, User string, Account string, Partition string, QOS string, State string, Submit timestamp, Start timestamp, "
        "End timestamp, AllocCPUS int, AllocGPUS int, AllocNodes int, NodeList string, CPUHours double, GPUHours double, SubmitYearWeek string")
    text = old.withColumns({"NodeList": F.lit("cpu5"), "CPUHours": F.lit(99.0)})
    old.write.parquet(f"{root}/weekly/weekly-data")
    new.write.parquet(f"{root}/ingested/data")
    old.coalesce(1).write.mode("append").parquet(f"{root}/mixed/data")
    new.coalesce(1).write.mode("append").parquet(f"{root}/mixed/data")
    text.coalesce(1).write.mode("append").parquet(f"{root}/mixed/data")
    (root / "mixed" / "weekly-data").mkdir()
    return str(root)


def test_scan_history(spark, history):
    assert Y.list_clusters(spark, history) == ["ingested", "mixed", "weekly"]
    jobs = Y.scan_history(spark, history)
    assert jobs.schema.names == JOBS.names
    assert dict(rows(jobs.groupBy("cluster").count())) == {"weekly": 1, "ingested": 1, "mixed": 3}
    first = jobs.where("cluster = 'weekly'").first()
    assert (first.CPUHours, first.WaitingTimeHours, first.ElapsedHours, first.NodeList) == (8.0, 1.0, 2.0, ["gpu01", "gpu02"])
    assert first.JobID.startswith("h") and first.SubmitWeek == dt.date(2024, 1, 1) and first.End is None
    second = jobs.where("cluster = 'ingested'").first()
    assert (second.JobID, second.CPUs, second.Nodes, second.WaitingTimeHours, second.ElapsedHours) == ("7", 8, 2, 0.5, 2.0)
    assert second.SubmitWeek == dt.date(2024, 1, 29) and second.NodeList == ["cpu1", "cpu2"]


def test_mixed_node_lists(spark, history):
    jobs = Y.scan_history(spark, history, ["mixed"])
    assert sorted(r.node for r in with_nodes(jobs).collect()) == ["cpu1", "cpu2", "cpu5", "gpu01", "gpu02"]
    # The new name wins over the old one where a file has both.
    assert jobs.agg(F.max("CPUHours")).first()[0] == 99.0


def test_schema_groups_keep_equal_files_together(spark, history):
    paths = Y.history_files(spark, history, ["mixed"])
    assert sorted(len(g) for g in Y.schema_groups(spark, paths)) in ([1, 1, 1], [1, 2])


def test_interleaved_types_take_no_more_jobs(spark, tmp_path):
    def jobs_for(n, group):
        folder = str(tmp_path / group)
        for k in range(n):
            one = spark.range(1).select(F.lit("a").alias("User"), (F.lit("n1") if k % 2 else F.array(F.lit("n1"))).alias("NodeList"))
            one.coalesce(1).write.mode("append").parquet(folder)
        paths = sorted(str(f) for f in Path(folder).glob("*.parquet"))
        paths = [f"file:{p}" for p in paths]
        spark.sparkContext.setJobGroup(group, group)
        groups = Y.schema_groups(spark, paths)
        taken = len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
        spark.sparkContext.setJobGroup("rest", "rest")
        assert sorted(map(len, groups)) == [n // 2, n // 2] and sorted(sum(groups, [])) == paths
        return taken

    assert jobs_for(16, "few") == jobs_for(40, "many")


def test_kept_catalogue_reads_new_files_only(spark, history, tmp_path):
    at = str(tmp_path / "catalogue")
    weekly, mixed = Y.history_files(spark, history, ["weekly"]), Y.history_files(spark, history, ["mixed"])
    first = rows(Y.file_catalogue(spark, weekly, at), "file", "size", "time")
    assert sorted(r[0] for r in first) == sorted(weekly)
    # Entries whose size and time are those of the file are taken as they are.
    marked = spark.read.parquet(f"{at}/v0").withColumn("columns", F.create_map(F.lit("mark"), F.lit("x")))
    marked.write.parquet(f"{at}/v1")
    both = {r.file: r.columns for r in Y.file_catalogue(spark, weekly + mixed, at).collect()}
    assert both.keys() == {*weekly, *mixed}
    assert [both[f] for f in weekly] == [{"mark": "x"}] * len(weekly) and all("NodeList" in both[f] for f in mixed)
    # A scan of some clusters keeps what is known of the others; a changed file is read again.
    assert Y.file_catalogue(spark, mixed, at).count() == 3
    changed = spark.read.parquet(f"{at}/v2").withColumn("time", F.col("time") - 1)
    changed.write.parquet(f"{at}/v3")
    again = {r.file: r.columns for r in Y.file_catalogue(spark, weekly, at).collect()}
    assert all("NodeList" in again[f] for f in weekly)
    assert spark.read.parquet(f"{at}/v4").count() == len(weekly) + 3


def test_missing_history(spark, tmp_path):
    (tmp_path / "empty").mkdir()
    with pytest.raises(FileNotFoundError):
        Y.scan_history(spark, str(tmp_path))


# Accounting dump -----------------------------------------------------------------------------------


def dump_line(**fields):
    return "|".join(fields.get(f, "") for f in DUMP_FIELDS)


@pytest.fixture(scope="module")
def dump(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("dump")
    common = dict(QOS="normal", Account="a-b", Partition="cpu", Submit="2024-01-01T00:00:00", Start="2024-01-01T01:00:00",
                  End="2024-01-02T01:00:00", Elapsed="1-00:00:00", NodeList="n[1-2]", AllocTRES="cpu=4,gres/gpu=1,mem=8G,node=2", Cluster="m")
    lines = ["|".join(DUMP_FIELDS)]
    for job, user, state in (("1", "ann", "COMPLETED"), ("2", "béa", "CANCELLED by 7"), ("3", "", "FAILED"), ("4", "dan", "RUNNING"), ("5", "eve", "TIMEOUT")):
        lines.append(dump_line(**common | dict(JobID=job, User=user, State=state)))
        step = common | dict(QOS="", Partition="", State="COMPLETED" if state != "RUNNING" else state)
        lines.append(dump_line(**step | dict(JobID=f"{job}.batch", MaxRSS=f"{job}00K")))
        lines.append(dump_line(**step | dict(JobID=f"{job}.extern", AveDiskRead=f"{job}M", MaxRSS="9K")))
    lines.append(dump_line(**common | dict(JobID="6", User="fay", State="COMPLETED", Submit="None")))
    lines.append(dump_line(**common | dict(JobID="7", User="gus", State="COMPLETED", Submit="2024-03-01T00:00:00", Start="Unknown", AllocTRES="")))
    (path / "dump.txt").write_bytes("\n".join(lines).encode("latin-1"))
    return str(path)


def test_normalize_dump(spark, dump):
    jobs = U.normalize_dump(U.read_dump(spark, dump))
    got = {r.JobID: r for r in jobs.collect()}
    assert set(got) == {"1", "2", "5", "7"}  # no user, running and no submit time are left out
    one = got["1"]
    assert (one.CPUs, one.GPUs, one.Nodes, one.ElapsedHours, one.CPUHours, one.GPUHours) == (4, 1, 2, 24.0, 96.0, 24.0)
    assert (one.WaitingTimeHours, one.NodeList, one.cluster, one.SubmitMonth) == (1.0, ["n1", "n2"], "m", dt.date(2024, 1, 1))
    assert got["2"].State == "CANCELLED" and got["2"].User == "béa"
    assert [got[j].MaxRSS for j in "125"] == ["100K", "200K", "500K"] and got["2"].AveDiskRead == "2M" and got["7"].MaxRSS is None
    assert got["7"].CPUHours == 0.0 and got["7"].Start is None


def test_dump_window_and_raw_fill(spark, dump):
    lines = U.read_dump(spark, dump)
    assert U.normalize_dump(lines, start="2024-02-01").select("JobID").collect()[0].JobID == "7"
    # Filling down the file crosses from one job to the next: job 2 gets the metrics of the last step of job 1.
    crossed = {r.JobID: r.MaxRSS for r in U.normalize_dump(lines, fill="file").collect()}
    assert crossed["1"] is None and crossed["2"] == "9K"
    assert {r.JobID: r.MaxRSS for r in U.normalize_dump(lines, fill=None).collect()}["2"] is None


def test_fill_down_does_not_depend_on_splits(spark, tmp_path):
    lines = ["|".join(DUMP_FIELDS)] + [dump_line(JobID=str(i), User="u" if i % 50 == 0 else "", AveCPU=f"c{i}" if i % 333 == 0 else "") for i in range(3000)]
    (tmp_path / "big.txt").write_text("\n".join(lines))
    from jobmeter.operators.cleaning import fill_forward
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        df = U.read_dump(spark, str(tmp_path))
        assert df.rdd.getNumPartitions() > 3
        got = {int(r.JobID): (r.User, r.AveCPU) for r in fill_forward(df, ["User", "AveCPU"]).collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert got == {i: ("u", f"c{i // 333 * 333}") for i in range(3000)}


def test_batch_summary(spark):
    df = spark.createDataFrame([(ts("2024-01-01"), 1.0, 0.0), (ts("2024-01-07 23:00"), 2.0, 1.0), (ts("2024-01-08"), 4.0, 0.0)],
                               "Submit timestamp, CPUHours double, GPUHours double")
    got = {r.chunk: (r.jobs, r.cpu_hours) for r in U.batch_summary(df, "2024-01-01").collect()}
    assert got == {0: (2, 3.0), 1: (1, 4.0), None: (3, 7.0)}


# Records and config --------------------------------------------------------------------------------


def test_records(spark, tmp_path):
    rec = {"JobID": "1", "User": "u", "Account": "a", "Partition": "p", "State": "COMPLETED", "Submit": "2024-01-01T00:00:00",
           "Start": "2024-01-01T00:30:00", "NodeList": "n[1-2]"}
    (tmp_path / "r.json").write_text(json.dumps(rec) + "\n" + json.dumps(rec | {"JobID": "2", "Start": None, "AllocCPUS": 4, "CPUHours": 1.5}))
    got = {r.JobID: r for r in S.normalize_records(S.read_records(spark, str(tmp_path)), "m").collect()}
    assert (got["1"].CPUs, got["1"].CPUHours, got["1"].WaitingTimeHours, got["1"].NodeList) == (0, 0.0, 0.5, ["n1", "n2"])
    assert (got["2"].CPUs, got["2"].CPUHours, got["2"].WaitingTimeHours, got["2"].StartDay) == (4, 1.5, None, None)


def test_strict_times_fail(spark):
    df = spark.createDataFrame([("nonsense",)], "t string")
    assert rows(df.select(S.parse_time("t", strict=False))) == [(None,)]
    with pytest.raises(Exception):
        df.select(S.parse_time("t")).collect()


def test_load_dims(spark, tmp_path):
    config = {"clusters": {"m": {"display_name": "Main", "node_labels": {
        "gpu01": {"synonyms": ["g1"], "type": "gpu", "description": "d", "hardware": {"cpu": {"cores": 48}, "gpus": [{"count": 4}]}},
        "cpu1": {"synonyms": [], "type": "cpu", "description": "e"}}, "account_labels": {"a": {"display_name": "A", "short_name": "S"}},
        "partition_labels": {"p": {"display_name": "P", "description": "pp"}}}},
        "settings": {"default_node_type": "cpu", "hardware_defaults": {"cpu": {"cpu_cores": 32, "gpu_count": 0}},
                     "node_type_patterns": [{"name": "x", "pattern": "^x", "cpu_cores": 3}, {"name": "y", "pattern": "^y"}]}}
    path = tmp_path / "c.json"
    path.write_text(json.dumps(config, indent=1))
    dims = C.load_dims(spark, str(path))
    assert {(r.node, r.cpu_cores, r.gpu_count) for r in dims["node"].collect()} == {("gpu01", 48, 4), ("cpu1", None, None)}
    assert {(r.name, r.node) for r in dims["synonym"].collect()} == {("g1", "gpu01"), ("gpu01", "gpu01"), ("cpu1", "cpu1")}
    assert rows(dims["pattern"].orderBy("priority"), "pattern", "cpu_cores", "gpu_count") == [("^x", 3, 0), ("^y", 48, 0)]
    assert dims["cluster"].first().active is True


# Store ---------------------------------------------------------------------------------------------


def record(job, submit, state="COMPLETED", seq=1, cluster="m"):
    return (cluster, job, "u", "a", "p", state, ts(submit), ts(submit) + dt.timedelta(hours=1), seq, 2)


def batch(spark, *data):
    df = spark.createDataFrame(list(data), "cluster string, JobID string, User string, Account string, Partition string, State string, "
                               "Submit timestamp, Start timestamp, ingest_seq long, CPUs int")
    df = df.withColumns({"End": F.col("Start"), "GPUs": F.lit(0), "Nodes": F.lit(1), "NodeList": F.lit("n1"), "QOS": F.lit(None).cast("string")})
    return S.normalize_records(df)


def stored(spark, path):
    return sorted(rows(O.read_store(spark, path), "cluster", "JobID", "State", "SubmitMonth"))


def test_upsert(spark, tmp_path):
    path = str(tmp_path / "store")
    jan, mar = dt.date(2024, 1, 1), dt.date(2024, 3, 1)
    O.upsert_jobs(batch(spark, record("1", "2024-01-05"), record("1", "2024-01-05", "FAILED", 2), record("2", "2024-01-06"), record("9", "2023-12-31")), path)
    assert stored(spark, path) == [("m", "1", "FAILED", jan), ("m", "2", "COMPLETED", jan), ("m", "9", "COMPLETED", dt.date(2023, 12, 1))]
    update = batch(spark, record("1", "2024-03-05", "TIMEOUT", 3), record("1", "2024-01-05", seq=1, cluster="other"))
    for _ in range(2):  # merging the same batch again changes nothing
        O.upsert_jobs(update, path)
        assert stored(spark, path) == [("m", "1", "TIMEOUT", mar), ("m", "2", "COMPLETED", jan), ("m", "9", "COMPLETED", dt.date(2023, 12, 1)),
                                       ("other", "1", "COMPLETED", jan)]
    # A month that loses its last job disappears.
    O.upsert_jobs(batch(spark, record("2", "2024-03-06", "FAILED", 4)), path)
    assert ("m", "2", "FAILED", mar) in stored(spark, path)
    assert not (tmp_path / "store" / "cluster=m" / "SubmitYear=2024" / "SubmitMonth=2024-01-01").exists()


def test_old_records_do_not_replace_newer_ones(spark, tmp_path):
    path = str(tmp_path / "store")
    O.upsert_jobs(batch(spark, record("1", "2024-01-05", "TIMEOUT", 5)), path)
    O.upsert_jobs(batch(spark, record("1", "2024-01-05", "FAILED", 4)), path)
    assert [r[2] for r in stored(spark, path)] == ["TIMEOUT"]


def test_the_batch_wins_whatever_its_values(spark, tmp_path):
    """Neither the order of states by name nor a higher number of an earlier load matters where no order is given."""
    path = str(tmp_path / "store")
    O.upsert_jobs(batch(spark, record("1", "2024-01-05", "RUNNING", None), record("2", "2024-01-05", "FAILED", 7)), path)
    O.upsert_jobs(batch(spark, record("1", "2024-01-05", "COMPLETED", None), record("2", "2024-01-05", "COMPLETED", None)), path)
    assert [r[2] for r in stored(spark, path)] == ["COMPLETED", "COMPLETED"]


def test_jobs_without_submit_time_stay(spark, tmp_path):
    path = str(tmp_path / "store")
    for name in ("1", "2", "2"):
        O.upsert_jobs(batch(spark, record(name, "2024-01-05")).withColumns({c: F.lit(None).cast(k) for c, k in (
            ("Submit", "timestamp"), ("SubmitDay", "date"), ("SubmitWeek", "date"), ("SubmitMonth", "date"), ("SubmitYear", "int"))}), path)
    assert stored(spark, path) == [("m", "1", "COMPLETED", None), ("m", "2", "COMPLETED", None)]


def test_equal_tasks_without_id_stay_apart(spark, tmp_path):
    root, store = tmp_path / "history", str(tmp_path / "store")
    task = spark.range(0, 5, 1, 2).select(
        F.lit("2024-01-05 10:00:00").cast("timestamp").alias("Submit"), F.lit("2024-01-05 11:00:00").cast("timestamp").alias("Start"),
        *[F.lit(v).alias(c) for c, v in {"User": "u", "Account": "a", "Partition": "cpu", "State": "COMPLETED", "CPUHours": 2.0, "GPUs": 0, "CPUs": 2}.items()])
    task.write.parquet(str(root / "m" / "data"))
    jobs = Y.scan_history(spark, str(root))
    assert jobs.count() == 5 and jobs.select("JobID").distinct().count() == 5
    O.compact(spark, jobs, store)
    assert O.read_store(spark, store).count() == 5


def test_bounds_reach_the_scan(spark, tmp_path):
    from jobmeter.operators.filters import complete_only
    path = str(tmp_path / "store")
    O.upsert_jobs(batch(spark, record("1", "2023-11-05"), record("2", "2024-01-10")), path)
    store = O.read_store(spark, path)
    for df in (complete_only(store, "month", "2024-01-20"), O.retention_plan(store, 1, "2024-01-20"), O.missing_weeks(store, "2023-11-06", "2023-11-20")):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "LessThan(Submit," in plan and "SubmitMonth" in plan.split("PartitionFilters: [")[1].split("]")[0]


def test_upsert_leaves_no_scratch(spark, tmp_path):
    from pathlib import Path
    from jobmeter.session import shared_dir
    shared = Path(shared_dir(spark).removeprefix("file:"))
    before = set(shared.iterdir()) if shared.exists() else set()
    O.upsert_jobs(batch(spark, record("1", "2024-01-05")), str(tmp_path / "store"))
    assert set(shared.iterdir()) == before


def test_retention(spark, tmp_path):
    path = str(tmp_path / "store")
    jobs = batch(spark, record("1", "2023-11-05"), record("2", "2024-01-10"), record("3", "2024-01-20"), record("4", "2024-05-01"))
    O.upsert_jobs(jobs, path)
    plan = O.retention_plan(O.read_store(spark, path), 6, "2024-07-10")  # cutoff 2024-01-12
    assert plan.agg(F.sum("jobs")).first()[0] == 2
    assert sorted(r.JobID for r in O.apply_retention(spark, path, 6, "2024-07-10").collect()) == ["3", "4"]


def test_pushdown_and_pruning(spark, tmp_path):
    from jobmeter.operators.filters import submit_between
    path = str(tmp_path / "store")
    O.upsert_jobs(batch(spark, record("1", "2023-11-05"), record("2", "2024-01-10")), path)
    df = submit_between(O.read_store(spark, path), "2024-01-01", "2024-01-31").select("JobID")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "SubmitMonth" in plan.split("PartitionFilters")[1] and "GreaterThanOrEqual(Submit" in plan
    assert "CPUHours" not in plan
    assert len(df.inputFiles()) >= 1 and rows(df) == [("2",)]


def test_diff_and_weeks(spark):
    a = spark.createDataFrame([("m", "1", "x"), ("m", "2", "x"), ("m", "3", "x")], "cluster string, JobID string, State string")
    b = spark.createDataFrame([("m", "1", "x"), ("m", "2", "y"), ("m", "4", "x")], a.schema)
    assert set(rows(O.diff_loads(a, b), "JobID", "change")) == {("2", "modified"), ("3", "deleted"), ("4", "new")}
    jobs = spark.createDataFrame([(ts("2020-12-24"),), (ts("2021-01-05"),)], "Submit timestamp")
    got = rows(O.missing_weeks(jobs, "2020-12-21", "2021-01-17").orderBy("week"), "iso_year", "iso_week")
    assert got == [(2020, 53), (2021, 2)]
    assert rows(O.missing_weeks(jobs, (2020, 52), (2021, 2)).orderBy("week"), "iso_year", "iso_week") == got
    assert O.recent_weeks(jobs, "2021-01-20").count() == 2  # of the four weeks from 21 December, two have jobs


def test_weekly_files_and_file_years(spark, tmp_path):
    jobs = spark.createDataFrame([("a", ts("2020-12-31")), ("a", ts("2021-01-01")), ("a", ts("2021-05-01")), ("b", ts("2020-01-01")), ("b", ts("2021-01-01"))],
                                 "_file string, Submit timestamp")
    O.write_weekly(jobs, str(tmp_path / "w"))
    assert (tmp_path / "w" / "iso_year=2020" / "iso_week=53").exists()
    assert dict(rows(O.file_years(jobs))) == {"a": 2021, "b": 2020}


def test_weekly_files_of_clusters_leave_each_other_alone(spark, tmp_path):
    path = str(tmp_path / "w")
    for cluster, days in (("a", ["2021-01-04", "2021-01-11"]), ("b", ["2021-01-05"]), ("a", ["2021-01-12"])):
        O.write_weekly(spark.createDataFrame([(cluster, ts(d)) for d in days], "cluster string, Submit timestamp"), path)
    got = rows(spark.read.parquet(path), "cluster", "iso_week", "Submit")
    assert sorted(got) == [("a", 1, ts("2021-01-04")), ("a", 2, ts("2021-01-12")), ("b", 1, ts("2021-01-05"))]


def test_submission_stats(spark):
    audit = spark.createDataFrame([("m", ts("2024-01-01"), 5), ("m", ts("2024-01-02"), 7)], "cluster string, ingest_ts timestamp, n_jobs long")
    assert rows(O.submission_stats(audit)) == [("m", ts("2024-01-02"), 12)]
