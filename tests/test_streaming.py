import datetime as dt

from conftest import rows
from jobmeter.sources.records import arrival, normalize_records
from jobmeter.sources.store import read_store, submission_stats
from jobmeter.streaming import ingest as I
from jobmeter.streaming import live as V
from jobmeter.streaming import queue as G

T0 = dt.datetime(2024, 1, 1)


def at(minutes):
    return T0 + dt.timedelta(minutes=minutes)


POLLS = {  # minute of the poll -> pending jobs
    0: ["1", "2_1", "2_2"],
    10: ["2_1", "2_2", "3"],
    20: ["2_2"],
    30: [],
    40: ["4", "1"],
    50: ["4"],
}


def snapshots(spark, minutes):
    data = [(at(m), j, T0 - dt.timedelta(minutes=5) if j != "4" else at(35), "u", None) for m in minutes for j in POLLS[m]]
    return spark.createDataFrame(data, G.SNAPSHOT)


def marker(spark, minute, previous):
    return spark.createDataFrame([(at(minute), None, None, None, None if previous is None else at(previous))], G.SNAPSHOT)


def test_queue_waits(spark):
    got = rows(G.queue_waits(snapshots(spark, POLLS)), "JobID", "TaskIndex", "waiting_seconds")
    # The empty poll leaves no rows, so job 2_2 is seen gone at minute 40; job 1 came back and left again at 50.
    assert sorted(got) == [("1", "", 900), ("1", "", 3300), ("2", "1", 1500), ("2", "2", 2700), ("3", "", 1500)]


def test_queue_counts(spark):
    got = {r.snapshot_ts: (r.waiting, r.new, r.started) for r in G.queue_counts(snapshots(spark, POLLS)).collect()}
    assert got == {at(0): (3, 3, 0), at(10): (3, 1, 1), at(20): (1, 0, 2), at(40): (2, 2, 1), at(50): (1, 0, 1)}


def test_markers_make_empty_polls_known(spark):
    polls = spark.createDataFrame([(at(m),) for m in POLLS], "snapshot_ts timestamp")
    markers = G.poll_markers(polls)
    assert sorted(rows(markers, "snapshot_ts", "previous_ts"))[1:] == [(at(m), at(m - 10)) for m in (10, 20, 30, 40, 50)]
    assert markers.schema == G.SNAPSHOT
    got = rows(G.queue_waits(snapshots(spark, POLLS).unionByName(markers)), "JobID", "TaskIndex", "waiting_seconds")
    assert sorted(got) == [("1", "", 900), ("1", "", 3300), ("2", "1", 1500), ("2", "2", 2100), ("3", "", 1500)]
    counts = {r.snapshot_ts: (r.waiting, r.new, r.started) for r in G.queue_counts(snapshots(spark, POLLS).unionByName(markers)).collect()}
    assert counts[at(30)] == (0, 0, 1) and counts[at(40)] == (2, 2, 0)


def test_polls_over_days_follow_each_other(spark):
    times = [0, 700, 1439, 1441, 2900, 9000]
    polls = spark.createDataFrame([(at(m),) for m in times], "snapshot_ts timestamp")
    assert sorted(rows(G._next_polls(polls)), key=str) == [(at(a), at(b) if b else None) for a, b in zip(times, [*times[1:], None])]


def test_queue_stream_equals_batch(spark, tmp_path):
    """Polls come split over files and batches, some empty, some markers before their rows; the stream is restarted after each file."""
    source, out = str(tmp_path / "polls"), str(tmp_path / "out")
    every = snapshots(spark, POLLS).unionByName(G.poll_markers(spark.createDataFrame([(at(m),) for m in POLLS], "snapshot_ts timestamp")))
    want = sorted(rows(G.queue_waits(every)))
    files = []
    for m in POLLS:
        parts = [snapshots(spark, [m]).where(f"hash(JobID) % 2 {op} 0") for op in ("=", "!=")]
        files += [parts[0], marker(spark, m, m - 10 if m else None), parts[1]] if m != 20 else [marker(spark, m, 10), *parts]
    # The end of the series: a marker far behind that follows no poll.
    for df in [*files, marker(spark, 600, None)]:
        df.coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(G.SNAPSHOT).parquet(source)
        G.start_queue_monitor(stream, out, f"{out}/checkpoint", once=True).awaitTermination()
    assert sorted(rows(G.read_waits(spark, out))) == want
    G.export_waits(G.read_waits(spark, out), str(tmp_path / "csv"))
    assert spark.read.option("header", "true").csv(str(tmp_path / "csv")).columns == ["JobID", "TaskIndex", "Username", "WaitingTime [s]"]


def test_queue_monitor_keeps_only_what_is_open(spark, tmp_path):
    """Between batches there are rows of polls that are not settled yet, and no state store; a late row is dropped, a repeated start adds nothing."""
    source, out = str(tmp_path / "polls"), str(tmp_path / "out")
    late = spark.createDataFrame([(at(0), "9", T0, "u", None)], G.SNAPSHOT)
    for n, m in enumerate(POLLS):
        df = snapshots(spark, [m]).unionByName(marker(spark, m, m - 10 if m else None))
        (df.unionByName(late) if m == 50 else df).coalesce(1).write.mode("append").parquet(source)
        for _ in range(2):
            G.start_queue_monitor(spark.readStream.schema(G.SNAPSHOT).parquet(source), out, f"{out}/checkpoint", "5 minutes", once=True).awaitTermination()
        kept = spark.read.parquet(f"{out}/open/rows/{n}")
        assert {r[0] for r in rows(kept, "snapshot_ts")} <= {at(m), at(m - 10)}
    assert not (tmp_path / "out" / "checkpoint" / "state").exists()
    got = rows(G.read_waits(spark, out), "JobID", "TaskIndex", "waiting_seconds")
    assert sorted(got) == [("1", "", 900), ("2", "1", 1500), ("2", "2", 2100), ("3", "", 1500)]


def records(spark, *data):
    df = spark.createDataFrame(
        [(j, "u", "a", "p", s, None, at(m), at(m + 5), at(m + 65), 4.0, 0.0, 4, 0, 1, "n1") for j, m, s in data],
        "JobID string, User string, Account string, Partition string, State string, QOS string, Submit timestamp, Start timestamp, "
        "End timestamp, CPUHours double, GPUHours double, AllocCPUS int, AllocGPUS int, AllocNodes int, NodeList string")
    return df


def test_ingest_stream(spark, tmp_path):
    source, store = str(tmp_path / "in"), str(tmp_path / "store")
    loads = [records(spark, ("1", 0, "FAILED"), ("2", 1, "COMPLETED")), records(spark, ("1", 0, "TIMEOUT"), ("3", 2, "COMPLETED"))]
    for load in loads:
        load.coalesce(1).write.mode("append").parquet(source)
        stream = I.record_stream(spark, source, load.schema, max_files=1)
        I.start_ingest(stream, store, str(tmp_path / "cp"), "m", str(tmp_path / "audit"), once=True).awaitTermination()
    stats = submission_stats(spark.read.parquet(str(tmp_path / "audit"))).first()
    assert (stats.cluster, stats.total_jobs) == ("m", 4)
    assert sorted(rows(read_store(spark, store), "JobID", "State")) == [("1", "TIMEOUT"), ("2", "COMPLETED"), ("3", "COMPLETED")]


def test_last_record_of_a_load_wins(spark, tmp_path):
    """Two records of a job in one micro-batch, in both orders and over two files; nothing but the order of arrival tells them."""
    source, store = str(tmp_path / "in"), str(tmp_path / "store")
    loads = [records(spark, ("1", 0, "RUNNING"), ("1", 0, "COMPLETED"), ("2", 1, "COMPLETED"), ("2", 1, "RUNNING"), ("3", 2, "RUNNING")),
             records(spark, ("3", 2, "COMPLETED"), ("4", 2, "RUNNING"), ("4", 2, "CANCELLED"))]
    for load in loads:
        load.coalesce(1).write.mode("append").parquet(source)
    stream = I.record_stream(spark, source, loads[0].schema)
    I.start_ingest(stream, store, str(tmp_path / "cp"), "m", once=True).awaitTermination()
    want = [("1", "COMPLETED"), ("2", "RUNNING"), ("3", "COMPLETED"), ("4", "CANCELLED")]
    assert sorted(rows(read_store(spark, store), "JobID", "State")) == want
    assert "arrival" not in read_store(spark, store).columns


def test_live_totals_take_back_what_was_sent_again(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "totals")
    month = 32 * 1440
    loads = [[("1", 0, "A"), ("2", 1, "A"), ("2", 1, "B")], [("1", month, "A"), ("3", 2, "B")], [("2", 1, "A")], [("1", 5, "C"), ("4", 9, "B")]]
    want = []
    schema = records(spark, *loads[0]).schema
    for n, load in enumerate(loads):
        records(spark, *load).coalesce(1).write.mode("append").parquet(source)
        if n == 1:
            continue  # two files in one trigger
        stream = normalize_records(I.record_stream(spark, source, schema), "m")
        V.start_live_totals(stream, out, str(tmp_path / "cp"), "month", "State", once=True).awaitTermination()
        whole = normalize_records(spark.read.schema(schema).parquet(source).select("*", arrival()), "m")
        want = sorted(rows(V.live_totals(whole, "month", "State")))
        assert sorted(rows(V.read_live_totals(spark, out, "State"))) == want
    assert want == [(T0.date(), "A", 1, 4.0), (T0.date(), "B", 2, 8.0), (T0.date(), "C", 1, 4.0)]
    assert len([p for p in (tmp_path / "totals").iterdir() if p.name.startswith("batch=")]) == 2


def test_live_totals_heed_a_named_order(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "totals")
    make = lambda seq, state: records(spark, ("1", 0, state)).selectExpr("*", f"cast({seq} as long) as ingest_seq")
    for seq, state in ((5, "A"), (3, "B"), ("null", "C"), (2, "D")):
        make(seq, state).coalesce(1).write.mode("append").parquet(source)
        stream = normalize_records(I.record_stream(spark, source, make(1, "A").schema), "m")
        V.start_live_totals(stream, out, str(tmp_path / "cp"), "day", "State", once=True).awaitTermination()
    # The late load B is not taken; C names no order, so it and D are.
    assert rows(V.read_live_totals(spark, out, "State")) == [(T0.date(), "D", 1, 4.0)]


def test_records_without_id_count_each(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "totals")
    df = records(spark, ("1", 0, "A")).selectExpr("Submit", "CPUHours", "cast(null as string) as JobID", "explode(sequence(1, 7)) as n")
    df.coalesce(1).write.parquet(source)
    stream = spark.readStream.schema(df.schema).parquet(source)
    V.start_live_totals(stream, out, str(tmp_path / "cp"), once=True).awaitTermination()
    assert rows(V.read_live_totals(spark, out)) == rows(V.live_totals(df)) == [(T0.date(), 7, 28.0)]


def test_live_totals_hold_a_row_of_state_for_a_bucket(spark, tmp_path):
    """Many jobs share a call and a row of state; what is sent again in the next batch is still told job by job."""
    source, seen = str(tmp_path / "in"), []
    make = lambda lo, hi, state: records(spark, *[(str(k), k, state) for k in range(lo, hi) for _ in range(2)])
    for load in (make(0, 50, "A"), make(30, 60, "B")):
        load.coalesce(1).write.mode("append").parquet(source)
        changes = V.total_changes(normalize_records(I.record_stream(spark, source, load.schema), "m"), "month", "State", buckets=3)
        query = changes.writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).foreachBatch(
            lambda df, n: seen.extend((n, *r) for r in rows(df.groupBy("series").agg({"jobs": "sum", "cpu_hours": "sum"}).selectExpr("series", "`sum(jobs)`", "double(`sum(cpu_hours)`)")))).start()
        query.awaitTermination()
        assert query.lastProgress["stateOperators"][0]["numRowsTotal"] <= 3
    assert sorted(seen) == [(0, "A", 50, 200.0), (1, "A", -20, -80.0), (1, "B", 30, 120.0)]
