import datetime as dt

import pytest
from pyspark.sql import functions as F

from conftest import rows
from jobmeter.functions import nodes as N
from jobmeter.functions import text as X
from jobmeter.functions import time as Z


def apply(spark, build, values, kind="string"):
    """Values of an expression over a column ``v``, in order."""
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r.out for r in df.select("i", build(F.col("v")).alias("out")).orderBy("i").collect()]


NODE_LISTS = {
    # one name, no name
    "login2": ["login2"],
    "": [],
    None: [],
    "None assigned": [],
    # ranges and single numbers, mixed, with the padding of the range's start
    "rack[7-9]": ["rack7", "rack8", "rack9"],
    "rack[009-011]": ["rack009", "rack010", "rack011"],
    "rack[99-101,3,20-21]": ["rack99", "rack100", "rack101", "rack3", "rack20", "rack21"],
    "big[02,4]": ["big02", "big4"],
    # several groups, names with hyphens, commas in and outside brackets
    "a[1-2],b[03-04],c9": ["a1", "a2", "b03", "b04", "c9"],
    "fat-mem[1,3],slim-7": ["fat-mem1", "fat-mem3", "slim-7"],
    "k1,k2,k30": ["k1", "k2", "k30"],
    # cut off or senseless text gives what can be told
    "rack[12": ["rack12"],
    "7-8]": [],
    "[4]": [],
    "z[9-2]": [],
}


def test_expand_nodelist(spark):
    assert apply(spark, N.expand_nodelist, list(NODE_LISTS)) == list(NODE_LISTS.values())


def test_node_pieces_counts_commas_only(spark):
    assert apply(spark, N.node_pieces, ["gpu[1-4]", "a,b", "gpu[1,2]", None, ""]) == [1, 2, 2, 0, 0]


def test_natural_order(spark):
    names = ["cpu11", "cpu2", "CPU1", "gpu1", "cpu02"]
    keys = apply(spark, N.natural_key, names)
    assert [n for _, n in sorted(zip(keys, names))][0] == "CPU1"
    assert keys[1] < keys[0] < keys[3]


def test_valid_node_and_type(spark):
    assert apply(spark, N.valid_node, ["gpu01", "x-1", "1-5", "gpu[1", "]", "a_b"]) == [True, True, False, False, False, True]
    assert apply(spark, N.node_type, ["GPU1", "login2", "NAS3", "mystorage", "c1"]) == ["gpu", "login", "storage", "storage", "cpu"]


def test_tres(spark):
    got = apply(spark, X.parse_tres, [
        "billing=4,cpu=4,gres/gpu=2,mem=16G,node=1", "cpu=8,mem=512M", None, "", "cpu=x,gres/gpu:a100=3",
        "cpu=2,gres/gpu=1,gres/gpu:v100=4,mem=1.5G"])
    assert [tuple(g) for g in got] == [
        (4, 2, 16384, 1), (8, 0, 512, 0), (0, 0, 0, 0), (0, 0, 0, 0), (0, 3, 0, 0), (2, 4, 1536, 0)]


def test_memory(spark):
    assert apply(spark, X.memory_gb, ["1024M", "2G", None, "5T", "x"]) == [1.0, 2.0, 0.0, 0.0, 0.0]
    with pytest.raises(Exception, match="unsupported memory unit"):
        apply(spark, lambda c: X.memory_gb(c, strict=True), ["5T"])


def test_elapsed(spark):
    got = apply(spark, Z.elapsed_to_hours, ["1-02:03:04", "10:00:00", "05:06", "x", "", None, "a-01:00:00", "1-2-3", "00:00:30"])
    want = [26 + 3 / 60 + 4 / 3600, 10, 5 / 60 + 6 / 3600, 0, 0, 0, 0, 0, 30 / 3600]
    assert got == pytest.approx(want)


def test_state_and_text(spark):
    states = ["CANCELLED by 123", "COMPLETED", " ", None, "nan", "NODE_FAIL", "OUT_OF_MEMORY x"]
    assert apply(spark, X.job_state, states) == [
        "CANCELLED", "COMPLETED", "UNKNOWN", "UNKNOWN", "UNKNOWN", "NODE_FAIL", "OUT_OF_MEMORY x"]
    assert apply(spark, lambda c: X.job_state(c, first_word=True), states)[-1] == "OUT_OF_MEMORY"
    assert apply(spark, X.clean_text, [" a ", "NaN", "none", "", None]) == ["a", "unknown", "unknown", "unknown", "unknown"]
    assert apply(spark, lambda c: X.clean_text(c, None), ["", "b"]) == [None, "b"]


def test_account_prefix(spark):
    assert apply(spark, lambda c: X.account_prefix(c, 2), ["a-b-c", "a", "a-b"]) == ["a-b", "a", "a-b"]
    assert apply(spark, lambda c: X.account_prefix(c, 0), ["a-b-c-d"]) == ["a-b-c-d"]
    assert apply(spark, X.account_prefix, ["a-b-c-d"]) == ["a-b-c"]


def test_array_ids_and_labels(spark):
    assert [tuple(r) for r in apply(spark, X.array_job, ["123_7", "9"])] == [("123", "7"), ("9", "")]
    assert apply(spark, X.account_short_name, ["phys-opt-lab", "plain"]) == ["LAB", "plain"]
    assert apply(spark, X.partition_title, ["gpu", "bigMEM"]) == ["Gpu Partition", "Bigmem Partition"]
    assert apply(spark, X.partition_list, ["a, b", "a,,b ", None]) == [["a", "b"], ["a", "b"], None]


def monday_on_or_before(day):
    return day - dt.timedelta(days=day.weekday())


def test_week_and_month_text(spark):
    weeks = [f"{y}-01" for y in range(2016, 2029)] + ["2020-53", "2024-10"]
    want = [monday_on_or_before(dt.date(int(w[:4]), 1, 1)) + dt.timedelta(weeks=int(w[5:]) - 1) for w in weeks]
    assert apply(spark, Z.week_to_date, weeks) == want
    assert apply(spark, Z.month_to_date, ["2024-02"]) == [dt.date(2024, 2, 1)]


def test_week_anchors(spark):
    days = ["2024-01-01 00:00:00", "2024-01-02 05:00:00", "2023-12-31 23:59:59"]
    ts = lambda c: c.cast("timestamp")
    assert apply(spark, lambda c: Z.period_start(ts(c), "week"), days) == [
        dt.date(2024, 1, 1), dt.date(2024, 1, 1), dt.date(2023, 12, 25)]
    assert apply(spark, lambda c: Z.period_start(ts(c), "week", "tuesday"), days) == [
        dt.date(2023, 12, 26), dt.date(2024, 1, 2), dt.date(2023, 12, 26)]


def test_duration_category(spark):
    hours = [0.0, 0.001, 0.01, 0.05, 0.1, 0.3, 0.7, 3.0, 7.0, 20.0, 24.0, None, -1.0]
    label = lambda c: Z.duration_category(c)["label"]
    assert apply(spark, label, hours, "double") == [
        "<5s", "<5s", "<1min", "<5min", "<30min", "<30min", "<1h", "<5h", "<10h", "<24h", ">=24h", None, "<5s"]
    zero = lambda c: Z.duration_category(c, from_zero=True)["label"]
    got = apply(spark, zero, hours, "double")
    assert got[3] == "<15min" and got[12] is None
    ranks = apply(spark, lambda c: Z.duration_category(c)["rank"], hours[:11], "double")
    assert ranks == sorted(ranks)


def test_percent_change_and_utilisation(spark):
    df = spark.createDataFrame([(110, 100), (5, 0), (0, 0), (50, 100)], "c long, p long")
    assert rows(df.select(Z.percent_change("c", "p"))) == [(10.0,), (100.0,), (0.0,), (-50.0,)]
    use = spark.createDataFrame([(240.0, 10), (1e9, 10), (5.0, 0)], "h double, cap int")
    assert rows(use.select(Z.utilisation("h", "cap", 48.0))) == [(50.0,), (100.0,), (0.0,)]


def test_range_hours(spark):
    df = spark.createDataFrame([("2024-01-01 10:00:00",), ("2024-01-03 09:00:00",)], "Submit string")
    df = df.select(F.col("Submit").cast("timestamp"))
    assert rows(df.agg(Z.data_range_hours())) == [(48.0,)]
    assert rows(df.limit(1).select(Z.range_hours("2024-01-01", "2024-01-31"))) == [(744.0,)]
