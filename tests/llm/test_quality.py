import re

import duckdb

from jobmeter.llm import quality, queries

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    w = WORD.findall(text or "")
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    places = {}
    for p in range(len(w) - 4):
        places.setdefault(tuple(w[p:p + 5]), []).append(p)
    hit = {p + k for v in places.values() if len(v) > 1 for p in v for k in range(5)}
    n_symbols = sum(c in "#*$%&|<>" for c in text or "")
    return len(w), sum(map(len, w)), n_symbols, len(lines) - len(set(lines)), len(hit), len(w) < 10 or 100 * len(hit) > 20 * len(w)


def measured(docs):
    return sorted(((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in quality.apply_rules(docs).collect()), key=str)


def test_odd_rows(odd_docs, no_docs):
    assert measured(odd_docs) == sorted(((r.doc_id, *brute(r.text)) for r in odd_docs.collect()), key=str)
    assert quality.apply_rules(no_docs).count() == 0


def test_repeats_that_overlap(spark):
    texts = ["a b c d e " * 3, "a a a a a a a", "x a b c d e y a b c d e", "1 2 3 4 5\n1 2 3 4 5\n\n \n", "a\x0bb\x0cc\xa0d e\tf\r\n" * 4]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert measured(docs) == sorted(((k, *brute(t)) for k, t in enumerate(texts)), key=str)


def test_query_against_sql(spark):
    con = duckdb.connect()
    con.execute("CREATE VIEW documents AS SELECT * FROM '/root/testdata/sf0.001/documents.parquet'")
    got = queries.QUERIES["op3_quality_rules"](spark, "/root/testdata/sf0.001")
    want = con.execute(queries.ORACLES["op3_quality_rules"])
    names = [c[0] for c in want.description]
    assert sorted(map(tuple, got.select(*names).collect())) == sorted(want.fetchall())


def test_labelled_quality(spark):
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    found = quality.apply_rules(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).join(labels, "doc_id")
    good = found.where("quality = 1 and n_words >= 20")
    assert found.where("quality = 0 and kept").count() <= 0.05 * found.where("quality = 0").count()
    assert good.where("not kept").count() <= 0.05 * good.count()


def test_no_python_in_the_plan(spark, odd_docs):
    plan = quality.apply_rules(odd_docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
