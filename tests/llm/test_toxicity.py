import random

import pytest

from jobmeter.llm import toxicity as T

SF = "/root/testdata/sf0.1"


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    found = T.score_documents(docs, labels).join(labels, "doc_id").where("held_out")
    n = {(r.toxic, r.predicted): r["count"] for r in found.groupBy("toxic", "predicted").count().collect()}
    assert n[1, 1] >= 0.9 * (n[1, 1] + n.get((1, 0), 0))
    assert n.get((0, 1), 0) <= 0.01 * n[0, 0]


def labelled(spark, copies=1):
    """100 documents, half of them with an insult, some of their ids repeated with other texts."""
    rows = [(i, f"you are a zorgon number {i} {k}" if i % 2 else f"what a fine day number {i} {k} it is") for i in range(100) for k in range(copies if i < 10 else 1)]
    return spark.createDataFrame(rows, "doc_id long, text string")


def test_labels_without_documents_take_no_place(spark):
    docs = labelled(spark)
    labels = spark.range(100_000).selectExpr("id as doc_id", "cast(id % 2 as int) as toxic")
    assert T.sample_labelled(docs, labels, 1000).count() == docs.where("crc32(cast(doc_id as string)) % 5 != 0").count() > 60
    model = T.learn(docs, labels, sample=1000)
    assert model == T.learn(docs, labels.where("doc_id < 100")) and model.weights


def test_repeated_ids_are_sampled_once(spark):
    docs = labelled(spark, copies=500)
    labels = spark.range(10).selectExpr("id as doc_id", "cast(id % 2 as int) as toxic")
    assert T.sample_labelled(docs, labels, 5).count() == 5
    assert len(T.score_documents(docs, labels).collect()) == docs.count()


def test_folding():
    fold = T.folder()
    assert fold("ІD1ОТ, tr@$h! ｆｏｏ​bar").split() == ["idiot", "trash", "foobar"]


def test_exceptions_cancel_hits_and_length_counts():
    model = T.Model(weights={" trash ": 5.0, " idio": 4.0}, exceptions=("trash can",))
    measure = model.matcher()
    assert measure("A trash can.") == measure("") == measure(None) == (0.0, 0.0)
    assert measure("you TR4SH")[0] > 0 and measure("bigtrash trashy") == (0.0, 0.0)
    assert measure("trash")[1] > measure("trash" + " word" * 500)[1]
    assert measure("trash can trash")[0] == measure("trash")[0]


def brute(model, text):
    """Hits of every term at every place, without an automaton."""
    folded = T.folder()(text)
    covered = set()
    for phrase in model.exceptions:
        at = folded.find(f" {phrase} ")
        while at >= 0:
            covered.update(range(at, at + len(phrase) + 1))
            at = folded.find(f" {phrase} ", at + 1)
    best = {}
    for term, weight in model.weights.items():
        at = folded.find(term)
        while at >= 0:
            if at not in covered:
                best[at] = max(weight, best.get(at, 0.0))
            at = folded.find(term, at + 1)
    return sum(best.values())


def test_matcher_against_brute_force():
    rng = random.Random(4)
    model = T.Model(weights={" ab": 2.0, " abc ": 3.0, " ca": 1.5, " b ": 4.0}, exceptions=("b ca", "abc b"))
    measure = model.matcher()
    for _ in range(300):
        text = "".join(rng.choice("abcABC  .4") for _ in range(rng.randrange(40)))
        assert measure(text)[0] == pytest.approx(__import__("math").log1p(brute(model, text)))


def test_odd_rows(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(1, 1), (2, None), (None, 1), (4, 0), (5, 1), (5, 0), (77, 1)], "doc_id long, toxic int")
    found = T.score_documents(odd_docs, labels).collect()
    assert len(found) == odd_docs.count() and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in found)
    assert {r.held_out for r in found if r.doc_id is None} == {False}
    kept = T.remove_toxic(odd_docs, labels)
    assert kept.columns == odd_docs.columns
    assert T.score_documents(no_docs, labels).count() == 0
    assert {r.score for r in T.score_documents(odd_docs, labels.limit(0)).collect()} == {0.0}


def test_only_training_rows_teach(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    flipped = labels.selectExpr("doc_id", "if(crc32(cast(doc_id as string)) % 5 = 0, 1 - toxic, toxic) AS toxic")
    assert T.learn(docs, labels) == T.learn(docs, flipped)
