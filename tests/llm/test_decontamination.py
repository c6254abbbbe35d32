import hashlib
import random
import re
import tracemalloc

import pytest

from jobmeter.llm import decontamination as D

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, window=13):
    windows = {}
    for item, text in items:
        w = words(text)
        n = min(window, len(w))
        for p in range(len(w) - n + 1 if n else 0):
            windows.setdefault(tuple(w[p:p + n]), set()).add(item)
    out = []
    for doc_id, text in docs:
        w, hit, found = words(text), set(), set()
        for n in {len(k) for k in windows}:
            for p in range(len(w) - n + 1):
                owners = windows.get(tuple(w[p:p + n]))
                if owners:
                    hit.update(range(p, p + n))
                    found |= owners
        names = sorted(str(i) for i in found if i is not None)
        out.append((doc_id, len(w), len(hit), len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=str)


def report(docs, items, **options):
    return sorted((tuple(r) for r in D.contamination_report(docs, items, **options).collect()), key=str)


def test_documents_against_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    items = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    want = brute([(r.doc_id, r.text) for r in docs.collect()], [tuple(r) for r in items.select("item_id", "text").collect()])
    assert any(r[-1] for r in want)
    assert report(docs, items) == want


def made_up(seed=1):
    rng = random.Random(seed)
    text = lambda n: " ".join(rng.choice("a b c D é 7".split()) for _ in range(n))
    items = [(k, text(rng.choice([1, 2, 3, 5, 8, 13, 20, 40]))) for k in range(12)] + [(3, "a a b"), (None, "c c c c"), (99, None), (98, " .!"), (97, "zz")]
    return [(k, text(rng.choice([0, 1, 5, 30, 200]))) for k in range(60)], items


@pytest.mark.parametrize("block_bytes", [1, 8 << 20])
def test_short_items_ties_and_blocks(spark, monkeypatch, block_bytes):
    monkeypatch.setattr(D.match_benchmark, "__defaults__", (13, block_bytes))
    docs, items = made_up()
    got = report(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string").repartition(3))
    assert got == brute(docs, items)


@pytest.mark.parametrize("pairs", [1, 40, 1000])
def test_pairs_are_taken_in_turns(monkeypatch, pairs):
    docs, items = made_up(3)
    block = D.BenchmarkBlock([(i, D.fold_words((t or "").encode())) for i, t in items], 13)
    texts = [t.encode() for _, t in docs]
    whole = block.annotate(texts)
    assert sum(map(len, whole[1])) > 500
    monkeypatch.setattr(D, "PAIRS", pairs)
    assert [sorted(x, key=str) for x in block.annotate(texts)[1]] == [sorted(x, key=str) for x in whole[1]]


def test_repetitive_texts_in_bounded_memory():
    n = 6000
    block = D.BenchmarkBlock([(1, [b"a"] * n)], 13)
    tracemalloc.start()
    words, (found,) = block.annotate([b"a " * n])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert words == [n] and len(found) == 2 * (n - 12) - 1 and (1, 0, 0, n) in found and peak < 500 << 20


def test_matches_are_longest_and_have_places(spark):
    docs = spark.createDataFrame([(1, "x " + " ".join(f"w{i}" for i in range(5, 25)) + " y")], "doc_id long, text string")
    items = spark.createDataFrame([(7, " ".join(f"W{i}," for i in range(30)))], "item_id long, text string")
    found = D.match_benchmark(docs, items).first()
    assert [tuple(m) for m in found._llm_matches] == [(7, 1, 5, 20)]


def test_odd_rows(spark, odd_docs, no_docs):
    items = [(1, "same row twice"), (2, "text without id"), (3, None)]
    bench = spark.createDataFrame([(*i, "x") for i in items], "item_id long, text string, doc_id string")
    assert report(odd_docs, bench) == brute([(r.doc_id, r.text) for r in odd_docs.collect()], items)
    kept = D.remove_contaminated(odd_docs, bench)
    assert kept.columns == odd_docs.columns and kept.count() == odd_docs.count() - 3
    assert D.contamination_report(no_docs, bench).count() == 0
    assert D.remove_contaminated(odd_docs, bench.limit(0)).count() == odd_docs.count()
