import itertools
import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

from jobmeter.llm import divergence, queries

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(docs, least=10, top=10):
    counts, in_docs = defaultdict(Counter), defaultdict(Counter)
    for text, lang, source in docs:
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(FOLD))
        counts[lang or "", source or ""].update(terms)
        in_docs[lang or ""].update(set(terms))
    out = []
    for lang, found in in_docs.items():
        kept = [t for t, n in found.items() if n >= least]
        v = len(kept)
        groups = {s: c for (g, s), c in counts.items() if g == lang}
        total = {s: sum(c[t] for t in kept) for s, c in groups.items()}
        p = {s: {t: 1 + 10**9 * (c[t] + 2) // (total[s] + 2 * v) for t in kept} for s, c in groups.items()}
        q = {t: 1 + 10**9 * (sum(c[t] for c in groups.values()) + 2) // (sum(total.values()) + 2 * v) for t in kept}
        f = lambda x, y: (x - y) ** 2 // (x + y)
        for s in groups:
            pairs = [(o, sum(f(p[s][t], p[o][t]) for t in kept)) for o in groups if o != s]
            terms = [(t, f(p[s][t], q[t])) for t in kept if groups[s][t] > 0 and p[s][t] > q[t]]
            by_value = lambda x: (-x[1], x[0].encode())
            out += [(lang, s, "pair", i, value, k + 1) for k, (i, value) in enumerate(sorted(pairs, key=by_value))]
            out += [(lang, s, "term", i, value, k + 1) for k, (i, value) in enumerate(sorted(terms, key=by_value)[:top])]
    return sorted(out)


def audited(docs, **options):
    df = divergence.audit(docs, **options)
    assert df.columns == ["lang", "source", "part", "item", "value", "rank"]
    return sorted(map(tuple, df.collect()))


def made_up(seed, sources, rows, words=60):
    rng = random.Random(seed)
    docs = []
    for _ in range(rows):
        s = rng.choice(sources)
        n = rng.randrange(30)
        docs.append((" ".join(f"{rng.choice(['w', 'W', 'é', 'ß'])}{chr(97 + int(rng.random() ** 2 * words) % 26)}x{'y' * rng.randrange(3)}" for _ in range(n)), rng.choice(["a", "b"]), s))
    return docs


@pytest.mark.parametrize("terms, tile", [(20_000, 8), (7, 1), (3, 2), (10, 3)])
def test_against_brute_force_in_buckets_and_tiles(spark, monkeypatch, terms, tile):
    monkeypatch.setattr(divergence, "BUCKET_TERMS", terms)
    monkeypatch.setattr(divergence, "TILE", tile)
    docs = made_up(2, ["s1", "s10", "s2", "ź", "Z", "lone"], 160) + [("", "a", "silent"), ("solo words here", "c", "x"), ("rare", "c", "y")]
    want = brute(docs)
    assert len(want) > 100
    assert audited(spark.createDataFrame(docs, "text string, lang string, source string").repartition(3)) == want


def test_sample_against_brute_force_and_sql(spark):
    sf = "/root/testdata/sf0.001"
    docs = [(r.text, r.lang, r.source) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = sorted(map(tuple, queries.QUERIES["op11_source_divergence"](spark, sf).collect()))
    assert got == brute(docs)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    result = con.execute(queries.ORACLES["op11_source_divergence"])
    assert [c[0] for c in result.description] == ["lang", "source", "part", "item", "value", "rank"]
    assert sorted(result.fetchall()) == got


def test_odd_rows(spark, odd_docs, no_docs):
    from pyspark.sql import functions as F
    docs = odd_docs.withColumns({"lang": F.when(F.col("doc_id") > 3, "x"), "source": F.when(F.col("doc_id") != 5, F.col("doc_id").cast("string")),
                                 "ids": F.lit(1), "bucket": F.lit("b"), "term": F.lit("t"), "total": F.lit(0)})
    rows = [(r.text, r.lang, r.source) for r in docs.collect()]
    for least in (1, 2, 10):
        assert audited(docs, least_docs=least) == brute(rows, least)
    assert audited(no_docs) == []


def test_early_flushes_change_nothing(spark, monkeypatch):
    docs = made_up(5, ["p", "q"], 80)
    monkeypatch.setattr(divergence, "HELD_TERMS", 3)
    assert audited(spark.createDataFrame(docs, "text string, lang string, source string")) == brute(docs)


def test_counts_beyond_a_long_stay_exact(spark):
    from pyspark.sql import functions as F
    counts, total, terms = [0, 1, 10**10, 7 * 10**12], 9 * 10**12 + 1, 5
    want = [1 + 10**9 * (c + 2) // (total + 2 * terms) for c in counts]
    assert divergence.shares(np.array(counts, np.int64), total, terms).tolist() == want
    rows = spark.createDataFrame([(c, total, terms) for c in counts], "n long, total long, terms long")
    assert [r[0] for r in rows.select(divergence.share(F.col("n"), F.col("total"), F.col("terms"))).collect()] == want


def test_merge_against_all_terms():
    rng = random.Random(1)
    for _ in range(100):
        one, two = ({rng.randrange(30): rng.randrange(1, 10**9) for _ in range(rng.randrange(12))} for _ in range(2))
        arrays = lambda d: (np.array(sorted(d), np.int64), np.array([d[k] for k in sorted(d)], np.int64))
        f = lambda p, q: (p - q) ** 2 // (p + q)
        want = sum(f(one.get(k, 11), two.get(k, 7)) for k in one.keys() | two.keys())
        (a, p), (b, q) = arrays(one), arrays(two)
        assert divergence.merge(a, p, 11, b, q, 7) == divergence.merge(b, q, 7, a, p, 11) == (want, len(one.keys() | two.keys()))
    assert list(itertools.chain(divergence.merge(*[np.zeros(0, np.int64)] * 2, 1, *[np.zeros(0, np.int64)] * 2, 1))) == [0, 0]
