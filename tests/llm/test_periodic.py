import hashlib
import random
import zlib
from fractions import Fraction

import numpy as np
import pytest

from jobmeter.llm import periodic


def brute_runs(words, least=24):
    """All maximal stretches of at least three periods, by looking at every period."""
    n, found = len(words), {}
    for q in range(1, n // 3 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            first = i
            while i + q < n and words[i] == words[i + q]:
                i += 1
            length = i + q - first
            if length >= max(least, 3 * q) and (first, length) not in found:
                found[first, length] = q
    return sorted((s, m, q) for (s, m), q in found.items())


def brute_row(doc_id, text):
    words = (text or "").encode().split()
    n = len(words)
    if doc_id is not None and n and zlib.crc32(str(doc_id).encode()) % 10 == 0:
        g = zlib.crc32(str(doc_id).encode()) // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = brute_runs(words)
    best = sorted(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]))[:1]
    drop = {i for s, m, q in runs for i in range(s + q, s + m)}
    sha = lambda b: hashlib.sha256(b).hexdigest()
    return (doc_id, len(runs), *(best[0] if best else (None,) * 3), 1000 * best[0][1] // best[0][2] if best else None,
            sha("".join(f"{s},{m},{q}\n" for s, m, q in runs).encode()), sha(b" ".join(w for i, w in enumerate(words) if i not in drop)))


def made_up(rng):
    """Words with loops in loops, loops that stop and go on, and common words."""
    kinds = rng.choice([1, 2, 3, 5, 200])
    out = [rng.randrange(kinds) for _ in range(rng.randrange(60))]
    for _ in range(rng.randrange(6)):
        unit = [rng.randrange(kinds) for _ in range(rng.randrange(1, rng.choice([4, 20, 70])))]
        if rng.random() < 0.4:
            unit = unit[:3] * rng.randrange(1, 12) + unit
        size = rng.randrange(1, 5 * len(unit) + 20)
        out += [unit[i % len(unit)] for i in range(size)]
        if rng.random() < 0.3:
            out[rng.randrange(len(out))] = 999
    return out


@pytest.mark.parametrize("least", [24, 3, 10])
def test_runs_against_brute_force(least):
    rng = random.Random(least)
    some = 0
    for _ in range(400):
        words = made_up(rng)
        assert periodic.runs_of(words, least) == brute_runs(words, least)
        some += len(brute_runs(words, least))
    assert some > 300


def test_short_words_of_few_kinds():
    rng = random.Random(9)
    for _ in range(300):
        words = [rng.randrange(2) for _ in range(rng.randrange(80))]
        assert periodic.runs_of(words, 3) == brute_runs(words, 3)


def test_words_may_come_one_by_one():
    rng = random.Random(4)
    for least in (24, 5):
        for _ in range(60):
            words = np.array(made_up(rng), np.int64)
            online, squares = periodic.Catchers(least), []
            for w in words:
                squares += online.append(np.array([w]))
            chunks = periodic.Catchers(least)
            at = 0
            while at < len(words):
                step = rng.randrange(0, 40)
                chunks.append(words[at:at + step])
                at += step
            want = brute_runs(words.tolist(), least)
            assert online.runs() == chunks.runs() == want
            # A run was reported as a square, under its smallest period, while its words came in.
            assert {(s, q) for s, _, q in want} <= set(squares)


def test_runs_are_known_while_they_last():
    catchers = periodic.Catchers()
    seen = []
    for k in range(100):
        if catchers.append(np.array([k % 7])):
            seen.append(k)
        if k >= 23:
            assert catchers.runs() == [(0, k + 1, 7)]
    assert seen == [14]


def test_long_loops():
    one = [0] * 300_000
    assert periodic.runs_of(one) == [(0, 300_000, 1)]
    two = [0] * 5_000 + [1] + [0] * 5_000 + [1] + [0] * 5_000 + [1]
    assert periodic.runs_of(two) == [(0, 5000, 1), (0, 15003, 5001), (5001, 5000, 1), (10002, 5000, 1)]
    nothing = list(range(300_000))
    assert periodic.runs_of(nothing) == []


def test_documents_against_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = {r.doc_id: tuple(r) for r in periodic.run_digest(docs).collect()}
    assert len(got) == len(rows) and sum(r[1] > 0 for r in got.values()) > 10
    for doc_id, text in rows:
        if len(text or "") < 12_000:  # longer ones take the brute force too long
            assert got[doc_id] == brute_row(doc_id, text)


def test_odd_rows(spark, odd_docs, no_docs):
    rows = [(r.doc_id, r.text) for r in odd_docs.collect()]
    got = sorted(map(tuple, periodic.run_digest(odd_docs).collect()), key=str)
    brief = [r for r in rows if len(r[1] or "") < 60_000]
    want = [brute_row(*r) for r in brief]
    assert len(got) == len(rows) and sorted((g for g in got if g[0] != 6), key=str) == sorted(want, key=str)
    assert periodic.run_digest(no_docs).count() == 0
    looped = spark.createDataFrame([(None, "a b " * 30), (None, "a b " * 30)], "doc_id long, text string")
    found = [r.asDict(True) for r in periodic.periodic_runs(looped).collect()]
    run = {"start": 0, "length": 60, "period": 2}
    assert found == [{"doc_id": None, "n_words": 60, "runs": [run], "strongest": run, "collapsed": "a b"}] * 2
