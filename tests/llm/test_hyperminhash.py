import random

import numpy as np
import pytest
from .test_jaccard import brute, near_copies

from jobmeter.llm import hyperminhash as H


def found(docs, n=5, percent=85):
    rows = H.near_copies(docs, n, percent).collect()
    assert all(r.kept == (r.doc_id == r.component_id) for r in rows)
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in rows), key=str)


def hashes(members):
    return np.unique(np.array([hash(("x", m, m * 7)) * 0x9E3779B97F4A7C15 * 3 % 2**64 for m in members], np.uint64))


def test_documents_against_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    want = brute([(r.doc_id, r.text) for r in docs.collect()], 5, 85)
    assert any(r[0] != r[2] for r in want)
    assert found(docs) == want


@pytest.mark.parametrize("n, percent, most", [(5, 85, 10_000), (3, 90, 5), (5, 80, 4)])
def test_near_copies_and_blocks(spark, monkeypatch, n, percent, most):
    monkeypatch.setattr(H, "GROUP_ROWS", most)
    monkeypatch.setattr(H, "GROUP_SETS", most)
    docs = near_copies(seed=n * percent)
    want = brute(docs, n, percent)
    assert len({r[2] for r in want}) < len(docs) - 30
    assert found(spark.createDataFrame(docs, "doc_id long, text string").repartition(4), n, percent) == want


def test_blocks_are_bounded_by_bytes(spark, monkeypatch):
    monkeypatch.setattr(H, "GROUP_BYTES", 2_000)
    docs = near_copies(seed=8)
    assert found(spark.createDataFrame(docs, "doc_id long, text string")) == brute(docs, 5, 85)


def test_a_chain_of_links(spark):
    """Each text is similar to the next only; the chain is longer than any fixed number of rounds would reach by single steps."""
    words = [f"w{i}" for i in range(420)]
    docs = [(1000 - k, " ".join(words[3 * k:3 * k + 60])) for k in range(120)]
    got = found(spark.createDataFrame(docs, "doc_id long, text string"))
    assert got == brute(docs, 5, 85) and {r[2] for r in got} == {881}


def test_copies_without_id_are_one_class(spark):
    base = " ".join(f"w{i}" for i in range(300))
    df = spark.range(20_000).selectExpr("cast(null as long) as doc_id", f"'{base}' as text").unionByName(
        spark.createDataFrame([(7, base + " more"), (3, base), (9, "other words")], "doc_id long, text string"))
    rows = H.near_copies(df).groupBy("component_id", "kept").count().collect()
    assert sorted(map(tuple, rows), key=str) == sorted([(3, False, 20_001), (3, True, 1), (9, True, 1)], key=str)


def test_odd_rows(odd_docs, no_docs):
    assert [r for r in found(odd_docs) if r[0] is not None] == [r for r in brute([(r.doc_id, r.text) for r in odd_docs.collect()], 5, 85) if r[0] is not None]
    assert H.near_copies(odd_docs).where("doc_id is null").count() == 2
    assert found(no_docs) == []


def test_registers_keep_the_least_hash():
    rng = random.Random(2)
    for size in (1, 5, 100, 5000):
        members = np.unique(np.array([rng.getrandbits(64) for _ in range(size)], np.uint64))
        want = [0] * 128
        for b in range(128):
            low = [int(h) & (2**57 - 1) for h in members if int(h) >> 57 == b]
            if low:
                bits = f"{min(low):057b}"
                zeros = min(bits.index("1") if "1" in bits else 57, 30)
                rest = (bits[zeros + 1:] + "0" * 11)[:11]
                want[b] = ((zeros + 1) << 11) | int(rest, 2)
        assert H.registers(members).tolist() == want


def test_estimates_and_collisions(monkeypatch):
    rng = np.random.default_rng(3)
    off, disjoint = [], []
    for _ in range(300):
        pool = np.unique(rng.integers(0, 2**64, 3000, dtype=np.uint64))
        both, one, two = pool[rng.permutation(len(pool))[:2000]], None, None
        one, two = np.sort(both[:1850]), np.sort(both[150:])
        a, b = H.registers(one), H.registers(two)
        steps = H.step_of(np.array([len(one), len(two)]))
        off.append(H.estimate(a, steps[0], b[None], steps[1:])[0][0] - 1700 / 2000)
        disjoint.append((H.registers(np.sort(pool[:1500])) == H.registers(np.sort(pool[1500:2950]))).mean())
    assert abs(np.mean(off)) < 0.01 and 0.02 < np.std(off) < 0.045
    # Sets without common members agree as often as computed.
    pools = rng.integers(0, 2**57, (400_000, 2, 12), dtype=np.uint64).min(axis=2)
    digits = np.frexp(pools.astype(float))[1]
    cells = (digits.astype(np.int64) << 8) | ((pools >> (digits - 5).astype(np.uint64)) & np.uint64(15)).astype(np.int64)
    monkeypatch.setattr(H, "MANTISSA", 4)
    want = float(H.collision_rate(np.array(12.0 * 128), np.array(12.0 * 128)))
    assert abs((cells[:, 0] == cells[:, 1]).mean() / want - 1) < 0.08
