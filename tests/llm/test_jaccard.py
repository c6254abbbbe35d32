import itertools
import random
from collections import defaultdict

import pytest

from jobmeter.llm import jaccard


def brute(docs, n, percent):
    sets = []
    for _, text in docs:
        w = (text or "").encode().lower().split()
        sets.append({tuple(w[i:i + n]) for i in range(max(1, len(w) - n + 1))} if w else set())
    root = list(range(len(docs)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(range(len(docs)), 2):
        both = len(sets[a] & sets[b])
        if sets[a] and sets[b] and 100 * both >= percent * len(sets[a] | sets[b]):
            root[find(a)] = find(b)
    members = defaultdict(list)
    for k, (doc_id, _) in enumerate(docs):
        members[find(k)].append(doc_id)
    least = {k: min((i for i in v if i is not None), default=None) for k, v in members.items()}
    return sorted(((docs[k][0], len(sets[k]), least[find(k)] if sets[k] else docs[k][0]) for k in range(len(docs))), key=str)


def found(docs, n, percent):
    return sorted((tuple(r) for r in jaccard.similarity_components(docs, n, percent).collect()), key=str)


@pytest.mark.parametrize("n, percent", [(3, 90), (5, 80)])
def test_documents_against_brute_force(spark, n, percent):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert found(docs, n, percent) == brute([(r.doc_id, r.text) for r in docs.collect()], n, percent)


def near_copies(seed=3):
    """Groups of near copies at all similarities, some of them of common words alone, and many texts that share passages."""
    rng = random.Random(seed)
    docs = []
    passage = " ".join(f"shared{i}" for i in range(30))
    for g in range(12):
        size = rng.choice([4, 12, 33, 70, 130])
        base = [f"g{g}w{i}" if g % 3 else rng.choice("the of and to in a".split()) for i in range(size)]
        for _ in range(12):
            text = list(base)
            for _ in range(rng.randrange(0, 1 + size // 12)):
                text[rng.randrange(len(text))] = f"new{rng.random()}"
            docs.append((len(docs), " ".join(text + ([passage] if rng.random() < 0.2 else []))))
    rng.shuffle(docs)
    return docs


@pytest.mark.parametrize("n, percent, most", [(3, 90, 10_000), (5, 80, 10_000), (3, 90, 5), (5, 80, 5)])
def test_near_copies_and_blocks(spark, monkeypatch, n, percent, most):
    monkeypatch.setattr(jaccard, "GROUP_ROWS", most)
    monkeypatch.setattr(jaccard, "GROUP_TEXTS", most)
    docs = near_copies()
    want = brute(docs, n, percent)
    assert len({r[2] for r in want}) < len(docs) - 40
    assert found(spark.createDataFrame(docs, "doc_id long, text string").repartition(4), n, percent) == want


def test_tree_finds_what_all_pairs_find():
    rng = random.Random(5)
    base = [{rng.randrange(10**9) for _ in range(60)} for _ in range(10)]
    sets = []
    for _ in range(300):
        s = set(rng.choice(base))
        for _ in range(rng.randrange(12)):
            s.discard(rng.choice(sorted(s)))
            s.add(rng.randrange(10**9))
        sets.append(s)
    similar = lambda a, b: 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])
    bitmaps = [bytes(sum(1 << b for b in {x % 8 for x in s if x // 8 % 32 == k}) for k in range(32)) for s in sets]
    parts = jaccard.SignatureTree(bitmaps, [len(s) for s in sets], 85).parts(similar)
    root = list(range(300))
    for a, b in itertools.combinations(range(300), 2):
        if similar(a, b) and root[a] != root[b]:
            old = root[a]
            root = [root[b] if r == old else r for r in root]
    assert len(set(zip(parts, root))) == len(set(parts)) == len(set(root))


def test_odd_rows(odd_docs, no_docs):
    docs = [(r.doc_id, r.text) for r in odd_docs.collect()]
    assert found(odd_docs, 3, 90) == brute(docs, 3, 90)
    assert found(no_docs, 3, 90) == []
    kept = jaccard.keep_one_of_each(odd_docs)
    assert kept.columns == odd_docs.columns
    assert sorted((r.doc_id, r.text) for r in kept.where("doc_id is not null").collect() if r.text) == sorted(set((i, t) for i, t in docs if t and i not in (None, 5)))
    assert jaccard.keep_one_of_each(no_docs).count() == 0


def test_copies_without_id_meet_as_one(spark):
    base = " ".join(f"w{i}" for i in range(200))
    docs = spark.range(5000).selectExpr("cast(null as long) as doc_id", f"'{base}' as text").unionByName(
        spark.createDataFrame([(4, base + " more"), (None, base + " less")], "doc_id long, text string"))
    wanted = spark.createDataFrame([(c, 1, None) for c in [r[0] for r in jaccard.sketches(docs, 5, 80, jaccard.word_counts(docs)).select("class").distinct().collect()]],
                                   "node long, label long, rep long")
    texts = jaccard._texts(docs, wanted, 5)
    assert texts.count() == texts.select("class").distinct().count() == 2  # the one with an id is not named by it here
    got = {(r.doc_id, r.component_id) for r in jaccard.similarity_components(docs).collect()}
    assert got == {(None, 4), (4, 4)}


def test_rows_are_dropped_by_id_and_text(spark):
    one, two, clean, alone = (" ".join(f"{x}{k}" for k in range(40)) for x in "abcd")
    rows = [(1, one), (2, one + " more"), (2, clean), (None, one), (None, alone), (None, alone + " more"), (3, two), (3, two + " more"), (None, "")]
    kept = jaccard.keep_one_of_each(spark.createDataFrame(rows, "doc_id long, text string"))
    got = sorted(((r.doc_id, r.text.split(" ")[0]) for r in kept.collect()), key=str)
    assert got == sorted([(1, "a0"), (2, "c0"), (None, "d0"), (3, "b0"), (None, "")], key=str)
