import random
from collections import defaultdict

from jobmeter.llm import linededup


def brute(docs, similar=80):
    """Templates one line after the other, over all lines."""
    import re
    mask = lambda x: " ".join("<*>" if re.search("[0-9]", t) else t for t in re.split("[ \t\r]+", x.strip(" \t\r")))
    first = lambda i: -(2**63) if i is None else i
    lines = defaultdict(set)
    for i, text in docs:
        for x in (text or "").split("\n"):
            if len(mask(x).split(" ")) >= 8:
                lines[mask(x)].add(first(i))
    nodes = defaultdict(list)
    for x in lines:
        nodes[len(x.split(" ")), tuple(x.split(" ")[:3])].append(x)
    owner = {}
    for members in nodes.values():
        heads = []
        for x in sorted(members, key=lambda x: (min(lines[x]), linehash(x))):
            t = x.split(" ")
            for h in heads:
                if sum(a != b for a, b in zip(t, h[0])) <= len(t) * (100 - similar) // 100:
                    h[1].append(x)
                    break
            else:
                heads.append((t, [x]))
        for _, group in heads:
            least = min(min(lines[x]) for x in group)
            for x in group:
                owner[x] = least
    out = []
    for i, text in docs:
        keep = [x for x in (text or "").split("\n") if owner.get(mask(x), first(i)) == first(i)]
        n = 0 if text is None else len(text.split("\n"))
        out.append((i, None if text is None else "\n".join(keep), n, n - len(keep) if text is not None else 0))
    return sorted(out, key=str)


_HASHES = {}


def linehash(x):
    return _HASHES[x]


def hash_lines(spark, docs):
    from pyspark.sql import functions as F
    lines = sorted({x for _, t in docs for x in (t or "").split("\n")})
    df = spark.createDataFrame([(x,) for x in lines], "line string")
    masked = linededup.masked(F.col("line"))
    _HASHES.update((r[0], r[1]) for r in df.select(masked, F.xxhash64(masked)).collect())


def found(docs, **options):
    return sorted((tuple(r) for r in linededup.line_report(docs, **options).collect()), key=str)


def test_documents_against_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    hash_lines(spark, rows)
    want = brute(rows)
    assert sum(r[3] for r in want) > 20
    assert found(docs) == want


def test_variable_fields(spark):
    rng = random.Random(2)
    rows = []
    for i in range(40):
        text = [f"job {rng.randrange(10**6)} of user {rng.choice('ab')} ended after {i} s on node{i} with state {rng.choice(['ok', 'failed'])} today and left",
                " ".join(f"own{rng.choice('abcdefgh')}{'x' * rng.randrange(9)}" for _ in range(12)), "short line"]
        rows.append((i, "\n".join(text)))
    hash_lines(spark, rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = found(docs)
    assert got == brute(rows)
    assert [r for r in got if r[0] == 0][0][3] == 0 and all(r[3] >= 1 for r in got if r[0])
    assert all("short line" in r[1] for r in got)


def test_crowded_nodes_are_split(spark):
    rows = [(i, f"the same first words then {chr(97 + i)} {chr(98 + i)} and much more text follows here in it") for i in range(20)] * 2
    docs = spark.createDataFrame([(k, t) for k, (_, t) in enumerate(rows)], "doc_id long, text string")
    got = found(docs, node_lines=3)
    assert sum(r[3] for r in got) >= 20


def test_odd_rows(odd_docs, no_docs):
    rows = [(r.doc_id, r.text) for r in odd_docs.collect()]
    assert found(odd_docs) == sorted(((i, t, 0 if t is None else len(t.split("\n")), 0) for i, t in rows), key=str)
    assert linededup.dedup_lines(odd_docs).columns == odd_docs.columns
    assert linededup.dedup_lines(odd_docs).count() == len(rows)
    assert found(no_docs) == [] and linededup.dedup_lines(no_docs).count() == 0


def test_emptied_documents_go_and_lengths_follow(spark):
    line = "a line that is long enough to recur in this corpus"
    rows = [(1, line, 50), (2, line, 50), (3, "own\n" + line, 54), (3, line, 50), (4, None, None)]
    got = linededup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string, n_chars long"))
    assert sorted((tuple(r) for r in got.collect()), key=str) == sorted([(1, line, 50), (3, "own", 3), (4, None, None)], key=str)


def test_short_lines(spark):
    han = "\u672c\u6587\u6863\u7684\u7248\u6743\u5f52\u4f5c\u8005\u6240\u6709"
    rows = [(1, f"All rights reserved.\n\nPage 1 of 9\n12\n{han}2019\nown"), (2, f"mine\n\n  All rights  reserved.\nPage 3 of 9\n13\n{han}2024"),
            (3, "All rights waived.\n12\nPage one of 9\n\u672c2"), (4, "\u7248 3\n\u672c7")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert found(docs, short_lines=True) == [(1, rows[0][1], 6, 0), (2, "mine\n\n13", 6, 3),
                                             (3, "All rights waived.\nPage one of 9\n\u672c2", 4, 1), (4, "\u7248 3", 2, 1)]
    assert found(docs) == [(i, t, len(t.split("\n")), 0) for i, t in rows]


def test_crowded_nodes_have_the_results_of_whole_ones(spark):
    rng = random.Random(4)
    rows = []
    for i in range(400):
        n = rng.choice((10, 15))
        line = ["the", "same", "words", *(rng.choice("abc") if rng.random() < 0.5 else "x" for _ in range(n - 3))]
        rows.append((rng.randrange(150), " ".join(line) + "\nthe same words then " + " ".join(f"{chr(97 + i // 26)}{chr(97 + i % 26)}{k}" for k in "uvwxyz")))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    lines = linededup._lines(docs, 8, 3, False)
    rows_of = lambda most: sorted(tuple(r)[1:] for r in linededup.templates(lines, node_lines=most).collect())
    whole = rows_of(10_000)
    assert 420 < len({r[1] for r in whole}) < len(whole) - 40
    assert rows_of(120) == whole
