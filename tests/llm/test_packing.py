import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from jobmeter.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")
TOKENIZER, ENCODER = Tokenizer.from_file(PATH), packing.FastEncoder(PATH)


def ids(text):
    return TOKENIZER.encode(text or "", add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from("aAzZéÉßÿ'’sdtm<|>. \n\t\r\x0b\x1c ́-09"), st.characters(exclude_categories=["Cs"]))))
def test_encoder_gives_the_tokenizers_ids(text):
    assert np.frombuffer(ENCODER.encode(text), "<u4").tolist() == ids(text)


@settings(max_examples=100, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 500), max_size=30))
def test_plan_places_every_piece_once_and_within_capacity(counts):
    plan = packing.plan_packing(counts, 64)
    fill, ranks = Counter(), Counter()
    ends = {}
    for length in counts:
        runs = sorted((f, s, o) for n, f, s, o in zip(plan.length, plan.first, plan.sequence, plan.offset) if n == length)
        for (first, sequence, offset), nxt in zip(runs, [r[0] for r in runs[1:]] + [counts[length]]):
            for k in range(nxt - first):
                fill[sequence + k] += length
                ranks[length] += 1
                ends.setdefault(sequence + k, []).append((offset, offset + length))
    assert ranks == Counter(counts)
    assert all(n <= 64 for n in fill.values()) and len(fill) == plan.sequences
    for spans in ends.values():
        spans.sort()
        assert spans[0][0] == 0 and all(a[1] == b[0] for a, b in zip(spans, spans[1:]))


def test_exact_complements_are_used_first():
    assert packing.plan_packing({60: 3, 4: 1, 3: 1, 1: 1, 2: 2}, 64).sequences == 3  # 60+4, 60+3+1, 60+2+2


def check(rows, texts):
    want = Counter()
    for doc_id, text in texts:
        all_ids = ids(text) + [0]
        for k in range(0, len(all_ids), 2048):
            part = all_ids[k:k + 2048]
            want[doc_id, k // 2048, k, len(part), zlib.crc32(np.array(part, "<u4").tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    at = {}
    for r in rows:
        at.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for spans in at.values():
        spans.sort()
        assert spans[0][0] == 0 and sum(n for _, n in spans) <= 2048
        assert all(a + n == b for (a, n), (b, _) in zip(spans, spans[1:]))
    return at


def test_documents_against_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = packing.pack_documents(docs, PATH).collect()
    at = check(rows, [(r.doc_id, r.text) for r in docs.collect()])
    assert len(at) <= -(-sum(r.length for r in rows) // 2048) + 1


def test_odd_rows(odd_docs, no_docs):
    check(packing.pack_documents(odd_docs, PATH).collect(), [(r.doc_id, r.text) for r in odd_docs.collect()])
    assert packing.pack_documents(no_docs, PATH).count() == 0


def test_ids_make_a_round_trip(spark):
    docs = spark.createDataFrame([(1, "alpha beta"), (2, None)], "doc_id long, text string")
    got = {r.doc_id: np.frombuffer(r.ids, "<u4").tolist() for r in packing.pack_documents(docs, PATH, keep_ids=True).collect()}
    assert got == {1: ids("alpha beta") + [0], 2: [0]}


@pytest.mark.parametrize("length", [1, 2047, 2048])
def test_pieces_around_the_capacity(spark, length):
    docs = spark.createDataFrame([(1, " ".join(["a"] * length))], "doc_id long, text string")
    got = sorted((r.piece, r.length) for r in packing.pack_documents(docs, PATH).collect())
    assert got == ([(0, length + 1)] if length < 2048 else [(0, 2048), (1, 1)])
