import random

import public_tokenizers
import pytest

from jobmeter.llm import tokencount as K

PATH = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def vocabulary():
    return K.Vocabulary(PATH)


def brute(v, word):
    best = [(0.0, 0)]
    for end in range(1, len(word) + 1):
        found = [(best[s][0] + v.score[word[s:end]], best[s][1] - 1) for s in range(max(0, end - 40), end) if word[s:end] in v.score]
        if word[end - 1] not in v.score:
            found.append((best[-1][0] + v.unknown, best[-1][1] - len(word[end - 1].encode())))
        best.append(max(found))
    return -best[-1][1]


def test_words_against_brute_force(vocabulary):
    rng = random.Random(8)
    words = {K.MARK + "".join(rng.choice("abetionéß中🜁1.▁") for _ in range(rng.randrange(1, 14))) for _ in range(3000)}
    assert K.count_words(vocabulary, words) == {w: brute(vocabulary, w) for w in words}


def test_shared_beginnings_are_worked_out_once(vocabulary, monkeypatch):
    steps = []
    step = K.Vocabulary.step
    monkeypatch.setattr(K.Vocabulary, "step", lambda self, word, best: (steps.append(word[:len(best)]), step(self, word, best)))
    words = ["▁token", "▁tokens", "▁tokenize", "▁to", "▁other"]
    K.count_words(vocabulary, words)
    assert sorted(steps) == sorted({w[:n] for w in words for n in range(1, len(w) + 1)})


def test_documents_against_brute_force(spark, vocabulary):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    want = sorted((r.doc_id, len((r.text or "").split()), sum(brute(vocabulary, K.MARK + w) for w in (r.text or "").split())) for r in docs.collect())
    assert sorted(map(tuple, K.count_tokens(docs, PATH).collect())) == want


def test_odd_rows(odd_docs, no_docs, vocabulary, monkeypatch):
    got = sorted((tuple(r) for r in K.count_tokens(odd_docs, PATH).collect()), key=str)
    want = []
    for r in odd_docs.collect():
        words = (r.text or "").split()
        each = K.count_words(vocabulary, {K.MARK + w for w in words})
        want.append((r.doc_id, len(words), sum(each[K.MARK + w] for w in words)))
    assert got == sorted(want, key=str)
    assert K.count_tokens(no_docs, PATH).count() == 0
