"""Tokens of each text under a unigram vocabulary, by dynamic programming over a trie of words.

A text is split at white space; each word, with the word-begin mark before it, is cut into the vocabulary's pieces such that the sum of
their scores is largest, and among equal sums the number of pieces is smallest. The best score of a beginning of a word depends on
that beginning alone, so the different words of a batch go into one trie whose nodes are worked out once for all
words that share them; the node where a word ends holds its count. A character that no piece holds counts as its UTF-8 bytes and
has the score of the worst piece less ten.

Words already counted stay in a cache of bounded size; only counts leave a task, and nothing is shuffled.

Defined cases: null, empty and blank texts have no words and no tokens; repeated rows get a row each; an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable
from os.path import commonprefix

from pyspark.sql import DataFrame

from jobmeter.llm.common import CACHE_ENTRIES, map_rows

MARK = "▁"
#: Longer words are counted on their own and not kept.
LONG_WORD = 200


class Vocabulary:
    """Pieces and scores of a model file, without its control and byte pieces and runs of marks, which words don't hold."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        kept = [i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
        self.score = {p: model.get_score(i) for i in kept if len(p := model.id_to_piece(i)) == 1 or p.strip(MARK)}
        self.ends = {p[k:] for p in self.score for k in range(len(p))}
        self.unknown = min(self.score.values(), default=0.0) - 10

    def step(self, word: str, best: list[tuple[float, int]]) -> None:
        """Adds to ``best`` the score and (negative) number of pieces of the beginning of ``word`` that is one longer."""
        end = len(best)
        found = []
        for start in range(end - 1, -1, -1):
            piece = word[start:end]
            if piece not in self.ends:
                break
            score = self.score.get(piece)
            if score is not None:
                above = best[start]
                found.append((above[0] + score, above[1] - 1))
        if word[end - 1] not in self.score:
            above = best[end - 1]
            found.append((above[0] + self.unknown, above[1] - len(word[end - 1].encode("utf-8", "surrogatepass"))))
        best.append(max(found))


def count_words(vocabulary: Vocabulary, words: Iterable[str]) -> dict[str, int]:
    """Tokens of each of ``words``, which begin with the mark.

    Sorted words pass through their trie in depth-first order: ``best`` belongs to the path from the root to the present node, and
    what a word shares with the one before it is kept.
    """
    counts: dict[str, int] = {}
    best, path = [(0.0, 0)], ""
    for word in sorted(words):
        shared = len(commonprefix((path, word)))
        del best[shared + 1:]
        while len(best) <= len(word):
            vocabulary.step(word, best)
        path = word
        counts[word] = -best[-1][1]
    return counts


def count_tokens(docs: DataFrame, model_path: str) -> DataFrame:
    """``doc_id, n_words, n_tokens`` of every document."""

    def make():
        vocabulary = Vocabulary(model_path)
        known: dict[str, int] = {}

        def step(columns):
            ids, texts = columns
            split = [(t or "").split() for t in texts]
            new = {w for words in split for w in words} - known.keys()
            if len(known) + len(new) > CACHE_ENTRIES:
                known.clear()
                new = {w for words in split for w in words}
            once = {w for w in new if len(w) > LONG_WORD}
            for words in (new - once, once):
                known.update((w[1:], n) for w, n in count_words(vocabulary, [MARK + w for w in words]).items())
            rows = [(i, len(words), sum(map(known.__getitem__, words))) for i, words in zip(ids, split)]
            for w in once:
                del known[w]
            return rows

        return step

    return map_rows(docs.select("doc_id", "text"), make, "doc_id long, n_words long, n_tokens long")
