"""Toxicity by a weighted lexicon, matched with an Aho-Corasick automaton over folded text.

Folding lowers case, maps look-alike letters and digit or symbol substitutions to plain letters and everything else that is no
letter to blanks. The lexicon holds words and beginnings of words with weights learned from labelled documents; phrases in
which a term is harmless cancel the hits inside them. Hits are weighed against the length of the text and turned into a
score by a logistic function, fitted on the same labelled sample.

Learning reads at most ``SAMPLE`` labelled documents, those with the smallest hash of their id; the lexicon has at most
``TERMS`` entries. Scoring reads every whole text.

Defined cases: a null or empty text has no hits and gets the score of a text without hits; repeated rows get a row each; labels
that are null or belong to no document are ignored, and of contradicting labels the largest counts; without usable labels
the lexicon is empty and every score is 0; empty tables give no rows; other columns pass through.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from jobmeter.llm.common import map_batches, map_rows

#: Labelled documents that learning reads at most.
SAMPLE = 10_000
#: Terms of the lexicon at most.
TERMS = 1_000
#: Candidate terms that reach the driver at most.
CANDIDATES = 20_000
_SCORE = "_llm_toxicity"

# Characters that look like Latin letters, and substitutes for letters.
LOOK_ALIKES = {
    "а": "a", "в": "b", "е": "e", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c", "т": "t", "у": "y", "х": "x",
    "і": "i", "ј": "j", "ѕ": "s", "ԁ": "d", "ɡ": "g", "ӏ": "l", "α": "a", "β": "b", "ε": "e", "ι": "i", "κ": "k", "ν": "v",
    "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ı": "i", "ſ": "s",
    "0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s",
}
#: Phrases in which a term of the lexicon says nothing bad.
EXCEPTIONS = ("trash can", "trash bin", "clown fish", "sore loser rule", "idiot proof", "pond scum")


class _Fold(dict):
    """Replacement of each lower-case character: letters stay or turn into what they look like, the rest is blank."""

    def __missing__(self, code: int) -> str:
        char = chr(code)
        if 0xFF41 <= code <= 0xFF5A:  # full-width letters
            char = chr(code - 0xFF41 + ord("a"))
        out = self[code] = LOOK_ALIKES.get(char) or (char if char.isalpha() else "" if code in (0x200B, 0x200C, 0x200D, 0xAD) else " ")
        return out


def folder():
    """A function that folds a text; it begins and ends with a blank."""
    table = _Fold()
    return lambda text: f" {text.lower().translate(table)} " if text else " "


def is_train(doc_id: Column) -> Column:
    """Rows that may be learned from: four of five, by the CRC of the id."""
    return F.crc32(doc_id.cast("string")) % 5 != 0


@dataclass
class Model:
    """Weights by term (terms begin with a blank; whole words end with one) and the logistic function over measures."""

    weights: dict[str, float] = field(default_factory=dict)
    exceptions: tuple[str, ...] = EXCEPTIONS
    mean: tuple[float, ...] = (0.0, 0.0)
    scale: tuple[float, ...] = (1.0, 1.0)
    factor: tuple[float, ...] = (0.0, 0.0)
    bias: float = -math.inf

    def matcher(self):
        """A function from a text to its measures: weight of hits, and that weight by length."""
        import ahocorasick

        fold, automaton = folder(), ahocorasick.Automaton()
        for phrase in self.exceptions:
            automaton.add_word(f" {fold(phrase).strip()} ", (len(fold(phrase).strip()) + 2, None))
        for term, weight in self.weights.items():
            automaton.add_word(term, (len(term), weight))
        if not len(automaton):
            return lambda text: (0.0, 0.0)
        automaton.make_automaton()

        def measure(text: str | None) -> tuple[float, float]:
            folded = fold(text)
            hits: dict[int, float] = {}
            harmless = []
            for end, (length, weight) in automaton.iter(folded):
                start = end - length + 1
                if weight is None:
                    harmless.append((start, end))
                elif weight > hits.get(start, 0.0):
                    hits[start] = weight
            total = sum(w for at, w in hits.items() if not any(a <= at < b for a, b in harmless)) if hits else 0.0
            return math.log1p(total), (math.log1p(1000 * total / (folded.count(" ") + 20)) if total else 0.0)

        return measure

    def score(self, measures: tuple[float, float]) -> float:
        z = self.bias + sum(f * (x - m) / s for f, x, m, s in zip(self.factor, measures, self.mean, self.scale))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z)))) if z > -math.inf else 0.0


def sample_labelled(docs: DataFrame, labels: DataFrame, size: int = SAMPLE) -> DataFrame:
    """``text, toxic`` of at most ``size`` labelled documents that may be learned from, one row for an id; of several texts of an id one is taken."""
    given = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).where(is_train(F.col("doc_id")) & F.col("toxic").isNotNull())
    given = given.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    # Labels without a document teach nothing, so they must not take a place in the sample.
    given = given.join(docs.select(F.col("doc_id").cast(dict(labels.dtypes)["doc_id"]).alias("doc_id")).distinct(), "doc_id", "left_semi")
    # `size` ids and labels at most, so small enough for each executor.
    chosen = given.orderBy(F.xxhash64("doc_id"), "doc_id").limit(size)
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "toxic").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    return texts.select("text", "toxic")


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, terms: int = TERMS) -> Model:
    """A model from labelled documents; only texts and ``toxic`` are looked at."""
    chosen = sample_labelled(docs, labels, sample)

    def count():
        fold = folder()

        def step(columns):
            seen = ({}, {})
            docs_of = [0, 0]
            for text, toxic in zip(*columns):
                toxic = int(toxic > 0)
                docs_of[toxic] += 1
                found = {f" {w} " for w in set(fold(text).split()) if len(w) > 2}
                found |= {w[:n + 1] for w in found for n in range(4, 9) if len(w) > n + 2}
                counts = seen[toxic]
                for term in found:
                    counts[term] = counts.get(term, 0) + 1
            yield from (("", toxic, n) for toxic, n in enumerate(docs_of))
            yield from ((term, toxic, n) for toxic in (0, 1) for term, n in seen[toxic].items() if len(term) < 40)

        return step

    found = map_rows(chosen, count, "term string, toxic int, n long").groupBy("term").agg(
        F.sum(F.when(F.col("toxic") == 1, F.col("n")).otherwise(0)).alias("bad"),
        F.sum(F.when(F.col("toxic") == 0, F.col("n")).otherwise(0)).alias("good"))
    enough = found.where((F.col("term") == "") | ((F.col("bad") >= 4) & (F.col("bad") > F.col("good"))))
    rows = enough.orderBy((F.col("term") == "").desc(), (F.col("bad") - F.col("good")).desc(), "term").limit(CANDIDATES).collect()
    if not rows or rows[0]["term"] != "" or not rows[0]["bad"] or not rows[0]["good"]:
        return Model()
    model = Model(weights=_choose(rows[1:], rows[0]["bad"], rows[0]["good"], terms))

    def measure():
        matched = model.matcher()
        return lambda columns: ((*matched(text), int(toxic > 0)) for text, toxic in zip(*columns))

    data = map_rows(chosen, measure, "a double, b double, toxic int").toPandas()  # `sample` rows at most
    _fit(model, data[["a", "b"]].to_numpy(), data["toxic"].to_numpy())
    return model


def _choose(rows, bad_docs: int, good_docs: int, most: int) -> dict[str, float]:
    """Terms that tell toxic documents from others, with the log of how much likelier they are there.

    A term is left out where a shorter beginning of it tells about as much.
    """
    weights: dict[str, float] = {}
    for term, bad, good in sorted(((r["term"], r["bad"], r["good"]) for r in rows), key=lambda r: (len(r[0].rstrip()), r[0])):
        p, q = (bad + 0.1) / (bad_docs + 1), (good + 0.5) / (good_docs + 1)
        weight = math.log(p / q)
        error = math.sqrt(1 / (bad + 0.1) + 1 / (good + 0.5))
        if weight - 1.0 * error < 2.0:
            continue
        shorter = max((weights.get(term[:n], 0.0) for n in range(5, len(term))), default=0.0)
        if weight > shorter + 1.0:
            weights[term] = weight
    return dict(sorted(weights.items(), key=lambda x: (-x[1], x[0]))[:most])


def _fit(model: Model, x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> None:
    """Logistic regression by Newton's method over standardised measures."""
    if not len(y) or y.min() == y.max():
        return
    mean, scale = x.mean(0), np.maximum(x.std(0), 1e-9)
    z = np.column_stack([np.ones(len(x)), (x - mean) / scale])
    w = np.zeros(z.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        penalty = np.diag([1e-6, *[ridge] * (len(w) - 1)])
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + penalty, z.T @ (y - p) - penalty @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    model.mean, model.scale = tuple(map(float, mean)), tuple(map(float, scale))
    model.factor, model.bias = tuple(map(float, w[1:])), float(w[0])


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with ``_llm_toxicity``, from 0 to 1."""
    text_at = docs.columns.index("text")
    schema = StructType([*docs.schema.fields, StructField(_SCORE, DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        measure = model.matcher()
        for batch in batches:
            scores = [model.score(measure(t)) for t in batch.column(text_at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64())], [*batch.schema.names, _SCORE])

    return map_batches(docs, run, schema)


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every document."""
    found = score(docs.select("doc_id", "text"), learn(docs, labels))
    s = F.col(_SCORE)
    return found.select("doc_id", F.coalesce(~is_train(F.col("doc_id")), F.lit(False)).alias("held_out"), s.alias("score"), (s >= 0.5).cast("int").alias("predicted"))


def remove_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without those predicted to be toxic."""
    return score(docs, learn(docs, labels)).where(F.col(_SCORE) < 0.5).drop(_SCORE)
