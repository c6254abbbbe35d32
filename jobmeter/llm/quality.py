"""Text quality rules: a table of thresholds compiled into one projection.

Every measure is a column expression over the words and lines of a text and every rule an integer comparison between two
measures, so the verdict is part of one projection without Python. Words are runs of characters other than blank and U+0009 to
U+000D; lines end at line feeds.

Defined cases: a null or empty text has no words and fails the base rules; repeated rows each get their row; an empty table
gives no rows; other columns are ignored. Repeated windows are told by 64-bit hashes of their words.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_SPACE = " \t\n\x0b\f\r"
_BREAK = "[ \\t-\\r]+"
WINDOW = 5

# Frequent function words of English, German, French and Spanish.
STOP_WORDS = (
    "the be to of and that have with in is it for on was as at by this are from "
    "der die das und ist von zu den mit ein eine nicht im auf für dem des sie "
    "le la les de des et un une que est dans pour pas sur du au avec il "
    "el los las y en por con para se no es una del lo como al"
).split()


@dataclass(frozen=True)
class Rule:
    """Holds where ``least / 100 <= measure / per <= most / 100``; a bound of None is open, ``per`` None stands for 100."""

    measure: str
    per: str | None = None
    least: int | None = None
    most: int | None = None

    def holds(self) -> Column:
        value = F.col(self.measure) * 100
        per = F.col(self.per) if self.per else F.lit(100)
        bounds = [value >= per * self.least] if self.least is not None else []
        bounds += [value <= per * self.most] if self.most is not None else []
        return _all(bounds)


#: What must not be broken by a text worth looking at.
BASE_RULES = (
    Rule("n_words", least=10),
    Rule("n_repeat_words", "n_words", most=20),
)
#: What a text must fulfil besides.
RULES = (
    Rule("n_words", most=100_000),
    Rule("word_chars", "n_words", least=200, most=1200),
    Rule("n_symbols", "n_words", most=10),
    Rule("n_stop_words", "n_words", least=5),
    Rule("n_dup_lines", "n_lines", most=50),
)


def _all(conditions: list[Column]) -> Column:
    out = F.lit(True)
    for c in conditions:
        out = out & c
    return out


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _repeat_words(hashes: Column) -> Column:
    """Words inside windows whose hash occurs twice or more; ``hashes`` holds one hash for each place."""

    def covered(places: Column) -> Column:
        overlap = F.transform(places, lambda p, j: F.greatest(F.lit(0), F.lit(WINDOW) - (F.coalesce(F.get(places, j + 1), p + WINDOW) - p)))
        return F.size(places) * WINDOW - F.aggregate(overlap, F.lit(0), lambda a, b: a + b)

    def repeated(pairs: Column) -> Column:
        same = lambda e, j: (e["h"] == F.get(pairs, j - 1)["h"]) | (e["h"] == F.get(pairs, j + 1)["h"])
        return F.sort_array(F.transform(F.filter(pairs, same), lambda e: e["i"]))

    pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    some = F.size(F.array_distinct(hashes)) < F.size(hashes)
    return F.when(some, _let(pairs, lambda s: _let(repeated(s), covered))).otherwise(F.lit(0)).cast("long")


def measures(docs: DataFrame) -> DataFrame:
    """The counts that rules compare, for each document."""
    text = F.coalesce(F.col("text"), F.lit(""))
    bare = F.btrim(text, F.lit(_SPACE))
    words = F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, _BREAK))
    lines = F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(_SPACE)) != "")
    stop = [F.lit(w) for w in STOP_WORDS]
    cut = docs.select("doc_id", text.alias("text"), words.alias("words"), lines.alias("lines"))
    n = F.size("words")
    hashes = F.transform(F.sequence(F.lit(0), n - WINDOW), lambda i: F.xxhash64(*[F.get("words", i + k) for k in range(WINDOW)]))
    cut = cut.select("*", F.when(n >= WINDOW, hashes).otherwise(F.array().cast("array<bigint>")).alias("hashes"))
    found = F.struct(
        n.cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace("text", "[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        _repeat_words(F.col("hashes")).alias("n_repeat_words"),
        F.size("lines").cast("long").alias("n_lines"),
        F.size(F.filter("words", lambda w: F.lower(w).isin(*stop))).cast("long").alias("n_stop_words"),
    )
    # Filters on measures stay above the generator; pushed into the projection, they would work it out once for each use.
    return cut.select("doc_id", found.alias("found")).select("doc_id", F.inline(F.array("found")))


def apply_rules(docs: DataFrame, rules: tuple[Rule, ...] = RULES, base: tuple[Rule, ...] = BASE_RULES) -> DataFrame:
    """Measures, ``base_failed`` and ``kept`` for each document."""
    failed = ~_all([r.holds() for r in base])
    return measures(docs).select("*", failed.alias("base_failed"), (~failed & _all([r.holds() for r in rules])).alias("kept"))
