"""How far the sources of a language differ in the terms they use.

1. Terms are counted per language and source inside each task, and then summed. A language keeps the terms of enough documents.
2. Kept terms are dealt into buckets of about ``BUCKET_TERMS``; within its bucket a term has a number. A group, that is a source in a language,
   becomes one array of (term number, count), sorted by number, for each bucket. Terms a group lacks are not stored.
3. Groups meet in pair tasks: tiles of ``TILE`` groups, co-grouped with each other tile per bucket. Each unordered pair of arrays is
   intersected by searching the numbers of the shorter one in the longer one. Terms of both, terms of one side against the other side's share of
   an absent term, and the number of terms that neither has give the value, which counts for both directions.

A task holds ``2 * TILE`` arrays of a bucket, however many terms a language or documents a source has. An array is sent once per
tile, not once per pair. The pairs of sources of a language are themselves the result.

All arithmetic is in whole numbers: ``share = 1 + floor(SCALE * (count + 2) / (total + 2 * terms))``, and a term's value is
``floor((p - q) ** 2 / (p + q))``.

Defined cases: null text, language and source count as empty; rows are counted one by one, repeated ids too; a source without terms
is a group; a language without kept terms gives pairs of value 0; empty tables give no rows; ids and other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from jobmeter.llm.common import cut, map_batches, text_bytes

SCALE = 10**9
#: Documents that a kept term occurs in.
LEAST_DOCS = 10
#: Terms of a bucket, and groups of a tile.
BUCKET_TERMS = 20_000
TILE = 8
#: Entries that a task counts before it passes them on.
HELD_TERMS = 200_000

_TERM = re.compile(rb"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
_COUNTS = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("docs", pa.int64())])
_PRICES = pa.schema([("lang", pa.string()), ("a", pa.string()), ("b", pa.string()), ("value", pa.int64()), ("terms", pa.int64())])


def count_terms(docs: DataFrame) -> DataFrame:
    """``lang, source, term, n, docs``: occurrences and documents of each term; a row without term for each group."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups: dict[tuple[str, str], tuple[Counter, Counter]] = {}
        held = 0

        def flush() -> Iterator[pa.RecordBatch]:
            for (lang, source), (n, in_docs) in groups.items():
                terms = [None, *n]
                rows = [[lang] * len(terms), [source] * len(terms), terms, [0, *n.values()], [0, *(in_docs[t] for t in n)]]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(rows, _COUNTS)], schema=_COUNTS)

        for batch in batches:
            for lang, source, text in zip(*(c.to_pylist() for c in batch.columns)):
                n, in_docs = groups.setdefault((lang, source), (Counter(), Counter()))
                before, found = len(n), _TERM.findall(text.lower())
                n.update(found)
                in_docs.update(set(found))
                held += len(n) - before
                if held > HELD_TERMS:
                    yield from flush()
                    groups, held = {}, 0
        yield from flush()

    blank = lambda name: F.coalesce(F.col(name).cast("string"), F.lit("")).alias(name)
    found = map_batches(docs.select(blank("lang"), blank("source"), text_bytes()), run, "lang string, source string, term string, n long, docs long")
    return found.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(count: Column, total: Column, terms: Column) -> Column:
    """The share of a term in whole parts of ``SCALE``; decimals, as counts times ``SCALE`` exceed a long."""
    wide = lambda c: c.cast("decimal(19,0)")
    parts = F.lit(SCALE).cast("decimal(10,0)") * (wide(count) + F.lit(2).cast("decimal(19,0)"))
    return F.lit(1).cast("long") + F.call_function("div", parts, wide(total + 2 * terms)).cast("long")


def distance(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), p + q)


def shares(counts: np.ndarray, total: int, terms: int) -> np.ndarray:
    """As :func:`share`, for counts of an array."""
    if len(counts) and int(counts.max()) > 2**63 // SCALE - 3:
        return np.array([1 + SCALE * (int(c) + 2) // (total + 2 * terms) for c in counts], np.int64)
    return 1 + SCALE * (counts + 2) // (total + 2 * terms)


def distances(p: np.ndarray, q: np.ndarray | int) -> int:
    return int(((p - q) * (p - q) // (p + q)).sum())


def merge(ids: np.ndarray, p: np.ndarray, p_absent: int, other_ids: np.ndarray, q: np.ndarray, q_absent: int) -> tuple[int, int]:
    """The summed value of the terms that at least one of two sparse lists has, and how many they are."""
    if len(ids) > len(other_ids):
        ids, p, p_absent, other_ids, q, q_absent = other_ids, q, q_absent, ids, p, p_absent
    if not len(ids):
        return distances(q, p_absent), len(other_ids)
    # Ascending keys, so each search goes on from where the one before ended.
    at = np.searchsorted(other_ids, ids)
    at[at == len(other_ids)] = 0
    both = other_ids[at] == ids
    lone = np.ones(len(other_ids), bool)
    lone[at[both]] = False
    value = distances(p[both], q[at[both]]) + distances(p[~both], q_absent) + distances(q[lone], p_absent)
    return value, len(ids) + int(lone.sum())


def _price(left: pa.Table, right: pa.Table) -> pa.Table:
    """Values of all unordered pairs of a group of ``left`` and one of ``right``."""
    def lists(table: pa.Table) -> list[tuple]:
        out = []
        for row in zip(*(table.column(c) for c in ("lang", "source", "ids", "counts", "total", "terms"))):
            lang, source, total, terms = (row[k].as_py() for k in (0, 1, 4, 5))
            ids, counts = (row[k].values.to_numpy(zero_copy_only=False).astype(np.int64) for k in (2, 3))
            out.append((lang, source, ids, shares(counts, total, terms), int(shares(np.zeros(1, np.int64), total, terms)[0])))
        return out

    rows, others = [], lists(right)
    for lang, a, *one in lists(left):
        # Tiles follow the order of sources; in a tile that meets itself each pair counts once.
        rows += [(lang, a, b, *merge(*one, *other)) for _, b, *other in others if a < b]
    columns = zip(*rows) if rows else [[] for _ in _PRICES]
    return pa.Table.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, _PRICES)], schema=_PRICES)


def _pair_values(arrays: DataFrame, groups: DataFrame) -> DataFrame:
    """``lang, a, b, value, found`` of unordered pairs: sums over the terms that either has."""
    places = groups.where("terms > 0").select("lang", "source", "tile", "tiles", "total", "terms", F.explode(F.expr("sequence(0, buckets - 1)")).alias("bucket"))
    given = places.join(arrays, ["lang", "source", "bucket"], "left").withColumns({
        "ids": F.coalesce("ids", F.array().cast("array<int>")), "counts": F.coalesce("counts", F.array().cast("array<long>"))})
    # A tile is the left side towards itself and later ones, and the right side towards itself and earlier ones.
    left = given.withColumns({"lo": F.col("tile"), "hi": F.explode(F.expr("sequence(tile, tiles - 1)"))})
    right = given.toDF(*given.columns).withColumns({"lo": F.explode(F.expr("sequence(0, tile)")), "hi": F.col("tile")})
    keys = ["lang", "bucket", "lo", "hi"]
    priced = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(_price, "lang string, a string, b string, value long, terms long")
    return priced.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"), F.sum("terms").alias("found"))


def audit(docs: DataFrame, least_docs: int = LEAST_DOCS, top: int = 10) -> DataFrame:
    """``lang, source, part, item, value, rank`` per source of a language.

    Part ``pair`` holds its distance to each other source of the language; part ``term`` the ``top`` terms that it has more of than the language.
    """
    counts = cut(count_terms(docs), "term-counts")
    of_lang = counts.where("term is not null").groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("in_lang"))
    of_lang = cut(of_lang.where(F.col("docs") >= least_docs).select("lang", "term", "in_lang"), "lang-terms")
    langs = of_lang.groupBy("lang").agg(F.count("*").alias("terms"), F.sum("in_lang").alias("lang_total"))
    langs = cut(langs.withColumn("buckets", F.ceil(F.col("terms") / BUCKET_TERMS).cast("int")), "langs")

    bucket = F.pmod(F.xxhash64("term"), F.col("buckets")).cast("int").alias("bucket")
    numbered = of_lang.join(langs, "lang").select("lang", "term", "in_lang", bucket)
    numbered = numbered.withColumn("id", F.row_number().over(Window.partitionBy("lang", "bucket").orderBy("term")))
    entries = cut(counts.where("term is not null").join(numbered, ["lang", "term"]).select("lang", "source", "term", "n", "in_lang", "bucket", "id"), "entries")

    totals = entries.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = counts.select("lang", "source").distinct().join(totals, ["lang", "source"], "left").join(langs, "lang", "left")
    groups = groups.fillna(0, ["total", "terms", "lang_total"])
    place = F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1
    tiles = F.ceil(F.count("*").over(Window.partitionBy("lang")) / TILE).cast("int")
    groups = cut(groups.select("lang", "source", "total", "terms", "lang_total", "buckets", F.floor(place / TILE).cast("int").alias("tile"), tiles.alias("tiles")), "groups")

    arrays = entries.groupBy("lang", "source", "bucket").agg(F.sort_array(F.collect_list(F.struct("id", "n"))).alias("list"))
    arrays = cut(arrays.select("lang", "source", "bucket", F.col("list.id").alias("ids"), F.col("list.n").alias("counts")), "arrays")
    priced = _pair_values(arrays, groups)

    side = lambda name: groups.select("lang", F.col("source").alias(name), F.col("total").alias(f"{name}_total"), "terms")
    pairs = side("a").join(side("b").drop("terms"), "lang").where("a < b").join(priced, ["lang", "a", "b"], "left")
    none = F.lit(0).cast("long")
    absent = distance(share(none, F.col("a_total"), F.col("terms")), share(none, F.col("b_total"), F.col("terms")))
    value = F.coalesce("value", none) + (F.col("terms") - F.coalesce("found", none)) * absent
    pairs = cut(pairs.select("lang", "a", "b", F.when(F.col("terms") > 0, value).otherwise(none).alias("value")), "pairs")
    both = pairs.select("lang", F.col("a").alias("source"), F.col("b").alias("item"), "value").unionByName(
        pairs.select("lang", F.col("b").alias("source"), F.col("a").alias("item"), "value"))

    p = share(F.col("n"), F.col("total"), F.col("terms"))
    q = share(F.col("in_lang"), F.col("lang_total"), F.col("terms"))
    more = entries.join(groups, ["lang", "source"]).withColumns({"p": p, "q": q}).where("p > q")
    more = more.select("lang", "source", F.col("term").alias("item"), distance(F.col("p"), F.col("q")).alias("value"))

    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = lambda df, part: df.select("lang", "source", F.lit(part).alias("part"), "item", "value", F.row_number().over(order).alias("rank"))
    return ranked(both, "pair").unionByName(ranked(more, "term").where(F.col("rank") <= top))
