"""Benchmark passages found in training documents by suffix arrays, and documents taken out for them.

The documents of a task are read in shards of a few million words. Each shard gets an array of its suffixes in sorted order, and
every suffix of every benchmark item is looked up in it by binary search, as deep as a window is long; neighbouring finds join
to the longest verbatim matches with their places. Only suffixes that begin as some window begins are sorted, since no
other can be found. The benchmark is read in blocks of bounded size; each block is one more pass in the same job, over
rows that carry what earlier blocks found, so nothing is shuffled.

Defined cases: null and empty texts have no words and match nothing; items without words match nothing; items with the same id
count once; an item without id marks words but is not listed; repeated documents get a row each; empty tables give
empty results or no matches; other columns pass through, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from jobmeter.llm.common import map_batches

WINDOW = 13
#: UTF-8 bytes of benchmark text handled in one pass.
BLOCK_BYTES = 8 << 20
SHARD_WORDS = 2_000_000
#: Pairs of a place in a text and one in the benchmark that are held at once.
PAIRS = 1_000_000
_FILTER_BITS = 22
_WORDS, _MATCHES = "_llm_n_words", "_llm_matches"
_MATCH = "array<struct<item_id:bigint,doc_word:bigint,item_word:bigint,n_words:bigint>>"

_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def fold_words(text: bytes) -> list[bytes]:
    """Words of a UTF-8 text: runs of letters, digits and non-ASCII characters, A-Z in lower case."""
    return text.translate(_FOLD).split()


def _diagonals(hits: np.ndarray, owners: np.ndarray) -> np.ndarray:
    """Rows (item, lag, place, run, length): windows found at following places of a text and of an item, as runs of ``run`` windows.

    ``hits`` has rows (place, first owner, number of owners, words of the window), ``owners`` rows (item, place in the item).
    """
    place, first, k, length = hits.T
    at = np.repeat(first - np.concatenate([[0], np.cumsum(k)[:-1]]), k) + np.arange(k.sum())
    item, place, length = owners[at, 0], np.repeat(place, k), np.repeat(length, k)
    return _joined(np.column_stack([item, place - owners[at, 1], place, np.ones(len(at), np.int64), length]))


def _joined(rows: np.ndarray) -> np.ndarray:
    """Runs of :func:`_diagonals` that follow each other, as one."""
    item, lag, place, run, length = rows[np.lexsort((rows[:, 2], rows[:, 1], rows[:, 0]))].T
    new = np.ones(len(item), bool)
    new[1:] = (item[1:] != item[:-1]) | (lag[1:] != lag[:-1]) | (place[1:] != place[:-1] + run[:-1])
    head = np.flatnonzero(new)
    return np.column_stack([item[head], lag[head], place[head], np.add.reduceat(run, head), length[head]])


class Vocabulary(dict):
    """Numbers of the benchmark's words from 1; any other word is 0."""

    def __missing__(self, word):
        return 0


class BenchmarkBlock:
    """The windows of some benchmark items, ready to be looked up in suffix arrays."""

    def __init__(self, items: list[tuple[int | None, list[bytes]]], window: int):
        self.window = window
        self.vocabulary = Vocabulary()
        self.item_ids = [i for i, _ in items]
        by_length: dict[int, dict[bytes, list[tuple[int, int]]]] = {}
        self.size = 1 + sum(len(w) for _, w in items)  # above every number of a word
        starts: dict[int, set[int]] = {}
        for n, (_, words) in enumerate(items):
            ids = np.array([self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words], ">u4")
            length = min(window, len(words))
            for at in range(len(words) - length + 1 if length else 0):
                by_length.setdefault(length, {}).setdefault(ids[at:at + length].tobytes(), []).append((n, at))
                starts.setdefault(min(3, length), set()).add(self._start(ids[at:at + min(3, length)].astype(np.uint64)))
        self.groups = []
        for length, windows in sorted(by_length.items()):
            keys = sorted(windows)
            owners = [o for k in keys for o in windows[k]]
            counts = np.array([len(windows[k]) for k in keys])
            pad = 4 * (window - length)
            self.groups.append((length, np.array([k + b"\0" * pad for k in keys], f"S{4 * window}"),
                                np.array([k + b"\xff" * pad for k in keys], f"S{4 * window}"),
                                np.array(owners, np.int64), np.concatenate([[0], np.cumsum(counts)])))
        self.filters = []
        for width, found in sorted(starts.items()):
            table = np.zeros(1 << _FILTER_BITS, bool)
            table[self._slot(np.array(sorted(found), np.uint64))] = True
            self.filters.append((width, table))

    def _start(self, ids) -> int:
        total = np.uint64(0)
        for x in ids:
            total = np.uint64((int(total) * self.size + int(x)) & 0xFFFFFFFFFFFFFFFF)
        return int(total)

    @staticmethod
    def _slot(keys: np.ndarray) -> np.ndarray:
        return (keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - _FILTER_BITS)

    def _suffixes(self, ids: np.ndarray) -> np.ndarray:
        """Places in ``ids`` (padded by a window of zeros) whose first words may begin a window."""
        n = len(ids) - self.window
        here = np.zeros(n, bool)
        for width, table in self.filters:
            places = np.flatnonzero(ids[:n])
            key = ids[places].astype(np.uint64)
            for k in range(1, width):
                following = ids[places + k]
                places, key, following = places[following > 0], key[following > 0], following[following > 0]
                key = key * np.uint64(self.size) + following.astype(np.uint64)
            here[places[table[self._slot(key)]]] = True
        return np.flatnonzero(here)

    def search(self, ids: np.ndarray, starts: np.ndarray) -> dict[int, list[tuple]]:
        """Longest matches (item_id, word in document, word in item, words) by document of a shard.

        ``ids`` are the words of all documents with a 0 after each, ``starts`` where each document begins.
        """
        ids = np.concatenate([ids, np.zeros(self.window, ids.dtype)])
        places = self._suffixes(ids)
        if not len(places):
            return {}
        rows = np.lib.stride_tricks.sliding_window_view(ids, self.window)[places].astype(">u4")
        keys = np.ascontiguousarray(rows).view(f"S{4 * self.window}").ravel()
        order = np.argsort(keys, kind="stable")
        keys, places = keys[order], places[order]
        hits, tables, base = [], [], 0
        for length, low, high, owners, own in self.groups:
            first, last = np.searchsorted(keys, low, "left"), np.searchsorted(keys, high, "right")
            met = np.flatnonzero(last > first)
            n = (last - first)[met]
            window = np.repeat(met, n)
            place = places[np.repeat(first[met] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())]
            hits.append(np.column_stack([place, base + own[:-1][window], (own[1:] - own[:-1])[window], np.full(len(window), length)]))
            tables.append(owners)
            base += len(owners)
        hits = np.concatenate(hits)
        if not len(hits):
            return {}
        hits, owners = hits[np.argsort(hits[:, 0], kind="stable")], np.concatenate(tables)
        # A window may have many owners, and a text may repeat it, so only so many pairs of both are held at once.
        batch = np.cumsum(hits[:, 2]) // PAIRS
        cuts = [0, *(np.flatnonzero(batch[1:] != batch[:-1]) + 1).tolist(), len(hits)]
        parts = [_diagonals(hits[a:b], owners) for a, b in zip(cuts, cuts[1:])]
        item, lag, place, run, length = (parts[0] if len(parts) == 1 else _joined(np.concatenate(parts))).T
        length = length + run - 1
        doc = np.searchsorted(starts, place, "right") - 1
        out: dict[int, list[tuple]] = {}
        for d, i, p, g, n in zip(doc.tolist(), item.tolist(), (place - starts[doc]).tolist(), (place - lag).tolist(), length.tolist()):
            out.setdefault(d, []).append((self.item_ids[i], p, g, n))
        return out

    def annotate(self, texts: list[bytes]) -> tuple[list[int], list[list[tuple]]]:
        """Number of words and matches of each text."""
        words, matches = [], []
        ids: list[np.ndarray] = []
        held = 0

        def flush():
            nonlocal ids, held
            ends = np.cumsum([len(x) for x in ids], dtype=np.int64)
            found = self.search(np.concatenate(ids), np.concatenate([[0], ends[:-1]])) if ids else {}
            matches.extend(found.get(k, []) for k in range(len(ids)))
            ids, held = [], 0

        for text in texts:
            found = fold_words(text)
            words.append(len(found))
            ids.append(np.fromiter(map(self.vocabulary.__getitem__, found + [b""]), np.uint32, len(found) + 1))
            held += len(found) + 1
            if held >= SHARD_WORDS:
                flush()
        flush()
        return words, matches


def benchmark_blocks(benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> Iterator[BenchmarkBlock]:
    """The benchmark as blocks of about ``block_bytes`` of text, read one partition at a time."""
    held, size = [], 0
    rows = benchmark.select(F.col("item_id").cast("long"), F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    for item_id, text in rows.toLocalIterator():
        held.append((item_id, fold_words(bytes(text))))
        size += len(text) + 64
        if size >= block_bytes:
            yield BenchmarkBlock(held, window)
            held, size = [], 0
    yield BenchmarkBlock(held, window)


def match_benchmark(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``docs`` with ``_llm_n_words`` and ``_llm_matches``, the longest verbatim matches of at least a window.

    An item of fewer words than ``window`` is one window. Matches hold the item, the first word in document and item, and the
    number of words.
    """
    given = docs.schema
    schema = StructType([*given.fields, StructField(_WORDS, LongType()), *StructType.fromDDL(f"`{_MATCHES}` {_MATCH}").fields])
    docs = docs.select("*", F.lit(0).cast("long").alias(_WORDS), F.array().cast(_MATCH).alias(_MATCHES))
    text_at = [f.name for f in given.fields].index("text")

    def search(block: BenchmarkBlock):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at in range(0, batch.num_rows, 1000):
                    part = batch.slice(at, 1000)
                    texts = [b"" if x is None else x.encode() for x in part.column(text_at).to_pylist()]
                    words, found = block.annotate(texts)
                    kind = part.schema.field(_MATCHES).type
                    matches = [old + [dict(zip(("item_id", "doc_word", "item_word", "n_words"), m)) for m in new]
                               for old, new in zip(part.column(len(given) + 1).to_pylist(), found)]
                    columns = [*part.columns[:len(given)], pa.array(words, pa.int64()), pa.array(matches, kind)]
                    yield pa.RecordBatch.from_arrays(columns, schema=part.schema)

        return run

    for block in benchmark_blocks(benchmark, window, block_bytes):
        docs = map_batches(docs, search(block), schema)
    return docs


def hit_words(matches: Column) -> Column:
    """Words covered by any match, each counted once."""
    spans = F.array_sort(F.transform(matches, lambda m: F.struct(m["doc_word"].alias("a"), (m["doc_word"] + m["n_words"]).alias("b"))))
    none = F.struct(F.lit(0).cast("long").alias("end"), F.lit(0).cast("long").alias("hit"))
    return F.aggregate(spans, none, lambda x, s: F.struct(
        F.greatest(x["end"], s["b"]).alias("end"),
        (x["hit"] + F.greatest(F.lit(0).cast("long"), s["b"] - F.greatest(x["end"], s["a"]))).alias("hit")))["hit"]


def contaminated(n_hit: Column, n_words: Column, least_percent: int = 5) -> Column:
    """True if at least ``least_percent`` of the words, and one at least, are hit."""
    return (n_hit > 0) & (n_hit * 100 >= n_words * least_percent)


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """``docs`` without the contaminated ones, all columns as given."""
    found = match_benchmark(docs, benchmark, window)
    return found.where(~contaminated(hit_words(F.col(_MATCHES)), F.col(_WORDS))).select(*[F.col(f"`{c}`") for c in docs.columns])


def contamination_report(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """Per document: words, hit words, items found, and the verdict."""
    found = match_benchmark(docs.select("doc_id", "text"), benchmark, window)
    items = F.array_sort(F.array_distinct(F.transform(F.filter(_MATCHES, lambda m: m["item_id"].isNotNull()), lambda m: m["item_id"].cast("string"))))
    found = found.select("doc_id", F.col(_WORDS).alias("n_words"), hit_words(F.col(_MATCHES)).alias("n_hit"), items.alias("items"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), contaminated(F.col("n_hit"), F.col("n_words")).alias("contaminated"))
