"""Best-fit packing of tokenized documents into sequences of fixed capacity.

Documents become pieces (id, place, length) in one distributed pass. Packing needs only how many pieces have each length, a
histogram of at most ``capacity`` numbers, so the driver plans with that histogram alone, whatever the corpus holds. The plan
says for each length which ranks go to which sequences; ranks are counted per shard and looked up where the pieces are.

Defined cases: a null or empty text is one piece that holds the end id; a repeated row is packed once per row; an empty table
gives no rows; other columns are ignored; pieces of equal length are interchangeable, so their order decides nothing else.
"""

from __future__ import annotations

import re
import zlib
from collections import defaultdict
from dataclasses import dataclass, field

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from jobmeter.llm.common import Cache, cut, map_rows

CAPACITY = 2048
END_ID = 0
_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, shard int, shard_rank long"


class FastEncoder:
    """Ids of a text as little-endian 32-bit bytes, equal to the tokenizer's own, with words looked up once.

    The tokenizer splits at white space and never looks across it, so texts are cut at blanks and line feeds. Words of ASCII
    and Latin-1 letters are split here as its pre-tokenizer does; all others go through the tokenizer itself.
    """

    _plain = re.compile(r"[!-~À-ÖØ-öø-ÿ]*\Z")
    _split = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-z0-9ß-öø-ÿ]+")

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        latin = {chr(c) for c in range(0xC0, 0x100)} - {"×", "÷"}
        self.byte_level = str.maketrans({c: self.tokenizer.pre_tokenizer.pre_tokenize_str(c)[0][0] for c in latin})
        self.marked = [a.content for a in self.tokenizer.get_added_tokens_decoder().values()]
        self.pieces, self.words = Cache(self._piece), Cache(self._word)

    def _piece(self, piece: str) -> bytes:
        return np.array([t.id for t in self.tokenizer.model.tokenize(piece.translate(self.byte_level))], "<u4").tobytes()

    def _word(self, word: str) -> bytes:
        if self._plain.match(word) and not any(m in word for m in self.marked):
            return b"".join(map(self.pieces.__getitem__, self._split.findall(word.lower())))
        return np.array(self.tokenizer.encode(word, add_special_tokens=False).ids, "<u4").tobytes()

    def encode(self, text: str) -> bytes:
        words = text.replace("\n", " ").split(" ")
        long = max(map(len, words), default=0) > 200
        got = map(self._word, words) if long else map(self.words.__getitem__, words)
        return b"".join(got)

    def trim(self) -> None:
        self.pieces.trim()
        self.words.trim()


def tokenize_pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID,
                    keep_ids: bool = False) -> DataFrame:
    """Pieces of at most ``capacity`` ids of every document, each followed by ``end_id``; ``keep_ids`` adds the ids as bytes.

    ``shard`` and ``shard_rank`` number the pieces of a length within one task of this pass.
    """
    end, width = np.array([end_id], "<u4").tobytes(), 4 * capacity

    def make():
        encoder, seen = FastEncoder(tokenizer_path), defaultdict(int)
        shard = TaskContext.get().partitionId()

        def step(columns):
            for doc_id, text in zip(*columns):
                ids = encoder.encode(text or "") + end
                for piece, at in enumerate(range(0, len(ids), width)):
                    part = ids[at:at + width]
                    length = len(part) // 4
                    row = (doc_id, piece, at // 4, length, zlib.crc32(part), shard, seen[length])
                    seen[length] += 1
                    yield (*row, part) if keep_ids else row
            encoder.trim()

        return step

    return map_rows(docs.select("doc_id", "text"), make, _PIECES + (", ids binary" if keep_ids else ""))


@dataclass
class Plan:
    """Which ranks of a length go where: rank ``r`` of ``length`` in ``[first, next first)`` goes to ``sequence + r - first``."""

    length: list[int] = field(default_factory=list)
    first: list[int] = field(default_factory=list)
    sequence: list[int] = field(default_factory=list)
    offset: list[int] = field(default_factory=list)
    sequences: int = 0

    def put(self, used: dict[int, int], length: int, count: int, sequence: int, offset: int) -> None:
        self.length.append(length)
        self.first.append(used[length])
        self.sequence.append(sequence)
        self.offset.append(offset)
        used[length] += count


def plan_packing(counts: dict[int, int], capacity: int = CAPACITY) -> Plan:
    """A packing of ``counts[length]`` pieces of each length, by exact complements first and best fit for what remains.

    From the longest length down, the gap beside it is filled exactly by one length, else by a pair, else by a triple that
    adds up to it, as often as the counts allow; sums of available pairs are kept in an index by sum. The rest is placed in
    the open sequences with the smallest sufficient gap. Each step handles all sequences of one shape at once, so work and
    plan depend on the capacity and not on the number of pieces.
    """
    plan, used = Plan(), defaultdict(int)
    left = np.zeros(capacity + 1, np.int64)
    for length, count in counts.items():
        left[length] = count
    pair_sums = np.zeros(2 * capacity + 1, np.int64)  # by sum: unordered pairs of available lengths, a length with itself too
    for a in np.flatnonzero(left):
        pair_sums[a + np.flatnonzero(left[:a + 1])] += 1

    def gone(length: int) -> None:
        pair_sums[length + np.flatnonzero(left)] -= 1
        pair_sums[2 * length] -= 1

    def pairs_with_sum(total: int):
        low = np.arange(max(1, total - capacity), total // 2 + 1)
        return low[(left[low] > 0) & (left[total - low] > 0)]

    def complements(gap: int):
        if left[gap]:
            yield (gap,)
        if pair_sums[gap]:
            for a in pairs_with_sum(gap):
                yield (int(gap - a), int(a))
        third = np.arange(1, gap - 1)
        third = third[(left[third] > 0) & (pair_sums[gap - third] > 0)][::-1]
        for a in third:
            for b in pairs_with_sum(gap - a):
                yield (int(a), int(gap - a - b), int(b))

    def consume(parts: tuple[int, ...]) -> bool:
        need = {p: parts.count(p) for p in parts}
        times = min(int(left[p]) // k for p, k in need.items())
        if not times:
            return False
        offset = 0
        for p in parts:
            plan.put(used, p, times, plan.sequences, offset)
            offset += p
        plan.sequences += times
        for p, k in need.items():
            left[p] -= k * times
            if not left[p]:
                gone(p)
        return True

    residual: list[tuple[int, int]] = []
    for length in range(capacity, 0, -1):
        if length == capacity and left[length]:
            consume((length,))
        while left[length]:
            if not any(consume((length, *parts)) for parts in complements(capacity - length)):
                residual.append((length, int(left[length])))
                left[length] = 0
                gone(length)
    open_gaps: dict[int, list[tuple[int, int]]] = defaultdict(list)  # gap: runs of (first sequence, count)
    for length, count in residual:
        while count:
            gap = min((g for g, runs in open_gaps.items() if g >= length and runs), default=None)
            if gap is None:
                each = min(capacity // length, count)
                full, rest = divmod(count, each)
                for n, per in ((full, each), (1 if rest else 0, rest)):
                    if n:
                        for k in range(per):
                            plan.put(used, length, n, plan.sequences, k * length)
                        open_gaps[capacity - per * length].append((plan.sequences, n))
                        plan.sequences += n
                count = 0
            else:
                sequence, n = open_gaps[gap].pop()
                took = min(n, count)
                plan.put(used, length, took, sequence, capacity - gap)
                if took < n:
                    open_gaps[gap].append((sequence + took, n - took))
                open_gaps[gap - length].append((sequence, took))
                count -= took
    return plan


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` of :func:`tokenize_pieces`, read from a written table, with ``sequence_id`` and ``offset``."""
    sizes = pieces.groupBy("shard", "length").agg(F.count("*").alias("n"))
    # At most `capacity` rows, whatever the corpus holds.
    counts = {r["length"]: r["n"] for r in sizes.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    plan = plan_packing(counts, capacity)
    order = np.lexsort((plan.first, plan.length))
    key = (np.array(plan.length, np.int64)[order] << 44) + np.array(plan.first, np.int64)[order]
    first, sequence, offset = (np.array(x, np.int64)[order] for x in (plan.first, plan.sequence, plan.offset))
    earlier = Window.partitionBy("length").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.select("shard", "length", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    ranked = pieces.join(before, ["shard", "length"])

    def make():
        def step(columns):
            *given, shard_rank, shards_before = columns
            rank = np.array(shard_rank, np.int64) + np.array(shards_before, np.int64)
            at = np.searchsorted(key, (np.array(given[3], np.int64) << 44) + rank, "right") - 1
            return zip(*given, (sequence[at] + rank - first[at]).tolist(), offset[at].tolist())

        return step

    given = [c for c in pieces.columns if c not in ("shard", "shard_rank")]
    kinds = {f.name: f.dataType.simpleString() for f in pieces.schema}
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in given) + ", sequence_id long, offset long"
    return map_rows(ranked.select(*given, "shard_rank", "before"), make, schema)


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID,
                   keep_ids: bool = False) -> DataFrame:
    """Every document tokenized, cut only where longer than ``capacity``, and packed; one row per piece."""
    return pack(cut(tokenize_pieces(docs, tokenizer_path, capacity, end_id, keep_ids), "pieces"), capacity)
