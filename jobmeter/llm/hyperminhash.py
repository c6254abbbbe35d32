"""Near copies found by HyperMinHash sketches, and confirmed on whole sets.

1. Each text becomes a set of word n-gram hashes; texts with equal sets are one class from then on. A class is sketched in ``BUCKETS`` registers: the
   first bits of a hash name its bucket, and of the smallest hash of a bucket the register keeps the number of leading zeros and the
   ``MANTISSA`` bits behind the first one, 16 bits in all.
2. Bands of ``BAND`` registers are hashed to keys. Classes that share a key meet in a group, where the similarity of two sketches is
   estimated, corrected for registers that agree by chance. Pairs within ``MARGIN`` standard deviations of the threshold connect candidates.
3. The sets of connected candidates are made once more and compared exactly wherever that might connect two parts.

Two sets of a similarity of 0.85 miss each other in all bands with a chance of 2 in 10 million, and less if they are small: of sets of up to
about a hundred n-grams fewer registers can differ than there are bands. The estimate rejects them with less than one in 100
million. No step emits pairs beyond one link per row of a group; crowded groups are dealt into blocks, of bounded rows and bytes, of
which any two meet.

Defined cases: null and empty texts have an empty set and are linked with nothing; a text with fewer words than an n-gram has one n-gram; rows
with equal text, even with the same id, are linked; the smallest id names a component, null ids count only where there are no others;
empty tables give no rows; other columns are ignored. N-grams and classes are told by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobmeter.llm.common import components, cut, in_blocks, in_slots, map_batches, map_groups, map_rows, slot_table, text_bytes
from jobmeter.llm.jaccard import Shingler

#: Registers of a sketch (a power of two), bits of a register behind the leading one, and registers of a band.
BUCKETS = 128
MANTISSA = 11
BAND = 5
_ZEROS = (1 << (16 - MANTISSA)) - 2  # leading zeros are told up to here; a register of 0 is an empty bucket
_REST = 64 - BUCKETS.bit_length() + 1  # bits of a hash behind its bucket
#: Standard deviations that an estimate may lie below the threshold.
MARGIN = 6
#: Sketches and sets that meet in one task, and bytes of the sets.
GROUP_ROWS = 4_000
GROUP_SETS = 4_000
GROUP_BYTES = 24 << 20
#: Bits of the table that tells which rows to read again: 8 MB.
TABLE_BITS = 26
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def registers(hashes: np.ndarray) -> np.ndarray:
    """The sketch of a set of 64-bit hashes, given in ascending order."""
    out = np.zeros(BUCKETS, np.uint16)
    first = np.searchsorted(hashes, np.arange(BUCKETS, dtype=np.uint64) << np.uint64(_REST))
    used = np.flatnonzero(np.append(first[1:], len(hashes)) > first)
    least = hashes[first[used]] & np.uint64((1 << _REST) - 1)
    digits = np.frexp(least.astype(np.float64))[1].astype(np.int64)  # place of the first one
    zeros = np.minimum(_REST - digits, _ZEROS)
    behind = np.maximum(_REST - zeros - 1, 0).astype(np.uint64)
    low = least & ((np.uint64(1) << behind) - np.uint64(1))
    shift = behind.astype(np.int64) - MANTISSA
    mantissa = np.where(shift >= 0, low >> np.maximum(shift, 0).astype(np.uint64), low << np.maximum(-shift, 0).astype(np.uint64))
    out[used] = ((zeros + 1) << MANTISSA) | mantissa.astype(np.int64)
    return out


def collision_rate(n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """The chance that the registers of one bucket agree for two sets of ``n`` and ``m`` members that share none.

    Minima of sets are spread with density ``n * (1 - x) ** (n - 1)``; a cell behind ``z`` leading zeros is ``2 ** -(z + 1 + MANTISSA)`` wide.
    """
    n, m = np.maximum(n / BUCKETS, 1.0), np.maximum(m / BUCKETS, 1.0)
    both, rate = n + m - 1, 0.0
    for z in range(_ZEROS + 1):
        upper = 2.0 ** -z if z else 1 - 2.0 ** -53
        rate = rate + 2.0 ** -(z + 1 + MANTISSA) * (np.exp(both * np.log1p(-2.0 ** -(z + 1))) - np.exp(both * np.log1p(-upper)))
    return n * m / both * rate


_STEP = np.arange(4 * 40)
#: Collision rates by size, in quarters of a power of two.
_RATES = collision_rate(2.0 ** (_STEP[:, None] / 4), 2.0 ** (_STEP / 4))


def step_of(sizes: np.ndarray) -> np.ndarray:
    return np.minimum(4 * np.log2(sizes), len(_STEP) - 1).astype(np.int64)


def estimate(one: np.ndarray, step: int, others: np.ndarray, steps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Similarity of a sketch with each row of ``others``, corrected for collisions, and the number of buckets used."""
    used = np.count_nonzero(others | one, axis=1)
    agree = np.count_nonzero((others == one) & (one != 0), axis=1)
    rate = _RATES[step, steps]
    return (agree / used - rate) / (1 - rate), used


def likely(one, step, others, steps, percent: int) -> np.ndarray:
    """Which of ``others`` may reach the threshold."""
    similarity, used = estimate(one, step, others, steps)
    t = percent / 100
    return similarity >= t - MARGIN * np.sqrt(t * (1 - t) / used)


def parts(sizes: np.ndarray, percent: int, near: Callable[[int, np.ndarray], np.ndarray]) -> np.ndarray:
    """A number of the part for each member; ``near(x, others)`` tells which of ``others`` are linked with ``x``.

    Each member is compared with those of like size that no part has reached yet.
    """
    part, left = np.zeros(len(sizes), np.int64), np.arange(len(sizes))
    for number in range(len(sizes)):
        if not len(left):
            break
        reached, left = [int(left[0])], left[1:]
        part[reached[0]] = number
        while reached and len(left):
            x = reached.pop()
            fits = (100 * sizes[left] >= percent * sizes[x]) & (100 * sizes[x] >= percent * sizes[left])
            if fits.any():
                fits[fits] = near(x, left[fits])
                found = left[fits]
                part[found] = number
                reached += found.tolist()
                left = left[~fits]
    return part


def _star(members: list[int], part: np.ndarray) -> Iterator[tuple[int, int]]:
    """Links of each member to the smallest member of its part."""
    least: dict[int, int] = {}
    for member, k in zip(members, part.tolist()):
        least[k] = min(member, least.get(k, member))
    return ((member, least[k]) for member, k in zip(members, part.tolist()) if member != least[k])


def _set_of(shingler: Shingler, text: bytes) -> np.ndarray:
    return np.unique(shingler.shingles(shingler.word_hashes(text)))


def sketches(docs: DataFrame, words: int) -> DataFrame:
    """``doc_id, n_shingles, class, registers`` per document; class and registers are null for empty sets."""
    def make():
        shingler = Shingler(words)

        def step(columns):
            for doc_id, text in zip(*columns):
                hashes = _set_of(shingler, text)
                if len(hashes):
                    yield doc_id, len(hashes), xxhash.xxh3_64_intdigest(hashes.tobytes()) - (1 << 63), registers(hashes).tobytes()
                else:
                    yield doc_id, 0, None, None

        return step

    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes())
    return map_rows(given, make, "doc_id long, n_shingles long, class long, registers binary")


def band_keys(classes: DataFrame) -> DataFrame:
    """``key, class`` for each band of a class that has a register in use."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column(0).to_numpy()
            table = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint16).reshape(len(own), BUCKETS)
            table = np.pad(table, ((0, 0), (0, -BUCKETS % BAND))).reshape(len(own), -1, BAND).astype(np.uint64)
            used = table.any(axis=2)
            hashes = np.broadcast_to(np.arange(1, table.shape[1] + 1, dtype=np.uint64) * _MULTIPLIER, used.shape).copy()
            for k in range(BAND):
                hashes = (hashes ^ table[:, :, k]) * _MULTIPLIER
                hashes ^= hashes >> np.uint64(29)
            owners = np.broadcast_to(own[:, None], used.shape)
            yield pa.RecordBatch.from_arrays([pa.array(hashes[used].view(np.int64)), pa.array(owners[used])], ["key", "class"])

    return map_batches(classes.select("class", "registers"), run, "key long, class long")


def _candidates(percent: int):
    """Links between classes of a group that may be similar."""
    def handle(_, columns):
        _, members, sizes, sketched = columns
        if len(members) == 1:
            return ()
        table = np.frombuffer(b"".join(sketched), np.uint16).reshape(len(members), BUCKETS)
        sizes = np.array(sizes, np.int64)
        steps = step_of(sizes)
        return _star(members, parts(sizes, percent, lambda x, others: likely(table[x], steps[x], table[others], steps[others], percent)))

    return handle


def _confirmed(percent: int):
    """Links between classes whose sets are similar."""
    def handle(_, columns):
        _, members, _, given = columns
        if len(members) == 1:
            return ()
        sets = [np.frombuffer(s, np.uint64) for s in given]
        table = np.stack([registers(s) for s in sets])
        sizes = np.array([len(s) for s in sets], np.int64)
        steps = step_of(sizes)

        def near(x: int, others: np.ndarray) -> np.ndarray:
            fits = likely(table[x], steps[x], table[others], steps[others], percent)
            for k in np.flatnonzero(fits):
                other = sets[others[k]]
                at = np.searchsorted(sets[x], other)
                at[at == len(sets[x])] = 0
                both = np.count_nonzero(sets[x][at] == other)
                fits[k] = 100 * both >= percent * (len(sets[x]) + len(other) - both)
            return fits

        return _star(members, parts(sizes, percent, near))

    return handle


def _wanted_sets(docs: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """``group, class, bytes, members`` of the classes ``wanted`` (``class, label, rep``), made again from the documents."""
    slot = F.xxhash64("rep").bitwiseAND((1 << TABLE_BITS) - 1)
    table = slot_table(wanted.select(slot.alias("slot")), TABLE_BITS)
    given = docs.select(F.xxhash64(F.col("doc_id").cast("long")).alias("slot"), text_bytes())

    def make():
        shingler = Shingler(words)

        def step(columns):
            for k in np.flatnonzero(in_slots(np.array(columns[0], np.int64), table)):
                hashes = _set_of(shingler, columns[1][k])
                if len(hashes):
                    yield xxhash.xxh3_64_intdigest(hashes.tobytes()) - (1 << 63), hashes.tobytes()

        return step

    found = map_rows(given, make, "class long, members binary")
    # Rows without id, or with one id, may have the class more than once.
    joined = found.join(wanted.select("class", "label"), "class").groupBy("class").agg(F.first("label").alias("group"), F.first("members").alias("members"))
    return joined.select("group", "class", F.length("members").cast("long").alias("bytes"), "members")


def find_links(docs: DataFrame, words: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """Per document ``doc_id, n_shingles, class``, and per class ``class, label`` for classes linked with others."""
    all_sets = cut(sketches(docs, words), "sketches")
    classes = all_sets.where("n_shingles > 0").groupBy("class").agg(F.min("doc_id").alias("rep"), F.first(F.struct("n_shingles", "registers")).alias("p"))
    classes = cut(classes.select("class", "rep", "p.*"), "classes")
    keys = cut(band_keys(classes), "keys")
    shared = keys.groupBy("key").agg(F.min("class").alias("a"), F.max("class").alias("b")).where("a != b").select("key")
    groups = keys.join(shared, "key").join(classes.select("class", "n_shingles", "registers"), "class")
    dealt = in_blocks(cut(groups.select("key", "class", "n_shingles", "registers"), "groups"), "key", "class", GROUP_ROWS)
    candidates = components(map_groups(dealt, "key", _candidates(percent), "a long, b long"))
    wanted = candidates.join(classes.select("class", "rep"), F.col("node") == F.col("class")).select("class", "label", "rep")
    sets = cut(_wanted_sets(docs, cut(wanted, "wanted"), words), "sets")
    dealt = in_blocks(sets, "group", "class", GROUP_SETS, "bytes", GROUP_BYTES)
    linked = components(map_groups(dealt, "group", _confirmed(percent), "a long, b long"))
    return all_sets.select("doc_id", "n_shingles", "class"), linked.select(F.col("node").alias("class"), "label")


def near_copies(docs: DataFrame, words: int = 5, percent: int = 85) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for every document.

    Documents are linked where ``100 * intersection >= percent * union`` of their sets of ``words``-grams; the component is named by the
    smallest id that links lead to, and the document of that id is kept. Where no row of a component has an id, all are kept.
    """
    sets, linked = find_links(docs, words, percent)
    named = sets.where("n_shingles > 0").groupBy("class").agg(F.min("doc_id").alias("rep"))
    named = named.join(linked, "class", "left").select("class", "rep", F.coalesce("label", "class").alias("label"))
    least = named.groupBy("label").agg(F.min("rep").alias("component_id"))
    named = named.join(least, "label").select(F.col("class").alias("_class"), "component_id")
    found = sets.join(named, F.col("class") == F.col("_class"), "left")
    component = F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("component_id"))
    return found.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
