"""Documents linked by the Jaccard similarity of their word n-grams, found with signature trees.

1. Words are counted in a table of fixed size, so that n-grams can be ordered from rare to common.
2. Each text becomes a set of n-gram hashes. Texts with equal sets are one class from then on.
3. Two sets that are similar enough share one of their rarest n-grams (prefix filter), so classes meet in groups by such an
   n-gram and a band of sizes. N-grams that only one class has are left out first by a table of bits.
4. In each group a signature tree holds bitmaps of the sets, OR-combined upwards, with ranges of set sizes. Traversing the tree
   against itself drops pairs of nodes whose largest possible overlap is too small. What remains connects candidates.
5. The texts of connected candidates are read again and meet in one more tree, where each pair that might connect two
   parts is compared exactly. Connected parts are the result.

Groups beyond a fixed number of rows are dealt into blocks of which any two meet. No step emits pairs beyond one link
per row of a group, and copies are handled as one.

Defined cases: null and empty texts have an empty set and are linked with nothing; a text with fewer words than an n-gram has one
n-gram; rows with equal text, even with the same id, are linked; the smallest id names a component, ids that are null count
only where there are no others; empty tables give no rows; other columns are ignored. N-grams and classes are told by 64-bit
hashes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobmeter.llm.common import Cache, components, cut, in_blocks, in_slots, map_batches, map_groups, map_rows, shared_slots, slot_table, text_bytes

#: Words are counted in so many slots (a power of two).
COUNT_BITS = 21
#: Bits of the tables that leave out what only one document has: 8 MB.
TABLE_BITS = 26
#: Rows of a group, and texts of a connected set, that one task compares with each other.
GROUP_ROWS = 8_000
GROUP_TEXTS = 4_000
_WIDEST = 4096
_EMPTY = 0

_SKETCH = ("doc_id long, n_shingles long, class long, band int, next_band int, bitmap binary, next_bitmap binary, keys binary, text_hash long")
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


class Shingler:
    """Sets of word n-gram hashes of UTF-8 texts; A-Z is folded, words end at blanks and U+0009 to U+000D."""

    def __init__(self, words: int):
        self.n = words
        self.hashes = Cache(xxhash.xxh3_64_intdigest)

    def word_hashes(self, text: bytes) -> np.ndarray:
        found = text.lower().split()
        out = np.fromiter(map(self.hashes.__getitem__, found), np.uint64, len(found))
        self.hashes.trim()
        return out

    def shingles(self, words: np.ndarray) -> np.ndarray:
        """A hash for each place where an n-gram begins."""
        width = min(self.n, len(words))
        if not width:
            return words
        out = np.full(len(words) - width + 1, width, np.uint64)
        for k in range(width):
            out = (out * _MULTIPLIER) ^ words[k:len(words) - width + 1 + k]
            out ^= out >> np.uint64(32)
        return (out * _MULTIPLIER) ^ (out >> np.uint64(29))


def prefix_length(n: int, percent: int) -> int:
    """So many of the rarest n-grams of a set of ``n`` that similar sets share one of them."""
    return n - (n * percent + 99) // 100 + 1


def bitmap(shingles: np.ndarray, width: int) -> bytes:
    bits = np.zeros(width, np.uint8)
    bits[(shingles >> np.uint64(7)) & np.uint64(width - 1)] = 1
    return np.packbits(bits).tobytes()


def band_of(n: int) -> int:
    """The smallest power of two that is not below ``n``, as exponent."""
    return max(0, n - 1).bit_length()


def band_width(band: int) -> int:
    return min(_WIDEST, max(64, 1 << band))


def word_counts(docs: DataFrame, bits: int = COUNT_BITS) -> np.ndarray:
    """How often words of each slot occur in all documents; a table of fixed size."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, shingler = np.zeros(1 << bits, np.int64), Shingler(1)
        for batch in batches:
            for text in batch.column(0).to_pylist():
                np.add.at(counts, (shingler.word_hashes(text) & np.uint64((1 << bits) - 1)).astype(np.int64), 1)
        used = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(counts[used], pa.int64())], ["slot", "n"])

    found = map_batches(docs.select(text_bytes()), run, "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    table = np.zeros(1 << bits, np.int64)
    table[found.column("slot").to_numpy()] = found.column("n").to_numpy()  # 2 ** bits rows at most
    return np.minimum(table, (1 << 20) - 1).astype(np.int32)


def sketches(docs: DataFrame, words: int, percent: int, counts: np.ndarray) -> DataFrame:
    """Per document: size and class of its set, bitmaps for its bands of sizes, and its rarest n-grams as keys.

    A set that may be similar to sets of the next band is in that one too.
    """
    mask = np.uint64(len(counts) - 1)

    def make():
        shingler = Shingler(words)

        def step(columns):
            for doc_id, text, text_hash in zip(*columns):
                hashes = shingler.word_hashes(text)
                shingles, first = np.unique(shingler.shingles(hashes), return_index=True)
                n = len(shingles)
                if not n:
                    yield doc_id, 0, _EMPTY, None, None, None, None, None, text_hash
                    continue
                rarity = counts[(hashes & mask).astype(np.int64)]
                width = min(words, len(hashes))
                rarity = np.lib.stride_tricks.sliding_window_view(rarity, width).min(1)[first]
                keys = (rarity.astype(np.uint64) << np.uint64(43)) | (shingles >> np.uint64(21))
                p = prefix_length(n, percent)
                keys = np.unique(np.partition(keys, p - 1)[:p]) if p < n else np.unique(keys)
                band = band_of(n)
                above = band + 1 if 100 * n >= percent * ((1 << band) + 1) else None
                yield (doc_id, n, xxhash.xxh3_64_intdigest(shingles.tobytes()) - (1 << 63), band, above, bitmap(shingles, band_width(band)),
                       None if above is None else bitmap(shingles, band_width(above)), keys.tobytes(), text_hash)

        return step

    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes(), F.xxhash64(text_bytes()).alias("text_hash"))
    return map_rows(given, make, _SKETCH)


class SignatureTree:
    """Sets by bitmap and size, in nodes that hold the OR of their bitmaps and the range of their sizes."""

    LEAF, FAN = 32, 8

    def __init__(self, bitmaps: list[bytes], sizes: list[int], percent: int):
        self.percent = percent
        width = len(bitmaps[0])
        bits = np.frombuffer(b"".join(bitmaps), np.uint8).reshape(len(bitmaps), width).view(np.uint64)
        sizes = np.array(sizes, np.int64)
        self.order = np.lexsort((*bits.T[:4], sizes))
        self.bits, self.sizes = bits[self.order], sizes[self.order]
        # So many n-grams of a set may share their bits with others of it.
        self.excess = self.sizes - np.bitwise_count(self.bits).sum(1, dtype=np.int64)
        self.levels = []
        node = (self.bits, self.sizes, self.sizes, self.excess)
        fan = self.LEAF
        while True:
            at = np.arange(0, len(node[1]), fan)
            node = (np.bitwise_or.reduceat(node[0], at), np.minimum.reduceat(node[1], at), np.maximum.reduceat(node[2], at), np.maximum.reduceat(node[3], at))
            self.levels.append(node)
            fan = self.FAN
            if len(at) == 1:
                break

    def _possible(self, level: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether sets below the nodes ``a`` and ``b`` may be similar enough."""
        bits, low, high, excess = self.levels[level]
        shared = np.bitwise_count(bits[a] & bits[b]).sum(1, dtype=np.int64) + np.minimum(excess[a], excess[b])
        overlap = np.minimum(shared, np.minimum(high[a], high[b]))
        sizes = (100 * high[a] >= self.percent * low[b]) & (100 * high[b] >= self.percent * low[a])
        return sizes & (overlap * (100 + self.percent) >= self.percent * (low[a] + low[b]))

    def leaf_pairs(self) -> np.ndarray:
        a = b = np.zeros(1, np.int64)
        for level in range(len(self.levels) - 1, -1, -1):
            if level < len(self.levels) - 1:
                n = len(self.levels[level][1])
                steps = np.arange(self.FAN)
                x = (a[:, None, None] * self.FAN + steps[:, None] + 0 * steps).ravel()
                y = (b[:, None, None] * self.FAN + steps + 0 * steps[:, None]).ravel()
                keep = (x < n) & (y < n) & (x <= y)
                a, b = x[keep], y[keep]
            keep = self._possible(level, a, b)
            a, b = a[keep], b[keep]
        return np.column_stack([a, b])[np.argsort(b - a, kind="stable")]

    def parts(self, similar: Callable[[int, int], bool] | None = None) -> list[int]:
        """For each set the first one that it is connected with by pairs that may be, or are, ``similar``."""
        root = list(range(len(self.sizes)))

        def find(x: int) -> int:
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        for a, b in self.leaf_pairs().tolist():
            i = np.arange(a * self.LEAF, min((a + 1) * self.LEAF, len(root)))
            j = np.arange(b * self.LEAF, min((b + 1) * self.LEAF, len(root)))
            ri, rj = np.array([find(x) for x in i]), np.array([find(x) for x in j])
            apart = ri[:, None] != rj
            if a == b:
                apart &= i[:, None] < j
            if not apart.any():
                continue
            both = np.bitwise_count(self.bits[i][:, None] & self.bits[j]).sum(2, dtype=np.int64)
            overlap = both + np.minimum(self.excess[i][:, None], self.excess[j])
            overlap = np.minimum(overlap, np.minimum(self.sizes[i][:, None], self.sizes[j]))
            fits = apart & (overlap * (100 + self.percent) >= self.percent * (self.sizes[i][:, None] + self.sizes[j]))
            for x, y in zip(*(k.tolist() for k in np.nonzero(fits))):
                x, y = int(i[x]), int(j[y])
                if find(x) != find(y) and (similar is None or similar(int(self.order[x]), int(self.order[y]))):
                    root[find(x)] = find(y)
        out = [0] * len(root)
        for x in range(len(root)):
            out[self.order[x]] = int(self.order[find(x)])
        return out


def _star(members: list[int], parts: list[int]) -> Iterator[tuple[int, int]]:
    """Links of each member to the smallest member of its part."""
    least: dict[int, int] = {}
    for member, part in zip(members, parts):
        least[part] = min(member, least.get(part, member))
    return ((member, least[part]) for member, part in zip(members, parts) if member != least[part])


def _few(bitmaps: list[bytes], sizes: list[int], percent: int) -> list[int]:
    """What :meth:`SignatureTree.parts` finds, for so few sets that they are one leaf that needs no arrays."""
    bits, part = [int.from_bytes(b, "big") for b in bitmaps], list(range(len(sizes)))
    excess = [n - b.bit_count() for n, b in zip(sizes, bits)]
    for i in range(len(sizes)):
        for j in range(i):
            overlap = min((bits[i] & bits[j]).bit_count() + min(excess[i], excess[j]), sizes[i], sizes[j])
            if part[i] != part[j] and overlap * (100 + percent) >= percent * (sizes[i] + sizes[j]):
                part = [part[j] if p == part[i] else p for p in part]
    return part


def _candidates(percent: int):
    """Links between classes of a group that may be similar."""

    def handle(_, columns):
        _, members, sizes, bitmaps = columns
        if len(members) == 1:
            return ()
        if len(members) > 4:
            return _star(members, SignatureTree(bitmaps, sizes, percent).parts())
        return _star(members, _few(bitmaps, sizes, percent))

    return handle


def _confirmed(words: int, percent: int):
    """Links between classes whose texts are similar."""
    shingler = Shingler(words)

    def handle(_, columns):
        _, members, texts = columns
        sets = dict(zip(members, texts))
        members = sorted(sets)
        sets = [np.unique(shingler.shingles(shingler.word_hashes(sets[m]))) for m in members]
        sizes = [len(s) for s in sets]
        width = min(2 * _WIDEST, 4 * band_width(band_of(max(sizes))))

        def similar(a: int, b: int) -> bool:
            both = len(np.intersect1d(sets[a], sets[b], assume_unique=True))
            return 100 * both >= percent * (sizes[a] + sizes[b] - both)

        return _star(members, SignatureTree([bitmap(s, width) for s in sets], sizes, percent).parts(similar))

    return handle


def _group_rows(classes: DataFrame, shared: np.ndarray) -> DataFrame:
    """``group, class, n, bitmap``: classes by shared key and band."""

    def make():
        def step(columns):
            for own, n, band, above, narrow, wide, keys in zip(*columns):
                keys = np.frombuffer(keys, np.uint64)
                keys = keys[in_slots(keys, shared)]
                for number, bits in ((band, narrow), (above, wide)):
                    if number is not None:
                        for group in ((keys * _MULTIPLIER) ^ np.uint64(number)).view(np.int64).tolist():
                            yield group, own, n, bits

        return step

    given = classes.select("class", "n_shingles", "band", "next_band", "bitmap", "next_bitmap", "keys")
    return map_rows(given, make, "group long, class long, n long, bitmap binary")


def _keys(classes: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [np.frombuffer(k, np.int64) for k in batch.column(1).to_pylist()]
            own = np.repeat(batch.column(0).to_numpy(), [len(k) for k in keys])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys) if keys else [], pa.int64()), pa.array(own, pa.int64())], ["key", "class"])

    return map_batches(classes.select("class", "keys"), run, "key long, class long")


def _texts(docs: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """``group, class, text`` of the classes ``wanted`` (``node, label, rep``), read again from the documents."""
    slot = F.xxhash64("rep").bitwiseAND((1 << TABLE_BITS) - 1)
    table = slot_table(wanted.select(slot.alias("slot")), TABLE_BITS)
    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes())
    given = given.select("doc_id", "text", F.xxhash64("doc_id").alias("slot"))

    def make():
        shingler = Shingler(words)

        def step(columns):
            wanted = in_slots(np.array(columns[2], np.int64), table)
            for doc_id, text in ((columns[0][k], columns[1][k]) for k in np.flatnonzero(wanted)):
                shingles = np.unique(shingler.shingles(shingler.word_hashes(text)))
                if len(shingles):
                    yield doc_id, xxhash.xxh3_64_intdigest(shingles.tobytes()) - (1 << 63), text

        return step

    found = map_rows(given, make, "doc_id long, class long, text binary")
    joined = found.join(wanted, (F.col("class") == F.col("node")) & F.col("doc_id").eqNullSafe(F.col("rep")))
    # Rows without id, or with one id, may have the class more than once.
    return joined.select(F.col("label").alias("group"), "class", "text").dropDuplicates(["class"])


def find_links(docs: DataFrame, words: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """Per document ``doc_id, n_shingles, class, text_hash``, and per class ``class, label``, for classes linked with others."""
    all_sets = cut(sketches(docs, words, percent, word_counts(docs)), "sketches")
    payload = ("n_shingles", "band", "next_band", "bitmap", "next_bitmap", "keys")
    classes = all_sets.where("n_shingles > 0").groupBy("class").agg(F.min("doc_id").alias("rep"), F.first(F.struct(*payload)).alias("p"))
    classes = cut(classes.select("class", "rep", "p.*"), "classes")
    shared = shared_slots(_keys(classes), "key", "class", TABLE_BITS)
    groups = cut(_group_rows(classes, shared), "groups")
    dealt = in_blocks(groups, "group", "class", GROUP_ROWS)
    candidates = components(map_groups(dealt, "group", _candidates(percent), "a long, b long"))
    wanted = candidates.join(classes.select("class", "rep"), F.col("node") == F.col("class")).select("node", "label", "rep")
    texts = cut(_texts(docs, wanted, words), "texts")
    dealt = in_blocks(texts, "group", "class", GROUP_TEXTS)
    linked = components(map_groups(dealt, "group", _confirmed(words, percent), "a long, b long"))
    return all_sets.select("doc_id", "n_shingles", "class", "text_hash"), linked.select(F.col("node").alias("class"), "label")


def similarity_components(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """``doc_id, n_shingles, component_id`` for every document.

    Documents are linked where ``100 * intersection >= percent * union`` of their sets of ``words``-grams; the component is
    named by the smallest id that links lead to.
    """
    sets, linked = find_links(docs, words, percent)
    named = sets.where("n_shingles > 0").groupBy("class").agg(F.min("doc_id").alias("rep"))
    named = named.join(linked, "class", "left").select("class", "rep", F.coalesce("label", "class").alias("label"))
    least = named.groupBy("label").agg(F.min("rep").alias("component_id"))
    named = named.join(least, "label").select(F.col("class").alias("_class"), "component_id")
    found = sets.join(named, (F.col("class") == F.col("_class")) & (F.col("n_shingles") > 0), "left")
    return found.select("doc_id", "n_shingles", F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def keep_one_of_each(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one row of each component; all columns as given.

    The row with the smallest id stays, of those with one id the one with the smallest text hash, and rows without id come last. Rows that
    repeat id and text are one; rows without words are in no component.
    """
    sets, linked = find_links(docs, words, percent)
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash")
    named = sets.where("n_shingles > 0").groupBy("class").agg(F.min(order).alias("least"))
    named = named.join(linked, "class", "left").select("class", "least", F.coalesce("label", "class").alias("label"))
    named = named.join(named.groupBy("label").agg(F.min("least").alias("kept")), "label").select(F.col("class").alias("_class"), "kept")
    found = sets.where("n_shingles > 0").join(named, F.col("class") == F.col("_class"))
    # An id may have several texts, and texts may lack one, so rows are told by both.
    dropped = found.where(~(F.col("doc_id").eqNullSafe(F.col("kept.doc_id")) & (F.col("text_hash") == F.col("kept.text_hash"))))
    dropped = cut(dropped.select(F.col("doc_id").alias("_llm_id"), F.col("text_hash").alias("_llm_hash")).distinct(), "dropped")
    same = F.col("doc_id").cast("long").eqNullSafe(F.col("_llm_id")) & (F.xxhash64(text_bytes()) == F.col("_llm_hash"))
    stays = docs.join(dropped.hint("shuffle_hash"), same, "left_anti")
    repeated = sets.groupBy("doc_id", "text_hash").count().where("count > 1").limit(1).count()
    return stays.dropDuplicates(["doc_id", "text"]) if repeated else stays
