"""What the operators of this subpackage share: lineage cuts, Arrow batches in and out, bounded caches."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from jobmeter.session import file_system, scratch_path

#: Entries that a cache of words in a Python worker may hold before it starts anew.
CACHE_ENTRIES = 200_000
#: Bytes of the Arrow batches that Python workers get at most; a longer row is a batch of its own.
BATCH_BYTES = 8 << 20


def cut(df: DataFrame, label: str) -> DataFrame:
    """``df`` written to the shared folder and read back: later steps neither repeat its work nor depend on its lineage.

    The folder goes when the driver's session ends.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.parquet(path)
    fs, folder = file_system(spark, path)
    fs.deleteOnExit(folder)
    return spark.read.schema(df.schema).parquet(path)


def map_batches(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """``mapInArrow`` with batches of at most ``BATCH_BYTES``, so that a worker's memory doesn't follow the rows' size."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return df.mapInArrow(run, schema)


def map_rows(df: DataFrame, make: Callable[[], Callable[[list], Iterable[tuple]]], schema: str) -> DataFrame:
    """Rows of ``df`` turned into rows of ``schema``, one bounded Arrow batch at a time.

    ``make`` is called once in each task and returns a function from a batch's columns (lists) to output rows.
    """
    out = StructType.fromDDL(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow, step = to_arrow_schema(out), make()
        for batch in batches:
            rows = list(step([c.to_pylist() for c in batch.columns]))
            columns = zip(*rows) if rows else [[] for _ in arrow]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, arrow)], schema=arrow)

    return map_batches(df, run, out)


class Cache(dict):
    """Values of a function by key, at most ``CACHE_ENTRIES`` of them; ``limit`` is checked between batches."""

    def __init__(self, function: Callable):
        super().__init__()
        self.function = function

    def __missing__(self, key):
        value = self[key] = self.function(key)
        return value

    def trim(self) -> None:
        if len(self) > CACHE_ENTRIES:
            self.clear()


def text_bytes(name: str = "text"):
    """A text column as UTF-8 bytes, nulls as empty."""
    return F.coalesce(F.col(name).cast("string"), F.lit("")).cast("binary").alias(name)


def shared_slots(rows: DataFrame, key: str, owner: str, bits: int) -> np.ndarray:
    """A table of ``2 ** bits`` bits, as 64-bit words: set in the slots of keys (longs) that two or more owners have.

    Slots are the low bits of the keys. The table is of fixed size, so it may be sent to every task; with very many shared keys it
    tells less, but never misses one.
    """
    seen = rows.groupBy(key).agg(F.min(owner).alias("a"), F.max(owner).alias("b")).where("a != b")
    return slot_table(seen.select(F.col(key).bitwiseAND((1 << bits) - 1).alias("slot")), bits)


def slot_table(slots: DataFrame, bits: int) -> np.ndarray:
    """The table with the bits of column ``slot`` set."""
    one = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("slot").bitwiseAND(63).cast("int"))
    words = slots.groupBy(F.shiftright("slot", 6).cast("int").alias("word")).agg(F.bit_or(one).alias("mask"))
    found = words.toArrow()  # 2 ** (bits - 6) rows at most
    table = np.zeros(1 << (bits - 6), np.uint64)
    table[found.column("word").to_numpy()] = found.column("mask").to_numpy().view(np.uint64)
    return table


def in_slots(keys: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Which of ``keys`` (64-bit) have their slot set."""
    slot = keys.view(np.uint64) & np.uint64(64 * len(table) - 1)
    return ((table[slot >> np.uint64(6)] >> (slot & np.uint64(63))) & np.uint64(1)).astype(bool)


def only_slots(rows: DataFrame, key: str, table: np.ndarray) -> DataFrame:
    """The rows whose key (a long without nulls) has its slot set."""
    at = rows.columns.index(key)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(in_slots(batch.column(at).to_numpy(zero_copy_only=False), table)))

    return map_batches(rows, run, rows.schema)


def map_groups(rows: DataFrame, key: str, handle: Callable[[int, list[list]], Iterable[tuple]], schema: str) -> DataFrame:
    """Output rows of ``handle(key, columns)`` for each value of the long column ``key``; groups must be of bounded size."""
    out = StructType.fromDDL(schema)
    at = rows.columns.index(key)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow, made = to_arrow_schema(out), []
        held: list[list] = []
        current = None

        def flush(rows_made: list) -> pa.RecordBatch:
            by_column = zip(*rows_made) if rows_made else [[] for _ in arrow]
            return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(by_column, arrow)], schema=arrow)

        for batch in batches:
            keys = batch.column(at).to_numpy(zero_copy_only=False)
            columns = [c.to_pylist() for c in batch.columns]
            edges = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)]
            for a, b in zip(edges, edges[1:]):
                if a == b:
                    continue
                if held and current == columns[at][a]:
                    for old, new in zip(held, columns):
                        old.extend(new[a:b])
                    continue
                if held:
                    made.extend(handle(current, held))
                current, held = columns[at][a], [c[a:b] for c in columns]
            if len(made) > 20_000:
                yield flush(made)
                made = []
        if held:
            made.extend(handle(current, held))
        yield flush(made)

    return map_batches(rows.repartition(key).sortWithinPartitions(key), run, out)


def in_blocks(rows: DataFrame, key: str, member: str, most: int, weight: str | None = None, heaviest: int = 1) -> DataFrame:
    """``rows`` so that no key has more than about ``2 * most`` of them, and any two rows of a key still share a key.

    The rows of a crowded key are dealt into blocks of about ``most``, and every two blocks get a key of their own. With a column
    ``weight`` the sum of it in a block is held to about ``heaviest`` too, but for single rows that weigh more.
    """
    blocks = F.ceil(F.count("*") / most)
    if weight:
        blocks = F.greatest(blocks, F.least(F.count("*"), F.ceil(F.sum(weight) / heaviest)))
    crowded = rows.groupBy(F.col(key).alias("_key")).agg(blocks.cast("int").alias("_blocks")).where(F.col("_blocks") > 1)
    # Written, so that its size is known: it is broadcast where it is small, and then ``rows`` need no shuffle for it.
    crowded = cut(crowded, "crowded")
    joined = rows.join(crowded, F.col(key) == F.col("_key"), "left")
    own = F.pmod(F.xxhash64(member), F.col("_blocks"))
    others = F.when(F.col("_blocks").isNull(), F.array(F.lit(None).cast("int"))).otherwise(F.sequence(F.lit(0), F.col("_blocks") - 1))
    dealt = joined.select(*[F.col(c) for c in rows.columns], own.alias("_own"), F.explode(others).alias("_other"))
    pair = F.xxhash64(key, F.least("_own", "_other"), F.greatest("_own", "_other"))
    return dealt.select(*[F.when(F.col("_other").isNull(), F.col(key)).otherwise(pair).alias(key) if c == key else F.col(c) for c in rows.columns])


def components(edges: DataFrame) -> DataFrame:
    """``node, label`` for all nodes of ``edges`` (``a, b``, longs): the label is the smallest node that can be reached.

    Large-star and small-star steps in turn: each node points to the smallest neighbour until all point to the label. The rounds go on until
    nothing changes; they grow with the logarithm of the longest chain.
    """
    edges = cut(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a != b").distinct(), "edges")
    state = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b"))
        edges = cut(small.where("a != b").distinct(), "edges")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.count_distinct("a")).first()
        if tuple(now) == state:
            break
        state = tuple(now)
    # Each node that is no label has one edge, to its label.
    return edges.select(F.col("a").alias("node"), F.col("b").alias("label")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct())
