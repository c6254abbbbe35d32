"""Lines that recur across documents, found by a fixed-depth tree of log templates.

A line of at least ``MIN_TOKENS`` tokens goes down the tree by its number of tokens and its leading tokens, where tokens with
digits count as variable; the node it reaches holds the templates of such lines. A line joins the first template of its node with which
it shares at least ``SIMILAR`` percent of the tokens, place by place; places that differ become variable. A template
that occurs in two or more documents is dropped from all of them but the one with the smallest id.

With ``short_lines``, as the query and the pipeline have it, shorter lines are held against each other too, blank ones apart: they
must be equal but for variable tokens, or equal if they have no others. Characters of scripts without blanks are tokens then.
Without it shorter lines stay.

Lines of a node that only one document reaches cannot recur. They are left out early by a bit table of fixed size, which may let
through more than it must but never less. Nodes with many different lines are split where no lines are similar, and what is still large
is taken in turns, with the same results as in one task. Only hashes and
lines of shared nodes are shuffled; equal lines are counted, not gathered.

Defined cases: a null text stays null and an empty one empty; rows with the same id are one document and keep each other's lines;
rows without id together are one document, before all others; of equal templates the smallest id keeps its line; an empty table gives no rows; other columns pass through. A document that loses its last word goes.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from jobmeter.llm.common import components, cut, map_groups, map_rows, only_slots, shared_slots
from jobmeter.session import staged

MIN_TOKENS = 8
DEPTH = 3
SIMILAR = 80
#: Different lines that a task takes of a node at most; results don't depend on it.
NODE_LINES = 20_000
#: Bits of the table of shared nodes: 8 MB at most.
TABLE_BITS = 26

_SPACE = " \t\r"
_LOWEST = -(2**63)
_CLUSTERS = "node long, line_hash long, template_id long, first_doc long, last_doc long, template string"
#: Characters of scripts that set no blanks between words.
_UNSPACED = "[\\p{IsHan}\\p{IsHiragana}\\p{IsKatakana}\\p{IsThai}\\p{IsLao}\\p{IsKhmer}\\p{IsMyanmar}]"


def _tight(bare: Column) -> Column:
    odd = bare.contains("  ") | bare.contains("\t") | bare.contains("\r")
    return F.when(odd, F.regexp_replace(bare, "[ \\t\\r]+", " ")).otherwise(bare)


def squeezed(line: Column) -> Column:
    """A line without outer blanks, its tokens one blank apart."""
    return _tight(F.btrim(line, F.lit(_SPACE)))


def _parted(bare: Column) -> Column:
    """A squeezed line in which the characters of unspaced scripts are tokens."""
    odd = (F.octet_length(bare) != F.length(bare)) & bare.rlike(_UNSPACED)
    return F.when(odd, squeezed(F.regexp_replace(bare, _UNSPACED, " $0 "))).otherwise(bare)


def _variable(bare: Column) -> Column:
    return F.when(bare.rlike("[0-9]"), F.regexp_replace(bare, "[^ ]*[0-9][^ ]*", "<*>")).otherwise(bare)


def _told(bare: Column, line: Column, min_tokens: int) -> Column:
    """A masked line, or the squeezed one where it is short and has variable tokens only."""
    alike = line.startswith("<*>") & (_n_tokens(line) < min_tokens) & line.rlike("^<\\*>( <\\*>)*$")
    return F.when(alike, bare).otherwise(line)


def masked(line: Column) -> Column:
    """A squeezed line, its tokens with digits as ``<*>``."""
    return _variable(squeezed(line))


def _n_tokens(line: Column) -> Column:
    """Tokens of a squeezed line, without splitting it."""
    return F.octet_length(line) - F.octet_length(F.replace(line, F.lit(" "), F.lit(""))) + 1


def _lines(docs: DataFrame, min_tokens: int, depth: int, short_lines: bool) -> DataFrame:
    """``doc, line, node, raw`` of the lines that go into the tree, ``raw`` the hash of the line as it stands; a short line has a node of its own."""
    rows = docs.select(F.coalesce(F.col("doc_id"), F.lit(_LOWEST)).alias("doc"), F.explode(F.split("text", "\n")).alias("line"))
    rows = rows.select("doc", "line", F.xxhash64("line").alias("raw"))
    leading = F.xxhash64(_n_tokens(F.col("line")), F.substring_index("line", " ", depth))
    if not short_lines:
        rows = rows.where(_n_tokens(squeezed(F.col("line"))) >= min_tokens).select("doc", masked(F.col("line")).alias("line"), "raw")
        return rows.select("doc", "line", leading.alias("node"), "raw")
    rows = rows.select("doc", "raw", squeezed(F.col("line")).alias("bare")).where("bare != ''").select("doc", "raw", _parted(F.col("bare")).alias("bare"))
    rows = rows.select("doc", "raw", "bare", _variable(F.col("bare")).alias("line")).select("doc", "raw", _told(F.col("bare"), F.col("line"), min_tokens).alias("line"))
    short = _n_tokens(F.col("line")) < min_tokens
    return rows.select("doc", "line", F.when(short, F.xxhash64("line")).otherwise(leading).alias("node"), "raw")


def stretches(tokens: list[str], similar: int) -> list[tuple]:
    """Of one stretch more than tokens may differ, at least one is the same in similar lines."""
    may_differ = len(tokens) * (100 - similar) // 100
    edges = [k * len(tokens) // (may_differ + 1) for k in range(may_differ + 2)]
    return [(k, *tokens[a:b]) for k, (a, b) in enumerate(zip(edges, edges[1:]))]


class Node:
    """The templates of one tree node, told by the first line of each."""

    def __init__(self, similar: int):
        self.similar = similar
        self.tokens: list[list[str]] = []
        self.variable: list[set[int]] = []
        self.index: dict[tuple, list[int]] = defaultdict(list)
        self.members: list[list[tuple[int, int, int]]] = []

    def add(self, line_hash: int, line: str, first_doc: int, last_doc: int) -> None:
        tokens = line.split(" ")
        keys = stretches(tokens, self.similar)
        found = self.first(tokens, keys)
        if found is not None:
            t, other = found
            self.variable[t].update(other)
            self.members[t].append((line_hash, first_doc, last_doc))
            return
        for k in keys:
            self.index[k].append(len(self.tokens))
        self.tokens.append(tokens)
        self.variable.append(set())
        self.members.append([(line_hash, first_doc, last_doc)])

    def first(self, tokens: list[str], keys: list[tuple]) -> tuple[int, list[int]] | None:
        """The first template that a line is similar to, and the places that differ."""
        may_differ = len(tokens) * (100 - self.similar) // 100
        for t in sorted({t for k in keys for t in self.index.get(k, ())}):
            other = [n for n, (x, y) in enumerate(zip(tokens, self.tokens[t])) if x != y]
            if len(other) <= may_differ:
                return t, other
        return None

    def rows(self, node: int) -> Iterator[tuple]:
        for tokens, variable, members in zip(self.tokens, self.variable, self.members):
            template = " ".join("<*>" if n in variable else x for n, x in enumerate(tokens))
            first, last = min(m[1] for m in members), max(m[2] for m in members)
            for line, _, _ in members:
                yield node, line, members[0][0], first, last, template


def _grow(similar: int):
    """Templates of the lines of a node, which are taken in the order of their documents."""

    def handle(node, columns):
        tree = Node(similar)
        for first_doc, line_hash, line, last_doc in sorted(zip(*columns[1:])):
            tree.add(line_hash, line, first_doc, last_doc)
        return tree.rows(node)

    return handle


def _stretch_keys(similar: int):
    def make():
        def step(columns):
            for node, line_hash, line in zip(*columns):
                tokens = line.split(" ")
                for key in stretches(tokens, similar):
                    told = f"{node} {len(tokens)} {' '.join(map(str, key))}".encode()
                    yield node, line_hash, xxhash.xxh3_64_intdigest(told) - (1 << 63)

        return step

    return make


def _crowded(lines: DataFrame, most: int) -> DataFrame:
    """``_node, _n`` of the nodes with more than ``most`` lines."""
    counts = lines.groupBy("node").agg(F.count("*").alias("_n")).where(F.col("_n") > most)
    return cut(counts.select(F.col("node").alias("_node"), "_n"), "crowded")


def _parts(lines: DataFrame, crowded: DataFrame, similar: int) -> DataFrame:
    """``lines``, crowded nodes split into lines that stretches connect; others have no similar line in common."""
    here = lines.join(crowded, F.col("node") == F.col("_node"), "left_semi")
    line = F.xxhash64("node", "line_hash").alias("id")
    keys = map_rows(here.select("node", "line_hash", "line"), _stretch_keys(similar), "node long, line_hash long, key long")
    keys = cut(keys.select(line, "key"), "stretches")
    least = keys.groupBy("key").agg(F.min("id").alias("least"), F.count("*").alias("n")).where("n > 1").select("key", "least")
    found = components(keys.join(least, "key").select(F.col("id").alias("a"), F.col("least").alias("b")))
    found = found.select(F.col("node").alias("_id"), "label")
    placed = here.withColumn("_at", line).join(found, F.col("_at") == F.col("_id"), "left")
    placed = placed.select(F.xxhash64("node", F.coalesce("label", "_at")).alias("node"), *lines.columns[1:])
    return lines.join(crowded, F.col("node") == F.col("_node"), "left_anti").unionByName(placed)


def _ranked(lines: DataFrame) -> DataFrame:
    """``lines`` with ``rank``, their place in the order of their node from 0 on; no task holds a node."""
    parts = cut(lines.repartitionByRange("node", "first_doc", "line_hash").withColumn("part", F.spark_partition_id()), "ranks")
    ends = parts.groupBy("part", "node").agg(F.count("*").alias("n"))
    before = Window.partitionBy("node").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select("part", "node", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    inside = F.row_number().over(Window.partitionBy("part", "node").orderBy("first_doc", "line_hash"))
    return parts.withColumn("inside", inside).join(ends, ["part", "node"]).select(*lines.columns, (F.col("before") + F.col("inside") - 1).alias("rank"))


def _heads(similar: int):
    """The lines of a node that begin templates."""

    def handle(node, columns):
        tree = Node(similar)
        for first_doc, line_hash, line, last_doc in sorted(zip(*columns[1:])):
            tree.add(line_hash, line, first_doc, last_doc)
        for tokens, members in zip(tree.tokens, tree.members):
            yield node, members[0][1], members[0][0], " ".join(tokens), members[0][2]

    return handle


def _joined(similar: int):
    """The template, if any, of each line of a slice, which has all new templates of its node."""

    def handle(_, columns):
        tree, rows = Node(similar), sorted(zip(*columns[1:]), key=lambda r: (not r[0], r[2], r[3]))
        for is_head, node, first_doc, line_hash, line, last_doc in rows:
            tokens = line.split(" ")
            if is_head:
                for k in stretches(tokens, similar):
                    tree.index[k].append(len(tree.tokens))
                tree.tokens.append(tokens)
                tree.members.append([(line_hash, first_doc, last_doc)])
            else:
                found = tree.first(tokens, stretches(tokens, similar))
                head, places = (None, None) if found is None else (tree.members[found[0]][0][0], found[1])
                yield node, first_doc, line_hash, line, last_doc, head, places

    return handle


def _settled(lines: DataFrame, similar: int, most: int) -> DataFrame:
    """``_CLUSTERS`` of crowded nodes, as one tree each would have it, from tasks of at most about ``2 * most`` lines.

    The first ``most`` lines of a node that have no template yet begin the next templates; all lines left are held against those.
    """
    schema = "node long, first_doc long, line_hash long, line string, last_doc long"
    done = None
    while not lines.isEmpty():
        ranked = cut(_ranked(lines), "ranked")
        heads = cut(map_groups(ranked.where(F.col("rank") < most).drop("rank"), "node", _heads(similar), schema), "heads")
        slices = ranked.groupBy("node").agg(F.ceil(F.count("*") / most).cast("int").alias("slices"))
        own = ranked.join(slices, "node").withColumn("slice", F.pmod(F.xxhash64("line_hash"), F.col("slices")))
        every = heads.join(slices, "node").withColumn("slice", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)))
        pick = lambda df, head: df.select(F.xxhash64("node", F.col("slice").cast("int")).alias("slice"), F.lit(head).alias("is_head"), *lines.columns)
        met = map_groups(pick(own, False).unionByName(pick(every, True)), "slice", _joined(similar), schema + ", template_id long, places array<int>")
        met = cut(met, "met")
        found = met.where("template_id is not null").select("node", "first_doc", "line_hash", "last_doc", "template_id", "places")
        found = found.join(heads.select("node", F.col("line_hash").alias("template_id"), F.col("line").alias("head")), ["node", "template_id"])
        done = found if done is None else done.unionByName(found)
        lines = met.where("template_id is null").select(*lines.columns)
    # Places that differ anywhere are variable; a template has as many as its line has tokens at most.
    places = done.select("node", "template_id", F.explode_outer("places").alias("place")).groupBy("node", "template_id").agg(F.collect_set("place").alias("places"))
    ends = done.groupBy("node", "template_id").agg(F.min("first_doc").alias("first_doc"), F.max("last_doc").alias("last_doc"), F.first("head").alias("head"))
    tokens = F.transform(F.split("head", " "), lambda x, i: F.when(F.array_contains("places", i), F.lit("<*>")).otherwise(x))
    ends = ends.join(places, ["node", "template_id"]).select("node", "template_id", "first_doc", "last_doc", F.array_join(tokens, " ").alias("template"))
    return done.select("node", "line_hash", "template_id").join(ends, ["node", "template_id"]).select("node", "line_hash", "template_id", "first_doc", "last_doc", "template")


def templates(lines: DataFrame, similar: int = SIMILAR, depth: int = DEPTH, node_lines: int = NODE_LINES) -> DataFrame:
    """The template of every different line of ``lines`` (``doc, line, node``), with its first and last document."""
    distinct = lines.groupBy("node", F.xxhash64("line").alias("line_hash")).agg(
        F.min("line").alias("line"), F.min("doc").alias("first_doc"), F.max("doc").alias("last_doc"))
    placed = cut(distinct, "lines").select("node", "first_doc", "line_hash", "line", "last_doc")
    crowded = _crowded(placed, node_lines)
    if crowded.isEmpty():
        return map_groups(placed, "node", _grow(similar), _CLUSTERS)
    placed = cut(_parts(placed, crowded, similar), "parts")
    crowded = _crowded(placed, node_lines)
    small = map_groups(placed.join(crowded, F.col("node") == F.col("_node"), "left_anti"), "node", _grow(similar), _CLUSTERS)
    if crowded.isEmpty():
        return small
    return small.unionByName(_settled(placed.join(crowded, F.col("node") == F.col("_node"), "left_semi"), similar, node_lines))


def recurring_lines(docs: DataFrame, min_tokens: int = MIN_TOKENS, similar: int = SIMILAR, depth: int = DEPTH,
                    bits: int = TABLE_BITS, node_lines: int = NODE_LINES, short_lines: bool = False) -> DataFrame:
    """``doc, drop``: for each document that loses lines, the hashes of those as they stand in the text."""
    # Lines are normalised once; the copy goes when the shared ones are known.
    with staged(_lines(docs.select("doc_id", "text"), min_tokens, depth, short_lines), "lines") as lines:
        shared = cut(only_slots(lines, "node", shared_slots(lines.select("doc", "node"), "node", "doc", bits)), "shared-lines")
    found = templates(shared.drop("raw"), similar, depth, node_lines).where("first_doc != last_doc").select("line_hash", "first_doc")
    places = shared.select("doc", F.xxhash64("line").alias("line_hash"), "raw")
    dropped = places.join(found, "line_hash").where(F.col("doc") != F.col("first_doc"))
    return dropped.groupBy("doc").agg(F.collect_set("raw").alias("drop"))


def drop_recurring(docs: DataFrame, min_tokens: int = MIN_TOKENS, short_lines: bool = False, **options) -> DataFrame:
    """``docs`` with the lines that stay in ``text`` and ``_llm_lines``, ``_llm_dropped``: lines before, lines dropped."""
    drop = recurring_lines(docs, min_tokens, short_lines=short_lines, **options).select(F.col("doc").alias("_llm_doc"), F.col("drop").alias("_llm_drop"))
    joined = docs.join(drop.hint("shuffle_hash"), F.coalesce(F.col("doc_id"), F.lit(_LOWEST)) == F.col("_llm_doc"), "left")
    lines = F.split("text", "\n")
    kept = F.filter(lines, lambda x: ~F.array_contains("_llm_drop", F.xxhash64(x)))
    text = F.when(F.col("_llm_drop").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n"))
    n_lines = F.coalesce(F.size(lines), F.lit(0)).cast("long")
    n_kept = F.when(F.col("_llm_drop").isNull(), n_lines).otherwise(F.size(kept).cast("long"))
    # Filters on these stay above the generator; pushed below, they would do the work once for each use.
    made = F.inline(F.array(F.struct(text.alias("_llm_kept"), n_lines.alias("_llm_lines"), (n_lines - n_kept).alias("_llm_dropped"))))
    made = joined.select(*[F.col(f"`{c}`") for c in docs.columns if c != "text"], made)
    order = [F.col("_llm_kept").alias("text") if c == "text" else F.col(f"`{c}`") for c in docs.columns]
    return made.select(*order, "_llm_lines", "_llm_dropped")


def dedup_lines(docs: DataFrame, **options) -> DataFrame:
    """``docs`` without recurring lines, ``n_chars`` counted anew where the text changed; emptied documents go."""
    found = drop_recurring(docs, **options)
    changed = F.col("_llm_dropped") > 0
    stays = found.where(~changed | F.coalesce(F.col("text").rlike("[^ \\t-\\r]"), F.lit(False)))
    kind = dict(docs.dtypes).get("n_chars")
    out = [F.when(changed, F.length("text").cast(kind)).otherwise(F.col("n_chars")).alias("n_chars") if c == "n_chars" else F.col(f"`{c}`") for c in docs.columns]
    return stays.select(*out)


def line_report(docs: DataFrame, **options) -> DataFrame:
    """``doc_id, text`` after the lines were dropped, with the number of lines before and of those dropped."""
    return drop_recurring(docs.select("doc_id", "text"), **options).select("doc_id", "text", F.col("_llm_lines").alias("n_lines"), F.col("_llm_dropped").alias("n_dropped"))
