"""Conversations in reply order, linked through what messages quote.

Lines that begin with ``>`` are quoted, once for each mark. A message is split into passages: stretches of lines of one
quote level. A passage of level n in a reply stood at level n - 1 in the message replied to, so passages are hashed after their
text was normalised (case, white space, marks), and a quoted passage joins the message of the same conversation that has
the hash one level lower, the latest before it. The message that the largest number of characters is quoted from is the
one replied to; without any, it is the message before. Quotes are then taken out, and each message gets its place: the branch of
replies that it belongs to, its depth and its position there.

A conversation may hold a third of all messages: the message before is found within parts of a range partitioning, where one row of each
part carries over to the next, and quotes meet by conversation and hash.

Passages of any length count; one of marks and blanks only is none.

Defined cases: null and empty texts have no passages and empty content; messages without conversation or turn stay without links
and place;
of messages with the same conversation and turn each is a row, and a link names their turn; a quote that fits several earlier
messages belongs to the latest; a message never replies to itself or a later one; empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from jobmeter.llm.common import cut

_MARKS = "^([ \\t]*>)+[ \\t]?"


def _level(line: Column) -> Column:
    """How many quote marks a line begins with."""
    return F.length(F.regexp_replace(F.regexp_extract(line, "^[ \\t]*(>[ \\t]*)*", 0), "[^>]", ""))


def normalised(text: Column) -> Column:
    return F.lower(F.btrim(F.regexp_replace(text, "[\\s>]+", " ")))


def passages(messages: DataFrame) -> DataFrame:
    """``conv_id, turn, level, hash, n_chars``: stretches of lines with one quote level, blank lines apart, and single lines.

    Replies often quote a part of a message, so each line of a passage counts as well as the whole.
    """
    text = F.translate(F.coalesce("text", F.lit("")), "\r\x01\x02", "")
    line = lambda x: F.struct(_level(x).alias("level"), F.regexp_replace(x, _MARKS, "").alias("text"))
    split = messages.select("conv_id", "turn", F.transform(F.split(text, "\n"), line).alias("lines"))
    # A passage ends where the level changes or a line is blank. One pass marks where passages begin, a second one parts the text there.
    blank = lambda x: F.btrim(x["text"]) == ""

    def begin(x: Column, i: Column) -> Column:
        before = F.get("lines", i - 1)
        goes_on = (i > 0) & (before["level"] == x["level"]) & ~blank(before)
        return F.when(blank(x), F.lit("\x01")).when(goes_on, F.concat(F.lit(" "), x["text"])).otherwise(F.concat(F.lit("\x01"), x["level"].cast("string"), F.lit("\x02"), x["text"]))

    parts = F.filter(F.split(F.array_join(F.transform("lines", begin), ""), "\x01"), lambda p: p != "")
    whole = F.transform(parts, lambda p: F.struct(F.substring_index(p, "\x02", 1).cast("int").alias("level"), F.substring_index(p, "\x02", -1).alias("text")))
    both = F.concat(whole, "lines")  # repeated ones are dropped where they meet
    found = split.select("conv_id", "turn", F.explode(both).alias("p")).select("conv_id", "turn", F.col("p.level").alias("level"), normalised(F.col("p.text")).alias("text"))
    found = found.where("text != ''")
    return found.select("conv_id", "turn", "level", F.xxhash64("text").alias("hash"), F.length("text").alias("n_chars"))


def quote_links(messages: DataFrame) -> DataFrame:
    """``conv_id, turn, quoted_turn``: the earlier message that most of a message's quotes are from.

    A quoted passage belongs to the latest message before it that has it one level lower: passages and quotes of a
    conversation with one hash are put in the order of their turns.
    """
    placed = messages.where("conv_id is not null and turn is not null")
    found = passages(placed)
    # Only a text with a mark has quotes, so the others aren't parted a second time.
    quoted = passages(placed.where(F.col("text").contains(">"))).where("level > 0").select("conv_id", "turn", (F.col("level") - 1).alias("level"), "hash", "n_chars").distinct()
    # Only hashes that are quoted somewhere matter; a conversation quotes a passage in few messages.
    asked = quoted.select("conv_id", "level", "hash").distinct()
    origins = found.select("conv_id", "turn", "level", "hash").distinct().join(asked, ["conv_id", "level", "hash"], "left_semi")
    marked = origins.select("*", F.lit(None).cast("int").alias("n_chars"), F.col("turn").alias("origin")).unionByName(
        quoted.select("conv_id", "turn", "level", "hash", "n_chars", F.lit(None).cast("long").alias("origin")))
    before = Window.partitionBy("conv_id", "level", "hash").orderBy("turn").rangeBetween(Window.unboundedPreceding, -1)
    linked = marked.select("*", F.max("origin").over(before).alias("quoted_turn")).where("n_chars is not null and quoted_turn is not null")
    chars = linked.groupBy("conv_id", "turn", "quoted_turn").agg(F.sum("n_chars").alias("n_chars"))
    best = chars.groupBy("conv_id", "turn").agg(F.max(F.struct("n_chars", "quoted_turn")).alias("best"))
    return best.select("conv_id", "turn", F.col("best.quoted_turn").alias("quoted_turn"))


def previous_turns(messages: DataFrame) -> DataFrame:
    """``conv_id, turn, previous_turn``: the turn before, also where one conversation is as large as all others together."""
    turns = messages.select("conv_id", "turn").where("conv_id is not null and turn is not null").distinct()
    parts = turns.repartitionByRange("conv_id", "turn").select("*", F.spark_partition_id().alias("part"))
    parts = cut(parts, "turns")
    ends = parts.groupBy("part", "conv_id").agg(F.max("turn").alias("last"))
    # One row for each conversation in a part: what the same conversation had last in an earlier part.
    carried = ends.select("part", "conv_id", F.max("last").over(Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)).alias("carried"))
    inside = F.lag("turn").over(Window.partitionBy("part", "conv_id").orderBy("turn"))
    return parts.select("part", "conv_id", "turn", inside.alias("inside")).join(carried, ["part", "conv_id"]).select("conv_id", "turn", F.coalesce("inside", "carried").alias("previous_turn"))


def without_quotes(text: Column) -> Column:
    """A text without its quoted lines and the blanks around what is left."""
    lines = F.filter(F.split(F.regexp_replace(F.coalesce(text, F.lit("")), "\\r", ""), "\n"), lambda x: ~x.rlike("^[ \\t]*>"))
    return F.btrim(F.array_join(lines, "\n"), F.lit(" \t\n"))


def threads(links: DataFrame) -> DataFrame:
    """``conv_id, turn, branch, depth, position`` from ``conv_id, turn, reply_to``, one row for each turn.

    The first reply to a message goes on with its branch, any other begins one that is named by its turn. ``depth`` counts the messages above,
    ``position`` those of the branch before. Pointers to the message above are doubled until they stand at the first message and at the
    first of the branch, so the rounds grow with the logarithm of the longest chain. A row that has arrived is joined no more.
    """
    first = links.where("reply_to is not null").groupBy(F.col("conv_id").alias("_conv"), F.col("reply_to").alias("_above")).agg(F.min("turn").alias("_next"))
    known = links.join(first, (F.col("conv_id") == F.col("_conv")) & (F.col("reply_to") == F.col("_above")), "left")
    above = F.col("reply_to")
    ways = F.array(F.struct(F.lit("d").alias("way"), above.alias("to")), F.struct(F.lit("b").alias("way"), F.when(F.col("_next") == F.col("turn"), above).alias("to")))
    state = known.select("conv_id", "turn", F.explode(ways).alias("w")).select(
        "conv_id", "turn", "w.way", F.coalesce("w.to", "turn").alias("at"), F.col("w.to").isNotNull().cast("long").alias("steps"), F.col("w.to").isNull().alias("there"))
    state = cut(state, "threads")
    while not state.where("not there").isEmpty():
        ahead = state.select(F.col("conv_id").alias("_conv"), F.col("way").alias("_way"), F.col("turn").alias("_turn"), F.col("at").alias("_at"), F.col("steps").alias("_steps"), F.col("there").alias("_there"))
        moved = state.where("not there").join(ahead, (F.col("conv_id") == F.col("_conv")) & (F.col("way") == F.col("_way")) & (F.col("at") == F.col("_turn")))
        moved = moved.select("conv_id", "turn", "way", F.col("_at").alias("at"), (F.col("steps") + F.col("_steps")).alias("steps"), F.col("_there").alias("there"))
        state = cut(state.where("there").unionByName(moved), "threads")
    branch, depth = F.col("way") == "b", F.col("way") == "d"
    return state.groupBy("conv_id", "turn").agg(F.max(F.when(branch, F.col("at"))).alias("branch"), F.max(F.when(depth, F.col("steps"))).alias("depth"),
                                                F.max(F.when(branch, F.col("steps"))).alias("position"))


def reply_order(messages: DataFrame) -> DataFrame:
    """``conv_id, turn, role, content, reply_to, quoted, branch, depth, position``: conversations without quotes, in the order of replies.

    ``reply_to`` is the turn a message replies to; ``quoted`` tells whether a quote leads there. In order of ``conv_id, branch, position`` each branch
    is a conversation that goes on from the message that its first one replies to. Conversations stay rows, as one may be of any size.
    """
    given = messages.select("conv_id", "turn", "role", "text")
    links = previous_turns(given).join(quote_links(given), ["conv_id", "turn"], "left")
    links = cut(links.select("conv_id", "turn", F.coalesce("quoted_turn", "previous_turn").alias("reply_to"), F.col("quoted_turn").isNotNull().alias("quoted")), "replies")
    placed = links.join(threads(links), ["conv_id", "turn"])
    placed = placed.select(F.col("conv_id").alias("_conv"), F.col("turn").alias("_turn"), "reply_to", "quoted", "branch", "depth", "position")
    joined = given.join(placed, (F.col("conv_id") == F.col("_conv")) & (F.col("turn") == F.col("_turn")), "left")
    return joined.select("conv_id", "turn", "role", without_quotes(F.col("text")).alias("content"), "reply_to",
                         F.coalesce("quoted", F.lit(False)).alias("quoted"), "branch", "depth", "position")
