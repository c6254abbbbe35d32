import random
import time

from pyspark.sql import functions as F

from jobmeter.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string, level string"


def ordered(spark, rows):
    df = spark.createDataFrame([(*r, "x") for r in rows], SCHEMA).repartition(3)
    return sorted(((r.conv_id, r.turn, r.content, r.reply_to, r.quoted) for r in chat.reply_order(df).collect()), key=str)


def test_quotes_lead_to_their_messages(spark):
    got = ordered(spark, [
        (1, 0, "user", "Hello there, this is a question.\nSecond line here."),
        (1, 1, "assistant", ">  hello there, THIS is a question.\n\nMy answer is long enough."),
        (1, 2, "user", "something unrelated"),
        (1, 3, "assistant", "> > Hello there, this is a question.\n> My answer is long enough.\nNested"),
        (1, 4, "user", "> Second line here.\n\n  back to the first \n> Second line here."),
        (2, 3, "user", "> something unrelated\nother conversation"),
    ])
    assert got == sorted([
        (1, 0, "Hello there, this is a question.\nSecond line here.", None, False),
        (1, 1, "My answer is long enough.", 0, True), (1, 2, "something unrelated", 1, False), (1, 3, "Nested", 1, True),
        (1, 4, "back to the first", 0, True), (2, 3, "other conversation", None, False)], key=str)


def test_paragraphs_quoted_over_several_lines(spark):
    got = ordered(spark, [(1, 0, "u", "first part\nof a paragraph\n\nanother one"), (1, 5, "u", "x"), (1, 9, "u", "> first part of\n> a paragraph\nyes")])
    assert (1, 9, "yes", 0, True) in got


def test_ties_go_to_the_latest_before(spark):
    same = "the very same words"
    got = ordered(spark, [(1, 0, "u", same), (1, 1, "u", same), (1, 2, "u", "> " + same), (1, 3, "u", same)])
    assert (1, 2, "", 1, True) in got


def test_most_quoted_characters_win(spark):
    got = ordered(spark, [(1, 0, "u", "a rather long first message"), (1, 1, "u", "short one"), (1, 2, "u", "> a rather long first message\n\n> short one\nk")])
    assert (1, 2, "k", 0, True) in got


def test_odd_rows(spark):
    got = ordered(spark, [(1, 0, "u", None), (1, 4, "u", ""), (1, 4, "u", "> q"), (None, 1, "u", "a"), (3, None, "u", "b"), (1, 4, "u", "")])
    assert got == sorted([(1, 0, "", None, False), (1, 4, "", 0, False), (1, 4, "", 0, False), (1, 4, "", 0, False),
                          (None, 1, "a", None, False), (3, None, "b", None, False)], key=str)
    assert ordered(spark, []) == []


def test_conversations_against_brute_force(spark):
    data = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet")
    rows = [tuple(r) for r in data.select("conv_id", "turn", "role", "text").collect()]
    got = {(r.conv_id, r.turn): (r.content, r.reply_to) for r in chat.reply_order(data.repartition(5)).collect()}
    for c, t, _, text in rows:
        earlier = [u for d, u, _, _ in rows if d == c and u < t]
        kept = "\n".join(x for x in (text or "").replace("\r", "").split("\n") if not x.lstrip(" \t").startswith(">")).strip(" \t\n")
        assert got[c, t] == (kept, max(earlier, default=None))


def test_large_conversation_is_split(spark):
    n = 5000
    rows = spark.range(n).selectExpr("1L AS conv_id", "id * 2 AS turn", "'u' AS role", "concat('message number ', id) AS text")
    got = chat.reply_order(rows).where("turn > 0 and (reply_to is null or reply_to != turn - 2)").count()
    assert got == 0


def test_short_quotes_lead_to_their_messages(spark):
    got = ordered(spark, [(1, 0, "u", "why?"), (1, 1, "u", "\u4e3a\u4ec0\u4e48"), (1, 2, "u", "a longer one\nyes"), (1, 3, "u", "other"),
                          (1, 4, "u", "> Why?\nb"), (1, 5, "u", "> \u4e3a\u4ec0\u4e48\nc"), (1, 6, "u", "> yes\nd"), (1, 7, "u", "> ye\ne"), (1, 8, "u", "> why?\n\n> a longer one\nf")])
    assert [r[2:] for r in got[4:]] == [("b", 0, True), ("c", 1, True), ("d", 2, True), ("e", 6, False), ("f", 2, True)]


def brute_passages(text):
    """Passages with their level, and each line by itself."""
    def clean(t):
        return " ".join(t.replace(">", " ").split()).lower()

    lines = []
    for raw in text.split("\n"):
        body, level = raw, 0
        while body.lstrip(" \t").startswith(">"):
            body, level = body.lstrip(" \t")[1:], level + 1
        lines.append((level, body))
    found, held = set(), []
    for level, body in [*lines, (0, "")]:
        if held and (not body.strip() or held[0][0] != level):
            found.add((held[0][0], clean(" ".join(b for _, b in held))))
            held = []
        if body.strip():
            held.append((level, body))
    return {(n, t) for n, t in found | {(n, clean(b)) for n, b in lines} if t}


def brute_conversation(texts):
    """By turn: reply_to, quoted, branch, depth, position."""
    own = {t: brute_passages(x) for t, x in texts.items()}
    out, taken = {}, set()
    for t in sorted(texts):
        chars = {}
        for level, words in own[t]:
            origins = [u for u in texts if u < t and (level - 1, words) in own[u]] if level else []
            if origins:
                chars[max(origins)] = chars.get(max(origins), 0) + len(words)
        quoted = max(chars, key=lambda u: (chars[u], u)) if chars else None
        above = quoted if chars else max((u for u in texts if u < t), default=None)
        out[t] = (above, bool(chars))
    first = {}
    for t in sorted(out):
        first.setdefault(out[t][0], t)
    placed = {}
    for t in sorted(out):
        above, quoted = out[t]
        if above is None:
            placed[t] = (None, quoted, t, 0, 0)
        else:
            _, _, branch, depth, position = placed[above]
            placed[t] = (above, quoted, branch, depth + 1, position + 1) if first[above] == t else (above, quoted, t, depth + 1, 0)
    return placed


def test_quoting_threads_against_brute_force(spark):
    rng = random.Random(5)
    words = [f"w{k}" for k in range(40)]
    rows, want = [], {}
    for conv in range(25):
        texts = {}
        for turn in range(rng.randint(1, 24)):
            own = "\n".join(" ".join(rng.choices(words, k=rng.randint(1, 4))) for _ in range(rng.randint(1, 3)))
            for source in rng.sample(sorted(texts), min(len(texts), rng.choice([0, 0, 1, 1, 2]))):
                cited = texts[source].split("\n")
                cited = cited[:rng.randint(1, len(cited))]
                own = "\n".join(f"> {x}".upper() if rng.random() < 0.3 else f">{x}" for x in cited) + rng.choice(["\n", "\n\n"]) + own
            texts[turn * 3] = own
        rows += [(conv, t, "u", x) for t, x in texts.items()]
        want |= {(conv, t): p for t, p in brute_conversation(texts).items()}
    df = spark.createDataFrame([(*r, "x") for r in rows], SCHEMA).repartition(4)
    got = {(r.conv_id, r.turn): (r.reply_to, r.quoted, r.branch, r.depth, r.position) for r in chat.reply_order(df).collect()}
    assert got == want
    assert sum(p[1] for p in want.values()) > 50 and len({(c, p[2]) for (c, _), p in want.items()}) > 40


def test_long_chain_and_many_replies_to_one(spark):
    n = 3000
    chain = spark.range(n).selectExpr("1L as conv_id", "id as turn", "if(id = 0, null, id - 1) as reply_to")
    star = spark.range(n).selectExpr("2L as conv_id", "id as turn", "if(id = 0, null, 0L) as reply_to")
    got = chat.threads(chain.unionByName(star)).groupBy("conv_id").agg(
        F.count("*"), F.sum("depth"), F.sum("position"), F.count_distinct("branch")).orderBy("conv_id").collect()
    assert [tuple(r) for r in got] == [(1, n, n * (n - 1) // 2, n * (n - 1) // 2, 1), (2, n, n - 1, 1, n - 1)]


def test_message_of_many_lines(spark):
    def seconds(n):
        text = "\n".join(f"line {k} of it" if k % 7 else "> quoted" for k in range(n))
        start = time.time()
        assert chat.passages(spark.createDataFrame([(1, 0, "u", text, "x")], SCHEMA)).count() > n * 6 // 7
        return time.time() - start

    seconds(100)
    assert seconds(50_000) < 30
