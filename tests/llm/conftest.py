import pytest

LONG = " ".join(f"wort{i} and the {i % 97}." for i in range(30_000))
ODD = [
    (1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "one"), (6, LONG), (7, "x" * 50_000), (None, "text without id"),
    (None, None), (8, "same row twice here"), (8, "same row twice here"), (9, "naïve ﬀ 中文 🜁 é ​ İ ß <|endoftext|> it's 12"),
]


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls, empty and very long texts, repeated rows, and columns whose names operators use themselves."""
    names = ["class", "label", "group", "node", "drop", "line", "piece", "length", "shard", "n_words", "count", "score", "word", "matches"]
    rows = [(i, t, *[f"{n}-{k}" for n in names]) for k, (i, t) in enumerate(ODD)]
    return spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"`{n}` string" for n in names))


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
