import pytest

pytest.importorskip("gridstat.llm")

#: Rows that every operator must take: nulls, empty and white texts, ties, repeated rows, long and odd texts.
ODD = [
    (1, "The quick brown fox jumps over the lazy dog and runs away from it at once."), (2, "The quick brown fox jumps over the lazy dog and runs away from it at once."),
    (2, "The quick brown fox jumps over the lazy dog and runs away from it at once."), (3, None), (4, ""), (5, " \t\n "), (6, "!!! ??? 12345 …"), (7, "ΣΑΣ İstanbul ﬁn é é <|endoftext|> 中文字 🙂"),
    (8, "word " * 30_000), (9, "x" * 150_000), (10, "\x00\x01\x02\x03\x1c\x85  a\x1fb"), (None, "no id here, but some words all the same"), (None, None),
]


@pytest.fixture(scope="session")
def odd(spark):
    """Those rows with columns whose names operators use themselves."""
    rows = [(i, t, "en" if i and i % 2 else None, "s", len(t) if t is not None else None, 7, 8, True, "f", "p", [1], "m", "n") for i, t in ODD]
    schema = "doc_id long, text string, lang string, source string, n_chars long, row int, fp int, guest boolean, kinds string, parts string, Marked array<int>, made string, spans string"
    return spark.createDataFrame(rows, schema)


@pytest.fixture(scope="session")
def empty(spark, odd):
    return spark.createDataFrame([], odd.schema)


@pytest.fixture(scope="session")
def documents(spark, data):
    return spark.read.parquet(f"{data}/documents.parquet")


@pytest.fixture(scope="session")
def texts(documents):
    return {r["doc_id"]: r["text"] for r in documents.collect()}
