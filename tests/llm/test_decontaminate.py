import re

from compare import assert_same
from pyspark.sql import functions as F

from gridstat.llm import decontaminate as D


def test_query_agrees_with_sql(spark, data, duck):
    assert_same(D.op5_decontaminate(spark, data).toPandas(), duck.execute(D.OP5_SQL).df())


def brute(words, items, window=10):
    hit, found = set(), set()
    for item, w in items:
        k = min(window, len(w))
        for j in range(len(w) - k + 1 if w else 0):
            for i in range(len(words) - k + 1):
                if words[i : i + k] == w[j : j + k]:
                    hit |= set(range(i, i + k))
                    found.add(item)
    return hit, found


def test_automaton_agrees_with_brute_force():
    import random

    rng = random.Random(2)
    for _ in range(200):
        alphabet = [c.encode() for c in "abc"[: rng.randint(1, 3)]]
        items = [(str(i), [rng.choice(alphabet) for _ in range(rng.randint(0, 9))]) for i in range(rng.randint(0, 5))]
        words = [rng.choice([*alphabet, b"z"]) for _ in range(rng.randint(0, 40))]
        window = rng.randint(2, 5)
        spans, found = D.SuffixAutomaton(items, window).match(words)
        hit, want = brute(words, items, window)
        assert {p for s, e in spans for p in range(s, e)} == hit and found == want
        assert all(a[1] <= b[0] for a, b in zip(spans, spans[1:], strict=False))


def test_blocks_agree_with_one_automaton(spark, data, documents):
    bench = spark.read.parquet(f"{data}/benchmark.parquet")
    one = D.matches(documents, bench)
    many = D.matches(documents, bench, block_words=100)
    key = lambda df: sorted((r["doc_id"], r["n_words"], sorted(r["items"]), r["n_hit"]) for r in df.withColumn("n_hit", D.hit_words(df["spans"])).collect())
    assert key(one) == key(many) and any(r[3] for r in key(one))


def test_cutting(spark):
    item = "one two three four five six seven eight nine ten"
    bench = spark.createDataFrame([("a", item), ("b", None), ("c", "..."), ("d", "short item")], "item_id string, text string")
    rows = [(1, f"Before it, {item.upper()}; after it come many more words that stay here now", 5), (2, item, 6), (3, None, 7), (4, "nothing at all", 8), (5, "a SHORT, item in it and so on", 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars int")
    out = {r["doc_id"]: (r["text"], r["n_chars"]) for r in D.remove_contamination(docs, bench).collect()}
    first = "Before it, ; after it come many more words that stay here now"
    assert out == {1: (first, len(first)), 3: (None, 7), 4: ("nothing at all", 8), 5: ("a  in it and so on", 18)}
    assert not re.search("(?i)two three", out[1][0])


def test_odd_rows(spark, odd, empty):
    bench = spark.createDataFrame([("w", " ".join(["word"] * 12))], "item_id string, text string")
    got = {r["doc_id"]: r for r in D.matches(odd, bench).collect()}
    assert got[8]["spans"] == [[0, 30_000]] and got[3]["n_words"] == 0
    assert D.matches(empty, bench).count() == 0 and D.remove_contamination(empty, bench).count() == 0
    none = spark.createDataFrame([], "item_id string, text string")
    assert D.matches(odd, none).where("size(spans) > 0").count() == 0
    assert D.remove_contamination(odd, bench).count() == odd.count() - 1


def test_removal_does_not_depend_on_blocks(spark):
    words = lambda a, b: " ".join(f"w{i}" for i in range(a, b))
    # Items overlap across blocks (a, b), hit a document together (c, d), would meet once one is cut (e, f), or touch (g, h).
    items = [("a", words(0, 14)), ("b", words(8, 22)), ("c", words(100, 112)), ("d", words(200, 212)), ("e", words(300, 310)), ("f", words(400, 405) + " " + words(500, 505)), ("g", words(600, 610)), ("h", words(610, 620))]
    bench = spark.createDataFrame(items, "item_id string, text string")
    rest = words(1000, 1040)
    rows = [(1, f"{words(0, 22)}, {rest}"), (2, f"{words(100, 112)} {words(1000, 1016)} {words(200, 212)}"), (3, f"{words(400, 405)} {words(300, 310)} {words(500, 505)} {rest}"), (4, f"{words(600, 610)} -- {words(610, 620)}; {rest}"), (5, rest)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    key = lambda n: sorted((r["doc_id"], r["text"]) for r in D.remove_contamination(docs, bench, block_words=n).collect())
    want = [(1, f", {rest}"), (3, f"{words(400, 405)}  {words(500, 505)} {rest}"), (4, f"; {rest}"), (5, rest)]
    assert key(1000) == want and key(1) == want and key(30) == want


def test_long_items_come_in_pieces_that_keep_every_window():
    words = [str(i).encode() for i in range(57)]
    for window, most in ((10, 12), (10, 10), (3, 20), (10, 100)):
        pieces = list(D.pieces_of(words, window, most))
        windows = {tuple(p[i : i + window]) for p in pieces for i in range(len(p) - window + 1)}
        assert windows == {tuple(words[i : i + window]) for i in range(len(words) - window + 1)} and all(len(p) <= max(most, window) for p in pieces)
    assert list(D.pieces_of(words[:4])) == [words[:4]] and list(D.pieces_of([])) == [[]]


def test_items_without_an_id_hit_but_have_no_name(spark):
    item = " ".join(f"w{i}" for i in range(12))
    bench = spark.createDataFrame([(None, item), ("a", item.replace("w", "v"))], "item_id string, text string")
    docs = spark.createDataFrame([(1, f"x {item} y"), (2, f"{item} {item.replace('w', 'v')}")], "doc_id long, text string")
    for block_words in (5, 1000):
        got = {r["doc_id"]: (r["items"], r["n"]) for r in D.matches(docs, bench, block_words=block_words).withColumn("n", D.hit_words(F.col("spans"))).collect()}
        assert got == {1: ([], 12), 2: (["a"], 24)}
