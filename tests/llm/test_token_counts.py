import hashlib
import random

import public_tokenizers
import pytest

from gridstat.llm import token_counts as T


@pytest.fixture(scope="module")
def counter():
    return T.counter_of(str(public_tokenizers.path("byte_bpe_50k.tiktoken")), public_tokenizers.PATTERN)


def whole(counter, text):
    return len(counter.encoding.encode_ordinary(text))


def test_random_edits_equal_a_full_count(counter):
    rng = random.Random(3)
    bits = ["a", "b ", " the", "'", "'s", "ll", "  ", "\n", "12", "!", "é", " x", "\t"]
    for _ in range(150):
        text = "".join(rng.choice(bits) for _ in range(rng.randint(0, 400)))
        c = T.CountedText(text, counter)
        for _ in range(12):
            a, b = sorted(rng.randint(0, len(text) + 2) for _ in range(2))
            b = min(b, a + rng.choice([0, 1, 5, 300]))
            new = "".join(rng.choice(bits) for _ in range(rng.choice([0, 1, 3, 90])))
            a2, b2 = min(a, len(text)), min(b, len(text))
            text = text[:a2] + new + text[b2:]
            c.edit(a, b, new)
            assert (c.text(), c.chars, c.tokens) == (text, len(text), whole(counter, text))


def test_edits_touch_little(counter):
    text = "some words of a long text, again and again. " * 2000
    c = T.CountedText(text, counter)
    c.edit(40_000, 40_003, "new")
    assert c.encoded_chars < 100


def test_query(spark, data, counter, texts):
    rows = T.op2_token_counts(spark, data).collect()
    assert len(rows) == len(texts)
    for r in rows:
        text = texts[r["doc_id"]]
        assert r["n_tokens"] == whole(counter, text)
        n = len(text)
        e = text[: n // 3] + text[:12] + text[n // 3 :]
        e = e[: 2 * n // 3] + e[2 * n // 3 + n // 50 :]
        e = e[: n + 12] + " " + text[:40] + e[n + 12 :]
        assert r["n_tokens_edited"] == whole(counter, e) and r["edited_sha256"] == hashlib.sha256(e.encode()).hexdigest()


def balanced(node):
    if node is None or node.left is None:
        return True
    return abs(node.left.height - node.right.height) <= 1 and balanced(node.left) and balanced(node.right)


def test_thousands_of_edits_keep_the_tree_balanced(counter):
    c, want = T.CountedText("in the middle", counter), "in the middle"
    for i in range(10_000):
        at = (0, len(want), len(want) // 2)[i % 3]
        new = f" w{i}" * (1 + i % 5)
        c.edit(at, at, new)
        want = want[:at] + new + want[at:]
    assert c.text() == want and c.tokens == whole(counter, want) and balanced(c.root)
    for _ in range(3_000):
        c.edit(0, 40, "")
    assert c.text() == want[120_000:] and c.tokens == whole(counter, want[120_000:]) and balanced(c.root)


def test_log_and_odd_rows(spark, odd, empty, counter):
    log = spark.createDataFrame([(1, 2, 0, 3, "A"), (1, 1, 0, 0, "x "), (4, 1, 9, 2, "new text"), (99, 1, 0, 1, "y"), (None, 1, 0, 9, "n")], "doc_id long, seq int, start long, stop long, text string")
    path = str(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    rows = T.count_through_log(odd, log, path, public_tokenizers.PATTERN).collect()
    assert len(rows) == odd.count()
    out = {r["doc_id"]: r for r in rows}
    assert out[1]["edited_sha256"] == hashlib.sha256(b"Ahe quick brown fox jumps over the lazy dog and runs away from it at once.").hexdigest()
    assert out[4]["n_tokens_edited"] == whole(counter, "new text") and out[3]["n_tokens"] == 0
    assert T.count_through_log(empty, log, path, public_tokenizers.PATTERN).count() == 0


def test_a_long_log_of_one_document(spark, counter):
    edits = [(7, i, i, i, f"{i % 10} ") for i in range(3_000)]
    log = spark.createDataFrame(edits, "doc_id long, seq int, start long, stop long, text string")
    docs = spark.createDataFrame([(7, "end"), (8, "other"), (7, "")], "doc_id long, text string")
    rows = sorted(T.count_through_log(docs, log, str(public_tokenizers.path("byte_bpe_50k.tiktoken")), public_tokenizers.PATTERN).collect(), key=lambda r: r["n_chars_edited"])
    want = ""
    for _, _, a, b, new in edits:
        want = want[:a] + new + want[b:]
    assert [r["n_chars_edited"] for r in rows] == [5, 6_000, 6_003]
    assert rows[1]["edited_sha256"] == hashlib.sha256(want.encode()).hexdigest() and rows[1]["n_tokens_edited"] == whole(counter, want)
