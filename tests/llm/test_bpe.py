import hashlib
import random

import pytest
from tokenizers import Tokenizer

from gridstat.llm import bpe


def sha(s):
    return hashlib.sha256(s.encode("utf-8")).hexdigest()


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(bpe.default_vocabulary())


def expected(library, text):
    ids = library.encode(text or "", add_special_tokens=False).ids
    return len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False))


def test_query_agrees_with_the_library(spark, data, library, texts):
    got = bpe.op3_bpe(spark, data).collect()
    assert len(got) == len(texts)
    for r in got:
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == expected(library, texts[r["doc_id"]])


def test_odd_rows(odd, empty, library):
    want = sorted((r["doc_id"] or -1, *expected(library, r["text"])) for r in odd.collect())
    got = sorted((r["doc_id"] or -1, r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in bpe.encode_decode(odd, bpe.default_vocabulary()).collect())
    assert got == want
    assert bpe.encode_decode(empty, bpe.default_vocabulary()).count() == 0


def test_long_words_stream_with_bounded_memory(library):
    table = bpe.cache_of(bpe.default_vocabulary()).table
    rng = random.Random(5)
    for alphabet in ("ab", "aaab", "etaoin", "haha", "the"):
        word = "".join(rng.choice(alphabet) for _ in range(6000))
        machine, out, most = bpe.PreTokenTransducer(table), [], 0
        for c in word[:-1]:
            out += machine.feed(c)
            most = max(most, len(machine.held))
        out += machine.feed(chr(256 + ord(word[-1]))) + machine.finish()
        assert out == library.encode(word, add_special_tokens=False).ids
        assert most <= 2 * table.lookahead + table.longest + 1 < len(word)


UNSPACED = {
    "letters": "abcdéß中", "marks": "!?-'\"…", "mixed": "a'sb1!中é'r", "composed": "e\u0301a\u0300\u0316x", "hangul": "\u1100\u1161\u11a8가",
    "special": ["<|endoftext|>", "ab", "!", "1"], "spaced": "abc def'll ", "long words": ["word" * 40, "x" * 90, " "],
}


@pytest.mark.parametrize("kind", UNSPACED)
def test_chunks_do_not_show(library, monkeypatch, kind):
    cache = bpe.cache_of(bpe.default_vocabulary())
    rng = random.Random(kind)
    texts = ["".join(rng.choice(UNSPACED[kind]) for _ in range(rng.randint(1, 300))) for _ in range(40)]
    whole = [bpe.digest(cache, t) for t in texts]
    for size in (7, 20, 64):
        monkeypatch.setattr(bpe, "CHUNK_CHARS", size)
        for t, before in zip(texts, whole, strict=True):
            assert (got := bpe.digest(cache, t)) == before and got[:3] == expected(library, t)
            assert cache.encoder.encode(t) == library.encode(t, add_special_tokens=False).ids


def test_unspaced_text_needs_no_more_memory_than_a_chunk(library, monkeypatch):
    import tracemalloc

    cache, rng = bpe.cache_of(bpe.default_vocabulary()), random.Random(1)
    monkeypatch.setattr(bpe, "CHUNK_CHARS", 4096)
    text = "".join(rng.choice("abcdefgh") for _ in range(200_000))  # one pre-token
    bpe.digest(cache, text[:20_000])
    tracemalloc.start()
    got = bpe.digest(cache, text)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got[:3] == expected(library, text) and most < 3e6, most


def test_decoder_waits_for_whole_characters():
    cache = bpe.cache_of(bpe.default_vocabulary())
    ids = cache.encoder.encode("naïve 中🙂")
    d = bpe.StreamingDecoder(cache.table)
    parts = [d.text([i]) for i in ids] + [d.finish()]
    assert "".join(parts) == "naïve 中 🙂" and "�" not in "".join(parts)


def test_ids_round_trip(spark, library):
    df = spark.createDataFrame([(1, "Hello, world's end"), (2, None)], "doc_id long, text string")
    got = {r["doc_id"]: r["ids"] for r in bpe.token_ids(df, bpe.default_vocabulary()).collect()}
    assert got == {1: library.encode("Hello, world's end", add_special_tokens=False).ids, 2: []}


def test_every_character_is_cut_as_the_library_cuts_it(library):
    """Letters, numbers and lower case of all code points, those of a newer standard too."""
    import unicodedata

    import regex

    encoder = bpe.cache_of(bpe.default_vocabulary()).encoder
    every = [c for c in map(chr, [*range(0x80, 0xD800), *range(0xE000, 0x20000)]) if unicodedata.category(c) != "Cn" or regex.match(r"\P{Cn}", c)]
    every += list(bpe._doubtful())
    for at in range(0, len(every), 500):
        some = every[at : at + 500]
        texts = [f"a{c}b {c}c1{c}" for c in some]
        want = library.encode_batch(texts, add_special_tokens=False)
        assert [(t, encoder.encode(t)) for t in texts] == [(t, w.ids) for t, w in zip(texts, want, strict=True)]
