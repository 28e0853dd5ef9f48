import hashlib
import random

import numpy as np

from gridstat.llm import winnow as W


def brute(text, gram, window):
    """Chosen positions, by the definition."""
    h = W.gram_hashes(W._points(text), gram)
    out = []
    for i in range(len(h) - window + 1):
        part = h[i : i + window]
        at = i + max(k for k in range(window) if part[k] == part.min())
        if not out or out[-1] != at:
            out.append(at)
    return out


def test_choice_follows_the_definition(monkeypatch):
    rng = random.Random(4)
    monkeypatch.setattr(W, "_PIECE", 37)  # pieces must not show
    for _ in range(60):
        text = "".join(rng.choice("ab é") for _ in range(rng.randint(20, 300)))
        assert list(W.chosen(text, 4, 7)[1]) == brute(text, 4, 7)


def test_rolling_hash_depends_on_its_run_alone():
    a, b = W.gram_hashes(W._points("xxhello world")), W.gram_hashes(W._points("hello world, the same")[:])
    assert len(W.gram_hashes(W._points("x" * 40))) == 25 and len(set(W.gram_hashes(W._points("x" * 40)).tolist())) == 1
    assert len(a) == 0 and len(b) == 6


def test_shared_passages_share_a_hash():
    rng = random.Random(1)
    noise = lambda n: "".join(rng.choice("abcdefghij ") for _ in range(n))
    passage = noise(W.GRAM + W.WINDOW - 1)
    a, b = W.chosen(noise(500) + passage + noise(300)), W.chosen(noise(77) + passage + noise(900))
    assert set(a[0].tolist()) & set(b[0].tolist())


def test_query_agrees_with_brute_force(spark, data, texts):
    rows = W.op10_winnow(spark, data).collect()
    ids = sorted(texts, reverse=True)
    following = {i: ids[(k + 1) % len(ids)] for k, i in enumerate(ids)}
    assert sorted(r["doc_id"] for r in rows) == sorted(texts)
    by_text = {}
    for r in rows:
        t, n = texts[r["doc_id"]], texts[following[r["doc_id"]]]
        k = len(t) // 3
        e = (t[:-k] if k else t) + n[:k]
        assert r["n_chars"] == len(t) and r["edited_sha256"] == hashlib.sha256(e.encode()).hexdigest()
        a, b, c = (W.chosen(x) for x in (t, e, n))
        assert r["fingerprint"] == W.render(*a) and r["edited_fingerprint"] == W.render(*b)
        assert (r["near_edited"], r["near_next"]) == (W.likeness(a[0], b[0]), W.likeness(a[0], c[0]))
        by_text.setdefault(t, set()).add(r["fingerprint"])
    assert all(len(v) == 1 for v in by_text.values())
    assert np.mean([r["near_edited"] for r in rows]) > np.mean([r["near_next"] for r in rows]) + 0.3


def test_odd_rows(spark, odd, empty):
    rows = W.compare_with_next(odd).collect()
    assert len(rows) == odd.count()
    r = {x["doc_id"]: x for x in rows}
    assert r[3]["fingerprint"] == r[4]["fingerprint"] == "" and r[4]["near_next"] == 1.0 and r[1]["near_next"] == 0.0
    assert W.compare_with_next(empty).count() == 0
    one = spark.createDataFrame([(1, "abc")], "doc_id long, text string")
    assert W.compare_with_next(one).first()["near_next"] == 1.0
    assert W.fingerprints(odd).count() == odd.count()


def test_hashes_of_runs_of_any_length():
    text = "".join(random.Random(8).choice("abcdé ") for _ in range(200))
    points = W._points(text)
    for gram in (1, 3, 5, 16, 20, 31):
        got = W.gram_hashes(points, gram)
        want = []
        for i in range(len(points) - gram + 1):
            h = 0
            for p in points[i : i + gram].tolist():
                h = (h * int(W._BASE) + p + 1) % 2**64
            want.append(h)
        assert got.tolist() == W._mixed(np.array(want, dtype=np.uint64)).tolist()
    for gram, window in ((5, 9), (20, 7)):
        assert list(W.chosen(text, gram, window)[1]) == brute(text, gram, window)


def test_likeness_is_that_of_the_printed_fingerprints(spark, data):
    for r in W.op10_winnow(spark, data).limit(50).collect():
        a, b = (np.array([int(x.split("@")[0], 16) for x in r[c].split()], dtype=np.uint64) for c in ("fingerprint", "edited_fingerprint"))
        assert W.likeness(a, b) == r["near_edited"]
