import re
from collections import Counter

import numpy as np
import pytest
from compare import assert_same
from pyspark.sql import functions as F

from gridstat.llm import divergence as D


def plain(rows, least=3, top=200):
    """The audit by its definition, pair by pair and term by term."""
    docs = [(a or "", s or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))) for a, s, t in rows]
    out = []
    for lang in {a for a, _, _ in docs}:
        seen = Counter(w for a, _, ws in docs if a == lang for w in set(ws))
        kept = {w for w, n in seen.items() if n >= least}
        counts = {s: Counter() for a, s, _ in docs if a == lang}
        for a, s, ws in docs:
            if a == lang:
                counts[s].update(w for w in ws if w in kept)
        whole = sum(counts.values(), Counter())
        p = {s: {w: 1 + 10**9 * (c[w] + 1) // (sum(c.values()) + len(kept)) for w in kept} for s, c in counts.items()}
        q = {w: 1 + 10**9 * (whole[w] + 1) // (sum(whole.values()) + len(kept)) for w in kept}
        for s in counts:
            pairs = [(o, sum((p[s][w] - p[o][w]) ** 2 // p[o][w] for w in kept)) for o in counts if o != s]
            terms = [(w, (p[s][w] - q[w]) ** 2 // q[w]) for w in kept if counts[s][w] and p[s][w] > q[w]]
            for part, found, most in (("pair", pairs, None), ("term", terms, top)):
                ranked = sorted(found, key=lambda x: (-x[1], x[0].encode()))[:most]
                out += [(lang, s, part, i, v, k) for k, (i, v) in enumerate(ranked, 1)]
    return set(out)


ROWS = [
    ("en", "a", "The cat sat. The cat sat!"), ("en", "a", "the dog sat"), ("en", "b", "THE cat ran, the dog"), ("en", "b", "the cat, the dog, a b c"), ("en", None, "dog the"), ("en", "quiet", None),
    ("en", "quiet", "123 456 _"), (None, "a", "é É ﬁn 中文 x1y"), (None, "b", "é y x"), (None, "b", "x y É é"), ("de", "a", "nur einmal"), ("de", "b", ""), ("fr", "alone", "un deux"), ("fr", "alone", "un deux"), ("fr", "alone", "un"),
]


def test_query_agrees_with_sql(spark, data, duck):
    assert_same(D.op11_divergence(spark, data).toPandas(), duck.execute(D.OP11_SQL).df())


@pytest.mark.parametrize("copies", [1, 40])
def test_agrees_with_the_definition(spark, copies):
    df = spark.createDataFrame(ROWS * copies, "lang string, source string, text string")
    got = [tuple(r) for r in D.audit(df).collect()]
    assert len(got) == len(set(got)) and set(got) == plain(ROWS * copies)


def test_top_and_least_are_parameters(spark):
    df = spark.createDataFrame(ROWS, "lang string, source string, text string")
    assert {tuple(r) for r in D.audit(df, least_docs=1, top=2).collect()} == plain(ROWS, 1, 2)


def test_counts_do_not_depend_on_what_a_task_holds(spark, documents, monkeypatch):
    want = {tuple(r) for r in D.term_counts(documents.limit(40)).collect()}
    text = " ".join(documents.limit(40).select("text").toPandas()["text"].dropna()).encode()
    assert [w for part in D.slices_of(text, 10) for w in part] == [w for part in D.slices_of(text) for w in part]
    counts = D._Counts()
    monkeypatch.setattr(D, "FREQUENT", 3)
    got = Counter()
    for r in documents.limit(40).collect():
        counts.add((r["lang"] or "", r["source"] or ""), (r["text"] or "").encode())
        for b in counts.drain(False):
            got.update({(x["lang"], x["source"], x["term"]): x["n"] for x in b.to_pylist()})
    for b in counts.drain(True):
        got.update({(x["lang"], x["source"], x["term"]): x["n"] for x in b.to_pylist()})
    assert got == Counter({(a, s, bytes(t)): n for a, s, t, n, _ in want})


def test_shares_are_exact(spark):
    cases = [(0, 1), (5, 6), (10**15, 10**15 + 7), (9 * 10**14, 9 * 10**15), (123456789, 987654321)]
    want = [1 + 10**9 * (c + 1) // m for c, m in cases]
    assert D.shares(*np.array(cases, np.int64).T).tolist() == want
    df = spark.createDataFrame(cases, "c long, m long")
    assert sorted(r[0] for r in df.select(D.share(F.col("c"), F.col("m"))).collect()) == sorted(want)


def test_odd_rows(spark, odd, empty):
    assert D.audit(empty).count() == 0
    rows = [(r["lang"], r["source"], r["text"]) for r in odd.collect()]
    assert {tuple(r) for r in D.audit(odd).collect()} == plain(rows)
