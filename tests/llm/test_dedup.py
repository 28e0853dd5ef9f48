import itertools

import numpy as np
import xxhash
from pyspark.sql import functions as F

from gridstat.llm import simhash


def brute_fingerprint(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(fps, ids, most=3):
    parent = list(range(len(fps)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in itertools.combinations(range(len(fps)), 2):
        if (fps[i] ^ fps[j]).bit_count() <= most or ids[i] == ids[j]:
            parent[find(i)] = find(j)
    least = {}
    for i in range(len(fps)):
        least[find(i)] = min(least.get(find(i), ids[i]), ids[i])
    return [least[find(i)] for i in range(len(fps))]


def test_query_agrees_with_brute_force(spark, data, texts):
    rows = sorted(simhash.op6_simhash(spark, data).collect(), key=lambda r: r["doc_id"])
    fps = [int(r["fingerprint"], 16) for r in rows]
    assert fps == [brute_fingerprint(texts[r["doc_id"]]) for r in rows]
    assert [r["component_id"] for r in rows] == brute_components(fps, [r["doc_id"] for r in rows])


def test_links_of_close_fingerprints(spark):
    rng = np.random.default_rng(0)
    base = [int(x) for x in rng.integers(0, 2**63, 30)]
    fps = set(base)
    for b in base:
        for k in (1, 2, 3, 4, 5):
            x = b
            for bit in rng.choice(64, k, replace=False):
                x ^= 1 << int(bit)
            fps.add(x)
    signed = [f - (1 << 64) if f >= 1 << 63 else f for f in sorted(fps)]
    classes = spark.createDataFrame([(f, i) for i, f in enumerate(signed)], "fp long, node long")
    got = sorted(tuple(sorted((r["a"], r["b"]))) for r in simhash.links(classes).collect())
    unsigned = sorted(fps)
    want = sorted((i, j) for i, j in itertools.combinations(range(len(unsigned)), 2) if (unsigned[i] ^ unsigned[j]).bit_count() <= 3)
    assert got == want and want


def test_components_of_chains_stars_and_rings(spark):
    edges = [(i, i + 1) for i in range(100, 140)] + [(7, i) for i in range(20, 30)] + [(50, 51), (51, 52), (52, 50)] + [(60, 60)]
    got = {r["node"]: r["root"] for r in simhash.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 100 for i in range(101, 141)}, **{i: 7 for i in range(20, 30)}, 51: 50, 52: 50}
    none = spark.createDataFrame([], "a long, b long")
    assert simhash.components(none).count() == 0


def test_odd_rows(odd, empty):
    rows = simhash.near_duplicates(odd).collect()
    assert len(rows) == odd.count()
    of = {}
    for r in rows:
        of.setdefault(r["doc_id"], set()).add(r["component_id"])
    assert of[1] == of[2] == {1} and of[3] == of[4] == of[5] == {3}
    assert simhash.near_duplicates(empty).count() == 0


def test_repeated_ids_are_one_document(spark):
    df = spark.createDataFrame([(5, "a b c d"), (5, "quite another text here"), (9, "quite another text here")], "doc_id long, text string")
    assert {r["component_id"] for r in simhash.near_duplicates(df).collect()} == {5}


def test_one_of_each_stays(odd):
    kept = simhash.keep_one_of_each(odd)
    assert kept.columns == odd.columns
    ids = [r["doc_id"] for r in kept.orderBy("doc_id").collect()]
    assert ids == [None, None, 1, 3, 6, 7, 8, 9, 10]
    assert kept.where(F.col("doc_id") == 1).first()["fp"] == 8


def test_large_families_link_through_midpoints(spark):
    rng = np.random.default_rng(5)
    centres = [int(x) for x in rng.integers(0, 2**63, 3)]
    fps = set(centres)
    for c in centres:
        for _ in range(100):
            x = c
            for bit in rng.choice(64, int(rng.integers(1, 6)), replace=False):
                x ^= 1 << int(bit)
            fps.add(x)
    fps = sorted(f - (1 << 64) if f >= 1 << 63 else f for f in fps)
    ids = list(range(len(fps)))
    classes = spark.createDataFrame(list(zip(fps, ids, strict=True)), "fp long, node long")
    want = brute_components([f % (1 << 64) for f in fps], ids)
    for hot in (20, 10_000):
        roots = {r["node"]: r["root"] for r in simhash.components(simhash.links(classes, hot)).collect()}
        assert [roots.get(i, i) for i in ids] == want, hot


def test_a_family_of_thousands_gives_rows_in_proportion(spark):
    rng = np.random.default_rng(6)
    base = 0x1234_5678_9ABC_DEF0
    fps = {base}
    while len(fps) < 5_000:
        x = base
        for bit in rng.choice(64, 3, replace=False):
            x ^= 1 << int(bit)
        fps.add(x)
    fps = sorted(fps)
    classes = spark.createDataFrame([(f - (1 << 64) if f >= 1 << 63 else f, i) for i, f in enumerate(fps)], "fp long, node long")
    out = simhash.links(classes)
    roots = simhash.components(out)
    assert roots.count() == len(fps) - 1 and roots.where("root <> 0").isEmpty()


def test_what_stays_does_not_depend_on_the_order_of_rows(spark):
    rows = [(1, "f g h i j", "x"), (1, "a b c d e", "y"), (1, "a b c d e", "w"), (2, None, "z"), (2, "k l m n o", "z"), (None, "p", "q"), (4, "p", "q")]
    for order in (rows, rows[::-1]):
        df = spark.createDataFrame(order, "doc_id long, text string, source string").coalesce(1)
        for most in (0, 100):  # joined by a shuffle or a broadcast
            got = sorted(map(tuple, simhash.keep_one_of_each(df, broadcast_ids=most).collect()), key=str)
            assert got == [(1, "a b c d e", "w"), (2, None, "z"), (4, "p", "q"), (None, "p", "q")]
