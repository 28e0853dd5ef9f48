import hashlib
import random
import re
from collections import Counter
from fractions import Fraction

import pytest
from compare import assert_same
from pyspark.sql import functions as F

from gridstat.llm import mixture as M


def test_query_agrees_with_sql(spark, data, duck):
    assert_same(M.op12_mixture(spark, data).toPandas(), duck.execute(M.OP12_SQL).df())


def test_query_comes_near_its_targets(spark, data):
    got = M.op12_mixture(spark, data).toPandas()
    assert (got["taken"] <= 3 * got["size"]).all() and (got["taken"] % got["size"].clip(lower=1) == 0).all()
    by = got.groupby("source_size").agg(target=("target", "first"), taken=("taken", "sum"))
    assert (by["taken"] <= by["target"] + 1e-6).all() and by["taken"].sum() >= 0.97 * by["target"].sum()
    assert abs(by["target"].sum() - got["size"].sum()) < 1e-3


def plain_fill(total, weights, most):
    """Share by weight, cut, share the excess again, until nothing is above."""
    got = {s: Fraction(0) for s in weights}
    left, open_ = Fraction(total), set(weights)
    while left and open_:
        w = sum(weights[s] for s in open_)
        got.update({s: got[s] + left * weights[s] / w for s in open_})
        left = sum(max(got[s] - most[s], 0) for s in open_)
        capped = {s for s in open_ if got[s] >= most[s]}
        got.update({s: Fraction(most[s]) for s in capped})
        open_ -= capped
    return got


def test_fill():
    rng = random.Random(1)
    for _ in range(300):
        sizes = {f"s{i}": rng.choice([0, 1, 5, 100, 10**6]) for i in range(rng.randint(1, 7))}
        weights = {s: rng.randint(1, 3) for s in sizes}
        most = {s: 3 * n for s, n in sizes.items()}
        got = {s: Fraction(*v) for s, v in M.fill(sum(sizes.values()), weights, most).items()}
        assert got == plain_fill(sum(sizes.values()), weights, most) and sum(got.values()) == sum(sizes.values())
    assert M.code_points(["b", None, "é", "B", ""]) == ["", "B", "b", "é", None]


def least_cost(patterns, quotas, repeats):
    """Most words and then the least cost, by trying every amount."""
    best = (0, 0)

    def go(i, left, moved, cost):
        nonlocal best
        if i == len(patterns):
            best = max(best, (moved, -cost))
            return
        room, members = patterns[i]

        def split(j, used, left):
            if j == len(members):
                go(i + 1, left, moved + used, cost + sum((k // room) + 1 for k in range(used)))
                return
            for x in range(min(repeats * room - used, left[members[j]]) + 1):
                split(j + 1, used + x, {**left, members[j]: left[members[j]] - x})

        split(0, 0, left)

    go(0, dict(enumerate(quotas)), 0, 0)
    return best


def test_flow_is_the_cheapest():
    rng = random.Random(3)
    for _ in range(60):
        n = rng.randint(1, 3)
        patterns = [(rng.randint(1, 2), sorted(rng.sample(range(n), rng.randint(1, n)))) for _ in range(rng.randint(1, 3))]
        quotas = [rng.randint(0, 5) for _ in range(n)]
        flows = M.route(patterns, quotas)
        assert all(sum(f.get(s, 0) for f in flows) <= q for s, q in enumerate(quotas))
        used = [sum(f.values()) for f in flows]
        assert all(u <= 3 * room for u, (room, _) in zip(used, patterns, strict=True))
        cost = sum((k // room) + 1 for u, (room, _) in zip(used, patterns, strict=True) for k in range(u))
        assert (sum(used), -cost) == least_cost(patterns, quotas, 3)


def plain_times(rows, quota, seed=M.SEED):
    """How often each (doc_id, text) of one source is taken."""
    sizes = {r: len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or "")) for r in rows}
    units = Counter()
    key = {r: int(hashlib.md5(f"{seed}|{'' if r[0] is None else r[0]}|{r[1] or ''}".encode()).hexdigest()[:15], 16) for r in rows}
    for r in rows:
        units[key[r]] += sizes[r]
    total = sum(units.values())
    passes, left = divmod(quota, total) if total else (0, 0)
    out = {}
    for k in sorted(units):
        fits = 0 < units[k] <= left
        left -= units[k] * fits
        out[k] = passes + fits
    return {r: out[key[r]] * sizes[r] for r in rows}


@pytest.mark.parametrize("rows_in_a_range", [1, 7, 20_000])
def test_selection_agrees_with_a_walk(spark, monkeypatch, rows_in_a_range):
    monkeypatch.setattr(M, "RANGE_ROWS", rows_in_a_range)
    monkeypatch.setattr(M, "PARTS", 8)
    rng = random.Random(9)
    rows = [(rng.randint(0, 150), " ".join("w" for _ in range(rng.choice([0, 1, 2, 3, 50, 400])))) for _ in range(200)] + [(None, None), (None, "a b"), (None, "c d"), (7, "same"), (7, "same")]
    df = spark.createDataFrame([(i, t, s) for s in ("a", None) for i, t in rows], "doc_id long, text string, source string")
    total = sum(len((t or "").split()) for _, t in rows)
    sized = M.materialize(M._sized(df, F.array("source"), M.SEED))
    for quota in (0, 1, total // 3, total, 2 * total + 17, 3 * total):
        mix = M.plan(sized, lambda sizes, whole, q=quota: dict.fromkeys(sizes, (q, 1)))
        got = Counter((str(r["members"]), r["key"], r["times"] * r["size"]) for r in M._times(sized, mix).collect())
        want = plain_times(rows, quota)
        for s in ("a", None):
            assert Counter(n for (m, _, n), c in got.items() for _ in range(c) if m == str([s])) == Counter(want[r] for r in rows)


def test_overlapping_sources(spark):
    """A shared pattern serves whom its own documents can't; what is fresh goes first."""
    rows = [(i, "w " * 10, ["a"]) for i in range(10)] + [(100 + i, "w " * 10, ["b", "a", "b"]) for i in range(10)] + [(200 + i, "w " * 10, ["b", None]) for i in range(10)]
    df = spark.createDataFrame(rows, "doc_id long, text string, members array<string>")
    quota = {"a": (150, 1), "b": (120, 1), None: (30, 1)}
    mix = M.plan(M._sized(df, F.col("members"), 1), lambda sizes, total: quota)
    assert mix.sizes == {"a": 200, "b": 200, None: 100}
    out = {s: sum(f.get(s, 0) for f in mix.flows.values()) for s in quota}
    assert out == {s: q for s, (q, _) in quota.items()}
    assert sum(sum(f.values()) for f in mix.flows.values()) == 300 and max(sum(f.values()) for f in mix.flows.values()) <= 100
    taken = M.mixed(df, F.col("members"), lambda sizes, total: quota, seed=1)
    assert taken.columns == df.columns and taken.count() == 30 and {r["doc_id"] for r in taken.collect()} == {r[0] for r in rows}
    twice = {"a": (300, 1), "b": (150, 1), None: (100, 1)}
    assert M.mixed(df, F.col("members"), lambda sizes, total: twice).groupBy("doc_id").count().agg(F.max("count"), F.sum("count")).first()[:] == (2, 55)


def test_odd_rows(spark, odd, empty):
    assert M.mixed(empty, F.array("source"), M.cyclic_targets()).count() == 0
    out = M.mixed(odd.withColumn("key", F.lit(1)).withColumn("rule_ranges_", F.lit(2)), F.array("source"), M.cyclic_targets())
    assert 0 < out.count() <= odd.count() and "key" in out.columns
    words = odd.select("text", M.n_words(F.col("text")).alias("n")).collect()
    assert all(r["n"] == len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or "")) for r in words)
