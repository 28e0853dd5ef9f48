"""Training of codebooks and the ladder of resets against plain loops."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridstat.operators import codebook as C
from gridstat.operators import resets as L
from gridstat.plans import codes as P
from gridstat.sources.steps import Steps
from gridstat.streaming import resets as T


def plain_step(x, e, size, weight, decay, eps):
    near = ((x[:, None] - e[None]) ** 2).sum(2).argmin(1)
    n = np.bincount(near, minlength=len(e)).astype(float)
    sums = np.zeros_like(e)
    np.add.at(sums, near, x)
    size = decay * size + (1 - decay) * n
    size = (size + eps) / (size.sum() + len(e) * eps) * size.sum() if size.sum() else size
    weight = decay * weight + (1 - decay) * sums
    return (weight / size[:, None] if size.sum() else e), size, weight, n, ((x - e[near]) ** 2).sum()


@pytest.mark.parametrize("dims", [3, 300])
def test_training_agrees_with_a_loop(spark, tmp_path, dims):
    rng = np.random.default_rng(1)
    x, e = rng.normal(size=(120, dims)), rng.normal(size=(6, dims))
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vec array<double>")
    book = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(e)], "code int, vec array<double>")
    kept = C.train(vectors, book, 3, 0.8, 1e-3, folder=f"file://{tmp_path}/job")
    size, weight = np.zeros(6), e.copy()
    for i in range(1, 4):
        e, size, weight, n, error = plain_step(x, e, size, weight, 0.8, 1e-3)
        got = kept.read(i).orderBy("code").collect()
        np.testing.assert_allclose([r["vec"] for r in got], e, rtol=1e-9)
        np.testing.assert_allclose([r["size"] for r in got], size, rtol=1e-9)
        assert [r["n"] for r in got] == n.tolist()
        np.testing.assert_allclose(C.quantisation_error(kept.read(i)).first()[0], error / x.size, rtol=1e-9)


def test_training_goes_on_from_its_last_whole_step(spark, tmp_path):
    rng = np.random.default_rng(2)
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rng.normal(size=(50, 2)))], "id long, vec array<double>")
    book = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rng.normal(size=(3, 2)))], "code int, vec array<double>")
    whole = C.train(vectors, book, 3, folder=f"file://{tmp_path}/whole")
    cut = C.train(vectors, book, 2, folder=f"file://{tmp_path}/cut")
    cut.read(1).limit(1).write.parquet(f"{cut.folder}/step-000003/part")  # a step that a lost driver left without its mark
    assert cut.last() == 2
    again = C.train(vectors, book, 3, folder=cut.folder)
    assert again.read(3).orderBy("code").collect() == whole.read(3).orderBy("code").collect()
    again.keep_only(3)
    assert Steps(spark, cut.folder).last() == 3 and not again.whole(1)


def test_groups_have_their_own_codebooks_and_no_rows_change_nothing(spark):
    rng = np.random.default_rng(3)
    rows = [(g, i, rng.normal(size=2).tolist()) for g in "ab" for i in range(40)]
    books = [(g, c, rng.normal(size=2).tolist()) for g in "abc" for c in range(3)]
    vectors, book = spark.createDataFrame(rows, "g string, id int, vec array<double>"), spark.createDataFrame(books, "g string, code int, vec array<double>")
    both = C.step(vectors, C.initial_state(book, ["g"]), 0.9, by=["g"])
    for g in "ab":
        alone = C.step(vectors.where(F.col("g") == g), C.initial_state(book.where(F.col("g") == g)), 0.9)
        assert both.where(F.col("g") == g).drop("g").orderBy("code").collect() == alone.select("code", "vec", "size", "weight", "n", "error").orderBy("code").collect()
    none = both.where("g = 'c'").orderBy("code").collect()
    assert [r["vec"] for r in none] == [b[2] for b in books if b[0] == "c"] and {r["n"] for r in none} == {0}


@pytest.mark.parametrize("rows", [5, 400])
def test_dead_codes_move_to_drawn_vectors(spark, rows):
    rng = np.random.default_rng(4)
    sizes = [0.0, 0.0, 0.0, 0.0, 0.0, 3.0, 4.0, 5.0, 6.0, 7.0, 8.0, 9.0]
    state = spark.createDataFrame([(i, [float(i)] * 2, s, [0.0, 0.0]) for i, s in enumerate(sizes)], "code int, vec array<double>, size double, weight array<double>")
    x = rng.normal(size=(rows, 2)).tolist()
    vectors = spark.createDataFrame(list(enumerate(x)), "id long, vec array<double>")
    out = {r["code"]: r for r in C.reset_dead(state, vectors, "id", percent=30.0, most=0.25, seed=1).collect()}
    moved = sorted(c for c, r in out.items() if r["moved"])
    assert moved == [0, 1, 2] and all(out[c]["size"] == 3.0 and out[c]["vec"] in x and out[c]["weight"] == out[c]["vec"] for c in moved)
    assert len({tuple(out[c]["vec"]) for c in moved}) == 3 and out[4]["vec"] == [4.0, 4.0] and out[4]["size"] == 0.0
    assert C.reset_dead(state, vectors, "id", percent=30.0, most=0.25, seed=1).where("moved").orderBy("code").select("vec").collect() == [(out[c]["vec"],) for c in moved]
    few = {r["code"]: r["moved"] for r in C.reset_dead(state, vectors.limit(2), "id", percent=30.0, seed=1).collect()}
    assert sum(few.values()) == 2 and len(few) == 12


def plain_ladder(rows, rules=L.Ladder()):  # noqa: B008
    """Resets of one run's (epoch, utilization, loss, stale, categories), rule by rule."""
    utils, losses, last, out = [], [], 0, []
    for epoch, u, loss, stale, categories in sorted(rows, key=lambda r: r[0]):
        if epoch == 0:
            continue
        utils.append(u)
        losses.append(loss)
        interval = rules.interval * (1 if epoch < 100 else 2 if epoch < 200 else 4)

        def reason(epoch=epoch, u=u, stale=stale, categories=categories, interval=interval):
            if epoch - last >= max(interval // 2, 25):
                for util, n in categories:
                    limit = 0.10 if n is None else 0.05 if n <= 5 else 0.05 + (n - 5) * 0.005 if n <= 15 else 0.10 + (n - 15) * 0.0014 if n <= 50 else 0.15
                    if util < limit:
                        return "category"
            if len(utils) >= 20 and epoch > 20 and sum(utils[-20:-10]) / 10 - sum(utils[-10:]) / 10 > 0.05 and epoch - last >= 10:
                return "collapse"
            if epoch - last < interval:
                return None
            if u < 0.15:
                return "emergency"
            if u > rules.low:
                return None
            b = rules.lookback
            if len(utils) >= 2 * b:
                recent, before = sum(utils[-b:]) / b, sum(utils[-2 * b : -b]) / b
                if not (recent < before - 0.01 or (recent < rules.low and abs(recent - before) < 0.01)):
                    return None
                if sum(losses[-2 * b : -b]) / b - sum(losses[-b:]) / b > 0.005:
                    return None
            return "low" if stale <= 30 else None

        why = reason()
        if why:
            last = epoch
            out.append((epoch, why))
    return out


SCHEMA = "run string, epoch long, utilization double, loss double, stale int, categories array<struct<utilization: double, features: int>>"


def runs():
    rng = random.Random(8)
    out = {}
    for k in range(12):
        u, rows = rng.choice([0.12, 0.2, 0.24, 0.4]), []
        for epoch in range(0, 420, rng.choice([1, 1, 2])):
            u = min(0.9, max(0.02, u + rng.gauss(-0.001 if k % 3 else -0.004, 0.01)))
            u = 0.35 if rng.random() < 0.005 else u
            rows.append((epoch, u, 1 / (1 + epoch * (k % 2) / 50), rng.randint(0, 35), [(rng.random() + 0.12 * (k > 5), rng.choice([3, 5, 9, 15, 40, 80, None])) for _ in range(k % 3)]))
        out[f"r{k}"] = rows
    return out


def test_ladder_agrees_with_its_rules(spark):
    every = runs()
    df = spark.createDataFrame([(k, *r) for k, rows in every.items() for r in rows], SCHEMA).repartition(5)
    got: dict = {}
    for r in L.resets(df).orderBy("run", "epoch").collect():
        got.setdefault(r["run"], []).append((r["epoch"], r["reason"]))
        assert r["percent"] == (10.0 if r["epoch"] < 100 else 7.0 if r["epoch"] < 200 else 5.0)
    assert got == {k: v for k, rows in every.items() if (v := plain_ladder(rows))}
    assert {w for v in got.values() for _, w in v} == {"category", "collapse", "emergency", "low"}
    assert L.resets(df.limit(0)).count() == 0


def test_stream_gives_the_same_resets(spark, tmp_path):
    every = runs()
    rows = [(k, *r) for k, of in every.items() for r in of]
    for part, (a, b) in enumerate([(0, 60), (60, 61), (61, 230), (230, 500)]):
        spark.createDataFrame([r for r in rows if a <= r[1] < b], SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/in/part={part}")
    s = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(f"{tmp_path}/in/part=*")
    q = T.resets(s).writeStream.format("memory").queryName("ladder").outputMode("append").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
    q.awaitTermination(300)
    want = L.resets(spark.createDataFrame(rows, SCHEMA)).select("run", "epoch", "reason")
    assert sorted(map(tuple, spark.table("ladder").collect())) == sorted(map(tuple, want.collect()))


def test_history_has_an_epoch_an_hour(spark, data):
    h = P.history(spark, data)
    assert h.groupBy("run", "epoch").count().where("count > 1").isEmpty() and h.agg(F.max("epoch")).first()[0] < 24 * 31
