"""Learned operators: held-out accuracy, their parts against plain forms, and odd rows."""

import numpy as np
from pyspark.sql import functions as F

from gridstat.llm import langid, quality, toxicity
from gridstat.llm.common import crc_mod


def test_language_query_on_held_out_rows(spark, data, documents, texts):
    got = langid.op7_langid(spark, data)
    assert got.count() == len(texts)
    both = got.where("held_out").join(documents.select("doc_id", "lang"), "doc_id").toPandas()
    assert (both["lang"] == both["lang_pred"]).mean() > 0.95 and both["score"].between(0, 1).all()
    assert set(got.where("held_out").select("doc_id").toPandas()["doc_id"]) == set(documents.where(crc_mod("doc_id", 3) == 1).select("doc_id").toPandas()["doc_id"])


def test_language_backs_off_to_shorter_grams():
    m = langid.Model(["a", "b"], {"known": np.array([1.0, -1.0])}, {"^xyz": np.array([-1.0, 1.0]), "q": np.array([2.0, -2.0])})
    assert m.word_score("known")[0] == 1
    assert m.word_score("xyzzz")[1] == langid.BACKOFF**2  # order 4, the second
    assert m.word_score("q")[0] == 2 * langid.BACKOFF**5
    assert not m.word_score("www").any()


def test_language_scores_do_not_depend_on_the_cache(documents, monkeypatch, texts):
    m = langid.fit(langid.learnable(documents))
    plain = langid.Scorer(m)
    want = [plain.predict(t) for t in list(texts.values())[:40]]
    monkeypatch.setattr(langid, "CACHED_WORDS", 25_000)
    small = langid.Scorer(m)
    assert [small.predict(t) for t in list(texts.values())[:40]] == want


def test_language_of_odd_rows(spark, odd, empty, documents):
    m = langid.fit(langid.learnable(documents))
    out = {r["doc_id"]: r for r in langid.predict(odd, m).collect()}
    assert all(out[i]["lang_pred"] == "und" and out[i]["score"] == 0 for i in (3, 4, 5, 6)) and out[1]["lang_pred"] != "und"
    kept = langid.keep_known(odd, m)
    assert kept.columns == odd.columns and not {3, 4, 5, 6} & {r["doc_id"] for r in kept.collect()}
    assert langid.predict(empty, m).count() == 0
    none = langid.fit(empty)
    assert {r["lang_pred"] for r in langid.predict(odd, none).collect()} == {"und"}


def plain_language_model(rows):
    """Counts of words and n-grams by plain loops, then log frequencies less their mean."""
    languages = sorted({lang for _, lang in rows})
    words = {lang: {} for lang in languages}
    for text, lang in rows:
        for w in langid.words_of(text):
            words[lang][w] = words[lang].get(w, 0) + 1
    grams = {lang: {} for lang in languages}
    for lang in languages:
        for w, n in words[lang].items():
            for _, g in langid.grams_of(w):
                grams[lang][g] = grams[lang].get(g, 0) + int(np.ceil(np.log2(n + 1)))

    def log_frequencies(counts, most):
        kept = {lang: dict(sorted(((u, n) for u, n in c.items() if n >= 2), key=lambda x: (-x[1], x[0].encode()))[:most]) for lang, c in counts.items()}
        totals = np.array([sum(counts[lang].values()) for lang in languages], dtype=float)
        out = {}
        for u in set().union(*kept.values()):
            f = np.log((np.array([kept[lang].get(u, 0) for lang in languages]) + 0.5) / (totals + 1.0))
            out[u] = f - f.mean()
        return out

    return languages, log_frequencies(words, langid.WORDS), log_frequencies(grams, langid.GRAMS)


def test_language_query_agrees_with_a_plain_version(spark, data, documents, texts):
    learn = [(r["text"], r["lang"]) for r in documents.where(crc_mod("doc_id", 3) != 1).collect() if r["text"] is not None and r["lang"]]
    languages, words, grams = plain_language_model(learn)  # fewer rows than the sample's bound

    def of(word):
        if word in words:
            return words[word]
        weight = langid.BACKOFF
        for n in langid.ORDERS:
            known = [grams[g] for k, g in langid.grams_of(word) if k == n and g in grams]
            if known:
                return weight * np.mean(known, axis=0)
            weight *= langid.BACKOFF
        return np.zeros(len(languages))

    got = {r["doc_id"]: r for r in langid.op7_langid(spark, data).collect()}
    assert set(got) == set(texts)
    for i, text in texts.items():
        found = langid.words_of(text or "")
        if not found:
            assert (got[i]["lang_pred"], got[i]["score"]) == ("und", 0.0)
            continue
        mean = np.sum([of(w) for w in found], axis=0) / len(found) * min(1.0, len(found) / langid.CERTAIN_WORDS) * 4.0
        p = np.exp(mean - mean.max())
        p /= p.sum()
        assert abs(p.max() - got[i]["score"]) < 1e-4 and abs(p[languages.index(got[i]["lang_pred"])] - p.max()) < 1e-4


def test_quality_query_agrees_with_a_plain_version(spark, data, documents, texts):
    labels = {r["doc_id"]: float(r["quality"]) for r in spark.read.parquet(f"{data}/labels.parquet").where(crc_mod("doc_id", 4) != 2).collect() if r["quality"] is not None}
    share = F.pmod(F.xxhash64("doc_id", F.lit("calibration")), F.lit(1000)) < int(quality.CALIBRATION * 1000)
    kept = {r["doc_id"]: r["kept"] for r in documents.where(crc_mod("doc_id", 4) != 2).select("doc_id", share.alias("kept")).collect()}
    ids = sorted(set(labels) & set(kept))
    x = {i: np.array(quality.statistics(t or "")) for i, t in texts.items()}
    own = np.array([x[i] for i in ids])
    mean, scale = own.mean(axis=0), np.maximum(own.std(axis=0), 1e-6)
    rng = np.random.default_rng(quality.SEED)
    weights, phases = rng.normal(0, 1 / quality.WIDTH, (len(mean), quality.FEATURES)), rng.uniform(0, 2 * np.pi, quality.FEATURES)
    mapped = lambda v: np.append(np.cos(np.clip((v - mean) / scale, -6, 6) @ weights + phases) * np.sqrt(2 / quality.FEATURES), 1.0)
    z, y = np.array([mapped(x[i]) for i in ids if not kept[i]]), np.array([labels[i] for i in ids if not kept[i]])
    beta = np.linalg.solve(z.T @ z + quality.RIDGE * np.eye(z.shape[1]), z.T @ y)
    raw = sorted((float(mapped(x[i]) @ beta), labels[i]) for i in ids if kept[i])
    # The isotonic value of a score: the largest of the least means around it.
    v = np.array([b for _, b in raw])
    fitted = [max(min(v[a:b].mean() for b in range(k + 1, len(v) + 1)) for a in range(k + 1)) for k in range(len(v))]
    got = {r["doc_id"]: r["score"] for r in quality.op4_quality(spark, data).collect()}
    assert set(got) == set(texts)
    for i in texts:
        assert abs(got[i] - np.clip(np.interp(mapped(x[i]) @ beta, [a for a, _ in raw], fitted), 0, 1)) < 1e-6, i


def test_quality_query_on_held_out_rows(spark, data, texts):
    got = quality.op4_quality(spark, data)
    assert got.count() == len(texts)
    labels = spark.read.parquet(f"{data}/labels.parquet")
    both = got.where("held_out").join(labels, "doc_id").toPandas()
    assert (both["predicted"] == both["quality"]).mean() > 0.9
    assert (got.toPandas().eval("(score >= 0.7) == (predicted == 1)")).all()


def test_random_features_approximate_the_kernel():
    rng = np.random.default_rng(1)
    k = len(quality.STATISTICS)
    m = quality.Model(np.zeros(k), np.ones(k), rng.normal(0, 1 / quality.WIDTH, (k, 20_000)), rng.uniform(0, 2 * np.pi, 20_000), np.zeros(0), np.zeros(1), np.zeros(1))
    x = rng.normal(size=(5, k))
    z = m.mapped(x)[:, :20_000]
    want = np.exp(-((x[:, None] - x[None]) ** 2).sum(axis=2) / (2 * quality.WIDTH**2))
    assert np.abs(z @ z.T - want).max() < 0.05


def test_isotonic_is_monotone_and_pools():
    x, y = quality.isotonic(np.array([3.0, 1.0, 2.0, 4.0]), np.array([0.0, 1.0, 0.0, 1.0]))
    assert np.all(np.diff(y) >= 0) and y[-1] > y[0]
    assert len(quality.isotonic(np.array([1.0, 1.0]), np.array([0.0, 1.0]))[0]) == 2


def test_statistics_of_any_text(odd):
    for r in odd.collect():
        s = quality.statistics(r["text"] or "")
        assert len(s) == len(quality.STATISTICS) and np.all(np.isfinite(s))


def test_quality_of_odd_rows_and_of_nothing_to_learn(spark, odd, empty):
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, None), (8, 1)], "doc_id long, label int")
    out = quality.score(odd, quality.fit(odd, labels)).collect()
    assert len(out) == odd.count() and all(0 <= r["score"] <= 1 for r in out)
    assert {r["score"] for r in quality.score(odd, quality.fit(odd, labels.limit(0))).collect()} == {1.0}
    assert {r["score"] for r in quality.score(odd, quality.fit(odd, labels.where("label = 0"))).collect()} == {0.0}
    assert quality.score(empty, quality.fit(empty, labels)).count() == 0


def test_toxicity_gradients_agree_with_differences():
    rng = np.random.default_rng(2)
    w = {k: v.astype(np.float64) * 2 for k, v in toxicity.start_weights(12).items()}
    words, own = ["abc", "schrecklich", "x"], np.array([3, 0, 12])
    ids, y = np.full((2, toxicity.STEPS), -1), np.array([1.0, 0.0])
    ids[0, :5], ids[1, :2] = [0, 1, 2, 1, 0], [2, 0]
    _, g = toxicity.gradients(w, words, own, ids, y)
    places = [(k, tuple(int(rng.integers(n)) for n in w[k].shape)) for k in w for _ in range(2)]
    places += [("word", (0, 1)), ("word", (12, 3)), ("char", (ord("c"), 2)), ("char", (ord("x"), 5))]
    for name, at in places:
        step = 1e-4
        up, down = ({k: v.copy() for k, v in w.items()} for _ in range(2))
        up[name][at] += step
        down[name][at] -= step
        slope = (toxicity.gradients(up, words, own, ids, y)[0] - toxicity.gradients(down, words, own, ids, y)[0]) / (2 * step)
        assert abs(slope - g[name][at]) < 1e-6 + 1e-3 * abs(slope), (name, at, slope, g[name][at])


def plain_gru(rows, u, size):
    """States of a gated recurrent network, step by step."""
    s, out = np.zeros(size), []
    for x in rows:
        a = s @ u
        r, z = 1 / (1 + np.exp(-(x[:size] + a[:size]))), 1 / (1 + np.exp(-(x[size : 2 * size] + a[size : 2 * size])))
        s = s + (1 - z) * (np.tanh(x[2 * size :] + r * a[2 * size :]) - s)
        out.append(s)
    return out


def plain_logit(m, text):
    """The largest logit of a text's windows: no batches, no tables, no padding."""
    w, h, k = {n: v.astype(np.float64) for n, v in m.weights.items()}, toxicity.HIDDEN, toxicity.CHAR_HIDDEN
    words, inputs = toxicity.words_of(text), {}
    for x in set(words):
        rows = [w["char"][ord(c) % toxicity.CHARS] @ w["char_w"] + w["char_b"] for c in x]
        spelt = [plain_gru([r[: 3 * k] for r in rows], w["char_u"][0], k)[-1], plain_gru([r[3 * k :] for r in rows[::-1]], w["char_u"][1], k)[-1]]
        inputs[x] = np.concatenate([w["word"][m.vocabulary.get(x, 0)], *spelt]) @ w["w"] + w["b"]
    best = -np.inf
    for s in toxicity.windows_of(len(words)):
        rows = [inputs[x] for x in words[s : s + toxicity.STEPS]]
        states = np.hstack([plain_gru([r[: 3 * h] for r in rows], w["u"][0], h), plain_gru([r[3 * h :] for r in rows[::-1]], w["u"][1], h)[::-1]])
        a = np.exp(states @ w["attend"])
        best = max(best, (a / a.sum()) @ states @ w["out"] + w["bias"][0])
    return best


def test_toxicity_query_agrees_with_a_plain_version(spark, data, documents, texts):
    """Learning task by task without Spark, and scoring word by word, against the query."""
    rows = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{data}/labels.parquet").where(crc_mod("doc_id", 5) != 0).collect()}
    learn = documents.where(crc_mod("doc_id", 5) != 0).join(spark.createDataFrame(list(rows.items()), "doc_id long, y int"), "doc_id")
    dealt = learn.select("doc_id", "text", "y", toxicity.part_of(F.col("doc_id"), toxicity.parts_of(learn.count())).alias("part"))
    parts = {}
    for r in sorted(dealt.collect(), key=lambda r: r["doc_id"]):  # no more than the sample's bound: all of them are learned from
        parts.setdefault(r["part"], []).append((toxicity.words_of(r["text"] or ""), r["y"]))
    held = {}
    for docs in parts.values():
        for words, _ in docs:
            for x in set(words):
                held[x] = held.get(x, 0) + 1
    common = sorted((x for x in held if held[x] >= toxicity.WORD_DOCS), key=lambda x: (-held[x], x.encode()))[: toxicity.VOCABULARY]
    m = toxicity.Model({x: i for i, x in enumerate(common, 1)}, constant=None)
    state = toxicity.State.new(len(common))
    epoch = 0
    while toxicity.goes_on(epoch, state):
        state, epoch = toxicity.mixed([toxicity.train_part(state, m.vocabulary, parts[p], epoch) for p in sorted(parts)]), epoch + 1
    m.weights = state.w
    logits = {i: plain_logit(m, t or "") for i, t in texts.items()}
    # Calibration: the same logistic fit, by small steps.
    x, y = np.array([logits[i] for i in rows if np.isfinite(logits[i])]), np.array([rows[i] for i in rows if np.isfinite(logits[i])])
    got = {r["doc_id"]: r["score"] for r in toxicity.op9_toxicity(spark, data).collect()}
    assert set(got) == set(texts)
    finite = sorted(i for i in logits if np.isfinite(logits[i]))
    z, s = np.array([logits[i] for i in finite]), np.array([got[i] for i in finite])
    inner = (s > 1e-6) & (s < 1 - 1e-6)
    slope, offset = np.polyfit(z[inner], np.log(s[inner] / (1 - s[inner])), 1)
    assert slope > 0 and np.abs(1 / (1 + np.exp(-(slope * z + offset))) - s).max() < 1e-3
    loss = lambda a, b: np.mean(np.logaddexp(0, a * x + b) - y * (a * x + b))
    assert all(loss(slope, offset) <= loss(slope * k, offset + d) + 2e-2 for k in (0.8, 1, 1.25) for d in (-0.5, 0, 0.5))


def test_scoring_agrees_with_the_training_form():
    m = toxicity.Model({f"w{i}x{i % 5}": i + 1 for i in range(9)}, {k: v * 2 for k, v in toxicity.start_weights(9).items()}, constant=None)
    text = " ".join(f"w{i % 17}x{i % 5}" for i in range(200)) + " " + "long" * 30
    want = plain_logit(m, text)
    assert abs(toxicity.Scorer(m).logits([text, ""])[0] - want) < 1e-3
    words = toxicity.words_of(text)
    names = sorted(set(words))
    ids = np.full((len(toxicity.windows_of(len(words))), toxicity.STEPS), -1)
    for row, s in zip(ids, toxicity.windows_of(len(words)), strict=True):
        part = [names.index(x) for x in words[s : s + toxicity.STEPS]]
        row[: len(part)] = part
    assert abs(toxicity._local_logits(m.weights, names, m.own(names), ids).max() - want) < 1e-3


def test_windows_cover_all_words():
    for n in (1, 47, 48, 49, 80, 81, 1000):
        s = toxicity.windows_of(n)
        assert {i for a in s for i in range(a, min(n, a + toxicity.STEPS))} == set(range(n))
    assert toxicity.windows_of(0) == []


def test_toxicity_learns_words_and_leaves_others_alone(spark):
    rng = np.random.default_rng(3)
    plain = [f"{a}{b}" for a in ("lo", "mi", "ra", "te") for b in ("na", "so", "ku", "pe")]
    rows = []
    for i in range(240):
        words = list(rng.choice(plain, rng.integers(20, 150)))
        if i % 3 == 0:
            for k in rng.integers(0, len(words), 3):
                words[k] = rng.choice(["vile", "awful", "nasty"])
        rows.append((i, " ".join(words), int(i % 3 == 0)))
    df = spark.createDataFrame(rows, "doc_id long, text string, label int")
    m = toxicity.fit(df.where("doc_id < 180"), df.select("doc_id", "label").where("doc_id < 180"))
    out = toxicity.score(df.where("doc_id >= 180"), m).join(df, "doc_id").toPandas()
    assert ((out["score"] >= 0.5) == (out["label"] == 1)).mean() > 0.9


def test_toxicity_of_odd_rows_and_of_nothing_to_learn(spark, odd, empty):
    labels = spark.createDataFrame([(1, 1), (7, 0), (3, None)], "doc_id long, label int")
    out = toxicity.score(odd, toxicity.fit(odd, labels)).collect()
    assert len(out) == odd.count() and all(0 <= r["score"] <= 1 for r in out)
    for none, want in ((labels.limit(0), 0.0), (labels.where("label = 1"), 1.0), (labels.where("label = 0"), 0.0)):
        assert {r["score"] for r in toxicity.score(odd, toxicity.fit(odd, none)).collect()} == {want}
    assert toxicity.score(empty, toxicity.fit(odd, labels)).count() == 0
    assert odd.where(F.col("doc_id") == 1).count() == 1
