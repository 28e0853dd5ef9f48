"""The pipeline against its stages in plain Python, and stage by stage on odd rows."""

import hashlib

import corpus_pipeline
from test_dedup import brute_components, brute_fingerprint
from tokenizers import Tokenizer

from gridstat.llm import bpe, decontaminate, langid, pii


def test_run_agrees_with_plain_stages(spark, data, documents):
    rows = {r["doc_id"]: r["text"] for r in documents.collect()}
    model = langid.fit(langid.learnable(documents))
    scorer, least = langid.Scorer(model), langid.MIN_LIFT / len(model.languages)
    kept = {i: t for i, t in rows.items() if (p := scorer.predict(t or ""))[0] != "und" and p[1] >= least}
    ids = sorted(kept)
    roots = brute_components([brute_fingerprint(kept[i]) for i in ids], ids)
    kept = {i: kept[i] for i, root in zip(ids, roots, strict=True) if i == root}
    bench = [(str(r["item_id"]), decontaminate.words_of(r["text"])) for r in spark.read.parquet(f"{data}/benchmark.parquet").collect()]
    windows = {tuple(w[j : j + 10]) for _, w in bench for j in range(len(w) - 9)}
    clean = {}
    for i, t in kept.items():
        w = decontaminate.words_of(t)
        hit = {p for j in range(len(w) - 9) if tuple(w[j : j + 10]) in windows for p in range(j, j + 10)}
        if len(hit) <= decontaminate.MAX_COVERAGE * len(w):
            spans, inside = [], False
            for p in range(len(w) + 1):
                if (p in hit) != inside:
                    spans.append([p]) if not inside else spans[-1].append(p)
                    inside = not inside
            clean[i] = decontaminate.cut_spans(t, spans)
    df = spark.createDataFrame(list(clean.items()), "doc_id long, text string")
    private = {r["doc_id"]: r["text"] for r in pii.pseudonymize(df, pii.KEY).collect()}
    library = Tokenizer.from_file(bpe.default_vocabulary())
    want = {i: hashlib.sha256(" ".join(map(str, library.encode(t, add_special_tokens=False).ids)).encode()).hexdigest() for i, t in private.items()}
    got = {r["doc_id"]: r["ids_sha256"] for r in corpus_pipeline.run(spark, data).collect()}
    assert got == want and len(got) < len(rows)


def test_contamination_is_gone(spark, data, documents):
    bench = spark.read.parquet(f"{data}/benchmark.parquet")
    before = decontaminate.matches(documents, bench).where("size(spans) > 0").count()
    clean = decontaminate.remove_contamination(documents, bench)
    left = decontaminate.matches(clean, bench).where("size(spans) > 0").count()
    assert before > 0 and left == 0


def test_stages_take_odd_rows(spark, data, odd, empty):
    for docs in (odd, empty):
        now = docs
        for _, stage in corpus_pipeline.STAGES[:-1]:
            now = stage(spark, now, data)
            assert now.columns == docs.columns
        assert corpus_pipeline.STAGES[-1][1](spark, now, data).columns[0] == "doc_id"
        now.count()
