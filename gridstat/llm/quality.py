"""Operator 4: quality scores by random Fourier features, ridge regression and isotonic calibration.

Statistics of a document - shares of kinds of characters, word lengths,
repetition, lines - are standardised and mapped to random Fourier features,
whose inner products approximate a Gaussian kernel. Every partition sums its
part of the normal equations; the ridge solution of their sum gives raw scores,
and isotonic regression on labelled rows kept apart makes them shares of label 1.

Learning uses at most about SAMPLE_ROWS labelled rows, taken by a hash of the
id; scoring is row-local over whole texts.

Defined results: null and empty texts have the statistics of an empty text and
get a score like any other; null labels teach nothing; with nothing to learn
from, or one class only, every score is that class's share (1 if there is no
row at all); labels that repeat a doc_id count each; extra columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridstat.llm.common import crc_mod, hash_share, map_arrow, materialize, read_table, texts_of

SAMPLE_ROWS = 20_000  # labelled rows to learn from, about
CALIBRATION = 0.3  # share of them kept for calibration
FEATURES = 512  # random Fourier features
WIDTH = 3.0  # of the Gaussian kernel, in standard deviations of the statistics
RIDGE = 1.0
THRESHOLD = 0.7
SEED = 7
FIT_PARTS = 8  # partitions of the sample: as many partial sums reach the driver

STATISTICS = [
    "log_chars", "upper", "lower", "digit", "space", "newline", "other_bytes", "stops", "commas", "marks", "rare_marks", "byte_entropy",
    "log_words", "word_length", "long_words", "distinct_words", "top_word", "repeats", "lone_marks", "distinct_lines", "line_length", "first_upper",
]


def _kinds() -> np.ndarray:
    """Which kinds each byte value belongs to, one column a kind."""
    m = np.zeros((256, 10))
    groups = [range(65, 91), range(97, 123), range(48, 58), b" \t", b"\n\r", range(128, 256), b".!?", b",;:", b"#$%&*|<>=@^~\\{}[]_+/", b"!#$%&*|"]
    for k, g in enumerate(groups):
        m[list(g), k] = 1
    return m


_KINDS = _kinds()


def statistics(text: str) -> list[float]:
    """The statistics of a whole text, in the order of STATISTICS."""
    raw = text.encode("utf-8", "surrogatepass")
    n = max(1, len(raw))
    seen = np.bincount(np.frombuffer(raw, dtype=np.uint8), minlength=256)
    share = seen @ _KINDS / n
    p = seen[seen > 0] / n
    words = raw.split()
    w = max(1, len(words))
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    counts = Counter(words)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    return [
        float(np.log1p(len(raw))), *share.tolist(), float(-(p * np.log2(p)).sum()) if len(p) else 0.0,
        float(np.log1p(len(words))), float(lengths.mean()) if len(words) else 0.0, float((lengths > 20).mean()) if len(words) else 0.0,
        len(counts) / w ** 0.8, max(counts.values(), default=0) / w, sum(map(eq, words, words[1:])) / w,
        sum(n for x, n in counts.items() if not x[0] >= 128 and len(x) == 1 and not x.isalnum()) / w,
        len(set(lines)) / max(1, len(lines)), float(np.log1p(n / max(1, len(lines)))), sum(n for x, n in counts.items() if 65 <= x[0] < 91) / w,
    ]


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray  # of the random projection
    phases: np.ndarray
    beta: np.ndarray
    steps_x: np.ndarray  # isotonic calibration: raw scores and what they stand for
    steps_y: np.ndarray

    def mapped(self, x: np.ndarray) -> np.ndarray:
        """Random Fourier features of the standardised statistics, and a constant."""
        z = np.clip((x - self.mean) / self.scale, -6, 6)
        fourier = np.cos(z @ self.weights + self.phases) * np.sqrt(2.0 / len(self.phases))
        return np.hstack([fourier, np.ones((len(z), 1))])

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(self.mapped(x) @ self.beta, self.steps_x, self.steps_y), 0.0, 1.0)


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: the non-decreasing steps closest to y in the order of x, as interpolation points."""
    order = np.argsort(x, kind="stable")
    blocks: list[list[float]] = []  # sum of y, count, first x, last x
    for a, b in zip(x[order], y[order], strict=True):
        if blocks and blocks[-1][3] == a:  # ties share a value
            blocks[-1][0] += b
            blocks[-1][1] += 1
        else:
            blocks.append([b, 1, a, a])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            s, n, _, last = blocks.pop()
            blocks[-1][0] += s
            blocks[-1][1] += n
            blocks[-1][3] = last
    xs = [v for b in blocks for v in (b[2], b[3])]
    ys = [v for b in blocks for v in (b[0] / b[1],) * 2]
    return np.array(xs), np.array(ys)


def _stats_frame(docs: DataFrame) -> DataFrame:
    def task():
        def one(batch: pa.RecordBatch) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array([statistics(t) for t in texts_of(batch)], pa.list_(pa.float64()))], names=["doc_id", "x"])

        return one

    return map_arrow(docs.select("doc_id", "text"), task, "doc_id long, x array<double>")


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Model:
    """Learn from documents and their labels (doc_id, label)."""
    labels = labels.where("label is not null and doc_id is not null").select("doc_id", F.col("label").cast("double").alias("y"))
    n = labels.count()
    k = len(STATISTICS)
    taken = hash_share(F.col("doc_id"), min(1.0, sample_rows / n) if n else 1.0)
    # Statistics first: what is joined are numbers of the sampled rows only.
    rows = materialize(_stats_frame(docs.where(taken)).join(labels.where(taken), "doc_id").coalesce(FIT_PARTS))
    part = F.pmod(F.xxhash64("doc_id", F.lit("calibration")), F.lit(1000)) < int(CALIBRATION * 1000)
    moments = rows.agg(F.count("*").alias("n"), F.avg("y").alias("y"), *[f(F.col("x")[i]).alias(f"{f.__name__}{i}") for i in range(k) for f in (F.avg, F.stddev_pop)]).first()
    rng = np.random.default_rng(SEED)
    model = Model(
        np.array([moments[f"avg{i}"] or 0.0 for i in range(k)]), np.array([max(moments[f"stddev_pop{i}"] or 0.0, 1e-6) for i in range(k)]),
        rng.normal(0.0, 1.0 / WIDTH, (k, FEATURES)), rng.uniform(0, 2 * np.pi, FEATURES), np.zeros(FEATURES + 1), np.array([0.0]), np.array([1.0]),
    )
    if not moments["n"]:
        return model
    model.steps_y = np.array([moments["y"]])
    if moments["y"] in (0.0, 1.0):
        return model
    size = len(model.beta)

    def sums(batches):
        a, b = np.zeros((size, size)), np.zeros(size)
        for batch in batches:
            if batch.num_rows:
                z, y = model.mapped(np.array(batch.column(0).to_pylist())), np.array(batch.column(1).to_pylist())
                a += z.T @ z
                b += z.T @ y
        yield pa.RecordBatch.from_arrays([pa.array([a.ravel().tolist()]), pa.array([b.tolist()])], names=["a", "b"])

    partial = rows.where(~part).select("x", "y").mapInArrow(sums, "a array<double>, b array<double>").collect()
    a = np.sum([r["a"] for r in partial], axis=0).reshape(size, size)
    model.beta = np.linalg.solve(a + RIDGE * np.eye(size), np.sum([r["b"] for r in partial], axis=0))
    kept = rows.where(part).select("x", "y").collect() or rows.select("x", "y").collect()  # at most the sample
    raw = model.mapped(np.array([r["x"] for r in kept])) @ model.beta
    model.steps_x, model.steps_y = isotonic(raw, np.array([r["y"] for r in kept]))
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def task():
        def one(batch: pa.RecordBatch) -> pa.RecordBatch:
            x = np.array([statistics(t) for t in texts_of(batch)])
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(shared.value.score(x))], names=["doc_id", "score"])

        return one

    return map_arrow(docs.select("doc_id", "text"), task, "doc_id long, score double")


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score all of `documents`."""
    docs = read_table(spark, sf_dir, "documents")
    labels = read_table(spark, sf_dir, "labels").where(crc_mod("doc_id", 4) != 2).select("doc_id", F.col("quality").alias("label"))
    out = score(docs, fit(docs.where(crc_mod("doc_id", 4) != 2), labels))
    return out.select("doc_id", (crc_mod("doc_id", 4) == 2).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
