"""Operator 7: language identification by words first, then ever shorter character n-grams.

Known words score by their log frequency in each language. An unseen word falls
back to the longest order of character n-grams (of the word between boundary
marks) at which it has known ones, each order less weighty than the one above.
A document's score is the mean over its words.

Learning counts words and n-grams in Spark over a bounded sample of labelled
rows, at most about SAMPLE_DOCS for each language, taken by a hash of the id;
the model keeps the most frequent WORDS and GRAMS of each language, so its size
is bounded whatever the input. Prediction is row-local over whole texts.

Defined results: null, empty and letterless texts are `und` with score 0; so is
every text if there is nothing to learn from; ties go to the first language in
alphabetical order; extra columns are ignored by op7 and kept by the filter.
"""

from __future__ import annotations

import functools
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridstat.llm.common import below_share, crc_mod, map_arrow, materialize, read_table, texts_of

SAMPLE_DOCS = 2_500  # labelled documents a language to learn from, about
WORDS = 30_000  # known words a language
GRAMS = 20_000  # known n-grams a language, all orders
ORDERS = (5, 4, 3, 2, 1)
BACKOFF = 0.7  # weight of each order relative to the one above
CERTAIN_WORDS = 25.0  # words from which a mean counts in full
MIN_LIFT = 1.05  # the filter wants a score of so many times the chance of a guess
CACHED_WORDS = 90_000

UNKNOWN = "und"
_LETTERS = r"\p{L}[\p{L}\p{M}]*"


@functools.cache
def _pattern() -> regex.Pattern:
    return regex.compile(_LETTERS)


def words_of(text: str) -> list[str]:
    return _pattern().findall(text.lower())


def grams_of(word: str) -> list[tuple[int, str]]:
    """(order, n-gram) of a word between boundary marks; a bare mark is none."""
    w = f"^{word}$"
    return [(n, w[i : i + n]) for n in ORDERS for i in range(len(w) - n + 1) if n > 1 or 0 < i < len(w) - 1]


@dataclass
class Model:
    languages: list[str]
    words: dict[str, np.ndarray]  # log frequencies by language, less their mean
    grams: dict[str, np.ndarray]

    def word_score(self, word: str) -> np.ndarray:
        known = self.words.get(word)
        if known is not None:
            return known
        w, weight = f"^{word}$", BACKOFF
        for n in ORDERS:
            found = [g for i in range(len(w) - n + 1) if (n > 1 or 0 < i < len(w) - 1) and (g := self.grams.get(w[i : i + n])) is not None]
            if found:
                return weight * np.mean(found, axis=0)
            weight *= BACKOFF
        return np.zeros(len(self.languages), dtype=np.float32)


class Scorer:
    """Scores of texts; word scores are cached in a bounded table."""

    def __init__(self, model: Model):
        self.model = model
        self.rows = np.zeros((CACHED_WORDS, max(1, len(model.languages))), dtype=np.float32)
        self.at: dict[str, int] = {}

    def _row(self, word: str) -> int:
        at = self.at.get(word)
        if at is None:
            at = len(self.at)
            self.at[word] = at
            self.rows[at] = self.model.word_score(word)
        return at

    def predict(self, text: str) -> tuple[str, float]:
        words = words_of(text)
        if not words or not self.model.languages:
            return UNKNOWN, 0.0
        total = np.zeros(self.rows.shape[1])
        for at in range(0, len(words), 20_000):  # the table has room for the words of each step
            part = words[at : at + 20_000]
            if len(self.at) + len(part) > CACHED_WORDS:
                self.at.clear()
            get, row = self.at.get, self._row
            index = [i if (i := get(w)) is not None else row(w) for w in part]
            total += self.rows[index].sum(axis=0, dtype=np.float64)
        mean = total / len(words) * min(1.0, len(words) / CERTAIN_WORDS) * 4.0
        p = np.exp(mean - mean.max())
        best = int(np.argmax(p))
        return self.model.languages[best], float(p[best] / p.sum())


def fit(labelled: DataFrame, sample_docs: int = SAMPLE_DOCS, n_words: int = WORDS, n_grams: int = GRAMS) -> Model:
    """Learn from (doc_id, text, lang) rows; null languages and texts teach nothing."""
    labelled = labelled.where("lang is not null and text is not null").select("doc_id", "text", "lang")
    sizes = {r["lang"]: r["count"] for r in labelled.groupBy("lang").count().collect()}  # a row a language
    if not sizes:
        return Model([], {}, {})
    share = F.create_map(*[F.lit(x) for lang, n in sizes.items() for x in (lang, float(min(1.0, sample_docs / n)))])
    taken = below_share(F.xxhash64("doc_id"), share[F.col("lang")])

    def count(words: bool):
        def task():
            def one(batch: pa.RecordBatch) -> pa.RecordBatch:
                seen: Counter = Counter()
                if words:
                    for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                        seen.update((lang, w) for w in words_of(text))
                else:
                    for lang, word, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                        for _, g in grams_of(word):
                            seen[lang, g] += n
                return pa.RecordBatch.from_arrays(
                    [pa.array([k[0] for k in seen], pa.string()), pa.array([k[1] for k in seen], pa.string()), pa.array(list(seen.values()), pa.int64())],
                    names=["lang", "unit", "n"],
                )

            return one

        return task

    schema = "lang string, unit string, n long"
    word_counts = materialize(
        map_arrow(labelled.where(taken).select("lang", "text"), count(True), schema).groupBy("lang", "unit").agg(F.sum("n").alias("n"))
    )
    # Rare words tell as much about n-grams as frequent ones do: damp the counts.
    damped = word_counts.select("lang", "unit", F.ceil(F.log2(F.col("n") + 1)).cast("long").alias("n"))
    gram_counts = materialize(map_arrow(damped, count(False), schema).groupBy("lang", "unit").agg(F.sum("n").alias("n")))
    languages = sorted(sizes)
    return Model(languages, _log_frequencies(word_counts, languages, n_words, 2), _log_frequencies(gram_counts, languages, n_grams, 2))


def _log_frequencies(counts: DataFrame, languages: list[str], most: int, least: int) -> dict[str, np.ndarray]:
    """Log frequency of the most frequent units, smoothed, less the mean over languages."""
    total = {r["lang"]: r["n"] for r in counts.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    number = {lang: k for k, lang in enumerate(languages)}
    n_by: dict[str, np.ndarray] = {}
    # How many units have each count says where a language's list ends (a row a different count), so only the units
    # of the count at its end have to be put in order; those above it are kept where they are.
    ends: dict[str, tuple[int, int]] = {}
    above: dict[str, int] = {}
    for lang, n, units in counts.where(F.col("n") >= least).groupBy("lang", "n").count().orderBy("lang", F.desc("n")).collect():
        if lang not in ends:
            if above.get(lang, 0) + units >= most:
                ends[lang] = (n, most - above.get(lang, 0))
            above[lang] = above.get(lang, 0) + units
    last = F.create_map(*[F.lit(x) for lang in languages for x in (lang, ends.get(lang, (least - 1, 0))[0])])[F.col("lang")]
    room = F.create_map(*[F.lit(x) for lang in languages for x in (lang, ends.get(lang, (0, 0))[1])])[F.col("lang")]
    place = F.row_number().over(Window.partitionBy("lang").orderBy("unit"))
    kept = counts.where((F.col("n") >= least) & (F.col("n") > last)).select("lang", "unit", "n")
    tied = counts.where((F.col("n") >= least) & (F.col("n") == last)).withColumn("place", place).where(F.col("place") <= room).select("lang", "unit", "n")
    for lang, unit, n in kept.unionByName(tied).collect():
        n_by.setdefault(unit, np.zeros(len(languages)))[number[lang]] = n
    totals = np.array([float(total.get(lang, 1)) for lang in languages])
    out = {}
    for unit, n in n_by.items():
        f = np.log((n + 0.5) / (totals + 1.0))
        out[unit] = (f - f.mean()).astype(np.float32)
    return out


def _scorer_task(model: Model, spark: SparkSession):
    shared = spark.sparkContext.broadcast(model)  # at most (WORDS + GRAMS) units a language
    return lambda: Scorer(shared.value)


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, lang_pred, score) of every row."""
    make = _scorer_task(model, docs.sparkSession)

    def task():
        scorer = make()

        def one(batch: pa.RecordBatch) -> pa.RecordBatch:
            langs, scores = zip(*(scorer.predict(t) for t in texts_of(batch)), strict=True)
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(langs), pa.array(scores)], names=["doc_id", "lang_pred", "score"])

        return one

    return map_arrow(docs.select("doc_id", "text"), task, "doc_id long, lang_pred string, score double")


def keep_known(docs: DataFrame, model: Model, min_lift: float = MIN_LIFT) -> DataFrame:
    """The documents with a known language; undetermined ones and mere guesses go. All columns are kept.

    Short clean texts score low but above chance, and stay.
    """
    least = min(1.0, min_lift / max(1, len(model.languages)))
    make = _scorer_task(model, docs.sparkSession)

    def task():
        scorer = make()

        def one(batch: pa.RecordBatch) -> pa.RecordBatch:
            found = [scorer.predict(t) for t in texts_of(batch)]
            return batch.filter(pa.array([lang != UNKNOWN and score >= least for lang, score in found]))

        return one

    return map_arrow(docs, task, docs.schema)


def learnable(docs: DataFrame) -> DataFrame:
    """The rows that op7 may learn from."""
    return docs.where(crc_mod("doc_id", 3) != 1)


def op7_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predict the language of all of `documents`."""
    docs = read_table(spark, sf_dir, "documents")
    out = predict(docs, fit(learnable(docs)))
    return out.select("doc_id", (crc_mod("doc_id", 3) == 1).alias("held_out"), "lang_pred", "score")
