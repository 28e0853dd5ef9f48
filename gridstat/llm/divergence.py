"""Source divergence audit: how the word use of each source of a language differs from its other sources'.

Terms are runs of letters; a language keeps those found in enough of its documents.
A group (a language's source) gives each kept term a smoothed share in exact integer
arithmetic, and two groups differ by the sum of a chi-square distance over all kept terms.

Many terms have the same counts in all sources, so count columns are deduplicated: terms
are grouped by their sparse vector of (source, count), every pair of sources is evaluated
once for each distinct vector, and the value is multiplied by the number of terms that have
it. The terms that set a group apart from its language are ranked as they are.

Work: tasks count the terms of their own documents, so what is shuffled are a task's
distinct terms a group. Vectors are dealt by their hash, whatever their language; a task
hands on sums a pair of sources. Only the groups' totals (at most `MAX_GROUPS`, checked)
pass the driver. A long text is counted in slices.

Defined results: null text, language and source read as the empty string; a document is a
row, repeated rows count each; a group without terms has pairs and no terms; a language
without kept terms has pairs of value 0; a language with one source has no pairs; an empty
table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridstat.llm.common import materialize, read_table, small_batches

#: Documents of a language that a term must occur in.
LEAST_DOCS = 3
#: Shares are integers of this many parts.
PARTS = 1_000_000_000
#: Terms of a group that are reported.
TOP = 200
#: Groups (languages times their sources) whose totals a task holds; the result has a row for each pair of them.
MAX_GROUPS = 100_000

#: (group, term) entries that a task holds before it hands rare ones on; entries that occurred so often stay.
HELD, FREQUENT = 400_000, 32
#: Bytes of a text that are split at a time.
SLICE = 1 << 20

#: Letters and all bytes beyond ASCII are a term's; A to Z become a to z; the rest separates.
_FOLD = bytes(b if b >= 0x80 or 0x61 <= b <= 0x7A else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))

_COUNTED = "lang string, source string, term binary, n long, docs long"
_KINDS = [pa.string(), pa.string(), pa.binary(), pa.int64(), pa.int64()]


def slices_of(text: bytes, size: int = SLICE) -> Iterator[list[bytes]]:
    """The terms of a text, a list for each slice; no term is cut."""
    folded, at = text.translate(_FOLD), 0
    while at < len(folded):
        end = folded.find(b" ", at + size)
        end = len(folded) if end < 0 else end
        yield folded[at:end].split()
        at = end


class _Counts:
    """Counts of terms and of their documents by group, with a bound on what is held."""

    def __init__(self):
        self.groups: dict[tuple[str, str], tuple[Counter, Counter]] = {}
        self.held = 0

    def add(self, group: tuple[str, str], text: bytes) -> None:
        terms, docs = self.groups.setdefault(group, (Counter(), Counter()))
        before, seen = len(terms), set()
        for words in slices_of(text):
            terms.update(words)
            seen.update(words)
        docs.update(seen)
        self.held += len(terms) - before

    def drain(self, all_of_them: bool) -> Iterator[pa.RecordBatch]:
        for (lang, source), (terms, docs) in self.groups.items():
            gone = [(t, n) for t, n in terms.items() if all_of_them or n < FREQUENT]
            for at in range(0, len(gone), 20_000):
                some = gone[at : at + 20_000]
                columns = ([lang] * len(some), [source] * len(some), [t for t, _ in some], [n for _, n in some], [docs[t] for t, _ in some])
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, _KINDS, strict=True)], names=[c.split()[0] for c in _COUNTED.split(", ")])
            for t, _ in gone:
                del terms[t], docs[t]
        self.held = sum(len(terms) for terms, _ in self.groups.values())


def _plain(documents: DataFrame) -> DataFrame:
    return documents.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")))


def term_counts(documents: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): occurrences of every term in every group, and the documents that have it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = _Counts()
        for batch in batches:
            lang, source, text = (batch.column(i) for i in range(3))
            for i in range(batch.num_rows):
                counts.add((lang[i].as_py(), source[i].as_py()), text[i].as_py())
                if counts.held > HELD:
                    yield from counts.drain(False)
                    if counts.held > HELD // 2:
                        yield from counts.drain(True)
        yield from counts.drain(True)

    small_batches(documents.sparkSession)
    made = _plain(documents).withColumn("text", F.col("text").cast("binary")).mapInArrow(run, _COUNTED)
    return made.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def count_vectors(documents: DataFrame, least_docs: int = LEAST_DOCS) -> DataFrame:
    """(lang, term, vector, total): the kept terms, each with its counts in the sources that have it, in order of the source."""
    by_term = term_counts(documents).groupBy("lang", "term").agg(
        F.sum("docs").alias("docs"), F.sum("n").alias("total"), F.sort_array(F.collect_list(F.struct("source", "n"))).alias("vector")
    )
    return by_term.where(F.col("docs") >= least_docs).select("lang", F.col("term").cast("string").alias("term"), "vector", "total")


def share(count: Column, total: Column, parts: int = PARTS) -> Column:
    """1 + floor(parts * (count + 1) / total), exact for counts to 2^53: a long division of three digits a step."""

    def div(x: Column, y: Column) -> Column:
        return F.call_function("div", x, y)

    digits = len(str(parts)) - 1
    if digits % 3 or parts != 10**digits:
        raise ValueError("parts must be a power of 1000")
    whole, rest = div(count + 1, total), (count + 1) % total
    for _ in range(digits // 3):
        whole, rest = whole * 1000 + div(rest * 1000, total), (rest * 1000) % total
    return whole + 1


def shares(count: np.ndarray, total: np.ndarray, parts: int = PARTS) -> np.ndarray:
    """share() for arrays."""
    whole, rest = np.divmod(count + 1, total)
    for _ in range((len(str(parts)) - 1) // 3):
        digit, rest = np.divmod(rest * 1000, total)
        whole = whole * 1000 + digit
    return whole + 1


def _pair_sums(vectors: DataFrame, groups: dict[str, tuple[list[str], list[int]]]) -> DataFrame:
    """(lang, source, item, value): parts of every pair's sum, from distinct vectors with their multiplicity."""

    def sums(lang: str, rows: pa.RecordBatch) -> tuple[list, list, list, list]:
        sources, totals = groups[lang]
        known, total, s = pa.array(sources, pa.string()), np.array(totals, np.int64), len(sources)
        out = np.zeros((s, s), np.int64)
        step = max(1, 2_000_000 // s)
        for at in range(0, rows.num_rows, step):
            part = rows.slice(at, step)
            lists = part.column(1)
            entries = lists.flatten()
            lengths = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
            counts = np.zeros((part.num_rows, s), np.int64)
            where = pc.index_in(entries.field(0), value_set=known).to_numpy(zero_copy_only=False)
            counts[np.repeat(np.arange(part.num_rows), lengths), where] = entries.field(1).to_numpy(zero_copy_only=False)
            p, times = shares(counts, total), part.column(2).to_numpy(zero_copy_only=False)
            for g in range(s):
                apart = p[:, g : g + 1] - p
                out[g] += times @ (apart * apart // p)
        g, h = np.nonzero(out)
        return [lang] * len(g), [sources[i] for i in g], [sources[i] for i in h], out[g, h].tolist()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lang in pc.unique(batch.column(0)).to_pylist():
                found = sums(lang, batch.filter(pc.equal(batch.column(0), lang)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(found, [pa.string(), pa.string(), pa.string(), pa.int64()], strict=True)], names=["lang", "source", "item", "value"]
                )

    made = vectors.select("lang", "vector", "times").mapInArrow(run, "lang string, source string, item string, value long")
    return made.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))


def audit(documents: DataFrame, least_docs: int = LEAST_DOCS, top: int = TOP) -> DataFrame:
    """(lang, source, part, item, value, rank): each group against every other source of its language (part `pair`)
    and the terms that it uses more than its language does (part `term`, the first `top`)."""
    spark = documents.sparkSession
    kept = materialize(count_vectors(documents, least_docs))
    every = _plain(documents).select("lang", "source").distinct()
    entries = kept.select("lang", "term", "total", F.explode("vector").alias("e")).select("lang", "term", "total", "e.source", "e.n")
    sums = entries.groupBy("lang", "source").agg(F.sum("n").alias("n"))
    size = kept.groupBy("lang").agg(F.count("*").alias("v"), F.sum("total").alias("whole"))
    known = every.join(sums, ["lang", "source"], "left").join(size, "lang", "left").select("lang", "source", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("n", "v", "whole")))
    rows = sorted(tuple(r) for r in known.limit(MAX_GROUPS + 1).collect())
    if len(rows) > MAX_GROUPS:
        raise ValueError(f"more than {MAX_GROUPS} groups of language and source")
    groups: dict[str, tuple[list[str], list[int]]] = {}
    for lang, source, n, v, _ in rows:
        sources, totals = groups.setdefault(lang, ([], []))
        sources.append(source)
        totals.append(n + v)

    totals = spark.createDataFrame([(lang, s, n + v, whole + v) for lang, s, n, v, whole in rows], "lang string, source string, m long, m_lang long")
    ours, theirs = totals.select("lang", "source"), totals.select("lang", F.col("source").alias("item"))
    vectors = kept.groupBy("lang", "vector").agg(F.count("*").alias("times"))
    pairs = (
        ours.join(theirs, "lang").where(F.col("source") != F.col("item"))
        .join(_pair_sums(vectors, groups), ["lang", "source", "item"], "left")
        .select("lang", "source", F.lit("pair").alias("part"), "item", F.coalesce("value", F.lit(0)).alias("value"))
    )
    by_value = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    p, q = F.col("p"), F.col("q")
    terms = (
        entries.join(F.broadcast(totals), ["lang", "source"])
        .select("lang", "source", F.col("term").alias("item"), share(F.col("n"), F.col("m")).alias("p"), share(F.col("total"), F.col("m_lang")).alias("q"))
        .where(p > q).select("lang", "source", F.lit("term").alias("part"), "item", F.call_function("div", (p - q) * (p - q), q).alias("value"))
        .withColumn("rank", F.row_number().over(by_value)).where(F.col("rank") <= top)
    )
    return pairs.withColumn("rank", F.row_number().over(by_value)).unionByName(terms)


def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Audit all sources of `documents`."""
    return audit(read_table(spark, sf_dir, "documents"))


OP11_SQL = rf"""
WITH d AS (
  SELECT row_number() OVER () AS i, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents
), w AS (SELECT i, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
kept AS (SELECT lang, term FROM w GROUP BY ALL HAVING count(DISTINCT i) >= {LEAST_DOCS}),
c AS (SELECT lang, source, term, count(*) AS n FROM w JOIN kept USING (lang, term) GROUP BY ALL),
g AS (SELECT DISTINCT lang, source FROM d),
m AS (SELECT lang, count(*) AS v FROM kept GROUP BY ALL),
full_ AS (SELECT g.lang, g.source, kept.term, coalesce(c.n, 0)::HUGEINT AS n FROM g JOIN kept USING (lang) LEFT JOIN c USING (lang, source, term)),
p AS (SELECT lang, source, term, n, 1 + ({PARTS} * (n + 1)) // (sum(n) OVER (PARTITION BY lang, source)::HUGEINT + m.v) AS p FROM full_ JOIN m USING (lang)),
l AS (SELECT lang, term, sum(n) AS n FROM c GROUP BY ALL),
q AS (SELECT lang, term, 1 + ({PARTS} * (n + 1)) // (sum(n) OVER (PARTITION BY lang)::HUGEINT + m.v) AS q FROM l JOIN m USING (lang)),
pairs AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(sum(((x.p - y.p) * (x.p - y.p)) // y.p), 0)::BIGINT AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN p x ON x.lang = a.lang AND x.source = a.source LEFT JOIN p y ON y.lang = b.lang AND y.source = b.source AND y.term = x.term
  GROUP BY ALL
), terms AS (
  SELECT lang, source, 'term' AS part, term AS item, (((p - q) * (p - q)) // q)::BIGINT AS value FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank FROM (FROM pairs UNION ALL FROM terms)
)
SELECT * FROM ranked WHERE part = 'pair' OR rank <= {TOP}
"""
