"""Operator 10: document fingerprints by winnowing.

Every run of GRAM code points is hashed with a rolling polynomial; of each
window of WINDOW hashes the smallest is chosen, the rightmost among equals, and
its position kept. Two texts that share GRAM + WINDOW - 1 code points in a row
share a chosen hash. A fingerprint is the list of `hash@position`, in order;
the likeness of two is the share of hashes in common (multisets: sum of minima
over sum of maxima).

op10 also compares each document with its edited text and with the next
document, by descending doc_id. Ids are cut into ranges; every range gets a copy
of the first document of the range after it, so one shuffle of texts by range and
a sort within it put neighbours side by side, and tasks stream over their rows.

Defined results: null counts as empty; an empty text has the empty
fingerprint, two of them likeness 1, one of them likeness 0; a text shorter than
GRAM has one hash, of the whole text; with a single document, the next one is
itself; rows that repeat a doc_id follow each other by text; rows without a
doc_id come after all others; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridstat.llm.common import map_arrow, read_table, small_batches, texts_of

GRAM = 16  # code points of a hashed run
WINDOW = 64  # hashes of a window
_BASE = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xD6E8FEB86659FD93)
_PIECE = 1 << 18  # code points worked on at once


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _MIX
    return h ^ (h >> np.uint64(29))


def gram_hashes(points: np.ndarray, gram: int = GRAM) -> np.ndarray:
    """Hashes of all runs of `gram` points: a polynomial of each run, rolled over all runs at once.

    The polynomial of a run is that of its beginning times a power, plus that of
    its end; so runs of 1, 2, 4, ... points make up runs of any length.
    """
    if gram < 1:
        raise ValueError("a gram has a code point at least")
    if len(points) < gram:
        return np.zeros(0, dtype=np.uint64)
    part, size, power = points + np.uint64(1), 1, _BASE  # of all runs of `size` points
    whole, done = None, 0
    with np.errstate(over="ignore"):
        while True:
            if gram & size:
                n = len(points) - done - size + 1
                whole = part if whole is None else whole[:n] * power + part[done : done + n]
                done += size
            if done == gram:
                return _mixed(whole)
            part = part[:-size] * power + part[size:]
            size, power = 2 * size, power * power


def _short_hash(points: np.ndarray) -> np.ndarray:
    h = np.uint64(len(points))
    with np.errstate(over="ignore"):
        for p in points:
            h = h * _BASE + p + np.uint64(1)
        return _mixed(np.array([h], dtype=np.uint64))


def _window_minima(h: np.ndarray, window: int) -> np.ndarray:
    """Positions of each window's smallest hash, the rightmost among equals, without repeats."""
    at, n = np.arange(len(h)), 1
    while n < window:
        step = min(n, window - n)
        a, b = at[:-step], at[step:]
        at = np.where(h[b] <= h[a], b, a)
        n += step
    return at[np.flatnonzero(np.diff(at, prepend=-1))]


def chosen(text: str, gram: int = GRAM, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, positions) that winnowing chooses; long texts piece by piece, with the same result."""
    points = _points(text)
    if not len(points):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    if len(points) < gram:
        return _short_hash(points), np.zeros(1, np.int64)
    if len(points) < gram + window - 1:
        h = gram_hashes(points, gram)
        at = len(h) - 1 - int(np.argmin(h[::-1]))
        return h[at : at + 1], np.array([at])
    found, last = [], -1
    for begin in range(0, len(points) - gram - window + 2, _PIECE):
        h = gram_hashes(points[begin : begin + _PIECE + gram + window - 2], gram)
        at = _window_minima(h, window)
        at = at[at + begin > last]
        found.append((h[at], at + begin))
        if len(at):
            last = int(found[-1][1][-1])
    hashes, places = zip(*found, strict=True)
    return np.concatenate(hashes), np.concatenate(places)


def render(hashes: np.ndarray, places: np.ndarray) -> str:
    """`hash@position` of each choice: the whole hash, as it is compared."""
    return " ".join([f"{h:x}@{p}" for h, p in zip(hashes.tolist(), places.tolist(), strict=True)])


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Common share of two multisets of hashes; two empty ones are alike."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    x, y = Counter(a.tolist()), Counter(b.tolist())
    common = sum(min(n, y[h]) for h, n in x.items() if h in y)
    return common / (len(a) + len(b) - common)


def fingerprints(docs: DataFrame, gram: int = GRAM, window: int = WINDOW) -> DataFrame:
    """(doc_id, hashes, positions) of every row: rows to join on hashes. Row-local."""

    def task():
        def one(batch: pa.RecordBatch) -> pa.RecordBatch:
            found = [chosen(t, gram, window) for t in texts_of(batch)]
            return pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([h.view(np.int64).tolist() for h, _ in found], pa.list_(pa.int64())), pa.array([p.tolist() for _, p in found], pa.list_(pa.int64()))],
                names=["doc_id", "hashes", "positions"],
            )

        return one

    return map_arrow(docs.select("doc_id", "text"), task, "doc_id long, hashes array<long>, positions array<long>")


def edited(text: str, following: str) -> str:
    """The text with its last third (rounded down) replaced by as much of the beginning of another, or all of it."""
    k = len(text) // 3
    return text[: len(text) - k] + following[:k] if k else text


OUT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _ranged(docs: DataFrame) -> DataFrame:
    """Rows with `range`, later ranges holding smaller ids, and a `guest` copy of each range's first row in the range before.

    The first row of all is also a guest after the last one. Only ids are read
    to find the ranges, and no more than the ranges' bounds reach the driver.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    n = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts = docs.where("doc_id is not null").approxQuantile("doc_id", [i / n for i in range(1, n)], 0.2 / n)
    cuts = sorted({int(c) for c in cuts}, reverse=True)
    at = F.lit(len(cuts))
    if cuts:
        bounds = F.array(*[F.lit(c).cast("long") for c in cuts])
        at = F.aggregate(bounds, F.lit(0), lambda s, c: s + F.when(F.coalesce(F.col("doc_id"), F.lit(-(2**63))) < c, 1).otherwise(0))
    rows = docs.withColumn("range", at)
    tops = rows.groupBy("range").agg(F.max("doc_id").alias("top")).orderBy("range").collect()  # a row a range
    if not tops:
        return rows.withColumn("guest", F.lit(False))
    # Ties of the first id: the first by text is the guest.
    heads = {r["range"]: r["top"] for r in tops}
    order = [r["range"] for r in tops]
    host = {r: order[i - 1] if i else order[-1] for i, r in enumerate(order)}
    listed = spark.createDataFrame([(r, host[r], heads[r]) for r in order], "range int, host int, top long")
    firsts = rows.join(F.broadcast(listed), "range").where(F.col("doc_id").eqNullSafe(F.col("top")))
    firsts = firsts.groupBy("range").agg(F.min(F.struct("text", "doc_id", "host")).alias("f"))
    guests = firsts.select("f.doc_id", "f.text", F.col("f.host").alias("range"), F.lit(True).alias("guest"))
    return rows.withColumn("guest", F.lit(False)).unionByName(guests)


def compare_with_next(docs: DataFrame) -> DataFrame:
    """Fingerprints of every document and its edited text, and their likeness."""
    rows = _ranged(docs)
    small_batches(rows.sparkSession, 500)
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # In a range: own rows by descending id, then the guest.
    dealt = rows.repartition(n, "range").sortWithinPartitions("range", "guest", F.desc_nulls_last("doc_id"), "text")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the row before, its hashes and rendered fingerprint
        out: list[tuple] = []
        for batch in batches:
            names = batch.schema.names
            for doc_id, text, at, guest in zip(*(batch.column(names.index(c)).to_pylist() for c in ("doc_id", "text", "range", "guest")), strict=True):
                hashes, places = chosen(text)
                if held is not None and held[2] == at:
                    out.append(_compared(*held[:2], held[3], held[4], text, hashes))
                held = None if guest else (doc_id, text, at, hashes, places)
                if len(out) >= 256:
                    yield _batch(out)
                    out = []
        if out:
            yield _batch(out)

    return dealt.mapInArrow(run, OUT)


def _compared(doc_id, text: str, hashes: np.ndarray, places: np.ndarray, following: str, next_hashes: np.ndarray) -> tuple:
    new = edited(text, following)
    new_hashes, new_places = chosen(new)
    return (
        doc_id, len(text), hashlib.sha256(new.encode("utf-8", "surrogatepass")).hexdigest(), render(hashes, places),
        render(new_hashes, new_places), likeness(hashes, new_hashes), likeness(hashes, next_hashes),
    )


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    kinds = [pa.int64(), pa.int64(), *[pa.string()] * 3, *[pa.float64()] * 2]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


def op10_winnow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all of `documents`, edited and next."""
    return compare_with_next(read_table(spark, sf_dir, "documents"))
