"""Operator 5: benchmark decontamination with a generalised suffix automaton.

The benchmark's items, as words, go into one suffix automaton. Each document's
words then stream through it; the state tells, at every word, the longest run
of words up to there that occurs in some item. A run of ten or more ends a
window of an item; the state's place in the tree of suffix links names the
items. Documents pass row by row: no shuffle, memory of one document.

The benchmark is a stated query set. Its items are cut into overlapping pieces
that keep every window, and dealt by a hash into blocks of about BLOCK_WORDS
words. One block at a time is sent to the tasks, which build its automaton; with
more than one, each is matched with the original texts and what they find is
merged by row: coverage is judged, and texts are cut, once and by the union of
their spans.

Defined results: null and empty texts have no words and no hits; items without
words are left out; repeated items and repeated item_ids count once by id; an
item without an id hits words but isn't counted or named; an item shorter than a
window counts where it occurs whole; rows that repeat a doc_id give a row each;
extra columns are ignored.
"""

from __future__ import annotations

import math
import re
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridstat.llm.common import free_names, map_arrow, materialize, read_table, texts_of

WINDOW = 10
#: Words of items in one automaton, about: some 100 MB in a worker.
BLOCK_WORDS = 200_000
#: Words of a piece of an item.
PIECE_WORDS = 20_000
#: A document with a larger share of hit words goes as a whole.
MAX_COVERAGE = 0.5

#: A word of a text that is not in lower case yet.
_WORD = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
#: A-Z in lower case, ASCII outside a-z and 0-9 as white space; other bytes belong to words.
_TABLE = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256)
)


def words_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_TABLE).split()


class SuffixAutomaton:
    """All runs of words of the items, and for each state the items that a window ending there belongs to."""

    def __init__(self, items: Iterable[tuple[str | None, list[bytes]]], window: int = WINDOW):
        self.window = window
        self.next: list[dict[bytes, int]] = [{}]
        self.link, self.length = [-1], [0]
        items = [(i, w) for i, w in items if w]
        for _, words in items:
            last = 0
            for w in words:
                last = self._extend(last, w)
        self.place = self._places()
        self.items: dict[int, set[str]] = {}
        short: dict[int, set[tuple[int, str]]] = {}
        for item, words in items:
            state = 0
            for n, w in enumerate(words, 1):
                state = self.next[state][w]
                if n >= window:
                    self.items.setdefault(self.place[state], set()).add(item)
            if len(words) < window:
                while self.length[self.link[state]] >= len(words):
                    state = self.link[state]
                short.setdefault(state, set()).add((len(words), item))
        self.short = self._along_links(short) if short else None

    def _extend(self, last: int, word: bytes) -> int:
        """The state of the run that ends with `word` after the state `last`."""
        step, link, length = self.next, self.link, self.length
        there = step[last].get(word)
        if there is not None:
            return there if length[there] == length[last] + 1 else self._split(last, there, word)
        new = self._state({}, 0, length[last] + 1)
        at = last
        while at >= 0 and word not in step[at]:
            step[at][word] = new
            at = link[at]
        if at >= 0:
            there = step[at][word]
            link[new] = there if length[there] == length[at] + 1 else self._split(at, there, word)
        return new

    def _split(self, at: int, there: int, word: bytes) -> int:
        """Give the shorter runs of a state, those that end `at` plus the word, a state of their own."""
        twin = self._state(dict(self.next[there]), self.link[there], self.length[at] + 1)
        self.link[there] = twin
        while at >= 0 and self.next[at].get(word) == there:
            self.next[at][word] = twin
            at = self.link[at]
        return twin

    def _state(self, step: dict[bytes, int], link: int, length: int) -> int:
        self.next.append(step)
        self.link.append(link)
        self.length.append(length)
        return len(self.link) - 1

    def _places(self) -> list[int]:
        """For each state of a window or more, the state on its links that holds its last `window` words."""
        out = [0] * len(self.link)
        for v in sorted(range(1, len(self.link)), key=self.length.__getitem__):
            if self.length[v] >= self.window:
                up = self.link[v]
                out[v] = out[up] if self.length[up] >= self.window else v
        return out

    def _along_links(self, short: dict[int, set[tuple[int, str]]]) -> list[tuple[tuple[int, str], ...]]:
        out: list[tuple[tuple[int, str], ...]] = [()] * len(self.link)
        for v in sorted(range(1, len(self.link)), key=self.length.__getitem__):
            own = tuple(sorted(short.get(v, ())))
            out[v] = out[self.link[v]] + own if own else out[self.link[v]]
        return out

    def match(self, words: list[bytes]) -> tuple[list[list[int]], set[str]]:
        """Disjoint spans [first, end) of hit words in order, and the items that occur."""
        step, link, length, window, short = self.next, self.link, self.length, self.window, self.short
        spans: list[list[int]] = []
        places: set[int] = set()
        items: set[str] = set()
        state = run = 0
        for i, w in enumerate(words):
            there = step[state].get(w)
            while there is None and state:
                state = link[state]
                run = length[state]
                there = step[state].get(w)
            if there is None:
                continue
            state, run = there, run + 1
            k = 0
            if run >= window:
                k = window
                places.add(self.place[state])
            if short is not None:
                for n, item in short[state]:
                    if n <= run:
                        items.add(item)
                        k = max(k, n)
            if k:
                first = i - k + 1
                while spans and spans[-1][1] >= first:
                    first = min(first, spans.pop()[0])
                spans.append([first, i + 1])
        for p in places:
            items |= self.items[p]
        return spans, items


def pieces_of(words: list[bytes], window: int = WINDOW, most: int = PIECE_WORDS) -> Iterator[list[bytes]]:
    """An item's words in pieces that overlap by a window less one: each window is in one of them."""
    step = max(1, most - window + 1)
    for at in range(0, max(1, len(words) - window + 1), step):
        yield words[at : at + step + window - 1]


class Blocks:
    """The benchmark in blocks of bounded size; no more than one is held by the driver at a time."""

    def __init__(self, benchmark: DataFrame, window: int, block_words: int):
        def task():
            def one(batch: pa.RecordBatch) -> pa.RecordBatch:
                items = batch.column(0).to_pylist()
                rows = [(i, b" ".join(p), len(p)) for i, t in zip(items, texts_of(batch), strict=True) for p in pieces_of(words_of(t), window) if p]
                item, piece, n = zip(*rows, strict=True) if rows else ((), (), ())
                return pa.RecordBatch.from_arrays([pa.array(item, pa.string()), pa.array(piece, pa.binary()), pa.array(n, pa.int64())], names=["item", "piece", "n"])

            return one

        self.window, self.spark = window, benchmark.sparkSession
        items = benchmark.where("text is not null").select(F.col("item_id").cast("string").alias("item_id"), "text")
        pieces = map_arrow(items, task, "item string, piece binary, n long")
        total = pieces.agg(F.sum("n")).first()[0] or 0
        self.n = max(1, math.ceil(total / block_words))
        self.pieces = materialize(pieces) if self.n > 1 else pieces

    def __iter__(self) -> Iterator:
        """Broadcasts of (name, items) of each block."""
        block = F.pmod(F.xxhash64("item", "piece"), F.lit(self.n))
        for k in range(self.n):
            rows = self.pieces.where(block == k).select("item", "piece").distinct().collect()
            items = sorted(((r["item"], bytes(r["piece"])) for r in rows), key=lambda r: (r[0] is not None, r))
            yield self.spark.sparkContext.broadcast((uuid.uuid4().hex, items))


_HELD: dict[str, SuffixAutomaton] = {}  # the block that a worker process works with


def _automaton(shared, window: int) -> SuffixAutomaton:
    """The automaton of a block, built once a worker process."""
    name, items = shared.value
    if name not in _HELD:
        _HELD.clear()
        _HELD[name] = SuffixAutomaton([(i, p.split(b" ")) for i, p in items], window)
    return _HELD[name]


def drop_kept() -> None:
    """Forget what this worker process keeps for later tasks."""
    _HELD.clear()


MATCHES = "doc_id long, n_words long, spans array<array<long>>, items array<string>"


def matches(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """(doc_id, n_words, spans, items) of every row: word spans that are hit, and whose windows they are."""
    blocks = Blocks(benchmark, window, block_words)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    if blocks.n == 1:
        return _pass(docs, next(iter(blocks)), window)
    # Every block over the same rows: a number for each row merges what the blocks find.
    docs = materialize(docs.withColumn("row", F.monotonically_increasing_id()))
    found = _all_passes(docs, blocks)
    none = F.array().cast("array<array<long>>"), F.array().cast("array<string>")
    sizes = docs.select("row", "doc_id", _n_words().alias("n_words"))
    return sizes.join(found, "row", "left").select("doc_id", "n_words", F.coalesce("spans", none[0]).alias("spans"), F.coalesce("items", none[1]).alias("items"))


def _n_words() -> F.Column:
    return F.size(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+"), F.lit(0))).cast("long")


def _all_passes(docs: DataFrame, blocks: Blocks) -> DataFrame:
    """(row, spans, items) of the rows that any block hits; each pass is written before the next block is sent."""
    every = None
    for shared in blocks:
        hits = materialize(_pass(docs, shared, blocks.window).where("size(spans) > 0").select("row", "spans", "items"))
        shared.destroy()
        every = hits if every is None else every.unionByName(hits)
    return every.groupBy("row").agg(F.flatten(F.collect_list("spans")).alias("spans"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"))


def _pass(docs: DataFrame, shared, window: int) -> DataFrame:
    extra = [c for c in docs.columns if c == "row"]

    def task():
        automaton = _automaton(shared, window)

        def one(batch: pa.RecordBatch) -> pa.RecordBatch:
            found = []
            for text in texts_of(batch):
                words = words_of(text)
                spans, items = automaton.match(words)
                found.append((len(words), spans, sorted(i for i in items if i is not None)))
            n, spans, items = zip(*found, strict=True)
            columns = [batch.column(0), pa.array(n, pa.int64()), pa.array(spans, pa.list_(pa.list_(pa.int64()))), pa.array(items, pa.list_(pa.string()))]
            columns += [batch.column(batch.schema.get_field_index(c)) for c in extra]
            return pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_words", "spans", "items", *extra])

        return one

    return map_arrow(docs, task, MATCHES + (", row long" if extra else ""))


def hit_words(spans: F.Column) -> F.Column:
    """Words in a union of spans that may overlap (those of several blocks)."""
    merged = F.aggregate(
        F.array_sort(spans),
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("end")),
        lambda a, s: F.struct(
            (a["n"] + F.greatest(F.lit(0).cast("long"), s[1] - F.greatest(a["end"], s[0]))).alias("n"), F.greatest(a["end"], s[1]).alias("end")
        ),
    )
    return merged["n"]


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits of all of `documents` in all of `benchmark`."""
    found = matches(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        hit_words(F.col("spans")).alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"),
    )


def cut_spans(text: str, spans: list[list[int]]) -> str:
    """The text without the words of the spans and what stands between words of one span."""
    out, at, spans, i = [], 0, iter(spans), -1
    span = next(spans, None)
    begin = 0
    for i, m in enumerate(_WORD.finditer(text)):
        if span is None:
            break
        if i == span[0]:
            begin = m.start()
        if i == span[1] - 1:
            out.append(text[at:begin])
            at = m.end()
            span = next(spans, None)
    return "".join([*out, text[at:]])


def remove_contamination(
    docs: DataFrame, benchmark: DataFrame, max_coverage: float = MAX_COVERAGE, block_words: int = BLOCK_WORDS
) -> DataFrame:
    """Documents with hit spans cut out; those with more than `max_coverage` of their words hit are dropped.

    Spans are those of all blocks on the original text, so results don't depend on the size of blocks.
    All columns are kept; n_chars, where there is such a column, follows the new text.
    """
    blocks = Blocks(benchmark, WINDOW, block_words)
    if blocks.n == 1:
        return _cut(docs, docs.schema, max_coverage, shared=next(iter(blocks)))
    row, spans = free_names(docs, "row", "spans")
    docs = docs.select("*", F.monotonically_increasing_id().alias(row))
    held = materialize(docs)
    found = _all_passes(held.select("doc_id", "text", F.col(row).alias("row")), blocks).select(F.col("row").alias(row), F.col("spans").alias(spans))
    return _cut(held.join(found, row, "left"), docs.drop(row).schema, max_coverage, spans=spans)


def union_of(spans: Iterable[list[int]]) -> list[list[int]]:
    """Disjoint spans in order; those that overlap or touch become one."""
    out: list[list[int]] = []
    for first, end in sorted(spans):
        if out and first <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([first, end])
    return out


def _cut(docs: DataFrame, schema, max_coverage: float, shared=None, spans: str | None = None) -> DataFrame:
    """Cut what the automaton of a block finds, or what a column of spans says."""
    names = schema.names

    def task():
        automaton = _automaton(shared, WINDOW) if shared is not None else None

        def one(batch: pa.RecordBatch) -> pa.RecordBatch | None:
            said = None if automaton else batch.column(batch.schema.get_field_index(spans)).to_pylist()
            batch = batch.select(names)
            texts, keep, changed = batch.column(batch.schema.get_field_index("text")).to_pylist(), [], {}
            for r, text in enumerate(texts):
                words = words_of(text or "")
                found = automaton.match(words)[0] if automaton else union_of(said[r] or ())
                hit = sum(e - s for s, e in found)
                if hit and hit > max_coverage * len(words):
                    continue
                keep.append(r)
                if found:
                    changed[r] = cut_spans(text, found)
            if changed:
                for name, of in (("text", lambda t: t), ("n_chars", len)):
                    if name in names:
                        c = batch.schema.get_field_index(name)
                        values = batch.column(c).to_pylist()
                        for r, t in changed.items():
                            values[r] = of(t)
                        batch = batch.set_column(c, name, pa.array(values, batch.schema.field(c).type))
            return batch.take(pa.array(keep, pa.int64()))

        return one

    return map_arrow(docs, task, schema)


#: An independent statement of the query: windows joined by their text.
OP5_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents
), b AS (
  SELECT CAST(item_id AS VARCHAR) AS item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark WHERE text IS NOT NULL
), bw AS (
  SELECT DISTINCT item_id, k, array_to_string(w[i:i + k - 1], ' ') AS win
  FROM (SELECT item_id, w, least(10, len(w)) AS k, unnest(generate_series(1, greatest(len(w) - 9, 1))) AS i FROM b WHERE len(w) > 0)
), dw AS (
  SELECT doc_id, i, k, array_to_string(w[i:i + k - 1], ' ') AS win
  FROM (SELECT doc_id, w, k, unnest(generate_series(1, len(w) - k + 1)) AS i FROM d, (SELECT DISTINCT k FROM bw) WHERE len(w) >= k)
), m AS (
  SELECT dw.doc_id, dw.i, dw.k, bw.item_id FROM dw JOIN bw ON dw.k = bw.k AND dw.win = bw.win
), h AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(generate_series(i, i + k - 1)) AS p FROM m) GROUP BY doc_id
), t AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM m WHERE item_id IS NOT NULL) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(h.n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(t.n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(t.ids, '')) AS items_sha256, coalesce(h.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h ON d.doc_id = h.doc_id LEFT JOIN t ON d.doc_id = t.doc_id
"""
