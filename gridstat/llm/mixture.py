"""Mixing sources to target weights: which documents to take, and how often, so that each source gives its share of words.

A document may belong to several sources. Documents are aggregated by membership pattern
(the set of their sources); a minimum-cost flow routes words of patterns to the sources'
quotas. A pattern's words may be taken up to `repeats` times and the r-th time costs r, so
costs are convex: nothing is repeated while something fresh could serve. What flows out of
a pattern is a number of whole passes over its documents and a rest. For the rest,
documents are taken in a seeded order, each one that still fits, until nothing is left.

Work: one pass over the texts writes sizes and order keys; the rest reads only those. The
flow's network has a node for each pattern and source (at most `MAX_PATTERNS`, checked).
The seeded order is never sorted as a whole: sums over ranges of keys, split anew where the
rest ends, narrow down to ranges of at most `RANGE_ROWS` rows, which are walked in order,
one task a pattern. What is taken becomes a few ranges of keys a pattern, so the decision
for a document needs nothing but itself and its pattern's row.

Defined results: null text has no words; a null source is a source of its own; without
words every target is 0; an empty table gives an empty result; rows of equal id, text and
pattern are one unit (taken together); other columns are not looked at; a long text is
counted as a whole.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridstat.llm.common import discard, free_names, materialize, read_table

#: How often a document may be taken.
REPEATS = 3
#: Seed of the order in which documents are taken.
SEED = 42
#: Patterns of membership that the flow's network holds.
MAX_PATTERNS = 100_000
#: A range of the order with at most so many rows is walked; others are split into so many parts.
RANGE_ROWS, PARTS = 2_000, 256
#: Order keys are below this.
KEYS = 1 << 60

_WHITE = " \t\n\x0b\x0c\r"

#: An amount of words as a fraction (numerator, denominator): targets are exact until they are shown.
Share = tuple[int, int]
Targets = Callable[[dict[str | None, int], int], dict[str | None, Share]]


def n_words(text: Column) -> Column:
    """Runs of characters that aren't white space; no list of words is made."""
    told = F.rtrim(F.coalesce(text, F.lit("")), F.lit(_WHITE))
    return F.length(F.regexp_replace(told, "[\\x20\\x09-\\x0D]*[^\\x20\\x09-\\x0D]+", "x")).cast("long")


def order_key(doc_id: Column, text: Column, seed: int) -> Column:
    """A seeded number below 2^60 of a document."""
    said = F.concat(F.lit(f"{seed}|"), F.coalesce(doc_id.cast("string"), F.lit("")), F.lit("|"), F.coalesce(text, F.lit("")))
    return F.conv(F.substring(F.md5(said.cast("binary")), 1, 15), 16, 10).cast("long")


# --- targets


def code_points(sources: list[str | None]) -> list[str | None]:
    """Sources in order of their code points, null last."""
    return sorted(sources, key=lambda s: (s is None, (s or "").encode()))


def fill(total: int, weights: dict[str | None, int], most: dict[str | None, int]) -> dict[str | None, Share]:
    """Share a total by weight; what exceeds a source's most goes to the others by weight, until nothing does."""
    left, open_ = total, sum(weights.values())
    out: dict[str | None, Share] = {}
    # Sources reach their most in order of most / weight.
    for s in sorted(weights, key=lambda s: most[s] / weights[s]):
        if left * weights[s] > most[s] * open_:
            out[s] = (most[s], 1)
            left, open_ = left - most[s], open_ - weights[s]
        else:
            out[s] = (left * weights[s], open_)
    return out


def cyclic_targets(weights: tuple[int, ...] = (1, 2, 3), repeats: int = REPEATS) -> Targets:
    """All words, shared by weights that go round the sources in order of code points."""

    def targets(sizes: dict[str | None, int], total: int) -> dict[str | None, Share]:
        each = {s: weights[i % len(weights)] for i, s in enumerate(code_points(list(sizes)))}
        return fill(total, each, {s: repeats * n for s, n in sizes.items()})

    return targets


# --- flow


class Network:
    """Directed arcs with capacities and costs that are not negative; minimum-cost maximum flow by shortest distances
    and blocking flows over the arcs that lie on shortest paths."""

    def __init__(self, nodes: int):
        self.out: list[list[int]] = [[] for _ in range(nodes)]
        self.to: list[int] = []
        self.room: list[int] = []
        self.cost: list[int] = []

    def arc(self, a: int, b: int, room: int, cost: int) -> int:
        """Add an arc and its reverse; the flow is the reverse's room."""
        for x, y, r, c in ((a, b, room, cost), (b, a, 0, -cost)):
            self.out[x].append(len(self.to))
            self.to.append(y)
            self.room.append(r)
            self.cost.append(c)
        return len(self.to) - 2

    def run(self, source: int, sink: int) -> None:
        height = [0] * len(self.out)
        while True:
            far = [None] * len(self.out)
            far[source], heap = 0, [(0, source)]
            while heap:
                d, a = heapq.heappop(heap)
                if d > far[a]:
                    continue
                for e in self.out[a]:
                    b = self.to[e]
                    if self.room[e] and (far[b] is None or d + self.cost[e] + height[a] - height[b] < far[b]):
                        far[b] = d + self.cost[e] + height[a] - height[b]
                        heapq.heappush(heap, (far[b], b))
            if far[sink] is None:
                return
            height = [h + (f if f is not None else far[sink]) for h, f in zip(height, far, strict=True)]
            while self._block(source, sink, height):
                pass

    def _block(self, source: int, sink: int, height: list[int]) -> bool:
        """A blocking flow over arcs of no reduced cost, by layers."""
        layer, row = {source: 0}, [source]
        while row and sink not in layer:
            following = []
            for a in row:
                for e in self.out[a]:
                    b = self.to[e]
                    if self.room[e] and b not in layer and self.cost[e] + height[a] - height[b] == 0:
                        layer[b] = layer[a] + 1
                        following.append(b)
            row = following
        if sink not in layer:
            return False
        at, path = dict.fromkeys(layer, 0), []
        a = source
        while True:
            if a == sink:
                push = min(self.room[e] for e in path)
                for e in path:
                    self.room[e] -= push
                    self.room[e ^ 1] += push
                path, a = [], source
                continue
            while at[a] < len(self.out[a]):
                e = self.out[a][at[a]]
                b = self.to[e]
                if self.room[e] and layer.get(b) == layer[a] + 1 and self.cost[e] + height[a] - height[b] == 0:
                    break
                at[a] += 1
            else:
                if a == source:
                    return True
                e = path.pop()
                a = self.to[e ^ 1]
                at[a] += 1
                continue
            path.append(e)
            a = self.to[e]


def route(patterns: list[tuple[int, list[int]]], quotas: list[int], repeats: int = REPEATS) -> list[dict[int, int]]:
    """Words that each pattern (capacity, its sources' numbers) gives each of its sources, at the least cost of repetition."""
    source, sink, p = 0, 1, len(patterns)
    net = Network(2 + p + len(quotas))
    arcs = []
    for i, (room, members) in enumerate(patterns):
        for r in range(1, repeats + 1):
            net.arc(source, 2 + i, room, r)
        arcs.append({s: net.arc(2 + i, 2 + p + s, repeats * room, 0) for s in members})
    for s, quota in enumerate(quotas):
        net.arc(2 + p + s, sink, quota, 0)
    net.run(source, sink)
    return [{s: net.room[e ^ 1] for s, e in of.items()} for of in arcs]


# --- selection


@dataclass
class _Rest:
    """What of a pattern's rest is not decided yet: ranges of keys in order, as (low, high, words, rows, least)."""

    members: list[str | None]
    words: int
    open: list[tuple[int, int, int, int, int]]
    taken: list[tuple[int, int]] = field(default_factory=list)

    def take(self, low: int, high: int) -> None:
        if self.taken and self.taken[-1][1] == low:
            low = self.taken.pop()[0]
        self.taken.append((low, high))

    def advance(self) -> tuple[int, int, int] | None:
        """Decide ranges as long as sums alone tell; then the next range to look into, as (low, high, rows)."""
        while self.open and self.words:
            low, high, words, rows, least = self.open[0]
            if words <= self.words:
                self.take(low, high)
                self.words -= words
            elif least <= self.words and high - low > 1:
                return low, high, rows
            self.open.pop(0)
        return None


def walk(words: int, keys: list[int], sizes: list[int]) -> tuple[int, list[tuple[int, int]]]:
    """Take units in order, each that still fits: what is left, and the ranges of keys that were taken."""
    out: list[tuple[int, int]] = []
    joined = False
    for key, size in zip(keys, sizes, strict=True):
        if size <= words:
            words -= size
            out.append((out.pop()[0] if joined else key, key + 1))
            joined = True
        else:
            joined = False
    return words, out


_WALKED = "members array<string>, words long, lows array<long>, highs array<long>"


def _select(sized: DataFrame, rests: list[_Rest]) -> None:
    """Decide all rests, a job a round for all patterns."""
    spark = sized.sparkSession
    while True:
        looks = [(r, look) for r in rests if (look := r.advance())]
        if not looks:
            return
        asked = [(r.members, low, high, -(-(high - low) // PARTS), r.words, rows <= RANGE_ROWS) for r, (low, high, rows) in looks]
        ranges = spark.createDataFrame(asked, "m array<string>, low long, high long, width long, words long, walk boolean")
        inside = (F.col("members") == F.col("m")) & (F.col("key") >= F.col("low")) & (F.col("key") < F.col("high"))
        found = sized.where(F.col("size") > 0).join(F.broadcast(ranges), inside).drop("m")
        by = {tuple(r.members): (r, look) for r, look in looks}

        parts = found.where(~F.col("walk")).groupBy("members", "low", "width", F.call_function("div", F.col("key") - F.col("low"), F.col("width")).alias("part"))
        split: dict[tuple, list] = {}
        for x in parts.agg(F.sum("size").alias("words"), F.count("*").alias("rows"), F.min("size").alias("least")).collect() if not all(a[5] for a in asked) else []:
            low = x["low"] + x["part"] * x["width"]
            split.setdefault(tuple(x["members"]), []).append((low, min(low + x["width"], by[tuple(x["members"])][1][1]), x["words"], x["rows"], x["least"]))
        for m, ordered in split.items():
            by[m][0].open[:1] = sorted(ordered)

        def walked(rows: pd.DataFrame) -> pd.DataFrame:
            rows = rows.sort_values("key")
            words, out = walk(int(rows["words"].iloc[0]), rows["key"].tolist(), rows["size"].tolist())
            return pd.DataFrame({"members": [rows["members"].iloc[0]], "words": [words], "lows": [[a for a, _ in out]], "highs": [[b for _, b in out]]})

        units = found.where("walk").groupBy("members", "words", "key").agg(F.sum("size").alias("size"))
        for x in units.groupBy("members").applyInPandas(walked, _WALKED).collect() if any(a[5] for a in asked) else []:
            rest = by[tuple(x["members"])][0]
            rest.words = x["words"]
            rest.open.pop(0)
            for low, high in zip(x["lows"], x["highs"], strict=True):
                rest.take(low, high)


# --- the mix


@dataclass
class Mix:
    """A mix of a table: `rules` has a row a pattern (members, passes, ranges); the rest is for reports."""

    rules: DataFrame
    sizes: dict[str | None, int]
    targets: dict[str | None, Share]
    flows: dict[tuple[str | None, ...], dict[str | None, int]]


def _sized(documents: DataFrame, members: Column, seed: int) -> DataFrame:
    text = F.col("text").cast("string")
    return documents.select("doc_id", F.array_sort(F.array_distinct(members)).alias("members"), n_words(text).alias("size"), order_key(F.col("doc_id"), text, seed).alias("key"))


def plan(sized: DataFrame, targets: Targets, repeats: int = REPEATS) -> Mix:
    """The mix of sized documents (members, size, key)."""
    spark = sized.sparkSession
    found = sized.groupBy("members").agg(F.sum("size").alias("size"), F.count("*").alias("rows"), F.coalesce(F.min(F.when(F.col("size") > 0, F.col("size"))), F.lit(0)).alias("least"))
    patterns = found.limit(MAX_PATTERNS + 1).collect()
    if len(patterns) > MAX_PATTERNS:
        raise ValueError(f"more than {MAX_PATTERNS} patterns of membership")
    patterns.sort(key=lambda r: [(m is not None, m or "") for m in r["members"]])
    sizes: dict[str | None, int] = {}
    for r in patterns:
        for s in r["members"]:
            sizes[s] = sizes.get(s, 0) + r["size"]
    goal = targets(sizes, sum(r["size"] for r in patterns))
    names = code_points(list(sizes))
    number = {s: i for i, s in enumerate(names)}
    flows = route([(r["size"], [number[s] for s in r["members"]]) for r in patterns], [goal[s][0] // goal[s][1] for s in names], repeats)
    rests, passes = [], []
    for r, flow in zip(patterns, flows, strict=True):
        whole, words = divmod(sum(flow.values()), r["size"]) if r["size"] else (0, 0)
        passes.append(whole)
        rests.append(_Rest(list(r["members"]), words, [(0, KEYS, r["size"], r["rows"], r["least"])]))
    _select(sized, rests)
    rules = [(r.members, n, [{"low": a, "high": b} for a, b in r.taken]) for r, n in zip(rests, passes, strict=True)]
    return Mix(
        spark.createDataFrame(rules, "members array<string>, passes long, ranges array<struct<low: long, high: long>>"), sizes, goal,
        {tuple(r["members"]): {names[s]: n for s, n in flow.items()} for r, flow in zip(patterns, flows, strict=True)},
    )


def _times(sized: DataFrame, mix: Mix) -> DataFrame:
    """Sized documents with `times`, how often the mix takes each."""
    rules = F.broadcast(mix.rules.select(F.col("members").alias("m"), "passes", "ranges"))
    in_rest = F.exists("ranges", lambda r: (F.col("key") >= r["low"]) & (F.col("key") < r["high"]))
    return sized.join(rules, F.col("members") == F.col("m")).withColumn("times", F.col("passes") + in_rest.cast("long")).drop("m", "passes", "ranges")


def mixed(documents: DataFrame, members: Column, targets: Targets, repeats: int = REPEATS, seed: int = SEED) -> DataFrame:
    """The mixed corpus: the rows of documents, each as often as it is taken."""
    sized = materialize(_sized(documents, members, seed))
    mix = plan(sized, targets, repeats)
    discard(sized)
    m, key, times, ours, passes, ranges = free_names(documents, "members", "key", "times", "rule_members", "rule_passes", "rule_ranges")
    rules = F.broadcast(mix.rules.select(F.col("members").alias(ours), F.col("passes").alias(passes), F.col("ranges").alias(ranges)))
    text = F.col("text").cast("string")
    marked = documents.withColumn(m, F.array_sort(F.array_distinct(members))).withColumn(key, order_key(F.col("doc_id"), text, seed))
    in_rest = F.exists(F.col(ranges), lambda r: (F.col(key) >= r["low"]) & (F.col(key) < r["high"]))
    often = marked.join(rules, F.col(m) == F.col(ours)).withColumn(times, F.col(passes) + in_rest.cast("long")).where(F.col(times) > 0)
    return often.withColumn(times, F.explode(F.sequence(F.lit(1), F.col(times)))).select(*documents.columns)


def op12_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mix all of `documents`: each one belongs to its source alone."""
    docs = read_table(spark, sf_dir, "documents")
    sized = materialize(_sized(docs, F.array(F.col("source").cast("string")), SEED))
    mix = plan(sized, cyclic_targets())
    shown = [([s], mix.sizes[s], mix.targets[s][0] / mix.targets[s][1]) for s in mix.sizes]
    sources = F.broadcast(spark.createDataFrame(shown, "m array<string>, source_size long, target double"))
    return (
        _times(sized, mix).join(sources, F.col("members") == F.col("m"))
        .select(F.col("doc_id").cast("long").alias("doc_id"), "size", "source_size", "target", (F.col("times") * F.col("size")).alias("taken"))
    )


OP12_SQL = rf"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
    substr(md5('{SEED}|' || coalesce(CAST(doc_id AS VARCHAR), '') || '|' || coalesce(text, '')), 1, 15) AS key FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, CAST(1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS BIGINT) AS w FROM d GROUP BY source
), o AS (
  SELECT *, {REPEATS} * source_size AS most, row_number() OVER (ORDER BY {REPEATS} * source_size * (6 // w), source NULLS LAST) AS k FROM s
), f AS (
  SELECT *, CAST((SELECT sum(source_size) FROM s) - coalesce(sum(most) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS r,
    CAST(sum(w) OVER (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS BIGINT) AS ws FROM o
), e AS (SELECT r, ws, k FROM f WHERE r * w <= most * ws ORDER BY k LIMIT 1),
t AS (
  SELECT source, source_size, CASE WHEN f.k < e.k THEN CAST(most AS DOUBLE) ELSE CAST(e.r * w AS DOUBLE) / e.ws END AS target,
    CASE WHEN f.k < e.k THEN most ELSE (e.r * w) // e.ws END AS quota FROM f, e
), q AS (SELECT *, CASE WHEN source_size > 0 THEN quota // source_size ELSE 0 END AS passes, CASE WHEN source_size > 0 THEN quota % source_size ELSE 0 END AS rest FROM t),
units AS (
  SELECT source, key, CAST(sum(size) AS BIGINT) AS words, row_number() OVER (PARTITION BY source ORDER BY key) AS n FROM d WHERE size > 0 GROUP BY source, key
), walk AS (
  SELECT source, CAST(0 AS BIGINT) AS n, CAST(rest AS BIGINT) AS rest, CAST(NULL AS VARCHAR) AS key, false AS took FROM q
  UNION ALL
  SELECT w.source, u.n, CASE WHEN u.words <= w.rest THEN w.rest - u.words ELSE w.rest END, u.key, u.words <= w.rest
  FROM walk w JOIN units u ON w.source IS NOT DISTINCT FROM u.source AND u.n = w.n + 1
)
SELECT d.doc_id, d.size, q.source_size, q.target, CAST(d.size * (q.passes + CASE WHEN coalesce(walk.took, false) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM d JOIN q ON d.source IS NOT DISTINCT FROM q.source LEFT JOIN walk ON d.source IS NOT DISTINCT FROM walk.source AND d.key = walk.key
"""
