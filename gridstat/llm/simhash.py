"""Operator 6: SimHash near-duplicates by pigeonhole blocks.

A 64-bit fingerprint is split into six blocks. Two fingerprints that differ in
at most three bits agree in at least three whole blocks, so each fingerprint is
filed under its twenty triples of blocks (32 bits or so each), an equi-join on
triple and value finds every close pair, and the Hamming distance is checked in
the join itself. A pair that agrees in more triples is reported under the
lowest one only. Equal fingerprints are one class before the join: a group of
copies of any size enters as one row, and what is joined grows with the
different fingerprints alone. Components come from rounds of large-star and
small-star steps over classes, each written to the shared folder.

Defined results: null and empty texts, and those of white space, have
fingerprint zero and are linked like any other; fewer than three words are one
shingle; repeated shingles count as often as they occur. Rows that repeat a
doc_id are one document: a row each, one component. A null doc_id can't be
linked by id: it takes its class's component, or null if the class has no id.
Extra columns are ignored.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridstat.llm.common import discard, map_arrow, materialize, read_table, texts_of

SHINGLE_WORDS = 3
MAX_DISTANCE = 3
#: Fingerprints under one triple of blocks above which pairs are not listed: a member has some 500 midpoints there.
HOT_FAMILY = 1_000
#: Ids of dropped documents up to which they are broadcast: a table of some 100 MB at most.
BROADCAST_IDS = 2_000_000
#: (first bit, bits) of the six blocks.
BLOCKS = [(0, 11), (11, 11), (22, 11), (33, 11), (44, 10), (54, 10)]

_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)
_COLUMN = (np.arange(8, dtype=np.int64) * 256)[None, :]


def fingerprint(text: str, shingle_words: int = SHINGLE_WORDS) -> int:
    """The unsigned 64-bit SimHash of a text; 0 if it has no word."""
    words = text.encode("utf-8", "surrogatepass").lower().split()  # bytes: lower() is A-Z, split() is ASCII white space
    if not words:
        return 0
    joined = b" ".join(words)
    n = max(1, len(words) - shingle_words + 1)
    ends = [-1, *itertools.accumulate(len(w) + 1 for w in words)]
    ends = [e - 1 for e in ends[1:]]
    starts = [0, *(e + 1 for e in ends)]
    last = ends[shingle_words - 1 :] or ends[-1:]
    votes = np.zeros((8, 8), dtype=np.int64)
    for at in range(0, n, 1 << 15):
        h = np.array(
            [xxhash.xxh64_intdigest(joined[s:e], 42) for s, e in zip(starts[at : at + (1 << 15)], last[at : at + (1 << 15)])],
            dtype="<u8",
        )
        cells = h.view(np.uint8).reshape(-1, 8) + _COLUMN
        votes += np.bincount(cells.ravel(), minlength=2048).reshape(8, 256) @ _BITS
    return int(np.packbits((2 * votes > n).ravel(), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp): the fingerprint as a signed long. Row-local."""

    def task():
        def one(batch: pa.RecordBatch) -> pa.RecordBatch:
            fps = np.array([fingerprint(t) for t in texts_of(batch)], dtype=np.uint64).view(np.int64)
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps)], names=["doc_id", "fp"])

        return one

    return map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), task, "doc_id long, fp long")


def _block(fp: Column, first: int, bits: int) -> Column:
    return F.shiftrightunsigned(fp, first).bitwiseAND(F.lit((1 << bits) - 1))


def _lowest(mask: Column) -> Column:
    return mask.bitwiseAND(-mask)


def _filed(classes: DataFrame) -> DataFrame:
    """(fp, node, blocks, value): each fingerprint under its twenty triples of blocks."""
    fp, keys = F.col("fp"), []
    for three in itertools.combinations(range(len(BLOCKS)), 3):
        key = F.lit(sum(1 << b for b in three)).cast("long")  # which blocks, then their values
        for b in three:
            key = F.shiftleft(key, BLOCKS[b][1]).bitwiseOR(_block(fp, *BLOCKS[b]))
        keys.append(F.struct(F.lit(sum(1 << b for b in three)).alias("blocks"), key.alias("value")))
    return classes.select("fp", "node", F.explode(F.array(*keys)).alias("key")).select("fp", "node", "key.*")


def links(classes: DataFrame, hot: int = HOT_FAMILY) -> DataFrame:
    """(a, b): links between nodes whose components are those of all pairs within the distance.

    Families (fingerprints under one triple) of up to `hot` give each close pair
    once. Larger ones would give a number of pairs that grows with their square;
    they link through midpoints instead, a fixed number of rows a member.
    """
    filed = _filed(classes)
    large = filed.groupBy("blocks", "value").count().where(F.col("count") > hot).select("blocks", "value")
    small = filed.join(large, ["blocks", "value"], "left_anti")
    return _pairs(small).unionByName(_through_midpoints(filed.join(large, ["blocks", "value"], "left_semi")))


def _pairs(filed: DataFrame) -> DataFrame:
    """All close pairs of families; one that agrees in more triples comes from the lowest of those at hand."""
    a, b = filed.alias("a"), filed.alias("b")
    x = F.col("a.fp").bitwiseXOR(F.col("b.fp"))
    same = F.lit(0)
    for i, block in enumerate(BLOCKS):
        same = same + F.when(_block(x, *block) == 0, F.lit(1 << i)).otherwise(F.lit(0))
    second = same.bitwiseXOR(_lowest(same))
    third = second.bitwiseXOR(_lowest(second))
    first_three = _lowest(same).bitwiseOR(_lowest(second)).bitwiseOR(_lowest(third))
    close = (
        (F.col("a.value") == F.col("b.value"))
        & (F.col("a.blocks") == F.col("b.blocks"))
        & (F.col("a.fp") < F.col("b.fp"))
        & (F.bit_count(x) <= MAX_DISTANCE)
        & (first_three == F.col("a.blocks"))
    )
    return a.join(b, close).select(F.col("a.node").alias("a"), F.col("b.node").alias("b"))


def _through_midpoints(filed: DataFrame) -> DataFrame:
    """Links of large families, as stars around midpoints.

    Two fingerprints within three bits have a midpoint one bit (or none) from the
    one and two bits at most from the other. So each member goes to every point
    within two bits of it; all that reach a point which some member is within one
    bit of are within three bits of that member, and are linked to it alone. A
    point that several are near has the least of them as its middle: they are
    within two bits of each other. Only bits outside the triple's blocks can differ.
    """
    ones = None
    for three in itertools.combinations(range(len(BLOCKS)), 3):
        free = [str(bit) for i, (first, n) in enumerate(BLOCKS) if i not in three for bit in range(first, first + n)]
        own = F.expr(f"transform(array({', '.join(free)}), bit -> shiftleft(1L, bit))")
        here = F.col("blocks") == sum(1 << b for b in three)
        ones = F.when(here, own) if ones is None else ones.when(here, own)
    two = F.flatten(F.transform("ones", lambda x: F.transform(F.filter("ones", lambda y: y > x), lambda y: x.bitwiseOR(y))))
    flips = F.concat(F.array(F.lit(0).cast("long")), F.col("ones"), two)
    reached = filed.withColumn("ones", ones).select("blocks", "node", "fp", F.explode(flips).alias("flip"))
    point = F.col("fp").bitwiseXOR(F.col("flip"))
    reached = reached.select("blocks", "node", point.alias("point"), (F.bit_count("flip") <= 1).alias("near"))
    middle = reached.where("near").groupBy("blocks", "point").agg(F.min("node").alias("middle"))
    return reached.join(middle, ["blocks", "point"]).where("node <> middle").select(F.col("middle").alias("a"), F.col("node").alias("b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node of each component, for the nodes that have an edge and aren't it.

    Large-star hangs each larger neighbour of a node on the smallest one, then
    small-star does so with the smaller neighbours, until nothing changes; the
    edges are then stars. Rounds grow with the square of the logarithm of the
    nodes at most. Hubs are split by the adaptive join, not gathered.
    """
    now = materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    mark = _mark(now)
    while mark[0]:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        new = materialize(small.select("e.*").where("u <> v").distinct())
        discard(now)
        now, before, mark = new, mark, _mark(new)
        if mark == before:
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("root"))


def _mark(edges: DataFrame) -> tuple:
    """Count and hash sum of a set of edges: equal exactly when nothing changed."""
    r = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
    return r["n"], r["h"]


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, fp, component_id) of every row."""
    rows = materialize(fingerprints(docs))
    classes = materialize(rows.groupBy("fp").agg(F.min("doc_id").alias("node")))
    same_id = _classes_of_one_id(rows, classes)
    pairs = links(classes.where("node is not null")).unionByName(same_id)
    roots = components(pairs)
    found = classes.join(roots, "node", "left").select("fp", F.coalesce("root", "node").alias("component_id"))
    return rows.join(found, "fp").select("doc_id", "fp", "component_id")


def _classes_of_one_id(rows: DataFrame, classes: DataFrame) -> DataFrame:
    """Links of classes that share a doc_id (only where ids repeat with different texts)."""
    several = rows.where("doc_id is not null").groupBy("doc_id").agg(F.min("fp").alias("lo"), F.max("fp").alias("hi")).where("lo <> hi")
    shared = rows.join(several.select("doc_id"), "doc_id").join(classes, "fp")
    # The smallest node of each such id, and every other node of it.
    least = shared.groupBy("doc_id").agg(F.min("node").alias("a"))
    return shared.join(least, "doc_id").where("a <> node").select("a", F.col("node").alias("b")).distinct()


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints and components of all of `documents`."""
    out = near_duplicates(read_table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one_of_each(docs: DataFrame, broadcast_ids: int = BROADCAST_IDS) -> DataFrame:
    """The documents whose id is their component's; rows without an id stay. All columns are kept.

    Of rows that repeat a doc_id the one with the least text stays (null first,
    then the least of its other columns), in whatever order they come. Texts are
    shuffled only where ids repeat, or where more documents go than may be broadcast.
    """
    rows = near_duplicates(docs)
    gone = materialize(rows.where("doc_id <> component_id").select("doc_id").distinct())
    several = materialize(rows.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id"))
    few = lambda ids: F.broadcast(ids) if ids.count() <= broadcast_ids else ids
    kept = docs.join(few(gone), "doc_id", "left_anti").select(docs.columns)
    if several.isEmpty():
        return kept
    several = few(several)
    once = kept.join(several, "doc_id", "left_anti").select(docs.columns)
    row, order = F.struct(*[F.col(f"`{c}`") for c in docs.columns]), F.struct("text", F.to_json(F.struct(*[F.col(f"`{c}`") for c in docs.columns])))
    least = kept.join(several, "doc_id", "left_semi").groupBy("doc_id").agg(F.min_by(row, order).alias("kept_row"))
    return once.unionByName(least.select("kept_row.*"))
