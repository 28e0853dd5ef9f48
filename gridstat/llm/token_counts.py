"""Operator 2: token counts that follow edits.

A document's pre-tokens stand in a segment tree, kept balanced by height: leaves
hold some of them with their lengths and token counts, inner nodes the sums of
both. An edit re-encodes
from the pre-token before the touched one (its end depends on what follows it)
up to the first cut beyond the edit that is a cut of the old text as well: the
pre-token pattern reads left to right and looks ahead only, so all after it
stays as it was. Leaves between are replaced, and sums change on the path to
the root alone. Counts of pre-tokens come from the byte-level BPE vocabulary.

Defined results: a null text counts as empty; edits beyond the end act at the
end, a stop before its start counts as the start, null edits and a null
replacement insert nothing; edits act in order, each on the text as the ones
before left it; rows that repeat a doc_id give a row each; extra columns are
ignored. A log of edits streams through its document's tree: edits of an unknown
or null doc_id act on nothing, those of equal seq go by start, stop and text.
"""

from __future__ import annotations

import base64
import functools
import hashlib

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridstat.llm.common import map_arrow, materialize, read_table, small_batches, texts_of

LEAF = 64  # pre-tokens of a leaf
CACHED_CHARS = 48
CACHED_WORDS = 300_000


class Counter:
    """Token counts of pre-tokens, with a bounded cache of short ones."""

    def __init__(self, ranks_path: str, pattern: str):
        import tiktoken

        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.pattern = regex.compile(pattern)
        self.encoding = tiktoken.Encoding("counts", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.known: dict[str, int] = {}

    def count(self, word: str) -> int:
        n = self.known.get(word)
        if n is None:
            n = len(self.encoding.encode_ordinary(word))
            if len(word) <= CACHED_CHARS:
                if len(self.known) >= CACHED_WORDS:
                    for old in list(self.known)[: CACHED_WORDS // 2]:
                        del self.known[old]
                self.known[word] = n
        return n

    def counts(self, words: list[str]) -> list[int]:
        get, count = self.known.get, self.count
        return [get(w) or count(w) for w in words]


class Node:
    """A leaf (words with their counts) or an inner node; sums of characters, tokens and leaves below, and the height."""

    __slots__ = ("chars", "counts", "height", "leaves", "left", "right", "tokens", "words")

    def __init__(self, words=None, counts=None, left=None, right=None):
        self.words, self.counts, self.left, self.right = words, counts, left, right
        if left is None:
            self.chars, self.tokens, self.leaves, self.height = sum(map(len, words)), sum(counts), 1, 0
        else:
            self.chars, self.tokens, self.leaves = left.chars + right.chars, left.tokens + right.tokens, left.leaves + right.leaves
            self.height = 1 + max(left.height, right.height)


def _grown(leaves: list[Node]) -> Node | None:
    """A balanced tree of nodes in order."""
    while len(leaves) > 1:
        pairs = [Node(left=a, right=b) for a, b in zip(leaves[::2], leaves[1::2], strict=False)]
        if len(leaves) % 2:  # the odd one joins the last pair, so that heights stay close
            pairs[-1] = _joined(pairs[-1], leaves[-1])
        leaves = pairs
    return leaves[0] if leaves else None


def _joined(a: Node | None, b: Node | None) -> Node | None:
    """The tree of two balanced trees in order: the lower one goes down the edge of the higher one, which is turned where it leans."""
    if a is None or b is None:
        return b if a is None else a
    if a.height > b.height + 1:
        return _turned(a.left, _joined(a.right, b))
    if b.height > a.height + 1:
        return _turned(_joined(a, b.left), b.right)
    return Node(left=a, right=b)


def _turned(a: Node, b: Node) -> Node:
    """A node over two trees whose heights differ by two at most."""
    if a.height > b.height + 1:
        if a.left.height >= a.right.height:
            return Node(left=a.left, right=Node(left=a.right, right=b))
        return Node(left=Node(left=a.left, right=a.right.left), right=Node(left=a.right.right, right=b))
    if b.height > a.height + 1:
        if b.right.height >= b.left.height:
            return Node(left=Node(left=a, right=b.left), right=b.right)
        return Node(left=Node(left=a, right=b.left.left), right=Node(left=b.left.right, right=b.right))
    return Node(left=a, right=b)


def _parted(node: Node | None, k: int) -> tuple[Node | None, Node | None]:
    """Trees of the first k leaves and of the others; subtrees are shared."""
    if node is None or k <= 0:
        return None, node
    if k >= node.leaves:
        return node, None
    if k < node.left.leaves:
        first, rest = _parted(node.left, k)
        return first, _joined(rest, node.right)
    first, rest = _parted(node.right, k - node.left.leaves)
    return _joined(node.left, first), rest


def _spliced(node: Node | None, first: int, end: int, new: Node | None) -> Node | None:
    """The tree with leaves [first, end) replaced; sums on the paths to the cuts are computed anew."""
    before, rest = _parted(node, first)
    return _joined(_joined(before, new), _parted(rest, end - first)[1])


class CountedText:
    """A text with its token count, kept up to date through edits."""

    def __init__(self, text: str, counter: Counter):
        self.counter = counter
        words = counter.pattern.findall(text)
        self.root = _grown(self._leaves(words, counter.counts(words)))
        self.encoded_chars = 0  # characters that edits had encoded again

    @staticmethod
    def _leaves(words: list[str], counts: list[int]) -> list[Node]:
        return [Node(words[i : i + LEAF], counts[i : i + LEAF]) for i in range(0, len(words), LEAF)]

    @property
    def tokens(self) -> int:
        return self.root.tokens if self.root else 0

    @property
    def chars(self) -> int:
        return self.root.chars if self.root else 0

    def leaf(self, k: int) -> Node:
        node = self.root
        while node.left is not None:
            if k < node.left.leaves:
                node = node.left
            else:
                k -= node.left.leaves
                node = node.right
        return node

    def find(self, at: int) -> tuple[int, int]:
        """(number of the leaf that holds a position, where that leaf begins)."""
        node, k, begin = self.root, 0, 0
        while node.left is not None:
            if at < begin + node.left.chars:
                node = node.left
            else:
                begin += node.left.chars
                k += node.left.leaves
                node = node.right
        return k, begin

    def text(self) -> str:
        out, todo = [], [self.root] if self.root else []
        while todo:
            node = todo.pop()
            if node.left is None:
                out += node.words
            else:
                todo += [node.right, node.left]
        return "".join(out)

    def edit(self, start: int, stop: int, new: str) -> None:
        """Replace the characters [start, stop)."""
        size = self.chars
        start = min(max(start, 0), size)
        stop = min(max(stop, start), size)
        if not size:
            words = self.counter.pattern.findall(new)
            self.root = _grown(self._leaves(words, self.counter.counts(words)))
            self.encoded_chars += len(new)
            return
        first, begin = self.find(max(0, start - 1))
        held = self.leaf(first)
        # The pre-token before the one that is touched, maybe in the leaf before.
        at, k = begin, 0
        while k < len(held.words) and at + len(held.words[k]) < start:
            at += len(held.words[k])
            k += 1
        words, counts, end = list(held.words), list(held.counts), first + 1
        for _ in range(2):
            if k == 0 and first > 0:
                first -= 1
                before = self.leaf(first)
                words, counts, k, begin = before.words + words, before.counts + counts, len(before.words), begin - before.chars
            if k > 0:
                k -= 1
                at -= len(words[k])
        # Leaves enough to reach a cut beyond the edit.
        total = self.root.leaves
        reach = begin + sum(map(len, words))
        while True:
            while reach < stop and end < total:
                more = self.leaf(end)
                words, counts, end, reach = words + more.words, counts + more.counts, end + 1, reach + more.chars
            made, rest = self._again(words, k, at, start, stop, new, end == total)
            if made is not None or end == total:
                break
            more = self.leaf(end)
            words, counts, end, reach = words + more.words, counts + more.counts, end + 1, reach + more.chars
        fresh = self.counter.counts(made)
        self.encoded_chars += sum(map(len, made))
        leaves = self._leaves(words[:k] + made + words[rest:], counts[:k] + fresh + counts[rest:])
        self.root = _spliced(self.root, first, end, _grown(leaves))

    def _again(self, words: list[str], k: int, at: int, start: int, stop: int, new: str, last: bool) -> tuple[list[str] | None, int]:
        """(pre-tokens from word k on, first old word that stays); (None, 0) if that takes more text."""
        old = "".join(words[k:])
        text = old[: start - at] + new + old[stop - at :]
        shift = len(new) - (stop - start)  # from old places to new ones, beyond the edit
        cuts, place = {}, at
        for i in range(k, len(words)):
            if place >= stop:
                cuts[place - at + shift] = i
            place += len(words[i])
        made: list[str] = []
        for m in self.counter.pattern.finditer(text):
            if m.start() in cuts and m.start() >= start - at + len(new) and m.end() < len(text):
                return made, cuts[m.start()]
            made.append(m[0])
        return (made, len(words)) if last else (None, 0)


@functools.cache
def counter_of(ranks_path: str, pattern: str) -> Counter:
    return Counter(ranks_path, pattern)


def drop_kept() -> None:
    """Forget what this worker process keeps for later tasks."""
    counter_of.cache_clear()


OUT = "doc_id long, n_tokens long, n_tokens_edited long, n_chars_edited long, encoded_chars long, edited_sha256 string"


def count_through_edits(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """Counts before and after each row's `edits` (array of start, stop, text), characters counted from 0. Row-local."""

    def task():
        counter = counter_of(ranks_path, pattern)

        def one(batch: pa.RecordBatch) -> pa.RecordBatch:
            rows = []
            edits = batch.column(batch.schema.get_field_index("edits")).to_pylist()
            for text, own in zip(texts_of(batch), edits, strict=True):
                counted = CountedText(text, counter)
                before = counted.tokens
                for e in own or ():
                    if e is not None:
                        counted.edit(e["start"] or 0, e["stop"] or 0, e["text"] or "")
                sha = hashlib.sha256(counted.text().encode("utf-8", "surrogatepass")).hexdigest()
                rows.append((before, counted.tokens, counted.chars, counted.encoded_chars, sha))
            return _counted([(i, *r) for i, r in zip(batch.column(0).to_pylist(), rows, strict=True)])

        return one

    return map_arrow(docs.select("doc_id", "text", "edits"), task, OUT)


def count_through_log(docs: DataFrame, log: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """Counts of every row before and after the edits of a log (doc_id, seq, start, stop, text), in order of seq.

    Rows get a number, which the edits of their document take over; both are
    dealt by it and sorted, and tasks stream: a task holds one document's tree
    and one edit at a time, however long the log.
    """
    rows = materialize(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("row", F.monotonically_increasing_id()))
    place = lambda c: F.col(c).cast("long").alias(c)
    edits = log.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("seq").cast("long").alias("seq"), place("start"), place("stop"), "text")
    edits = edits.join(rows.where("doc_id is not null").select("doc_id", "row"), "doc_id").withColumn("edit", F.lit(True))
    none = F.lit(None).cast("long")
    first = rows.select("doc_id", none.alias("seq"), none.alias("start"), none.alias("stop"), "text", "row", F.lit(False).alias("edit"))
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = first.unionByName(edits).repartition(n, "row").sortWithinPartitions("row", "edit", "seq", "start", "stop", "text")
    small_batches(docs.sparkSession)

    def run(batches):
        counter, held, out = counter_of(ranks_path, pattern), None, []

        def done():
            doc_id, counted, before = held
            sha = hashlib.sha256(counted.text().encode("utf-8", "surrogatepass")).hexdigest()
            out.append((doc_id, before, counted.tokens, counted.chars, counted.encoded_chars, sha))

        for batch in batches:
            at = batch.schema.get_field_index
            for doc_id, start, stop, text, edit in zip(*(batch.column(at(c)).to_pylist() for c in ("doc_id", "start", "stop", "text", "edit")), strict=True):
                if edit:
                    held[1].edit(start or 0, stop or 0, text or "")
                    continue
                if held is not None:
                    done()
                counted = CountedText(text or "", counter)
                held = doc_id, counted, counted.tokens
            if len(out) >= 256:
                yield _counted(out)
                out = []
        if held is not None:
            done()
        if out:
            yield _counted(out)

    return dealt.mapInArrow(run, OUT)


def _counted(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [*[pa.int64()] * 5, pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=[c.split()[0] for c in OUT.split(", ")])


def sample_edits(text: F.Column) -> F.Column:
    """Three edits made of a text itself: an insertion at a third, a deletion at two thirds, a few words at the end."""
    n = F.length(text).cast("long")
    edit = lambda a, b, t: F.struct(a.cast("long").alias("start"), b.cast("long").alias("stop"), t.alias("text"))
    return F.array(
        edit(F.floor(n / 3), F.floor(n / 3), F.substring(text, 1, 12)),
        edit(F.floor(2 * n / 3), F.floor(2 * n / 3) + F.floor(n / 50), F.lit("")),
        edit(n + 12, n + 12, F.concat(F.lit(" "), F.substring(text, 1, 40))),
    )


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of all of `documents` before and after three edits each."""
    import public_tokenizers

    docs = read_table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return count_through_edits(
        docs.withColumn("edits", sample_edits(F.col("text"))), str(public_tokenizers.path("byte_bpe_50k.tiktoken")), public_tokenizers.PATTERN
    )
