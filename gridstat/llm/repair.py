"""Conversation structure repair: the cheapest edits that bring a conversation's roles into a grammar.

A weighted role grammar says which sequences of roles are legal: a system message at most,
then pairs of user and assistant, or nothing at all. An error-correcting Earley parser reads
a conversation's messages in order. Besides the grammar's productions it has error
productions: a terminal may stand for a message of another role (rerole), for no message
(insert), and a message may be skipped (delete). A chart item keeps the least (cost, audit),
where the audit spells the edits' initials; the completed chart yields the repair.

Role grammars are regular, so productions are left-linear (checked) and every item begins at
the first message: a chart set needs only the one before it and the predictions of set 0.
Audits of a set are kept as ranks of the audits of the set before plus what the message added.
No two of them are a prefix of each other at that point (each has one edit for every message
read), so ranks order them rightly, and a message costs the same work however long the
conversation is. Each live audit has its own running hash of the repaired text; texts are
not held. What a conversation needs in memory are its edits and 16 bytes a message.

A conversation is a key: it is read in order by one task, since its digest hashes its text
in order. Different conversations are dealt by their hash.

Defined results: null role and text read as one space; turns in order, null first, ties by
role, then text; rows without conv_id are one conversation; repeated rows are duplicates; a
conversation without messages has zeros, an empty audit and the empty text's hash; an empty
table gives an empty result; a very long text is hashed, never split; other columns are not
looked at. Only a role's first character counts, so a kept message keeps its role's name.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridstat.llm.common import read_table, small_batches

#: What counts as blank in a text.
WHITE = " \t\n\x0b\x0c\r"
#: Characters that may end a whole text.
ENDS = ".!?"


@dataclass(frozen=True)
class Grammar:
    """Productions (name, symbols) over initials of roles, and the costs of edits.

    A symbol is the name of a production or a terminal, one lower-case letter. `writable`
    names the roles that an edit may give to a message. The first production's name is the start.
    """

    productions: tuple[tuple[str, tuple[str, ...]], ...]
    writable: tuple[tuple[str, str], ...]
    rerole: int = 3
    delete: int = 4
    insert: int = 3
    faulty: int = 3

    def __post_init__(self):
        names = {name for name, _ in self.productions}
        for name, symbols in self.productions:
            if any(s in names for s in symbols[1:]):
                raise ValueError(f"{name}: a production may only begin with another one's name")
            if any(s not in names and not (len(s) == 1 and s.islower()) for s in symbols):
                raise ValueError(f"{name}: a terminal is one lower-case letter")
        if min(self.rerole, self.delete, self.insert) <= 0 or self.faulty < 0:
            raise ValueError("edits cost more than nothing")


#: (s?(ua)+)?
ROLES = Grammar(
    productions=(
        ("Dialogue", ()), ("Dialogue", ("Pairs",)), ("Pairs", ("Asked", "a")),
        ("Asked", ("u",)), ("Asked", ("Instructed", "u")), ("Asked", ("Pairs", "u")), ("Instructed", ("s",)),
    ),
    writable=(("u", "user"), ("a", "assistant")),
)

#: A value of a chart item: cost, rank of the audit up to the message before, initials added since, and the same with roles.
Value = tuple[int, int, str, str]
Item = tuple[int, int]


class _Tables:
    """What a grammar says about each item (production, dot)."""

    def __init__(self, grammar: Grammar):
        rules = grammar.productions
        names, self.start = {n for n, _ in rules}, rules[0][0]
        self.grammar, self.names = grammar, dict(grammar.writable)
        self.terminal: dict[Item, str] = {}
        self.complete: dict[Item, str] = {}
        #: Items of set 0 that wait for a name, moved over it.
        self.moved: dict[str, list[Item]] = {n: [] for n in names}
        for p, (name, symbols) in enumerate(rules):
            for dot in range(len(symbols) + 1):
                if dot == len(symbols):
                    self.complete[p, dot] = name
                elif symbols[dot] in names:
                    self.moved[symbols[dot]].append((p, 1))
                else:
                    self.terminal[p, dot] = symbols[dot]
        predicted, waiting = set(), [self.start]
        while waiting:
            name = waiting.pop()
            if name not in predicted:
                predicted.add(name)
                waiting += [s[0] for n, s in rules if n == name and s and s[0] in names]
        self.first = [(p, 0) for p, (n, _) in enumerate(rules) if n in predicted]
        self.ends = [i for i, n in self.complete.items() if n == self.start]
        self.skips = set(self.terminal) | set(self.ends)


class _Node:
    """An audit that some chart item of the present set ends: its last edits, the node before, and its repaired text's hash."""

    __slots__ = ("before", "edits", "hash", "said")

    def __init__(self, before: _Node | None, edits: str):
        self.before, self.edits = before, edits
        self.hash = before.hash.copy() if before else hashlib.sha256()
        self.said = before.said if before else False

    def say(self, role: bytes, text: bytes) -> None:
        self.hash.update(b"\n" + role + b":" if self.said else role + b":")
        self.hash.update(text)
        self.said = True


def edits_of(plan: str) -> Iterator[tuple[str, str]]:
    """(initial, role's initial or nothing) of each edit of a plan such as `KRaIu`."""
    at = 0
    while at < len(plan):
        wide = 1 + (plan[at] in "RI")
        yield plan[at], plan[at + 1 : at + wide]
        at += wide


class Chart:
    """The chart of one conversation, a set at a time."""

    def __init__(self, tables: _Tables):
        self.t = tables
        self.nodes = [_Node(None, "")]
        self.items = self._closed({i: (0, 0, "", "") for i in tables.first})

    def _closed(self, kernel: dict[Item, Value]) -> dict[Item, Value]:
        """Complete and insert until nothing gets cheaper."""
        t, insert, found, open_ = self.t, self.t.grammar.insert, dict(kernel), list(kernel)

        def offer(item: Item, value: Value) -> None:
            if item not in found or value < found[item]:
                found[item] = value
                open_.append(item)

        while open_:
            item = open_.pop()
            cost, rank, audit, plan = value = found[item]
            name = t.complete.get(item)
            if name is not None:
                for moved in t.moved[name]:
                    offer(moved, value)
            else:
                role = t.terminal.get(item)
                if role in t.names:
                    offer((item[0], item[1] + 1), (cost + insert, rank, audit + "I", plan + "I" + role))
        return found

    def read(self, role: bytes, text: bytes, must_go: bool, faulty: bool) -> None:
        """The set after one message."""
        t, g = self.t, self.t.grammar
        initial, more = role.decode("utf-8", "replace")[:1], g.faulty if faulty else 0
        kernel: dict[Item, Value] = {}

        def offer(item: Item, value: Value) -> None:
            if item not in kernel or value < kernel[item]:
                kernel[item] = value

        for item, (cost, rank, audit, plan) in self.items.items():
            if item in t.skips:
                offer(item, (cost + g.delete, rank, audit + "D", plan + "D"))
            wanted = t.terminal.get(item)
            if wanted is None or must_go:
                continue
            if wanted == initial:
                offer((item[0], item[1] + 1), (cost + more, rank, audit + "K", plan + "K"))
            elif wanted in t.names:
                offer((item[0], item[1] + 1), (cost + g.rerole + more, rank, audit + "R", plan + "R" + wanted))
        heads = sorted({(rank, audit, plan) for _, rank, audit, plan in kernel.values()})
        order = {h[:2]: n for n, h in enumerate(heads)}
        nodes = []
        for rank, _, plan in heads:
            node = _Node(self.nodes[rank], plan)
            self._say(node, plan, role, text)
            nodes.append(node)
        self.nodes = nodes
        self.items = self._closed({i: (cost, order[rank, audit], "", "") for i, (cost, rank, audit, _) in kernel.items()})

    def _say(self, node: _Node, plan: str, role: bytes, text: bytes) -> None:
        for edit, given in edits_of(plan):
            if edit == "K":
                node.say(role, text)
            elif edit != "D":
                node.say(self.t.names[given].encode(), text if edit == "R" else b"")

    def finish(self) -> tuple[int, str, str]:
        """Cost, plan and repaired text's hash of the cheapest repair."""
        cost, rank, _, plan = min(self.items[i] for i in self.t.ends if i in self.items)
        node = _Node(self.nodes[rank], plan)
        self._say(node, plan, b"", b"")
        digest, parts = node.hash.hexdigest(), []
        at: _Node | None = node
        while at is not None:
            parts.append(at.edits)
            at = at.before
        return cost, "".join(reversed(parts)), digest


class _Face:
    """Faults of a conversation, counted as its messages come."""

    def __init__(self):
        self.seen: set[bytes] = set()
        self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.least = self.turn = None
        self.initial: str | None = None

    def look(self, turn: int | None, role: bytes, text: bytes, blank: bool, cut: bool) -> tuple[bool, bool]:
        """Whether the message must go, and whether it is truncated."""
        if turn is not None and turn != self.turn:
            self.least = turn if self.least is None else self.least
            self.turns, self.turn = self.turns + 1, turn
        initial = role.decode("utf-8", "replace")[:1]
        if self.initial is not None and self.initial + initial not in ("su", "ua", "au"):
            self.illegal += 1
        self.initial = initial
        key = hashlib.blake2b(b"%d:" % len(role) + role, digest_size=16)
        key.update(text)
        again = key.digest() in self.seen
        self.seen.add(key.digest())
        self.blank += blank
        self.duplicate += again and not blank
        cut = cut and not blank and not again
        self.truncated += cut
        return blank or again, cut

    @property
    def gaps(self) -> int:
        return 0 if self.least is None else self.turn - self.least + 1 - self.turns


def messages(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, there): the messages with their defaults; all of them are there."""
    return conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        *(F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")), F.lit(True).alias("there"),
    )


def damaged(conversations: DataFrame) -> DataFrame:
    """The messages with the damage that op13 repairs, by a hash of conversation and turn."""
    conv, turn = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn"))
    by = F.crc32(F.concat(conv, F.lit(":"), turn).cast("binary")) % 20
    hurt = messages(conversations).select(
        "conv_id", "turn", F.when(by == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(by == 1, "").when(by == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")).alias("text"),
        (by != 0).alias("there"), F.when(by == 3, 2).otherwise(1).alias("times"),
    )
    return hurt.withColumn("time", F.explode(F.sequence(F.lit(1), F.col("times")))).drop("times", "time")


def _in_order(rows: DataFrame, *first: str) -> DataFrame:
    """Whole conversations in a partition, their messages in order."""
    spark = rows.sparkSession
    small_batches(spark, 500)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(n, "conv_id").sortWithinPartitions("conv_id", *first, F.asc_nulls_first("turn"), "role", "text")


def _rows(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)


def _batch(rows: list[tuple], columns: list[tuple[str, pa.DataType]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows, strict=True), columns, strict=True)], names=[n for n, _ in columns])


_COUNTS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
_FOUND = [("conv_id", pa.int64()), *((c, pa.int64()) for c in _COUNTS), ("audit", pa.string()), ("repaired_sha256", pa.string()), ("plan", pa.string())]


def repairs(rows: DataFrame, grammar: Grammar = ROLES) -> DataFrame:
    """A row a conversation: faults, cost and audit of the cheapest repair, the repaired text's hash, and
    the plan (the audit with the role's initial after each rerole and insert)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables, out = _Tables(grammar), []
        for conv_id, said in groupby(_rows(batches), key=lambda r: r[0]):
            chart, face = Chart(tables), _Face()
            for _, turn, role, text, there, blank, cut in said:
                if there:
                    chart.read(role, text, *face.look(turn, role, text, blank, cut))
            cost, plan, digest = chart.finish()
            audit = "".join(e for e, _ in edits_of(plan))
            out.append((conv_id, face.gaps, face.blank, face.duplicate, face.truncated, face.illegal, cost, audit, digest, plan))
            if len(out) >= 500:
                yield _batch(out, _FOUND)
                out = []
        if out:
            yield _batch(out, _FOUND)

    told = F.rtrim(F.col("text"), F.lit(WHITE))
    looked = _in_order(rows).select(
        "conv_id", "turn", F.col("role").cast("binary").alias("role"), F.col("text").cast("binary").alias("text"), "there",
        (told == "").alias("blank"), (~F.right(told, F.lit(1)).isin(*ENDS)).alias("cut"),
    )
    return looked.mapInArrow(run, f"conv_id long, {', '.join(f'{c} long' for c in _COUNTS)}, audit string, repaired_sha256 string, plan string")


_TOLD = [("conv_id", pa.int64()), ("position", pa.int64()), ("role", pa.string()), ("text", pa.string()), ("edit", pa.string()), ("turn", pa.int64())]


def repaired(rows: DataFrame, grammar: Grammar = ROLES) -> DataFrame:
    """(conv_id, position, role, text, edit, turn): the repaired conversations; an inserted message has no turn."""
    plans = repairs(rows, grammar).select("conv_id", F.lit(None).cast("long").alias("turn"), F.lit("").alias("role"), F.col("plan").alias("text"), F.lit(0).alias("part"))
    both = plans.unionByName(rows.where("there").select("conv_id", "turn", "role", "text", F.lit(1).alias("part")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, out = dict(grammar.writable), []
        for conv_id, said in groupby(_rows(batches), key=lambda r: r[0]):
            position = 0
            for edit, given in edits_of(next(said)[3]):
                _, turn, role, text, _ = next(said) if edit != "I" else (None, None, "", "", None)
                if edit != "D":
                    out.append((conv_id, position, names[given] if given else role, text, edit, turn))
                    position += 1
                if len(out) >= 500:
                    yield _batch(out, _TOLD)
                    out = []
        if out:
            yield _batch(out, _TOLD)

    ordered = _in_order(both, "part").select("conv_id", "turn", "role", "text", "part")
    return ordered.mapInArrow(run, "conv_id long, position long, role string, text string, edit string, turn long")


def op13_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Damage all of `conversations`, repair them, and report faults and repairs."""
    return repairs(damaged(read_table(spark, sf_dir, "conversations"))).drop("plan")


# --- SQL: the same least edits by states (z nothing yet, s system, u user, a assistant) instead of a chart.
# A state is {k: cost in twelve digits and audit, o: repaired lines}.


def _sql_add(state: str, cost: str, edit: str, line: str = "''") -> str:
    return f"CASE WHEN {state} IS NOT NULL THEN {{'k': lpad(CAST(CAST({state}.k[1:12] AS BIGINT) + {cost} AS VARCHAR), 12, '0') || {state}.k[13:] || '{edit}', 'o': {state}.o || {line}}} END"


_SAID, _NEW_U, _NEW_A = "chr(10) || r.role || ':' || r.text", "chr(10) || 'user:'", "chr(10) || 'assistant:'"
_MAY = "NOT r.must_go"


def _sql_scan(sources: str, initial: str, name: str | None) -> list[str]:
    out = []
    for s in sources:
        out.append(f"CASE WHEN {_MAY} AND r.initial = '{initial}' THEN {_sql_add(f'p.{s}', 'r.more', 'K', _SAID)} END")
        if name:
            out.append(f"CASE WHEN {_MAY} AND r.initial <> '{initial}' THEN {_sql_add(f'p.{s}', 'r.more + 3', 'R', f'''chr(10) || '{name}:' || r.text''')} END")
    return out


_CLOSED = f"""least(k.u, {", ".join(_sql_add(f"k.{s}", "3", "I", _NEW_U) for s in "zsa")}) AS u,
  least(k.a, {_sql_add("k.u", "3", "I", _NEW_A)}, {", ".join(_sql_add(f"k.{s}", "6", "II", f"{_NEW_U} || {_NEW_A}") for s in "zs")}) AS a"""

OP13_SQL = rf"""
WITH RECURSIVE bytes AS (
  SELECT list(list_reduce(list_concat([i], range(8)), lambda c, b: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS crc FROM range(256) t(i)
), keyed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS id FROM conversations
), hashed AS (
  SELECT conv_id, turn, role, text, xor(4294967295, list_reduce(
    list_concat([4294967295], list_transform(range(1, length(id) + 1), lambda i: CAST(ascii(id[i]) AS BIGINT))),
    lambda c, b: xor(c >> 8, crc[(xor(c, b) & 255) + 1]))) % 20 AS h FROM keyed, bytes
), hurt AS (
  SELECT conv_id, turn, CASE h WHEN 4 THEN 'user' ELSE role END AS role,
    CASE h WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM hashed, range(CASE h WHEN 3 THEN 2 ELSE 1 END) WHERE h <> 0
), placed AS (
  SELECT *, rtrim(text, concat(' ', chr(9), chr(10), chr(11), chr(12), chr(13))) AS told, role[1] AS initial,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS n FROM hurt
), faults AS (
  SELECT *, told = '' AS blank, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY n) > 1 AS again,
    told <> '' AND right(told, 1) NOT IN ('.', '!', '?') AS cut,
    lag(initial) OVER (PARTITION BY conv_id ORDER BY n) || initial NOT IN ('su', 'ua', 'au') AS bad FROM placed
), r AS (SELECT *, blank OR again AS must_go, CASE WHEN cut AND NOT blank AND NOT again THEN 3 ELSE 0 END AS more FROM faults),
ids AS (SELECT DISTINCT conv_id FROM conversations),
start AS (SELECT conv_id, {{'k': '000000000000', 'o': ''}} AS z, CAST(NULL AS STRUCT(k VARCHAR, o VARCHAR)) AS s, CAST(NULL AS STRUCT(k VARCHAR, o VARCHAR)) AS u, CAST(NULL AS STRUCT(k VARCHAR, o VARCHAR)) AS a FROM ids),
p AS (
  SELECT k.conv_id, CAST(0 AS BIGINT) AS n, k.z, k.s, {_CLOSED} FROM start k
  UNION ALL
  SELECT k.conv_id, k.n, k.z, k.s, {_CLOSED} FROM (
    SELECT p.conv_id, r.n,
      {_sql_add("p.z", "4", "D")} AS z,
      least({_sql_add("p.s", "4", "D")}, {", ".join(_sql_scan("z", "s", None))}) AS s,
      least({_sql_add("p.u", "4", "D")}, {", ".join(_sql_scan("zsa", "u", "user"))}) AS u,
      least({_sql_add("p.a", "4", "D")}, {", ".join(_sql_scan("u", "a", "assistant"))}) AS a
    FROM p JOIN r ON p.conv_id IS NOT DISTINCT FROM r.conv_id AND r.n = p.n + 1) k
), ended AS (SELECT conv_id, least(z, a) AS best, row_number() OVER (PARTITION BY conv_id ORDER BY n DESC) AS back FROM p),
counts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE blank) AS blank,
    count(*) FILTER (WHERE again AND NOT blank) AS duplicate, count(*) FILTER (WHERE more > 0) AS truncated, count(*) FILTER (WHERE bad) AS illegal FROM r GROUP BY conv_id
)
SELECT e.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
  coalesce(illegal, 0) AS illegal, CAST(best.k[1:12] AS BIGINT) AS cost, best.k[13:] AS audit, sha256(best.o[2:]) AS repaired_sha256
FROM ended e LEFT JOIN counts c ON e.conv_id IS NOT DISTINCT FROM c.conv_id WHERE back = 1
"""
