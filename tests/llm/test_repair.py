import hashlib
import itertools
import random
import re
import zlib

import pytest
from compare import assert_same

from gridstat.llm import repair as R

SCHEMA = "conv_id long, turn long, role string, text string"


def plain_edits(rows, legal=r"(s?(ua)+)?"):
    """The cheapest edits of (role, text, must go, faulty) rows, by trying all of them with two inserts at most at a place."""
    inserts = [(), *itertools.product("ua", repeat=1), *itertools.product("ua", repeat=2)]
    best = None

    def go(at, cost, audit, out):
        nonlocal best
        for ins in inserts:
            c, a, o = cost + 3 * len(ins), audit + "I" * len(ins), [*out, *((i, "") for i in ins)]
            if best and c > best[0]:
                continue
            if at == len(rows):
                if re.fullmatch(legal, "".join(r[:1] for r, _ in o)) and (best is None or (c, a) < best[:2]):
                    best = (c, a, o)
                continue
            role, text, gone, faulty = rows[at]
            go(at + 1, c + 4, a + "D", o)
            if not gone:
                go(at + 1, c + 3 * faulty, a + "K", [*o, (role, text)])
                for r in "ua":
                    go(at + 1, c + 3 + 3 * faulty, a + "R", [*o, (r, text)])

    go(0, 0, "", [])
    names = {"u": "user", "a": "assistant"}
    return best[0], best[1], hashlib.sha256("\n".join(f"{names.get(r, r)}:{t}" for r, t in best[2]).encode()).hexdigest()


def run(rows, grammar=R.ROLES):
    chart = R.Chart(R._Tables(grammar))
    for role, text, gone, faulty in rows:
        chart.read(role.encode(), text.encode(), gone, faulty)
    cost, plan, digest = chart.finish()
    return cost, "".join(e for e, _ in R.edits_of(plan)), digest


def test_chart_agrees_with_trying_everything():
    rng = random.Random(5)
    for _ in range(300):
        rows = [(rng.choice(["user", "assistant", "system", " ", "tool", "sam"]), rng.choice(["a.", "b", "c!"]), rng.random() < 0.2, rng.random() < 0.3) for _ in range(rng.randint(0, 4))]
        assert run(rows) == plain_edits(rows), rows


def test_other_grammars():
    once = R.Grammar((("S", ("T", "a")), ("T", ("u",)), ("T", ("T", "t"))), (("u", "user"), ("t", "tool")))
    rng = random.Random(6)
    for _ in range(60):
        rows = [(rng.choice(["user", "assistant", "tool"]), "x", rng.random() < 0.2, False) for _ in range(rng.randint(1, 4))]
        cost, audit, _ = run([*rows, ("assistant", "end", False, False)], once)
        assert audit and cost >= 0 and audit[-1] == "K"
    with pytest.raises(ValueError):
        R.Grammar((("S", ("a", "S")),), ())
    with pytest.raises(ValueError):
        R.Grammar((("S", ("a",)),), (), insert=0)


def test_audits_that_never_meet_stay_cheap():
    """Roles that nobody may keep: two ways of numbering them stay alive to the end."""
    rows = [("tool", f"{i}.", False, False) for i in range(20_000)]
    cost, audit, _ = run(rows)
    assert cost == 60_000 and audit == "R" * 20_000
    assert run(rows[:-1])[1] == "D" + "R" * 19_998
    assert run(rows[:4])[:2] == plain_edits(rows[:4])[:2]


def plain(rows):
    """op13 by its contract."""
    out = {}
    for conv in {r[0] for r in rows}:
        said = []
        for c, turn, role, text in rows:
            role, text = " " if role is None else role, " " if text is None else text
            h = zlib.crc32(f"{' ' if c is None else c}:{' ' if turn is None else turn}".encode()) % 20
            if c == conv and h:
                text = "" if h == 1 else re.sub("[.!?]", "", text) if h == 2 else text
                said += [(turn, "user" if h == 4 else role, text)] * (2 if h == 3 else 1)
        said.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        turns = [t for t, _, _ in said if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        blank = again = cut = illegal = 0
        seen, marked = set(), []
        for i, (_, role, text) in enumerate(said):
            told = text.strip(R.WHITE)
            faults = [not told, (role, text) in seen, told[-1:] not in (".", "!", "?")]
            first = faults.index(True) if True in faults else None
            blank, again, cut = blank + (first == 0), again + (first == 1), cut + (first == 2)
            illegal += i > 0 and said[i - 1][1][:1] + role[:1] not in ("su", "ua", "au")
            seen.add((role, text))
            marked.append((role, text, first in (0, 1), first == 2))
        out[conv] = (gaps, blank, again, cut, illegal, *run(marked))
    return out


ODD = [
    (1, 0, "user", "Hi."), (1, 1, "assistant", "Yo."), (2, None, "user", "a."), (2, None, "user", "a."), (2, 5, None, None), (2, 9, "assistant", "b"), (None, 1, "system", "s."), (None, 2, "user", "x"),
    (None, None, "assistant", "\t\x0b "), (3, 7, "", "no role."), (3, 8, "unknown", "e\x85"), (3, 8, "user", "é中🙂!"), (4, 3, "user", "w " * 100_000), (5, 1, "assistant", "a."), (5, 2, "assistant", "a."), (5, 2, "assistant", "a."),
    *((6, i, "tool", "t.") for i in range(60)), *((i, 0, "user", "q?") for i in range(100, 160)),
]


def test_agrees_with_the_contract(spark):
    got = {r[0]: tuple(r)[1:] for r in R.repairs(R.damaged(spark.createDataFrame(ODD, SCHEMA))).drop("plan").collect()}
    assert got == plain(ODD)
    assert (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()) in got.values()


def test_query_agrees_with_sql(spark, data, duck):
    assert_same(R.op13_repair(spark, data).toPandas(), duck.execute(R.OP13_SQL).df())


def test_repaired_messages_are_what_was_hashed(spark, data):
    rows = R.damaged(spark.read.parquet(f"{data}/conversations.parquet")).unionByName(R.damaged(spark.createDataFrame(ODD, SCHEMA)).withColumn("conv_id", R.F.col("conv_id") + 10**6))
    want = {r["conv_id"]: (r["audit"], r["repaired_sha256"]) for r in R.repairs(rows).collect()}
    told: dict = {}
    for r in sorted(R.repaired(rows).collect(), key=lambda r: r["position"]):
        told.setdefault(r["conv_id"], []).append(r)
    for conv, (audit, digest) in want.items():
        out = told.get(conv, [])
        assert hashlib.sha256("\n".join(f"{r['role']}:{r['text']}" for r in out).encode()).hexdigest() == digest
        assert "".join(r["edit"] for r in out) == audit.replace("D", "") and re.fullmatch(r"(s?(ua)+)?", "".join(r["role"][0] for r in out))
        assert all((r["turn"] is None) for r in out if r["edit"] == "I")


def test_whole_conversations_stay_and_empty_tables_pass(spark):
    rows = R.messages(spark.createDataFrame([(1, 0, "user", "Hi."), (1, 1, "assistant", "Yo.")], SCHEMA))
    assert R.repairs(rows).select("cost", "audit").collect() == [(0, "KK")]
    nothing = spark.createDataFrame([], "text string, role string, there int, turn long, conv_id long, plan string, Part int")
    assert R.repairs(R.damaged(nothing)).count() == 0 == R.repaired(R.damaged(nothing)).count()
