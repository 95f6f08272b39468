"""Repair of conversations against search over all edits, and the query against its SQL."""

import hashlib
import heapq
import random
import re
import zlib

import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from logicspark.llm import queries, repair
from tests.conftest import SF


def cheapest(rows):
    """Least cost and then least audit, with its outcome, over (role initial, fault) rows: search in order of both."""
    heap = [(0, "", 0, ())]
    limit = 3 * len(rows) + 1
    while heap:
        cost, audit, at, roles = heapq.heappop(heap)
        if at == len(rows) and re.fullmatch("(s?(ua)+)?", "".join(roles)):
            return cost, audit
        steps = [(2, "I", 0, r) for r in "ua"]
        if at < len(rows):
            role, fault = rows[at]
            steps.append((3, "D", 1, ""))
            if fault not in ("blank", "duplicate"):
                more = fault == "truncated"
                steps += [(more, "K", 1, role)] + [(2 + more, "R", 1, r) for r in "ua"]
        for price, edit, moved, role in steps:
            said = "".join(roles) + role
            if cost + price < limit and re.fullmatch("(s?(ua)*u?)", said):
                heapq.heappush(heap, (cost + price, audit + edit, at + moved, tuple(said)))
    raise AssertionError


LETTER = {"blank": "x", "duplicate": "x", "truncated": "upper", "none": "lower"}


def signature(rows):
    return "".join("x" if LETTER[f] == "x" else getattr(r, LETTER[f])() for r, f in rows)


ROWS = st.lists(st.tuples(st.sampled_from("suao"), st.sampled_from(sorted(LETTER))), max_size=4)


@settings(max_examples=200, deadline=None)
@given(st.lists(ROWS, min_size=1, max_size=4))
def test_cheapest_edits(conversations):
    automaton = repair.Automaton()
    for backward in sorted(signature(rows)[::-1] for rows in conversations):
        rows = next(r for r in conversations if signature(r)[::-1] == backward)
        assert automaton.audit(backward) == cheapest(rows)


def test_suffixes_are_shared():
    rng = random.Random(3)
    backward = sorted("".join(rng.choice("suaAx") for _ in range(rng.randrange(9))) for _ in range(500))
    automaton = repair.Automaton()
    for each in backward:
        automaton.audit(each)
    assert automaton.made == len({b[:k] for b in backward for k in range(1, len(b) + 1)})
    long = automaton.audit("au" * 40_000 + "s")
    assert long == (0, "K" * 80_001)


def faults(rows):
    """Fault of each (role, text) in order."""
    seen, out = set(), []
    for role, text in rows:
        visible = text.strip(repair.SPACES)
        fault = "blank" if not visible else "none" if visible[-1] in ".!?" else "truncated"
        out.append("duplicate" if visible and (role, text) in seen else fault)
        seen.add((role, text))
    return out


def expected(conv_id, rows):
    """Row of the query for (turn, role, text) rows before damage."""
    after = []
    for turn, role, text in rows:
        key = ":".join(" " if x is None else str(x) for x in (conv_id, turn))
        code = zlib.crc32(key.encode()) % 20
        role, text = (" " if x is None else x for x in (role, text))
        text = {1: "", 2: re.sub("[.!?]", "", text)}.get(code, text)
        after += [(turn, "user" if code == 4 else role, text)] * {0: 0, 3: 2}.get(code, 1)
    after.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.md5(r[2].encode()).digest()))
    found = faults([r[1:] for r in after])
    turns = {r[0] for r in after if r[0] is not None}
    initials = [r[1][:1] for r in after]
    cost, audit = cheapest([(i if i in ("s", "u", "a") else "o", f) for i, f in zip(initials, found, strict=True)])
    lines, at, state = [], 0, ""
    for edit in audit:
        following = "a" if state == "u" else "u"
        if edit != "D":
            state = initials[at] if edit == "K" else following
            role = after[at][1] if edit == "K" else {"u": "user", "a": "assistant"}[state]
            lines.append(f"{role}:{after[at][2] if edit != 'I' else ''}")
        at += edit != "I"
    return {
        "conv_id": conv_id,
        "gaps": max(turns) - min(turns) + 1 - len(turns) if turns else 0,
        **{f: found.count(f) for f in ("blank", "duplicate", "truncated")},
        "illegal": sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])),
        "cost": cost,
        "audit": audit,
        "repaired_sha256": hashlib.sha256("\n".join(lines).encode()).hexdigest(),
    }


def by_sql(path):
    con = duckdb.connect()
    con.execute(f"create view conversations as select * from '{path}'")
    result = con.execute(queries.ORACLES["op11_repair"])
    names = [d[0] for d in result.description]
    return sorted((dict(zip(names, r, strict=True)) for r in result.fetchall()), key=repr)


def by_spark(spark, folder):
    return sorted((r.asDict() for r in queries.op11_repair(spark, str(folder)).collect()), key=repr)


def in_order(rows):
    keys = ("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
    return sorted(({k: r[k] for k in keys} for r in rows), key=repr)


def test_query_and_sql(spark):
    turns = {}
    for r in spark.read.parquet(f"{SF}/conversations.parquet").collect():
        turns.setdefault(r["conv_id"], []).append((r["turn"], r["role"], r["text"]))
    want = in_order(expected(k, rows) for k, rows in turns.items())
    assert in_order(by_spark(spark, SF)) == want
    assert in_order(by_sql(f"{SF}/conversations.parquet")) == want


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    """Nulls everywhere, ties, repeated rows, odd roles, gaps, a clashing column, and conversations that vanish."""
    rng = random.Random(11)
    texts = ["Yes.", "yes", "  \n", "", None, "No!\t", "Really?\x0b", ".", "…", "Yes."]
    roles = ["user", "assistant", "system", "unknown", "tool", "", None, "user", "assistant"]
    rows = []
    for conv_id in [*range(60), None]:
        for _ in range(rng.randrange(1, 6)):
            turn = rng.choice([None, 0, 1, 2, 3, 7, -2])
            rows += [(conv_id, turn, rng.choice(roles), rng.choice(texts), 1)] * rng.choice((1, 1, 1, 2))
    rows += [(conv_id, 0, "user", "Alone.", 1) for conv_id in range(100, 160)]
    folder = tmp_path_factory.mktemp("odd")
    turns = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string, digest int")
    turns.write.parquet(f"{folder}/conversations.parquet")
    return folder, rows


def test_cases(spark, odd):
    folder, rows = odd
    turns = {}
    for conv_id, turn, role, text, _ in rows:
        turns.setdefault(conv_id, []).append((turn, role, text))
    want = in_order(expected(k, r) for k, r in turns.items())
    assert in_order(by_spark(spark, folder)) == want
    assert in_order(by_sql(f"{folder}/conversations.parquet/*.parquet")) == want
    vanished = [w for w in want if w["audit"] == ""]
    assert vanished and all(w["repaired_sha256"] == hashlib.sha256(b"").hexdigest() for w in vanished)


def test_repaired_turns(spark):
    long = "word " * 20_000
    rows = [(1, 3, "assistant", long), (1, 1, "user", "Hi."), (1, 2, "user", "And?"), (2, None, "system", "Be brief.")]
    rows = spark.createDataFrame(rows, "conv_id int, turn int, role string, text string").withColumn("place", F.lit(9))
    audits = repair.audited(rows).cache()
    assert {r["conv_id"]: (r["cost"], r["audit"]) for r in audits.collect()} == {1: (3, "KIKK"), 2: (3, "D")}
    fixed = [tuple(r) for r in repair.repaired(rows, audits).orderBy("conv_id", "place").collect()]
    assert fixed == [
        (1, 0, "K", 1, "user", "Hi."),
        (1, 1, "I", None, "assistant", ""),
        (1, 2, "K", 2, "user", "And?"),
        (1, 3, "K", 3, "assistant", long),
    ]
    assert repair.audited(rows.where("false")).collect() == []
