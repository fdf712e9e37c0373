"""Conversation repair against an enumeration of all edits, and the query against its SQL."""

from __future__ import annotations

import random
import re
import time

import pytest

from mediaweave.llm import repair as R
from mediaweave.llm.queries import ORACLES
from tests.test_oracles import SF_DIR, rows
from tests.test_oracles import duck as duck  # a fixture


def enumerated(codes: bytes) -> tuple[int, str]:
    """All sequences of edits with at most two inserts between turns, by what they say: no states, bounds or dominance."""
    ways = [(0, "", "")]
    for code in codes:
        fault, role = divmod(code, 4)
        new = set()
        for cost, audit, initials in ways:
            for more in ("", "u", "a", "ua", "au"):
                c, a, i = cost + 5 * len(more), audit + "I" * len(more), initials + more
                new.add((c + 2, a + "D", i))
                if fault != R.USELESS:
                    stays = c + 5 * (fault == R.TRUNCATED)
                    new.add((stays, a + "K", i + R.ROLES[role]))
                    new |= {(stays + 1, a + "R", i + to) for to in "ua"}
        ways = [w for w in new if re.fullmatch("(s?(ua)*u?)?", w[2])]
    ends = [(c + 5 * len(m), a + "I" * len(m)) for c, a, i in ways for m in ("", "u", "a", "ua") if re.fullmatch("(s?(ua)+)?", i + m)]
    return min(ends)


def test_the_search_finds_the_cheapest_and_least():
    draw = random.Random(12)
    for n in [0, *[1] * 12, *[2] * 30, *[3] * 60, *[4] * 25]:
        codes = bytes(draw.randrange(12) for _ in range(n))
        assert R.solve(codes) == enumerated(codes), codes
        assert R.solve(codes, block=2) == enumerated(codes), codes


def test_blocks_change_nothing():
    draw = random.Random(7)
    for n in (5, 40, 333):
        codes = bytes(draw.choice([0, 1, 1, 2, 2, 3, 5, 6, 9, 10]) for _ in range(n))
        assert len({R.solve(codes, block) for block in (1, 3, 64, 1000)}) == 1


def test_bounds_hold_where_they_are_loose():
    """The search itself is exact: with bounds of nothing it finds the same, with more work."""
    draw = random.Random(4)
    for _ in range(40):
        codes = bytes(draw.randrange(12) for _ in range(draw.randrange(1, 7)))
        loose = [[0.0 if q in R.WHOLE or i < len(codes) else 5.0 for q in range(4)] for i in range(len(codes) + 1)]
        assert R.search(codes, loose, R.START, last=True)[:2] == R.solve(codes)


def test_a_very_long_conversation_takes_linear_time():
    draw = random.Random(1)
    codes = bytes(draw.choice([1, 2, 3, 6, 9]) for _ in range(100_000))
    began = time.process_time()
    cost, audit = R.solve(codes)
    assert time.process_time() - began < 60 and len(audit.replace("I", "")) == len(codes) and cost > 0


SHAPE = "conv_id long, turn long, role string, text string"


def repaired(spark, given, shape=SHAPE):
    rows_ = R.ordered(spark.createDataFrame(given, shape))
    found = R.plans(R.faults(rows_))
    turns = R.repaired(rows_, found)
    return {r.conv_id: r for r in found.collect()}, [(r.conv_id, r.edit, r.role, r.text) for r in sorted(turns.collect(), key=lambda r: (r.conv_id is None, r.conv_id, r.place))], {r.conv_id: r.sha256 for r in R.hashes(turns).collect()}


def test_repairs(spark):
    given = [
        (1, 0, "system", "Be brief."), (1, 1, "user", "Hi?"), (1, 3, "user", "Hello."),  # a hole, and two users
        (2, 0, "user", " \n"), (2, 1, "user", "Why?"), (2, 1, "user", "Why?"), (2, 2, "assistant", "So it is.\t"),  # blank, twice
        (3, 5, "tool", "x."), (3, None, "assistant", "y."), (3, 6, None, None),
        (None, 1, "user", "a."), (None, 1, "assistant", "b"), (4, 1, "user", ""),
    ]
    found, turns, hashes = repaired(spark, given)
    told = lambda i: tuple(found[i])[1:]
    assert told(1) == (3, 1, 0, 0, 0, 1, 1, "KKR")
    assert told(2) == (4, 0, 1, 1, 0, 2, 4, "DKDK")
    assert told(3) == (3, 0, 1, 0, 0, 2, 4, "RRD")
    assert told(None) == (2, 0, 0, 0, 1, 0, 4, "DD")
    assert told(4) == (1, 0, 1, 0, 0, 0, 2, "D") and 4 not in hashes
    assert [t[1:] for t in turns if t[0] == 1] == [("K", "system", "Be brief."), ("K", "user", "Hi?"), ("R", "assistant", "Hello.")]
    assert [t[1:] for t in turns if t[0] == 3] == [("R", "user", "y."), ("R", "assistant", "x.")]


def test_inserted_turns_are_where_the_audit_has_them(spark):
    given = [(1, i, "user", f"Question {i}.") for i in range(2)] + [(2, 0, "assistant", "Only an answer."), (3, 0, "user", "No answer.")]
    found, turns, _ = repaired(spark, given)
    for conv_id, row in found.items():
        mine = [t for t in turns if t[0] == conv_id]
        assert "".join(t[1] for t in mine) == row.audit.replace("D", "") and re.fullmatch("(s?(ua)+)?", "".join(t[2][0] for t in mine))
    rows_ = R.ordered(spark.createDataFrame([(9, 0, "user", "A question.")], SHAPE))
    plan = spark.createDataFrame([(9, 1, "KI")], "conv_id long, rows long, audit string")
    assert [(t.role, t.text) for t in R.repaired(rows_, plan).sort("place").collect()] == [("user", "A question."), ("assistant", "")]


def test_empty_tables_other_columns_and_long_texts(spark):
    assert R.plans(R.faults(R.ordered(spark.createDataFrame([], SHAPE)))).collect() == []
    text = "word " * 400_000 + "end."
    found, turns, _ = repaired(spark, [("x", 1, "user", text, "mine"), ("x", 2, "assistant", text, "mine"), ("x", 3, "user", text + "\n", "mine")], "conv_id string, turn int, role string, text string, fault string")
    assert found["x"].audit == "KKD" and [len(t[3]) for t in turns] == [len(text)] * 2


@pytest.mark.parametrize("copies", [1, 400])
def test_a_turn_that_is_said_very_often(spark, copies):
    given = [(1, i, "user", "Yes.") for i in range(copies)] + [(1, copies, "assistant", "Well.")]
    found, _, _ = repaired(spark, given)
    assert (found[1].duplicate, found[1].audit) == (copies - 1, "K" + "D" * (copies - 1) + "K")


def test_query_against_sql(spark, duck):
    assert rows(R.op12_repair(spark, SF_DIR).toPandas()) == rows(duck.execute(ORACLES["op12_repair"]).df())
