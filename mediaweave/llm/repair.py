"""12. Conversation structure repair by depth-first branch and bound.

A conversation's turns should be an optional system turn and then pairs of user and assistant, none blank, none twice,
none cut off. faults() tells what is wrong with each turn; duplicates are found by a count of digests over all rows, not
within a conversation. plans() finds the cheapest edits of each conversation: keep 0, rerole to user or assistant 1,
delete 2, insert an empty turn 5, and 5 for each truncated turn that stays; of equally cheap ones the ASCII-least audit
(the edits' initials in order). repaired() applies a plan to the turns.

The search walks the conversation with a stack of its own. A node is a turn and what the repaired part ends in. Lower
bounds of what the rest costs from each node come from one pass over the suffix; the incumbent is the best (cost, audit)
so far; a node's dominance entry is the best (cost, audit) that has reached it, and a worse prefix is given up. The
child with the least bound is tried first. Where bounds are as tight as here, the first dive ends in the optimum and
what is left on the stack only proves it, so that work is linear in the turns. Long conversations are searched in blocks
of BLOCK turns, with bounds kept for the blocks' ends alone: memory is two bytes a turn beside a block.

A conversation's turns meet in one task in order (as its digest needs), without their texts for the search, and stream.

Defined results: a null role or text is one space; a null conv_id is a conversation of its own; turns are in order of
turn (nulls first), role, text and so repeated rows stand beside each other; roles are told by their first letter, s, u
or a in lower case; conversations without rows have no plan; an empty table gives an empty result. Texts may be of any
length, a row has to fit in memory. Other columns aren't read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial
from math import inf

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mediaweave.llm.common import join_by_size, publish, shared_dir, small_batches, table
from mediaweave.llm.variants import CRC_SQL

SPACE = " \t\n\x0b\x0c\r"
ENDS = (".", "!", "?")
RENAME, DELETE, INSERT, CUT_OFF = 1, 2, 5, 5
#: What the repaired part ends in.
START, SYSTEM, USER, ASSISTANT = range(4)
#: The role that may follow, by its initial.
FOLLOWS = ({"s": SYSTEM, "u": USER}, {"u": USER}, {"a": ASSISTANT}, {"u": USER})
WHOLE = (START, ASSISTANT)
NAMES = {USER: "user", ASSISTANT: "assistant"}
#: A turn's code: four times its fault (none, truncated, blank or duplicate) and its role's place in here.
ROLES = "sua?"
FINE, TRUNCATED, USELESS = range(3)
BLOCK = 512


def inserted(state: int) -> int:
    """What an inserted turn makes of the end: the one of user and assistant that may follow."""
    return ASSISTANT if state == USER else USER


def edits(code: int, state: int) -> list[tuple[str, int, int]]:
    """The edits of a turn, in ASCII order: initial, cost, what the repaired part ends in then."""
    fault, role = divmod(code, 4)
    out = [("D", DELETE, state)]
    if fault != USELESS:
        stays = CUT_OFF * (fault == TRUNCATED)
        if (after := FOLLOWS[state].get(ROLES[role])) is not None:
            out.append(("K", stays, after))
        out.append(("R", stays + RENAME, inserted(state)))
    return out


EDITS = [[edits(code, state) for state in range(4)] for code in range(12)]


def with_inserts(least: list[float]) -> list[float]:
    """Bounds at a turn of all ways on, from those of its own edits."""
    user, assistant = min(least[USER], INSERT + least[ASSISTANT]), min(least[ASSISTANT], INSERT + least[USER])
    return [min(least[START], INSERT + user), min(least[SYSTEM], INSERT + user), user, assistant]


#: From the end: whole, or made whole by inserts.
AT_END = with_inserts([0 if state in WHOLE else inf for state in range(4)])


def suffix_bounds(codes: bytes, after: list[float]) -> list[list[float]]:
    """Lower bounds of what the turns from each on cost, by what the part before ends in; the last is `after`."""
    out = [after]
    for code in reversed(codes):
        out.append(with_inserts([min(cost + out[-1][to] for _, cost, to in EDITS[code][state]) for state in range(4)]))
    return out[::-1]


def _letters(path: tuple | None) -> str:
    out = []
    while path:
        letter, path = path
        out.append(letter)
    return "".join(reversed(out))


def search(codes: bytes, bounds: list[list[float]], start: int, last: bool) -> tuple[int, str, int]:
    """The cheapest edits of a block of turns, ties to the ASCII-least: cost, audit, and what the repaired part ends in.
    bounds: of suffix_bounds(). Only the last block may insert after its last turn."""
    n = len(codes)
    best_total, best = inf, (0, "", start)
    reached: dict[tuple[int, int], tuple[int, tuple | None]] = {}  # dominance: the best that has come to a node
    stack: list[tuple[int, int, int, tuple | None]] = [(0, start, 0, None)]
    while stack:
        at, state, cost, path = stack.pop()
        total = cost + bounds[at][state]
        if total > best_total or total == best_total and _letters(path) >= best[1]:
            continue
        was = reached.get((at, state))
        if was and (was[0] < cost or was[0] == cost and _letters(was[1]) <= _letters(path)):
            continue
        reached[at, state] = (cost, path)
        if at == n and (state in WHOLE or not last):
            if total < best_total or _letters(path) < best[1]:
                best_total, best = total, (cost, _letters(path), state)
            continue
        ways = [(at + 1, to, cost + more, letter) for letter, more, to in EDITS[codes[at]][state]] if at < n else []
        if at < n or last:
            ways.append((at, inserted(state), cost + INSERT, "I"))
        # the least bound is on top of the stack, and of equal ones the least letter
        ways.sort(key=lambda w: (w[2] + bounds[w[0]][w[1]], w[3]), reverse=True)
        stack += [(i, to, c, (letter, path)) for i, to, c, letter in ways if c + bounds[i][to] <= best_total]
    return best


def solve(codes: bytes, block: int = BLOCK) -> tuple[int, str]:
    """The cheapest edits of a conversation: cost and audit."""
    ends = [AT_END]  # bounds at the blocks' ends, from the last
    starts = range(0, max(len(codes), 1), block)
    for at in reversed(starts[1:]):
        ends.append(suffix_bounds(codes[at : at + block], ends[-1])[0])
    state, cost, audits = START, 0, []
    for at in starts:
        part = codes[at : at + block]
        more, audit, state = search(part, suffix_bounds(part, ends.pop()), state, last=at == starts[-1])
        cost += more
        audits.append(audit)
    return cost, "".join(audits)


def ordered(turns: DataFrame) -> DataFrame:
    """turns: conv_id, turn, role, text. Written in order: a conversation's rows follow one another by `at`, a number of a
    row's own."""
    shared_dir(turns.sparkSession)
    one_space = lambda c: F.coalesce(F.col(c), F.lit(" ")).alias(c)  # noqa: E731
    rows = turns.select("conv_id", "turn", one_space("role"), one_space("text"))
    return publish(rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").withColumn("at", F.monotonically_increasing_id()))


def faults(rows: DataFrame) -> DataFrame:
    """rows: of ordered(). conv_id, turn, at, initial (of the role), fault: blank, duplicate, truncated or null."""
    bare = F.rtrim(F.col("text"), F.lit(SPACE))
    light = rows.select("conv_id", "turn", "at", F.substring("role", 1, 1).alias("initial"), (bare == "").alias("blank"), (~F.substring(bare, -1, 1).isin(*ENDS)).alias("open"), F.xxhash64("conv_id", "role", "text").alias("d1"), F.xxhash64(F.lit(1), "conv_id", "role", "text").alias("d2"))
    light = publish(light)
    firsts = publish(light.groupBy("d1", "d2").agg(F.min("at").alias("first"), F.count("*").alias("times")).filter("times > 1"))
    told = join_by_size(light, firsts, ["d1", "d2"], "times", hint=None)
    fault = F.when(F.col("blank"), "blank").when(F.col("at") > F.col("first"), "duplicate").when(F.col("open"), "truncated")
    return told.select("conv_id", "turn", "at", "initial", fault.alias("fault"))


PLAN = "rows long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"
FAULTS = ("blank", "duplicate", "truncated")


class _Plan:
    """What a conversation's turns add up to as they pass."""

    def __init__(self, conv_id) -> None:
        self.conv_id, self.codes, self.counts, self.illegal, self.before = conv_id, bytearray(), dict.fromkeys(FAULTS, 0), 0, None
        self.first = self.turn = None
        self.distinct = 0

    def add(self, turn, initial: str, fault: str | None) -> None:
        if turn is not None and turn != self.turn:
            self.first, self.turn, self.distinct = turn if self.first is None else self.first, turn, self.distinct + 1
        if fault:
            self.counts[fault] += 1
        if self.codes and f"{self.before}{initial}" not in ("su", "ua", "au"):
            self.illegal += 1
        self.before = initial
        role = "sua".find(initial) if initial else -1
        self.codes.append(4 * (FINE if fault is None else TRUNCATED if fault == "truncated" else USELESS) + (role if role >= 0 else 3))

    def row(self) -> tuple:
        gaps = 0 if self.first is None else self.turn - self.first + 1 - self.distinct
        return self.conv_id, len(self.codes), gaps, *self.counts.values(), self.illegal, *solve(bytes(self.codes))


def _plans(batches, names: list[str], kinds: list) -> Iterator[pa.RecordBatch]:
    def made(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    now = None
    for batch in batches:
        done = []
        for conv_id, turn, initial, fault in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "turn", "initial", "fault")), strict=True):
            if now is None or conv_id != now.conv_id:
                done += [now.row()] if now else []
                now = _Plan(conv_id)
            now.add(turn, initial, fault)
        if done:
            yield made(done)
    if now:
        yield made([now.row()])


def arrow_kind(df: DataFrame, column: str) -> pa.DataType:
    return {"string": pa.string(), "int": pa.int32()}.get(df.schema[column].dataType.simpleString(), pa.int64())


def plans(told: DataFrame) -> DataFrame:
    """told: of faults(). One row a conversation: conv_id and PLAN."""
    kind = told.schema["conv_id"].dataType.simpleString()
    names = ["conv_id", *(x.split()[0] for x in PLAN.split(", "))]
    kinds = [arrow_kind(told, "conv_id"), *[pa.int64()] * 7, pa.string()]
    sorted_ = told.repartition("conv_id").sortWithinPartitions("conv_id", "at")
    return sorted_.select("conv_id", "turn", "initial", "fault").mapInArrow(partial(_plans, names=names, kinds=kinds), f"conv_id {kind}, {PLAN}")


class _Repair:
    """A conversation's audit, letter by letter, as its turns pass."""

    def __init__(self, conv_id, audit: str, rows: int) -> None:
        self.conv_id, self.audit, self.rows, self.at, self.state, self.place = conv_id, audit, rows, 0, START, 0

    def turn(self, edit: str, role: str, text: bytes) -> tuple:
        self.place += 1
        return self.conv_id, self.place, edit, role, text

    def inserts(self) -> Iterator[tuple]:
        while self.audit.startswith("I", self.at):
            self.at, self.state = self.at + 1, inserted(self.state)
            yield self.turn("I", NAMES[self.state], b"")

    def edited(self, role: str, text: bytes) -> Iterator[tuple]:
        """What becomes of the next turn, with what is inserted before it and, after the last one, behind it."""
        yield from self.inserts()
        edit = self.audit[self.at]
        self.at, self.rows = self.at + 1, self.rows - 1
        if edit != "D":
            self.state = FOLLOWS[self.state][role[0]] if edit == "K" else inserted(self.state)
            yield self.turn(edit, role if edit == "K" else NAMES[self.state], text)
        if not self.rows:
            yield from self.inserts()


def _repaired(batches, kind: pa.DataType) -> Iterator[pa.RecordBatch]:
    """Rows by conversation, its audit first: the turns after the edits, in order."""
    now, out = None, []
    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in ("conv_id", "audit", "rows", "role")] + [batch.column("text").cast(pa.binary()).to_pylist()]
        for conv_id, audit, rows, role, text in zip(*columns, strict=True):
            if audit is None:
                out += now.edited(role, text)
            else:
                now = _Repair(conv_id, audit, rows)
        if out:
            arrays = [pa.array(x, t) for x, t in zip(zip(*out, strict=True), (kind, pa.int64(), pa.string(), pa.string(), pa.binary()), strict=True)]
            yield pa.RecordBatch.from_arrays([*arrays[:4], arrays[4].cast(pa.string())], names=["conv_id", "place", "edit", "role", "text"])
            out = []


def repaired(rows: DataFrame, found: DataFrame) -> DataFrame:
    """rows: of ordered(), found: of plans(). The turns that are left and those inserted: conv_id, place (from 1), edit, role,
    text. A conversation's turns follow one another in one partition."""
    small_batches(rows.sparkSession)
    kind = rows.schema["conv_id"].dataType.simpleString()
    heads = found.select("conv_id", F.lit(-1).cast("long").alias("at"), "audit", "rows", F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("text"))
    turns = rows.select("conv_id", "at", F.lit(None).cast("string").alias("audit"), F.lit(None).cast("long").alias("rows"), "role", "text")
    both = heads.unionAll(turns).repartition("conv_id").sortWithinPartitions("conv_id", "at")
    return both.drop("at").mapInArrow(partial(_repaired, kind=arrow_kind(rows, "conv_id")), f"conv_id {kind}, place long, edit string, role string, text string")


def _hashes(batches, kind: pa.DataType) -> Iterator[pa.RecordBatch]:
    def made(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([x[0] for x in rows], kind), pa.array([x[1].hexdigest() for x in rows])], names=["conv_id", "sha256"])

    now = None
    for batch in batches:
        done = []
        for conv_id, place, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "place", "role")), batch.column("text").cast(pa.binary()).to_pylist(), strict=True):
            if place == 1:
                done += [now] if now else []
                now = (conv_id, hashlib.sha256())
            now[1].update((b"\n" if place > 1 else b"") + role.encode() + b":" + text)
        if done:
            yield made(done)
    if now:
        yield made([now])


def hashes(turns: DataFrame) -> DataFrame:
    """turns: of repaired(), in its order. conv_id, sha256 of role:text of the turns, joined by line feeds."""
    kind = turns.schema["conv_id"].dataType.simpleString()
    return turns.select("conv_id", "place", "role", "text").mapInArrow(partial(_hashes, kind=arrow_kind(turns, "conv_id")), f"conv_id {kind}, sha256 string")


def damaged(turns: DataFrame) -> DataFrame:
    """Test damage, by the CRC-32 of conv_id:turn modulo 20: 0 drops a row, 1 empties its text, 2 takes its ends of
    sentences, 3 repeats it, 4 makes it the user's. Nulls are one space."""
    one_space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))  # noqa: E731
    kind = F.crc32(F.encode(F.concat(one_space("conv_id"), F.lit(":"), one_space("turn")), "utf-8")) % 20
    rows = turns.select("conv_id", "turn", one_space("role").alias("role"), one_space("text").alias("text"), kind.alias("kind")).filter("kind <> 0")
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    copies = F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.select("conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.explode(copies).alias("copy")).drop("copy")


NOTHING = hashlib.sha256().hexdigest()


def op12_repair(spark, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    rows = ordered(damaged(turns))
    found = publish(plans(faults(rows)))
    digests = hashes(repaired(rows, found)).withColumnRenamed("conv_id", "of")
    ids = turns.select("conv_id").distinct()
    for more, key in ((found.withColumnRenamed("conv_id", "conv"), "conv"), (digests, "of")):
        ids = ids.join(more, F.col("conv_id").eqNullSafe(F.col(key)) & F.col(more.columns[1]).isNotNull(), "left")
    numbers = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", *FAULTS, "illegal", "cost")]
    return ids.select("conv_id", *numbers, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("sha256", F.lit(NOTHING)).alias("repaired_sha256"))


OP12_SQL = rf"""
WITH RECURSIVE given AS (SELECT row_number() OVER () AS id, conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text FROM conversations),
s AS (SELECT id, hex(encode(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '))) AS hx FROM given),
{CRC_SQL},
d AS (
  SELECT id, conv_id, turn, CASE WHEN h % 20 = 4 THEN 'user' ELSE role END AS role,
    CASE WHEN h % 20 = 1 THEN '' WHEN h % 20 = 2 THEN translate(text, '.!?', '') ELSE text END AS text, unnest(range(CASE WHEN h % 20 = 3 THEN 2 ELSE 1 END)) AS copy
  FROM given JOIN crc USING (id) WHERE h % 20 <> 0),
o AS (SELECT *, dense_rank() OVER (ORDER BY conv_id) AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, id, copy) AS i FROM d),
f AS (
  SELECT *, substr(role, 1, 1) AS r, regexp_extract(text, '([^ 	-])[ 	-]*$', 1) AS e,
    row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) AS nth, lag(substr(role, 1, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS before FROM o),
t AS (SELECT *, CASE WHEN e = '' THEN 'blank' WHEN nth > 1 THEN 'duplicate' WHEN e NOT IN ('.', '!', '?') THEN 'truncated' ELSE 'none' END AS fault FROM f),
ins AS (FROM (VALUES (0, 0, 0, '', []), (1, 1, 0, '', []), (2, 2, 0, '', []), (3, 3, 0, '', []), (0, 2, 5, 'I', ['user:']), (0, 3, 10, 'II', ['user:', 'assistant:']), (1, 2, 5, 'I', ['user:']),
  (1, 3, 10, 'II', ['user:', 'assistant:']), (2, 3, 5, 'I', ['assistant:']), (3, 2, 5, 'I', ['user:'])) AS v(q, p, cost, letters, made)),
way AS (FROM (VALUES (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (2, 'a', 3), (3, 'u', 2)) AS v(q, r, p)),
edit AS (
  SELECT id, copy, c, i, q, q AS p, 2 AS cost, 'D' AS letter, [] AS made FROM t, range(4) AS x(q)
  UNION ALL SELECT id, copy, c, i, q, p, 5 * (fault = 'truncated')::INT, 'K', [role || ':' || text] FROM t JOIN way USING (r) WHERE fault IN ('none', 'truncated')
  UNION ALL SELECT id, copy, c, i, q, CASE WHEN q = 2 THEN 3 ELSE 2 END, 1 + 5 * (fault = 'truncated')::INT, 'R', [CASE WHEN q = 2 THEN 'assistant:' ELSE 'user:' END || text] FROM t, range(4) AS x(q) WHERE fault IN ('none', 'truncated')),
best AS (
  SELECT c, 0::BIGINT AS i, 0 AS q, {{'cost': 0, 'audit': '', 'made': []::VARCHAR[]}} AS x FROM (SELECT DISTINCT c FROM t)
  UNION ALL
  SELECT b.c, b.i + 1, e.p, min({{'cost': b.x.cost + ins.cost + e.cost, 'audit': b.x.audit || ins.letters || e.letter, 'made': b.x.made || ins.made || e.made}})
  FROM best b JOIN ins ON ins.q = b.q JOIN edit e ON e.c = b.c AND e.i = b.i + 1 AND e.q = ins.p GROUP BY b.c, b.i, e.p),
size AS (SELECT c, any_value(conv_id) AS conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
  count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (i > 1 AND before || r NOT IN ('su', 'ua', 'au')) AS illegal FROM t GROUP BY c),
done AS (
  SELECT c, min({{'cost': x.cost + ins.cost, 'audit': x.audit || ins.letters, 'made': x.made || ins.made}}) AS x
  FROM best JOIN size USING (c) JOIN ins USING (q) WHERE i = n AND (ins.p = 3 OR ins.p = 0) GROUP BY c)
SELECT g.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  coalesce(x.cost, 0)::BIGINT AS cost, coalesce(x.audit, '') AS audit, sha256(coalesce(array_to_string(x.made, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) g LEFT JOIN size ON size.conv_id IS NOT DISTINCT FROM g.conv_id LEFT JOIN done USING (c)
"""
