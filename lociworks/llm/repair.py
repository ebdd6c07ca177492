"""Repair of conversation structure (operator 12).

A conversation's rows stand in the order of their turns, nulls first, then of
their roles, then of a digest of their texts. Its roles should read as an
optional system turn and then pairs of user and assistant turns, or nothing.
The cheapest edits that make it so are found by dynamic programming over the
rows and the states of the small automaton of that form:

    Keep 0, Rerole 2 (to user or assistant), Delete 3, Insert 2 (an empty user
    or assistant turn); a truncated row that isn't deleted adds 1; blank and
    duplicate rows must be deleted.

A vector of backward costs holds, for each state, the least cost of all rows
from one on. Such vectors are kept only at checkpoints, one in about sqrt(n)
rows. Walking forward, each block's vectors are worked out again from the
checkpoint behind it, and at each step the edit of the least initial is taken
among those that are tight, that is, whose cost is what the vectors differ by.
From a state one letter allows one edit, so that is the ASCII-least of all
cheapest audits, and the audit says what the repaired roles are.

Rows come to Python as a sorted stream, each with a byte or two of what matters
(initial, fault), so a conversation of any length costs a task its codes, its
digests and some sqrt(n) vectors. A second sorted stream carries the texts past
the finished audit and hashes what is left, one row at a time. A conversation
is one row of the result, so its rows meet in one task.

Null texts and roles, and null parts of a row's key, are one space. A role that
is empty has no legal initial. Rows with a null conv_id are one conversation,
whose id is null. An empty table gives no rows; extra columns are ignored;
repeated rows are duplicates.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import isqrt

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, written
from .resampling import CRC_TABLE_SQL, crc_sql

REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
#: Faults of a row; the first that holds counts. Duplicates are found as rows pass.
FINE, BLANK, DUPLICATE, CUT = 0, 1, 2, 3
#: States: nothing yet, after the system turn, after a user turn, after an assistant turn.
START, SYSTEM, USER, ASSISTANT = range(4)
#: Where an initial leads from each state, None where it may not stand; where a conversation may end.
STEP = {"s": (SYSTEM, None, None, None), "u": (USER, USER, None, USER), "a": (None, None, ASSISTANT, None)}
ENDS = (START, ASSISTANT)
#: The one initial that Insert and Rerole can give in each state.
NEXT = ("u", "u", "a", "u")
ROLES = {"u": "user", "a": "assistant"}
FAR = 1 << 60
#: ASCII white space (a fixed value).
SPACE = " \t\n\x0b\x0c\r"

Vector = tuple[int, int, int, int]


def _inserted(costs: list[int]) -> Vector:
    """Costs from each state where turns may be inserted first; twice, since a pair is enough to come back to any state."""
    for _ in range(2):
        costs = [min(c, INSERT + costs[STEP[NEXT[q]][q]]) for q, c in enumerate(costs)]
    return tuple(costs)


LAST: Vector = _inserted([0 if q in ENDS else FAR for q in range(4)])


def edits(state: int, initial: str, fault: int) -> Iterator[tuple[str, int, int]]:
    """(letter, cost, next state) of what can be done to a row, in the order of the letters; inserting isn't among them."""
    yield "D", DELETE, state
    if fault in (BLANK, DUPLICATE):
        return
    more = TRUNCATED if fault == CUT else 0
    to = STEP[initial][state] if initial in STEP else None
    if to is not None:
        yield "K", more, to
    yield "R", REROLE + more, STEP[NEXT[state]][state]


def _before(row: tuple[str, int], after: Vector) -> Vector:
    """The vector in front of a row, from the one behind it."""
    return _inserted([min(cost + after[to] for _, cost, to in edits(q, *row)) for q in range(4)])


def tight_edits(rows: list[tuple[str, int]]) -> tuple[int, str]:
    """(least cost, ASCII-least audit of that cost) of rows (initial, fault)."""
    n = len(rows)
    every = max(1, isqrt(n))
    marks, vector = {n: LAST}, LAST
    for i in range(n - 1, -1, -1):
        vector = _before(rows[i], vector)
        if i % every == 0:
            marks[i] = vector
    cost, state, audit = vector[START], START, []
    for begin in range(0, n, every):
        end = min(begin + every, n)
        block = [marks[end]]  # from the checkpoint behind the block back to its first row
        for i in range(end - 1, begin - 1, -1):
            block.append(_before(rows[i], block[-1]))
        for i in range(begin, end):
            here, after = block.pop(), block[-1]
            done = False
            while not done:
                left, inserted = here[state], STEP[NEXT[state]][state]
                choices = [(letter, to) for letter, c, to in edits(state, *rows[i]) if c + after[to] == left]
                if INSERT + here[inserted] == left:
                    choices.append(("I", inserted))
                letter, state = min(choices)
                audit.append(letter)
                done = letter != "I"
    while state not in ENDS:
        audit.append("I")
        state = STEP[NEXT[state]][state]
    return cost, "".join(audit)


def _spaced(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(" "))


def damage(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, place and dropped: each row harmed as the crc32 of ``conv_id:turn`` says. place orders rows of the same turn, and copies stand together; dropped rows stay, marked."""
    fate = F.crc32(F.concat(_spaced(F.col("conv_id")), F.lit(":"), _spaced(F.col("turn")))) % 20
    role, text = _spaced(F.col("role")), _spaced(F.col("text"))
    own = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.when(fate == 4, "user").otherwise(role).alias("role"),
        F.when(fate == 1, "").when(fate == 2, F.regexp_replace(text, r"[.!?]", "")).otherwise(text).alias("text"),
        F.struct(role.alias("role"), F.md5(text).alias("text")).alias("place"),
        (fate == 0).alias("dropped"),
        F.explode(F.array_repeat(F.lit(0), F.when(fate == 3, 2).otherwise(1))).alias("_copy"),
    )
    return own.drop("_copy")


def _coded(rows: DataFrame) -> DataFrame:
    """What the programme needs of each row: no texts."""
    text = F.rtrim("text", F.lit(SPACE))
    fault = F.when(text == "", BLANK).when(~F.substring(text, -1, 1).isin(".", "!", "?"), CUT).otherwise(FINE)
    same = F.unhex(F.md5(F.concat(F.char_length("role").cast("string"), F.lit(":"), "role", "text")))
    return rows.select("conv_id", "turn", "place", "dropped", F.substring("role", 1, 1).alias("initial"), fault.alias("fault"), same.alias("same"))


class _Conversation:
    """What is gathered of one conversation while its rows pass."""

    def __init__(self, conv_id: int | None):
        self.conv_id, self.rows, self.seen, self.turns, self.counts, self.illegal = conv_id, [], set(), [], [0, 0, 0, 0], 0

    def add(self, turn: int | None, initial: str, fault: int, same: bytes) -> None:
        if turn is not None:  # least, greatest and number of different turns: they come in order
            if not self.turns:
                self.turns = [turn, turn, 1]
            elif turn != self.turns[1]:
                self.turns = [self.turns[0], turn, self.turns[2] + 1]
        fault = DUPLICATE if fault != BLANK and same in self.seen else fault
        self.seen.add(same)
        self.counts[fault] += 1
        if self.rows and self.rows[-1][0] + initial not in ("su", "ua", "au"):
            self.illegal += 1
        self.rows.append((initial, fault))

    def result(self) -> tuple:
        cost, audit = tight_edits(self.rows)
        gaps = self.turns[1] - self.turns[0] + 1 - self.turns[2] if self.turns else 0
        return (self.conv_id, gaps, self.counts[BLANK], self.counts[DUPLICATE], self.counts[CUT], self.illegal, cost, audit)


_COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
_RESULT = pa.schema([("conv_id", pa.int64()), *((c, pa.int64()) for c in _COUNTS), ("audit", pa.string())])
_REPAIRED = pa.schema([*_RESULT, ("repaired_sha256", pa.string())])
_KIND = f"conv_id long, {', '.join(f'{c} long' for c in _COUNTS)}, audit string"


def _audited(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    now, done = None, []
    for batch in batches:
        for conv_id, turn, dropped, initial, fault, same in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "turn", "dropped", "initial", "fault", "same")), strict=True):
            if now is None or now.conv_id != conv_id:
                if now:
                    done.append(now.result())
                now = _Conversation(conv_id)
            if not dropped:
                now.add(turn, initial, fault, same)
        if len(done) > 10_000:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done, strict=True), _RESULT, strict=True)], schema=_RESULT)
            done = []
    if now:
        done.append(now.result())
    if done:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done, strict=True), _RESULT, strict=True)], schema=_RESULT)


def audits(rows: DataFrame) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit) of every conversation of damage()'s form."""
    return _coded(rows).repartition("conv_id").sortWithinPartitions("conv_id", "turn", "place").drop("place").mapInArrow(_audited, _KIND)


_TURNS = pa.schema([("conv_id", pa.int64()), ("at", pa.int64()), ("role", pa.string()), ("text", pa.string())])


def repaired_turns(rows: DataFrame, found: DataFrame) -> DataFrame:
    """(conv_id, at, role, text): the turns that the audits leave, numbered from 0."""
    return _beside(rows, found).mapInArrow(lambda batches: _written_turns(_replay(batches)), "conv_id long, at long, role string, text string")


def _beside(rows: DataFrame, found: DataFrame) -> DataFrame:
    """Each audit in front of its conversation's rows, in order; dropped rows have gone."""
    own = rows.where(~F.col("dropped")).select("conv_id", F.lit(1).alias("kind"), "turn", "place", "role", "text")
    nothing = [F.lit(None).cast(own.schema[c].dataType).alias(c) for c in ("turn", "place", "role")]
    lead = found.select("conv_id", F.lit(0).alias("kind"), *nothing, F.col("audit").alias("text"), *_COUNTS)
    both = lead.unionByName(own, allowMissingColumns=True)
    return both.repartition("conv_id").sortWithinPartitions("conv_id", "kind", "turn", "place").drop("turn", "place")


def _replay(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int | None, list[tuple[str, str]] | None]]:
    """(conv_id, None) where a conversation begins, then (conv_id, turns) for what each row leaves, insertions with the row after them."""
    conv_id, audit, at, state = None, "", 0, START

    def inserted() -> list[tuple[str, str]]:
        nonlocal at, state
        out = []
        while at < len(audit) and audit[at] == "I":
            out.append((ROLES[NEXT[state]], ""))
            at, state = at + 1, STEP[NEXT[state]][state]
        return out

    for batch in batches:
        for own, kind, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "kind", "role", "text")), strict=True):
            if kind == 0:
                if out := inserted():
                    yield conv_id, out
                conv_id, audit, at, state = own, text, 0, START
                yield conv_id, None
                continue
            out = inserted()
            letter, at = audit[at], at + 1
            if letter == "R":
                role = ROLES[NEXT[state]]
            if letter != "D":
                out.append((role, text))
                state = STEP[role[0]][state]
            if out:
                yield conv_id, out
    if out := inserted():
        yield conv_id, out


def _written_turns(turns: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
    rows, size, n = [], 0, 0
    for conv_id, out in turns:
        if out is None:
            n = 0
            continue
        for role, text in out:
            rows.append((conv_id, n, role, text))
            n, size = n + 1, size + len(text)
        if size > 1 << 22 or len(rows) > 10_000:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _TURNS, strict=True)], schema=_TURNS)
            rows, size = [], 0
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _TURNS, strict=True)], schema=_TURNS)


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    leads: list[tuple] = []

    def seen() -> Iterator[pa.RecordBatch]:
        """The batches, with what leads each conversation put aside."""
        for batch in batches:
            led = batch.filter(pc.equal(batch.column("kind"), 0))
            leads.extend(zip(*(led.column(c).to_pylist() for c in ("conv_id", *_COUNTS, "text")), strict=True))
            yield batch

    hashes, now, first = [], None, True
    for _, out in _replay(seen()):
        if out is None:
            if now:
                hashes.append(now.hexdigest())
            now, first = hashlib.sha256(), True
            if len(hashes) > 10_000:
                yield _repaired(leads[: len(hashes)], hashes)
                del leads[: len(hashes)]
                hashes = []
            continue
        for role, text in out:
            now.update(("" if first else "\n").encode() + f"{role}:{text}".encode())
            first = False
    if now:
        yield _repaired(leads, [*hashes, now.hexdigest()])


def _repaired(leads: list[tuple], hashes: list[str]) -> pa.RecordBatch:
    columns = [*zip(*leads, strict=True), hashes]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _REPAIRED, strict=True)], schema=_REPAIRED)


def repaired_hashes(rows: DataFrame, found: DataFrame) -> DataFrame:
    """found with repaired_sha256, of the turns that the audits leave: ``role:text``, joined by newlines."""
    return _beside(rows, found).mapInArrow(_hashed, f"{_KIND}, repaired_sha256 string")


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, damaged and repaired: faults, cost and audit of the cheapest edits, and the hash of what they leave."""
    rows = damage(table(spark, sf_dir, "conversations"))
    found = written(audits(rows))
    return repaired_hashes(rows, found)


def _add(so_far: str, cost: str, letter: str) -> str:
    """SQL: an eight-digit cost and its audit, with an edit put in front."""
    return f"printf('%08d', CAST(substr({so_far}, 1, 8) AS INTEGER) + {cost}) || '{letter}' || substr({so_far}, 9)"


def _best(state: str, allowed: str, reroled: str) -> str:
    """SQL: the least of what can be done to a row in a state, given where its initial leads and where a new one does."""
    return f"least({_add(state, '3', 'D')}, CASE WHEN fault NOT IN (1, 2) THEN least(CASE {allowed} END, {_add(reroled, '2 + cut', 'R')}) END)"


_KEEP = "WHEN initial = '{}' THEN {}"
OP12_SQL = rf"""
WITH RECURSIVE {CRC_TABLE_SQL},
keyed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role0, coalesce(text, ' ') AS text0, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS key
  FROM conversations
), fated AS (SELECT *, {crc_sql("key")} % 20 AS fate FROM keyed, crc_table),
harmed AS (
  SELECT conv_id, turn, role0, text0, CASE fate WHEN 4 THEN 'user' ELSE role0 END AS role,
    CASE fate WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text0, '[.!?]', '', 'g') ELSE text0 END AS text, unnest(range(CASE fate WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy
  FROM fated
), placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role0, md5(text0)) AS i FROM harmed),
judged AS (
  SELECT *, substr(role, 1, 1) AS initial, CASE WHEN NOT regexp_matches(text, '[^ 	-
]') THEN 1
    WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 2 WHEN NOT regexp_matches(text, '[.!?][ 	-
]*$') THEN 3 ELSE 0 END AS fault
  FROM placed
), paired AS (SELECT *, CASE fault WHEN 3 THEN 1 ELSE 0 END AS cut, lag(initial) OVER (PARTITION BY conv_id ORDER BY i) || initial AS pair FROM judged),
counted AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 1) AS blank, count(*) FILTER (fault = 2) AS duplicate,
    count(*) FILTER (fault = 3) AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal, max(i) AS n
  FROM paired GROUP BY conv_id
), back AS (
  SELECT conv_id, n + 1 AS i, '00000000' AS p, '00000004II' AS s, '00000002I' AS u, '00000000' AS a FROM counted
  UNION ALL
  SELECT conv_id, i, least(p, {_add("u", "2", "I")}), least(s, {_add("u", "2", "I")}), least(u, {_add("a", "2", "I")}), least(a, {_add("u", "2", "I")}) FROM (
    SELECT conv_id, i, least(p, {_add("u", "2", "I")}) AS p, least(s, {_add("u", "2", "I")}) AS s, least(u, {_add("a", "2", "I")}) AS u, least(a, {_add("u", "2", "I")}) AS a FROM (
      SELECT b.conv_id, r.i,
        {_best("p", _KEEP.format("s", _add("s", "cut", "K")) + " " + _KEEP.format("u", _add("u", "cut", "K")), "u")} AS p,
        {_best("s", _KEEP.format("u", _add("u", "cut", "K")), "u")} AS s, {_best("u", _KEEP.format("a", _add("a", "cut", "K")), "a")} AS u,
        {_best("a", _KEEP.format("u", _add("u", "cut", "K")), "u")} AS a
      FROM back b JOIN paired r ON b.conv_id IS NOT DISTINCT FROM r.conv_id AND r.i = b.i - 1))
), solved AS (SELECT conv_id, CAST(substr(p, 1, 8) AS BIGINT) AS cost, substr(p, 9) AS audit FROM back WHERE i = 1),
letters AS (SELECT conv_id, audit, unnest(range(1, len(audit) + 1)) AS pos FROM solved),
walked AS (
  SELECT conv_id, pos, substr(audit, pos, 1) AS letter, len(replace(substr(audit, 1, pos), 'I', '')) AS i, len(replace(substr(audit, 1, pos), 'D', '')) AS k, len(replace(audit, 'D', '')) AS len FROM letters
), said AS (
  SELECT w.conv_id, pos, CASE letter WHEN 'K' THEN r.role ELSE CASE WHEN (k + len) % 2 = 1 THEN 'user' ELSE 'assistant' END END || ':' || CASE letter WHEN 'I' THEN '' ELSE r.text END AS line
  FROM walked w JOIN paired r ON w.conv_id IS NOT DISTINCT FROM r.conv_id AND r.i = greatest(w.i, 1) WHERE letter <> 'D'
), repaired AS (SELECT conv_id, sha256(string_agg(line, chr(10) ORDER BY pos)) AS hash FROM said GROUP BY conv_id)
SELECT o.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  coalesce(cost, 0) AS cost, coalesce(audit, '') AS audit, coalesce(hash, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN counted c ON o.conv_id IS NOT DISTINCT FROM c.conv_id
  LEFT JOIN solved v ON o.conv_id IS NOT DISTINCT FROM v.conv_id LEFT JOIN repaired h ON o.conv_id IS NOT DISTINCT FROM h.conv_id
"""
