"""Repair of conversation structure: the cheapest edits that make role initials spell `(s?(ua)+)?`.

Conversations are dealt by hash and streamed in order of their turns. A batch of them is cut into segments, and one recursive
DuckDB query advances all segments by a turn in each recursion, with the least cost and its edits for each grammar state; a
segment behind the first is solved from every state, so that long conversations take as many recursions as a segment has turns.
Segments are put together state by state. Every row adds one word of a prefix code (inserts, then Keep, Rerole or Delete), so
equally dear edits up to a row compare like their whole continuations, and the ASCII-least stay the least.

A conversation longer than a batch is carried on with its four states. Its lines are final, and leave memory, once all states
come from one; so memory holds batches, not conversations. (A digest of a conversation is sequential, so one task streams it.)

Defined results: null role or text is one space; null conv_id is one conversation; rows of one turn go by role, then text, and
a repeated row comes next to its copy; null turns come first; a role without initial can't be kept; further columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import batch_of, own_columns, slices

#: Turns of a segment, and rows and characters of a batch.
SEGMENT, BATCH_ROWS, BATCH_CHARS = 64, 8192, 8 << 20
BLANKS = " \t\n\x0b\f\r"

# Grammar states: nothing yet; behind system, user, assistant; closed.
START, SYSTEM, USER, ASSISTANT, CLOSED = range(5)
NEXT = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3

#: [p][q]: with this much more at most, state p can be followed by whatever may follow state q (a system row is deleted, what is
#: missing is inserted). So q is of no use where p with that is cheaper.
INSTEAD = [[0, 0, 3, 0], [10, 0, 3, 6], [7, 3, 0, 3], [4, 0, 3, 0]]


def _inserts(state: int) -> list[tuple[int, int]]:
    """(state, inserts) that are reached by inserting alone; more inserts would go round in a circle."""
    found, at = [(state, 0)], state
    while (at := NEXT[at, "a" if at == USER else "u"]) not in [s for s, _ in found]:
        found.append((at, len(found)))
    return found


def _moves() -> pa.Table:
    """What may be done with a row of a kind: from state, to state, edits, cost, whether the row stays.

    Kinds: role initial s, u or a; x for another role; d for a row that must go; e for the conversation's end.
    """
    rows = []
    for state in range(4):
        for after, k in _inserts(state):
            paid, edits = INSERT * k, "I" * k
            rows += [(kind, state, after, edits + "D", paid + DELETE, False) for kind in "suaxd"]
            rows += [(r, state, NEXT[after, r], edits + "K", paid, True) for r in "sua" if (after, r) in NEXT]
            rows += [(kind, state, NEXT[after, r], edits + "R", paid + REROLE, True) for r in "ua" if (after, r) in NEXT for kind in "suax"]
            if after in (START, ASSISTANT):
                rows.append(("e", state, CLOSED, edits, paid, False))
    return pa.table(dict(zip(("kind", "s", "t", "edits", "cost", "stays"), map(list, zip(*rows)))))


#: begins: segment c may begin in state o. turns: its i-th row's kind, and what keeping it costs. sizes: its rows.
ADVANCE = """
WITH RECURSIVE best AS (
  SELECT c, 0 AS i, o, o AS s, {'cost': 0::BIGINT, 'audit': ''} AS b FROM begins
  UNION ALL
  SELECT best.c, best.i + 1, best.o, m.t, min({'cost': best.b.cost + m.cost + CASE WHEN m.stays THEN t.extra ELSE 0 END, 'audit': best.b.audit || m.edits})
  FROM best JOIN turns t ON t.c = best.c AND t.i = best.i JOIN moves m ON m.kind = t.kind AND m.s = best.s
  GROUP BY best.c, best.i, best.o, m.t
)
SELECT c, o, s, b.cost, b.audit FROM best JOIN sizes USING (c) WHERE best.i = sizes.n
"""


@functools.lru_cache(maxsize=1)
def _engine():
    import duckdb

    engine = duckdb.connect(config={"threads": 1, "memory_limit": "600MB", "temp_directory": ""})
    engine.register("moves", _moves())
    return engine


def solve(segments: list[list[tuple[str, int]]], begins: list[tuple[int, int]]) -> list[list[tuple[int, int, int, str]]]:
    """For each segment of (kind, extra cost if it stays): (state it begins in, state it ends in, least cost, ASCII-least edits)."""
    turns = [(c, i, kind, extra) for c, rows in enumerate(segments) for i, (kind, extra) in enumerate(rows)]
    c, i, kind, extra = map(list, zip(*turns))
    engine = _engine()
    engine.register("turns", pa.table({"c": c, "i": i, "kind": kind, "extra": extra}))
    engine.register("sizes", pa.table({"c": list(range(len(segments))), "n": [len(x) for x in segments]}))
    engine.register("begins", pa.table({"c": [b[0] for b in begins], "o": [b[1] for b in begins]}))
    found: list[list] = [[] for _ in segments]
    for c, *way in engine.execute(ADVANCE).fetchall():
        found[c].append(tuple(way))
    return found


@dataclass
class Conversation:
    """What is known of a conversation up to a row."""

    conv_id: int | None
    whole: bool = False  # all its rows have come
    rows: list[tuple[str, str, str, int]] = field(default_factory=list)  # role, text, kind, fault: of this batch
    turns: list[int] = field(default_factory=list)  # smallest, largest
    distinct: int = 0
    faults: list[int] = field(default_factory=lambda: [0, 0, 0, 0])
    illegal: int = 0
    last: str | None = None
    ways: dict[int, tuple[int, int]] = field(default_factory=lambda: {START: (0, 0)})  # cost and rank of the edits by state
    open: dict[int, list] = field(default_factory=lambda: {START: []})  # rows and edits by state that aren't final
    state: int = START  # behind the final lines
    lines: int = 0
    cost: int = 0
    audit: list[str] = field(default_factory=list)

    def add(self, turn: int | None, role: str, text: str, kind: str, fault: int) -> None:
        if turn is not None:
            self.distinct += not self.turns or turn != self.turns[1]
            self.turns = [self.turns[0] if self.turns else turn, turn]
        self.faults[fault] += 1
        self.illegal += self.last is not None and self.last + role[:1] not in ("su", "ua", "au")
        self.last = role[:1]
        self.rows.append((role, text, kind, fault))

    def segments(self) -> list[list[tuple[str, int]]]:
        kinds = [(kind, TRUNCATED * (fault == 3)) for _, _, kind, fault in self.rows] + [("e", 0)] * self.whole
        return [kinds[i : i + SEGMENT] for i in range(0, len(kinds), SEGMENT)]

    def advance(self, solved: list[list[tuple[int, int, int, str]]]) -> list[tuple[str, str]]:
        """Take the solved segments of this batch; returns the lines (role, text) that have become final."""
        now = {s: (cost, rank, "", s) for s, (cost, rank) in self.ways.items()}
        for ways in solved:
            new: dict[int, tuple] = {}
            for begin, end, cost, edits in ways:
                if begin in now:
                    way = (now[begin][0] + cost, now[begin][1], now[begin][2] + edits, now[begin][3])
                    new[end] = min(new.get(end, way), way)
            now = new
        rows, self.rows = self.rows, []
        if self.whole:
            self.cost, _, edits, origin = now[CLOSED]
            return [line for part in (*self.open[origin], (rows, edits)) for line in self._final(*part)]
        now = {q: way for q, way in now.items() if all(other[0] + INSTEAD[p][q] >= way[0] for p, other in now.items())}
        order = sorted({(rank, edits) for _, rank, edits, _ in now.values()})
        self.ways = {s: (cost, order.index((rank, edits))) for s, (cost, rank, edits, _) in now.items()}
        origins = {origin for *_, origin in now.values()}
        final = []
        if len(origins) == 1:  # what all states have in common
            (origin,) = origins
            final = [line for part in self.open[origin] for line in self._final(*part)]
            self.open = {origin: []}
        self.open = {s: [*self.open[origin], (rows, edits)] for s, (_, _, edits, origin) in now.items()}
        return final

    def _final(self, rows: list[tuple], edits: str) -> Iterator[tuple[str, str]]:
        self.audit.append(edits)
        left = iter(rows)
        for edit in edits:
            role, text, *_ = ("", "") if edit == "I" else next(left)
            if edit == "D":
                continue
            if edit != "K":
                role = "assistant" if self.state == USER else "user"
            self.state = NEXT[self.state, role[:1]]
            self.lines += 1
            yield role, text

    def gaps(self) -> int:
        return self.turns[1] - self.turns[0] + 1 - self.distinct if self.turns else 0


def damaged(conversations: DataFrame, *, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv_id, turn, role, text, present: rows damaged by crc32(`conv_id:turn`) % 20. 0 drops a row (present is false), 1 empties
    its text, 2 takes `.!?` out of it, 3 repeats it, 4 makes it the user's."""
    own = own_columns(conversations, conv_id=id_col, turn=turn_col, role=role_col, text=text_col).selectExpr("CAST(conv_id AS BIGINT) conv_id", "CAST(turn AS BIGINT) turn", "role", "text")
    spelled = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fault = F.crc32(F.concat(spelled("conv_id"), F.lit(":"), spelled("turn"))) % 20
    text = F.when(F.col("f") == 1, "").when(F.col("f") == 2, F.translate(spelled("text"), ".!?", "")).otherwise(spelled("text"))
    times = F.explode(F.when(F.col("f") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return own.withColumn("f", fault).select("conv_id", "turn", F.when(F.col("f") == 4, "user").otherwise(spelled("role")).alias("role"), text.alias("text"), (F.col("f") != 0).alias("present"), times.alias("copy")).drop("copy")


def _classified(rows: DataFrame) -> DataFrame:
    """Rows of conversations side by side and in order, with the first fault of each (0 none, 1 blank, 2 duplicate, 3 truncated)
    and the kind that says what may be done with it. One shuffle, by conversation."""
    text: Column = F.rtrim(F.col("text"), F.lit(BLANKS))
    before = Window.partitionBy("conv_id", "present", "role", "text").orderBy(F.col("turn").asc_nulls_first())
    dealt = rows.repartition("conv_id").withColumn("nth", F.row_number().over(before))
    fault = F.when(text == "", 1).when(F.col("nth") > 1, 2).when(~F.right(text, F.lit(1)).isin(".", "!", "?"), 3).otherwise(0)
    initial = F.left("role", F.lit(1))
    faulty = dealt.withColumn("fault", fault.cast("int"))
    kind = F.when(F.col("fault").isin(1, 2), "d").when(initial.isin("s", "u", "a"), initial).otherwise("x")
    return faulty.select("conv_id", "present", "turn", "role", "text", kind.alias("kind"), "fault", "nth").sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), "role", "text", "nth").drop("nth")


SUMMARY = pa.schema([("conv_id", pa.int64()), *((k, pa.int64()) for k in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")), ("audit", pa.string()), ("repaired_sha256", pa.string())])
TURNS = pa.schema([("conv_id", pa.int64()), ("place", pa.int64()), ("role", pa.string()), ("text", pa.string())])


def _advanced(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[Conversation, list[tuple[str, str]]]]:
    """Conversations of sorted rows, each with the lines that have become final; a long one comes several times."""
    waiting: list[Conversation] = []
    rows = chars = 0

    def flush() -> Iterator[tuple[Conversation, list[tuple[str, str]]]]:
        own = [x.segments() for x in waiting]
        entered = [range(4) if k else list(x.ways) for x, of in zip(waiting, own) for k in range(len(of))]
        begins = [(c, s) for c, states in enumerate(entered) for s in states]
        solved = iter(solve([s for of in own for s in of], begins))
        for x, of in zip(waiting, own):
            yield x, x.advance([next(solved) for _ in of])

    for batch in batches:
        for part in slices(batch, 4):
            for conv_id, present, turn, role, text, kind, fault in zip(*(c.to_pylist() for c in part.columns)):
                if not waiting or waiting[-1].conv_id != conv_id:
                    if waiting:
                        waiting[-1].whole = True
                    waiting.append(Conversation(conv_id))
                if present:
                    waiting[-1].add(turn, role, text, kind, fault)
                    rows, chars = rows + 1, chars + len(text)
                if rows >= BATCH_ROWS or chars >= BATCH_CHARS:
                    yield from flush()
                    waiting, rows, chars = waiting[-1:], 0, 0
    if waiting:
        waiting[-1].whole = True
        yield from flush()


def repair(rows: DataFrame) -> DataFrame:
    """One row for each conv_id of `rows` (conv_id, turn, role, text, present): gaps, blank, duplicate, truncated, illegal, cost,
    audit, and the SHA-256 of the repaired `role:text` lines. Rows that aren't present only name their conversation."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digests: dict = {}
        for x, lines in _advanced(batches):
            digest, begun = digests.pop(x.conv_id, None) or (hashlib.sha256(), False)
            for role, text in lines:
                digest.update(f"{chr(10) * begun}{role}:{text}".encode())
                begun = True
            if not x.whole:
                digests[x.conv_id] = digest, begun
                continue
            values = [x.conv_id, x.gaps(), *x.faults[1:], x.illegal, x.cost, "".join(x.audit), digest.hexdigest()]
            yield batch_of({f.name: [v] for f, v in zip(SUMMARY, values)}, SUMMARY)

    return _classified(rows).mapInArrow(run, "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string")


def repaired_turns(rows: DataFrame) -> DataFrame:
    """conv_id, place (from 0), role, text: the repaired conversations themselves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x, lines in _advanced(batches):
            if lines:
                first = x.lines - len(lines)
                yield batch_of({"conv_id": [x.conv_id] * len(lines), "place": list(range(first, x.lines)), "role": [r for r, _ in lines], "text": [t for _, t in lines]}, TURNS)

    return _classified(rows).mapInArrow(run, "conv_id long, place long, role string, text string")
