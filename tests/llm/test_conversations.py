import functools
import hashlib
import itertools
import random
import re
import zlib

import pytest

from corpusmill.llm import conversations as C
from corpusmill.llm import queries

LEGAL = re.compile(r"(s?(ua)+)?")


def brute_faults(rows):
    """Rows (turn, role, text) in order to (role, text, fault)."""
    out, seen = [], set()
    for _, role, text in rows:
        solid = re.findall(r"[^\x20\x09-\x0D]", text)
        fault = "blank" if not solid else "duplicate" if (role, text) in seen else "truncated" if solid[-1] not in ".!?" else None
        seen.add((role, text))
        out.append((role, text, fault))
    return out


def brute_every(rows):
    """Cheapest edits by trying every one of them; for a few rows."""
    per_row = []
    for role, text, fault in rows:
        ways = [("D", 4, [])]
        if fault not in ("blank", "duplicate"):
            extra = 3 * (fault == "truncated")
            ways += [("K", extra, [(role, text)]), ("R", 3 + extra, [("user", text)]), ("R", 3 + extra, [("assistant", text)])]
        per_row.append(ways)
    inserted = [("I" * n, 3 * n, [(r, "") for r in roles]) for n in range(3) for roles in itertools.product(("user", "assistant"), repeat=n)]
    steps = [x for ways in per_row for x in (inserted, ways)] + [inserted]
    best = None
    for chosen in itertools.product(*steps):
        lines = [line for *_, own in chosen for line in own]
        found = (sum(c for _, c, _ in chosen), "".join(e for e, *_ in chosen), lines)
        if (best is None or found[:2] < best[:2]) and all(r for r, _ in lines) and LEGAL.fullmatch("".join(r[0] for r, _ in lines)):
            best = found
    return best


def brute_backwards(rows):
    """The same from the end, one edit at a time, for any number of rows."""
    after = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}

    @functools.lru_cache(maxsize=None)
    def ends(i, state, inserts):
        found = []
        if i == len(rows) and state in ("", "a"):
            found.append((0, "", None))
        steps = []
        if inserts < 3:
            steps += [("I", 3, (r, ""), i, inserts + 1) for r in ("user", "assistant")]
        if i < len(rows):
            role, text, fault = rows[i]
            steps.append(("D", 4, None, i + 1, 0))
            if fault not in ("blank", "duplicate"):
                extra = 3 * (fault == "truncated")
                steps += [("K", extra, (role, text), i + 1, 0), ("R", 3 + extra, ("user", text), i + 1, 0), ("R", 3 + extra, ("assistant", text), i + 1, 0)]
        for edit, cost, line, j, n in steps:
            to = state if line is None else after.get((state, line[0][:1]))
            if to is not None and (rest := ends(j, to, n)):
                found.append((cost + rest[0], edit + rest[1], (line, rest[2])))
        return min(found, key=lambda x: x[:2]) if found else None

    for i in range(len(rows), -1, -50):  # keeps the recursion flat
        [ends(i, s, n) for s in ("", "s", "u", "a") for n in range(4)]
    cost, audit, chain = ends(0, "", 0)
    lines = []
    while chain:
        lines, chain = lines + [chain[0]] * (chain[0] is not None), chain[1]
    return cost, audit, lines


def brute_damage(rows):
    out = {}
    for conv, turn, role, text in rows:
        kept = out.setdefault(conv, [])
        role, text = " " if role is None else role, " " if text is None else text
        h = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if h:
            text = "" if h == 1 else re.sub("[.!?]", "", text) if h == 2 else text
            kept += [(turn, "user" if h == 4 else role, text)] * (2 if h == 3 else 1)
    return {c: sorted(x, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2])) for c, x in out.items()}


def brute(rows):
    found = {}
    for conv, own in brute_damage(rows).items():
        turns = [t for t, *_ in own if t is not None]
        faults = brute_faults(own)
        cost, audit, lines = brute_backwards(faults)
        initials = [r[:1] for r, _, _ in faults]
        counts = [sum(f == k for *_, f in faults) for k in ("blank", "duplicate", "truncated")]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        sha = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in lines).encode()).hexdigest()
        found[conv] = (gaps, *counts, illegal, cost, audit, sha), lines
    return found


def random_rows(r, n):
    texts = ["Yes.", "No!", "Why?", "cut off", "", " \t", "Ok.  ", "é", "."]
    roles = ["system", "user", "assistant", "assistant", "user", "tool", "", " ", "unknown", "User"]
    return [(0, r.choice(roles), r.choice(texts) + str(r.randrange(9)) * r.randrange(2)) for _ in range(n)]


def streamed(rows):
    """Faulty rows through segments and batches, without Spark."""
    kind = lambda role, fault: "d" if fault in ("blank", "duplicate") else role[:1] if role[:1] and role[:1] in "sua" else "x"
    table = [(7, True, i, role, text, kind(role, fault), [None, "blank", "duplicate", "truncated"].index(fault)) for i, (role, text, fault) in enumerate(rows)]
    import pyarrow as pa

    names = ["conv_id", "present", "turn", "role", "text", "kind", "fault"]
    batch = pa.RecordBatch.from_pydict({n: list(c) for n, c in zip(names, zip(*table))}) if table else None
    lines, x = [], C.Conversation(7, whole=True)
    for x, some in C._advanced([batch] if batch else []):
        lines += some
    return (x.cost, "".join(x.audit), lines) if table else (0, "", [])


def test_equal_to_every_edit_tried():
    r = random.Random(2)
    for n in (0, 1, 1, 1, 2, 2, 2):
        for _ in range(12):
            rows = brute_faults(random_rows(r, n))
            assert streamed(rows) == brute_every(rows) == brute_backwards(rows), rows


@pytest.mark.parametrize("segment, batch", [(1, 1), (2, 5), (3, 7), (64, 8192)])
def test_segments_and_batches_change_nothing(monkeypatch, segment, batch):
    monkeypatch.setattr(C, "SEGMENT", segment)
    monkeypatch.setattr(C, "BATCH_ROWS", batch)
    r = random.Random(segment)
    for n in (1, 4, 9, 30, 60):
        for _ in range(4):
            rows = brute_faults(random_rows(r, n))
            assert streamed(rows) == brute_backwards(rows), rows


def test_lines_of_a_long_conversation_leave_memory(monkeypatch):
    monkeypatch.setattr(C, "BATCH_ROWS", 50)
    rows = [(("user", "assistant")[i % 2], f"Turn {i}.", None) for i in range(2000)]
    held = []
    advance = C.Conversation.advance

    def watch(self, solved):
        out = advance(self, solved)
        held.append(sum(len(rows) for rows, _ in next(iter(self.open.values()))))
        return out

    monkeypatch.setattr(C.Conversation, "advance", watch)
    cost, audit, lines = streamed(rows)
    assert (cost, audit, len(lines)) == (0, "K" * 2000, 2000)
    assert max(held) <= 100


def as_rows(found):
    return sorted(((str(r.conv_id), r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256) for r in found))


def test_nulls_ties_repeats_and_clashing_names(spark):
    r = random.Random(9)
    texts = ["Yes.", "No!", None, "cut off", "", "  ", "Ok. ", "Why?"]
    roles = ["system", "user", "assistant", "assistant", "user", None, "tool", ""]
    rows = [(c, t, r.choice(roles), r.choice(texts)) for c in [*range(40), None] for t in [None, *range(r.randrange(12)), 3, 3, 10**12]]
    rows += [(99, 0, "user", "Once."), (99, 0, "user", "Once.")]
    rows += [(c, t, "user", "x") for c in range(200, 260) for t in [1]]
    data = spark.createDataFrame([(*x, 1, "z") for x in rows], "conv_id long, turn long, role string, text string, kind int, present string").repartition(5)
    want = brute(rows)
    assert any(not x[6] and x[7] == hashlib.sha256(b"").hexdigest() for x, _ in want.values())
    assert as_rows(C.repair(C.damaged(data)).collect()) == sorted((str(c), *x) for c, (x, _) in want.items())
    turns = {}
    for t in sorted(C.repaired_turns(C.damaged(data)).collect(), key=lambda t: t.place):
        turns.setdefault(t.conv_id, []).append((t.role, t.text))
    assert turns == {c: lines for c, (_, lines) in want.items() if lines}
    assert C.repair(C.damaged(data.where("false"))).count() == 0


def test_query_equals_brute_force(spark):
    rows = [tuple(x) for x in spark.read.parquet("/root/testdata/sf0.01/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert as_rows(queries.op13_conversations(spark, "/root/testdata/sf0.01").collect()) == sorted((str(c), *x) for c, (x, _) in brute(rows).items())
