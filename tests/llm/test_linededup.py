import random
import re

import pytest
from pyspark.sql import functions as F

from corpusmill.llm import linededup


def brute(docs, need):
    """All repeated runs of enough words, one by one."""
    rows = sorted({((d is not None, d or 0), t) for d, t in docs if t is not None}, key=lambda r: r[0])
    lines = [(d, t.split("\n")) for d, t in rows]
    words = lambda x: max(1, len(re.findall(r"[^ \t\n\x0b\f\r]+", x)))
    seen, gone = set(), {}
    for k, (d, own) in enumerate(lines):
        for s in range(len(own)):
            total = 0
            for e in range(s, len(own)):
                total += words(own[e])
                run = tuple(own[s : e + 1])
                if total >= need and run in seen:
                    gone.setdefault(k, set()).update(range(s, e + 1))
                if total >= need:
                    seen.add(run)
    return {(d, "\n".join(own)): "\n".join(x for i, x in enumerate(own) if i not in gone.get(k, ())) for k, (d, own) in enumerate(lines)}


def deduplicated(spark, rows, need):
    docs = spark.createDataFrame([(i, t, n) for n, (i, t) in enumerate(rows)], "doc_id long, text string, h int")
    return linededup.deduplicate_lines(docs, need)


def check(spark, rows, need):
    want = brute(rows, need)
    out = deduplicated(spark, rows, need).collect()
    assert len(out) == len(rows)
    for r in out:
        d, t = rows[r.h]
        assert r.doc_id == d
        if t is None:
            assert (r.text, r.n_lines_, r.n_removed_) == (None, 0, 0)
        else:
            kept = want[(d is not None, d or 0), t]
            assert r.text == kept, (rows, r)
            assert r.n_lines_ == t.count("\n") + 1


@pytest.mark.parametrize("seed,need", [(0, 1), (1, 3), (2, 5), (3, 8), (4, 12)])
def test_equals_brute_force(spark, seed, need):
    r = random.Random(seed)
    pool = ["a", "b b", "c c c", "", "d d d d d", "e"]
    rows = [(i, "\n".join(r.choice(pool) for _ in range(r.randrange(1, 14)))) for i in range(40)]
    check(spark, rows, need)


def test_passages_of_several_lines(spark):
    passage = "\n".join(" ".join(f"p{i}w{k}" for k in range(20)) for i in range(3))
    rows = [(i, f"own start {i}\n{passage}\nown end {i}") for i in range(5)] + [(9, passage.split("\n")[0])]
    out = {r.doc_id: r.text for r in deduplicated(spark, rows, 50).collect()}
    assert out[0] == rows[0][1] and out[9] == rows[5][1]
    assert all(out[i] == f"own start {i}\nown end {i}" for i in range(1, 5))


def test_edges(spark):
    line = " ".join(["w"] * 60)
    rows = [(None, line), (2, line + "\n"), (2, line + "\n"), (3, None), (4, ""), (5, f"{line}\n{line}\n{line}"), (6, "\n" * 200), (7, "\n" * 200), (8, "one line")]
    docs = deduplicated(spark, rows, 50)
    out = {}
    for r in docs.collect():
        out.setdefault(r.doc_id, set()).add((r.text, r.n_removed_))
    assert out[None] == {(line, 0)} and out[2] == {("", 1)} and out[3] == {(None, 0)} and out[4] == {("", 0)} and out[8] == {("one line", 0)}
    assert out[5] == {("", 3)}
    assert out[7] == {("", 201)}
    assert docs.columns == ["doc_id", "text", "h", "n_lines_", "n_removed_"]
    empty = linededup.deduplicate_lines(spark.createDataFrame([], "doc_id long, text string"), 50)
    assert empty.count() == 0


def test_main_path_is_native(spark):
    rows = [(1, "a a a"), (2, "a a a")]
    plan = deduplicated(spark, rows, 2)._jdf.queryExecution().toString()
    assert not any(word in plan for word in ("Python", "Pandas", "Arrow"))


def test_suffix_array_order_and_common_prefixes(spark):
    """Ranks against sorted suffixes, common prefixes against a comparison line by line."""
    r = random.Random(6)
    islands = [[r.choice([0, 10, 20]) for _ in range(r.randrange(1, 30))] for _ in range(40)]
    first = {0: 0, 10: 1000, 20: 2000}  # any numbers in the lines' order, with room for the positions
    rows = [(d, 0, p, 0, first[x]) for d, own in enumerate(islands) for p, x in enumerate(own)]
    frame = spark.createDataFrame(rows, "d long, h long, p int, i int, r long")
    depth = 8
    array = linededup.suffix_array(frame, depth)
    got = {(x.d, x.p): x.r for x in array.collect()}
    suffix = {(d, p): tuple(own[p:]) for d, own in enumerate(islands) for p in range(len(own))}
    order = sorted(got, key=got.get)
    for a, b in zip(order, order[1:]):
        assert suffix[a][:depth] <= suffix[b][:depth]
        assert (got[a] == got[b]) == (suffix[a][:depth] == suffix[b][:depth])
    lines = linededup._first_lines(frame, array.select("d", "h", "p", "i"), depth)
    next_lines = {(x.d, x.p): tuple(x.lines) for x in lines.collect()}
    assert next_lines == {k: tuple(first[x] for x in s[:depth]) for k, s in suffix.items()}
    pairs = spark.createDataFrame([(list(next_lines[a]), list(next_lines[b])) for a, b in zip(order, order[1:])], "a array<long>, b array<long>")
    common = lambda x, y: next((i for i, (u, v) in enumerate(zip(x, y)) if u != v), min(len(x), len(y)))
    for x in pairs.select("a", "b", linededup.common_prefix(F.col("a"), F.col("b")).alias("n")).collect():
        assert x.n == common(x.a, x.b)


def test_intervals_within_a_document_and_over_islands(spark):
    """Runs that repeat with overlap, end at an island's end, or stand on both sides of a line that is alone."""
    a, b = "x " * 20, "y " * 20
    for rows in (
        [(1, "\n".join([a, b] * 6)), (2, "\n".join([b, a] * 4))],
        [(1, f"{a}\n{b}\n{a}\nalone\n{a}\n{b}\n{a}"), (2, f"{a}\n{b}\n{a}\n{b}")],
        [(1, f"{a}\n{b}\n{a}\nend"), (2, f"{a}\n{b}\n{a}\nshort"), (3, f"{a}\n{b}\n{a}\nshort")],
    ):
        check(spark, rows, 50)


@pytest.mark.parametrize("seed,need,span", [(0, 2, 1), (1, 3, 3), (2, 5, 2), (3, 8, 7), (4, 4, 5)])
def test_array_in_ranges(spark, monkeypatch, seed, need, span):
    """Intervals over several ranges of the suffix array, and ranges without a new interval."""
    monkeypatch.setattr(linededup, "SPAN", span)
    r = random.Random(seed)
    pool = ["a", "b b", "c c c", ""]
    check(spark, [(i, "\n".join(r.choice(pool) for _ in range(r.randrange(1, 12)))) for i in range(40)], need)


def test_one_header_before_many_lines(spark, monkeypatch):
    monkeypatch.setattr(linededup, "SPAN", 16)
    header = "h " * 30 + "\n" + "i " * 30
    check(spark, [(i, f"{header}\nown {i // 2}\nmore {i // 2}") for i in range(300)], 50)


def test_one_document_in_very_many_rows(spark):
    """Rows without an id that repeat one text, or have none, are a third of all each."""
    line = " ".join(["w"] * 60)
    n = 100_000
    text = F.when(F.col("id") % 3 == 0, F.lit(f"{line}\nend")).when(F.col("id") % 3 == 1, F.concat(F.lit(f"{line}\nown "), "id"))
    docs = spark.range(n).select(F.when(F.col("id") % 3 == 1, F.col("id")).alias("doc_id"), text.alias("text"))
    out = linededup.deduplicate_lines(docs, 50)
    got = {tuple(r) for r in out.groupBy(F.col("doc_id").isNull(), F.length("text") > 100, "n_lines_", "n_removed_").count().collect()}
    third = [len(range(i, n, 3)) for i in range(3)]
    assert got == {(True, True, 2, 0, third[0]), (False, False, 2, 1, third[1]), (True, None, 0, 0, third[2])}
