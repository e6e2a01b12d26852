import random
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from test_bpe import brute_train

from corpusmill.operators import bpe, trainer


def table(spark, texts):
    return bpe.word_table(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")).cache()


def rounds_of(monkeypatch):
    """Counts the rounds, each of which is a pass over the words."""
    seen = []
    plain = trainer.measured

    def watch(words, known, row):
        seen.append(len(row))
        return plain(words, known, row)

    monkeypatch.setattr(trainer, "measured", watch)
    return seen


def corpus(seed, n=400):
    r = random.Random(seed)
    letters = "abcdeéf"[: r.randrange(2, 8)]
    pool = ["".join(r.choice(letters) for _ in range(r.randrange(1, 9))) for _ in range(60)]
    return [" ".join(r.choices(pool, [1 / (i + 1) for i in range(60)], k=r.randrange(1, 20))) for _ in range(n)]


@pytest.mark.parametrize("seed", range(4))
def test_equal_to_brute_force_on_random_corpora(spark, seed):
    texts = corpus(seed)
    assert trainer.train_merges(table(spark, texts), 120) == brute_train(texts, 256 + 120, [])


@pytest.mark.parametrize("row, candidates", [(1, 2048), (3, 2048), (7, 5), (40, 1), (40, 30)])
def test_any_row_and_few_followed_pairs_give_the_same(spark, monkeypatch, row, candidates):
    monkeypatch.setattr(trainer, "ROW", row)
    monkeypatch.setattr(trainer, "CANDIDATES", candidates)
    monkeypatch.setattr(trainer, "PART_BYTES", 50)
    texts = corpus(11, 30)
    assert trainer.train_merges(table(spark, texts), 14) == brute_train(texts, 256 + 14, [])


def test_a_wrong_guess_decides_nothing(spark, monkeypatch):
    """Even a first guess made on other words, and all guesses reversed."""
    texts = corpus(12, 60)
    right = brute_train(texts, 256 + 25, [])
    monkeypatch.setattr(trainer, "guessed", lambda *a: [(b"x", b"y"), (b"b", b"a")])
    words = table(spark, texts)
    assert trainer.train_merges(words, 25) == right
    monkeypatch.setattr(trainer.Followed, "next_row", lambda self, row, most: row[::-1])
    assert trainer.train_merges(words, 6) == right[:6]


def test_all_merges_until_no_pair_is_left(spark):
    texts = ["aaaa aaa ab", "ba ab", "é"]
    assert trainer.train_merges(table(spark, texts), 1000) == brute_train(texts, 2000, [])


def test_two_hundred_merges_take_a_tenth_as_many_passes(spark, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    seen = rounds_of(monkeypatch)
    merges = trainer.train_merges(bpe.word_table(docs).cache(), 200)
    assert len(merges) == 200 and len(seen) <= 20, seen


def test_no_task_has_all_words(spark):
    """The plan groups pairs, never words, and by no constant."""
    words = spark.createDataFrame([("ab", 2)], "word string, n long")
    plan = trainer.measured(words, [(b"a", b"b")], [(b"ab", b"c")])._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan and plan.count("hashpartitioning(l") == 1 and plan.count("Exchange") == 1


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.text("ab", min_size=1, max_size=9), st.integers(1, 5)), min_size=1, max_size=6), st.lists(st.tuples(st.sampled_from([b"a", b"b", b"ab", b"aa"]), st.sampled_from([b"a", b"b", b"ba", b"aa"])), max_size=5))
def test_changes_equal_a_recount(words, merges):
    number = trainer.Numbers()
    own = trainer.Words([list(w.encode()) for w, _ in words], [n for _, n in words])
    lists = [([c.encode() for c in w], n) for w, n in words]

    def recount():
        found = Counter()
        for toks, n in lists:
            for p in zip(toks, toks[1:]):
                found[p] += n
        return found

    named = lambda keys, values: {(number.tokens[k >> 32], number.tokens[k & 0xFFFFFFFF]): n for k, n in zip(keys.tolist(), values.tolist())}
    counts = recount()
    assert named(*own.pairs()) == counts
    for left, right in merges:
        changes = named(*own.merge(number[left], number[right], number[left + right]))
        for toks, _ in lists:
            i = 0
            while i < len(toks) - 1:
                if (toks[i], toks[i + 1]) == (left, right):
                    toks[i : i + 2] = [left + right]
                i += 1
        after = recount()
        assert changes == {p: after[p] - counts[p] for p in {*after, *counts} if after[p] != counts[p]}
        counts = after


def test_small_batches_are_measured_together(spark, monkeypatch):
    """A round's work is by parts of PART_BYTES, not by Arrow batch; parts hold all words, and no more than that and a word."""
    import pyarrow as pa

    words = [f"w{i}é" * (i % 5) for i in range(1000)] + ["long" * 500]
    table = pa.table({"word": words, "n": list(range(len(words)))})
    for most in (50, 300, 1 << 20):
        monkeypatch.setattr(trainer, "PART_BYTES", most)
        parts = list(trainer._parts(iter(table.to_batches(max_chunksize=7))))
        assert b"".join(raw.tobytes() for raw, _, _ in parts) == "".join(words).encode()
        assert [n for _, sizes, _ in parts for n in sizes] == [len(w.encode()) for w in words]
        assert [n for _, _, times in parts for n in times] == list(range(len(words)))
        assert all(len(raw) <= most or len(sizes) == 1 or len(raw) - sizes[-1] < most for raw, sizes, _ in parts)
        assert len(parts) <= 2 * sum(len(w.encode()) for w in words) // most + 2


def test_known_merges_are_done_in_their_order(spark):
    """Also where two of them give one token: each pass has the words as training left them."""
    words = spark.createDataFrame([("aab", 3), ("aaab", 2), ("baab", 1)], "word string, n long")
    known = [(b"a", b"b"), (b"a", b"a"), (b"aa", b"b"), (b"a", b"ab")]
    got = {(bytes(r.l), bytes(r.r)): [tuple(c) for c in r.changes] for r in trainer.measured(words, known, []).collect()}
    assert got == {(b"aa", b"ab"): [(-1, 2)], (b"b", b"aab"): [(-1, 1)]}
