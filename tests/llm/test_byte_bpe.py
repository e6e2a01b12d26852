import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from corpusmill.llm import bpe

PATH, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


@pytest.fixture(scope="module")
def own():
    return bpe.codec(PATH, PATTERN)


@pytest.fixture(scope="module")
def library(own):
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=own.ranks, special_tokens={})


def test_rank_queue_gives_smallest_rank_then_leftmost():
    r = random.Random(1)
    for _ in range(50):
        queue, held = bpe.RankQueue(50_000), []
        if r.random() < 0.5:
            start = [r.choice([-1, 5, 63, 64, 4095, 4096, 49_999]) for _ in range(20)]
            queue.fill(start)
            held = [(x, i) for i, x in enumerate(start) if x >= 0]
        for _ in range(40):
            item = (r.choice([0, 5, 63, 64, 4095, 4096, 49_999]), r.randrange(1000))
            queue.push(*item)
            held.append(item)
        out = []
        while (rank := queue.first()) >= 0:
            bucket = queue.buckets[rank]
            out.append((rank, bpe.heappop(bucket)))
            if not bucket:
                queue.drop(rank)
        assert out == sorted(held) and not queue.top and not any(queue.low)


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_encoding_equals_the_library(own, library, text):
    assert own.encode(text) == library.encode_ordinary(text)
    assert own.decode(own.encode(text)) == text.encode()


@pytest.mark.parametrize("text", ["", " " * 3000, "a" * 5000, "ab" * 4000, "aaab" * 2000, "é" * 999, "\n\n\n", "x" * 2 + "😀" * 700, "thethe" * 3000])
def test_long_pretokens(own, library, text):
    assert own.encode(text) == library.encode_ordinary(text)


def test_incomplete_tables_are_refused():
    with pytest.raises(ValueError):
        bpe.Codec({b"a": 0}, PATTERN)
    with pytest.raises(KeyError):
        bpe.codec(PATH, PATTERN).decode([10**6])


def test_documents(spark, own):
    rows = [(1, "The cat, l'été!", "x"), (2, None, "y"), (None, "", "z"), (1, "The cat, l'été!", "x"), (5, "a" * 10_000 + " b", "q")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = sorted(map(tuple, bpe.digest_documents(docs, PATH, PATTERN).collect()), key=str)
    want = []
    for d, t, _ in rows:
        ids = own.encode(t or "")
        want.append((d, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert got == sorted(want, key=str)
    back = bpe.decode_documents(bpe.encode_documents(docs, PATH, PATTERN), PATH, PATTERN)
    assert sorted((str(r.doc_id), r.text) for r in back.collect()) == sorted((str(d), t or "") for d, t, _ in rows)
    assert bpe.digest_documents(docs.where("false"), PATH, PATTERN).count() == 0


def test_words_that_come_up_again_stay_remembered(own, monkeypatch):
    """A full memory forgets its older half alone; what is frequent is merged once."""
    monkeypatch.setattr(bpe, "REMEMBERED", 20)
    made = bpe._Packed(own)
    merged, plain = [], own.merge
    monkeypatch.setattr(own, "merge", lambda raw: merged.append(raw) or plain(raw))
    for i in range(200):
        for w in ("qxheron", "qxmillrace", f"qxrare{i}"):
            assert bpe.unpack(made[w]) == plain(w.encode())
        assert len(made) + len(made.older) <= 20
    assert merged.count(b"qxheron") == merged.count(b"qxmillrace") == 1
    assert len(merged) == 202
