import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from corpusmill.llm import fim, queries

TEXTS = ["", "a", "ab c", "日本語 text", "x<P>y", "<", "<P", "<PS>", "<<S>", "a<M", "é" * 300, "word " * 200, "a" * 255 + "b<S>", "a" * 256, "\n\r\t", "z" * 254 + "<M>", "z" * 253 + "<S>tail", "😀a😀", "\x00b"]


def brute(doc_id, text, seed=1):
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    n = len(units)
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[i : i + 8], 16) for i in range(0, 32, 8))
    if not text or re.search("<[PSM]>", text) or h3 % 100 >= 90:
        return n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    form = "spm" if h4 % 100 < 20 else "psm"
    return n, form, len(p), len(m), f"<P>{p}<S>{s}<M>{m}" if form == "psm" else f"<S>{s}<P>{p}<M>{m}"


def samples():
    r = random.Random(5)
    pool = ["a", "Zz", "<", ">", "P", "S", "M", "<P", "é", "日", "😀", " ", "\n", "word", "1", "<" * 5, "q" * 100]
    return TEXTS + ["".join(r.choice(pool) for _ in range(r.randrange(400))) for _ in range(600)]


@pytest.mark.parametrize("lane", [2, 3, 7, 256])
def test_cuts_equal_brute_force(monkeypatch, lane):
    monkeypatch.setattr(fim, "LANE", lane)
    texts = samples()[: 60 if lane < 7 else None]
    for (i, text), cut in zip(enumerate(texts), fim.cuts(list(range(len(texts))), [t.encode() for t in texts])):
        got = (cut.units, cut.form, cut.prefix_chars, cut.middle_chars, cut.applied(text.encode()).decode())
        assert got == brute(i, text), repr(text)


def test_documents(spark):
    texts = samples()
    rows = [(i, t, "x") for i, t in enumerate(texts)] + [(None, "null id " * 9, "x"), (3, None, "x"), (3, "again and again", "y"), (3, "again and again", "y"), (10**15, "long word " * 40_000, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, output string").repartition(3)
    out = fim.fill_in_middle(docs).withColumn("back", fim.restored(F.col("output"), F.col("form"))).collect()
    key = lambda x: str(x)
    assert sorted((key((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output)) for r in out)) == sorted(key((d, *brute(d, t or ""))) for d, t, _ in rows)
    assert sorted(key((r.doc_id, r.back)) for r in out) == sorted(key((d, t or "")) for d, t, _ in rows)
    assert fim.fill_in_middle(docs.where("false")).count() == 0
    forms = {r.form for r in out}
    assert forms == {"plain", "psm", "spm"}


def test_query_digests(spark):
    rows = [(r.doc_id, r.output_sha256, r.restored_sha256) for r in queries.op12_fill_in_middle(spark, "/root/testdata/sf0.001").collect()]
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert len(rows) == len(texts)
    assert all(out == sha(brute(d, texts[d])[-1]) and back == sha(texts[d]) for d, out, back in rows)
