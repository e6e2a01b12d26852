import random
import re

import numpy as np
import pytest
import xxhash

from corpusmill.llm import components, simhash


def plain_fingerprint(text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@pytest.mark.parametrize("text", [None, "", " \n", "One", "one TWO", "a b c", "É a b c d", "x y z x y z x y z", " a\tb\x0bc\x0cd\r\ne ", "a\x85b c d", "w " * 9000])
def test_fingerprint(text):
    assert simhash.fingerprint(text) == plain_fingerprint(text)


def test_golay_code():
    count, patterns, _ = simhash._cosets()
    assert sorted(set(count.tolist())) == [1, 6] and (count == 6).sum() == 1771
    r = np.random.default_rng(1)
    words = r.integers(0, 1 << 24, 300)
    codes, n = simhash.nearest_codewords(words)
    for w, c, k in zip(words, codes, n):
        mine = set(c[:k].tolist())
        for bit in range(24):
            other, m = simhash.nearest_codewords(np.array([w ^ (1 << bit)]))
            assert mine & set(other[0][: m[0]].tolist())


def test_linked_fingerprints_share_a_key():
    r = np.random.default_rng(2)
    for _ in range(400):
        a = r.integers(0, 1 << 63, dtype=np.int64).astype(np.uint64)
        b = a
        for bit in r.choice(64, r.integers(0, 4), replace=False):
            b ^= np.uint64(1) << np.uint64(bit)
        keys = [set(simhash.keys(np.array([x]))[0].tolist()) for x in (a, b)]
        assert keys[0] & keys[1]


def brute_components(prints):
    parent = list(range(len(prints)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 3:
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return [root(i) for i in range(len(prints))]


def linked(spark, prints, most=simhash.GROUP):
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    df = spark.createDataFrame([(p,) for p in set(signed)], "fp long")
    found = {r.node: r.component for r in components.components(simhash.links(df, most)).collect()}
    names = [found.get(p, p) for p in signed]
    first = {}
    return [first.setdefault(n, i) for i, n in enumerate(names)]


def cloud(r, n):
    """Chains of near fingerprints, far ones, and copies."""
    out = []
    for _ in range(n):
        p = r.getrandbits(64) if not out or r.random() < 0.3 else r.choice(out[-20:])
        for _ in range(r.randrange(0, 6)):
            p ^= 1 << r.randrange(64)
        out.append(p)
    return out


def test_components_equal_brute_force(spark):
    prints = [0, 1, 7, (1 << 64) - 1, *cloud(random.Random(5), 600)]
    assert linked(spark, prints) == brute_components(prints)


def test_large_groups_are_dealt_over_blocks(spark):
    r = random.Random(6)
    base = r.getrandbits(64)
    prints = list({base ^ sum(1 << b for b in r.sample(range(14), r.randrange(0, 8))) for _ in range(900)})
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    df = spark.createDataFrame([(p,) for p in signed], "fp long")
    keyed = df.mapInArrow(simhash._keyed, "key long, fp long")
    assert not keyed.groupBy("key").count().where("count > 64").isEmpty()
    assert linked(spark, prints, 64) == brute_components(prints)


def test_documents(spark):
    long = " ".join(f"word{i}" for i in range(300))
    rows = [(9, long, 1), (4, long, 2), (7, long + " tail", 3), (2, "other words here", 4), (3, None, 5), (1, "", 6), (None, "  ", 7), (2, long, 8), (None, "quite alone here", 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp int")
    got = simhash.near_duplicates(docs).collect()
    prints = {(r[0], simhash.fingerprint(r[1])) for r in rows}
    assert {(g.doc_id, int(g.fingerprint, 16)) for g in got} == prints and len(got) == len(rows)
    group = {g.doc_id: g.component_id for g in got if int(g.fingerprint, 16) == simhash.fingerprint(long)}
    assert {9, 4, 2} <= set(group) and set(group.values()) == {2}
    assert {g.component_id for g in got if g.fingerprint == "0" * 16} == {1}
    kept = simhash.deduplicate(docs)
    assert kept.columns == docs.columns
    assert sorted((str(r.doc_id), r.text) for r in kept.collect() if r.text == long) == [("2", long)]
    assert simhash.near_duplicates(docs.where("false")).count() == 0
    assert simhash.deduplicate(docs.where("false")).count() == 0


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, k) for k in range(101, 140)] + [(500, 500), (7, 3), (3, 7)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(61)} | {k: 100 for k in range(100, 140)}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("part", [1, 10, 64])
def test_fingerprint_of_a_long_text_in_parts(part, monkeypatch):
    r = random.Random(part)
    texts = [r.choice(["", " ", "\n "]).join(r.choice(["a", "B", "word ", " \t", "é "]) for _ in range(120)) for _ in range(20)] + ["one", "one two", "x" * 200]
    monkeypatch.setattr(simhash, "PART", part)
    assert [simhash.fingerprint(t) for t in texts] == [plain_fingerprint(t) for t in texts]


def test_texts_are_shuffled_once(spark):
    docs = spark.createDataFrame([(i, f"text number {i % 50} of several", "x") for i in range(200)], "doc_id long, text string, lang string")
    kept = simhash.deduplicate(docs)
    plan = kept._jdf.queryExecution().executedPlan().toString()
    with_text = [line for line in plan.splitlines() if "Exchange hashpartitioning(d_" in line]
    sides = [line for line in plan.splitlines() if re.search(r"Exchange", line)]
    assert len(with_text) <= 2 and len(sides) <= 6  # the documents once, the short list of first rows once, and that list's own
    assert kept.count() == 50


def test_settings_of_the_session_stay(spark):
    from corpusmill.llm import neardup, toxicity

    names = ["spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch", "spark.sql.shuffle.partitions"]
    before = [spark.conf.get(n, None) for n in names]
    docs = spark.createDataFrame([(i, f"some words {i % 3} to read here") for i in range(20)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(20)], "doc_id long, toxic int")
    simhash.near_duplicates(docs).count()
    neardup.deduplicate(docs).count()
    toxicity.score_toxicity(docs, labels).count()
    assert [spark.conf.get(n, None) for n in names] == before


def test_hot_rows(spark):
    """A third of all rows with one doc_id and text, another third of rows without both."""
    rows = [(5, "the same words again")] * 300 + [(None, None)] * 300 + [(i, f"words that differ {i} {i * 7} {i * 13}") for i in range(10, 310)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    near = simhash.near_duplicates(docs)
    assert near.count() == 900
    want = {(r.doc_id, r.text_hash): r.component for r in near.collect()}
    assert len(want) == 302
    kept = sorted(str(r.doc_id) for r in simhash.deduplicate(docs).collect())
    assert len(kept) == len(set(want.values())) and "5" in kept and "None" in kept
