"""SimHash near-duplicates by similarity: two texts link at a Jaccard similarity of 0.8 or more of their sets of word shingles.

Candidates come from two sides, and all are verified on the whole sets.
  * SimHash: 64-bit fingerprints of the sets; simhash.links() finds those at most 3 bits apart by Golay-code keys, and texts of
    equal fingerprints meet their first one. This joins the copies with few changes, and so the large groups.
  * Fingerprints of two sets with a similarity of 0.8 differ by some ten bits of 64 on average, more than any keys by pigeonhole
    bear; so a prefix filter finds the rest, exactly: put all shingles in one order; of two sets that link, the first
    n - ceil(0.8 n) + K shingles of each (n: its own size) have K in common, or all of a smaller overlap. Any order will
    do, so shingles that a sample of texts holds often come last: they are keys of few texts then.

Work runs over distinct texts. Keys of at most `SMALL` texts count how many keys a pair shares. A pair that shares a key of more
texts needs no count: members of such a key are compared with a few others first; then every pair of the key whose members are
still in different components. Sizes, places in the order, and the parity of each set's hashes in `PARITY` places (sets differ in
as many shingles as parities, at least) tell apart what cannot link, before any set is read. So a large group of near copies
does not make pairs by its square. Nothing is dropped or capped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import simhash
from .common import batch_of, join_hot, materialize, only, own_columns, partitions, slices
from .components import components
from .words import mix

WORDS = 5
SHARE = (4, 5)  # least similarity, as a fraction
SAMPLE = 32  # one text of so many is looked at for common shingles
OFTEN, MOST_OFTEN = 3, 200_000  # a shingle is common if so many sampled texts hold it; how many of them are put last
BITMAP = 1 << 22  # places of the filter of texts that are candidates
K = 4  # keys that linked sets share
SMALL = 64  # texts of one key whose pairs are all counted
WINDOWS = (16, None)  # rounds: how many neighbours of a key's members are compared; at last all
PARITY = 256
GROUP = 50_000  # texts of one key that are compared in one block
AT_ONCE = 1 << 20  # rows of one key that a task holds
KEYS_AT_ONCE, PAIRS_AT_ONCE = 100_000, 1 << 18

KEYS = pa.schema([("key", pa.int64()), ("rep", pa.int64()), ("at", pa.int64())])
SETS = pa.schema([("rep", pa.int64()), ("hashes", pa.binary()), *[(f"p{i}", pa.int64()) for i in range(PARITY // 64)]])
COUNTS = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("at", pa.int64()), ("shared", pa.int32()), ("need", pa.int32())])
PAIRS = pa.schema([("a", pa.int64()), ("b", pa.int64())])


class _Hashes(dict):
    """XXH64 of words; the short ones are remembered, up to a bound."""

    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh64_intdigest(word, 42)
        if len(word) < 64:
            if len(self) >= 100_000:
                self.clear()
            self[word] = value
        return value


_hashes = _Hashes()


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """Sorted distinct hashes (unsigned 64-bit) of the shingles of `words` words; a text of fewer words is one shingle.

    Words are those of simhash.fingerprint(): A-Z lowered, cut at space and 0x09-0x0D.
    """
    parts = []
    for part in simhash.byte_parts((text or "").encode()):
        found = part.lower().split()
        parts.append(np.fromiter(map(_hashes.__getitem__, found), np.uint64, len(found)))
    own = parts[0] if len(parts) == 1 else np.concatenate(parts)
    n = min(words, len(own))
    if not n:
        return np.zeros(0, np.uint64)
    last = len(own) - n + 1
    mixed = np.full(last, n, np.uint64)
    for i in range(n):
        mixed = mixed * np.uint64(0x9E3779B97F4A7C15) + own[i : i + last]
        mixed ^= mixed >> np.uint64(29)
    return np.unique(mix(mixed))


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sorted sets have a similarity of SHARE or more; empty sets are equal."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return SHARE[1] * both >= SHARE[0] * (len(a) + len(b) - both)


def fingerprint(found: np.ndarray) -> int:
    """64-bit SimHash of a set, as a signed number: a bit is 1 if more than half of the hashes set it."""
    counts = np.zeros(64, np.int64)
    for i in range(0, len(found), 4096):
        counts += np.unpackbits(found[i : i + 4096].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits((2 * counts > len(found)).astype(np.uint8), bitorder="little").view("<i8")[0])


def parity(found: np.ndarray) -> np.ndarray:
    """PARITY bits, as signed numbers: whether an odd number of the set's hashes has each value modulo PARITY."""
    odd = np.bincount((found >> np.uint64(20) & np.uint64(PARITY - 1)).astype(np.int64), minlength=PARITY) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<i8")


def prefix(found: np.ndarray, often: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The keys of a set: its first shingles, rare ones first. `often` (sorted) are common shingles, `count` says how common."""
    rank = np.zeros(len(found), np.int64)
    if len(often):
        at = np.minimum(np.searchsorted(often, found), len(often) - 1)
        rank = np.where(often[at] == found, count[at], 0)
    least = -(-SHARE[0] * len(found) // SHARE[1])
    return found[np.lexsort((found, rank))[: len(found) - least + K]]


def may_link(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether sets can link that have one of their first K common keys at these sizes and places (size << 32 | place)."""
    (m, i), (n, j) = ((x >> 32, x & 0xFFFFFFFF) for x in (a, b))
    most = np.minimum(m - i, n - j) + K - 1
    return (SHARE[1] + SHARE[0]) * most >= SHARE[0] * (m + n)


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[np.ndarray], np.ndarray, np.ndarray, bool]]:
    """Rows (key, rep, ...) in that order, repeats left out: columns, and where each key's rows begin and end among them.

    A key of more than AT_ONCE rows comes in parts; True says that the first run goes on from the one before.
    """
    parts: list[list[np.ndarray]] = []
    size, goes_on = 0, False

    def whole() -> list[np.ndarray]:
        cols = [np.concatenate(x) for x in zip(*parts)]
        new = np.concatenate([[True], (cols[0][1:] != cols[0][:-1]) | (cols[1][1:] != cols[1][:-1])])
        return [c[new] for c in cols]

    for batch in batches:
        if not batch.num_rows:
            continue
        parts.append([batch.column(i).to_numpy(zero_copy_only=False) for i in range(batch.num_columns)])
        size += batch.num_rows
        one_key = parts[0][0][0] == parts[-1][0][-1]
        if one_key and size <= AT_ONCE:
            continue
        cols = whole()
        starts = np.flatnonzero(np.concatenate([[True], cols[0][1:] != cols[0][:-1]]))
        if one_key:
            yield cols, starts, np.array([len(cols[0])]), goes_on
            parts, size, goes_on = [[c[-1:].copy() for c in cols]], 1, True  # its last row again, which says that the key goes on
        else:
            yield cols, starts[:-1], starts[1:], goes_on
            parts, goes_on = [[c[starts[-1] :].copy() for c in cols]], False
            size = len(parts[0][0])
    if parts:
        cols = whole()
        yield cols, np.array([0]), np.array([len(cols[0])]), goes_on


def _counted(batches: Iterator[pa.RecordBatch], small: int) -> Iterator[pa.RecordBatch]:
    """Rows (key, rep, at) in key order. Pairs of small keys that may link, with how many keys they share and need to share;
    of larger keys the members instead (a: key, b: rep, at, shared: 0).
    """
    for (key, rep, at), starts, ends, goes_on in _runs(batches):
        sizes = ends - starts
        if goes_on:
            sizes[0] += small
        for s, e in zip(starts[sizes > small].tolist(), ends[sizes > small].tolist()):
            none = np.zeros(e - s, np.int32)
            yield batch_of({"a": key[s:e], "b": rep[s:e], "at": at[s:e], "shared": none, "need": none}, COUNTS)
        for size in np.unique(sizes[(sizes > 1) & (sizes <= small)]).tolist():
            every = starts[sizes == size]
            one, two = np.triu_indices(size, 1)
            for begin in range(0, len(every), max(1, PAIRS_AT_ONCE // len(one))):
                some = every[begin : begin + max(1, PAIRS_AT_ONCE // len(one)), None]
                i, j = (some + one).ravel(), (some + two).ravel()
                hit = may_link(at[i], at[j])
                i, j = i[hit], j[hit]
                size_of = (at[i] >> 32) + (at[j] >> 32)
                need = np.minimum(K, -(-SHARE[0] * size_of // sum(SHARE))).astype(np.int32)
                yield batch_of({"a": np.minimum(rep[i], rep[j]), "b": np.maximum(rep[i], rep[j]), "at": np.zeros(len(i), np.int64), "shared": np.ones(len(i), np.int32), "need": need}, COUNTS)


def _pairs(batches: Iterator[pa.RecordBatch], window: int | None) -> Iterator[pa.RecordBatch]:
    """Pairs of each key's members (key, rep, at, component, parities) that are in different components and may link: those of near
    places in a shuffled order, or all."""
    a, b, count = [], [], 0

    def out() -> pa.RecordBatch:
        x, y = (np.concatenate([*c, np.zeros(0, np.int64)]) for c in (a, b))
        both = np.unique(np.stack([np.minimum(x, y), np.maximum(x, y)]), axis=1)
        return batch_of({"a": both[0], "b": both[1]}, PAIRS)

    for cols, starts, ends, _ in _runs(batches):
        for s, e in zip(starts.tolist(), ends.tolist()):
            rep, at, component, *bits = (c[s:e] for c in cols[1:])
            order = np.argsort(mix(rep.view(np.uint64)), kind="stable")
            if window is None:  # pairs with one member at least outside of the largest component, that one first
                names, of, n = np.unique(component, return_inverse=True, return_counts=True)
                order = np.argsort(of == n.argmax(), kind="stable")
            rep, at, component, bits = rep[order], at[order], component[order], np.stack(bits, axis=1).view(np.uint64)[order]
            if window is None:
                blocks = ((slice(i, i + 1), slice(i + 1, len(rep))) for i in range(len(rep) - n.max()))
            else:
                blocks = ((slice(0, len(rep) - k), slice(k, len(rep))) for k in range(1, min(window, len(rep) - 1) + 1))
            for left, right in blocks:
                apart = np.bitwise_count(bits[left] ^ bits[right]).sum(axis=1, dtype=np.int64)
                hit = (component[left] != component[right]) & may_link(at[left], at[right])
                hit &= (SHARE[0] + SHARE[1]) * apart <= (SHARE[1] - SHARE[0]) * ((at[left] >> 32) + (at[right] >> 32))
                x, y = np.broadcast_arrays(rep[left], rep[right])
                a.append(x[hit]), b.append(y[hit])
                count += len(a[-1])
                if count > PAIRS_AT_ONCE:
                    yield out()
                    a, b, count = [], [], 0
    yield out()


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, 3):
            left, right = ([np.frombuffer(x.as_py(), np.uint64) for x in part.column(i)] for i in (2, 3))
            keep = pa.array([similar(x, y) for x, y in zip(left, right)], pa.bool_())
            yield pa.RecordBatch.from_arrays([part.column(i).filter(keep) for i in range(2)], schema=PAIRS)


def _common(texts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that many texts of a sample hold, sorted, and how many hold each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only("neardup", _hashes.clear)
        for batch in batches:
            for t in batch.column(0):
                yield pa.RecordBatch.from_arrays([pa.array(shingles(t.as_py()).view(np.int64))], ["key"])

    found = texts.where(F.pmod("rep", F.lit(SAMPLE)) == 0).select("text").mapInArrow(run, "key long")
    top = found.groupBy("key").count().where(F.col("count") >= OFTEN).orderBy(F.desc("count"), "key").limit(MOST_OFTEN).toArrow()
    often, count = top["key"].to_numpy().view(np.uint64), top["count"].to_numpy()
    order = np.argsort(often)
    return often[order], count[order]


def _keyed(texts: DataFrame) -> DataFrame:
    """key, rep, at (size << 32 | place) of the prefix of every text's set; and its fingerprint as the key, with -1 for `at`."""
    common = texts.sparkSession.sparkContext.broadcast(_common(texts))  # MOST_OFTEN numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only("neardup", _hashes.clear)
        often, count = common.value
        seen, held, size = set(), [], 0

        def out() -> pa.RecordBatch:
            return batch_of(dict(zip(KEYS.names, map(np.concatenate, zip(*held)))), KEYS)

        for batch in batches:
            for rep, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                if rep in seen:
                    continue
                seen.add(rep)
                found = shingles(text.as_py())
                own = prefix(found, often, count) if len(found) else np.zeros(1, np.uint64)  # texts without words share a key
                keys = np.append(own.view(np.int64), fingerprint(found))
                held.append((keys, np.full(len(keys), rep), np.append(len(found) << 32 | np.arange(len(own)), -1)))
                size += len(keys)
                if size > KEYS_AT_ONCE:
                    yield out()
                    held, size = [], 0
        if held:
            yield out()

    return materialize(texts.select("rep", "text").mapInArrow(run, "key long, rep long, at long"), "neardup-keys")


def _by_fingerprint(keyed: DataFrame) -> DataFrame:
    """a, b: texts that fingerprints join: each with the first of its own, and the first ones of linked fingerprints."""
    of = keyed.where("at < 0").select(F.col("key").alias("fp"), "rep").distinct()
    first = materialize(of.groupBy("fp").agg(F.min("rep").alias("first"), F.count("*").alias("n")), "neardup-prints")
    same = of.join(first.where("n > 1").select("fp", "first"), "fp").where("rep <> first").select(F.col("first").alias("a"), F.col("rep").alias("b"))
    linked = simhash.links(first.select("fp"))
    one, two = (first.select(F.col("fp").alias(x), F.col("first").alias(f"rep_{x}")) for x in "ab")
    return same.unionAll(linked.join(one, "a").join(two, "b").select("rep_a", "rep_b")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def _sets(texts: DataFrame, nodes: DataFrame) -> DataFrame:
    """rep, hashes, parities of the texts in `nodes`; a bitmap of bounded size leaves most others out where they are read."""
    x = F.pmod("rep", F.lit(BITMAP)) + 1
    rows = nodes.select(x.alias("x")).groupBy(F.bitmap_bucket_number("x").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("x")).alias("bits")).collect()  # BITMAP / 32768 rows
    bitmap = np.zeros(BITMAP // 8, np.uint8)
    for r in rows:
        bitmap[(r.bucket - 1) * 4096 : r.bucket * 4096] = np.frombuffer(bytes(r.bits), np.uint8)[: len(bitmap) - (r.bucket - 1) * 4096]
    wanted = texts.sparkSession.sparkContext.broadcast(bitmap)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only("neardup", _hashes.clear)
        bits, seen = wanted.value, set()
        for batch in batches:
            for part in slices(batch, 1):
                rows = []
                for rep, text in zip(part.column(0).to_pylist(), part.column(1)):
                    if bits[rep % BITMAP >> 3] >> (rep % BITMAP & 7) & 1 and rep not in seen:
                        seen.add(rep)
                        found = shingles(text.as_py())
                        rows.append((rep, found.tobytes(), *parity(found).tolist()))
                if rows:
                    yield batch_of(dict(zip(SETS.names, map(list, zip(*rows)))), SETS)

    found = texts.select("rep", "text").mapInArrow(run, "rep long, hashes binary, " + ", ".join(f"p{i} long" for i in range(PARITY // 64)))
    return materialize(found.join(nodes, "rep", "left_semi").dropDuplicates(["rep"]), "neardup-sets")


def _dealt(members: DataFrame) -> DataFrame:
    """`members` of keys; those of a key of more than GROUP go to each pair of blocks that their own block is part of."""
    large = members.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > GROUP).select("key", F.ceil(F.col("n") / GROUP).cast("int").alias("blocks"))
    large = materialize(large, "neardup-large")
    if large.isEmpty():
        return members
    names = members.columns[1:]
    own = members.join(large, "key").withColumn("own", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    parts = own.select(F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other")).alias("key"), *names)
    return members.join(large, "key", "left_anti").unionAll(parts)


def links(texts: DataFrame) -> DataFrame:
    """a, b: links among distinct texts (rep, text) by name, enough of them to connect all that linked pairs connect."""
    n = partitions(texts.sparkSession)
    keyed = _keyed(texts)
    small = SMALL

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _counted(batches, small)

    keys = keyed.where("at >= 0").repartition(n, "key").sortWithinPartitions("key", "rep")
    met = materialize(keys.mapInArrow(counted, "a long, b long, at long, shared int, need int"), "neardup-met")
    enough = met.where("shared > 0").groupBy("a", "b").agg(F.sum("shared").alias("shared"), F.max("need").alias("need")).where("shared >= need")
    pairs = materialize(enough.select("a", "b").unionAll(_by_fingerprint(keyed)).distinct(), "neardup-pairs")
    groups = met.where("shared = 0").selectExpr("a AS key", "b AS rep", "at")
    nodes = materialize(groups.select("rep").unionAll(pairs.selectExpr("explode(array(a, b)) AS rep")).distinct(), "neardup-nodes")
    sets = _sets(texts, nodes)

    def verified(pairs: DataFrame) -> DataFrame:
        one, two = (sets.select(F.col("rep").alias(x), F.col("hashes").alias(f"set_{x}")) for x in "ab")
        whole = pairs.join(one, "a").join(two, "b").select("a", "b", "set_a", "set_b")
        return materialize(whole.mapInArrow(_verified, "a long, b long"), "neardup-links")

    linked, tested = verified(pairs), pairs
    if groups.isEmpty():
        return linked
    marked = materialize(groups.join(sets.drop("hashes"), "rep"), "neardup-groups")
    for window in WINDOWS:
        of = components(linked).select(F.col("node").alias("rep"), "component")
        named = marked.join(of, "rep", "left").select("key", "rep", "at", F.coalesce("component", "rep").alias("component"), *[f"p{i}" for i in range(PARITY // 64)])

        def paired(batches: Iterator[pa.RecordBatch], window: int | None = window) -> Iterator[pa.RecordBatch]:
            return _pairs(batches, window)

        found = _dealt(named).repartition(n, "key").sortWithinPartitions("key", "rep").mapInArrow(paired, "a long, b long").distinct()
        pairs = materialize(found.join(tested, ["a", "b"], "left_anti"), "neardup-pairs")
        linked, tested = linked.unionAll(verified(pairs)), tested.unionAll(pairs)
    return linked


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text_hash, component (names the component of linked texts), one row for each row of `docs`.

    Null text and texts without words have the empty set; these link to each other and to no other text.
    """
    own = own_columns(docs, doc_id=id_col, text=text_col).selectExpr("CAST(doc_id AS BIGINT) doc_id", "text", "xxhash64(text) rep")
    marked = materialize(own.select("doc_id", "rep"), "neardup-rows")
    of = components(links(own.select("rep", "text"))).select(F.col("node").alias("rep"), "component")
    by_rep = marked.groupBy("rep").agg(F.count("*").alias("n")).join(of, "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    return join_hot(marked, materialize(by_rep, "neardup-named"), "rep").select("doc_id", F.col("rep").alias("text_hash"), "component")


def deduplicate(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`docs` with one row of each component: that with the smallest doc_id (null is the smallest), then the smallest text hash."""
    return simhash.keep_first(docs, near_duplicates(docs, id_col=id_col, text_col=text_col), id_col, text_col)
