"""SimHash near-duplicates with Golay-code fuzzy hashing.

Fingerprint: 64 bits over word shingles (see fingerprint()). Two fingerprints link at 3 or fewer differing bits.

Candidates: a fingerprint is cut into segments of 22, 21 and 21 bits, each read as a word of the extended binary Golay code
[24, 12, 8] (padded with zeros). Decoding gives the index of the one codeword within 3 bits, or of all six at 4 bits. Two
words at most one bit apart share a codeword: one of the two has odd weight, hence is at distance 1 or 3 of a unique
codeword, and the other one is at distance 4 or less of that codeword, and no nearer to another.
By the pigeonhole principle 3 errors over 3 segments leave
  * a segment without error and another one with at most one: keys (A) are, for each ordered pair of segments, the bits of
    the first and one codeword index of the second; or
  * one error in every segment: keys (B) are one codeword index for each segment.
So a pair of linked fingerprints shares a key; candidates of a key are verified by their Hamming distance.

Work runs over distinct fingerprints, and each key's group yields a spanning forest of its links, not all pairs. A group of
more than `GROUP` fingerprints is dealt over block pairs of bounded size. Nothing is dropped or capped.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch_of, join_hot, materialize, only, own_columns, partitions, place, slices
from .components import components

SEGMENTS = ((0, 22), (22, 21), (43, 21))  # first bit, bits
DISTANCE = 3
GOLAY_POLYNOMIAL = 0xC75  # fixed value: x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1 generates the binary Golay code
HOT_SHARE = 1024  # keys of over one row in so many are treated apart
GROUP = 2048  # fingerprints of one key that are compared at once
PART = 1 << 20  # bytes of a text that are cut into words at once
WHITE = re.compile(rb"[ \t-\r]")


def byte_parts(raw: bytes) -> Iterator[bytes]:
    """A text in parts of about PART bytes, cut at white space."""
    at = 0
    while len(raw) - at > PART:
        cut = WHITE.search(raw, at + PART)
        if not cut:
            break
        yield raw[at : cut.start()]
        at = cut.end()
    yield raw[at:]


def fingerprint(text: str | None, words: int = 3) -> int:
    """64-bit SimHash of the shingles of `words` words, repeats included; 0 without words.

    A-Z are lowered; words are runs of bytes other than space and 0x09-0x0D; shingles are joined by one space, fewer words
    make one shingle; a shingle is hashed by XXH64 with seed 42; a bit is 1 if more than half of the hashes set it.
    """
    counts, total, found = np.zeros(64, np.int64), 0, []
    for part in byte_parts((text or "").encode()):
        found += part.lower().split()
        if len(found) < words:
            continue
        joined = b" ".join(found)
        lengths = np.fromiter(map(len, found), np.int64, len(found)) + 1
        ends = np.cumsum(lengths) - 1
        last = len(found) - words + 1
        begins = (ends - lengths + 1)[:last].tolist()
        hashes = np.array([xxhash.xxh64_intdigest(joined[a:b], 42) for a, b in zip(begins, ends[words - 1 :].tolist())], "<u8")
        for i in range(0, last, 4096):
            some = hashes[i : i + 4096]
            counts += np.unpackbits(some.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        total += last
        found = found[last:]
    if not total:
        return xxhash.xxh64_intdigest(b" ".join(found), 42) if found else 0
    bits = (2 * counts > total).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


@functools.lru_cache(maxsize=1)
def _cosets() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each syndrome: how many nearest error patterns, and the patterns; and the syndromes of the 24 unit words."""
    rows = []
    for i in range(12):  # systematic generator of the cyclic code, message in the high 12 bits, then a parity bit
        rest = 1 << (i + 11)
        for b in range(22, 10, -1):
            if rest >> b & 1:
                rest ^= GOLAY_POLYNOMIAL << (b - 11)
        word = (1 << (i + 11) | rest) << 1
        rows.append(word | (word.bit_count() & 1))
    units = np.zeros(24, np.int64)
    for bit in range(12):  # syndrome of a word: its low 12 bits, less those that its message part calls for
        units[bit] = 1 << bit
    for i in range(12):
        units[12 + i] = rows[i] & 0xFFF
    count, patterns = np.zeros(4096, np.int64), np.zeros((4096, 6), np.int64)
    import itertools

    for weight in range(5):
        for at in itertools.combinations(range(24), weight):
            syndrome = 0
            for b in at:
                syndrome ^= int(units[b])
            if weight == 4 and count[syndrome] and int(patterns[syndrome, 0]).bit_count() < 4:
                continue
            patterns[syndrome, count[syndrome]] = sum(1 << b for b in at)
            count[syndrome] += 1
    return count, patterns, units


@functools.lru_cache(maxsize=1)
def _syndromes() -> tuple[np.ndarray, np.ndarray]:
    """Syndromes of the low and of the high 12 bits of a word."""
    units = _cosets()[2]
    tables = []
    for first in (0, 12):
        values = np.zeros(4096, np.int64)
        for b in range(12):
            values[np.arange(4096) >> b & 1 == 1] ^= units[first + b]
        tables.append(values)
    return tables[0], tables[1]


def nearest_codewords(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For 24-bit words: the 12-bit indices of their nearest codewords, (n, 6), and how many of them count (1 or 6)."""
    count, patterns, _ = _cosets()
    low, high = _syndromes()
    syndrome = low[words & 0xFFF] ^ high[words >> 12]
    return (words[:, None] ^ patterns[syndrome]) >> 12, count[syndrome]


def keys(fingerprints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys (signed 64-bit) of fingerprints (unsigned 64-bit), and the place of each key's fingerprint."""
    parts = [(fingerprints >> np.uint64(at) & np.uint64((1 << bits) - 1)).astype(np.int64) for at, bits in SEGMENTS]
    decoded = [nearest_codewords(p) for p in parts]
    out, of = [], []
    kind = 0
    for exact in range(3):
        for fuzzy in range(3):
            if exact != fuzzy:
                codes, n = decoded[fuzzy]
                for k in range(6):
                    at = np.flatnonzero(n > k)
                    out.append(kind << 56 | parts[exact][at] << 12 | codes[at, k])
                    of.append(at)
                kind += 1
    (ca, na), (cb, nb), (cc, nc) = decoded
    for i in range(6):
        for j in range(6):
            for k in range(6):
                at = np.flatnonzero((na > i) & (nb > j) & (nc > k))
                if len(at):
                    out.append(kind << 56 | ca[at, i] << 24 | cb[at, j] << 12 | cc[at, k])
                    of.append(at)
    return np.concatenate(out), np.concatenate(of)


def forest(members: np.ndarray) -> list[tuple[int, int]]:
    """Edges (places in `members`) of a spanning forest of the links among them; memory is a block of rows."""
    n = len(members)
    if n == 2:
        return [(0, 1)] if int(members[0] ^ members[1]).bit_count() <= DISTANCE else []
    left, edges = np.arange(n), []
    while len(left):
        frontier, left = left[:1], left[1:]
        while len(frontier) and len(left):
            reached = []
            for i in frontier:
                hit = np.bitwise_count(members[left] ^ members[i]) <= DISTANCE
                if hit.any():
                    new = left[hit]
                    edges += [(int(i), int(j)) for j in new]
                    reached.append(new)
                    left = left[~hit]
                    if not len(left):
                        break
            frontier = np.concatenate(reached) if reached else left[:0]
    return edges


FINGERPRINTS = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64()), ("fp", pa.int64())])
KEYS = pa.schema([("key", pa.int64()), ("fp", pa.int64())])
LINKS = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("waits", pa.int64())])


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words: int = 3) -> DataFrame:
    """doc_id, text_hash, fp (the fingerprint's bits as a signed long), one row for each row of `docs`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only("simhash", lambda: None)
        for batch in batches:
            for part in slices(batch, 2):
                found = np.array([fingerprint(t.as_py(), words) for t in part.column(2)], np.uint64).view(np.int64)
                yield batch_of({"doc_id": part.column(0), "text_hash": part.column(1), "fp": found}, FINGERPRINTS)

    own = own_columns(docs, doc_id=id_col, text=text_col).selectExpr("CAST(doc_id AS BIGINT) doc_id", "xxhash64(text) text_hash", "text")
    return own.mapInArrow(run, "doc_id long, text_hash long, fp long")


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(0, batch.num_rows, 2000):
            own = batch.column(0).slice(i, 2000).to_numpy(zero_copy_only=False)
            key, of = keys(own.view(np.uint64))
            yield batch_of({"key": key, "fp": own[of]}, KEYS)


def _linked(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Rows in key order. Links of each key's group; a group of more than `most` says how many it has instead (a: key, waits)."""
    key, held, count = None, [], 0

    def close(a: list, b: list, waits: list) -> None:
        if count > most:
            a.append(key), b.append(0), waits.append(count)
        elif count > 1:
            group = np.concatenate(held)
            for i, j in forest(group.view(np.uint64)):
                a.append(int(group[i])), b.append(int(group[j])), waits.append(0)

    for batch in batches:
        a, b, waits = [], [], []
        ks, fps = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(2))
        starts = np.flatnonzero(np.concatenate([[True], ks[1:] != ks[:-1]]))
        ends = np.append(starts[1:], len(ks))
        if not len(ks):
            continue
        several = np.flatnonzero(ends - starts > 1)
        edge = {0, len(starts) - 1}  # only the first and last run can go on in another batch
        for r in sorted(edge | set(several.tolist())):
            s, e = int(starts[r]), int(ends[r])
            if r in edge:
                if key is not None and ks[s] != key:
                    close(a, b, waits)
                    key, held, count = None, [], 0
                key, count = int(ks[s]), count + e - s
                if count <= most:
                    held.append(fps[s:e].copy())
                else:
                    held = []
            else:
                if key is not None:
                    close(a, b, waits)
                    key, held, count = None, [], 0
                if e - s > most:
                    a.append(int(ks[s])), b.append(0), waits.append(e - s)
                else:
                    for i, j in forest(fps[s:e].view(np.uint64)):
                        a.append(int(fps[s + i])), b.append(int(fps[s + j])), waits.append(0)
        yield batch_of({"a": a, "b": b, "waits": waits}, LINKS)
    a, b, waits = [], [], []
    if key is not None:
        close(a, b, waits)
    yield batch_of({"a": a, "b": b, "waits": waits}, LINKS)


def links(distinct: DataFrame, most: int = GROUP) -> DataFrame:
    """a, b: links among the distinct fingerprints `fp`, enough of them to connect all that linked pairs connect."""
    n = partitions(distinct.sparkSession)
    schema = "a long, b long, waits long"

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _linked(batches, most)

    def pairs() -> DataFrame:
        return distinct.select("fp").mapInArrow(_keyed, "key long, fp long")

    found = materialize(pairs().repartition(n, "key").sortWithinPartitions("key").mapInArrow(linked, schema), "simhash-links")
    edges = found.where("waits = 0").select("a", "b").distinct()
    waiting = found.where("waits > 0").select(F.col("a").alias("key"), F.ceil(F.col("waits") / max(1, most // 4)).cast("int").alias("blocks"))
    if waiting.isEmpty():
        return edges
    # A large group: every member goes to each pair of blocks that its own block is part of, about half of `most` members a pair.
    block = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
    dealt = pairs().join(waiting, "key").withColumn("own", block).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select(F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other")).alias("key"), "fp")
    more = materialize(dealt.repartition(n, "key").sortWithinPartitions("key").mapInArrow(linked, schema), "simhash-links")
    if not more.where("waits > 0").isEmpty():
        raise RuntimeError("a block pair exceeds its bound")
    return edges.unionAll(more.select("a", "b")).distinct()


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words: int = 3) -> DataFrame:
    """doc_id, fingerprint (16 lower-case hex digits), component_id (the smallest doc_id reachable, itself included), text_hash,
    component (names the component even where it has no id).

    Defined results: null text has no words, so its fingerprint is zero, and it links like any other; null doc_id takes part
    but names a component only if the component has no other id (component_id is null then); each row of a repeated doc_id
    has its own fingerprint and component; an empty table gives an empty table; further columns are ignored.
    """
    marked = materialize(fingerprints(docs, id_col=id_col, text_col=text_col, words=words), "simhash-fingerprints")
    classes = materialize(marked.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")), "simhash-classes")
    # Components run over fingerprints; then each takes the smallest doc_id of its members.
    of = components(links(classes))
    named = classes.join(of.select(F.col("node").alias("fp"), "component"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    by_fp = materialize(named.join(least, "component").select("fp", "n", "component_id", "component"), "simhash-named")
    return join_hot(marked, by_fp, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "text_hash", "component")


def keep_first(docs: DataFrame, near: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """`docs` with one row (smallest doc_id, then text hash) of each component of `near` (doc_id, text_hash, component).

    Texts are shuffled once, by the key that finds the first rows and drops repeats of them. Repeats of a key that holds
    very many rows are dropped before that shuffle, in each task.
    """
    names = docs.columns
    marks = materialize(near.groupBy("doc_id", "text_hash").agg(F.min("component").alias("component"), F.count("*").alias("n")), "near-rows")
    first = marks.groupBy("component").agg(F.min(F.struct("doc_id", "text_hash")).alias("k"))
    first = first.select(F.coalesce("k.doc_id", F.lit(0)).alias("d_"), F.col("k.doc_id").isNull().alias("z_"), F.col("k.text_hash").alias("h_"))
    keyed = docs.toDF(*[f"c{i}_" for i in range(len(names))])
    doc_id = F.col(f"c{place(names, id_col)}_").cast("long")
    keyed = keyed.withColumns({"d_": F.coalesce(doc_id, F.lit(0)), "z_": doc_id.isNull(), "h_": F.xxhash64(f"c{place(names, text_col)}_")})
    key = ["d_", "z_", "h_"]
    kept = keyed.join(first, key, "left_semi").dropDuplicates(key)
    most = marks.agg(F.sum("n") / HOT_SHARE).first()[0] or 0
    hot = marks.where((F.col("n") > most) & (F.col("n") > 1)).select(F.coalesce("doc_id", F.lit(0)).alias("d_"), F.col("doc_id").isNull().alias("z_"), F.col("text_hash").alias("h_"))
    if not hot.isEmpty():  # HOT_SHARE keys at most
        hot = F.broadcast(materialize(hot, "hot-rows"))
        some = keyed.join(hot, key, "left_semi").dropDuplicates(key).join(first, key, "left_semi")
        kept = keyed.join(hot, key, "left_anti").join(first, key, "left_semi").dropDuplicates(key).unionAll(some)
    return kept.drop(*key).toDF(*names)


def deduplicate(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words: int = 3) -> DataFrame:
    """`docs` with one row of each component: that with the smallest doc_id (null is the smallest), then the smallest text hash."""
    return keep_first(docs, near_duplicates(docs, id_col=id_col, text_col=text_col, words=words), id_col, text_col)
