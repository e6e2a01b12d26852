"""Benchmark decontamination by spaced-seed hashing.

A seed is a fixed mask over consecutive words; it hashes the words under its 1s and ignores those under its 0s. Equal hashes
of a document and a benchmark item put the two on one diagonal; the overlap around the hit is then verified word by word: the
item is found if some `least_words` words in a row (all of a shorter item) agree in at least `similarity` of the places. So
substituted words are tolerated wherever they fall. Words are lower-case runs of letters, digits and underscores.

Nothing is missed at the given 13 words and 0.8: wherever the substitutions that are tolerated fall in 8 to 13 words, one of MASKS
stands on words that agree, and one of SHORT_MASKS does so in 5 to 7 words; items of one to four words must stand in a
document unchanged, and are hashed whole. (Tests enumerate all of these; other settings may need other masks.)

Words that repeat make hits by the product of their places. Places with equal surroundings, as far as one of the masks and the
words needed reach, are verified alike, so only the first of them counts, in a document and in an item.

The benchmark is a stated query set. It is read in blocks of about `BLOCK_BYTES` of text; each block's hashes are a file in the
shared folder. All documents pass once, whatever the benchmark's size: their words are hashed once, and a task holds one block
(or two) beside them. Nothing of the documents is shuffled or collected.

Defined results: null or empty text has no words and no overlap; null ids are kept; each row of a repeated doc_id or item_id has
its own result, and equal results of equal (doc_id, text, item_id) are one row; where several places of a document overlap an
item, the row has the one with most equal words; an empty documents or benchmark table gives an empty table; further columns
are ignored (overlaps) or kept (decontaminate).
"""

from __future__ import annotations

import functools
import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch_of, kept_rows, new_dir, only, open_fs, own_columns, slices, temporary, write_atomically
from .words import forget, joined, mix, odd, word_hashes

MASKS = ("11111", "110111", "11010011", "1011100101", "110010100111")
SHORT_MASKS = ("111", "1101", "1011")  # for items of 5 to 7 words
WHOLE_MASKS = ("1", "11", "111", "1111")  # for items of 1 to 4 words
BLOCK_BYTES = 2 << 20
BITS = 22
GAP = max(map(len, MASKS))
BATCH_WORDS = 400_000
HITS_AT_ONCE = 1 << 20


def masks_of(words: int) -> tuple[str, ...]:
    """The masks that an item of so many words is looked for by."""
    return MASKS if words >= 8 else SHORT_MASKS if words >= 5 else WHOLE_MASKS[words - 1 : words]


def seed_keys(words: np.ndarray, shape: str) -> np.ndarray:
    """Hash of each window of the mask's span."""
    places = [i for i, c in enumerate(shape) if c == "1"]
    n = len(words) - len(shape) + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    mask = int(shape, 2)
    total = np.full(n, odd(1 << 20 | mask))
    for k, at in enumerate(places):
        total += words[at : at + n] * odd(16 * mask + k)
    return mix(total)


def surroundings(words: np.ndarray, at: np.ndarray, span: int, reach: int) -> np.ndarray:
    """A hash of the words around each place: those of the mask's span, and `reach` before and behind it."""
    padded = np.concatenate([np.zeros(reach, np.uint64), words, np.zeros(reach + span, np.uint64)])
    total = np.zeros(len(at), np.uint64)
    for k in range(2 * reach + span):
        total += padded[at + k] * odd(100_000 + k)
    return mix(total)


class Index:
    """Seed hashes of a block of items, by mask: those that differ in key, item or surroundings."""

    def __init__(self, items: list[tuple[int | None, str | None]], least_words: int = 13):
        kept = [(i, w) for i, w in ((i, word_hashes(t)) for i, t in items) if len(w)]
        self.ids = [i for i, _ in kept]
        self.words = [w for _, w in kept]
        self.reach = least_words - 1
        self.parts = {}
        for shape in sorted({*MASKS, *SHORT_MASKS, *WHOLE_MASKS}):
            numbers = np.array([i for i, w in enumerate(self.words) if shape in masks_of(len(w))], np.int64)
            if len(numbers):
                self.parts[shape] = self._entries(numbers, shape)

    def _entries(self, numbers: np.ndarray, shape: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Key, item and place of a mask's windows in some items, by key; all items at once, side by side and too far apart to meet."""
        flat, begins = joined([self.words[i] for i in numbers], self.reach + len(shape))
        key = seed_keys(flat, shape)
        place = np.arange(len(key))
        item = np.searchsorted(begins, place, "right") - 1
        at = place - begins[item]
        inside = at + len(shape) <= np.array([len(self.words[i]) for i in numbers])[item]
        key, item, at = key[inside], item[inside], at[inside]
        around = surroundings(flat, place[inside], len(shape), self.reach)
        order = np.lexsort((at, around, item, key))
        same = (np.diff(key[order]) == 0) & (np.diff(item[order]) == 0) & (np.diff(around[order]) == 0)
        kept = order[np.concatenate([[True], ~same])] if len(order) else order
        kept = kept[np.lexsort((at[kept], item[kept], key[kept]))]
        return key[kept], numbers[item[kept]].astype(np.int32), at[kept].astype(np.int32)

    def filters(self) -> dict[str, np.ndarray]:
        """For each mask, which low bits of a hash occur: most windows end here."""
        out = {}
        for shape, (key, _, _) in self.parts.items():
            out[shape] = np.zeros(1 << BITS, bool)
            out[shape][(key & np.uint64((1 << BITS) - 1)).astype(np.int64)] = True
        return out


def hits(words: np.ndarray, begins: np.ndarray, index: Index, filters: dict[str, np.ndarray]) -> set[tuple[int, int]]:
    """(item, diagonal): place in `words`, where a document begins at each of `begins`, less place in the item."""
    found: set[tuple[int, int]] = set()
    low = np.uint64((1 << BITS) - 1)
    for shape, (key, item, at) in index.parts.items():
        own = seed_keys(words, shape)
        maybe = np.flatnonzero(filters[shape][(own & low).astype(np.int64)]) if len(own) else np.empty(0, np.int64)
        first = np.searchsorted(key, own[maybe], "left")
        counts = np.searchsorted(key, own[maybe], "right") - first
        maybe, first, counts = maybe[counts > 0], first[counts > 0], counts[counts > 0]
        if not len(maybe):
            continue
        doc = np.searchsorted(begins, maybe, "right").astype(np.uint64)
        around = mix(surroundings(words, maybe, len(shape), index.reach) + doc * odd(99_999))
        once = np.sort(np.unique(around, return_index=True)[1])
        maybe, first, counts = maybe[once], first[once], counts[once]
        ends = np.cumsum(counts)
        begin = 0
        while begin < len(maybe):  # so many places that their hits fit into memory
            end = max(begin + 1, int(np.searchsorted(ends, ends[begin] - counts[begin] + HITS_AT_ONCE, "right")))
            n = counts[begin:end]
            of = np.repeat(first[begin:end] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
            pairs = np.unique(np.stack([item[of].astype(np.int64), np.repeat(maybe[begin:end], n) - at[of]]), axis=1)
            found.update(zip(pairs[0].tolist(), pairs[1].tolist()))
            begin = end
    return found


def verify(words: np.ndarray, item: np.ndarray, diagonal: int, least_words: int, similarity: float) -> tuple[int, int, int] | None:
    """(first word of the item, words, equal words) of the overlap on a diagonal, or None if it is too short or unlike."""
    begin, end = max(0, -diagonal), min(len(item), len(words) - diagonal)
    need = min(least_words, len(item))
    if end - begin < need:
        return None
    same = words[diagonal + begin : diagonal + end] == item[begin:end]
    sums = np.concatenate([[0], np.cumsum(same)])
    good = np.flatnonzero(sums[need:] - sums[:-need] >= similarity * need - 1e-9)
    if not len(good):
        return None
    first, last = int(good[0]), int(good[-1]) + need
    return begin + first, last - first, int(sums[last] - sums[first])


FOUND = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64()), ("item_id", pa.int64()), ("doc_word", pa.int64()), ("item_word", pa.int64()), ("n_words", pa.int64()), ("n_equal", pa.int64())])
FOUND_DDL = "doc_id long, text_hash long, item_id long, doc_word long, item_word long, n_words long, n_equal long"


class Searcher:
    """Finds the overlaps of documents' words with the items of an index."""

    def __init__(self, index: Index, least_words: int, similarity: float):
        self.index, self.filters, self.least_words, self.similarity = index, index.filters(), least_words, similarity

    def __call__(self, docs: list[np.ndarray]) -> dict[tuple[int, int], tuple]:
        """(document, item) to (equal words, words, first in the document, first in the item) of the best overlap."""
        words, begins = joined(docs, GAP)
        best: dict[tuple[int, int], tuple] = {}
        for item, diagonal in sorted(hits(words, begins, self.index, self.filters)):
            own = self.index.words[item]
            # The hit's middle may lie before or after the item's own place only if the item is cut at the document's edge.
            for d in range(max(0, int(np.searchsorted(begins, diagonal, "right")) - 1), len(docs)):
                if begins[d] >= diagonal + len(own):
                    break
                got = verify(docs[d], own, diagonal - int(begins[d]), self.least_words, self.similarity)
                if got:
                    best[d, item] = max(best.get((d, item), (0,)), (got[2], got[1], diagonal - int(begins[d]) + got[0], got[0]))
        return best


def _forget() -> None:
    _searcher.cache_clear()
    forget()


def _gathered(groups: Iterator[list[np.ndarray]], most: int = 4_000_000) -> Iterator[list[list[np.ndarray]]]:
    """Groups together, of some `most` words: each block of the benchmark is read once for all of them."""
    held, size = [], 0
    for group in groups:
        held.append(group)
        size += sum(map(len, group))
        if size >= most:
            yield held
            held, size = [], 0
    if held:
        yield held


def _grouped(texts: pa.Array) -> Iterator[list[np.ndarray]]:
    """The words of the texts, some BATCH_WORDS at once."""
    held, size = [], 0
    for text in texts:
        held.append(word_hashes(text.as_py()))
        size += len(held[-1])
        if size >= BATCH_WORDS:
            yield held
            held, size = [], 0
    if held:
        yield held


@functools.lru_cache(maxsize=2)
def _searcher(uri: str, least_words: int, similarity: float) -> Searcher:
    filesystem, path = open_fs(uri)
    with filesystem.open_input_stream(path, compression=None) as stream:
        return Searcher(pickle.loads(stream.read()), least_words, similarity)


def _blocks(benchmark: DataFrame, least_words: int) -> list[str]:
    """Files of the hashes of the benchmark's rows, some BLOCK_BYTES of text in each."""
    items = own_columns(benchmark, item_id="item_id", text="text").selectExpr("CAST(CAST(item_id AS BIGINT) AS STRING) item_id", "text").where("text IS NOT NULL")
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-total // BLOCK_BYTES))
    out_dir = temporary(benchmark.sparkSession, new_dir(benchmark.sparkSession, "decontam"))

    def write(own: pd.DataFrame) -> pd.DataFrame:
        items = [(None if i is None else int(i), t) for i, t in zip(own["item_id"], own["text"])]  # ids came as text: exact beside nulls
        items.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
        uri = f"{out_dir}/block-{int(own['block'].iloc[0]):08d}"
        made = pickle.dumps(Index(items, least_words))
        write_atomically(uri, lambda stream: stream.write(made))
        return pd.DataFrame({"uri": [uri]})

    dealt = items.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)).cast("int"))
    return sorted(r.uri for r in dealt.groupBy("block").applyInPandas(write, "uri string").collect())  # a name a block


def overlaps(docs: DataFrame, benchmark: DataFrame, *, least_words: int = 13, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each document and item that overlap: doc_id, text_hash, item_id, doc_word and item_word (where the overlap
    begins), n_words, n_equal."""
    own = own_columns(docs, doc_id=id_col, text=text_col).selectExpr("CAST(doc_id AS BIGINT) doc_id", "xxhash64(text) text_hash", "text")
    blocks = _blocks(benchmark, least_words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only("decontam", _forget)
        for part in (p for batch in batches for p in slices(batch, 2, rows=1 << 16, size=32 << 20)):
            done, ids, hashes = 0, part.column(0).to_pylist(), part.column(1).to_pylist()
            for groups in _gathered(_grouped(part.column(2))):
                for uri in blocks:
                    find, at = _searcher(uri, least_words, similarity), done
                    for docs in groups:
                        rows = [(ids[at + d], hashes[at + d], find.index.ids[i], b[2], b[3], b[1], b[0]) for (d, i), b in sorted(find(docs).items())]
                        if rows:
                            yield batch_of(dict(zip(FOUND.names, map(list, zip(*rows)))), FOUND)
                        at += len(docs)
                done += sum(map(len, groups))

    return own.mapInArrow(run, FOUND_DDL).distinct()


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, least_words: int = 13, similarity: float = 0.8, text_col: str = "text") -> DataFrame:
    """`docs` without the rows whose text overlaps a benchmark item."""
    blocks = _blocks(benchmark, least_words)

    def judge():
        only("decontam", _forget)

        def keep(texts: pa.Array) -> list[bool]:
            out: list[bool] = []
            for groups in _gathered(_grouped(texts)):
                bad: list[set[int]] = [set() for _ in groups]
                for uri in blocks:
                    find = _searcher(uri, least_words, similarity)
                    for known, docs in zip(bad, groups):
                        known |= {d for d, _ in find(docs)}
                out += [d not in known for known, docs in zip(bad, groups) for d in range(len(docs))]
            return out

        return keep

    return kept_rows(docs, text_col, judge)
