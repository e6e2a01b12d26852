"""Training of byte-pair merges, many merges a job: guess a row of merges, measure it over all words, keep what is proven.

A round proposes a row of merges. Every task does them, one after another, on its own words and reports how each changes the
pair counts; the sums over all tasks give each pair's count before each merge of the row. As long as every proposed merge is the
most frequent pair of its turn (the smallest by bytes of equal ones), it is the merge that counting anew would choose, so the
row holds up to its first mistake. The counts then give the right pair there, and a better guess of what follows. So each
round proves a merge at least, and usually most of its row.

No task sees more than its part of the words, and what the driver gets is bounded by `CANDIDATES`: the pairs with the highest
counts of the round, and how these change. Guesses never decide anything; they only say how long the proven row will be.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .pieces import Pair

#: Merges that a round proposes, and pairs that the driver follows.
ROW, CANDIDATES = 256, 2048
#: The most frequent words, on which the driver makes its first guess.
GUESS_WORDS = 20_000
#: Changes that a task adds up before it hands them on.
HELD = 1 << 20
#: Bytes of words that a task works on at once, a word at least.
PART_BYTES = 1 << 20

DELTA = pa.schema([("l", pa.binary()), ("r", pa.binary()), ("turn", pa.int32()), ("n", pa.int64())])


class Numbers(dict):
    """Tokens as numbers: bytes by themselves, others in the order in which they come up; equal tokens have one number."""

    def __init__(self):
        self.tokens = [bytes([b]) for b in range(256)]
        super().__init__(zip(self.tokens, range(256)))

    def __missing__(self, token: bytes) -> int:
        self[token] = len(self.tokens)
        self.tokens.append(token)
        return self[token]


class Words:
    """Words as one array of token numbers, -1 behind each word, with each token's weight: how often its word occurs.

    Tokens are a chain over the places where they began; a merged one leaves -2. Places are indexed by their pair, so that a merge
    touches its own occurrences, not the array.
    """

    def __init__(self, words: list[list[int]], times: list[int]):
        self._chain(np.array([t for w in words for t in (*w, -1)], np.int32), np.array([len(w) + 1 for w in words], np.int64), np.array(times, np.int64))

    @classmethod
    def of_bytes(cls, raw: np.ndarray, sizes: np.ndarray, times: np.ndarray) -> Words:
        """Words of `sizes` bytes each, one after another in `raw`."""
        own, token = cls.__new__(cls), np.full(len(raw) + len(sizes), -1, np.int32)
        token[np.arange(len(raw)) + np.repeat(np.arange(len(sizes)), sizes)] = raw
        own._chain(token, sizes + 1, times)
        return own

    def _chain(self, token: np.ndarray, sizes: np.ndarray, times: np.ndarray) -> None:
        self.token, self.weight = token, np.repeat(times, sizes)
        self.after = np.arange(1, len(token) + 1, dtype=np.int32)
        self.before = np.arange(-1, len(token) - 1, dtype=np.int32)
        self.after[-1:] = len(token) - 1  # the last is no token
        self.sorted: tuple[np.ndarray, np.ndarray] | None = None  # pairs as they were before the first merge, and their places
        self.added: dict[int, list[np.ndarray]] = {}  # places of pairs that merges made

    def _keys(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Keys of the pairs that begin at some places, and these places; -1 and -2 are no tokens."""
        left, right = self.token[at], self.token[self.after[at]]
        real = (at >= 0) & (left >= 0) & (right >= 0)
        return left[real].astype(np.int64) << 32 | right[real], at[real]

    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """All pairs and their counts."""
        key, at = self._keys(np.arange(len(self.token)))
        return added_up(key, self.weight[at])

    def _places(self, key: int) -> np.ndarray:
        if self.sorted is None:
            keys, at = self._keys(np.arange(len(self.token)))
            short = len(keys) and max(int(keys.max()) >> 32, int((keys & 0xFFFFFFFF).max())) < 256
            order = np.argsort((keys >> 24 | keys & 0xFF).astype(np.uint16) if short else keys, kind="stable")
            self.sorted = keys[order], at[order]
        keys, at = self.sorted
        return np.concatenate([at[np.searchsorted(keys, key) : np.searchsorted(keys, key, "right")], *self.added.pop(key, ())])

    def merge(self, left: int, right: int, new: int, counted: bool = True) -> tuple[np.ndarray, np.ndarray] | None:
        """Merge a pair from left to right, without overlap; the pairs whose counts change, and by how much, if that is `counted`."""
        at = self._places(left << 32 | right)
        at = once(at[(self.token[at] == left) & (self.token[self.after[at]] == right)])
        if left == right and len(at) > 1:  # in a run, every other one
            begins = np.flatnonzero(np.concatenate([[True], at[1:] != self.after[at[:-1]]]))
            at = at[(np.arange(len(at)) - np.repeat(begins, np.diff(begins, append=len(at)))) % 2 == 0]
        if not len(at):
            return (at, at) if counted else None
        gone = self.after[at]
        old, began = self._keys(once(np.concatenate([self.before[at], at, gone]))) if counted else (at, at)
        end = self.after[gone]
        self.token[at], self.token[gone] = new, -2
        self.after[at], self.before[end] = end, at
        key, begin = self._keys(once(np.concatenate([self.before[at], at])))
        order = np.argsort(key, kind="stable")
        first = np.flatnonzero(np.diff(key[order], prepend=-1))
        for k, places in zip(key[order][first].tolist(), np.split(begin[order], first[1:])):
            self.added.setdefault(k, []).append(places)
        return added_up(np.concatenate([old, key]), np.concatenate([-self.weight[began], self.weight[begin]])) if counted else None


def once(places: np.ndarray) -> np.ndarray:
    """Each place once, in order."""
    places = np.sort(places)
    return places[np.diff(places, prepend=-2) != 0]


def added_up(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each key once with the sum of its values; zeros are left out."""
    order = np.argsort(keys, kind="stable")
    keys, values = keys[order], values[order]
    first = np.flatnonzero(np.diff(keys, prepend=-1))
    sums = np.add.reduceat(values, first) if len(first) else values
    return keys[first][sums != 0], sums[sums != 0]


def measured(words: DataFrame, known: list[Pair], row: list[Pair]) -> DataFrame:
    """l, r, changes: for every pair of the words after the `known` merges, array<struct<turn, n>>: its count (turn -1), and how each
    merge of the row changes it. One shuffle; what it moves are pairs, not words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = Numbers()
        done, numbers = ([(number[l], number[r], number[l + r]) for l, r in some] for some in (known, row))
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        size = 0

        def handed() -> pa.RecordBatch:
            turn, key, n = (np.concatenate(x) for x in zip(*held))
            order = np.lexsort((key, turn))
            turn, key, n = turn[order], key[order], n[order]
            first = np.flatnonzero((np.diff(key, prepend=-1) != 0) | (np.diff(turn, prepend=-2) != 0))
            n = np.add.reduceat(n, first)
            key, turn = key[first], turn[first]
            tokens = pa.array(number.tokens, pa.binary())
            return pa.RecordBatch.from_arrays([tokens.take(pa.array(key >> 32)), tokens.take(pa.array(key & 0xFFFFFFFF)), pa.array(turn, pa.int32()), pa.array(n, pa.int64())], schema=DELTA)

        for part in _parts(batches):
            own = Words.of_bytes(*part)
            for m in done:
                own.merge(*m, counted=False)
            for turn, (key, n) in enumerate((own.pairs(), *(own.merge(*m) for m in numbers)), -1):
                held.append((np.full(len(key), turn, np.int32), key, n))
                size += len(key)
            if size > HELD:
                yield handed()
                held, size = [], 0
        if held:
            yield handed()

    deltas = words.select("word", "n").mapInArrow(run, "l binary, r binary, turn int, n long")
    each = deltas.repartition("l", "r").groupBy("l", "r", "turn").agg(F.sum("n").alias("n")).where("n <> 0")
    return each.groupBy("l", "r").agg(F.array_sort(F.collect_list(F.struct("turn", "n"))).alias("changes"))


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Bytes, sizes and counts of words, in parts of about PART_BYTES, a word at least; small batches are put together."""
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    size = 0
    for batch in batches:
        words = batch.column(0).cast(pa.large_binary())
        ends = np.frombuffer(words.buffers()[1], np.int64, len(words) + 1, 8 * words.offset) if len(words) else np.zeros(1, np.int64)
        raw, times = np.frombuffer(words.buffers()[2] or b"", np.uint8), batch.column(1).to_numpy(zero_copy_only=False)
        begin = 0
        while begin < len(words):
            end = max(begin + 1, int(np.searchsorted(ends, ends[begin] + max(0, PART_BYTES - size), "right")) - 1)
            held.append((raw[ends[begin] : ends[end]], np.diff(ends[begin : end + 1]), times[begin:end]))
            size += int(ends[end] - ends[begin])
            begin = end
            if size >= PART_BYTES or begin < len(words):
                yield tuple(np.concatenate(x) for x in zip(*held))
                held, size = [], 0
    if held:
        yield tuple(np.concatenate(x) for x in zip(*held))


def guessed(words: list[tuple[str, int]], known: list[Pair], most: int) -> list[Pair]:
    """The merges that some words alone would choose."""
    number, own = Numbers(), Words([list(w.encode()) for w, _ in words], [n for _, n in words])
    for left, right in known:
        own.merge(number[left], number[right], number[left + right], counted=False)
    count, row = Counter(dict(zip(*(x.tolist() for x in own.pairs())))), []
    while len(row) < most and count:
        highest = max(count.values())
        left, right = min((number.tokens[k >> 32], number.tokens[k & 0xFFFFFFFF]) for k, n in count.items() if n == highest)
        row.append((left, right))
        for key, n in zip(*(x.tolist() for x in own.merge(number[left], number[right], number[left + right]))):
            count[key] += n
            if count[key] <= 0:
                del count[key]
    return row


class Followed:
    """What a round measured of the pairs with the highest counts: enough to say which of its merges are right."""

    def __init__(self, rows: list, turns: int):
        """`rows`: l, r, highest, turns, changes, by highest count, then bytes; all pairs, or one more than CANDIDATES."""
        self.cut = (rows[-1].highest, (bytes(rows[-1].l), bytes(rows[-1].r))) if len(rows) > CANDIDATES else (0, (b"", b""))
        rows = sorted(rows[:CANDIDATES], key=lambda r: (bytes(r.l), bytes(r.r)))
        self.pairs = [(bytes(r.l), bytes(r.r)) for r in rows]
        self.count = np.zeros(len(rows), np.int64)  # before the merge whose turn it is
        self.change = np.zeros((turns, len(rows)), np.int64)
        for k, r in enumerate(rows):
            for turn, n in zip(r.turns, r.changes):
                if turn < 0:
                    self.count[k] = n
                else:
                    self.change[turn, k] = n

    def best(self) -> int | None:
        """The most frequent pair, the smallest of equal ones; None if none is left, or if one that isn't followed might be it."""
        if not len(self.count):
            return None
        k = int(np.argmax(self.count))
        n, pair = int(self.count[k]), self.pairs[k]
        highest, other = self.cut
        return k if n > max(highest, 0) or n == highest > 0 and pair < other else None

    def proven(self, row: list[Pair]) -> list[tuple[bytes, bytes, int]]:
        """The merges of the row up to the first mistake, and the right one in its place, with their counts."""
        found = []
        for turn, pair in enumerate([*row, None]):
            k = self.best()
            if k is None:
                break
            found.append((*self.pairs[k], int(self.count[k])))
            if self.pairs[k] != pair:
                at = {p: i for i, p in enumerate(row)}.get(self.pairs[k])
                self._take(k, at)
                break
            self._take(k, turn)
        return found

    def _take(self, k: int, turn: int | None) -> None:
        if turn is not None:
            self.count += self.change[turn]
            self.change[turn] = 0
        self.count[k] = min(self.count[k], 0)

    def next_row(self, row: list[Pair], most: int) -> list[Pair]:
        """A better guess, after proven(): merges change counts as they were measured to, if in another order."""
        turn, found = {p: i for i, p in enumerate(row)}, []
        while len(found) < most and len(self.count):
            k = int(np.argmax(self.count))
            if self.count[k] <= 0:
                break
            found.append(self.pairs[k])
            self._take(k, turn.get(self.pairs[k]))
        return found

    def exhausted(self) -> bool:
        return self.cut[0] == 0 and not (self.count > 0).any()


def train_merges(words: DataFrame, wanted: int) -> list[tuple[bytes, bytes, int]]:
    """(left, right, count) of the first `wanted` merges of a table of distinct words (word, n), which is read once a round."""
    found: list[tuple[bytes, bytes, int]] = []
    if wanted <= 0:
        return found
    frequent = [tuple(r) for r in words.where(F.length("word") <= 64).orderBy(F.desc("n"), "word").limit(GUESS_WORDS).select("word", "n").collect()]
    row = guessed(frequent, [], min(ROW, wanted))
    running = F.aggregate("changes", F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("top")), lambda a, x: F.struct((a["n"] + x["n"]).alias("n"), F.greatest(a["top"], a["n"] + x["n"]).alias("top")))["top"]
    while len(found) < wanted:
        known = [m[:2] for m in found]
        top = measured(words, known, row).withColumn("highest", running).orderBy(F.desc("highest"), "l", "r").limit(CANDIDATES + 1)
        followed = Followed(top.select("l", "r", "highest", "changes.turn", "changes.n").toDF("l", "r", "highest", "turns", "changes").collect(), len(row))
        proven = followed.proven(row)
        found += proven[: wanted - len(found)]
        if followed.exhausted():
            break
        left = min(ROW, wanted - len(found))
        if not proven:
            row = []  # too many equal counts to tell; without a row the first pair is certain
        elif len(proven) > len(row):
            row = guessed(frequent, [m[:2] for m in found], left)
        else:
            row = followed.next_row(row, left)
    return found
