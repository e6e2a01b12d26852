"""Fill-in-the-middle: texts cut into prefix, middle and suffix at unit boundaries, found by a byte automaton.

A unit is a run of ASCII letters or one other code point. The automaton reads UTF-8 bytes through one table, NEXT[state, byte];
a second, EMIT[state, byte], says what the step counts: a unit begins, a code point begins, a sentinel ends. Its state depends
on the last two bytes alone, so texts are laid out in lanes of LANE bytes, each begun in the state that the two bytes before it
give, and one scan takes all lanes of a batch a byte further at a time. Its counts tell the lane of each cut; a second pass reads
those lanes again and finds the byte.

Defined results: null text is the empty text, which is plain; null doc_id is hashed as an empty string; every row of a repeated
doc_id has its own result; further columns are ignored; an empty table gives an empty result. Bytes that are no UTF-8 belong to
the code point before them, if they look like continuation bytes, and else are code points of their own.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import batch_of, own_columns, slices

PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
LANE = 256  # two at least

# States: the last byte was no letter; a letter; `<`; the letter of a sentinel behind `<`.
REST, LETTER, OPEN, NAMED = range(4)
#: A byte that counts nothing; fills lanes up. (A continuation byte.)
FILL = 0x80
#: What EMIT counts, each in bits of its own.
UNIT, CHAR, SENTINEL = 1, 1 << 20, 1 << 40


def _tables() -> tuple[np.ndarray, np.ndarray]:
    after, emit = np.zeros((4, 256), np.uint16), np.zeros((4, 256), np.int64)
    for state in range(4):
        for byte in range(256):
            letter, continued = chr(byte).isascii() and chr(byte).isalpha(), 0x80 <= byte < 0xC0
            if byte == ord("<"):
                after[state, byte] = OPEN
            elif letter:
                after[state, byte] = NAMED if state == OPEN and byte in b"PSM" else LETTER
            begins = not continued and not (letter and state in (LETTER, NAMED))
            emit[state, byte] = UNIT * begins + CHAR * (not continued) + SENTINEL * (state == NAMED and byte == ord(">"))
    return after.reshape(-1) << 8, emit.reshape(-1)


#: NEXT gives the state in the upper byte, so that state | byte is the place in both tables.
NEXT, EMIT = _tables()


@dataclass
class Lanes:
    """Texts as lanes: `rows` has a row for each place in a lane and a column for each lane; `first` is each text's first lane."""

    rows: np.ndarray
    state: np.ndarray
    first: np.ndarray

    @classmethod
    def of(cls, texts: list[bytes]) -> Lanes:
        first = np.concatenate([[0], np.cumsum([-(-len(t) // LANE) for t in texts])]).astype(np.int64)
        flat = np.full(int(first[-1]) * LANE, FILL, np.uint8)
        for t, at in zip(texts, (first[:-1] * LANE).tolist()):
            flat[at : at + len(t)] = np.frombuffer(t, np.uint8)
        lanes = flat.reshape(-1, LANE)
        before = np.full((len(lanes), 2), FILL, np.uint8)
        before[1:] = lanes[:-1, -2:]
        before[first[:-1][first[:-1] < first[1:]]] = FILL  # nothing is before a text
        return cls(np.ascontiguousarray(lanes.T), NEXT[NEXT[before[:, 0]] | before[:, 1]], first)

    def count(self) -> np.ndarray:
        """What each lane counts, in one scan."""
        state, total = self.state, np.zeros(len(self.state), np.int64)
        for byte in self.rows:
            step = state | byte
            total += EMIT[step]
            state = NEXT[step]
        return total

    def find(self, lanes: np.ndarray, units: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each of the lanes: the byte at which its unit number `units` (from 0) begins, and how many code points are before."""
        state, seen = self.state[lanes], np.zeros(len(lanes), np.int64)
        at, chars = np.zeros(len(lanes), np.int64), np.zeros(len(lanes), np.int64)
        for place, byte in enumerate(self.rows[:, lanes]):
            step = state | byte
            emitted = EMIT[step]
            here = (emitted & UNIT == UNIT) & (seen & (CHAR - 1) == units)
            at[here], chars[here] = place, (seen[here] >> 20) & (CHAR - 1)
            seen += emitted
            state = NEXT[step]
        return at, chars


def numbers(doc_id: int | None, seed: int) -> tuple[int, int, int, int]:
    """The draws of a document: the first four 32-bit numbers of the SHA-256 of `seed:doc_id`."""
    return struct.unpack(">4I", hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()[:16])


@dataclass
class Cut:
    units: int
    form: str = "plain"
    begin: int = 0  # bytes
    end: int = 0
    prefix_chars: int | None = None
    middle_chars: int | None = None

    def applied(self, text: bytes) -> bytes:
        if self.form == "plain":
            return text
        prefix, middle, suffix = text[: self.begin], text[self.begin : self.end], text[self.end :]
        return b"".join((PREFIX, prefix, SUFFIX, suffix, MIDDLE, middle) if self.form == "psm" else (SUFFIX, suffix, PREFIX, prefix, MIDDLE, middle))


def cuts(doc_ids: list[int | None], texts: list[bytes], seed: int = 1, plain: int = 10, spm: int = 20) -> list[Cut]:
    """How each text is cut: plain ones in `plain` of 100 documents and wherever a sentinel or nothing is in the text."""
    lanes = Lanes.of(texts)
    counted = lanes.count()
    upto = np.concatenate([[0], np.cumsum(counted & (CHAR - 1))])  # units before each lane, of all texts
    chars = np.concatenate([[0], np.cumsum((counted >> 20) & (CHAR - 1))])
    sentinels = np.concatenate([[0], np.cumsum(counted >> 40)])
    first, last = lanes.first[:-1], lanes.first[1:]
    total = upto[last] - upto[first]
    marked = sentinels[last] > sentinels[first]
    found, wanted = [], []
    for i, (doc_id, n) in enumerate(zip(doc_ids, total.tolist())):
        h1, h2, h3, h4 = numbers(doc_id, seed)
        cut = Cut(n)
        if n and not marked[i] and h3 % 100 < 100 - plain:
            cut.form = "spm" if h4 % 100 < spm else "psm"
            wanted += [(i, *sorted((h1 % (n + 1), h2 % (n + 1))))]
        found.append(cut)
    if wanted:
        docs, *ends = np.array(wanted, np.int64).T
        places = []
        for units in ends:
            number = upto[first[docs]] + units  # of all texts' units
            inside = units < total[docs]
            lane = np.searchsorted(upto, number[inside], "right") - 1
            at, before = lanes.find(lane, number[inside] - upto[lane])
            byte, char = np.array([len(texts[i]) for i in docs], np.int64), chars[last[docs]] - chars[first[docs]]
            byte[inside] = (lane - first[docs[inside]]) * LANE + at
            char[inside] = chars[lane] - chars[first[docs[inside]]] + before
            places += [byte, char]
        for i, begin, prefix, end, upto_end in zip(docs.tolist(), *(p.tolist() for p in places)):
            cut = found[i]
            cut.begin, cut.end, cut.prefix_chars, cut.middle_chars = begin, end, prefix, upto_end - prefix
    return found


OUT = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64()), ("output", pa.binary())])


def fill_in_middle(docs: DataFrame, *, seed: int = 1, plain: int = 10, spm: int = 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n (units), form (plain, psm or spm), prefix_chars, middle_chars, output (the text with its parts in the form's order).

    One pass over the documents, nothing is shuffled.
    """
    own = own_columns(docs, doc_id=id_col, text=text_col).selectExpr("CAST(doc_id AS BIGINT) doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1):
                ids = part.column(0).to_pylist()
                texts = [t or b"" for t in part.column(1).cast(pa.binary()).to_pylist()]
                found = cuts(ids, texts, seed, plain, spm)
                columns = {"doc_id": ids, "n": [c.units for c in found], "form": [c.form for c in found], "prefix_chars": [c.prefix_chars for c in found], "middle_chars": [c.middle_chars for c in found]}
                yield batch_of(columns | {"output": [c.applied(t) for c, t in zip(found, texts)]}, OUT)

    made = own.mapInArrow(run, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output binary")
    return made.withColumn("output", F.col("output").cast("string"))


def restored(output: Column, form: Column) -> Column:
    """The text of an output of fill_in_middle(): parts hold no sentinel, so the first of each kind is the one that was set."""
    psm = F.regexp_replace(output, r"(?s)\A<P>(.*?)<S>(.*?)<M>(.*)\z", "$1$3$2")
    spm = F.regexp_replace(output, r"(?s)\A<S>(.*?)<P>(.*?)<M>(.*)\z", "$2$3$1")
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)
