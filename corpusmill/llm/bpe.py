"""Byte-level BPE encoding and decoding with a hierarchical-bitmap rank queue.

Ranks come from a public rank file (one `base64(token) rank` a line); nothing is trained here. Each match of the
pre-tokenizer pattern is merged on its own. Live pairs wait in buckets, one a rank, that hold positions in a linked
list of tokens; a hierarchical bitmap over the ranks gives the next non-empty bucket by find-first-set. A merge does not
search for the entries it outdates: an entry whose rank is not the live rank of its position is skipped when it
comes up. A pre-token of n bytes costs O(n log n), however long it is.

Defined results: null text is the empty text, which has no ids; null or repeated doc_id are kept as they come, one
row for each input row; an empty table gives an empty table; further input columns are ignored.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import itertools
import struct
from array import array
from collections.abc import Iterable, Iterator
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import batch_of, only, own_columns, slices

#: Longest pre-token (bytes) and most pre-tokens whose ids a worker remembers; memory stays near 250 bytes times the latter.
REMEMBERED_BYTES, REMEMBERED = 48, 660_000
LONG_TEXT = 1 << 20  # characters of a text, or ids, that are worked on at once


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


class RankQueue:
    """Positions by rank, smallest rank first and leftmost first within it.

    Two levels of bits: `low` has a word for each 64 ranks, `top` a bit for each word that isn't zero.
    """

    def __init__(self, ranks: int):
        words = (ranks + 63) // 64
        self.low, self.top = [0] * words, 0
        self.bit = [1 << i for i in range(max(64, words))]
        self.buckets: dict[int, list[int]] = {}

    def push(self, rank: int, position: int) -> None:
        bucket = self.buckets.get(rank)
        if bucket is not None:
            heappush(bucket, position)
            return
        self.buckets[rank] = [position]
        word = rank >> 6
        self.low[word] |= self.bit[rank & 63]
        self.top |= self.bit[word]

    def fill(self, ranks: list[int]) -> None:
        """Push position p by ranks[p], for all that aren't negative, into an empty queue."""
        buckets, low, bit, top = self.buckets, self.low, self.bit, 0
        for position, rank in enumerate(ranks):
            if rank >= 0:
                if rank in buckets:
                    buckets[rank].append(position)
                else:
                    buckets[rank] = [position]
                    word = rank >> 6
                    low[word] |= bit[rank & 63]
                    top |= bit[word]
        self.top = top

    def first(self) -> int:
        """The smallest rank with a bucket, by find-first-set on both levels; -1 if there is none."""
        top = self.top
        if not top:
            return -1
        word = (top & -top).bit_length() - 1
        bits = self.low[word]
        return (word << 6) + (bits & -bits).bit_length() - 1

    def drop(self, rank: int) -> None:
        """Forget an emptied bucket."""
        del self.buckets[rank]
        word = rank >> 6
        bits = self.low[word] ^ self.bit[rank & 63]
        self.low[word] = bits
        if not bits:
            self.top ^= self.bit[word]


class Codec:
    """Encodes texts to ids and ids to bytes by one rank table and one pre-tokenizer pattern."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        missing = [b for b in range(256) if bytes([b]) not in ranks]
        if missing:
            raise ValueError(f"the rank table lacks the single bytes {missing[:5]}")
        self.ranks = ranks
        self.longest = max(map(len, ranks))
        self.queue = RankQueue(max(ranks.values()) + 1)
        self.pattern = regex.compile(pattern)
        self.find = self.pattern.findall
        self.tokens = {rank: token for token, rank in ranks.items()}
        self.packed = _Packed(self)
        self.spelled = pa.array([self.tokens.get(i, b"") for i in range(max(ranks.values()) + 1)], pa.large_binary())

    def merge(self, piece: bytes) -> list[int]:
        """Ids of one pre-token."""
        ranks, longest, queue = self.ranks, self.longest, self.queue
        whole = ranks.get(piece)
        if whole is not None:
            return [whole]
        n = len(piece)
        after, before = list(range(1, n + 1)), list(range(-1, n))
        get = ranks.get
        live = [get(piece[p : p + 2], -1) for p in range(n - 1)]  # rank of the pair that starts here
        live.append(-1)
        queue.fill(live)
        # first(), drop() and push() of the queue, written out: this loop is most of the encoding's time.
        buckets, low, bit, top, heads = queue.buckets, queue.low, queue.bit, queue.top, n
        while top:
            word = (top & -top).bit_length() - 1
            bits = low[word]
            one = bits & -bits
            rank = (word << 6) + one.bit_length() - 1
            bucket = buckets[rank]
            if len(bucket) == 1:
                p = bucket[0]
                del buckets[rank]
                low[word] = bits = bits ^ one
                if not bits:
                    top ^= bit[word]
            else:
                p = heappop(bucket)
            if live[p] != rank:
                continue
            gone = after[p]
            after[p] = end = after[gone]
            live[gone] = live[p] = -1
            heads -= 1
            made = []
            if end < n:
                before[end] = p
                far = after[end]
                if far - p <= longest:
                    new = get(piece[p:far])
                    if new is not None:
                        live[p] = new
                        made.append((new, p))
            left = before[p]
            if left >= 0:
                live[left] = -1
                if end - left <= longest:
                    new = get(piece[left:end])
                    if new is not None:
                        live[left] = new
                        made.append((new, left))
            for new, at in made:
                bucket = buckets.get(new)
                if bucket is not None:
                    heappush(bucket, at)
                else:
                    buckets[new] = [at]
                    word = new >> 6
                    low[word] |= bit[new & 63]
                    top |= bit[word]
        queue.top = 0
        ids, p = [], 0
        for _ in range(heads):
            ids.append(ranks[piece[p : after[p]]])
            p = after[p]
        return ids

    def encode_packed(self, text: str) -> bytes:
        """Ids of a text as little-endian unsigned 32-bit integers; a long text's pre-tokens are not held all at once."""
        if len(text) <= LONG_TEXT:
            return b"".join(map(self.packed.__getitem__, self.find(text)))
        pieces = (m.group() for m in self.pattern.finditer(text))
        return b"".join(b"".join(map(self.packed.__getitem__, some)) for some in itertools.batched(pieces, 100_000))

    def encode(self, text: str) -> list[int]:
        return unpack(self.encode_packed(text))

    def digests(self, packed: bytes) -> tuple[str, str]:
        """SHA-256 of packed ids and of the bytes that they stand for."""
        decoded = hashlib.sha256()
        for at in range(0, len(packed), 4 * LONG_TEXT):
            tokens = self.spelled.take(pa.array(np.frombuffer(packed, "<u4", min(LONG_TEXT, len(packed) // 4 - at // 4), at)))
            decoded.update(tokens.buffers()[2] or b"")
        return hashlib.sha256(packed).hexdigest(), decoded.hexdigest()

    def decode(self, ids: Iterable[int]) -> bytes:
        """Bytes of the ids; an unknown id raises KeyError."""
        return b"".join(map(self.tokens.__getitem__, ids))


class _Packed(dict):
    """Pre-token to packed ids; the short ones are remembered in two generations of half the bound each: the older is forgotten at
    once when the younger is full, but for what came up again since."""

    def __init__(self, codec: Codec):
        super().__init__()
        self.codec, self.older = codec, {}

    def __missing__(self, piece: str) -> bytes:
        packed = self.older.get(piece)
        if packed is None:
            raw = piece.encode()
            ids = self.codec.merge(raw)
            packed = struct.pack(f"<{len(ids)}I", *ids)
            if len(raw) > REMEMBERED_BYTES:
                return packed
        if len(self) >= REMEMBERED // 2:
            self.older = dict(self)
            self.clear()
        self[piece] = packed
        return packed


def unpack(packed: bytes) -> list[int]:
    ids = array("I")
    ids.frombytes(packed)
    if struct.pack("=I", 1) != struct.pack("<I", 1):
        ids.byteswap()
    return ids.tolist()


@functools.lru_cache(maxsize=2)
def codec(path: str, pattern: str) -> Codec:
    """One codec a process, table and pattern. The vocabulary is an installed package's file on every node."""
    return Codec(load_ranks(path), pattern)


ENCODED = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])


def encode_documents(docs: DataFrame, path: str, pattern: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids (binary: little-endian unsigned 32-bit integers), one row for each row of `docs`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only("bpe", codec.cache_clear)
        own = codec(path, pattern)
        for batch in batches:
            for part in slices(batch, 1):
                ids = [own.encode_packed(t.as_py() or "") for t in part.column(1)]
                yield batch_of({"doc_id": part.column(0), "n_tokens": [len(x) // 4 for x in ids], "ids": ids}, ENCODED)

    return own_columns(docs, doc_id=id_col, text=text_col).selectExpr("CAST(doc_id AS BIGINT) doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids binary")


def decode_documents(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, text: what the ids of `encode_documents` stand for; bytes that aren't UTF-8 become U+FFFD."""
    schema = pa.schema([("doc_id", pa.int64()), ("text", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only("bpe", codec.cache_clear)
        own = codec(path, pattern)
        for batch in batches:
            texts = [own.decode(unpack(x.as_py() or b"")).decode("utf-8", "replace") for x in batch.column(1)]
            yield batch_of({"doc_id": batch.column(0), "text": texts}, schema)

    return own_columns(encoded, doc_id="doc_id", ids="ids").mapInArrow(run, "doc_id long, text string")


DIGEST = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])


def digest_documents(docs: DataFrame, path: str, pattern: str, *, keep_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode and decode in one pass over `docs`: doc_id, n_tokens, ids_sha256, decoded_sha256; keep_ids: and the packed ids."""
    schema = DIGEST.append(pa.field("ids", pa.binary())) if keep_ids else DIGEST

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only("bpe", codec.cache_clear)
        own = codec(path, pattern)
        for part in (p for batch in batches for p in slices(batch, 1)):
            out: dict[str, list] = {name: [] for name in schema.names}
            out["doc_id"] = part.column(0)
            for t in part.column(1):
                packed = own.encode_packed(t.as_py() or "")
                of_ids, of_bytes = own.digests(packed)
                out["n_tokens"].append(len(packed) // 4)
                out["ids_sha256"].append(of_ids)
                out["decoded_sha256"].append(of_bytes)
                if keep_ids:
                    out["ids"].append(packed)
            yield batch_of(out, schema)

    ddl = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids binary" * keep_ids
    return own_columns(docs, doc_id=id_col, text=text_col).selectExpr("CAST(doc_id AS BIGINT) doc_id", "text").mapInArrow(run, ddl)
