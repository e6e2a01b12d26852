"""Token ids as binary files: independent zstandard frames, a trailing seek table, a checksum for each frame.

File layout (the public zstd seekable format, so `zstd -d` gives the plain id stream):
  * data frames: each holds the ids of whole documents, unsigned little-endian, 16 or 32 bits; a frame is closed once it
    holds `frame_bytes`; each is an independent frame with its own content checksum;
  * one skippable frame with the document index (zstd inside): doc_id, null flag, tokens, frame of each document;
  * the seek table, a skippable frame: compressed size, decompressed size, low 32 bits of XXH64 of each frame; its footer
    is last, so a reader seeks to the end, then to the index, then only to the frames of the documents asked for.
A set of files in shard order, with each shard's first position, is the corpus as one id stream in ascending doc_id order.

Defined results: null text is the empty text (the end id alone); null doc_id comes first; repeated doc_id keep one entry
for each row, in a file ordered by their ids (rows of one doc_id, or of none, may fill several files); strings of added tokens,
such as <|endoftext|>, are what the library makes of them; an empty table makes no file and an empty result; further columns
are ignored.
"""

from __future__ import annotations

import bisect
import functools
import re
import struct
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import batch_of, materialize, new_dir, only, open_fs, own_columns, partitions, slices, temporary, write_atomically

# Fixed values of the zstd seekable format.
SKIPPABLE_INDEX = 0x184D2A50
SKIPPABLE_SEEK_TABLE = 0x184D2A5E
SEEKABLE_FOOTER = 0x8F92EAB1
CHECKSUM_FLAG = 0x80

#: Words whose ids a worker remembers (some 200 bytes each), and the longest of them in characters.
REMEMBERED, REMEMBERED_CHARS = 1_800_000, 40
#: Characters of a text that are cut into words at once, and of all texts together.
PIECE_CHARS, PIECES_CHARS = 1 << 18, 1 << 21


class CorruptFrame(ValueError):
    """A frame's bytes don't match its checksum."""


class TokenFileWriter:
    """Writes documents to a binary stream; close() adds index and seek table."""

    def __init__(self, stream, *, id_bytes: int = 4, frame_bytes: int = 1 << 17, level: int = 3):
        self.stream, self.dtype, self.frame_bytes = stream, np.dtype(f"<u{id_bytes}"), frame_bytes
        self.compress = zstandard.ZstdCompressor(level=level, write_checksum=True).compress
        self.waiting: list[bytes] = []
        self.held = 0
        self.frames: list[tuple[int, int, int]] = []
        self.docs: list[tuple[int, bool, int, int]] = []

    def add(self, doc_id: int | None, ids: bytes) -> None:
        """`ids` are already packed in the file's width."""
        self.docs.append((doc_id or 0, doc_id is None, len(ids) // self.dtype.itemsize, len(self.frames)))
        self.waiting.append(ids)
        self.held += len(ids)
        if self.held >= self.frame_bytes:
            self._flush()

    def _flush(self) -> None:
        plain = b"".join(self.waiting)
        packed = self.compress(plain)
        self.stream.write(packed)
        self.frames.append((len(packed), len(plain), xxhash.xxh64_intdigest(plain) & 0xFFFFFFFF))
        self.waiting, self.held = [], 0

    def close(self) -> None:
        if self.waiting:
            self._flush()
        index = np.array([(d, z, n, f) for d, z, n, f in self.docs], dtype=[("d", "<i8"), ("z", "<i8"), ("n", "<i8"), ("f", "<i8")])
        columns = np.array([self.dtype.itemsize], "<i8").tobytes() + b"".join(np.ascontiguousarray(index[k]).tobytes() for k in "dznf")
        body = self.compress(columns)
        self.stream.write(struct.pack("<II", SKIPPABLE_INDEX, len(body)) + body)
        self.frames.append((len(body) + 8, 0, xxhash.xxh64_intdigest(b"") & 0xFFFFFFFF))
        table = b"".join(struct.pack("<III", *x) for x in self.frames)
        self.stream.write(struct.pack("<II", SKIPPABLE_SEEK_TABLE, len(table) + 9) + table + struct.pack("<IBI", len(self.frames), CHECKSUM_FLAG, SEEKABLE_FOOTER))


class TokenFileReader:
    """Reads single documents of a file; only their frame is fetched and decompressed, and its checksum is verified."""

    def __init__(self, stream):
        self.stream = stream
        end = stream.seek(0, 2)
        footer = self._read(end - 9, 9)
        n, flags, magic = struct.unpack("<IBI", footer)
        if magic != SEEKABLE_FOOTER or not flags & CHECKSUM_FLAG:
            raise CorruptFrame("no seek table with checksums at the end of the file")
        raw = self._read(end - 9 - 12 * n, 12 * n)
        self.frames = [struct.unpack_from("<III", raw, 12 * i) for i in range(n)]
        self.offsets = np.concatenate([[0], np.cumsum([f[0] for f in self.frames])]).tolist()
        at, size = self.offsets[n - 1], self.frames[-1][0]
        body = self._read(at, size)
        if struct.unpack_from("<I", body)[0] != SKIPPABLE_INDEX:
            raise CorruptFrame("no document index before the seek table")
        plain = np.frombuffer(zstandard.ZstdDecompressor().decompress(body[8:]), "<i8")
        self.dtype = np.dtype(f"<u{plain[0]}")
        docs = (len(plain) - 1) // 4
        self.doc_ids, self.nulls, self.counts, self.frame_of = (plain[1 + k * docs : 1 + (k + 1) * docs] for k in range(4))
        self.starts = np.concatenate([[0], np.cumsum(self.counts)])
        self.first = np.searchsorted(self.frame_of, np.arange(n))  # first document of each frame
        self.at, self.plain = -1, b""
        self.wide_at, self.wide_ids = -1, memoryview(b"")

    def _read(self, at: int, size: int) -> bytes:
        self.stream.seek(at)
        return self.stream.read(size)

    def __len__(self) -> int:
        return len(self.doc_ids)

    def frame(self, k: int) -> bytes:
        if k != self.at:
            size, plain_size, checksum = self.frames[k]
            plain = zstandard.ZstdDecompressor().decompress(self._read(self.offsets[k], size), max_output_size=plain_size)
            if len(plain) != plain_size or xxhash.xxh64_intdigest(plain) & 0xFFFFFFFF != checksum:
                raise CorruptFrame(f"frame {k} doesn't match its checksum")
            self.at, self.plain = k, plain
        return self.plain

    def ids(self, i: int) -> np.ndarray:
        """Ids of the i-th document of the file."""
        k = int(self.frame_of[i])
        begin = int(self.starts[i] - self.starts[self.first[k]]) * self.dtype.itemsize
        return np.frombuffer(self.frame(k)[begin : begin + int(self.counts[i]) * self.dtype.itemsize], self.dtype)

    def wide(self, i: int) -> memoryview:
        """Ids of the i-th document as little-endian unsigned 32-bit integers; a frame is converted once."""
        k = int(self.frame_of[i])
        if k != self.wide_at:
            self.wide_at, self.wide_ids = k, memoryview(np.frombuffer(self.frame(k), self.dtype).astype("<u4").tobytes())
        begin = int(self.starts[i] - self.starts[self.first[k]]) * 4
        return self.wide_ids[begin : begin + int(self.counts[i]) * 4]

    def find(self, doc_id: int) -> int:
        """Place of a doc_id in the file (its documents ascend), or -1."""
        nulls = int(self.nulls.sum())
        i = nulls + bisect.bisect_left(self.doc_ids[nulls:], doc_id)
        return i if i < len(self) and self.doc_ids[i] == doc_id else -1


@functools.lru_cache(maxsize=2)
def _words(path: str):
    """The tokenizer, as the library reads it, and packed ids of words."""
    import os

    from tokenizers import Tokenizer

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a worker has one core
    return Tokenizer.from_file(path), {}


@functools.lru_cache(maxsize=2)
def _last_tokens(path: str) -> np.ndarray:
    """For each id, whether its token ends a word."""
    vocab = _words(path)[0].get_vocab()
    ends = np.zeros(max(vocab.values()) + 1, bool)
    ends[[i for t, i in vocab.items() if t.endswith("</w>")]] = True
    return ends


#: Words that are one pre-token, which no normal form changes and lower-casing only letter by letter: letters of Latin-1.
PLAIN = re.compile(r"[A-Za-zÀ-ÖØ-öø-ÿ]+")
#: Such a word and points or commas behind it, which are the next pre-token and change nothing in the word.
TAILED = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([.,]+)")


def _pieces(text: str) -> Iterator[str]:
    """A text in parts of about PIECE_CHARS characters, cut at blanks and line feeds, which are left out there."""
    at = 0
    while len(text) - at > PIECE_CHARS:
        end = at + PIECE_CHARS
        cut = max(text.rfind(" ", at, end), text.rfind("\n", at, end))
        if cut < 0:
            later = [x for x in (text.find(" ", end), text.find("\n", end)) if x >= 0]
            if not later:
                break
            cut = min(later)
        yield text[at:cut]
        at = cut + 1
    yield text[at:]


def encode_packed(texts: list[str], path: str, end_id: int | None, id_bytes: int) -> list[bytes]:
    """Packed ids of each text by the library's tokenizer, add_special_tokens=False, then the end id.

    The tokenizer's pre-tokens and added tokens never span a blank or line feed, and its normalizer treats what stands on each
    side of one alone; so a text is cut there, and each distinct word goes through the library once. `separable` says whether
    a tokenizer is so; by any other one whole texts are encoded. A long text is encoded in pieces.
    """
    dtype = np.dtype(f"<u{id_bytes}")
    end = b"" if end_id is None else np.array([end_id], dtype).tobytes()
    if not separable(path):
        return [np.array(_words(path)[0].encode(t, add_special_tokens=False).ids, dtype).tobytes() + end for t in texts]
    out: list[list[bytes]] = [[] for _ in texts]
    held, size = [], 0

    def close() -> None:
        for (i, _), ids in zip(held, _packed_words([p for _, p in held], path, dtype), strict=True):
            out[i].append(ids)

    for i, text in enumerate(texts):
        for piece in _pieces(text):
            held.append((i, piece))
            size += len(piece)
            if size > PIECES_CHARS:
                close()
                held, size = [], 0
    close()
    return [b"".join(parts) + end for parts in out]


def _packed_words(texts: list[str], path: str, dtype: np.dtype) -> list[bytes]:
    """Packed ids of texts that are cut at blanks and line feeds. A word's ids are the library's for that word alone, so they
    depend on nothing that the worker has met before."""
    tokenizer, known = _words(path)
    cut = [t.replace("\n", " ").split(" ") for t in texts]
    new, tailed = _unknown(cut, known, path)
    if len(known) + len(new) + len(tailed) > REMEMBERED:
        known.clear()
        new, tailed = _unknown(cut, known, path)
    plain = [w for w in new if PLAIN.fullmatch(w)]
    rest = new.difference(plain)
    # Many plain words share a call: a word ends where a token says so. Should the counts differ, each word has a call of its own.
    many = [plain[i : i + 500] for i in range(0, len(plain), 500)]
    for some, e in zip(many, tokenizer.encode_batch_fast([" ".join(p) for p in many], add_special_tokens=False), strict=True):
        ids = np.array(e.ids, dtype)
        stops = ((np.flatnonzero(_last_tokens(path)[ids]) + 1) * dtype.itemsize).tolist()
        if len(stops) == len(some):
            known.update(zip(some, map(ids.tobytes().__getitem__, map(slice, [0, *stops], stops))))
        else:
            rest.update(some)
    single = list(rest)
    for w, e in zip(single, tokenizer.encode_batch_fast(single, add_special_tokens=False), strict=True):
        known[w] = np.array(e.ids, dtype).tobytes()
    for w, (stem, tail) in tailed.items():
        known[w] = known[stem] + known[tail]
    packed = [b"".join(map(known.__getitem__, words)) for words in cut]
    for w in (*new, *tailed):
        if len(w) > REMEMBERED_CHARS:
            del known[w]
    return packed


def _unknown(cut: list[list[str]], known: dict[str, bytes], path: str) -> tuple[set[str], dict[str, tuple[str, str]]]:
    """Words for the library that aren't known, and words that are a plain one (known or among these) and a tail of points and commas."""
    new = set().union(*cut).difference(known)
    tailed = {w: m.groups() for w in new if w[-1:] in (".", ",") and (m := TAILED.fullmatch(w))} if _tails_part(path) else {}
    new.difference_update(tailed)
    new.update(p for pair in tailed.values() for p in pair if p not in known)
    return new, tailed


@functools.lru_cache(maxsize=8)
def _tails_part(path: str) -> bool:
    """Whether no added token can lie in a plain word and its tail."""
    import json

    with open(path, encoding="utf-8") as f:
        return not any(re.fullmatch(r"[A-Za-zÀ-ÖØ-öø-ÿ]*[.,]*", t["content"]) for t in json.load(f).get("added_tokens", []))


@functools.lru_cache(maxsize=8)
def separable(path: str) -> bool:
    """True for a normalizer of NFC, blanks and lower case, pre-tokens that drop white space, and added tokens without any."""
    import json

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    normal = spec.get("normalizer") or {}
    kinds = [(x["type"], x.get("content")) for x in normal.get("normalizers", [normal])]
    before = (spec.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
    split = before[0]
    return (
        all(k in (("NFC", None), ("Replace", " "), ("Lowercase", None)) for k in kinds)
        and split.get("type") == "Split"
        and split.get("behavior") == "Removed"
        and bool(split.get("invert"))
        and split.get("pattern", {}).get("Regex") == r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
        and all(x.get("type") == "ByteLevel" and not x.get("add_prefix_space") for x in before[1:])
        and not spec.get("post_processor")
        and spec.get("model", {}).get("end_of_word_suffix") == "</w>"
        and all(t["content"].split() == [t["content"]] and not t.get("single_word") and not t.get("normalized") for t in spec.get("added_tokens", []))
    )


def id_width(path: str) -> int:
    return 2 if _words(path)[0].get_vocab_size(with_added_tokens=True) <= 1 << 16 else 4


PACKED = pa.schema([("doc_id", pa.int64()), ("shard", pa.int32()), ("ids", pa.binary())])
MANIFEST = pa.schema([("shard", pa.int64()), ("path", pa.string()), ("docs", pa.int64()), ("tokens", pa.int64()), ("bytes", pa.int64())])


def write_token_files(docs: DataFrame, path: str, out_dir: str, *, end_id: int | None = 1, shards: int | None = None, frame_bytes: int = 1 << 17, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode `docs` and write shards in ascending doc_id order to `out_dir`; returns the manifest: shard, path, docs,
    tokens, bytes, start (ids of all shards before it).

    Shard bounds are quantiles of doc_id alone (a scan of one column), so each text is encoded once, and what is shuffled
    are packed ids. A repeated task writes the same bytes to the same name, if `docs` gives its rows in the same order again, as
    files do (rows of one doc_id that fill several shards are dealt by their place).
    """
    spark = docs.sparkSession
    n = shards or partitions(spark)
    own = own_columns(docs, doc_id=id_col, text=text_col).selectExpr("CAST(doc_id AS BIGINT) doc_id", "text")
    said = own.select(F.percentile_approx("doc_id", [i / n for i in range(1, n)] or [0.5], 100 * n).alias("b"), F.count("*").alias("rows"), F.count("doc_id").alias("ids")).first()
    bounds = sorted(said.b or [])
    nulls = -(-n * (said.rows - said.ids) // said.rows) if said.rows else 0  # shards of rows without id, before all others
    own = own.withColumn("shard", _shard_of(F.col("doc_id"), bounds, nulls, F.xxhash64("text", F.monotonically_increasing_id())))
    width = id_width(path)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only("tokenbin", _words.cache_clear)
        for batch in batches:
            for part in slices(batch, 1):
                ids = encode_packed([t or "" for t in part.column(1).to_pylist()], path, end_id, width)
                yield batch_of({"doc_id": part.column(0), "shard": part.column(2), "ids": ids}, PACKED)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = ((s, d, x.as_py()) for b in batches for s, d, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)))
        for shard, of in _runs(rows):
            name, said = f"{out_dir}/tokens-{shard:08d}.zst", {}

            def fill(stream, of=of, said=said):
                writer = TokenFileWriter(stream, id_bytes=width, frame_bytes=frame_bytes)
                for _, doc_id, ids in of:
                    writer.add(doc_id, ids)
                writer.close()
                said |= {"docs": len(writer.docs), "tokens": sum(d[2] for d in writer.docs)}

            size = write_atomically(name, fill)
            yield batch_of({"shard": [shard], "path": [name], "docs": [said["docs"]], "tokens": [said["tokens"]], "bytes": [size]}, MANIFEST)

    packed = own.mapInArrow(encode, "doc_id long, shard int, ids binary")
    dealt = packed.repartitionById(len(bounds) + 1 + nulls, "shard").sortWithinPartitions("shard", F.col("doc_id").asc_nulls_first(), "ids")
    manifest = materialize(dealt.select(F.col("shard").cast("long"), "doc_id", "ids").mapInArrow(write, "shard long, path string, docs long, tokens long, bytes long"), "token-manifest")
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # one row a file
    return manifest.withColumn("start", F.coalesce(F.sum("tokens").over(before), F.lit(0).cast("long")))


def _shard_of(doc_id: Column, bounds: list[int], nulls: int, deal: Column) -> Column:
    """`nulls` more than the number of ascending bounds at or below doc_id, as a balanced tree of comparisons; rows without id fill
    the shards before.

    A bound that occurs r times is an id of so many rows that they fill shards: these are dealt over the r shards that end there, by
    `deal`. Larger ids come no earlier than the last of them, so shards stay in order.
    """
    counts = Counter(bounds)
    values = sorted(counts)
    upto = [0, *accumulate(counts[v] for v in values)]

    def tree(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(upto[lo] + nulls)
        mid = (lo + hi) // 2
        return F.when(doc_id >= F.lit(values[mid]), tree(mid + 1, hi)).otherwise(tree(lo, mid))

    times = F.lit(1)
    for v in (v for v in values if counts[v] > 1):
        times = F.when(doc_id == v, counts[v]).otherwise(times)
    known = tree(0, len(values)) - F.pmod(deal, times)
    return F.when(doc_id.isNull(), F.pmod(deal, F.lit(max(1, nulls)))).otherwise(known).cast("int")


def _runs(rows: Iterable[tuple]) -> Iterator[tuple[int, Iterator[tuple]]]:
    import itertools

    return itertools.groupby(rows, key=lambda r: r[0])


READ = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])


def read_token_files(manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document of the files in a manifest, file by file in parallel."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                filesystem, path = open_fs(name)
                with filesystem.open_input_file(path) as stream:
                    reader = TokenFileReader(stream)
                    for i in range(0, len(reader), 5000):
                        part = range(i, min(i + 5000, len(reader)))
                        yield batch_of(
                            {
                                "doc_id": [None if reader.nulls[k] else int(reader.doc_ids[k]) for k in part],
                                "start": [start + int(reader.starts[k]) for k in part],
                                "n_tokens": [int(reader.counts[k]) for k in part],
                                "ids_crc32": [zlib.crc32(reader.wide(k)) for k in part],
                            },
                            READ,
                        )

    files = manifest.select("path", "start").repartition(max(1, partitions(manifest.sparkSession)))
    return files.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_files(docs: DataFrame, path: str, *, end_id: int | None = 1, **options) -> DataFrame:
    """Write the token files of `docs` to the shared folder, where they stay until the application ends, and read every document back."""
    out_dir = temporary(docs.sparkSession, new_dir(docs.sparkSession, "tokens"))
    return read_token_files(write_token_files(docs, path, out_dir, end_id=end_id, **options))
