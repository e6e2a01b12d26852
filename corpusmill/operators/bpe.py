"""Byte-pair encoding: word table, pair counts, merges, training, vocabulary, encoding and decoding.

Tokens are lower-case hex in DataFrames (two digits a byte); hex sorts as the bytes do. A word is its tokens, spelled
`<hex><hex>...` (functions.text), so that a merge is a replacement and stays in the JVM.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from ..functions import text as T
from ..sources.shared import discard, materialize
from .names import reserve
from .pieces import merged
from .trainer import train_merges


#: Words of the dictionary that are broadcast, and the bytes of the longest of them: 32 MB at most, with their ids.
HOT_WORDS, HOT_BYTES = 65_536, 64
#: Words of a partition that is put together in one task (some 80 bytes each), and ids that are decoded at once.
PARTITION_WORDS, DECODED_IDS = 2_000_000, 1 << 22


def word_table(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """word (pre-token), n: how often each occurs; a partial count in every task, then one shuffle of distinct words."""
    return docs.select(F.explode(T.pretokens(F.col(text_col))).alias("word")).groupBy("word").agg(F.count("*").alias("n"))


def spelled_words(words: DataFrame) -> DataFrame:
    """toks (spelled bytes), n."""
    return words.select(T.spelled(T.byte_hex(F.col("word"))).alias("toks"), "n")


def pair_counts(spelled: DataFrame) -> DataFrame:
    """l, r, n: neighbouring tokens, weighted by the words' counts."""
    pair = spelled.select(F.explode(T.pairs(T.unspelled(F.col("toks")))).alias("p"), "n")
    return pair.groupBy(F.col("p.l").alias("l"), F.col("p.r").alias("r")).agg(F.sum("n").alias("n"))


def best_pair(counts: DataFrame) -> DataFrame:
    """The most frequent pair; of equal ones the smallest by bytes, the left token first. A top-1, no global sort."""
    return counts.orderBy(F.desc("n"), "l", "r").limit(1)


def merge_step(spelled: DataFrame, left: str, right: str) -> DataFrame:
    """The word table after a merge, equal words added up."""
    merged = T.merge_pair(F.col("toks"), F.lit(left), F.lit(right))
    return spelled.select(merged.alias("toks"), "n").groupBy("toks").agg(F.sum("n").alias("n"))


def merge_deltas(spelled: DataFrame, left: str, right: str) -> DataFrame:
    """l, r, n: what a merge changes in the pair counts; pairs that it leaves as they were are left out."""
    touched = spelled.where(F.contains("toks", F.lit(f"<{left}><{right}>")))
    after = touched.select(T.merge_pair(F.col("toks"), F.lit(left), F.lit(right)).alias("toks"), "n")
    both = pair_counts(touched.withColumn("n", -F.col("n"))).unionAll(pair_counts(after))
    return both.groupBy("l", "r").agg(F.sum("n").alias("n")).where("n <> 0")


def apply_deltas(counts: DataFrame, deltas: DataFrame) -> DataFrame:
    """Pair counts after a merge; pairs that no longer occur are dropped."""
    return counts.unionAll(deltas).groupBy("l", "r").agg(F.sum("n").alias("n")).where("n > 0")


def train(docs: DataFrame, vocab_size: int, specials: list[str] = (), text_col: str = "text") -> DataFrame:
    """rank, l, r (hex), n of the merges up to a vocabulary of `vocab_size` (specials and the 256 bytes included).

    Words are counted over the cluster and stay there; see trainer.train_merges. Null and empty texts have no words; without
    pairs there are no merges. The result has a row for each merge.
    """
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    counted = materialize(word_table(docs, text_col).repartition(parts), "bpe-words")  # even parts: a round is as long as its longest
    found = train_merges(counted, vocab_size - 256 - len(specials))
    discard(counted)
    return docs.sparkSession.createDataFrame([(i, left.hex(), right.hex(), n) for i, (left, right, n) in enumerate(found)], "rank int, l string, r string, n long")


@dataclass
class Tokenizer:
    """A trained vocabulary: ids are specials, then the 256 bytes, then merges. Small enough to broadcast: a row for each id."""

    vocab: dict[int, bytes]
    merges: list[tuple[bytes, bytes]]
    specials: list[str] = field(default_factory=list)

    @classmethod
    def from_merges(cls, merges: list[tuple[bytes, bytes]], specials: list[str] = ()) -> Tokenizer:
        tokens = [s.encode() for s in specials] + [bytes([b]) for b in range(256)] + [a + b for a, b in merges]
        return cls(dict(enumerate(tokens)), list(merges), list(specials))

    @classmethod
    def train(cls, docs: DataFrame, vocab_size: int, specials: list[str] = (), text_col: str = "text") -> Tokenizer:
        rows = sorted(train(docs, vocab_size, specials, text_col).collect())  # vocab_size rows at most
        return cls.from_merges([(bytes.fromhex(r.l), bytes.fromhex(r.r)) for r in rows], specials)

    def __post_init__(self):
        # Of repeated bytes the last id counts, of a repeated pair the last rank.
        self.ids = dict(zip(self.vocab.values(), self.vocab))
        self.rank = dict(zip(self.merges, range(len(self.merges))))
        self.words = regex.compile(T.PRETOKEN)
        self.special = regex.compile("|".join(regex.escape(s) for s in self.specials if s) or r"(?!)")

    @property
    def vocab_size(self) -> int:
        return len(self.vocab)

    def merged(self, piece: bytes) -> list[bytes]:
        """Tokens of a pre-token."""
        return merged(piece, self.rank, self.merges)

    def piece_ids(self, piece: str) -> list[int]:
        """Ids of a pre-token, or of a special token, which is one id."""
        return [self.ids[piece.encode()]] if piece in self.specials else [self.ids[t] for t in self.merged(piece.encode())]

    def encode(self, text: str) -> list[int]:
        """Ids of a text. Where two specials begin at one place, the first of the list is meant."""
        out, at = [], 0
        for special in (*self.special.finditer(text), None):
            for piece in self.words.findall(text[at : special.start() if special else len(text)]):
                out += [self.ids[t] for t in self.merged(piece.encode())]
            if special:
                out.append(self.ids[special.group().encode()])
                at = special.end()
        return out

    def decode(self, ids) -> str:
        return b"".join(self.vocab[i] for i in map(int, ids)).decode("utf-8", "replace")


def _pieces(text: Column, specials: list[str]) -> Column:
    """array<string>: pre-tokens and special tokens of a text, in order."""
    specials = [s for s in specials if s]
    if not specials:
        return T.pretokens(text)
    parts = F.transform(T.split_specials(text, specials), lambda p: F.when(T.is_special(p, specials), F.array(p)).otherwise(T.pretokens(p)))
    return F.when(F.greatest(*[F.contains(text, F.lit(s)) for s in specials], F.lit(False)), F.flatten(parts)).otherwise(T.pretokens(text))


def dictionary(docs: DataFrame, tokenizer: Tokenizer, text_col: str = "text") -> DataFrame:
    """word, n, code: each distinct pre-token (and special token) of the documents, how often it occurs, and its ids; written to the
    shared folder. Each is encoded once in the whole cluster."""
    words = docs.select(F.explode(_pieces(F.col(text_col), tokenizer.specials)).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    shared = docs.sparkSession.sparkContext.broadcast(tokenizer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            codes = pa.array([own.piece_ids(w) for w in batch.column(0).to_pylist()], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([*batch.columns, codes], ["word", "n", "code"])

    return materialize(words.mapInArrow(run, "word string, n long, code array<int>"), "bpe-dictionary")


def encode_documents(docs: DataFrame, tokenizer: Tokenizer, *, end: str | None = None, text_col: str = "text", key: str = "doc_id", hot_words: int = HOT_WORDS) -> DataFrame:
    """`docs` with ids (array<int>) in place of the text, ending with the id of the special token `end` if one is named.

    A dictionary join: texts are dealt out by document once, then cut where they lie; the most frequent words of at most HOT_BYTES (a
    bounded table) are broadcast, so that their occurrences get their ids there and are put together without a shuffle; a document's
    other words are joined with the dictionary and put in their places. What is shuffled are texts and rare words. A partition has
    about PARTITION_WORDS words. Rows are known by hashes of key and text, so keys may repeat or be null, and rows too; null text
    counts as empty. An input column `ids` would clash and raises.
    """
    reserve(docs, "ids", "g_", "t_", "known", "rare")
    table = dictionary(docs, tokenizer, text_col)
    hot = table.where(F.octet_length("word") <= HOT_BYTES).orderBy(F.desc("n"), "word").limit(hot_words)
    named = [F.xxhash64(key, text_col).alias("g_"), F.xxhash64(text_col).alias("t_")]
    least = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = max(least, (table.agg(F.sum("n")).first()[0] or 0) // PARTITION_WORDS)
    texts = docs.select(*named, F.col(text_col).alias("text")).where("text <> ''").repartition(dealt, "g_", "t_")  # hashed once a document, before it is cut
    found = texts.select("g_", "t_", F.posexplode(_pieces(F.col("text"), tokenizer.specials)).alias("at", "word"))
    coded = found.join(F.broadcast(hot.select("word", "code")), "word", "left")
    known = coded.where("code IS NOT NULL").groupBy("g_", "t_").agg(F.collect_set(F.struct("at", "code")).alias("known"))  # of rows that are equal one set
    rare = coded.where("code IS NULL").select("g_", "t_", "at", "word").join(table.select("word", "code"), "word")
    filled = rare.groupBy("g_", "t_").agg(F.collect_set(F.struct("at", "code")).alias("rare"))
    none = F.array().cast("array<struct<at:int,code:array<int>>>")
    both = F.array_sort(F.concat(F.coalesce("known", none), F.coalesce("rare", none)))
    tail = F.array(*[F.lit(tokenizer.ids[end.encode()])] if end is not None else []).cast("array<int>")
    rows = docs.select(*named, *[F.col(f"`{c}`") for c in docs.columns if c != text_col])
    joined = rows.join(known, ["g_", "t_"], "left").join(filled, ["g_", "t_"], "left")
    ids = F.concat(F.flatten(F.transform(both, lambda p: p["code"])), tail)
    return joined.withColumn("ids", ids).drop("g_", "t_", "known", "rare")


def vocab_frame(spark: SparkSession, tokenizer: Tokenizer) -> DataFrame:
    return spark.createDataFrame([(i, bytearray(t)) for i, t in tokenizer.vocab.items()], "id int, token binary")


def decode_documents(encoded: DataFrame, vocab: DataFrame, key: str) -> DataFrame:
    """key, text: ids looked up in the vocabulary (id, token), which is broadcast (a row an id), in their order; an unknown id raises.

    A row's ids are decoded where they are: nothing is shuffled. Null ids are left out; a row without ids has the empty text.
    """
    rows = sorted((r.id, bytes(r.token)) for r in vocab.select("id", "token").where("id IS NOT NULL AND token IS NOT NULL").collect())
    shared = encoded.sparkSession.sparkContext.broadcast((np.array([i for i, _ in rows], np.int64), pa.array([*(t for _, t in rows), b""], pa.large_binary())))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends = np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(batch.column(1)), 0).to_numpy())])
            begin = 0
            while begin < batch.num_rows:
                end = max(begin + 1, int(np.searchsorted(ends, ends[begin] + DECODED_IDS, "right")) - 1)
                texts = _decoded(batch.column(1).slice(begin, end - begin).flatten(), ends[begin : end + 1] - ends[begin], *shared.value)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(begin, end - begin), texts], ["key", "text"])
                begin = end

    named = encoded.select(F.col(key).alias("key"), "ids")
    found = named.mapInArrow(run, StructType([named.schema["key"], StructField("text", BinaryType())]))
    return found.select(F.col("key").alias(key), T.decoded(F.col("text")).alias("text"))


def _decoded(ids: pa.Array, ends: np.ndarray, known: np.ndarray, tokens: pa.Array) -> pa.Array:
    """The bytes of rows that have ids[ends[i] : ends[i + 1]]; the last of `tokens` is empty, for null."""
    null = ids.is_null().to_numpy(zero_copy_only=False)
    wanted = pc.fill_null(ids, 0).to_numpy(zero_copy_only=False)
    at = np.searchsorted(known, wanted)
    lost = ~null & (np.append(known, -1)[at] != wanted) | ~null & (at == len(known))
    if lost.any():
        raise ValueError(f"unknown id {wanted[lost][0]}")
    taken = tokens.take(pa.array(np.where(null, len(known), at)))
    offsets = np.frombuffer(taken.buffers()[1], np.int64, len(taken) + 1) if len(taken) else np.zeros(1, np.int64)
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(ends) - 1, [None, pa.py_buffer(np.ascontiguousarray(offsets[ends])), taken.buffers()[2] or pa.py_buffer(b"")]).cast(pa.binary())
