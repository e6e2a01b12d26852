"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features of a document: its distinct words, pairs of neighbours and pairs with one word between, hashed to 2^22 coordinates;
words are lower-case runs of letters, digits and underscores. FTRL-proximal keeps a learning rate for each coordinate, and its
L1 term leaves most weights exactly zero, so what is broadcast is the short list of the others. Only the texts are inputs of a score.

Training takes a bounded sample: at most `TRAIN_DOCS` labelled documents, those with the smallest hash of their doc_id, and of
these, in that order, the whole texts that fit into `TRAIN_BYTES` bytes together; a text of over `TRAIN_BYTES` / `LARGEST` is left
out alone. How many are left out is logged. Their features (distinct 32-bit numbers) meet in one task. Scoring covers every whole
text.

Defined results: null text is the empty text, which gets the bias's score; null labels are left out; a doc_id that the labels
repeat counts once for each label; of a doc_id that the documents repeat, the text with the smallest hash is learned from; without both labels the score is the same for all, the share of label 1 (0 without any
label); null or repeated doc_id are kept, one row for each input row (null is never held out); an empty table gives an empty
table; further columns are ignored.
"""

from __future__ import annotations

import logging
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import batch_of, kept_rows, only, own_columns, slices
from .words import forget, joined, mix, odd, word_hashes

BITS = 22
TRAIN_DOCS, TRAIN_BYTES = 10_000, 32 << 20
LARGEST = 64  # one text has at most this part of the bytes
GAP = 2
BATCH_WORDS = 400_000


def held_out(doc_id: Column) -> Column:
    """Rows that no label is learned from: crc32 of the doc_id as text, modulo 5, is 0."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def hashed(words: np.ndarray) -> list[np.ndarray]:
    """Coordinates of the words, neighbours and skip-grams that begin at each place."""
    shift = np.uint64(64 - BITS)
    one = words * odd(1)
    found = [mix(one) >> shift]
    for k, step in ((2, 1), (3, 2)):
        if len(words) > step:
            found.append(mix(one[:-step] + words[step:] * odd(k)) >> shift)
    return found


def features(text: str | None) -> np.ndarray:
    return np.unique(np.concatenate(hashed(word_hashes(text)))).astype(np.uint32)


class Ftrl:
    """Per-coordinate FTRL-proximal; coordinate 2^BITS is the bias, without L1."""

    def __init__(self, alpha: float = 3.0, beta: float = 1.0, l1: float = 5.0, l2: float = 0.0):
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z, self.n = np.zeros((1 << BITS) + 1, np.float32), np.zeros((1 << BITS) + 1, np.float32)

    def weights(self, at: np.ndarray) -> np.ndarray:
        z, l1 = self.z[at], np.where(at == 1 << BITS, 0.0, self.l1)
        return np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((self.beta + np.sqrt(self.n[at])) / self.alpha + self.l2))

    def learn(self, at: np.ndarray, label: int) -> None:
        w = self.weights(at)
        g = 1 / (1 + np.exp(-np.clip(w.sum(), -30, 30))) - label
        n = self.n[at]
        sigma = (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha
        self.z[at] += g - sigma * w
        self.n[at] = n + g * g

    def compact(self) -> tuple[np.ndarray, np.ndarray, float]:
        """Coordinates and weights that aren't zero, and the bias."""
        at = np.flatnonzero(self.n)  # coordinates ever met; the bias is the last
        w = self.weights(at)
        kept = (w != 0) & (at < 1 << BITS)
        return at[kept].astype(np.uint32), w[kept].astype(np.float32), float(w[-1])


def fit(examples: list[tuple[np.ndarray, int]], epochs: int = 12) -> tuple[np.ndarray, np.ndarray, float]:
    """Weights of the examples (coordinates, label), in the same order every time."""
    positive = sum(y for _, y in examples)
    none = np.empty(0, np.uint32), np.empty(0, np.float32)
    if not 0 < positive < len(examples):
        return *none, 30.0 if positive else -30.0
    model, order = Ftrl(), np.random.default_rng(7)
    for _ in range(epochs):
        for i in order.permutation(len(examples)):
            at, label = examples[i]
            model.learn(np.append(at.astype(np.int64), 1 << BITS), label)
    return model.compact()


def labelled(docs: DataFrame, labels: DataFrame, label: str, most: int, most_bytes: int) -> DataFrame:
    """doc_id, label, text_hash, text of the sample that is learned from: one row for each doc_id and label, `most` at most, of
    `most_bytes` together. A text that several input rows hold may come once from each task that reads it.

    Only numbers are shuffled and, for `most` documents at most, come to the driver.
    """
    known = own_columns(labels, doc_id="doc_id", label=label).selectExpr("CAST(doc_id AS BIGINT) doc_id", "CAST(label AS INT) label").where("doc_id IS NOT NULL AND label IN (0, 1)")
    own = own_columns(docs, doc_id="doc_id", text="text").selectExpr("CAST(doc_id AS BIGINT) doc_id", "text")
    first = known.where(~held_out(F.col("doc_id"))).distinct().join(own.select("doc_id").distinct(), "doc_id", "left_semi").orderBy(F.xxhash64("doc_id"), "doc_id", "label").limit(most)
    sizes = own.join(F.broadcast(first), "doc_id").select("doc_id", "label", F.xxhash64("text").alias("h"), F.coalesce(F.octet_length("text"), F.lit(0)).alias("size"))  # `most` pairs of numbers
    rows = sizes.groupBy("doc_id", "label").agg(F.min(F.struct("h", "size")).alias("k")).select("doc_id", "label", "k.h", "k.size").orderBy(F.xxhash64("doc_id"), "doc_id", "label").collect()
    fits, held = [], 0
    for r in rows:
        if r.size * LARGEST <= most_bytes and held + r.size <= most_bytes:
            held += r.size
            fits.append((r.doc_id, r.label, r.h))
    if len(fits) < len(rows):
        logging.getLogger(__name__).warning("%d of %d labelled texts are too long to learn from", len(rows) - len(fits), len(rows))
    picked = docs.sparkSession.createDataFrame(fits, "doc_id long, label int, text_hash long")
    return own.join(F.broadcast(picked), "doc_id").where(F.xxhash64("text") == F.col("text_hash")).select("doc_id", "label", "text_hash", "text")


def once(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, str | None]]:
    """doc_id, label, text of the rows of labelled(), each document once a task."""
    seen = set()
    for batch in batches:
        for part in slices(batch, 3):
            for doc_id, label, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), part.column(3)):
                if (doc_id, label) not in seen:
                    seen.add((doc_id, label))
                    yield doc_id, label, text.as_py()


def train(docs: DataFrame, labels: DataFrame, *, label: str = "toxic", most: int = TRAIN_DOCS, most_bytes: int = TRAIN_BYTES) -> tuple[np.ndarray, np.ndarray, float]:
    """Weights of the sample's documents. They are learned in one task, which the sample's bounds keep small; the driver gets the weights."""
    examples_schema = pa.schema([("doc_id", pa.int64()), ("label", pa.int32()), ("at", pa.binary())])
    model_schema = pa.schema([("at", pa.binary()), ("weights", pa.binary()), ("bias", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only("words", forget)
        for doc_id, y, text in once(batches):
            yield batch_of({"doc_id": [doc_id], "label": [y], "at": [features(text).tobytes()]}, examples_schema)

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only("learning", lambda: None)
        rows = [(i.as_py(), y.as_py(), np.frombuffer(at.as_buffer(), np.uint32)) for b in batches for i, y, at in zip(*b.columns)]  # views, no copies
        rows.sort(key=lambda e: e[:2])
        at, weights, bias = fit([(at, y) for _, y, at in rows])
        yield batch_of({"at": [at.tobytes()], "weights": [weights.tobytes()], "bias": [bias]}, model_schema)

    examples = labelled(docs, labels, label, most, most_bytes).mapInArrow(run, "doc_id long, label int, at binary").dropDuplicates(["doc_id", "label"])
    found = examples.repartition(1).mapInArrow(learn, "at binary, weights binary, bias double").collect()
    if not found:  # no examples, no task
        return fit([])
    return np.frombuffer(bytes(found[0].at), np.uint32), np.frombuffer(bytes(found[0].weights), np.float32), found[0].bias


SCORED = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64()), ("score", pa.float64())])


class Scorer:
    """Scores of texts by a model."""

    def __init__(self, model: tuple[np.ndarray, np.ndarray, float]):
        at, weights, self.bias = model
        self.dense = np.zeros(1 << BITS, np.float32)
        self.dense[at] = weights

    def _met(self, words: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Document << BITS | coordinate of the features that have a weight, each once."""
        found = []
        for at in range(0, len(words), BATCH_WORDS):
            for step, coordinates in enumerate(hashed(words[at : at + BATCH_WORDS + GAP])):
                where = np.flatnonzero(self.dense[coordinates[:BATCH_WORDS]])
                doc = np.searchsorted(begins, where + at, "right") - 1
                inside = where + at + step < ends[doc]
                found.append(np.unique(doc[inside] << BITS | coordinates[where[inside]].astype(np.int64)))
        return np.unique(np.concatenate([*found, np.empty(0, np.int64)]))

    def of_words(self, parts: list[np.ndarray]) -> np.ndarray:
        words, begins = joined(parts, GAP)
        pairs = self._met(words, begins, begins[:-1] + np.array([len(p) for p in parts], np.int64))
        total = np.bincount(pairs >> BITS, self.dense[pairs & ((1 << BITS) - 1)], len(parts))
        return 1 / (1 + np.exp(-np.clip(total + self.bias, -30, 30)))

    def __call__(self, texts: pa.Array) -> np.ndarray:
        out, held, size = [], [], 0
        for text in texts:
            held.append(word_hashes(text.as_py()))
            size += len(held[-1])
            if size >= BATCH_WORDS:
                out.append(self.of_words(held))
                held, size = [], 0
        if held:
            out.append(self.of_words(held))
        return np.concatenate([*out, np.empty(0)])


def score(docs: DataFrame, model: tuple[np.ndarray, np.ndarray, float], *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text_hash, score: one row for each row of `docs`."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only("words", forget)
        scorer = Scorer(shared.value)
        for batch in batches:
            for part in slices(batch, 2):
                yield batch_of({"doc_id": part.column(0), "text_hash": part.column(1), "score": scorer(part.column(2))}, SCORED)

    own = own_columns(docs, doc_id=id_col, text=text_col).selectExpr("CAST(doc_id AS BIGINT) doc_id", "xxhash64(text) text_hash", "text")
    return own.mapInArrow(run, "doc_id long, text_hash long, score double")


def predictions(scored: DataFrame, threshold: float) -> DataFrame:
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def score_toxicity(docs: DataFrame, labels: DataFrame, *, threshold: float = 0.5) -> DataFrame:
    """doc_id, held_out, score, predicted of every document, by a model of the labels outside the held-out fold."""
    return predictions(score(docs, train(docs, labels)), threshold)


def drop_toxic(docs: DataFrame, labels: DataFrame, *, threshold: float = 0.5, text_col: str = "text") -> DataFrame:
    """`docs` without the rows that score at least `threshold`."""
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, labels))

    def judge():
        only("words", forget)
        scorer = Scorer(shared.value)
        return lambda texts: scorer(texts) < threshold

    return kept_rows(docs, text_col, judge)
