"""Quality classifier: a byte-level convolutional network in numpy.

A text is its UTF-8 bytes. Each byte has a learned vector; learned filters over `WIDTH` bytes, moved by `STRIDE`, go through a ReLU.
The document is covered by overlapping chunks (of `CHUNK` blocks of `BLOCK` bytes, half a chunk apart, to the last byte); every
filter is max-pooled over each chunk, and the mean and the maximum over the chunks are combined into one probability.
Only the texts are inputs of a score.

Training takes a bounded sample as toxicity.py does: at most `TRAIN_DOCS` labelled documents of the smallest hash of their doc_id and,
of these, the whole texts that fit into `TRAIN_BYTES` bytes together, none of over a 64th of that. Scoring covers every whole text, a
long one in pieces of `PIECE` blocks, whose windows reach into the next piece.

Defined results: null text is the empty text, which has one chunk of padding; null labels are left out; without both labels the score
is the same for all, the share of label 1 (0 without any label); null or repeated doc_id are kept, one row for each input row
(null is never held out); an empty table gives an empty table; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import batch_of, own_columns, slices
from .toxicity import SCORED, labelled, once, predictions

WIDTH, STRIDE, VECTOR, FILTERS = 8, 2, 6, 24
BLOCK, CHUNK = 128, 4
TRAIN_DOCS, TRAIN_BYTES = 6000, 20 << 20
BATCH_BYTES = 1 << 19
PIECE = 1 << 12  # blocks that are convolved at once


@dataclass
class Network:
    vectors: np.ndarray  # 256 x VECTOR
    filters: np.ndarray  # WIDTH * VECTOR x FILTERS
    offsets: np.ndarray  # FILTERS
    out: np.ndarray  # 2 * FILTERS + 1; the last is the bias


def blocks_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All texts, each padded with zeros to whole blocks (at least WIDTH zeros), and the first block of each."""
    counts = np.array([(len(t) + WIDTH) // BLOCK + 1 for t in texts], np.int64)
    first = np.concatenate([[0], np.cumsum(counts)])
    out = np.zeros(int(first[-1]) * BLOCK + WIDTH, np.uint8)
    for t, b in zip(texts, first.tolist()):
        out[b * BLOCK : b * BLOCK + len(t)] = np.frombuffer(t, np.uint8)
    return out, first


def windows(net: Network, data: np.ndarray) -> np.ndarray:
    """Every STRIDE-th window of WIDTH bytes as a row of vectors; a view's copy, made once for each batch."""
    vectors = net.vectors[data]
    rows = (len(data) - WIDTH) // STRIDE
    view = np.lib.stride_tricks.as_strided(vectors, (rows, WIDTH * VECTOR), (STRIDE * vectors.strides[0], vectors.strides[1]))
    return view


def answered(net: Network, data: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Each filter's answer at each window, by blocks; the padding's windows that reach into the next text never win."""
    answers = (windows(net, data) @ net.filters).reshape(-1, BLOCK // STRIDE, FILTERS)
    answers[first[1:] - 1, 1 - WIDTH // STRIDE :] = -np.inf
    return answers


def chunks_of(first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First block of every chunk, and its document; the last chunk of a document may be shorter."""
    counts = np.diff(first)
    half = CHUNK // 2
    n = np.maximum(1, -(-(counts - half) // half))
    doc = np.repeat(np.arange(len(counts)), n)
    within = np.arange(int(n.sum())) - np.repeat(np.concatenate([[0], np.cumsum(n)[:-1]]), n)
    return first[doc] + within * half, doc


def tops_of(net: Network, data: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Each filter's largest answer in each block, before the ReLU, which keeps order; memory is that of PIECE blocks."""
    tops = np.empty((int(first[-1]), FILTERS), net.filters.dtype)
    for at in range(0, len(tops), PIECE):
        to = min(at + PIECE, len(tops))
        answers = (windows(net, data[at * BLOCK : to * BLOCK + WIDTH]) @ net.filters).reshape(-1, BLOCK // STRIDE, FILTERS)
        last = first[1:][(first[1:] > at) & (first[1:] <= to)] - 1 - at
        answers[last, 1 - WIDTH // STRIDE :] = -np.inf
        answers.max(axis=1, out=tops[at:to])
    return tops


def combined(net: Network, chunk: np.ndarray, doc: np.ndarray, texts: int) -> tuple:
    """Probability of each text from its chunks' features, and what gradients need."""
    edges = np.searchsorted(doc, np.arange(texts))
    n = np.diff(np.append(edges, len(doc)))
    mean = np.add.reduceat(chunk, edges, axis=0) / n[:, None]
    most = np.maximum.reduceat(chunk, edges, axis=0)
    logit = np.concatenate([mean, most], axis=1) @ net.out[:-1] + net.out[-1]
    return 1 / (1 + np.exp(-np.clip(logit, -30, 30))), n, edges, mean, most


def forward(net: Network, texts: list[bytes]) -> np.ndarray:
    """Probability of each text."""
    data, first = blocks_of(texts)
    tops = tops_of(net, data, first)
    begin, doc = chunks_of(first)
    last = first[doc + 1] - 1  # the last block again beyond the end
    chunk = tops[begin]
    for k in range(1, CHUNK):
        np.maximum(chunk, tops[np.minimum(begin + k, last)], out=chunk)
    return combined(net, np.maximum(chunk + net.offsets, 0), doc, len(texts))[0]


def forward_whole(net: Network, texts: list[bytes]) -> tuple:
    """The same with all that gradients need; for small batches."""
    data, first = blocks_of(texts)
    answers = answered(net, data, first)
    tops = answers.max(axis=1)
    begin, doc = chunks_of(first)
    member = np.minimum(begin[:, None] + np.arange(CHUNK), first[doc + 1][:, None] - 1)
    held = tops[member]  # chunks x CHUNK x FILTERS
    chunk = np.maximum(held.max(axis=1) + net.offsets, 0)
    probability, n, edges, mean, most = combined(net, chunk, doc, len(texts))
    return probability, data, answers, member, held, chunk, doc, n, edges, mean, most


def gradients(net: Network, texts: list[bytes], labels: np.ndarray) -> tuple[list[np.ndarray], float]:
    probability, data, answers, member, held, chunk, doc, n, edges, mean, most = forward_whole(net, texts)
    error = (probability - labels) / len(texts)
    out = np.append(np.concatenate([mean, most], axis=1).T @ error, error.sum())
    # To the chunks: all share the mean, the first of the largest has the maximum.
    at_chunk = (error / n)[doc][:, None] * net.out[:FILTERS]
    is_most = chunk == most[doc]
    place = np.where(is_most, np.arange(len(doc))[:, None], len(doc))
    firsts = np.minimum.reduceat(place, edges, axis=0)
    at_chunk[firsts, np.arange(FILTERS)] += error[:, None] * net.out[FILTERS:-1]
    at_chunk *= chunk > 0
    # To the blocks, to the one window of each that was largest.
    block = np.take_along_axis(member, held.argmax(axis=1), axis=1)
    live = np.nonzero(at_chunk)
    g, f, b = at_chunk[live], live[1], block[live]
    step = BLOCK // STRIDE
    window = b * step + answers[b, :, f].argmax(axis=1)
    rows = windows(net, data)[window]
    filters = np.zeros_like(net.filters)
    for k in range(FILTERS):
        own = f == k
        filters[:, k] = rows[own].T @ g[own]
    back = (g[:, None] * net.filters[:, f].T).reshape(-1, VECTOR)
    codes = data[(window * STRIDE)[:, None] + np.arange(WIDTH)].ravel()
    vectors = np.stack([np.bincount(codes, back[:, k], 256) for k in range(VECTOR)], axis=1)
    offsets = np.bincount(f, g, FILTERS)
    loss = -np.mean(np.log(np.where(labels == 1, probability, 1 - probability) + 1e-9))
    return [vectors, filters, offsets, out], float(loss)


def batches_of(examples: list[tuple[bytes, int]], batch: int) -> Iterator[list[tuple[bytes, int]]]:
    """Parts of `batch` examples and BATCH_BYTES bytes at most, one example at least."""
    held, size = [], 0
    for x in examples:
        if held and (len(held) == batch or size + len(x[0]) > BATCH_BYTES):
            yield held
            held, size = [], 0
        held.append(x)
        size += len(x[0])
    if held:
        yield held


def fit(examples: list[tuple[bytes, int]], epochs: int = 10, batch: int = 32, rate: float = 6e-3, seed: int = 11) -> Network | float:
    """A network by Adam on the logistic loss, in the same order every time; the share of 1 where there is one label only."""
    positive = sum(y for _, y in examples)
    if not 0 < positive < len(examples):
        return positive / len(examples) if examples else 0.0
    random = np.random.default_rng(seed)
    net = Network(
        random.normal(0, 0.5, (256, VECTOR)).astype(np.float32),
        random.normal(0, (2 / (WIDTH * VECTOR)) ** 0.5, (WIDTH * VECTOR, FILTERS)).astype(np.float32),
        np.zeros(FILTERS, np.float32),
        np.append(random.normal(0, 0.1, 2 * FILTERS), np.log(positive / (len(examples) - positive))).astype(np.float32),
    )
    parts = [net.vectors, net.filters, net.offsets, net.out]
    first, second, t = [np.zeros_like(p) for p in parts], [np.zeros_like(p) for p in parts], 0
    steps = epochs * -(-len(examples) // batch)  # about; long texts make smaller batches
    for _ in range(epochs):
        for part in batches_of([examples[k] for k in random.permutation(len(examples))], batch):
            grads, _ = gradients(net, [x for x, _ in part], np.array([y for _, y in part], np.float32))
            t += 1
            now = rate * max(0.02, 1 - t / (steps + 1))
            for p, m, v, g in zip(parts, first, second, grads):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p -= now * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return net


def train(docs: DataFrame, labels: DataFrame, *, label: str = "quality", most: int = TRAIN_DOCS, most_bytes: int = TRAIN_BYTES) -> Network | float:
    schema = pa.schema([("doc_id", pa.int64()), ("label", pa.int32()), ("text", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in once(batches):
            yield batch_of(dict(zip(schema.names, ([x] for x in row))), schema)

    rows = labelled(docs, labels, label, most, most_bytes).mapInArrow(run, "doc_id long, label int, text string").dropDuplicates(["doc_id", "label"]).toArrow()
    found = sorted(zip(*(c.to_pylist() for c in rows.columns)), key=lambda r: r[:2])
    return fit([((t or "").encode(), y) for _, y, t in found])


def scores(net: Network | float, texts: pa.Array) -> np.ndarray:
    """The score of each whole text."""
    if isinstance(net, float):
        return np.full(len(texts), net)
    out, held, size = [], [], 0
    for text in texts:
        held.append((text.as_py() or "").encode())
        size += len(held[-1])
        if size >= BATCH_BYTES:
            out.append(forward(net, held))
            held, size = [], 0
    if held:
        out.append(forward(net, held))
    return np.concatenate([*out, np.empty(0)]).astype(float)


def score(docs: DataFrame, net: Network | float, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text_hash, score: one row for each row of `docs`."""
    shared = docs.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 2):
                yield batch_of({"doc_id": part.column(0), "text_hash": part.column(1), "score": scores(shared.value, part.column(2))}, SCORED)

    rows = own_columns(docs, doc_id=id_col, text=text_col).selectExpr("CAST(doc_id AS BIGINT) doc_id", "xxhash64(text) text_hash", "text")
    return rows.mapInArrow(run, "doc_id long, text_hash long, score double")


def score_quality(docs: DataFrame, labels: DataFrame, *, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted of every document, by a network of the labels outside the held-out fold."""
    return predictions(score(docs, train(docs, labels)), threshold)
