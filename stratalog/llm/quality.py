"""Quality by random-indexing word vectors and a small network with calibrated probabilities."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordHashes, fetched, pinned, slices
from .toxicity import CALIBRATE, HELD_OUT, fold_of, labelled

#: Buckets of words and length of their vectors; nonzero entries of an index vector; neighbours on either side.
WORD_BITS, DIMENSIONS, NONZERO, WINDOW = 13, 48, 6, 2
#: Expected bound of labelled rows the network learns from (their pooled vectors reach the driver).
LABELLED_ROWS = 20_000
HIDDEN, EPOCHS, RATE, BATCH = 32, 60, 2e-3, 128
SEED = 7
THRESHOLD = 0.3

#: Runs of letters and digits, runs of one kind of mark, and line ends are words of their own.
TOKEN = re.compile(rb"[0-9A-Za-z\x80-\xff]+|\n|[^\s0-9A-Za-z\x80-\xff]+")


def index_vectors() -> np.ndarray:
    """A fixed sparse ternary vector per word bucket."""
    draw = np.random.default_rng(SEED)
    out = np.zeros((1 << WORD_BITS, DIMENSIONS), dtype=np.float32)
    for row in out:
        row[draw.choice(DIMENSIONS, NONZERO, replace=False)] = draw.choice([-1.0, 1.0], NONZERO)
    return out


def _buckets(hashes: WordHashes, text: str | None) -> np.ndarray:
    words = TOKEN.findall((text or "").encode("utf-8", "replace"))
    return (hashes(words) >> np.uint64(64 - WORD_BITS)).astype(np.int64)


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per word bucket of a partition: occurrences and the sum of its neighbours' index vectors."""
    hashes, index = WordHashes(), index_vectors()
    total = np.zeros(index.shape, dtype=np.float64)
    count = np.zeros(len(index), dtype=np.int64)
    for batch in slices(batches, 128):
        ids = [_buckets(hashes, t) for t in batch.column("text").to_pylist()]
        gap = np.full(WINDOW, -1)  # keeps neighbours of different texts apart
        flat = np.concatenate([x for i in ids for x in (i, gap)] + [gap])
        vectors = np.where(flat[:, None] >= 0, index[flat], np.float32(0))
        near = np.zeros_like(vectors)
        for step in range(1, WINDOW + 1):
            near[step:] += vectors[:-step]
            near[:-step] += vectors[step:]
        order = np.argsort(flat, kind="stable")
        order = order[np.searchsorted(flat[order], 0) :]
        if len(order):
            ranked = flat[order]
            starts = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]]))
            total[ranked[starts]] += np.add.reduceat(near[order], starts, axis=0)
            count += np.bincount(ranked, minlength=len(count))
    at = np.flatnonzero(count)
    columns = {"bucket": pa.array(at.astype(np.int32)), "n": pa.array(count[at])}
    columns |= {f"v{i}": pa.array(total[at, i].astype(np.float32)) for i in range(DIMENSIONS)}
    yield from pa.table(columns).to_batches(max_chunksize=4096)


@dataclass
class Network:
    """Word vectors, the two layers and the temperature."""

    vectors: np.ndarray  # (buckets, dimensions)
    weights: np.ndarray  # (buckets,): frequent words count less
    layers: list[np.ndarray] | None = None
    mean: np.ndarray | None = None
    spread: np.ndarray | None = None
    temperature: float = 1.0

    def pooled(self, hashes: WordHashes, text: str | None) -> np.ndarray:
        """Weighted mean, plain mean and largest entries of the word vectors, and their spread."""
        ids = _buckets(hashes, text)
        size = self.vectors.shape[1]
        if not len(ids):
            return np.zeros(3 * size, dtype=np.float32)
        v, w = self.vectors[ids], self.weights[ids]
        plain = v.mean(axis=0)
        return np.concatenate([(w @ v) / w.sum(), plain, np.sqrt(np.maximum((v * v).mean(axis=0) - plain**2, 0))])

    def logits(self, x: np.ndarray) -> np.ndarray:
        a, b, c, d = self.layers
        return np.tanh((x - self.mean) / self.spread @ a + b) @ c + d

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -30, 30)))


def word_vectors(docs: DataFrame) -> Network:
    """Random indexing over all texts: each task sums its own contexts, so shuffle and
    model are bounded by the buckets."""
    names = [f"v{i}" for i in range(DIMENSIONS)]
    schema = "bucket int, n bigint, " + ", ".join(f"{c} float" for c in names)
    summed = docs.select("text").mapInArrow(_contexts, schema).groupBy("bucket").agg(
        F.sum("n").alias("n"), *[F.sum(c).alias(c) for c in names]
    )
    frame = fetched(summed)
    size = 1 << WORD_BITS
    vectors, count = index_vectors().astype(np.float64), np.zeros(size)
    count[frame.bucket] = frame.n
    # a word's vector: its own index vector and its normalised contexts
    contexts = frame[names].to_numpy(float)
    contexts -= np.outer(frame.n, contexts.sum(axis=0) / max(1, frame.n.sum()))
    norm = np.linalg.norm(contexts, axis=1, keepdims=True)
    vectors /= np.sqrt(NONZERO)
    vectors[frame.bucket] += contexts / np.maximum(norm, 1e-9)
    share = count / max(1.0, count.sum())
    return Network(vectors.astype(np.float32), (1e-3 / (1e-3 + share)).astype(np.float32))


def _pool(rows: DataFrame, model: Network) -> DataFrame:
    """(label, fold, vector) of every row of (label, fold, text)."""
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, known = WordHashes(), shared.value
        for batch in slices(batches):
            vectors = [known.pooled(hashes, t) for t in batch.column("text").to_pylist()]
            yield pa.record_batch(
                [batch.column("label"), batch.column("fold"), pa.array(vectors, pa.list_(pa.float32()))],
                ["label", "fold", "vector"],
            )

    return rows.select("label", "fold", "text").mapInArrow(run, "label int, fold int, vector array<float>")


def _fit(model: Network, x: np.ndarray, y: np.ndarray) -> None:
    """Two layers by Adam on the logistic loss."""
    draw = np.random.default_rng(SEED)
    model.mean, model.spread = x.mean(axis=0), x.std(axis=0) + 1e-3
    z = (x - model.mean) / model.spread
    a = draw.normal(0, 1 / np.sqrt(z.shape[1]), (z.shape[1], HIDDEN))
    c = draw.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN)
    p = [a, np.zeros(HIDDEN), c, np.zeros(1)]
    first, second, step = [np.zeros_like(q) for q in p], [np.zeros_like(q) for q in p], 0
    for _ in range(EPOCHS):
        order = draw.permutation(len(z))
        for at in range(0, len(z), BATCH):
            rows = order[at : at + BATCH]
            hidden = np.tanh(z[rows] @ p[0] + p[1])
            error = (1 / (1 + np.exp(-np.clip(hidden @ p[2] + p[3], -30, 30))) - y[rows]) / len(rows)
            back = np.outer(error, p[2]) * (1 - hidden**2)
            gradients = [z[rows].T @ back + 1e-4 * p[0], back.sum(axis=0), hidden.T @ error + 1e-4 * p[2], error.sum(keepdims=True)]
            step += 1
            for q, g, m, v in zip(p, gradients, first, second):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                q -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    model.layers = p


def _temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """The temperature with the least log loss on rows that the layers have not seen."""
    tried = np.exp(np.linspace(-1.5, 2.5, 81))
    loss = [np.mean(np.logaddexp(0, np.where(y > 0.5, -1, 1) * logits / t)) for t in tried]
    return float(tried[int(np.argmin(loss))])


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", most: int = LABELLED_ROWS) -> Network:
    """Word vectors from all texts; the network from labelled rows outside the held-out
    fold, at most ``most`` in expectation; the temperature from another fold of these."""
    model = word_vectors(docs)
    marked = pinned(labelled(labels, label, most), "quality-labels")
    rows = docs.select("doc_id", "text").join(F.broadcast(marked), "doc_id").select("label", "fold", "text")
    seen = fetched(_pool(rows, model))
    x = np.array(seen.vector.tolist(), dtype=np.float32).reshape(len(seen), 3 * DIMENSIONS)
    y, tune = seen.label.to_numpy(float), (seen.fold == CALIBRATE).to_numpy()
    if len(set(y[~tune])) < 2:  # nothing to tell apart: the share of label 1 is all that is known
        share = (y.sum() + 1) / (len(y) + 2)
        model.mean, model.spread = np.zeros(x.shape[1]), np.ones(x.shape[1])
        model.layers = [np.zeros((x.shape[1], 1)), np.zeros(1), np.zeros(1), np.array([np.log(share / (1 - share))])]
        return model
    _fit(model, x[~tune], y[~tune])
    if tune.any():
        model.temperature = _temperature(model.logits(x[tune]), y[tune])
    return model


def score(docs: DataFrame, model: Network) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row.

    * Null or empty text, or one without words: the score of the zero vector.
    * Null or repeated ids: rows are scored one by one. Empty table: no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, known = WordHashes(), shared.value
        for batch in slices(batches):
            vectors = [known.pooled(hashes, t) for t in batch.column("text").to_pylist()]
            rated = known.score(np.array(vectors)) if vectors else np.zeros(0)
            yield pa.record_batch([batch.column("doc_id"), pa.array(rated, pa.float64())], ["doc_id", "score"])

    rated = docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double")
    return rated.select(
        "doc_id",
        (fold_of(F.col("doc_id")) == HELD_OUT).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )
