"""Toxicity by class-conditional Kneser-Ney word models over shared counts of the whole corpus."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby, islice

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Temporary, WordHashes, few_rows, fetched, fold, pinned, slices

#: Expected bound of labelled rows a model learns from; beyond it a hash of the id draws them.
LABELLED_ROWS = 20_000
#: What counts lose to the backoff. A word pair that a class shows twice and a word that it shows
#: after three others are too rare to tell classes apart, so all they have goes to the backoff.
PAIR_DISCOUNT, WORD_DISCOUNT = 2, 3
#: Log gain over an unknown word from which a word is evidence, and the most it adds.
EVIDENCE, MOST_EVIDENCE = 1.15, 2.0
#: Words (or different pairs of them) that a counting task holds before it passes them on.
HELD = 1 << 21
#: Bits of a pair's digest by which pairs are dealt to tasks.
DEAL_BITS = 12
#: Rows of packed pairs, of some kilobytes each, that pass to or from a counting task at a time.
PACKED_ROWS = 512
FOLDS, HELD_OUT, CALIBRATE = 5, 0, 4
THRESHOLD = 0.5

_PUNCTUATION = bytes(32 if i < 48 or 57 < i < 65 or 90 < i < 97 or 122 < i < 128 else i for i in range(256))


def fold_of(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 5 (a null id counts as the empty text)."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % FOLDS


def labelled(labels: DataFrame, label: str, most: int = LABELLED_ROWS) -> DataFrame:
    """(doc_id, label, fold) of rows outside the held-out fold, one per id.

    The expected number of rows is ``most`` at the utmost, so they may be broadcast.
    Ids that occur more than once take the larger label; null ids or labels are left out.
    """
    rows = labels.filter(F.col("doc_id").isNotNull() & F.col(label).isNotNull())
    part = most / max(1, rows.count())
    if part < 1:
        rows = rows.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(part * 1_000_000))
    one = rows.groupBy("doc_id").agg(F.max(label).cast("int").alias("label"))
    return one.withColumn("fold", fold_of(F.col("doc_id")).cast("int")).filter(F.col("fold") != HELD_OUT)


def _words(text: str | None) -> list[bytes]:
    return (text or "").lower().encode("utf-8", "replace").translate(_PUNCTUATION).split()


def _pair(left: np.ndarray, word: np.ndarray) -> np.ndarray:
    """64-bit digest of a word and the one before it."""
    return fold(left * np.uint64(0x9E3779B97F4A7C15) + word)


def _sequence(hashes: WordHashes, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word digests of all texts, the digest before each (0 at a start), and words per text."""
    rows = [hashes(_words(t)) for t in texts]
    sizes = np.array([len(r) for r in rows], np.int64)
    words = np.concatenate([*rows, np.zeros(0, np.uint64)])
    left = np.concatenate([np.zeros(1, np.uint64), words])[: len(words)]
    left[(np.cumsum(sizes) - sizes)[sizes > 0]] = 0
    return words, left, sizes


def _class_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(left, word, n0, n1) of labelled texts, added up within a task."""
    hashes, held, size = WordHashes(), [], 0

    def flush() -> Iterator[pa.RecordBatch]:
        words, left, label = (np.concatenate(x) for x in zip(*held))
        _, first, at = np.unique(_pair(left, words), return_index=True, return_inverse=True)
        toxic = np.bincount(at, label, minlength=len(first)).astype(np.int64)
        every = np.bincount(at, minlength=len(first))
        columns = [left[first].view(np.int64), words[first].view(np.int64), every - toxic, toxic]
        yield from pa.table([pa.array(c) for c in columns], ["left", "word", "n0", "n1"]).to_batches(max_chunksize=8192)

    for batch in slices(batches):
        words, left, sizes = _sequence(hashes, batch.column("text").to_pylist())
        held.append((words, left, np.repeat(batch.column("label").to_numpy(), sizes)))
        size += len(words)
        if size >= HELD:
            yield from flush()
            held, size = [], 0
    if size:
        yield from flush()


def _packed(keys: np.ndarray, low: int) -> Iterator[tuple[int, bytes]]:
    """(deal, bytes) of sorted different keys: the first bits, and the steps between the lower
    ``low`` bits of the keys that share them, each in as many bytes as the widest step needs."""
    deals = keys >> low
    starts = np.flatnonzero(np.diff(deals, prepend=-1))
    for keys_of, deal in zip(np.split(keys & ((1 << low) - 1), starts[1:]), deals[starts]):
        steps = np.diff(keys_of, prepend=0)
        width = max(1, (int(steps.max()).bit_length() + 7) // 8)
        yield int(deal), bytes([width]) + steps.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def _unpacked(packed: bytes) -> np.ndarray:
    """The lower bits that :func:`_packed` has packed."""
    width = packed[0]
    steps = np.zeros(((len(packed) - 1) // width, 8), np.uint8)
    steps[:, :width] = np.frombuffer(packed, np.uint8, offset=1).reshape(-1, width)
    return np.cumsum(steps.view("<u8").ravel().astype(np.int64))


def _shared_counts(docs: DataFrame, words: np.ndarray) -> tuple[np.ndarray, int]:
    """Numbers of different words before each of ``words`` (sorted), and of different pairs in all texts.

    A task makes its pairs unique before they leave it, as one number each: the first bits
    of the pair's digest, the place of the word among ``words``, more bits of the digest.
    They leave in order, those that begin alike as the steps between them in one row, and
    are shuffled and sorted by these first bits. A task makes one such share of all pairs
    (a 4096th) unique after the other: what is gathered grows with the corpus and no
    counter can fill.
    """
    width = int(len(words)).bit_length()
    low = 63 - DEAL_BITS
    rest = low - width
    known = docs.sparkSession.sparkContext.broadcast(words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, held, size = WordHashes(), [], 0

        def out(keys: np.ndarray) -> Iterator[pa.RecordBatch]:
            rows = _packed(keys, low)
            while some := list(islice(rows, PACKED_ROWS)):
                deals, packed = zip(*some)
                yield pa.record_batch([pa.array(deals, pa.int32()), pa.array(packed, pa.binary())], ["deal", "packed"])

        for batch in slices(batches):
            found, left, _ = _sequence(hashes, batch.column("text").to_pylist())
            place = np.searchsorted(known.value, found)
            same = known.value[np.minimum(place, len(known.value) - 1)] == found if len(known.value) else np.zeros(len(found), bool)
            place = np.where(same, place, len(known.value)).astype(np.int64)
            pair = _pair(left, found)
            first, more = pair >> np.uint64(64 - DEAL_BITS), pair & np.uint64((1 << rest) - 1)
            held.append((first.astype(np.int64) << low) | (place << rest) | more.astype(np.int64))
            size += len(found)
            if size >= HELD:
                held = [np.unique(np.concatenate(held))]
                size = len(held[0])
                if size >= HELD // 2:
                    yield from out(held[0])
                    held, size = [], 0
        if size:
            yield from out(np.unique(np.concatenate(held)))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(len(known.value) + 1, np.int64)
        rows = ((d.as_py(), k.as_py()) for b in batches for d, k in zip(b.column("deal"), b.column("packed")))
        for _, same in groupby(rows, lambda row: row[0]):
            once = np.unique(np.concatenate([_unpacked(packed) for _, packed in same]))
            counts += np.bincount(once >> rest, minlength=len(counts))
        at = np.flatnonzero(counts)
        yield from pa.table([pa.array(at, pa.int32()), pa.array(counts[at])], ["place", "n"]).to_batches(max_chunksize=8192)

    with few_rows(docs.sparkSession, PACKED_ROWS):
        keys = docs.select("text").mapInArrow(run, "deal int, packed binary")
        dealt = keys.repartition("deal").sortWithinPartitions("deal").mapInArrow(count, "place int, n bigint")
        counts = fetched(pinned(dealt.groupBy("place").agg(F.sum("n").alias("n")), "toxicity-shared"))
    before = np.zeros(len(words), np.int64)
    own = counts.place < len(words)
    before[counts.place[own]] = counts.n[own]
    return before, int(counts.n.sum())


@dataclass
class Model:
    """Two word models over one shared distribution.

    The chance of a word after another in class c is
    ``top[c](left, word) + weight[c](left) * (kept[c](word) + mass[c] * shared(word))``:
    discounted pairs, what they leave, discounted words and what those leave, and the
    share of all different word pairs that end in the word. Pairs, contexts and words of
    which a class keeps nothing are not stored: they have top 0, weight 1 and kept 0.
    """

    words: np.ndarray  # digests, sorted
    kept: np.ndarray  # (2, words)
    shared: np.ndarray  # (words)
    mass: np.ndarray  # (2)
    lefts: np.ndarray  # digests, sorted
    weight: np.ndarray  # (2, lefts)
    pairs: np.ndarray  # (2, pairs): digests of left and word
    top: np.ndarray  # (2, pairs)
    bias: float = -2.0
    slopes: tuple = (1.0, 0.0, 0.0, 0.0)

    def chances(self, left: int, words: np.ndarray, shared: np.ndarray) -> np.ndarray:
        """(2, words) chances of words after ``left``, given their shared chances."""
        at, found = _find(self.words, words)
        low = np.where(found, self.kept[:, at], 0) + self.mass[:, None] * shared
        context, known = _find(self.lefts, np.full(1, left, np.uint64))
        weight = self.weight[:, context] if known[0] else np.ones((2, 1))
        keys = _pair(np.full(len(words), left, np.uint64), words)
        order = np.argsort(_pair(*self.pairs))
        at, found = _find(_pair(*self.pairs)[order], keys)
        return np.where(found, self.top[:, order][:, at], 0) + weight * low

    def gaps(self) -> dict:
        """What tasks need, as plain arrays: log ratios of toxic to ordinary chances."""
        low = self.kept + self.mass[:, None] * self.shared
        at, _ = _find(self.words, self.pairs[1])
        context, _ = _find(self.lefts, self.pairs[0])
        pair = self.top + self.weight[:, context] * low[:, at]
        keys = _pair(*self.pairs)
        order = np.argsort(keys)

        def gap(x: np.ndarray) -> np.ndarray:
            return (np.log(x[1]) - np.log(x[0])).astype(np.float32)

        return {
            "words": self.words, "word": gap(low), "unknown": float(np.log(self.mass[1] / self.mass[0])),
            "lefts": self.lefts, "left": gap(self.weight), "pairs": keys[order], "pair": gap(pair)[order],
        }

    def score(self, features: np.ndarray) -> np.ndarray:
        return _score(features, self.bias, self.slopes)


def _score(features: np.ndarray, bias: float, slopes: tuple) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(bias + features @ np.asarray(slopes), -30, 30)))


def _find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of ``wanted`` in sorted ``keys`` and whether they are there."""
    if not len(keys):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return at, keys[at] == wanted


def _looked_up(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray, other: float) -> np.ndarray:
    if not len(keys):
        return np.full(len(wanted), other)
    at, found = _find(keys, wanted)
    return np.where(found, values[at], other)


def features(known: dict, hashes: WordHashes, texts: list[str | None]) -> np.ndarray:
    """Per text: the log-likelihood ratio of toxic to ordinary by its length, and the evidence
    of single words beyond ``EVIDENCE`` by the length, as a root, and by the root of the length."""
    words, left, sizes = _sequence(hashes, texts)
    single = _looked_up(known["words"], known["word"], words, known["unknown"])
    gap = single + _looked_up(known["lefts"], known["left"], left, 0.0)
    at, found = _find(known["pairs"], _pair(left, words))
    if found.any():
        gap[found] = known["pair"][at[found]]
    over = np.clip(single - max(known["unknown"], 0.0) - EVIDENCE, 0, MOST_EVIDENCE)
    text = np.repeat(np.arange(len(texts)), sizes)
    total = np.bincount(text, gap, minlength=len(texts))
    evidence = np.bincount(text, over, minlength=len(texts))
    n = np.maximum(sizes, 1)
    return np.column_stack([total / n, evidence / n, np.sqrt(evidence), evidence / np.sqrt(n)])


def _build(texts: DataFrame, docs: DataFrame) -> Model:
    """Count the labelled (text, label), then what all documents share of the words kept.

    What reaches the driver are words, contexts and pairs that a class keeps after the
    discount: fewer than labelled words, which the sample of labels bounds.
    """
    pairs = texts.mapInArrow(_class_pairs, "left bigint, word bigint, n0 bigint, n1 bigint")
    pairs = pinned(pairs.groupBy("left", "word").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")), "toxicity-pairs")
    most = F.greatest("n0", "n1")
    words = pinned(
        pairs.groupBy("word").agg(
            F.count(F.when(F.col("n0") > 0, 1)).alias("c0"), F.count(F.when(F.col("n1") > 0, 1)).alias("c1"), F.max(most).alias("top")
        ),
        "toxicity-words",
    )
    contexts = pairs.groupBy("left").agg(
        *[F.sum(f"n{c}").alias(f"n{c}") for c in (0, 1)],
        *[F.sum(F.least(F.col(f"n{c}"), F.lit(PAIR_DISCOUNT))).alias(f"lost{c}") for c in (0, 1)],
        F.max(most).alias("top"),
    )
    sums = words.agg(*[F.sum(f(F.col(f"c{c}"))).alias(f"{n}{c}") for c in (0, 1) for n, f in (
        ("all", lambda x: x), ("lost", lambda x: F.least(x, F.lit(WORD_DISCOUNT))))]).first()
    kept_words = fetched(words.filter((F.greatest("c0", "c1") > WORD_DISCOUNT) | (F.col("top") > PAIR_DISCOUNT)).drop("top"))
    kept_pairs = fetched(pairs.filter(most > PAIR_DISCOUNT))
    kept_contexts = fetched(contexts.filter(F.col("top") > PAIR_DISCOUNT).drop("top"))

    def digests(column: pd.Series) -> np.ndarray:
        return column.to_numpy(np.int64).view(np.uint64)

    word, left = digests(kept_words.word), digests(kept_contexts.left)
    order, along = np.argsort(word), np.argsort(left)
    word, left = word[order], left[along]
    before, total = _shared_counts(docs, word)
    counts = kept_words[["c0", "c1"]].to_numpy(np.float64).T[:, order]
    every = np.array([sums.all0 or 0, sums.all1 or 0], np.float64)
    lost = np.array([sums.lost0 or 0, sums.lost1 or 0], np.float64)
    seen = kept_contexts[["n0", "n1"]].to_numpy(np.float64).T[:, along]
    given = kept_contexts[["lost0", "lost1"]].to_numpy(np.float64).T[:, along]
    pair = np.stack([digests(kept_pairs.left), digests(kept_pairs.word)])
    times = kept_pairs[["n0", "n1"]].to_numpy(np.float64).T
    at, _ = _find(left, pair[0])
    return Model(
        words=word,
        kept=np.maximum(counts - WORD_DISCOUNT, 0) / np.maximum(every, 1)[:, None],
        shared=before / max(total, 1),
        mass=np.where(every > 0, lost / np.maximum(every, 1), 1.0),
        lefts=left,
        weight=np.where(seen > 0, given / np.maximum(seen, 1), 1.0),
        pairs=pair,
        top=np.maximum(times - PAIR_DISCOUNT, 0) / np.maximum(seen[:, at], 1),
    )


def _fit_logistic(x: np.ndarray, y: np.ndarray, steps: int = 40) -> tuple[float, np.ndarray]:
    """Newton steps for a logistic fit with a ridge."""
    mean, spread = x.mean(axis=0), x.std(axis=0) + 1e-12
    z = np.column_stack([np.ones(len(x)), (x - mean) / spread])
    beta = np.zeros(z.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ beta, -30, 30)))
        gradient = z.T @ (p - y) + beta
        hessian = (z * (p * (1 - p))[:, None]).T @ z + np.eye(len(beta))
        step = np.linalg.solve(hessian, gradient)
        beta -= np.clip(step, -5, 5)
    slopes = beta[1:] / spread
    return float(beta[0] - slopes @ mean), slopes


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", most: int = LABELLED_ROWS) -> Model:
    """Learn from labelled rows outside the held-out fold and from all texts.

    The labelled ones give each class its counts of word pairs and of different words
    before a word; all documents give the distribution that both back off to. Another
    fold of labelled rows calibrates the score. Tables on the way to the model are removed.
    """
    with Temporary(docs.sparkSession):
        return _train(docs, labels, label, most)


def _train(docs: DataFrame, labels: DataFrame, label: str, most: int) -> Model:
    marked = pinned(labelled(labels, label, most), "toxicity-labels")
    learn = marked.filter(F.col("fold") != CALIBRATE).select("doc_id", "label")
    model = _build(docs.select("doc_id", "text").join(F.broadcast(learn), "doc_id").select("text", "label"), docs)
    tune = marked.filter(F.col("fold") == CALIBRATE).select("doc_id", "label")
    seen = _features(docs.select("doc_id", "text").join(F.broadcast(tune), "doc_id").select("label", "text"), "label", "int", model)
    fit = fetched(seen)
    if fit.label.nunique() == 2:
        bias, slopes = _fit_logistic(fit[_FEATURES].to_numpy(), fit.label.to_numpy(float))
        model.bias, model.slopes = bias, tuple(slopes)
    return model


_FEATURES = ["mean", "over_mean", "over_root", "over_by_root"]


def _features(rows: DataFrame, keep: str, kind: str, model: Model) -> DataFrame:
    """(keep, features) of every row of (keep, text)."""
    shared = rows.sparkSession.sparkContext.broadcast(model.gaps())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, known = WordHashes(), shared.value
        for batch in slices(batches):
            found = features(known, hashes, batch.column("text").to_pylist())
            yield pa.record_batch([batch.column(keep), *[pa.array(x) for x in found.T]], [keep, *_FEATURES])

    return rows.select(keep, "text").mapInArrow(run, f"{keep} {kind}, " + ", ".join(f"{x} double" for x in _FEATURES))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row.

    * Null or empty text, or one without words: the calibrated score of ratios of 0.
    * Null or repeated ids: rows are scored one by one. Empty table: no rows.
    """
    kind = dict(docs.dtypes)["doc_id"]
    seen = _features(docs.select("doc_id", "text"), "doc_id", kind, model)
    gap = sum((float(s) * F.col(x) for x, s in zip(_FEATURES, model.slopes)), F.lit(float(model.bias)))
    rated = seen.withColumn("score", 1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), gap)))))
    return rated.select(
        "doc_id",
        (fold_of(F.col("doc_id")) == HELD_OUT).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )


def drop_toxic(docs: DataFrame, model: Model) -> DataFrame:
    """The rows that the model does not call toxic, all columns as they are.

    * Null or empty text: kept or dropped as a text without words is rated.
    * Repeated rows and ids: each row by its own text. Empty table: no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast((model.gaps(), float(model.bias), tuple(float(x) for x in model.slopes)))

    @F.pandas_udf("double")
    def rate(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        hashes, (known, bias, slopes) = WordHashes(), shared.value
        for texts in batches:
            parts = [features(known, hashes, list(texts[i : i + 512])) for i in range(0, len(texts), 512)]
            yield pd.Series(_score(np.concatenate([*parts, np.zeros((0, 4))]), bias, slopes))

    return docs.filter(rate(F.col("text")) < THRESHOLD)
