"""Ranked lexical search on an index stratified by document length."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from math import ceil, log

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import few_rows, fetched, pinned, slices

#: Bounds of a segment: a stratum is stored in pieces of at most so many documents, and of
#: about so many postings (one long document may exceed them).
SEGMENT_DOCS, SEGMENT_POSTINGS = 2048, 1 << 17
#: Postings per task of the index.
TASK_POSTINGS = 1_000_000
#: Items that are looked up together, and their terms: what a task holds of the queries.
BLOCK_ITEMS, BLOCK_TERMS = 256, 20_000
#: Segments that go to a task's Python worker at a time.
AT_A_TIME = 4
#: Cells of the impact matrix that a task fills at a time.
CELLS = 1 << 20
#: Share of strata, by an item's bounds, that the first visit leaves for later ones.
LATER = (0.9,)
TOP = 20

_TABLE = bytes(
    i + 32 if 65 <= i <= 90 else i if i >= 128 or 48 <= i <= 57 or 97 <= i <= 122 else 32 for i in range(256)
)


def terms_of(text: bytes | None) -> list[bytes]:
    """Terms of a UTF-8 text: runs of ASCII letters and digits and of anything beyond ASCII, A-Z in lower case."""
    return (text or b"").translate(_TABLE).split()


def forward(rows: DataFrame, key: str, text: str, label: str) -> DataFrame:
    """(id, place, n, terms, tfs) of every row with a term, written once: one pass over the texts.

    ``place`` tells rows apart; it is pinned by the writing. ``terms`` is one string, the
    distinct terms with a space between: an array of short strings takes several times the
    room in a shuffle.
    """
    kind = dict(rows.dtypes)[key]
    source = rows.select(F.col(key).alias("id"), F.monotonically_increasing_id().alias("place"), F.col(text).cast("binary").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            at, sizes, ends, terms, tfs = [], [], [0], [], []
            for i, body in enumerate(batch.column("text").to_pylist()):
                found = Counter(terms_of(body))
                if found:
                    at.append(i)
                    terms.append(b" ".join(found))
                    tfs.extend(found.values())
                    ends.append(len(tfs))
                    sizes.append(sum(found.values()))
            ends = pa.array(ends, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("id").take(pa.array(at, pa.int64())),
                    batch.column("place").take(pa.array(at, pa.int64())),
                    pa.array(sizes, pa.int64()),
                    pa.array(terms, pa.binary()).cast(pa.string()),
                    pa.ListArray.from_arrays(ends, pa.array(tfs, pa.int32())),
                ],
                ["id", "place", "n", "terms", "tfs"],
            )

    shape = f"id {kind}, place bigint, n bigint, terms string, tfs array<int>"
    return pinned(source.mapInArrow(run, shape), label)


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order of m, gathered into segments of one stratum each."""
    held: list[pa.RecordBatch] = []
    docs = postings = 0
    stratum = None

    def segment() -> pa.RecordBatch:
        flat = pa.concat_arrays([pc.split_pattern(b.column("terms"), " ").flatten() for b in held]).dictionary_encode()
        tfs = np.concatenate([b.column("tfs").flatten().to_numpy() for b in held])
        sizes = np.concatenate([pc.list_value_length(b.column("tfs")).to_numpy() for b in held])
        codes = flat.indices.to_numpy()
        where = np.repeat(np.arange(docs, dtype=np.int32), sizes)
        order = np.lexsort((where, -tfs, codes))  # postings of a term by falling tf
        codes, tfs, where = codes[order], tfs[order], where[order]
        first = np.flatnonzero(np.diff(codes, prepend=-1))

        def one(values: pa.Array) -> pa.ListArray:
            return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)

        counts = np.diff(first, append=len(codes)).astype(np.int32)
        columns = [
            pa.array([stratum], pa.int64()),
            one(pa.concat_arrays([b.column("id") for b in held])),
            pc.binary_join(one(flat.dictionary), " "),
            one(pa.array(counts)),
            one(pa.array(tfs[first])),
            one(pa.array(tfs)),
            one(pa.array(where)),
        ]
        return pa.RecordBatch.from_arrays(columns, ["m", "docs", "terms", "counts", "tops", "tfs", "places"])

    for batch in batches:
        ms = batch.column("m").to_numpy()
        lengths = pc.list_value_length(batch.column("tfs")).to_numpy()
        start = 0
        while start < len(ms):
            if held and (ms[start] != stratum or docs >= SEGMENT_DOCS or postings >= SEGMENT_POSTINGS):
                yield segment()
                held, docs, postings = [], 0, 0
            stratum = int(ms[start])
            own = int(np.searchsorted(ms[start:], stratum, side="right"))
            room = int(np.searchsorted(np.cumsum(lengths[start : start + own]), SEGMENT_POSTINGS - postings)) + 1
            taken = min(own, room, SEGMENT_DOCS - docs)
            held.append(batch.slice(start, taken))
            docs, postings, start = docs + taken, postings + int(lengths[start : start + taken].sum()), start + taken
    if held:
        yield segment()


def build_index(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The index, written below the shared folder: one row per segment of a stratum.

    A stratum is all documents of one length normaliser m = 75 + (25 * n * N) div L.
    A segment row is (m, docs, terms, counts, tops, tfs, places): its document ids, its
    terms, how many documents hold each, the largest tf of each, and the postings of all
    terms one after another, by falling tf. Rows are dealt by ranges of (m, place), so a
    stratum with a third of all documents is cut into many tasks.

    * Null and empty texts, texts without a term: not in the index and not counted.
    * Repeated rows and ids: a document each. Null ids are kept. Empty table: no rows.
    """
    rows = forward(docs, key, text, "ranked-forward")
    size = rows.agg(F.count("*").alias("docs"), F.sum("n").alias("words"), F.sum(F.size("tfs")).alias("postings")).first()
    words = size.words or 1
    kind = dict(docs.dtypes)[key]
    m = 75 + F.expr(f"(25 * n * {size.docs}L) div {words}L")
    tasks = max(1, ceil((size.postings or 0) / TASK_POSTINGS))
    dealt = rows.withColumn("m", m).repartitionByRange(tasks, "m", "place").sortWithinPartitions("m", "place")
    shape = f"m bigint, docs array<{kind}>, terms string, counts array<int>, tops array<int>, tfs array<int>, places array<int>"
    segments = dealt.select("m", "id", "terms", "tfs").mapInArrow(_segments, shape)
    # a page holds many whole segments; the default codec would keep it in direct memory, out of the heap's sight
    return pinned(segments, "ranked-segments", compression="zstd")


def impacts(tfs: np.ndarray, m: int) -> np.ndarray:
    """Impact of every tf in stratum m; computed once per distinct tf."""
    distinct, at = np.unique(tfs, return_inverse=True)
    wide = distinct.astype(np.int64)
    return ((1_000_000_000 * wide) // (1000 * wide + 12 * m))[at]


def _known(segment: dict, vocabulary: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Positions in a segment's terms and in the vocabulary of the terms they share."""
    terms = pc.split_pattern(segment["terms"], " ").values
    found = pc.fill_null(pc.index_in(terms, value_set=vocabulary), -1).to_numpy()
    at = np.flatnonzero(found >= 0)
    return at, found[at]


def _rows(batch: pa.RecordBatch) -> Iterator[dict]:
    for i in range(batch.num_rows):
        out = {}
        for name in batch.schema.names:
            value = batch.column(name)[i]
            out[name] = value.values if isinstance(value, pa.ListScalar) else value if name == "terms" else value.as_py()
        yield out


def document_counts(index: DataFrame, vocabulary: list[str]) -> np.ndarray:
    """Number of documents that hold each term of a bounded vocabulary."""
    shared = index.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = pa.array(shared.value, pa.string())
        total = np.zeros(len(words), np.int64)
        for batch in batches:
            for segment in _rows(batch):
                at, term = _known(segment, words)
                total[term] += segment["counts"].to_numpy()[at]
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["term", "n"])

    parts = index.select("terms", "counts").mapInArrow(run, "term bigint, n bigint")
    found = fetched(parts.groupBy("term").agg(F.sum("n").alias("n")))
    out = np.zeros(len(vocabulary), np.int64)
    out[found.term] = found.n
    return out


class _Bounds:
    """The most that a document of a segment can score for every item."""

    def __init__(self, vocabulary: list[str], weights: np.ndarray):
        self.words, self.weights = pa.array(vocabulary, pa.string()), weights

    def __call__(self, segment: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        at, term = _known(segment, self.words)
        best = impacts(segment["tops"].to_numpy()[at], segment["m"])
        return at, term, self.weights[:, term] @ best.astype(self.weights.dtype)


def _cutoffs(index: DataFrame, shared, items: int, shares: tuple[float, ...]) -> np.ndarray:
    """Per item, bounds that ``shares`` of the segments stay below."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bounds = _Bounds(*shared.value)
        for batch in batches:
            for segment in _rows(batch):
                *_, bound = bounds(segment)
                at = np.flatnonzero(bound > 0)
                yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(bound[at].astype(np.int64))], ["item", "bound"])

    parts = index.select("m", "terms", "tops").mapInArrow(run, "item bigint, bound bigint")
    cut = F.percentile_approx("bound", F.array(*[F.lit(s) for s in shares]), F.lit(1000))
    out = np.ones((len(shares), items), np.int64)
    for row in parts.groupBy("item").agg(cut.alias("cuts")).collect():  # a row per item of the block
        out[:, row["item"]] = np.maximum(row.cuts, 1)
    return out


def _best(scores: np.ndarray, ids: pa.Array, top: int) -> np.ndarray:
    """Positions of the ``top`` highest scores, equal ones by id, null ids last."""
    if len(scores) > top:
        edge = -np.partition(-scores, top - 1)[top - 1]
        at = np.flatnonzero(scores >= edge)
    else:
        at = np.arange(len(scores))
    table = pa.table({"score": pa.array(scores[at]), "id": ids.take(pa.array(at)), "at": pa.array(at)})
    order = pc.sort_indices(table, sort_keys=[("score", "descending"), ("id", "ascending")])
    return at[order.to_numpy()[:top]]


def _visit(index: DataFrame, shared, low: np.ndarray, high: np.ndarray | None, least: np.ndarray, top: int, kind: str) -> DataFrame:
    """(item, id, score): scores from ``least`` on in the segments with low <= bound < high.

    A task keeps the ``top`` best of each item and passes segments whose bound cannot
    reach the last of them.
    """
    limits = index.sparkSession.sparkContext.broadcast((low, high, least))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bounds, (low, high, least) = _Bounds(*shared.value), limits.value
        floor = least.copy()
        kept: dict[int, tuple[np.ndarray, pa.Array]] = {}
        for batch in batches:
            for segment in _rows(batch):
                at, term, bound = bounds(segment)
                want = (bound >= low) & (bound >= floor)
                if high is not None:
                    want &= bound < high
                items = np.flatnonzero(want)
                if not len(items) or not len(at):
                    continue
                ids = segment["docs"]
                ends = np.cumsum(segment["counts"].to_numpy())
                counts = segment["counts"].to_numpy()[at]
                # postings of the terms asked for, and the row of each in the matrix
                line = np.repeat(np.arange(len(at)), counts)
                post = np.repeat(ends[at] - counts, counts) + np.arange(len(line)) - np.repeat(np.cumsum(counts) - counts, counts)
                place = segment["places"].to_numpy()[post]
                impact = impacts(segment["tfs"].to_numpy()[post], segment["m"]).astype(bounds.weights.dtype)
                weights = bounds.weights[items][:, term]
                step = max(1, CELLS // len(at))
                for start in range(0, len(ids), step):
                    inside = (place >= start) & (place < start + step)
                    cells = np.zeros((len(at), min(step, len(ids) - start)), bounds.weights.dtype)
                    cells[line[inside], place[inside] - start] = impact[inside]
                    scores = (weights @ cells).astype(np.int64)
                    own = ids[start : start + step]
                    for row, item in zip(scores, items.tolist()):
                        good = np.flatnonzero(row >= floor[item])
                        if not len(good):
                            continue
                        values, names = row[good], own.take(pa.array(good))
                        if item in kept:
                            values = np.concatenate([kept[item][0], values])
                            names = pa.concat_arrays([kept[item][1], names])
                        best = _best(values, names, top)
                        kept[item] = values[best], names.take(pa.array(best))
                        if len(best) == top:
                            floor[item] = max(floor[item], int(kept[item][0][-1]))
        for item, (values, names) in kept.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(values), item, np.int64)), names, pa.array(values)], ["item", "id", "score"]
            )

    return pinned(index.mapInArrow(run, f"item bigint, id {kind}, score bigint"), "ranked-hits")


def _ranked(hits: DataFrame, top: int) -> DataFrame:
    order = Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("id").asc_nulls_last())
    return hits.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)


def _search_block(index: DataFrame, block: list, docs: int, top: int, kind: str) -> DataFrame:
    """(item, id, score, rank) of a block of items, which are rows of (id, terms, tfs)."""
    vocabulary = sorted({t for row in block for t in row.terms.split(" ")})
    at = {t: i for i, t in enumerate(vocabulary)}
    df = document_counts(index, vocabulary)
    w = np.array([int(1000 * log((2 * docs + 2) / (2 * int(n) + 1))) for n in df], np.int64)
    weights = np.zeros((len(block), len(vocabulary)), np.int64)
    for i, row in enumerate(block):
        for t, q in zip(row.terms.split(" "), row.tfs):
            weights[i, at[t]] = q * w[at[t]]
    if int(weights.sum(axis=1).max()) * 1_000_000 < 1 << 53:
        weights = weights.astype(np.float64)  # sums of whole numbers below 2^53 stay exact
    shared = index.sparkSession.sparkContext.broadcast((vocabulary, weights))
    hits = high = None
    least = np.ones(len(block), np.int64)
    for low in sorted(_cutoffs(index, shared, len(block), LATER), key=lambda c: -int(c.sum())):
        found = _visit(index, shared, low, high, least, top, kind)
        hits, high = found if hits is None else hits.unionByName(found), low
    last = _ranked(hits, top).groupBy("item").agg(F.count("*").alias("n"), F.min("score").alias("score"))
    for row in last.filter(F.col("n") >= top).collect():  # a row per item of the block
        least[row["item"]] = row.score
    # an equal score can still win by its id, so bounds equal to the last score are visited
    rest = _visit(index, shared, least, high, least, top, kind)
    return _ranked(hits.unionByName(rest), top)


def search(
    spark: SparkSession, index: DataFrame, items: DataFrame, key: str = "item_id", text: str = "text", top: int = TOP,
    doc_key: str = "doc_id",
) -> DataFrame:
    """(key, rank, doc_key, score): the ``top`` best documents of every item, exact.

    Items are taken in blocks of bounded size, each a few passes over the index. A
    segment's bound for an item is the sum of its terms' weights times the impact of
    their largest tf there. Segments with the highest bounds are visited first; then
    only those whose bound reaches the item's last place. Nothing else is cut.

    * Items without a term or a match: no rows. Null ids are kept; every item row is
      answered by itself, so an id that occurs twice has two lists.
    * Equal scores: smaller id first, null ids last. Empty index or items: no rows.
    """
    asked = forward(items, key, text, "ranked-items")
    about = asked.agg(F.count("*").alias("n"), F.sum(F.size("tfs")).alias("terms")).first()
    blocks = max(1, ceil(about.n / BLOCK_ITEMS), ceil((about.terms or 0) / BLOCK_TERMS))
    docs = index.agg(F.sum(F.size("docs"))).first()[0] or 0
    kind = dict(index.dtypes)["docs"].removeprefix("array<").removesuffix(">")
    item_kind = dict(items.dtypes)[key]
    out = spark.createDataFrame([], f"`{key}` {item_kind}, rank int, `{doc_key}` {kind}, score bigint")
    for number in range(blocks if docs else 0):
        block = asked.filter(F.pmod(F.xxhash64("place"), F.lit(blocks)) == number).select("id", "terms", "tfs").collect()
        if not block:
            continue
        with few_rows(spark, AT_A_TIME):
            ranks = _search_block(index, block, docs, top, kind)
        names = spark.createDataFrame([(i, row.id) for i, row in enumerate(block)], f"item bigint, name {item_kind}")
        found = ranks.join(F.broadcast(names), "item")  # a block of items
        out = out.unionByName(found.select(F.col("name").alias(key), "rank", F.col("id").alias(doc_key), "score"))
    return out
