"""Approximate nearest neighbours over learned partitions."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import fetched, pinned

#: Expected bounds: vectors the partitions are learned from, queries that set the number of probes.
SAMPLE, TUNING = 4_000, 200
#: Neighbours in the graph, and how much a partition may exceed its even share.
GRAPH_NEIGHBOURS, SLACK = 10, 1.1
#: Recall that the probes reach on the tuning queries, measured against all rows.
TARGET = 0.96
#: Rows of a block of candidates, and queries that meet it at once.
BLOCK_ROWS, BLOCK_QUERIES = 4_096, 1_024
HIDDEN, EPOCHS, SEED = 64, 40, 3


def usable(vectors: DataFrame, vector: str = "embedding") -> DataFrame:
    """(vec_id, v) of the vectors that take part: not null, not zero, only finite
    components, and of the most frequent length (the smaller of equals)."""
    v = F.col(vector).cast("array<double>")
    finite = F.forall(v, lambda x: F.coalesce((F.abs(x) < float("inf")) & ~F.isnan(x), F.lit(False)))
    sound = vectors.filter(v.isNotNull() & (F.size(v) > 0)).filter(finite & F.exists(v, lambda x: x != 0))
    rows = sound.select("vec_id", v.alias("v"))
    length = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return rows.filter(F.size("v") == (length[0] if length else 0))


def _drawn(rows: DataFrame, total: int, most: int, salt: int) -> np.ndarray:
    """About ``most`` vectors (all, if there are fewer), drawn by a hash of the id."""
    part = min(1.0, most / max(1, total))
    picked = rows.filter(F.pmod(F.xxhash64(F.lit(salt), "vec_id"), F.lit(1_000_000)) < int(part * 1_000_000))
    return np.array([r[0] for r in picked.orderBy("vec_id").select("v").collect()], dtype=np.float64)


def neighbour_graph(x: np.ndarray, k: int = GRAPH_NEIGHBOURS) -> np.ndarray:
    """The ``k`` nearest of every sample vector."""
    k = min(k, len(x) - 1)
    near = []
    squares = (x * x).sum(axis=1)
    for at in range(0, len(x), 500):
        d = squares[None, :] - 2 * x[at : at + 500] @ x.T
        d[np.arange(len(d)), at + np.arange(len(d))] = np.inf
        near.append(np.argpartition(d, k - 1, axis=1)[:, :k] if k > 0 else np.zeros((len(d), 0), int))
    return np.concatenate(near)


def balanced_parts(x: np.ndarray, graph: np.ndarray, parts: int) -> np.ndarray:
    """Partition of the graph into parts of at most ``SLACK`` times the even share.

    Parts start as balanced cells around drawn centres; then vertices move to the
    part that holds most of their neighbours while it has room, in some passes.
    """
    draw = np.random.default_rng(SEED)
    room = int(np.ceil(len(x) / parts * SLACK))
    centres = x[draw.choice(len(x), parts, replace=False)]
    for _ in range(6):
        d = (centres * centres).sum(axis=1)[None, :] - 2 * x @ centres.T
        ranks = np.argsort(d, axis=1)
        sure = np.sort(d, axis=1)
        order = np.argsort(sure[:, 0] - sure[:, min(1, parts - 1)])
        own, free = np.full(len(x), -1), np.full(parts, room)
        for i in order:
            for p in ranks[i]:
                if free[p]:
                    own[i], free[p] = p, free[p] - 1
                    break
        centres = np.array([x[own == p].mean(axis=0) if (own == p).any() else centres[p] for p in range(parts)])
    for _ in range(4):
        moved = 0
        for i in draw.permutation(len(x)):
            votes = np.bincount(own[graph[i]], minlength=parts)
            best = int(votes.argmax())
            if votes[best] > votes[own[i]] and free[best]:
                free[own[i]] += 1
                free[best] -= 1
                own[i], moved = best, moved + 1
        if not moved:
            break
    return own


@dataclass
class Router:
    """A small classifier from vectors to parts."""

    layers: list[np.ndarray]
    parts: int
    probes: int = 1

    def logits(self, x: np.ndarray) -> np.ndarray:
        a, b, c, d, e = self.layers
        return np.maximum(x @ a + b, 0) @ c + x @ d + e

    def ranked(self, x: np.ndarray) -> np.ndarray:
        """Parts of every row, most probable first (ties to the smaller number)."""
        return np.argsort(-self.logits(x), axis=1, kind="stable")


def fit_router(x: np.ndarray, graph: np.ndarray, own: np.ndarray, parts: int) -> Router:
    """Softmax network that learns where a vector and its neighbours are."""
    draw = np.random.default_rng(SEED)
    goal = np.zeros((len(x), parts))
    goal[np.arange(len(x)), own] = 1
    for column in graph.T:
        goal[np.arange(len(x)), own[column]] += 1 / max(1, graph.shape[1])
    goal /= goal.sum(axis=1, keepdims=True)
    size, scale = x.shape[1], 1 / max(1e-12, np.sqrt((x * x).sum(axis=1).mean()))
    z = x * scale
    p = [
        draw.normal(0, np.sqrt(2 / size), (size, HIDDEN)), np.zeros(HIDDEN),
        draw.normal(0, 0.05, (HIDDEN, parts)), np.zeros((size, parts)), np.zeros(parts),
    ]
    first, second, step = [np.zeros_like(q) for q in p], [np.zeros_like(q) for q in p], 0
    for _ in range(EPOCHS):
        order = draw.permutation(len(z))
        for at in range(0, len(z), 128):
            rows = order[at : at + 128]
            hidden = np.maximum(z[rows] @ p[0] + p[1], 0)
            out = hidden @ p[2] + z[rows] @ p[3] + p[4]
            out = np.exp(out - out.max(axis=1, keepdims=True))
            error = (out / out.sum(axis=1, keepdims=True) - goal[rows]) / len(rows)
            back = (error @ p[2].T) * (hidden > 0)
            gradients = [z[rows].T @ back, back.sum(axis=0), hidden.T @ error, z[rows].T @ error, error.sum(axis=0)]
            step += 1
            for q, g, m, v in zip(p, gradients, first, second):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                q -= 3e-3 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return Router([p[0] * scale, p[1], p[2], p[3] * scale, p[4]], parts)


def parts_for(rows: int) -> int:
    """Number of parts: with the square root of the rows, between 1 and 256."""
    return int(np.clip(round(np.sqrt(rows) / 8), 1, 256))


def learn_parts(rows: DataFrame, total: int) -> Router:
    """Sample, neighbour graph, balanced partition and router; all of bounded size."""
    x = _drawn(rows, total, SAMPLE, 1)
    parts = min(parts_for(total), max(1, len(x) // 8))
    if parts < 2:
        size = x.shape[1] if x.ndim == 2 else 1
        return Router([np.zeros((size, 1)), np.zeros(1), np.zeros((1, 1)), np.zeros((size, 1)), np.zeros(1)], 1)
    graph = neighbour_graph(x)
    return fit_router(x, graph, balanced_parts(x, graph, parts), parts)


def _vectors(batch_or_series) -> np.ndarray:
    return np.stack([np.asarray(v, dtype=np.float64) for v in batch_or_series])


def _routed(rows: DataFrame, router: Router, most: int, id_name: str) -> DataFrame:
    """(id, v, part, place) of the ``most`` most probable parts of every row."""
    shared = rows.sparkSession.sparkContext.broadcast(router)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            ranked = shared.value.ranked(_vectors(batch.column("v").to_pylist()))[:, :most]
            kept = ranked.shape[1]
            take = pa.array(np.repeat(np.arange(batch.num_rows), kept))
            yield pa.record_batch(
                [batch.column(id_name).take(take), batch.column("v").take(take), pa.array(ranked.ravel().astype(np.int32)),
                 pa.array(np.tile(np.arange(kept, dtype=np.int32), batch.num_rows))],
                [id_name, "v", "part", "place"],
            )

    return rows.select(id_name, "v").mapInArrow(run, f"{id_name} bigint, v array<double>, part int, place int")


def nearest(queries: tuple, candidates: tuple, k: int) -> list[tuple[int, int, float]]:
    """(query, candidate, distance) of the ``k`` nearest candidates of every query.

    A product of matrices finds a radius that is wide enough beyond rounding; what
    lies within is measured by differences in double precision, ties to the smaller id.
    """
    (qid, q), (cid, c) = queries, candidates
    out = []
    cc = (c * c).sum(axis=1)
    for at in range(0, len(q), 64):
        part = q[at : at + 64]
        d = (part * part).sum(axis=1)[:, None] + cc[None, :] - 2 * part @ c.T
        d[qid[at : at + 64, None] == cid[None, :]] = np.inf
        for i, row in enumerate(d):
            sound = int(np.isfinite(row).sum())
            if not sound:
                continue
            limit = np.partition(row, min(k, sound) - 1)[min(k, sound) - 1]
            slack = 1e-9 * (1 + (part[i] ** 2).sum() + cc.max())
            near = np.flatnonzero((row <= limit + slack) & np.isfinite(row))
            exact = np.sqrt(((c[near] - part[i]) ** 2).sum(axis=1))
            for j in np.lexsort((cid[near], exact))[:k]:
                out.append((int(qid[at + i]), int(cid[near[j]]), float(exact[j])))
    return out


def _best_of_blocks(queries: DataFrame, stored: DataFrame, k: int) -> DataFrame:
    """(query_id, vec_id, score): the best of each block for the queries that reach it.

    ``queries`` are (query_id, v, part), ``stored`` (vec_id, v, part). A part is cut
    into blocks by a hash of the ids, on both sides, so that a task holds one block
    of candidates and one of queries however large the part is.
    """
    spark = stored.sparkSession
    sizes = stored.groupBy("part").agg(F.count("*").alias("n")).join(
        queries.groupBy("part").agg(F.count("*").alias("m")), "part"
    )
    cut = sizes.select(
        "part", F.ceil(F.col("n") / BLOCK_ROWS).cast("int").alias("blocks"), F.ceil(F.col("m") / BLOCK_QUERIES).cast("int").alias("chunks")
    )
    table = {r["part"]: (r["blocks"], r["chunks"]) for r in cut.collect()}  # at most 256 parts
    if not table:
        return spark.createDataFrame([], "query_id bigint, vec_id bigint, score double")
    blocks = F.create_map(*[c for p, (b, _) in table.items() for c in (F.lit(p), F.lit(b))])
    chunks = F.create_map(*[c for p, (_, m) in table.items() for c in (F.lit(p), F.lit(m))])
    of = lambda m: F.coalesce(F.try_element_at(m, F.col("part")), F.lit(0))
    held = stored.withColumn("b_", of(blocks)).withColumn("m_", of(chunks)).filter("b_ > 0")
    held = held.select(
        "vec_id", "v", "part", F.pmod(F.xxhash64("vec_id"), F.col("b_").cast("long")).cast("int").alias("block"),
        F.explode(F.sequence(F.lit(0), F.col("m_") - 1)).alias("chunk"),
    )
    asked = queries.withColumn("b_", of(blocks)).withColumn("m_", of(chunks)).filter("b_ > 0")
    asked = asked.select(
        "query_id", "v", "part", F.explode(F.sequence(F.lit(0), F.col("b_") - 1)).alias("block"),
        F.pmod(F.xxhash64("query_id"), F.col("m_").cast("long")).cast("int").alias("chunk"),
    )

    def meet(asked: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        if not len(asked) or not len(held):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        found = nearest((asked.query_id.to_numpy(), _vectors(asked.v)), (held.vec_id.to_numpy(), _vectors(held.v)), k)
        return pd.DataFrame(found, columns=["query_id", "vec_id", "score"])

    keys = ["part", "block", "chunk"]
    return asked.groupBy(*keys).cogroup(held.groupBy(*keys)).applyInPandas(meet, "query_id bigint, vec_id bigint, score double")


def _tuned_probes(rows: DataFrame, stored: DataFrame, router: Router, total: int, k: int) -> int:
    """The fewest probes that reach ``TARGET`` recall on drawn queries.

    Their true neighbours come from all rows: a bounded number of queries against
    all blocks. A true neighbour is found if its part is among the probes.
    """
    part = min(1.0, TUNING / max(1, total))
    drawn = rows.filter(F.pmod(F.xxhash64(F.lit(2), "vec_id"), F.lit(1_000_000)) < int(part * 1_000_000) + 1)
    drawn = drawn.select(F.col("vec_id").alias("query_id"), "v")
    everywhere = F.array(*[F.lit(p) for p in range(router.parts)])
    found = _best_of_blocks(drawn.select("*", F.explode(everywhere).alias("part")), stored, k)
    best = found.withColumn("r_", F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))).filter(F.col("r_") <= k)
    home = stored.select("vec_id", "part")
    ranks = _routed(drawn, router, router.parts, "query_id").select("query_id", "part", "place")
    places = fetched(best.join(home, "vec_id").join(ranks, ["query_id", "part"]).groupBy("place").count())
    if not len(places):
        return router.parts
    counts = np.zeros(router.parts)
    counts[places.place] = places["count"]
    return int(np.searchsorted(np.cumsum(counts) / counts.sum(), TARGET) + 1)


def search(
    vectors: DataFrame, queries: Column, k: int = 10, vector: str = "embedding"
) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest found for every row of
    ``vectors`` (vec_id, vector) for which ``queries`` holds, over all other rows.

    ``score`` is the Euclidean distance in double precision. A bounded sample gives
    a neighbour graph, a balanced partition of it and a classifier; every vector is
    stored in its most probable part; a query goes to as many of its most probable
    parts as reach a recall of ``TARGET`` on drawn queries, measured against all rows.

    * Vectors null, empty, zero, with null or non-finite components or of another
      length than most take no part. Null ids take no part.
    * Repeated ids: none is a neighbour of a query of the same id; otherwise each
      row counts. Equal distances: smaller id first.
    * Fewer candidates than ``k``: all of them. Empty table: no rows.
    """
    rows = pinned(usable(vectors.filter(F.col("vec_id").isNotNull()), vector), "vectors")
    total = rows.count()
    router = learn_parts(rows, total)
    stored = pinned(_routed(rows, router, 1, "vec_id").drop("place"), "parts")
    router.probes = _tuned_probes(rows, stored, router, total, k) if router.parts > 1 else 1
    asked = rows.filter(queries).select(F.col("vec_id").alias("query_id"), "v")
    routed = _routed(asked, router, router.probes, "query_id").drop("place")
    found = _best_of_blocks(routed, stored, k)
    place = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(place)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
