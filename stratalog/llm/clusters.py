"""Centroid clustering on dictionaries of subvectors, exact in whole numbers."""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import few_rows, fetched, pinned

#: Vectors per chunk; a chunk has its own dictionaries, as a row group of a column store has.
CHUNK = 8192
#: Chunks that go to a task's Python worker at a time.
AT_A_TIME = 4
#: Scaled components stay below this, so that squared distances of thousands of dimensions fit 64 bits.
LARGEST = 1 << 25
CENTROIDS, ROUNDS, DIMS, SCALE = 40, 5, 64, 256

_CHUNKS = "ids array<{kind}>, blocks array<struct<first:int,width:int,entries:array<bigint>,codes:array<int>>>"


def usable(vector: Column, dims: int) -> Column:
    """Exactly ``dims`` components, none of them null or non-finite."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) != float("inf")))
    return F.coalesce((F.size(vector) == dims) & finite, F.lit(False))


def dictionaries(values: np.ndarray) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """(first dimension, distinct subvectors, code of every row) of blocks that cover all dimensions.

    Blocks begin one dimension wide. Neighbours are joined while the distances of the
    joint dictionary cost less than the sums over rows that one block fewer saves.
    """
    blocks = []
    for d in range(values.shape[1]):
        entries, codes = np.unique(values[:, d], return_inverse=True)
        blocks.append((d, entries[:, None], codes))
    grew = True
    while grew:
        grew, wider = False, []
        while blocks:
            first, left, x = blocks.pop(0)
            if blocks:
                _, right, y = blocks[0]
                width = left.shape[1] + right.shape[1]
                if max(len(left), len(right)) * width <= len(values):
                    pairs, codes = np.unique(x * len(right) + y, return_inverse=True)
                    if len(pairs) * width <= len(values):
                        joint = np.hstack([left[pairs // len(right)], right[pairs % len(right)]])
                        left, x, grew = joint, codes, True
                        blocks.pop(0)
            wider.append((first, left, x))
        blocks = wider
    return blocks


def encoded(vectors: DataFrame, key: str, vector: str, dims: int, scale: int) -> DataFrame:
    """The usable vectors as chunks of dictionary-encoded blocks, written once for all rounds."""
    kind = dict(vectors.dtypes)[key]
    rows = vectors.filter(usable(F.col(vector), dims)).select(F.col(key).alias("id"), F.col(vector).cast("array<double>").alias("v"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, values, held = [], [], 0

        def chunk(ids: pa.Array, values: np.ndarray) -> pa.RecordBatch:
            blocks = [
                {"first": first, "width": entries.shape[1], "entries": entries.ravel(), "codes": codes.astype(np.int32)}
                for first, entries, codes in dictionaries(values)
            ]
            item = pa.struct([("first", pa.int32()), ("width", pa.int32()), ("entries", pa.list_(pa.int64())), ("codes", pa.list_(pa.int32()))])
            held = pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids)
            return pa.RecordBatch.from_arrays([held, pa.array([blocks], pa.list_(item))], ["ids", "blocks"])

        for batch in batches:
            flat = batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)
            whole = np.floor(scale * flat)
            if len(whole) and np.abs(whole).max() >= LARGEST:
                raise ValueError(f"a scaled component reaches {LARGEST}: squared distances would not fit 64 bits")
            ids.append(batch.column("id"))
            values.append(whole.astype(np.int64))
            held += batch.num_rows
            if held >= CHUNK:
                every, all_ids = np.concatenate(values), pa.concat_arrays(ids)
                full = held - held % CHUNK
                for start in range(0, full, CHUNK):
                    yield chunk(all_ids[start : start + CHUNK], every[start : start + CHUNK])
                ids, values, held = [all_ids[full:]], [every[full:]], held - full
        if held:
            yield chunk(pa.concat_arrays(ids), np.concatenate(values))

    return pinned(rows.mapInArrow(run, _CHUNKS.format(kind=kind)), "cluster-chunks", compression="zstd")


def _blocks(row: pa.StructArray) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """The blocks of one chunk as arrays."""
    first, width, entries, codes = (row.field(name) for name in ("first", "width", "entries", "codes"))
    out = []
    for i in range(len(row)):
        w = width[i].as_py()
        table = entries[i].values.to_numpy(zero_copy_only=False).reshape(-1, w)
        out.append((first[i].as_py(), table, codes[i].values.to_numpy(zero_copy_only=False)))
    return out


def nearest(blocks: list, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Cluster and squared distance of every row of a chunk.

    A distinct subvector meets the centroids once; rows add up what their codes point at.
    """
    total = 0
    for first, entries, codes in blocks:
        gap = entries[:, None, :] - centroids[None, :, first : first + entries.shape[1]]
        total = total + (gap * gap).sum(axis=2)[codes]
    cluster = total.argmin(axis=1)  # the first of equal ones
    return cluster, total[np.arange(len(cluster)), cluster]


def _moved(chunks: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The centroids after one round; empty ones stay."""
    shared = chunks.sparkSession.sparkContext.broadcast(centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        k, dims = known.shape
        sums, counts = np.zeros((k, dims), np.int64), np.zeros(k, np.int64)
        for batch in batches:
            for row in batch.column("blocks"):
                blocks = _blocks(row.values)
                cluster, _ = nearest(blocks, known)
                counts += np.bincount(cluster, minlength=k)
                for first, entries, codes in blocks:
                    m, w = entries.shape
                    met = np.bincount(cluster * m + codes, minlength=k * m).reshape(k, m)
                    sums[:, first : first + w] += met @ entries
        at = np.flatnonzero(counts)
        columns = [pa.array(at.astype(np.int32)), pa.array(counts[at]), pa.array(list(sums[at]), pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays(columns, ["cluster", "n", "sums"])

    parts = chunks.select("blocks").mapInArrow(run, "cluster int, n bigint, sums array<bigint>")
    flat = parts.select("cluster", "n", F.posexplode("sums").alias("dim", "x"))
    found = fetched(flat.groupBy("cluster", "dim").agg(F.sum("n").alias("n"), F.sum("x").alias("x")))
    out = centroids.copy()
    out[found.cluster, found.dim] = found.x // found.n  # floors, of negative sums as well
    shared.destroy()
    return out


def seeds(vectors: DataFrame, key: str, vector: str, dims: int, scale: int, k: int, salt: str) -> np.ndarray:
    """The scaled vectors with the smallest digests of ``salt`` and their ids, in that order."""
    whole = F.transform(F.col(vector).cast("array<double>"), lambda x: F.floor(scale * x).cast("bigint"))
    named = F.concat(F.lit(salt), F.coalesce(F.col(key).cast("string"), F.lit("")))
    drawn = (
        vectors.filter(usable(F.col(vector), dims))
        .select(F.sha2(named, 256).alias("digest"), whole.alias("whole"))
        .orderBy("digest", "whole")
        .limit(k)
    )
    rows = drawn.collect()  # k rows
    return np.array([r.whole for r in rows], dtype=np.int64).reshape(-1, dims)


def cluster_vectors(
    vectors: DataFrame,
    key: str = "vec_id",
    vector: str = "embedding",
    k: int = CENTROIDS,
    rounds: int = ROUNDS,
    dims: int = DIMS,
    scale: int = SCALE,
    salt: str = "2:",
) -> DataFrame:
    """(key, cluster, distance, cluster_inertia, inertia, centroid_sha256) of every usable vector.

    Components become ``floor(scale * x)``; distances, sums and means are whole numbers,
    so the result does not depend on how rows are dealt. Vectors are written once as
    chunks in which each block of dimensions is a dictionary of its distinct subvectors
    and a code per row; nothing is lost by that. A round computes the distances of a
    chunk's distinct subvectors to all centroids once and adds them up by code; what
    leaves a task is one row per cluster, and the driver holds the centroids alone.

    * Null vectors, other lengths, null or non-finite components: no part, no row.
    * Null key: digest of the bare salt. Repeated rows: one row each; equal seeds by
      their components. Fewer vectors than ``k``: that many clusters.
    * Equal distances: the smaller number. A cluster without vectors keeps its centroid.
    * Scaled components from 2^25 on raise: their distances would not fit 64 bits.
    * Empty table: no rows. Other columns are not looked at.
    """
    spark = vectors.sparkSession
    kind = dict(vectors.dtypes)[key]
    names = "cluster int, distance bigint"
    centroids = seeds(vectors, key, vector, dims, scale, k, salt)
    if not len(centroids):
        return spark.createDataFrame([], f"`{key}` {kind}, {names}, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    chunks = encoded(vectors, key, vector, dims, scale)
    with few_rows(spark, AT_A_TIME):
        for _ in range(rounds):
            centroids = _moved(chunks, centroids)
    shared = spark.sparkContext.broadcast(centroids)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, row in zip(batch.column("ids"), batch.column("blocks")):
                cluster, distance = nearest(_blocks(row.values), shared.value)
                columns = [ids.values, pa.array(cluster.astype(np.int32)), pa.array(distance)]
                yield pa.RecordBatch.from_arrays(columns, ["id", "cluster", "distance"])

    with few_rows(spark, AT_A_TIME):
        assigned = pinned(chunks.mapInArrow(assign, f"id {kind}, {names}"), "cluster-assigned")
    sums = fetched(assigned.groupBy("cluster").agg(F.sum("distance").alias("total")))  # k rows
    total = int(sums.total.sum())
    digests = [sha256(",".join(str(x) for x in row).encode()).hexdigest() for row in centroids.tolist()]
    about = [(int(c), int(t), total, digests[c]) for c, t in zip(sums.cluster, sums.total)]
    table = spark.createDataFrame(about, "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    joined = assigned.join(F.broadcast(table), "cluster")  # k rows
    return joined.select(F.col("id").alias(key), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
