"""Sharding by jump consistent hashing."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import pinned

SHARDS = 24


def jump_hash(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket of every key (Lamping and Veach): no ring table, and with one more
    bucket only keys that go to the new one move."""
    key = keys.astype(np.uint64, copy=True)
    bucket = np.zeros(len(key), dtype=np.int64)
    jump = np.zeros(len(key), dtype=np.int64)
    live = np.arange(len(key))
    while len(live):
        bucket[live] = jump[live]
        key[live] = key[live] * np.uint64(2862933555777941757) + np.uint64(1)
        step = float(1 << 31) / ((key[live] >> np.uint64(33)) + np.uint64(1)).astype(np.float64)
        jump[live] = ((bucket[live] + 1) * step).astype(np.int64)
        live = live[jump[live] < buckets]
    return bucket.astype(np.int32)


def shard_of(key: Column, shards: int) -> Column:
    """Shard of a key column (bigint, not null)."""

    @F.pandas_udf("int")
    def place(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for keys in batches:
            yield pd.Series(jump_hash(keys.to_numpy(np.int64).view(np.uint64), shards))

    return place(key)


def stable_key(docs: DataFrame, key: str) -> Column:
    """The key as bigint: whole numbers as they are, other types by a 64-bit hash, null as 0."""
    kind = dict(docs.dtypes)[key]
    whole = kind in ("bigint", "int", "smallint", "tinyint")
    column = F.col(key).cast("long") if whole else F.when(F.col(key).isNotNull(), F.xxhash64(F.col(key)))
    return F.coalesce(column, F.lit(0).cast("long"))


def assign_shards(docs: DataFrame, shards: int = SHARDS, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Shard and slot of every row: (key, size, text_crc32, shard, slot, grown_shard).

    ``size`` is the UTF-8 length of the text plus 8, ``text_crc32`` its checksum,
    ``grown_shard`` the shard among ``shards + 1``. Slots of a shard run from 0 in
    key order without gaps. The rows are dealt by ranges of (shard, key), so slots
    need one narrow shuffle, counts per range and a number within the range; a
    shard is never one task.

    * Null key: counts as key 0. Null text: as empty (size 8, checksum 0).
    * Repeated keys: same shard, slots in any order among them; equal rows are
      spread over ranges by a random third sort column, pinned before use.
    * Empty table: no rows. Other columns are not looked at.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    placed = docs.select(
        F.col(key),
        stable_key(docs, key).alias("key_"),
        (F.octet_length(body) + 8).cast("long").alias("size"),
        F.crc32(body.cast("binary")).alias("text_crc32"),
    ).select(
        "*",
        shard_of(F.col("key_"), shards).alias("shard"),
        shard_of(F.col("key_"), shards + 1).alias("grown_shard"),
    )
    ranged = placed.repartitionByRange("shard", "key_", F.rand(11)).withColumn("range_", F.spark_partition_id())
    ranged = pinned(ranged, "shard-ranges")
    counts = ranged.groupBy("range_", "shard").agg(F.count("*").alias("n_"))
    before = Window.partitionBy("shard").orderBy("range_").rowsBetween(Window.unboundedPreceding, -1)
    bases = pinned(
        counts.select("range_", "shard", F.coalesce(F.sum("n_").over(before), F.lit(0)).alias("base_")), "shard-bases"
    )
    within = Window.partitionBy("range_", "shard").orderBy("key_", "text_crc32", "size")
    numbered = ranged.withColumn("at_", F.row_number().over(within))
    return numbered.join(bases, ["range_", "shard"]).select(
        key, "size", "text_crc32", "shard", (F.col("base_") + F.col("at_") - 1).cast("long").alias("slot"), "grown_shard"
    )


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS, key: str = "doc_id", files: int = 8) -> None:
    """Write the rows below ``path/shard=N``. A shard is written by ``files`` tasks,
    dealt by a hash of key and all columns, so no task holds a whole shard. A column
    named ``shard`` is replaced."""
    placed = docs.withColumn("shard", shard_of(stable_key(docs, key), shards))
    placed = placed.withColumn("part_", F.pmod(F.xxhash64(*docs.columns), F.lit(files)))
    placed.repartition(shards * files, "shard", "part_").drop("part_").write.partitionBy("shard").parquet(path)
