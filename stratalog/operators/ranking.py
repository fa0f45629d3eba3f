"""Positions inside groups without putting a whole group into one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import stable


def position_in_group(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Add ``ordinal``: the 0-based position of a row in its group.

    All rows are range sorted by (keys, order), which splits a hot group over many
    tasks; counts per group and piece (at most one row for each) give the offset of
    every piece.
    """
    pieces = stable(
        df.repartitionByRange(*keys, *order)
        .sortWithinPartitions(*keys, *order)
        .withColumn("_piece", F.spark_partition_id())
        .withColumn("_row", F.monotonically_increasing_id())
    )
    counts = pieces.groupBy(*keys, "_piece").agg(F.count("*").alias("_n"), F.min("_row").alias("_first"))
    before = Window.partitionBy(*keys).orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    offsets = stable(counts.withColumn("_offset", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n"))
    return (
        pieces.join(offsets, [*keys, "_piece"])
        .withColumn("ordinal", (F.col("_offset") + F.col("_row") - F.col("_first")).cast("long"))
        .drop("_piece", "_row", "_first", "_offset")
    )
