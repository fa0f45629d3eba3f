"""Append-only sinks: the provenance log and the write log."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..model import OPERATIONS, QueryError
from ..operators.temporal import normalize_operation


def provenance_rows(events: DataFrame) -> DataFrame:
    """Events as they are appended: normalised operation, 'unknown' actor, day."""
    return events.withColumn("operation", normalize_operation(F.col("operation"))).withColumn(
        "actor_id", F.coalesce("actor_id", F.lit("unknown"))
    ).withColumn("event_date", F.to_date("timestamp"))


def append_provenance(events: DataFrame, path: str, mode: str = "append") -> None:
    """Append events, partitioned by day. Unknown operations are refused first."""
    rows = provenance_rows(events)
    bad = rows.where(~F.col("operation").isin(*OPERATIONS)).head(1)
    if bad:
        raise QueryError(f"unknown operation {bad[0]['operation']!r}")
    # Ranges over (day, entity): no day is one task, and the files of a day are
    # sorted by entity, so one entity's history skips most row groups.
    (
        rows.repartitionByRange("event_date", "entity_id", "timestamp")
        .sortWithinPartitions("event_date", "entity_id", "timestamp")
        .write.mode(mode)
        .partitionBy("event_date")
        .parquet(path)
    )


def write_log_rows(
    existing: DataFrame, ids: DataFrame, loader: str, version: Any, entity_type: str, written_at: Any
) -> DataFrame:
    """Rows to append: each (loader, version, entity) once, known ones left out."""
    known = existing.where((F.col("loader_name") == loader) & (F.col("version") == F.lit(version))).select(
        F.col("entity_id").cast("string").alias("_known")
    )
    return (
        ids.select(F.col("id").cast("string").alias("entity_id"))
        .distinct()
        .join(known, F.col("entity_id") == F.col("_known"), "left_anti")
        .select(
            F.lit(loader).alias("loader_name"),
            F.lit(version).alias("version"),
            "entity_id",
            F.lit(entity_type).alias("entity_type"),
            F.lit(written_at).cast(T.TimestampNTZType()).alias("written_at"),
        )
    )


def append_write_log(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").parquet(path)


def write_batch_once(df: DataFrame, path: str, batch_id: int) -> None:
    """Write a micro-batch to its own folder; a replay overwrites the same folder."""
    df.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")
