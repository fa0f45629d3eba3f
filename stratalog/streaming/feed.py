"""The change feed: entities as they change, oldest first, each change told once."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..model import QueryError
from ..operators.temporal import is_deletion
from ..sources.sinks import write_batch_once

#: The state store of the feed; the default store keeps state in the executors' heap.
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def change_feed(events: DataFrame, delay: str, since: Any = None) -> DataFrame:
    """Streaming rows (entity_id, updated_at, n_events) of changes after ``since``, by millisecond.

    ``events`` is a stream of the log. A change is told when the watermark, the newest
    time seen less ``delay``, has passed it: a late event within ``delay`` still takes its
    place in the order, one beyond it is dropped by the watermark and counted in the
    query's progress. Deletions are no changes. Events without entity or time are left out.
    An entity's changes that one micro-batch tells are put together by :func:`told_changes`.

    Two aggregates keep the state. The first drops what comes at or before the watermark,
    and gives up what it has reached; the second holds what stands at the watermark itself
    until it has passed, as a window has ended only then.
    """
    changes = events.where(~is_deletion() & F.col("entity_id").isNotNull() & F.col("timestamp").isNotNull())
    if since is not None:
        changes = changes.where(F.col("timestamp") > F.lit(since).cast(T.TimestampNTZType()))
    reached = (
        changes.select("entity_id", F.col("timestamp").cast("timestamp").alias("at"))
        .withWatermark("at", delay)
        .groupBy("entity_id", "at")
        .agg(F.count("*").alias("n"))
    )
    passed = reached.groupBy("entity_id", F.window("at", "1 millisecond")).agg(F.max("at").alias("newest"), F.sum("n").alias("n_events"))
    return passed.select("entity_id", F.col("newest").cast(T.TimestampNTZType()).alias("updated_at"), "n_events")


def told_changes(batch: DataFrame) -> DataFrame:
    """One row per entity of a micro-batch: its newest change, and how many there are."""
    return batch.groupBy("entity_id").agg(F.max("updated_at").alias("updated_at"), F.sum("n_events").alias("n_events"))


def stream_updated_since(
    events: DataFrame, out_path: str, checkpoint: str, delay: str = "1 day", since: Any = None, once: bool = True
) -> StreamingQuery:
    """Write the change feed below ``out_path``, one folder per micro-batch.

    A batch's rows are sorted by (updated_at, entity_id) and lie after those of all
    batches before it; a replayed batch replaces its own folder. Changes newer than the
    watermark wait in the checkpoint for the next run. The session must use the RocksDB
    state store, which keeps state outside the executors' heap.
    """
    spark = events.sparkSession
    if spark.conf.get("spark.sql.streaming.stateStore.providerClass", "") != STATE_STORE:
        raise QueryError(f"set spark.sql.streaming.stateStore.providerClass to {STATE_STORE}")

    def emit(batch: DataFrame, batch_id: int) -> None:
        write_batch_once(told_changes(batch).orderBy("updated_at", "entity_id"), out_path, batch_id)

    writer = change_feed(events, delay, since).writeStream.outputMode("append").foreachBatch(emit).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def read_feed(df: DataFrame) -> DataFrame:
    """A feed's rows in the order they were told."""
    return df.orderBy("batch_id", "updated_at", "entity_id").select("entity_id", "updated_at", "n_events")
