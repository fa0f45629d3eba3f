"""Stream jobs over the append-only log and over incoming record files.

Each micro-batch writes its own folder, so a batch replayed after a failure
replaces its earlier output instead of adding to it.
"""

from __future__ import annotations

from typing import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..model import Schema
from ..operators.mutate import Stamp, run_loader
from ..operators.temporal import temporal_summary
from ..sources import store
from ..sources.sinks import write_batch_once


def read_log_stream(spark: SparkSession, path: str, schema: T.StructType, files_per_batch: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def stream_upsert(
    records: DataFrame,
    root: str,
    schema: Schema,
    entity_type: str,
    stamp: Callable[[int], Stamp],
    key: str,
    order: str,
    out_path: str,
    checkpoint: str,
    stream: str = "upsert",
    once: bool = True,
) -> StreamingQuery:
    """Incremental loader: every batch of new records is upserted into the store at ``root``.

    A batch sees what the batches before it committed, their external ids too, so an id
    that returns in a later batch finds its entity. Rows, edges, mappings, log and the
    batch's number are one commit: a replayed batch that was published is not written
    again. The outcome of every record is written below ``out_path``, a folder per batch.
    ``stamp`` gives the time and actor of a batch by its number.
    """

    def load(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        if store.stream_mark(spark, root, stream) >= batch_id:
            return
        catalog = store.load_catalog(spark, root, schema)
        active = catalog.external_ids.where("is_active").select("value", "entity")
        out = run_loader(lambda since: batch, catalog, entity_type, stamp(batch_id), key, order, active, source_system=stream)
        write_batch_once(out.report, out_path, batch_id)  # the loader has written its outcomes out
        store.commit(root, {entity_type: out}, mark=(stream, batch_id))

    writer = records.writeStream.foreachBatch(load).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def stream_temporal_summary(events: DataFrame) -> DataFrame:
    """The temporal summary kept up to date per entity (update or complete mode).

    min/max commute, so late events need no watermark.
    """
    return temporal_summary(events)


def run_to_table(df: DataFrame, out_path: str, checkpoint: str) -> None:
    """Drive an update-mode aggregation to parquet, one folder per batch."""
    query = (
        df.writeStream.outputMode("update")
        .foreachBatch(lambda batch, batch_id: write_batch_once(batch, out_path, batch_id))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def latest_of(updates: DataFrame, keys: list[str]) -> DataFrame:
    """Newest row per key of an update feed written by :func:`run_to_table`."""
    rest = [c for c in updates.columns if c not in (*keys, "batch_id")]
    return (
        updates.groupBy(*keys)
        .agg(F.max_by(F.struct(*rest), "batch_id").alias("last"))
        .select(*keys, "last.*")
    )
