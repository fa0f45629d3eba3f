"""Stored states of a long log: as-of questions read the nearest snapshot and the days after it."""

from __future__ import annotations

import re
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..model import QueryError
from ..sources.store import _file_system
from .latest import fetch_winners, order_code
from .temporal import STATE_OPS, after, is_deletion, until

_FOLDER = "%Y%m%dT%H%M%S.%f"


def _moment(spark: SparkSession, as_of: Any):
    """``as_of`` as a datetime without zone."""
    when = spark.range(1).select(F.lit(as_of).cast(T.TimestampNTZType())).first()[0]
    if when is None:
        raise QueryError(f"not a timestamp: {as_of!r}")
    return when


def state_parts(events: DataFrame) -> DataFrame:
    """(entity_id, state, timestamp, gone, versions, creates) of some events of a log.

    ``state`` is the newest post-image, ``gone`` what the newest availability event says;
    both are NULL without such an event. Parts of consecutive stretches of a log add up.
    """
    state_op = F.col("operation").isin(*STATE_OPS)
    avail_op = (F.col("operation") == "availability_change") & F.col("patch").isNotNull()
    rows = events.where(state_op | avail_op).select(
        "entity_id", "timestamp", "id", "operation", "patch", state_op.alias("is_state"), order_code(events).alias("_code"), is_deletion().alias("gone")
    )
    state, key = F.col("is_state"), ["entity_id"]
    found = rows.groupBy(*key).agg(
        F.max(F.when(state, F.col("_code"))).alias("_code"), F.max(F.when(~state, F.col("_code"))).alias("_avail"),
        F.max(F.when(state, F.col("timestamp"))).alias("timestamp"),
        F.count(F.when(state, 1)).alias("versions"), F.count(F.when(F.col("operation") == "create", 1)).alias("creates"),
    )
    flags = rows.where(~state).withColumnRenamed("_code", "_avail")
    found = fetch_winners(found, flags, key, "_avail", "id", ["gone"], "left")
    found = fetch_winners(found, rows.where(state), key, "_code", "id", ["patch"], "left")
    return found.select("entity_id", F.col("patch").alias("state"), "timestamp", "gone", "versions", "creates")


def write_snapshot(log: DataFrame, as_of: Any, root: str) -> None:
    """Store the states at ``as_of`` below ``root``, sorted by entity.

    If ``root`` holds an earlier snapshot, it is taken forward and only the days since
    are read. An event that is appended later with a time before ``as_of`` is not in the
    snapshot: take snapshots as far back as events can come late.
    """
    when = _moment(log.sparkSession, as_of)
    rows = merged_parts(log, when, root)
    ranged = rows.repartitionByRange("entity_id").sortWithinPartitions("entity_id")
    ranged.write.mode("overwrite").parquet(f"{root}/at={when.strftime(_FOLDER)}")


def snapshot_times(spark: SparkSession, root: str) -> list:
    """Times of the complete snapshots, ascending."""
    from datetime import datetime

    hadoop, fs = _file_system(spark, root)
    if not fs.exists(hadoop):
        return []
    found = []
    for status in fs.listStatus(hadoop):
        name = status.getPath().getName()
        match = re.fullmatch(r"at=(\d{8}T\d{6}\.\d{6})", name)
        done, _ = _file_system(spark, f"{root}/{name}/_SUCCESS")
        if match and fs.exists(done):
            found.append(datetime.strptime(match.group(1), _FOLDER))
    return sorted(found)


def merged_parts(log: DataFrame, as_of: Any, root: str) -> DataFrame:
    """:func:`state_parts` of all events until ``as_of``, from the nearest snapshot and what follows it."""
    spark = log.sparkSession
    when = _moment(spark, as_of)
    known = [t for t in snapshot_times(spark, root) if t <= when]
    if not known:
        return state_parts(until(log, when))
    base = spark.read.parquet(f"{root}/at={known[-1].strftime(_FOLDER)}")
    tail = state_parts(after(until(log, when), known[-1])).select("entity_id", *[F.col(c).alias(f"_{c}") for c in base.columns[1:]])
    later = {c: F.coalesce(f"_{c}", c) for c in ("state", "timestamp", "gone")}
    sums = {c: F.coalesce(c, F.lit(0)) + F.coalesce(f"_{c}", F.lit(0)) for c in ("versions", "creates")}
    return base.join(tail, "entity_id", "full_outer").select("entity_id", *[x.alias(c) for c, x in (later | sums).items()])


def state_at_stored(log: DataFrame, as_of: Any, root: str, require_create: bool = False) -> DataFrame:
    """:func:`temporal.state_at` by way of the snapshots below ``root``."""
    rows = merged_parts(log, as_of, root).where(F.col("state").isNotNull() & ~F.coalesce("gone", F.lit(False)))
    rows = rows.where(F.col("creates") >= (1 if require_create else 0))
    return rows.select("entity_id", "state", "timestamp", F.greatest("versions", F.lit(1).cast("long")).alias("version"))
