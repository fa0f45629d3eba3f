"""Everything derived from the provenance log: summaries, versions, as-of states.

"Latest per key" goes by ``(timestamp, id)`` as one number (:mod:`.latest`), so a hash
aggregate combines it before the shuffle: a key holding a large share of the log
sends one narrow row per map task, and patches travel for winners only.
"""

from __future__ import annotations

from typing import Any, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.predicates import TreeCompiler, flat_condition
from ..model import QueryError, Schema
from .latest import dictionary, digest_of, fetch_winners, flag_of, has_whole_ids, order_code, spell_out, with_flag

STATE_OPS = ("create", "update")
EDGE_OPS = ("relationship_add", "relationship_remove")

# Operation names of older logs.
LEGACY_OPERATIONS = {
    "CREATE": "create",
    "UPDATE": "update",
    "EntityUpdated": "update",
    "REPLACED": "update",
    "EntitySuperseded": "supersede",
    "SUPERSEDE": "supersede",
    "AvailabilityChanged": "availability_change",
    "AVAILABILITY_CHANGE": "availability_change",
    "SOFT_DELETE": "availability_change",
    "RELATE": "relationship_add",
    "UNRELATE": "relationship_remove",
}


def normalize_operation(col: Column) -> Column:
    pairs = [F.lit(x) for pair in LEGACY_OPERATIONS.items() for x in pair]
    return F.coalesce(F.create_map(*pairs)[col], col)


def until(log: DataFrame, as_of: Any) -> DataFrame:
    """Events at or before ``as_of``; plain comparisons, so the scan prunes files
    by timestamp and, in a log written by ``append_provenance``, folders by day."""
    if as_of is None:
        return log
    mark = F.lit(as_of).cast(T.TimestampNTZType())
    if "event_date" in log.columns:
        log = log.where(F.col("event_date") <= mark.cast("date"))
    return log.where(F.col("timestamp") <= mark)


def after(log: DataFrame, since: Any) -> DataFrame:
    """Events strictly after ``since``, pruned like :func:`until`."""
    mark = F.lit(since).cast(T.TimestampNTZType())
    if "event_date" in log.columns:
        log = log.where(F.col("event_date") >= mark.cast("date"))
    return log.where(F.col("timestamp") > mark)


def instant() -> Column:
    """Total order of events."""
    return F.struct("timestamp", "id")


def is_deletion() -> Column:
    """Availability events that take the entity away."""
    gone = (F.get_json_object("patch", "$.status") == "deleted") | F.get_json_object(
        "patch", "$.is_available"
    ).isin("false", "0")
    return F.when(F.col("operation") == "availability_change", F.coalesce(gone, F.lit(False))).otherwise(
        F.lit(False)
    )


def temporal_summary(log: DataFrame, as_of: Any = None) -> DataFrame:
    """created/updated time and actor and schema version per entity.

    ``updated_*`` and ``schema_version`` come from the newest event that is not a
    deletion, edge events included; ``created_*`` from the earliest create.
    """
    created, kept, code = F.col("operation") == "create", ~is_deletion(), order_code(log)
    events = until(log, as_of).select(
        "entity_id", "id", F.when(created, F.col("timestamp")).alias("first_at"), F.when(kept, F.col("timestamp")).alias("last_at"),
        F.when(created, code).alias("first"), F.when(kept, code).alias("last"), "actor_id", "schema_version",
    )
    times = [F.min("first_at").alias("created_at"), F.max("last_at").alias("updated_at")]
    if has_whole_ids(log) and not log.isStreaming:
        narrow = events.withColumns({"actor": digest_of("actor_id"), "version": digest_of("schema_version")})
        out = narrow.groupBy("entity_id").agg(
            *times, F.max_by("version", "last").alias("_version"),
            F.min_by("actor", "first").alias("_made"), F.max_by("actor", "last").alias("_changed"),
        )
        actors = dictionary(events, "actor_id")
        out = spell_out(out, dictionary(events, "schema_version"), "_version", "schema_version")
        out = spell_out(spell_out(out, actors, "_made", "created_by"), actors, "_changed", "updated_by")
    else:  # text ids, and streams, whose updates no second stream can spell out: a task sorts
        # the narrow rows it combines, and one row per entity leaves it
        first = F.min(F.when(F.col("first").isNotNull(), F.struct("first", "id", "actor_id")))
        last = F.max(F.when(F.col("last").isNotNull(), F.struct("last", "id", "actor_id", "schema_version")))
        out = events.groupBy("entity_id").agg(*times, first.alias("_first"), last.alias("_last"))
        out = out.withColumns({"schema_version": F.col("_last.schema_version"), "created_by": F.col("_first.actor_id"), "updated_by": F.col("_last.actor_id")})
    return out.select("entity_id", "created_at", "updated_at", "schema_version", "created_by", "updated_by")


def temporal_summary_of(log: DataFrame, ids: DataFrame, as_of: Any = None) -> DataFrame:
    """The summary of ``ids(entity_id)`` only.

    Written as aggregate, then semi join: Catalyst moves the join below the
    aggregate when the ids are small enough to broadcast; otherwise the log
    combines first, so an entity with very many events is never shuffled raw.
    """
    return temporal_summary(log, as_of).join(ids.select("entity_id"), "entity_id", "left_semi")


def temporal_as_of(log: DataFrame, as_of: Any) -> DataFrame:
    return temporal_summary(log, as_of)


def provenance_summary(log: DataFrame, entity_type: str | None = None) -> DataFrame:
    """Per (entity, type): earliest event, newest non-deletion, latest schema version."""
    if entity_type is not None:
        log = log.where(F.col("entity_type") == entity_type)
    key = ["entity_id", "entity_type"]
    events = log.select(
        *key, "id", "timestamp", order_code(log).alias("code"), F.when(~is_deletion(), F.col("timestamp")).alias("kept_at"), "schema_version"
    )
    times = [F.min("timestamp").alias("created_at"), F.max("kept_at").alias("updated_at")]
    if has_whole_ids(log):
        narrow = events.withColumn("version", digest_of("schema_version"))
        out = narrow.groupBy(*key).agg(*times, F.max_by("version", "code").alias("_version"))
        out = spell_out(out, dictionary(log, "schema_version"), "_version", "schema_version")
    else:
        out = events.groupBy(*key).agg(*times, F.max(F.struct("code", "id", "schema_version")).alias("_last"))
        out = out.withColumn("schema_version", F.col("_last.schema_version"))
    return out.select(*key, "created_at", "updated_at", "schema_version")


def entity_version(log: DataFrame, as_of: Any = None) -> DataFrame:
    """Number of create/update events, at least 1."""
    n = F.count(F.when(F.col("operation").isin(*STATE_OPS), 1))
    return (
        until(log, as_of)
        .groupBy("entity_id")
        .agg(F.greatest(n, F.lit(1).cast("long")).alias("version"))
    )


def version_as_of(log: DataFrame, as_of: Any) -> DataFrame:
    return entity_version(log, as_of)


def creation_time(log: DataFrame) -> DataFrame:
    return (
        log.where(F.col("operation") == "create")
        .groupBy("entity_id")
        .agg(F.min("timestamp").alias("created_at"))
    )


def entities_created_by(log: DataFrame, as_of: Any = None, entity_type: str | None = None) -> DataFrame:
    """Distinct (entity, type) with a create event at or before ``as_of``."""
    events = until(log, as_of).where(F.col("operation") == "create")
    if entity_type is not None:
        events = events.where(F.col("entity_type") == entity_type)
    return events.select("entity_id", "entity_type").distinct()


def latest_state_per_entity(log: DataFrame, as_of: Any = None) -> DataFrame:
    """Newest create/update post-image per entity."""
    states = until(log, as_of).where(F.col("operation").isin(*STATE_OPS)).withColumn("_code", order_code(log))
    newest = states.groupBy("entity_id").agg(F.max("_code").alias("_code"), F.max("timestamp").alias("timestamp"))
    found = fetch_winners(newest, states, ["entity_id"], "_code", "id", ["patch"])
    return found.select("entity_id", F.col("patch").alias("state"), "timestamp")


def latest_availability_per_entity(log: DataFrame, as_of: Any = None) -> DataFrame:
    """What the newest availability event says; entities without one are absent."""
    events = (
        until(log, as_of)
        .where((F.col("operation") == "availability_change") & F.col("patch").isNotNull())
        .select("entity_id", "timestamp", "id", order_code(log).alias("_code"), (~is_deletion()).alias("available"))
    )
    newest = F.max("timestamp").alias("timestamp")
    if has_whole_ids(log):
        found = events.groupBy("entity_id").agg(F.max(with_flag(F.col("_code"), F.col("available"))).alias("_code"), newest)
        return found.select("entity_id", flag_of(F.col("_code")).alias("available"), "timestamp")
    found = events.groupBy("entity_id").agg(F.max("_code").alias("_code"), newest)
    return fetch_winners(found, events, ["entity_id"], "_code", "id", ["available"]).select("entity_id", "available", "timestamp")


def state_at(log: DataFrame, as_of: Any = None, require_create: bool = False) -> DataFrame:
    """State of every entity at ``as_of``: one narrow aggregate, then the winners' patches.

    The newest create/update carries the post-image; the newest availability
    event decides presence on its own; other events never define state.
    ``require_create`` drops entities whose log has no create event by then.
    """
    state_op = F.col("operation").isin(*STATE_OPS)
    avail_op = (F.col("operation") == "availability_change") & F.col("patch").isNotNull()
    events = (
        until(log, as_of)
        .where(state_op | avail_op)
        .select(
            "entity_id", "timestamp", "id", "operation", "patch", state_op.alias("is_state"), order_code(log).alias("_code"),
            is_deletion().alias("deletion"),
        )
    )
    state, whole, key = F.col("is_state"), has_whole_ids(log), ["entity_id"]
    avail = with_flag(F.col("_code"), F.col("deletion")) if whole else F.col("_code")
    newest = (
        events.groupBy(*key)
        .agg(
            F.max(F.when(state, F.col("_code"))).alias("_code"),
            F.max(F.when(state, F.col("timestamp"))).alias("timestamp"),
            F.max(F.when(~state, avail)).alias("_avail"),
            F.count(F.when(state, 1)).alias("version"),
            F.count(F.when(F.col("operation") == "create", 1)).alias("creates"),
        )
        .where(F.col("_code").isNotNull() & (F.col("creates") >= (1 if require_create else 0)))
    )
    if whole:
        gone = flag_of(F.col("_avail"))
    else:
        flags = events.where(~state).withColumnRenamed("_code", "_avail")
        newest = fetch_winners(newest, flags, key, "_avail", "id", ["deletion"], "left")
        gone = F.col("deletion")
    newest = newest.where(~F.coalesce(gone, F.lit(False))).select(
        "entity_id", "_code", "timestamp", F.greatest(F.col("version"), F.lit(1).cast("long")).alias("version")
    )
    found = fetch_winners(newest, events.where(state), key, "_code", "id", ["patch"])
    return found.select("entity_id", F.col("patch").alias("state"), "timestamp", "version")


def query_as_of(
    log: DataFrame,
    schema: Schema,
    entity_type: str,
    as_of: Any,
    filters: Iterable[dict] = (),
    filter_mode: str = "and",
    where: dict | None = None,
    order_by: str | None = None,
) -> DataFrame:
    """A class reconstructed at ``as_of`` and filtered like a live query."""
    if order_by is not None:
        raise QueryError("order_by is not available with as_of")
    # A create event fixes the class of an entity; edge events carry other types.
    own = log.where(
        (F.col("entity_type") == entity_type)
        & F.col("operation").isin(*STATE_OPS, "availability_change")
    )
    states = state_at(own, as_of, require_create=True)
    parsed = states.select(
        F.col("entity_id").alias("id"),
        "version",
        F.from_json("state", schema.struct(entity_type)).alias("data"),
    ).select("id", "version", "data.*")
    return matches_tree_json(parsed, filters, filter_mode, where)


def matches_tree_json(
    parsed: DataFrame,
    filters: Iterable[dict] = (),
    filter_mode: str = "and",
    where: dict | None = None,
) -> DataFrame:
    """The live predicates over reconstructed rows; one builder serves both."""
    rows = parsed.alias("entity")
    condition = flat_condition(parsed.schema, filters, filter_mode, "entity")
    if condition is not None:
        rows = rows.where(condition)
    if where is not None:
        rows = rows.where(TreeCompiler().condition(where, parsed, "entity"))
    return rows


def count_as_of(log: DataFrame, schema: Schema, entity_type: str, as_of: Any, **criteria) -> DataFrame:
    return query_as_of(log, schema, entity_type, as_of, **criteria).agg(F.count("*").alias("n"))


def edge_events(log: DataFrame, as_of: Any = None) -> DataFrame:
    patch = T.StructType(
        [
            T.StructField("relationship_id", T.StringType()),
            T.StructField("source_id", T.StringType()),
            T.StructField("target_id", T.StringType()),
            T.StructField("relationship_type", T.StringType()),
        ]
    )
    return (
        until(log, as_of)
        .where(F.col("operation").isin(*EDGE_OPS))
        .select("timestamp", "id", "operation", F.from_json("patch", patch).alias("edge"))
        .select(
            "timestamp", F.col("id").alias("event_id"), "operation",
            "edge.relationship_id", "edge.source_id", "edge.target_id", "edge.relationship_type",
        )
    )


def latest_edge_event(log: DataFrame, as_of: Any = None) -> DataFrame:
    """Newest add/remove per (source, target, type)."""
    keys = ["source_id", "target_id", "relationship_type"]
    events = edge_events(log, as_of)
    # text of a patch may name no key; those events are one group, as nulls are when grouped
    events = events.withColumns({k: F.coalesce(k, F.lit("\x00")) for k in keys}).withColumn("_code", order_code(events, tie="event_id"))
    newest = events.groupBy(*keys).agg(
        F.max("_code").alias("_code"), F.max("timestamp").alias("timestamp")
    )
    found = fetch_winners(newest, events, keys, "_code", "event_id", ["relationship_id", "operation"])
    return found.select(
        F.col("relationship_id").alias("id"), *[F.nullif(F.col(k), F.lit("\x00")).alias(k) for k in keys], "operation", "timestamp"
    )


def live_edges_at(log: DataFrame, as_of: Any = None) -> DataFrame:
    """Edges whose newest event is an add."""
    return (
        latest_edge_event(log, as_of)
        .where(F.col("operation") == "relationship_add")
        .select("id", "source_id", "target_id", "relationship_type")
    )


def updated_since(
    entities: DataFrame,
    log: DataFrame,
    since: Any,
    limit: int | None = None,
    offset: int | None = None,
    hydrate: bool = False,
) -> DataFrame:
    """Entities changed strictly after ``since`` (UTC), oldest change first.

    The newest change of such an entity lies after ``since`` itself, so only that
    end of the log is read. ``hydrate`` adds the other temporal fields, for the
    ids of the page.
    """
    from ..functions.scalars import iso_to_utc
    from .read import page

    mark = iso_to_utc(since)
    if mark is None:
        raise QueryError(f"not an ISO-8601 timestamp: {since!r}")
    recent = (
        after(log, mark)
        .where(~is_deletion())
        .groupBy(F.col("entity_id").alias("id"))
        .agg(F.max("timestamp").alias("updated_at"))
    )
    rows = page(entities.join(recent, "id").orderBy("updated_at", "id"), limit, offset)
    if not hydrate:
        return rows
    summary = temporal_summary_of(log, rows.select(F.col("id").alias("entity_id"))).drop("updated_at")
    return rows.join(summary.withColumnRenamed("entity_id", "id"), "id", "left").orderBy("updated_at", "id")


def history(log: DataFrame, entity_id: Any) -> DataFrame:
    """All events of an entity, oldest first."""
    return log.where(F.col("entity_id") == F.lit(entity_id)).orderBy("timestamp", "id")


def events_by_operation(log: DataFrame, entity_id: Any, operation: str | None = None) -> DataFrame:
    """Events of an entity, newest first."""
    rows = log.where(F.col("entity_id") == F.lit(entity_id))
    if operation is not None:
        rows = rows.where(F.col("operation") == operation)
    return rows.orderBy(F.col("timestamp").desc(), F.col("id").desc())


def backfill_registry(log: DataFrame) -> DataFrame:
    """id -> class from create events."""
    return entities_created_by(log).select(F.col("entity_id").alias("id"), "entity_type")
