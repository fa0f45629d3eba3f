"""Writes as batch jobs: current tables + an input batch -> new snapshots, log
rows and edge rows.

Nothing is written here. A :class:`WriteSet` holds lazy DataFrames; the caller
validates first and writes each table once. Event ids are digests of what the
event says, so a recomputed task yields the same rows.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..model import SYSTEM_COLUMNS, Catalog, QueryError, Schema, union_all
from ..runtime import stable


def among(table: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    """Rows of ``table`` whose id occurs in ``ids(key)``.

    Applied before an outer join, so that a small batch is broadcast to the table
    and the table is not shuffled for it; Spark decides by the batch's size.
    """
    return table.join(ids.select(F.col(key).alias("id")), "id", "left_semi")


@dataclass
class WriteSet:
    """What a job wants to write. ``entities`` is the class's new snapshot and
    ``changed`` only its new or changed rows, for tables that can merge.

    ``edges`` and ``external_ids`` are whole tables as they shall be;
    ``new_edges`` and ``new_mappings`` are rows to add to the tables that are.
    """

    entities: DataFrame | None = None
    changed: DataFrame | None = None
    log: DataFrame | None = None
    edges: DataFrame | None = None
    external_ids: DataFrame | None = None
    report: DataFrame | None = None
    new_edges: DataFrame | None = None
    new_mappings: DataFrame | None = None


@dataclass(frozen=True)
class Stamp:
    """Who writes, when and why; put on every event of a job."""

    timestamp: Any
    actor_id: str = "unknown"
    context: str | None = None
    schema_version: str | None = None
    process_id: str | None = None


def event(
    rows: DataFrame,
    stamp: Stamp,
    entity_id: Column,
    entity_type: str | Column,
    operation: str | Column,
    patch: Column,
    derived_from: Column | None = None,
) -> DataFrame:
    """Log rows with a content digest as id."""
    kind = F.lit(entity_type) if isinstance(entity_type, str) else entity_type
    op = F.lit(operation) if isinstance(operation, str) else operation
    when = F.lit(stamp.timestamp).cast(T.TimestampNTZType())
    none = F.lit(None).cast("string")
    digest = F.sha2(
        F.concat_ws("|", entity_id.cast("string"), kind, op, when.cast("string"), F.coalesce(patch, F.lit(""))), 256
    )
    return rows.select(
        digest.alias("id"),
        entity_id.alias("entity_id"),
        kind.alias("entity_type"),
        op.alias("operation"),
        F.lit(stamp.actor_id).alias("actor_id"),
        when.alias("timestamp"),
        F.lit(stamp.schema_version).cast("string").alias("schema_version"),
        (derived_from if derived_from is not None else none).cast("string").alias("derived_from_id"),
        F.lit(stamp.process_id).cast("string").alias("process_id"),
        patch.alias("patch"),
        F.lit(stamp.context).cast("string").alias("context"),
    )


def stamp_events(log: DataFrame, actor_id: str = "unknown", context: str | None = None) -> DataFrame:
    """Fill actor and context of events that carry none."""
    return log.withColumns(
        {
            "actor_id": F.coalesce("actor_id", F.lit(actor_id)),
            "context": F.coalesce("context", F.lit(context).cast("string")),
        }
    )


def image(columns: Iterable[str]) -> Column:
    """Full post-image of a row as JSON text, absent values left out."""
    return F.to_json(F.struct(*[F.col(c) for c in columns]))


def assign_ids(batch: DataFrame) -> DataFrame:
    """Give rows without id a random one, pinned by writing the batch out once."""
    if "id" not in batch.columns:
        return stable(batch.withColumn("id", F.uuid()))
    if batch.where(F.col("id").isNull()).isEmpty():
        return batch
    return stable(batch.withColumn("id", F.coalesce(F.col("id"), F.uuid())))


def apply_defaults(df: DataFrame, schema: Schema, entity_type: str) -> DataFrame:
    """Declared defaults for absent values; rows are available unless told so."""
    out = {}
    for slot in schema.slots(entity_type).values():
        if slot.is_edge or slot.default is None:
            continue
        value = F.lit(slot.default).cast(slot.spark_type)
        out[slot.name] = F.coalesce(F.col(slot.name), value) if slot.name in df.columns else value
    flag = F.lit(True)
    out["is_available"] = F.coalesce(F.col("is_available"), flag) if "is_available" in df.columns else flag
    return df.withColumns(out)


def _shape(batch: DataFrame, table: DataFrame, keep: Iterable[str] = ()) -> DataFrame:
    """The batch with exactly the table's columns and ``keep``; absent ones NULL, new rows live."""
    cols = []
    for f in table.schema.fields:
        if f.name in batch.columns:
            cols.append(F.col(f.name).cast(f.dataType).alias(f.name))
        elif f.name == "is_available":
            cols.append(F.lit(True).alias("is_available"))
        else:
            cols.append(F.lit(None).cast(f.dataType).alias(f.name))
    return batch.select(*cols, *keep)


def _data_columns(table: DataFrame) -> list[str]:
    return [c for c in table.columns if c not in SYSTEM_COLUMNS]


def refuse_bad_ids(catalog: Catalog, entity_type: str, batch: DataFrame) -> None:
    """Raise on an id that the batch repeats or that names an entity of another class."""
    twice = batch.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").head(1)
    if twice:
        raise QueryError(f"the batch holds {entity_type} {twice[0][0]!r} more than once")
    others = [name for name in catalog.tables if name != entity_type]
    if catalog.global_ids and others:
        taken = union_all([among(catalog.table(n), batch).select("id", F.lit(n).alias("kind")) for n in others]).head(1)
        if taken:
            raise QueryError(f"{taken[0][0]!r} is a {taken[0][1]}, not a {entity_type}")


def put(
    catalog: Catalog, entity_type: str, batch: DataFrame, stamp: Stamp, only_existing: bool = False
) -> WriteSet:
    """Upsert by id: one create or update event with the full post-image per row.

    One id-only join decides the event; the snapshot is the untouched rows plus the
    batch, whose availability and ``superseded_by`` stay what they were. Lists of
    multivalued slots become edges, and a slot that the batch omits loses its edges
    (see :func:`reconcile_multi_refs`). An id may occur once and in one class.
    """
    refuse_bad_ids(catalog, entity_type, batch)
    table = catalog.table(entity_type)
    slots = [s.name for s in catalog.schema.edge_slots(entity_type)]
    lists = [s for s in slots if s in batch.columns]
    rows = _shape(batch, table, lists)
    known = among(table, rows).select(
        "id", F.col("is_available").alias("_was"), F.col("superseded_by").alias("_by"), F.lit(True).alias("_exists")
    )
    joined = rows.drop("is_available", "superseded_by").join(known, "id", "left")
    if only_existing:
        missing = joined.where(F.col("_exists").isNull()).select("id").head(1)
        if missing:
            raise QueryError(f"{entity_type} {missing[0][0]!r} does not exist")
    written = joined.withColumn("is_available", F.coalesce("_was", F.lit(True))).withColumn("superseded_by", F.col("_by"))
    operation = F.when(F.col("_exists"), "update").otherwise("create")
    return _written(catalog, entity_type, batch, written, operation, stamp)


def _written(
    catalog: Catalog, entity_type: str, batch: DataFrame, written: DataFrame, operation: Column, stamp: Stamp
) -> WriteSet:
    """What :func:`put` returns, from the rows as they shall stand and the event of each."""
    table = catalog.table(entity_type)
    slots = [s.name for s in catalog.schema.edge_slots(entity_type)]
    lists = [s for s in slots if s in batch.columns]
    log = event(written, stamp, F.col("id"), entity_type, operation, image([*_data_columns(table), *lists]))
    changed = written.select(*table.columns)
    snapshot = table.join(written.select("id"), "id", "left_anti").unionByName(changed)
    report = written.select("id", operation.alias("operation"))
    out = WriteSet(entities=snapshot, changed=changed, log=log, report=report)
    if slots and catalog.edges is not None:
        moved = reconcile_multi_refs(catalog, entity_type, batch, stamp, all_slots=True)
        out.edges = moved.edges
        out.log = log.unionByName(moved.log.withColumn("entity_id", F.col("entity_id").cast(log.schema["entity_id"].dataType)))
    return out


def update(catalog: Catalog, entity_type: str, batch: DataFrame, stamp: Stamp) -> WriteSet:
    """``put`` whose rows must exist."""
    return put(catalog, entity_type, batch, stamp, only_existing=True)


def replace(catalog: Catalog, entity_type: str, batch: DataFrame, stamp: Stamp) -> WriteSet:
    """Full replacement of existing rows: omitted slots become NULL, omitted lists empty."""
    return put(catalog, entity_type, batch, stamp, only_existing=True)


def set_availability_bulk(
    catalog: Catalog, entity_type: str, ids: DataFrame, available: bool, stamp: Stamp, reason: str | None = None
) -> WriteSet:
    """Flip many ids. ``report(id, success, error)`` covers every requested id."""
    table = catalog.table(entity_type)
    asked = ids.select("id").distinct()
    hit = table.join(asked, "id", "left_semi")
    patch = F.to_json(
        F.struct(F.lit(available).alias("is_available"), F.lit(reason).cast("string").alias("reason"))
    )
    log = event(hit, stamp, F.col("id"), entity_type, "availability_change", patch)
    snapshot = table.join(asked.withColumn("_asked", F.lit(True)), "id", "left").withColumn(
        "is_available", F.when(F.col("_asked"), F.lit(available)).otherwise(F.col("is_available"))
    ).select(*table.columns)
    report = asked.join(hit.select("id", F.lit(True).alias("found")), "id", "left").select(
        "id",
        F.coalesce("found", F.lit(False)).alias("success"),
        F.when(F.col("found").isNull(), "not found").alias("error"),
    )
    changed = hit.withColumn("is_available", F.lit(available))
    return WriteSet(entities=snapshot, changed=changed, log=log, report=report)


def soft_delete(catalog: Catalog, entity_type: str, ids: DataFrame, stamp: Stamp) -> WriteSet:
    """Make live rows unavailable; unknown or gone ids report ``deleted = false``."""
    table = catalog.table(entity_type)
    asked = ids.select("id").distinct()
    hit = catalog.live(entity_type).join(asked, "id", "left_semi")
    patch = F.to_json(
        F.struct(F.lit("deleted").alias("status"), F.struct(*_data_columns(table)).alias("snapshot"))
    )
    log = event(hit, stamp, F.col("id"), entity_type, "availability_change", patch)
    snapshot = table.join(asked.withColumn("_asked", F.lit(True)), "id", "left").withColumn(
        "is_available", F.col("is_available") & F.col("_asked").isNull()
    ).select(*table.columns)
    report = asked.join(hit.select("id", F.lit(True).alias("hit")), "id", "left").select(
        "id", F.coalesce("hit", F.lit(False)).alias("deleted")
    )
    changed = hit.withColumn("is_available", F.lit(False))
    return WriteSet(entities=snapshot, changed=changed, log=log, report=report)


def supersede_entities(
    catalog: Catalog, entity_type: str, pairs: DataFrame, stamp: Stamp, reason: str | None = None
) -> WriteSet:
    """``pairs(id, replacement)``: the old row goes unavailable and points at its
    replacement; a supersede event, an edge and an update event record it."""
    table = catalog.table(entity_type)
    old = among(table, pairs)
    fresh = among(table, pairs, "replacement")
    unknown = pairs.join(old.select("id"), "id", "left_anti").select("id").unionByName(
        pairs.select(F.col("replacement").alias("id")).join(fresh.select("id"), "id", "left_anti")
    )
    if unknown.head(1):
        raise QueryError("supersede names an entity that does not exist")
    if old.where(F.col("superseded_by").isNotNull()).head(1):
        raise QueryError("an entity is already superseded")
    why = F.lit(reason).cast("string").alias("reason")
    gone = event(
        pairs, stamp, F.col("id"), entity_type, "supersede",
        F.to_json(F.struct(F.col("replacement").alias("superseded_by"), why)),
    )
    update_log = event(fresh, stamp, F.col("id"), entity_type, "update", image(_data_columns(table)))
    edges = new_edges(
        pairs.select(
            F.col("id").alias("source_id"), F.col("replacement").alias("target_id"),
            F.lit("superseded_by").alias("relationship_type"),
        ),
        stamp,
    )
    snapshot = (
        table.join(pairs.select("id", F.col("replacement").alias("_by")), "id", "left")
        .withColumn("is_available", F.col("is_available") & F.col("_by").isNull())
        .withColumn("superseded_by", F.coalesce("_by", "superseded_by"))
        .select(*table.columns)
    )
    return WriteSet(entities=snapshot, changed=among(snapshot, pairs), log=gone.unionByName(update_log), new_edges=edges)


def new_edges(rows: DataFrame, stamp: Stamp) -> DataFrame:
    """Edge rows from ``(source_id, target_id, relationship_type[, metadata])``."""
    when = F.lit(stamp.timestamp).cast(T.TimestampNTZType())
    meta = F.col("metadata") if "metadata" in rows.columns else F.lit(None).cast("string")
    digest = F.sha2(
        F.concat_ws("|", F.col("source_id").cast("string"), F.col("target_id").cast("string"), "relationship_type", when.cast("string")), 256
    )
    return rows.select(
        digest.alias("id"), "source_id", "target_id", "relationship_type",
        meta.alias("metadata"), when.alias("created_at"),
        F.lit(stamp.actor_id).alias("created_by"), F.lit(True).alias("is_available"),
    )


def edge_patch() -> Column:
    return F.to_json(
        F.struct(
            F.col("id").alias("relationship_id"), "source_id", "target_id", "relationship_type",
        )
    )


def relate(edges: DataFrame, rows: DataFrame, live_ids: DataFrame, stamp: Stamp) -> WriteSet:
    """Add edges after checking type, self edges and endpoints."""
    from .validate import check_edges, require_valid

    fresh = new_edges(rows, stamp)
    require_valid(check_edges(fresh, live_ids, batch=True))
    log = event(fresh, stamp, F.col("source_id"), "relationship", "relationship_add", edge_patch())
    return WriteSet(edges=edges.unionByName(fresh, allowMissingColumns=True), log=log)


def unrelate(edges: DataFrame, rows: DataFrame, stamp: Stamp) -> WriteSet:
    """Soft-delete live edges named by (source_id, target_id, relationship_type)."""
    keys = ["source_id", "target_id", "relationship_type"]
    asked = stable(rows.select(*keys).distinct())
    live = edges.where("is_available")
    if asked.join(live, keys, "left_anti").head(1):
        raise QueryError("no live edge to remove")
    gone = live.join(asked, keys, "left_semi")
    log = event(gone, stamp, F.col("source_id"), "relationship", "relationship_remove", edge_patch())
    marked = edges.join(asked.withColumn("_asked", F.lit(True)), keys, "left").withColumn(
        "is_available", F.col("is_available") & F.col("_asked").isNull()
    )
    return WriteSet(edges=marked.select(*edges.columns), log=log)


def reconcile_multi_refs(
    catalog: Catalog, entity_type: str, batch: DataFrame, stamp: Stamp, all_slots: bool = False
) -> WriteSet:
    """Replace the live edges of each multivalued slot by the lists in the batch.

    The batch holds one row per id. A scalar counts as a one-item list and NULL
    items are dropped. Slots absent from the batch keep their edges unless
    ``all_slots``.
    """
    edges = catalog.edges
    slots = [s.name for s in catalog.schema.edge_slots(entity_type)]
    present = [s for s in slots if s in batch.columns]
    touched = slots if all_slots else present
    owner = batch.select(F.col("id").alias("source_id"))
    mine = F.col("relationship_type").isin(touched) & F.col("is_available")
    old = edges.where(mine).join(owner, "source_id", "left_semi")
    kinds = dict(batch.dtypes)
    parts = []
    for name in present:
        items = F.col(name) if kinds[name].startswith("array") else F.array(F.col(name))
        parts.append(
            batch.select(
                F.col("id").alias("source_id"), F.explode(items).alias("target_id"),
                F.lit(name).alias("relationship_type"),
            ).where(F.col("target_id").isNotNull())
        )
    removed = event(old, stamp, F.col("source_id"), "relationship", "relationship_remove", edge_patch())
    # edges that cannot lose their place meet no join; of the others a reader of live edges sorts those that stay
    other = edges.where(~F.coalesce(mine, F.lit(False)))
    stays = edges.where(mine).join(owner, "source_id", "left_anti").select(*edges.columns)
    gone = old.withColumn("is_available", F.lit(False)).select(*edges.columns)
    marked = union_all([other, stays, gone])
    if not parts:
        return WriteSet(edges=marked, log=removed)
    fresh = new_edges(union_all(parts).distinct(), stamp)
    fresh = fresh.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in edges.schema.fields])
    added = event(fresh, stamp, F.col("source_id"), "relationship", "relationship_add", edge_patch())
    return WriteSet(edges=marked.unionByName(fresh), log=removed.unionByName(added))


def register_external_ids(
    catalog: Catalog, entity_type: str, rows: DataFrame, stamp: Stamp
) -> WriteSet:
    """``rows(entity, value, source_system)``: new active mappings and their events."""
    parents = among(catalog.table(entity_type), rows, "entity").select(F.col("id").alias("entity"))
    if rows.join(parents, "entity", "left_anti").head(1):
        raise QueryError("an external id names an entity that does not exist")
    return _new_mappings(rows, entity_type, stamp)


def _new_mappings(rows: DataFrame, entity_type: str, stamp: Stamp) -> WriteSet:
    when = F.lit(stamp.timestamp).cast(T.TimestampNTZType()).cast("string")
    mapping = rows.select(
        F.sha2(F.concat_ws("|", F.col("entity").cast("string"), "value", "source_system", when), 256).alias("id"),
        "value", "source_system", "entity", F.lit(True).alias("is_active"),
    )
    made = event(
        mapping.withColumn("entity_id", F.col("id")), stamp, F.col("entity_id"), "ExternalID", "create",
        image(["value", "source_system", "entity", "is_active"]),
    )
    told = event(
        mapping, stamp, F.col("entity").cast("string"), entity_type, "external_id_add",
        F.to_json(F.struct(F.col("value").alias("external_id"), "source_system")),
    )
    return WriteSet(new_mappings=mapping, log=made.unionByName(told))


def supersede_external_ids(
    external_ids: DataFrame, entity_type: str, rows: DataFrame, stamp: Stamp
) -> WriteSet:
    """``rows(entity, old_value, new_value, source_system)``: the active old
    mapping is deactivated and a new one added, linked by a supersede event."""
    keys = ["entity", "value", "source_system"]
    asked = rows.select("entity", F.col("old_value").alias("value"), "source_system", "new_value")
    active = external_ids.where("is_active").select("id", *keys)
    if asked.join(active, keys, "left_anti").head(1):
        raise QueryError("no active external id to supersede")
    old = active.join(asked, keys)
    fresh = _new_mappings(
        old.select("entity", F.col("new_value").alias("value"), "source_system"), entity_type, stamp
    )
    link = event(
        old, stamp, F.col("entity").cast("string"), entity_type, "supersede",
        F.to_json(F.struct(F.col("value").alias("old_external_id"), F.col("new_value").alias("new_external_id"))),
        derived_from=F.col("id"),
    )
    marked = external_ids.join(old.select("id", F.lit(True).alias("_old")), "id", "left").withColumn(
        "is_active", F.col("is_active") & F.col("_old").isNull()
    ).select(*external_ids.columns)
    new_rows = fresh.new_mappings.select(
        *[F.col(f.name).cast(f.dataType).alias(f.name) for f in external_ids.schema.fields]
    )
    return WriteSet(external_ids=marked.unionByName(new_rows), log=fresh.log.unionByName(link))


def batch_put(
    catalog: Catalog,
    batches: dict[str, DataFrame],
    stamp: Stamp,
    new_edge_rows: DataFrame | None = None,
    dry_run: bool = False,
    **validation,
) -> dict[str, WriteSet] | DataFrame:
    """Several classes and edges, all or nothing: everything is validated before
    anything is returned to write. A dry run returns the plan instead."""
    from .validate import check_edges, require_valid, validate_batch

    batches = {name: assign_ids(df) for name, df in batches.items()}
    # References may point into the same batch.
    merged = Catalog(
        catalog.schema, dict(catalog.tables), catalog.edges, catalog.log, global_ids=catalog.global_ids
    )
    sets = {}
    for name, df in batches.items():
        sets[name] = put(merged, name, df, stamp)
        merged.tables[name] = sets[name].entities
        if sets[name].edges is not None:  # a later class starts from these edges
            merged.edges = sets[name].edges
    findings = [validate_batch(df, merged, name, **validation) for name, df in batches.items()]
    if new_edge_rows is not None:
        live = union_all([merged.live(n).select("id") for n in merged.tables])
        fresh = new_edges(new_edge_rows, stamp)
        findings.append(check_edges(fresh, live, batch=True))
        log = event(fresh, stamp, F.col("source_id"), "relationship", "relationship_add", edge_patch())
        sets["relationships"] = WriteSet(new_edges=fresh, log=log)
    require_valid(union_all(findings))
    if dry_run:
        return union_all(
            [
                s.report.groupBy("operation").agg(F.count("*").alias("n")).withColumn("entity_type", F.lit(n))
                for n, s in sets.items()
                if s.report is not None
            ]
        )
    return sets


def first_in_batch(batch: DataFrame, key: str, order: str) -> DataFrame:
    """Mark each row ``first`` or not within its external id.

    The winning position per id is a combined ``min``. It joins back on (id,
    position), so the copies of one id spread over all tasks.
    """
    winners = first_positions(batch, key, order).withColumn("_won", F.lit(True))
    return batch.join(winners, [key, order], "left").withColumn(
        "is_first", F.coalesce("_won", F.lit(False))
    ).drop("_won")


def first_positions(batch: DataFrame, key: str, order: str) -> DataFrame:
    """(key, order): the smallest position of every external id."""
    return batch.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(order).alias(order))


def classify_changes(incoming: DataFrame, stored: DataFrame, key: str, columns: Iterable[str]) -> DataFrame:
    """created / updated / unchanged by null-safe equality of all values."""
    columns = list(columns)
    old = stored.select(key, F.struct(*columns).alias("_old"), F.lit(True).alias("_has"))
    new = F.struct(*columns)
    return incoming.join(old, key, "left").withColumn(
        "outcome",
        F.when(F.col("_has").isNull(), "created")
        .when(new.eqNullSafe(F.col("_old")), "unchanged")
        .otherwise("updated"),
    ).drop("_old", "_has")


def apply_release_diff(
    base: DataFrame, key: str, added: DataFrame, changed: DataFrame, obsoleted: DataFrame
) -> DataFrame:
    """base without obsoleted and replaced rows, plus changed and added; added wins."""
    upserts = changed.join(added.select(key), key, "left_anti").unionByName(added)
    gone = obsoleted.select(key).unionByName(upserts.select(key)).distinct()
    return base.join(gone, key, "left_anti").unionByName(upserts).orderBy(key)


def upsert_by_external_id(
    batch: DataFrame,
    key: str,
    order: str,
    stored: DataFrame,
    mappings: DataFrame,
    columns: Iterable[str],
    carried: Iterable[str] = (),
) -> DataFrame:
    """Outcome per input row of an upsert by external id.

    ``stored(id, ...)`` are live entities, ``mappings(value, entity)`` the active
    mapping per value (see ``external.get_by_external_id``). Rows without an id
    or repeating one earlier in the batch are errors. ``carried`` columns of the entity
    found come along.
    """
    columns = list(columns)
    value = F.col(key).cast("string")
    old = stored.select(
        F.col("id").alias("_id"), F.struct(*columns).alias("_old"), F.lit(True).alias("_has"), *carried
    )
    # Only first rows can match: each id looks its entity up once, and what was found goes
    # to its row by (id, position), so that copies of one id do not meet in one task.
    winners = first_positions(batch, key, order)
    mapped = mappings.select(F.col("value").alias("_value"), F.col("entity").alias("_entity"))
    found = winners.join(mapped, value == F.col("_value")).join(old, F.col("_entity") == F.col("_id")).drop("_value", "_id")
    joined = batch.join(winners.withColumn("_won", F.lit(True)), [key, order], "left").join(found, [key, order], "left")
    same = F.struct(*columns).eqNullSafe(F.col("_old"))
    outcome = (
        F.when(F.col(key).isNull() | F.col("_won").isNull(), "error")
        .when(F.col("_has").isNull(), "created")
        .when(same, "unchanged")
        .otherwise("updated")
    )
    error = F.when(F.col(key).isNull(), F.lit(f"no value in {key}")).when(
        F.col("_won").isNull(), F.concat(F.lit(f"{key} "), value, F.lit(" came earlier in the batch"))
    )
    made = {"outcome": outcome, "error": error, "entity": F.col("_entity"), **{n: F.col(n) for n in carried}}
    return joined.select(*batch.columns, *[c.alias(n) for n, c in made.items()])


def stored_lists(catalog: Catalog, ids: DataFrame, slots: list[str]) -> DataFrame:
    """(id, one sorted array per slot) of the live edges of ``ids(id)``."""
    mine = F.col("relationship_type").isin(slots) & F.col("is_available")
    edges = catalog.edges.where(mine).join(ids.select(F.col("id").alias("source_id")), "source_id", "left_semi")
    lists = [
        F.array_sort(F.collect_set(F.when(F.col("relationship_type") == s, F.col("target_id")))).alias(s) for s in slots
    ]
    return edges.groupBy(F.col("source_id").alias("id")).agg(*lists)


def as_lists(df: DataFrame, slots: list[str], kind: T.DataType) -> DataFrame:
    """Each slot as a sorted array of different items; a scalar is a list of one, an absent slot an empty one."""
    have, empty = dict(df.dtypes), F.array().cast(T.ArrayType(kind))
    out = {}
    for name in slots:
        if name in have:
            items = F.col(name) if have[name].startswith("array") else F.array(name)
            out[name] = F.array_sort(F.array_distinct(F.array_compact(F.coalesce(items.cast(T.ArrayType(kind)), empty))))
        else:
            out[name] = empty
    return df.withColumns(out) if out else df


def run_loader(
    fetch,
    catalog: Catalog,
    entity_type: str,
    stamp: Stamp,
    key: str,
    order: str,
    mappings: DataFrame,
    transform=None,
    since: Any = None,
    dry_run: bool = False,
    checks: Iterable = (),
    source_system: str = "loader",
) -> DataFrame | WriteSet:
    """fetch -> map -> validate -> upsert; what is wrong with a row stops that row only.

    ``fetch(since)`` and ``transform(df)`` are callables over DataFrames, ``checks``
    callables from rows (``id`` is the row's ``order``) to findings, beside the schema's.
    The outcome of every row is in the report: created, updated, unchanged or error, with
    the findings as ``error``. Rows without external id are created. A list replaces the
    edges of its slot and counts when rows are compared; a slot that the feed lacks is empty.

    The fetched rows are written out once, with what the schema finds in each, so entities,
    edges, mappings and log come from the same rows whatever the source does meanwhile. They
    are dealt by ``order``, as a batch may come in a few small files. Their outcomes are
    written out once too, and all that is returned is cut from those.
    """
    from .validate import messages_of

    rows = fetch(since)
    rows = transform(rows) if transform is not None else rows
    rows = stable(rows.withColumn("_found", messages_of(catalog.schema, entity_type, rows)).repartition(order))
    table = catalog.table(entity_type)
    columns = [c for c in _data_columns(table) if c in rows.columns]
    slots = [s.name for s in catalog.schema.edge_slots(entity_type)] if catalog.edges is not None else []
    if checks:
        named = rows.drop("_found").withColumn("id", F.col(order).cast("string"))
        found = union_all([check(named) for check in checks])
        bad = found.groupBy(F.col("entity_id").alias("_row")).agg(F.collect_set("message").alias("_told"))
        rows = stable(rows.join(bad, F.col(order).cast("string") == F.col("_row"), "left").drop("_row"))
        rows = rows.withColumn("_found", F.when(F.col("_told").isNull(), F.col("_found")).otherwise(
            F.array_union(F.coalesce("_found", F.array().cast("array<string>")), "_told"))).drop("_told")
    judged = rows.withColumn("_wrong", F.array_join(F.array_sort("_found"), "; ")).drop("_found")
    good = judged.where("_wrong IS NULL").drop("_wrong")
    live = catalog.live(entity_type)
    if slots:
        kind = catalog.edges.schema["target_id"].dataType
        good = as_lists(good, slots, kind)
        asked = good.select(F.col(key).cast("string").alias("value"))
        ids = mappings.join(asked, "value", "left_semi").select(F.col("entity").alias("id"))
        live = as_lists(live.drop(*slots).join(stored_lists(catalog, ids, slots), "id", "left"), slots, kind)
    outcomes = upsert_by_external_id(good, key, order, live.withColumn("_by", F.col("superseded_by")), mappings, [*columns, *slots], ["_by"])
    outcomes = outcomes.withColumn("outcome", F.when(F.col(key).isNull(), "created").otherwise(F.col("outcome")))
    outcomes = outcomes.withColumn("error", F.when(F.col("outcome") == "error", F.col("error")))
    wrong = judged.where("_wrong IS NOT NULL").withColumns({"outcome": F.lit("error"), "error": F.col("_wrong")}).drop("_wrong")
    report = outcomes.unionByName(wrong, allowMissingColumns=True)
    if dry_run:
        return report.drop("_by")
    name = F.coalesce(F.concat(F.lit("="), F.col(key).cast("string")), F.concat(F.lit("row "), F.col(order).cast("string"), F.lit(f" {stamp.timestamp}")))
    made_id = F.sha2(F.concat_ws("|", F.lit(entity_type), name), 256)
    if dict(table.dtypes)["id"] != "string":
        made_id = F.xxhash64(F.lit(entity_type), name)
    told = stable(report.withColumn("_id", F.coalesce(F.col("entity").cast(table.schema["id"].dataType), made_id)))
    report = told.drop("_id", "_by")
    batch = told.where(F.col("outcome").isin("created", "updated")).withColumn("id", F.col("_id")).drop("_id")
    created = batch.where("outcome = 'created'").select("id")
    taken = among(table, created).select("id").head(1)
    if taken:
        raise QueryError(f"the id {taken[0][0]!r} made for a new {entity_type} is taken")
    rows = batch.select("id", *columns, *slots)
    refuse_bad_ids(catalog, entity_type, rows)
    # the outcome tells what is stored: an updated row has a live entity, a created one none
    written = _shape(batch, table.drop("is_available", "superseded_by"), [*slots, "outcome", "_by"])
    written = written.withColumns({"is_available": F.lit(True), "superseded_by": F.col("_by")})
    out = _written(catalog, entity_type, rows, written, F.when(F.col("outcome") == "created", "create").otherwise("update"), stamp)
    fresh = batch.where((F.col("outcome") == "created") & F.col(key).isNotNull()).select(
        F.col("id").alias("entity"), F.col(key).cast("string").alias("value"), F.lit(source_system).alias("source_system")
    )
    mapped = _new_mappings(fresh, entity_type, stamp)
    return WriteSet(
        entities=out.entities,
        changed=out.changed,
        log=out.log.withColumn("entity_id", F.col("entity_id").cast("string")).unionByName(mapped.log),
        edges=out.edges,
        new_mappings=mapped.new_mappings,
        report=report,
    )
