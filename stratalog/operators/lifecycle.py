"""Jobs over whole releases: migration, reference loads, pruning, evolution."""

from __future__ import annotations

import json
from typing import Any, Callable, Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..model import Catalog, QueryError, Schema
from .aggregate import live_types
from .mutate import Stamp, WriteSet, event, new_edges, put, soft_delete
from .validate import check_schema, require_valid

MIGRATE_KEY = "predecessor"


def migrate_rows(
    catalog: Catalog,
    source: str,
    target: str,
    transform: Callable[[DataFrame], DataFrame],
    stamp: Stamp,
) -> dict[str, WriteSet]:
    """One migration hop: live rows of ``source`` become rows of ``target``.

    ``transform`` returns new rows with a ``predecessor`` column (an id, so a
    split repeats it and a merge gives several rows of one ``id``). New ids are
    digests of class, version and key. The gate runs before anything is built;
    predecessors then retire and are superseded by their successor.
    """
    new = transform(catalog.live(source))
    if MIGRATE_KEY not in new.columns or "id" not in new.columns:
        raise QueryError("a migration returns id and predecessor")
    # Of several rows of one id, that of the smallest predecessor is written.
    columns = [c for c in new.columns if c not in ("id", MIGRATE_KEY)]
    chosen_row = F.min(F.struct(MIGRATE_KEY, *columns)).alias("row")
    data = new.groupBy("id").agg(chosen_row).select("id", *[F.col(f"row.{c}").alias(c) for c in columns])
    require_valid(check_schema(data, catalog.schema, target))
    links = new.select(F.col(MIGRATE_KEY).alias("id"), F.col("id").alias("successor")).distinct()
    # One successor per predecessor is recorded on the row, all of them as edges.
    chosen = links.groupBy("id").agg(F.min("successor").alias("successor"))
    old_table = catalog.table(source)
    retired = (
        old_table.join(chosen, "id", "left")
        .withColumn("is_available", F.col("is_available") & F.col("successor").isNull())
        .withColumn("superseded_by", F.coalesce(F.col("superseded_by"), F.col("successor").cast(old_table.schema["superseded_by"].dataType)))
        .select(*old_table.columns)
    )
    # Reconstructions go by availability events, so the retirement is one, before the reason for it.
    away = event(
        chosen, stamp, F.col("id"), source, "availability_change",
        F.to_json(F.struct(F.lit(False).alias("is_available"), F.lit("migrated").alias("reason"))),
    )
    gone = event(
        links, stamp, F.col("id"), source, "supersede",
        F.to_json(F.struct(F.col("successor").alias("superseded_by"))),
    )
    edges = new_edges(
        links.select(
            F.col("id").alias("source_id"), F.col("successor").alias("target_id"),
            F.lit("superseded_by").alias("relationship_type"),
        ),
        stamp,
    )
    log = away.unionByName(gone)
    written = put(catalog.with_table(source, retired), target, data, stamp)
    if source == target:  # one snapshot holds what retired and what is new
        both = log.unionByName(written.log)
        return {target: WriteSet(entities=written.entities, changed=written.changed, log=both, edges=written.edges, new_edges=edges)}
    return {source: WriteSet(entities=retired, log=log, new_edges=edges), target: written}


def migrate_chain(
    catalog: Catalog, hops: Iterable[tuple[str, str, Callable[[DataFrame], DataFrame]]], stamp: Stamp
) -> Catalog:
    """Several hops, each reading only the live output of the one before."""
    for source, target, transform in hops:
        out = migrate_rows(catalog, source, target, transform, stamp)
        catalog = catalog.with_table(source, out[source].entities)
        catalog = catalog.with_table(target, out[target].entities)
    return catalog


def load_reference(
    catalog: Catalog,
    entity_type: str,
    release: DataFrame,
    loader: str,
    version: str,
    stamp: Stamp,
) -> tuple[WriteSet, DataFrame]:
    """Write a release under (loader, version). A version already in the write
    log loads nothing again."""
    from ..sources.sinks import write_log_rows

    done = catalog.write_log.where(
        (F.col("loader_name") == loader) & (F.col("version") == version)
    ).agg(F.count("*")).scalar()
    pending = release.where(done == 0)
    out = put(catalog, entity_type, pending, stamp)
    rows = write_log_rows(catalog.write_log, pending.select("id"), loader, version, entity_type, stamp.timestamp)
    return out, rows


def prune_version(
    catalog: Catalog, loader: str, version: str | None, entity_types: Iterable[str] | None = None
) -> tuple[dict[str, DataFrame], DataFrame]:
    """Hard-delete what (loader, version) wrote, even if a later version rewrote
    it. ``version=None`` prunes every version. With ``entity_types`` only these
    classes lose rows, in their tables and in the write log."""
    names = list(entity_types or catalog.tables)
    mine = (F.col("loader_name") == loader) & F.col("entity_type").isin(names)
    if version is not None:
        mine = mine & (F.col("version") == version)
    doomed = catalog.write_log.where(mine).select(F.col("entity_id").alias("id"), "entity_type")
    tables = {}
    for name in names:
        table = catalog.table(name)
        key = table.schema["id"].dataType
        ids = doomed.where(F.col("entity_type") == name).select(F.col("id").cast(key).alias("id"))
        tables[name] = except_pruned(table, ids)
    return tables, catalog.write_log.where(~mine)


def prune_loader(catalog: Catalog, loader: str, entity_types: Iterable[str] | None = None):
    return prune_version(catalog, loader, None, entity_types)


def except_pruned(table: DataFrame, ids: DataFrame) -> DataFrame:
    return table.join(ids, "id", "left_anti")


def evolve_columns(
    df: DataFrame, schema: Schema, entity_type: str
) -> tuple[DataFrame, list[str], list[str]]:
    """Add declared columns a table lacks. Returns (table, added, warnings)."""
    added, warnings, out = [], [], {}
    for slot in schema.slots(entity_type).values():
        if slot.is_edge or slot.name in df.columns:
            continue
        out[slot.name] = F.lit(slot.default).cast(slot.spark_type)
        added.append(slot.name)
        if slot.required and slot.default is None and not df.isEmpty():
            warnings.append(f"{slot.name} is required but has no default for existing rows")
    return (df.withColumns(out) if out else df), added, warnings


def backfill_write_log(
    nested: DataFrame, registry: DataFrame, written_at: Any, column: str = "payload"
) -> DataFrame:
    """Nested JSON ``{loader: {version: [ids]}}`` to write-log rows with the class
    of each id; ids of no known class are left out."""
    kind = T.MapType(T.StringType(), T.MapType(T.StringType(), T.ArrayType(T.StringType())))
    flat = (
        nested.select(F.from_json(column, kind).alias("m"))
        .select(F.explode("m").alias("loader_name", "versions"))
        .select("loader_name", F.explode("versions").alias("version", "ids"))
        .select("loader_name", "version", F.explode("ids").alias("entity_id"))
        .distinct()
    )
    known = registry.select(F.col("id").cast("string").alias("entity_id"), "entity_type")
    return flat.join(known, "entity_id").select(
        "loader_name", "version", "entity_id", "entity_type",
        F.lit(written_at).cast(T.TimestampNTZType()).alias("written_at"),
    )


def retire_classes(
    catalog: Catalog, names: Iterable[str], stamp: Stamp, force: bool = False
) -> dict[str, WriteSet]:
    """Refuse while a class holds live rows; forced, soft-delete them all."""
    names = list(names)
    if not force:
        held = [r[0] for r in live_types(catalog, names).collect()]
        if held:
            raise QueryError(f"live rows in {sorted(held)}")
    return {n: soft_delete(catalog, n, catalog.live(n).select("id"), stamp) for n in names}


def load_rule_file(path: str):
    """Rules from a JSON file (the dict form of YAML rule files)."""
    from .validate import rules_from_config

    with open(path, encoding="utf-8") as handle:
        decoded = json.load(handle)
    return rules_from_config(decoded["validators"] if isinstance(decoded, dict) else decoded)
