"""Joins over the edge table: hydration, expansion, lookups."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import Catalog, QueryError, union_all
from .ranking import position_in_group
from .read import find
from .temporal import temporal_summary_of


def semi_to_one(catalog: Catalog, entity_type: str, edge: str, where: dict) -> DataFrame:
    """Rows whose referenced row exists, is live and satisfies ``where``."""
    return find(catalog, entity_type, where={"edge": edge, "where": where})


def semi_some(catalog: Catalog, entity_type: str, edge: str, where: dict) -> DataFrame:
    return find(catalog, entity_type, where={"edge": edge, "quantifier": "some", "where": where})


def anti_none(catalog: Catalog, entity_type: str, edge: str, where: dict) -> DataFrame:
    return find(catalog, entity_type, where={"edge": edge, "quantifier": "none", "where": where})


def multi_refs(catalog: Catalog, entity_type: str) -> DataFrame:
    """``(id, slot, target_id, created_at, edge_id)`` of every multivalued slot.

    The long form: insertion order is ``(created_at, edge_id)``, no group is
    gathered anywhere.
    """
    slots = [s.name for s in catalog.schema.edge_slots(entity_type)]
    return catalog.live_edges().where(F.col("relationship_type").isin(slots)).select(
        F.col("source_id").alias("id"),
        F.col("relationship_type").alias("slot"),
        "target_id",
        "created_at",
        F.col("id").alias("edge_id"),
    )


def hydrate_multi_refs(catalog: Catalog, entity_type: str) -> DataFrame:
    """Each live entity with its targets in the long form: a row per slot and target.

    ``ordinal`` counts the targets of a slot in insertion order from 0; an entity
    without targets has one row with NULLs. The grain is the same for any number of
    targets; a caller that wants lists collects them by ordinal.
    """
    refs = multi_refs(catalog, entity_type)
    placed = position_in_group(refs, ["id", "slot"], ["created_at", "edge_id", "target_id"])
    return catalog.live(entity_type).join(placed.select("id", "slot", "ordinal", "target_id"), "id", "left")


def expand_path(catalog: Catalog, entity_type: str, path: str) -> DataFrame:
    """Resolve ``a.b.c`` level by level into nested structs.

    Single-valued steps become a struct (NULL when dangling). A multivalued step
    gives a row per target with its struct and its ordinal among the live targets,
    NULLs when there is none. The deepest step is built first so each level joins once.
    """
    steps = path.split(".")
    if len(set(steps)) != len(steps) and len(steps) > 10:
        raise QueryError(f"expand path {path!r} is too deep")
    return _expand(catalog, entity_type, steps, catalog.live(entity_type))


def _expand(catalog: Catalog, entity_type: str, steps: list[str], rows: DataFrame) -> DataFrame:
    if not steps:
        return rows
    slots = catalog.schema.slots(entity_type)
    slot = slots.get(steps[0])
    if slot is None or slot.reference is None:
        raise QueryError(f"{steps[0]!r} is not a reference slot of {entity_type}")
    children = _expand(catalog, slot.reference, steps[1:], catalog.live(slot.reference))
    child = children.select(F.col("id").alias("_target"), F.struct(*children.columns).alias("_child"))
    name = f"{slot.name}_expanded"
    if not slot.multivalued:
        return (
            rows.join(child, F.col(slot.name) == F.col("_target"), "left")
            .withColumnRenamed("_child", name)
            .drop("_target")
        )
    edges = (
        catalog.live_edges()
        .where(F.col("relationship_type") == slot.name)
        .select(F.col("source_id").alias("_source"), F.col("target_id").alias("_target"),
                F.col("created_at").alias("_at"), F.col("id").alias("_edge"))
    )
    # Only live targets are numbered, on the narrow edge rows; the targets join afterwards.
    live = catalog.live(slot.reference).select(F.col("id").alias("_target"))
    placed = position_in_group(edges.join(live, "_target", "left_semi"), ["_source"], ["_at", "_edge", "_target"])
    targets = placed.join(child, "_target").select(
        "_source", F.col("ordinal").alias(f"{slot.name}_ordinal"), F.col("_child").alias(name)
    )
    return rows.join(targets, F.col("id") == F.col("_source"), "left").drop("_source")


def resolve_types(catalog: Catalog, ids: DataFrame) -> DataFrame:
    """Class of each id, unavailable rows included, unknown ids dropped."""
    return catalog.registry().join(ids.select("id").distinct(), "id", "left_semi")


def find_relationships(
    edges: DataFrame, source_id: Any = None, target_id: Any = None, relationship_type: str | None = None
) -> DataFrame:
    rows = edges.where("is_available")
    for name, value in (
        ("source_id", source_id), ("target_id", target_id), ("relationship_type", relationship_type),
    ):
        if value is not None:
            rows = rows.where(F.col(name) == F.lit(value))
    return rows


def related_to(catalog: Catalog, source_type: str, target_id: Any, relationship_type: str | None = None) -> DataFrame:
    """Live entities pointing at an id, with edge type, data and temporal fields."""
    incoming = find_relationships(catalog.edges, None, target_id, relationship_type).select(
        F.col("source_id").alias("id"), "relationship_type", F.col("id").alias("edge_id")
    )
    sources = catalog.live(source_type).join(incoming, "id")
    summary = temporal_summary_of(catalog.log, incoming.select(F.col("id").alias("entity_id")))
    return sources.join(summary.withColumnRenamed("entity_id", "id"), "id", "left")


def column_edges(catalog: Catalog) -> DataFrame:
    """Single-valued references of all live rows as edges."""
    parts = []
    for name, df in catalog.tables.items():
        for slot in catalog.schema.references(name):
            parts.append(
                df.where(F.col("is_available") & F.col(slot.name).isNotNull()).select(
                    F.col("id").alias("source_id"),
                    F.col(slot.name).alias("target_id"),
                    F.lit(slot.name).alias("relationship_type"),
                    F.lit("COLUMN").alias("edge_source"),
                )
            )
    return union_all(parts)


def union_edge_stores(link_edges: DataFrame, columns: DataFrame) -> DataFrame:
    """Both stores, distinct; an edge in both counts as a link-table edge."""
    keys = ["source_id", "target_id", "relationship_type"]
    both = link_edges.select(*keys, F.lit(0).alias("rank")).unionByName(
        columns.select(*keys, F.lit(1).alias("rank"))
    )
    return (
        both.groupBy(*keys)
        .agg(F.min("rank").alias("rank"))
        .select(*keys, F.when(F.col("rank") == 0, "LINK_TABLE").otherwise("COLUMN").alias("edge_source"))
    )


def where_tree(catalog: Catalog, entity_type: str, where: dict) -> DataFrame:
    """Rows of a class under an and/or/not tree with relationship nodes."""
    return find(catalog, entity_type, where=where)
