"""Typed descriptors of entity classes and the catalog of DataFrames behind them.

Five logical tables carry everything:

* one DataFrame per entity class: ``id, is_available, superseded_by`` + slot columns
* ``edges``: ``id, source_id, target_id, relationship_type, metadata, created_at,
  created_by, is_available``
* ``log``: ``id, entity_id, entity_type, operation, actor_id, timestamp,
  schema_version, derived_from_id, process_id, patch, context``
* ``external_ids``: ``id, value, source_system, entity, is_active``
* ``write_log``: ``loader_name, version, entity_id, entity_type, written_at``
"""

from __future__ import annotations

from collections import ChainMap
from collections.abc import Mapping
from dataclasses import dataclass, field
from functools import cached_property
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


class QueryError(ValueError):
    """A request the library refuses rather than answer wrongly."""


# Scalar range -> Spark type.
RANGE_TYPES: dict[str, T.DataType] = {
    "string": T.StringType(),
    "uri": T.StringType(),
    "uriorcurie": T.StringType(),
    "curie": T.StringType(),
    "ncname": T.StringType(),
    "jsonpointer": T.StringType(),
    "jsonpath": T.StringType(),
    "sparqlpath": T.StringType(),
    "integer": T.LongType(),
    "float": T.DoubleType(),
    "double": T.DoubleType(),
    "decimal": T.DecimalType(38, 18),
    "boolean": T.BooleanType(),
    "date": T.DateType(),
    "datetime": T.TimestampNTZType(),
    "time": T.StringType(),
}

SYSTEM_COLUMNS = ("id", "is_available", "superseded_by")

LOG_COLUMNS = (
    "id", "entity_id", "entity_type", "operation", "actor_id", "timestamp",
    "schema_version", "derived_from_id", "process_id", "patch", "context",
)

EDGE_COLUMNS = (
    "id", "source_id", "target_id", "relationship_type", "metadata",
    "created_at", "created_by", "is_available",
)

# Operations of the provenance log.
OPERATIONS = (
    "create", "update", "availability_change", "supersede",
    "relationship_add", "relationship_remove",
    "external_id_add", "external_id_remove",
    "migration_applied", "reference_data_installed", "recipe_imported",
)


@dataclass(frozen=True)
class Slot:
    """One slot of an entity class. ``reference`` names the target class."""

    name: str
    range: str = "string"
    reference: str | None = None
    multivalued: bool = False
    required: bool = False
    permissible: tuple[str, ...] = ()
    pattern: str | None = None
    minimum: float | None = None
    maximum: float | None = None
    unique: bool = False
    searchable: bool = False
    xref: bool = False
    default: Any = None

    @property
    def is_edge(self) -> bool:
        """Multivalued references live in the edge table and have no column."""
        return self.reference is not None and self.multivalued

    @property
    def spark_type(self) -> T.DataType:
        base = RANGE_TYPES.get(self.range, T.StringType())
        return T.ArrayType(base) if self.multivalued else base


@dataclass(frozen=True)
class EntityType:
    name: str
    slots: tuple[Slot, ...] = ()
    parent: str | None = None
    abstract: bool = False
    designator: str | None = None


@dataclass(frozen=True)
class Schema:
    """A closed set of entity classes; inherited slots resolve through ``parent``."""

    types: tuple[EntityType, ...]

    @cached_property
    def by_name(self) -> dict[str, EntityType]:
        return {t.name: t for t in self.types}

    def type(self, name: str) -> EntityType:
        if name not in self.by_name:
            raise QueryError(f"unknown entity type {name!r}")
        return self.by_name[name]

    def ancestors(self, name: str) -> list[str]:
        line, current = [], name
        while current is not None and current not in line:
            line.append(current)
            current = self.type(current).parent
        return line

    def descendants(self, name: str) -> list[str]:
        """The class itself and everything that inherits from it."""
        return [t.name for t in self.types if name in self.ancestors(t.name)]

    def slots(self, name: str) -> dict[str, Slot]:
        """Own and inherited slots; a subclass overrides its parent's slot."""
        induced: dict[str, Slot] = {}
        for owner in reversed(self.ancestors(name)):
            induced.update({s.name: s for s in self.type(owner).slots})
        return induced

    def columns(self, name: str) -> list[str]:
        return [s.name for s in self.slots(name).values() if not s.is_edge]

    def references(self, name: str) -> list[Slot]:
        """Single-valued reference slots (foreign-key columns)."""
        return [s for s in self.slots(name).values() if s.reference and not s.multivalued]

    def edge_slots(self, name: str) -> list[Slot]:
        return [s for s in self.slots(name).values() if s.is_edge]

    def searchable(self, name: str) -> list[Slot]:
        return [s for s in self.slots(name).values() if s.searchable]

    def struct(self, name: str) -> T.StructType:
        """The class's data columns as a StructType (for parsing post-images)."""
        slots = self.slots(name)
        return T.StructType(
            [T.StructField(c, slots[c].spark_type) for c in self.columns(name)]
        )


@dataclass
class Catalog:
    """The schema together with the DataFrames that hold its data."""

    schema: Schema
    tables: Mapping[str, DataFrame] = field(default_factory=dict)
    edges: DataFrame | None = None
    log: DataFrame | None = None
    external_ids: DataFrame | None = None
    write_log: DataFrame | None = None
    #: An id names one entity over all classes; off where each class counts its own.
    global_ids: bool = True

    def table(self, entity_type: str) -> DataFrame:
        if entity_type not in self.tables:
            raise QueryError(f"no table for entity type {entity_type!r}")
        return self.tables[entity_type]

    def live(self, entity_type: str) -> DataFrame:
        return self.table(entity_type).where("is_available")

    def live_edges(self) -> DataFrame:
        return self.edges.where("is_available")

    def registry(self) -> DataFrame:
        """``(id, entity_type)`` over every class, unavailable rows included."""
        parts = [
            df.select("id", F.lit(name).alias("entity_type"))
            for name, df in self.tables.items()
        ]
        return union_all(parts)

    def with_table(self, entity_type: str, df: DataFrame) -> "Catalog":
        tables = ChainMap({entity_type: df}, self.tables)
        return Catalog(
            self.schema, tables, self.edges, self.log, self.external_ids, self.write_log, self.global_ids
        )


def union_all(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return out
