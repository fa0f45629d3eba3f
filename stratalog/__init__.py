"""Entity, edge and provenance analytics as plain PySpark DataFrame functions."""

from .model import Catalog, EntityType, QueryError, Schema, Slot

__all__ = ["Catalog", "EntityType", "QueryError", "Schema", "Slot"]
