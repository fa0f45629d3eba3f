"""Counts, facets, ranges and summaries. All combine before the shuffle."""

from __future__ import annotations

from typing import Any, Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.predicates import read_filters
from ..model import Catalog, QueryError, union_all
from .read import find


def count_matching(catalog: Catalog, entity_type: str, **criteria) -> DataFrame:
    return find(catalog, entity_type, **criteria).agg(F.count("*").alias("n"))


def count_all_classes(catalog: Catalog, filters: Iterable[dict] = (), filter_mode: str = "and") -> DataFrame:
    """Matches over every class; a class without a filtered field adds none."""
    filters = list(filters)
    fields = {x.field for x in read_filters(filters)}
    parts = [
        find(catalog, name, filters, filter_mode).agg(F.count("*").alias("n"))
        for name, df in catalog.tables.items()
        if fields <= set(df.columns)
    ]
    if not parts:
        raise QueryError(f"no class has the fields {sorted(fields)}")
    return union_all(parts).agg(F.sum("n").alias("n"))


def facet_counts(catalog: Catalog, entity_type: str, field: str, **criteria) -> DataFrame:
    """Rows per value, NULL left out, largest first, then by value."""
    if field not in catalog.table(entity_type).columns:
        raise QueryError(f"unknown facet field {field!r}")
    return (
        find(catalog, entity_type, **criteria)
        .where(F.col(field).isNotNull())
        .groupBy(F.col(field).alias("value"))
        .agg(F.count("*").alias("n"))
        .orderBy(F.col("n").desc(), F.col("value").asc())
    )


def field_range(catalog: Catalog, entity_type: str, field: str, **criteria) -> DataFrame:
    if field not in catalog.table(entity_type).columns:
        raise QueryError(f"unknown range field {field!r}")
    return find(catalog, entity_type, **criteria).agg(
        F.min(field).alias("lowest"), F.max(field).alias("highest")
    )


def count_relationship(catalog: Catalog, entity_type: str, slot: str) -> DataFrame:
    """Live edges to live targets of one multivalued slot, per live entity.

    Edges are counted per (source, target) before the target join, so a hot
    source reaches it as at most one row per distinct target.
    """
    target = catalog.schema.slots(entity_type)[slot].reference
    pairs = (
        catalog.live_edges()
        .where(F.col("relationship_type") == slot)
        .groupBy("source_id", "target_id")
        .agg(F.count("*").alias("k"))
    )
    alive = catalog.live(target).select(F.col("id").alias("target_id"))
    counts = (
        pairs.join(alive, "target_id", "left_semi")
        .groupBy(F.col("source_id").alias("id"))
        .agg(F.sum("k").alias("n"))
    )
    return (
        catalog.live(entity_type)
        .select("id")
        .join(counts, "id", "left")
        .select("id", F.coalesce("n", F.lit(0)).cast("long").alias("n"))
    )


def entity_counts(catalog: Catalog) -> DataFrame:
    """Rows per class, unavailable ones included."""
    return union_all(
        [
            df.agg(F.count("*").alias("n")).select(F.lit(name).alias("entity_type"), "n")
            for name, df in catalog.tables.items()
        ]
    )


def live_types(catalog: Catalog, names: Iterable[str] | None = None) -> DataFrame:
    """Classes that hold at least one live row."""
    wanted = list(names) if names is not None else list(catalog.tables)
    return union_all(
        [
            catalog.live(name).limit(1).select(F.lit(name).alias("entity_type"))
            for name in wanted
        ]
    )


def load_breakdown(write_log: DataFrame, loader: str, version: Any) -> DataFrame:
    """Rows written per class by one (loader, version), and their total."""
    own = write_log.where((F.col("loader_name") == loader) & (F.col("version") == F.lit(version)))
    per_type = own.groupBy("entity_type").agg(F.count("*").alias("n"))
    total = per_type.agg(F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("n")).select(
        F.lit("total").alias("entity_type"), "n", F.lit(1).alias("last")
    )
    return (
        per_type.withColumn("last", F.lit(0))
        .unionByName(total)
        .orderBy("last", F.col("n").desc(), "entity_type")
        .drop("last")
    )


def ingest_summary(outcomes: DataFrame) -> DataFrame:
    """One row of counts over an ``outcome`` column."""
    kinds = {"created": "created", "updated": "updated", "unchanged": "unchanged", "errors": "error"}
    return outcomes.agg(
        F.count("*").alias("total_rows"),
        *[F.count(F.when(F.col("outcome") == v, 1)).alias(k) for k, v in kinds.items()],
    )


def validation_summary(entities: DataFrame, violations: DataFrame, order: str = "id") -> DataFrame:
    """Failures per input row in input order, zero for valid rows."""
    failures = violations.groupBy(F.col("entity_id").alias("id")).agg(
        F.count("*").alias("failures"), F.min("message").alias("first_message")
    )
    keys = entities.select(*dict.fromkeys(["id", order]))
    return (
        keys.join(failures, "id", "left")
        .select(
            "id", order if order != "id" else F.col("id").alias("position"),
            F.col("failures").isNull().alias("is_valid"),
            F.coalesce("failures", F.lit(0)).cast("long").alias("failures"),
            "first_message",
        )
    )


def all_valid(violations: DataFrame) -> DataFrame:
    """The overall verdict as one row."""
    return violations.agg((F.count("*") == 0).alias("is_valid"), F.count("*").alias("failures"))
