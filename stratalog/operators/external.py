"""External identifiers and the cross-reference index."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import Catalog, Schema, union_all
from .latest import fetch_winners, order_code
from .temporal import creation_time

XREF = "array<struct<system:string,value:string>>"


def mapping_times(external_ids: DataFrame, log: DataFrame) -> DataFrame:
    """Mappings with the creation time of the mapping row itself."""
    created = creation_time(log).withColumnRenamed("entity_id", "id")
    asked = created.join(external_ids.select("id"), "id", "left_semi")
    return external_ids.join(asked, "id", "left")


def newest_mapping(mappings: DataFrame) -> DataFrame:
    """Newest active mapping per value; ``mappings`` carry ``created_at``."""
    never = F.lit("0001-01-01").cast("timestamp_ntz")
    active = mappings.where("is_active").withColumn("_at", F.coalesce("created_at", never))
    active = active.withColumn("_code", order_code(active, "_at"))
    newest = active.groupBy("value").agg(F.max("_code").alias("_code"), F.max("created_at").alias("created_at"))
    found = fetch_winners(newest, active, ["value"], "_code", "id", ["entity", "source_system", "id"])
    return found.select("value", "entity", "source_system", F.col("id").alias("mapping_id"), "created_at")


def get_by_external_id(
    external_ids: DataFrame, log: DataFrame, parents: DataFrame, values: DataFrame, include_archived: bool = False
) -> DataFrame:
    """Entity behind each ``values(value)``: the newest mapping with a readable parent.

    Unreadable parents are removed before the newest is chosen.
    """
    readable = parents if include_archived else parents.where("is_available")
    asked = external_ids.where("is_active").join(values.select("value").distinct(), "value", "left_semi")
    owned = asked.join(readable.select(F.col("id").alias("entity")), "entity", "left_semi")
    return newest_mapping(mapping_times(owned, log))


def list_external_ids(
    external_ids: DataFrame, log: DataFrame, entities: DataFrame | None = None, include_superseded: bool = False
) -> DataFrame:
    """Mappings of entities, newest first, with the time they were superseded."""
    rows = external_ids
    if entities is not None:
        rows = rows.join(entities.select(F.col("id").alias("entity")), "entity", "left_semi")
    if not include_superseded:
        rows = rows.where("is_active")
    superseded = (
        log.where((F.col("operation") == "supersede") & F.col("derived_from_id").isNotNull())
        .groupBy(F.col("derived_from_id").alias("id"))
        .agg(F.max("timestamp").alias("superseded_at"))
    )
    return (
        mapping_times(rows, log)
        .join(superseded, "id", "left")
        .select(
            "id",
            F.col("entity").alias("entity_id"),
            F.col("value").alias("external_id"),
            "source_system",
            "created_at",
            F.when(~F.col("is_active"), F.col("superseded_at")).alias("superseded_at"),
        )
        .orderBy(F.col("created_at").desc_nulls_last(), "id")
    )


def superseded_external_ids(external_ids: DataFrame, log: DataFrame, entities: DataFrame | None = None) -> DataFrame:
    return list_external_ids(external_ids, log, entities, True).where(F.col("superseded_at").isNotNull())


def xref_pairs(rows: DataFrame, entity_type: str, slot: str) -> DataFrame:
    """Explode one struct / array / JSON-text slot into (system, value) pairs."""
    kind = dict(rows.dtypes)[slot]
    col = F.col(slot)
    if kind == "string":
        one = F.from_json(col, "struct<system:string,value:string>")
        many = F.from_json(col, XREF)
        items = F.when(F.startswith(F.ltrim(col), F.lit("[")), many).otherwise(F.array(one))
    elif kind.startswith("struct"):
        items = F.array(F.struct(col["system"].cast("string").alias("system"), col["value"].cast("string").alias("value")))
    else:
        items = F.transform(
            col, lambda x: F.struct(x["system"].cast("string").alias("system"), x["value"].cast("string").alias("value"))
        )
    return (
        rows.select(F.col("id").alias("entity_id"), F.explode(items).alias("pair"))
        .where((F.col("pair.system") != "") & (F.col("pair.value") != ""))
        .select(
            "entity_id",
            F.lit(entity_type).alias("entity_type"),
            F.lit(slot).alias("slot"),
            F.col("pair.system").alias("system"),
            F.col("pair.value").alias("value"),
        )
    )


def xref_index(catalog: Catalog, schema: Schema | None = None) -> DataFrame:
    """``(entity_id, entity_type, slot, system, value)`` over all xref slots of live rows."""
    schema = schema or catalog.schema
    return union_all(
        [
            xref_pairs(catalog.live(name), name, slot.name)
            for name in catalog.tables
            for slot in schema.slots(name).values()
            if slot.xref
        ]
    )


def find_by_xref(index: DataFrame, pairs: DataFrame) -> DataFrame:
    """Entities behind ``pairs(system, value)``."""
    return index.join(pairs.select("system", "value").distinct(), ["system", "value"])


def list_xrefs(index: DataFrame, entity_id: Any) -> DataFrame:
    return index.where(F.col("entity_id") == F.lit(entity_id)).orderBy("slot", "system", "value")
