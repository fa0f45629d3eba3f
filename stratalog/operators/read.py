"""Scans, filtered queries, ordering and paging over entity tables."""

from __future__ import annotations

from typing import Any, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.predicates import TreeCompiler, flat_condition, read_filters
from ..model import SYSTEM_COLUMNS, Catalog, QueryError, Schema, union_all
from .temporal import creation_time, temporal_summary, temporal_summary_of

COMPUTED_FIELDS = ("created_at", "updated_at", "schema_version", "created_by", "updated_by")


def scan_entities(catalog: Catalog, entity_type: str, **equals: Any) -> DataFrame:
    """Live rows of one class; keyword arguments are equality filters."""
    return find(catalog, entity_type, [equals] if equals else [])


def scan_all_classes(catalog: Catalog, columns: Iterable[str] | None = None) -> DataFrame:
    """Live rows of every class, tagged with ``entity_type``."""
    keep = set(columns) if columns is not None else None
    parts = []
    for name, df in catalog.tables.items():
        live = df.where("is_available")
        if keep is not None:
            live = live.select(*[c for c in live.columns if c in keep])
        parts.append(live.withColumn("entity_type", F.lit(name)))
    return union_all(parts)


def find(
    catalog: Catalog,
    entity_type: str,
    filters: Iterable[dict] = (),
    filter_mode: str = "and",
    where: dict | None = None,
    live_only: bool = True,
) -> DataFrame:
    """Rows of one class under flat filters AND a predicate tree."""
    base = catalog.table(entity_type)
    if live_only:
        base = base.where("is_available")
    aliased = base.alias("entity")
    condition = flat_condition(base.schema, filters, filter_mode, "entity")
    if condition is not None:
        aliased = aliased.where(condition)
    if where is not None:
        aliased = aliased.where(TreeCompiler(catalog).condition(where, base, "entity", entity_type))
    return aliased


def ordering(df: DataFrame, order_by: str, direction: str = "asc") -> list[Column]:
    """NULLs last both ways, ``id`` ascending as tiebreak."""
    if direction not in ("asc", "desc"):
        raise QueryError(f"order_dir is 'asc' or 'desc', got {direction!r}")
    if order_by in COMPUTED_FIELDS:
        raise QueryError(f"{order_by!r} is derived from the log and cannot order a query")
    if order_by not in df.columns:
        raise QueryError(f"unknown order_by column {order_by!r}")
    col = F.col(order_by)
    first = col.asc_nulls_last() if direction == "asc" else col.desc_nulls_last()
    return [first, F.col("id").asc()]


def order_by_slot(df: DataFrame, order_by: str, direction: str = "asc") -> DataFrame:
    return df.orderBy(*ordering(df, order_by, direction))


def order_by_created(entities: DataFrame, log: DataFrame) -> DataFrame:
    """Default order: derived ``created_at`` ascending, unknown first, then id."""
    return with_created(entities, log).orderBy(F.col("created_at").asc_nulls_first(), "id")


def with_created(entities: DataFrame, log: DataFrame) -> DataFrame:
    """Attach only ``created_at``: a plain minimum over the create events."""
    created = creation_time(log).withColumnRenamed("entity_id", "id")
    return entities.join(created, "id", "left")


def page(df: DataFrame, limit: int | None = None, offset: int | None = None) -> DataFrame:
    """``limit=0`` is an empty page, ``None`` is everything."""
    if offset:
        df = df.offset(offset)
    return df if limit is None else df.limit(limit)


def page_with_total(
    matched: DataFrame,
    order: list[Column],
    limit: int | None = None,
    offset: int | None = None,
) -> DataFrame:
    """A page whose rows carry ``total_count``, the size of the whole match set."""
    total = matched.agg(F.count("*")).scalar()
    return page(matched.orderBy(*order), limit, offset).withColumn("total_count", total)


def join_temporal(
    entities: DataFrame, log: DataFrame, as_of: Any = None, key: str = "id"
) -> DataFrame:
    """Attach the five derived temporal fields; rows without a log keep NULLs.

    ``validate.check_provenance`` lists the rows whose log is missing or lacks a
    create event.
    """
    summary = temporal_summary(log, as_of).withColumnRenamed("entity_id", key)
    return entities.join(summary, key, "left")


def filter_created_between(entities: DataFrame, log: DataFrame, start: Any, end: Any) -> DataFrame:
    """Inclusive window on the derived ``created_at``."""
    created = F.col("created_at")
    rows = with_created(entities, log)
    if start is not None:
        rows = rows.where(created >= F.lit(start).cast(T.TimestampNTZType()))
    if end is not None:
        rows = rows.where(created <= F.lit(end).cast(T.TimestampNTZType()))
    return rows


def query(
    catalog: Catalog,
    entity_type: str,
    filters: Iterable[dict] = (),
    filter_mode: str = "and",
    where: dict | None = None,
    order_by: str | None = None,
    order_dir: str = "asc",
    limit: int | None = None,
    offset: int | None = None,
    date_from: Any = None,
    date_to: Any = None,
) -> DataFrame:
    """The list query: filter, order, page, count, attach temporal fields.

    An explicit ``order_by`` ranks without the log; the default order needs only
    ``created_at`` of the match set. The other temporal fields are derived for
    the ids of the page.
    """
    matched = find(catalog, entity_type, filters, filter_mode, where)
    if order_by is not None:
        if date_from is not None or date_to is not None:
            raise QueryError("order_by cannot be combined with date_from / date_to")
        order = ordering(matched, order_by, order_dir)
        out = page_with_total(matched, order, limit, offset)
    else:
        dated = filter_created_between(matched, catalog.log, date_from, date_to)
        order = [F.col("created_at").asc_nulls_first(), F.col("id").asc()]
        out = page_with_total(dated, order, limit, offset).drop("created_at")
    if catalog.log is None:
        return out
    summary = temporal_summary_of(catalog.log, out.select(F.col("id").alias("entity_id")))
    return out.join(summary.withColumnRenamed("entity_id", "id"), "id", "left").orderBy(*order)


def get_by_id(
    catalog: Catalog, entity_type: str, ids: DataFrame, include_unavailable: bool = False
) -> DataFrame:
    """Batch point lookup: rows for ``ids(id)`` with their temporal fields."""
    rows = catalog.table(entity_type) if include_unavailable else catalog.live(entity_type)
    hits = rows.join(ids.select("id"), "id", "left_semi")
    summary = temporal_summary_of(catalog.log, ids.select(F.col("id").alias("entity_id")))
    return hits.join(summary.withColumnRenamed("entity_id", "id"), "id", "left")


def get_any(catalog: Catalog, entity_type: str, ids: DataFrame) -> DataFrame:
    return get_by_id(catalog, entity_type, ids, include_unavailable=True)


def get_one(catalog: Catalog, entity_type: str, entity_id: Any, include_unavailable: bool = False):
    """One row or a refusal, as a Row."""
    rows = catalog.table(entity_type).where(F.col("id") == F.lit(entity_id))
    if not include_unavailable:
        rows = rows.where("is_available")
    events = catalog.log.where(F.col("entity_id") == F.lit(entity_id))
    found = join_temporal(rows, events).head(1)
    if not found:
        raise QueryError(f"{entity_type} {entity_id!r} not found")
    return found[0]


def project_to_schema(df: DataFrame, schema: Schema, entity_type: str) -> DataFrame:
    """Keep declared slots only; system and unknown columns go."""
    return df.select(*[c for c in schema.columns(entity_type) if c in df.columns])


def decode_values(df: DataFrame, schema: Schema, entity_type: str) -> DataFrame:
    """Storage text and 0/1 flags to declared types; JSON text to arrays/structs."""
    slots = schema.slots(entity_type)
    have = dict(df.dtypes)
    changed = {}
    for name, slot in slots.items():
        if name not in have or slot.is_edge:
            continue
        target = slot.spark_type
        if slot.multivalued and have[name] == "string":
            changed[name] = F.from_json(F.col(name), target)
        elif slot.range == "boolean" and have[name] != "boolean":
            changed[name] = F.col(name).try_cast("int") != 0
        elif have[name] != target.simpleString():
            changed[name] = F.col(name).try_cast(target)
    return df.withColumns(changed) if changed else df


def flatten_nested(df: DataFrame, delimiter: str = ".") -> DataFrame:
    """Struct fields become ``a.b`` columns; arrays stay as they are."""

    def leaves(struct: T.StructType, path: list[str]):
        for f in struct.fields:
            if isinstance(f.dataType, T.StructType):
                yield from leaves(f.dataType, path + [f.name])
            else:
                yield path + [f.name]

    return df.select(
        *[
            F.col(".".join(f"`{p}`" for p in path)).alias(delimiter.join(path))
            for path in leaves(df.schema, [])
        ]
    )


def expand_dotted(df: DataFrame, delimiter: str = ".") -> DataFrame:
    """The inverse of :func:`flatten_nested`, by regrouping column names."""
    tree: dict = {}
    for name in df.columns:
        node = tree
        *parents, last = name.split(delimiter)
        for part in parents:
            below = node.setdefault(part, {})
            if not isinstance(below, dict):
                raise QueryError(f"column {name!r} clashes with a scalar of the same path")
            node = below
        node[last] = name

    def build(value) -> Column:
        if isinstance(value, dict):
            return F.struct(*[build(v).alias(k) for k, v in value.items()])
        return F.col(f"`{value}`")

    return df.select(*[build(v).alias(k) for k, v in tree.items()])


def dispatch_by_type(
    df: DataFrame, schema: Schema, base: str, designator: str | None = None
) -> tuple[dict[str, DataFrame], DataFrame]:
    """Route rows of a base collection to the concrete class they name.

    Returns one DataFrame per class and the rejected rows with an ``error``.
    Rows without a designator stay in the base class; they are rejected when the
    base is abstract or when they fill a slot only a subclass declares.
    """
    designator = designator or schema.type(base).designator
    family = schema.descendants(base)
    concrete = [n for n in family if not schema.type(n).abstract]
    own = set(schema.slots(base)) | set(SYSTEM_COLUMNS) | {designator}
    extra = [c for c in df.columns if c not in own]
    named = F.col(designator) if designator in df.columns else F.lit(None).cast("string")
    target = F.coalesce(named, F.lit(base))
    filled = [F.col(c).isNotNull() for c in extra]
    misplaced = F.array_contains(F.array(*filled), True) if filled else F.lit(False)
    error = (
        F.when(~target.isin(family), F.concat(F.lit("unknown type "), target))
        .when(~target.isin(concrete), F.concat(F.lit("abstract type "), target))
        .when(
            (target == base) & misplaced,
            F.lit(f"{base} row fills slots of a subclass"),
        )
    )
    routed = df.withColumn("_class", target).withColumn("error", error)
    classes = {}
    for name in concrete:
        wanted = [c for c in df.columns if c in set(schema.slots(name)) | set(SYSTEM_COLUMNS)]
        classes[name] = routed.where(F.col("error").isNull() & (F.col("_class") == name)).select(*wanted)
    return classes, routed.where(F.col("error").isNotNull()).drop("_class")


def typed_compare_json(
    df: DataFrame, json_column: str, schema: Schema, entity_type: str, filters: Iterable[dict]
) -> DataFrame:
    """Filter on fields of a JSON column, compared as the slot's declared type."""
    slots = schema.slots(entity_type)
    for test in read_filters(filters):
        if test.field not in slots:
            return df.where(F.lit(False))
        dtype = slots[test.field].spark_type
        text = F.get_json_object(F.col(json_column), f"$.{test.field}")
        df = df.where(test.over(text.try_cast(dtype), dtype))
    return df


def scheme_of(uri: Column) -> Column:
    """Text before ``://``; ``https`` when there is none."""
    return F.when(F.contains(uri, F.lit("://")), F.split_part(uri, F.lit("://"), F.lit(1))).otherwise(
        F.lit("https")
    )


def drs_objects(entities: DataFrame, entity_type: str, log: DataFrame, host: str = "localhost") -> DataFrame:
    """Live rows with a ``uri`` as access objects."""
    files = entities.where(F.col("is_available") & (F.coalesce(F.col("uri"), F.lit("")) != ""))
    rows = join_temporal(files, log)
    key = F.col("id").cast("string")
    return rows.select(
        key.alias("id"),
        F.concat(F.lit(f"{entity_type}/"), key).alias("name"),
        F.concat(F.lit(f"drs://{host}/"), key).alias("self_uri"),
        F.col("created_at").alias("created_time"),
        F.col("updated_at").alias("updated_time"),
        F.array(
            F.struct(
                scheme_of(F.col("uri")).alias("type"),
                F.struct(F.col("uri").alias("url")).alias("access_url"),
            )
        ).alias("access_methods"),
    )
