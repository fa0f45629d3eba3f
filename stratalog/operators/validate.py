"""Checks that produce violations:
``(entity_type, entity_id, tier, rule, field, message)``.

Row-local checks of a class run in one pass: each is a Column that is a struct
when violated and NULL when not, and the array of them explodes.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any, Callable, Iterable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..model import Catalog, QueryError, Schema, union_all
from .external import xref_index

COLUMNS = ("entity_type", "entity_id", "tier", "rule", "field", "message")


def finding(tier: str, rule: str, field_name: str, message: Column | str) -> Column:
    text = F.lit(message) if isinstance(message, str) else message
    return F.struct(
        F.lit(tier).alias("tier"), F.lit(rule).alias("rule"),
        F.lit(field_name).alias("field"), text.alias("message"),
    )


def explode_findings(df: DataFrame, entity_type: str, findings: list[Column]) -> DataFrame:
    """One row per finding that is not NULL."""
    if not findings:
        findings = [F.when(F.lit(False), finding("", "", "", ""))]
    hits = F.array_compact(F.array(*findings))
    return (
        df.select(F.col("id").cast("string").alias("entity_id"), F.explode(hits).alias("hit"))
        .select(
            F.lit(entity_type).alias("entity_type"), "entity_id",
            "hit.tier", "hit.rule", "hit.field", "hit.message",
        )
    )


def violations_of(df: DataFrame, entity_type: str, tier: str, rule: str, field_name: str, message: Column | str) -> DataFrame:
    """Rows that are violations already, shaped as such."""
    text = F.lit(message) if isinstance(message, str) else message
    return df.select(
        F.lit(entity_type).alias("entity_type"),
        F.col("id").cast("string").alias("entity_id"),
        F.lit(tier).alias("tier"), F.lit(rule).alias("rule"),
        F.lit(field_name).alias("field"), text.alias("message"),
    )


def schema_findings(schema: Schema, entity_type: str, have: dict[str, str]) -> list[Column]:
    """Required, type, enum, pattern, range and cardinality checks per slot."""
    out = []
    for name, slot in schema.slots(entity_type).items():
        if slot.is_edge:
            continue
        if name not in have:
            if slot.required:
                out.append(finding("schema", "required", name, f"{name} is required"))
            continue
        col = F.col(f"`{name}`")
        text = col.cast("string")
        if slot.required:
            out.append(F.when(col.isNull(), finding("schema", "required", name, f"{name} is required")))
        if slot.multivalued and not have[name].startswith("array"):
            out.append(F.when(col.isNotNull(), finding("schema", "multivalued", name, f"{name} must be a list")))
            continue
        if slot.multivalued:
            if slot.permissible:
                bad = F.exists(col, lambda x: ~x.isin(list(slot.permissible)))
                out.append(F.when(bad, finding("schema", "enum", name, f"{name} holds a value that is not allowed")))
            continue
        want = slot.spark_type.simpleString()
        if have[name] == "string" and want != "string":
            bad = col.isNotNull() & col.try_cast(want).isNull()
            out.append(F.when(bad, finding("schema", "type", name, F.concat(text, F.lit(f" is not a {slot.range}")))))
        if slot.permissible:
            bad = ~text.isin(list(slot.permissible))
            out.append(F.when(bad, finding("schema", "enum", name, F.concat(text, F.lit(f" is not allowed for {name}")))))
        if slot.pattern:
            bad = ~text.rlike(slot.pattern)
            out.append(F.when(bad, finding("schema", "pattern", name, F.concat(text, F.lit(f" does not match the pattern of {name}")))))
        number = col.try_cast("double") if have[name] == "string" else col
        if slot.minimum is not None:
            out.append(F.when(number < slot.minimum, finding("schema", "minimum", name, F.concat(F.lit(f"{name} is below {slot.minimum:g}")))))
        if slot.maximum is not None:
            out.append(F.when(number > slot.maximum, finding("schema", "maximum", name, F.concat(F.lit(f"{name} is above {slot.maximum:g}")))))
    return out


def check_schema(df: DataFrame, schema: Schema, entity_type: str) -> DataFrame:
    return explode_findings(df, entity_type, schema_findings(schema, entity_type, dict(df.dtypes)))


def messages_of(schema: Schema, entity_type: str, df: DataFrame) -> Column:
    """What :func:`check_schema` finds in a row, as an array of different messages; NULL if nothing."""
    findings = schema_findings(schema, entity_type, dict(df.dtypes))
    if not findings:
        return F.lit(None).cast("array<string>")
    hits = F.array_compact(F.array(*findings))
    return F.when(F.size(hits) > 0, F.array_distinct(F.array_compact(F.transform(hits, lambda hit: hit["message"]))))


def check_references(
    catalog: Catalog, entity_type: str, rows: DataFrame | None = None, whole: bool = False
) -> DataFrame:
    """Single-valued references whose target does not exist (unavailable ones do).

    For a batch the known ids are narrowed to those it names first, so a small
    batch does not shuffle the target table.
    """
    whole = whole or rows is None
    rows = catalog.table(entity_type) if whole else rows
    parts = []
    for slot in catalog.schema.references(entity_type):
        if slot.name not in rows.columns:
            continue
        known = catalog.table(slot.reference).select(F.col("id").alias("_known"))
        if not whole:
            known = known.join(rows.select(F.col(slot.name).alias("_known")), "_known", "left_semi")
        missing = rows.where(F.col(slot.name).isNotNull()).join(
            known, F.col(slot.name) == F.col("_known"), "left_anti"
        )
        message = F.concat(F.lit(f"{slot.name} refers to missing {slot.reference} "), F.col(slot.name).cast("string"))
        parts.append(violations_of(missing, entity_type, "schema", "reference", slot.name, message))
    return union_all(parts) if parts else explode_findings(rows.limit(0), entity_type, [])


def check_polymorphic_refs(
    rows: DataFrame, entity_type: str, slot: str, base: str, schema: Schema, registry: DataFrame
) -> DataFrame:
    """The target must exist under ``base`` or one of its subclasses."""
    found = registry.select(F.col("id").alias("_known"), F.col("entity_type").alias("_class"))
    checked = rows.where(F.col(slot).isNotNull()).join(found, F.col(slot) == F.col("_known"), "left")
    bad = checked.where(F.col("_class").isNull() | ~F.col("_class").isin(schema.descendants(base)))
    message = F.concat(
        F.lit(f"{slot} refers to "), F.coalesce("_class", F.lit("missing")), F.lit(" "), F.col(slot).cast("string")
    )
    return violations_of(bad, entity_type, "schema", "polymorphic_reference", slot, message)


def check_unique_live(catalog: Catalog, entity_type: str) -> DataFrame:
    """Values of unique slots held by several live rows, one violation per value.

    ``entity_id`` is the lowest holder. Counting combines before the shuffle, so
    a value copied over a large share of the rows costs no more than another.
    """
    live = catalog.live(entity_type)
    parts = []
    for slot in catalog.schema.slots(entity_type).values():
        if slot.unique:
            bad = (
                live.where(F.col(slot.name).isNotNull())
                .groupBy(slot.name)
                .agg(F.count("*").alias("n"), F.min("id").alias("id"))
                .where(F.col("n") > 1)
            )
            message = F.concat(
                F.lit(f"{slot.name} "), F.col(slot.name).cast("string"), F.lit(" is held by "), F.col("n").cast("string"), F.lit(" rows")
            )
            parts.append(violations_of(bad, entity_type, "schema", "unique", slot.name, message))
    return union_all(parts) if parts else explode_findings(live.limit(0), entity_type, [])


def check_unique_keys(external_ids: DataFrame, keys: Iterable[str] = ("source_system", "value")) -> DataFrame:
    """Key tuples held by several active mappings."""
    keys = list(keys)
    active = external_ids.where("is_active").dropna(subset=keys)
    return active.groupBy(*keys).agg(F.count("*").alias("n")).where(F.col("n") > 1)


def check_xref_unique(index: DataFrame) -> DataFrame:
    """(system, value) claimed more than once among live entities."""
    return (
        index.groupBy("system", "value")
        .agg(F.count("*").alias("n"), F.min("entity_id").alias("first_entity"), F.max("entity_id").alias("last_entity"))
        .where(F.col("n") > 1)
    )


# Presets: configured checks, each a factory of a validator.

Validator = Callable[[DataFrame, str], DataFrame]


def _ref_value(df: DataFrame, name: str) -> Column:
    dtype = df.select(name).schema[0].dataType
    return F.col(name)["id"] if isinstance(dtype, T.StructType) else F.col(name)


def preset_ref_check(fields: list[dict], catalog: Catalog) -> Validator:
    """``{"field", "entity_type"}``: a plain id or a struct's ``id`` must exist."""

    def run(df: DataFrame, entity_type: str) -> DataFrame:
        parts = []
        for f in fields:
            known = catalog.table(f["entity_type"]).select(F.col("id").alias("_known"))
            keyed = df.withColumn("_ref", _ref_value(df, f["field"])).where(F.col("_ref").isNotNull())
            bad = keyed.join(known, F.col("_ref") == F.col("_known"), "left_anti")
            message = F.concat(F.lit(f"{f['field']} refers to missing {f['entity_type']} "), F.col("_ref").cast("string"))
            parts.append(violations_of(bad, entity_type, "preset", "ref_check", f["field"], message))
        return union_all(parts)

    return run


def preset_count(fields: list[dict]) -> Validator:
    """``{"field", "max_count"}``: lists and maps stay within a size."""

    def run(df: DataFrame, entity_type: str) -> DataFrame:
        found = [
            F.when(
                F.size(f["field"]) > f["max_count"],
                finding("preset", "count_constraint", f["field"],
                        F.concat(F.lit(f"{f['field']} has "), F.size(f["field"]), F.lit(f" items, at most {f['max_count']}"))),
            )
            for f in fields
        ]
        return explode_findings(df, entity_type, found)

    return run


def preset_immutable(fields: list[dict], stored: DataFrame) -> Validator:
    """A stored value may be set once; changing it is a violation."""

    def run(df: DataFrame, entity_type: str) -> DataFrame:
        names = [f["field"] for f in fields]
        old = stored.select("id", *[F.col(n).alias(f"_old_{n}") for n in names])
        both = df.join(old, "id")
        found = [
            F.when(F.col(f"_old_{n}") != F.col(n), finding("preset", "immutable_field", n, f"{n} cannot be changed"))
            for n in names
        ]
        return explode_findings(both, entity_type, found)

    return run


def preset_required_if(fields: list[dict]) -> Validator:
    """``{"field", "when_field", "when_value"}``."""

    def run(df: DataFrame, entity_type: str) -> DataFrame:
        found = [
            F.when(
                F.col(f["when_field"]).eqNullSafe(F.lit(f["when_value"])) & F.col(f["field"]).isNull(),
                finding("preset", "field_required_if", f["field"],
                        f"{f['field']} is required when {f['when_field']} == {f['when_value']}"),
            )
            for f in fields
        ]
        return explode_findings(df, entity_type, found)

    return run


def _mentions(col: Column, dtype: T.DataType, own: Column) -> Column:
    if isinstance(dtype, T.StructType):
        out = F.lit(False)
        for f in dtype.fields:
            out = out | F.coalesce(_mentions(col.getField(f.name), f.dataType, own), F.lit(False))
        return out
    if isinstance(dtype, T.ArrayType):
        return F.coalesce(F.exists(col, lambda x: _mentions(x, dtype.elementType, own)), F.lit(False))
    if isinstance(dtype, T.MapType):
        return F.coalesce(F.exists(F.map_values(col), lambda x: _mentions(x, dtype.valueType, own)), F.lit(False))
    return F.coalesce(col.cast("string") == own, F.lit(False))


def preset_no_self_ref(fields: list[dict]) -> Validator:
    """The own id must not occur in the field, at any nesting."""

    def run(df: DataFrame, entity_type: str) -> DataFrame:
        own = F.col("id").cast("string")
        found = [
            F.when(
                _mentions(F.col(f["field"]), df.schema[f["field"]].dataType, own),
                finding("preset", "no_self_ref", f["field"], F.concat(F.lit(f"{f['field']} refers to its own entity "), own)),
            )
            for f in fields
        ]
        return explode_findings(df, entity_type, found)

    return run


@dataclass
class PresetRegistry:
    """Validator factories by name."""

    factories: dict[str, Callable[..., Validator]] = field(default_factory=dict)

    def register(self, name: str, factory: Callable[..., Validator]) -> None:
        self.factories[name] = factory

    def create(self, name: str, *args, **kwargs) -> Validator:
        if name not in self.factories:
            raise QueryError(f"unknown preset {name!r}")
        return self.factories[name](*args, **kwargs)


def preset_registry() -> PresetRegistry:
    return PresetRegistry(
        {
            "ref_check": preset_ref_check,
            "count_constraint": preset_count,
            "immutable_field": preset_immutable,
            "field_required_if": preset_required_if,
            "no_self_ref": preset_no_self_ref,
        }
    )


# Rules: conditions written as Spark SQL expressions.


@dataclass(frozen=True)
class Rule:
    name: str
    condition: str
    error: str
    entity_types: tuple[str, ...] = ()
    on: tuple[str, ...] = ("create", "update")
    when: str | None = None
    expand: tuple[str, ...] = ()
    priority: int = 100


def expand_nested_rules(items: Iterable[Any]) -> list[Any]:
    """Unroll nested lists of rules."""
    out: list[Any] = []
    for item in items:
        out.extend(expand_nested_rules(item) if isinstance(item, (list, tuple)) else [item])
    return out


def rules_from_config(items: Iterable[Any]) -> list[Rule]:
    """Rules from decoded JSON/YAML dicts."""
    rules = []
    for item in expand_nested_rules(items):
        known = {k: tuple(v) if isinstance(v, list) else v for k, v in item.items()}
        rules.append(Rule(**known))
    return rules


def _message(template: str, rule: Rule, entity_type: str) -> Column:
    text = template.replace("{name}", rule.name).replace("{entity_type}", entity_type)
    pieces: list[Column] = []
    for i, part in enumerate(text.split("{entity_id}")):
        if i:
            pieces.append(F.col("id").cast("string"))
        pieces.append(F.lit(part))
    return F.concat(*pieces)


def rule_engine(
    df: DataFrame,
    entity_type: str,
    rules: Iterable[Any],
    operation: str = "create",
) -> DataFrame:
    """Apply every matching rule in ascending priority; all rules run.

    A rule whose ``when`` is false is skipped. A condition over a field the rows
    do not have counts as false.
    """
    chosen = [
        r
        for r in expand_nested_rules(rules)
        if (not r.entity_types or entity_type in r.entity_types) and operation in r.on
    ]
    found = []
    for rule in sorted(chosen, key=lambda r: r.priority):
        bad = ~_holds(df, rule.condition)
        if rule.when is not None:
            bad = _holds(df, rule.when) & bad
        found.append(F.when(bad, finding("rule", rule.name, "", _message(rule.error, rule, entity_type))))
    return explode_findings(df, entity_type, found)


def _holds(df: DataFrame, expression: str) -> Column:
    """The condition as true/false; over a field the rows do not have it is false."""
    try:
        df.select(F.expr(expression))
    except AnalysisException as error:
        if "UNRESOLVED_COLUMN" in str(error) or "FIELD_NOT_FOUND" in str(error):
            return F.lit(False)
        raise QueryError(f"cannot evaluate {expression!r}: {error}") from error
    return F.coalesce(F.expr(expression), F.lit(False))


def rule_expand(catalog: Catalog, entity_type: str, rules: Iterable[Any], operation: str = "create") -> DataFrame:
    """Rules that see single-valued references as ``<slot>_expanded`` structs.

    Targets are attached by left joins on the reference, one per expanded slot.
    """
    rules = expand_nested_rules(rules)
    rows = catalog.live(entity_type)
    slots = catalog.schema.slots(entity_type)
    for name in dict.fromkeys(n for r in rules for n in r.expand):
        target = catalog.live(slots[name].reference)
        child = target.select(F.col("id").alias("_target"), F.struct(*target.columns).alias(f"{name}_expanded"))
        rows = rows.join(child, F.col(name) == F.col("_target"), "left").drop("_target")
    return rule_engine(rows, entity_type, rules, operation)


def check_provenance(entities: DataFrame, entity_type: str, log: DataFrame) -> DataFrame:
    """Live entities without events, or with events but no create."""
    seen = log.groupBy(F.col("entity_id").alias("id")).agg(
        F.count(F.when(F.col("operation") == "create", 1)).alias("creates")
    )
    checked = entities.where("is_available").join(seen, "id", "left").where(
        F.col("creates").isNull() | (F.col("creates") == 0)
    )
    message = F.when(F.col("creates").isNull(), "no provenance records").otherwise("no create record")
    return violations_of(checked, entity_type, "provenance", "integrity", "", message)


def check_type_conflict(registry: DataFrame) -> DataFrame:
    """Ids registered under more than one class."""
    return (
        registry.groupBy("id")
        .agg(F.min("entity_type").alias("first_type"), F.max("entity_type").alias("last_type"))
        .where(F.col("first_type") != F.col("last_type"))
    )


def check_edges(edges: DataFrame, live_ids: DataFrame, batch: bool = False) -> DataFrame:
    """Empty type, self edge, endpoint missing or unavailable.

    ``batch`` narrows the live ids to the named ones first.
    """
    local = explode_findings(
        edges,
        "relationship",
        [
            F.when(F.coalesce(F.trim("relationship_type"), F.lit("")) == "", finding("edge", "empty_type", "relationship_type", "relationship type is empty")),
            F.when(F.col("source_id") == F.col("target_id"), finding("edge", "self_edge", "target_id", "an entity cannot relate to itself")),
        ],
    )
    parts = [local]
    known = live_ids.select(F.col("id").alias("_known"))
    for end in ("source_id", "target_id"):
        # different ends only: a target of very many edges is one row before it meets the ids
        ends = edges.select(F.col(end).alias("_end")).distinct()
        near = known.join(ends, F.col("_known") == F.col("_end"), "left_semi") if batch else known
        lost = ends.join(near, F.col("_end") == F.col("_known"), "left_anti")
        bad = edges.join(lost, F.col(end).eqNullSafe(F.col("_end")), "left_semi")
        message = F.concat(F.lit(f"{end} not found: "), F.col(end).cast("string"))
        parts.append(violations_of(bad, "relationship", "edge", "missing_endpoint", end, message))
    return union_all(parts)


def check_append_only(old_log: DataFrame, new_log: DataFrame) -> DataFrame:
    """Rows of the old log that the new one no longer holds as they were.

    A whole-row digest keeps the comparison narrow: digests are matched with an
    anti join, which never ranks or multiplies copies of a row.
    """
    def digest(df: DataFrame) -> DataFrame:
        cols = [F.coalesce(F.col(c).cast("string"), F.lit("\u0000")) for c in sorted(old_log.columns)]
        return df.withColumn("_digest", F.sha2(F.concat_ws("\u0001", *cols), 256))

    def counted(df: DataFrame) -> DataFrame:
        return digest(df).groupBy("id", "_digest").agg(F.count("*").alias("n"))

    before = counted(old_log).alias("b")
    after = counted(new_log).alias("a")
    lost = before.join(
        after, (F.col("b.id") == F.col("a.id")) & (F.col("b._digest") == F.col("a._digest")), "left"
    ).where(F.coalesce(F.col("a.n"), F.lit(0)) < F.col("b.n")).select(F.col("b.id").alias("id"))
    still = new_log.select(F.col("id").alias("_id")).distinct()
    marked = lost.join(still, F.col("id") == F.col("_id"), "left")
    message = F.when(F.col("_id").isNull(), "record removed").otherwise("record updated")
    return violations_of(marked, "ProvenanceRecord", "provenance", "append_only", "", message)


def fail_fast(violations: DataFrame, order: list[str]) -> DataFrame:
    """First failing validator per entity in the given tier/rule order.

    ``min`` over a position combines before the shuffle, so an entity with very
    many findings is no hot group.
    """
    position = F.array_position(F.array(*[F.lit(x) for x in order]), F.concat_ws(":", "tier", "rule"))
    ranked = F.struct(position.alias("pos"), "tier", "rule", "field", "message")
    return (
        violations.groupBy("entity_type", "entity_id")
        .agg(F.min(ranked).alias("first"))
        .select("entity_type", "entity_id", "first.tier", "first.rule", "first.field", "first.message")
    )


@dataclass(frozen=True)
class WriteValidator:
    """A named user check: DataFrame in, violations out (or a boolean Column)."""

    name: str
    check: Callable[[DataFrame], Any]
    entity_types: tuple[str, ...] = ()
    tier: str = "python"
    priority: int = 100
    message: str = "rejected"

    def run(self, df: DataFrame, entity_type: str) -> DataFrame:
        if self.entity_types and entity_type not in self.entity_types:
            return explode_findings(df.limit(0), entity_type, [])
        answer = self.check(df)
        if isinstance(answer, Column):
            bad = ~F.coalesce(answer, F.lit(False))
            return explode_findings(df, entity_type, [F.when(bad, finding(self.tier, self.name, "", self.message))])
        return answer


TIERS = ("schema", "preset", "rule", "python")


def validate_batch(
    batch: DataFrame,
    catalog: Catalog,
    entity_type: str,
    presets: Iterable[Validator] = (),
    rules: Iterable[Rule] = (),
    validators: Iterable[WriteValidator] = (),
    operation: str = "create",
) -> DataFrame:
    """All findings of a batch, nothing written. Rows without id get one first
    (see ``mutate.assign_ids``)."""
    found = [
        check_schema(batch, catalog.schema, entity_type),
        check_references(catalog, entity_type, batch),
        *[p(batch, entity_type) for p in presets],
        rule_engine(batch, entity_type, rules, operation),
    ]
    for v in sorted(validators, key=lambda v: (TIERS.index(v.tier) if v.tier in TIERS else 99, v.priority)):
        found.append(v.run(batch, entity_type))
    return union_all(found)


def end_to_end_gate(catalog: Catalog, names: Iterable[str]) -> DataFrame:
    """Schema, reference and uniqueness findings over all live rows of classes."""
    parts = []
    for name in names:
        live = catalog.live(name)
        parts += [
            check_schema(live, catalog.schema, name),
            check_references(catalog, name, live, whole=True),
            check_unique_live(catalog, name),
        ]
        if any(s.xref for s in catalog.schema.slots(name).values()):
            index = xref_index(Catalog(catalog.schema, {name: catalog.table(name)}))
            clash = check_xref_unique(index).select(F.col("first_entity").alias("id"), "system", "value")
            parts.append(violations_of(clash, name, "schema", "xref_unique", "", F.concat_ws(":", "system", "value")))
    return union_all(parts)


def require_valid(violations: DataFrame) -> None:
    """Abort before any write when there is a finding."""
    first = violations.head(1)
    if first:
        raise QueryError(f"validation failed: {first[0].asDict()}")
