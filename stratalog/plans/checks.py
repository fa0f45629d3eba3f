"""Validation over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..model import union_all
from ..operators import aggregate as ag
from ..operators import external as ext
from ..operators import validate as va
from .registry import query
from .relations import XREF_SQL, xref_rows
from .tables import Tables


def keyed(df):
    """The columns the comparisons look at."""
    return df.select("entity_id", "rule", "field")


PART_CHECKS = """SELECT CAST(id AS VARCHAR) AS entity_id, 'pattern' AS rule, 'brand' AS field FROM part_e WHERE NOT regexp_matches(brand, '^Brand#[0-9]$') {live}
  UNION ALL SELECT CAST(id AS VARCHAR), 'minimum', 'size' FROM part_e WHERE size < 5 {live}
  UNION ALL SELECT CAST(id AS VARCHAR), 'maximum', 'size' FROM part_e WHERE size > 45 {live}"""
ORDER_CHECKS = "SELECT CAST(id AS VARCHAR) AS entity_id, 'required' AS rule, 'priority' AS field FROM order_e WHERE priority IS NULL {live}"
CUSTOMER_CHECKS = """SELECT CAST(id AS VARCHAR) AS entity_id, 'enum' AS rule, 'segment' AS field FROM customer_e
  WHERE segment NOT IN ('AUTOMOBILE', 'BUILDING', 'FURNITURE', 'MACHINERY') {live}"""


@query("check_schema", " UNION ALL ".join(q.format(live="") for q in (PART_CHECKS, ORDER_CHECKS, CUSTOMER_CHECKS)))
def check_schema(t: Tables):
    names = ("Part", "Order", "Customer")
    return keyed(union_all([va.check_schema(t.catalog.table(n), t.catalog.schema, n) for n in names]))


def broken_orders(t: Tables):
    """Orders of which some point at customers that do not exist or are themselves."""
    return t.role("order_e").withColumn(
        "customer",
        F.when(F.col("id") % 9 == 0, F.col("customer") + 10_000_000).when(F.col("id") % 9 == 1, F.col("id")).otherwise(F.col("customer")),
    )


@query("check_references", "SELECT CAST(id AS VARCHAR) AS entity_id, 'reference' AS rule, 'customer' AS field FROM order_e WHERE id % 9 = 0 OR (id % 9 = 1 AND id NOT IN (SELECT id FROM customer_e))")
def check_references(t: Tables):
    return keyed(va.check_references(t.catalog, "Order", broken_orders(t)))


@query(
    "check_polymorphic_refs",
    """SELECT CAST(id AS VARCHAR) AS entity_id, 'polymorphic_reference' AS rule, 'party' AS field FROM order_e WHERE id % 9 IN (0, 1)""",
)
def check_polymorphic_refs(t: Tables):
    g = t.global_catalog
    last = F.substring_index("id", "/", -1).cast("bigint") % 9
    rows = g.table("Order").withColumn(
        "party", F.when(last == 0, F.lit("Customer/none")).when(last == 1, F.lit("Region/1")).otherwise(F.col("customer"))
    )
    found = va.check_polymorphic_refs(rows, "Order", "party", "Party", t.catalog.schema, g.registry())
    return keyed(found.withColumn("entity_id", F.substring_index("entity_id", "/", -1)))


@query(
    "check_unique_live",
    """SELECT CAST(min(id) AS VARCHAR) AS entity_id, 'unique' AS rule, 'name' AS field FROM part_e WHERE is_available
    GROUP BY name HAVING count(*) > 1""",
)
def check_unique_live(t: Tables):
    from ..model import Catalog, EntityType, Schema, Slot

    schema = Schema((EntityType("Part", (Slot("name", unique=True),)),))
    return keyed(va.check_unique_live(Catalog(schema, {"Part": t.role("part_e")}), "Part"))


@query("check_unique_keys", "SELECT source_system, value, count(*) AS n FROM ext_e WHERE is_active GROUP BY source_system, value HAVING count(*) > 1")
def check_unique_keys(t: Tables):
    return va.check_unique_keys(t.role("ext_e"))


@query(
    "check_xref_unique",
    f"""SELECT system, value, count(*) AS n, min(entity_id) AS first_entity, max(entity_id) AS last_entity
    FROM ({XREF_SQL}) x GROUP BY system, value HAVING count(*) > 1""",
)
def check_xref_unique(t: Tables):
    return va.check_xref_unique(ext.xref_index(xref_rows(t)))


@query("preset_ref_check", "SELECT CAST(id AS VARCHAR) AS entity_id, 'ref_check' AS rule, 'owner' AS field FROM order_e WHERE id % 9 = 0 OR (id % 9 = 1 AND id NOT IN (SELECT id FROM customer_e))")
def preset_ref_check(t: Tables):
    rows = broken_orders(t).select("id", F.struct(F.col("customer").alias("id")).alias("owner"))
    check = va.preset_ref_check([{"field": "owner", "entity_type": "Customer"}], t.catalog)
    return keyed(check(rows, "Order"))


@query("preset_count", "SELECT CAST(vec_id AS VARCHAR) AS entity_id, 'count_constraint' AS rule, 'high' AS field FROM embeddings WHERE len(list_filter(embedding, lambda x: x > 0.1)) > 12")
def preset_count(t: Tables):
    rows = t.raw("embeddings").select(F.col("vec_id").alias("id"), F.filter("embedding", lambda x: x > F.lit(0.1).cast("float")).alias("high"))
    return keyed(va.preset_count([{"field": "high", "max_count": 12}])(rows, "Embedding"))


@query("preset_immutable", "SELECT CAST(id AS VARCHAR) AS entity_id, 'immutable_field' AS rule, 'segment' AS field FROM customer_e WHERE id % 3 = 0 AND id % 4 <> 0")
def preset_immutable(t: Tables):
    stored = t.role("customer_e").withColumn("segment", F.when(F.col("id") % 4 != 0, F.col("segment")))
    rows = t.role("customer_e").withColumn("segment", F.when(F.col("id") % 3 == 0, "MOVED").otherwise(F.col("segment")))
    return keyed(va.preset_immutable([{"field": "segment"}], stored)(rows, "Customer"))


@query("preset_required_if", "SELECT CAST(id AS VARCHAR) AS entity_id, 'field_required_if' AS rule, 'priority' AS field FROM order_e WHERE status = 'F' AND priority IS NULL")
def preset_required_if(t: Tables):
    check = va.preset_required_if([{"field": "priority", "when_field": "status", "when_value": "F"}])
    return keyed(check(t.role("order_e"), "Order"))


@query(
    "preset_no_self_ref",
    """SELECT CAST(id AS VARCHAR) AS entity_id, 'no_self_ref' AS rule, 'related' AS field FROM order_e WHERE id % 7 = 3 OR id = customer""",
)
def preset_no_self_ref(t: Tables):
    other = F.when(F.col("id") % 7 == 3, F.col("id")).otherwise(F.lit(-1).cast("bigint"))
    rows = t.role("order_e").select(
        "id", F.array(F.struct(F.col("customer").alias("id"), F.array(other).alias("more"))).alias("related")
    )
    return keyed(va.preset_no_self_ref([{"field": "related"}])(rows, "Order"))


RULES = [
    va.Rule("positive_balance", "balance > 0", "{name}: {entity_type} {entity_id} is in debt", ("Customer",), priority=20),
    [va.Rule("building_rich", "balance > 5000", "poor builder {entity_id}", ("Customer",), when="segment = 'BUILDING'", priority=10)],
    va.Rule("has_vat", "vat IS NOT NULL", "no vat", ("Customer",), when="nation = 3"),
    va.Rule("on_delete", "false", "never", ("Customer",), on=("delete",)),
    va.Rule("orders_only", "false", "never", ("Order",)),
]


@query(
    "rule_engine",
    """SELECT CAST(id AS VARCHAR) AS entity_id, 'positive_balance' AS rule,
      concat('positive_balance: Customer ', CAST(id AS VARCHAR), ' is in debt') AS message FROM customer_e WHERE NOT balance > 0
    UNION ALL SELECT CAST(id AS VARCHAR), 'building_rich', concat('poor builder ', CAST(id AS VARCHAR)) FROM customer_e
      WHERE segment = 'BUILDING' AND NOT balance > 5000
    UNION ALL SELECT CAST(id AS VARCHAR), 'has_vat', 'no vat' FROM customer_e WHERE nation = 3""",
)
def rule_engine(t: Tables):
    return va.rule_engine(t.role("customer_e"), "Customer", RULES).select("entity_id", "rule", "message")


@query(
    "rule_expand",
    """SELECT CAST(o.id AS VARCHAR) AS entity_id, 'buyer_in_debt' AS rule FROM order_e o
    LEFT JOIN (SELECT * FROM customer_e WHERE is_available) c ON c.id = o.customer
    WHERE o.is_available AND NOT coalesce(c.balance >= 1000, FALSE)""",
)
def rule_expand(t: Tables):
    rule = va.Rule("buyer_in_debt", "customer_expanded.balance >= 1000", "no", expand=("customer",))
    return va.rule_expand(t.catalog, "Order", [rule]).select("entity_id", "rule")


@query(
    "check_provenance",
    """SELECT CAST(id AS VARCHAR) AS entity_id, CASE WHEN id IN (SELECT l_orderkey FROM lineitem WHERE l_shipdate >= TIMESTAMP '1997-01-01')
      THEN 'no create record' ELSE 'no provenance records' END AS message
    FROM order_e WHERE is_available AND ordered_at < TIMESTAMP '1997-01-01'""",
)
def check_provenance(t: Tables):
    log = t.order_log.where("timestamp >= TIMESTAMP_NTZ '1997-01-01 00:00:00'")  # a log cut off at that day
    return va.check_provenance(t.role("order_e"), "Order", log).select("entity_id", "message")


@query(
    "check_type_conflict",
    """SELECT id, min(entity_type) AS first_type, max(entity_type) AS last_type FROM (
      SELECT id, 'Customer' AS entity_type FROM customer_e UNION ALL SELECT id, 'Supplier' FROM supplier_e
      UNION ALL SELECT id, 'Part' FROM part_e) x GROUP BY id HAVING count(DISTINCT entity_type) > 1""",
)
def check_type_conflict(t: Tables):
    registry = t.catalog.registry().where(F.col("entity_type").isin("Customer", "Supplier", "Part"))
    return va.check_type_conflict(registry)


@query(
    "check_edges",
    """SELECT CAST(id AS VARCHAR) AS entity_id, 'empty_type' AS rule, 'relationship_type' AS field FROM link_e WHERE id % 5 = 0
    UNION ALL SELECT CAST(id AS VARCHAR), 'self_edge', 'target_id' FROM link_e WHERE source_id = target_id
    UNION ALL SELECT CAST(id AS VARCHAR), 'missing_endpoint', 'source_id' FROM link_e WHERE source_id NOT IN (SELECT id FROM customer_e WHERE is_available)
    UNION ALL SELECT CAST(id AS VARCHAR), 'missing_endpoint', 'target_id' FROM link_e WHERE target_id NOT IN (SELECT id FROM customer_e WHERE is_available)""",
)
def check_edges(t: Tables):
    edges = t.role("link_e").withColumn(
        "relationship_type", F.when(F.col("id") % 5 == 0, " ").otherwise(F.col("relationship_type"))
    )
    return keyed(va.check_edges(edges, t.catalog.live("Customer")))


@query(
    "check_append_only",
    """SELECT CAST(id AS VARCHAR) AS entity_id, CASE WHEN operation = 'update' THEN 'record removed' ELSE 'record updated' END AS message
    FROM log_e WHERE operation = 'update' OR actor_id = 'actor3'""",
)
def check_append_only(t: Tables):
    kept = t.log.where("operation <> 'update'")
    newer = kept.withColumn("actor_id", F.when(F.col("actor_id") == "actor3", "intruder").otherwise(F.col("actor_id")))
    return va.check_append_only(t.log, newer).select("entity_id", "message")


@query(
    "fail_fast_vs_all",
    """SELECT CAST(id AS VARCHAR) AS entity_id, CASE WHEN NOT regexp_matches(brand, '^Brand#[0-9]$') THEN 'pattern'
      WHEN size < 5 THEN 'minimum' ELSE 'maximum' END AS rule FROM part_e
    WHERE NOT regexp_matches(brand, '^Brand#[0-9]$') OR size < 5 OR size > 45""",
)
def fail_fast_vs_all(t: Tables):
    every = va.check_schema(t.role("part_e"), t.catalog.schema, "Part")
    return va.fail_fast(every, ["schema:pattern", "schema:minimum", "schema:maximum"]).select("entity_id", "rule")


ALL_PART = f"SELECT * FROM ({PART_CHECKS.format(live='')}) x"


@query(
    "validation_summary",
    f"""SELECT p.id, p.id AS position, count(x.entity_id) = 0 AS is_valid, count(x.entity_id) AS failures FROM part_e p
    LEFT JOIN ({ALL_PART}) x ON x.entity_id = CAST(p.id AS VARCHAR) GROUP BY p.id""",
)
def validation_summary(t: Tables):
    every = va.check_schema(t.role("part_e"), t.catalog.schema, "Part").withColumn(
        "entity_id", F.col("entity_id").cast("bigint")
    )
    return ag.validation_summary(t.role("part_e"), every).drop("first_message")


@query(
    "validate_batch",
    f"""{PART_CHECKS.format(live='')}
    UNION ALL SELECT CAST(id AS VARCHAR), 'cheap', '' FROM part_e WHERE price < 1000
    UNION ALL SELECT CAST(id AS VARCHAR), 'typed', '' FROM part_e WHERE type = 'PROMO'
    UNION ALL SELECT CAST(id AS VARCHAR), 'field_required_if', 'type' FROM part_e WHERE id % 3 = 0 AND brand = 'Brand#1'""",
)
def validate_batch(t: Tables):
    batch = t.role("part_e").withColumn("kind", F.col("type"))
    batch = batch.withColumn("type", F.when(~((F.col("id") % 3 == 0) & (F.col("brand") == "Brand#1")), F.col("type")))
    found = va.validate_batch(
        batch, t.catalog, "Part",
        presets=[va.preset_required_if([{"field": "type", "when_field": "brand", "when_value": "Brand#1"}])],
        rules=[va.Rule("cheap", "price >= 1000", "too cheap")],
        validators=[va.WriteValidator("typed", lambda df: F.col("kind") != "PROMO")],
    )
    return keyed(found)


@query(
    "end_to_end_gate",
    " UNION ALL ".join(q.format(live="AND is_available") for q in (PART_CHECKS, ORDER_CHECKS)),
)
def end_to_end_gate(t: Tables):
    return keyed(va.end_to_end_gate(t.catalog, ["Part", "Order"]))


# Extension surface.


@query("custom_validator", "SELECT CAST(id AS VARCHAR) AS entity_id, 'not_too_big' AS rule FROM order_e WHERE total > 400000")
def custom_validator(t: Tables):
    check = va.WriteValidator("not_too_big", lambda df: F.col("total") <= 400000, ("Order",))
    return check.run(t.role("order_e"), "Order").select("entity_id", "rule")


@query("preset_registry", "SELECT CAST(id AS VARCHAR) AS entity_id, 'upper' AS rule FROM part_e WHERE size > 40")
def preset_registry(t: Tables):
    registry = va.preset_registry()

    def upper(fields):
        def run(df, entity_type):
            return va.explode_findings(
                df, entity_type, [F.when(F.col(f["field"]) > f["max"], va.finding("preset", "upper", f["field"], "too big")) for f in fields]
            )

        return run

    registry.register("upper", upper)
    return registry.create("upper", [{"field": "size", "max": 40}])(t.role("part_e"), "Part").select("entity_id", "rule")


@query(
    "rule_file",
    "SELECT CAST(id AS VARCHAR) AS entity_id, 'solvent' AS rule FROM customer_e WHERE balance < 100",
)
def rule_file(t: Tables):
    import json

    text = json.dumps(
        [[{"name": "solvent", "entity_types": ["Customer"], "on": ["create"], "condition": "balance >= 100", "error": "{name}"}]]
    )
    rules = va.rules_from_config(json.loads(text))
    return va.rule_engine(t.role("customer_e"), "Customer", rules).select("entity_id", "rule")
