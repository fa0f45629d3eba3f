"""Mutations, lifecycle jobs and streams over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..model import Catalog, EntityType, Schema, Slot
from ..operators import lifecycle as lc
from ..operators import mutate as mu
from ..operators import temporal as tm
from ..runtime import scratch_path
from ..sources import store
from ..sources.readers import map_fields
from ..streaming import feed, jobs
from .registry import query
from .tables import Tables, told_id

STAMP = mu.Stamp("2025-01-01 00:00:00", "tester", schema_version="v9")


def part_batch(t: Tables):
    """The big parts changed, and as many new ones. Keys are not negative, so ids of new parts
    below zero are free however many parts there are; see :func:`.tables.told_id`."""
    changed = t.role("part_e").where("size > 25").select("id", F.upper("name").alias("name"), "brand", "type", "size", "price")
    return changed.unionByName(changed.withColumn("id", -1 - F.col("id")))


PUT_ROWS = """SELECT id, upper(name) AS name, is_available, 'update' AS operation FROM part_e WHERE size > 25
  UNION ALL SELECT id + 1000000, upper(name), TRUE, 'create' FROM part_e WHERE size > 25
  UNION ALL SELECT id, name, is_available, NULL FROM part_e WHERE size <= 25"""


@query("put", PUT_ROWS)
def put(t: Tables):
    out = mu.put(t.catalog, "Part", part_batch(t), STAMP)
    events = out.log.select(F.col("entity_id").alias("id"), "operation")
    return out.entities.select("id", "name", "is_available").join(events, "id", "left").withColumn("id", told_id())


@query(
    "update",
    """SELECT id AS entity_id, 'update' AS operation, upper(name) AS name FROM part_e""",
)
def update(t: Tables):
    batch = t.role("part_e").withColumn("name", F.upper("name"))
    log = mu.update(t.catalog, "Part", batch, STAMP).log
    return log.select("entity_id", "operation", F.get_json_object("patch", "$.name").alias("name"))


@query(
    "replace",
    """SELECT id, name, brand, n_edges FROM (
      SELECT o.id, CASE WHEN o.status = 'O' THEN 'F' ELSE o.status END AS name,
        CASE WHEN o.status = 'O' THEN NULL ELSE o.priority END AS brand,
        CASE WHEN o.status = 'O' THEN 0 ELSE (SELECT count(*) FROM edge_e e WHERE e.source_id = o.id AND e.is_available) END AS n_edges
      FROM order_e o) x""",
)
def replace(t: Tables):
    batch = t.role("order_e").where("status = 'O'").select("id", F.lit("F").alias("status"))
    out = mu.replace(t.catalog, "Order", batch, STAMP)
    counts = out.edges.where("is_available").groupBy(F.col("source_id").alias("id")).agg(F.count("*").alias("n_edges"))
    return out.entities.join(counts, "id", "left").select(
        "id", F.col("status").alias("name"), F.col("priority").alias("brand"), F.coalesce("n_edges", F.lit(0)).cast("bigint").alias("n_edges")
    )


@query(
    "soft_delete",
    """SELECT id, is_available AS deleted, FALSE AS is_available FROM order_e WHERE total > 250000
    UNION ALL SELECT id, NULL, is_available FROM order_e WHERE total <= 250000
    UNION ALL SELECT id + 5000000000, FALSE, NULL FROM order_e WHERE total > 250000""",
)
def soft_delete(t: Tables):
    ids = t.role("order_e").where("total > 250000").select("id")
    asked = ids.unionByName(ids.select((F.col("id") + 5_000_000_000).alias("id")))
    out = mu.soft_delete(t.catalog, "Order", asked, STAMP)
    return out.entities.select("id", "is_available").join(out.report, "id", "full_outer").select("id", "deleted", "is_available")


@query(
    "set_availability_bulk",
    """SELECT id, TRUE AS success, NULL AS error FROM order_e WHERE total > 250000
    UNION ALL SELECT id + 5000000000, FALSE, 'not found' FROM order_e WHERE total > 250000""",
)
def set_availability_bulk(t: Tables):
    ids = t.role("order_e").where("total > 250000").select("id")
    asked = ids.unionByName(ids.select((F.col("id") + 5_000_000_000).alias("id")))
    return mu.set_availability_bulk(t.catalog, "Order", asked, True, STAMP, "restock").report


@query(
    "supersede_entities",
    """SELECT 'entity' AS kind, CAST(id AS VARCHAR) AS id, CAST(id + 1 AS VARCHAR) AS other FROM part_e WHERE type = 'PROMO' AND id + 1 IN (SELECT id FROM part_e)
    UNION ALL SELECT 'edge', CAST(id AS VARCHAR), CAST(id + 1 AS VARCHAR) FROM part_e WHERE type = 'PROMO' AND id + 1 IN (SELECT id FROM part_e)
    UNION ALL SELECT 'supersede', CAST(id AS VARCHAR), CAST(id + 1 AS VARCHAR) FROM part_e WHERE type = 'PROMO' AND id + 1 IN (SELECT id FROM part_e)
    UNION ALL SELECT 'update', CAST(id AS VARCHAR), name FROM part_e WHERE id - 1 IN (SELECT id FROM part_e WHERE type = 'PROMO')""",
)
def supersede_entities(t: Tables):
    pairs = t.role("part_e").where("type = 'PROMO'").select("id", (F.col("id") + 1).alias("replacement")).join(
        t.role("part_e").select(F.col("id").alias("replacement")), "replacement", "left_semi"
    )
    out = mu.supersede_entities(t.catalog, "Part", pairs, STAMP, "merged")
    text = lambda c: F.col(c).cast("string")
    rows = out.entities.where(F.col("superseded_by").isNotNull() & ~F.col("is_available")).select(
        F.lit("entity").alias("kind"), text("id").alias("id"), text("superseded_by").alias("other")
    )
    edges = out.new_edges.select(F.lit("edge").alias("kind"), text("source_id").alias("id"), text("target_id").alias("other"))
    other = F.coalesce(F.get_json_object("patch", "$.superseded_by"), F.get_json_object("patch", "$.name"))
    log = out.log.select(F.col("operation").alias("kind"), text("entity_id").alias("id"), other.alias("other"))
    return rows.unionByName(edges).unionByName(log)


@query(
    "register_external_ids",
    """SELECT 'mapping' AS kind, concat('P-', CAST(id AS VARCHAR)) AS value, CAST(id AS VARCHAR) AS entity FROM part_e
    UNION ALL SELECT 'external_id_add', concat('P-', CAST(id AS VARCHAR)), CAST(id AS VARCHAR) FROM part_e
    UNION ALL SELECT 'create', concat('P-', CAST(id AS VARCHAR)), NULL FROM part_e""",
)
def register_external_ids(t: Tables):
    rows = t.role("part_e").select(
        F.col("id").alias("entity"), F.concat(F.lit("P-"), F.col("id").cast("string")).alias("value"), F.lit("erp").alias("source_system")
    )
    out = mu.register_external_ids(t.catalog, "Part", rows, STAMP)
    maps = out.new_mappings.select(F.lit("mapping").alias("kind"), "value", F.col("entity").cast("string").alias("entity"))
    value = F.coalesce(F.get_json_object("patch", "$.external_id"), F.get_json_object("patch", "$.value"))
    entity = F.when(F.col("operation") == "external_id_add", F.col("entity_id"))
    return maps.unionByName(out.log.select(F.col("operation").alias("kind"), value.alias("value"), entity.alias("entity")))


@query(
    "supersede_external_ids",
    """SELECT entity, value, source_system, is_active AND source_system <> 'crm' AS is_active FROM ext_e
    UNION ALL SELECT entity, concat(value, '-b'), source_system, TRUE FROM ext_e WHERE is_active AND source_system = 'crm'""",
)
def supersede_external_ids(t: Tables):
    old = t.role("ext_e").where("is_active AND source_system = 'crm'")
    rows = old.select("entity", F.col("value").alias("old_value"), F.concat("value", F.lit("-b")).alias("new_value"), "source_system")
    out = mu.supersede_external_ids(t.role("ext_e"), "Customer", rows, STAMP)
    return out.external_ids.select("entity", "value", "source_system", "is_active")


def good_links(t: Tables):
    live = t.catalog.live("Order").select(F.col("id").alias("source_id"), (F.col("id") % 100).alias("target_id"))
    wanted = live.select("target_id").distinct()
    there = t.catalog.live("Order").select(F.col("id").alias("target_id")).join(wanted, "target_id", "left_semi")
    return live.where("source_id <> target_id").join(there, "target_id", "left_semi").withColumn("relationship_type", F.lit("near"))


GOOD_LINKS = """SELECT id AS source_id, id % 100 AS target_id FROM order_e WHERE is_available AND id <> id % 100
  AND id % 100 IN (SELECT id FROM order_e WHERE is_available)"""


@query(
    "relate",
    f"""SELECT 'edge' AS kind, source_id, target_id FROM ({GOOD_LINKS}) a
    UNION ALL SELECT 'relationship_add', source_id, target_id FROM ({GOOD_LINKS}) b""",
)
def relate(t: Tables):
    out = mu.relate(t.catalog.edges, good_links(t), t.catalog.live("Order"), STAMP)
    edges = out.edges.where("relationship_type = 'near'").select(F.lit("edge").alias("kind"), "source_id", "target_id")
    log = out.log.select(
        F.col("operation").alias("kind"), F.col("entity_id").alias("source_id"),
        F.get_json_object("patch", "$.target_id").cast("bigint").alias("target_id"),
    )
    return edges.unionByName(log)


@query(
    "unrelate",
    """SELECT id, source_id, is_available AND relationship_type <> 'follows' AS is_available FROM link_e""",
)
def unrelate(t: Tables):
    gone = t.role("link_e").where("is_available AND relationship_type = 'follows'").select("source_id", "target_id", "relationship_type")
    return mu.unrelate(t.role("link_e"), gone, STAMP).edges.select("id", "source_id", "is_available")


@query(
    "reconcile_multi_refs",
    """SELECT source_id, target_id, count(*) AS n FROM (
      SELECT source_id, target_id FROM edge_e WHERE is_available AND source_id NOT IN (SELECT id FROM order_e WHERE status = 'F')
      UNION ALL SELECT id, id % 50 FROM order_e WHERE status = 'F'
      UNION ALL SELECT id, customer FROM order_e WHERE status = 'F' AND id % 50 <> customer) x GROUP BY source_id, target_id""",
)
def reconcile_multi_refs(t: Tables):
    batch = t.role("order_e").where("status = 'F'").select(
        "id", F.array((F.col("id") % 50), F.col("customer"), F.lit(None).cast("bigint")).alias("parts")
    )
    out = mu.reconcile_multi_refs(t.catalog, "Order", batch, STAMP)
    return out.edges.where("is_available").groupBy("source_id", "target_id").agg(F.count("*").alias("n"))


@query(
    "batch_put",
    """SELECT 'Supplier' AS entity_type, 'update' AS operation, count(*) AS n FROM supplier_e
    UNION ALL SELECT 'Nation', 'create', count(*) FROM nation_e""",
)
def batch_put(t: Tables):
    suppliers = t.role("supplier_e").withColumn("nation", F.col("nation") + 100)
    nations = t.role("nation_e").withColumn("id", F.col("id") + 100)
    return mu.batch_put(t.catalog, {"Supplier": suppliers, "Nation": nations}, STAMP, dry_run=True)


def customer_feed(t: Tables):
    """Incoming records by external id: unchanged, changed, new, repeated and without id."""
    base = t.role("customer_e").select(
        F.concat(F.lit("K"), F.col("id").cast("string")).alias("key"), F.col("id").alias("line"), "id", "name", "segment"
    )
    last = F.col("id") % 10
    fed = base.withColumn("name", F.when(last == 1, F.concat("name", F.lit("*"))).otherwise(F.col("name"))).withColumn(
        "key", F.when(last == 2, F.concat(F.lit("NEW"), F.col("key"))).when(last != 3, F.col("key"))
    )
    again = fed.where("segment = 'BUILDING'").withColumn("line", F.col("line") + 1_000_000_000)
    return fed.unionByName(again).select("key", "line", "name", "segment")


def feed_out(no_id: str) -> str:
    """Outcome per fed line; ``no_id`` is that of lines without external id."""
    return f"""SELECT id AS line, CASE id % 10 WHEN 1 THEN 'updated' WHEN 2 THEN 'created' WHEN 3 THEN '{no_id}' ELSE 'unchanged' END AS outcome FROM customer_e
  UNION ALL SELECT id + 1000000000, CASE id % 10 WHEN 3 THEN '{no_id}' ELSE 'error' END FROM customer_e WHERE segment = 'BUILDING'"""


def feed_mappings(t: Tables):
    return t.role("customer_e").select(
        F.concat(F.lit("K"), F.col("id").cast("string")).alias("value"), F.col("id").alias("entity")
    )


@query("upsert_by_external_id", feed_out("error"))
def upsert_by_external_id(t: Tables):
    out = mu.upsert_by_external_id(
        customer_feed(t), "key", "line", t.role("customer_e"), feed_mappings(t), ["name", "segment"]
    )
    return out.select("line", "outcome")


def open_catalog(t: Tables) -> Catalog:
    """Customers under a schema whose segment is free text."""
    schema = Schema((EntityType("Customer", (Slot("name", required=True), Slot("segment"))),))
    table = t.role("customer_e").select("id", F.lit(True).alias("is_available"), "superseded_by", "name", "segment")
    return Catalog(schema, {"Customer": table}, write_log=t.role("write_e"))


@query("run_loader", feed_out("created"))
def run_loader(t: Tables):
    renamed = lambda since: customer_feed(t).withColumnRenamed("name", "label")
    out = mu.run_loader(
        renamed, open_catalog(t), "Customer", STAMP, "key", "line", feed_mappings(t),
        transform=lambda df: map_fields(df, {"label": "name"}), dry_run=True,
    )
    return out.select("line", "outcome")


@query(
    "run_loader_writes",
    """SELECT name, count(*) AS n FROM (
      SELECT CASE WHEN id % 10 = 1 THEN concat(name, '*') ELSE name END AS name FROM customer_e
      UNION ALL SELECT name FROM customer_e WHERE id % 10 IN (2, 3)
      UNION ALL SELECT name FROM customer_e WHERE id % 10 = 3 AND segment = 'BUILDING') x GROUP BY name""",
)
def run_loader_writes(t: Tables):
    out = mu.run_loader(
        lambda since: customer_feed(t), open_catalog(t), "Customer", STAMP, "key", "line", feed_mappings(t)
    )
    return out.entities.groupBy("name").agg(F.count("*").alias("n"))


def split_customers(t: Tables):
    schema = Schema(
        (
            EntityType("Customer", (Slot("name"), Slot("segment"), Slot("balance", "double"))),
            EntityType("Client", (Slot("label", required=True),)),
        )
    )
    empty = t.spark.createDataFrame([], "id bigint, is_available boolean, superseded_by bigint, label string")
    table = t.role("customer_e").select("id", "is_available", "superseded_by", "name", "segment", "balance")
    return Catalog(schema, {"Customer": table, "Client": empty})


@query(
    "migrate_rows",
    """SELECT 'Customer' AS entity_type, id, FALSE AS is_available, CASE WHEN is_available THEN 10000000 + id END AS superseded_by, name AS label FROM customer_e
    UNION ALL SELECT 'Client', 10000000 + id, TRUE, NULL, concat(name, '/a') FROM customer_e WHERE is_available
    UNION ALL SELECT 'Client', 20000000 + id, TRUE, NULL, concat(name, '/b') FROM customer_e WHERE is_available AND balance > 5000""",
)
def migrate_rows(t: Tables):
    catalog = split_customers(t)

    def transform(df):
        first = df.select((F.col("id") + 10_000_000).alias("id"), F.concat("name", F.lit("/a")).alias("label"), F.col("id").alias("predecessor"))
        second = df.where("balance > 5000").select((F.col("id") + 20_000_000).alias("id"), F.concat("name", F.lit("/b")).alias("label"), F.col("id").alias("predecessor"))
        return first.unionByName(second)

    out = lc.migrate_rows(catalog, "Customer", "Client", transform, STAMP)
    old = out["Customer"].entities.select(F.lit("Customer").alias("entity_type"), "id", "is_available", "superseded_by", F.col("name").alias("label"))
    return old.unionByName(out["Client"].entities.select(F.lit("Client").alias("entity_type"), "id", "is_available", "superseded_by", "label"))


@query(
    "migration_transform",
    """SELECT 20000000 + id AS id, upper(name) AS label FROM customer_e WHERE is_available AND contains(name, '5')
    UNION ALL SELECT 10000000 + id, name FROM customer_e WHERE is_available AND NOT contains(name, '5')""",
)
def migration_transform(t: Tables):
    """Two hops; the second reads only what the first left live."""
    catalog = split_customers(t)
    hop1 = lambda df: df.select((F.col("id") + 10_000_000).alias("id"), F.col("name").alias("label"), F.col("id").alias("predecessor"))
    hop2 = lambda df: df.where("contains(label, '5')").select((F.col("id") + 10_000_000).alias("id"), F.upper("label").alias("label"), F.col("id").alias("predecessor"))
    done = lc.migrate_chain(catalog, [("Customer", "Client", hop1), ("Client", "Client", hop2)], STAMP)
    return done.live("Client").select("id", "label")


@query(
    "migrate_as_of",
    """SELECT 'Client' AS entity_type, 10000000 + id AS id FROM customer_e WHERE is_available AND balance > 5000
    UNION ALL SELECT 'Customer', id FROM customer_e WHERE NOT is_available OR balance <= 5000""",
)
def migrate_as_of(t: Tables):
    """What stands after a migration, reconstructed from the log alone."""
    catalog = split_customers(t)
    early = mu.Stamp("2023-01-01 00:00:00", "loader")
    created = mu.put(Catalog(catalog.schema, {"Customer": catalog.table("Customer").limit(0)}), "Customer", catalog.table("Customer"), early)
    rich = lambda df: df.where("balance > 5000").select((F.col("id") + 10_000_000).alias("id"), F.col("name").alias("label"), F.col("id").alias("predecessor"))
    out = lc.migrate_rows(catalog, "Customer", "Client", rich, STAMP)
    log = created.log.unionByName(out["Customer"].log).unionByName(out["Client"].log)
    states = [tm.query_as_of(log, catalog.schema, n, "2030-01-01 00:00:00").select(F.lit(n).alias("entity_type"), "id") for n in ("Customer", "Client")]
    return states[0].unionByName(states[1])


@query(
    "put_lists",
    """SELECT source_id, target_id FROM edge_e WHERE is_available AND source_id NOT IN (SELECT id FROM order_e WHERE status = 'O')
    UNION ALL SELECT id, id % 100 + 1 FROM order_e WHERE status = 'O' UNION ALL SELECT id, id % 100 + 2 FROM order_e WHERE status = 'O'""",
)
def put_lists(t: Tables):
    """Lists of a multivalued slot replace the edges of the rows that are put."""
    parts = F.array(F.col("id") % 100 + 1, F.col("id") % 100 + 2)
    batch = t.role("order_e").where("status = 'O'").withColumn("parts", parts)
    return mu.put(t.catalog, "Order", batch, STAMP).edges.where("is_available").select("source_id", "target_id")


@query(
    "load_reference",
    """SELECT 'log' AS kind, CAST(id AS VARCHAR) AS id, name FROM part_e WHERE type = 'PROMO'
    UNION ALL SELECT 'row', CAST(id AS VARCHAR), CASE WHEN type = 'PROMO' THEN concat(name, ' r2') ELSE name END FROM part_e""",
)
def load_reference(t: Tables):
    release = t.role("part_e").where("type = 'PROMO'").select("id", F.concat("name", F.lit(" r2")).alias("name"), "brand", "type", "size", "price")
    out, rows = lc.load_reference(t.catalog, "Part", release, "loader9", "v1", STAMP)
    names = t.role("part_e").select(F.col("id").cast("string").alias("entity_id"), "name")
    log = rows.join(names, "entity_id").select(F.lit("log").alias("kind"), F.col("entity_id").alias("id"), "name")
    return out.entities.select(F.lit("row").alias("kind"), F.col("id").cast("string").alias("id"), "name").unionByName(log)


PRUNED = """SELECT 'Order' AS kind, CAST(id AS VARCHAR) AS id FROM order_e WHERE CAST(id AS VARCHAR) NOT IN
      (SELECT entity_id FROM write_e WHERE {mine} AND entity_type = 'Order')
    UNION ALL SELECT 'Part', CAST(id AS VARCHAR) FROM part_e WHERE CAST(id AS VARCHAR) NOT IN
      (SELECT entity_id FROM write_e WHERE {mine} AND entity_type = 'Part')
    UNION ALL SELECT 'log of ' || entity_type, entity_id FROM write_e WHERE NOT ({mine})"""


def pruned(tables, log):
    parts = [tables[n].select(F.lit(n).alias("kind"), F.col("id").cast("string").alias("id")) for n in ("Order", "Part")]
    left = log.select(F.concat(F.lit("log of "), "entity_type").alias("kind"), F.col("entity_id").alias("id"))
    return parts[0].unionByName(parts[1]).unionByName(left)


@query("prune_version", PRUNED.format(mine="loader_name = 'loader1' AND version = 'v1'"))
def prune_version(t: Tables):
    return pruned(*lc.prune_version(t.catalog, "loader1", "v1"))


@query("prune_loader", PRUNED.format(mine="loader_name = 'loader1'"))
def prune_loader(t: Tables):
    return pruned(*lc.prune_loader(t.catalog, "loader1"))


@query(
    "prune_one_class",
    """SELECT 'Order' AS kind, CAST(id AS VARCHAR) AS id FROM order_e WHERE CAST(id AS VARCHAR) NOT IN
      (SELECT entity_id FROM write_e WHERE loader_name = 'loader1' AND version = 'v1' AND entity_type = 'Order')
    UNION ALL SELECT 'log of ' || entity_type, entity_id FROM write_e
      WHERE NOT (loader_name = 'loader1' AND version = 'v1' AND entity_type = 'Order')""",
)
def prune_one_class(t: Tables):
    tables, log = lc.prune_version(t.catalog, "loader1", "v1", ["Order"])
    return pruned({**tables, "Part": t.role("part_e").limit(0)}, log)


@query("evolve_columns", "SELECT id, name, CAST(7 AS BIGINT) AS rank, CAST(NULL AS VARCHAR) AS note FROM supplier_e")
def evolve_columns(t: Tables):
    schema = Schema((EntityType("Supplier", (Slot("name"), Slot("rank", "integer", required=True, default=7), Slot("note"))),))
    table, added, warnings = lc.evolve_columns(t.role("supplier_e").select("id", "name"), schema, "Supplier")
    return table


@query(
    "backfill_write_log",
    """SELECT loader_name, version, CAST(id AS VARCHAR) AS entity_id, 'Order' AS entity_type FROM (
      SELECT o_orderkey AS id, concat('loader', CAST(o_orderkey % 3 AS VARCHAR)) AS loader_name, concat('v', CAST(o_custkey % 2 AS VARCHAR)) AS version FROM orders WHERE o_orderstatus <> 'P') x""",
)
def backfill_write_log(t: Tables):
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    payload = F.to_json(
        F.create_map(
            F.concat(F.lit("loader"), (key % 3).cast("string")),
            F.create_map(F.concat(F.lit("v"), (cust % 2).cast("string")), F.array(key.cast("string"), F.lit("ghost"))),
        )
    )
    nested = t.raw("orders").select(payload.alias("payload"))
    registry = t.catalog.live("Order").select("id", F.lit("Order").alias("entity_type"))
    return lc.backfill_write_log(nested, registry, "2024-01-01 00:00:00").drop("written_at")


@query(
    "retire_classes",
    """SELECT id, FALSE AS is_available, deleted FROM (SELECT id, CASE WHEN is_available THEN TRUE END AS deleted FROM part_e) x""",
)
def retire_classes(t: Tables):
    out = lc.retire_classes(t.catalog, ["Part"], STAMP, force=True)["Part"]
    return out.entities.select("id", "is_available").join(out.report, "id", "left")


@query(
    "stamp_context",
    "SELECT event_id AS id, CASE WHEN event_id % 2 = 0 THEN 'app' ELSE 'importer' END AS actor_id, 'batch 7' AS context FROM events",
)
def stamp_context(t: Tables):
    log = t.log.withColumn("actor_id", F.when(F.col("id") % 2 == 0, "app"))
    return mu.stamp_events(log, "importer", "batch 7").select("id", "actor_id", "context")


@query(
    "custom_loader",
    """SELECT id, CASE WHEN id % 2 = 0 THEN 'updated' ELSE 'unchanged' END AS outcome FROM supplier_e""",
)
def custom_loader(t: Tables):
    """A loader is any ``since -> DataFrame``; here it reads suppliers."""
    schema = Schema((EntityType("Supplier", (Slot("name", required=True),)),))
    catalog = Catalog(schema, {"Supplier": t.role("supplier_e").select("id", "is_available", "superseded_by", "name")})

    def fetch(since):
        return t.role("supplier_e").select(
            F.col("id").cast("string").alias("key"), F.col("id").alias("line"),
            F.when(F.col("id") % 2 == 0, F.upper("name")).otherwise(F.col("name")).alias("name"),
        )

    mapping = t.role("supplier_e").select(F.col("id").cast("string").alias("value"), F.col("id").alias("entity"))
    out = mu.run_loader(fetch, catalog, "Supplier", STAMP, "key", "line", mapping, dry_run=True)
    return out.select(F.col("line").alias("id"), "outcome")


# Streams.

SUMMARY_SQL = """SELECT entity_id, min(CASE WHEN operation = 'create' THEN timestamp END) AS created_at,
  max(CASE WHEN deletion THEN NULL ELSE timestamp END) AS updated_at FROM log_e GROUP BY entity_id"""


def written_log(t: Tables) -> tuple[str, T.StructType]:
    path = scratch_path(t.spark, "stream-log")
    t.log.repartitionByRange(3, "timestamp").write.parquet(path)  # three files, a batch each
    return path, t.log.schema


#: Where the log of the feed is cut into three batches, and which events come a batch late.
FEED_CUTS, FEED_LATE, FEED_DELAY = ("2024-01-11", "2024-01-21"), "id % 10 = 0", "36 hours"
FEED_BATCH = (
    f"least(2, CASE WHEN timestamp < TIMESTAMP '{FEED_CUTS[0]} 00:00:00' THEN 0 WHEN timestamp < TIMESTAMP '{FEED_CUTS[1]} 00:00:00' THEN 1 ELSE 2 END"
    f" + CASE WHEN {FEED_LATE} THEN 1 ELSE 0 END)"
)


@query(
    "stream_updated_since",
    f"""WITH changes AS (SELECT entity_id, timestamp, {FEED_BATCH} AS b FROM log_e WHERE NOT deletion),
    marks AS (SELECT b, max(date_trunc('millisecond', newest) - INTERVAL {FEED_DELAY}) OVER (ORDER BY b) AS mark
      FROM (SELECT b, max(timestamp) AS newest FROM changes GROUP BY b) n),
    kept AS (SELECT c.* FROM changes c LEFT JOIN marks m ON m.b = c.b - 1 WHERE m.mark IS NULL OR c.timestamp > m.mark),
    told AS (SELECT k.entity_id, k.timestamp, min(m.b) AS step FROM kept k JOIN marks m ON m.b >= k.b AND k.timestamp < m.mark
      GROUP BY k.entity_id, k.timestamp, k.b)
    SELECT entity_id, max(timestamp) AS updated_at, count(*) AS n_events FROM told GROUP BY entity_id, step""",
)
def stream_updated_since(t: Tables):
    """Three runs of the feed; a tenth of the events come one run late, most of them too late."""
    path, out, state = (scratch_path(t.spark, name) for name in ("stream-log", "feed", "state"))
    t.spark.conf.set("spark.sql.streaming.stateStore.providerClass", feed.STATE_STORE)
    log = t.log.withColumn("b", F.expr(FEED_BATCH.replace("TIMESTAMP '", "TIMESTAMP_NTZ '")))
    for number in range(3):
        log.where(F.col("b") == number).drop("b").write.mode("append").parquet(path)
        events = jobs.read_log_stream(t.spark, path, t.log.schema)
        feed.stream_updated_since(events, out, state, FEED_DELAY).awaitTermination()
    return feed.read_feed(t.spark.read.parquet(out))


@query(
    "stream_upsert",
    """WITH fed AS (SELECT id, id AS line FROM customer_e UNION ALL SELECT id, id + 1000000000 FROM customer_e WHERE segment = 'BUILDING'),
    numbered AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY line % 3) AS nth FROM fed)
    SELECT 'line' AS kind, CAST(line AS VARCHAR) AS what, CASE WHEN id % 10 = 3 THEN 'created' WHEN nth > 1 THEN 'unchanged'
      WHEN id % 10 = 1 THEN 'updated' WHEN id % 10 = 2 THEN 'created' ELSE 'unchanged' END AS outcome FROM numbered
    UNION ALL SELECT 'mapping', concat(CASE WHEN id % 10 = 2 THEN 'NEWK' ELSE 'K' END, CAST(id AS VARCHAR)), NULL FROM customer_e
    UNION ALL SELECT 'mapping', concat('K', CAST(id AS VARCHAR)), NULL FROM customer_e WHERE id % 10 = 2
    UNION ALL SELECT 'rows', CAST((SELECT count(*) FROM customer_e) + count(*) FILTER (WHERE id % 10 = 3)
      + count(DISTINCT id) FILTER (WHERE id % 10 = 2) AS VARCHAR), NULL FROM fed""",
)
def stream_upsert(t: Tables):
    """Three batches; external ids return in later ones and are created once."""
    root, path, out, state = (scratch_path(t.spark, name) for name in ("store", "feed-in", "feed-out", "state"))
    catalog, feed_rows = open_catalog(t), customer_feed(t)
    maps = feed_mappings(t).select(
        F.concat(F.lit("m"), "value").alias("id"), "value", F.lit("crm").alias("source_system"), "entity", F.lit(True).alias("is_active")
    )
    store.commit(root, {"Customer": mu.WriteSet(entities=catalog.table("Customer"), external_ids=maps)})
    for number in range(3):
        feed_rows.where(F.col("line") % 3 == number).write.mode("append").parquet(path)
        records = jobs.read_log_stream(t.spark, path, feed_rows.schema)
        stamp = lambda batch: mu.Stamp(f"2025-01-0{batch + 1} 00:00:00", "stream")
        jobs.stream_upsert(records, root, catalog.schema, "Customer", stamp, "key", "line", out, state).awaitTermination()
    after = store.load_catalog(t.spark, root, catalog.schema)
    none = F.lit(None).cast("string").alias("outcome")
    lines = t.spark.read.parquet(out).select(F.lit("line").alias("kind"), F.col("line").cast("string").alias("what"), "outcome")
    mapped = after.external_ids.select(F.lit("mapping").alias("kind"), F.col("value").alias("what"), none)
    rows = after.table("Customer").agg(F.count("*").cast("string").alias("what")).select(F.lit("rows").alias("kind"), "what", none)
    return lines.unionByName(mapped).unionByName(rows)


@query("stream_temporal_summary", SUMMARY_SQL)
def stream_temporal_summary(t: Tables):
    path, schema = written_log(t)
    out = scratch_path(t.spark, "summary")
    events = jobs.read_log_stream(t.spark, path, schema, files_per_batch=1)
    jobs.run_to_table(jobs.stream_temporal_summary(events), out, scratch_path(t.spark, "state"))
    return jobs.latest_of(t.spark.read.parquet(out), ["entity_id"]).select("entity_id", "created_at", "updated_at")
