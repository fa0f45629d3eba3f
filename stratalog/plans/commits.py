"""Writes that are committed to a store and read back: rows, edges, mappings and log together."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import Catalog, EntityType, Schema, Slot
from ..operators import lifecycle as lc
from ..operators import mutate as mu
from ..runtime import scratch_path
from ..sources import store
from .registry import query
from .tables import SCHEMA, Tables
from .writes import STAMP, feed_mappings

EDGE_COLUMNS = ["id", "source_id", "target_id", "relationship_type", "metadata", "created_at", "created_by", "is_available"]


def reloaded(t: Tables, before: Catalog, sets: dict[str, mu.WriteSet]) -> Catalog:
    """The catalog after its tables and then a job's writes were committed and read back."""
    path = scratch_path(t.spark, "store")
    start = {name: mu.WriteSet(entities=df) for name, df in before.tables.items()}
    start["links"] = mu.WriteSet(edges=before.edges, external_ids=before.external_ids)
    store.commit(path, start)
    store.commit(path, sets)
    return store.load_catalog(t.spark, path, before.schema)


def edge_rows(edges: DataFrame) -> DataFrame:
    return edges.select(
        F.col("relationship_type").alias("kind"), F.col("source_id").cast("string").alias("a"),
        F.col("target_id").cast("string").alias("b"), "is_available",
    )


PROMOTED = "FROM part_e WHERE type = 'PROMO' AND id + 1 IN (SELECT id FROM part_e)"


@query(
    "commit_supersede",
    f"""SELECT 'parts' AS kind, CAST(source_id AS VARCHAR) AS a, CAST(target_id AS VARCHAR) AS b, is_available FROM edge_e
    UNION ALL SELECT 'superseded_by', CAST(id AS VARCHAR), CAST(id + 1 AS VARCHAR), TRUE {PROMOTED}
    UNION ALL SELECT 'row', CAST(id AS VARCHAR), CASE WHEN type = 'PROMO' AND id + 1 IN (SELECT id FROM part_e) THEN CAST(id + 1 AS VARCHAR) END,
      is_available AND NOT (type = 'PROMO' AND id + 1 IN (SELECT id FROM part_e)) FROM part_e
    UNION ALL SELECT 'supersede', CAST(id AS VARCHAR), CAST(id + 1 AS VARCHAR), NULL {PROMOTED}""",
)
def commit_supersede(t: Tables):
    before = Catalog(SCHEMA, {"Part": t.role("part_e")}, edges=t.role("edge_e"), global_ids=False)
    pairs = t.role("part_e").where("type = 'PROMO'").select("id", (F.col("id") + 1).alias("replacement"))
    pairs = pairs.join(t.role("part_e").select(F.col("id").alias("replacement")), "replacement", "left_semi")
    after = reloaded(t, before, {"Part": mu.supersede_entities(before, "Part", pairs, STAMP)})
    rows = after.table("Part").select(
        F.lit("row").alias("kind"), F.col("id").cast("string").alias("a"), F.col("superseded_by").cast("string").alias("b"), "is_available"
    )
    gone = after.log.where("operation = 'supersede'").select(
        F.col("operation").alias("kind"), F.col("entity_id").cast("string").alias("a"),
        F.get_json_object("patch", "$.superseded_by").alias("b"), F.lit(None).cast("boolean").alias("is_available"),
    )
    return edge_rows(after.edges).unionByName(rows).unionByName(gone)


@query(
    "commit_register",
    """SELECT value, source_system, entity, is_active FROM ext_e
    UNION ALL SELECT concat('C-', CAST(id AS VARCHAR)), 'erp', id, TRUE FROM customer_e""",
)
def commit_register(t: Tables):
    before = Catalog(SCHEMA, {"Customer": t.role("customer_e")}, external_ids=t.role("ext_e"))
    rows = t.role("customer_e").select(
        F.col("id").alias("entity"), F.concat(F.lit("C-"), F.col("id").cast("string")).alias("value"), F.lit("erp").alias("source_system")
    )
    after = reloaded(t, before, {"Customer": mu.register_external_ids(before, "Customer", rows, STAMP)})
    return after.external_ids.select("value", "source_system", "entity", "is_active")


@query(
    "commit_migration",
    """SELECT 'near' AS kind, CAST(id AS VARCHAR) AS a, CAST(nation AS VARCHAR) AS b, TRUE AS is_available FROM customer_e
    UNION ALL SELECT 'superseded_by', CAST(id AS VARCHAR), CAST(10000000 + id AS VARCHAR), TRUE FROM customer_e WHERE is_available AND balance > 5000
    UNION ALL SELECT 'row', CAST(id AS VARCHAR), name, is_available AND balance <= 5000 FROM customer_e
    UNION ALL SELECT 'row', CAST(10000000 + id AS VARCHAR), upper(name), TRUE FROM customer_e WHERE is_available AND balance > 5000
    UNION ALL SELECT 'pals', CAST(id AS VARCHAR), CAST(id % 10 AS VARCHAR), TRUE FROM customer_e
    UNION ALL SELECT 'pals', CAST(10000000 + id AS VARCHAR), CAST(id % 4 AS VARCHAR), TRUE FROM customer_e WHERE is_available AND balance > 5000""",
)
def commit_migration(t: Tables):
    """A hop within one class whose new rows bring lists of their own."""
    pals = Slot("pals", "integer", reference="Customer", multivalued=True)
    schema = Schema((EntityType("Customer", (Slot("name"), Slot("balance", "double"), pals)),))
    table = t.role("customer_e").select("id", "is_available", "superseded_by", "name", "balance")

    def edges(kind: str, target: F.Column) -> DataFrame:
        rows = t.role("customer_e").select(F.col("id").alias("source_id"), target.alias("target_id"), F.lit(kind).alias("relationship_type"))
        return mu.new_edges(rows, STAMP)

    every = edges("near", F.col("nation")).unionByName(edges("pals", F.col("id") % 10))
    before = Catalog(schema, {"Customer": table}, edges=every)

    def rich(df: DataFrame) -> DataFrame:
        return df.where("balance > 5000").select(
            (F.col("id") + 10_000_000).alias("id"), F.upper("name").alias("name"), "balance",
            F.array(F.col("id") % 4).alias("pals"), F.col("id").alias("predecessor"),
        )

    after = reloaded(t, before, lc.migrate_rows(before, "Customer", "Customer", rich, STAMP))
    rows = after.table("Customer").select(
        F.lit("row").alias("kind"), F.col("id").cast("string").alias("a"), F.col("name").alias("b"), "is_available"
    )
    return edge_rows(after.edges).unionByName(rows)


@query(
    "commit_batch",
    """SELECT 'nation' AS kind, id AS a, region AS b, TRUE AS live FROM nation_e UNION ALL SELECT 'nation', id + 100, region, TRUE FROM nation_e
    UNION ALL SELECT 'supplier', id, nation + 100, is_available FROM supplier_e
    UNION ALL SELECT 'parts', source_id, target_id, is_available FROM edge_e
    UNION ALL SELECT 'serves', id, nation + 100, TRUE FROM supplier_e WHERE id <> nation + 100
    UNION ALL SELECT 'relationship_add', id, nation + 100, NULL FROM supplier_e WHERE id <> nation + 100""",
)
def commit_batch(t: Tables):
    """Two classes and new edges in one commit; the edges that were there stay."""
    tables = {n: t.role(f"{n.lower()}_e") for n in ("Region", "Nation", "Supplier")}
    before = Catalog(SCHEMA, tables, edges=t.role("edge_e"), global_ids=False)
    suppliers = t.role("supplier_e").withColumn("nation", F.col("nation") + 100)
    nations = t.role("nation_e").withColumn("id", F.col("id") + 100)
    links = suppliers.where("id <> nation").select(F.col("id").alias("source_id"), F.col("nation").alias("target_id"), F.lit("serves").alias("relationship_type"))
    after = reloaded(t, before, mu.batch_put(before, {"Nation": nations, "Supplier": suppliers}, STAMP, new_edge_rows=links))
    parts = [
        after.table("Nation").select(F.lit("nation").alias("kind"), F.col("id").alias("a"), F.col("region").alias("b"), F.col("is_available").alias("live")),
        after.table("Supplier").select(F.lit("supplier"), "id", "nation", "is_available"),
        after.edges.select("relationship_type", "source_id", "target_id", "is_available"),
        after.log.where("operation = 'relationship_add'").select(
            "operation", F.get_json_object("patch", "$.source_id").cast("bigint"), F.get_json_object("patch", "$.target_id").cast("bigint"), F.lit(None).cast("boolean")
        ),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.union(part)
    return out


FRIENDS = "SELECT id % 7 AS friend, id FROM customer_e WHERE {where} UNION SELECT id % 5, id FROM customer_e WHERE {where}"


@query(
    "commit_loader",
    f"""SELECT 'outcome' AS kind, CASE WHEN id % 10 = 4 THEN 'error: name is required' WHEN id % 10 IN (2, 3) THEN 'created'
        WHEN id % 10 = 1 OR (id % 2 = 1 AND id % 7 <> id % 5) THEN 'updated' ELSE 'unchanged' END AS what, id AS n FROM customer_e
    UNION ALL SELECT 'friends', CAST(friend AS VARCHAR), count(*) FROM (
      {FRIENDS.format(where="id % 10 <> 3")} UNION ALL SELECT id % 7, id FROM customer_e WHERE id % 10 = 3
      UNION ALL ({FRIENDS.format(where="id % 10 IN (2, 3)")})) f GROUP BY friend
    UNION ALL SELECT 'mapping', concat('K', CAST(id AS VARCHAR)), 1 FROM customer_e
    UNION ALL SELECT 'mapping', concat('NEWK', CAST(id AS VARCHAR)), 1 FROM customer_e WHERE id % 10 = 2
    UNION ALL SELECT 'name', name, count(*) FROM (SELECT CASE WHEN id % 10 = 1 THEN concat(name, '*') ELSE name END AS name FROM customer_e
      UNION ALL SELECT name FROM customer_e WHERE id % 10 IN (2, 3)) x GROUP BY name""",
)
def commit_loader(t: Tables):
    """A feed with lists, new and unnamed rows and rows without the required name."""
    friends = Slot("friends", "integer", reference="Customer", multivalued=True)
    schema = Schema((EntityType("Customer", (Slot("name", required=True), Slot("segment"), friends)),))
    base, last = t.role("customer_e"), F.col("id") % 10
    table = base.select("id", F.lit(True).alias("is_available"), "superseded_by", "name", "segment")
    both = F.array(F.col("id") % 7, F.col("id") % 5)
    stored = F.when(F.col("id") % 2 == 0, F.array_distinct(both)).otherwise(F.array(F.col("id") % 7))
    links = base.select(F.col("id").alias("source_id"), F.explode(stored).alias("target_id"), F.lit("friends").alias("relationship_type"))
    maps = feed_mappings(t).select(
        F.concat(F.lit("m"), "value").alias("id"), "value", F.lit("crm").alias("source_system"), "entity", F.lit(True).alias("is_active")
    )
    before = Catalog(schema, {"Customer": table}, edges=mu.new_edges(links, STAMP), external_ids=maps)
    name = F.concat(F.lit("K"), F.col("id").cast("string"))
    feed = base.select(
        F.when(last == 2, F.concat(F.lit("NEW"), name)).when(last != 3, name).alias("key"), F.col("id").alias("line"),
        F.when(last == 1, F.concat("name", F.lit("*"))).when(last != 4, F.col("name")).alias("name"), "segment", both.alias("friends"),
    )
    later = mu.Stamp("2025-01-02 00:00:00", "tester")
    out = mu.run_loader(lambda since: feed, before, "Customer", later, "key", "line", feed_mappings(t))
    after = reloaded(t, before, {"Customer": out})
    told = F.when(F.col("outcome") == "error", F.concat(F.lit("error: "), "error")).otherwise(F.col("outcome"))
    parts = [
        out.report.select(F.lit("outcome").alias("kind"), told.alias("what"), F.col("line").alias("n")),
        after.edges.where("is_available").groupBy(F.col("target_id").cast("string").alias("what")).agg(F.count("*").alias("n")).select(F.lit("friends"), "what", "n"),
        after.external_ids.select(F.lit("mapping"), "value", F.lit(1).cast("bigint")),
        after.table("Customer").groupBy("name").agg(F.count("*").alias("n")).select(F.lit("name"), "name", "n"),
    ]
    return parts[0].union(parts[1]).union(parts[2]).union(parts[3])
