"""Relationship predicates, joins and graph walks over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import external as ext
from ..operators import graph, links
from ..operators import read as rd
from ..operators import temporal as tm
from ..runtime import scratch_path
from .registry import query
from .scans import _order_temporal, is_
from .tables import Tables


@query(
    "semi_to_one",
    """SELECT o.id, o.customer FROM order_e o WHERE is_available AND EXISTS (
      SELECT 1 FROM customer_e c WHERE c.id = o.customer AND c.is_available AND c.segment = 'BUILDING')""",
)
def semi_to_one(t: Tables):
    return links.semi_to_one(t.catalog, "Order", "customer", is_("segment", "eq", "BUILDING")).select("id", "customer")


SOME = """EXISTS (SELECT 1 FROM edge_e l JOIN part_e p ON p.id = l.target_id
  WHERE l.source_id = o.id AND l.is_available AND l.relationship_type = 'parts' AND p.is_available AND {test})"""


@query("semi_some", f"SELECT o.id, o.status FROM order_e o WHERE o.is_available AND {SOME.format(test='p.size > 45')}")
def semi_some(t: Tables):
    return links.semi_some(t.catalog, "Order", "parts", is_("size", "gt", 45)).select("id", "status")


@query("anti_none", f"SELECT o.id, o.status FROM order_e o WHERE o.is_available AND NOT {SOME.format(test='p.size > 10')}")
def anti_none(t: Tables):
    return links.anti_none(t.catalog, "Order", "parts", is_("size", "gt", 10)).select("id", "status")


@query(
    "nested_edges",
    f"""SELECT o.id, o.total FROM order_e o WHERE o.is_available AND (
      EXISTS (SELECT 1 FROM customer_e c WHERE c.id = o.customer AND c.is_available AND EXISTS (
        SELECT 1 FROM nation_e n WHERE n.id = c.nation AND n.is_available AND EXISTS (
          SELECT 1 FROM region_e r WHERE r.id = n.region AND r.is_available AND r.name = 'ASIA')))
      OR NOT ({SOME.format(test="p.brand = 'Brand#1'")} OR coalesce(o.total < 300000, FALSE)))""",
)
def nested_edges(t: Tables):
    to_region = {"edge": "region", "where": is_("name", "eq", "ASIA")}
    tree = {
        "or": [
            {"edge": "customer", "where": {"edge": "nation", "where": to_region}},
            {"not": {"or": [
                {"edge": "parts", "quantifier": "some", "where": is_("brand", "eq", "Brand#1")},
                is_("total", "lt", 300000),
            ]}},
        ]
    }
    return links.where_tree(t.catalog, "Order", tree).select("id", "total")


@query(
    "join_temporal",
    f"""SELECT o.id, created_at, updated_at, 'v1' AS schema_version, 'loader' AS created_by FROM order_e o
    LEFT JOIN ({_order_temporal()}) x ON x.entity_id = o.id WHERE o.is_available""",
)
def join_temporal(t: Tables):
    rows = rd.join_temporal(t.catalog.live("Order"), t.order_log)
    return rows.select("id", "created_at", "updated_at", "schema_version", "created_by")


@query(
    "hydrate_multi_refs",
    """SELECT o.id, string_agg(CAST(e.target_id AS VARCHAR), ',' ORDER BY e.created_at, e.id, e.target_id) AS targets
    FROM order_e o JOIN edge_e e ON e.source_id = o.id AND e.is_available WHERE o.is_available GROUP BY o.id
    UNION ALL SELECT o.id, NULL FROM order_e o WHERE o.is_available
      AND NOT EXISTS (SELECT 1 FROM edge_e e WHERE e.source_id = o.id AND e.is_available)""",
)
def hydrate_multi_refs(t: Tables):
    rows = links.hydrate_multi_refs(t.catalog, "Order")
    lists = rows.groupBy("id").agg(F.array_sort(F.collect_list(F.when(F.col("ordinal").isNotNull(), F.struct("ordinal", "target_id")))).alias("refs"))
    joined = F.array_join(F.transform("refs", lambda r: r["target_id"].cast("string")), ",")
    return lists.select("id", F.when(F.size("refs") > 0, joined).alias("targets"))


@query(
    "expand_path",
    """SELECT o.id, c.name AS customer_name, n.name AS nation_name, r.name AS region_name FROM order_e o
    LEFT JOIN (SELECT * FROM customer_e WHERE is_available) c ON c.id = o.customer
    LEFT JOIN nation_e n ON n.id = c.nation LEFT JOIN region_e r ON r.id = n.region WHERE o.is_available""",
)
def expand_path(t: Tables):
    rows = links.expand_path(t.catalog, "Order", "customer.nation.region")
    person = F.col("customer_expanded")
    return rows.select(
        "id", person["name"].alias("customer_name"),
        person["nation_expanded"]["name"].alias("nation_name"),
        person["nation_expanded"]["region_expanded"]["name"].alias("region_name"),
    )


@query(
    "expand_path_multi",
    """SELECT o.id, count(p.id) AS n, string_agg(p.name, ',' ORDER BY e.created_at, e.id, p.id) AS names FROM order_e o
    LEFT JOIN edge_e e ON e.source_id = o.id AND e.is_available
    LEFT JOIN (SELECT * FROM part_e WHERE is_available) p ON p.id = e.target_id WHERE o.is_available GROUP BY o.id""",
)
def expand_path_multi(t: Tables):
    rows = links.expand_path(t.catalog, "Order", "parts")
    part = F.struct("parts_ordinal", F.col("parts_expanded.name").alias("name"))
    lists = rows.groupBy("id").agg(F.array_sort(F.collect_list(F.when(F.col("parts_ordinal").isNotNull(), part))).alias("found"))
    names = F.array_join(F.transform("found", lambda p: p["name"]), ",")
    return lists.select("id", F.size("found").cast("bigint").alias("n"), F.when(F.size("found") > 0, names).alias("names"))


@query(
    "resolve_types",
    """SELECT 'Order' AS entity_type, id FROM order_e WHERE id IN (SELECT l_partkey FROM lineitem)
    UNION ALL SELECT 'Part', id FROM part_e WHERE id IN (SELECT l_partkey FROM lineitem)
    UNION ALL SELECT 'Customer', id FROM customer_e WHERE id IN (SELECT l_partkey FROM lineitem)
    UNION ALL SELECT 'Supplier', id FROM supplier_e WHERE id IN (SELECT l_partkey FROM lineitem)
    UNION ALL SELECT 'Nation', id FROM nation_e WHERE id IN (SELECT l_partkey FROM lineitem)
    UNION ALL SELECT 'Region', id FROM region_e WHERE id IN (SELECT l_partkey FROM lineitem)""",
)
def resolve_types(t: Tables):
    ids = t.raw("lineitem").select(F.col("l_partkey").alias("id"))
    return links.resolve_types(t.catalog, ids)


@query("find_relationships", "SELECT id, source_id, target_id FROM link_e WHERE is_available AND source_id = 7 AND relationship_type = 'views'")
def find_relationships(t: Tables):
    rows = links.find_relationships(t.role("link_e"), source_id=7, relationship_type="views")
    return rows.select("id", "source_id", "target_id")


@query(
    "related_to",
    f"""SELECT e.id AS edge_id, o.id, o.total, x.created_at, x.updated_at FROM edge_e e JOIN order_e o ON o.id = e.source_id
    LEFT JOIN ({_order_temporal()}) x ON x.entity_id = o.id
    WHERE e.is_available AND o.is_available AND e.target_id = 17""",
)
def related_to(t: Tables):
    rows = links.related_to(t.catalog, "Order", 17, "parts")
    return rows.select("edge_id", "id", "total", "created_at", "updated_at")


@query(
    "traverse",
    """WITH RECURSIVE walk AS (
      SELECT id, source_id, target_id, relationship_type, 1 AS depth FROM link_e
      WHERE is_available AND source_id = 7 AND relationship_type = 'views'
      UNION ALL SELECT l.id, l.source_id, l.target_id, l.relationship_type, w.depth + 1
      FROM link_e l JOIN walk w ON l.source_id = w.target_id WHERE l.is_available AND w.depth < 3)
    SELECT id, source_id, target_id, relationship_type, depth, count(*) AS walks FROM walk GROUP BY ALL""",
)
def traverse(t: Tables):
    return graph.traverse(t.role("link_e").where("is_available"), 7, "views", 3)


LATEST_EDGE = """SELECT source_id, target_id, relationship_type, arg_max(operation, timestamp) AS operation,
  arg_max(id, timestamp) AS id, max(timestamp) AS timestamp FROM (
    SELECT id, entity_id AS source_id, k AS target_id, operation, timestamp,
      CASE WHEN k % 3 = 0 THEN 'follows' ELSE 'views' END AS relationship_type FROM log_e
    WHERE operation IN ('relationship_add', 'relationship_remove') AND timestamp <= {at}) e
  GROUP BY source_id, target_id, relationship_type"""
NOW = "TIMESTAMP '2024-01-20 00:00:00'"
LIVE_AT = f"SELECT CAST(id AS VARCHAR) AS id, CAST(source_id AS VARCHAR) AS source_id, CAST(target_id AS VARCHAR) AS target_id, relationship_type FROM ({LATEST_EDGE.format(at=NOW)}) g WHERE operation = 'relationship_add'"


@query("live_edges_at", LIVE_AT)
def live_edges_at(t: Tables):
    return tm.live_edges_at(t.log, "2024-01-20 00:00:00")


@query(
    "latest_edge_event",
    f"""SELECT CAST(source_id AS VARCHAR) AS source_id, CAST(target_id AS VARCHAR) AS target_id, relationship_type,
    operation, timestamp FROM ({LATEST_EDGE.format(at=NOW)}) g""",
)
def latest_edge_event(t: Tables):
    return tm.latest_edge_event(t.log, "2024-01-20 00:00:00").drop("id")


@query(
    "traverse_as_of",
    f"""WITH RECURSIVE live AS ({LIVE_AT}), walk AS (
      SELECT id, source_id, target_id, relationship_type, 1 AS depth FROM live WHERE source_id = '5'
      UNION ALL SELECT l.id, l.source_id, l.target_id, l.relationship_type, w.depth + 1
      FROM live l JOIN walk w ON l.source_id = w.target_id WHERE w.depth < 3)
    SELECT id, source_id, target_id, relationship_type, depth, count(*) AS walks FROM walk GROUP BY ALL""",
)
def traverse_as_of(t: Tables):
    return graph.traverse_as_of(t.log, "5", "2024-01-20 00:00:00", None, 3)


GLOBAL_EDGES = """
  ids AS (SELECT 'Region/' || id AS id FROM region_e UNION ALL SELECT 'Nation/' || id FROM nation_e
    UNION ALL SELECT 'Customer/' || id FROM customer_e WHERE is_available UNION ALL SELECT 'Supplier/' || id FROM supplier_e
    UNION ALL SELECT 'Part/' || id FROM part_e WHERE is_available UNION ALL SELECT 'Order/' || id FROM order_e WHERE is_available),
  edges AS (
    SELECT DISTINCT 'Order/' || source_id AS s, 'Part/' || target_id AS t, relationship_type AS ty, 'LINK_TABLE' AS origin FROM edge_e WHERE is_available
    UNION ALL SELECT 'Nation/' || id, 'Region/' || region, 'region', 'COLUMN' FROM nation_e
    UNION ALL SELECT 'Customer/' || id, 'Nation/' || nation, 'nation', 'COLUMN' FROM customer_e WHERE is_available
    UNION ALL SELECT 'Supplier/' || id, 'Nation/' || nation, 'nation', 'COLUMN' FROM supplier_e
    UNION ALL SELECT 'Order/' || id, 'Customer/' || customer, 'customer', 'COLUMN' FROM order_e WHERE is_available)"""

START, REGION = "Order/1", "Region/1"


@query(
    "neighbors",
    f"""WITH {GLOBAL_EDGES},
    l1 AS (SELECT t AS id FROM edges WHERE s = '{START}' UNION SELECT s FROM edges WHERE t = '{START}'),
    expanded AS (SELECT '{START}' AS id UNION SELECT id FROM l1),
    l2 AS (SELECT t AS id FROM edges WHERE s IN (SELECT id FROM expanded) UNION SELECT s FROM edges WHERE t IN (SELECT id FROM expanded)),
    nodes AS (SELECT id FROM ids WHERE id IN (SELECT id FROM l2 UNION SELECT id FROM expanded))
    SELECT s AS source_id, t AS target_id, ty AS relationship_type, origin AS edge_source FROM edges
    WHERE (s IN (SELECT id FROM expanded) OR t IN (SELECT id FROM expanded))
      AND s IN (SELECT id FROM nodes) AND t IN (SELECT id FROM nodes)""",
)
def neighbors(t: Tables):
    """On the adjacency that the first call of a session stores."""
    return graph.neighbors_stored(t.spark, adjacency(t), START, depth=2, must_live=False).edges


_STORED: dict[tuple[str, str], str] = {}


def adjacency(t: Tables) -> str:
    key = (t.spark.sparkContext.applicationId, t.folder)
    if key not in _STORED:
        path = scratch_path(t.spark, "adjacency")
        graph.write_adjacency(t.global_catalog, path)
        _STORED[key] = path
    return _STORED[key]


@query(
    "neighbors_deep",
    f"""WITH {GLOBAL_EDGES}, both_ways AS (SELECT s AS a, t AS b FROM edges UNION SELECT t, s FROM edges),
    l1 AS (SELECT b AS id FROM both_ways WHERE a = '{REGION}' UNION SELECT '{REGION}'),
    l2 AS (SELECT b AS id FROM both_ways WHERE a IN (SELECT id FROM l1) UNION SELECT id FROM l1),
    l3 AS (SELECT b AS id FROM both_ways WHERE a IN (SELECT id FROM l2) UNION SELECT id FROM l2)
    SELECT id, split_part(id, '/', 1) AS entity_type FROM ids WHERE id IN (SELECT id FROM l3)""",
)
def neighbors_deep(t: Tables):
    """Thousands of nodes: nations, customers, suppliers and their orders."""
    return graph.neighbors_stored(t.spark, adjacency(t), REGION, depth=3, must_live=False).nodes


@query(
    "neighbors_nodes",
    f"""WITH {GLOBAL_EDGES},
    l1 AS (SELECT t AS id FROM edges WHERE s = '{START}' UNION SELECT s FROM edges WHERE t = '{START}'),
    expanded AS (SELECT '{START}' AS id UNION SELECT id FROM l1),
    l2 AS (SELECT t AS id FROM edges WHERE s IN (SELECT id FROM expanded) UNION SELECT s FROM edges WHERE t IN (SELECT id FROM expanded))
    SELECT id, split_part(id, '/', 1) AS entity_type FROM ids WHERE id IN (SELECT id FROM l2 UNION SELECT id FROM expanded)""",
)
def neighbors_nodes(t: Tables):
    return graph.neighbors(t.global_catalog, START, depth=2, must_live=False).nodes


STATE_AT = """SELECT entity_id, k, n_state, creates FROM (
    SELECT entity_id, arg_max(k, timestamp) FILTER (WHERE operation IN ('create', 'update')) AS k,
      count(*) FILTER (WHERE operation IN ('create', 'update')) AS n_state,
      count(*) FILTER (WHERE operation = 'create') AS creates,
      coalesce(arg_max(deletion, timestamp) FILTER (WHERE operation = 'availability_change'), FALSE) AS gone
    FROM log_e WHERE timestamp <= {at} GROUP BY entity_id) s WHERE n_state > 0 AND NOT gone"""


@query(
    "neighbors_as_of",
    f"""WITH live AS (SELECT DISTINCT source_id AS s, target_id AS t, relationship_type AS ty FROM ({LIVE_AT}) x),
    l1 AS (SELECT t AS id FROM live WHERE s = '9' UNION SELECT s FROM live WHERE t = '9' UNION SELECT '9'),
    l2 AS (SELECT t AS id FROM live WHERE s IN (SELECT id FROM l1) UNION SELECT s FROM live WHERE t IN (SELECT id FROM l1) UNION SELECT id FROM l1),
    nodes AS (SELECT CAST(entity_id AS VARCHAR) AS id FROM ({STATE_AT.format(at=NOW)}) q WHERE CAST(entity_id AS VARCHAR) IN (SELECT id FROM l2))
    SELECT s AS source_id, t AS target_id, ty AS relationship_type, 'LINK_TABLE' AS edge_source FROM live
    WHERE (s IN (SELECT id FROM l1) OR t IN (SELECT id FROM l1)) AND s IN (SELECT id FROM nodes) AND t IN (SELECT id FROM nodes)""",
)
def neighbors_as_of(t: Tables):
    return graph.neighbors_as_of(t.log, "9", "2024-01-20 00:00:00", depth=2).edges


@query(
    "column_edges",
    """SELECT 'Nation/' || id AS source_id, 'Region/' || region AS target_id, 'region' AS relationship_type FROM nation_e
    UNION ALL SELECT 'Customer/' || id, 'Nation/' || nation, 'nation' FROM customer_e WHERE is_available
    UNION ALL SELECT 'Supplier/' || id, 'Nation/' || nation, 'nation' FROM supplier_e
    UNION ALL SELECT 'Order/' || id, 'Customer/' || customer, 'customer' FROM order_e WHERE is_available""",
)
def column_edges(t: Tables):
    return links.column_edges(t.global_catalog).drop("edge_source")


@query(
    "union_edge_stores",
    """SELECT s AS source_id, t AS target_id, ty AS relationship_type,
      CASE WHEN min(origin) = 0 THEN 'LINK_TABLE' ELSE 'COLUMN' END AS edge_source FROM (
      SELECT source_id AS s, target_id AS t, 'parts' AS ty, 0 AS origin FROM edge_e WHERE is_available
      UNION ALL SELECT id, customer, 'customer', 1 FROM order_e
      UNION ALL SELECT id, customer, 'customer', 0 FROM order_e WHERE status = 'F') x GROUP BY s, t, ty""",
)
def union_edge_stores(t: Tables):
    def customers(rows):
        return rows.select(
            F.col("id").alias("source_id"), F.col("customer").alias("target_id"), F.lit("customer").alias("relationship_type")
        )

    link = t.role("edge_e").where("is_available").select("source_id", "target_id", "relationship_type")
    both = link.unionByName(customers(t.role("order_e").where("status = 'F'")))
    return links.union_edge_stores(both, customers(t.role("order_e")))


@query(
    "supersession_chain",
    """WITH RECURSIVE chain AS (
      SELECT id, 1 AS hop, superseded_by AS replacement FROM order_e WHERE superseded_by IS NOT NULL
      UNION ALL SELECT c.id, c.hop + 1, o.superseded_by FROM chain c JOIN order_e o ON o.id = c.replacement
      WHERE o.superseded_by IS NOT NULL)
    SELECT id, hop, replacement FROM chain""",
)
def supersession_chain(t: Tables):
    return graph.supersession_chain(t.role("order_e"))


@query(
    "supersession_ends",
    """WITH RECURSIVE walk AS (SELECT id, 1 AS hop, superseded_by AS node FROM order_e WHERE superseded_by IS NOT NULL
      UNION ALL SELECT w.id, w.hop + 1, o.superseded_by FROM walk w JOIN order_e o ON o.id = w.node WHERE o.superseded_by IS NOT NULL)
    SELECT id, max(hop)::BIGINT AS hops, arg_max(node, hop) AS terminal FROM walk GROUP BY id""",
)
def supersession_ends(t: Tables):
    return graph.supersession_ends(t.role("order_e"))


MAPPED = """SELECT value, entity, source_system, TIMESTAMP '2024-01-01' + entity * INTERVAL 1 MINUTE AS created_at, id
  FROM ext_e WHERE is_active"""


@query(
    "get_by_external_id",
    f"""SELECT value, arg_max(entity, created_at) AS entity, arg_max(source_system, created_at) AS source_system,
      max(created_at) AS created_at FROM ({MAPPED}) m
    WHERE entity IN (SELECT id FROM customer_e WHERE is_available) GROUP BY value""",
)
def get_by_external_id(t: Tables):
    asked = t.role("ext_e").select("value").distinct()
    rows = ext.get_by_external_id(t.role("ext_e"), t.mapping_log, t.role("customer_e"), asked)
    return rows.drop("mapping_id")


@query(
    "newest_mapping",
    f"""SELECT value, arg_max(entity, created_at) AS entity, max(created_at) AS created_at FROM ({MAPPED}) m GROUP BY value""",
)
def newest_mapping(t: Tables):
    return ext.newest_mapping(ext.mapping_times(t.role("ext_e"), t.mapping_log)).select("value", "entity", "created_at")


EXT_LIST = """SELECT id, entity AS entity_id, value AS external_id, source_system,
  TIMESTAMP '2024-01-01' + entity * INTERVAL 1 MINUTE AS created_at,
  CASE WHEN NOT is_active THEN TIMESTAMP '2024-01-31' + entity * INTERVAL 1 MINUTE END AS superseded_at FROM ext_e"""


@query("list_external_ids", EXT_LIST)
def list_external_ids(t: Tables):
    return ext.list_external_ids(t.role("ext_e"), t.mapping_log, t.role("customer_e"), include_superseded=True)


@query("superseded_external_ids", f"SELECT * FROM ({EXT_LIST}) x WHERE superseded_at IS NOT NULL")
def superseded_external_ids(t: Tables):
    return ext.superseded_external_ids(t.role("ext_e"), t.mapping_log)


XREF_SQL = """SELECT id AS entity_id, 'Customer' AS entity_type, slot, system, value FROM (
  SELECT id, 'main' AS slot, 'crm' AS system, concat('C', CAST(id % 700 AS VARCHAR)) AS value FROM customer_e WHERE is_available
  UNION ALL SELECT id, 'others', 'geo', concat('N', CAST(nation AS VARCHAR), '-', CAST(id AS VARCHAR)) FROM customer_e WHERE is_available
  UNION ALL SELECT id, 'others', 'seg', segment FROM customer_e WHERE is_available AND id % 3 = 0
  UNION ALL SELECT id, 'text', 'txt', concat('T', CAST(id AS VARCHAR)) FROM customer_e WHERE is_available AND id % 2 = 0) x"""


def xref_rows(t: Tables):
    """Customers with a struct, an array and a JSON-text cross-reference slot."""
    from ..model import Catalog, EntityType, Schema, Slot

    def pair(system, value):
        return F.struct(F.lit(system).alias("system"), value.alias("value"))

    key = F.col("id").cast("string")
    rows = t.role("customer_e").select(
        "id", "is_available",
        pair("crm", F.concat(F.lit("C"), (F.col("id") % 700).cast("string"))).alias("main"),
        F.array(
            pair("geo", F.concat(F.lit("N"), F.col("nation").cast("string"), F.lit("-"), key)),
            pair("seg", F.when(F.col("id") % 3 == 0, F.col("segment")).otherwise("")),
        ).alias("others"),
        F.when(F.col("id") % 2 == 0, F.to_json(F.array(pair("txt", F.concat(F.lit("T"), key))))).otherwise("not json").alias("text"),
    )
    schema = Schema((EntityType("Customer", (Slot("main", xref=True), Slot("others", xref=True), Slot("text", xref=True))),))
    return Catalog(schema, {"Customer": rows})


@query("xref_index", XREF_SQL)
def xref_index(t: Tables):
    return ext.xref_index(xref_rows(t))


@query(
    "find_by_xref",
    f"""SELECT system, value, entity_id FROM ({XREF_SQL}) x
    WHERE (system, value) IN (SELECT 'txt', concat('T', CAST(o_custkey AS VARCHAR)) FROM orders)""",
)
def find_by_xref(t: Tables):
    pairs = t.raw("orders").select(
        F.lit("txt").alias("system"), F.concat(F.lit("T"), F.col("o_custkey").cast("string")).alias("value")
    )
    return ext.find_by_xref(ext.xref_index(xref_rows(t)), pairs).select("system", "value", "entity_id")


@query("list_xrefs", f"SELECT slot, system, value FROM ({XREF_SQL}) x WHERE entity_id = 18")
def list_xrefs(t: Tables):
    return ext.list_xrefs(ext.xref_index(xref_rows(t)), 18).select("slot", "system", "value")
