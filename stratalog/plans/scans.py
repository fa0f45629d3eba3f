"""Scans, sources and sinks over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import read as rd
from ..runtime import scratch_path
from ..sources import readers as src
from ..sources import sinks
from .registry import query
from .tables import Tables


@query("scan_entities", "SELECT id, customer, total FROM order_e WHERE is_available AND status = 'F'")
def scan_entities(t: Tables):
    return rd.scan_entities(t.catalog, "Order", status="F").select("id", "customer", "total")


@query(
    "scan_all_classes",
    """SELECT 'Region' AS entity_type, id, name FROM region_e WHERE is_available
    UNION ALL SELECT 'Nation', id, name FROM nation_e WHERE is_available
    UNION ALL SELECT 'Customer', id, name FROM customer_e WHERE is_available
    UNION ALL SELECT 'Supplier', id, name FROM supplier_e WHERE is_available
    UNION ALL SELECT 'Part', id, name FROM part_e WHERE is_available
    UNION ALL SELECT 'Order', id, NULL FROM order_e WHERE is_available""",
)
def scan_all_classes(t: Tables):
    return rd.scan_all_classes(t.catalog, ["id", "name"])


@query(
    "read_csv_records",
    """SELECT 'record' AS kind, CAST(c_custkey AS VARCHAR) AS c_custkey, c_name, c_mktsegment
    FROM customer WHERE c_custkey % 50 <> 0
    UNION ALL SELECT 'error', CAST(c_custkey AS VARCHAR), NULL, NULL FROM customer WHERE c_custkey % 50 = 0""",
)
def read_csv_records(t: Tables):
    path = scratch_path(t.spark, "csv")
    key = F.col("c_custkey")
    extra = F.when(key % 50 == 0, F.lit(",surplus")).otherwise("")
    t.raw("customer").select(
        F.concat(F.concat_ws(",", key.cast("string"), "c_name", "c_mktsegment"), extra).alias("value")
    ).write.text(path)
    good, bad = src.read_csv_records(t.spark, path, ["c_custkey", "c_name", "c_mktsegment"], header=False)
    none = F.lit(None).cast("string")
    errors = bad.select(
        F.lit("error").alias("kind"), F.split_part("record", F.lit(","), F.lit(1)).alias("c_custkey"),
        none.alias("c_name"), none.alias("c_mktsegment"),
    )
    return good.select(F.lit("record").alias("kind"), "c_custkey", "c_name", "c_mktsegment").unionByName(errors)


@query(
    "read_json_array",
    """SELECT 'record' AS kind, o_orderkey AS id, o_orderstatus AS status, NULL AS error FROM orders
    UNION ALL SELECT 'error', NULL, NULL, 'not an object' FROM orders WHERE o_orderkey % 7 = 0""",
)
def read_json_array(t: Tables):
    path = scratch_path(t.spark, "json")
    obj = F.to_json(F.struct(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status")))
    extra = F.when(F.col("o_orderkey") % 7 == 0, F.lit(", 5")).otherwise("")
    t.raw("orders").select(F.concat(F.lit("["), obj, extra, F.lit("]")).alias("value")).write.text(path)
    kind = T.StructType([T.StructField("id", T.LongType()), T.StructField("status", T.StringType())])
    good, bad = src.read_json_array(t.spark, path, kind, whole_files=False)
    none = F.lit(None)
    return good.select(F.lit("record").alias("kind"), "id", "status", none.cast("string").alias("error")).unionByName(
        bad.select(F.lit("error").alias("kind"), none.cast("bigint").alias("id"), none.cast("string").alias("status"), "error")
    )


@query(
    "read_jsonl",
    """SELECT 'record' AS error, event_id, k FROM event_k WHERE event_id % 10 > 3
    UNION ALL SELECT 'invalid JSON', NULL, NULL FROM event_k WHERE event_id % 10 = 0
    UNION ALL SELECT 'not an object', NULL, NULL FROM event_k WHERE event_id % 10 = 1
    UNION ALL SELECT 'missing event_id', NULL, NULL FROM event_k WHERE event_id % 10 = 2""",
)
def read_jsonl(t: Tables):
    path = scratch_path(t.spark, "jsonl")
    last = F.col("event_id") % 10
    line = (
        F.when(last == 0, F.lit("{broken"))
        .when(last == 1, F.lit("[1, 2]"))
        .when(last == 2, F.to_json(F.struct("k")))
        .when(last == 3, F.lit("   "))
        .otherwise(F.to_json(F.struct("event_id", "k")))
    )
    t.event_k.select(line.alias("value")).write.text(path)
    kind = T.StructType([T.StructField("event_id", T.LongType()), T.StructField("k", T.LongType())])
    good, bad = src.read_jsonl(t.spark, path, kind, id_field="event_id")
    none = F.lit(None).cast("bigint")
    return good.select(F.lit("record").alias("error"), "event_id", "k").unionByName(
        bad.select("error", none.alias("event_id"), none.alias("k"))
    )


@query(
    "extract_json_path",
    """SELECT event_id, 0 AS position, k FROM event_k
    UNION ALL SELECT event_id, 1, event_id % 9 FROM event_k""",
)
def extract_json_path(t: Tables):
    doc = F.to_json(
        F.struct(
            F.struct(
                F.array(
                    F.struct(F.col("k")), F.struct((F.col("event_id") % 9).alias("k"))
                ).alias("items")
            ).alias("data")
        )
    )
    docs = t.event_k.select("event_id", doc.alias("doc"))
    found = src.extract_json_path(docs, "doc", "$.data.items")
    return found.select("event_id", "position", F.get_json_object("record", "$.k").cast("bigint").alias("k"))


@query(
    "read_sql_query",
    "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderdate > TIMESTAMP '1998-03-01 10:00:00'",
)
def read_sql_query(t: Tables):
    t.raw("orders").createOrReplaceTempView("source_orders")
    return src.read_sql_query(
        t.spark,
        "SELECT o_orderkey, o_totalprice FROM source_orders WHERE o_orderdate > :since",
        since="1998-03-01T12:00:00+02:00",
    )


@query(
    "read_bundle",
    """SELECT 'Customer' AS entity_type, id, name, segment, NULL AS error FROM customer_e WHERE id % 10 > 2
    UNION ALL SELECT 'Supplier', id, name, NULL, NULL FROM customer_e WHERE id % 10 = 2
    UNION ALL SELECT 'error', id, NULL, NULL, 'unknown type Robot' FROM customer_e WHERE id % 10 = 1
    UNION ALL SELECT 'error', id, NULL, NULL, 'abstract type Party' FROM customer_e WHERE id % 10 = 0""",
)
def read_bundle(t: Tables):
    path = scratch_path(t.spark, "bundle")
    last = F.col("id") % 10
    kind = F.when(last == 1, "Robot").when(last == 2, "Supplier").when(last > 2, "Customer")
    party = F.struct("id", kind.alias("kind"), "name", "balance", "nation", "segment")
    t.role("customer_e").select(F.to_json(F.struct(F.array(party).alias("parties"))).alias("value")).write.text(path)
    record = T._parse_datatype_string(
        "struct<id:bigint,kind:string,name:string,balance:double,nation:bigint,segment:string>"
    )
    tables, errors = src.read_bundle(
        t.spark, path, t.catalog.schema, {"parties": "Party"}, {"parties": record}, multi_line=False
    )
    none = F.lit(None).cast("string")
    rows = [
        tables["Customer"].select(F.lit("Customer").alias("entity_type"), "id", "name", "segment", none.alias("error")),
        tables["Supplier"].select(F.lit("Supplier").alias("entity_type"), "id", "name", none.alias("segment"), none.alias("error")),
        errors.select(F.lit("error").alias("entity_type"), F.col("id").cast("bigint").alias("id"), none.alias("name"), none.alias("segment"), "error"),
    ]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


@query(
    "read_stanzas",
    """SELECT concat('P:', CAST(p_partkey AS VARCHAR)) AS id, p_name AS name,
      concat(p_brand, ' made of ', p_type) AS def FROM part WHERE p_size % 10 <> 3""",
)
def read_stanzas(t: Tables):
    path = scratch_path(t.spark, "stanzas")
    lines = F.concat(
        F.lit("[Term]\nid: P:"), F.col("p_partkey").cast("string"), F.lit("\nname: "), F.col("p_name"),
        F.lit('\ndef: "'), F.col("p_brand"), F.lit(" made of "), F.col("p_type"), F.lit('" [source:x]\n'),
        F.when(F.col("p_size") % 10 == 3, F.lit("is_obsolete: true\n")).otherwise(""),
        F.when(F.col("p_size") % 10 == 4, F.lit("\n[Typedef]\nid: not_a_term\n")).otherwise(""),
    )
    t.raw("part").select(lines.alias("value")).write.text(path)
    return src.read_stanzas(t.spark, path)


@query(
    "verify_file_digest",
    """SELECT url AS path, sha256(html) AS actual, page_id % 7 <> 0 AS matches FROM pages""",
)
def verify_file_digest(t: Tables):
    """Pages share urls, so a page is known by its number beside its path."""
    pages = t.raw("pages")
    files = pages.select("page_id", F.col("url").alias("path"), F.encode("html", "UTF-8").alias("content"))
    good = F.sha2(F.encode("html", "UTF-8"), 256)
    manifest = pages.select(
        "page_id", F.col("url").alias("path"), F.when(F.col("page_id") % 7 != 0, good).otherwise("stale").alias("sha256")
    )
    return src.verify_file_digest(files, manifest, ("page_id", "path")).select("path", "actual", "matches")


@query("append_provenance", "SELECT operation, entity_id, count(*) AS n FROM log_e GROUP BY operation, entity_id")
def append_provenance(t: Tables):
    path = scratch_path(t.spark, "log")
    sinks.append_provenance(t.log, path)
    return t.spark.read.parquet(path).groupBy("operation", "entity_id").agg(F.count("*").alias("n"))


@query(
    "append_write_log",
    """SELECT DISTINCT 'loader1' AS loader_name, 'v1' AS version, CAST(o_orderkey AS VARCHAR) AS entity_id
    FROM orders WHERE CAST(o_orderkey AS VARCHAR) NOT IN
      (SELECT entity_id FROM write_e WHERE loader_name = 'loader1' AND version = 'v1')""",
)
def append_write_log(t: Tables):
    ids = t.role("order_e").select("id").unionByName(t.role("order_e").select("id"))
    rows = sinks.write_log_rows(t.role("write_e"), ids, "loader1", "v1", "Order", "2024-01-01 00:00:00")
    return rows.select("loader_name", "version", "entity_id")


@query(
    "map_fields",
    """SELECT c_custkey AS id, c_name AS name,
      CASE c_mktsegment WHEN 'HOUSEHOLD' THEN 'home' WHEN 'MACHINERY' THEN 'industry' ELSE c_mktsegment END AS segment,
      concat('region ', CAST(n_regionkey AS VARCHAR)) AS nation
    FROM customer JOIN nation ON c_nationkey = n_nationkey""",
)
def map_fields(t: Tables):
    rows = t.raw("customer").select("c_custkey", "c_name", "c_mktsegment", F.col("c_nationkey").cast("string").alias("c_nationkey"))
    terms = t.raw("nation").select(
        F.col("n_nationkey").cast("string").alias("term"),
        F.concat(F.lit("region "), F.col("n_regionkey").cast("string")).alias("standard"),
    )
    return src.map_fields(
        rows,
        {"c_custkey": "id", "c_name": "name", "c_mktsegment": "segment", "c_nationkey": "nation"},
        {"segment": {"HOUSEHOLD": "home", "MACHINERY": "industry"}},
        {"nation": terms},
    )


# Projections and filters.

LIVE = "FROM order_e WHERE is_available"


def orders(t: Tables, *leaves, mode="and", where=None):
    return rd.find(t.catalog, "Order", list(leaves), mode, where)


def is_(field, op, value):
    return {"field": field, "op": op, "value": value}


@query("filter_eq", f"SELECT id, total {LIVE} AND priority = '1-URGENT'")
def filter_eq(t: Tables):
    return orders(t, is_("priority", "eq", "1-URGENT")).select("id", "total")


@query("filter_neq", f"SELECT id, priority {LIVE} AND priority <> '1-URGENT'")
def filter_neq(t: Tables):
    return orders(t, is_("priority", "neq", "1-URGENT")).select("id", "priority")


@query(
    "filter_compare",
    f"""SELECT id, total, ordered_at {LIVE} AND total > 100000 AND total <= 200000
    AND ordered_at >= TIMESTAMP '1996-01-01' AND customer < 1000""",
)
def filter_compare(t: Tables):
    return orders(
        t, is_("total", "gt", 100000), is_("total", "lte", "200000"),
        is_("ordered_at", "gte", "1996-01-01T00:00:00"), is_("customer", "lt", 1000),
    ).select("id", "total", "ordered_at")


@query("filter_in", f"SELECT id, priority {LIVE} AND priority IN ('1-URGENT', '5-LOW')")
def filter_in(t: Tables):
    return orders(t, is_("priority", "in", ["1-URGENT", "5-LOW", None])).select("id", "priority")


@query("filter_contains", "SELECT id, name FROM part_e WHERE is_available AND contains(lower(name), 'ring')")
def filter_contains(t: Tables):
    return rd.find(t.catalog, "Part", [is_("name", "contains", "RING")]).select("id", "name")


@query("filter_is_null", f"SELECT id, status {LIVE} AND priority IS NULL")
def filter_is_null(t: Tables):
    return orders(t, is_("priority", "is_null", True)).select("id", "status")


@query(
    "filter_flat_and_or",
    f"SELECT id, status, priority, total {LIVE} AND (status = 'O' OR priority <> '5-LOW' OR total < 2000)",
)
def filter_flat_and_or(t: Tables):
    return orders(
        t, {"status": "O"}, is_("priority", "neq", "5-LOW"), is_("total", "lt", 2000), mode="or"
    ).select("id", "status", "priority", "total")


@query(
    "where_tree",
    f"""SELECT id, status, priority, total {LIVE} AND (
      (status = 'F' AND NOT coalesce(priority = '1-URGENT', FALSE))
      OR (total > 400000 AND NOT (coalesce(priority IN ('5-LOW'), FALSE) OR coalesce(total < 450000, FALSE))))
      AND customer >= 100""",
)
def where_tree(t: Tables):
    tree = {
        "or": [
            {"and": [is_("status", "eq", "F"), {"not": is_("priority", "eq", "1-URGENT")}]},
            {"and": [is_("total", "gt", 400000), {"not": {"or": [is_("priority", "in", ["5-LOW"]), is_("total", "lt", 450000)]}}]},
        ]
    }
    return orders(t, is_("customer", "gte", 100), where=tree).select("id", "status", "priority", "total")


@query(
    "filter_created_between",
    """SELECT id, o.ordered_at AS created_at FROM order_e o WHERE is_available
    AND ordered_at BETWEEN TIMESTAMP '1997-01-01' AND TIMESTAMP '1997-06-30'""",
)
def filter_created_between(t: Tables):
    rows = rd.filter_created_between(
        t.catalog.live("Order"), t.order_log, "1997-01-01 00:00:00", "1997-06-30 00:00:00"
    )
    return rows.select("id", "created_at")


TEMPORAL_SQL = """SELECT entity_id, min(CASE WHEN operation = 'create' THEN timestamp END) AS created_at,
  max(timestamp) AS updated_at FROM {log} GROUP BY entity_id"""


def _order_temporal() -> str:
    from .tables import ORDER_LOG_SQL

    return TEMPORAL_SQL.format(log=ORDER_LOG_SQL)


@query(
    "get_by_id",
    f"""SELECT o.id, status, total, created_at, updated_at FROM order_e o
    LEFT JOIN ({_order_temporal()}) x ON x.entity_id = o.id
    WHERE is_available AND o.id IN (SELECT DISTINCT l_orderkey FROM lineitem WHERE l_quantity >= 50)""",
)
def get_by_id(t: Tables):
    ids = t.raw("lineitem").where("l_quantity >= 50").select(F.col("l_orderkey").alias("id")).distinct()
    return rd.get_by_id(t.catalog, "Order", ids).select("id", "status", "total", "created_at", "updated_at")


@query(
    "get_any",
    f"""SELECT o.id, is_available, total, created_at, updated_at FROM order_e o
    LEFT JOIN ({_order_temporal()}) x ON x.entity_id = o.id
    WHERE o.id IN (SELECT DISTINCT l_orderkey FROM lineitem WHERE l_quantity >= 50)""",
)
def get_any(t: Tables):
    ids = t.raw("lineitem").where("l_quantity >= 50").select(F.col("l_orderkey").alias("id")).distinct()
    return rd.get_any(t.catalog, "Order", ids).select("id", "is_available", "total", "created_at", "updated_at")


@query("project_to_schema", "SELECT name, balance, nation, segment FROM customer_e")
def project_to_schema(t: Tables):
    rows = t.role("customer_e").withColumn("scratch", F.lit(1))
    return rd.project_to_schema(rows, t.catalog.schema, "Customer")


@query(
    "decode_values",
    """SELECT event_id, k % 2 = 1 AS odd, concat('t', CAST(k AS VARCHAR), '|t', CAST(k + 1 AS VARCHAR)) AS tags,
      k AS level FROM event_k""",
)
def decode_values(t: Tables):
    from ..model import EntityType, Schema, Slot

    schema = Schema((EntityType("Flagged", (Slot("odd", "boolean"), Slot("tags", multivalued=True), Slot("level", "integer"))),))
    stored = t.event_k.select(
        "event_id",
        (F.col("k") % 2).cast("int").alias("odd"),
        F.to_json(F.array(F.concat(F.lit("t"), F.col("k").cast("string")), F.concat(F.lit("t"), (F.col("k") + 1).cast("string")))).alias("tags"),
        F.col("k").cast("string").alias("level"),
    )
    return rd.decode_values(stored, schema, "Flagged").withColumn("tags", F.array_join("tags", "|"))


@query("flatten_nested", """SELECT event_id, k AS "props.k", value AS "detail.inner.value" FROM event_k""")
def flatten_nested(t: Tables):
    nested = t.raw("events").select(
        "event_id",
        F.from_json("props", "k bigint").alias("props"),
        F.struct(F.struct("value").alias("inner")).alias("detail"),
    )
    return rd.flatten_nested(nested)


@query("expand_dotted", "SELECT id, nation, segment FROM customer_e")
def expand_dotted(t: Tables):
    dotted = t.role("customer_e").select(
        "id", F.col("nation").alias("place.nation"), F.col("segment").alias("place.market.segment")
    )
    return rd.expand_dotted(dotted).select("id", "place.nation", "place.market.segment")


@query(
    "dispatch_by_type",
    """SELECT 'Customer' AS target, id, name, NULL AS error FROM customer_e WHERE id % 4 = 0
    UNION ALL SELECT 'Supplier', id, name, NULL FROM customer_e WHERE id % 4 = 1
    UNION ALL SELECT 'error', id, name, 'unknown type Robot' FROM customer_e WHERE id % 4 = 2
    UNION ALL SELECT 'error', id, name, 'abstract type Party' FROM customer_e WHERE id % 4 = 3""",
)
def dispatch_by_type(t: Tables):
    last = F.col("id") % 4
    rows = t.role("customer_e").withColumn(
        "kind", F.when(last == 0, "Customer").when(last == 1, "Supplier").when(last == 2, "Robot")
    )
    classes, errors = rd.dispatch_by_type(rows, t.catalog.schema, "Party")
    none = F.lit(None).cast("string")
    out = errors.select(F.lit("error").alias("target"), "id", "name", "error")
    for name in ("Customer", "Supplier"):
        out = out.unionByName(classes[name].select(F.lit(name).alias("target"), "id", "name", none.alias("error")))
    return out


@query("typed_compare_json", "SELECT id, k FROM log_e WHERE operation IN ('create', 'update') AND k > 9")
def typed_compare_json(t: Tables):
    states = t.log.where(F.col("operation").isin("create", "update"))
    hits = rd.typed_compare_json(states, "patch", t.catalog.schema, "User", [is_("k", "gt", 9)])
    return hits.select("id", F.get_json_object("patch", "$.k").cast("bigint").alias("k"))


@query(
    "drs_objects",
    """SELECT CAST(page_id AS VARCHAR) AS id, concat('Page/', CAST(page_id AS VARCHAR)) AS name,
      concat('drs://localhost/', CAST(page_id AS VARCHAR)) AS self_uri,
      CASE WHEN contains(url, '://') THEN split_part(url, '://', 1) ELSE 'https' END AS access_type, url
    FROM (SELECT page_id, CASE WHEN page_id % 5 = 0 THEN replace(url, 'http://', '') ELSE url END AS url FROM pages)
    WHERE page_id % 3 <> 0""",
)
def drs_objects(t: Tables):
    uri = F.when(F.col("page_id") % 5 == 0, F.replace("url", F.lit("http://"), F.lit(""))).otherwise(F.col("url"))
    files = t.raw("pages").select(
        F.col("page_id").alias("id"), (F.col("page_id") % 3 != 0).alias("is_available"), uri.alias("uri")
    )
    objects = rd.drs_objects(files, "Page", t.log)
    return objects.select(
        "id", "name", "self_uri", F.col("access_methods")[0]["type"].alias("access_type"),
        F.col("access_methods")[0]["access_url"]["url"].alias("url"),
    )
