"""The given parquet tables bound to the entity / edge / log roles.

Each role exists twice, as a DataFrame and as the SQL of the same view, so a
query and its SQL counterpart start from the same rows.
"""

from __future__ import annotations

import re
from collections.abc import Mapping
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import Catalog, EntityType, Schema, Slot

# Columns of the given tables.
COLUMNS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "embeddings": "vec_id bigint, embedding array<float>, label int",
    "pages": "page_id bigint, url string, html string",
    "benchmark": "item_id bigint, text string",
    "labels": "doc_id bigint, quality int, toxic int",
    "conversations": "conv_id bigint, turn bigint, role string, text string",
}

SCHEMA = Schema(
    (
        EntityType("Region", (Slot("name", required=True, unique=True),)),
        EntityType("Nation", (Slot("name", required=True), Slot("region", "integer", reference="Region"))),
        EntityType("Party", (Slot("name", required=True), Slot("balance", "double")), abstract=True, designator="kind"),
        EntityType(
            "Customer",
            (
                Slot("nation", "integer", reference="Nation"),
                Slot("segment", permissible=("AUTOMOBILE", "BUILDING", "FURNITURE", "MACHINERY")),
            ),
            parent="Party",
        ),
        EntityType("Supplier", (Slot("nation", "integer", reference="Nation"),), parent="Party"),
        EntityType(
            "Part",
            (
                Slot("name", required=True, searchable=True),
                Slot("brand", pattern=r"^Brand#[0-9]$", searchable=True),
                Slot("type"),
                Slot("size", "integer", minimum=5, maximum=45),
                Slot("price", "double"),
            ),
        ),
        EntityType(
            "Order",
            (
                Slot("customer", "integer", reference="Customer"),
                Slot("status", permissible=("F", "O", "P")),
                Slot("total", "double"),
                Slot("ordered_at", "datetime"),
                Slot("priority", required=True),
                Slot("parts", "integer", reference="Part", multivalued=True),
            ),
        ),
        EntityType("Document", (Slot("text", searchable=True), Slot("lang"), Slot("source"))),
        EntityType("User", (Slot("k", "integer"), Slot("status"))),
    )
)

# Columns every entity role starts with.
LIVE = {"is_available": "TRUE", "superseded_by": "CAST(NULL AS BIGINT)"}

# Role -> (source, filter, column -> expression). The expressions are read by
# Spark and DuckDB alike; only the JSON text of the log is Spark's own.
ROLES: dict[str, tuple[str, str | None, dict[str, str]]] = {
    "region_e": ("region", None, {"id": "CAST(r_regionkey AS BIGINT)", **LIVE, "name": "r_name"}),
    "nation_e": (
        "nation", None,
        {"id": "CAST(n_nationkey AS BIGINT)", **LIVE, "name": "n_name", "region": "CAST(n_regionkey AS BIGINT)"},
    ),
    "customer_e": (
        "customer", None,
        {
            "id": "c_custkey", **LIVE, "is_available": "c_acctbal > 0", "name": "c_name", "balance": "c_acctbal",
            "nation": "CAST(c_nationkey AS BIGINT)", "segment": "c_mktsegment",
        },
    ),
    "supplier_e": (
        "supplier", None,
        {"id": "s_suppkey", **LIVE, "name": "s_name", "balance": "s_acctbal", "nation": "CAST(s_nationkey AS BIGINT)"},
    ),
    "part_e": (
        "part", None,
        {
            "id": "p_partkey", **LIVE, "is_available": "p_size <> 13", "name": "p_name", "brand": "p_brand",
            "type": "p_type", "size": "CAST(p_size AS BIGINT)", "price": "p_retailprice",
        },
    ),
    "order_e": (
        "orders", None,
        {
            "id": "o_orderkey", "is_available": "o_orderstatus <> 'P'",
            "superseded_by": "CASE WHEN o_orderstatus = 'P' THEN o_orderkey + 1 END",
            "customer": "o_custkey", "status": "o_orderstatus", "total": "o_totalprice", "ordered_at": "o_orderdate",
            "priority": "nullif(o_orderpriority, '4-NOT SPECIFIED')",
        },
    ),
    "document_e": (
        "documents", None,
        {"id": "doc_id", **LIVE, "is_available": "source <> 'src0'", "text": "text", "lang": "lang", "source": "source"},
    ),
    # Orders hold parts: one edge per line item.
    "edge_e": (
        "lineitem", None,
        {
            "id": "concat_ws('-', CAST(l_orderkey AS VARCHAR(20)), CAST(l_partkey AS VARCHAR(20)), "
            "CAST(l_suppkey AS VARCHAR(20)), CAST(l_linenumber AS VARCHAR(20)))",
            "source_id": "l_orderkey", "target_id": "l_partkey", "relationship_type": "'parts'",
            "metadata": "CAST(NULL AS VARCHAR(20))", "created_at": "l_shipdate", "created_by": "'loader'",
            "is_available": "l_returnflag <> 'R'",
        },
    ),
    # Users point at users: one edge per view event.
    "link_e": (
        "event_k", "event_type = 'view'",
        {
            "id": "event_id", "source_id": "user_id", "target_id": "k",
            "relationship_type": "CASE WHEN k % 3 = 0 THEN 'follows' ELSE 'views' END",
            "metadata": "CAST(NULL AS VARCHAR(20))", "created_at": "ts", "created_by": "'app'",
            "is_available": "event_id % 4 <> 0",
        },
    ),
    "log_e": (
        "event_k", None,
        {
            "id": "event_id", "entity_id": "user_id",
            "entity_type": "CASE WHEN event_type IN ('view', 'click') THEN 'relationship' ELSE 'User' END",
            "operation": "CASE event_type WHEN 'signup' THEN 'create' WHEN 'purchase' THEN 'update' "
            "WHEN 'error' THEN 'availability_change' WHEN 'view' THEN 'relationship_add' ELSE 'relationship_remove' END",
            "actor_id": "concat('actor', CAST(event_id % 7 AS VARCHAR(20)))", "timestamp": "ts",
            "schema_version": "concat('v', CAST(1 + event_id % 3 AS VARCHAR(20)))",
            "derived_from_id": "CAST(NULL AS VARCHAR(20))", "process_id": "CAST(NULL AS VARCHAR(20))",
            "k": "k", "deletion": "event_type = 'error' AND k % 2 = 1",
        },
    ),
    # Several customers share a value; one mapping in five is inactive.
    "ext_e": (
        "customer", None,
        {
            "id": "concat('m', CAST(c_custkey AS VARCHAR(20)))", "value": "concat('X', CAST(c_custkey % 500 AS VARCHAR(20)))",
            "source_system": "CASE WHEN c_custkey % 2 = 0 THEN 'crm' ELSE 'erp' END",
            "entity": "c_custkey", "is_active": "c_custkey % 5 <> 0",
        },
    ),
    "write_e": (
        "orders", None,
        {
            "loader_name": "concat('loader', CAST(o_custkey % 3 AS VARCHAR(20)))",
            "version": "concat('v', CAST(1 + o_orderkey % 2 AS VARCHAR(20)))",
            "entity_id": "CAST(o_orderkey AS VARCHAR(20))",
            "entity_type": "CASE WHEN o_orderkey % 10 = 0 THEN 'Part' ELSE 'Order' END", "written_at": "o_orderdate",
        },
    ),
}


def view_sql(name: str) -> str:
    source, where, columns = ROLES[name]
    picked = ", ".join(f"{expr} AS {alias}" for alias, expr in columns.items())
    return f"SELECT {picked} FROM {source}" + (f" WHERE {where}" if where else "")


DUCK_EVENT_K = "SELECT *, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events"

# Views that another view reads.
NEEDS = {"link_e": ["event_k"], "log_e": ["event_k"]}


def with_views(sql: str) -> str:
    """Put the views a SQL text names in front of it."""
    sql = sql.strip()
    names: list[str] = []
    for name in ROLES:
        if re.search(rf"\b{name}\b", sql):
            names += [n for n in NEEDS.get(name, []) if n not in names] + [name]
    if re.search(r"\bevent_k\b", sql) and "event_k" not in names:
        names.insert(0, "event_k")
    if not names:
        return sql
    text = lambda n: DUCK_EVENT_K if n == "event_k" else view_sql(n)
    ctes = ",\n".join(f"{n} AS ({text(n)})" for n in names)
    recursive = re.match(r"(?is)with\s+(recursive\s+)?", sql)
    if recursive:
        word = "WITH RECURSIVE " if recursive.group(1) else "WITH "
        return f"{word}{ctes},\n{sql[recursive.end():]}"
    return f"WITH {ctes}\n{sql}"


class Roles(Mapping):
    """Entity classes by name; a class's DataFrame is built when it is asked for."""

    def __init__(self, tables: "Tables", names: tuple[str, ...]):
        self._tables, self._names = tables, names

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._names:
            raise KeyError(name)
        return self._tables.role(f"{name.lower()}_e")

    def __contains__(self, name) -> bool:
        return name in self._names

    def __iter__(self):
        return iter(self._names)

    def __len__(self) -> int:
        return len(self._names)


class RoleCatalog(Catalog):
    """A catalog over the roles that builds each DataFrame on first use."""

    def __init__(self, tables: "Tables", names: tuple[str, ...]):
        self._tables, self.schema, self.tables = tables, SCHEMA, Roles(tables, names)

    global_ids = False  # the given tables number each class by itself
    edges = property(lambda self: self._tables.role("edge_e"))
    log = property(lambda self: self._tables.order_log)
    external_ids = property(lambda self: self._tables.role("ext_e"))
    write_log = property(lambda self: self._tables.role("write_e"))


class Tables:
    """Given tables and roles of one folder, loaded on first use."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder.rstrip("/")
        self._cache: dict[str, DataFrame] = {}

    def raw(self, name: str) -> DataFrame:
        if name not in self._cache:
            self._cache[name] = self.spark.read.schema(COLUMNS[name]).parquet(f"{self.folder}/{name}.parquet")
        return self._cache[name]

    @cached_property
    def event_k(self) -> DataFrame:
        return self.raw("events").withColumn("k", F.get_json_object("props", "$.k").cast("bigint"))

    def role(self, name: str) -> DataFrame:
        """A role of :data:`ROLES` as a DataFrame."""
        if name not in self._cache:
            source, where, columns = ROLES[name]
            frame = self.event_k if source == "event_k" else self.raw(source)
            if where:
                frame = frame.where(where)
            self._cache[name] = frame.selectExpr(*[f"{expr} AS {alias}" for alias, expr in columns.items()])
        return self._cache[name]

    @cached_property
    def log(self) -> DataFrame:
        """The provenance log; ``patch`` is JSON text of the event's content."""
        rows = self.role("log_e")
        state = F.to_json(
            F.struct(F.col("k"), F.concat(F.lit("s"), (F.col("k") % 5).cast("string")).alias("status"))
        )
        flag = F.to_json(F.struct((F.col("k") % 2 == 0).alias("is_available")))
        edge = F.to_json(
            F.struct(
                F.col("id").cast("string").alias("relationship_id"),
                F.col("entity_id").cast("string").alias("source_id"),
                F.col("k").cast("string").alias("target_id"),
                F.when(F.col("k") % 3 == 0, "follows").otherwise("views").alias("relationship_type"),
            )
        )
        patch = (
            F.when(F.col("operation").isin("create", "update"), state)
            .when(F.col("operation") == "availability_change", flag)
            .otherwise(edge)
        )
        return rows.select(
            "id", "entity_id", "entity_type", "operation", "actor_id", "timestamp", "schema_version",
            "derived_from_id", "process_id", patch.alias("patch"), F.lit(None).cast("string").alias("context"),
        )

    @cached_property
    def order_log(self) -> DataFrame:
        """A log of the orders: created on their date, updated at their ship dates."""
        created = self.raw("orders").select(
            (F.col("o_orderkey") * 100).alias("id"),
            F.col("o_orderkey").alias("entity_id"),
            F.lit("Order").alias("entity_type"),
            F.lit("create").alias("operation"),
            F.col("o_orderdate").alias("timestamp"),
        )
        updated = self.raw("lineitem").select(
            (F.col("l_orderkey") * 100 + F.col("l_linenumber")).cast("bigint").alias("id"),
            F.col("l_orderkey").alias("entity_id"),
            F.lit("Order").alias("entity_type"),
            F.lit("update").alias("operation"),
            F.col("l_shipdate").alias("timestamp"),
        )
        none = F.lit(None).cast("string")
        return created.unionByName(updated).select(
            "*", F.lit("loader").alias("actor_id"), F.lit("v1").alias("schema_version"),
            none.alias("derived_from_id"), none.alias("process_id"), none.alias("patch"), none.alias("context"),
        )

    @cached_property
    def mapping_log(self) -> DataFrame:
        """Create events of the external-id mappings and supersede events of inactive ones."""
        base = self.raw("customer").select("c_custkey")
        inactive = self.role("ext_e").where("NOT is_active").select(F.col("entity").alias("c_custkey"))
        key = F.col("c_custkey")
        when = F.make_dt_interval(mins=key.cast("int")) + F.lit("2024-01-01").cast("timestamp_ntz")
        mapping = F.concat(F.lit("m"), key.cast("string"))
        none = F.lit(None).cast("string")

        def rows(df, op, entity, derived, stamp):
            return df.select(
                F.concat(F.lit(op), mapping).alias("id"), entity.alias("entity_id"),
                F.lit("ExternalID").alias("entity_type"), F.lit(op).alias("operation"),
                F.lit("loader").alias("actor_id"), stamp.alias("timestamp"), F.lit("v1").alias("schema_version"),
                derived.alias("derived_from_id"), none.alias("process_id"), none.alias("patch"), none.alias("context"),
            )

        made = rows(base, "create", mapping, none, when)
        gone = rows(
            inactive, "supersede", key.cast("string"), mapping, when + F.make_dt_interval(days=F.lit(30))
        )
        return made.unionByName(gone)

    @cached_property
    def catalog(self) -> Catalog:
        return RoleCatalog(self, ("Region", "Nation", "Customer", "Supplier", "Part", "Order"))

    @cached_property
    def documents(self) -> Catalog:
        return Catalog(SCHEMA, {"Document": self.role("document_e")})

    @cached_property
    def global_catalog(self) -> Catalog:
        """Ids unique over classes (``Order/5``), for graph operators."""
        tables = {}
        for name, df in self.catalog.tables.items():
            cols = {"id": F.concat(F.lit(f"{name}/"), F.col("id").cast("string"))}
            for slot in SCHEMA.references(name):
                cols[slot.name] = F.concat(F.lit(f"{slot.reference}/"), F.col(slot.name).cast("string"))
            tables[name] = df.withColumns(cols)
        edges = self.catalog.edges.withColumns(
            {
                "source_id": F.concat(F.lit("Order/"), F.col("source_id").cast("string")),
                "target_id": F.concat(F.lit("Part/"), F.col("target_id").cast("string")),
            }
        )
        return Catalog(SCHEMA, tables, edges=edges, log=None)


ORDER_LOG_SQL = """(SELECT o_orderkey * 100 AS id, o_orderkey AS entity_id,
  'create' AS operation, o_orderdate AS timestamp FROM orders
  UNION ALL SELECT l_orderkey * 100 + l_linenumber, l_orderkey, 'update', l_shipdate FROM lineitem)"""


def told_id() -> Column:
    """The number under which the SQL lists a new part: its model's key + 1000000, which may be
    the key of another part once there are more than a million."""
    return F.when(F.col("id") < 0, 999_999 - F.col("id")).otherwise(F.col("id"))
