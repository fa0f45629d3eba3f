"""Filters and trees, each case on the live table and on the reconstructed one."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from stratalog.functions.predicates import TreeCompiler, read_filters
from stratalog.model import Catalog, EntityType, QueryError, Schema, Slot
from stratalog.operators import aggregate as ag
from stratalog.operators import read as rd
from stratalog.operators import temporal as tm

SCHEMA = Schema(
    (
        EntityType(
            "Specimen",
            (
                Slot("name", required=True), Slot("age", "integer"), Slot("score", "double"),
                Slot("collected_on", "date"), Slot("is_tumor", "boolean"), Slot("notes"),
            ),
        ),
    )
)

ROWS = [
    ("s1", True, None, "Alpha", 30, 1.5, dt.date(2024, 1, 1), True, "50% of A_b"),
    ("s2", True, None, "beta", 45, 2.5, dt.date(2024, 2, 1), False, None),
    ("s3", True, None, "Gamma", None, 0.5, dt.date(2024, 3, 1), True, "plain"),
    ("s4", False, None, "delta", 50, 9.5, dt.date(2024, 4, 1), True, "gone"),
]


@pytest.fixture(scope="module")
def catalog(spark):
    table = spark.createDataFrame(
        ROWS,
        "id string, is_available boolean, superseded_by string, name string, age bigint, score double, "
        "collected_on date, is_tumor boolean, notes string",
    )
    data = F.to_json(F.struct("name", "age", "score", "collected_on", "is_tumor", "notes"))
    none = F.lit(None).cast("string")
    made = table.select(
        F.concat(F.lit("c"), "id").alias("id"), F.col("id").alias("entity_id"), F.lit("Specimen").alias("entity_type"),
        F.lit("create").alias("operation"), F.lit("ann").alias("actor_id"),
        F.lit("2024-05-01 00:00:00").cast("timestamp_ntz").alias("timestamp"), F.lit("1").alias("schema_version"),
        none.alias("derived_from_id"), none.alias("process_id"), data.alias("patch"), none.alias("context"),
    )
    gone = made.where("entity_id = 's4'").withColumns(
        {
            "id": F.lit("g4"), "operation": F.lit("availability_change"),
            "timestamp": F.lit("2024-05-02 00:00:00").cast("timestamp_ntz"), "patch": F.lit('{"status": "deleted"}'),
        }
    )
    return Catalog(SCHEMA, {"Specimen": table}, log=made.unionByName(gone))


def both(catalog, filters=(), mode="and", where=None):
    live = sorted(r.id for r in rd.find(catalog, "Specimen", filters, mode, where).select("id").collect())
    past = sorted(
        r.id
        for r in tm.query_as_of(catalog.log, SCHEMA, "Specimen", "2024-06-01 00:00:00", filters, mode, where)
        .select("id").collect()
    )
    assert live == past
    return live


def leaf(field, op, value):
    return {"field": field, "op": op, "value": value}


@pytest.mark.parametrize(
    "filters, mode, expected",
    [
        ([{"name": "Alpha"}], "and", ["s1"]),
        ([leaf("name", "eq", None)], "and", []),
        ([leaf("age", "neq", 30)], "and", ["s2"]),
        ([leaf("age", "gt", 30)], "and", ["s2"]),
        ([leaf("age", "gte", "30")], "and", ["s1", "s2"]),
        ([leaf("age", "lt", "old")], "and", []),
        ([leaf("collected_on", "gte", "2024-02-01")], "and", ["s2", "s3"]),
        ([leaf("is_tumor", "eq", True)], "and", ["s1", "s3"]),
        ([leaf("name", "in", [])], "and", []),
        ([leaf("name", "in", ["beta", "Gamma", None])], "and", ["s2", "s3"]),
        ([leaf("name", "contains", "ALPH")], "and", ["s1"]),
        ([leaf("notes", "contains", "50%")], "and", ["s1"]),
        ([leaf("notes", "contains", "a_B")], "and", ["s1"]),
        ([leaf("notes", "contains", "axb")], "and", []),
        ([leaf("notes", "is_null", True)], "and", ["s2"]),
        ([leaf("notes", "is_null", False)], "and", ["s1", "s3"]),
        ([{"name": "beta"}, leaf("age", "is_null", True)], "or", ["s2", "s3"]),
        ([{"name": "beta"}, {"nope": 1}], "or", []),
        ([leaf("id", "in", ["s1", "s4"])], "and", ["s1"]),
        ([leaf("age", "eq", 30.5)], "and", []),
    ],
)
def test_flat_filters(catalog, filters, mode, expected):
    assert both(catalog, filters, mode) == expected


@pytest.mark.parametrize(
    "where, expected",
    [
        ({"not": leaf("age", "eq", 30)}, ["s2", "s3"]),
        ({"not": {"not": leaf("age", "eq", 30)}}, ["s1"]),
        ({"not": {"or": [leaf("age", "gt", 40), leaf("notes", "contains", "plain")]}}, ["s1"]),
        ({"not": {"and": [leaf("age", "gt", 10), leaf("notes", "is_null", False)]}}, ["s2", "s3"]),
        ({"or": [leaf("age", "lt", 40), {"not": leaf("score", "gt", 1)}]}, ["s1", "s3"]),
        ({"not": leaf("name", "in", [])}, ["s1", "s2", "s3"]),
    ],
)
def test_trees_are_two_valued(catalog, where, expected):
    assert both(catalog, where=where) == expected


def test_tree_joins_flat_filters_by_and(catalog):
    filters = [leaf("age", "eq", 30), leaf("age", "eq", 45)]
    assert both(catalog, filters, "or", {"not": leaf("name", "eq", "beta")}) == ["s1"]


@pytest.mark.parametrize(
    "bad",
    [
        {}, {"and": []}, {"and": [leaf("a", "eq", 1)], "or": []}, {"edge": "x"}, {"edge": "", "where": leaf("a", "eq", 1)},
        {"edge": "x", "quantifier": "all", "where": leaf("a", "eq", 1)}, leaf("a", "starts_with", "x"),
        leaf("a", "is_null", 1), leaf("a", "in", "abc"), "text",
    ],
)
def test_malformed_trees_raise(spark, bad):
    with pytest.raises(QueryError):
        TreeCompiler().condition(bad, spark.range(1).withColumnRenamed("id", "a"), "entity")


def test_deep_tree_raises(spark):
    node = leaf("a", "eq", 1)
    for _ in range(32):
        node = {"not": node}
    with pytest.raises(QueryError):
        TreeCompiler().condition(node, spark.range(1).withColumnRenamed("id", "a"), "entity")


def test_wrong_operator_key_raises():
    with pytest.raises(QueryError):
        read_filters([{"field": "a", "operator": "gt", "value": 1}])


def test_unknown_tree_field_raises(catalog):
    with pytest.raises(QueryError):
        rd.find(catalog, "Specimen", where=leaf("nope", "eq", 1))


def test_as_of_refuses_order_and_edges(catalog):
    edge = {"edge": "x", "where": leaf("a", "eq", 1)}
    with pytest.raises(QueryError):
        tm.query_as_of(catalog.log, SCHEMA, "Specimen", "2024-06-01 00:00:00", where={"not": {"and": [leaf("age", "eq", 1), edge]}})
    with pytest.raises(QueryError):
        tm.query_as_of(catalog.log, SCHEMA, "Specimen", "2024-06-01 00:00:00", where=edge)
    with pytest.raises(QueryError):
        tm.query_as_of(catalog.log, SCHEMA, "Specimen", "2024-06-01 00:00:00", order_by="age")


def test_deleted_row_is_back_before_its_deletion(catalog):
    rows = tm.query_as_of(catalog.log, SCHEMA, "Specimen", "2024-05-01 12:00:00").select("id").collect()
    assert sorted(r.id for r in rows) == ["s1", "s2", "s3", "s4"]


def test_order_nulls_last_both_ways(catalog):
    rows = rd.scan_entities(catalog, "Specimen")
    for direction, expected in (("asc", ["s1", "s2", "s3"]), ("desc", ["s2", "s1", "s3"])):
        got = [r.id for r in rd.order_by_slot(rows, "age", direction).collect()]
        assert got == expected
    for bad in ("nope", "created_at"):
        with pytest.raises(QueryError):
            rd.order_by_slot(rows, bad)


def test_paging_edges(catalog):
    rows = rd.order_by_slot(rd.scan_entities(catalog, "Specimen"), "name")
    assert rd.page(rows, 0).count() == 0
    assert rd.page(rows, None, 1).count() == 2
    total = rd.query(catalog, "Specimen", order_by="name", limit=1).collect()
    assert len(total) == 1 and total[0].total_count == 3


def test_aggregates_see_live_rows_only(catalog):
    assert ag.count_matching(catalog, "Specimen").first().n == 3
    assert ag.entity_counts(catalog).first().n == 4
    span = ag.field_range(catalog, "Specimen", "score").first()
    assert (span.lowest, span.highest) == (0.5, 2.5)
    empty = ag.field_range(catalog, "Specimen", "score", filters=[{"name": "zzz"}]).first()
    assert (empty.lowest, empty.highest) == (None, None)
    facets = ag.facet_counts(catalog, "Specimen", "is_tumor").collect()
    assert [(r.value, r.n) for r in facets] == [(True, 2), (False, 1)]
    assert ag.facet_counts(catalog, "Specimen", "notes").count() == 2


def test_default_order_is_created_at(catalog):
    rows = rd.query(catalog, "Specimen", date_from="2024-05-01 00:00:00", date_to="2024-05-01 00:00:00").collect()
    assert [r.id for r in rows] == ["s1", "s2", "s3"]
    assert rd.query(catalog, "Specimen", date_from="2024-05-02 00:00:00").count() == 0


def test_decimals_compare_exactly(spark):
    from pyspark.sql import types as T

    from stratalog.functions.predicates import leaf as make

    kind = T.DecimalType(38, 18)
    df = spark.createDataFrame([("0.1",), ("0.10000000000000001",), ("0.2",)], "t string").select(F.col("t").cast(kind).alias("d"))
    for value, n in (("0.1", 1), ("0.10000000000000001", 1), (0.2, 1), ("x", 0), ("NaN", 0)):
        assert df.where(make(F.col("d"), kind, "eq", value)).count() == n


def test_get_one(catalog):
    assert rd.get_one(catalog, "Specimen", "s1").created_by == "ann"
    with pytest.raises(QueryError):
        rd.get_one(catalog, "Specimen", "s4")
    assert rd.get_one(catalog, "Specimen", "s4", include_unavailable=True).name == "delta"
