"""What the plans must look like whatever the data size."""

import pytest

import __spark_entry__ as entry
from stratalog.operators import read as rd
from stratalog.plans.tables import Tables

FOLDER = "/root/testdata/sf0.001"
LAZY = [
    "flagship", "where_tree", "semi_some", "anti_none", "nested_edges", "count_relationship", "join_temporal",
    "temporal_summary", "state_at", "query_as_of", "updated_since", "get_by_id", "expand_path", "check_schema",
    "rule_engine", "put", "upsert_by_external_id", "classify_changes", "check_unique_live", "page_with_total",
    "search_trigram", "search_boolean", "union_edge_stores", "check_append_only", "first_in_batch",
]


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", LAZY)
def test_no_cross_joins_and_no_python(spark, name):
    plan = plan_of(entry.queries()[name](spark, FOLDER))
    for word in ("CartesianProduct", "BroadcastNestedLoopJoin", "EvalPython"):
        assert word not in plan


def test_filters_and_columns_reach_the_scan(spark):
    t = Tables(spark, FOLDER)
    rows = rd.find(t.catalog, "Order", [{"field": "total", "op": "gt", "value": 1000}, {"status": "F"}]).select("id")
    plan = plan_of(rows)
    assert "GreaterThan(o_totalprice,1000.0)" in plan and "EqualTo(o_orderstatus,F)" in plan
    assert "o_orderdate" not in plan.split("ReadSchema")[1]


def test_a_tree_without_not_is_pushed_down(spark):
    t = Tables(spark, FOLDER)
    tree = {"or": [{"field": "total", "op": "gt", "value": 9}, {"field": "customer", "op": "eq", "value": 3}]}
    assert "Or(GreaterThan(o_totalprice,9.0),EqualTo(o_custkey,3))" in plan_of(rd.find(t.catalog, "Order", where=tree))


@pytest.mark.parametrize(
    "name",
    ["temporal_summary", "temporal_as_of", "provenance_summary", "latest_state_per_entity", "latest_availability_per_entity", "state_at",
     "query_as_of", "latest_edge_event", "live_edges_at", "newest_mapping", "get_by_external_id", "get_by_id", "join_temporal", "query_list"],
)
def test_latest_per_key_never_sorts_the_log(spark, name):
    assert "SortAggregate" not in plan_of(entry.queries()[name](spark, FOLDER))


def test_the_first_exchange_of_a_state_carries_no_patch(spark):
    from stratalog.operators import temporal as tm

    path = Tables(spark, FOLDER).log
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for build in (tm.latest_state_per_entity, tm.state_at):
            plan = build(path)._jdf.queryExecution().executedPlan().toString()
            aggregate = plan[plan.index("HashAggregate(keys") :]
            first = aggregate[aggregate.index("Exchange hashpartitioning") :]
            partial = first[first.index("HashAggregate(keys") :].split("\n")[0]
            assert "partial_max" in partial and "patch" not in partial
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_flagship_takes_ordered(spark):
    assert "TakeOrderedAndProject" in plan_of(entry.entry(spark))


def test_hot_key_joins_are_split(spark):
    """A reference held by most rows: the join splits the hot side at run time."""
    from pyspark.sql import functions as F

    from stratalog.model import Catalog, EntityType, Schema, Slot
    from stratalog.operators import validate as va

    names = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20000",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20000",
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
    }
    old = {k: spark.conf.get(k) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    try:
        schema = Schema((EntityType("T", ()), EntityType("E", (Slot("t", reference="T"),))))
        big = spark.range(0, 60_000, 1, 8).select(
            "id", F.when(F.col("id") % 3 > 0, F.lit(7)).otherwise(F.col("id")).alias("t"), F.sha2(F.col("id").cast("string"), 256).alias("x")
        )
        cat = Catalog(schema, {"T": spark.range(10_000).withColumn("x", F.lit(1)), "E": big})
        missing = va.check_references(cat, "E")
        assert missing.count() == sum(1 for i in range(0, 60_000, 3) if i >= 10_000)
        rows = missing.select("entity_id", "message")
        rows.collect()
        plan = plan_of(rows)
        assert "AQEShuffleRead skewed" in plan and "skew=true" in plan
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
