"""Provenance-derived fields, as-of states and append-only sinks."""

import pytest
from pyspark.sql import functions as F

from stratalog.model import QueryError
from stratalog.operators import graph
from stratalog.operators import temporal as tm
from stratalog.operators import validate as va
from stratalog.operators import mutate as mu
from stratalog.sources import sinks

LOG = (
    "id string, entity_id string, entity_type string, operation string, actor_id string, timestamp timestamp_ntz, "
    "schema_version string, derived_from_id string, process_id string, patch string, context string"
)


def make(spark, events):
    rows = [
        (f"p{i:02d}", e, kind, op, who, f"2024-01-{day:02d} 00:00:00", f"v{day}", None, None, patch, None)
        for i, (e, kind, op, who, day, patch) in enumerate(events)
    ]
    cols = LOG.replace("timestamp timestamp_ntz", "timestamp string")
    return spark.createDataFrame(rows, cols).withColumn("timestamp", F.col("timestamp").cast("timestamp_ntz"))


@pytest.fixture(scope="module")
def log(spark):
    edge = '{"relationship_id": "r1", "source_id": "a", "target_id": "b", "relationship_type": "near"}'
    return make(
        spark,
        [
            ("a", "T", "create", "ann", 1, '{"k": 1}'),
            ("b", "T", "create", "bob", 1, '{"k": 9}'),
            ("a", "T", "update", "bob", 3, '{"k": 2}'),
            ("a", "relationship", "relationship_add", "cyd", 4, edge),
            ("a", "T", "availability_change", "dan", 5, '{"status": "deleted"}'),
            ("a", "T", "update", "eve", 6, '{"k": 3}'),
            ("a", "relationship", "relationship_remove", "cyd", 7, edge),
            ("a", "T", "availability_change", "dan", 8, '{"is_available": true}'),
            ("a", "T", "supersede", "dan", 9, '{"superseded_by": "b"}'),
            ("b", "T", "availability_change", "dan", 9, '{"is_available": false}'),
            ("x", "T", "update", "eve", 2, '{"k": 5}'),
        ],
    )


def states(log, day, **kw):
    rows = tm.state_at(log, f"2024-01-{day:02d} 00:00:00", **kw).collect()
    return {r.entity_id: r.state for r in rows}


def test_timeline(log):
    assert states(log, 2) == {"a": '{"k": 1}', "b": '{"k": 9}', "x": '{"k": 5}'}
    assert states(log, 4)["a"] == '{"k": 2}'
    # an update after a deletion does not bring the entity back
    assert "a" not in states(log, 6)
    assert states(log, 8)["a"] == '{"k": 3}'
    assert states(log, 9) == {"a": '{"k": 3}', "x": '{"k": 5}'}
    assert states(log, 9, require_create=True) == {"a": '{"k": 3}'}


def test_summary_skips_deletions_and_counts_edge_events(log):
    rows = {r.entity_id: r for r in tm.temporal_summary(log).collect()}
    assert str(rows["a"].created_at)[:10] == "2024-01-01" and rows["a"].created_by == "ann"
    assert str(rows["a"].updated_at)[:10] == "2024-01-09" and rows["a"].updated_by == "dan"
    assert str(rows["b"].updated_at)[:10] == "2024-01-01"
    assert rows["x"].created_at is None
    bounded = {r.entity_id: r for r in tm.temporal_as_of(log, "2024-01-05 00:00:00").collect()}
    assert bounded["a"].updated_by == "cyd" and bounded["a"].schema_version == "v4"


def test_provenance_summary_keeps_deletion_versions(log):
    rows = {(r.entity_id, r.entity_type): r for r in tm.provenance_summary(log).collect()}
    assert rows[("b", "T")].schema_version == "v9"
    assert str(rows[("b", "T")].updated_at)[:10] == "2024-01-01"
    assert str(rows[("a", "relationship")].created_at)[:10] == "2024-01-04"


def test_versions(log):
    assert {r.entity_id: r.version for r in tm.entity_version(log).collect()} == {"a": 3, "b": 1, "x": 1}
    assert {r.entity_id: r.version for r in tm.version_as_of(log, "2024-01-03 00:00:00").collect()} == {"a": 2, "b": 1, "x": 1}


def test_edges_at(log):
    assert tm.live_edges_at(log, "2024-01-03 00:00:00").count() == 0
    assert [r.id for r in tm.live_edges_at(log, "2024-01-06 00:00:00").collect()] == ["r1"]
    assert tm.live_edges_at(log, "2024-01-07 00:00:00").count() == 0
    walk = graph.traverse_as_of(log, "a", "2024-01-05 00:00:00").collect()
    assert [(r.source_id, r.target_id, r.depth) for r in walk] == [("a", "b", 1)]


def test_neighbors_as_of_drop_absent_nodes(log):
    early = graph.neighbors_as_of(log, "a", "2024-01-04 00:00:00")
    assert sorted(r.id for r in early.nodes.collect()) == ["a", "b"] and early.edges.count() == 1
    later = graph.neighbors_as_of(log, "a", "2024-01-05 00:00:00")
    assert [r.id for r in later.nodes.collect()] == ["b"] and later.edges.count() == 0
    assert later.notices


def test_updated_since_is_exclusive(spark, log):
    entities = spark.createDataFrame([("a",), ("b",), ("x",)], "id string")
    ids = lambda since, **kw: [r.id for r in tm.updated_since(entities, log, since, **kw).collect()]
    assert ids("2024-01-01T00:00:00Z") == ["x", "a"]
    assert ids("2024-01-01T01:00:00+01:00") == ["x", "a"]
    assert ids("2023-12-31T23:59:59") == ["b", "x", "a"]
    assert ids("2024-01-09") == []
    assert ids("2023-12-31", limit=1, offset=1) == ["x"]
    full = tm.updated_since(entities, log, "2024-01-01", limit=2, hydrate=True).collect()
    assert [(r.id, r.created_by, r.updated_by) for r in full] == [("x", None, "eve"), ("a", "ann", "dan")]
    with pytest.raises(QueryError):
        tm.updated_since(entities, log, "yesterday")


def test_ties_go_to_the_higher_id(spark):
    log = make(spark, [("a", "T", "create", "one", 1, '{"k": 1}'), ("a", "T", "update", "two", 1, '{"k": 2}')])
    assert states(log, 1) == {"a": '{"k": 2}'}
    assert tm.temporal_summary(log).first().updated_by == "two"


def test_provenance_check(spark, log):
    entities = spark.createDataFrame([("a", True), ("x", True), ("z", True), ("gone", False)], "id string, is_available boolean")
    got = {r.entity_id: r.message for r in va.check_provenance(entities, "T", log).collect()}
    assert got == {"x": "no create record", "z": "no provenance records"}


def test_append_refuses_unknown_operations(spark, log, folder):
    sinks.append_provenance(log, folder + "/log")
    sinks.append_provenance(log.limit(2), folder + "/log")
    stored = spark.read.parquet(folder + "/log")
    assert stored.count() == 13
    plan = tm.state_at(stored, "2024-01-03 00:00:00")._jdf.queryExecution().executedPlan().toString()
    assert "event_date" in plan.split("PartitionFilters")[1].split("PushedFilters")[0]
    assert sorted(r.entity_id for r in tm.state_at(stored, "2024-01-04 00:00:00").collect()) == ["a", "b", "x"]
    with pytest.raises(QueryError):
        sinks.append_provenance(log.withColumn("operation", F.lit("rewrite")), folder + "/log")


def test_stamps_fill_gaps(spark, log):
    bare = log.withColumn("actor_id", F.lit(None).cast("string"))
    assert {r.actor_id for r in mu.stamp_events(bare).collect()} == {"unknown"}
