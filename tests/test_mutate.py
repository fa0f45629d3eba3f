"""Writes, lifecycle jobs, the folder store and streams."""

import pytest
from pyspark.sql import functions as F

from stratalog.model import Catalog, EntityType, QueryError, Schema, Slot
from stratalog.operators import external as ext
from stratalog.operators import lifecycle as lc
from stratalog.operators import mutate as mu
from stratalog.operators import read as rd
from stratalog.operators import temporal as tm
from stratalog.operators import validate as va
from stratalog.sources import store
from stratalog.streaming import jobs

SCHEMA = Schema(
    (
        EntityType("Sample", (Slot("name", required=True), Slot("tissue"), Slot("parts", reference="Sample", multivalued=True))),
        EntityType("Aliquot", (Slot("label", required=True),)),
    )
)
TABLE = "id string, is_available boolean, superseded_by string, name string, tissue string"
EDGE = "id string, source_id string, target_id string, relationship_type string, metadata string, created_at timestamp_ntz, created_by string, is_available boolean"
STAMP = mu.Stamp("2024-05-01 00:00:00", "ann", schema_version="1")


@pytest.fixture(scope="module")
def catalog(spark):
    table = spark.createDataFrame(
        [("a", True, None, "A", "x"), ("b", True, None, "B", None), ("c", False, "b", "C", "y")], TABLE
    )
    edges = spark.createDataFrame(
        [("e1", "a", "b", "parts", None, None, None, True), ("e2", "a", "c", "parts", None, None, None, True), ("e3", "a", "b", "other", None, None, None, True)],
        EDGE,
    )
    ext_ids = spark.createDataFrame(
        [("m1", "X", "s", "a", True), ("m2", "X", "t", "c", True), ("m3", "Y", "s", "b", False)],
        "id string, value string, source_system string, entity string, is_active boolean",
    )
    aliquot = spark.createDataFrame([], "id string, is_available boolean, superseded_by string, label string")
    log = spark.createDataFrame([], "entity_id string, entity_type string, operation string, timestamp timestamp_ntz, id string, derived_from_id string")
    return Catalog(SCHEMA, {"Sample": table, "Aliquot": aliquot}, edges, log, ext_ids)


def frame(spark, rows, columns):
    return spark.createDataFrame(rows, columns)


def test_put_creates_and_updates(spark, catalog):
    batch = frame(spark, [("a", "A2"), ("n", "N")], "id string, name string")
    out = mu.put(catalog, "Sample", batch, STAMP)
    rows = {r.id: r for r in out.entities.collect()}
    assert rows["a"].name == "A2" and rows["a"].tissue is None and rows["n"].is_available and len(rows) == 4
    events = {r.entity_id: r for r in out.log.collect() if r.operation in ("create", "update")}
    assert (events["a"].operation, events["n"].operation) == ("update", "create")
    assert events["a"].patch == '{"name":"A2"}' and events["a"].actor_id == "ann"
    again = {r.entity_id: r.id for r in mu.put(catalog, "Sample", batch, STAMP).log.collect() if r.operation in ("create", "update")}
    assert again == {k: v.id for k, v in events.items()}


def test_put_stores_lists_and_keeps_system_columns(spark, catalog):
    batch = frame(spark, [("a", "A", ["c", "b"]), ("c", "C", None)], "id string, name string, parts array<string>")
    out = mu.put(catalog, "Sample", batch, STAMP)
    live = {(r.source_id, r.target_id) for r in out.edges.where("is_available and relationship_type = 'parts'").collect()}
    assert live == {("a", "b"), ("a", "c")}
    rows = {r.id: r for r in out.entities.collect()}
    assert (rows["c"].superseded_by, rows["c"].is_available, rows["a"].superseded_by) == ("b", False, None)
    post = [r.patch for r in out.log.collect() if r.operation == "update" and r.entity_id == "a"]
    assert post == ['{"name":"A","parts":["c","b"]}']


def test_repeated_ids_and_ids_of_another_class_are_refused(spark, catalog):
    with pytest.raises(QueryError, match="more than once"):
        mu.put(catalog, "Sample", frame(spark, [("n", "1"), ("n", "2")], "id string, name string"), STAMP)
    with pytest.raises(QueryError, match="is a Sample"):
        mu.put(catalog, "Aliquot", frame(spark, [("a", "x")], "id string, label string"), STAMP)
    catalog_of_classes = Catalog(SCHEMA, catalog.tables, catalog.edges, catalog.log, global_ids=False)
    assert mu.put(catalog_of_classes, "Aliquot", frame(spark, [("a", "x")], "id string, label string"), STAMP).entities.count() == 1


def test_migration_within_a_class(spark, catalog):
    hop = lambda df: df.where("id = 'a'").select(F.lit("a2").alias("id"), F.lit("new").alias("name"), F.col("id").alias("predecessor"))
    out = lc.migrate_rows(catalog, "Sample", "Sample", hop, STAMP)["Sample"]
    rows = {r.id: (r.is_available, r.superseded_by) for r in out.entities.collect()}
    assert rows == {"a": (False, "a2"), "b": (True, None), "c": (False, "b"), "a2": (True, None)}
    assert sorted(r.operation for r in out.log.where("entity_id = 'a'").collect()) == ["availability_change", "supersede"]


def test_pruning_some_classes_leaves_the_log_of_others(spark, catalog):
    cols = "loader_name string, version string, entity_id string, entity_type string, written_at timestamp_ntz"
    log = frame(spark, [("l", "v1", "a", "Sample", None), ("l", "v1", "q", "Aliquot", None)], cols)
    tables, left = lc.prune_version(Catalog(SCHEMA, catalog.tables, write_log=log), "l", "v1", ["Sample"])
    assert list(tables) == ["Sample"] and [r.entity_id for r in left.collect()] == ["q"]


def test_update_keeps_unavailability_and_needs_the_row(spark, catalog):
    out = mu.update(catalog, "Sample", frame(spark, [("c", "C2")], "id string, name string"), STAMP)
    row = [r for r in out.entities.collect() if r.id == "c"][0]
    assert row.name == "C2" and not row.is_available
    with pytest.raises(QueryError):
        mu.update(catalog, "Sample", frame(spark, [("zz", "?")], "id string, name string"), STAMP)


def test_replace_clears_omitted_edges(spark, catalog):
    out = mu.replace(catalog, "Sample", frame(spark, [("a", "A")], "id string, name string"), STAMP)
    assert {r.id: r.is_available for r in out.edges.collect()} == {"e1": False, "e2": False, "e3": True}
    assert sorted(r.operation for r in out.log.collect()) == ["relationship_remove", "relationship_remove", "update"]


def test_reconcile_lists(spark, catalog):
    batch = frame(spark, [("a", ["b", None, "a"])], "id string, parts array<string>")
    out = mu.reconcile_multi_refs(catalog, "Sample", batch, STAMP)
    live = sorted(r.target_id for r in out.edges.where("is_available and relationship_type = 'parts'").collect())
    assert live == ["a", "b"]
    scalar = mu.reconcile_multi_refs(catalog, "Sample", frame(spark, [("a", "c")], "id string, parts string"), STAMP)
    assert [r.target_id for r in scalar.edges.where("is_available and relationship_type = 'parts'").collect()] == ["c"]
    untouched = mu.reconcile_multi_refs(catalog, "Sample", frame(spark, [("a", 1)], "id string, other int"), STAMP)
    assert untouched.edges.where("is_available").count() == 3


def test_reconcile_leaves_edges_of_no_type_and_matches_each_edge_once(spark, catalog):
    more = frame(spark, [("e4", "a", "b", None, None, None, None, True), ("e5", "b", "a", "parts", None, None, None, False), ("e6", "b", "c", "parts", None, None, None, True)], EDGE)
    both = Catalog(SCHEMA, catalog.tables, catalog.edges.unionByName(more), catalog.log, catalog.external_ids)
    out = mu.reconcile_multi_refs(both, "Sample", frame(spark, [("a", ["c"])], "id string, parts array<string>"), STAMP)
    kept = {r.id: r.is_available for r in out.edges.where("created_by IS NULL").collect()}
    assert kept == {"e1": False, "e2": False, "e3": True, "e4": True, "e5": False, "e6": True}
    assert out.edges.count() == len(kept) + 1


def test_soft_delete_reports(spark, catalog):
    out = mu.soft_delete(catalog, "Sample", frame(spark, [("a",), ("c",), ("zz",)], "id string"), STAMP)
    assert {r.id: r.deleted for r in out.report.collect()} == {"a": True, "c": False, "zz": False}
    (event,) = out.log.collect()
    assert tm.is_deletion is not None and '"status":"deleted"' in event.patch and '"name":"A"' in event.patch


def test_deleted_then_restored_state(spark, catalog):
    first = mu.put(catalog, "Sample", frame(spark, [("n", "N")], "id string, name string"), STAMP)
    step = catalog.with_table("Sample", first.entities)
    gone = mu.soft_delete(step, "Sample", frame(spark, [("n",)], "id string"), mu.Stamp("2024-05-02 00:00:00"))
    step = step.with_table("Sample", gone.entities)
    back = mu.set_availability_bulk(step, "Sample", frame(spark, [("n",)], "id string"), True, mu.Stamp("2024-05-03 00:00:00"))
    log = first.log.unionByName(gone.log).unionByName(back.log)
    seen = [
        {r.id for r in tm.query_as_of(log, SCHEMA, "Sample", f"2024-05-0{d} 12:00:00").collect()} for d in (1, 2, 3)
    ]
    assert seen == [{"n"}, set(), {"n"}]


def test_supersede(spark, catalog):
    out = mu.supersede_entities(catalog, "Sample", frame(spark, [("a", "b")], "id string, replacement string"), STAMP)
    row = [r for r in out.entities.collect() if r.id == "a"][0]
    assert not row.is_available and row.superseded_by == "b"
    for bad in (("c", "b"), ("zz", "b"), ("a", "zz")):
        with pytest.raises(QueryError):
            mu.supersede_entities(catalog, "Sample", frame(spark, [bad], "id string, replacement string"), STAMP)


def test_relate_and_unrelate(spark, catalog):
    live = catalog.live("Sample")
    edge = "source_id string, target_id string, relationship_type string"
    out = mu.relate(catalog.edges, frame(spark, [("a", "b", "near")], edge), live, STAMP)
    assert out.edges.count() == 4 and out.log.first().operation == "relationship_add"
    for bad in (("a", "a", "near"), ("a", "c", "near"), ("a", "b", " ")):
        with pytest.raises(QueryError):
            mu.relate(catalog.edges, frame(spark, [bad], edge), live, STAMP)
    gone = mu.unrelate(out.edges, frame(spark, [("a", "b", "near")], edge), STAMP)
    assert gone.edges.where("is_available").count() == 3
    with pytest.raises(QueryError):
        mu.unrelate(gone.edges, frame(spark, [("a", "b", "near")], edge), STAMP)


def test_external_ids(spark, catalog):
    rows = frame(spark, [("b", "Z", "s")], "entity string, value string, source_system string")
    out = mu.register_external_ids(catalog, "Sample", rows, STAMP)
    assert sorted(r.operation for r in out.log.collect()) == ["create", "external_id_add"]
    with pytest.raises(QueryError):
        mu.register_external_ids(catalog, "Sample", rows.withColumn("entity", F.lit("zz")), STAMP)
    swap = frame(spark, [("a", "X", "X2", "s")], "entity string, old_value string, new_value string, source_system string")
    moved = mu.supersede_external_ids(catalog.external_ids, "Sample", swap, STAMP)
    got = {(r.value, r.entity, r.is_active) for r in moved.external_ids.collect()}
    assert got == {("X", "a", False), ("X2", "a", True), ("X", "c", True), ("Y", "b", False)}
    history = ext.superseded_external_ids(moved.external_ids, moved.log).collect()
    assert [(r.id, r.external_id) for r in history] == [("m1", "X")]
    with pytest.raises(QueryError):
        mu.supersede_external_ids(moved.external_ids, "Sample", swap, STAMP)


def test_external_lookup_prefers_readable_parents(spark, catalog):
    asked = frame(spark, [("X",), ("Y",)], "value string")
    table = catalog.table("Sample")
    live = ext.get_by_external_id(catalog.external_ids, catalog.log, table, asked).collect()
    assert [(r.value, r.entity) for r in live] == [("X", "a")]
    both = ext.get_by_external_id(catalog.external_ids, catalog.log, table, asked, include_archived=True).collect()
    assert [(r.value, r.entity) for r in both] == [("X", "c")]


def test_batch_put_is_all_or_nothing(spark, catalog):
    good = frame(spark, [(None, "N"), (None, "N"), ("a", "A")], "id string, name string")
    plan = mu.batch_put(catalog, {"Sample": good}, STAMP, dry_run=True)
    assert {r.operation: r.n for r in plan.collect()} == {"create": 2, "update": 1}
    sets = mu.batch_put(catalog, {"Sample": good}, STAMP)
    made = [r.id for r in sets["Sample"].entities.collect()]
    assert len(set(made)) == 5 and {r.entity_id for r in sets["Sample"].log.collect()} <= set(made)
    with pytest.raises(QueryError):
        mu.batch_put(catalog, {"Sample": frame(spark, [("q", None)], "id string, name string")}, STAMP)
    edge = frame(spark, [("a", "zz", "near")], "source_id string, target_id string, relationship_type string")
    with pytest.raises(QueryError):
        mu.batch_put(catalog, {"Sample": good}, STAMP, new_edge_rows=edge)


def test_hot_external_id(spark, catalog):
    rows = [("K", i, f"n{i}") for i in range(300)] + [(None, 1000 + i, "x") for i in range(100)] + [("X", 5000, "A")]
    batch = frame(spark, rows, "key string, line bigint, name string").repartition(5)
    maps = catalog.external_ids.where("is_active and entity = 'a'").select("value", "entity")
    out = mu.upsert_by_external_id(batch, "key", "line", catalog.live("Sample"), maps, ["name"])
    counts = {r.outcome: r["count"] for r in out.groupBy("outcome").count().collect()}
    assert counts == {"created": 1, "unchanged": 1, "error": 399}
    assert out.where("outcome = 'created'").first().line == 0


def test_loader_writes(spark, catalog):
    feed = frame(spark, [("X", 1, "A9"), ("W", 2, "W"), (None, 3, "V")], "key string, line bigint, name string")
    maps = catalog.external_ids.where("is_active and entity = 'a'").select("value", "entity")
    out = mu.run_loader(lambda since: feed, catalog, "Sample", STAMP, "key", "line", maps)
    assert {r.name for r in out.entities.collect()} == {"A9", "B", "C", "W", "V"}
    assert [r.value for r in out.new_mappings.collect()] == ["W"]
    nameless = mu.run_loader(lambda since: feed.withColumn("name", F.lit(None).cast("string")), catalog, "Sample", STAMP, "key", "line", maps)
    assert {(r.outcome, r.error) for r in nameless.report.collect()} == {("error", "name is required")}
    assert nameless.log.count() == 0 and nameless.entities.count() == 3


def test_a_bad_row_stops_itself_only(spark, catalog):
    rows = [("X", 1, "A9"), ("W", 2, None), ("W", 3, "late"), (None, 4, None), (None, 5, "V"), ("V2", 6, "q")]
    feed = frame(spark, rows, "key string, line bigint, name string")
    maps = catalog.external_ids.where("is_active and entity = 'a'").select("value", "entity")
    short = lambda df: va.explode_findings(df, "Sample", [F.when(F.length("name") < 2, va.finding("python", "short", "name", "too short"))])
    out = mu.run_loader(lambda since: feed, catalog, "Sample", STAMP, "key", "line", maps, checks=[short])
    got = {r.line: (r.outcome, r.error) for r in out.report.collect()}
    assert got == {
        1: ("updated", None), 2: ("error", "name is required"), 3: ("created", None), 4: ("error", "name is required"),
        5: ("error", "too short"), 6: ("error", "too short"),
    }
    assert {r.name for r in out.entities.collect()} == {"A9", "B", "C", "late"}
    again = mu.run_loader(lambda since: feed, catalog, "Sample", STAMP, "key", "line", maps, checks=[short])
    ids = lambda o: sorted(r.id for r in o.entities.collect())
    assert ids(out) == ids(again)  # a rerun makes the same ids


def test_loader_cuts_all_it_writes_from_outcomes_written_once(spark, catalog):
    feed = frame(spark, [("N", 1, "new"), ("N", 2, "again"), (None, 3, "bare")], "key string, line bigint, name string").coalesce(1)
    maps = catalog.external_ids.where("is_active").select("value", "entity")
    plain = Catalog(SCHEMA, catalog.tables, external_ids=catalog.external_ids)
    out = mu.run_loader(lambda since: feed, plain, "Sample", STAMP, "key", "line", maps)
    joins = lambda df: df._jdf.queryExecution().optimizedPlan().toString().count("Join ")
    assert (joins(out.report), joins(out.log), joins(out.new_mappings), joins(out.entities)) == (0, 0, 0, 1)
    assert {r.line: r.outcome for r in out.report.collect()} == {1: "created", 2: "error", 3: "created"}


def test_lists_through_the_loader(spark, catalog, folder):
    rows = [("X", 1, "A", ["b", "c"]), ("N", 2, "N", ["a", None, "a"]), ("M", 3, "M", None)]
    feed = frame(spark, rows, "key string, line bigint, name string, parts array<string>")
    maps = catalog.external_ids.where("is_active and entity = 'a'").select("value", "entity")
    live = lambda c: sorted((r.source_id, r.target_id) for r in c.edges.where("is_available and relationship_type = 'parts'").collect())
    store.commit(folder, {"Sample": mu.WriteSet(entities=catalog.table("Sample"), edges=catalog.edges, external_ids=catalog.external_ids)})
    current = store.load_catalog(spark, folder, SCHEMA)
    store.commit(folder, {"Sample": mu.run_loader(lambda since: feed, current, "Sample", STAMP, "key", "line", maps)})
    after = store.load_catalog(spark, folder, SCHEMA)
    new = after.external_ids.where("value = 'N'").first().entity
    assert live(after) == sorted([("a", "b"), ("a", "c"), (new, "a")])
    assert after.external_ids.count() == catalog.external_ids.count() + 2
    maps = maps.unionByName(after.external_ids.where("value in ('N', 'M')").select("value", "entity"))
    second = mu.run_loader(lambda since: feed, after, "Sample", STAMP, "key", "line", maps)
    assert {r.outcome for r in second.report.collect()} == {"unchanged"} and second.log.count() == 0
    bare = mu.run_loader(lambda since: feed.drop("parts"), after, "Sample", STAMP, "key", "line", maps)
    assert {r.line: r.outcome for r in bare.report.collect()} == {1: "updated", 2: "updated", 3: "unchanged"}
    store.commit(folder, {"Sample": bare})
    assert live(store.load_catalog(spark, folder, SCHEMA)) == []


def test_additions_keep_what_is_there(spark, catalog, folder, monkeypatch):
    monkeypatch.setattr(store, "MOST_PARTS", 3)
    store.commit(folder, {"Sample": mu.WriteSet(entities=catalog.table("Sample"), edges=catalog.edges, external_ids=catalog.external_ids)})
    for n in range(4):
        current = store.load_catalog(spark, folder, SCHEMA)
        rows = frame(spark, [("a", f"Z{n}", "s")], "entity string, value string, source_system string")
        stamp = mu.Stamp(f"2024-06-0{n + 1} 00:00:00", "ann")
        edge = frame(spark, [("a", "b", f"near{n}")], "source_id string, target_id string, relationship_type string")
        store.commit(folder, {"ids": mu.register_external_ids(current, "Sample", rows, stamp), "links": mu.WriteSet(new_edges=mu.new_edges(edge, stamp))})
        now = store.load_catalog(spark, folder, SCHEMA)
        assert now.external_ids.count() == catalog.external_ids.count() + n + 1 and now.edges.count() == catalog.edges.count() + n + 1
    pairs = frame(spark, [("a", "b")], "id string, replacement string")
    store.commit(folder, {"Sample": mu.supersede_entities(now, "Sample", pairs, mu.Stamp("2024-07-01 00:00:00"))})
    assert store.load_catalog(spark, folder, SCHEMA).edges.count() == catalog.edges.count() + 5


def test_migration_gate_runs_first(spark, catalog):
    bad = lambda df: df.select(F.concat("id", F.lit("2")).alias("id"), F.lit(None).cast("string").alias("label"), F.col("id").alias("predecessor"))
    with pytest.raises(QueryError):
        lc.migrate_rows(catalog, "Sample", "Aliquot", bad, STAMP)
    merge = lambda df: df.select(F.lit("m").alias("id"), F.lit("all").alias("label"), F.col("id").alias("predecessor"))
    out = lc.migrate_rows(catalog, "Sample", "Aliquot", merge, STAMP)
    assert [tuple(r) for r in out["Aliquot"].entities.select("id", "label").collect()] == [("m", "all")]
    old = {r.id: (r.is_available, r.superseded_by) for r in out["Sample"].entities.collect()}
    assert old == {"a": (False, "m"), "b": (False, "m"), "c": (False, "b")}
    assert out["Sample"].new_edges.count() == 2


def test_reference_loads_once(spark, catalog):
    cols = "loader_name string, version string, entity_id string, entity_type string, written_at timestamp_ntz"
    done = Catalog(SCHEMA, catalog.tables, write_log=frame(spark, [("l", "v1", "a", "Sample", None)], cols))
    release = frame(spark, [("r", "R"), ("a", "A7")], "id string, name string")
    out, rows = lc.load_reference(done, "Sample", release, "l", "v1", STAMP)
    assert out.log.count() == 0 and rows.count() == 0 and out.entities.count() == 3
    out, rows = lc.load_reference(done, "Sample", release, "l", "v2", STAMP)
    assert out.log.count() == 2 and sorted(r.entity_id for r in rows.collect()) == ["a", "r"]
    step = Catalog(SCHEMA, {"Sample": out.entities}, write_log=done.write_log.unionByName(rows))
    # a row rewritten by v2 still goes with v1
    tables, log = lc.prune_version(step, "l", "v1")
    assert sorted(r.id for r in tables["Sample"].collect()) == ["b", "c", "r"] and log.count() == 2
    tables, log = lc.prune_loader(step, "l")
    assert sorted(r.id for r in tables["Sample"].collect()) == ["b", "c"] and log.count() == 0


def test_release_diff(spark):
    base = frame(spark, [("1", "a"), ("2", "b"), ("3", "c")], "id string, v string")
    got = mu.apply_release_diff(
        base, "id", frame(spark, [("4", "d"), ("2", "added")], "id string, v string"),
        frame(spark, [("2", "changed"), ("3", "c2")], "id string, v string"), frame(spark, [("1", "a")], "id string, v string"),
    )
    assert [tuple(r) for r in got.collect()] == [("2", "added"), ("3", "c2"), ("4", "d")]


def test_evolution_warns(spark):
    schema = Schema((EntityType("T", (Slot("a"), Slot("n", "integer", required=True), Slot("d", "date"))),))
    df = frame(spark, [("1", "x")], "id string, a string")
    table, added, warnings = lc.evolve_columns(df, schema, "T")
    assert added == ["n", "d"] and len(warnings) == 1 and dict(table.dtypes)["d"] == "date"
    assert lc.evolve_columns(df.limit(0), schema, "T")[2] == []


def test_retire_needs_force(spark, catalog):
    with pytest.raises(QueryError):
        lc.retire_classes(catalog, ["Sample", "Aliquot"], STAMP)
    assert lc.retire_classes(catalog, ["Aliquot"], STAMP)["Aliquot"].log.count() == 0
    assert lc.retire_classes(catalog, ["Sample"], STAMP, force=True)["Sample"].log.count() == 2


def test_store_round_trip(spark, catalog, folder):
    start = {"Sample": mu.WriteSet(entities=catalog.table("Sample"), edges=catalog.edges)}
    store.commit(folder, start)
    for day, name in ((1, "first"), (2, "second")):
        current = store.load_catalog(spark, folder, SCHEMA)
        batch = frame(spark, [("n", name)], "id string, name string")
        store.commit(folder, {"Sample": mu.put(current, "Sample", batch, mu.Stamp(f"2024-06-0{day} 00:00:00", "ann"))})
    final = store.load_catalog(spark, folder, SCHEMA)
    row = rd.get_one(final, "Sample", "n")
    assert row.name == "second" and str(row.updated_at)[:10] == "2024-06-02"
    assert store.versions(spark, folder + "/entities/Sample") == [1, 2, 3] and final.external_ids is None
    past = tm.query_as_of(final.log, SCHEMA, "Sample", "2024-06-01 12:00:00").collect()
    assert [(r.id, r.name, r.version) for r in past] == [("n", "first", 1)]


def test_a_commit_that_stops_changes_nothing(spark, catalog, folder, monkeypatch):
    store.commit(folder, {"Sample": mu.WriteSet(entities=catalog.table("Sample"), edges=catalog.edges)})
    current = store.load_catalog(spark, folder, SCHEMA)
    out = mu.put(current, "Sample", frame(spark, [("n", "N")], "id string, name string"), STAMP)
    with monkeypatch.context() as broken:
        broken.setattr(store, "append_provenance", lambda *a, **k: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            store.commit(folder, {"Sample": out})
    after = store.load_catalog(spark, folder, SCHEMA)
    assert after.log is None and sorted(r.id for r in after.table("Sample").collect()) == ["a", "b", "c"]
    assert store.commit(folder, {"Sample": out}) == 2
    done = store.load_catalog(spark, folder, SCHEMA)
    assert done.table("Sample").count() == 4 and done.log.count() == 1


def log_rows(spark, days):
    return spark.createDataFrame(
        [(f"p{d}{e}", e, "T", "create" if d == 1 else "update", "ann", f"2024-01-0{d} 00:00:00", "v1", None, None, "{}", None) for d, e in days],
        "id string, entity_id string, entity_type string, operation string, actor_id string, timestamp string, "
        "schema_version string, derived_from_id string, process_id string, patch string, context string",
    ).withColumn("timestamp", F.col("timestamp").cast("timestamp_ntz"))


def test_stream_upsert_carries_ids_and_replays_nothing(spark, catalog, folder):
    rows = "key string, line bigint, name string"
    root, path, out = (f"{folder}/{x}" for x in ("store", "in", "out"))
    store.commit(root, {"Sample": mu.WriteSet(entities=catalog.table("Sample"), edges=catalog.edges, external_ids=catalog.external_ids)})
    stamp = lambda n: mu.Stamp(f"2024-08-0{n + 1} 00:00:00", "stream")

    def drive(state):
        records = jobs.read_log_stream(spark, path, frame(spark, [], rows).schema)
        jobs.stream_upsert(records, root, SCHEMA, "Sample", stamp, "key", "line", out, f"{folder}/{state}").awaitTermination()

    for batch in ([("N", 1, "new"), ("M", 2, None)], [("N", 3, "newer"), ("M", 4, "m")], [("N", 5, "newer"), ("M", 6, "m2")]):
        frame(spark, batch, rows).coalesce(1).write.mode("append").parquet(path)
        drive("state")
    after = store.load_catalog(spark, root, SCHEMA)
    assert {r.line: r.outcome for r in spark.read.parquet(out).collect()} == {1: "created", 2: "error", 3: "updated", 4: "created", 5: "unchanged", 6: "updated"}
    assert sorted(r.name for r in after.table("Sample").collect()) == ["A", "B", "C", "m2", "newer"]
    assert after.external_ids.where("value in ('N', 'M')").count() == 2 and store.stream_mark(spark, root, "upsert") == 2
    count = len(store.versions(spark, f"{root}/manifest"))
    drive("lost")  # a checkpoint that was lost gives the records again as batch 0
    assert len(store.versions(spark, f"{root}/manifest")) == count and store.load_catalog(spark, root, SCHEMA).log.count() == after.log.count()


def test_stream_summary_takes_late_events(spark, folder):
    path = f"{folder}/log"
    log_rows(spark, [(2, "a"), (3, "a")]).coalesce(1).write.parquet(path)
    schema = spark.read.parquet(path).schema
    events = lambda: jobs.stream_temporal_summary(jobs.read_log_stream(spark, path, schema))
    jobs.run_to_table(events(), f"{folder}/out", f"{folder}/state")
    log_rows(spark, [(1, "a")]).coalesce(1).write.mode("append").parquet(path)
    jobs.run_to_table(events(), f"{folder}/out", f"{folder}/state")
    (row,) = jobs.latest_of(spark.read.parquet(f"{folder}/out"), ["entity_id"]).collect()
    assert str(row.created_at)[:10] == "2024-01-01" and str(row.updated_at)[:10] == "2024-01-03"


def test_type_conflict(spark):
    registry = frame(spark, [("a", "T"), ("a", "U"), ("b", "T"), ("b", "T")], "id string, entity_type string")
    assert [r.id for r in va.check_type_conflict(registry).collect()] == ["a"]


def test_stream_summary_of_whole_number_ids(spark, folder):
    """One time, two events: the larger id is the newer one, whichever batch brings it."""
    path = f"{folder}/log"
    rows = log_rows(spark, [(2, "a"), (2, "a")]).withColumns({"actor_id": F.lit("amy"), "schema_version": F.lit("v1")})
    newer, older = (rows.limit(1).withColumns({"id": F.lit(n).cast("long"), "actor_id": F.lit(who)}) for n, who in ((10, "bob"), (9, "amy")))
    newer.coalesce(1).write.parquet(path)
    older.coalesce(1).write.mode("append").parquet(path)
    events = jobs.read_log_stream(spark, path, newer.schema, files_per_batch=1)
    jobs.run_to_table(jobs.stream_temporal_summary(events), f"{folder}/out", f"{folder}/state")
    row = jobs.latest_of(spark.read.parquet(f"{folder}/out"), ["entity_id"]).first()
    assert (row.updated_by, row.schema_version) == ("bob", "v1")
