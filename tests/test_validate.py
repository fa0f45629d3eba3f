"""Violations, presets and rules."""

import pytest
from pyspark.sql import functions as F

from stratalog.model import Catalog, EntityType, QueryError, Schema, Slot
from stratalog.operators import aggregate as ag
from stratalog.operators import validate as va

SCHEMA = Schema(
    (
        EntityType("Subject", (Slot("name", required=True),)),
        EntityType("Donor", (Slot("age", "integer"),), parent="Subject"),
        EntityType(
            "Datafile",
            (
                Slot("uri", required=True, pattern=r"^\w+://"), Slot("kind", permissible=("fastq", "bam")),
                Slot("reads", "integer", minimum=0, maximum=100), Slot("subject", reference="Subject"),
                Slot("tags", multivalued=True, permissible=("a", "b")), Slot("sha", unique=True),
            ),
        ),
    )
)


@pytest.fixture(scope="module")
def catalog(spark):
    subjects = spark.createDataFrame([("u1", True, "x"), ("u2", False, "y")], "id string, is_available boolean, name string")
    files = spark.createDataFrame(
        [
            ("f1", True, "s3://x", "bam", 5, "u1", ["a"], "1"),
            ("f2", True, "nowhere", "cram", -1, "u9", ["a", "z"], "1"),
            ("f3", True, None, None, 101, "u2", None, None),
            ("f4", False, "s3://y", "bam", 0, None, [], "1"),
        ],
        "id string, is_available boolean, uri string, kind string, reads bigint, subject string, tags array<string>, sha string",
    )
    return Catalog(SCHEMA, {"Subject": subjects, "Datafile": files})


def keys(df):
    return sorted((r.entity_id, r.rule, r.field) for r in df.collect())


def test_schema_findings(catalog):
    assert keys(va.check_schema(catalog.table("Datafile"), SCHEMA, "Datafile")) == [
        ("f2", "enum", "kind"), ("f2", "enum", "tags"), ("f2", "minimum", "reads"), ("f2", "pattern", "uri"),
        ("f3", "maximum", "reads"), ("f3", "required", "uri"),
    ]


def test_text_of_the_wrong_type(spark):
    df = spark.createDataFrame([("a", "12"), ("b", "x"), ("c", None)], "id string, age string")
    assert keys(va.check_schema(df, SCHEMA, "Donor")) == [("a", "required", "name"), ("b", "required", "name"), ("b", "type", "age"), ("c", "required", "name")]


def test_references_may_be_unavailable_but_not_missing(catalog):
    assert keys(va.check_references(catalog, "Datafile")) == [("f2", "reference", "subject")]


def test_polymorphic_reference(spark, catalog):
    registry = spark.createDataFrame([("u1", "Donor"), ("u2", "Datafile")], "id string, entity_type string")
    files = catalog.table("Datafile")
    assert keys(va.check_polymorphic_refs(files, "Datafile", "subject", "Subject", SCHEMA, registry)) == [
        ("f2", "polymorphic_reference", "subject"), ("f3", "polymorphic_reference", "subject")
    ]


def test_unique_counts_live_rows_only(catalog):
    assert keys(va.check_unique_live(catalog, "Datafile")) == [("f1", "unique", "sha")]
    only = Catalog(SCHEMA, {"Datafile": catalog.table("Datafile").where("id <> 'f2'")})
    assert keys(va.check_unique_live(only, "Datafile")) == []


def test_presets(spark, catalog):
    df = spark.createDataFrame(
        [("a", "u1", ["a", "b"], "x", None, ("b", ["q"])), ("b", "zz", ["a"], "y", 1, ("z", ["b"]))],
        "id string, owner string, items array<string>, state string, note int, rel struct<id:string,more:array<string>>",
    )
    registry = va.preset_registry()
    run = lambda name, *args: keys(registry.create(name, *args)(df, "T"))
    assert run("ref_check", [{"field": "owner", "entity_type": "Subject"}], catalog) == [("b", "ref_check", "owner")]
    assert run("count_constraint", [{"field": "items", "max_count": 1}]) == [("a", "count_constraint", "items")]
    assert run("field_required_if", [{"field": "note", "when_field": "state", "when_value": "x"}]) == [("a", "field_required_if", "note")]
    assert run("no_self_ref", [{"field": "rel"}, {"field": "items"}]) == [
        ("a", "no_self_ref", "items"), ("b", "no_self_ref", "rel")
    ]
    stored = spark.createDataFrame([("a", "old"), ("b", None)], "id string, state string")
    assert run("immutable_field", [{"field": "state"}], stored) == [("a", "immutable_field", "state")]
    with pytest.raises(QueryError):
        registry.create("nope")


def test_rules(spark):
    df = spark.createDataFrame([("a", 0, "x"), ("b", None, "y"), ("c", 5, "y")], "id string, age int, kind string")
    rules = [
        va.Rule("age_positive", "age > 0", "{entity_type} {entity_id}: {name}"),
        [va.Rule("only_y", "false", "y", when="kind = 'y'"), [va.Rule("missing_field", "nope > 1", "m", when="id = 'c'")]],
        va.Rule("other_class", "false", "n", entity_types=("Else",)),
        va.Rule("guard_on_missing", "false", "n", when="nope = 1"),
    ]
    got = va.rule_engine(df, "T", rules)
    assert keys(got) == [("a", "age_positive", ""), ("b", "age_positive", ""), ("b", "only_y", ""), ("c", "missing_field", ""), ("c", "only_y", "")]
    assert "T a: age_positive" in {r.message for r in got.collect()}
    assert va.rule_engine(df, "T", rules, operation="delete").count() == 0
    with pytest.raises(QueryError):
        va.rule_engine(df, "T", [va.Rule("broken", "age >", "x")])


def test_fail_fast_takes_the_first_in_order(catalog):
    every = va.check_schema(catalog.table("Datafile"), SCHEMA, "Datafile")
    first = va.fail_fast(every, ["schema:required", "schema:minimum", "schema:pattern", "schema:enum", "schema:maximum"])
    assert keys(first) == [("f2", "minimum", "reads"), ("f3", "required", "uri")]
    assert ag.all_valid(every).first().failures == 6


def test_validate_batch_and_gate(spark, catalog):
    check = va.WriteValidator("no_bam", lambda df: F.col("kind") != "bam", ("Datafile",))
    found = va.validate_batch(catalog.table("Datafile"), catalog, "Datafile", validators=[check])
    assert ("f1", "no_bam", "") in keys(found) and ("f3", "no_bam", "") in keys(found)
    assert va.WriteValidator("x", lambda df: F.lit(False), ("Else",)).run(catalog.table("Datafile"), "Datafile").count() == 0
    gate = va.end_to_end_gate(catalog, ["Datafile"])
    assert ("f1", "unique", "sha") in keys(gate) and not any(k[0] == "f4" for k in keys(gate))
    with pytest.raises(QueryError):
        va.require_valid(gate)
    va.require_valid(gate.limit(0))


def test_append_only(spark):
    old = spark.createDataFrame([("1", "a"), ("2", "b"), ("3", None), ("3", None)], "id string, v string")
    new = spark.createDataFrame([("1", "a"), ("2", "c"), ("3", None), ("4", "d")], "id string, v string")
    got = {(r.entity_id, r.message) for r in va.check_append_only(old, new).collect()}
    assert got == {("2", "record updated"), ("3", "record updated")}
    assert va.check_append_only(old, old.unionByName(new)).count() == 0


def test_rule_file(folder):
    from stratalog.operators.lifecycle import load_rule_file

    path = folder + "/rules.json"
    with open(path, "w") as f:
        f.write('{"validators": [{"name": "r", "entity_types": ["T"], "on": ["create"], "condition": "a > 0", "error": "e"}]}')
    (rule,) = load_rule_file(path)
    assert rule.entity_types == ("T",) and rule.on == ("create",)


def test_ends_of_edges_are_made_unique_before_they_meet_the_ids(spark):
    edges = spark.createDataFrame(
        [(f"e{i}", i, 100, "near") for i in range(5)] + [("gone", 1, 99, "near"), ("none", 2, None, "near"), ("from", 98, 100, "near")],
        "id string, source_id bigint, target_id bigint, relationship_type string",
    )
    ids = spark.createDataFrame([(i,) for i in [0, 1, 2, 3, 4, 100]], "id bigint")
    for batch in (False, True):
        found = va.check_edges(edges, ids, batch=batch)
        assert sorted((r.entity_id, r.field) for r in found.collect()) == [("from", "source_id"), ("gone", "target_id"), ("none", "target_id")]
        plan = found._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("Aggregate [") == 2 * (1 + batch)
