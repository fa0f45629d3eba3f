"""Readers and sinks on real files."""

import hashlib
import json
import os

import pytest
from pyspark.sql import functions as F

from stratalog.model import EntityType, QueryError, Schema, Slot
from stratalog.operators import read as rd
from stratalog.sources import readers as src
from stratalog.sources import sinks


def put(folder, name, text):
    path = os.path.join(folder, name)
    with open(path, "w", encoding="utf-8") as f:
        f.write(text)
    return path


def test_csv_values_stay_text(spark, folder):
    path = put(folder, "a.csv", 'id,name\n001,"Smith, J"\n2\n3,x,y\n\n4,\n')
    good, bad = src.read_csv_records(spark, path)
    assert [tuple(r) for r in good.collect()] == [("001", "Smith, J"), ("4", None)]
    assert sorted(r.record for r in bad.collect()) == ["2", "3,x,y"]
    assert bad.count() == 2
    empty = put(folder, "b.csv", "")
    assert src.read_csv_records(spark, empty, ["id"])[0].count() == 0
    only_head = put(folder, "c.csv", "id,name\n")
    assert src.read_csv_records(spark, only_head)[0].count() == 0


def test_jsonl_line_numbers(spark, folder):
    path = put(folder, "a.jsonl", '{"id": 1}\n\n{bad\n[1]\n"text"\n{"x": 2}\n')
    good, bad = src.read_jsonl(spark, path, id_field="id", line_numbers=True)
    assert [(r.position, json.loads(r.json)["id"]) for r in good.collect()] == [(1, 1)]
    assert sorted((r.position, r.error) for r in bad.collect()) == [
        (3, "invalid JSON"), (4, "not an object"), (5, "not an object"), (6, "missing id")
    ]


def test_line_numbers_over_many_splits(spark, folder):
    spark.range(0, 500, 1, 7).select(F.col("id").cast("string").alias("value")).write.text(folder + "/lines")
    lines = spark.read.text(folder + "/lines").withColumnRenamed("value", "line")
    got = sorted(r.position for r in src.number_lines(lines).collect())
    assert got == list(range(1, 501))


def test_json_array(spark, folder):
    path = put(folder, "a.json", '[{"id": 1, "tags": ["x"]}, 3, {"id": 2}]')
    good, bad = src.read_json_array(spark, path)
    assert [json.loads(r.json)["id"] for r in good.orderBy("position").collect()] == [1, 2]
    assert [(r.position, r.error) for r in bad.collect()] == [(1, "not an object")]
    for text in ('{"id": 1}', "[1, 2", "7"):
        with pytest.raises(QueryError):
            src.read_json_array(spark, put(folder, "bad.json", text))


def test_json_path(spark):
    docs = spark.createDataFrame(
        [(1, '{"a": {"b": [{"k": 1}, {"k": 2}]}}'), (2, '{"a": {"b": {"k": 3}}}'), (3, '{"a": 1}')], "id int, doc string"
    )
    got = src.extract_json_path(docs, "doc", "$.a.b").orderBy("id", "position").collect()
    assert [(r.id, json.loads(r.record)["k"]) for r in got] == [(1, 1), (1, 2), (2, 3)]


@pytest.mark.parametrize(
    "bad", ["DELETE FROM t", "select 1; drop table t", "INSERT INTO t VALUES (1)", "update t set a = 1", "select 'truncate'"]
)
def test_write_statements_are_refused(bad):
    with pytest.raises(QueryError):
        src.check_read_only(bad)


def test_jdbc_source(spark):
    url = "jdbc:derby:memory:readers;create=true"
    options = {"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}
    rows = spark.range(20).select(F.col("id").cast("int").alias("K"), F.concat(F.lit("n"), "id").alias("NAME"))
    rows.write.format("jdbc").options(url=url, dbtable="THINGS", **options).mode("overwrite").save()
    got = src.read_sql_query(spark, "SELECT K, NAME FROM THINGS WHERE K >= 15", url, options=options)
    assert sorted(r.K for r in got.collect()) == list(range(15, 20))
    split = src.read_sql_query(spark, "SELECT K, NAME FROM THINGS", url, options=options, partition=("K", 0, 20, 4))
    assert split.rdd.getNumPartitions() == 4 and split.count() == 20


def test_since_is_parsed_not_pasted(spark):
    assert src.bind_since("select :since", "2024-01-01T00:00:00Z") == "select TIMESTAMP '2024-01-01 00:00:00'"
    with pytest.raises(QueryError):
        src.bind_since("select :since", "x' OR 1=1")


def test_stanzas(spark, folder):
    text = (
        "format-version: 1.2\n\n[Term]\nid: D:1\nname: heart\ndef: \"A pump.\" [x]\n\n[Term]\nid: D:2\nname: old\n"
        "is_obsolete: true\n\n[Term]\nid: D:3\nname: lung\n\n[Typedef]\nid: part_of\nname: part of\n"
    )
    got = src.read_stanzas(spark, put(folder, "a.obo", text)).orderBy("id").collect()
    assert [(r.id, r.name, r["def"]) for r in got] == [("D:1", "heart", "A pump."), ("D:3", "lung", "")]


def test_digests(spark, folder):
    path = put(folder, "a.bin", "hello")
    files = spark.read.format("binaryFile").load(path)
    name = files.first().path
    good = spark.createDataFrame([(name, hashlib.sha256(b"hello").hexdigest().upper())], "path string, sha256 string")
    src.require_digests(files, good)
    missing = spark.createDataFrame([(name, "0"), ("other", "1")], "path string, sha256 string")
    assert {r.path: r.matches for r in src.verify_file_digest(files, missing).collect()} == {name: False, "other": False}
    with pytest.raises(QueryError):
        src.require_digests(files, missing)


def test_digests_of_one_path_fetched_twice(spark):
    files = spark.createDataFrame([(1, "u", b"hello"), (2, "u", b"bye")], "page_id int, path string, content binary")
    manifest = spark.createDataFrame([(1, "u", hashlib.sha256(b"hello").hexdigest()), (2, "u", "stale")], "page_id int, path string, sha256 string")
    got = src.verify_file_digest(files, manifest, ("page_id", "path")).collect()
    assert sorted((r.page_id, r.matches) for r in got) == [(1, True), (2, False)]


SCHEMA = Schema(
    (
        EntityType("Publication", (Slot("title"), Slot("year", "integer"), Slot("kind")), designator="kind"),
        EntityType("Article", (Slot("journal"),), parent="Publication"),
        EntityType("Preprint", (Slot("server"),), parent="Publication"),
    )
)


def test_dispatch(spark):
    rows = spark.createDataFrame(
        [
            ("1", "Article", "t", "J", None), ("2", "Preprint", "t", None, "S"), ("3", None, "t", None, None),
            ("4", "Book", "t", None, None), ("5", None, "t", "J", None),
        ],
        "id string, kind string, title string, journal string, server string",
    )
    classes, errors = rd.dispatch_by_type(rows, SCHEMA, "Publication")
    assert {n: [r.id for r in d.collect()] for n, d in classes.items()} == {"Publication": ["3"], "Article": ["1"], "Preprint": ["2"]}
    assert "server" not in classes["Article"].columns
    assert {r.id: r.error for r in errors.collect()} == {"4": "unknown type Book", "5": "Publication row fills slots of a subclass"}


def test_bundle(spark, folder):
    put(folder, "one.json", json.dumps({"publications": [{"id": "1", "kind": "Article", "title": "a"}], "notes": [{"id": "n"}]}, indent=1))
    put(folder, "two.json", json.dumps({"publications": [{"id": "2", "kind": "Blog", "title": "b"}]}))
    schema = Schema((*SCHEMA.types, EntityType("Note", ())))
    kinds = {
        "publications": spark.createDataFrame([], "id string, kind string, title string, journal string").schema,
        "notes": spark.createDataFrame([], "id string").schema,
    }
    tables, errors = src.read_bundle(spark, folder, schema, {"publications": "Publication", "notes": "Note"}, kinds)
    assert [r.id for r in tables["Article"].collect()] == ["1"] and tables["Note"].count() == 1
    assert [tuple(r) for r in errors.collect()] == [("Publication", "2", "unknown type Blog")]


def test_nesting_round_trip(spark):
    df = spark.createDataFrame([(1, ("x", (2,)), [1, 2])], "id int, a struct<b:string,c:struct<d:int>>, l array<int>")
    flat = rd.flatten_nested(df)
    assert flat.columns == ["id", "a.b", "a.c.d", "l"]
    assert rd.expand_dotted(flat).first() == df.first()
    with pytest.raises(QueryError):
        rd.expand_dotted(spark.createDataFrame([(1, 2)], "a int, `a.b` int"))


def test_mapping(spark):
    df = spark.createDataFrame([("1", "M"), ("2", "?"), ("3", None)], "k string, sex string")
    got = src.map_fields(df, {"k": "id"}, {"sex": {"M": "male"}}).collect()
    assert [tuple(r) for r in got] == [("1", "male"), ("2", "?"), ("3", None)]


def test_write_log_rows_are_new_and_distinct(spark):
    old = spark.createDataFrame([("l", "v1", "a", "T"), ("l", "v2", "b", "T")], "loader_name string, version string, entity_id string, entity_type string")
    ids = spark.createDataFrame([("a",), ("b",), ("b",)], "id string")
    rows = sinks.write_log_rows(old, ids, "l", "v1", "T", "2024-01-01 00:00:00").collect()
    assert [r.entity_id for r in rows] == ["b"]


def test_replayed_batch_replaces_itself(spark, folder):
    df = spark.range(3)
    for _ in range(2):
        sinks.write_batch_once(df, folder + "/out", 4)
    assert spark.read.parquet(folder + "/out").count() == 3


def test_csv_with_line_breaks_and_a_header_in_each_file(spark, folder):
    os.makedirs(f"{folder}/csv")
    for name, body in (("a", 'id,note\n1,"one\ntwo"\nid,note\n'), ("b", "id,note\n2,x\n3,y,z\n4\n")):
        with open(f"{folder}/csv/{name}.csv", "w") as f:
            f.write(body)
    good, bad = src.read_csv_records(spark, f"{folder}/csv")
    assert sorted(tuple(r) for r in good.collect()) == [("1", "one\ntwo"), ("2", "x"), ("id", "note")]
    assert sorted(r.record for r in bad.collect()) == ["3,y,z", "4"] and good.count() == 3 and bad.count() == 2


def test_json_strings_that_look_like_arrays(spark):
    df = spark.createDataFrame([(1, '{"a": "[x"}'), (2, '{"a": ["p", "q"]}'), (3, '{"a": "[1]"}'), (4, '{"b": 1}')], "id int, doc string")
    got = sorted((r.id, r.position, r.record) for r in src.extract_json_path(df, "doc", "$.a").collect())
    assert got == [(1, 0, "[x"), (2, 0, "p"), (2, 1, "q"), (3, 0, "[1]")]
