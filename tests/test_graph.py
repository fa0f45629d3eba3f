"""Edge predicates, walks, neighbourhoods, chains and hydration by brute force."""

import random

import pytest
from pyspark.sql import functions as F

from stratalog.model import Catalog, EntityType, QueryError, Schema, Slot
from stratalog.operators import graph, links
from stratalog.operators import aggregate as ag
from stratalog.operators.ranking import position_in_group

SCHEMA = Schema(
    (
        EntityType("Sample", (Slot("name"), Slot("tissue"), Slot("volume", "integer"), Slot("parent", reference="Sample"))),
        EntityType("Study", (Slot("title"), Slot("status"), Slot("samples", reference="Sample", multivalued=True))),
    )
)
EDGE = "id string, source_id string, target_id string, relationship_type string, metadata string, created_at timestamp_ntz, created_by string, is_available boolean"


@pytest.fixture(scope="module")
def catalog(spark):
    sample = spark.createDataFrame(
        [
            ("a", True, None, "A", "cortex", 10, None), ("b", True, None, "B", "liver", 20, "a"),
            ("c", False, None, "C", "cortex", 30, "b"), ("d", True, None, "D", None, 40, "c"),
        ],
        "id string, is_available boolean, superseded_by string, name string, tissue string, volume bigint, parent string",
    )
    study = spark.createDataFrame(
        [("s1", True, None, "one", "open"), ("s2", True, None, "two", "open"), ("s3", True, None, "three", "done"), ("s4", True, None, "four", "done")],
        "id string, is_available boolean, superseded_by string, title string, status string",
    )
    rows = [
        ("e1", "s1", "a", True, 1), ("e2", "s1", "b", True, 2), ("e3", "s2", "b", True, 3),
        ("e4", "s4", "c", True, 4), ("e5", "s2", "a", False, 5),
    ]
    edges = spark.createDataFrame(
        [(i, s, t, "samples", None, None, "x", ok) for i, s, t, ok, _ in rows], EDGE
    ).withColumn("created_at", F.lit("2024-01-01").cast("timestamp_ntz"))
    return Catalog(SCHEMA, {"Sample": sample, "Study": study}, edges=edges)


def leaf(field, op, value):
    return {"field": field, "op": op, "value": value}


def ids(df):
    return sorted(r.id for r in df.select("id").collect())


def test_quantified_predicates(catalog):
    cortex = leaf("tissue", "eq", "cortex")
    assert ids(links.semi_some(catalog, "Study", "samples", cortex)) == ["s1"]
    # an unavailable target does not count; a study without edges satisfies none
    assert ids(links.anti_none(catalog, "Study", "samples", cortex)) == ["s2", "s3", "s4"]
    assert ids(links.semi_to_one(catalog, "Sample", "parent", leaf("volume", "lt", 15))) == ["b"]
    # the parent of d is unavailable
    assert ids(links.semi_to_one(catalog, "Sample", "parent", leaf("volume", "gt", 0))) == ["b"]


def test_nested_self_reference_under_or_and_not(catalog):
    tree = {
        "or": [
            {"edge": "samples", "quantifier": "some", "where": {"edge": "parent", "where": leaf("name", "eq", "A")}},
            {"not": {"edge": "samples", "quantifier": "some", "where": leaf("volume", "gt", 0)}},
        ]
    }
    assert ids(links.where_tree(catalog, "Study", tree)) == ["s1", "s2", "s3", "s4"]
    both = {"and": [{"not": tree["or"][1]}, {"not": tree["or"][0]}]}
    assert ids(links.where_tree(catalog, "Study", both)) == []


@pytest.mark.parametrize(
    "node",
    [
        {"edge": "title", "where": {"field": "name", "value": 1}},
        {"edge": "samples", "where": {"field": "name", "value": "A"}},
        {"edge": "nope", "where": {"field": "name", "value": "A"}},
    ],
)
def test_edge_misuse_raises(catalog, node):
    with pytest.raises(QueryError):
        links.where_tree(catalog, "Study", node)


def test_quantifier_on_single_reference_raises(catalog):
    with pytest.raises(QueryError):
        links.semi_some(catalog, "Sample", "parent", leaf("name", "eq", "A"))


def test_counts_and_lists_disagree_on_dead_targets(catalog):
    counts = {r.id: r.n for r in ag.count_relationship(catalog, "Study", "samples").collect()}
    assert counts == {"s1": 2, "s2": 1, "s3": 0, "s4": 0}
    rows = links.hydrate_multi_refs(catalog, "Study").collect()
    assert sorted((r.id, r.ordinal, r.target_id) for r in rows if r.id != "s3") == [("s1", 0, "a"), ("s1", 1, "b"), ("s2", 0, "b"), ("s4", 0, "c")]
    assert [(r.ordinal, r.target_id) for r in rows if r.id == "s3"] == [(None, None)]
    expanded = {(r.id, r.samples_ordinal): r.samples_expanded for r in links.expand_path(catalog, "Study", "samples.parent").collect()}
    assert [expanded["s1", i].id for i in (0, 1)] == ["a", "b"]
    assert expanded["s1", 1].parent_expanded.id == "a" and expanded["s1", 0].parent_expanded is None
    assert expanded["s4", None] is None and expanded["s3", None] is None


def test_hot_group_is_numbered_over_many_tasks(spark):
    rows = [("hot", i) for i in range(1000)] + [("cold", i) for i in range(7)] + [("edge", i) for i in range(50)]
    random.Random(3).shuffle(rows)
    df = spark.createDataFrame(rows, "k string, n int").repartition(6)
    placed = position_in_group(df, ["k"], ["n"]).collect()
    assert len(placed) == len(rows) and all(r.ordinal == r.n for r in placed)


def brute_walks(edges, start, kind, depth):
    out, layer = [], [e for e in edges if e[1] == start and (kind is None or e[3] == kind)]
    d = 1
    while layer and d <= depth:
        out += [(*e, d) for e in layer]
        layer = [n for e in layer for n in edges if n[1] == e[2]]
        d += 1
    return sorted(out)


@pytest.mark.parametrize("seed", [1, 2])
def test_walks_match_enumeration(spark, seed):
    rng = random.Random(seed)
    edges = [(f"e{i}", f"n{rng.randrange(5)}", f"n{rng.randrange(5)}", rng.choice("xy")) for i in range(12)]
    df = spark.createDataFrame(edges, "id string, source_id string, target_id string, relationship_type string")
    counted = graph.traverse(df, "n1", "x", 4)
    want = brute_walks(edges, "n1", "x", 4)
    assert sorted(tuple(r) for r in graph.walk_rows(counted).collect()) == want
    assert {tuple(r) for r in counted.collect()} == {(*w, want.count(w)) for w in want}
    with pytest.raises(QueryError):
        graph.traverse(df, "n1", "x", 0)
    assert graph.traverse(df, "absent", None, 3).count() == 0


def brute_neighbors(edges, live, start, depth):
    seen, frontier, opened = {start}, {start}, set()
    for _ in range(depth):
        opened |= frontier
        near = {t for s, t, _ in edges if s in frontier} | {s for s, t, _ in edges if t in frontier}
        frontier = near - seen
        seen |= frontier
    nodes = seen & live
    return nodes, {e for e in edges if (e[0] in opened or e[1] in opened) and e[0] in nodes and e[1] in nodes}


@pytest.mark.parametrize("seed, depth", [(1, 1), (2, 2), (3, 3), (4, 9)])
def test_neighbors_match_search(spark, folder, monkeypatch, seed, depth):
    rng = random.Random(seed)
    names = [f"n{i:02d}" for i in range(20)]
    parents = {n: rng.choice(names) if rng.random() < 0.5 else None for n in names}
    live = {n for n in names if n == "n00" or rng.random() < 0.8}
    links_ = {(rng.choice(names), rng.choice(names), rng.choice("xy")) for _ in range(15)}
    schema = Schema((EntityType("Node", (Slot("parent", reference="Node"),)),))
    table = spark.createDataFrame(
        [(n, n in live, None, parents[n]) for n in names], "id string, is_available boolean, superseded_by string, parent string"
    )
    edges = spark.createDataFrame(
        [(f"{i}", s, t, k, None, None, None, True) for i, (s, t, k) in enumerate(links_)], EDGE
    )
    found = graph.neighbors(Catalog(schema, {"Node": table}, edges=edges), "n00", depth)
    all_edges = links_ | {(n, p, "parent") for n, p in parents.items() if p and n in live}
    nodes, kept = brute_neighbors(all_edges, live, "n00", depth)
    graph.write_adjacency(Catalog(schema, {"Node": table}, edges=edges), folder)
    monkeypatch.setattr(graph, "LISTED", 3)  # larger layers are joined
    for answer in (found, graph.neighbors_stored(spark, folder, "n00", depth)):
        assert {r.id for r in answer.nodes.collect()} == nodes
        rows = [(r.source_id, r.target_id, r.relationship_type) for r in answer.edges.collect()]
        assert set(rows) == kept and len(rows) == len(kept)
    with pytest.raises(QueryError):
        graph.neighbors_stored(spark, folder, "zzz")
    with pytest.raises(QueryError):
        graph.neighbors(Catalog(schema, {"Node": table}, edges=edges), "zzz", 1)


def test_adjacency_moves_its_edges_once(spark):
    schema = Schema((EntityType("Node", (Slot("parent", reference="Node"),)),))
    rows = [("a", True, None, "b"), ("b", True, None, "b"), ("c", True, None, None)]
    table = spark.createDataFrame(rows, "id string, is_available boolean, superseded_by string, parent string")
    links_ = [("a", "b", "parent"), ("a", "b", "x"), ("a", "b", "x"), ("c", "c", "x"), ("b", "a", "x")]
    edges = spark.createDataFrame([(f"{i}", *e, None, None, None, True) for i, e in enumerate(links_)], EDGE)
    found = graph.adjacency_rows(Catalog(schema, {"Node": table}, edges=edges))
    plan = found._jdf.queryExecution().executedPlan().toString()  # not yet run
    assert plan.count("Exchange") == 1 and "HashAggregate" not in plan
    link, column = "LINK_TABLE", "COLUMN"
    want = [("a", "b", True, "parent", link), ("a", "b", True, "x", link), ("a", "b", False, "x", link), ("b", "a", True, "x", link),
            ("b", "a", False, "parent", link), ("b", "a", False, "x", link), ("b", "b", True, "parent", column), ("c", "c", True, "x", link)]
    assert sorted(tuple(r) for r in found.collect()) == sorted(want)


def test_neighbors_of_a_start_that_is_not_live(spark, folder):
    schema = Schema((EntityType("Node", (Slot("parent", reference="Node"),)),))
    rows = [("a", False, None, "b"), ("b", True, None, "c"), ("c", True, None, None), ("d", True, None, None)]
    table = spark.createDataFrame(rows, "id string, is_available boolean, superseded_by string, parent string")
    edges = spark.createDataFrame([("1", "a", "b", "x", None, None, None, True), ("2", "d", "a", "x", None, None, None, True)], EDGE)
    catalog = Catalog(schema, {"Node": table}, edges=edges)
    graph.write_adjacency(catalog, folder)
    for start, nodes, kept in (("a", {"b", "c", "d"}, {("b", "c")}), ("zzz", set(), set())):
        for found in (graph.neighbors(catalog, start, 2, must_live=False), graph.neighbors_stored(spark, folder, start, 2, must_live=False)):
            assert {r.id for r in found.nodes.collect()} == nodes
            assert {(r.source_id, r.target_id) for r in found.edges.collect()} == kept


def test_chain_stops_at_cycles(spark):
    rows = [("a", "b"), ("b", "c"), ("c", "a"), ("d", "e"), ("e", None), ("f", "f")]
    df = spark.createDataFrame(rows, "id string, superseded_by string")
    got = sorted(tuple(r) for r in graph.supersession_chain(df).collect())
    assert got == [("a", 1, "b"), ("a", 2, "c"), ("b", 1, "c"), ("b", 2, "a"), ("c", 1, "a"), ("c", 2, "b"), ("d", 1, "e")]
    one = graph.supersession_chain(df, spark.createDataFrame([("b",)], "id string")).collect()
    assert sorted(tuple(r) for r in one) == [("b", 1, "c"), ("b", 2, "a")]


def test_chains_of_starts_and_ends(spark):
    rows = [("a", "b"), ("b", "c"), ("c", "a"), ("x", "a"), ("d", "e"), ("e", "g"), ("g", None), ("f", "f"), ("h", "gone")]
    df = spark.createDataFrame(rows, "id string, superseded_by string")
    ends = {r.id: (r.hops, r.terminal) for r in graph.supersession_ends(df).collect()}
    assert ends == {"a": (None, None), "b": (None, None), "c": (None, None), "x": (None, None), "d": (2, "g"), "e": (1, "g"), "h": (1, "gone")}
    starts = spark.createDataFrame([("x",), ("d",), ("g",), ("nobody",), ("d",)], "id string")
    got = sorted(tuple(r) for r in graph.supersession_chain(df, starts).collect())
    assert got == [("d", 1, "e"), ("d", 2, "g"), ("x", 1, "a"), ("x", 2, "b"), ("x", 3, "c")]
    assert graph.supersession_ends(df.limit(0)).count() == 0 and graph.supersession_chain(df.limit(0)).count() == 0


def test_long_chain_in_linear_rows(spark):
    n = 100_000
    df = spark.range(n).select("id", F.when(F.col("id") < n - 1, F.col("id") + 1).alias("superseded_by"))
    ends = graph.supersession_ends(df)
    assert ends.count() == n - 1
    assert ends.where((F.col("terminal") != n - 1) | (F.col("hops") != n - 1 - F.col("id"))).isEmpty()
    chain = graph.supersession_chain(df, spark.createDataFrame([(0,)], "id bigint"))
    assert chain.count() == n - 1 and chain.where("hop <> replacement").isEmpty()
