"""Newest event per key: ties, text and whole-number ids, old dates, repeated rows."""

import datetime as dt
import random

import pytest

from stratalog.operators import temporal as tm

SHAPE = (
    "id {kind}, entity_id string, entity_type string, operation string, actor_id string, timestamp timestamp_ntz, "
    "schema_version string, derived_from_id string, process_id string, patch string, context string"
)


def events(kind, n=400):
    draw = random.Random(5)
    out = []
    for i in range(n):
        number = draw.randrange(-50, 50) * 10**15 + i
        at = draw.choice([dt.datetime(1950, 5, 1), dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 1, 0, 0, 0, 1), dt.datetime(2024, 3, 1)])
        operation = draw.choice(["create", "update", "update", "availability_change", "relationship_add"])
        patch = draw.choice(['{"is_available":false}', '{"is_available":true}', '{"status":"deleted"}', None]) if operation == "availability_change" else f'{{"k":{i}}}'
        row = (number if kind == "bigint" else f"event-{draw.randrange(10)}-{i:04d}", f"e{draw.randrange(25)}", draw.choice("TU"), operation,
               draw.choice(["ann", "bob", None]), at, draw.choice(["v1", "v2", None]), None, None, patch, None)
        out.append(row)
    return out + out[:20]  # repeated rows


def gone(r):
    return r[3] == "availability_change" and r[9] in ('{"is_available":false}', '{"status":"deleted"}')


@pytest.mark.parametrize("kind", ["bigint", "string"])
def test_newest_per_key_with_ties(spark, kind):
    rows = events(kind)
    log = spark.createDataFrame(rows, SHAPE.format(kind=kind))
    by = {}
    for r in rows:
        by.setdefault(r[1], []).append(r)
    at = lambda r: (r[5], r[0])
    pick = lambda found, f, i, g=max: g(found, key=at)[i] if found else None

    def summary(e):
        made, kept = [r for r in by[e] if r[3] == "create"], [r for r in by[e] if not gone(r)]
        return (e, pick(made, max, 5, min), pick(kept, max, 5), pick(kept, max, 6), pick(made, max, 4, min), pick(kept, max, 4))

    got = tm.temporal_summary(log).collect()
    assert sorted(map(tuple, got), key=repr) == sorted((summary(e) for e in by), key=repr)
    pairs = {(r[1], r[2]) for r in rows}
    want = []
    for e, t in pairs:
        own = [r for r in rows if (r[1], r[2]) == (e, t)]
        want.append((e, t, min(r[5] for r in own), pick([r for r in own if not gone(r)], max, 5), pick(own, max, 6)))
    assert sorted(map(tuple, tm.provenance_summary(log).collect()), key=repr) == sorted(want, key=repr)
    states = {e: max((r for r in by[e] if r[3] in ("create", "update")), key=at, default=None) for e in by}
    got = {r.entity_id: (r.state, r.timestamp) for r in tm.latest_state_per_entity(log).collect()}
    assert got == {e: (r[9], r[5]) for e, r in states.items() if r}
    flags = {e: max((r for r in by[e] if r[3] == "availability_change" and r[9]), key=at, default=None) for e in by}
    got = {r.entity_id: (r.available, r.timestamp) for r in tm.latest_availability_per_entity(log).collect()}
    assert got == {e: (not gone(r), r[5]) for e, r in flags.items() if r}
    got = {r.entity_id: (r.state, r.version) for r in tm.state_at(log).collect()}
    live = {e: r for e, r in states.items() if r and not (flags[e] and gone(flags[e]))}
    assert got == {e: (r[9], max(1, sum(x[3] in ("create", "update") for x in by[e]))) for e, r in live.items()}


@pytest.mark.parametrize("kind", ["bigint", "string"])
def test_newest_edge_event_of_null_keys_and_ties(spark, kind):
    patch = lambda rid, s, t: f'{{"relationship_id":"{rid}","source_id":"{s}"' + (f',"target_id":"{t}"' if t else "") + ',"relationship_type":"r"}'
    name = (lambda i: i) if kind == "bigint" else (lambda i: f"x{i}")
    day = dt.datetime(2024, 1, 1)
    spec = [(1, "relationship_add", "a", "b"), (2, "relationship_remove", "a", "b"), (3, "relationship_add", "a", None), (4, "relationship_remove", "a", None), (0, "relationship_add", "c", "d")]
    rows = [(name(i), s, "relationship", op, "ann", day, "v1", None, None, patch(f"r{i}", s, t), None) for i, op, s, t in spec]
    log = spark.createDataFrame(rows, SHAPE.format(kind=kind))
    got = {(r.source_id, r.target_id): (r.id, r.operation) for r in tm.latest_edge_event(log).collect()}
    assert got == {("a", "b"): ("r2", "relationship_remove"), ("a", None): ("r4", "relationship_remove"), ("c", "d"): ("r0", "relationship_add")}
    assert [r.id for r in tm.live_edges_at(log).collect()] == ["r0"]


@pytest.mark.parametrize("kind", ["bigint", "string"])
def test_states_from_snapshots(spark, folder, kind):
    from stratalog.operators import snapshots as sn
    from stratalog.sources.sinks import append_provenance

    draw = random.Random(8)
    rows = [(r[0], *r[1:5], r[5] + dt.timedelta(days=draw.randrange(60), seconds=draw.randrange(9)), *r[6:]) for r in events(kind) if r[5].year == 2024]
    append_provenance(spark.createDataFrame(rows, SHAPE.format(kind=kind)), f"{folder}/log")
    log = spark.read.parquet(f"{folder}/log")
    full = lambda at, c: sorted(map(tuple, tm.state_at(log, at, c).collect()), key=repr)
    stored = lambda at, c: sorted(map(tuple, sn.state_at_stored(log, at, f"{folder}/snaps", c).collect()), key=repr)
    assert stored("2024-02-01 00:00:00", False) == full("2024-02-01 00:00:00", False)  # no snapshot yet
    for at in ("2024-01-20 00:00:00", "2024-02-15 12:30:00.5"):
        sn.write_snapshot(log, at, f"{folder}/snaps")
    assert len(sn.snapshot_times(spark, f"{folder}/snaps")) == 2
    for at in ("2024-01-05 00:00:00", "2024-01-20 00:00:00", "2024-02-01 00:00:00", "2024-02-15 12:30:00.5", "2024-03-10 00:00:00", "2030-01-01 00:00:00"):
        for create in (False, True):
            assert stored(at, create) == full(at, create), at
    plan = sn.state_at_stored(log, "2024-03-01 00:00:00", f"{folder}/snaps")._jdf.queryExecution().executedPlan().toString()
    assert "event_date" in plan and ">= 2024-02-15" in plan  # only the days after the snapshot
