"""The change feed over batches with late events, beside a plain account of it."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from stratalog.model import QueryError
from stratalog.streaming import feed

LOG = "id bigint, entity_id bigint, operation string, timestamp timestamp_ntz, patch string"
START = dt.datetime(2024, 1, 1)


def told(batches, delay, since=None):
    """(batch, entity, newest change, changes) as the watermark passes them."""
    waiting, mark, out = {}, None, []
    for number, rows in enumerate(batches):
        times = []
        for entity, operation, at, patch in rows:
            gone = operation == "availability_change" and patch and '"deleted"' in patch
            if entity is None or at is None or gone or (since and at <= since):
                continue
            times.append(at)
            if mark is None or at > mark:
                waiting.setdefault(entity, []).append(at)
        if times:
            newest = max(times) - delay
            newest = newest.replace(microsecond=newest.microsecond // 1000 * 1000)
            mark = newest if mark is None else max(mark, newest)
        for entity in list(waiting):
            passed = [a for a in waiting[entity] if mark and a < mark]
            if passed:
                out.append((number, entity, max(passed), len(passed)))
                waiting[entity] = [a for a in waiting[entity] if a >= mark]
    return out


def run(spark, folder, batches, delay, since=None):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", feed.STATE_STORE)
    out = []
    for number, rows in enumerate(batches):
        frame = spark.createDataFrame([(i, e, o, t, p) for i, (e, o, t, p) in enumerate(rows)], LOG)
        frame.write.mode("append").parquet(f"{folder}/log")
        stream = spark.readStream.schema(LOG).parquet(f"{folder}/log")
        feed.stream_updated_since(stream, f"{folder}/feed", f"{folder}/state", delay, since).awaitTermination()
        rows = feed.read_feed(spark.read.parquet(f"{folder}/feed")).collect() if number or True else []
        out.append([tuple(r) for r in rows])
    return out


def test_feed_over_three_batches_with_late_events(spark, folder):
    draw = random.Random(3)
    at = lambda hours: START + dt.timedelta(hours=hours, microseconds=draw.randrange(10**6))
    batches = []
    for b in range(3):
        rows = [(draw.randrange(12), draw.choice(["create", "update", "relationship_add"]), at(10 * b + draw.random() * 10), None) for _ in range(60)]
        rows += [(draw.randrange(12), "update", at(10 * b - draw.random() * 9), None) for _ in range(20)] if b else []  # late
        rows += [(100 + b, "availability_change", at(10 * b + 1), '{"status":"deleted"}'), (None, "update", at(1), None), (7, "update", None, None)]
        rows += [(50, "update", at(10 * b + 2), None)] * 30  # one busy entity, equal times
        batches.append(rows)
    want = told(batches, dt.timedelta(hours=3))
    got = run(spark, folder, batches, "3 hours")
    assert sorted(got[-1]) == sorted(r[1:] for r in want)
    assert [r[1] for r in got[-1]] == sorted(r[1] for r in got[-1])  # oldest first over all batches
    for number, rows in enumerate(got):  # nothing told is ever taken back
        assert sorted(rows) == sorted(r[1:] for r in want if r[0] <= number)


def test_feed_since_and_state_store(spark, folder):
    rows = [(1, "update", START, None), (2, "update", START + dt.timedelta(hours=1), None), (3, "update", START + dt.timedelta(hours=9), None)]
    got = run(spark, folder, [rows], "1 hour", since=START)
    assert got == [[(2, START + dt.timedelta(hours=1), 1)]]
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    stream = spark.readStream.schema(LOG).parquet(f"{folder}/log")
    with pytest.raises(QueryError, match="stateStore"):
        feed.stream_updated_since(stream, f"{folder}/f", f"{folder}/s")


def test_feed_at_the_watermark_itself(spark, folder):
    """A change at the watermark waits for the next step; one that comes late at it is dropped."""
    mark = START + dt.timedelta(hours=1)
    first = [(1, "update", mark, None), (2, "update", mark - dt.timedelta(microseconds=1), None), (3, "update", mark + dt.timedelta(hours=3), None)]
    second = [(1, "update", mark, None), (4, "update", mark + dt.timedelta(hours=5), None)]
    got = run(spark, folder, [first, second], "3 hours")
    assert got[0] == [(2, mark - dt.timedelta(microseconds=1), 1)]
    assert got[1][1:] == [(1, mark, 1)]


def test_feed_keeps_its_state_in_the_engine(spark, folder):
    """No entity calls into Python: the time of the feed grew with entities times steps."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", feed.STATE_STORE)
    spark.createDataFrame([(1, 1, "update", START, None)], LOG).write.parquet(f"{folder}/log")
    stream = feed.change_feed(spark.readStream.schema(LOG).parquet(f"{folder}/log"), "1 hour")
    plan = stream._jdf.queryExecution().analyzed().toString()
    assert "Python" not in plan and plan.count("Aggregate") == 2
