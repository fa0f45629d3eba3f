"""Sharding and mixing beside plain Python."""

import math
import zlib
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from stratalog.llm import mixing, shards

DOCS = "doc_id long, text string, source string, size string, shard int"


def jump(key, n):
    key, b, j = key % 2**64, -1, 0
    while j < n:
        b = j
        key = (key * 2862933555777941757 + 1) % 2**64
        j = int((b + 1) * ((1 << 31) / ((key >> 33) + 1)))
    return b


def test_jump_hash_is_the_sequential_algorithm():
    keys = [0, 1, 2, 10**6, 2**63 - 1, -1 % 2**64, 12345678901234567890]
    for n in (1, 2, 24, 25, 1000):
        assert shards.jump_hash(np.array(keys, dtype=np.uint64), n).tolist() == [jump(k, n) for k in keys]


def test_shards_slots_sizes_and_growth(spark):
    texts = ["", None, "a b", "ü ß", "x" * 100_000]
    rows = [(i, texts[i % 5], "s", "clash", 7) for i in range(300)] + [(5, "again", "s", "c", 1)] * 3 + [(None, "n", None, None, None)]
    got = shards.assign_shards(spark.createDataFrame(rows, DOCS)).collect()
    assert len(got) == len(rows)
    slots = {}
    for r in got:
        key = r["doc_id"] or 0
        assert r["shard"] == jump(key, 24) and r["grown_shard"] == jump(key, 25)
        assert r["grown_shard"] in (r["shard"], 24)
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    by_id = {r["doc_id"]: r for r in got}
    for i in range(6, 300):
        body = (texts[i % 5] or "").encode()
        assert by_id[i]["size"] == len(body) + 8 and by_id[i]["text_crc32"] == zlib.crc32(body)
    ordered = sorted((r["shard"], r["doc_id"] or 0, r["slot"]) for r in got)
    assert all(a[2] < b[2] or a[1] == b[1] for a, b in zip(ordered, ordered[1:]) if a[0] == b[0])


def test_empty_tables(spark):
    none = spark.createDataFrame([], DOCS)
    assert shards.assign_shards(none).count() == 0
    assert mixing.mix_sizes(none).count() == 0
    assert mixing.mix_documents(none).columns == none.columns


def test_text_keys_and_written_shards(spark, folder):
    docs = spark.createDataFrame([(str(i), f"t{i}", "s", "", 0) for i in range(50)], DOCS.replace("doc_id long", "doc_id string"))
    assert shards.assign_shards(docs).count() == 50
    shards.write_shards(docs, f"{folder}/out", shards=4, files=2)
    back = spark.read.parquet(f"{folder}/out")
    assert back.count() == 50 and set(back.columns) == set(docs.columns)


def targets_by_loop(sizes, share=Fraction(3, 2), weights=(3, 1, 2)):
    names = sorted([s for s in sizes if s is not None]) + ([None] if None in sizes else [])
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, capped = share * sum(sizes.values()), {}
    while True:
        free = [s for s in names if s not in capped]
        if not free:
            return capped
        level = Fraction(left - sum(capped.values())) / sum(w[s] for s in free)
        over = [s for s in free if level * w[s] > 2 * sizes[s]]
        if not over:
            return capped | {s: level * w[s] for s in free}
        capped |= {s: Fraction(2 * sizes[s]) for s in over}


@pytest.mark.parametrize(
    "sizes",
    [
        {"a": 100, "b": 50, "c": 7},
        {"a": 10, "b": 1000, "c": 1, "d": 5, None: 300},
        {"a": 0, "b": 4},
        {"é": 9000, "z": 10, "Z": 10, "": 3},
        {None: 5},
    ],
)
def test_targets_and_blocks(spark, sizes):
    frame = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    targets = mixing.source_targets(frame)
    want = targets_by_loop(sizes)
    got = {r["source"]: r["target"] for r in targets.collect()}
    assert got.keys() == want.keys()
    for s in want:
        assert math.isclose(got[s], float(want[s]), rel_tol=1e-12, abs_tol=1e-9)
    blocks = {r["source"]: r["blocks"] for r in mixing.source_blocks(targets, 4).collect()}
    house = int(Fraction(sum(want.values())) / 4 + Fraction(1, 2))
    names = sorted([s for s in sizes if s is not None]) + ([None] if None in sizes else [])
    seats = dict.fromkeys(names, 0)
    for _ in range(house):  # Sainte-Laguë by hand
        best = max(names, key=lambda s: (got[s] / (2 * seats[s] + 1), -names.index(s)))
        if got[best] > 0:
            seats[best] += 1
    assert blocks == seats


def test_mix_comes_near_its_targets_and_reruns_agree(spark):
    draw = np.random.default_rng(1)
    rows = []
    for i in range(3000):
        n = int(draw.integers(0, 60)) if i % 500 else 6000
        rows.append((i, "w " * n, ["hot", "a", "b", None][0 if i % 3 == 0 else int(draw.integers(0, 4))], "clash", 1))
    rows += [(None, None, "a", None, None), (7, "w w", "b", None, None), (7, "w w", "b", None, None)]
    docs = spark.createDataFrame(rows, DOCS)
    first = mixing.mix_sizes(docs, shard_words=10_000).collect()
    again = mixing.mix_sizes(docs.repartition(5), shard_words=10_000).collect()
    key = lambda r: (r["doc_id"] is None, r["doc_id"], r["size"], r["taken"])
    assert sorted(map(key, first)) == sorted(map(key, again))
    taken, target = {}, {}
    for r in first:
        assert 0 <= r["taken"] <= 2 * r["size"] and 0 <= r["copies"] <= 2
        taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
        target[r["source"]] = r["target"]
    for s in target:
        assert abs(taken[s] - target[s]) < 0.01 * target[s] + 200
    mixed = mixing.mix_documents(docs, shard_words=10_000)
    assert mixed.columns == docs.columns
    counts = {r["doc_id"]: r["count"] for r in mixed.groupBy("doc_id").count().collect()}
    assert counts == {k: v for k, v in _sum((r["doc_id"], r["copies"]) for r in first).items() if v}


def test_small_sources_of_short_texts_reach_their_targets(spark):
    rows = [(i, "w " * 3, "short", "", 1) for i in range(900)] + [(i, "w " * 500, "z%d" % (i % 2), "", 1) for i in range(1000, 1800)]
    docs = spark.createDataFrame(rows, DOCS)
    for share in (0.5, 1.0, 1.5):
        got = mixing.mix_sizes(docs, share=share, weights=(1, 100, 120), shard_words=100).collect()
        blocks = {}
        for r in got:
            assert 0 <= r["taken"] <= 2 * r["size"]
            taken, target = blocks.get(r["source"], (0, 0))
            blocks[r["source"]] = taken + r["taken"], r["target"]
        for source, (taken, target) in blocks.items():
            assert abs(taken - target) <= mixing.BLOCK_WORDS, (share, source, taken, target)


def _sum(pairs):
    out = {}
    for k, v in pairs:
        out[k] = out.get(k, 0) + v
    return out


def test_mix_plan_has_no_python(spark):
    docs = spark.createDataFrame([(1, "a b", "s", "", 0)], DOCS)
    plan = mixing.mix_sizes(docs)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Cartesian" not in plan
    assert F is not None
