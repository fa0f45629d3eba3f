"""The pipeline on a small corpus, stage by stage beside plain Python."""

import numpy as np

import corpus_pipeline
from stratalog.llm import mixing, toxicity
from tests.llm.test_neardup_repeats import components
from tests.llm.test_windows_archive_ann import leaks

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def build(spark, folder):
    draw = np.random.default_rng(4)
    word = lambda: "word%d" % draw.integers(0, 900)
    items = [(i, " ".join(word() for _ in range(40))) for i in range(5)]
    rows, labels = [], []
    for i in range(900):
        body = [word() for _ in range(int(draw.integers(30, 90)))]
        toxic = i % 5 == 0
        for _ in range(5 * toxic):
            body[int(draw.integers(0, len(body)))] = "vilest"
        if i % 50 == 1:
            body += items[i % 5][1].split()
        text = " ".join(body)
        if i % 20 == 3 and rows:
            text = rows[-1][1].upper()
        rows.append((i, text, "en", "hot" if i % 3 == 0 else f"s{i % 4}", len(text)))
        if i % 2:
            labels.append((i, 1, int("vilest" in text.lower())))
    rows += [(2000, None, None, None, None), (2001, "", "en", "s1", 0)]
    spark.createDataFrame(rows, DOCS).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return rows, items


def test_each_stage_on_what_its_predecessor_kept(spark, folder):
    rows, items = build(spark, folder)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_dedup", "decontamination", "mixing", "sharding"]
    docs = spark.createDataFrame(rows, DOCS)
    kept = []
    for at, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, folder)
        out.write.parquet(f"{folder}/stage{at}")
        out = spark.read.parquet(f"{folder}/stage{at}")
        if name != "sharding":
            assert out.columns == docs.columns
        kept.append([(r["doc_id"], r["text"], r["source"]) for r in out.collect()] if name != "sharding" else out.collect())
        docs = out
    clean, single, safe, mixed, dealt = kept
    texts = {i: t for i, t, *_ in rows}
    rude = {i for i, t in texts.items() if t and "vilest" in t.lower()}
    ids = {i for i, *_ in clean}
    assert len(ids & rude) <= 0.1 * len(rude) and len((texts.keys() - rude) - ids) <= 0.02 * len(texts)
    assert {2000, 2001} <= ids
    classes = components([(i, t) for i, t, _ in clean], 5)
    assert sorted(i for i, *_ in single) == sorted(i for i, (_, c) in classes.items() if i == c)
    found = {d for d, _ in leaks([(i, t) for i, t, _ in single], items)}
    assert found and sorted(i for i, *_ in safe) == sorted(i for i, *_ in single if i not in found)
    words = lambda t: len((t or "").split())
    total = sum(words(t) for _, t, _ in safe)
    assert abs(sum(words(t) for _, t, _ in mixed) - mixing.SHARE * total) < 0.05 * total
    counts = {i: 0 for i, *_ in safe}
    for i, *_ in mixed:
        counts[i] += 1
    assert max(counts.values()) <= 2
    assert len(dealt) == len(mixed) and {r["shard"] for r in dealt} <= set(range(24))
    by_shard = {}
    for r in dealt:
        by_shard.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in by_shard.values())
    assert toxicity.THRESHOLD == 0.5


def test_run_gives_the_last_stage(spark, folder):
    build(spark, folder)
    out = corpus_pipeline.run(spark, folder)
    assert {"doc_id", "shard", "slot"} <= set(out.columns) and out.count() > 0
