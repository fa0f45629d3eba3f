"""Licences beside a plain scan; toxicity and quality on planted documents."""

import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from stratalog.llm import licenses, quality, toxicity
from stratalog.llm.common import WordHashes

DOCS = "doc_id long, text string, words string, score double"


def words_of(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)


def test_licence_places_labels_and_scores(spark):
    rows = [
        (1, "Released under the MIT License. x under the mit license under the MIT license"),
        (2, "Licensed under CC BY-NC 4.0."),
        (3, "This work is licensed under the GNU General Public License, version 3."),
        (4, "Apache License, Version 2 apache-license_version.2 apache licenseversion 2"),
        (5, ""), (6, None), (None, "mit license under the"), (7, "the of license " * 4000), (7, "cc by nc cc by nc"),
        (8, "Éunder the mit licenseé under\x00the/mit:license"),
        (9, "Permission is hereby granted free of charge to any person obtaining one copy of this software and associated "
            "documentation files the software to deal in the software without restriction"),
        (10, "permission is granted free of charge to any person obtaining a copy of this software"),
        (11, "nc"), (12, "license version 2"), (13, "x" * 100_000),
    ]
    docs = spark.createDataFrame([(i, t, "clash", 0.0) for i, t in rows], DOCS)
    got = licenses.license_report(docs).collect()
    assert len(got) == len(rows)
    want = []
    for i, text in rows:
        words = words_of(text)
        places = [
            (k, t.label)
            for t in licenses.BASE
            for k in range(len(words) - len(t.words) + 1)
            if words[k : k + len(t.words)] == t.words
        ]
        starts = [k for k, _ in places]
        want.append((i, len(words), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in places}))))
    assert sorted(map(str, ((r["doc_id"], r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) for r in got))) == sorted(map(str, want))
    labels = {r["doc_id"]: (r["labels"], r["score"]) for r in got if r["doc_id"] != 7}
    assert labels[1] == ("mit", 1.0) and labels[2] == ("cc-by-nc", 1.0) and labels[3] == ("gpl-3", 1.0)
    assert labels[9][0] == "mit" and 0.8 <= labels[9][1] < 1
    assert labels[10] == ("", 0.0) and labels[5] == ("", 0.0)
    assert all(0 <= r["score"] <= 1 for r in got)
    assert licenses.license_report(spark.createDataFrame([], DOCS)).count() == 0


def test_edited_notices_are_found_wherever_their_phrase_stands(spark):
    draw = np.random.default_rng(5)
    templates = licenses.BASE + licenses.NOTICES
    rows = [(0, "the of a license " * 50)]
    for n, t in enumerate(licenses.NOTICES):
        low, high = t.key_span
        for edits in (0, 1, 3, 5):
            words = list(t.words)
            free = [i for i in range(len(words)) if not low <= i < high]
            # the rarest words are the long ones here: an edit takes them first
            for i in sorted(free, key=lambda i: -len(words[i]))[:edits]:
                words[i] = "edited"
            around = list(draw.choice(["the", "of", "license", "software", "under", "permission"], 6))
            rows.append((10 * n + edits, " ".join([*around[:3], *words, *around[3:]])))
    docs = spark.createDataFrame([(i, t, "", 0.0) for i, t in rows], DOCS)
    weights = licenses.word_weights(docs.select(licenses.license_words(F.col("text")).alias("words")), templates)
    want = {}
    for i, text in rows:
        words, best, labels = words_of(text), 0.0, set()
        for t in templates:
            low, high = t.key_span
            for start in range(-len(t.words), len(words)):
                same = [0 <= start + k < len(words) and words[start + k] == w for k, w in enumerate(t.words)]
                share = sum(weights[w] for w, s in zip(t.words, same) if s) / sum(weights[w] for w in t.words)
                share = 1.0 if all(same) else share
                if all(same[low:high]):
                    best = max(best, share)
                if all(same) or (not t.exact and all(same[low:high]) and share >= licenses.ENOUGH):
                    labels.add(t.label)
        want.setdefault(i, []).append((",".join(sorted(labels)), round(best, 9)))
    got = {}
    for r in licenses.license_report(docs).collect():
        got.setdefault(r["doc_id"], []).append((r["labels"], round(r["score"], 9)))
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}
    assert sum(x[0] != "" for v in got.values() for x in v) > 2 * len(licenses.NOTICES)
    with pytest.raises(ValueError):
        licenses.license_report(docs, licenses.NOTICES[:1] + licenses.BASE)


def test_licence_plan_is_narrow_and_native(spark):
    docs = spark.createDataFrame([(1, "mit", "", 0.0)], DOCS)
    plan = licenses.license_report(docs)._jdf.queryExecution().toString()
    assert "Exchange" not in plan and "Python" not in plan


RUDE = ["vilest", "rubbishy", "dimwit", "crook"]


def corpus(n, rude_share=0.2):
    draw = np.random.default_rng(2)
    vocabulary = ["word%d" % i for i in range(600)]
    docs, labels = [], []
    for i in range(n):
        body = list(draw.choice(vocabulary, int(draw.integers(20, 120))))
        toxic = int(draw.random() < rude_share)
        for _ in range(toxic * 4):
            body[int(draw.integers(0, len(body)))] = str(draw.choice(RUDE))
        junk = int(draw.random() < 0.2)
        if junk:
            body = [w + str(draw.choice(["***", "$$$", "###"])) for w in body]
        docs.append((i, " ".join(body), "clash", 0.5))
        if i % 2:
            labels.append((i, 1 - junk, toxic))
    return docs, labels


def _auc(truth, score):
    order = np.argsort(np.argsort(score)) + 1
    truth = np.array(truth)
    ones = truth.sum()
    return (order[truth == 1].sum() - ones * (ones + 1) / 2) / (ones * (len(truth) - ones))


def test_models_find_planted_documents_and_follow_the_contract(spark):
    docs, labels = corpus(1600)
    truth = {i: (q, t) for i, q, t in labels}
    rows = docs + [(None, "word1", "", 0.0), (90001, None, "", 0.0), (90002, "", "", 0.0), (90003, "word2 " * 40_000, "", 0.0), docs[0]]
    frame = spark.createDataFrame(rows, DOCS)
    marked = spark.createDataFrame(labels + [(None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")
    for module, label, at, threshold in ((toxicity, "toxic", 1, 0.5), (quality, "quality", 0, 0.3)):
        got = module.score(frame, module.train(frame, marked)).collect()
        assert len(got) == len(rows)
        for r in got:
            body = "" if r["doc_id"] is None else str(r["doc_id"])
            assert r["held_out"] == (zlib.crc32(body.encode()) % 5 == 0)
            assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= threshold)
        held = [(truth[r["doc_id"]][at], r["score"]) for r in got if r["held_out"] and r["doc_id"] in truth]
        assert _auc(*zip(*held)) > 0.9, label
    kept = toxicity.drop_toxic(frame, toxicity.train(frame, marked))
    assert kept.columns == frame.columns
    clean = {d[0] for d in docs if not any(w in d[1] for w in RUDE)}
    ids = {r["doc_id"] for r in kept.select("doc_id").collect()}
    assert len(clean - ids) <= 0.03 * len(clean) and {None, 90001, 90002} <= ids


def test_labels_of_the_held_out_fold_change_nothing(spark):
    docs, labels = corpus(300)
    frame = spark.createDataFrame(docs, DOCS)
    other = [(i, 1 - q, 1 - t) if zlib.crc32(str(i).encode()) % 5 == 0 else (i, q, t) for i, q, t in labels]
    scores = []
    for rows in (labels, other):
        marked = spark.createDataFrame(rows, "doc_id long, quality int, toxic int")
        scores.append({r["doc_id"]: r["score"] for r in toxicity.score(frame, toxicity.train(frame, marked)).collect()})
    assert scores[0].keys() == scores[1].keys()
    assert max(abs(scores[0][i] - scores[1][i]) for i in scores[0]) < 1e-9


def test_models_without_labels_or_rows(spark):
    none = spark.createDataFrame([], DOCS)
    no_labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    one = spark.createDataFrame([(1, "a b", "", 0.0)], DOCS)
    for module in (toxicity, quality):
        assert module.score(none, module.train(none, no_labels)).count() == 0
        assert module.score(one, module.train(one, no_labels)).count() == 1


def test_quality_trains_the_same_epochs_at_every_size(monkeypatch):
    drawn = []

    class Counted:
        def __init__(self, seed):
            self.draw = np.random.Generator(np.random.PCG64(seed))

        def normal(self, *a):
            return self.draw.normal(*a)

        def permutation(self, n):
            drawn.append(n)
            return self.draw.permutation(n)

    monkeypatch.setattr(quality.np.random, "default_rng", Counted)
    for n in (500, 8000, 8001):
        drawn.clear()
        x = np.linspace(-1, 1, 2 * n).reshape(n, 2)
        quality._fit(quality.Network(np.zeros((1, 2)), np.zeros(1)), x, (x[:, 0] > 0).astype(float))
        assert drawn == [n] * quality.EPOCHS


def test_shared_counts_are_exact_and_grow(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "HELD", 500)  # tasks pass on what they hold many times
    rows = [" ".join(f"left{i} hot left{i} rare" if i < 3 else f"left{i} hot" for i in range(k, 5000, 7)) for k in range(7)]
    words = np.sort(WordHashes()([b"hot", b"rare", b"never"]))
    before, total = toxicity._shared_counts(spark.createDataFrame([(r,) for r in rows * 2], "text string"), words)
    found = dict(zip(words.tolist(), before.tolist()))
    hot, rare, never = WordHashes()([b"hot", b"rare", b"never"]).tolist()
    assert (found[hot], found[rare], found[never]) == (5000, 3, 0)
    pairs = {p for r in rows for p in zip(["", *r.split()], r.split())}
    assert total == len(pairs)


def test_pairs_travel_as_steps_between_sorted_keys():
    low = 63 - toxicity.DEAL_BITS
    edges = np.array([0, 1, 1 << low, (1 << 63) - 1], np.int64)
    for keys in (edges[:1], edges, np.unique(np.random.default_rng(1).integers(0, 1 << 63, 1 << 21))):
        rows = list(toxicity._packed(keys, low))
        assert [d for d, _ in rows] == np.unique(keys >> low).tolist()
        assert np.array_equal(np.concatenate([toxicity._unpacked(p) + (d << low) for d, p in rows]), keys)
    assert sum(len(p) for _, p in rows) < 7 * len(keys)


def test_chances_follow_kneser_ney_and_sum_to_one(spark):
    draw = np.random.default_rng(4)
    vocabulary = [f"w{i}" for i in range(25)]
    p = 1 / np.arange(1, 26) ** 1.3
    texts = [" ".join(draw.choice(vocabulary, 30, p=p / p.sum() if i % 2 else p[::-1] / p.sum())) for i in range(60)]
    labelled = spark.createDataFrame([(t, i % 2) for i, t in enumerate(texts[:40])], "text string, label int")
    every = spark.createDataFrame([(t,) for t in texts], "text string")
    model = toxicity._build(labelled, every)
    digest = dict(zip(["", *vocabulary], [0, *WordHashes()([w.encode() for w in vocabulary]).tolist()]))
    pairs = {p for t in texts for p in zip(["", *t.split()], t.split())}
    shared = np.array([sum(w == v for _, w in pairs) / len(pairs) for v in vocabulary])
    ids = np.array([digest[v] for v in vocabulary], np.uint64)
    counts = [{}, {}]
    for i, t in enumerate(texts[:40]):
        for pair in zip(["", *t.split()], t.split()):
            counts[i % 2][pair] = counts[i % 2].get(pair, 0) + 1
    for left in ["", *vocabulary, "unseen"]:
        got = model.chances(digest.get(left, 12345), ids, shared)
        assert np.allclose(got.sum(axis=1), 1)
        for c in (0, 1):
            ends = np.array([sum(w == v for _, w in counts[c]) for v in vocabulary])
            low = np.maximum(ends - 3, 0) / ends.sum() + np.minimum(ends, 3).sum() / ends.sum() * shared
            n = np.array([counts[c].get((left, v), 0) for v in vocabulary])
            want = np.maximum(n - 2, 0) / n.sum() + np.minimum(n, 2).sum() / n.sum() * low if n.sum() else low
            assert np.allclose(got[c], want)
    known, text = model.gaps(), texts[0]
    rated = toxicity.features(known, WordHashes(), [text, None, ""])
    steps = [model.chances(digest[a], np.array([digest[b]], np.uint64), shared[[vocabulary.index(b)]]) for a, b in zip(["", *text.split()], text.split())]
    assert np.isclose(rated[0, 0], np.mean([np.log(s[1, 0] / s[0, 0]) for s in steps]), atol=1e-5)
    assert not rated[1:].any()
