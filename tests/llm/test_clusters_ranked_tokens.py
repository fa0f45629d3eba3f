"""Centroid clustering, ranked search and token files beside brute force."""

import math
import re
from collections import Counter
from hashlib import sha256
from zlib import crc32

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from stratalog.llm import clusters, ranked, token_files

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
FOLDER = "/root/testdata/sf0.001"


def plain_clusters(rows, k, rounds, dims, scale=256, salt="2:"):
    kept = [(i, [math.floor(scale * x) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    centroids = [v for _, v in sorted(kept, key=lambda r: (sha256(f"{salt}{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))[:k]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), n) for n, c in enumerate(centroids))

    for _ in range(rounds):
        own = {}
        for _, v in kept:
            own.setdefault(nearest(v)[1], []).append(v)
        centroids = [[sum(x) // len(own[n]) for x in zip(*own[n])] if n in own else c for n, c in enumerate(centroids)]
    found = [(i, *nearest(v)) for i, v in kept]
    inertia = Counter()
    for _, d, c in found:
        inertia[c] += d
    return sorted(
        ((i, c, d, inertia[c], sum(inertia.values()), sha256(",".join(map(str, centroids[c])).encode()).hexdigest()) for i, d, c in found),
        key=repr,
    )


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, cluster string")


@pytest.mark.parametrize("k, rounds", [(5, 3), (40, 5)])
def test_clusters_equal_brute_force(spark, k, rounds):
    rng = np.random.default_rng(3)
    rows = [(int(i), [float(np.float32(x)) for x in rng.normal(0, 0.05, 6)], "x") for i in range(150)]
    rows += [(200 + i, rows[i % 3][1], None) for i in range(60)]  # copies
    rows += [(7, rows[7][1], None), (None, rows[9][1], None), (301, None, None), (302, [1.0] * 5, None)]
    rows += [(303, [None] + [0.0] * 5, None), (304, [float("nan")] * 6, None), (305, [float("inf")] * 6, None), (306, [], None), (307, [0.0] * 6, None)]
    got = clusters.cluster_vectors(vectors(spark, rows), k=k, rounds=rounds, dims=6)
    want = plain_clusters([(i, v) for i, v, _ in rows], k, rounds, 6)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == want


def test_empty_clusters_keep_their_centroid_and_few_vectors(spark):
    same = [(i, [0.5, -0.25], None) for i in range(8)]
    got = clusters.cluster_vectors(vectors(spark, same), k=3, rounds=2, dims=2).collect()
    assert {(r.cluster, r.distance) for r in got} == {(0, 0)} and len(got) == 8
    assert clusters.cluster_vectors(vectors(spark, []), dims=2).collect() == []
    with pytest.raises(Exception, match="64 bits"):
        clusters.cluster_vectors(vectors(spark, [(1, [1e9, 0.0], None)]), dims=2).collect()


def test_dictionaries_are_lossless_and_widen():
    rng = np.random.default_rng(1)
    alike = np.repeat(rng.integers(-5, 5, (4, 8)), 200, axis=0)
    for values in (alike, rng.integers(-100, 100, (500, 8)), rng.integers(0, 2, (1, 8))):
        blocks = clusters.dictionaries(values)
        assert np.array_equal(np.hstack([entries[codes] for _, entries, codes in blocks]), values)
    assert len(clusters.dictionaries(alike)) == 1


TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
UPPER = {c: c + 32 for c in range(65, 91)}


def plain_search(docs, items, top):
    split = [(i, TERM.findall((t or "").translate(UPPER))) for i, t in docs]
    split = [(i, Counter(w), len(w)) for i, w in split if w]
    n_docs, words = len(split), sum(n for *_, n in split)
    df = Counter(t for _, c, _ in split for t in c)
    out = []
    for item, text in items:
        asked = Counter(TERM.findall((text or "").translate(UPPER)))
        scored = []
        for doc, c, n in split:
            m = 75 + 25 * n * n_docs // words
            score = sum(q * int(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 12 * m)) for t, q in asked.items() if t in c)
            if score > 0:
                scored.append((-score, doc is None, doc or 0, doc))
        out += [(item, rank, doc, -s) for rank, (s, _, _, doc) in enumerate(sorted(scored)[:top], 1)]
    return sorted(out, key=repr)


def run_search(spark, docs, items, top=20):
    docs = spark.createDataFrame(docs, "doc_id bigint, text string, rank string")
    items = spark.createDataFrame(items, "item_id bigint, text string, score string")
    return sorted((tuple(r) for r in ranked.search(spark, ranked.build_index(docs), items, top=top).collect()), key=repr)


@pytest.mark.parametrize("docs_limit, postings", [(2048, 1 << 17), (3, 1 << 17), (2048, 10)])
def test_search_equals_brute_force(spark, monkeypatch, docs_limit, postings):
    monkeypatch.setattr(ranked, "SEGMENT_DOCS", docs_limit)
    monkeypatch.setattr(ranked, "SEGMENT_POSTINGS", postings)
    rng = np.random.default_rng(5)
    words = ["Wort", "naïve", "ÉCLAIR", "x1", "the", "of", "and", *[f"w{i}" for i in range(40)]]
    p = 1 / np.arange(1, len(words) + 1)
    docs = [(i, " ".join(rng.choice(words, int(rng.integers(0, 40)), p=p / p.sum())), None) for i in range(300)]
    docs += [(1000 + i, docs[4][1], None) for i in range(30)]  # ties
    docs += [(None, docs[4][1], "x"), (4, docs[4][1], "x"), (4, "of the w1", "x"), (2000, None, "x"), (2001, "", None), (2002, "., -", None)]
    docs += [(2003, "the w1-w2 " * 5000, None)]
    items = [(i, " ".join(rng.choice(words, 8)), None) for i in range(20)]
    items += [(50, None, None), (51, "", None), (52, "nowhere", None), (53, docs[4][1], None), (53, docs[4][1], None), (None, "the the of", None)]
    want = plain_search([d[:2] for d in docs], [i[:2] for i in items], 5)
    assert run_search(spark, docs, items, 5) == want


def test_search_in_blocks_of_items_and_empty_tables(spark, monkeypatch):
    docs = [(i, f"a b{i % 7} c{i % 3}", None) for i in range(50)]
    items = [(i, f"b{i % 9} c1 a a", None) for i in range(30)]
    want = plain_search([d[:2] for d in docs], [i[:2] for i in items], 20)
    monkeypatch.setattr(ranked, "BLOCK_ITEMS", 4)
    monkeypatch.setattr(ranked, "CELLS", 40)
    assert run_search(spark, docs, items) == want
    assert run_search(spark, [], items) == [] and run_search(spark, docs, []) == []
    assert run_search(spark, [(1, "?", None)], items) == []


def plain_tokens(docs):
    t = Tokenizer.from_file(TOKENIZER)
    start, out = 0, []
    for doc, text in docs:
        ids = t.encode(text or "", add_special_tokens=False).ids + [1]
        out.append((doc, start, len(ids), crc32(np.array(ids, "<u4").tobytes()), ids))
        start += len(ids)
    return out


ODD = ["", None, "and " * 3000, "a<|endoftext|>b <|startoftext|>", "I'll  don't\n\tÉtude é ́x y z\x1cq\x85r", "日本語 текст 123 4.5!!",
       "x" * 500, "ΟΔΟΣ ΣΑΣ İi̇ ﬁn", " lead and trail ", "\r\n\r\n a\rb\x0bc"]


def test_tokens_round_trip(spark, folder):
    docs = [(i, ODD[i % len(ODD)] if i % 3 else f"some words {i} and some words again and again") for i in range(120)]
    docs += [(500, "a b c " * 20_000), (None, "last")]
    frame = spark.createDataFrame([(i, t, "x") for i, t in reversed(docs)], "doc_id bigint, text string, start string")
    token_files.write_tokens(frame, f"{folder}/t", TOKENIZER, shard_tokens=700)
    got = token_files.read_tokens(spark, f"{folder}/t").orderBy("start").collect()
    want = plain_tokens(docs)
    assert [tuple(r) for r in got] == want
    shards = spark.read.parquet(f"{folder}/t")
    assert shards.count() > 5 and shards.agg({"tokens": "sum"}).first()[0] == sum(r[2] for r in want)
    picked = token_files.fetch_tokens(spark, f"{folder}/t", [3, 77, 500, 9999]).collect()
    assert {r.doc_id: list(r.ids) for r in picked} == {d: ids for d, *_, ids in want if d in (3, 77, 500)}


def test_tokens_of_repeated_rows_and_empty_table(spark, folder):
    rows = [(1, "one two"), (1, "three"), (1, "one two"), (0, "zero")]
    token_files.write_tokens(spark.createDataFrame(rows, "doc_id bigint, text string"), f"{folder}/t", TOKENIZER)
    got = token_files.read_tokens(spark, f"{folder}/t").orderBy("start").collect()
    assert [r.doc_id for r in got] == [0, 1, 1, 1]
    assert sorted((r.n_tokens, r.ids_crc32) for r in got) == sorted(r[2:4] for r in plain_tokens(rows))
    token_files.write_tokens(spark.createDataFrame([], "doc_id bigint, text string"), f"{folder}/e", TOKENIZER)
    assert token_files.read_tokens(spark, f"{folder}/e").count() == 0


def test_grammar_is_lossless_compresses_and_gives_slices():
    rng = np.random.default_rng(2)
    phrases = [rng.integers(0, 1000, int(n)) for n in rng.integers(2, 30, 50)]
    for ids in (
        np.concatenate([phrases[i] for i in rng.integers(0, 50, 800)]),
        np.full(1001, 7),
        np.tile([3, 3, 3, 4], 200),
        rng.integers(0, 5, 3000),
        np.array([5]),
        np.zeros(0, np.int64),
    ):
        shard = token_files.compress(ids.astype(np.int32), 1000)
        assert np.array_equal(token_files.expand(shard["symbols"], shard), ids)
        assert shard["lengths"].sum() >= 2 * len(shard["lengths"])
        for a, b in rng.integers(0, len(ids) + 1, (40, 2)):
            a, b = min(a, b), max(a, b)
            assert np.array_equal(token_files.read_slice(shard, int(a), int(b)), ids[a:b]), (a, b)
    shard = token_files.compress(np.concatenate([phrases[i] for i in rng.integers(0, 50, 800)]), 1000)
    assert len(shard["symbols"]) < 3000


def test_query_equals_plain_encoding(spark):
    from stratalog.llm.queries import op13_tokens

    rows = spark.read.parquet(f"{FOLDER}/documents.parquet").orderBy("doc_id").select("doc_id", "text").collect()
    want = [r[:4] for r in plain_tokens([tuple(r) for r in rows])]
    assert [tuple(r) for r in op13_tokens(spark, FOLDER).orderBy("start").collect()] == want


def test_plain_texts_are_cut_into_runs_that_the_model_sees_once():
    """Runs beside the whole library, on texts, on pieces and on what must not be cut here."""
    with open(TOKENIZER, encoding="utf-8") as f:
        encode = token_files.Encoder(f.read())
    rng = np.random.default_rng(4)
    signs = list("abcXYZ019'''.,-!|%$ \n\t") + ["'LL ", "'s", "don't", "É", "ß", "Ÿ", "ſ", "ŉ", "×", "÷", "İ", "²", "Ω", "é", "<", "\r", "\x1c", "<|endoftext|>"]
    texts = ["".join(rng.choice(signs[: int(rng.integers(20, len(signs) + 1))], int(rng.integers(0, 60)))) for _ in range(3000)] + [t or "" for t in ODD]
    want = Tokenizer.from_file(TOKENIZER)
    assert [x.tolist() for x in encode(texts)] == [want.encode(t, add_special_tokens=False).ids for t in texts]
    asked = []
    tokenize, encode._ids = encode._model.tokenize, None  # no plain text goes through all steps
    encode._model = type("Model", (), {"tokenize": staticmethod(lambda run: asked.append(run) or tokenize(run))})
    encode(["Unseenwordone. unseenwordone, UNSEENWORDONE!", "|unseenwordone|"])
    assert asked.count("unseenwordone") == 1


def test_tasks_of_a_worker_share_what_its_encoder_remembers():
    with open(TOKENIZER, encoding="utf-8") as f:
        model = f.read()
    first, text = token_files.encoder(model), "Sharedwordone sharedwordtwo"
    want = [x.tolist() for x in first([text])]
    encode = token_files.encoder("".join([model[:10], model[10:]]))  # the next task's copy of the broadcast
    runs, asked = encode._runs, []
    make, runs._make = runs._make, lambda run: asked.append(run) or make(run)
    try:
        assert [x.tolist() for x in encode([text])] == want and asked == []
    finally:
        runs._make = make


def test_pairs_of_one_bucket_are_told_apart(monkeypatch):
    monkeypatch.setattr(token_files, "BUCKET", 3)
    rng = np.random.default_rng(3)
    keys = np.unique(rng.integers(0, 40, 300) << 32 | rng.integers(0, 40, 300))
    chosen = rng.permutation(keys)[:60]
    bucket = token_files._buckets(keys >> 32, keys & 0xFFFFFFFF)
    want = {key: i for i, key in enumerate(chosen.tolist())}
    assert token_files._numbers(keys, bucket, chosen).tolist() == [want.get(key, -1) for key in keys.tolist()]
    ids = np.tile(rng.integers(0, 30, 200), 20).astype(np.int32)
    shard = token_files.compress(ids, 30)
    assert np.array_equal(token_files.expand(shard["symbols"], shard), ids) and len(shard["symbols"]) < 1000
