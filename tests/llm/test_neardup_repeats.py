"""Near-duplicates and repeated units beside brute force."""

import numpy as np
import pytest

from stratalog.llm import neardup, repeats
from stratalog.llm.common import WordHashes

DOCS = "doc_id long, text string, n long, kept string, bands string"


def sets_of(text, words):
    w = (text or "").encode().lower().split()
    if not w:
        return set()
    size = min(words, len(w))
    return {tuple(w[i : i + size]) for i in range(len(w) - size + 1)}


def components(rows, words):
    sets = [sets_of(t, words) for _, t in rows]
    parent = {i: i for i, _ in rows}

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j]:
                common = len(sets[i] & sets[j])
                if 100 * common >= 80 * (len(sets[i]) + len(sets[j]) - common):
                    a, b = find(rows[i][0]), find(rows[j][0])
                    parent[max(a, b)] = min(a, b)
    return {i: (len(s), find(i)) for (i, _), s in zip(rows, sets)}


def corpus():
    draw = np.random.default_rng(5)
    word = lambda: "w%d" % draw.integers(0, 400)
    rows = []
    for group in range(12):  # chains of edits: neighbours alike, ends apart
        text = [word() for _ in range(int(draw.integers(3, 120)))]
        for _ in range(int(draw.integers(1, 14))):
            rows.append(" ".join(text))
            for _ in range(max(1, len(text) // 30)):
                text[int(draw.integers(0, len(text)))] = word()
    rows += [" ".join(word() for _ in range(int(draw.integers(1, 60)))) for _ in range(60)]
    rows += ["", None, " \t\n", "One", "one", "ONE TWO", "one  two", "Ünï code", "a " * 30_000, "A b", "\x1c\x1d"]
    order = draw.permutation(len(rows))
    return [(int(i) * 3, rows[k]) for i, k in enumerate(order)]


@pytest.mark.parametrize("words", [2, 5])
def test_components_are_those_of_all_pairs(spark, words):
    rows = corpus()
    docs = spark.createDataFrame([(i, t, 0, "x", "y") for i, t in rows], DOCS).repartition(6)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in neardup.near_duplicates(docs, words).collect()}
    assert got == components(rows, words)


def test_kept_nulls_repeated_ids_and_empty(spark):
    text = " ".join(f"a{i}" for i in range(40))
    rows = [(4, text), (2, text.upper()), (2, "other words here"), (None, text), (None, None), (9, text + " more"), (7, "")]
    docs = spark.createDataFrame([(i, t, 0, "x", "y") for i, t in rows], DOCS)
    got = neardup.near_duplicates(docs).collect()
    assert sorted((r["doc_id"] is None, r["doc_id"], r["component_id"], r["kept"]) for r in got) == [
        (False, 2, 2, True), (False, 2, 2, True), (False, 4, 2, False), (False, 7, 7, True), (False, 9, 2, False),
        (True, None, None, True), (True, None, None, True),
    ]
    kept = neardup.keep_one(docs)
    assert kept.columns == docs.columns and sorted(str(r["doc_id"]) for r in kept.collect()) == ["2", "2", "7", "None", "None"]
    assert neardup.near_duplicates(spark.createDataFrame([], DOCS)).count() == 0
    assert neardup.keep_one(spark.createDataFrame([], DOCS)).count() == 0


def test_every_coordinate_fills_and_agreement_is_the_similarity():
    hashes = WordHashes()
    size = neardup.BANDS * neardup.BAND_ROWS
    agree, truth = [], []
    for n in (1, 2, 5, 40, 300, 3000):
        common = [b"c%d" % i for i in range(n)]
        a = np.unique(hashes(common + [b"a%d" % i for i in range(n // 4)]))
        b = np.unique(hashes(common + [b"b%d" % i for i in range(n // 4)]))
        x, y = neardup.fast_sketch(a, size), neardup.fast_sketch(b, size)
        assert (x != 0).all() and (y != 0).all()
        assert (neardup.fast_sketch(a[::-1].copy(), size) == x).all()
        agree.append(float((x == y).mean()))
        truth.append(len(np.intersect1d(a, b)) / len(np.union1d(a, b)))
    assert max(abs(p - q) for p, q in zip(agree, truth)) < 0.13


def test_connected_finds_the_smallest_reachable(spark):
    chain = [(i + 1, i) for i in range(60)] + [(200, 100), (150, 200), (150, 170)]
    roots = neardup.connected(spark.createDataFrame(chain, "a long, b long")).collect()
    want = {i: 0 for i in range(61)} | {100: 100, 200: 100, 150: 100, 170: 100}
    assert {r["id_"]: r["root_"] for r in roots} == want


LONG = "one two three four five six seven eight nine ten."


def test_repeated_units_beside_a_scan(spark):
    rows = [
        (3, f"Alpha beta gamma delta epsilon zeta eta theta iota.\n{LONG}\nshort line"),
        (1, f"start here {LONG.upper()} and a sentence that is long enough to count as one. tail"),
        (8, f"{LONG} {LONG}\nAlpha  beta gamma delta epsilon zeta ETA theta iota."),
        (5, ""), (6, None), (7, "short line"), (None, LONG), (2, "x" * 50_000),
    ]
    docs = spark.createDataFrame([(i, t, 0, "x", "y") for i, t in rows], DOCS)
    ranked = sorted(((i if i is not None else 2**63), *u) for i, t in rows for u in repeats.units(t))
    seen, want = {}, set()
    for rank, level, start, end, n, body in sorted(ranked, key=lambda u: (u[0], u[2], u[1])):
        if body in seen:
            want.add((rank, level, start, end, n, seen[body]))
        seen.setdefault(body, rank)
    got = repeats.repeated_units(docs).collect()
    assert {(2**63 if r["doc_id"] is None else r["doc_id"], r["level"], r["start"], r["end"], r["n_words"], r["keeper"]) for r in got} == want
    assert len(got) == len(want) > 0
    texts = {i: t for i, t in rows}
    for r in got:
        assert len(texts[r["doc_id"]][r["start"] : r["end"]].split()) == r["n_words"]
    cleaned = repeats.remove_units(docs, repeats.repeated_units(docs))
    assert cleaned.columns == docs.columns and cleaned.count() == len(rows)
    after = {r["doc_id"]: r["text"] for r in cleaned.collect()}
    assert after[1] == texts[1] and after[7] == "short line" and after[6] is None and after[None] == ""
    assert "three" not in after[8] and repeats.repeated_units(spark.createDataFrame([], DOCS)).count() == 0


def test_short_lines_and_short_sentences_repeat_too(spark):
    verse = "\n".join(["roses are red", "violets are blue", "sugar is sweet"])
    talk = "He came in late. She said no. They left."
    rows = [
        (1, f"{verse}\n\nMy own first words stand before it. {talk}\n這是一行沒有空格的文字"),
        (2, f"Quite other words.\n\n{verse}\n\nYours. {talk} And something else comes after."),
        (3, "這是一行沒有空格的文字"), (4, verse.replace("\n", " ")), (5, "no no. " * 30),
    ]
    docs = spark.createDataFrame([(i, t, 0, "x", "y") for i, t in rows], DOCS)
    cleaned = repeats.remove_units(docs, repeats.repeated_units(docs, least_line=1))
    after = {r["doc_id"]: r["text"] for r in cleaned.collect()}
    assert after[1] == rows[0][1] and after[3] == after[4] == ""
    assert "roses" not in after[2] and "late" not in after[2] and "left" not in after[2]
    assert after[2].startswith("Quite other words.") and after[2].endswith("And something else comes after.")
    assert after[5].count("no no.") in range(4, 8)
    # paragraphs of short lines count without short lines, too
    assert {r["level"] for r in repeats.repeated_units(docs).filter("doc_id = 2").collect()} == {"paragraph", "sentence"}


def test_texts_of_one_id_are_tied(spark):
    x, y, z = ("one two three four five six seven eight " + w for w in ("x", "other words entirely here y", "and nothing shared at all z"))
    y = " ".join(reversed(y.split()))
    rows = [(5, x), (7, x), (5, y), (3, y), (9, z)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {(r.doc_id, r.component_id) for r in neardup.near_duplicates(docs, words=2).collect()}
    assert got == {(5, 3), (7, 3), (3, 3), (9, 9)}
    assert sorted(r.doc_id for r in neardup.keep_one(docs, words=2).collect()) == [3, 9]


def test_scratch_tables_are_removed(spark, folder, monkeypatch):
    import os

    from stratalog.llm import common

    monkeypatch.setattr(common, "scratch_path", lambda spark, label: f"{folder}/{label}-{len(os.listdir(folder))}")
    docs = spark.createDataFrame([(i, f"a b c d e f {i % 3}") for i in range(9)], "doc_id bigint, text string")
    assert neardup.near_duplicates(docs).count() == 9
    assert [name.split("-")[0] for name in os.listdir(folder)] == ["near"]
