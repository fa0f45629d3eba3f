"""Decontamination, archive and neighbours beside brute force."""

import base64
import hashlib
import os
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from stratalog.llm import ann, archive, decontaminate

DOCS = "doc_id long, text string, grams string, item_id string, key string"
BENCH = "item_id long, text string, doc_id long"


def words_of(text):
    return [w for w in re.findall(r"[^\W_]+", (text or "").lower())]


def grams_of(words, size):
    return Counter(tuple(words[i : i + size]) for i in range(len(words) - size + 1))


def leaks(docs, items):
    """Best window of every item in every text, over all starts."""
    out = {}
    for d, text in docs:
        words = words_of(text)
        for i, item in items:
            own = words_of(item)
            if not own:
                continue
            size = min(5, len(own))
            want, best = grams_of(own, size), 0.0
            for start in range(max(1, len(words) - size + 1)):
                window = grams_of(words[start : start + len(own)], size)
                common = sum((window & want).values())
                total = sum((window | want).values())
                best = max(best, common / total if total else 0.0)
            if best >= 0.8:
                out[(d, i)] = best
    return out


def test_leaks_beside_all_windows(spark):
    draw = np.random.default_rng(8)
    text = lambda n: " ".join("v%d" % draw.integers(0, 3000) for _ in range(n))
    items = [(i, text(int(draw.integers(20, 70)))) for i in range(20)] + [(20, "three short words"), (21, ""), (22, None), (23, "same same same same same same same")]
    docs = []
    for i in range(40):
        item = items[i % 20][1].split()
        body = text(150).split()
        if i % 4 == 1:
            item[len(item) // 2] = "edited"
        if i % 4 == 2:
            item = item[: len(item) // 2]
        if i % 4 == 3:
            item = [w.upper() + "," for w in item[:-1]]
        at = int(draw.integers(0, 150))
        docs.append((i, " ".join(body[:at] + item + body[at:])))
    docs += [(50, "x three, SHORT words."), (51, ""), (52, None), (53, "same " * 300), (54, items[0][1]), (55, text(30_000)), (None, items[1][1])]
    frame = spark.createDataFrame([(i, t, "c", "c", "c") for i, t in docs] + [(54, items[0][1], "d", "d", "d")], DOCS)
    bench = spark.createDataFrame([(i, t, 1) for i, t in items], BENCH)
    got = decontaminate.contaminated(frame, bench).collect()
    want = leaks([d for d in docs if d[0] != 55], items)
    assert {(r["doc_id"], r["item_id"]): round(r["similarity"], 9) for r in got} == {k: round(v, 9) for k, v in want.items()}
    assert len(got) == len(want)
    start = {(r["doc_id"], r["item_id"]): r["start_word"] for r in got}
    assert start[(50, 20)] == 1 and start[(54, 0)] == 0
    kept = decontaminate.drop_contaminated(frame, bench)
    assert kept.columns == frame.columns
    assert {r["doc_id"] for r in kept.collect()} == {d[0] for d in docs} - {d for d, _ in want}
    none, no_items = spark.createDataFrame([], DOCS), spark.createDataFrame([], BENCH)
    assert decontaminate.contaminated(none, bench).count() == 0
    assert decontaminate.contaminated(frame, no_items).count() == 0


def test_leaks_with_repeated_shingles_beside_all_windows(spark):
    items, docs = [], []
    for i in range(10):
        common, run = ["c%dx%d" % (i, k) for k in range(126)], [["and", "no", "la"][i % 3]] * 15
        other = ["o%dx%d" % (i, k) for k in range(15)]
        items.append((i, " ".join(common + run)))
        docs.append((i, " ".join(["before"] * 3 + common + other)))
    want = leaks(docs, items)
    assert len(want) == 10 and all(0.8 <= v < 0.81 for v in want.values())
    frame = spark.createDataFrame([(i, t, "c", "c", "c") for i, t in docs], DOCS)
    got = decontaminate.contaminated(frame, spark.createDataFrame([(i, t, 1) for i, t in items], BENCH)).collect()
    assert {(r["doc_id"], r["item_id"]): round(r["similarity"], 9) for r in got} == {k: round(v, 9) for k, v in want.items()}


def test_leaks_of_moved_passages_beside_all_windows(spark):
    """Windows whose shared shingles all lie at other offsets than in the item, or at the text's end."""
    own, other = lambda n, c: ["%s%d" % (c, k) for k in range(n)], ["z%d" % k for k in range(90)]
    items = [(1, own(90, "a")), (2, own(60, "b")), (3, own(40, "c"))]
    a, b, c = (w for _, w in items)
    docs = [
        (1, other + a[45:] + a[:45] + other), (2, other + b[30:] + b[:30] + other), (3, other + c[:34]),
        (4, other + a[:40] + ["new"] + a[40:] + other), (5, c[6:] + other), (6, b[30:] + b[:30]),
    ]
    docs, items = ([(i, " ".join(w)) for i, w in rows] for rows in (docs, items))
    want = leaks(docs, items)
    assert {(1, 1), (2, 2), (6, 2)} <= set(want)
    frame = spark.createDataFrame([(i, t, "c", "c", "c") for i, t in docs], DOCS)
    got = decontaminate.contaminated(frame, spark.createDataFrame([(i, t, 1) for i, t in items], BENCH)).collect()
    assert {(r["doc_id"], r["item_id"]): round(r["similarity"], 9) for r in got} == {k: round(v, 9) for k, v in want.items()}


def test_repeats_count_as_features_of_their_own(spark):
    frame = spark.createDataFrame([([5, 7, 5, 5, 9],), ([9, 5, 7, 5, 5],), ([5, 7],), ([],)], "grams array<bigint>")
    got = [r[0] for r in frame.select(decontaminate.occurrences(F.col("grams"))).collect()]
    assert len(set(got[0])) == 5 and {5, 7, 9} < set(got[0]) and set(got[0]) == set(got[1])
    assert got[2:] == [[5, 7], []]


def test_blocks_find_every_fingerprint_within_the_radius():
    parts = decontaminate.blocks(20)
    assert len(parts) == 21 and sum(w for _, w in parts) == 64
    draw = np.random.default_rng(0)
    for _ in range(200):
        flips = {int(b) for b in draw.choice(64, 20, replace=False)}
        assert any(not any(a <= b < a + w for b in flips) for a, w in parts)


def test_decontamination_is_native(spark):
    frame = spark.createDataFrame([(1, "a b c d e f", "", "", "")], DOCS)
    plan = decontaminate.contaminated(frame, spark.createDataFrame([(1, "a b c d e f", 1)], BENCH))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Cartesian" not in plan


PAGES = "page_id long, url string, html string, sha256 string, kind string"


def test_archive_round_trip(spark, folder):
    bodies = ["<a>\r\n\r\nüß</a>", "", None, "x" * 200_000, "same", "same", "WARC/1.1\r\nContent-Length: 3\r\n\r\nabc"]
    rows = [(i, f"http://h/{i}\r\nX: y", bodies[i % len(bodies)], "c", "c") for i in range(40, 0, -1)]
    rows += [(None, None, "same", "c", "c"), (None, None, "lonely", "c", "c"), (3, "again", bodies[3], "c", "c")]
    pages = spark.createDataFrame(rows, PAGES).repartition(5)
    path = f"{folder}/archive"
    archive.write_archive(pages, path)
    first = {}
    for i, _, html, *_ in rows:
        body = (html or "").encode()
        first[body] = min(first.get(body, 2**63), 2**63 if i is None else i)
    want = []
    for i, _, html, *_ in rows:
        body = (html or "").encode()
        bearer = None if first[body] == 2**63 else first[body]
        revisit = i != bearer
        want.append((i, len(body), base64.b32encode(hashlib.sha1(body).digest()).decode(), "revisit" if revisit else "response", bearer if revisit else None, True))
    archive.write_warc(spark, path, f"{folder}/warc", file_bytes=1000)
    got = [tuple(r) for r in archive.page_report(spark, f"{folder}/warc").collect()]
    assert sorted(map(str, got)) == sorted(map(str, want))
    stored = spark.read.parquet(f"{path}/payloads")
    assert stored.count() == len(first) and stored.select("sha256").distinct().count() == len(first)
    assert all(r["intact"] for r in archive.verify_payloads(spark, path).collect())

    records = {}
    for r in archive.restore_records(spark, path, payload_of_revisits=True).collect():
        head, body = bytes(r["record"]).split(b"\r\n\r\n", 1)
        length = int(re.search(rb"Content-Length: (\d+)$", head).group(1))
        assert len(body) == length + 4 and body[length:] == b"\r\n\r\n"
        records.setdefault(r["page_id"], []).append(bytes(r["payload"]))
    for i, _, html, *_ in rows:
        assert (html or "").encode() in records[i]

    back = archive.read_warc(spark, f"{folder}/warc").collect()
    again = archive.restore_records(spark, path).collect()
    assert sorted((r["header"], bytes(r["payload"])) for r in back) == sorted((r["header"], bytes(r["payload"])) for r in again)


def test_archive_of_nothing_and_small_payloads(spark, folder):
    archive.write_archive(spark.createDataFrame([], PAGES), f"{folder}/none")
    archive.write_warc(spark, f"{folder}/none", f"{folder}/none-warc")
    assert archive.page_report(spark, f"{folder}/none-warc").count() == 0
    pages = spark.createDataFrame([(1, "u", "ab", "", ""), (2, "u", "ab", "", ""), (3, "u", "abcdef", "", ""), (4, "u", "abcdef", "", "")], PAGES)
    archive.write_archive(pages, f"{folder}/least", least=5)
    archive.write_warc(spark, f"{folder}/least", f"{folder}/least-warc")
    got = {r["page_id"]: (r["record_type"], r["refers_to"], r["verified"]) for r in archive.page_report(spark, f"{folder}/least-warc").collect()}
    assert got == {1: ("response", None, True), 2: ("response", None, True), 3: ("response", None, True), 4: ("revisit", 3, True)}


def test_warc_files_tell_what_is_in_them(spark, folder):
    pages = spark.createDataFrame([(1, "u\r\nv", "abc", "", ""), (2, "u", "abc", "", ""), (3, None, "de", "", "")], PAGES)
    archive.write_archive(pages, f"{folder}/told")
    archive.write_warc(spark, f"{folder}/told", f"{folder}/told-warc")
    rows = archive.read_warc(spark, f"{folder}/told-warc").collect()
    assert any("WARC-Target-URI: u%0D%0Av\r\n" in r["header"] for r in rows)
    # files of other hands, not compressed: a payload that is not what its header says, a lost response
    text = "".join(r["header"] + bytes(r["payload"]).decode().replace("de", "dE") + "\r\n\r\n" for r in rows if "page:1>\r\nWARC-Date" not in r["header"])
    os.mkdir(f"{folder}/other-warc")
    with open(f"{folder}/other-warc/part-1.warc", "w", newline="") as out:
        out.write(text)
    got = {r["page_id"]: r for r in archive.page_report(spark, f"{folder}/other-warc").collect()}
    assert set(got) == {2, 3} and not any(r["verified"] for r in got.values())
    assert got[3]["payload_digest"] == archive.digest_of(b"dE")
    with open(f"{folder}/other-warc/part-2.warc", "w", newline="") as out:
        out.write(text[:-6])
    with pytest.raises(Exception, match="cut off"):
        archive.read_warc(spark, f"{folder}/other-warc").count()


VECTORS = "vec_id long, embedding array<float>, part int, v string"


def brute(rows, asked, k=10):
    ok = [(i, np.array(v, dtype=np.float32).astype(float)) for i, v in rows if i is not None]
    out = {}
    for q, x in ok:
        if asked(q):
            near = sorted((float(np.sqrt(((x - y) ** 2).sum())), i) for i, y in ok if i != q)[:k]
            out[q] = [(i, d) for d, i in near]
    return out


@pytest.mark.parametrize("n", [1, 5, 40, 4000])
def test_neighbours_beside_brute_force(spark, n):
    draw = np.random.default_rng(n)
    centres = draw.normal(size=(12, 16))
    rows = [(i, (centres[i % 12] + 0.5 * draw.normal(size=16)).tolist()) for i in range(n)]
    if n >= 40:
        rows[20:30] = [(i, rows[7][1]) for i in range(20, 30)]
    extra = [(10_000, None), (10_100, [0.0] * 16), (10_200, [float("nan")] * 16), (10_300, [1.0] * 15 + [float("inf")]), (10_400, [1.0, 2.0]), (None, [1.0] * 16), (10_500, [])]
    table = [(i, v, 0, "c") for i, v in rows + extra] + [(10_600, [1.0] * 15 + [None], 0, "c")]
    if n < 40:
        table = [t for t in table if t[1] is None or len(t[1]) == 16]
    frame = spark.createDataFrame(table, VECTORS)
    got = {}
    for r in ann.search(frame, F.col("vec_id") % 20 == 0).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
        assert r["rank"] == len(got[r["query_id"]])
    want = {q: x for q, x in brute(rows, lambda i: i % 20 == 0).items() if x}
    assert got.keys() == want.keys()
    hits = total = 0
    for q in want:
        assert len(got[q]) == len(want[q]) and got[q] == sorted(got[q], key=lambda p: (p[1], p[0]))
        hits += len({i for i, _ in got[q]} & {i for i, _ in want[q]})
        total += len(want[q])
    assert hits >= 0.9 * total
    exact = {(q, i): d for q, x in brute(rows, lambda i: i % 20 == 0, n).items() for i, d in x}
    assert all(abs(exact[q, i] - d) < 1e-12 for q, x in got.items() for i, d in x)


def test_no_vectors(spark):
    assert ann.search(spark.createDataFrame([], VECTORS), F.lit(True)).count() == 0
