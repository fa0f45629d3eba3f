"""The stored full-text index beside one built anew, over deltas, tombstones and compaction."""

import pytest
from pyspark.sql import functions as F

from stratalog.functions import text as tx
from stratalog.model import QueryError
from stratalog.operators import search as se
from stratalog.sources import fts

ROW = "id bigint, is_available boolean, body string"
START = [(i, True, f"Blue ring {i} blue sky" if i % 2 else f"old ring of fire {i}") for i in range(20)] + [(90, False, "blue ring"), (91, True, ""), (92, True, None)]
WRITES = [
    [(1, True, "quite new words"), (2, False, "old ring of fire 2"), (50, True, "blue ring blue ring"), (90, True, "blue ring back")],
    [(1, True, "Blue ring again"), (50, True, "blue"), (3, True, None), (77, False, "never seen")],
    [],
]


def rows_of(df):
    return sorted((r.term, r.entity_id, r.tf, r.doc_len, tuple(r.positions)) for r in df.collect())


def test_index_follows_writes(spark, folder, monkeypatch):
    with pytest.raises(QueryError):
        fts.add(spark.createDataFrame(WRITES[0], ROW), "body", folder)
    fts.create(spark.createDataFrame(START, ROW), "body", folder)
    now = {r[0]: r for r in START}
    for number, write in enumerate(WRITES, start=1):
        now |= {r[0]: r for r in write}
        assert fts.add(spark.createDataFrame(write, ROW), "body", folder) == number
        table = spark.createDataFrame(list(now.values()), ROW)
        assert rows_of(fts.postings(spark, folder)) == rows_of(se.build_fts_index(table, "body"))
        for phrase in ("blue ring", "ring", "old ring of fire", "absent"):
            got = [(r.entity_id, round(r.score, 9)) for r in fts.search_phrase(spark, folder, phrase).collect()]
            want = [(r.entity_id, round(r.score, 9)) for r in se.search_phrase_bm25(table, "body", phrase).collect()]
            assert got == want, phrase
    content = se.content_rows(table, "body")
    assert fts.totals(spark, folder) == (content.count(), content.agg(F.sum(tx.count_tokens(F.col("content")))).first()[0])
    before = rows_of(fts.postings(spark, folder))
    monkeypatch.setattr(fts, "MOST_PARTS", 4)
    fts.add(spark.createDataFrame([], ROW), "body", folder)  # compacts first
    assert len(fts.parts_of(spark, folder)) == 2 and rows_of(fts.postings(spark, folder)) == before


def test_a_part_that_stops_does_not_count(spark, folder, monkeypatch):
    fts.create(spark.createDataFrame(START, ROW), "body", folder)
    before = rows_of(fts.postings(spark, folder))
    with monkeypatch.context() as broken:
        broken.setattr(fts, "_publish", lambda *a: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            fts.add(spark.createDataFrame(WRITES[0], ROW), "body", folder)
    assert rows_of(fts.postings(spark, folder)) == before
    assert fts.add(spark.createDataFrame(WRITES[0], ROW), "body", folder) == 1


def test_lookup_reads_only_the_terms(spark, folder):
    fts.create(spark.createDataFrame(START, ROW), "body", folder)
    plan = fts.postings(spark, folder, ["blue"])._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in plan and ("In(term" in plan or "EqualTo(term,blue)" in plan)


@pytest.mark.parametrize("text", ["a b", "", " ", "x́ y", "́", "a ́ b", "á̂b", "́a", "İstanbul ẞ", "42,x-y_z", " p"])
def test_counts_tokens_as_folding_does(spark, text):
    row = spark.createDataFrame([(text,)], "t string").select(tx.count_tokens(F.col("t")).alias("n"), F.size(tx.tokens(F.col("t"))).alias("m")).first()
    assert row.n == row.m


def test_postings_within_rows_equal_grouped_ones_without_an_exchange(spark):
    texts = ["de la de la", "", "...", "One", "a b a c a b", "Été ete ÉTÉ x1 y_2", " ".join(f"w{i % 700}" for i in range(5000))]
    content = spark.createDataFrame(list(enumerate(texts)), "entity_id bigint, content string")
    found = se.postings_in_rows(content)
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    rows = found.collect()
    assert {r.entity_id: r.doc_len for r in rows} == {0: 4, 1: 0, 2: 0, 3: 1, 4: 6, 5: 6, 6: 5000}
    got = sorted((p.term, r.entity_id, p.tf, r.doc_len, tuple(p.positions)) for r in rows for p in r.postings)
    assert got == sorted((*tuple(r)[:4], tuple(r.positions)) for r in se.postings_of(content).collect())
