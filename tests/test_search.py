"""Search ranking, folding and trigrams."""

import math
import random

import pytest
from pyspark.sql import functions as F

from stratalog.functions import text as tx
from stratalog.model import Catalog, EntityType, QueryError, Schema, Slot
from stratalog.operators import search as se

SCHEMA = Schema(
    (
        EntityType("Note", (Slot("name", searchable=True), Slot("tissue"), Slot("priority", "integer"), Slot("body", searchable=True))),
        EntityType("Plain", (Slot("name"),)),
    )
)
NOTES = [
    ("n1", True, "one", "brain", 3, "cortex a b c d e"),
    ("n2", True, "two", "brain", 1, "cortex cortex b c d e"),
    ("n3", True, "three", None, 2, "cortex cortex cortex c d e"),
    ("n4", False, "four", "brain", 9, "cortex cortex cortex cortex d e"),
    ("n5", True, "five", "liver", 4, "Hépatique FOIE, foie-gras"),
]


@pytest.fixture(scope="module")
def catalog(spark):
    notes = spark.createDataFrame(NOTES, "id string, is_available boolean, name string, tissue string, priority bigint, body string")
    plain = spark.createDataFrame([("p1", True, "cortex")], "id string, is_available boolean, name string")
    return Catalog(SCHEMA, {"Note": notes, "Plain": plain})


def found(df):
    return [r[0] for r in df.collect()]


def test_rank_follows_term_frequency(catalog):
    hits = se.search_phrase_bm25(catalog.table("Note"), "body", "cortex").collect()
    assert [h.entity_id for h in hits] == ["n3", "n2", "n1"]
    assert hits[0].score == 1.0 and hits[2].score < hits[1].score < 1
    cut = se.search_phrase_bm25(catalog.table("Note"), "body", "cortex", min_score=hits[1].score)
    assert cut.count() == 2
    assert se.search_phrase_bm25(catalog.table("Note"), "body", "cortex", limit=1).count() == 1
    assert se.search_phrase_bm25(catalog.table("Note"), "body", "cortex", limit=0).count() == 0
    assert se.search_phrase_bm25(catalog.table("Note"), "body", "cortex", limit=None).count() == 3
    with pytest.raises(QueryError):
        se.search_phrase_bm25(catalog.table("Note"), "body", "cortex", limit=-1)


def test_no_hit_is_cut(spark):
    rows = spark.range(3000).selectExpr("id", "true AS is_available", "'cortex' AS name", "'' AS tissue", "id AS priority", "'' AS body")
    many = Catalog(SCHEMA, {"Note": rows})
    late = [{"field": "priority", "op": "gte", "value": 1500}]
    page = se.search_entities(many, "Note", "cortex", 20, 1000, filters=late).collect()
    assert [r.id for r in page] == list(range(2500, 2520)) and page[0].total_count == 1500
    hits = se.search_phrase_bm25(rows, "name", "cortex", limit=None)
    assert hits.count() == 3000 and se.top_k_hits(hits, 2000).count() == 2000


def test_stems_on_either_side(catalog):
    notes = catalog.table("Note")
    assert [tx.light_stem_of(w) for w in ("rings", "walking", "bed", "boxes", "class")] == ["ring", "walk", "bed", "box", "clas"]
    assert found(se.search_stemmed_and(notes, "body", "cortexes b")) == ["n2", "n1"]
    assert found(se.search_stemmed_and(notes, "body", "")) == []


def test_phrases_are_consecutive_and_folded(catalog):
    notes = catalog.table("Note")
    assert found(se.search_phrase_bm25(notes, "body", "cortex b")) == ["n2"]
    assert found(se.search_phrase_bm25(notes, "body", "hepatique foie")) == ["n5"]
    assert found(se.search_phrase_bm25(notes, "body", "foie gras")) == ["n5"]
    assert found(se.search_phrase_bm25(notes, "body", '"-*:')) == []


def test_search_composes_with_filters(catalog):
    rows = se.search_entities(catalog, "Note", "cortex").collect()
    assert [r.id for r in rows] == ["n3", "n2", "n1"] and rows[0].total_count == 3
    either = [{"tissue": "liver"}, {"priority": 1}]
    assert [r.id for r in se.search_entities(catalog, "Note", "cortex", filters=either, filter_mode="or").collect()] == ["n2"]
    tree = {"not": {"field": "tissue", "op": "eq", "value": "brain"}}
    assert [r.id for r in se.search_entities(catalog, "Note", "cortex", where=tree).collect()] == ["n3"]
    by = se.search_entities(catalog, "Note", "cortex", 2, 1, order_by="priority", order_dir="desc").collect()
    assert [r.id for r in by] == ["n3", "n2"] and by[0].total_count == 3
    assert se.search_entities(catalog, "Note", "cortex", limit=0).count() == 0
    assert se.search_entities(catalog, "Plain", "cortex").count() == 0
    with pytest.raises(QueryError):
        se.search_entities(catalog, "Note", "cortex", order_by="nope")


def test_search_all_skips_unsearchable(catalog):
    rows = se.search_all_classes(catalog, "cortex", 2).collect()
    assert [(r.entity_type, r.entity_id) for r in rows] == [("Note", "n3"), ("Note", "n2")]
    assert se.search_all_classes(catalog, "cortex", 0).count() == 0


def test_plain_and_trigram_fallback(catalog):
    notes = catalog.table("Note")
    assert sorted(found(se.search_plain_and(notes, "body", "e cortex b"))) == ["n1", "n2"]
    assert found(se.search_trigram(notes, "body", "hepatiqe foi", threshold=0.1)) != []
    assert found(se.search_boolean(notes, "body", ["cortex", "b"], "NOT")) == ["n3"]
    assert found(se.search_boolean(notes, "body", ["cort"], prefix=True)) == ["n1", "n2", "n3"]
    assert found(se.search_raw_content(notes, "body", "cortex b")) == ["n2"]


def brute_phrase(tokens, phrase):
    return sum(tokens[i : i + len(phrase)] == phrase for i in range(len(tokens) - len(phrase) + 1))


def test_bm25_and_postings_match_brute_force(spark, folder):
    rng = random.Random(5)
    docs = [(i, True, " ".join(rng.choice(["a", "b", "ab", "c"]) for _ in range(rng.randrange(1, 40)))) for i in range(60)]
    df = spark.createDataFrame(docs, "id bigint, is_available boolean, body string")
    se.write_fts_index(se.build_fts_index(df, "body"), folder + "/idx")
    postings = spark.read.parquet(folder + "/idx")
    lengths = df.select(F.col("id").alias("entity_id"), F.size(tx.tokens(F.col("body"))).alias("doc_len"))
    for phrase in (["a"], ["a", "a"], ["a", "b", "a"], ["c", "c", "c", "c"]):
        freq = {i: brute_phrase(t.split(), phrase) for i, _, t in docs}
        hits = sum(f > 0 for f in freq.values())
        avg = sum(len(t.split()) for _, _, t in docs) / len(docs)
        idf = max(math.log((len(docs) - hits + 0.5) / (hits + 0.5)), 1e-6)
        raw = {
            i: idf * freq[i] * 2.2 / (freq[i] + 1.2 * (0.25 + 0.75 * len(t.split()) / avg))
            for i, _, t in docs if freq[i]
        }
        want = {i: r / max(raw.values()) for i, r in raw.items()}
        for got in (
            se.search_phrase_bm25(df, "body", " ".join(phrase)),
            se.search_index_phrase(postings, lengths, " ".join(phrase)),
        ):
            scores = {r.entity_id: r.score for r in got.collect()}
            assert scores.keys() == want.keys()
            assert all(abs(scores[i] - want[i]) < 1e-9 for i in want)


@pytest.mark.parametrize("a, b", [("word", "two words"), ("Straße 12", "strasse 12"), ("", "x"), ("abc", "abc")])
def test_trigram_similarity(spark, a, b):
    x, y = set(tx.trigram_set(a)), set(tx.trigram_set(b))
    want = len(x & y) / len(x | y) if x | y else 0.0
    got = spark.range(1).select(tx.trigram_similarity(F.lit(a), b).alias("s")).first().s
    assert abs(got - want) < 1e-12


def test_known_similarity(spark):
    # The documented example: 'word' and 'two words' share 4 of 11 trigrams.
    got = spark.range(1).select(tx.trigram_similarity(F.lit("word"), "two words").alias("s")).first().s
    assert abs(got - 4 / 11) < 1e-12


def test_fold_matches_query_folding(spark):
    for text in ("Éèê çà ÑANDÚ", "ẞ Ångström", "naïve-café_1", "Ελλάδα", "éa"):
        row = spark.range(1).select(tx.folded_tokens_text(F.lit(text)).alias("t")).first().t
        assert row.split() == tx.query_tokens(text)


def test_content_and_scores(spark):
    df = spark.createDataFrame([(1, "a", None), (2, None, None), (3, "a", "b")], "id int, x string, y string")
    got = [r.c for r in df.orderBy("id").select(se.fts_content(["x", "y"]).alias("c")).collect()]
    assert got == ["a", None, "a b"]
    one = spark.range(1).select(tx.logistic_score(F.lit(0.0)).alias("s")).first().s
    assert one == 0.5


def test_boolean_and_stemmed_search_fold_a_text_once(spark):
    texts = ["The cat", "thé  dogs, and", "and so", "...", "", None, "\u212aelvin the", "bathe", "walking the dog", "WALKED, Th\u00e9 d\u00f3gs walks"]
    rows = spark.createDataFrame([(i, True, t) for i, t in enumerate(texts)], "id bigint, is_available boolean, text string")

    def found(*args, **more):
        hits = se.search_boolean(rows, "text", *args, **more)
        assert hits._jdf.queryExecution().optimizedPlan().toString().count("translate(") == 1
        return sorted(r[0] for r in hits.collect())

    assert found(["the", "and"], "AND") == [1]
    assert found(["the", "and"], "NOT") == [0, 6, 8, 9]
    assert found(["kelvin", "so"], "OR") == [2, 6]
    assert found(["wal"], prefix=True) == [8, 9]
    stemmed = se.search_stemmed_and(rows, "text", "walks dog", None)
    assert "translate(" not in stemmed._jdf.queryExecution().optimizedPlan().toString()  # ranked from narrow rows
    assert [(r.entity_id, round(r.score, 6)) for r in stemmed.collect()] == [(9, 1.0), (8, round(0.5 / 0.6, 6))]
