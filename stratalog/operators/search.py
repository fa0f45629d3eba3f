"""Full-text search over entity tables.

A query scans the text column with JVM expressions; only hits are ranked, and all
of them unless the caller gives a limit. ``build_fts_index`` and
``write_fts_index`` keep postings for repeated use.
"""

from __future__ import annotations

from functools import reduce
from operator import and_, or_
from typing import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from ..model import Catalog, QueryError, union_all
from ..runtime import stable
from .read import find, ordering, page
from .temporal import temporal_summary_of


def fts_content(columns: Iterable[str]) -> Column:
    """Present fields joined by blanks, NULL when there is none."""
    joined = F.concat_ws(" ", *[F.when(F.col(c) != "", F.col(c)) for c in columns])
    return F.when(joined != "", joined)


def content_rows(entities: DataFrame, field: str) -> DataFrame:
    """``(entity_id, content)`` of live rows that have content."""
    return entities.where(F.col("is_available") & (F.col(field) != "")).select(
        F.col("id").alias("entity_id"), F.col(field).alias("content")
    )


def build_fts_index(entities: DataFrame, field: str) -> DataFrame:
    """Postings ``(term, entity_id, tf, doc_len, positions)``.

    Token streams explode to one row each and regroup by (term, entity), so a
    frequent term is spread over its entities rather than gathered.
    """
    return postings_of(content_rows(entities, field))


def postings_of(content: DataFrame) -> DataFrame:
    """Postings of ``content(entity_id, content)``."""
    rows = content.withColumn("toks", tx.tokens(F.col("content")))
    return (
        rows.select("entity_id", F.size("toks").alias("doc_len"), F.posexplode("toks").alias("pos", "term"))
        .groupBy("term", "entity_id", "doc_len")
        .agg(F.count("*").alias("tf"), F.array_sort(F.collect_list("pos")).alias("positions"))
        .select("term", "entity_id", "tf", "doc_len", "positions")
    )


def postings_in_rows(content: DataFrame) -> DataFrame:
    """(entity_id, doc_len, postings) of each text, with postings (term, tf, positions) as
    :func:`postings_of` gives them where ids do not repeat: (term, position) pairs are sorted within
    the row and cut where the term changes, so a text is folded once and no token is shuffled."""
    pairs = F.array_sort(F.transform(tx.tokens(F.col("content")), lambda term, at: F.struct(term.alias("term"), at.alias("at"))))
    term = lambda i: F.get(F.col("pairs"), i)["term"]
    starts = F.filter(F.transform("pairs", lambda _, i: i), lambda i: (i == 0) | (term(i) != term(i - 1)))
    once = lambda *columns: F.inline(F.array(F.struct(*columns)))  # computed here, not again at every use
    sorted_ = content.select("entity_id", once(pairs.alias("pairs")))
    begun = sorted_.select("entity_id", "pairs", once(starts.alias("starts"), F.col("pairs.at").alias("places")))
    end = lambda n: F.coalesce(F.get("starts", n + 1), F.size("pairs"))
    cut = F.transform(
        "starts",
        lambda i, n: F.struct(term(i).alias("term"), (end(n) - i).cast("long").alias("tf"), F.slice("places", i + 1, end(n) - i).alias("positions")),
    )
    return begun.select("entity_id", F.size("pairs").alias("doc_len"), cut.alias("postings"))


def write_fts_index(postings: DataFrame, path: str) -> None:
    """Store postings sorted by term, so a term lookup skips most row groups.

    The range runs over (term, entity), so a very frequent term fills several
    files instead of one task.
    """
    (
        postings.repartitionByRange("term", "entity_id")
        .sortWithinPartitions("term", "entity_id")
        .write.mode("overwrite")
        .parquet(path)
    )


def _shifted(positions: Column, place: int) -> Column:
    return F.transform(positions, lambda x: x - place)


def search_index_phrase(
    postings: DataFrame, content: DataFrame, query: str, min_score: float = 0.0, limit: int | None = 100
) -> DataFrame:
    """The phrase search over postings; ``content(entity_id, doc_len)`` gives the number
    and mean length of rows. ``sources.fts`` keeps both with a stored index."""
    row = content.agg(F.count("*").alias("rows"), F.avg("doc_len").alias("average")).first()
    return rank_postings(postings, query, row.rows, row.average or 0.0, min_score, limit)


def rank_postings(
    postings: DataFrame, query: str, rows: int, average: float, min_score: float = 0.0, limit: int | None = 100
) -> DataFrame:
    """Phrase hits from postings, ranked by BM25 over ``rows`` texts of ``average`` length.

    Only postings of the phrase's terms are read (a pushed ``IN`` on the sorted
    term column). Per entity they regroup to at most one position list per term;
    a phrase starts where all lists, shifted by their place, share a position. The
    hits, narrow rows, are written once and ranked from there.
    """
    terms = tx.query_tokens(query)
    words = list(dict.fromkeys(terms))
    if not words:
        return postings.select("entity_id", F.lit(0.0).alias("score")).limit(0)
    lists = [
        F.max(F.when(F.col("term") == w, F.col("positions"))).alias(f"p{i}") for i, w in enumerate(words)
    ]
    grouped = postings.where(F.col("term").isin(words)).groupBy("entity_id").agg(F.max("doc_len").alias("length"), *lists)
    for i in range(len(words)):
        grouped = grouped.where(F.col(f"p{i}").isNotNull())
    starts = F.col(f"p{words.index(terms[0])}")
    for place, term in enumerate(terms[1:], start=1):
        starts = F.array_intersect(starts, _shifted(F.col(f"p{words.index(term)}"), place))
    found = stable(grouped.select("entity_id", "length", F.size(starts).alias("freq")).where(F.col("freq") > 0))
    hits = found.count()
    weight = tx.bm25_weight(F.col("freq"), F.col("length"), F.lit(float(average)))
    scored = found.select("entity_id", (tx.idf(F.lit(rows), F.lit(hits)) * weight).alias("raw"))
    return normalised_top(scored, limit, min_score)


def sync_fts(content: DataFrame, changed: DataFrame, field: str) -> DataFrame:
    """Content rows after a write: changed ids replaced, gone or empty ones removed."""
    touched = changed.select(F.col("id").alias("entity_id"))
    return content.join(touched, "entity_id", "left_anti").unionByName(content_rows(changed, field))


def _scored(entities: DataFrame, field: str, query: str) -> DataFrame:
    """Hits ``(entity_id, raw)`` with BM25 over the live rows of one field."""
    terms = tx.query_tokens(query)
    content = F.col("content")
    freq = tx.phrase_frequency(tx.folded_tokens_text(content), terms)
    # the texts are read once; statistics, best score and hits come from narrow rows
    measured = stable(
        content_rows(entities, field).select(
            "entity_id", F.when(tx.may_hold(content, terms), freq).otherwise(F.lit(0)).alias("freq"), tx.count_tokens(content).alias("length")
        )
    )
    stats = measured.agg(
        F.struct(
            F.count("*").alias("rows"),
            F.count(F.when(F.col("freq") > 0, 1)).alias("hits"),
            F.avg("length").alias("average"),
        )
    ).scalar()
    hits = measured.where(F.col("freq") > 0).withColumn("stats", stats)
    weight = tx.bm25_weight(F.col("freq"), F.col("length"), F.col("stats.average"))
    return hits.select("entity_id", (tx.idf(F.col("stats.rows"), F.col("stats.hits")) * weight).alias("raw"))


def first_rows(ordered: DataFrame, limit: int | None) -> DataFrame:
    """The first ``limit`` rows; None is all of them, a negative number is refused."""
    if limit is None:
        return ordered
    if limit < 0:
        raise QueryError(f"limit must not be negative, got {limit}")
    return ordered.limit(limit)


def normalised_top(scored: DataFrame, limit: int | None, min_score: float = 0.0) -> DataFrame:
    """Hits by their share of the best score, best first."""
    top = scored.agg(F.max("raw")).scalar()
    rated = scored.withColumn("top", top).select(
        "entity_id", F.when(F.col("top") > 0, F.col("raw") / F.col("top")).otherwise(F.lit(0.0)).alias("score")
    )
    return first_rows(rated.where(F.col("score") >= min_score).orderBy(F.col("score").desc(), "entity_id"), limit)


def search_phrase_bm25(
    entities: DataFrame, field: str, query: str, min_score: float = 0.0, limit: int | None = 100
) -> DataFrame:
    """Phrase match ranked by BM25, best hit scoring 1."""
    return normalised_top(_scored(entities, field, query), limit, min_score)


def top_k_hits(scored: DataFrame, k: int | None) -> DataFrame:
    """Best k hits by score, then id."""
    return first_rows(scored.orderBy(F.col("score").desc(), "entity_id"), k)


def best_score_per_entity(hits: DataFrame) -> DataFrame:
    """Max score per entity; ``seen`` (the field's position) breaks ties."""
    return hits.groupBy("entity_id").agg(F.max("score").alias("score"), F.min("seen").alias("seen"))


def _field_hits(catalog: Catalog, entity_type: str, query: str) -> DataFrame:
    """All hits of every searchable field; nothing is cut before filters apply."""
    parts = []
    for position, slot in enumerate(catalog.schema.searchable(entity_type)):
        hits = search_phrase_bm25(catalog.table(entity_type), slot.name, query, limit=None)
        parts.append(hits.withColumn("seen", F.lit(position)))
    return union_all(parts)


def search_entities(
    catalog: Catalog,
    entity_type: str,
    query: str,
    limit: int | None = None,
    offset: int | None = None,
    filters: Iterable[dict] = (),
    filter_mode: str = "and",
    where: dict | None = None,
    order_by: str | None = None,
    order_dir: str = "asc",
    with_times: bool = True,
) -> DataFrame:
    """Ranked hits of a class that also satisfy filters and tree, paged, with the
    total of all of them. With a log, hits carry their temporal fields."""
    if not catalog.schema.searchable(entity_type):
        return catalog.live(entity_type).limit(0)
    best = best_score_per_entity(_field_hits(catalog, entity_type, query))
    matched = find(catalog, entity_type, filters, filter_mode, where).join(
        best.withColumnRenamed("entity_id", "id"), "id"
    )
    total = matched.agg(F.count("*")).scalar()
    if order_by is not None:
        ordered = matched.orderBy(*ordering(matched, order_by, order_dir))
    else:
        ordered = matched.orderBy(F.col("score").desc(), "seen", "id")
    hits = page(ordered, limit, offset).withColumn("total_count", total).drop("seen")
    if catalog.log is None or not with_times:
        return hits
    times = temporal_summary_of(catalog.log, hits.select(F.col("id").alias("entity_id")))
    joined = hits.join(times.withColumnRenamed("entity_id", "id"), "id", "left")
    if order_by is not None:
        return joined.orderBy(*ordering(joined, order_by, order_dir))
    return joined.orderBy(F.col("score").desc(), "id")


def search_all_classes(catalog: Catalog, query: str, limit: int | None = 100) -> DataFrame:
    """Best hits over every searchable class: score desc, type, id."""
    parts = []
    for name in catalog.tables:
        if catalog.schema.searchable(name):
            best = best_score_per_entity(_field_hits(catalog, name, query)).drop("seen")
            live = catalog.live(name).select(F.col("id").alias("entity_id"))
            parts.append(best.join(live, "entity_id", "left_semi").withColumn("entity_type", F.lit(name)))
    return first_rows(union_all(parts).orderBy(F.col("score").desc(), "entity_type", "entity_id"), limit)


def search_stemmed_and(entities: DataFrame, field: str, query: str, limit: int | None = 100) -> DataFrame:
    """All words must occur by their stem, in any order, ranked like :func:`search_plain_and`.

    A stem is a word without its ending (:func:`text.light_stem`), cut by one JVM
    expression on either side.
    """
    stems = list(dict.fromkeys(tx.light_stem_of(w) for w in tx.query_tokens(query)))
    if not stems:
        return entities.select(F.col("id").alias("entity_id"), F.lit(0.0).alias("score")).limit(0)
    # a stem begins its token, so only rows with such tokens are cut into them, and only these are stemmed
    content = F.col("content")
    begun = lambda folded: reduce(and_, [F.contains(folded, F.lit(f" {s}")) for s in stems])
    like = lambda token: reduce(or_, [F.startswith(token, F.lit(s)) for s in stems])
    rows = content_rows(entities, field).where(tx.may_hold(content, stems)).where(tx.folded_test(content, begun))
    cut = F.transform(F.filter(tx.tokens(content), like), tx.light_stem)
    rows = rows.where(F.exists(F.array(cut), lambda found: reduce(and_, [F.array_contains(found, s) for s in stems])))
    rows = rows.select("entity_id", cut.alias("stems"))
    wanted = F.array(*[F.lit(s) for s in stems])
    mean = F.size(F.filter("stems", lambda t: F.array_contains(wanted, t))) / len(stems)
    return normalised_top(stable(rows.select("entity_id", (1 - 1 / (1 + mean)).alias("raw"))), limit)


def search_plain_and(entities: DataFrame, field: str, query: str, limit: int | None = 100) -> DataFrame:
    """All words must occur as they are, in any order; ranked by their frequency.

    The score is ``1 - 1/(1 + mean tf)``, then normalised like the phrase search.
    """
    terms = list(dict.fromkeys(tx.query_tokens(query)))
    folded = content_rows(entities, field).select(
        "entity_id", tx.folded_tokens_text(F.col("content")).alias("folded")
    )
    for term in terms:
        folded = folded.where(F.contains("folded", F.lit(f" {term} ")))
    counts = sum((tx.phrase_frequency(F.col("folded"), [t]) for t in terms), F.lit(0))
    mean = counts / max(len(terms), 1)
    scored = folded.select("entity_id", (1 - 1 / (1 + mean)).alias("raw"))
    return normalised_top(scored if terms else scored.limit(0), limit)


def search_trigram(
    entities: DataFrame, field: str, query: str, limit: int | None = 100, threshold: float = 0.3
) -> DataFrame:
    """Trigram similarity above ``threshold``, most similar first."""
    rows = content_rows(entities, field).select(
        "entity_id", tx.trigram_similarity(F.col("content"), query).alias("score")
    )
    return first_rows(rows.where(F.col("score") > threshold).orderBy(F.col("score").desc(), "entity_id"), limit)


def search_raw_content(entities: DataFrame, field: str, query: str) -> DataFrame:
    """Matching rows ``(entity_id, content)`` unranked."""
    terms = tx.query_tokens(query)
    needle = " " + " ".join(terms) + " "
    rows = content_rows(entities, field)
    return rows.where(F.contains(tx.folded_tokens_text(F.col("content")), F.lit(needle)))


def boolean_match(folded: Column, terms: list[str], operator: str = "AND", prefix: bool = False) -> Column:
    """Terms joined AND / OR / NOT (first term without the others), or by prefix."""
    parts = []
    for term in terms:
        token = " ".join(tx.query_tokens(term))
        parts.append(F.contains(folded, F.lit(f" {token}" if prefix else f" {token} ")))
    out = parts[0]
    for part in parts[1:]:
        out = {"AND": lambda: out & part, "OR": lambda: out | part, "NOT": lambda: out & ~part}[operator]()
    return out


def search_boolean(
    entities: DataFrame, field: str, terms: list[str], operator: str = "AND", prefix: bool = False
) -> DataFrame:
    """Ids of live rows that :func:`boolean_match` finds; each text is folded once."""
    rows = content_rows(entities, field)
    if operator != "OR":  # a cheap look for what every hit holds
        needed = terms if operator == "AND" else terms[:1]
        rows = rows.where(tx.may_hold(F.col("content"), [w for t in needed for w in tx.query_tokens(t)]))
    return rows.where(tx.folded_test(F.col("content"), lambda f: boolean_match(f, terms, operator, prefix))).select("entity_id")
