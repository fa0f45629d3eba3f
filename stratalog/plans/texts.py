"""Full-text search and scalar functions over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as sc
from ..functions import text as tx
from ..model import Catalog
from ..operators import mutate as mu
from ..operators import search as se
from ..runtime import scratch_path
from ..sources import fts
from .registry import query
from .scans import is_
from .tables import SCHEMA, Tables

TOKS = r"list_filter(regexp_split_to_array(strip_accents(lower({col})), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '')"
DOC_TOKS = f"SELECT id, lang, source, is_available, text, {TOKS.format(col='text')} AS toks FROM document_e"
PART_TOKS = f"SELECT id, name, brand, type, size, is_available, {TOKS.format(col='name')} AS toks, {TOKS.format(col='brand')} AS btoks FROM part_e"


def freq(toks: str, words: list[str]) -> str:
    """Occurrences of consecutive tokens."""
    n = len(words)
    tests = " AND ".join(f"{toks}[i + {j}] = '{w}'" for j, w in enumerate(words))
    return f"len(list_filter(range(1, len({toks}) - {n} + 2), lambda i: {tests}))"


def bm25(source: str, toks: str, words: list[str]) -> str:
    return f"""SELECT id, raw / max(raw) OVER () AS score FROM (
      SELECT id, greatest(ln((rows - hits + 0.5) / (hits + 0.5)), 1e-6)
        * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * len / average)) AS raw FROM (
        SELECT *, count(*) OVER () AS rows, count(*) FILTER (WHERE f > 0) OVER () AS hits, avg(len) OVER () AS average
        FROM (SELECT id, {freq(toks, words)} AS f, len({toks}) AS len FROM ({source}) s WHERE is_available) a) b
      WHERE f > 0) c"""


@query(
    "build_fts_index",
    rf"""SELECT term, id AS entity_id, count(*) AS tf, len AS doc_len FROM (
      SELECT id, len(toks) AS len, unnest(toks) AS term FROM ({DOC_TOKS}) d WHERE is_available AND text <> '') x
    GROUP BY term, id, len""",
)
def build_fts_index(t: Tables):
    return se.build_fts_index(t.role("document_e"), "text").select("term", "entity_id", "tf", F.col("doc_len").cast("bigint").alias("doc_len"))


@query(
    "fts_content",
    """SELECT id, CASE WHEN id % 3 = 0 THEN concat(name, ' ', segment) ELSE name END AS content FROM customer_e""",
)
def fts_content(t: Tables):
    rows = t.role("customer_e").withColumn("segment", F.when(F.col("id") % 3 == 0, F.col("segment")))
    return rows.select("id", se.fts_content(["name", "segment"]).alias("content"))


@query(
    "search_phrase_bm25",
    f"SELECT id AS entity_id, round(score, 8) AS score FROM ({bm25(DOC_TOKS, 'toks', ['de', 'la'])}) x ORDER BY score DESC, id LIMIT 100",
)
def search_phrase_bm25(t: Tables):
    hits = se.search_phrase_bm25(t.role("document_e"), "text", "De LA", limit=100)
    return hits.select("entity_id", F.round("score", 8).alias("score"))


@query(
    "search_term_bm25",
    f"SELECT id AS entity_id, round(score, 8) AS score FROM ({bm25(DOC_TOKS, 'toks', ['the'])}) x WHERE score >= 0.5 ORDER BY score DESC, id LIMIT 50",
)
def search_term_bm25(t: Tables):
    hits = se.search_phrase_bm25(t.role("document_e"), "text", "the", min_score=0.5, limit=50)
    return hits.select("entity_id", F.round("score", 8).alias("score"))


@query(
    "search_index_phrase",
    f"SELECT id AS entity_id, round(score, 8) AS score FROM ({bm25(DOC_TOKS, 'toks', ['de', 'la'])}) x ORDER BY score DESC, id LIMIT 100",
)
def search_index_phrase(t: Tables):
    """The index is built by the first search of a session and stays; later ones only read it."""
    hits = fts.search_phrase(t.spark, stored_index(t), "de la")
    return hits.select("entity_id", F.round("score", 8).alias("score"))


_STORED: dict[tuple[str, str], str] = {}


def stored_index(t: Tables) -> str:
    """The stored index over the documents of a folder, one per session."""
    key = (t.spark.sparkContext.applicationId, t.folder)
    if key not in _STORED:
        path = scratch_path(t.spark, "fts")
        fts.create(t.role("document_e"), "text", path)
        _STORED[key] = path
    return _STORED[key]


UPKEEP = """SELECT id, name FROM (SELECT id, CASE WHEN size <= 10 THEN concat('new ring ', name) ELSE name END AS name,
    CASE WHEN size BETWEEN 11 AND 15 THEN FALSE WHEN size BETWEEN 16 AND 20 THEN TRUE ELSE is_available END AS live, size FROM part_e) x
  WHERE live AND name <> ''"""


@query(
    "fts_upkeep",
    f"""SELECT term, id AS entity_id, to_json(list(pos ORDER BY pos))::VARCHAR AS positions, max(len)::BIGINT AS doc_len FROM (
      SELECT id, len(toks) AS len, unnest(toks) AS term, generate_subscripts(toks, 1) - 1 AS pos FROM (
        SELECT id, {TOKS.format(col="name")} AS toks FROM ({UPKEEP}) u) y) z GROUP BY term, id
    UNION ALL SELECT '(rows, tokens)', count(*), NULL, sum(len(toks))::BIGINT FROM (SELECT {TOKS.format(col="name")} AS toks FROM ({UPKEEP}) v) w""",
)
def fts_upkeep(t: Tables):
    """A base, a delta that renames and one that retires and revives: the index as it then stands."""
    parts = t.role("part_e").select("id", "is_available", "name", "size")
    path = scratch_path(t.spark, "fts")
    fts.create(parts, "name", path)
    fts.add(parts.where("size <= 10").withColumn("name", F.concat(F.lit("new ring "), "name")), "name", path)
    fts.add(parts.where("size BETWEEN 11 AND 20").withColumn("is_available", F.col("size") > 15), "name", path)
    rows, tokens = fts.totals(t.spark, path)
    told = t.spark.createDataFrame([("(rows, tokens)", rows, None, tokens)], "term string, entity_id bigint, positions string, doc_len bigint")
    current = fts.postings(t.spark, path)
    return current.select("term", "entity_id", F.to_json("positions").alias("positions"), F.col("doc_len").cast("bigint").alias("doc_len")).unionByName(told)


NAME_HITS = bm25(PART_TOKS, "toks", ["ring"])


@query(
    "search_entities",
    f"""SELECT p.id, p.name, round(h.score, 8) AS score, count(*) OVER () AS total_count FROM ({NAME_HITS}) h
    JOIN part_e p ON p.id = h.id WHERE p.is_available AND p.size > 20 AND NOT coalesce(p.type = 'STANDARD', FALSE)
    ORDER BY h.score DESC, p.id LIMIT 30 OFFSET 5""",
)
def search_entities(t: Tables):
    rows = se.search_entities(
        t.catalog, "Part", "ring", 30, 5, [is_("size", "gt", 20)], where={"not": is_("type", "eq", "STANDARD")}
    )
    return rows.select("id", "name", F.round("score", 8).alias("score"), "total_count")


@query(
    "search_all_classes",
    f"""SELECT entity_type, entity_id, round(score, 8) AS score FROM (
      SELECT 'Part' AS entity_type, id AS entity_id, score FROM ({bm25(PART_TOKS, 'toks', ['blue'])}) p
      UNION ALL SELECT 'Document', id, score FROM ({bm25(DOC_TOKS, 'toks', ['blue'])}) d) x
    ORDER BY score DESC, entity_type, entity_id LIMIT 200""",
)
def search_all_classes(t: Tables):
    both = Catalog(SCHEMA, {"Part": t.role("part_e"), "Document": t.role("document_e")})
    rows = se.search_all_classes(both, "blue", 200)
    return rows.select("entity_type", "entity_id", F.round("score", 8).alias("score"))


@query(
    "best_score_per_entity",
    """SELECT user_id AS entity_id, max(value) AS score, min(event_id) AS seen FROM events GROUP BY user_id""",
)
def best_score_per_entity(t: Tables):
    hits = t.raw("events").select(
        F.col("user_id").alias("entity_id"), F.col("value").alias("score"), F.col("event_id").alias("seen")
    )
    return se.best_score_per_entity(hits)


@query("top_k_hits", "SELECT event_id AS entity_id, value AS score FROM events ORDER BY value DESC, event_id LIMIT 25")
def top_k_hits(t: Tables):
    return se.top_k_hits(t.raw("events").select(F.col("event_id").alias("entity_id"), F.col("value").alias("score")), 25)


@query(
    "search_plain_and",
    f"""SELECT id AS entity_id, round(raw / max(raw) OVER (), 8) AS score FROM (
      SELECT id, 1 - 1 / (1 + ({freq('toks', ['que'])} + {freq('toks', ['los'])}) / 2.0) AS raw FROM ({DOC_TOKS}) d
      WHERE is_available AND list_contains(toks, 'que') AND list_contains(toks, 'los')) x
    ORDER BY raw DESC, id LIMIT 100""",
)
def search_plain_and(t: Tables):
    hits = se.search_plain_and(t.role("document_e"), "text", "los que")
    return hits.select("entity_id", F.round("score", 8).alias("score"))


@query(
    "search_stemmed_and",
    f"""SELECT id AS entity_id, round(raw / max(raw) OVER (), 8) AS score FROM (
      SELECT id, 1 - 1 / (1 + len(list_filter(stems, lambda x: x IN ('the', 'tion', 'haed'))) / 3.0) AS raw FROM (
        SELECT id, list_transform(toks, lambda x: regexp_replace(x, '{tx.ENDING}', '\\1')) AS stems
        FROM ({DOC_TOKS}) d WHERE is_available) s
      WHERE list_contains(stems, 'the') AND list_contains(stems, 'tion') AND list_contains(stems, 'haed')) x""",
)
def search_stemmed_and(t: Tables):
    hits = se.search_stemmed_and(t.role("document_e"), "text", "the tioning haed", None)
    return hits.select("entity_id", F.round("score", 8).alias("score"))


BRAND_HITS = bm25(PART_TOKS, "btoks", ["brand"])


@query(
    "search_every_hit",
    f"SELECT id AS entity_id, round(score, 8) AS score FROM ({BRAND_HITS}) x",
)
def search_every_hit(t: Tables):
    """A word that nearly every row holds, without a limit."""
    hits = se.search_phrase_bm25(t.role("part_e"), "brand", "brand", limit=None)
    return hits.select("entity_id", F.round("score", 8).alias("score"))


GRAMS = """list_distinct(flatten(list_transform(list_filter(regexp_split_to_array(lower({col}), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> ''),
  lambda w: list_transform(range(1, len(w) + 2), lambda i: substr('  ' || w || ' ', i, 3)))))"""


@query(
    "search_trigram",
    f"""SELECT id AS entity_id, round(score, 8) AS score FROM (
      SELECT id, CAST(len(list_intersect(g, q)) AS DOUBLE) / (len(g) + len(q) - len(list_intersect(g, q))) AS score FROM (
        SELECT id, {GRAMS.format(col='name')} AS g, {GRAMS.format(col="'small rings'")} AS q FROM part_e WHERE is_available) a) b
    WHERE score > 0.3 ORDER BY score DESC, id LIMIT 100""",
)
def search_trigram(t: Tables):
    hits = se.search_trigram(t.role("part_e"), "name", "small rings")
    return hits.select("entity_id", F.round("score", 8).alias("score"))


@query("search_raw_content", f"SELECT id AS entity_id, text AS content FROM ({DOC_TOKS}) d WHERE is_available AND {freq('toks', ['de', 'la'])} > 0")
def search_raw_content(t: Tables):
    return se.search_raw_content(t.role("document_e"), "text", "de la")


@query(
    "search_boolean",
    f"""SELECT id AS entity_id, 'NOT' AS mode FROM ({DOC_TOKS}) d WHERE is_available AND list_contains(toks, 'the') AND NOT list_contains(toks, 'and')
    UNION ALL SELECT id, 'OR' FROM ({DOC_TOKS}) d WHERE is_available AND (list_contains(toks, 'que') OR list_contains(toks, 'und'))
    UNION ALL SELECT id, 'PREFIX' FROM ({DOC_TOKS}) d WHERE is_available AND len(list_filter(toks, lambda x: starts_with(x, 'eau'))) > 0""",
)
def search_boolean(t: Tables):
    docs = t.role("document_e")
    return (
        se.search_boolean(docs, "text", ["the", "and"], "NOT").withColumn("mode", F.lit("NOT"))
        .unionByName(se.search_boolean(docs, "text", ["que", "und"], "OR").withColumn("mode", F.lit("OR")))
        .unionByName(se.search_boolean(docs, "text", ["eau"], prefix=True).withColumn("mode", F.lit("PREFIX")))
    )


@query(
    "sync_fts",
    """SELECT id AS entity_id, CASE WHEN size <= 10 THEN concat(name, ' v2') ELSE name END AS content FROM part_e
    WHERE size <= 10 OR (is_available AND size > 30)""",
)
def sync_fts(t: Tables):
    parts = t.role("part_e").select("id", "is_available", "name", "size")
    content = se.content_rows(parts, "name")
    changed = parts.where("size <= 30").select(
        "id",
        (~F.col("size").between(11, 20)).alias("is_available"),
        F.when(F.col("size") <= 10, F.concat("name", F.lit(" v2"))).otherwise("").alias("name"),
    )
    return se.sync_fts(content, changed, "name")


@query("logistic_score", "SELECT event_id, round(1.0 / (1.0 + exp(-0.5 * (value / 100 - 1.0))), 9) AS score FROM events")
def logistic_score(t: Tables):
    score = tx.logistic_score(F.col("value") / 100, 0.5, 1.0)
    return t.raw("events").select("event_id", F.round(score, 9).alias("score"))


# Scalar functions.

RAW_TEXT = """CASE event_id % 6 WHEN 0 THEN CAST(k AS VARCHAR) WHEN 1 THEN concat(CAST(k AS VARCHAR), '.5')
  WHEN 2 THEN 'TRUE' WHEN 3 THEN 'false' WHEN 4 THEN 'n/a' END"""


def raw_text():
    last, k = F.col("event_id") % 6, F.col("k").cast("string")
    return (
        F.when(last == 0, k).when(last == 1, F.concat(k, F.lit(".5"))).when(last == 2, "TRUE")
        .when(last == 3, "false").when(last == 4, "n/a")
    )


@query("coerce_number", f"SELECT event_id, try_cast({RAW_TEXT} AS DOUBLE) AS number FROM event_k")
def coerce_number(t: Tables):
    return t.event_k.select("event_id", sc.coerce_number(raw_text(), "string").alias("number"))


@query(
    "coerce_boolean",
    f"""SELECT event_id, CASE lower({RAW_TEXT}) WHEN 'true' THEN TRUE WHEN 'false' THEN FALSE END AS from_text,
    k <> 0 AS from_number FROM event_k""",
)
def coerce_boolean(t: Tables):
    return t.event_k.select(
        "event_id", sc.coerce_boolean(raw_text(), "string").alias("from_text"),
        sc.coerce_boolean(F.col("k"), "bigint").alias("from_number"),
    )


@query(
    "coerce_string",
    """SELECT event_id, CAST(k AS VARCHAR) AS from_number, CASE WHEN k > 50 THEN 'True' ELSE 'False' END AS from_flag,
    event_type AS from_text FROM event_k""",
)
def coerce_string(t: Tables):
    return t.event_k.select(
        "event_id", sc.coerce_string(F.col("k"), "bigint").alias("from_number"),
        sc.coerce_string(F.col("k") > 50, "boolean").alias("from_flag"),
        sc.coerce_string(F.col("event_type"), "string").alias("from_text"),
    )


@query(
    "coerce_with_warning",
    f"""SELECT event_id, {RAW_TEXT} AS value, CASE WHEN try_cast({RAW_TEXT} AS DOUBLE) IS NOT NULL
      THEN concat('string ''', {RAW_TEXT}, ''' read as number ', {RAW_TEXT}) END AS warning,
      concat('number written as text ''', CAST(k AS VARCHAR), '''') AS text_warning FROM event_k""",
)
def coerce_with_warning(t: Tables):
    number = sc.coerce_with_warning(raw_text(), "string", "number")
    text = sc.coerce_with_warning(F.col("k"), "bigint", "string")
    return t.event_k.select("event_id", number["value"].alias("value"), number["warning"].alias("warning"), text["warning"].alias("text_warning"))


@query(
    "merge_precedence",
    """SELECT id, CASE WHEN id % 2 = 0 THEN 'override' ELSE name END AS name,
      CASE WHEN id % 3 = 0 THEN -1 ELSE balance END AS balance, segment FROM customer_e""",
)
def merge_precedence(t: Tables):
    rows = t.role("customer_e").select(
        "id",
        F.struct("name", F.struct("balance", "segment").alias("more")).alias("old"),
        F.struct(
            F.when(F.col("id") % 2 == 0, "override").alias("name"),
            F.struct(F.when(F.col("id") % 3 == 0, F.lit(-1.0)).alias("balance"), F.lit(None).cast("string").alias("segment")).alias("more"),
        ).alias("new"),
    )
    merged = sc.merge_precedence([F.col("old"), F.col("new")], rows.schema["old"].dataType)
    return rows.select("id", merged.alias("m")).select("id", "m.name", "m.more.balance", "m.more.segment")


@query(
    "parse_iso_utc",
    """SELECT event_id, CASE event_id % 5 WHEN 0 THEN ts WHEN 1 THEN ts WHEN 2 THEN ts - INTERVAL 150 MINUTE
      WHEN 3 THEN date_trunc('day', ts) END AS stamp FROM events""",
)
def parse_iso_utc(t: Tables):
    last = F.col("event_id") % 5
    iso = F.replace(F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS"), F.lit(" "), F.lit("T"))
    text = (
        F.when(last == 0, iso).when(last == 1, F.concat(iso, F.lit("Z"))).when(last == 2, F.concat(iso, F.lit("+02:30")))
        .when(last == 3, F.substring(iso, 1, 10)).otherwise("yesterday")
    )
    return t.raw("events").select("event_id", sc.parse_iso_utc(text).alias("stamp"))


@query(
    "json_extract",
    "SELECT id, CAST(entity_id AS VARCHAR) AS source_id, k AS target_id FROM log_e WHERE operation = 'relationship_add'",
)
def json_extract(t: Tables):
    adds = t.log.where("operation = 'relationship_add'")
    return adds.select(
        "id", sc.json_extract(F.col("patch"), "$.source_id").alias("source_id"),
        sc.json_extract(F.col("patch"), "$.target_id", "bigint").alias("target_id"),
    )


@query("uri_scheme", "SELECT page_id, CASE WHEN page_id % 4 = 0 THEN 'https' ELSE split_part(url, '://', 1) END AS scheme FROM pages")
def uri_scheme(t: Tables):
    from ..operators.read import scheme_of

    uri = F.when(F.col("page_id") % 4 == 0, F.lit("files/a.txt")).otherwise(F.col("url"))
    return t.raw("pages").select("page_id", scheme_of(uri).alias("scheme"))


@query(
    "rule_string_fns",
    r"""SELECT page_id, contains(url, 'page=2') AS has_page, starts_with(url, 'http://') AS plain, suffix(url, 'ref=x') AS tail,
      regexp_matches(url, '/[a-z]{2}/[0-9]+') AS shaped, length(url) AS size FROM pages""",
)
def rule_string_fns(t: Tables):
    f, url = sc.RULE_STRING_FUNCTIONS, F.col("url")
    return t.raw("pages").select(
        "page_id", f["contains"](url, "page=2").alias("has_page"), f["startsWith"](url, "http://").alias("plain"),
        f["endsWith"](url, "ref=x").alias("tail"), f["matches"](url, "/[a-z]{2}/[0-9]+").alias("shaped"),
        f["size"](url).cast("bigint").alias("size"),
    )


@query(
    "rule_list_fns",
    """SELECT vec_id, list_contains(embedding, embedding[3]) AS has, len(list_filter(embedding, lambda x: x >= 2)) = 0 AS all_small,
      len(list_filter(embedding, lambda x: x > 0.3)) > 0 AS any_big, len(list_filter(embedding, lambda x: x > 0)) AS positives,
      len(embedding) AS size FROM embeddings""",
)
def rule_list_fns(t: Tables):
    f, v = sc.RULE_LIST_FUNCTIONS, F.col("embedding")
    positives = f["size"](f["filter"](f["map"](v, lambda x: x * 2), lambda x: x > 0))
    return t.raw("embeddings").select(
        "vec_id", f["in"](v[2], v).alias("has"), f["all"](v, lambda x: x < 2).alias("all_small"),
        f["exists"](v, lambda x: x > F.lit(0.3)).alias("any_big"), positives.cast("bigint").alias("positives"),
        f["size"](v).cast("bigint").alias("size"),
    )


@query(
    "rule_map_type_fns",
    """SELECT event_id, TRUE AS has_k, k AS as_int, CAST(k AS DOUBLE) AS as_double, CAST(k AS VARCHAR) AS as_string,
      CASE WHEN k > 50 THEN 'high' ELSE 'low' END AS level, event_type = 'x' AS never FROM event_k""",
)
def rule_map_type_fns(t: Tables):
    f = sc.RULE_TYPE_FUNCTIONS
    rows = t.event_k.select("event_id", "event_type", F.create_map(F.lit("k"), F.col("k").cast("string")).alias("m"))
    k = f["key"](F.col("m"), "k")
    return rows.select(
        "event_id", f["has"](k).alias("has_k"), f["int"](k).alias("as_int"), f["double"](k).alias("as_double"),
        f["string"](f["int"](k)).alias("as_string"),
        f["ternary"](f["int"](k) > 50, F.lit("high"), F.lit("low")).alias("level"), f["is_null"](k).alias("never"),
    )


@query(
    "matches_type",
    """SELECT 'Customer' AS entity_type, count(*) AS n FROM customer_e UNION ALL SELECT 'Supplier', count(*) FROM supplier_e""",
)
def matches_type(t: Tables):
    from ..operators.aggregate import entity_counts

    counts = entity_counts(t.catalog)
    return counts.where(sc.matches_type(F.col("entity_type"), SCHEMA, "Party"))


@query(
    "apply_defaults",
    """SELECT id, coalesce(CASE WHEN id % 2 = 0 THEN segment END, 'NONE') AS segment, TRUE AS is_available FROM customer_e""",
)
def apply_defaults(t: Tables):
    from ..model import EntityType, Schema, Slot

    schema = Schema((EntityType("Customer", (Slot("segment", default="NONE"),)),))
    rows = t.role("customer_e").select("id", F.when(F.col("id") % 2 == 0, F.col("segment")).alias("segment"))
    return mu.apply_defaults(rows, schema, "Customer").select("id", "segment", "is_available")
