"""DuckDB SQL of the registered queries that SQL can express."""

from __future__ import annotations

from .archive import LEAST_REVISIT
from .clusters import CENTROIDS, DIMS, ROUNDS, SCALE
from .decontaminate import SIMILARITY, SHINGLE_WORDS
from .neardup import THRESHOLD
from .ranked import TOP
from .shards import SHARDS

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

OP1 = rf"""WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (SELECT doc_id, list_distinct(CASE WHEN len(w) = 1 THEN w
  ELSE list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END) AS s FROM words),
flat AS (SELECT doc_id, len(s) AS n, unnest(s) AS shingle FROM sets),
links AS (SELECT a.doc_id AS a, b.doc_id AS b FROM flat a JOIN flat b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= {THRESHOLD} * (a.n + b.n - count(*))),
reach AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b),
lowest AS (SELECT a, min(b) AS b FROM reach GROUP BY a)
SELECT doc_id, len(s) AS n_shingles, least(doc_id, coalesce(b, doc_id)) AS component_id,
  least(doc_id, coalesce(b, doc_id)) = doc_id AS kept FROM sets LEFT JOIN lowest ON a = doc_id"""

OP4 = rf"""WITH doc_words AS (SELECT DISTINCT doc_id, regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+') AS w FROM documents),
item_words AS (SELECT item_id, regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+') AS w FROM benchmark),
items AS (SELECT item_id, len(w) AS n, k, list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i : i + k - 1], ' ')) AS g
  FROM (SELECT *, least({SHINGLE_WORDS}, len(w)) AS k FROM item_words WHERE len(w) > 0) x),
docs AS (SELECT doc_id, k, list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i : i + k - 1], ' ')) AS g
  FROM doc_words, (SELECT DISTINCT k FROM items) s WHERE len(w) >= k),
doc_grams AS (SELECT doc_id, k, unnest(g) AS gram, generate_subscripts(g, 1) - 1 AS place FROM docs),
item_grams AS (SELECT item_id, k, unnest(g) AS gram, generate_subscripts(g, 1) - 1 AS back FROM items),
starts AS (SELECT DISTINCT doc_id, item_id, greatest(0, place - back) AS start FROM doc_grams JOIN item_grams USING (k, gram)),
pairs AS (SELECT doc_id, item_id, start, n, i.g AS ig, d.g[start + 1 : start + n - i.k + 1] AS wg
  FROM starts JOIN items i USING (item_id) JOIN docs d USING (doc_id) WHERE d.k = i.k),
counts AS (SELECT doc_id, item_id, start, n, len(ig) + len(wg) AS total, list_sum(list_transform(list_distinct(ig),
  lambda x: least(len(list_filter(ig, lambda y: y = x)), len(list_filter(wg, lambda z: z = x))))) AS common FROM pairs),
rated AS (SELECT *, common::DOUBLE / (total - common) AS similarity FROM counts)
SELECT doc_id, item_id, start::INTEGER AS start_word, n::INTEGER AS n_words, similarity FROM rated WHERE similarity >= {SIMILARITY}
QUALIFY row_number() OVER (PARTITION BY doc_id, item_id ORDER BY similarity DESC, start) = 1"""

_BASE32 = " || ".join(
    f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((v[{chunk + 1}] >> {shift}) & 31 AS INTEGER) + 1, 1)"
    for chunk in range(8)
    for shift in (15, 10, 5, 0)
)

OP6 = f"""WITH pages_ AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
digests AS (SELECT page_id, body, octet_length(encode(body)) AS payload_bytes,
  list_transform(range(0, 8), lambda i: CAST('0x' || substr(sha1(body), CAST(5 * i + 1 AS INTEGER), 5) AS BIGINT)) AS v,
  min(page_id) OVER (PARTITION BY body) AS first_id FROM pages_),
kinds AS (SELECT *, payload_bytes >= {LEAST_REVISIT} AND page_id <> first_id AS again FROM digests)
SELECT page_id, payload_bytes, {_BASE32} AS payload_digest, CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN again THEN first_id END AS refers_to, TRUE AS verified FROM kinds"""


def _crc_table() -> list[int]:
    """The table of CRC-32 (reflected polynomial 0xEDB88320), by its rule."""
    out = []
    for c in range(256):
        for _ in range(8):
            c = (c >> 1) ^ 0xEDB88320 if c & 1 else c >> 1
        out.append(c)
    return out


_BYTES = """flatten(list_transform(string_split(coalesce(text, ''), ''), lambda c: CASE
  WHEN unicode(c) < 0 THEN [] WHEN unicode(c) < 128 THEN [unicode(c)]
  WHEN unicode(c) < 2048 THEN [192 + (unicode(c) >> 6), 128 + (unicode(c) & 63)]
  WHEN unicode(c) < 65536 THEN [224 + (unicode(c) >> 12), 128 + ((unicode(c) >> 6) & 63), 128 + (unicode(c) & 63)]
  ELSE [240 + (unicode(c) >> 18), 128 + ((unicode(c) >> 12) & 63), 128 + ((unicode(c) >> 6) & 63), 128 + (unicode(c) & 63)] END))"""

OP9 = f"""WITH RECURSIVE jump AS (
  SELECT doc_id, n, CASE WHEN doc_id < 0 THEN doc_id::HUGEINT + 18446744073709551616 ELSE doc_id::HUGEINT END AS key, 0::BIGINT AS b, 0::BIGINT AS j
  FROM (SELECT DISTINCT doc_id FROM documents) d, (SELECT unnest([{SHARDS}, {SHARDS + 1}]) AS n) m
  UNION ALL
  SELECT doc_id, n, k2, j, floor((j + 1) * (2147483648::DOUBLE / ((k2 // 8589934592) + 1)::DOUBLE))::BIGINT
  FROM (SELECT doc_id, n, j, (key * 2862933555777941757 + 1) % 18446744073709551616 AS k2 FROM jump WHERE j < n) x),
placed AS (SELECT doc_id, max(b) FILTER (WHERE n = {SHARDS}) AS shard, max(b) FILTER (WHERE n = {SHARDS + 1}) AS grown_shard
  FROM jump WHERE j >= n GROUP BY doc_id),
sums AS (SELECT doc_id, octet_length(encode(coalesce(text, ''))) + 8 AS size,
  xor(list_reduce(list_prepend(4294967295::BIGINT, {_BYTES}),
    lambda crc, byte: xor(({_crc_table()}::BIGINT[])[CAST(xor(crc, byte) & 255 AS INTEGER) + 1], crc >> 8)), 4294967295) AS text_crc32 FROM documents)
SELECT doc_id, size, text_crc32, shard::INTEGER AS shard, grown_shard::INTEGER AS grown_shard,
  row_number() OVER (PARTITION BY shard ORDER BY doc_id) - 1 AS slot, 'key' AS law FROM sums JOIN placed USING (doc_id)"""

def _round(r: int) -> str:
    """Assignment to the centroids of round ``r`` and the centroids after it."""
    return f"""near{r} AS MATERIALIZED (SELECT row_, c, gap FROM (
  SELECT row_, c, sum((f.x - m.x) * (f.x - m.x))::BIGINT AS gap FROM flat f JOIN mid{r} m USING (d) GROUP BY row_, c) g
  QUALIFY row_number() OVER (PARTITION BY row_ ORDER BY gap, c) = 1),
mid{r + 1} AS MATERIALIZED (SELECT m.c, m.d, coalesce(s.x, m.x) AS x FROM mid{r} m LEFT JOIN (
  SELECT c, d, ((sum(x) - ((sum(x) % count(*)) + count(*)) % count(*)) // count(*))::BIGINT AS x
  FROM near{r} JOIN flat USING (row_) GROUP BY c, d) s USING (c, d))"""


OP11 = f"""WITH kept AS (SELECT row_number() OVER (ORDER BY vec_id) AS row_, vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS v
  FROM embeddings WHERE len(embedding) = {DIMS} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {DIMS}),
flat AS MATERIALIZED (SELECT row_, unnest(v) AS x, generate_subscripts(v, 1) AS d FROM kept),
mid0 AS MATERIALIZED (SELECT c, unnest(v) AS x, generate_subscripts(v, 1) AS d FROM (
  SELECT row_number() OVER (ORDER BY sha256('2:' || vec_id), v) - 1 AS c, v FROM kept) s WHERE c < {CENTROIDS}),
{", ".join(_round(r) for r in range(ROUNDS + 1))},
named AS (SELECT c, sha256(string_agg(x::VARCHAR, ',' ORDER BY d)) AS centroid_sha256 FROM mid{ROUNDS} GROUP BY c)
SELECT vec_id, c::INTEGER AS cluster, gap AS distance, (sum(gap) OVER (PARTITION BY c))::BIGINT AS cluster_inertia,
  (sum(gap) OVER ())::BIGINT AS inertia, centroid_sha256 FROM near{ROUNDS} JOIN kept USING (row_) JOIN named USING (c)"""

_TERMS = r"regexp_extract_all(translate(coalesce(text, ''), '{}', '{}'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')".format(UPPER, LOWER)

OP12 = f"""WITH docs AS (SELECT row_number() OVER () AS row_, doc_id, {_TERMS} AS w FROM documents),
size_ AS (SELECT count(*) AS docs_, sum(len(w))::BIGINT AS words_ FROM docs WHERE len(w) > 0),
tfs AS (SELECT row_, t, count(*) AS tf FROM (SELECT row_, unnest(w) AS t FROM docs) x GROUP BY row_, t),
asked AS (SELECT item_id, t, count(*) AS q FROM (SELECT item_id, unnest({_TERMS}) AS t FROM benchmark) x GROUP BY item_id, t),
weights AS (SELECT t, floor(1000 * ln((2 * docs_ + 2) / (2 * df + 1)))::BIGINT AS weight
  FROM (SELECT t, count(*) AS df FROM tfs SEMI JOIN asked USING (t) GROUP BY t) f, size_),
lengths AS (SELECT row_, doc_id, 75 + (25 * len(w) * docs_) // words_ AS m FROM docs, size_ WHERE len(w) > 0),
scores AS (SELECT item_id, row_, doc_id, sum(q * weight * ((1000000000 * tf) // (1000 * tf + 12 * m)))::BIGINT AS score
  FROM asked JOIN weights USING (t) JOIN tfs USING (t) JOIN lengths USING (row_) GROUP BY item_id, row_, doc_id)
SELECT item_id, (row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id))::INTEGER AS rank, doc_id, score
FROM scores WHERE score > 0 QUALIFY rank <= {TOP}"""

ORACLES = {"op1_minhash": OP1, "op4_decontaminate": OP4, "op6_warc": OP6, "op9_sharding": OP9, "op11_clusters": OP11, "op12_ranked": OP12}
