"""DuckDB statements of the queries that SQL can express."""

from __future__ import annotations

from claimlens.llm.queries import SHARD_BYTES

OP10 = f"""
WITH rows AS (
  SELECT doc_id, coalesce(strlen(text), 0)::BIGINT AS n_bytes,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || ':' || md5(coalesce(text, ''))), 1, 15))::BIGINT AS h
  FROM documents),
deep AS (SELECT *, d.depth, (h >> (60 - d.depth)::INT) AS bucket
         FROM rows, (SELECT unnest(range(0, 61))::INT AS depth) d),
sums AS (SELECT depth, bucket, sum(n_bytes)::BIGINT AS shard_bytes, min(h) = max(h) AS one
         FROM deep GROUP BY ALL),
leaf AS (SELECT r.doc_id, r.n_bytes, r.h, r.bucket, s.depth, s.shard_bytes,
                row_number() OVER (PARTITION BY r.doc_id, r.h ORDER BY s.depth) AS rn
         FROM deep r JOIN sums s ON r.depth = s.depth AND r.bucket = s.bucket
         WHERE s.shard_bytes <= {SHARD_BYTES} OR s.one OR s.depth = 60)
SELECT doc_id, n_bytes,
       CASE WHEN depth = 0 THEN '' ELSE lpad(bin(bucket), depth, '0') END AS shard,
       depth, shard_bytes, shard_bytes > {SHARD_BYTES} AS oversized
FROM leaf WHERE rn = 1
"""

_WORDS = r"""regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
  '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"""

#: Every run of 13 words (of a shorter item: all its words) is compared as joined text.
OP1 = f"""
WITH d AS (SELECT doc_id, coalesce({_WORDS}, []) AS w FROM documents),
b AS (SELECT item_id, {_WORDS} AS w FROM benchmark WHERE text IS NOT NULL),
windows AS (
  SELECT DISTINCT item_id, least(13, len(w)) AS n, array_to_string(w[i:i + least(13, len(w)) - 1], ' ') AS phrase
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM windows),
grams AS (
  SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS phrase
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)),
hits AS (SELECT g.doc_id, g.i, g.n, x.item_id FROM grams g JOIN windows x ON g.n = x.n AND g.phrase = x.phrase),
words AS (SELECT doc_id, count(DISTINCT p) AS n_hit
          FROM (SELECT DISTINCT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS list
          FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item_id FROM hits) GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(list, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(d.w) AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""

OP5 = """
WITH v AS (
  SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND vec_id IS NOT NULL
    AND list_bool_and([y IS NOT NULL AND isfinite(y) FOR y IN embedding]) AND list_bool_or([y <> 0 FOR y IN embedding])),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.x, c.x) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.x) = len(c.x) WHERE q.vec_id % 20 = 0)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score
FROM scored QUALIFY rank <= 20
"""

OP11 = r"""
WITH d AS (
  SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms
  FROM documents),
t AS (SELECT row, lang, source, unnest(terms) AS term FROM d),
kept AS (SELECT lang, term FROM t GROUP BY ALL HAVING count(DISTINCT row) >= 3),
counts AS (SELECT lang, source, term, count(*) AS n FROM t SEMI JOIN kept USING (lang, term) GROUP BY ALL),
groups AS (SELECT DISTINCT lang, source FROM d),
sizes AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
grid AS (
  SELECT g.lang, g.source, k.term, v, coalesce(n, 0) AS n, sum(coalesce(n, 0)) OVER (PARTITION BY g.lang, g.source) AS total
  FROM groups g JOIN kept k ON g.lang = k.lang JOIN sizes s ON g.lang = s.lang
  LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
p AS (SELECT *, 1 + (1000000000::HUGEINT * (n + 1)) // (total + v) AS p,
             1 + (1000000000::HUGEINT * (sum(n) OVER (PARTITION BY lang, term) + 1)) // (sum(n) OVER (PARTITION BY lang) + v) AS q
      FROM grid),
pairs AS (
  SELECT a.lang, a.source, b.source AS item, coalesce(sum(x.f), 0)::BIGINT AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN (SELECT m.lang, m.source, o.source AS item, sum((m.p - o.p) * (m.p - o.p) // o.p) AS f
             FROM p m JOIN p o ON m.lang = o.lang AND m.term = o.term AND m.source <> o.source GROUP BY ALL) x
    ON x.lang = a.lang AND x.source = a.source AND x.item = b.source
  GROUP BY ALL),
telling AS (SELECT lang, source, term AS item, ((p - q) * (p - q) // q)::BIGINT AS value FROM p WHERE n > 0 AND p > q),
ranked AS (
  SELECT lang, source, 'pair' AS part, item, value,
         row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item)::INTEGER AS rank FROM pairs
  UNION ALL
  SELECT lang, source, 'term', item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item)::INTEGER
  FROM telling)
SELECT * FROM ranked WHERE part = 'pair' OR rank <= 200
"""

#: The given pages have one article element each, of headings and paragraphs without other parts in it.
OP13 = r"""
WITH article AS (
  SELECT page_id, url, regexp_split_to_array(regexp_extract(coalesce(html, ''), '(?s)<article>(.*?)</article>', 1), '</?(?:h1|p)>') AS parts
  FROM pages),
decoded AS (
  SELECT page_id, url, [trim(regexp_replace(replace(replace(replace(replace(replace(
           regexp_replace(x, '<[^>]*>', ' ', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#x27;', chr(39)), '&amp;', '&'),
           '\s+', ' ', 'g')) FOR x IN parts] AS parts
  FROM article),
blocks AS (SELECT page_id, url, [x FOR x IN parts IF x <> ''] AS parts FROM decoded)
SELECT page_id, url, coalesce(array_to_string(parts, chr(10) || chr(10)), '') AS text,
       length(coalesce(array_to_string(parts, chr(10) || chr(10)), ''))::BIGINT AS n_chars, len(parts)::BIGINT AS n_blocks
FROM blocks
"""

ORACLE: dict[str, str] = {"op13_html_extraction": OP13, "op11_source_divergence": OP11, "op1_benchmark_decontamination": OP1, "op5_nearest_neighbours": OP5,
                          "op10_extendible_sharding": OP10}
