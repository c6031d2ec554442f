"""DuckDB SQL for the queries of this package that SQL can express."""

from .licenses import COVERAGE, PHRASES, SLACK, STRETCH, TEMPLATES, K

_WORDS = r"len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))"

OP7 = rf"""
WITH sized AS (
  SELECT doc_id, source, CAST({_WORDS} AS BIGINT) AS size FROM documents
), per AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source
), weighed AS (
  SELECT *, (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1 AS w FROM per
), ordered AS (
  SELECT *, 3 * source_size AS cap,
    coalesce(sum(3 * source_size) OVER (r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS capped_before,
    sum(w) OVER (r ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS w_left,
    sum(source_size) OVER () AS total,
    row_number() OVER r AS nth
  FROM weighed
  WINDOW r AS (ORDER BY CAST(source_size AS DOUBLE) / w ASC, source ASC NULLS LAST)
), levels AS (
  SELECT *, CAST(total - capped_before AS DOUBLE) / CAST(w_left AS DOUBLE) AS level FROM ordered
), marked AS (
  SELECT *, cap <= w * level AS capped FROM levels
), targets AS (
  SELECT source, source_size,
    CASE WHEN capped THEN CAST(cap AS DOUBLE)
         ELSE w * (SELECT arg_min(level, nth) FROM marked WHERE NOT capped) END AS target,
    CAST('0x' || substr(md5('mix|' || coalesce('=' || source, '')), 1, 6) AS BIGINT) AS off
  FROM marked
), ranked AS (
  SELECT s.*, t.source_size, t.target, t.off,
    CASE WHEN t.source_size > 0 THEN CAST(floor(t.target / t.source_size * 16777216) AS BIGINT) ELSE 0 END AS rate,
    row_number() OVER (PARTITION BY s.source ORDER BY s.size, s.doc_id NULLS FIRST) - 1 AS pos
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source
), taken AS (
  SELECT *, CAST(((pos + 1) * rate + off) // 16777216 - (pos * rate + off) // 16777216 AS BIGINT) AS copies FROM ranked
)
SELECT doc_id, size, source_size, target, CAST(copies * size AS BIGINT) AS taken, copies FROM taken
"""

OP2 = """
WITH usable AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)
), places AS (
  SELECT DISTINCT vec_id, v, len(v) AS n, unnest(range(1, len(v) + 1)) AS i FROM usable
), scores AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(sum(q.v[q.i] * c.v[c.i]) AS BIGINT) AS score
  FROM places q JOIN places c ON q.i = c.i AND q.n = c.n AND q.vec_id <> c.vec_id
  WHERE q.vec_id % 50 = 0 GROUP BY q.vec_id, c.vec_id, q.v, c.v
), best AS (SELECT query_id, vec_id, max(score) AS score FROM scores GROUP BY query_id, vec_id)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank, vec_id, score
FROM best QUALIFY rank <= 5
"""

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP3 = rf"""
WITH RECURSIVE worded AS (
  SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS w FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS s
  FROM worded
), tokens AS (SELECT doc_id, len(s) AS n, unnest(s) AS t FROM sets),
pairs AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common, any_value(a.n) + any_value(b.n) AS n
  FROM tokens a JOIN tokens b ON a.t = b.t AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id
), links AS MATERIALIZED (SELECT a, b FROM pairs WHERE 100 * common >= 90 * (n - common)),
reach AS (
  SELECT doc_id, doc_id AS other FROM documents
  UNION SELECT r.doc_id, l.b FROM reach r JOIN links l ON l.a = r.other
), least AS (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, l.component_id FROM sets s JOIN least l USING (doc_id)
"""

# crc32 byte by byte, from a table that the polynomial 0xEDB88320 gives.
OP4 = """
WITH steps AS (
  SELECT list_transform(range(256), lambda n: list_reduce(range(8),
    lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, n)) AS tab
), sized AS (
  SELECT doc_id, CAST(strlen(coalesce(text, '')) + 1 AS BIGINT) AS size, string_split(hex(encode(coalesce(text, ''))), '') AS h FROM documents
), summed AS (
  SELECT doc_id, size, CASE WHEN size = 1 THEN 0 ELSE xor(list_reduce(
      list_transform(range(1, size), lambda i: (strpos('0123456789ABCDEF', h[2 * i - 1]) - 1) * 16 + strpos('0123456789ABCDEF', h[2 * i]) - 1),
      lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1]), 4294967295), 4294967295) END AS crc
  FROM sized, steps
), placed AS (
  SELECT doc_id, size, CAST(crc AS BIGINT) AS text_crc32, CAST(sum(size) OVER o AS BIGINT) AS upto, CAST(sum(size) OVER () AS BIGINT) AS total,
    row_number() OVER o AS nth
  FROM summed WINDOW o AS (ORDER BY doc_id NULLS FIRST, size, crc ROWS UNBOUNDED PRECEDING)
), cut AS (SELECT *, CAST(least(7, ((2 * upto - size) * 8) // (2 * total)) AS INT) AS shard FROM placed)
SELECT doc_id, size, text_crc32, 'bytes' AS law, shard, CAST(row_number() OVER (PARTITION BY shard ORDER BY nth) - 1 AS BIGINT) AS slot,
  CAST(NULL AS INT) AS grown_shard FROM cut
"""


def _op6() -> str:
    starts = []
    for phrase in PHRASES:
        words = phrase.split()
        stands = " AND ".join(f"w[i + {n}] = '{word}'" for n, word in enumerate(words, 1))
        starts.append(f"list_filter(range(0, len(w) - {len(words) - 1}), lambda i: {stands})")
    found = ", ".join(f"{s} AS p{i}" for i, s in enumerate(starts))
    every = "list_concat(" + ", ".join(f"p{i}" for i in range(len(starts))) + ")"
    named = "list_filter([" + ", ".join(f"CASE WHEN len(p{i}) > 0 THEN '{label}' END" for i, label in enumerate(PHRASES.values())) + "], lambda x: x IS NOT NULL)"
    templates = ", ".join(f"('{label}', string_split('{text}', ' '))" for label, text in TEMPLATES.items())
    gram = lambda w, at: " || ' ' || ".join(f"{w}[{at} + {n}]" for n in range(1, K + 1))
    return rf"""
WITH worded AS (
  SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), based AS (SELECT rid, doc_id, len(w) AS n_words, {found} FROM worded),
base AS (SELECT rid, doc_id, n_words, {every} AS starts, list_sort(list_distinct({named})) AS names FROM based),
template(label, t) AS (VALUES {templates}),
tgrams AS (SELECT label, len(t) - {K - 1} AS n_grams, pos AS tpos, {gram("t", "pos")} AS gram
  FROM (SELECT *, unnest(range(0, len(t) - {K - 1})) AS pos FROM template)),
dgrams AS (SELECT rid, pos, {gram("w", "pos")} AS gram FROM (SELECT rid, w, unnest(range(0, len(w) - {K - 1})) AS pos FROM worded)),
matches AS (SELECT rid, label, pos, tpos, n_grams, pos - tpos AS diagonal FROM dgrams JOIN tgrams USING (gram)),
diagonals AS (SELECT rid, label, diagonal, CASE WHEN diagonal - lag(diagonal) OVER d <= {SLACK} THEN 0 ELSE 1 END AS fresh
  FROM (SELECT DISTINCT rid, label, diagonal FROM matches) WINDOW d AS (PARTITION BY rid, label ORDER BY diagonal)),
grouped AS (SELECT rid, label, diagonal, sum(fresh) OVER (PARTITION BY rid, label ORDER BY diagonal ROWS UNBOUNDED PRECEDING) AS g FROM diagonals),
spans AS (SELECT rid, label, count(DISTINCT tpos) / any_value(n_grams) AS coverage, min(pos) AS head, max(pos) + {K - 1} AS tail, any_value(n_grams) AS n_grams
  FROM matches JOIN grouped USING (rid, label, diagonal) GROUP BY rid, label, g
  HAVING coverage >= {COVERAGE} AND tail - head + 1 <= {STRETCH} * (any_value(n_grams) + {K - 1})),
verified AS (SELECT rid, list(DISTINCT label) AS more, max(coverage) AS best FROM spans s
  WHERE NOT EXISTS (SELECT 1 FROM spans o WHERE o.rid = s.rid AND o.head <= s.tail AND o.tail >= s.head AND o.coverage > s.coverage) GROUP BY rid)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(len(starts) AS BIGINT) AS n_base,
  CAST(list_min(starts) AS BIGINT) AS first_word, CAST(list_max(starts) AS BIGINT) AS last_word,
  array_to_string(names, ',') AS base_labels,
  array_to_string(list_sort(list_distinct(list_concat(names, coalesce(more, [])))), ',') AS labels,
  CAST(CASE WHEN len(names) > 0 THEN 1 ELSE coalesce(best, 0) END AS DOUBLE) AS score
FROM base LEFT JOIN verified USING (rid)
"""


SQL = {
    "op2_segment_bound_topk": OP2,
    "op3_count_vector_join": OP3,
    "op4_byte_shards": OP4,
    "op6_diagonal_licenses": _op6(),
    "op7_systematic_mix": OP7,
}
