"""DuckDB SQL for the corpus queries that SQL can express."""

OP7 = """
WITH cut AS (
  SELECT page_id,
         translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path
  FROM pages
), rules(action, rhost, rpath) AS (
  VALUES ('block', 'com', '/en/'), ('allow', 'example.com', '/en/7'), ('block', 'net', '/de/'),
         ('block', 'example.net', '/de/8'), ('block', 'org', '/es/')
), fit AS (
  SELECT page_id, host, path, rhost || rpath AS rule, action,
         row_number() OVER (PARTITION BY page_id ORDER BY length(rhost || rpath) DESC NULLS LAST) AS n
  FROM cut LEFT JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)
)
SELECT page_id, host, path, rule, coalesce(action, 'allow') AS verdict FROM fit WHERE n = 1
"""

_CRC = "xor(list_reduce(list_prepend(4294967295::BIGINT, {bytes}), lambda c, b: {steps}), 4294967295)"


def _crc32(text: str) -> str:
    """CRC-32 of a text's UTF-8 bytes, eight shifts a byte."""
    data = f"list_transform(range(0, octet_length(encode({text}))), lambda i: ('0x' || substr(hex(encode({text})), 1 + 2 * i, 2))::BIGINT)"
    steps = "xor(c, b)"
    for _ in range(8):
        steps = f"list_transform([{steps}], lambda v: xor(v >> 1, (v & 1) * 3988292384))[1]"
    return _CRC.format(bytes=data, steps=steps)


OP9 = """
WITH sized AS (
  SELECT doc_id, coalesce(text, '') AS text, octet_length(encode(coalesce(text, ''))) + 1 AS size FROM documents
), placed AS (
  SELECT doc_id, text, size, coalesce(sum(size) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start,
         (sum(size) OVER ())::BIGINT AS total
  FROM sized
), put AS (
  SELECT *, least(7, (2 * start + size) * 8 // (2 * total))::INTEGER AS shard FROM placed
)
SELECT doc_id, size::BIGINT AS size, %s AS text_crc32, 'bytes' AS law, shard,
       row_number() OVER (PARTITION BY shard ORDER BY doc_id) - 1 AS slot, NULL::INTEGER AS grown_shard
FROM put
"""

# The blocks are dealt one by one here: every quotient is listed and the highest are taken.
OP1 = """
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size,
         CASE WHEN source IS NULL THEN '1' ELSE '0' || source END AS src, md5(coalesce(text, '')) AS text_hash
  FROM documents
), total AS (
  SELECT sum(size)::BIGINT AS total, greatest(32768, (sum(size) + 65535)::BIGINT // 65536) AS per_shard,
         greatest(1, least(greatest(64, greatest(32768, (sum(size) + 65535)::BIGINT // 65536) // 512), sum(size)::BIGINT // 4096)) AS block
  FROM sized
), weighed AS (
  SELECT src, sum(size)::BIGINT AS words, [5, 2, 1][1 + (row_number() OVER (ORDER BY src) - 1) % 3] AS w FROM sized GROUP BY src
), filling AS (
  SELECT *, 3 * words * sum(w) OVER (ORDER BY 3 * words / w, src ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
              <= (total - coalesce(sum(3 * words) OVER (ORDER BY 3 * words / w, src ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) * w AS is_full
  FROM weighed, total
), targets AS (
  SELECT src, words, block, is_full, greatest(1, (words + per_shard - 1) // per_shard) AS shards,
         CASE WHEN is_full THEN (3 * words)::DOUBLE
              ELSE (total - sum(CASE WHEN is_full THEN 3 * words ELSE 0 END) OVER ())::DOUBLE * w / sum(CASE WHEN is_full THEN 0 ELSE w END) OVER () END AS target
  FROM filling
), open AS (
  SELECT *, floor(sum(target) OVER ())::BIGINT AS open_words FROM targets WHERE NOT is_full
), seats AS (
  SELECT src, count(*) FILTER (n <= (2 * open_words + block) // (2 * block)) AS blocks
  FROM (SELECT src, open_words, block, row_number() OVER (ORDER BY target / (2 * k - 1) DESC, src) AS n
        FROM open, LATERAL (SELECT unnest(range(1, 4 + (2 * target / block)::BIGINT)) AS k))
  GROUP BY src
), hashed AS (
  SELECT *, ('0x' || substr(h, 1, 8))::BIGINT % shards AS shard
  FROM (SELECT s.*, md5(concat_ws(':', 'mix', doc_id::VARCHAR, size::VARCHAR, text_hash)) AS h, shards, block, is_full FROM sized s JOIN targets USING (src))
), cells AS (
  SELECT src, shard, any_value(block) AS block, any_value(is_full) AS is_full, sum(size)::BIGINT AS words FROM hashed GROUP BY src, shard
), dealt AS (
  SELECT src, shard, count(*) FILTER (n <= blocks) AS quota
  FROM (SELECT src, shard, blocks, row_number() OVER (PARTITION BY src ORDER BY words / (2 * k - 1) DESC, shard) AS n
        FROM cells JOIN seats USING (src), LATERAL (SELECT unnest(range(1, 6 + 8 * words // block)) AS k))
  GROUP BY src, shard
), bounded AS (
  SELECT c.*, quota, CASE WHEN is_full THEN 3 * words ELSE least(quota * block, 3 * words) END AS first_taken FROM cells c LEFT JOIN dealt USING (src, shard)
), quotas AS (
  SELECT *, first_taken + CASE WHEN is_full THEN 0 ELSE
           greatest(0, least(3 * words - first_taken, sum(quota * block - first_taken) OVER (PARTITION BY src)
             - coalesce(sum(3 * words - first_taken) OVER (PARTITION BY src ORDER BY words / (2 * quota + 1) DESC, shard ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))) END AS taken
  FROM bounded
), blocks AS (
  SELECT src, shard, b, least(block, words - b * block) AS width, md5(concat_ws(':', 'mix', src, shard::VARCHAR, b::VARCHAR)) AS bh, taken % words AS rest
  FROM quotas, LATERAL (SELECT unnest(range(0, (words + block - 1) // block)) AS b) WHERE words > 0
), kept AS (
  SELECT src, shard, b, greatest(0, least(width, rest - coalesce(sum(width) OVER (PARTITION BY src, shard ORDER BY bh, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))) AS used
  FROM blocks
), stream AS (
  SELECT *, coalesce(sum(size) OVER (PARTITION BY src, shard ORDER BY h, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM hashed
), extra AS (
  SELECT doc_id, sum(greatest(0, least(start + size, b * block + used) - greatest(start, b * block)))::BIGINT AS more
  FROM stream JOIN kept USING (src, shard) WHERE b * block < start + size AND (b + 1) * block > start GROUP BY doc_id
)
SELECT s.doc_id, s.source, s.size, t.words AS source_size, t.target, (coalesce(q.taken // nullif(q.words, 0), 0) * s.size + coalesce(e.more, 0))::BIGINT AS taken
FROM stream s JOIN targets t USING (src) JOIN quotas q USING (src, shard) LEFT JOIN extra e ON e.doc_id = s.doc_id
"""

OP3 = """
WITH lines AS (
  SELECT doc_id, generate_subscripts(parts, 1) AS pos, unnest(parts) AS line
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents)
), keyed AS (
  SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines
), repeated AS (
  SELECT key, min(doc_id) AS first FROM keyed WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) >= 2
), marked AS (
  SELECT k.*, r.key IS NOT NULL AND doc_id <> first AS gone FROM keyed k LEFT JOIN repeated r USING (key)
)
SELECT doc_id, count(*)::BIGINT AS n_lines, (count(*) FILTER (gone))::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""

OP5 = """
WITH ints AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.v, c.v)::BIGINT AS score
  FROM ints q JOIN ints c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id
), ranked AS (
  SELECT *, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INTEGER AS rank FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""

# Exact neighbours: the query's answer is exact on tables of up to ``neighbours.LEAST`` rows.
OP11 = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings
  WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), met AS (
  SELECT q.vec_id AS query_id, c.vec_id, sqrt(list_sum(list_transform(list_zip(q.e, c.e), lambda p: (p[1] - p[2]) * (p[1] - p[2])))) AS score
  FROM v AS q JOIN v AS c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id)::INTEGER AS rank FROM met
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10
"""

OP12 = """
WITH pieces AS MATERIALIZED (
  SELECT coalesce(lang, 'und') AS lang,
         regexp_extract_all(unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')), '[^\\x20\\x09]+') AS w
  FROM documents
), total AS (
  SELECT lang, sum(len(w))::BIGINT AS n FROM pieces GROUP BY lang
), words AS (
  SELECT lang, piece, unnest(w) AS w1, unnest(range(len(w))) AS i FROM (SELECT *, row_number() OVER () AS piece FROM pieces)
), runs AS (
  SELECT lang, w1, lead(w1, 1) OVER p AS w2, lead(w1, 2) OVER p AS w3, lead(w1, 3) OVER p AS w4 FROM words WINDOW p AS (PARTITION BY piece ORDER BY i)
), grams AS (
  SELECT lang, 1 AS k, w1 AS phrase FROM runs
  UNION ALL SELECT lang, 2, w1 || ' ' || w2 FROM runs WHERE w2 IS NOT NULL
  UNION ALL SELECT lang, 3, w1 || ' ' || w2 || ' ' || w3 FROM runs WHERE w3 IS NOT NULL
  UNION ALL SELECT lang, 4, w1 || ' ' || w2 || ' ' || w3 || ' ' || w4 FROM runs WHERE w4 IS NOT NULL
), frequent AS MATERIALIZED (
  SELECT lang, k, phrase, count(*) AS a FROM grams GROUP BY ALL HAVING count(*) >= 30
), parted AS (
  SELECT *, string_split(phrase, ' ') AS w FROM frequent WHERE k > 1
), cuts AS (
  SELECT p.lang, p.phrase, p.a, c.cut, l.a AS l, r.a AS r, (2000000::HUGEINT * p.a) // (l.a + r.a) AS score
  FROM parted AS p JOIN (SELECT unnest([1, 2, 3]) AS cut) AS c ON c.cut < p.k
  JOIN frequent AS l ON l.lang = p.lang AND l.phrase = array_to_string(p.w[1 : c.cut], ' ')
  JOIN frequent AS r ON r.lang = p.lang AND r.phrase = array_to_string(p.w[c.cut + 1 : p.k], ' ')
), best AS (
  SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) AS place FROM cuts
), inside AS (
  SELECT lang, phrase, max(a) AS longer
  FROM (SELECT lang, a, array_to_string(w[i : i + n - 1], ' ') AS phrase
        FROM (SELECT lang, a, w, n, unnest(range(1, k - n + 2)) AS i FROM parted, (SELECT unnest([2, 3]) AS n) WHERE n < k))
  GROUP BY lang, phrase
), kept AS (
  SELECT b.* FROM best AS b LEFT JOIN inside AS i ON i.lang = b.lang AND i.phrase = b.phrase
  WHERE place = 1 AND (i.longer IS NULL OR 100 * i.longer < 80 * b.a)
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank FROM kept
)
SELECT lang, rank, phrase, a, l, r, n, score::BIGINT AS score FROM ranked JOIN total USING (lang) WHERE rank <= 2000
"""


def _rounds(rounds: int, k: int) -> str:
    """Whole-number rounds of clustering over (vector, place, value) rows, and the last assignment."""
    ctes = f"""
WITH kept AS MATERIALIZED (
  SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), value AS MATERIALIZED (
  SELECT row, unnest(range(1, 65)) AS j, unnest(v) AS x FROM kept
), c0 AS MATERIALIZED (
  SELECT c, unnest(range(1, 65)) AS j, unnest(v) AS x
  FROM (SELECT row_number() OVER (ORDER BY sha256('2:' || vec_id)) - 1 AS c, v FROM kept WHERE vec_id IS NOT NULL) WHERE c < {k}
)"""
    for i in range(rounds + 1):
        ctes += f""", d{i} AS MATERIALIZED (
  SELECT row, c, sum((value.x - m.x) * (value.x - m.x))::BIGINT AS d FROM value JOIN c{i} AS m USING (j) GROUP BY row, c
), a{i} AS MATERIALIZED (
  SELECT row, arg_min(c, (d, c)) AS c, min(d) AS d FROM d{i} GROUP BY row
)"""
        if i < rounds:
            ctes += f""", c{i + 1} AS MATERIALIZED (
  SELECT c, j, CASE WHEN n IS NULL THEN m.x ELSE (s - ((s % n) + n) % n) // n END AS x
  FROM c{i} AS m LEFT JOIN (SELECT c, j, sum(x)::BIGINT AS s, count(*) AS n FROM value JOIN a{i} USING (row) GROUP BY c, j) USING (c, j)
)"""
    return f"""{ctes}, named AS (
  SELECT c, sha256(string_agg(x::BIGINT::VARCHAR, ',' ORDER BY j)) AS centroid_sha256 FROM c{rounds} GROUP BY c
)
SELECT vec_id, c::INTEGER AS cluster, d AS distance, (sum(d) OVER (PARTITION BY c))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia, centroid_sha256
FROM a{rounds} JOIN kept USING (row) JOIN named USING (c)
"""


ORACLES: dict[str, str] = {
    "op1_mixing": OP1,
    "op3_line_dedup": OP3,
    "op5_topk": OP5,
    "op7_url_rules": OP7,
    "op9_sharding": OP9 % _crc32("text"),
    "op11_neighbours": OP11,
    "op12_collocations": OP12,
    "op13_clusters": _rounds(5, 40),
}
