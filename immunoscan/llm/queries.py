"""Registered queries of this subpackage, and SQL for those that SQL can express."""

from .bpe import op9_byte_bpe
from .decontamination import op1_benchmark_decontamination
from .embedding_dedup import op8_embedding_near_dedup
from .language_id import op4_language_id
from .lexical_search import op11_lexical_search
from .prefix_trie import op13_prefix_trie
from .secrets import op10_secret_scan
from .sharding import op2_sharding
from .simhash_dedup import op7_simhash_near_dedup
from .substring_dedup import op3_substring_dedup
from .suffix_dedup import op5_suffix_dedup
from .url_filter import op6_url_filter
from .warc import op12_warc

QUERIES = {
    f.__name__: f
    for f in (
        op1_benchmark_decontamination,
        op2_sharding,
        op3_substring_dedup,
        op4_language_id,
        op5_suffix_dedup,
        op6_url_filter,
        op7_simhash_near_dedup,
        op8_embedding_near_dedup,
        op9_byte_bpe,
        op10_secret_scan,
        op11_lexical_search,
        op12_warc,
        op13_prefix_trie,
    )
}

SUBSTRING = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS i FROM d WHERE len(w) >= 35),
g AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 34], ' ')) AS h FROM s),
t AS (SELECT g.doc_id, g.i FROM g JOIN (SELECT h FROM g GROUP BY h HAVING count(*) > 1) r ON g.h = r.h),
c AS (SELECT DISTINCT doc_id, j FROM (SELECT doc_id, unnest(range(i, i + 35)) AS j FROM t)),
e AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS j FROM d),
k AS (SELECT e.doc_id, string_agg(e.word, ' ' ORDER BY e.j) AS kept, count(*) AS n FROM e LEFT JOIN c ON e.doc_id = c.doc_id AND e.j = c.j
      WHERE c.j IS NULL GROUP BY e.doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(len(d.w) - coalesce(k.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(k.kept, '')) AS kept_sha256
FROM d LEFT JOIN k ON d.doc_id = k.doc_id"""

EMBEDDING = """
WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
  AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
p AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND len(a.e) = len(b.e) AND a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
r AS (SELECT vec_id AS node, vec_id AS seen FROM embeddings UNION SELECT r.node, p.b FROM r JOIN p ON p.a = r.seen),
c AS (SELECT node, min(seen) AS component_id FROM r GROUP BY node),
n AS (SELECT a, count(*) AS n FROM p GROUP BY a)
SELECT e.vec_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_links, c.component_id, c.component_id = e.vec_id AS kept
FROM embeddings e JOIN c ON c.node = e.vec_id LEFT JOIN n ON n.a = e.vec_id"""

SEARCH = r"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents WHERE text IS NOT NULL),
s AS (SELECT count(*) AS big_n, sum(len(w))::BIGINT AS big_l FROM d WHERE len(w) > 0),
t AS (SELECT k, term, count(*) AS tf FROM (SELECT k, unnest(w) AS term FROM d) GROUP BY k, term),
q AS (SELECT item_id, term, count(*) AS c FROM (SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark) GROUP BY item_id, term),
f AS (SELECT term, count(*) AS df FROM t GROUP BY term),
w AS (SELECT term, CAST(floor(1000 * ln((2 * big_n + 2)::DOUBLE / (2 * df + 1)::DOUBLE)) AS BIGINT) AS w FROM f, s),
m AS (SELECT k, doc_id, 100 - 75 + ((75 * len(w)::BIGINT * big_n) // big_l) AS m FROM d, s WHERE len(w) > 0),
r AS (SELECT q.item_id, m.k, m.doc_id, CAST(sum(q.c * w.w * ((1000000000 * t.tf) // (1000 * t.tf + 8 * m.m))) AS BIGINT) AS score
      FROM q JOIN t USING (term) JOIN w USING (term) JOIN m USING (k) GROUP BY ALL),
o AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM r WHERE score > 0)
SELECT * FROM o WHERE rank <= 10"""

WARC = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha1(coalesce(html, '')) AS d FROM pages),
g AS (SELECT d, max(page_id) AS holder FROM p WHERE n >= 1000 GROUP BY d)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, p.d AS payload_digest, CASE WHEN holder <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN holder <> page_id THEN holder END AS refers_to FROM p LEFT JOIN g ON p.d = g.d AND n >= 1000"""

# crc32 by its definition: each byte is folded in and followed by eight steps of one bit
TRIE = """
WITH o AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS p FROM conversations WHERE conv_id IS NOT NULL),
h AS (SELECT conv_id, conv_id - conv_id % 100 AS base, xor(list_reduce(flatten(list_transform(string_split(conv_id::VARCHAR, ''), lambda c: [ascii(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1])),
  lambda s, x: CASE WHEN x >= 0 THEN xor(s, x) WHEN s % 2 = 1 THEN xor(s // 2, 3988292384) ELSE s // 2 END, 4294967295), 4294967295) % 6 AS h FROM (SELECT DISTINCT conv_id FROM o)),
t AS (SELECT h.conv_id, o.p AS q, o.role, o.text FROM h JOIN o ON o.conv_id = h.base AND o.p <= h.h UNION ALL SELECT h.conv_id, o.p + 1000000 AS q, o.role, o.text FROM h JOIN o ON o.conv_id = h.conv_id AND o.p > h.h),
r AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY q) AS d, md5(length(role) || ':' || role || text) AS k, length(text) AS n FROM t),
x AS (SELECT conv_id, d, n, string_agg(k, '') OVER (PARTITION BY conv_id ORDER BY d) AS path FROM r UNION ALL SELECT conv_id, 0, 0, '' FROM h),
z AS (SELECT conv_id, max(d) AS deep FROM x GROUP BY conv_id),
m AS (SELECT path, d, any_value(n) AS n, min(conv_id) AS conv_id, count(*) AS c, string_agg(CASE WHEN deep = d THEN conv_id::VARCHAR END, ',' ORDER BY conv_id) AS ends FROM x JOIN z USING (conv_id) GROUP BY path, d),
k AS (SELECT left(path, length(path) - 32) AS path, count(*) AS children FROM m WHERE d > 0 GROUP BY ALL),
a AS (SELECT path, d, conv_id, unnest(range(0, d + 1)) AS e, (c - 1) * n AS saved, (children IS NULL)::BIGINT AS leaf FROM m LEFT JOIN k USING (path)),
b AS (SELECT left(path, 32 * e) AS path, sum(saved) AS saved, sum(leaf) AS leaves FROM a GROUP BY ALL)
SELECT m.conv_id, CAST(m.d AS BIGINT) AS depth, u.conv_id AS parent_conv_id, m.c AS n_convs, coalesce(children, 0) AS n_children, CAST(leaves AS BIGINT) AS n_leaves,
  CAST(saved AS BIGINT) AS saved_tokens, sha256(coalesce(m.ends, '')) AS ends_sha256
FROM m JOIN b USING (path) LEFT JOIN k USING (path) LEFT JOIN m u ON m.d > 0 AND u.path = left(m.path, length(m.path) - 32)"""

ORACLES = {"op3_substring_dedup": SUBSTRING, "op8_embedding_near_dedup": EMBEDDING, "op11_lexical_search": SEARCH, "op12_warc": WARC, "op13_prefix_trie": TRIE}
