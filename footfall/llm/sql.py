"""SQL of the queries that SQL can express, for DuckDB."""

_COMPONENTS = """
reach AS (
  SELECT id AS node, id AS low FROM nodes
  UNION
  SELECT e.v AS node, r.low FROM reach r JOIN edges e ON e.u = r.node WHERE r.low < e.v
),
labels AS (SELECT node, min(low) AS component_id FROM reach GROUP BY node)
"""

NEAR_DUPLICATES = (
    r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x20\x09-\x0D]+') AS w
  FROM documents
),
shingles AS (
  SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + 2), ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 1, 2))) AS i FROM words WHERE len(w) > 0)
),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
shared AS (
  SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS common
  FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id
  GROUP BY ALL
),
edges AS (
  SELECT u, v FROM shared JOIN sizes x ON x.doc_id = u JOIN sizes y ON y.doc_id = v
  WHERE 100 * common >= 85 * (x.n + y.n - common)
),
nodes AS (SELECT doc_id AS id FROM documents),"""
    + _COMPONENTS
    + """
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM documents d LEFT JOIN sizes USING (doc_id) JOIN labels ON node = d.doc_id
"""
)

TOP_PRODUCTS = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS z
  FROM embeddings
  WHERE len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id,
    list_sum(list_transform(list_zip(q.z, c.z), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id
  WHERE q.vec_id % 20 = 0
)
SELECT query_id, rank::INTEGER AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
WHERE rank <= 20
"""

SOURCE_MIX = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size
  FROM documents
),
held AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
weighed AS (
  SELECT *, [5.0, 2.0, 1.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INTEGER]::DOUBLE
    AS weight, 3.0::DOUBLE * source_size AS most
  FROM held
),
ranked AS (
  SELECT *, row_number() OVER fill AS place,
    (sum(source_size) OVER () - coalesce(sum(most) OVER (fill ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0::DOUBLE))
    / (sum(weight) OVER () - coalesce(sum(weight) OVER (fill ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0::DOUBLE))
    AS level
  FROM weighed WINDOW fill AS (ORDER BY most / weight, source NULLS LAST)
),
shared AS (SELECT arg_min(level, place) AS level FROM ranked WHERE most > level * weight),
targets AS (
  SELECT source, source_size,
    CASE WHEN source_size > 0 THEN least(most, coalesce((SELECT level FROM shared) * weight, most)) ELSE 0.0 END::DOUBLE
    AS target
  FROM ranked
),
placed AS (
  SELECT doc_id, size, d.source, source_size, target,
    CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0 END::DOUBLE AS expected,
    row_number() OVER (PARTITION BY d.source ORDER BY size, doc_id) AS place
  FROM d JOIN targets t ON t.source IS NOT DISTINCT FROM d.source
),
tried AS (
  SELECT p.source, k.k, any_value(target) AS target,
    any_value(('0x' || substr(md5('mix:' || k.k || ':' || coalesce(p.source, '')), 1, 8))::BIGINT / 4294967296.0::DOUBLE) AS u
  FROM placed p CROSS JOIN range(16) k(k) GROUP BY ALL
),
sums AS (
  SELECT t.source, t.k, t.u, abs(sum(size * (floor(expected * place + u) - floor(expected * (place - 1) + u)))
    - any_value(t.target)) AS miss
  FROM placed p JOIN tried t ON t.source IS NOT DISTINCT FROM p.source GROUP BY ALL
),
chosen AS (SELECT source, arg_min(u, {'miss': miss, 'k': k}) AS u FROM sums GROUP BY source)
SELECT doc_id, size, source_size, target,
  (size * (floor(expected * place + u) - floor(expected * (place - 1) + u)))::BIGINT AS taken
FROM placed p JOIN chosen c ON c.source IS NOT DISTINCT FROM p.source
"""

NEAR_VECTORS = (
    """
WITH RECURSIVE v AS (
  SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS z FROM embeddings
  WHERE len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
edges AS (
  SELECT a.vec_id AS u, b.vec_id AS v FROM v a JOIN v b ON a.vec_id <> b.vec_id
  WHERE list_inner_product(a.z, b.z)
    >= 0.95::DOUBLE * sqrt(list_inner_product(a.z, a.z)) * sqrt(list_inner_product(b.z, b.z))
    AND list_inner_product(a.z, a.z) > 0 AND list_inner_product(b.z, b.z) > 0
),
nodes AS (SELECT vec_id AS id FROM embeddings),"""
    + _COMPONENTS
    + """
SELECT e.vec_id, (SELECT count(*) FROM edges WHERE u = e.vec_id)::BIGINT AS n_links, component_id,
  e.vec_id = component_id AS kept
FROM embeddings e JOIN labels ON node = e.vec_id
"""
)

WARC = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html FROM pages
),
d AS (
  SELECT page_id, octet_length(encode(html))::BIGINT AS payload_bytes, sha1(html) AS hex,
    min(page_id) OVER (PARTITION BY html) AS first
  FROM p
),
b AS (SELECT *, unhex(hex)::BIT::VARCHAR AS bits FROM d)
SELECT page_id, (SELECT url FROM pages q WHERE q.page_id = b.page_id) AS url, payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    (list_sum(list_transform(range(5), lambda j: substr(bits, (5 * i + j + 1)::BIGINT, 1)::INTEGER * (16 >> j)))
     + 1)::BIGINT, 1)), '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first THEN first END AS refers_to
FROM b
"""

MANIFEST = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, text,
    dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS tree,
    coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-')
      || coalesce(strlen(source) || ':' || source, '-')
      || coalesce(strlen(lang) || ':' || lang, '-')
      || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') AS head
  FROM documents
),
marked AS (
  SELECT *, replace(text, chr(10), '') AS bare,
    list_reduce(list_prepend(4294967295::BIGINT, list_transform(encode(doc_id::VARCHAR)::BIT::VARCHAR.regexp_extract_all('.{8}'),
      lambda b: ('0b' || b)::BIGINT)), lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)),
      lambda r, k: CASE WHEN r & 1 = 1 THEN xor(r >> 1, 3988292384) ELSE r >> 1 END)) AS crc
  FROM d
),
leaves AS (
  SELECT doc_id, tree, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
    CASE WHEN xor(crc, 4294967295) % 2 = 0 THEN sha256(head || coalesce(strlen(bare) || ':' || bare, '-')) END
      AS altered
  FROM marked
),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i,
    count(*) OVER (PARTITION BY tree) AS n, row_number() OVER () AS r
  FROM leaves
),
low(tree, level, i, n, h) AS (
  SELECT tree, 0, i, n, leaf FROM placed
  UNION ALL
  SELECT tree, level + 1, i // 3, (n + 2) // 3, sha256(string_agg(h, '' ORDER BY i))
  FROM low WHERE n > 1 GROUP BY tree, level, i // 3, n
),
subroots AS (SELECT tree, level AS height, h AS subroot FROM low WHERE n = 1),
high(level, i, n, h) AS (
  SELECT 0, tree, (SELECT count(*) FROM subroots), subroot FROM subroots
  UNION ALL
  SELECT level + 1, i // 3, (n + 2) // 3, sha256(string_agg(h, '' ORDER BY i))
  FROM high WHERE n > 1 GROUP BY level, i // 3, n
),
nodes AS (
  SELECT tree, level, i, n, h FROM low UNION ALL SELECT -1, level, i, n, h FROM high
),
sides AS (
  SELECT tree, level, i,
    coalesce(string_agg(h, '') OVER (run ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS pre,
    coalesce(string_agg(h, '') OVER (run ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS post
  FROM nodes WHERE n > 1 WINDOW run AS (PARTITION BY tree, level, i // 3 ORDER BY i)
),
steps AS (
  SELECT p.r, s.level AS step, pre, post
  FROM placed p JOIN sides s ON s.tree = p.tree AND s.i = p.i // (3 ** s.level)::BIGINT
  UNION ALL
  SELECT p.r, height + s.level, pre, post
  FROM placed p JOIN subroots USING (tree) JOIN sides s ON s.tree = -1 AND s.i = p.tree // (3 ** s.level)::BIGINT
),
folds(r, step, h) AS (
  SELECT r, 0, coalesce(altered, leaf) FROM placed
  UNION ALL
  SELECT f.r, f.step + 1, sha256(pre || h || post) FROM folds f JOIN steps s ON s.r = f.r AND s.step = f.step
),
folded AS (SELECT r, arg_max(h, step) AS folded_root FROM folds GROUP BY r),
proved AS (SELECT r, sha256(string_agg(pre || post, '' ORDER BY step)) AS proof FROM steps GROUP BY r),
root AS (SELECT h AS root FROM high WHERE n = 1)
SELECT doc_id, leaf, subroot, root, coalesce(proof, sha256('')) AS proof_sha256, folded_root,
  folded_root = root AS verified
FROM placed JOIN subroots USING (tree) JOIN folded USING (r) LEFT JOIN proved USING (r), root
"""
