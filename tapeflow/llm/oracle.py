"""DuckDB SQL of the queries that SQL can express: brute force over the whole
tables (every pair of vectors, every pair of documents with a common shingle)."""

from __future__ import annotations

_SOUND = ("embedding IS NOT NULL AND len(embedding) > 0 AND vec_id IS NOT NULL AND "
          "len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0")

OP7 = f"""
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS e
           FROM embeddings WHERE {_SOUND}),
s AS (SELECT q.vec_id AS query_id, c.vec_id,
             CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e)
      WHERE q.vec_id % 20 = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
WHERE rank <= 20"""

OP4 = f"""
WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
           WHERE {_SOUND} AND len(list_filter(embedding, lambda x: x <> 0)) > 0 AND label IS NOT NULL),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b
      ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
      WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
reach AS (SELECT vec_id AS n, vec_id AS m FROM embeddings
          UNION SELECT l.b, reach.m FROM reach JOIN l ON l.a = reach.n),
c AS (SELECT n, min(m) AS component_id FROM reach GROUP BY n),
k AS (SELECT a, count(*) AS n_links FROM l GROUP BY a)
SELECT e.vec_id, coalesce(k.n_links, 0) AS n_links, c.component_id,
       e.vec_id = c.component_id AS kept
FROM embeddings e JOIN c ON c.n = e.vec_id LEFT JOIN k ON k.a = e.vec_id"""

OP9 = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5
        THEN list_transform(generate_series(1, len(w) - 4), lambda i: list_slice(w, i, i + 4))
        WHEN len(w) > 0 THEN [w] ELSE [] END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b
      ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b
      WHERE 100 * k >= 75 * (x.n + y.n - k)),
reach AS (SELECT doc_id AS d, doc_id AS m FROM documents
          UNION SELECT l.b, reach.m FROM reach JOIN l ON l.a = reach.d),
c AS (SELECT d, min(m) AS component_id FROM reach GROUP BY d)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id, w.doc_id = c.component_id AS kept
FROM w JOIN c ON c.d = w.doc_id LEFT JOIN n ON n.doc_id = w.doc_id"""

OP11 = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
g AS (SELECT DISTINCT item, unnest(CASE WHEN len(w) >= 10
        THEN list_transform(generate_series(1, len(w) - 9), lambda i: list_slice(w, i, i + 9))
        WHEN len(w) > 0 THEN [w] ELSE [] END) AS g FROM b),
spans AS (SELECT DISTINCT len(g) AS n FROM g),
p AS (SELECT r, n, unnest(generate_series(1, len(w) - n + 1)) AS i, w FROM d, spans
      WHERE len(w) >= n),
h AS (SELECT p.r, p.i, p.n, g.item FROM p JOIN g ON g.g = list_slice(p.w, p.i, p.i + p.n - 1)),
k AS (SELECT r, count(DISTINCT x) AS n_hit
      FROM (SELECT DISTINCT r, unnest(generate_series(i, i + n - 1)) AS x FROM h) GROUP BY r),
t AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
      FROM (SELECT DISTINCT r, item FROM h WHERE item IS NOT NULL) GROUP BY r)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(k.n_hit, 0) AS n_hit,
       coalesce(t.n_items, 0) AS n_items, sha256(coalesce(t.items, '')) AS items_sha256,
       coalesce(k.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN k ON k.r = d.r LEFT JOIN t ON t.r = d.r"""

# crc32 bit by bit over a table of 256 remainders; letters from U+00C0 to U+00FF
# stand as one byte each for levenshtein, which counts bytes.
_WIDE = "".join(chr(c) for c in range(0xC0, 0x100))
_BYTES = "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789!#$%&()*+,-./:;<=>?@[]^_{|}~`"[:64]
OP13 = f"""
WITH RECURSIVE bits AS (SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce(
        list_concat([i], [0, 0, 0, 0, 0, 0, 0, 0]),
        lambda c, b: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) AS c
    FROM (SELECT CAST(unnest(generate_series(0, 255)) AS BIGINT) AS i))),
r AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
        'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\u00C0-\u00FF]+')) AS run
      FROM documents WHERE text IS NOT NULL),
u AS (SELECT doc_id, run, count(*) AS n FROM r WHERE length(run) >= 6 GROUP BY ALL),
b AS (SELECT doc_id, run, n, flatten(list_transform(string_split(
        coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run, ''),
        lambda c: CASE WHEN ord(c) < 128 THEN [CAST(ord(c) AS BIGINT)]
                  ELSE [192 + ord(c) // 64, CAST(128 + ord(c) % 64 AS BIGINT)] END)) AS x FROM u),
h AS (SELECT run, n, xor(list_reduce(list_concat([4294967295], x),
        lambda c, y: xor(c // 256, t[xor(c % 256, y) + 1])), 4294967295) AS h FROM b, bits),
w AS (SELECT CASE WHEN h % 199 = 0 THEN substr(run, 1, CAST(h % length(run) AS INTEGER))
        || substr(run, CAST(h % length(run) AS INTEGER) + 2) ELSE run END AS word, n FROM h),
v AS (SELECT word, CAST(sum(n) AS BIGINT) AS n, translate(word, '{_WIDE}', '{_BYTES}') AS k,
             length(word) AS l FROM w WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
p AS (SELECT x.word, x.n, y.word AS other, y.n AS other_n FROM v x JOIN v y
      ON y.l BETWEEN x.l - 1 AND x.l + 1 WHERE levenshtein(x.k, y.k) = 1),
f AS (SELECT word, count(*) AS n_near, max(other_n) AS top FROM p GROUP BY word),
g AS (SELECT p.word, min(p.other) AS form, min(f.top) AS form_n FROM p JOIN f USING (word)
      WHERE p.other_n = f.top AND f.top >= 5 * p.n GROUP BY p.word),
chain AS (SELECT word, word AS root, 0 AS step FROM v
          UNION ALL SELECT c.word, g.form, c.step + 1 FROM chain c JOIN g ON g.word = c.root)
SELECT v.word, g.form, c.root, v.n, coalesce(f.n_near, 0) AS n_near, g.form_n
FROM v LEFT JOIN g ON g.word = v.word LEFT JOIN f ON f.word = v.word
JOIN (SELECT word, arg_max(root, step) AS root FROM chain GROUP BY word) c ON c.word = v.word"""

ORACLE = {"op4_embedding_dedup": OP4, "op7_topk": OP7, "op9_minhash": OP9,
          "op11_decontamination": OP11, "op13_spelling": OP13}
