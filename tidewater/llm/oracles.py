"""DuckDB SQL for the corpus queries that SQL can express, over whole tables."""

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_FOLDED = f"translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}')"
_SPACE_WORD = r"[^\x20\x09-\x0D]+"
#: The sequence of n words that starts at each position of w.
_WINDOWS = "list_transform(range(1, len(w) - {n} + 2), lambda i: array_to_string(w[i:i + {n} - 1], ' '))"

MINHASH = f"""WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_FOLDED}, '{_SPACE_WORD}') w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) >= 5 THEN list_distinct({_WINDOWS.format(n=5)}) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END k, len(w) < 5 short FROM d),
sets AS (SELECT min(doc_id) rep, list_sort(k) k, short FROM s GROUP BY list_sort(k), short),
e AS (SELECT rep, short, len(k) n, unnest(k) x FROM sets),
links AS (SELECT a.rep a, b.rep b FROM e a JOIN e b ON a.x = b.x AND a.short = b.short AND a.rep < b.rep GROUP BY a.rep, b.rep, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT rep a, rep b FROM sets UNION SELECT r.a, l.b FROM reach r JOIN both_ways l ON l.a = r.b),
least AS (SELECT a rep, min(b) root FROM reach GROUP BY a)
SELECT s.doc_id, CAST(len(s.k) AS BIGINT) n_shingles, CASE WHEN len(s.k) = 0 THEN s.doc_id ELSE root END component_id, len(s.k) = 0 OR s.doc_id = root kept
FROM s JOIN sets ON list_sort(s.k) = sets.k AND s.short = sets.short JOIN least USING (rep)"""

SUBSTRING = f"""WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{_SPACE_WORD}') w FROM documents),
x AS (SELECT doc_id, unnest(k) k, generate_subscripts(k, 1) i FROM (SELECT doc_id, list_transform({_WINDOWS.format(n=50)}, lambda t: md5(t)) k FROM d WHERE len(w) >= 50)),
hits AS (SELECT x.doc_id, x.i FROM x JOIN (SELECT k, min(doc_id) first FROM x GROUP BY k) USING (k) WHERE x.doc_id > first),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) p FROM hits),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) t, count(*) n FROM (SELECT doc_id, unnest(w) word, generate_subscripts(w, 1) p FROM d) ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) n_removed, sha256(coalesce(t, '')) kept_sha256 FROM d LEFT JOIN kept USING (doc_id)"""

EMBEDDINGS = """WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) e FROM embeddings WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (SELECT a.vec_id a, b.vec_id b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.95),
reach AS (SELECT vec_id a, vec_id b FROM embeddings UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b)
SELECT a vec_id, (SELECT count(*) FROM links l WHERE l.a = r.a) n_links, min(b) component_id, a = min(b) kept FROM reach r GROUP BY a"""

DECONTAMINATE = rf"""WITH d AS (SELECT doc_id, regexp_extract_all({_FOLDED}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w FROM documents),
b AS (SELECT item_id, w, least(10, len(w)) s FROM (SELECT item_id, regexp_extract_all({_FOLDED}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w FROM benchmark) WHERE len(w) > 0),
windows AS (SELECT DISTINCT CAST(item_id AS VARCHAR) item, s, unnest({_WINDOWS.format(n="s")}) k FROM b),
x AS (SELECT doc_id, s, unnest(k) k, generate_subscripts(k, 1) i FROM (SELECT doc_id, s, {_WINDOWS.format(n="s")} k FROM d, (SELECT DISTINCT s FROM b) WHERE len(w) >= s)),
hits AS (SELECT doc_id, i, s, item FROM x JOIN windows USING (s, k)),
n AS (SELECT doc_id, count(DISTINCT p) n_hit FROM (SELECT doc_id, unnest(range(i, i + s)) p FROM hits) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) n_items, string_agg(item, ',' ORDER BY item) t FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) n_words, coalesce(n_hit, 0) n_hit, coalesce(n_items, 0) n_items, sha256(coalesce(t, '')) items_sha256, coalesce(n_hit, 0) > 0 contaminated FROM d LEFT JOIN n USING (doc_id) LEFT JOIN items USING (doc_id)"""

WARC = """WITH p AS (SELECT page_id, coalesce(html, '') html FROM pages), h AS (SELECT *, sha1(html) x, min(page_id) OVER (PARTITION BY html) first FROM p)
SELECT page_id, CAST(strlen(html) AS BIGINT) payload_bytes, list_aggregate(list_transform(range(32), lambda j: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((CAST('0x' || substr(x, CAST(1 + 5 * (j // 4) AS INT), 5) AS INT) >> CAST(15 - 5 * (j % 4) AS INT)) & 31), 1)), 'string_agg', '') payload_digest,
CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END record_type, CASE WHEN page_id <> first THEN first END refers_to FROM h"""

SHARDING = "SELECT doc_id, CAST(strlen(coalesce(text, '')) AS BIGINT) text_bytes, sha256(coalesce(text, '')) text_sha256, TRUE AS in_manifest, TRUE AS within_target FROM documents"
