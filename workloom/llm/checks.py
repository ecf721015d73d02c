"""DuckDB SQL for the results of the queries that SQL can express. Plain methods, independent of the operators.

Without SQL: language models, the rule ensemble (learned), the token histogram (a tokenizer). Those are
tested against brute force or held-out accuracy.
"""

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

CHECKS = {
    # Pairs of distinct sets by shared shingles; classes by spreading the smallest id along links.
    "op1_minhash_neardup": rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') ws FROM documents),
s AS (SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
      ELSE list_sort(list_distinct([array_to_string(list_slice(ws, i, i + 4), ' ') FOR i IN range(1, len(ws) - 3)])) END sh FROM w),
n AS (SELECT doc_id, len(sh) n, sh FROM s),
node AS (SELECT sh, min(doc_id) node, any_value(n) n FROM n WHERE n > 0 GROUP BY sh),
x AS (SELECT node, n, unnest(sh) g FROM node),
common AS (SELECT a.node a, b.node b, any_value(a.n) na, any_value(b.n) nb, count(*) c FROM x a JOIN x b ON a.g = b.g AND a.node < b.node GROUP BY ALL),
link AS (SELECT a, b FROM common WHERE 100 * c >= 75 * (na + nb - c)),
edge AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
reach AS (SELECT node AS origin, node AS spot FROM node UNION SELECT r.origin, e.b FROM reach r JOIN edge e ON r.spot = e.a),
comp AS (SELECT origin AS node, min(spot) c FROM reach GROUP BY 1)
SELECT n.doc_id, n.n::BIGINT AS n_shingles, coalesce(comp.c, n.doc_id) AS component_id, n.doc_id = coalesce(comp.c, n.doc_id) AS kept
FROM n LEFT JOIN node ON n.sh = node.sh AND n.n > 0 LEFT JOIN comp USING (node)""",
    # Turn lists compared as whole strings.
    "op3_chat_formatting": r"""
WITH t AS (SELECT conv_id, turn, concat(coalesce(length(role), -1), ':', coalesce(role, ''), coalesce(length(text), -1), ':', coalesce(text, ''), ';') k,
  '<|im_start|>' || regexp_replace(coalesce(role, ''), '<\|(im_start|im_end)\|>', '<\1>', 'g') || chr(10)
  || regexp_replace(coalesce(text, ''), '<\|(im_start|im_end)\|>', '<\1>', 'g') || '<|im_end|>' || chr(10) body FROM conversations),
p AS (SELECT conv_id, row_number() OVER o place, count(*) OVER (PARTITION BY conv_id) n,
  string_agg(md5(k), '') OVER (o ROWS UNBOUNDED PRECEDING) pre FROM t WINDOW o AS (PARTITION BY conv_id ORDER BY turn)),
whole AS (SELECT pre, min(conv_id) conv_id, any_value(n) n_turns, count(*) n_copies FROM p WHERE place = n GROUP BY pre),
part AS (SELECT DISTINCT pre FROM p WHERE place < n),
body AS (SELECT conv_id, string_agg(body, '' ORDER BY turn) text FROM t GROUP BY conv_id)
SELECT conv_id, n_turns, n_copies, text FROM whole ANTI JOIN part USING (pre) JOIN body USING (conv_id)""",
    "op4_decontamination": rf"""
WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') ws FROM documents),
i AS (SELECT item_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') ws FROM benchmark),
p AS (SELECT DISTINCT item_id, l, array_to_string(list_slice(ws, k, k + l - 1), ' ') pat FROM
  (SELECT item_id, ws, least(13, len(ws)) l, unnest(range(1, len(ws) - least(13, len(ws)) + 2)) k FROM i WHERE len(ws) > 0)),
g AS (SELECT doc_id, k, l, array_to_string(list_slice(ws, k, k + l - 1), ' ') pat FROM
  (SELECT doc_id, ws, l, unnest(range(1, len(ws) - l + 2)) k FROM d, (SELECT DISTINCT l FROM p) WHERE len(ws) >= l)),
h AS (SELECT doc_id, item_id, k, l FROM g JOIN p USING (l, pat)),
hit AS (SELECT doc_id, count(DISTINCT spot) n FROM (SELECT doc_id, unnest(range(k, k + l)) spot FROM h) GROUP BY 1),
it AS (SELECT doc_id, count(*) n, string_agg(item, ',' ORDER BY item) items FROM (SELECT DISTINCT doc_id, item_id::VARCHAR item FROM h) GROUP BY 1)
SELECT doc_id, len(ws) AS n_words, coalesce(hit.n, 0) AS n_hit, coalesce(it.n, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
  coalesce(hit.n, 0) > 0 AND 20 * coalesce(hit.n, 0) >= len(ws) AS contaminated FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN it USING (doc_id)""",
    "op5_topk_search": r"""
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id query_id, v.vec_id, list_dot_product(q.e, v.e)::BIGINT score FROM v q, v WHERE q.vec_id % 100 = 0 AND q.vec_id <> v.vec_id)
SELECT query_id, (row_number() OVER o)::INTEGER AS rank, vec_id, score FROM s
WINDOW o AS (PARTITION BY query_id ORDER BY score DESC, vec_id) QUALIFY row_number() OVER o <= 10""",
    "op7_source_mixing": r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) size,
  ('0x' || substr(md5(concat_ws('|', doc_id::VARCHAR, text)), 1, 15))::BIGINT h FROM documents),
s AS (SELECT source, sum(size)::BIGINT source_size, row_number() OVER (ORDER BY source NULLS LAST) place FROM d GROUP BY source),
w AS (SELECT *, [3.0::DOUBLE, 1.0, 2.0][((place - 1) % 3 + 1)::INTEGER] weight, 2.0::DOUBLE * source_size cap FROM s),
r AS (SELECT *, 1.5::DOUBLE * (SELECT sum(source_size)::BIGINT FROM s) budget, coalesce(sum(cap) OVER (ORDER BY cap / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) before,
  sum(weight) OVER (ORDER BY cap / weight, place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) open_weight FROM w),
l AS (SELECT (budget - before) / open_weight level FROM r WHERE cap / weight > (budget - before) / open_weight ORDER BY cap / weight, place LIMIT 1),
t AS (SELECT source, source_size, coalesce(least(cap, weight * (SELECT level FROM l)), cap) target FROM w),
u AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END whole FROM t),
g AS (SELECT source, h, sum(size) words, sum(sum(size)) OVER (PARTITION BY source ORDER BY h) upto FROM d GROUP BY source, h),
e AS (SELECT g.source, h, upto <= target - whole * source_size OR (upto - words <= target - whole * source_size AND
  upto - (target - whole * source_size) <= (target - whole * source_size) - (upto - words)) more FROM g JOIN u ON g.source IS NOT DISTINCT FROM u.source)
SELECT doc_id, size, source_size, target, ((whole + CASE WHEN more AND size > 0 THEN 1 ELSE 0 END) * size)::BIGINT AS taken, d.source,
  (whole + CASE WHEN more THEN 1 ELSE 0 END)::INTEGER AS copies
FROM d JOIN u ON d.source IS NOT DISTINCT FROM u.source JOIN e ON d.source IS NOT DISTINCT FROM e.source AND d.h = e.h""",
    "op9_line_dedup": r"""
WITH p AS (SELECT page_id, nullif(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1)), '') host,
  list_filter(string_split(regexp_replace(regexp_replace(html, '(?s)<script.*?</script>|<style.*?</style>|<!--.*?-->', chr(10), 'g'), '<[^>]*>', chr(10), 'g'), chr(10)),
    lambda x: regexp_matches(x, '\S')) ls FROM pages),
c AS (SELECT host, line, count(*) n FROM (SELECT host, unnest(list_distinct(list_transform(ls, lambda x: trim(x, chr(32) || chr(9) || chr(13))))) line FROM p) GROUP BY ALL),
t AS (SELECT host, count(*) pages FROM p GROUP BY 1),
bad AS (SELECT c.host, list(line) lines FROM c JOIN t ON c.host IS NOT DISTINCT FROM t.host WHERE n >= 5 AND n > 0.02 * pages GROUP BY 1),
k AS (SELECT page_id, p.host, ls, list_filter(ls, lambda x: NOT list_contains(coalesce(bad.lines, []), trim(x, chr(32) || chr(9) || chr(13)))) kept
  FROM p LEFT JOIN bad ON p.host IS NOT DISTINCT FROM bad.host)
SELECT page_id, host, array_to_string(kept, chr(10)) AS text, len(ls) AS n_lines, len(ls) - len(kept) AS n_dropped FROM k""",
    "op10_warc_roundtrip": r"""
WITH p AS (SELECT page_id, encode(coalesce(html, '')) b FROM pages),
d AS (SELECT page_id, octet_length(b) n, sha256(b) h FROM p),
f AS (SELECT h, min(page_id) first FROM d WHERE n >= 100 GROUP BY h)
SELECT page_id, n::BIGINT AS payload_bytes, h AS payload_digest, CASE WHEN page_id > first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id > first THEN first END AS refers_to FROM d LEFT JOIN f USING (h)""",
    # Counts by part and set of failed filters, then every order.
    "op11_filter_audit": r"""
WITH d AS (SELECT doc_id, coalesce(lang, '') part, coalesce(text, '') t FROM documents),
m AS (SELECT doc_id, part, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') ws, min(doc_id) OVER (PARTITION BY t) first FROM d),
f AS (SELECT doc_id, part, len(ws) < 200 a, 100 * len(list_distinct(ws)) < 50 * len(ws) b,
  100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t) c, regexp_matches(t, '[#$%&*|]') e, coalesce(doc_id > first, false) g FROM m),
l AS (SELECT doc_id, max((quality = 1)::INT) good, max((toxic = 1)::INT) toxic FROM labels GROUP BY 1),
s AS (SELECT part, a::INT + 2 * b::INT + 4 * c::INT + 8 * e::INT + 16 * g::INT bits, count(*) n, sum(coalesce(good, 0)) good, sum(coalesce(toxic, 0)) toxic
  FROM f LEFT JOIN l USING (doc_id) GROUP BY ALL),
x AS (SELECT unnest(range(5)) i),
o AS (SELECT [p.i, q.i, r.i, t.i, u.i] v FROM x p, x q, x r, x t, x u WHERE len(list_distinct([p.i, q.i, r.i, t.i, u.i])) = 5),
k AS (SELECT array_to_string(list_transform(v, lambda i: substr('ABCDE', i::INT + 1, 1)), '') filter_order, step, 1 << v[step]::INT own,
  coalesce(list_sum(list_transform(v[1:step - 1], lambda i: 1 << i::INT)), 0)::BIGINT prior FROM o, (SELECT unnest(range(1, 6)) step)),
r AS (SELECT part, filter_order, step, own, sum(n) FILTER (bits & (prior | own) = 0) kept, sum(n) FILTER (bits & own > 0 AND bits & prior = 0) removed,
  sum(n) FILTER (bits & own > 0 AND bits & prior > 0) redundant, sum(n) FILTER (bits = own) unique_fails,
  sum(good) FILTER (bits & own > 0 AND bits & prior = 0) good_lost, sum(toxic) FILTER (bits & own > 0 AND bits & prior = 0) toxic_lost FROM s, k GROUP BY ALL)
SELECT part, filter_order, step::INTEGER AS step, coalesce(kept, 0)::BIGINT AS kept, coalesce(removed, 0)::BIGINT AS removed, coalesce(redundant, 0)::BIGINT AS redundant,
  coalesce(unique_fails, 0)::BIGINT AS unique_fails, coalesce(good_lost, 0)::BIGINT AS good_lost, coalesce(toxic_lost, 0)::BIGINT AS toxic_lost,
  sum(coalesce(removed, 0)) OVER (PARTITION BY part, own)::BIGINT AS shapley FROM r""",
    # Every pair of item and document that share a term, scored.
    "op13_lexical_search": rf"""
WITH t AS (SELECT doc_id, unnest(regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) term FROM documents),
f AS (SELECT doc_id, term, count(*) tf FROM t GROUP BY ALL),
len AS (SELECT doc_id, sum(tf)::BIGINT n FROM f GROUP BY 1),
tot AS (SELECT count(*) nn, sum(n)::BIGINT ll FROM len),
w AS (SELECT term, floor(1000 * ln((2 * nn + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT w FROM f, tot GROUP BY term, nn),
m AS (SELECT doc_id, 50 + (50 * n * nn) // ll m FROM len, tot),
q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) term FROM benchmark),
s AS (SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m)))::BIGINT score FROM q JOIN f USING (term) JOIN w USING (term) JOIN m USING (doc_id) GROUP BY ALL)
SELECT item_id, (row_number() OVER o)::INTEGER AS rank, doc_id, score FROM s WHERE score > 0
WINDOW o AS (PARTITION BY item_id ORDER BY score DESC, doc_id) QUALIFY row_number() OVER o <= 50""",
    # Pairs of distinct sets by shared shingles, classes by spreading the smallest id along links.
    "op12_ngram_join": rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') ws FROM documents),
s AS (SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')]
      ELSE list_sort(list_distinct([array_to_string(list_slice(ws, i, i + 3), ' ') FOR i IN range(1, len(ws) - 2)])) END sh FROM w),
n AS (SELECT doc_id, len(sh) n, sh FROM s),
node AS (SELECT sh, min(doc_id) node, any_value(n) n FROM n WHERE n > 0 GROUP BY sh),
x AS (SELECT node, n, unnest(sh) g FROM node),
common AS (SELECT a.node a, b.node b, any_value(a.n) na, any_value(b.n) nb, count(*) c FROM x a JOIN x b ON a.g = b.g AND a.node < b.node GROUP BY ALL),
link AS (SELECT a, b FROM common WHERE 100 * c >= 85 * (na + nb - c)),
edge AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
reach AS (SELECT node AS origin, node AS spot FROM node UNION SELECT r.origin, e.b FROM reach r JOIN edge e ON r.spot = e.a),
comp AS (SELECT origin AS node, min(spot) c FROM reach GROUP BY 1)
SELECT n.doc_id, n.n::BIGINT AS n_shingles, coalesce(comp.c, n.doc_id) AS component_id
FROM n LEFT JOIN node ON n.sh = node.sh AND n.n > 0 LEFT JOIN comp USING (node)""",
}
