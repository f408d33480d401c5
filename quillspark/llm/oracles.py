"""DuckDB SQL for the queries that SQL can express."""

OP10 = r"""
WITH rules(rhost, rpath, verdict) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
urls AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
parts AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^([^/?#]*)([^?#]*)', 2) AS path FROM urls),
best AS (SELECT host, path, max({'size': length(rhost) + length(rpath), 'host_size': length(rhost), 'rule': rhost || rpath, 'verdict': verdict}) AS b FROM (SELECT DISTINCT host, path FROM parts) JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY ALL)
SELECT page_id, host, path, b.rule AS rule, coalesce(b.verdict, 'allow') AS verdict FROM parts LEFT JOIN best USING (host, path)
"""

OP4 = r"""
WITH doc_words AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') AS w FROM documents),
item_words AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') AS w FROM benchmark),
wins AS (SELECT item_id, least(len(w), 13) AS size, w[s : s + least(len(w), 13) - 1] AS win FROM item_words, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS u(s) WHERE len(w) > 0),
doc_windows AS (SELECT doc_id, s AS pos, size, w[s : s + size - 1] AS win FROM doc_words, (SELECT DISTINCT size FROM wins), unnest(range(1, len(w) - size + 2)) AS u(s)),
hits AS (SELECT DISTINCT doc_id, pos, size, item_id FROM doc_windows JOIN wins USING (size, win)),
words_hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM hits, unnest(range(pos, pos + size)) AS u(p) GROUP BY doc_id),
items_hit AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS items FROM hits GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM doc_words LEFT JOIN words_hit USING (doc_id) LEFT JOIN items_hit USING (doc_id)
"""

OP1 = r"""
WITH bodies AS (SELECT doc_id, encode(coalesce(text, '')) AS b FROM documents),
starts AS (SELECT doc_id, p, md5(b[p : p + 199]) AS h FROM bodies, unnest(range(1, octet_length(b) - 198)) AS u(p)),
repeated AS (SELECT doc_id, p FROM starts JOIN (SELECT h FROM starts GROUP BY h HAVING count(*) > 1) USING (h)),
edges AS (SELECT doc_id, p, CASE WHEN p > 200 + lag(p, 1, -999) OVER (PARTITION BY doc_id ORDER BY p) THEN 1 ELSE 0 END AS new FROM repeated),
numbered AS (SELECT doc_id, p, sum(new) OVER (PARTITION BY doc_id ORDER BY p) AS span FROM edges),
spans AS (SELECT doc_id, span, min(p) AS a, max(p) + 200 AS z FROM numbered GROUP BY doc_id, span),
gaps AS (SELECT doc_id, a AS kept_to, z AS next_from, lag(z, 1, 1) OVER (PARTITION BY doc_id ORDER BY a) AS kept_from, lead(a) OVER (PARTITION BY doc_id ORDER BY a) IS NULL AS final FROM spans),
kept AS (SELECT doc_id, string_agg(CASE WHEN kept_to > kept_from THEN hex(b[kept_from : kept_to - 1]) ELSE '' END || CASE WHEN final AND next_from <= octet_length(b) THEN hex(b[next_from : octet_length(b)]) ELSE '' END, '' ORDER BY kept_to) AS left_over, sum(next_from - kept_to) AS n_removed, count(*) AS n_spans FROM gaps JOIN bodies USING (doc_id) GROUP BY doc_id)
SELECT doc_id, octet_length(b) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(CASE WHEN left_over IS NULL THEN b ELSE unhex(left_over) END) AS kept_sha256
FROM bodies LEFT JOIN kept USING (doc_id)
"""

OP12 = r"""
WITH pieces AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x{0A}-\x{0D}]')) AS piece FROM documents),
split AS (SELECT lang, regexp_extract_all(piece, '[^ \t]+') AS w FROM pieces),
totals AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM split GROUP BY lang),
grams AS (SELECT lang, k, array_to_string(w[s : s + k - 1], ' ') AS phrase, count(*) AS f FROM split, (VALUES (1), (2), (3), (4)) AS sizes(k), unnest(range(1, len(w) - k + 2)) AS u(s) GROUP BY lang, k, phrase HAVING count(*) >= 30),
cuts AS (SELECT lang, phrase, f AS a, j, array_to_string(string_split(phrase, ' ')[1 : j], ' ') AS first_part, array_to_string(string_split(phrase, ' ')[j + 1 : k], ' ') AS rest FROM grams, unnest(range(1, k)) AS u(j) WHERE k > 1),
scores AS (SELECT cuts.lang, cuts.phrase, a, j, x.f AS l, y.f AS r, CAST(2000000::HUGEINT * a // (x.f + y.f) AS BIGINT) AS score FROM cuts JOIN grams x ON x.lang = cuts.lang AND x.phrase = first_part JOIN grams y ON y.lang = cuts.lang AND y.phrase = rest),
best AS (SELECT * FROM scores QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
inside AS (SELECT lang, array_to_string(string_split(phrase, ' ')[s : s + m - 1], ' ') AS phrase, max(f) AS longer FROM grams, unnest(range(2, k)) AS u(m), unnest(range(1, k - m + 2)) AS v(s) WHERE k > 2 GROUP BY ALL),
ranked AS (SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, score FROM best LEFT JOIN inside USING (lang, phrase) WHERE longer IS NULL OR 100 * longer < 80 * a)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN totals USING (lang) WHERE rank <= 2000
"""

OP13 = r"""
WITH docs AS (SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{80}-\x{10FFFF}]+') AS t FROM documents),
words AS (SELECT id, lang, source, unnest(t) AS term FROM docs),
kept AS (SELECT lang, term FROM words GROUP BY lang, term HAVING count(DISTINCT id) >= 30),
sizes AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
counts AS (SELECT lang, source, term, count(*) AS c FROM words JOIN kept USING (lang, term) GROUP BY ALL),
groups AS (SELECT DISTINCT lang, source FROM docs),
totals AS (SELECT lang, source, coalesce(sum(c), 0) AS n FROM groups LEFT JOIN counts USING (lang, source) GROUP BY ALL),
p AS (SELECT lang, source, term, coalesce(c, 0) AS c, CAST(1 + 1000000000::HUGEINT * (coalesce(c, 0) + 5) // (n + 5 * v) AS BIGINT) AS p FROM totals JOIN kept USING (lang) JOIN sizes USING (lang) LEFT JOIN counts USING (lang, source, term)),
q AS (SELECT lang, term, CAST(1 + 1000000000::HUGEINT * (sum(c) + 5) // (any_value(n) + 5 * any_value(v)) AS BIGINT) AS q FROM counts JOIN (SELECT lang, sum(n) AS n FROM totals GROUP BY lang) USING (lang) JOIN sizes USING (lang) GROUP BY ALL),
pairs AS (SELECT a.lang, a.source, b.source AS item, CAST(sum(abs(a.p - b.p)) AS BIGINT) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
found AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN pairs ON pairs.lang = a.lang AND pairs.source = a.source AND pairs.item = b.source
          UNION ALL SELECT lang, source, 'term', term, p - q FROM p JOIN q USING (lang, term) WHERE c > 0 AND p > q)
SELECT lang, source, part, item, value, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM found QUALIFY part = 'pair' OR rank <= 50
"""
