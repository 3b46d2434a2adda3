"""SQL for the operators that SQL can express, over the driver's tables.

Tokenizers, trained models, packing and approximate search are tested against brute force instead.
"""

LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
SPACED = r"regexp_extract_all(coalesce({0}, ''), '[^\x20\x09-\x0D]+')"
FOLDED = r"regexp_extract_all(coalesce({0}, ''), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

SUBSTRING_DEDUP = f"""
WITH docs AS (SELECT doc_id, {SPACED.format("text")} AS ws FROM documents),
windows AS (SELECT doc_id, i, array_to_string(ws[i:i + 12], ' ') AS k FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS i FROM docs)),
firsts AS (SELECT k, min(doc_id) AS first FROM windows GROUP BY k),
removed AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS pos FROM windows JOIN firsts USING (k) WHERE first < doc_id),
words AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS pos FROM docs),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY pos) AS kept, count(*) AS n FROM words ANTI JOIN removed USING (doc_id, pos) GROUP BY doc_id)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM docs LEFT JOIN kept USING (doc_id)"""

WARC = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS raw FROM pages),
d AS (SELECT page_id, octet_length(raw) AS payload_bytes, sha1(raw) AS hex FROM p),
g AS (SELECT *, max(page_id) OVER (PARTITION BY hex, payload_bytes) AS top FROM d)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda c: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(((CAST('0x' || substr(hex, CAST((c // 8) * 10 + 1 AS INT), 10) AS BIGINT) >> CAST(35 - 5 * (c % 8) AS INT)) & 31) + 1 AS INT), 1)), '') AS payload_digest,
  CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> top THEN top END AS refers_to
FROM g"""

URL_FILTER = r"""
WITH r(host, path, action) AS (VALUES ('com', '/en/', 'block'), ('example.com', '/en/7', 'allow'), ('net', '/de/', 'allow'), ('example.net', '/de/8', 'block'), ('org', '/es/', 'block')),
cut AS (SELECT page_id, coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), '') AS h, coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
p AS (SELECT page_id, translate(h, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, path FROM cut),
fits AS (SELECT p.page_id, p.host AS host, p.path AS path, r.host || r.path AS rule, r.action, row_number() OVER (PARTITION BY p.page_id ORDER BY length(r.host || r.path) DESC, length(r.host) DESC) AS k FROM p JOIN r ON (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path))
SELECT p.page_id, p.host, p.path, f.rule, coalesce(f.action, 'allow') AS verdict FROM p LEFT JOIN fits f ON p.page_id = f.page_id AND k = 1"""

DECONTAMINATE = f"""
WITH docs AS (SELECT doc_id, {FOLDED.format(LOWER)} AS ws FROM documents),
items AS (SELECT item_id, {FOLDED.format(LOWER)} AS ws FROM benchmark),
item_windows AS (SELECT DISTINCT item_id, least(len(ws), 10) AS n, array_to_string(ws[i:i + 9], ' ') AS k FROM (SELECT item_id, ws, unnest(range(1, greatest(len(ws) - 9, 1) + 1)) AS i FROM items WHERE len(ws) > 0)),
sizes AS (SELECT DISTINCT n FROM item_windows),
doc_windows AS (SELECT doc_id, i, n, array_to_string(ws[i:i + n - 1], ' ') AS k FROM (SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM docs, sizes)),
found AS (SELECT doc_id, item_id, i, n FROM doc_windows JOIN item_windows USING (n, k)),
hits AS (SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS pos FROM found) GROUP BY doc_id),
owners AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS listed FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM found) GROUP BY doc_id)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(listed, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN hits USING (doc_id) LEFT JOIN owners USING (doc_id)"""

MINHASH = f"""
WITH RECURSIVE docs AS (SELECT doc_id, {SPACED.format(LOWER)} AS ws FROM documents),
sets AS (SELECT doc_id, list_sort(list_distinct(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) = 1 THEN [ws[1]] ELSE list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]) END)) AS s FROM docs),
reps AS (SELECT s, min(doc_id) AS rep, len(s) AS n FROM sets WHERE len(s) > 0 GROUP BY s),
shingles AS (SELECT rep, n, unnest(s) AS t FROM reps),
shared AS (SELECT a.rep AS a, b.rep AS b, a.n AS na, b.n AS nb, count(*) AS c FROM shingles a JOIN shingles b ON a.t = b.t AND a.rep < b.rep AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n) GROUP BY ALL),
links AS (SELECT a, b FROM shared WHERE 100 * c >= 80 * (na + nb - c) UNION ALL SELECT b, a FROM shared WHERE 100 * c >= 80 * (na + nb - c)),
reach(a, b) AS (SELECT rep, rep FROM reps UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
roots AS (SELECT a, min(b) AS root FROM reach GROUP BY a)
SELECT doc_id, CAST(len(sets.s) AS BIGINT) AS n_shingles, coalesce(root, doc_id) AS component_id, doc_id = coalesce(root, doc_id) AS kept
FROM sets LEFT JOIN reps ON sets.s = reps.s LEFT JOIN roots ON rep = a"""

COLLOCATIONS = rf"""
WITH pieces AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(coalesce({LOWER}, ''), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
lists AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM pieces),
totals AS (SELECT lang, CAST(sum(len(ws)) AS BIGINT) AS n FROM lists GROUP BY lang),
spans AS (SELECT lang, ws, m, unnest(range(1, len(ws) - m + 2)) AS i FROM lists, (SELECT unnest(range(1, 5)) AS m) WHERE len(ws) >= m),
f AS (SELECT lang, m, array_to_string(ws[i:i + m - 1], ' ') AS phrase, count(*) AS a FROM spans GROUP BY ALL HAVING count(*) >= 30),
c AS (SELECT *, string_split(phrase, ' ') AS ws FROM f WHERE m > 1),
cuts AS (SELECT lang, phrase, ws, m, a, unnest(range(1, m)) AS k FROM c),
scores AS (SELECT u.lang, u.phrase, u.m, u.a, k, x.a AS l, y.a AS r, CAST(CAST(2000000 AS HUGEINT) * u.a // (CAST(x.a AS HUGEINT) + y.a) AS BIGINT) AS score
  FROM cuts u JOIN f x ON x.lang = u.lang AND x.phrase = array_to_string(ws[1:k], ' ') JOIN f y ON y.lang = u.lang AND y.phrase = array_to_string(ws[k + 1:], ' ')),
weakest AS (SELECT * FROM scores QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
inner_ AS (SELECT lang, array_to_string(ws[j:j + size - 1], ' ') AS phrase, max(a) AS longer FROM (SELECT lang, ws, m, a, size, unnest(range(1, m - size + 2)) AS j FROM (SELECT lang, ws, m, a, unnest(range(2, m)) AS size FROM c WHERE m > 2)) GROUP BY ALL),
kept AS (SELECT w.* FROM weakest w LEFT JOIN inner_ i ON i.lang = w.lang AND i.phrase = w.phrase WHERE longer IS NULL OR CAST(100 AS HUGEINT) * longer < CAST(80 AS HUGEINT) * w.a),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN totals USING (lang) WHERE rank <= 2000"""

ORACLES = {"op1_substring_dedup": SUBSTRING_DEDUP, "op2_warc": WARC, "op4_url_filter": URL_FILTER, "op8_decontaminate": DECONTAMINATE, "op9_minhash": MINHASH, "op13_collocations": COLLOCATIONS}
