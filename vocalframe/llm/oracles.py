"""DuckDB SQL with the rows of those queries that SQL can express."""

from __future__ import annotations

ORACLES: dict[str, str] = {}

ORACLES["op3_url_filters"] = r"""
WITH RECURSIVE written AS (
  SELECT url AS src, unnest(list_concat(
    list_transform(regexp_extract_all(coalesce(html,''), '(?is)(<link\b[^>]*\brel\s*=\s*["'']?canonical\b[^>]*>)', 1),
                   lambda t: regexp_extract(t, '(?is)\bhref\s*=\s*["'']?([^"''\s>]+)', 1)),
    list_transform(regexp_extract_all(coalesce(html,''), '(?is)(<meta\b[^>]*\bhttp-equiv\s*=\s*["'']?refresh\b[^>]*>)', 1),
                   lambda t: regexp_extract(t, '(?is)\burl\s*=\s*["'']?([^"''\s>]+)', 1)))) AS t
  FROM pages WHERE url IS NOT NULL),
split AS (SELECT DISTINCT src, t, regexp_extract(src, '(?s)^(.*?://[^/?#]*)', 1) AS site, regexp_extract(src, '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS p,
                 regexp_extract(t, '^([^?#]*)', 1) AS tp FROM written WHERE t <> ''),
joined AS (SELECT *, CASE WHEN tp = '' THEN p WHEN starts_with(tp, '/') THEN tp ELSE '/' || substr(regexp_extract(p, '(?s)^(.*/)', 1), 2) || tp END AS j FROM split),
-- a '..' takes the last segment away, never the empty one before the first slash
walked AS (SELECT *, CASE WHEN NOT regexp_matches(j, '(?s)/\.\.?(/|$)') THEN j ELSE array_to_string(list_reduce(
             list_transform(list_concat(string_split(j, '/'), CASE WHEN regexp_matches(j, '(?s)/\.\.?$') THEN [''] ELSE [] END), lambda x: [x]),
             lambda a, x: CASE x[1] WHEN '.' THEN a WHEN '..' THEN a[1:greatest(len(a) - 1, 1)] ELSE list_concat(a, x) END), '/') END AS k FROM joined),
links AS (SELECT src, dst FROM (SELECT src, CASE
    WHEN regexp_matches(t, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN t
    WHEN NOT contains(src, '://') OR starts_with(t, '#') OR regexp_matches(t, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN NULL
    WHEN starts_with(t, '//') THEN regexp_extract(src, '(?s)^(.*?)://', 1) || ':' || t
    ELSE site || k || substr(t, length(tp) + 1) END AS dst FROM walked) WHERE dst IS NOT NULL),
urls AS (SELECT DISTINCT url FROM (SELECT url FROM pages UNION ALL SELECT dst FROM links) WHERE contains(url, '://')),
cut AS (SELECT url, substr(url, instr(url, '://') + 3) AS a,
               list_filter(string_split(regexp_extract(url, '(?s)^[^#]*?\?([^#]*)', 1), '&'),
                 lambda q: q <> '' AND NOT regexp_matches(q, '^(utm_[^=&]*|ref|fbclid|gclid)(=|$)')) AS qs FROM urls),
parts AS (SELECT url, translate(regexp_extract(a, '(?s)^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                 regexp_extract(a, '(?s)^[^/?#]*([^?#]*)', 1) AS path, array_to_string(list_sort(qs), '&') AS q FROM cut),
rules(verdict, rh, rp) AS (VALUES ('allow','com','/'), ('block','example.com','/en/'), ('allow','www.example.com','/en/'),
                                  ('block','net','/es/'), ('block','net','/fr/')),
fits AS (SELECT url, verdict, rh || rp AS rule,
                row_number() OVER (PARTITION BY url ORDER BY length(rh || rp) DESC, verdict) AS k
         FROM parts JOIN rules ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp)),
best AS (SELECT url, verdict, rule FROM fits WHERE k = 1),
forms AS (SELECT url, '//' || host || regexp_replace(path, '(\.html|/)$', '') || CASE WHEN q <> '' THEN '?' || q ELSE '' END AS form FROM parts),
-- urls of one form are one node; declared links join forms
fe AS (SELECT DISTINCT a.form AS x, b.form AS y FROM links l JOIN forms a ON a.url = l.src JOIN forms b ON b.url = l.dst),
sym AS (SELECT x, y FROM fe UNION SELECT y, x FROM fe UNION SELECT form, form FROM forms),
reach(x, y) AS (SELECT x, y FROM sym UNION SELECT r.x, s.y FROM reach r JOIN sym s ON r.y = s.x AND s.x <> s.y),
alias AS (SELECT r.x AS form, min(b.verdict) AS v FROM reach r JOIN forms f ON f.form = r.y JOIN best b ON b.url = f.url GROUP BY 1)
SELECT p.page_id, coalesce(c.host, '') AS host, coalesce(c.path, '') AS path, b.rule AS rule,
       coalesce(b.verdict, a.v, 'allow') AS verdict,
       CASE WHEN b.rule IS NOT NULL THEN 'rule' WHEN a.v IS NOT NULL THEN 'alias' ELSE 'default' END AS via
FROM pages p LEFT JOIN parts c ON c.url = p.url LEFT JOIN best b ON b.url = p.url
LEFT JOIN forms f ON f.url = p.url LEFT JOIN alias a ON a.form = f.form
"""

ORACLES["op2_decontamination"] = r"""
WITH lowered AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w,
         row_number() OVER () AS r FROM documents),
items AS (
  SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
windows AS (
  SELECT DISTINCT item, least(13, len(w)) AS n, array_to_string(list_slice(w, k, k + least(13, len(w)) - 1), ' ') AS s
  FROM items, unnest(generate_series(1, greatest(len(w) - 12, 1))) AS g(k) WHERE len(w) > 0),
lengths AS (SELECT DISTINCT n FROM windows),
grams AS (
  SELECT r, n, k, array_to_string(list_slice(w, k, k + n - 1), ' ') AS s
  FROM lowered, lengths, unnest(generate_series(1, len(w) - n + 1)) AS g(k) WHERE len(w) >= n),
found AS (SELECT r, g.n, k, item FROM grams g JOIN windows x ON g.n = x.n AND g.s = x.s),
words AS (SELECT DISTINCT r, unnest(generate_series(k, k + n - 1)) AS p FROM found),
hits AS (SELECT r, count(*) AS n_hit FROM words GROUP BY 1),
named AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT r, item FROM found) GROUP BY 1)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM lowered LEFT JOIN hits USING (r) LEFT JOIN named USING (r)
"""

ORACLES["op5_warc"] = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS h, sha1(coalesce(html, '')) AS d FROM pages),
m AS (SELECT d, max(page_id) AS keep FROM p GROUP BY d),
j AS (SELECT page_id, strlen(h) AS n, p.d AS d, keep FROM p JOIN m ON p.d = m.d)
SELECT page_id, n AS payload_bytes,
       array_to_string(list_transform(generate_series(0, 7), lambda k: array_to_string(list_transform([15, 10, 5, 0], lambda b:
         substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(1 + ((CAST('0x' || substr(d, 5 * k + 1, 5) AS BIGINT) >> b) & 31) AS INTEGER), 1)), '')), '') AS payload_digest,
       CASE WHEN page_id < keep THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id < keep THEN keep END AS refers_to
FROM j
"""

# CRC-32 byte by byte: the table entry of a byte is the sum (xor) of the entries of its bits
ORACLES["op11_importance_resampling"] = r"""
WITH texts AS (
  SELECT 'd' AS kind, row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents
  UNION ALL
  SELECT 'b', row_number() OVER (), NULL,
         regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')
  FROM benchmark),
runs AS (
  SELECT kind, r, unnest(list_concat(w,
    list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]),
    list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))) AS f
  FROM texts WHERE len(w) > 0),
per AS MATERIALIZED (SELECT kind, r, f, count(*) AS n FROM runs GROUP BY ALL),
bytes AS (SELECT f, hex(encode(f)) AS h FROM (SELECT DISTINCT f FROM per)),
crc AS (
  SELECT f, xor(4294967295, list_reduce(
    list_transform(range(0, len(h) // 2), lambda i:
      16 * (instr('123456789ABCDEF', h[2 * i + 1]))::BIGINT + instr('123456789ABCDEF', h[2 * i + 2])::BIGINT),
    lambda s, b: xor(s >> 8, xor(xor(xor((xor(s, b) & 1) * 1996959894, ((xor(s, b) >> 1) & 1) * 3993919788),
                                     xor(((xor(s, b) >> 2) & 1) * 124634137, ((xor(s, b) >> 3) & 1) * 249268274)),
                                 xor(xor(((xor(s, b) >> 4) & 1) * 498536548, ((xor(s, b) >> 5) & 1) * 997073096),
                                     xor(((xor(s, b) >> 6) & 1) * 1994146192, ((xor(s, b) >> 7) & 1) * 3988292384)))),
    4294967295)) % 10000 AS bucket
  FROM bytes),
counts AS (SELECT bucket, sum(n) FILTER (kind = 'd') AS s, sum(n) FILTER (kind = 'b') AS t FROM per JOIN crc USING (f) GROUP BY bucket),
sums AS (SELECT coalesce(sum(s), 0)::DOUBLE AS sa, coalesce(sum(t), 0)::DOUBLE AS ta FROM counts),
gain AS (SELECT bucket, floor(1000 * ln(((coalesce(t, 0) + 1)::DOUBLE * (sa + 10000)) / ((coalesce(s, 0) + 1)::DOUBLE * (ta + 10000))))::BIGINT AS g
         FROM counts, sums),
weights AS (SELECT r, sum(n)::BIGINT AS n_features, sum(n * g)::BIGINT AS weight
            FROM per JOIN crc USING (f) JOIN gain USING (bucket) WHERE kind = 'd' GROUP BY r),
scored AS (
  SELECT doc_id, len(w) >= 20 AS able, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
         coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || sha256('42:' || coalesce(doc_id::VARCHAR, ''))[1:8])::BIGINT + 0.5::DOUBLE)
                                                   / 4294967296.0::DOUBLE)))::BIGINT AS score
  FROM texts LEFT JOIN weights USING (r) WHERE kind = 'd'),
ranked AS (SELECT *, row_number() OVER (PARTITION BY coalesce(able, false) ORDER BY score DESC, doc_id) AS k,
                  (SELECT count(*) FROM scored WHERE able) AS n FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN able AND k <= 5 * n // 100 THEN k END AS rank FROM ranked
"""
