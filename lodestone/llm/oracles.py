"""SQL for the training-data queries that SQL can express, in the dialect of the checking engine.

Where only the base columns of a query can be written so, a query of those columns stands beside it.
"""

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"


def _low(c: str) -> str:
    return f"translate({c}, '{_UPPER}', '{_LOWER}')"


def _jaccard(k: int, percent: int, columns: str) -> str:
    return f"""
WITH RECURSIVE w AS (SELECT doc_id, {_WORDS.format(_low("coalesce(text, '')"))} AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) >= {k} THEN list_distinct(list_transform(range(1, len(w) - {k - 2}), lambda i: array_to_string(w[i:i+{k - 1}], ' '))) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS g FROM w),
n AS (SELECT doc_id, len(g) AS n, md5(array_to_string(list_sort(g), '|')) AS h FROM s),
u AS (SELECT doc_id, hash(unnest(g)) AS x FROM s),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM u a JOIN u b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM c JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * common >= {percent} * (p.n + q.n - common)),
both_ways AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id AS a, doc_id AS b FROM n UNION SELECT r.a, o.b FROM r JOIN both_ways o ON o.a = r.b),
k AS (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY a)
SELECT doc_id, n::BIGINT AS n_shingles, component_id, {columns} FROM n JOIN k USING (doc_id)
"""


JACCARD = _jaccard(4, 85, "CASE WHEN n = 0 THEN 1 ELSE count(*) OVER (PARTITION BY n, h) END AS n_copies")
MINHASH = _jaccard(5, 85, "doc_id = component_id AS kept")

LINES = r"""
WITH l AS (SELECT doc_id, generate_subscripts(p, 1) - 1 AS line, unnest(p) AS t FROM (SELECT doc_id, string_split(text, chr(10)) AS p FROM documents WHERE text IS NOT NULL)),
w AS (SELECT doc_id, line, t, list_filter(regexp_split_to_array(lower(t), '[ \t\x0B\f\r]+'), lambda x: x <> '') AS w, (doc_id, line) AS pos FROM l),
u AS (SELECT w, len(w) AS n, min(pos) AS first FROM w WHERE len(w) > 0 GROUP BY w),
o AS (SELECT w, n, first, hash(w) AS h FROM u WHERE n >= 5),
v AS (SELECT w, n, first, i, hash(list_concat(w[1:i], w[i+2:])) AS h FROM (SELECT w, n, first, unnest(range(n)) AS i FROM o)),
late AS (SELECT b.w FROM v a JOIN v b ON a.n = b.n AND a.i = b.i AND a.h = b.h AND a.first < b.first
  UNION SELECT b.w FROM v a JOIN o b ON a.n = b.n + 1 AND a.h = b.h AND a.first < b.first UNION SELECT b.w FROM v b JOIN o a ON b.n = a.n + 1 AND b.h = a.h AND a.first < b.first),
g AS (SELECT w.doc_id, line, t, len(w.w) > 0 AND (u.first <> pos OR late.w IS NOT NULL) AS gone FROM w LEFT JOIN u ON u.w = w.w LEFT JOIN late ON late.w = w.w),
x AS (SELECT doc_id, coalesce(string_agg(t, chr(10) ORDER BY line) FILTER (WHERE NOT gone), '') AS text, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_removed FROM g GROUP BY doc_id)
SELECT d.doc_id, x.text, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed FROM documents d LEFT JOIN x USING (doc_id)
"""

URLS = f"""
WITH h AS (SELECT page_id, coalesce({_low("regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1)")}, '') AS host, coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages)
SELECT page_id, host, path, CASE WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
  WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
  WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/' WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/') THEN 'net/' END AS rule FROM h
"""

QUALITY = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents), w AS (SELECT doc_id, text, {_WORDS.format("text")} AS w FROM d),
l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS t FROM d), dl AS (SELECT doc_id, count(*) - count(DISTINCT t) AS n_dup_lines FROM l WHERE regexp_matches(t, '[^\x20\x09-\x0D]') GROUP BY doc_id),
g AS (SELECT doc_id, i, w[i] AS a, w[i+1] AS b, w[i+2] AS c FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM w)),
t AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, a, b, c) AS times FROM g),
r AS (SELECT doc_id, count(DISTINCT k) AS n_repeat_words FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS k FROM t WHERE times > 1) GROUP BY doc_id),
z AS (SELECT doc_id, len(w) AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars, (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words FROM w LEFT JOIN dl USING (doc_id) LEFT JOIN r USING (doc_id))
SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM z
"""

LICENSES = rf"""
WITH w AS (SELECT doc_id, regexp_extract_all({_low("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
p AS (SELECT doc_id, w, unnest(range(1, len(w))) AS i FROM w),
f AS (SELECT doc_id, i - 1 AS place, CASE WHEN w[i] = 'mit' AND w[i+1] = 'license' THEN 'mit' WHEN w[i] = 'apache' AND w[i+1] = 'license' THEN 'apache' WHEN w[i] = 'general' AND w[i+1] = 'public' AND w[i+2] = 'license' THEN 'gpl' END AS label FROM p),
k AS (SELECT doc_id, count(*) AS n_base, min(place) AS first_word, max(place) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM f WHERE label IS NOT NULL GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels FROM w LEFT JOIN k USING (doc_id)
"""

SECRETS = r"""
SELECT doc_id, len(list_filter(regexp_extract_all(t, '(?:(?i:password|passwd|secret|token|api_?key))["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 1), lambda x: length(x) >= 6)) AS n_assign,
  len(list_filter(regexp_extract_all(t, 'AKIA[A-Z0-9]+'), lambda x: length(x) >= 20)) AS n_access, len(list_filter(regexp_extract_all(t, '[0-9a-f]+'), lambda x: length(x) >= 24)) AS n_hex
FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)
"""

FIM = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, sha256('1:' || doc_id) AS x FROM documents),
h AS (SELECT doc_id, text, regexp_extract_all(text, '[A-Za-z]+|[^A-Za-z]') AS u, ('0x' || x[1:8])::BIGINT AS h1, ('0x' || x[9:16])::BIGINT AS h2, ('0x' || x[17:24])::BIGINT AS h3, ('0x' || x[25:32])::BIGINT AS h4 FROM d),
c AS (SELECT doc_id, text, u, len(u) AS n, least(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS lo, greatest(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS hi,
  CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM h),
p AS (SELECT doc_id, text, n, form, array_to_string(u[1:lo], '') AS a, array_to_string(u[lo+1:hi], '') AS m, array_to_string(u[hi+1:n], '') AS z FROM c),
o AS (SELECT *, CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || a || '<S>' || z || '<M>' || m ELSE '<S>' || z || '<P>' || a || '<M>' || m END AS output FROM p),
k AS (SELECT *, regexp_split_to_array(output, '<[PSM]>') AS s FROM o)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(a)::BIGINT END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m)::BIGINT END AS middle_chars, sha256(output) AS output_sha256,
  sha256(CASE form WHEN 'plain' THEN output WHEN 'psm' THEN s[2] || s[4] || s[3] ELSE s[3] || s[4] || s[2] END) AS restored_sha256 FROM k
"""

RUNS = rf"""
WITH d AS (SELECT doc_id, {_WORDS.format("coalesce(text, '')")} AS w, xor(4294967295, list_reduce(list_concat([4294967295], flatten(list_transform(string_split(doc_id::VARCHAR, ''), lambda c: [ascii(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
  lambda s, x: CASE WHEN x >= 0 THEN xor(s, x) WHEN s % 2 = 1 THEN xor(s >> 1, 3988292384) ELSE s >> 1 END)) AS h FROM documents),
g AS (SELECT doc_id, w, len(w) AS n, h % 10 = 0 AND len(w) > 0 AS planted, h // 10 AS g FROM d),
p AS (SELECT *, CASE WHEN planted THEN g % n END AS a, CASE WHEN planted THEN 1 + (n - g % n) // (3 + g % 8) END AS p FROM g),
v AS (SELECT doc_id, n, unnest(CASE WHEN planted THEN list_transform(range(n), lambda i: CASE WHEN i < a THEN w[i+1] ELSE w[a + (i - a) % p + 1] END) ELSE w END) AS w, generate_subscripts(w, 1) - 1 AS i FROM p),
m AS (SELECT x.doc_id, y.i - x.i AS q, x.i FROM v x JOIN v y ON x.doc_id = y.doc_id AND x.w = y.w AND y.i > x.i AND 4 * (y.i - x.i) <= x.n),
e AS (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS island FROM m SEMI JOIN (SELECT doc_id, q FROM m GROUP BY doc_id, q HAVING count(*) >= greatest(6 - q, 3 * q)) USING (doc_id, q)),
s AS (SELECT doc_id, q, min(i) AS start, count(*) + q AS length FROM e GROUP BY doc_id, q, island HAVING count(*) >= greatest(6 - q, 3 * q)),
r AS (SELECT doc_id, start, length, min(q) AS period FROM s GROUP BY doc_id, start, length),
b AS (SELECT doc_id, count(*) AS n_runs, arg_min({{'start': start, 'length': length, 'period': period}}, (-length, start, period)) AS best, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS listed FROM r GROUP BY doc_id),
gone AS (SELECT DISTINCT doc_id, unnest(range(start + period, start + length)) AS i FROM r),
k AS (SELECT doc_id, string_agg(w, ' ' ORDER BY i) AS kept FROM v ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, best.start AS start, best.length AS length, best.period AS period, 1000 * best.length // best.period AS exponent_milli, sha256(coalesce(listed, '')) AS runs_sha256, sha256(coalesce(kept, '')) AS collapsed_sha256
FROM documents LEFT JOIN b USING (doc_id) LEFT JOIN k USING (doc_id)
"""

#: By query.
SQL = {"op2_ngram_jaccard_join": JACCARD, "op10_line_dedup": LINES, "op11_minhash_near_dedup": MINHASH, "op12_fill_in_middle": FIM, "op13_periodic_runs": RUNS, "base_url_rules": URLS, "base_quality_counts": QUALITY, "base_license_phrases": LICENSES, "base_secret_counts": SECRETS}
#: The base columns of a query, by the name of the query beside it.
BASE = {
    "base_url_rules": ("op3_url_filter", "page_id host path rule"),
    "base_quality_counts": ("op4_quality_rules", "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed"),
    "base_license_phrases": ("op8_license_scan", "doc_id n_words n_base first_word last_word base_labels"),
    "base_secret_counts": ("op9_secret_scan", "doc_id n_assign n_access n_hex"),
}
