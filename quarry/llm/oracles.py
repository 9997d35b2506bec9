"""The same results in DuckDB's SQL, by plain means, where SQL can say them.

None for op2, op3, op4 and the pipeline (SQL has no byte-pair encoding), op9 (hundreds of rules with
suppression) and op11 (a learned model): tests hold those against brute force, op11 against held-out labels.  Nothing here is taken from the operators: their rules and
thresholds are said again.
"""

from __future__ import annotations



_LOW = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_FOLDED = rf"regexp_extract_all({_LOW}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

OP1 = f"""WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
p AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d),
x AS (SELECT doc_id, i, w[i] AS word, CASE WHEN i + 19 <= len(w) THEN array_to_string(w[i:i + 19], ' ') END AS s FROM p),
r AS (SELECT *, s IS NOT NULL AND row_number() OVER (PARTITION BY s ORDER BY doc_id, i) > 1 AS again FROM x),
c AS (SELECT *, coalesce(bool_or(again) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 19 PRECEDING AND CURRENT ROW), FALSE) AS gone FROM r),
k AS (SELECT doc_id, count(*) FILTER (gone) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (NOT gone) AS kept FROM c GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN k USING (doc_id)"""

OP5 = """WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
p AS (SELECT doc_id, h, unnest(range(length(h) // 2)) AS i FROM d),
x AS (SELECT doc_id, i, substr(h, 2 * i + 1, 2) AS b, CASE WHEN 2 * i + 100 <= length(h) THEN substr(h, 2 * i + 1, 100) END AS s FROM p),
r AS (SELECT *, s IS NOT NULL AND min(doc_id) OVER (PARTITION BY s) < doc_id AS again FROM x),
c AS (SELECT *, bool_or(again) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) AS gone FROM r),
e AS (SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY i), FALSE) AS starts FROM c),
k AS (SELECT doc_id, count(*) FILTER (gone) AS n_removed, count(*) FILTER (starts) AS n_spans, string_agg(b, '' ORDER BY i) FILTER (NOT gone) AS kept FROM e GROUP BY doc_id)
SELECT doc_id, (length(h) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(kept, ''))) AS kept_sha256 FROM d LEFT JOIN k USING (doc_id)"""

OP6 = f"""WITH RECURSIVE d AS (SELECT doc_id, {_FOLDED} AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS x FROM d),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
e AS (SELECT a.doc_id AS a, b.doc_id AS b FROM s a JOIN s b ON a.x = b.x AND a.doc_id <> b.doc_id JOIN n m ON m.doc_id = a.doc_id JOIN n o ON o.doc_id = b.doc_id GROUP BY a.doc_id, b.doc_id, m.n, o.n HAVING 9 * count(*) >= 4 * (m.n + o.n)),
r AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b),
c AS (SELECT a AS doc_id, min(b) AS class_id FROM r GROUP BY a), l AS (SELECT a AS doc_id, count(*) AS n FROM e GROUP BY a)
SELECT doc_id, class_id, coalesce(l.n, 0)::BIGINT AS n_links FROM c LEFT JOIN l USING (doc_id)"""


_KEY_CHARS = r"[A-Za-z0-9+/=\\]"
_KEY_LINE = rf"[ \t]*(?:[A-Za-z0-9-]+:[^\n]*|{_KEY_CHARS}*)[ \t\r]*"
_PRIVATE_KEY = (
    r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY(?: BLOCK)?-----(?:(?s:.*?)-----END [A-Z ]{0,40}PRIVATE KEY(?: BLOCK)?-----|"
    rf"{_KEY_CHARS}*(?:[ \t]+{_KEY_CHARS}{{16,}})*(?:[ \t\r]*\n(?:{_KEY_LINE}\n)*(?:{_KEY_LINE}\z|[ \t]*{_KEY_CHARS}{{16,}})?)?)"
)

#: kind, regex, group, least code points of the group; the first three are the contract's.
_SECRETS = (
    ("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?[ ]*[:=][ ]*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    ("access", "AKIA[A-Z0-9]+", 0, 18),
    ("hex", "[0-9a-f]+", 0, 16),
    ("private_key", _PRIVATE_KEY, 0, 1),
    ("github", "gh[oprsu]_[A-Za-z0-9]{36,}", 0, 1),
    ("slack", "xox[abprs]-[A-Za-z0-9-]{10,}", 0, 1),
    ("google", "AIza[A-Za-z0-9_-]{35,}", 0, 1),
    ("stripe", "(?:rk|sk)_live_[A-Za-z0-9]{16,}", 0, 1),
    ("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 1),
    ("bearer", "(?i:bearer) {1,4}[A-Za-z0-9._~+/-]{20,}=*", 0, 1),
    ("npm", "npm_[A-Za-z0-9]{36,}", 0, 1),
    ("sendgrid", r"SG\.[A-Za-z0-9_-]{16,}\.[A-Za-z0-9_-]{16,}", 0, 1),
    ("login_url", r"://[A-Za-z0-9._%+-]*:[^\x00-\x20/@]+@", 0, 1),
    ("gitlab", "glpat-[A-Za-z0-9_-]{20,}", 0, 1),
    ("shop", "shp(?:at|ca|pa|ss)_[A-Fa-f0-9]{32,}", 0, 1),
)


def _op7() -> str:
    q = lambda s: "'" + s.replace("'", "''") + "'"
    found = []
    for k, (_, regex, group, least) in enumerate(_SECRETS):
        p = q(regex)
        parts = f"SELECT doc_id, string_split_regex(t, {p}) AS g, regexp_extract_all(t, {p}) AS m, regexp_extract_all(t, {p}, {group}) AS v FROM d WHERE regexp_matches(t, {p})"
        at = f"SELECT doc_id, {k} AS k, m[i] AS m, length(v[i]) AS n, coalesce(list_sum(list_transform(g[:i], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(m[:i - 1], lambda x: length(x))), 0) AS s FROM (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM ({parts}))"
        found.append(f"SELECT doc_id, k, s, s + length(m) AS e FROM ({at}) WHERE n >= {least}")
    kinds = "[" + ", ".join(q(x[0]) for x in _SECRETS) + "]"
    said = f"{kinds}[k + 1] || ':' || s::BIGINT || ':' || e::BIGINT"
    counts = ", ".join(f"coalesce(count(*) FILTER (k = {k}), 0)::BIGINT AS n_{_SECRETS[k][0]}" for k in range(3))
    return f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), f AS ({" UNION ALL ".join(found)})
SELECT d.doc_id, {counts}, sha256(coalesce(string_agg({said}, ',' ORDER BY s, k) FILTER (k < 3), '')) AS base_sha256, coalesce(string_agg({said}, ',' ORDER BY s, k), '') AS spans
FROM d LEFT JOIN f ON f.doc_id = d.doc_id GROUP BY d.doc_id"""


OP7 = _op7()

#: Offsets in the original text: lower-casing A-Z moves nothing.
OP8 = rf"""WITH d AS (SELECT doc_id, {_LOW} AS t, {_FOLDED} AS w FROM documents), b AS (SELECT item_id, {_FOLDED} AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS x FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS i FROM (SELECT *, least(10, len(w)) AS n FROM b WHERE len(w) > 0))),
dw AS (SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS x FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM bw) WHERE len(w) >= n)),
h AS (SELECT doc_id, i, n, item_id FROM dw JOIN bw USING (n, x)),
p AS (SELECT DISTINCT doc_id, unnest(range(i, i + n)) AS p FROM h),
c AS (SELECT doc_id, count(*) AS n_hit FROM p GROUP BY doc_id),
o AS (SELECT doc_id, p, length(v) AS size, sum(length(s) + length(v)) OVER (PARTITION BY doc_id ORDER BY p) AS stop FROM (SELECT doc_id, unnest(w) AS v, unnest(g[:len(w)]) AS s, unnest(range(1, len(w) + 1)) AS p
  FROM (SELECT doc_id, w, string_split_regex(t, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS g FROM d JOIN c USING (doc_id)))),
r AS (SELECT doc_id, min(stop - size)::BIGINT AS a, max(stop)::BIGINT AS b FROM (SELECT *, p - row_number() OVER (PARTITION BY doc_id ORDER BY p) AS run FROM p JOIN o USING (doc_id, p)) GROUP BY doc_id, run),
s AS (SELECT doc_id, string_agg(a || ':' || b, ',' ORDER BY a) AS spans FROM r GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS items FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS id FROM h WHERE item_id IS NOT NULL) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated, coalesce(spans, '') AS spans
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN t USING (doc_id) LEFT JOIN s USING (doc_id)"""

OP10 = f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t, {_WORDS} AS w, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l FROM documents),
x AS (SELECT doc_id, i, array_to_string(w[i:i + 4], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM d)),
r AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, s) AS n FROM x) WHERE n > 1),
c AS (SELECT doc_id, sum(n) AS n_repeat_words FROM (SELECT doc_id, least(5, i - coalesce(lag(i) OVER (PARTITION BY doc_id ORDER BY i), -5)) AS n FROM r) GROUP BY doc_id),
m AS (SELECT doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars, len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines,
  coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words FROM d LEFT JOIN c USING (doc_id)),
b AS (SELECT *, n_words < 10 AS few, 100 * n_repeat_words > 20 * n_words AS again, n_symbols > 0.3 * word_chars AS symbols, word_chars > 40 * n_words AS long, word_chars < 1.5 * n_words AS short FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  (1 * few::INT + 2 * again::INT + 4 * symbols::INT + 8 * long::INT + 16 * short::INT + 32 * (n_symbols > 0.1 * word_chars)::INT + 64 * (word_chars > 15 * n_words)::INT + 128 * (n_dup_lines > 0)::INT)::BIGINT AS failed,
  few OR again AS base_failed, NOT (few OR again OR symbols OR long OR short) AS kept FROM b"""


#: Products are of 128 bits.
OP12 = rf"""WITH d AS (SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all({_LOW}, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
r AS (SELECT *, row_number() OVER () AS r FROM d), c AS (SELECT lang, source, r, term, count(*) AS n FROM (SELECT lang, source, r, unnest(w) AS term FROM r) GROUP BY ALL),
k AS (SELECT lang, term, sum(n) AS ln FROM c GROUP BY lang, term HAVING count(*) >= 30),
l AS (SELECT lang, count(*) AS v, sum(ln) AS ls FROM k GROUP BY lang),
h AS (SELECT lang, source, term, sum(n) AS n, any_value(ln) AS ln FROM c JOIN k USING (lang, term) GROUP BY lang, source, term),
g AS (SELECT g.lang, g.source, coalesce(s.n, 0) AS size, coalesce(l.v, 0) AS v, coalesce(l.ls, 0) AS ls FROM (SELECT DISTINCT lang, source FROM d) g LEFT JOIN l ON l.lang = g.lang LEFT JOIN (SELECT lang, source, sum(n) AS n FROM h GROUP BY ALL) s ON s.lang = g.lang AND s.source = g.source),
p AS (SELECT g.lang, g.source, k.term, coalesce(h.n, 0) AS n, (1 + 1000000000::HUGEINT * (coalesce(h.n, 0) + 5) // (g.size + 5 * g.v))::BIGINT AS p, (1 + 1000000000::HUGEINT * (k.ln + 5) // (g.ls + 5 * g.v))::BIGINT AS q
  FROM g JOIN k ON k.lang = g.lang LEFT JOIN h ON h.lang = g.lang AND h.source = g.source AND h.term = k.term),
s AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
e AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0)::BIGINT AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
  UNION ALL SELECT lang, source, 'term', term, p - q FROM p WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value, rank::INTEGER AS rank FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM e) WHERE part = 'pair' OR rank <= 50"""

OP13 = f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_FOLDED} AS w FROM documents), b AS (SELECT row_number() OVER () AS i, item_id, {_FOLDED} AS w FROM benchmark),
s AS (SELECT count(*) FILTER (len(w) > 0)::BIGINT AS n, sum(len(w))::BIGINT AS l FROM d),
t AS (SELECT i, term, count(*) AS times FROM (SELECT i, unnest(w) AS term FROM b) GROUP BY ALL),
f AS (SELECT r, term, count(*)::BIGINT AS tf FROM (SELECT r, unnest(w) AS term FROM d) WHERE term IN (SELECT term FROM t) GROUP BY ALL),
w AS (SELECT term, floor(1000 * ln((2 * n + 2)::DOUBLE / (2 * df + 1)))::BIGINT AS w FROM (SELECT term, count(*) AS df FROM f GROUP BY term), s),
m AS (SELECT r, doc_id, (100 - 75 + (75 * len(w)::HUGEINT * n) // l)::BIGINT AS m FROM d, s WHERE len(w) > 0),
x AS (SELECT i, r, sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * m))) AS score FROM f JOIN w USING (term) JOIN m USING (r) JOIN t USING (term) GROUP BY i, r),
k AS (SELECT i, doc_id, score, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM x JOIN m USING (r) WHERE score > 0)
SELECT item_id, rank::INTEGER AS rank, doc_id, score::BIGINT AS score FROM k JOIN b USING (i) WHERE rank <= 10"""
