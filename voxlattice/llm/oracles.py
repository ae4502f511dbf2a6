"""DuckDB SQL of the text queries where SQL can express them.

None for sharding, toxicity, packing and the pipeline (heap, learned model, local search), nor for license scans, whose
score rests on the index, nor for token counts; tests compare those with brute force.
"""

from __future__ import annotations

from .quality import RULES, STOP_WORDS
from .secrets import RULES as SECRETS

_PLAIN = r"[^\x20\x09-\x0D]+"
_ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _quality() -> str:
    fails = []
    for r in RULES:
        fails += [f"{r.metric} < {r.least}"] if r.least is not None else []
        fails += [f"{r.metric} > {r.most}"] if r.most is not None else []
    stops = ", ".join(f"'{w}'" for w in dict.fromkeys(STOP_WORDS))
    return rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{_PLAIN}') AS w FROM documents),
g AS (SELECT r, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS s FROM d, LATERAL unnest(range(1, greatest(len(w) - 1, 1))) u(i)),
k AS (SELECT r, i, count(*) OVER (PARTITION BY r, s) AS c FROM g),
p AS (SELECT r, count(DISTINCT i + j) AS n_repeat_words FROM k, range(3) x(j) WHERE c > 1 GROUP BY r),
m AS (SELECT d.r, doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
 CAST(length(t) - length(translate(t, '#*$%&|<>', '')) AS BIGINT) AS n_symbols,
 list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l,
 CAST(len(list_filter(w, lambda x: lower(x) IN ({stops}))) AS BIGINT) AS n_stop_words FROM d),
n AS (SELECT doc_id, n_words, word_chars, n_symbols, CAST(len(l) AS BIGINT) AS n_lines, CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words, n_stop_words FROM m LEFT JOIN p ON p.r = m.r),
v AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, CASE WHEN n_words > 0 THEN word_chars / n_words ELSE 0 END AS mean_word_chars, CASE WHEN n_words > 0 THEN n_symbols / n_words ELSE 0 END AS symbol_ratio,
 CASE WHEN n_words > 0 THEN n_stop_words / n_words ELSE 0 END AS stop_word_ratio, CASE WHEN n_lines > 0 THEN n_dup_lines / n_lines ELSE 0 END AS dup_line_ratio FROM n)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT ({' OR '.join(fails)}) AS kept, n_lines, n_stop_words FROM v"""


def _secrets() -> str:
    def pattern(p: str) -> str:  # RE2 folds some letters beyond ASCII where case is ignored, so cases are listed
        if p.startswith("(?i:"):
            end = p.index(")")
            p = "(?:" + "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in p[4:end]) + p[end:]
        return p.replace("'", "''")

    each = " UNION ALL ".join(
        f"SELECT r, {k} AS kind, string_split_regex(t, '{pattern(s.pattern)}') AS gaps, regexp_extract_all(t, '{pattern(s.pattern)}', 0) AS whole, regexp_extract_all(t, '{pattern(s.pattern)}', {s.group}) AS part, {s.least} AS least FROM d" for k, s in enumerate(SECRETS)
    )
    names = "[" + ", ".join(f"'{s.kind}'" for s in SECRETS) + "]"
    return rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents), m AS ({each}),
u AS (SELECT r, kind, least, i, length(gaps[i]) AS gap, length(whole[i]) AS n, length(part[i]) AS p FROM m, LATERAL unnest(range(1, len(whole) + 1)) x(i)),
s AS (SELECT r, kind, CAST(sum(gap + n) OVER (PARTITION BY r, kind ORDER BY i) AS BIGINT) AS stop, n, p, least FROM u),
f AS (SELECT r, kind, stop - n AS start, stop, ({names})[kind + 1] || ':' || (stop - n) || ':' || stop AS said FROM s WHERE p >= least),
a AS (SELECT r, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex, string_agg(said, ',' ORDER BY start, kind) AS spans, string_agg(said, ',' ORDER BY start, kind) FILTER (kind < 3) AS base FROM f GROUP BY r)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN a USING (r)"""


_DECONTAMINATION = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({_LOWER}, '{_ALNUM}') AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all({_LOWER}, '{_ALNUM}') AS w FROM benchmark),
wi AS (SELECT DISTINCT item, least(13, len(w)) AS n, array_to_string(w[i : i + least(13, len(w)) - 1], ' ') AS s FROM b, LATERAL unnest(range(1, len(w) - least(13, len(w)) + 2)) u(i) WHERE len(w) > 0),
wd AS (SELECT r, i, n, array_to_string(w[i : i + n - 1], ' ') AS s FROM d, (SELECT DISTINCT n FROM wi) k, LATERAL unnest(range(1, greatest(len(w) - n + 2, 1))) u(i)),
h AS (SELECT DISTINCT wd.r, wd.i, wd.n, item FROM wd JOIN wi ON wd.n = wi.n AND wd.s = wi.s),
c AS (SELECT r, count(DISTINCT i + j) AS n_hit FROM (SELECT DISTINCT r, i, n FROM h) q, LATERAL unnest(range(0, n)) u(j) GROUP BY r),
t AS (SELECT r, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM h GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
 coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated FROM d LEFT JOIN c USING (r) LEFT JOIN t USING (r)"""

_SUBSTRING = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '{_PLAIN}') AS w FROM documents),
n AS (SELECT r, doc_id, i, md5(array_to_string(w[i : i + 49], ' ')) AS s FROM d, LATERAL unnest(range(1, greatest(len(w) - 48, 1))) u(i)),
m AS (SELECT s, min(doc_id) AS least FROM n GROUP BY s),
g AS (SELECT DISTINCT r, i + j AS i FROM n JOIN m USING (s), range(50) x(j) WHERE doc_id > least),
x AS (SELECT r, list(i) AS gone FROM g GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(gone), 0) AS BIGINT) AS n_removed,
 sha256(array_to_string(CASE WHEN gone IS NULL THEN w ELSE list_transform(list_filter(range(1, len(w) + 1), lambda i: NOT list_contains(gone, i)), lambda i: w[i]) END, ' ')) AS kept_sha256 FROM d LEFT JOIN x USING (r)"""

_JACCARD = rf"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({_LOWER}, '{_PLAIN}') AS w FROM documents),
s AS (SELECT DISTINCT r, array_to_string(w[i : i + least(3, len(w)) - 1], ' ') AS g FROM d, LATERAL unnest(range(1, len(w) - least(3, len(w)) + 2)) u(i) WHERE len(w) > 0),
n AS (SELECT r, count(*) AS n FROM s GROUP BY r),
p AS (SELECT a.r AS a, b.r AS b, count(*) AS i FROM s a JOIN s b ON a.g = b.g AND a.r <> b.r GROUP BY a.r, b.r),
e AS (SELECT p.a, p.b FROM p JOIN n x ON x.r = p.a JOIN n y ON y.r = p.b WHERE 100 * i >= 90 * (x.n + y.n - i)),
c AS (SELECT r, r AS other FROM d UNION SELECT c.r, e.b FROM c JOIN e ON e.a = c.other),
l AS (SELECT c.r, min(d.doc_id) AS component_id FROM c JOIN d ON d.r = c.other GROUP BY c.r)
SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, component_id FROM d LEFT JOIN n USING (r) JOIN l USING (r)"""

_LETTERS = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'"
_BASE32 = " || ".join(f"substr({_LETTERS}, ((CAST('0x' || substr(h, {5 * k + 1}, 5) AS BIGINT) >> {s}) & 31) + 1, 1)" for k in range(8) for s in (15, 10, 5, 0))
_WARC = f"""
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS n, sha1(coalesce(html, '')) AS h FROM pages), m AS (SELECT h, max(page_id) AS last FROM p GROUP BY h)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, {_BASE32} AS payload_digest, CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> last THEN last END AS refers_to FROM p JOIN m USING (h)"""

_AUDIT = rf"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{_PLAIN}') AS w, min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS least FROM documents),
f AS (SELECT doc_id, part, CAST(len(w) < 200 AS INT) + 2 * CAST(100 * len(list_distinct(w)) < 50 * len(w) AS INT) + 4 * CAST(100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t) AS INT)
 + 8 * CAST(regexp_matches(t, '[#$%&*|]') AS INT) + 16 * CAST(coalesce(doc_id > least, false) AS INT) AS mask FROM d),
l AS (SELECT doc_id, max(CAST(quality = 1 AS INT)) AS good, max(CAST(toxic = 1 AS INT)) AS bad FROM labels GROUP BY doc_id),
c AS (SELECT part, mask, count(*) AS n, sum(coalesce(good, 0)) AS good, sum(coalesce(bad, 0)) AS bad FROM f LEFT JOIN l USING (doc_id) GROUP BY part, mask),
v AS (SELECT * FROM (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) x(name, bit)),
o AS (SELECT a.name || b.name || c.name || d.name || e.name AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits FROM v a, v b, v c, v d, v e WHERE a.bit + b.bit + c.bit + d.bit + e.bit = 31 AND len(list_distinct([a.bit, b.bit, c.bit, d.bit, e.bit])) = 5),
s AS (SELECT filter_order, CAST(i AS INT) AS step, bits[i] AS bit, CAST(coalesce(list_sum(bits[1 : i - 1]), 0) AS INT) AS earlier FROM o, range(1, 6) r(i)),
r AS (SELECT part, filter_order, step, bit, coalesce(sum(n) FILTER (mask & (earlier | bit) = 0), 0) AS kept, coalesce(sum(n) FILTER (mask & earlier = 0 AND mask & bit > 0), 0) AS removed,
 coalesce(sum(n) FILTER (mask & earlier > 0 AND mask & bit > 0), 0) AS redundant, coalesce(sum(n) FILTER (mask = bit), 0) AS unique_fails,
 coalesce(sum(good) FILTER (mask & earlier = 0 AND mask & bit > 0), 0) AS good_lost, coalesce(sum(bad) FILTER (mask & earlier = 0 AND mask & bit > 0), 0) AS toxic_lost FROM c, s GROUP BY part, filter_order, step, bit)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost,
 CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, bit) AS BIGINT) AS shapley FROM r"""

# CRC-32 of a conversation's decimal id: each byte, then eight shifts
_CRC = "xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), flatten(list_transform(string_split(CAST(c AS VARCHAR), ''), lambda x: [CAST(unicode(x) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1]))), lambda s, b: CASE WHEN b >= 0 THEN xor(s, b) ELSE xor(s >> 1, 3988292384 * (s & 1)) END))"
_TRIE = f"""
WITH o AS (SELECT conv_id AS c, turn, coalesce(role, '') AS r, sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS tok, strlen(coalesce(text, '')) AS b FROM conversations WHERE conv_id IS NOT NULL),
t AS (SELECT c, tok, b, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, r, tok) - 1 AS nr, count(*) OVER (PARTITION BY c) AS n FROM o),
z AS (SELECT c, c - c % 5 AS base, {_CRC} % 9 AS h FROM (SELECT DISTINCT c FROM t) q),
k AS (SELECT z.*, least(h, coalesce(n, 0)) AS taken FROM z LEFT JOIN (SELECT DISTINCT c AS base, n FROM t) q USING (base)),
s AS (SELECT k.c, nr, tok, b FROM k JOIN t ON t.c = base AND nr < h UNION ALL SELECT k.c, nr - h + taken, tok, b FROM k JOIN t ON t.c = k.c AND nr >= h),
q AS (SELECT k.c, coalesce(toks, []) AS toks, coalesce(bs, []) AS bs FROM k LEFT JOIN (SELECT c, list(tok ORDER BY nr) AS toks, list(b ORDER BY nr) AS bs FROM s GROUP BY c) x USING (c)),
p AS (SELECT c, d, array_to_string(toks[1 : d], '') AS key, coalesce(bs[d], 0) AS b, d = len(toks) AS ends FROM q, LATERAL unnest(range(0, len(toks) + 1)) u(d)),
n AS (SELECT key, d AS depth, min(c) AS conv_id, count(*) AS n_convs, any_value(b) AS b, string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (ends) AS ended FROM p GROUP BY key, d),
x AS (SELECT substr(key, 1, 64 * (depth - 1)) AS up, count(*) AS kids FROM n WHERE depth > 0 GROUP BY up),
m AS (SELECT n.*, coalesce(kids, 0) AS kids FROM n LEFT JOIN x ON up = key),
a AS (SELECT substr(key, 1, 64 * i) AS top, sum(CAST(kids = 0 AS INT)) AS leaves, sum((n_convs - 1) * b) AS saved FROM m, LATERAL unnest(range(0, depth + 1)) u(i) GROUP BY top)
SELECT m.conv_id, CAST(m.depth AS BIGINT) AS depth, y.conv_id AS parent_conv_id, m.n_convs, m.kids AS n_children, CAST(leaves AS BIGINT) AS n_leaves, CAST(saved AS BIGINT) AS saved_tokens, sha256(coalesce(m.ended, '')) AS ends_sha256
FROM m JOIN a ON top = m.key LEFT JOIN n y ON m.depth > 0 AND y.key = substr(m.key, 1, 64 * (m.depth - 1))"""

ORACLES: dict[str, str] = {
    "op1_secret_scan": _secrets(),
    "op3_decontamination": _DECONTAMINATION,
    "op4_substring_dedup": _SUBSTRING,
    "op6_quality_rules": _quality(),
    "op7_jaccard_join": _JACCARD,
    "op9_warc_revisits": _WARC,
    "op11_filter_audit": _AUDIT,
    "op13_prefix_trie": _TRIE,
}
