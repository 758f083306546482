"""SQL, in DuckDB's dialect, for the training-data queries that SQL can express."""

from __future__ import annotations

SPACE = r"[\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def lowered(c: str) -> str:
    return f"translate(coalesce({c}, ''), '{UPPER}', '{UPPER.lower()}')"


def either_case(word: str) -> str:
    return "".join(f"[{ch.upper()}{ch}]" if ch.isalpha() else ch for ch in word)


_KEYWORD = "|".join(map(either_case, ("password", "passwd", "secret", "token"))) + "|" + either_case("api") + "_?" + either_case("key")
_ASSIGN = rf"""(?:{_KEYWORD})["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)"""

#: Words of documents and items, the items' windows, their places in the documents, the words that these cover, and the longest
#: run of windows of one item.
DECONTAMINATE = f"""
WITH d AS (SELECT doc_id, regexp_extract_all({lowered('text')}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
b AS (SELECT row_number() OVER () AS item, item_id, regexp_extract_all({lowered('text')}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
bs AS (SELECT item, item_id, w, least(10, len(w)) AS n FROM b WHERE len(w) > 0),
bw AS (SELECT item, coalesce(CAST(item_id AS VARCHAR), '') AS item_id, n, t, list_slice(w, t, t + n - 1) AS g FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS t FROM bs)),
sizes AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, n, s, list_slice(w, s, s + n - 1) AS g FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, sizes WHERE len(w) >= n)),
hits AS (SELECT doc_id, item, item_id, dw.n, s, t FROM dw JOIN bw ON dw.n = bw.n AND dw.g = bw.g),
covered AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(s, s + n)) AS p FROM hits) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM hits) GROUP BY doc_id),
runs AS (SELECT doc_id, count(*) + n - 1 AS size FROM (SELECT *, s - row_number() OVER (PARTITION BY doc_id, item, n, s - t ORDER BY s) AS island FROM hits) GROUP BY doc_id, item, n, s - t, island),
longest AS (SELECT doc_id, max(size) AS size FROM runs GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated,
  CAST(coalesce(size, 0) AS BIGINT) AS longest_match
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN items USING (doc_id) LEFT JOIN longest USING (doc_id)"""


def _spans(kind: str, rank: int, pattern: str, group: int, least: int) -> str:
    """Rows of one kind's matches; offsets from the pieces between the matches."""
    return f"""
  SELECT doc_id, source, {rank} AS rank, '{kind}' AS kind, start, start + length(m[i]) AS stop, v[i] AS value FROM (
    SELECT doc_id, source, m, v, i, CAST(coalesce(list_sum(list_transform(seg[:i], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(m[:i - 1], lambda x: length(x))), 0) AS BIGINT) AS start FROM (
      SELECT doc_id, source, m, v, seg, unnest(range(1, len(m) + 1)) AS i FROM (
        SELECT doc_id, source, regexp_extract_all(t, '{pattern}', 0) AS m, regexp_extract_all(t, '{pattern}', {group}) AS v, regexp_split_to_array(t, '{pattern}') AS seg
        FROM (SELECT doc_id, coalesce(source, '') AS source, coalesce(text, '') AS t FROM documents)))) WHERE length(v[i]) >= {least}"""


SECRETS = f"""
WITH base AS ({" UNION ALL ".join((_spans("assign", 0, _ASSIGN, 1, 8), _spans("access", 1, "AKIA[A-Z0-9]+", 0, 16), _spans("hex", 2, "[0-9a-f]+", 0, 32)))}),
opaque AS (SELECT * FROM ({_spans("opaque", 3, "[A-Za-z0-9+/_=-]{24,}", 0, 24)}) WHERE regexp_matches(value, '[0-9]') AND regexp_matches(value, '[A-Z]') AND regexp_matches(value, '[a-z]')),
apart AS (SELECT * FROM opaque o WHERE NOT EXISTS (SELECT 1 FROM base b WHERE b.doc_id = o.doc_id AND b.start < o.stop AND o.start < b.stop)),
every AS (SELECT * FROM base UNION ALL SELECT * FROM apart),
owners AS (SELECT value, count(DISTINCT source) AS owners FROM every GROUP BY value),
judged AS (SELECT every.*, owners < 3 AS live FROM every JOIN owners USING (value) WHERE rank < 3 OR owners < 3),
found AS (
  SELECT doc_id, count(*) FILTER (rank = 0) AS n_assign, count(*) FILTER (rank = 1) AS n_access, count(*) FILTER (rank = 2) AS n_hex, count(*) FILTER (live) AS n_live,
    string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank) FILTER (rank < 3) AS base, string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank) AS spans FROM judged GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_live, 0) AS n_live
FROM documents d LEFT JOIN found USING (doc_id)"""

URL_FILTER = """
WITH u AS (SELECT page_id, CASE WHEN contains(url, '://') THEN url[instr(url, '://') + 3:] ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, regexp_extract(coalesce(rest, ''), '^[^/?#]*') AS raw, coalesce(rest, '') AS rest FROM u),
p AS (SELECT page_id, translate(raw, '{upper}', '{lower}') AS host, regexp_extract(rest[length(raw) + 1:], '^[^?#]*') AS path FROM h),
r(rh, rp, action) AS (VALUES {rules}),
f AS (SELECT page_id, rh || rp AS rule, action, row_number() OVER (PARTITION BY page_id ORDER BY length(rh || rp) DESC, length(rh) DESC, action DESC) AS k FROM p JOIN r ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp))
SELECT p.page_id, host, path, rule, coalesce(action, 'allow') AS verdict FROM p LEFT JOIN f ON p.page_id = f.page_id AND k = 1"""


def url_filter(rules: list[tuple[str, str, str]]) -> str:
    return URL_FILTER.format(upper=UPPER, lower=UPPER.lower(), rules=", ".join(str(r) for r in rules))


#: Exact similarity over shingles as lists of words; links among distinct sets; components by the smallest id that spreads.
NEAR_DUPLICATES = f"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array({lowered('text')}, '{SPACE}'), lambda x: x != '') AS w FROM documents),
g AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) END AS g FROM w),
k AS (SELECT doc_id, len(g) AS n, CASE WHEN len(g) > 0 THEN md5(array_to_string(list_sort(g), chr(10))) END AS s, g FROM g),
s AS (SELECT s, min(doc_id) AS id, any_value(n) AS n, any_value(g) AS g FROM k WHERE s IS NOT NULL GROUP BY s),
x AS (SELECT id, n, unnest(g) AS t FROM s),
pairs AS (SELECT a.id AS a, b.id AS b FROM x a JOIN x b ON a.t = b.t AND a.id < b.id AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n) GROUP BY a.id, b.id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
both_ways AS (SELECT a, b FROM pairs UNION ALL SELECT b, a FROM pairs),
reach AS (SELECT id AS a, id AS b FROM s UNION SELECT reach.a, both_ways.b FROM reach JOIN both_ways ON reach.b = both_ways.a),
c AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a)
SELECT k.doc_id, CAST(k.n AS BIGINT) AS n_shingles, coalesce(component_id, k.doc_id) AS component_id, coalesce(component_id, k.doc_id) = k.doc_id AS kept
FROM k LEFT JOIN s ON k.s = s.s LEFT JOIN c ON s.id = c.a"""


#: Every window of 100 bytes with its place; those that have an earlier one; their runs; and what lies between these.
REPEATS = """
WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS b, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
w AS (SELECT doc_id, s, b[s:s + 99] AS g FROM (SELECT doc_id, b, unnest(range(1, n - 98)) AS s FROM d WHERE n >= 100)),
late AS (SELECT doc_id, s FROM (SELECT doc_id, s, row_number() OVER (PARTITION BY g ORDER BY doc_id, s) AS k FROM w) WHERE k > 1),
runs AS (SELECT doc_id, min(s) AS a, max(s) + 99 AS e FROM (SELECT doc_id, s, sum(fresh) OVER (PARTITION BY doc_id ORDER BY s) AS run FROM (
  SELECT doc_id, s, CASE WHEN s - lag(s) OVER (PARTITION BY doc_id ORDER BY s) <= 100 THEN 0 ELSE 1 END AS fresh FROM late)) GROUP BY doc_id, run),
gone AS (SELECT doc_id, sum(e - a + 1) AS n_removed, count(*) AS n_spans FROM runs GROUP BY doc_id),
edges AS (SELECT doc_id, coalesce(lag(e) OVER (PARTITION BY doc_id ORDER BY a), 0) + 1 AS a, a - 1 AS e FROM runs UNION ALL SELECT doc_id, max(e) + 1, NULL FROM runs GROUP BY doc_id),
kept AS (SELECT doc_id, string_agg(hex(b[edges.a:coalesce(edges.e, n)]), '' ORDER BY edges.a) AS h FROM edges JOIN d USING (doc_id) GROUP BY doc_id)
SELECT d.doc_id, n AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans, sha256(CASE WHEN h IS NULL THEN b ELSE unhex(h) END) AS kept_sha256
FROM d LEFT JOIN gone USING (doc_id) LEFT JOIN kept USING (doc_id)"""


def _assigned(at: str) -> str:
    return f"SELECT r, any_value(vec_id) AS vec_id, any_value(x) AS x, arg_min(c, (d, c)) AS c, min(d) AS d FROM (SELECT v.*, k.c, list_sum(list_transform(range(1, 65), lambda i: (v.x[i] - k.x[i]) * (v.x[i] - k.x[i]))) AS d FROM v CROSS JOIN {at} k) GROUP BY r"


def _moved(assigned: str, at: str) -> str:
    floor = "CAST((s - ((s % n) + n) % n) // n AS BIGINT)"
    sums = f"SELECT c, i, CAST(sum(e) AS BIGINT) AS s, count(*) AS n FROM (SELECT c, unnest(x) AS e, unnest(range(64)) AS i FROM {assigned}) GROUP BY c, i"
    return f"SELECT k.c, coalesce(m.x, k.x) AS x FROM {at} k LEFT JOIN (SELECT c, list({floor} ORDER BY i) AS x FROM ({sums}) GROUP BY c) m USING (c)"


#: Three rounds, written out.
CENTROIDS = f"""
WITH v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda e: CAST(floor(64 * CAST(e AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda e: e IS NOT NULL AND isfinite(e))) = 64),
k0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h, x) - 1 AS c, x FROM (SELECT sha256('1:' || vec_id) AS h, x FROM v WHERE vec_id IS NOT NULL ORDER BY h, x LIMIT 16)),
a1 AS MATERIALIZED ({_assigned('k0')}), k1 AS MATERIALIZED ({_moved('a1', 'k0')}),
a2 AS MATERIALIZED ({_assigned('k1')}), k2 AS MATERIALIZED ({_moved('a2', 'k1')}),
a3 AS MATERIALIZED ({_assigned('k2')}), k3 AS MATERIALIZED ({_moved('a3', 'k2')}),
a4 AS MATERIALIZED ({_assigned('k3')})
SELECT vec_id, CAST(a4.c AS INTEGER) AS cluster, CAST(d AS BIGINT) AS distance, CAST(sum(d) OVER (PARTITION BY a4.c) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(k3.x, ',')) AS centroid_sha256
FROM a4 JOIN k3 USING (c)"""

#: Turns as the template renders them; RE2 has no lookahead, so marks are escaped one by one.
_ESCAPED = r"replace(replace(replace({}, '\', '\\'), '<turn:', '\<turn:'), '</turn>', '\</turn>')".format
CHATS = rf"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, k, CASE k WHEN 0 THEN 'user' ELSE 'assistant' END, '\### Assistant: </turn> ok' FROM range(2) r(k)),
c AS (SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST) AS turns, coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST) FILTER (role = 'assistant'), '') AS loss,
  sum(length('<turn:' || replace({_ESCAPED('role')}, '>', '\>') || '>' || chr(10) || {_ESCAPED('text')} || '</turn>' || chr(10))) AS formatted FROM t GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, CAST(length(loss) AS BIGINT) AS loss_chars, sha256(loss) AS loss_sha256, CAST(formatted AS BIGINT) AS formatted_chars FROM c"""

#: zlib's checksum of a decimal number: the shift register over its digits, one bit after the other.
_CRC32 = """xor(list_reduce([CAST(4294967295 AS BIGINT)] || list_transform(string_split(CAST({} AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT)),
  lambda a, b: list_reduce([xor(a, b)] || range(8), lambda u, k: CASE WHEN u & 1 = 1 THEN xor(u >> 1, CAST(3988292384 AS BIGINT)) ELSE u >> 1 END)), CAST(4294967295 AS BIGINT))""".format
#: Prefixes as digests of all turns so far; what lies below a node is found by the prefixes of the nodes' smallest members.
PREFIX_TRIE = rf"""
WITH t AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, mark) - 1 AS p FROM (
    SELECT conv_id, turn, md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS mark, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS words FROM conversations WHERE conv_id IS NOT NULL)),
c AS (SELECT DISTINCT conv_id, conv_id - conv_id % 20 AS base, {_CRC32('conv_id')} % 4 AS h FROM t),
r AS (SELECT c.conv_id, 0 AS part, p, mark, words FROM c JOIN t ON t.conv_id = c.base AND p < h UNION ALL SELECT c.conv_id, 1, p, mark, words FROM c JOIN t ON t.conv_id = c.conv_id AND p >= h),
q AS (SELECT conv_id, words, row_number() OVER w AS d, md5(string_agg(mark, '') OVER w) AS k FROM r WINDOW w AS (PARTITION BY conv_id ORDER BY part, p)),
x AS MATERIALIZED (SELECT conv_id, words, d, k FROM q UNION ALL SELECT conv_id, 0, 0, '' FROM c),
n AS MATERIALIZED (SELECT k, d, min(conv_id) AS conv_id, any_value(words) AS words, count(*) AS n_convs FROM x GROUP BY k, d),
up AS (SELECT DISTINCT a.k, b.k AS parent FROM x a JOIN x b ON a.conv_id = b.conv_id AND a.d = b.d + 1),
kids AS (SELECT parent AS k, count(*) AS n_children FROM up GROUP BY parent),
m AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN kids USING (k)),
below AS (SELECT a.k, count(*) FILTER (m.n_children = 0) AS n_leaves, sum((m.n_convs - 1) * m.words) AS saved FROM m JOIN x a ON a.conv_id = m.conv_id AND a.d <= m.d GROUP BY a.k),
size AS (SELECT conv_id, arg_max(k, d) AS k FROM x GROUP BY conv_id),
ends AS (SELECT k, sha256(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id)) AS sha FROM size GROUP BY k)
SELECT m.conv_id, CAST(m.d AS BIGINT) AS depth, p.conv_id AS parent_conv_id, m.n_convs, CAST(m.n_children AS BIGINT) AS n_children, CAST(n_leaves AS BIGINT) AS n_leaves, CAST(saved AS BIGINT) AS saved_tokens, coalesce(sha, sha256('')) AS ends_sha256
FROM m JOIN below USING (k) LEFT JOIN up USING (k) LEFT JOIN n p ON p.k = up.parent LEFT JOIN ends ON ends.k = m.k"""
