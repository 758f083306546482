"""SQL that other queries of the catalogue are checked with, in DuckDB's dialect."""

from __future__ import annotations

from cantata.functions.text import CJK, DROPPED, LINE_END, SPACE


def sql_text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def strip(c: str) -> str:
    return f"regexp_replace({c}, {sql_text(rf'\A[{SPACE}]+|[{SPACE}]+\z')}, '', 'g')"


def capitalized(c: str) -> str:
    return f"upper({c}[1:1]) || lower({c}[2:])"


def words_spaced(c: str) -> str:
    pieces = f"list_filter(list_transform(regexp_split_to_array(coalesce({c}, ''), {sql_text(f'[{SPACE}]+')}), lambda x: regexp_replace(x, {sql_text(DROPPED)}, '', 'g')), lambda x: x != '')"
    return f"flatten(list_transform({pieces}, lambda x: regexp_extract_all(x, {sql_text(f'[{CJK}]|[^{CJK}]+')})))"


def repaired(source: str) -> str:
    """CTEs that end in fixed(id, t): source(id, t) with loops repaired, without back-references.

    Equal characters at a distance of one period form stretches; a stretch tells where a collapse may start and how far it reaches."""
    return f"""
    c0 AS (SELECT id, t, string_split(t, '') AS l, length(t) AS n FROM {source}),
    same1 AS (SELECT id, unnest(list_filter(range(1, n), lambda p: l[p] = l[p + 1])) AS p FROM c0),
    long1 AS (SELECT id, min(p) AS s, max(p) AS e FROM (SELECT id, p, p - row_number() OVER (PARTITION BY id ORDER BY p) AS g FROM same1) GROUP BY id, g HAVING count(*) >= 20),
    gone1 AS (SELECT id, list({{'s': s, 'e': e}}) AS runs FROM long1 GROUP BY id),
    c3 AS (
      SELECT c0.id, CASE WHEN runs IS NULL THEN t ELSE array_to_string(list_filter(list_transform(range(1, n + 1), lambda p: CASE WHEN len(list_filter(runs, lambda r: p > r.s AND p <= r.e + 1)) = 0 THEN l[p] END), lambda x: x IS NOT NULL), '') END AS t
      FROM c0 LEFT JOIN gone1 USING (id)),
    c4 AS (SELECT id, t, string_split(t, '') AS l, length(t) AS n FROM c3),
    samek AS (SELECT id, n, k, unnest(list_filter(range(1, n - k + 1), lambda p: l[p] = l[p + k])) AS p FROM c4, (SELECT unnest(range(1, 21)) AS k) WHERE n >= 40),
    longk AS (SELECT id, n, k, min(p) AS s, max(p) AS e FROM (SELECT id, n, k, p, p - row_number() OVER (PARTITION BY id, k ORDER BY p) AS g FROM samek) GROUP BY id, n, k, g HAVING count(*) >= 19 * k),
    stretches AS (SELECT id, list({{'s': s, 'hi': least(e - 19 * k + 1, n - 39), 'k': k, 'e': e}}) AS runs FROM longk GROUP BY id),
    walk AS (
      SELECT id, t, runs, CAST(1 AS BIGINT) AS place, '' AS done, list_sort(list_transform(list_filter(runs, lambda r: r.s <= r.hi), lambda r: {{'p': r.s, 'k': r.k, 'e': r.e}}))[1] AS nxt FROM c4 JOIN stretches USING (id)
      UNION ALL
      SELECT id, t, runs, place, done, list_sort(list_transform(list_filter(runs, lambda r: greatest(r.s, place) <= r.hi), lambda r: {{'p': greatest(r.s, place), 'k': r.k, 'e': r.e}}))[1] FROM (
        SELECT id, t, runs, nxt.p + ((nxt.e - nxt.p + 1) // nxt.k + 1) * nxt.k AS place, done || t[place:nxt.p - 1] || t[nxt.p:nxt.p + nxt.k - 1] AS done FROM walk WHERE nxt IS NOT NULL)),
    fixed AS (SELECT c4.id, coalesce(w.done || c4.t[w.place:], c4.t) AS t FROM c4 LEFT JOIN (SELECT id, done, place FROM walk WHERE nxt IS NULL) w USING (id))"""


def parsed(raw: str) -> str:
    """Query id, language, text from raw(id, raw, forced)."""
    tag, prefix = "<asr_text>", "language "
    line = f"list_filter(list_transform(regexp_split_to_array(meta, {sql_text(LINE_END)}), lambda x: {strip('x')}), lambda x: starts_with(lower(x), '{prefix}'))[1]"
    name = strip(f"({line})[{len(prefix) + 1}:]")
    return f"""
    WITH RECURSIVE raw0 AS ({raw}), stripped AS (SELECT id, {strip("coalesce(raw, '')")} AS t FROM raw0), {repaired('stripped')},
    parts AS (SELECT f.id, f.t, r.forced, instr(f.t, '{tag}') AS place FROM fixed f JOIN raw0 r USING (id)),
    cut AS (SELECT *, t[:place - 1] AS meta, {strip(f"t[place + {len(tag)}:]")} AS body FROM parts)
    SELECT id,
      CASE WHEN t = '' THEN '' WHEN coalesce(forced, '') != '' THEN forced WHEN place = 0 THEN '' WHEN contains(lower(meta), '{prefix}none') THEN ''
           ELSE coalesce({capitalized(name)}, '') END AS language,
      CASE WHEN t = '' THEN '' WHEN coalesce(forced, '') != '' OR place = 0 THEN t ELSE body END AS text
    FROM cut"""
