"""Text functions: columns to columns, all inside the JVM.

Null text counts as empty unless a function says otherwise. Strict functions raise an error where a value isn't allowed; their
lenient forms give null.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cantata.model import AUDIO_PREFIX, DTYPES, LANGUAGE_PREFIX, LANGUAGES, TEXT_TAG, TIMESTAMP_TOKEN, TURN_LABELS

#: White space as Unicode has it, with the information separators; the classes work in Spark's and in RE2's syntax.
SPACE = r"\t-\r\x1c-\x20\x85\xa0\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
_SPACES = "".join(map(chr, [*range(9, 14), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))  # the same, as characters
LINE_END = r"\r\n|[\n-\r\x1c-\x1e\x85\x{2028}\x{2029}]"
#: Ideographs that count as words of their own.
CJK = r"\x{4e00}-\x{9fff}\x{3400}-\x{4dbf}\x{20000}-\x{2a6df}\x{2a700}-\x{2b73f}\x{2b740}-\x{2b81f}\x{2b820}-\x{2ceaf}\x{f900}-\x{faff}"
DROPPED = r"[^\p{L}\p{N}']"
#: A run of over REPEATS equal characters, or REPEATS repetitions of up to LONGEST_PERIOD characters, is a decoder's loop.
REPEATS = 20
LONGEST_PERIOD = 20
REPLACEMENT = "�"


def let(value: Column, body) -> Column:
    """body(value) with the value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(_SPACES))


def is_blank(c: Column) -> Column:
    return c.isNull() | (F.length(strip(c)) == 0)


def capitalized(c: Column) -> Column:
    """First character upper, the rest lower."""
    return F.concat(F.upper(F.substring(c, 1, 1)), F.lower(c.substr(F.lit(2), F.length(c))))


def language_name(c: Column, strict: bool = False) -> Column:
    """Canonical spelling of a language name; blank gives null, or an error."""
    bad = F.raise_error(F.lit("language is null or empty")) if strict else F.lit(None).cast("string")
    return F.when(is_blank(c), bad).otherwise(capitalized(strip(c)))


def is_supported_language(c: Column) -> Column:
    return c.isin(*LANGUAGES)


def require_language(c: Column) -> Column:
    """The name itself if it is supported (case counts); else an error."""
    return F.when(is_supported_language(c), c).otherwise(F.raise_error(F.concat(F.lit("unsupported language: "), F.coalesce(c, F.lit("null")))).cast("string"))


def collapse_runs(c: Column, repeats: int = REPEATS) -> Column:
    """A run of more than so many equal characters becomes one character."""
    return F.regexp_replace(c, rf"(?s)(.)\1{{{repeats},}}", "$1")


def collapse_patterns(c: Column, repeats: int = REPEATS, longest: int = LONGEST_PERIOD) -> Column:
    """From left to right, so many repetitions or more of a pattern, the shortest that fits, become one; not within the last 2 * repeats characters."""
    return F.regexp_replace(c, rf"(?s)(?=.{{{2 * repeats}}})(.{{1,{longest}}}?)\1{{{repeats - 1},}}", "$1")


def may_loop(c: Column) -> Column:
    """Whether ten characters stand again at a distance of up to LONGEST_PERIOD, looked for at every tenth place: so it is wherever
    collapse_patterns() changes something, as 2 * REPEATS characters or more of a loop hold such a place. Linear, and false for nearly all texts."""
    step = LONGEST_PERIOD // 2

    def found(parts: Column) -> Column:
        part = lambda i: F.coalesce(F.get(parts, i), F.lit(""))
        ahead = lambda i: F.concat(part(i).substr(F.lit(2), F.lit(step)), part(i + 1), part(i + 2))
        return F.exists(F.transform(parts, lambda p, i: (F.length(p) == step) & F.contains(ahead(i), p)), lambda x: x)

    return let(F.regexp_extract_all(c, F.lit(rf"(?s).{{1,{step}}}"), F.lit(0)), found)


def fix_repetitions(c: Column) -> Column:
    return let(collapse_runs(c), lambda s: F.when(may_loop(s), collapse_patterns(s)).otherwise(s))


def parse_output(raw: Column, forced: Column | None = None) -> Column:
    """Raw recognizer output to (language, text).

    Loops are repaired first, in the tag as well. With a forced language the text is everything, a tag included. Without a tag the
    language is empty. Before the first tag, "language none" anywhere means no language; else the first line that begins with the
    prefix names it, without a check."""
    forced = F.lit(None).cast("string") if forced is None else forced
    struct = lambda language, text: F.struct(language.alias("language"), text.alias("text"))
    empty = F.lit("")

    def tagged(s: Column) -> Column:
        at = F.instr(s, TEXT_TAG)
        meta, text = s.substr(F.lit(1), at - 1), strip(s.substr(at + len(TEXT_TAG), F.length(s)))
        lines = F.filter(F.transform(F.split(meta, LINE_END), strip), lambda x: F.lower(x).startswith(LANGUAGE_PREFIX))
        name = F.when(F.size(lines) > 0, F.coalesce(language_name(F.get(lines, F.lit(0)).substr(F.lit(len(LANGUAGE_PREFIX) + 1), F.length(s))), empty)).otherwise(empty)
        return F.when(at == 0, struct(empty, s)).when(F.contains(F.lower(meta), F.lit(LANGUAGE_PREFIX + "none")), struct(empty, text)).otherwise(struct(name, text))

    def repaired(s: Column) -> Column:
        return F.when(F.length(s) == 0, struct(empty, empty)).when(forced.isNotNull() & (forced != ""), struct(forced, fix_repetitions(s))).otherwise(let(fix_repetitions(s), tagged))

    return let(strip(F.coalesce(raw, empty)), repaired)


def register_functions(spark) -> None:
    """parse_asr_output(raw, forced) and fix_repetitions(text) as SQL functions of the session: the same rules in SQL, inside the JVM."""
    bound = lambda value, name, body: f"element_at(transform(array({value}), {name} -> {body}), 1)"
    stripped = lambda c: f"regexp_replace({c}, r'\\A[{SPACE}]+|[{SPACE}]+\\z', '')"
    runs = lambda c: f"regexp_replace({c}, r'(?s)(.)\\1{{{REPEATS},}}', '$1')"
    patterns = rf"r'(?s)(?=.{{{2 * REPEATS}}})(.{{1,{LONGEST_PERIOD}}}?)\1{{{REPEATS - 1},}}'"
    step = LONGEST_PERIOD // 2
    part = "coalesce(get(q, {}), '')".format
    ahead = f"concat(substring({part('i')}, 2, {step}), {part('i + 1')}, {part('i + 2')})"
    loops = bound(f"regexp_extract_all(u, r'(?s).{{1,{step}}}', 0)", "q", f"exists(transform(q, (p, i) -> length(p) = {step} AND contains({ahead}, p)), z -> z)")  # as may_loop()
    fixed = lambda c: bound(runs(c), "u", f"CASE WHEN {loops} THEN regexp_replace(u, {patterns}, '$1') ELSE u END")
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION fix_repetitions(x STRING) RETURNS STRING RETURN {fixed('x')}")
    result = "named_struct('language', {}, 'text', {})".format
    tag, prefix = f"'{TEXT_TAG}'", f"'{LANGUAGE_PREFIX}'"
    lines = f"filter(transform(split(left(t, instr(t, {tag}) - 1), r'{LINE_END}'), y -> {stripped('y')}), y -> startswith(lower(y), {prefix}))"
    name = stripped(f"substring(get(l, 0), {len(LANGUAGE_PREFIX) + 1})")
    named = bound(lines, "l", f"coalesce({bound(name, 'n', 'concat(upper(left(n, 1)), lower(substring(n, 2)))')}, '')")
    text = stripped(f"substring(t, instr(t, {tag}) + {len(TEXT_TAG)})")
    none = f"contains(lower(left(t, instr(t, {tag}) - 1)), '{LANGUAGE_PREFIX}none')"
    tagged = f"CASE WHEN instr(t, {tag}) = 0 THEN {result(chr(39) * 2, 't')} WHEN {none} THEN {result(chr(39) * 2, text)} ELSE {result(named, text)} END"
    whole = f"CASE WHEN s = '' THEN {result(chr(39) * 2, chr(39) * 2)} WHEN forced != '' THEN {result('forced', fixed('s'))} ELSE {bound(fixed('s'), 't', tagged)} END"
    source = "coalesce(raw, '')"
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION parse_asr_output(raw STRING, forced STRING DEFAULT NULL) RETURNS STRUCT<language: STRING, text: STRING> RETURN {bound(stripped(source), 's', whole)}")


def clean_token(c: Column) -> Column:
    """Letters, numbers and the apostrophe."""
    return F.regexp_replace(c, DROPPED, "")


def split_cjk(c: Column) -> Column:
    """Each ideograph alone, what stands between them together."""
    return F.when(F.regexp(c, F.lit(f"[{CJK}]")), F.regexp_extract_all(c, F.lit(f"[{CJK}]|[^{CJK}]+"), F.lit(0))).otherwise(F.array(c))


def words_spaced(c: Column) -> Column:
    """Words at white space, cleaned, ideographs apart."""
    pieces = F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), f"[{SPACE}]+"), clean_token), lambda w: w != "")
    return F.flatten(F.transform(pieces, split_cjk))


def words_mixed(c: Column) -> Column:
    """Runs of kept characters, ideographs apart; any other character ends a word."""
    return F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(rf"[{CJK}]|(?:(?![{CJK}])[\p{{L}}\p{{N}}'])+"), F.lit(0))


def timestamp_prompt(words: Column, prefix: str = AUDIO_PREFIX) -> Column:
    """Words with a pair of timestamp tokens behind each; without words the pair still stands once."""
    pair = 2 * TIMESTAMP_TOKEN
    return F.concat(F.lit(prefix), F.array_join(words, pair), F.lit(pair))


def text_prompt(base: Column, language: Column) -> Column:
    """The chat text, and the language with the tag behind it where one is forced."""
    return F.concat(base, F.when(F.coalesce(language, F.lit("")) != "", F.concat(F.lit(LANGUAGE_PREFIX), language, F.lit(TEXT_TAG))).otherwise(""))


def expand_placeholders(c: Column, counts: Column, token: str) -> Column:
    """The k-th token becomes counts[k] tokens; tokens beyond the counts stay."""
    parts = F.split(c, "\\Q" + token + "\\E")
    last = F.size(parts) - 1
    grown = F.transform(parts, lambda p, i: F.when(i < last, F.concat(p, F.repeat(F.lit(token), F.coalesce(F.get(counts, i), F.lit(1)).cast("int")))).otherwise(p))
    return F.array_join(grown, "")


def display_name(c: Column) -> Column:
    """Underscores to blanks, white space to single blanks, each word's first letter upper."""
    pieces = F.filter(F.split(F.replace(c, F.lit("_"), F.lit(" ")), f"[{SPACE}]+"), lambda w: w != "")
    return F.array_join(F.transform(pieces, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), w.substr(F.lit(2), F.length(w)))), " ")


def dtype_name(c: Column, strict: bool = False) -> Column:
    pairs = F.create_map(*(F.lit(x) for pair in DTYPES.items() for x in pair))
    found = F.try_element_at(pairs, F.lower(strip(F.coalesce(c, F.lit("")))))
    return F.coalesce(found, F.raise_error(F.concat(F.lit("unsupported dtype: "), F.coalesce(c, F.lit("null")))).cast("string")) if strict else found


def json_map(c: Column, strict: bool = False) -> Column:
    """A JSON object as a map of strings; blank is the empty map; anything else gives null, or an error."""
    parsed = F.from_json(c, "map<string,string>", {"mode": "PERMISSIVE"})
    good = F.when(F.substring(strip(c), 1, 1) == "{", parsed)
    if strict:
        good = F.coalesce(good, F.raise_error(F.lit("a JSON object is expected")).cast("map<string,string>"))
    return F.when(is_blank(c), F.create_map().cast("map<string,string>")).otherwise(good)


def overlay(base: Column, over: Column) -> Column:
    """Both maps; the second wins."""
    return F.map_concat(F.map_filter(base, lambda k, v: ~F.map_contains_key(over, k)), over)


def turn_label(c: Column, strict: bool = False) -> Column:
    s = F.lower(strip(c))
    bad = F.raise_error(F.concat(F.lit("unsupported label: "), F.coalesce(c, F.lit("null")))).cast("string") if strict else F.lit(None).cast("string")
    return F.when(s.isin(*TURN_LABELS), s).otherwise(bad)


def label_id(c: Column) -> Column:
    """Place of a label among the two, from 0; null for others."""
    return F.nullif(F.array_position(F.array(*(F.lit(x) for x in TURN_LABELS)), c), F.lit(0).cast("bigint")).cast("int") - 1


def default_if_blank(c: Column, default: Column) -> Column:
    """Null and the empty string give way, white space doesn't."""
    return F.coalesce(F.nullif(c, F.lit("")), default)


def checkpoint_step(c: Column) -> Column:
    found = F.regexp_extract(c, r"\Acheckpoint-([0-9]+)\z", 1)
    return F.when(found != "", found.cast("bigint"))


def language_listing(names: Column) -> Column:
    """Lower case, distinct, sorted; null stays null."""
    return F.array_sort(F.array_distinct(F.transform(names, F.lower)))


def roll_back(words: Column, count: int, least: int = 0) -> Column:
    """The words but for the last `count`; further back while what stays ends in an incomplete character."""

    def kept(w: Column) -> Column:
        bad = F.array_position(F.transform(w, lambda x: F.contains(x, F.lit(REPLACEMENT))), F.lit(True)).cast("int")
        size = F.greatest(F.size(w) - count, F.lit(least))
        return F.slice(w, 1, F.when(bad > 0, F.least(size, bad - 1)).otherwise(size))

    return let(words, kept)
