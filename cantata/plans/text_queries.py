"""Catalogue: text, routing and merging."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cantata.functions import text as X
from cantata.model import AUDIO_PREFIX, LANGUAGES
from cantata.operators import align, chunking, datasets, lexicon
from cantata.plans import oracles as O
from cantata.sources import files, routing

DISPLAY = {"en": " cHINese ", "fr": "FRENCH", "de": "german", "es": "new york"}


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


#: Rows with loops that the tables lack: id, text.
LOOPS = [
    (-1, "a" * 20), (-2, "a" * 21), (-3, "a" * 20 + "bcdefghijklmnopqrstu"), (-4, "a" * 20 + "bcdefghijklmnopqrst"), (-5, "ab" * 20), (-6, "ab" * 19), (-7, "abc" * 25 + "xy" * 30 + "z"),
    (-8, "abcdefghijklmnopqrstu" * 20), (-9, ""), (-10, "x" + "é" * 30 + "y" * 5),
]
_LOOPS_SQL = ", ".join(f"({i}, {O.sql_text(t)})" for i, t in LOOPS)

#: Raw outputs by the remainder of doc_id: what stands before and after the text.
RAW = {
    0: ("", ""), 1: ("language English<asr_text>", ""), 2: ("language cHINese\n<asr_text> ", " "), 3: ("language None<asr_text>", ""), 4: ("LANGUAGE french<asr_text>", "<asr_text>b"),
    5: ("noise\nlanguage english\nlanguage french<asr_text>", ""), 6: ("junk<asr_text>", ""), 7: ("language German<asr_text>", ""),
}


def parse_output(spark, sf):
    kind = F.col("doc_id") % 8
    raw = F.coalesce(*(F.when(kind == k, F.concat(F.lit(a), "text", F.lit(b))) for k, (a, b) in RAW.items()))
    return table(spark, sf, "documents").select("doc_id", X.parse_output(raw, F.when(kind == 7, "German")).alias("p")).select("doc_id", "p.language", "p.text")


_RAW_SQL = "CASE doc_id % 8 " + " ".join(f"WHEN {k} THEN {O.sql_text(a)} || text || {O.sql_text(b)}" for k, (a, b) in RAW.items()) + " END"
PARSE_SQL = f"SELECT id AS doc_id, language, text FROM ({O.parsed(f'SELECT doc_id AS id, {_RAW_SQL} AS raw, CASE WHEN doc_id % 8 = 7 THEN {chr(39)}German{chr(39)} END AS forced FROM documents')})"


def language_name(spark, sf):
    raw = F.coalesce(*(F.when(F.col("lang") == k, F.lit(v)) for k, v in DISPLAY.items()), F.lit(" "))
    return table(spark, sf, "documents").select("doc_id", X.language_name(raw).alias("language")).withColumn("supported", X.is_supported_language(F.col("language")))


LANGUAGE_SQL = f"""
WITH n AS (SELECT doc_id, {O.strip("CASE lang " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in DISPLAY.items()) + " ELSE ' ' END")} AS s FROM documents),
m AS (SELECT doc_id, CASE WHEN s != '' THEN {O.capitalized('s')} END AS language FROM n)
SELECT doc_id, language, language IN ({", ".join(f"'{x}'" for x in LANGUAGES)}) AS supported FROM m"""


def collapse_repeats(spark, sf):
    rows = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text").unionByName(spark.createDataFrame(LOOPS, "id bigint, text string"))
    return rows.select("id", X.fix_repetitions(F.col("text")).alias("text"), F.length("text").alias("n_before"))


COLLAPSE_SQL = f"""
WITH RECURSIVE src AS (SELECT doc_id AS id, text AS t FROM documents UNION ALL SELECT * FROM (VALUES {_LOOPS_SQL})), {O.repaired('src')}
SELECT fixed.id, fixed.t AS text, CAST(length(src.t) AS INTEGER) AS n_before FROM fixed JOIN src USING (id)"""


def tokenize_space(spark, sf):
    w = X.words_spaced(F.col("text"))
    return table(spark, sf, "documents").select("doc_id", w.alias("w")).select("doc_id", F.size("w").alias("n_words"), F.array_join("w", "\n").alias("words"))


TOKENIZE_SQL = f"SELECT doc_id, CAST(len(w) AS INTEGER) AS n_words, array_to_string(w, chr(10)) AS words FROM (SELECT doc_id, {O.words_spaced('text')} AS w FROM documents)"

MIXED = [(1, "don't a-b 甚至abc出现。 —"), (2, "你好world"), (3, ""), (4, "a—b 漢字かな x"), (5, "　全角 空白 'q'"), (6, "𠀀𠀁z")]
_MIXED_SQL = "(VALUES " + ", ".join(f"({i}, {O.sql_text(t)})" for i, t in MIXED) + ") v(id, t)"


def tokenize_cjk(spark, sf):
    """Rows of mixed scripts, which the tables lack, and the documents."""
    df = spark.createDataFrame(MIXED, "id bigint, t string").unionByName(table(spark, sf, "documents").select((F.col("doc_id") + 1000).alias("id"), F.col("text").alias("t")))
    return df.select("id", F.array_join(X.words_spaced(F.col("t")), "|").alias("spaced"), F.array_join(X.words_mixed(F.col("t")), "|").alias("mixed"))


# RE2 has no lookahead: a run of kept characters is cut at ideographs afterwards.
CJK_SQL = f"""
SELECT CAST(id AS BIGINT) AS id, array_to_string({O.words_spaced('t')}, '|') AS spaced,
  array_to_string(flatten(list_transform(regexp_extract_all(t, '[\\p{{L}}\\p{{N}}'']+'), lambda x: regexp_extract_all(x, '[{X.CJK}]|[^{X.CJK}]+'))), '|') AS mixed
FROM (SELECT id, t FROM {_MIXED_SQL} UNION ALL SELECT doc_id + 1000, coalesce(text, '') FROM documents)"""


def lexicon_words(spark, sf):
    """Names of parts written together, as words with endings. The lexicon: the names' first words, and what types and names begin with, at lower scores."""
    parts = table(spark, sf, "part")
    first = F.get(F.split("p_name", " "), F.lit(0))
    known = parts.select(first.alias("word"), F.lit(1.0).alias("score")).unionByName(parts.select(F.left("p_name", F.lit(3)).alias("word"), F.lit(0.5).alias("score"))).unionByName(parts.select(F.lower(F.left("p_type", F.lit(4))).alias("word"), F.lit(1.0).alias("score")))
    df = parts.select("p_partkey", F.concat(F.replace("p_name", F.lit(" "), F.lit("")), F.lit(" "), F.lower("p_type"), F.lit("-x"), "p_size").alias("text"))
    return lexicon.words_by_lexicon(df, "text", known, score="score").select("p_partkey", F.array_join("words", " ").alias("words"))


LEXICON_SQL = f"""
WITH k AS (SELECT word, max(score) AS score FROM (SELECT string_split(p_name, ' ')[1] AS word, 1.0 AS score FROM part UNION ALL SELECT p_name[:3], 0.5 FROM part UNION ALL SELECT lower(p_type[:4]), 1.0 FROM part) WHERE word != '' GROUP BY word),
w AS (SELECT p_partkey, unnest([replace(p_name, ' ', ''), lower(p_type) || '-x' || p_size]) AS w, unnest([1, 2]) AS i FROM part),
c AS (SELECT DISTINCT w, unnest(range(2, length(w) + 1)) AS size FROM w WHERE length(w) > 2),
b AS (SELECT c.w, arg_max(size, (coalesce(score, 0.0), size)) AS size FROM c LEFT JOIN k ON k.word = c.w[:size] GROUP BY c.w),
p AS (SELECT p_partkey, i, unnest([w[:coalesce(size, length(w))], w[coalesce(size, length(w)) + 1:]]) AS p, unnest([1, 2]) AS j FROM w LEFT JOIN b USING (w)),
q AS (SELECT p_partkey, i, j, regexp_replace(p, {O.sql_text(X.DROPPED)}, '', 'g') AS p FROM p)
SELECT p_partkey, string_agg(p, ' ' ORDER BY i, j) AS words FROM q WHERE p != '' GROUP BY p_partkey"""


def merge_languages(spark, sf):
    lang = F.when(F.col("doc_id") % 5 == 0, " ").otherwise(F.concat(F.lit(" "), "lang"))
    return align.merge_languages_rows(table(spark, sf, "documents").withColumn("l", lang), "source", "doc_id", "l")


MERGE_LANGUAGES_SQL = """
WITH n AS (SELECT source, doc_id, lang AS l FROM documents WHERE doc_id % 5 != 0),
k AS (SELECT source, doc_id, l, lag(l) OVER (PARTITION BY source ORDER BY doc_id) AS b FROM n),
m AS (SELECT source, string_agg(l, ',' ORDER BY doc_id) AS languages FROM k WHERE b IS NULL OR b != l GROUP BY source)
SELECT DISTINCT d.source, coalesce(m.languages, '') AS languages FROM documents d LEFT JOIN m USING (source)"""


def merge_text(spark, sf):
    return table(spark, sf, "conversations").groupBy("conv_id").agg(align.merged_text(F.col("text"), F.col("turn")).alias("text"), align.merged_languages(F.col("role"), F.col("turn")).alias("roles"))


MERGE_TEXT_SQL = """
WITH k AS (SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS b FROM conversations)
SELECT conv_id, string_agg(coalesce(text, ''), '' ORDER BY turn) AS text, string_agg(role, ',' ORDER BY turn) FILTER (b IS NULL OR b != role) AS roles FROM k GROUP BY conv_id"""


def merge_align_offset(spark, sf):
    """Words of a conversation's turns with synthetic times: a word every 250 ms, 180 ms long; a turn every 30.0625 s."""
    words = table(spark, sf, "conversations").select("conv_id", "turn", X.words_spaced(F.col("text")).alias("w"))
    times = F.flatten(F.transform("w", lambda _, i: F.array(i * 250, i * 250 + 180)))
    items = align.shift(align.pair_words(F.col("w"), times), F.col("turn") * 30.0625)
    merged = words.where(F.size("w") > 0).withColumn("items", items).groupBy("conv_id").agg(align.merged_items(F.col("items"), F.col("turn")).alias("m"))
    return merged.select("conv_id", F.posexplode("m").alias("pos", "x")).select("conv_id", "pos", "x.text", "x.start_time", "x.end_time")


MERGE_ALIGN_SQL = f"""
WITH w AS (SELECT conv_id, turn, {O.words_spaced('text')} AS w FROM conversations),
i AS (SELECT conv_id, turn, unnest(w) AS text, unnest(range(len(w))) AS k FROM w)
SELECT conv_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn, k) - 1 AS INTEGER) AS pos, text,
  round(round(k * 250 / 1000.0, 3) + turn * CAST(30.0625 AS DOUBLE), 3) AS start_time, round(round((k * 250 + 180) / 1000.0, 3) + turn * CAST(30.0625 AS DOUBLE), 3) AS end_time FROM i"""


def batch_assign(spark, sf):
    df = chunking.with_positions(table(spark, sf, "documents").select("doc_id"), "doc_id")
    return df.select("doc_id", chunking.batch_number(F.col("position"), 32).alias("batch"), chunking.batch_number(F.col("position"), 0).alias("single"))


BATCH_SQL = "SELECT doc_id, CAST((row_number() OVER (ORDER BY doc_id) - 1) // 32 AS BIGINT) AS batch, CAST(0 AS BIGINT) AS single FROM documents"

SPECIAL_INPUTS = [("https://h/x"), ("data:audio/wav;base64,AAAA"), ("A" * 257), ("A" * 256), ("/" + "a" * 299), ("http:///x"), ("ftp://h"), ("HTTP://H"), ("a\\b" * 100), ("")]


def route_audio(spark, sf):
    urls = table(spark, sf, "pages").select(F.col("url").alias("s"))
    texts = table(spark, sf, "documents").select(F.col("text").alias("s"))
    packed = texts.select(routing.data_url("audio/wav", F.encode("s", "utf-8")).alias("s"))
    rows = urls.unionByName(texts).unionByName(packed).unionByName(spark.createDataFrame([(x,) for x in SPECIAL_INPUTS], "s string"))
    rows = rows.select("s", F.octet_length(routing.base64_bytes(F.when(F.col("s").startswith("data:"), F.col("s")))).alias("bytes"))
    return rows.groupBy(routing.route(F.col("s")).alias("kind"), F.col("bytes").isNotNull().alias("decodes")).agg(F.count("*").alias("n"), F.sum(F.length("s")).alias("chars"), F.sum("bytes").alias("payload"))


ROUTE_SQL = f"""
WITH s AS (SELECT url AS s, NULL AS b FROM pages UNION ALL SELECT text, NULL FROM documents
  UNION ALL SELECT 'data:audio/wav;base64,' || to_base64(encode(text)), octet_length(encode(text)) FROM documents
  UNION ALL SELECT s, CASE WHEN starts_with(s, 'data:') THEN 3 END FROM (VALUES {", ".join(f"({O.sql_text(x)})" for x in SPECIAL_INPUTS)}) v(s))
SELECT CASE WHEN regexp_matches(s, '^(?i:https?)://[^/?#]+') THEN 'url' WHEN starts_with(s, 'data:audio') OR (NOT contains(s, '/') AND NOT contains(s, '\\') AND length(s) > 256) THEN 'base64' ELSE 'path' END AS kind,
  b IS NOT NULL AS decodes, count(*) AS n, CAST(sum(length(s)) AS BIGINT) AS chars, CAST(sum(b) AS BIGINT) AS payload FROM s GROUP BY 1, 2"""


def placeholder_expand(spark, sf):
    df = table(spark, sf, "conversations")
    marked = F.concat(F.lit("<a>"), "role", F.lit("<a>"), F.coalesce("text", F.lit("")), F.lit("<a>"))
    expanded = X.expand_placeholders(marked, F.array((F.col("turn") % 3).cast("int"), F.lit(2)), "<a>")
    return df.select("conv_id", "turn", expanded.alias("expanded"), X.timestamp_prompt(X.words_spaced(F.col("text"))).alias("aligned"), X.text_prompt(F.col("role"), F.when(F.col("turn") % 2 == 0, "German")).alias("prompt"))


PLACEHOLDER_SQL = f"""
SELECT conv_id, turn, repeat('<a>', CAST(turn % 3 AS INTEGER)) || role || '<a><a>' || coalesce(text, '') || '<a>' AS expanded,
  '{AUDIO_PREFIX}' || array_to_string({O.words_spaced('text')}, '<timestamp><timestamp>') || '<timestamp><timestamp>' AS aligned,
  role || CASE WHEN turn % 2 = 0 THEN 'language German<asr_text>' ELSE '' END AS prompt FROM conversations"""


def defaults_prune(spark, sf):
    df = table(spark, sf, "conversations").select(
        F.concat(F.lit("a"), "conv_id").alias("audio"), F.when(F.col("turn") % 2 == 0, " COMPLETE ").otherwise("Incomplete").alias("label"), F.when(F.col("turn") % 3 == 0, "").otherwise(F.col("role")).alias("prompt"),
        F.when(F.col("turn") % 4 != 0, F.col("turn") * 100).alias("cut_time_ms"), F.lit(None).cast("double").alias("left_context_ms"), F.col("turn").cast("double").alias("right_context_ms"), F.col("text"),
    )
    return datasets.prepare_turns(df, "default", 1500, 200)


DEFAULTS_SQL = """
SELECT 'a' || conv_id AS audio, CAST(CASE WHEN turn % 2 = 0 THEN 1 ELSE 0 END AS INTEGER) AS label_id, CASE WHEN turn % 3 = 0 OR role IS NULL THEN 'default' ELSE role END AS prompt_text,
  CAST(CASE WHEN turn % 4 != 0 THEN turn * 100 END AS DOUBLE) AS cut_time_ms, CAST(1500 AS DOUBLE) AS left_context_ms, CAST(turn AS DOUBLE) AS right_context_ms FROM conversations"""


def json_parse(spark, sf):
    df = table(spark, sf, "events").select("event_id", X.json_map(F.col("props")).alias("m"))
    both = X.overlay(F.col("m"), F.create_map(F.lit("k"), F.lit("over")))
    return df.select("event_id", F.map_contains_key("m", "k").alias("had"), F.element_at(both, "k").alias("k"), F.size("m").alias("n"))


JSON_SQL = "SELECT event_id, coalesce(list_contains(json_keys(props), 'k'), false) AS had, 'over' AS k, CAST(coalesce(len(json_keys(props)), 0) AS INTEGER) AS n FROM events"

#: Aliases, paths and labels by the remainder of a part's size.
ALIASES = {0: " BF16", 1: "half", 2: "fp32", 3: "int8", 4: "Float16"}
PATHS = {0: ("checkpoint-", ""), 1: ("checkpoint-", "x"), 2: ("a/checkpoint-", ""), 3: ("checkpoint-00", "")}


def small_text(spark, sf):
    """Display names, dtype aliases, language listings, checkpoint names and lenient labels, made of the parts' names, types and numbers."""
    size = F.col("p_size")
    pick = lambda n, values, f: F.coalesce(*(F.when(size % n == k, f(v)) for k, v in values.items()))
    names = F.concat(F.split("p_name", " "), F.array("p_type", "p_brand", F.lower("p_type")))
    return table(spark, sf, "part").select(
        "p_partkey",
        X.display_name(F.concat(F.lit("_"), "p_name", F.lit("__ "), F.lower("p_type"))).alias("display"),
        X.dtype_name(pick(len(ALIASES), ALIASES, F.lit)).alias("dtype"),
        F.array_join(X.language_listing(F.when(size % 7 != 0, names)), ",").alias("listing"),
        X.checkpoint_step(pick(len(PATHS), PATHS, lambda v: F.concat(F.lit(v[0]), F.col("p_partkey").cast("string"), F.lit(v[1])))).alias("step"),
        X.turn_label(F.when(size % 2 == 0, " Complete").otherwise(F.col("p_type"))).alias("label"),
    )


SMALL_SQL = f"""
WITH n AS (SELECT *, string_split(p_name, ' ') || [p_type, p_brand, lower(p_type)] AS names FROM part)
SELECT p_partkey,
  array_to_string(list_transform(list_filter(regexp_split_to_array(replace('_' || p_name || '__ ' || lower(p_type), '_', ' '), ' +'), lambda x: x != ''), lambda x: upper(x[1:1]) || x[2:]), ' ') AS display,
  CASE p_size % 5 WHEN 0 THEN 'bfloat16' WHEN 1 THEN 'float16' WHEN 2 THEN 'float32' WHEN 4 THEN 'float16' END AS dtype,
  CASE WHEN p_size % 7 != 0 THEN array_to_string(list_sort(list_distinct(list_transform(names, lambda x: lower(x)))), ',') END AS listing,
  CASE WHEN p_size % 4 IN (0, 3) THEN p_partkey END AS step, CASE WHEN p_size % 2 = 0 THEN 'complete' END AS label FROM n"""


def results_json(spark, sf):
    """Results of recognized documents as JSON, blank texts left out, and the rolled-back prefix of each."""
    df = align.worth_aligning(table(spark, sf, "documents").select("doc_id", "lang", X.strip(F.col("text")).alias("t")), "t")
    df = df.select("doc_id", F.from_json(files.result_json(F.col("lang"), F.col("t")), "language string, text string").alias("r"), F.array_join(X.roll_back(X.words_spaced(F.col("t")), 5), " ").alias("prefix"))
    return df.select("doc_id", "r.language", "r.text", "prefix")


RESULTS_SQL = f"""
SELECT doc_id, coalesce(lang, '') AS language, t AS text, array_to_string(w[:greatest(len(w) - 5, 0)], ' ') AS prefix
FROM (SELECT doc_id, lang, t, {O.words_spaced('t')} AS w FROM (SELECT doc_id, lang, {O.strip('text')} AS t FROM documents)) WHERE t != ''"""


def transcript_rows(spark, sf):
    """Documents as training rows, and the text that the trainer sees. The language is the prompt, every third row has none."""
    prefix = X.text_prompt(F.lit(AUDIO_PREFIX), F.when(F.col("doc_id") % 2 == 0, "German"))
    df = table(spark, sf, "documents").select("doc_id", F.col("source").alias("audio"), "text", F.when(F.col("doc_id") % 3 != 0, F.col("lang")).alias("prompt"))
    rows = datasets.prepare_transcripts(df, prefix, keep=("doc_id",))
    return rows.withColumn("full_text", datasets.full_text(F.col("prefix_text"), F.col("target"), "<end>"))


TRANSCRIPT_SQL = f"""
SELECT *, prefix_text || target || '<end>' AS full_text FROM (
  SELECT doc_id, CASE WHEN doc_id % 3 != 0 THEN coalesce(lang, '') ELSE '' END AS prompt, source AS audio, text AS target,
    '{AUDIO_PREFIX}' || CASE WHEN doc_id % 2 = 0 THEN 'language German<asr_text>' ELSE '' END AS prefix_text FROM documents)"""


QUERIES = {
    "transcript_rows": (transcript_rows, TRANSCRIPT_SQL),
    "parse_output": (parse_output, PARSE_SQL),
    "language_name": (language_name, LANGUAGE_SQL),
    "collapse_repeats": (collapse_repeats, COLLAPSE_SQL),
    "tokenize_space": (tokenize_space, TOKENIZE_SQL),
    "tokenize_cjk": (tokenize_cjk, CJK_SQL),
    "lexicon_words": (lexicon_words, LEXICON_SQL),
    "merge_languages": (merge_languages, MERGE_LANGUAGES_SQL),
    "merge_text": (merge_text, MERGE_TEXT_SQL),
    "merge_align_offset": (merge_align_offset, MERGE_ALIGN_SQL),
    "batch_assign": (batch_assign, BATCH_SQL),
    "route_audio": (route_audio, ROUTE_SQL),
    "placeholder_expand": (placeholder_expand, PLACEHOLDER_SQL),
    "defaults_prune": (defaults_prune, DEFAULTS_SQL),
    "json_parse": (json_parse, JSON_SQL),
    "small_text": (small_text, SMALL_SQL),
    "results_json": (results_json, RESULTS_SQL),
}
