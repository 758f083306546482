"""Catalogue: signals, training rows, metrics and sessions."""

from __future__ import annotations

from pyspark.sql import functions as F

from cantata.functions import signal as S
from cantata.functions.text import let
from cantata.model import TURN_LABELS
from cantata.operators import align, chunking, datasets, resampling
from cantata.plans.text_queries import table
from cantata.sources import files
from cantata.storage import Scratch
from cantata.streaming import sessions

#: Vectors stand in for signals: 64 samples.
DOUBLES = "list_transform(embedding, lambda x: CAST(x AS DOUBLE))"


def signals(spark, sf):
    return table(spark, sf, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("x"), "label")


def rounded(c, places=6):
    """Rounded numbers of an array; minus zero becomes zero."""
    return F.transform(c, lambda x: F.round(x, places) + 0.0)


def spread(df, *keep):
    """Arrays as rows (pos, value)."""
    return df.select(*keep, F.posexplode("y").alias("pos", "value"))


def feature_length(spark, sf):
    n = F.col("n_chars")
    return table(spark, sf, "documents").select("doc_id", S.feature_length(n).alias("positions"), S.convolved_length(n).alias("convolved"))


def _half(x: str) -> str:
    return f"(CAST(floor((({x}) - 1) / 2.0) AS BIGINT) + 1)"


FEATURE_SQL = f"SELECT doc_id, {_half(_half(_half('n_chars % 100')))} + (n_chars // 100) * 13 AS positions, {_half(_half(_half('n_chars')))} AS convolved FROM documents"


def chunk_plan(spark, sf):
    df = table(spark, sf, "documents").select("doc_id", S.frame_chunks(F.col("n_chars"), 200).alias("c"))
    return df.select("doc_id", F.posexplode("c").alias("chunk", "frames"))


CHUNK_SQL = "SELECT doc_id, CAST(k AS INTEGER) AS chunk, CAST(least(200, n_chars - 200 * k) AS BIGINT) AS frames FROM (SELECT doc_id, n_chars, unnest(range(CAST(ceil(n_chars / 200.0) AS BIGINT))) AS k FROM documents)"


def cu_lengths(spark, sf):
    df = table(spark, sf, "documents").select("doc_id", S.cumulative(S.attention_windows(S.feature_length(F.col("n_chars")), 104)).alias("c"))
    return df.select("doc_id", F.posexplode("c").alias("pos", "end"))


CU_SQL = f"""
WITH p AS ({FEATURE_SQL})
SELECT doc_id, CAST(k AS INTEGER) AS pos, CAST(least(104 * k, positions) AS BIGINT) AS "end" FROM (SELECT doc_id, positions, unnest(range(CAST(ceil(positions / 104.0) AS BIGINT) + 1)) AS k FROM p)"""


def energy_window(spark, sf):
    rows = signals(spark, sf).select("vec_id", F.posexplode("x").alias("i", "v"))
    return chunking.quietest_window(rows, "vec_id", "i", "v", 4).select("vec_id", F.col("window_start"), F.round("energy", 6).alias("energy"))


ENERGY_SQL = f"""
WITH r AS (SELECT vec_id, unnest({DOUBLES}) AS v, unnest(range(64)) AS i FROM embeddings),
e AS (SELECT vec_id, i, sum(abs(v)) OVER w AS energy, count(*) OVER w AS n FROM r WINDOW w AS (PARTITION BY vec_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING))
SELECT vec_id, CAST(arg_min(i, (energy, i)) AS INTEGER) AS window_start, round(min(energy), 6) AS energy FROM e WHERE n = 4 GROUP BY vec_id"""


def energy_split(spark, sf):
    """16 samples a second, chunks of 1 s, half a second of padding at least, boundaries within 0.25 s."""
    df = table(spark, sf, "embeddings").select("vec_id", "embedding")
    out = chunking.split_quiet(df, "embedding", 16, 1.0, 0.25, 250.0, keep=("vec_id",))
    return out.select("vec_id", "chunk_index", "offset_samples", "offset_sec", "n_samples", F.size("chunk").alias("padded"))


# The walk over cuts as a recursive query. Sums are taken as single precision numbers, one after the other, as in a convolution.
SPLIT_SQL = """
WITH RECURSIVE s AS (SELECT vec_id, list_transform(embedding, lambda x: abs(x)) AS a FROM embeddings),
w AS (
  SELECT vec_id, a, CAST(0 AS BIGINT) AS start, CAST(0 AS BIGINT) AS k, CAST(NULL AS BIGINT) AS stop FROM s
  UNION ALL
  SELECT vec_id, a, stop, k + 1, CAST(NULL AS BIGINT) FROM (
    SELECT vec_id, a, start, k, least(greatest(lo + win + list_position(a[lo + win + 1:lo + win + 4], list_min(a[lo + win + 1:lo + win + 4])) - 1, start + 1), 64) AS stop FROM (
      SELECT vec_id, a, start, k, lo, list_position(e, list_min(e)) - 1 AS win FROM (
        SELECT *, list_transform(range(hi - lo - 3), lambda i: CAST(a[lo + i + 1] + a[lo + i + 2] + a[lo + i + 3] + a[lo + i + 4] AS FLOAT)) AS e FROM (
          SELECT vec_id, a, start, k, greatest(start, start + 12) AS lo, least(64, start + 20) AS hi FROM w WHERE 64 - start > 16))))),
c AS (SELECT vec_id, k AS chunk_index, start, lead(start, 1, 64) OVER (PARTITION BY vec_id ORDER BY k) AS stop FROM w)
SELECT vec_id, CAST(chunk_index AS INTEGER) AS chunk_index, start AS offset_samples, CAST(start / 16.0 AS DOUBLE) AS offset_sec, stop - start AS n_samples, CAST(greatest(stop - start, 8) AS INTEGER) AS padded FROM c"""


def mono_normalize(spark, sf):
    x = F.transform("x", lambda v: v * 8)
    df = signals(spark, sf).select("vec_id", S.to_mono(F.array(F.slice(x, 1, 32), F.slice(x, 33, 32))).alias("m"))
    return spread(df.select("vec_id", rounded(S.normalize_peak(F.col("m"))).alias("y")), "vec_id")


MONO_SQL = f"""
WITH m AS (SELECT vec_id, list_transform(range(32), lambda i: (e[i + 1] * 8 + e[i + 33] * 8) / 2) AS m FROM (SELECT vec_id, {DOUBLES} AS e FROM embeddings)),
p AS (SELECT vec_id, m, greatest(list_max(list_transform(m, lambda x: abs(x))), 1.0) AS p FROM m)
SELECT vec_id, CAST(unnest(range(32)) AS INTEGER) AS pos, unnest(list_transform(m, lambda x: round(least(greatest(x / p, -1.0), 1.0), 6) + 0.0)) AS value FROM p"""


def integer_normalize(spark, sf):
    """Vectors as integer samples: 16 bits, 8 bits, and as frames of two channels, integer and floating."""

    def parts(x):
        pcm = F.transform(x, lambda v: F.greatest(F.least(v, F.lit(32767.0)), F.lit(-32768.0)))
        byte = F.transform(x, lambda v: F.pmod(v, F.lit(256.0)))
        frames = F.transform(F.sequence(F.lit(0), F.lit(31)), lambda i: F.slice(x, 2 * i + 1, 2))
        return F.concat(S.from_int16(pcm), S.normalize_integers(pcm, -32768, 32767), S.normalize_integers(byte, 0, 255), S.normalize_frames(frames, -32768, 32767), S.normalize_frames(frames))

    all_ = let(F.transform("x", lambda v: F.round(v * 20000)), parts)
    return spread(signals(spark, sf).select("vec_id", F.transform(all_, lambda v: v + 0.0).alias("y")), "vec_id")  # unrounded: these are fractions of powers of two, many of which lie halfway


INTEGER_SQL = f"""
WITH x AS (SELECT vec_id, list_transform({DOUBLES}, lambda v: round(v * 20000)) AS x FROM embeddings),
p AS (SELECT *, list_max(list_transform(x, lambda v: abs(v))) AS p FROM x),
y AS (SELECT vec_id, list_transform(x, lambda v: least(greatest(v, -32768), 32767) / 32768.0) AS a, list_transform(x, lambda v: ((v % 256 + 256) % 256 - 128) / 128.0) AS b,
  list_transform(x, lambda v: least(greatest(v / 32768.0, -1.0), 1.0)) AS c, list_transform(x, lambda v: least(greatest(CASE WHEN p > 1 + 1e-6 THEN v / (p + 1e-12) ELSE v END, -1.0), 1.0)) AS d FROM p),
z AS (SELECT vec_id, a || a || b || list_transform(range(32), lambda i: (c[2 * i + 1] + c[2 * i + 2]) / 2) || list_transform(range(32), lambda i: (d[2 * i + 1] + d[2 * i + 2]) / 2) AS z FROM y)
SELECT vec_id, CAST(unnest(range(256)) AS INTEGER) AS pos, unnest(list_transform(z, lambda v: CAST(v AS DOUBLE) + 0.0)) AS value FROM z"""


def resample_linear(spark, sf):
    df = signals(spark, sf)
    both = F.concat(S.resample_span(F.col("x"), 64, 48), S.resample_step(F.col("x"), 64, 48))
    return spread(df.select("vec_id", rounded(both, 5).alias("y")), "vec_id")


def _mix(at: str) -> str:
    return f"e[CAST(floor({at}) AS BIGINT) + 1] * (1 - ({at} - floor({at}))) + e[least(CAST(floor({at}) AS BIGINT) + 2, 64)] * ({at} - floor({at}))"


RESAMPLE_SQL = f"""
WITH e AS (SELECT vec_id, {DOUBLES} AS e FROM embeddings)
SELECT vec_id, CAST(unnest(range(96)) AS INTEGER) AS pos,
  unnest(list_transform(list_transform(range(48), lambda i: {_mix('(i * CAST(63 AS DOUBLE) / 47)')}) || list_transform(range(48), lambda i: {_mix('(i * CAST(64 AS DOUBLE) / 48)')}), lambda v: round(v, 5) + 0.0)) AS value FROM e"""


#: Zero crossings of the filter in this query.
SINC_ZEROS = 8


def resample_sinc(spark, sf):
    """Vectors as signals of 64 samples a second, brought to 48."""
    df = signals(spark, sf).select("vec_id", F.col("x").alias("y"), F.lit(64).alias("rate"))
    return spread(resampling.resample_rows(df, "y", "rate", 48, SINC_ZEROS).select("vec_id", rounded(F.col("y")).alias("y")), "vec_id")


# Each new sample by the filter's formula, over all places that it reaches; beyond the ends a signal is silent.
_CUT = f"({resampling.BAND} * 0.75)"
SINC_SQL = f"""
WITH e AS (SELECT vec_id, {DOUBLES} AS e FROM embeddings),
p AS (SELECT pos, list_transform(range(-20, 90), lambda k: CAST(k - pos * 4 / 3.0 AS DOUBLE)) AS t FROM range(48) r(pos)),
h AS (SELECT pos, list_transform(t, lambda t: CASE WHEN abs(t) >= {SINC_ZEROS} / {_CUT} THEN 0.0 WHEN abs(t) < 1e-9 THEN 1.0 ELSE sin(pi() * {_CUT} * t) / (pi() * {_CUT} * t) * cos(pi() * t * {_CUT} / {2 * SINC_ZEROS}) ** 2 END) AS h FROM p)
SELECT vec_id, CAST(pos AS INTEGER) AS pos, round(list_sum(list_transform(range(64), lambda i: e[i + 1] * h[i + 21])) / list_sum(h), 6) + 0.0 AS value FROM e, h"""


def window_slice(spark, sf):
    cut = F.when(F.col("vec_id") % 7 != 0, (F.col("vec_id") % 90) * 50)
    df = signals(spark, sf).select("vec_id", F.size(S.window_slice(F.col("x"), 16, cut, F.lit(1000.0), F.lit(250.0))).alias("n"), S.window_bounds(F.lit(64), 16, cut, F.lit(1000.0), F.lit(250.0)).alias("b"))
    return df.select("vec_id", "n", "b.start", "b.end")


WINDOW_SQL = """
WITH c AS (SELECT vec_id, CASE WHEN vec_id % 7 != 0 THEN CAST(round_even((vec_id % 90) * 50 * 16 / 1000.0, 0) AS BIGINT) END AS cut FROM embeddings),
b AS (SELECT vec_id, cut, greatest(cut - 16, 0) AS s, least(cut + 4, 64) AS e FROM c),
w AS (SELECT vec_id, CASE WHEN cut IS NULL OR e <= s THEN 0 ELSE s END AS s, CASE WHEN cut IS NULL OR e <= s THEN 64 ELSE e END AS e FROM b)
SELECT vec_id, CAST(e - s AS INTEGER) AS n, CAST(s AS BIGINT) AS start, CAST(e AS BIGINT) AS "end" FROM w"""


def pooling(spark, sf):
    """Each vector as 16 steps of 4 components; the mask leaves out the last vec_id % 5 steps."""
    vectors = F.transform(F.sequence(F.lit(0), F.lit(15)), lambda i: F.slice("x", i * 4 + 1, 4))
    mask = F.transform(F.sequence(F.lit(0), F.lit(15)), lambda i: F.when(i < 16 - F.col("vec_id") % 5, 1).otherwise(0))
    df = signals(spark, sf).select("vec_id", vectors.alias("v"), mask.alias("m"))
    return spread(df.select("vec_id", rounded(F.concat(S.pool_mean(F.col("v"), F.col("m")), S.pool_last(F.col("v"), F.col("m")))).alias("y")), "vec_id")


POOL_SQL = f"""
WITH e AS (SELECT vec_id, 16 - vec_id % 5 AS n, {DOUBLES} AS e FROM embeddings)
SELECT vec_id, CAST(unnest(range(8)) AS INTEGER) AS pos,
  unnest(list_transform(list_transform(range(4), lambda c: list_reduce(list_transform(range(n), lambda i: e[i * 4 + c + 1]), lambda a, b: a + b, 0.0) / n) || list_transform(range(4), lambda c: e[(n - 1) * 4 + c + 1]), lambda v: round(v, 6) + 0.0)) AS value FROM e"""


def softmax_argmax(spark, sf):
    """A vector as pairs of logits."""
    logits = F.transform(F.sequence(F.lit(0), F.lit(31)), lambda i: F.slice("x", 2 * i + 1, 2))
    rows = signals(spark, sf).select("vec_id", F.posexplode(logits).alias("pos", "l")).select("vec_id", "pos", "l", S.softmax(F.col("l")).alias("p"))
    return rows.select("vec_id", "pos", F.round(F.get("p", F.lit(0)), 6).alias("incomplete_prob"), F.round(F.get("p", F.lit(1)), 6).alias("complete_prob"), F.get(F.array(*map(F.lit, TURN_LABELS)), S.argmax(F.col("l"))).alias("label"))


SOFTMAX_SQL = f"""
WITH r AS (SELECT vec_id, {DOUBLES} AS e, unnest(range(32)) AS pos FROM embeddings),
l AS (SELECT vec_id, pos, e[2 * pos + 1] AS a, e[2 * pos + 2] AS b, greatest(e[2 * pos + 1], e[2 * pos + 2]) AS m FROM r)
SELECT vec_id, CAST(pos AS INTEGER) AS pos, round(exp(a - m) / (exp(a - m) + exp(b - m)), 6) AS incomplete_prob, round(exp(b - m) / (exp(a - m) + exp(b - m)), 6) AS complete_prob, CASE WHEN b > a THEN 'complete' ELSE 'incomplete' END AS label FROM l"""


def binary_metrics(spark, sf):
    m = datasets.binary_metrics(table(spark, sf, "labels"), "toxic", "quality")
    return m.select(*(F.round(c, 9).alias(c) for c in m.columns))


METRICS_SQL = """
WITH c AS (SELECT count(*) FILTER (toxic = 1 AND quality = 1) AS tp, count(*) FILTER (toxic = 1 AND quality = 0) AS fp, count(*) FILTER (toxic = 0 AND quality = 1) AS fn, count(*) FILTER (toxic = quality) AS hit, count(*) AS n FROM labels),
m AS (SELECT hit / CAST(greatest(n, 1) AS DOUBLE) AS a, tp / CAST(greatest(1, tp + fp) AS DOUBLE) AS p, tp / CAST(greatest(1, tp + fn) AS DOUBLE) AS r FROM c)
SELECT round(a, 9) AS accuracy, round(p, 9) AS precision, round(r, 9) AS recall, round(2 * p * r / greatest(1e-8, p + r), 9) AS f1 FROM m"""


def position_ids(spark, sf):
    rows = table(spark, sf, "conversations").groupBy("conv_id").agg(align.in_order(F.when(F.col("role") == "system", 0).otherwise(1), F.col("turn")).alias("mask"))
    out = rows.select("conv_id", "mask", S.mask_positions(F.col("mask")).alias("p"))
    delta = F.array_max("p") + 1 - F.aggregate("mask", F.lit(0).cast("bigint"), lambda a, m: a + m)
    return out.select("conv_id", delta.alias("delta"), F.posexplode("p").alias("pos", "position"))


POSITION_SQL = """
WITH m AS (SELECT conv_id, turn, CASE WHEN role = 'system' THEN 0 ELSE 1 END AS m FROM conversations),
p AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS pos, m, CASE WHEN m = 0 THEN 1 ELSE sum(m) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) - 1 END AS position FROM m)
SELECT conv_id, CAST(max(position) OVER (PARTITION BY conv_id) + 1 - sum(m) OVER (PARTITION BY conv_id) AS BIGINT) AS delta, CAST(pos AS INTEGER) AS pos, CAST(position AS BIGINT) AS position FROM p"""


def segment_positions(spark, sf):
    """A conversation as one sequence: each turn is a sound behind turn % 3 text tokens, and two more tokens end it."""
    rows = table(spark, sf, "conversations").groupBy("conv_id").agg(align.in_order(F.struct((F.col("turn") % 3).alias("text"), F.length(F.coalesce("text", F.lit(""))).cast("bigint").alias("size")), F.col("turn")).alias("turns"))
    ends = S.cumulative(F.transform("turns", lambda x: x["text"] + x["size"]))
    rows = rows.withColumn("ends", ends)
    offsets = F.transform("turns", lambda x, i: F.get("ends", i) + x["text"])
    segments = S.segment_positions(offsets, F.transform("turns", lambda x: x["size"]), F.array_max("ends") + 2)
    return rows.select("conv_id", F.posexplode(segments).alias("pos", "s")).select("conv_id", "pos", "s.kind", "s.first", "s.size")


SEGMENT_SQL = """
WITH t AS (SELECT conv_id, turn, CAST(turn % 3 AS BIGINT) AS n, CAST(length(coalesce(text, '')) AS BIGINT) AS size FROM conversations),
e AS (SELECT *, CAST(sum(n + size) OVER (PARTITION BY conv_id ORDER BY turn) AS BIGINT) AS stop FROM t),
s AS (SELECT conv_id, turn, 0 AS part, 'text' AS kind, stop - size - n AS first, n AS size FROM e WHERE n > 0 UNION ALL SELECT conv_id, turn, 1, 'sound', stop - size, size FROM e
  UNION ALL SELECT conv_id, max(turn) + 1, 0, 'text', max(stop), 2 FROM e GROUP BY conv_id)
SELECT conv_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn, part) - 1 AS INTEGER) AS pos, kind, first, size FROM s"""


def batch_padding(spark, sf):
    """Word lengths of documents as signals, in batches of eight, padded to the longest of the batch."""
    x = F.transform(F.split("text", " "), lambda w: F.length(w).cast("double"))
    df = table(spark, sf, "documents").select("doc_id", F.floor(F.col("doc_id") / 8).alias("batch"), x.alias("x"))
    out = chunking.pad_batches(df, "batch", "x")
    return out.select("doc_id", "batch", F.size("x").alias("n"), F.aggregate("mask", F.lit(0), lambda a, m: a + m).alias("valid"), F.aggregate("x", F.lit(0.0), lambda a, v: a + v).alias("total"))


PADDING_SQL = """
WITH x AS (SELECT doc_id, doc_id // 8 AS batch, coalesce(list_transform(string_split(text, ' '), lambda w: length(w)), CAST([] AS BIGINT[])) AS x FROM documents)
SELECT doc_id, batch, CAST(max(len(x)) OVER (PARTITION BY batch) AS INTEGER) AS n, CAST(len(x) AS INTEGER) AS valid, CAST(coalesce(list_sum(x), 0) AS DOUBLE) AS total FROM x"""


def label_mask(spark, sf):
    ids = F.transform(F.split("text", " "), lambda w: F.length(w))
    df = table(spark, sf, "documents").select("doc_id", datasets.masked_labels(ids, F.lit(5), 2).alias("y"))
    return df.select("doc_id", F.size("y").alias("n"), F.size(F.filter("y", lambda x: x == -100)).alias("masked"), F.aggregate("y", F.lit(0).cast("bigint"), lambda a, x: a + x).alias("total"))


MASK_SQL = """
WITH y AS (SELECT doc_id, list_transform(string_split(text, ' '), lambda w, i: CASE WHEN i <= 5 OR length(w) = 2 THEN -100 ELSE length(w) END) AS y FROM documents)
SELECT doc_id, CAST(len(y) AS INTEGER) AS n, CAST(len(list_filter(y, lambda x: x = -100)) AS INTEGER) AS masked, CAST(list_sum(y) AS BIGINT) AS total FROM y"""


def latest_checkpoint(spark, sf):
    df = table(spark, sf, "events").select("user_id", F.concat(F.when(F.col("event_id") % 10 == 0, "tmp-checkpoint-").otherwise("checkpoint-"), F.col("event_id").cast("string")).alias("path"))
    kept = datasets.retained_checkpoints(df, "user_id", "path", 3).groupBy("user_id").agg(F.sum("step").alias("kept_sum"), F.max("age").alias("kept"))
    return datasets.latest_checkpoint(df, "user_id", "path").join(kept, "user_id")


CHECKPOINT_SQL = """
WITH c AS (SELECT user_id, event_id AS step FROM events WHERE event_id % 10 != 0), a AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY step DESC) AS age FROM c)
SELECT user_id, max(step) AS step, 'checkpoint-' || max(step) AS path, CAST(sum(step) FILTER (age <= 3) AS BIGINT) AS kept_sum, CAST(max(age) FILTER (age <= 3) AS INTEGER) AS kept FROM a GROUP BY user_id"""


def timestamp_repair(spark, sf):
    df = signals(spark, sf).select("vec_id", F.transform("x", lambda v, i: (F.round(v * 400) + i * 60).cast("bigint")).alias("t"))
    return spread(align.repair_times(df, "t", "y"), "vec_id")


# n: length of the longest rising subsequence that ends at each place, p: the place before it there (0 for none); by the quadratic rule.
REPAIR_SQL = f"""
WITH RECURSIVE s AS (SELECT vec_id, list_transform({DOUBLES}, lambda v, i: CAST(round(v * 400) + (i - 1) * 60 AS BIGINT)) AS t FROM embeddings),
d AS (
  SELECT vec_id, t, CAST(1 AS BIGINT) AS i, [CAST(1 AS BIGINT)] AS n, [CAST(0 AS BIGINT)] AS p FROM s
  UNION ALL
  SELECT vec_id, t, i + 1, list_append(n, m + 1), list_append(p, CASE WHEN m = 0 THEN 0 ELSE list_position(fits, m) END) FROM (
    SELECT *, list_max(fits) AS m FROM (SELECT *, list_transform(range(1, i + 1), lambda j: CASE WHEN t[j] <= t[i + 1] THEN n[j] ELSE 0 END) AS fits FROM d WHERE i < len(t)))),
b AS (
  SELECT vec_id, t, p, CAST(list_position(n, list_max(n)) AS BIGINT) AS place, [CAST(list_position(n, list_max(n)) AS BIGINT)] AS good FROM d WHERE i = len(t)
  UNION ALL
  SELECT vec_id, t, p, p[place], list_prepend(p[place], good) FROM b WHERE p[place] > 0),
x AS (SELECT vec_id, t, k, list_max(list_filter(good, lambda q: q <= k)) AS l, list_min(list_filter(good, lambda q: q >= k)) AS r FROM (SELECT vec_id, t, good, unnest(range(1, len(t) + 1)) AS k FROM b WHERE p[place] = 0))
SELECT vec_id, CAST(k - 1 AS INTEGER) AS pos, CAST(CASE WHEN l = r THEN t[k] WHEN l IS NULL THEN t[r] WHEN r IS NULL THEN t[l] WHEN r - l - 1 <= 2 THEN CASE WHEN k - l <= r - k THEN t[l] ELSE t[r] END
  ELSE trunc(t[l] + (t[r] - t[l]) / CAST(r - l AS DOUBLE) * (k - l)) END AS BIGINT) AS value FROM x"""


def token_times(spark, sf):
    """Predictions at marker tokens, chunk numbers of rising values, and rows dealt to placeholders."""
    tokens = F.transform("x", lambda v: F.pmod(F.floor(v * 1000), F.lit(4)).cast("int"))
    df = signals(spark, sf).select("vec_id", tokens.alias("t"))
    steps = F.transform("t", lambda v, i: (i * 7 + v * 3).cast("bigint"))
    rows = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: i * 10)
    return df.select(
        "vec_id", F.array_join(S.marked_times(F.col("t"), steps, 1, 80.0), ",").alias("times"), F.array_join(S.range_chunks(F.array_sort(steps), 20), ",").alias("chunks"),
        F.array_join(S.scatter(F.col("t"), 2, rows), ",", "-").alias("scattered"),
    )


TOKEN_SQL = f"""
WITH t AS (SELECT vec_id, list_transform({DOUBLES}, lambda v: ((CAST(floor(v * 1000) AS BIGINT) % 4) + 4) % 4) AS t FROM embeddings),
s AS (SELECT vec_id, t, list_transform(t, lambda v, i: (i - 1) * 7 + v * 3) AS s FROM t)
SELECT vec_id,
  array_to_string(list_transform(list_filter(range(1, 65), lambda i: t[i] = 1), lambda i: CAST(s[i] * CAST(80 AS DOUBLE) AS VARCHAR)), ',') AS times,
  array_to_string(list_reduce(list_transform(list_sort(s), lambda v: {{'k': v, 'o': CAST([] AS BIGINT[])}}),
    lambda a, v: {{'k': CASE WHEN v.k >= a.k * 20 THEN a.k + 1 ELSE a.k END, 'o': list_append(a.o, CASE WHEN v.k >= a.k * 20 THEN a.k ELSE a.k - 1 END)}}, {{'k': 1, 'o': CAST([] AS BIGINT[])}}).o, ',') AS chunks,
  array_to_string(list_transform(range(1, 65), lambda i: CASE WHEN t[i] = 2 THEN CAST((len(list_filter(t[:i], lambda u: u = 2)) - 1) * 10 AS VARCHAR) ELSE '-' END), ',') AS scattered FROM s"""


def stream_rechunk(spark, sf):
    return sessions.rechunk_samples(table(spark, sf, "events"), "user_id", "event_id", "value", 16).withColumn("total", F.round("total", 4))


RECHUNK_SQL = """
SELECT user_id, CAST(k // 16 AS BIGINT) AS chunk_id, count(*) AS n_samples, round(sum(value), 4) AS total, count(*) < 16 AS tail
FROM (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS k FROM events) GROUP BY user_id, k // 16"""


def session_expiry(spark, sf):
    return sessions.idle_sessions(table(spark, sf, "events"), "user_id", "ts")


EXPIRY_SQL = """
WITH g AS (SELECT user_id, ts, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts)) > 600000000 THEN 1 ELSE 0 END AS f FROM events),
s AS (SELECT user_id, ts, sum(f) OVER (PARTITION BY user_id ORDER BY ts) AS session_number FROM g)
SELECT user_id, CAST(session_number AS BIGINT) AS session_number, min(ts) AS first_seen, max(ts) AS last_seen, count(*) AS n FROM s GROUP BY user_id, session_number"""


def stream_state(spark, sf):
    """The chunks of stream_rechunk, made by the stateful stream: every event is a push of one sample, the last one of a user ends the session."""
    schema = table(spark, sf, "events").schema
    last = table(spark, sf, "events").groupBy("user_id").agg(F.max("event_id").alias("final"))
    events = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    pushes = events.join(last, "user_id").select(F.col("user_id").cast("string").alias("session_id"), F.col("event_id").alias("seq"), F.array("value").alias("samples"), (F.col("event_id") == F.col("final")).alias("last"))
    out = sessions.run_to_end(sessions.rechunk_stream(pushes, 16, idle_seconds=None), Scratch(spark).path("stream"))
    return out.select(F.col("session_id").cast("bigint").alias("user_id"), "chunk_id", "n_samples", F.round("total", 4).alias("total"), "tail")


def pcm_ingest(spark, sf):
    """Events as pushes: type and properties are the body, and sign-ups come as text."""
    mime = F.when(F.col("event_type") == "signup", "text/plain").otherwise(files.PCM_TYPE)
    df = table(spark, sf, "events").select("event_id", mime.alias("mime"), F.encode(F.concat("event_type", "props"), "utf-8").alias("payload"))
    good, bad = files.split_pushes(df, "mime", "payload")
    return good.select(F.lit("accepted").alias("error"), F.octet_length("payload").alias("n")).unionByName(bad.select("error", F.octet_length("payload").alias("n"))).groupBy("error").agg(F.count("*").alias("pushes"), F.sum("n").alias("bytes"))


PCM_SQL = """
WITH p AS (SELECT event_type, octet_length(encode(event_type || props)) AS n FROM events)
SELECT CASE WHEN event_type = 'signup' THEN 'wrong content type' WHEN n % 4 != 0 THEN 'length is not a multiple of 4' ELSE 'accepted' END AS error, count(*) AS pushes, CAST(sum(n) AS BIGINT) AS bytes FROM p GROUP BY 1"""


def corpus_stats(spark, sf):
    out = datasets.corpus_statistics(table(spark, sf, "documents"), "lang", "n_chars")
    return out.withColumn("mean", F.round("mean", 4))


STATS_SQL = "SELECT lang, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS total, round(avg(n_chars), 4) AS mean FROM documents GROUP BY ROLLUP (lang)"


def group_split(spark, sf):
    return table(spark, sf, "documents").groupBy("source", datasets.group_split(F.col("source"), 20).alias("split")).agg(F.count("*").alias("n"))


SPLIT_GROUP_SQL = """
SELECT source, CASE WHEN list_reduce(list_transform(string_split(source, ''), lambda c: CAST(ascii(c) AS BIGINT)), lambda a, c: (a * 31 + c) % 1000003, CAST(7 AS BIGINT)) % 100 < 20 THEN 'validation' ELSE 'train' END AS split, count(*) AS n FROM documents GROUP BY source"""


QUERIES = {
    "feature_length": (feature_length, FEATURE_SQL),
    "chunk_plan": (chunk_plan, CHUNK_SQL),
    "cu_lengths": (cu_lengths, CU_SQL),
    "energy_window": (energy_window, ENERGY_SQL),
    "energy_split": (energy_split, SPLIT_SQL),
    "mono_normalize": (mono_normalize, MONO_SQL),
    "integer_normalize": (integer_normalize, INTEGER_SQL),
    "resample_linear": (resample_linear, RESAMPLE_SQL),
    "resample_sinc": (resample_sinc, SINC_SQL),
    "window_slice": (window_slice, WINDOW_SQL),
    "pooling": (pooling, POOL_SQL),
    "softmax_argmax": (softmax_argmax, SOFTMAX_SQL),
    "binary_metrics": (binary_metrics, METRICS_SQL),
    "position_ids": (position_ids, POSITION_SQL),
    "segment_positions": (segment_positions, SEGMENT_SQL),
    "batch_padding": (batch_padding, PADDING_SQL),
    "label_mask": (label_mask, MASK_SQL),
    "latest_checkpoint": (latest_checkpoint, CHECKPOINT_SQL),
    "timestamp_repair": (timestamp_repair, REPAIR_SQL),
    "token_times": (token_times, TOKEN_SQL),
    "stream_rechunk": (stream_rechunk, RECHUNK_SQL),
    "session_expiry": (session_expiry, EXPIRY_SQL),
    "stream_state": (stream_state, RECHUNK_SQL),
    "pcm_ingest": (pcm_ingest, PCM_SQL),
    "corpus_stats": (corpus_stats, STATS_SQL),
    "group_split": (group_split, SPLIT_GROUP_SQL),
}
