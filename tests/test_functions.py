import math
import random
import re
import time

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from cantata.functions import signal as S
from cantata.functions import text as X


def one(spark, column, **values):
    df = spark.range(1).select(*(F.lit(v).alias(k) if not isinstance(v, list) else F.array(*map(F.lit, v)).alias(k) for k, v in values.items())) if values else spark.range(1)
    return df.select(column.alias("r")).first().r


PARSED = [
    (None, None, "", ""), ("  \n", None, "", ""), ("language English<asr_text>Hello", None, "English", "Hello"), ("language cHINese\n<asr_text> 你好 ", None, "Chinese", "你好"), ("plain text", None, "", "plain text"),
    ("language None<asr_text>", None, "", ""), ("language None<asr_text> hi ", None, "", "hi"), ("LANGUAGE french<asr_text>a<asr_text>b", None, "French", "a<asr_text>b"),
    ("noise\nlanguage english\nlanguage french<asr_text>t", None, "English", "t"), ("junk<asr_text>t", None, "", "t"), ("language Nonesuch<asr_text>t", None, "", "t"),
    ("language German<asr_text>x", "German", "German", "language German<asr_text>x"), ("language Czech<asr_text>" + "ab" * 30, None, "Czech", "ab"),
]


def test_parse_output(spark):
    df = spark.createDataFrame([(i, r, f) for i, (r, f, _, _) in enumerate(PARSED)], "i int, raw string, forced string")
    got = [(r.p.language, r.p.text) for r in df.select("i", X.parse_output(F.col("raw"), F.col("forced")).alias("p")).orderBy("i").collect()]
    assert got == [(a, b) for _, _, a, b in PARSED]


def test_fix_repetitions_against_a_plain_loop(spark):
    def plain(s):
        out, i, n = "", 0, len(s)
        s = re.sub(r"(.)\1{20,}", r"\1", s, flags=re.S)
        n = len(s)
        while i < n:
            for k in range(1, 21):
                if i + 40 <= n and s[i : i + k] * 20 == s[i : i + 20 * k]:
                    r = 20
                    while s[i + r * k : i + r * k + k] == s[i : i + k]:
                        r += 1
                    out += s[i : i + k]
                    i += r * k
                    break
            else:
                out += s[i]
                i += 1
        return out

    rng = random.Random(1)
    texts = ["".join(rng.choice("ab") * rng.choice([1, 1, 19, 20, 21, 22]) for _ in range(8)) for _ in range(100)]
    texts += ["".join(rng.choice(["ab", "abc", "x\n", "é😀"]) * rng.choice([1, 19, 20, 25]) for _ in range(4)) for _ in range(100)]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    assert [r.t for r in df.select("i", X.fix_repetitions(F.col("t")).alias("t")).orderBy("i").collect()] == [plain(t) for t in texts]


def test_strict_forms_raise(spark):
    for column in (X.language_name(F.lit(" "), strict=True), X.require_language(F.lit("Klingon")), X.dtype_name(F.lit("int8"), strict=True), X.json_map(F.lit("[1]"), strict=True), X.turn_label(F.lit("maybe"), strict=True)):
        with pytest.raises(PySparkException):
            spark.range(1).select(column).collect()


def test_small_text(spark):
    assert one(spark, X.language_name(F.lit(" new york "))) == "New york"
    assert one(spark, X.words_spaced(F.lit("don't a-b 甚至abc出现。 —"))) == ["don't", "ab", "甚", "至", "abc", "出", "现"]
    assert one(spark, X.words_mixed(F.lit("a-b 漢字x"))) == ["a", "b", "漢", "字", "x"]
    assert one(spark, X.roll_back(F.array(*map(F.lit, ["a", "b�", "c", "d"])), 1)) == ["a"]
    assert one(spark, X.timestamp_prompt(F.array().cast("array<string>"), "")) == "<timestamp><timestamp>"
    assert one(spark, X.json_map(F.lit(" "))) == {} and one(spark, X.json_map(F.lit("[1]"))) is None
    assert one(spark, X.overlay(X.json_map(F.lit('{"a":"1","b":"2"}')), X.json_map(F.lit('{"b":"3"}')))) == {"a": "1", "b": "3"}
    assert one(spark, X.label_id(F.lit("complete"))) == 1 and one(spark, X.label_id(F.lit("x"))) is None


def test_lengths(spark):
    n = [0, 1, 99, 100, 101, 200]
    df = spark.createDataFrame([(x,) for x in n], "n bigint").orderBy("n")
    assert [r[0] for r in df.select(S.feature_length(F.col("n"))).collect()] == [0, 1, 13, 13, 14, 26]
    assert one(spark, S.frame_chunks(F.lit(450), 200)) == [200, 200, 50] and one(spark, S.frame_chunks(F.lit(400), 200)) == [200, 200] and one(spark, S.frame_chunks(F.lit(0), 200)) == []
    assert one(spark, S.cumulative(S.attention_windows(F.lit(250), 104))) == [0, 104, 208, 250]
    bounds = lambda cut: tuple(one(spark, S.window_bounds(F.lit(16000), 16000, F.lit(cut), F.lit(200), F.lit(100))))
    assert bounds(500) == (4800, 9600) and bounds(5000) == (0, 16000) and bounds(None) == (0, 16000)


def test_signals(spark):
    arr = lambda *x: F.array(*(F.lit(float(v)) for v in x))
    assert one(spark, S.to_mono(F.array(arr(1, 2, 3), arr(3, 2, 1)))) == [2.0, 2.0, 2.0]
    assert one(spark, S.to_mono(F.array(arr(1, 3), arr(2, 2), arr(0, 4)))) == [2.0, 2.0, 2.0]
    assert one(spark, S.normalize_peak(arr(4, -2))) == [1.0, -0.5] and one(spark, S.normalize_peak(arr(0.5, -0.2))) == [0.5, -0.2]
    nan = one(spark, S.normalize_peak(arr(float("nan"), 2, 1)))
    assert math.isnan(nan[0]) and nan[1:] == [1.0, 1.0]
    assert one(spark, S.normalize_peak(F.array().cast("array<double>"))) == []
    x = np.sin(np.arange(64) / 5)
    got = one(spark, S.resample_span(arr(*x), 64, 48))
    assert np.allclose(got, np.interp(np.linspace(0, 1, 48), np.linspace(0, 1, 64), x))
    assert one(spark, S.mask_positions(F.array(*map(F.lit, [0, 1, 1, 0, 1])))) == [1, 0, 1, 1, 2]
    assert one(spark, S.range_chunks(F.array(*map(F.lit, [0, 9, 10, 45, 46, 47])), 10)) == [0, 0, 1, 2, 3, 4]
    assert one(spark, S.scatter(F.array(*map(F.lit, [7, 1, 7])), 7, F.array(*map(F.lit, ["a", "b"])))) == ["a", None, "b"]
    assert one(spark, S.marked_times(F.array(*map(F.lit, [7, 1, 7])), F.array(*map(F.lit, [3, 4, 5])), 7, 80.0)) == [240.0, 400.0]
    assert one(spark, S.argmax(arr(1, 3, 3))) == 1
    assert one(spark, S.pool_last(F.array(arr(1), arr(2), arr(3)), F.array(*map(F.lit, [1, 1, 0])))) == [2.0]


def test_frames_are_clipped_before_the_mean(spark):
    frames = lambda *x: F.array(*(F.array(*(F.lit(float(v)) for v in f)) for f in x))
    assert one(spark, S.normalize_frames(frames((40000, 0), (-32768, 16384)), -32768, 32767)) == [0.5, -0.25]
    assert [round(v, 9) for v in one(spark, S.normalize_frames(frames((4, 0), (-2, 2))))] == [0.5, 0.0]
    assert one(spark, S.normalize_frames(frames((1.0000005, 0)))) == [0.5]
    assert one(spark, S.normalize_frames(F.array().cast("array<array<double>>"))) == []


def test_segments(spark):
    at = lambda *x: F.array(*map(F.lit, x)).cast("array<bigint>")
    got = one(spark, S.segment_positions(at(7, 2), at(3, 4), F.lit(12)))
    assert [tuple(r) for r in got] == [("text", 0, 2), ("sound", 2, 4), ("text", 6, 1), ("sound", 7, 3), ("text", 10, 2)]
    assert [tuple(r) for r in one(spark, S.segment_positions(at(), at(), F.lit(3)))] == [("text", 0, 3)]
    for offsets, lengths, total in (((2, 4), (3, 1), 9), ((2,), (5,), 6)):
        with pytest.raises(Exception, match="positions don't match"):
            one(spark, S.segment_positions(at(*offsets), at(*lengths), F.lit(total)))


def test_loops_are_looked_for_where_they_may_be(spark):
    """may_loop() is true wherever the collapse changes a text."""
    rng = random.Random(5)
    texts = []
    for _ in range(400):
        unit = "".join(rng.choice("abé") for _ in range(rng.randint(1, 20)))
        texts.append("".join(rng.choice("xyz") for _ in range(rng.randint(0, 25))) + unit * rng.randint(18, 23) + "".join(rng.choice("xyz") for _ in range(rng.randint(0, 45))))
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    rows = df.select(X.may_loop(F.col("t")).alias("m"), (X.collapse_patterns(F.col("t")) != F.col("t")).alias("c")).collect()
    assert all(r.m for r in rows if r.c) and any(r.c for r in rows)
    assert not any(r.m for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select(X.may_loop(F.col("text")).alias("m")).limit(20).collect())


def test_registered_functions(spark):
    X.register_functions(spark)
    raws = [None, " ", "language English<asr_text>Hello", "language cHINese\n<asr_text> x ", "plain text", "language None<asr_text> hi ", "LANGUAGE french<asr_text>a<asr_text>b", "noise\nlanguage english\nlanguage french<asr_text>t", "junk<asr_text>t", "language <asr_text>q", "z" * 30 + "<asr_text>" + "ab" * 40]
    df = spark.createDataFrame([(r, f) for r in raws for f in (None, "", "German")], "raw string, forced string")
    df.createOrReplaceTempView("raw_outputs")
    got = spark.sql("SELECT raw, forced, parse_asr_output(raw, forced) AS p, parse_asr_output(raw) AS q FROM raw_outputs").collect()
    want = df.select("raw", "forced", X.parse_output(F.col("raw"), F.col("forced")).alias("p"), X.parse_output(F.col("raw")).alias("q")).collect()
    assert got == want


def test_scans_against_plain_loops(spark):
    rng = random.Random(7)
    rows = [(i, [rng.randrange(2) for _ in range(n)], sorted(rng.randrange(200) for _ in range(n))) for i, n in enumerate([0, 1, 2, 3, 7, 8, 9, 40])]
    df = spark.createDataFrame(rows, "i int, m array<int>, v array<bigint>")
    out = df.select("i", S.cumulative(F.col("v")).alias("c"), S.mask_positions(F.col("m")).alias("p"), S.range_chunks(F.col("v"), 10).alias("k"), S.scatter(F.col("m"), 1, F.col("v")).alias("s"))
    for r in out.orderBy("i").collect():
        _, m, v = rows[r.i]
        assert r.c == [sum(v[:k]) for k in range(len(v) + 1)]
        assert r.p == [sum(m[: k + 1]) - 1 if m[k] else 1 for k in range(len(m))]
        at, chunks = 1, []
        for x in v:
            at += x >= at * 10
            chunks.append(at - 1)
        assert r.k == chunks
        assert r.s == [v[sum(m[:k])] if m[k] else None for k in range(len(m))]


def test_long_signals_take_linear_time(spark):
    """Twenty seconds of samples in a row, and a hundred rows of short ones: a bound array is computed once, not for each element."""
    n, began = 320_000, time.monotonic()
    x = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.sin(i.cast("double")) * 3)
    frames = F.transform(F.sequence(F.lit(0), F.lit(n // 2 - 1)), lambda i: F.array(i % 7 - 3.0, i % 5 - 2.0))
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda a, v: a + v)
    mask = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: i % 2)
    row = spark.range(1).select(
        total(S.normalize_peak(x)).alias("a"), total(S.normalize_frames(frames)).alias("b"), total(S.to_mono(frames)).alias("c"), F.size(S.resample_step(x, 48_000, 16_000)).alias("d"), F.size(S.resample_span(x, 48_000, 16_000)).alias("e"),
        F.element_at(S.cumulative(mask), -1).alias("f"), F.array_max(S.mask_positions(mask)).alias("g"),
    ).first()
    k = np.arange(n // 2)
    assert abs(row.b - np.sum((k % 7 - 3.0) / 3 + (k % 5 - 2.0) / 3) / 2) < 1e-6 and abs(row.c - np.sum(k % 7 - 3.0 + k % 5 - 2.0) / 2) < 1e-6
    assert (row.d, row.e, row.f, row.g) == (106_667, 106_667, n // 2, n // 2 - 1)
    assert time.monotonic() - began < 60
