import base64
import io
import random
import wave

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cantata.model import TRANSCRIPT_ROW, TURN_LABELS
from cantata.operators import align, chunking, datasets
from cantata.plans import pipeline
from cantata.sources import files, routing
from cantata.streaming import sessions

REPAIRS = [([1, 2, 3], [1, 2, 3]), ([5, 1, 2, 3], [1, 1, 2, 3]), ([1, 9, 2, 3], [1, 1, 2, 3]), ([1, 8, 9, 2, 3, 4], [1, 1, 2, 2, 3, 4]), ([0, 90, 91, 92, 40, 50, 60, 70], [0, 10, 20, 30, 40, 50, 60, 70]), ([10, 5], [10, 10]), ([], [])]


def slow_places(t):
    """The same subsequence by the quadratic rule: strict improvement, so the first predecessor and the first end win."""
    best, back = [1] * len(t), [-1] * len(t)
    for i in range(len(t)):
        for j in range(i):
            if t[j] <= t[i] and best[j] + 1 > best[i]:
                best[i], back[i] = best[j] + 1, j
    at, out = (best.index(max(best)) if t else -1), []
    while at >= 0:
        out.append(at)
        at = back[at]
    return out[::-1]


def test_repair():
    for times, want in REPAIRS:
        assert align.repair(times) == want
    rng = random.Random(1)
    for _ in range(2000):
        t = [rng.randrange(30) for _ in range(rng.randrange(15))]
        assert align.rising_places(t) == slow_places(t)
        assert align.repair(t) == sorted(align.repair(t))


def test_repair_rows(spark):
    df = spark.createDataFrame([(1, [1, 9, 2, 3]), (2, None)], "i int, t array<bigint>")
    assert [r.y for r in align.repair_times(df, "t", "y").orderBy("i").collect()] == [[1, 1, 2, 3], None]


def test_quiet_cuts():
    x = np.ones(25, np.float32)
    x[9] = 0
    assert chunking.quiet_cuts(x, 10, 1.0, 0.3, 400) == [9, 16, 25]
    assert chunking.quiet_cuts(x[:10], 10, 1.0, 0.3, 400) == [10]
    rng = np.random.default_rng(1)
    for _ in range(50):
        n = int(rng.integers(1, 400))
        ends = chunking.quiet_cuts(rng.normal(size=n).astype(np.float32), 16, 1.0, 0.25, 250)
        assert ends[-1] == n and all(a < b for a, b in zip([0, *ends], ends)) and max(np.diff([0, *ends])) <= 20


def test_split_rows(spark):
    df = spark.createDataFrame([(1, [1.0] * 25), (2, None), (3, [])], "audio_id int, s array<float>")
    out = chunking.split_quiet(df, "s", 10, 1.0, 0.3, 400).orderBy("audio_id", "chunk_index").collect()
    assert [(r.audio_id, r.n_samples, len(r.chunk)) for r in out if r.audio_id > 1] == [(2, 0, 0), (3, 0, 0)]
    assert sum(r.n_samples for r in out if r.audio_id == 1) == 25


def test_batches_and_requests(spark):
    df = chunking.with_positions(spark.range(5).withColumnRenamed("id", "orig_index"), "orig_index")
    assert [r.b for r in df.select("orig_index", chunking.batch_number(F.col("position"), 2).alias("b")).orderBy("orig_index").collect()] == [0, 0, 1, 1, 2]
    with pytest.raises(ValueError):
        chunking.batch_number(F.col("position"), 0, zero_is_error=True)
    with pytest.raises(ValueError):
        chunking.broadcast_request(df, ["a", "b"], [None], 5)
    out = chunking.broadcast_request(df, ["c"], ["A", None, "B", "C", "D"], 5).orderBy("orig_index").collect()
    assert [(r.context, r.language) for r in out][:3] == [("c", "A"), ("c", None), ("c", "B")]


def test_merges_do_not_depend_on_partitions(spark):
    rows = [(g, i, l, t) for g, ls in enumerate([["Chinese", "English", "English"], ["A", "", "A"], ["A", "B", "A"], ["", None]]) for i, (l, t) in enumerate((l, f"t{k}") for k, l in enumerate(ls))]
    random.Random(2).shuffle(rows)
    for parts in (1, 3, 7):
        df = spark.createDataFrame(rows, "g int, i int, l string, t string").repartition(parts)
        got = df.groupBy("g").agg(align.merged_languages(F.col("l"), F.col("i")).alias("l"), align.merged_text(F.col("t"), F.col("i")).alias("t")).orderBy("g").collect()
        assert [r.l for r in got] == ["Chinese,English", "A", "A,B,A", ""] and got[0].t == "t0t1t2"
        assert [r.languages for r in align.merge_languages_rows(df, "g", "i", "l").orderBy("g").collect()] == [r.l for r in got]


@pytest.mark.parametrize("pairs,want", [([(1, 1), (1, 0), (0, 1), (0, 0)], (0.5, 0.5, 0.5, 0.5)), ([(0, 1), (0, 0)], (0.5, 0, 0, 0)), ([], (0, 0, 0, 0))])
def test_metrics(spark, pairs, want):
    assert tuple(datasets.binary_metrics(spark.createDataFrame(pairs, "p int, t int"), "p", "t").first()) == want


def test_routing(spark):
    inputs = [("https://h/x", "url"), ("data:audio/wav;base64,AAAA", "base64"), ("A" * 257, "base64"), ("A" * 256, "path"), ("/" * 300, "path"), ("http:///x", "path"), ("ftp://h", "path"), (None, "path")]
    df = spark.createDataFrame([(i, s) for i, (s, _) in enumerate(inputs)], "i int, s string")
    assert [r.k for r in df.select("i", routing.route(F.col("s")).alias("k")).orderBy("i").collect()] == [k for _, k in inputs]
    row = spark.range(1).select(routing.base64_bytes(F.lit(" data:x;base64,aGk= ")).alias("a"), routing.base64_bytes(F.lit("***")).alias("b"), routing.data_url("a/b", F.lit(b"x" * 100)).alias("c")).first()
    assert bytes(row.a) == b"hi" and row.b is None and "\n" not in row.c


def test_files(spark, tmp_path):
    (tmp_path / "train.jsonl").write_text('{"audio":"a","text":"b"}\n{"audio":"c","text":"d","prompt":"p"}\n')
    rows = files.read_rows(spark, TRANSCRIPT_ROW, str(tmp_path / "train.jsonl"), str(tmp_path / "train.jsonl"))
    assert sorted(r.split for r in rows.collect()) == ["train"] * 2 + ["validation"] * 2
    (tmp_path / "words.txt").write_text("b 3 N\n\n a 1\nb 9\n", encoding="utf-8")
    assert sorted(r.word for r in files.read_lexicon(spark, str(tmp_path / "words.txt")).collect()) == ["a", "b"]
    with wave.open(str(tmp_path / "x.wav"), "wb") as w:
        w.setnchannels(2), w.setsampwidth(2), w.setframerate(8000)
        w.writeframes(np.array([[16384, 0], [-16384, 0]], "<i2").tobytes())
    (tmp_path / "y.wav").write_bytes(b"no wave")
    got = {r.path[-5:]: (r.sr, r.samples) for r in files.decode_wave(files.read_audio(spark, f"{tmp_path}/*.wav"), "content").collect()}
    assert got == {"x.wav": (8000, [0.25, -0.25]), "y.wav": (None, None)}
    files.save_config(spark, {"b": 1}, str(tmp_path / "c"))
    assert files.load_config(spark, str(tmp_path / "c")) == {"b": 1} and files.copy_sidecars(spark, str(tmp_path / "c"), str(tmp_path / "d")) == ["config.json"]
    assert files.load_config(spark, str(tmp_path / "d")) == {"b": 1}


def wave_bytes(rate, width, frames):
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(len(frames[0])), w.setsampwidth(width), w.setframerate(rate)
        w.writeframes(b"".join((x + 128 if width == 1 else x).to_bytes(width, "little", signed=width > 1) for f in frames for x in f))
    return out.getvalue()


def test_waves_of_all_widths():
    for width in (1, 2, 3, 4):
        half = 1 << (8 * width - 2)
        rate, x = files.wave_samples(wave_bytes(8000, width, [(half, 0), (-half, -half)]))
        assert rate == 8000 and x.tolist() == [0.25, -0.5]
    assert files.wave_samples(b"RIFF") == (None, None) and files.wave_samples(None) == (None, None)


def test_load_audio_of_mixed_inputs(spark, tmp_path):
    mono, fast = wave_bytes(16000, 2, [(16384,), (-8192,)]), wave_bytes(8000, 2, [(16384,), (-8192,)])
    (tmp_path / "a.wav").write_bytes(mono)
    rows = [(0, f"{tmp_path}/a.wav"), (1, "data:audio/wav;base64," + base64.b64encode(mono).decode()), (2, "https://h/x"), (3, "https://h/none"), (4, "missing.wav"), (5, "data:audio/wav;base64," + base64.b64encode(fast).decode()), (6, "data:audio/wav;base64,AAAA"), (7, None)]
    df = spark.createDataFrame(rows, "id int, audio string")
    fetch = lambda urls: [mono if u.endswith("/x") else None for u in urls]
    resample = lambda x, rate, target: x.repeat(target // rate)
    out = {r.id: r for r in files.load_audio(df, "audio", ("id",), files.read_audio(spark, str(tmp_path)), fetch, resampler=resample).collect()}
    assert [out[i].kind for i in range(8)] == ["path", "base64", "url", "url", "path", "base64", "base64", "path"]
    assert all(out[i].samples == [0.5, -0.25] for i in (0, 1, 2)) and out[5].samples == [0.5, 0.5, -0.25, -0.25]
    assert [out[i].error for i in (3, 4, 6, 7)] == ["not fetched", "no such audio", "not decoded", "no such audio"] and all(out[i].samples is None for i in (3, 4, 6, 7))
    own = {r.id: r.samples for r in files.load_audio(df, "audio", ("id",)).collect()}
    assert len(own[5]) == 4 and abs(own[5][0] - 0.5) < 0.1
    bare = {r.id: r.error for r in files.load_audio(df, "audio", ("id",), resampler=None).collect()}
    assert bare[2] == "URLs need a fetcher" and bare[5] == "a rate of 8000 needs a resampler"


def test_result_sink_and_cards(spark, tmp_path):
    df = spark.createDataFrame([("a", "English", 'x "y"'), ("b", None, None)], "id string, language string, text string")
    df.coalesce(1).write.parquet(f"{tmp_path}/in")
    files.sink_results(spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in"), f"{tmp_path}/out", f"{tmp_path}/state", availableNow=True).awaitTermination()
    assert sorted(r.value for r in spark.read.text(f"{tmp_path}/out").collect()) == sorted(['{"language":"English","text":"x \\"y\\""}', '{"language":"","text":""}'])
    items = F.array(*(F.struct(F.lit(t).alias("text"), F.lit(a).cast("double").alias("start_time"), F.lit(b).cast("double").alias("end_time")) for t, a, b in (("<b>&", 0.0, 0.2), ("none", None, 1.0), ("empty", 0.3, 0.3), ("late", 9.0, 9.5))))
    cards = spark.range(1).select(files.timestamp_cards(items, F.array(*map(F.lit, range(10))), 10, lambda x: F.array_join(x, "-"))).first()[0]
    assert cards == '<div class="word"><b>&lt;b&gt;&amp;</b><audio controls src="0-1"></audio></div>'


def test_positions_over_many_partitions(spark):
    """Borders of range partitions are sampled; without adaptive joins of partitions, too, each position comes once."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    try:
        df = chunking.with_positions(spark.range(0, 300_000, 1, 16).select(F.pmod(F.xxhash64("id"), F.lit(1_000_003)).alias("k"), "id"), "k")
        r = df.agg(F.count_distinct("position").alias("n"), F.min("position").alias("a"), F.max("position").alias("b")).first()
        assert (r.n, r.a, r.b) == (300_000, 0, 299_999)
        ordered = df.orderBy("position").select("k").collect()
        assert all(a.k <= b.k for a, b in zip(ordered, ordered[1:]))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_padding(spark):
    df = spark.createDataFrame([(1, 0, [1.0, 2.0, 3.0]), (2, 0, [4.0]), (3, 1, None), (4, None, [5.0])], "id int, b int, x array<float>")
    got = {r.id: (r.x, r["mask"]) for r in chunking.pad_batches(df, "b", "x").collect()}
    assert got == {1: ([1, 2, 3], [1, 1, 1]), 2: ([4, 0, 0], [1, 0, 0]), 3: ([], []), 4: ([5], [1])}


def heard(audio, prompt):
    """A model that says how much it heard, and what it was shown."""
    return f" w{len(audio)}" if prompt else f"language English<asr_text>w{len(audio)}"


def test_recognizing_sessions(spark, tmp_path):
    settings = sessions.StreamSettings(chunk_seconds=4 / 16000, unfixed_chunks=2, unfixed_tokens=1)
    one = [("s", "start", None), ("s", "push", [0.0] * 3), ("s", "push", [0.0] * 15), ("s", "push", None), ("s", "end", None), ("s", "push", [0.0]), ("t", "push", [1.0] * 9), ("u", "start", None), ("u", "end", None)]
    rows = [(k, i, a, x) for i, (k, a, x) in enumerate(one)]
    spark.createDataFrame(rows, sessions.EVENTS).coalesce(1).write.parquet(f"{tmp_path}/in")
    out = sessions.run_to_end(sessions.recognize_stream(spark.readStream.schema(sessions.EVENTS).parquet(f"{tmp_path}/in"), heard, settings, idle_seconds=None), f"{tmp_path}/out").collect()
    raw, want = "", []
    for number, n in enumerate((4, 8, 12, 16, 18)):
        words = sessions.pieces(raw)
        kept = "" if number < 2 else "".join(words[: max(1 if n == 18 else 0, len(words) - 1)])
        raw = kept + heard([0] * n, kept)
        language, text = raw.removeprefix("language ").split("<asr_text>") if "<asr_text>" in raw else ("", raw.strip())
        want.append((number, n, language, text, n == 18))
    assert sorted((r.chunk_id, r.n_samples, r.language, r.text, r.final) for r in out if r.session_id == "s" and r.error is None) == want
    assert [(r.session_id, r.error) for r in sorted(out, key=str) if r.error] == [("s", "unknown session"), ("t", "unknown session")]
    assert [(r.chunk_id, r.text, r.final) for r in out if r.session_id == "u"] == [(None, "", True)]


def test_client_pushes(spark):
    settings = sessions.StreamSettings(chunk_seconds=4 / 16000)
    df = spark.createDataFrame([("a", 1, [float(i) for i in range(6, 12)]), ("a", 0, [float(i) for i in range(6)]), ("b", 0, [])], "k string, o int, x array<double>")
    got = sorted((r.k, r.seq, len(r.samples)) for r in sessions.client_pushes(df, "k", "o", "x", 32000, settings).collect())
    assert got == [("a", 0, 4), ("a", 1, 2)]
    assert sorted(sum((r.samples for r in sessions.client_pushes(df, "k", "o", "x", 32000, settings).orderBy("seq").collect()), [])) == [0.0, 2.0, 4.0, 6.0, 8.0, 10.0]


def test_backends_by_name(spark):
    pipeline.register_backend("counting", lambda f: [f"language English<asr_text>n {len(c)}" for c in f["chunk"]])
    df = spark.createDataFrame([(0, [0.1] * 10, "", None)], "orig_index bigint, samples array<float>, context string, language string")
    assert pipeline.transcribe(df, "counting").first().text == "n 10"
    with pytest.raises(ValueError):
        pipeline.transcribe(df, "none")


def test_rechunking_does_not_depend_on_the_pushes(spark, tmp_path):
    samples = [float(i) for i in range(17)]
    outs = []
    for k, sizes in enumerate([[17], [3, 5, 2, 7], [1] * 17]):
        rows, at = [], 0
        for seq, n in enumerate(sizes):
            rows.append(("s", seq, samples[at : at + n], at + n == 17))
            at += n
        spark.createDataFrame(rows, "session_id string, seq bigint, samples array<double>, last boolean").coalesce(1).write.parquet(f"{tmp_path}/in{k}")
        stream = spark.readStream.schema("session_id string, seq bigint, samples array<double>, last boolean").parquet(f"{tmp_path}/in{k}")
        out = sessions.run_to_end(sessions.rechunk_stream(stream, 4, idle_seconds=None), f"{tmp_path}/out{k}")
        outs.append(sorted(map(tuple, out.collect())))
    assert outs[0] == outs[1] == outs[2] and len(outs[0]) == 5 and outs[0][-1] == ("s", 4, 1, 16.0, True)


def test_idle_limit_is_strict(spark):
    df = spark.sql("SELECT 1 AS k, timestamp'2024-01-01 00:00:00' AS ts UNION ALL SELECT 1, timestamp'2024-01-01 00:10:00' UNION ALL SELECT 1, timestamp'2024-01-01 00:20:00.000001'")
    assert sorted(r.n for r in sessions.idle_sessions(df, "k", "ts").collect()) == [1, 2]


def test_stream_settings():
    s = sessions.StreamSettings(language="gERMAN", chunk_seconds=0.00001)
    assert s.language == "German" and s.chunk == 1
    assert s.prefix_words(0, list("abcdefgh")) == [] and s.prefix_words(2, list("abcdefgh")) == ["a", "b", "c"] and s.prefix_words(2, ["a"]) == [] and s.prefix_words(2, ["a"], finishing=True) == ["a"]
    for bad in ({"language": "Klingon"}, {"chunk_seconds": 0}):
        with pytest.raises(ValueError):
            sessions.StreamSettings(**bad)


def test_transcribe_with_injected_models(spark):
    df = spark.createDataFrame([(0, [0.1] * 10, "", None), (1, [0.2] * 20, "ctx", "German"), (2, [], None, "")], "orig_index bigint, samples array<float>, context string, language string")

    def model(frame: pd.DataFrame) -> list:
        return [f"language English<asr_text>n {len(c)}" if not p.endswith("<asr_text>") else "wort" for c, p in zip(frame["chunk"], frame["prompt"])]

    def aligner(frame: pd.DataFrame) -> list:
        return [[t for i in range(len(w)) for t in (i * 100, i * 100 + 50)] for w in frame["words"]]

    out = pipeline.transcribe(df, model, aligner, with_times=True).orderBy("orig_index").collect()
    assert [(r.language, r.text) for r in out] == [("English", "n 10"), ("German", "wort"), ("English", "n 0")]
    assert [(x.text, x.start_time, x.end_time) for x in out[0].time_stamps] == [("n", 0.0, 0.05), ("10", 0.1, 0.15)]
    with pytest.raises(ValueError):
        pipeline.transcribe(df, model, with_times=True)
    with pytest.raises(ValueError):
        pipeline.backend("none")
    turns = pipeline.predict_turns(df.select("orig_index", "samples"), lambda f: [[0.0, float(len(x))] for x in f["samples"]], ["samples"]).orderBy("orig_index").collect()
    assert [r.prediction.label for r in turns] == [TURN_LABELS[1], TURN_LABELS[1], TURN_LABELS[0]]
