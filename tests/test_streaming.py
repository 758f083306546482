"""Streams that restart, replay, and go idle."""

import datetime as dt
import struct
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from cantata.sources import files
from cantata.streaming import sessions

SETTINGS = sessions.StreamSettings(chunk_seconds=4 / 16000, unfixed_chunks=2, unfixed_tokens=1)


class Value:
    def __init__(self, log):
        self.value, self.log = None, log

    def exists(self):
        return self.value is not None

    def get(self):
        return self.value

    def update(self, value):
        self.value = value
        self.log.append(sum(len(x) if isinstance(x, (str, list)) else 1 for x in value))

    def clear(self):
        self.value = None


class Parts(Value):
    """List and map state that logs how much each call writes."""

    def __init__(self, log):
        super().__init__(log)
        self.value = {}

    def get(self):
        return iter(self.value.values())

    def appendValue(self, value):
        self.updateValue((len(self.value),), value)

    def updateValue(self, key, value):
        self.value[key] = value
        self.log.append(len(value[0]))

    def iterator(self):
        return iter(self.value.items())

    def clear(self):
        self.value = {}


class Handle:
    """A state store and a clock that a test steers."""

    def __init__(self):
        self.log, self.timers, self.now = [], [], 0
        self.getValueState = lambda name, schema: Value(self.log)
        self.getListState = self.getMapState = lambda name, *schema: Parts(self.log)

    def listTimers(self):
        return list(self.timers)

    def deleteTimer(self, t):
        self.timers.remove(t)

    def registerTimer(self, t):
        self.timers.append(t)

    def getCurrentProcessingTimeInMs(self):
        return self.now


def push(processor, handle, seq, samples, action="push", now=0):
    handle.now = now
    frame = pd.DataFrame({"seq": [seq], "samples": [samples], "last": [False], "action": [action]})
    return pd.concat(processor.handleInputRows(("s",), iter([frame]), handle))


def made(kind):
    handle = Handle()
    processor = sessions.Rechunker(64) if kind == "chunks" else sessions.Recognizer(lambda audio, prompt: f"w{len(audio)}", sessions.StreamSettings(chunk_seconds=64 / 16000))
    processor.init(handle)
    if kind != "chunks":
        push(processor, handle, -1, None, "start")
    return processor, handle


def test_a_push_writes_no_more_than_itself():
    """Samples written per push don't grow with the session; here a push is 10 samples and a chunk 64."""
    for kind, most in (("chunks", 10 + 2), ("model", 64 + 10 + 3 + 500 // 1)):
        processor, handle = made(kind)
        written = []
        for seq in range(400):
            handle.log.clear()
            push(processor, handle, seq, [float(seq)] * 10)
            written.append(sum(x for x in handle.log))
        assert max(written) <= most and sum(written[300:]) <= sum(written[:100]) * 2


def test_idle_timer_under_a_steered_clock():
    for kind in ("chunks", "model"):
        processor, handle = made(kind)
        push(processor, handle, 0, [1.0] * 5, now=1_000)
        push(processor, handle, 1, [1.0] * 5, now=601_000)  # exactly 600 s later the session lives, and the timer starts anew
        assert handle.timers == [601_000 + 600_000 + 1]
        handle.now = 1_201_001
        out = pd.concat(processor.handleExpiredTimer(("s",), handle, None))
        assert out["n_samples"].tolist() == [10]
        late = push(processor, handle, 2, [1.0], now=1_300_000)
        if kind == "model":
            assert late["error"].tolist() == ["unknown session"] and handle.timers == [1_201_001][:0]


PUSH = "session_id string, seq bigint, samples array<double>, last boolean, at timestamp"


def at(seconds):
    return dt.datetime(2024, 1, 1) + dt.timedelta(seconds=seconds)


def idle_run(spark, folder, times):
    """Session a pushes once, session b at each of the times, a batch each; what is flushed."""
    rows = [("a", 0, [1.0, 2.0, 3.0], False, at(0))] + [("b", i, [], False, at(t)) for i, t in enumerate(times)]
    for i, r in enumerate(rows):
        spark.createDataFrame([r], PUSH).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    stream = spark.readStream.schema(PUSH).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in").withWatermark("at", "0 seconds")
    return [tuple(r) for r in sessions.run_to_end(sessions.rechunk_stream(stream, 64, event_time="at"), f"{folder}/out").collect()]


def test_idle_sessions_in_a_stream(spark, tmp_path):
    """The watermark is the clock: at exactly 600 s the session lives, later it is flushed."""
    assert idle_run(spark, tmp_path / "exact", [300.0, 600.0]) == []
    assert idle_run(spark, tmp_path / "later", [300.0, 600.002]) == [("a", 0, 3, 6.0, True)]


def heard(audio, prompt):
    return f" w{len(audio)}:{int(audio.sum())}" if prompt else f"language English<asr_text>w{len(audio)}:{int(audio.sum())}"


def results(spark, events, folder, saved=None):
    spark.createDataFrame(events, sessions.EVENTS).coalesce(1).write.parquet(f"{folder}/in")
    stream = spark.readStream.schema(sessions.EVENTS).parquet(f"{folder}/in")
    out = sessions.run_to_end(sessions.recognize_stream(stream, heard, SETTINGS, idle_seconds=None, saved=saved), f"{folder}/out")
    return sorted((tuple(r) for r in out.collect()), key=str)


def test_a_stream_resumed_from_saved_sessions(spark, tmp_path):
    events = [(s, i, "start" if i == 0 else "end" if i == 9 else "push", None if i in (0, 9) else [float(i)] * (i * k % 7)) for k, s in enumerate(["s", "t", "u", "v"], 1) for i in range(10)] + [("w", 7, "push", [1.0]), ("early", 0, "start", None), ("early", 1, "end", None)]
    whole = results(spark, events, tmp_path / "whole")
    first = results(spark, [e for e in events if e[1] < 6], tmp_path / "first")
    saved = sessions.saved_sessions(spark, f"{tmp_path}/first/out/state")
    assert saved.schema.simpleString() == spark.createDataFrame([], sessions.SAVED).schema.simpleString()
    saved.write.parquet(f"{tmp_path}/saved")
    kept = spark.read.parquet(f"{tmp_path}/saved")
    assert sorted(r.session_id for r in kept.collect()) == ["s", "t", "u", "v"]
    second = results(spark, [e for e in events if e[1] >= 6], tmp_path / "second", kept)
    assert sorted(first + second, key=str) == whole and len(first) > 3 and len(second) > 8
    without = results(spark, [e for e in events if e[1] >= 6], tmp_path / "without")
    assert without != second


def test_a_replayed_batch_leaves_no_second_row(spark, tmp_path):
    df = spark.createDataFrame([("a", "English", "x"), ("b", None, None)], "id string, language string, text string")
    df.coalesce(1).write.parquet(f"{tmp_path}/in")
    for state in ("state", "state-lost"):  # without its checkpoint the stream runs the same batch again
        files.sink_results(spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in"), f"{tmp_path}/out", f"{tmp_path}/{state}", availableNow=True).awaitTermination()
    assert spark.read.text(f"{tmp_path}/out").count() == 2
    stream = lambda: spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in")
    assert sessions.run_to_end(stream(), f"{tmp_path}/run").count() == 2
    assert sessions.run_to_end(stream(), f"{tmp_path}/run").count() == 2
    commits = Path(tmp_path / "run/state/commits")
    for f in commits.iterdir():  # the batch was written, but its commit was lost
        f.unlink()
    assert sessions.run_to_end(stream(), f"{tmp_path}/run").count() == 2


def test_pushes_as_files(spark, tmp_path):
    body = lambda *x: struct.pack(f"<{len(x)}f", *x)
    def put(name, content):
        path = tmp_path / "pushes" / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(content)

    put("s%201/0.start", b"1")
    put("s%201/1.pcm", body(1.0, 2.0, 3.0, 4.0, 5.0))
    put("s%201/2.pcm", b"abc")
    put("s%201/notes.txt", b"left out")

    def run():
        stream = files.push_stream(spark, f"{tmp_path}/pushes")
        good = stream.where("error is null").select("session_id", "seq", "action", "samples")
        return sessions.run_to_end(sessions.recognize_stream(good, heard, SETTINGS, idle_seconds=None), f"{tmp_path}/out").collect()

    assert [(r.session_id, r.n_samples, r.text) for r in run()] == [("s 1", 4, "w4:10")]
    put("s%201/3.end", b"1")
    assert sorted((r.session_id, r.n_samples, r.text, r.final) for r in run()) == [("s 1", 4, "w4:10", False), ("s 1", 5, "w5:15", True)]
    refused = files.push_files(spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(f"{tmp_path}/pushes")).where("error is not null").collect()
    assert [(r.seq, r.samples, r.error) for r in refused] == [(2, None, "length is not a multiple of 4")]


def test_only_named_files_are_joined(spark, tmp_path):
    import io
    import wave

    for name, value in (("a", 1000), ("b", 2000), ("unnamed", 3000)):
        out = io.BytesIO()
        with wave.open(out, "wb") as w:
            w.setnchannels(1), w.setsampwidth(2), w.setframerate(16000)
            w.writeframes(np.full(5, value, "<i2").tobytes())
        (tmp_path / f"{name}.wav").write_bytes(out.getvalue())
    audio = files.read_audio(spark, f"{tmp_path}/*.wav")
    twice = audio.unionByName(audio.withColumn("path", F.regexp_replace("path", "^file:", "zfile:")).withColumn("content", F.lit(b"other")))
    df = spark.createDataFrame([(1, f"{tmp_path}/a.wav"), (2, f"file:{tmp_path}/b.wav"), (3, f"{tmp_path}/missing.wav"), (4, "https://h/x"), (5, f"{tmp_path}/a.wav")], "id int, s string")
    got = {r.id: (r.error, r.samples and round(r.samples[0] * 32768)) for r in files.load_audio(df, "s", ("id",), twice).collect()}
    assert got == {1: (None, 1000), 2: (None, 2000), 3: ("no such audio", None), 4: ("URLs need a fetcher", None), 5: (None, 1000)}
