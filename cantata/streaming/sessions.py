"""Sessions of pushed samples: cut into chunks of equal length while they arrive, flushed at their end or after a pause.

The stream's rows are (session_id, seq, samples, last), or EVENTS where a model recognizes each chunk. State lives per session in Spark's state store, so pushes to one session
never race and a restart goes on from the checkpoint. The batch forms give the same chunks from tables.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from cantata.functions.signal import resample_step
from cantata.functions.text import parse_output
from cantata.model import LANGUAGE_PREFIX, LANGUAGES, SAMPLE_RATE, TEXT_TAG
from cantata.operators.align import in_order

IDLE_SECONDS = 600
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
CHUNKS = "session_id string, chunk_id bigint, n_samples bigint, total double, tail boolean"


@dataclass(frozen=True)
class StreamSettings:
    """Settings of a session, checked when made."""

    language: str | None = None
    chunk_seconds: float = 2.0
    unfixed_chunks: int = 2
    unfixed_tokens: int = 5
    rate: int = SAMPLE_RATE

    def __post_init__(self):
        name = (self.language or "").strip()
        if name:
            name = name[:1].upper() + name[1:].lower()
            if name not in LANGUAGES:
                raise ValueError(f"unsupported language: {self.language}")
        object.__setattr__(self, "language", name or None)
        if self.chunk_seconds <= 0:
            raise ValueError("chunk_seconds must be above 0")

    @property
    def chunk(self) -> int:
        return max(1, round(self.chunk_seconds * self.rate))

    def prefix_words(self, chunk_id: int, words: list[str], finishing: bool = False) -> list[str]:
        """Words of the last result that the next one keeps: none at first, then all but the last few."""
        if chunk_id < self.unfixed_chunks:
            return []
        kept = len(words) - self.unfixed_tokens
        if finishing:
            return words[: max(1, kept)]
        kept = max(0, kept)
        bad = next((i for i, w in enumerate(words) if "�" in w), kept)
        return words[: min(kept, bad)]


class _Idle:
    """The idle timer of a session: one timer, set anew with each push. In processing time it counts from the batch's time, in event time from the last push's."""

    def _arm(self, timerValues, times, alive: bool) -> None:
        if self.idle_ms is None:
            return
        for t in self.handle.listTimers():
            self.handle.deleteTimer(t[0] if isinstance(t, tuple) else t)
        if alive:
            now = timerValues.getCurrentProcessingTimeInMs() if times is None else max(int(pd.Timestamp(t).timestamp() * 1000) for t in times)
            self.handle.registerTimer(now + self.idle_ms + 1)

    def _times(self, rows: pd.DataFrame):
        return None if self.event_time is None else rows[self.event_time]

    def close(self) -> None:
        pass


class Rechunker(_Idle, StatefulProcessor):
    """Emits a row for each full chunk, and for the rest when a session ends or has been idle for more than IDLE_SECONDS. Waiting samples are list state: a push
    appends itself, and what remains of it when chunks are full is shorter than it; nothing that was written before is written again."""

    def __init__(self, chunk: int, idle_seconds: int | None = IDLE_SECONDS, event_time: str | None = None):
        self.chunk, self.idle_ms, self.event_time = chunk, None if idle_seconds is None else idle_seconds * 1000, event_time

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("session", "chunk_id bigint, waiting bigint")
        self.parts = handle.getListState("parts", "part array<double>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        number, waiting = self.state.get() if self.state.exists() else (0, 0)
        pushes = pd.concat(list(rows)).sort_values("seq", kind="stable")
        out, new, ended = [], [], False
        for samples, last in zip(pushes["samples"], pushes["last"]):
            new.extend([] if samples is None else samples)
            ended = ended or bool(last)
        if waiting + len(new) >= self.chunk or ended:
            buffer = [x for part in self.parts.get() for x in part[0]] + new if waiting else new
            whole = len(buffer) // self.chunk * self.chunk
            for s in range(0, whole, self.chunk):
                out.append((key[0], number, self.chunk, float(sum(buffer[s : s + self.chunk])), False))
                number += 1
            new, waiting = buffer[whole:], 0
            self.parts.clear()
        if ended:
            out += self._rest(key, number, new)
            self.state.clear()
        else:
            if new:
                self.parts.appendValue((new,))
            self.state.update((number, waiting + len(new)))
        self._arm(timerValues, self._times(pushes), not ended)
        yield self._frame(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        out = []
        if self.state.exists():
            number, waiting = self.state.get()
            out = self._rest(key, number, [x for part in self.parts.get() for x in part[0]] if waiting else [])
        self.state.clear()
        self.parts.clear()
        yield self._frame(out)

    def _rest(self, key, number, buffer):
        return [(key[0], number, len(buffer), float(sum(buffer)), True)] if buffer else []

    def _frame(self, rows):
        return pd.DataFrame(rows, columns=["session_id", "chunk_id", "n_samples", "total", "tail"])


#: What a row of a session's input asks for.
START, PUSH, END = "start", "push", "end"
EVENTS = "session_id string, seq bigint, action string, samples array<float>"
RESULTS = "session_id string, chunk_id bigint, n_samples bigint, raw string, final boolean, error string"


def pieces(text: str) -> list[str]:
    """Words with the white space before each; joined they are the text again."""
    return re.findall(r"\s*\S+|\s+\Z", text)


#: A table of open sessions, to start a stream from.
SAVED = "session_id string, chunk_id bigint, heard bigint, raw string, audio map<bigint,array<float>>, waiting array<array<float>>"


class Recognizer(_Idle, StatefulProcessor):
    """Runs an injected model over sessions: start opens one, push adds samples, end flushes and removes it.

    For each full chunk the model gets all samples heard so far and the prompt with the part of its last output that the settings
    keep; what it gives is appended to that part, and the result replaces the one before. A push or an end of a session that isn't
    open is answered with an error. Full chunks are map state by their number, written once; the samples that wait for the next one are list
    state, a push an entry. So a push writes itself and the chunks that it fills, however long the session is."""

    def __init__(self, model: Callable[[np.ndarray, str], str], settings: StreamSettings, context: str = "", idle_seconds: int | None = IDLE_SECONDS, split: Callable[[str], list[str]] = pieces, event_time: str | None = None):
        self.model, self.settings, self.split, self.event_time = model, settings, split, event_time
        self.prompt = context + (f"{LANGUAGE_PREFIX}{settings.language}{TEXT_TAG}" if settings.language else "")
        self.idle_ms = None if idle_seconds is None else idle_seconds * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.session = handle.getValueState("session", "chunk_id bigint, heard bigint, waiting bigint, raw string")
        self.audio = handle.getMapState("audio", "number bigint", "part array<float>")
        self.waiting = handle.getListState("waiting", "part array<float>")

    def handleInitialState(self, key, initialState, timerValues) -> None:
        for s in initialState.itertuples():
            parts = [np.asarray(p, np.float32) for p in s.waiting]
            self.session.update((int(s.chunk_id), int(s.heard), sum(map(len, parts)), s.raw))
            for number, part in (s.audio.items() if isinstance(s.audio, dict) else s.audio):
                self.audio.updateValue((int(number),), (np.asarray(part, np.float32).tolist(),))
            for p in parts:
                self.waiting.appendValue((p.tolist(),))
            if self.event_time is None:
                self._arm(timerValues, None, True)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        events = pd.concat(list(rows)).sort_values("seq", kind="stable")
        out: list[tuple] = []
        for action, samples in zip(events["action"], events["samples"]):
            if action == START:
                self._close()
                self.session.update((0, 0, 0, ""))
            elif not self.session.exists():
                out.append((key[0], None, 0, None, False, "unknown session"))
            elif action == END:
                out += self._finish(key)
            else:
                out += self._push(key, np.zeros(0, np.float32) if samples is None else np.asarray(samples, np.float32))
        self._arm(timerValues, self._times(events), self.session.exists())
        yield self._frame(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield self._frame(self._finish(key) if self.session.exists() else [])

    def _push(self, key, samples: np.ndarray) -> list[tuple]:
        number, heard, waiting, raw = self.session.get()
        out = []
        size = self.settings.chunk
        if waiting + len(samples) >= size:
            if waiting:
                samples = np.concatenate([self._rest(), samples])
                self.waiting.clear()
            audio, waiting = [self._heard()], 0
            for s in range(0, len(samples) // size * size, size):
                part = samples[s : s + size]
                self.audio.updateValue((heard // size,), (part.tolist(),))
                audio.append(part)
                heard += size
                raw = self._result(np.concatenate(audio), number, raw, False)
                out.append((key[0], number, heard, raw, False, None))
                number += 1
            samples = samples[len(samples) // size * size :]
        if len(samples):
            self.waiting.appendValue((samples.tolist(),))
        self.session.update((number, heard, waiting + len(samples), raw))
        return out

    def _finish(self, key) -> list[tuple]:
        number, heard, waiting, raw = self.session.get()
        if waiting:
            raw = self._result(np.concatenate([self._heard(), self._rest()]), number, raw, True)
            number, heard = number + 1, heard + waiting
        self._close()
        return [(key[0], number - 1 if number else None, heard, raw, True, None)]

    def _heard(self) -> np.ndarray:
        parts = dict((k[0], np.asarray(v[0], np.float32)) for k, v in self.audio.iterator())
        return np.concatenate([np.zeros(0, np.float32), *(parts[k] for k in sorted(parts))])

    def _rest(self) -> np.ndarray:
        return np.concatenate([np.asarray(x[0], np.float32) for x in self.waiting.get()])

    def _result(self, audio: np.ndarray, number: int, raw: str, finishing: bool) -> str:
        kept = "".join(self.settings.prefix_words(number, self.split(raw), finishing))
        return kept + self.model(audio, self.prompt + kept)

    def _close(self) -> None:
        self.session.clear()
        self.audio.clear()
        self.waiting.clear()

    def _frame(self, rows):
        return pd.DataFrame(rows, columns=["session_id", "chunk_id", "n_samples", "raw", "final", "error"]).astype({"chunk_id": "Int64"})


def _state_store(spark: SparkSession) -> None:
    """Sessions hold several states each, which only this store keeps; a session's setting, so other streams of this Spark session get it, too."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)


def _time_mode(idle_seconds: int | None, event_time: str | None) -> str:
    return "None" if idle_seconds is None else "ProcessingTime" if event_time is None else "EventTime"


def recognize_stream(events: DataFrame, model: Callable[[np.ndarray, str], str], settings: StreamSettings, context: str = "", idle_seconds: int | None = IDLE_SECONDS, saved: DataFrame | None = None, event_time: str | None = None) -> DataFrame:
    """events: a stream of EVENTS. A row for each chunk, and one with final where a session ends: session_id, chunk_id, n_samples (heard so far),
    language, text, final, error. The latest row of a session is its result. model: samples and prompt to text. One model call serves one session
    and gives no word times; sessions run side by side. saved: sessions that are open already (SAVED, as saved_sessions() reads them from another
    stream). event_time: a column of times by which sessions go idle, with a watermark, instead of the cluster's clock."""
    _state_store(events.sparkSession)
    first = None if saved is None else saved.groupBy("session_id")
    out = events.groupBy("session_id").transformWithStateInPandas(
        statefulProcessor=Recognizer(model, settings, context, idle_seconds, event_time=event_time), outputStructType=RESULTS, outputMode="Update", timeMode=_time_mode(idle_seconds, event_time), initialState=first
    )
    parsed = parse_output(F.col("raw"), F.lit(settings.language).cast("string"))
    return out.withColumn("p", F.when(F.col("error").isNull(), parsed)).select("session_id", "chunk_id", "n_samples", "p.language", "p.text", "final", "error")


def saved_sessions(spark: SparkSession, checkpoint: str) -> DataFrame:
    """The sessions (SAVED) that recognize_stream() has open, read from the stream's state under its checkpoint. Write them to a table to start another stream from."""
    read = lambda name: spark.read.format("statestore").option("stateVarName", name).option("flattenCollectionTypes", "false").load(checkpoint)
    session = read("session").select(F.col("key.session_id").alias("session_id"), "value.chunk_id", "value.heard", "value.raw")
    audio = read("audio").select(F.col("key.session_id").alias("session_id"), F.map_from_entries(F.transform(F.map_entries("map_value"), lambda e: F.struct(e["key"]["number"], e["value"]["part"]))).alias("audio"))
    waiting = read("waiting").select(F.col("key.session_id").alias("session_id"), F.transform("list_value", lambda x: x["part"]).alias("waiting"))
    out = session.join(audio, "session_id", "left").join(waiting, "session_id", "left")
    none = F.map_from_arrays(F.array().cast("array<bigint>"), F.array().cast("array<array<float>>"))
    return out.select("session_id", "chunk_id", "heard", "raw", F.coalesce("audio", none).alias("audio"), F.coalesce("waiting", F.array().cast("array<array<float>>")).alias("waiting"))


def client_pushes(blocks: DataFrame, key: str, order: str, samples: str, rate: int, settings: StreamSettings) -> DataFrame:
    """What a client sends of the blocks that it records at another rate: each block is resampled by steps, and the samples are pushed in full
    chunks, the rest last: key, seq, samples. A recording's blocks come together in one array, so they are one client's."""
    resampled = blocks.select(key, order, resample_step(F.col(samples), rate, settings.rate).alias("x"))
    whole = resampled.groupBy(key).agg(F.flatten(in_order(F.col("x"), F.col(order))).alias("x")).where(F.size("x") > 0)
    starts = F.sequence(F.lit(0), F.size("x") - 1, F.lit(settings.chunk))
    return whole.select(key, F.posexplode(F.transform(starts, lambda s: F.slice("x", s + 1, F.lit(settings.chunk)))).alias("seq", "samples"))


def rechunk_stream(pushes: DataFrame, chunk: int, idle_seconds: int | None = IDLE_SECONDS, event_time: str | None = None) -> DataFrame:
    """pushes: a stream of (session_id string, seq bigint, samples array<double>, last boolean). Without idle_seconds sessions end by
    their last push only; a run to the end of a finite input needs that, or event_time, as timers of the clock would keep it waiting."""
    _state_store(pushes.sparkSession)
    return pushes.groupBy("session_id").transformWithStateInPandas(statefulProcessor=Rechunker(chunk, idle_seconds, event_time), outputStructType=CHUNKS, outputMode="Update", timeMode=_time_mode(idle_seconds, event_time))


def run_to_end(stream: DataFrame, path: str) -> DataFrame:
    """Runs a stream over what there is now; its rows, as a table under path. Each batch has a folder, which a batch that is run again replaces."""
    spark: SparkSession = stream.sparkSession
    query = stream.writeStream.outputMode("update").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).foreachBatch(lambda rows, batch: rows.write.mode("overwrite").parquet(f"{path}/rows/batch={batch}")).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/rows").select(*stream.columns)


def rechunk_samples(samples: DataFrame, key: str, order: str, value: str, chunk: int) -> DataFrame:
    """One sample a row, as chunks: key, chunk_id, n_samples, total, tail."""
    place = F.row_number().over(Window.partitionBy(key).orderBy(order)) - 1
    out = samples.select(key, F.floor(place / chunk).alias("chunk_id"), F.col(value).alias("v")).groupBy(key, "chunk_id").agg(F.count("*").alias("n_samples"), F.sum("v").alias("total"))
    return out.withColumn("tail", F.col("n_samples") < chunk)


def idle_sessions(events: DataFrame, key: str, time: str, idle_seconds: int = IDLE_SECONDS) -> DataFrame:
    """A session goes on while pauses don't exceed the limit: key, session_number (from 0), first and last time, and n."""
    before = F.lag(time).over(Window.partitionBy(key).orderBy(time))
    pause = F.unix_micros(F.col(time).cast("timestamp")) - F.unix_micros(before.cast("timestamp"))
    started = events.withColumn("__new", F.when(pause > idle_seconds * 1_000_000, 1).otherwise(0))
    number = F.sum("__new").over(Window.partitionBy(key).orderBy(time))
    return started.withColumn("session_number", number).groupBy(key, "session_number").agg(F.min(time).alias("first_seen"), F.max(time).alias("last_seen"), F.count("*").alias("n"))
