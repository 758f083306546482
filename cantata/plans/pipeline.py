"""Requests from audio to merged results. Models are injected: batched callables over pandas frames; none is built in."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cantata.functions.signal import argmax, softmax
from cantata.functions.text import parse_output, text_prompt, words_spaced
from cantata.model import MAX_ALIGN_SECONDS, MAX_TRANSCRIBE_SECONDS, SAMPLE_RATE, TURN_LABELS
from cantata.operators.align import merged_items, merged_languages, merged_text, pair_words, repair_times, shift
from cantata.operators.chunking import split_quiet

#: Named model callables: frame to a list with one result a row.
BACKENDS: dict[str, Callable[[pd.DataFrame], list]] = {}


def register_backend(name: str, model: Callable[[pd.DataFrame], list]) -> None:
    BACKENDS[name] = model


def backend(name: str) -> Callable[[pd.DataFrame], list]:
    if name not in BACKENDS:
        raise ValueError(f"unknown backend: {name}")
    return BACKENDS[name]


def apply_model(df: DataFrame, model: Callable[[pd.DataFrame], list], inputs: list[str], out: str, out_type: T.DataType | str, batch: int | None = None) -> DataFrame:
    """df with a column of the model's results. It is called on at most `batch` rows at once (None or below 0: what arrives together)."""
    if batch == 0:
        raise ValueError("a batch size of 0")
    kind = T._parse_datatype_string(out_type) if isinstance(out_type, str) else out_type
    schema = T.StructType([*df.schema.fields, T.StructField(out, kind)])

    def run(frames):
        for frame in frames:
            size = len(frame) if batch is None or batch < 0 else batch
            for s in range(0, len(frame), max(size, 1)):
                part = frame.iloc[s : s + size].copy()
                part[out] = list(model(part[inputs]))
                yield part

    return df.mapInPandas(run, schema)


def transcribe(requests: DataFrame, model: Callable[[pd.DataFrame], list] | str, aligner: Callable[[pd.DataFrame], list] | None = None, with_times: bool = False, batch: int | None = None, tokenize: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """requests: orig_index, samples (mono, SAMPLE_RATE), context, language. The model takes chunk and prompt and gives raw text;
    the aligner takes chunk and words and gives two times a word, in milliseconds. A model may be the name of a registered backend.
    One row a request: orig_index, language, text, time_stamps."""
    model = backend(model) if isinstance(model, str) else model
    if with_times and aligner is None:
        raise ValueError("word times need an aligner")
    longest = MAX_ALIGN_SECONDS if with_times else MAX_TRANSCRIBE_SECONDS
    forced = F.nullif(F.coalesce("language", F.lit("")), F.lit(""))
    df = requests.withColumn("language", forced).withColumn("prompt", text_prompt(F.coalesce("context", F.lit("")), F.col("language")))
    chunks = split_quiet(df, "samples", SAMPLE_RATE, longest, keep=("orig_index", "language", "prompt"))
    raw = apply_model(chunks, model, ["chunk", "prompt"], "raw", "string", batch)
    parsed = raw.withColumn("parsed", parse_output(F.col("raw"), F.col("language")))
    parsed = parsed.select("orig_index", "chunk_index", "offset_sec", "chunk", F.col("parsed.language").alias("language"), F.col("parsed.text").alias("text"))
    items = F.lit(None).cast("array<struct<text:string,start_time:double,end_time:double>>")
    if with_times:
        parsed = align(parsed, aligner, batch, tokenize)
        items = shift(F.col("items"), F.col("offset_sec"))
    order = F.col("chunk_index")
    parsed = parsed.select("orig_index", "chunk_index", "language", "text", items.alias("items"))
    return parsed.groupBy("orig_index").agg(merged_languages(F.col("language"), order).alias("language"), merged_text(F.col("text"), order).alias("text"), merged_items(F.col("items"), order).alias("time_stamps"))


def align(df: DataFrame, aligner: Callable[[pd.DataFrame], list], batch: int | None = None, tokenize: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """df (chunk, text) with words and items, the words' times; a text without words has no items, and isn't sent to the aligner. tokenize: df to df with words, where
    white space doesn't do, as lexicon.words_by_lexicon() for words with endings."""
    worded = tokenize(df) if tokenize else df.withColumn("words", words_spaced(F.col("text")))
    kind = "array<struct<text:string,start_time:double,end_time:double>>"
    timed = repair_times(apply_model(worded.where(F.size("words") > 0), aligner, ["chunk", "words"], "times", "array<bigint>", batch), "times", "times")
    timed = timed.withColumn("items", pair_words(F.col("words"), F.col("times"))).drop("times")
    return timed.unionByName(worded.where(F.size("words") == 0).withColumn("items", F.lit(None).cast(kind)))


def turn_prediction(logits: Column) -> Column:
    """label, complete_prob, incomplete_prob and logits from two logits."""
    p = softmax(logits)
    return F.struct(F.get(F.array(*map(F.lit, TURN_LABELS)), argmax(p)).alias("label"), F.get(p, F.lit(1)).alias("complete_prob"), F.get(p, F.lit(0)).alias("incomplete_prob"), logits.alias("logits"))


def predict_turns(windows: DataFrame, model: Callable[[pd.DataFrame], list], inputs: list[str], batch: int | None = None) -> DataFrame:
    """windows with prediction; the model gives two logits a row."""
    return apply_model(windows, model, inputs, "logits", "array<double>", batch).withColumn("prediction", turn_prediction(F.col("logits"))).drop("logits")
