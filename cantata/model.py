"""Schemas and fixed values of the data model."""

from __future__ import annotations

from pyspark.sql import types as T

#: Languages a request may name.
LANGUAGES = (
    "Chinese", "English", "Cantonese", "Arabic", "German", "French", "Spanish", "Portuguese", "Indonesian", "Italian",
    "Korean", "Russian", "Thai", "Vietnamese", "Japanese", "Turkish", "Hindi", "Malay", "Dutch", "Swedish",
    "Danish", "Finnish", "Polish", "Czech", "Filipino", "Persian", "Greek", "Romanian", "Hungarian", "Macedonian",
)

#: Rates, lengths and markers.
SAMPLE_RATE = 16000
MAX_TRANSCRIBE_SECONDS = 1200
MAX_ALIGN_SECONDS = 180
MIN_CHUNK_SECONDS = 0.5
TEXT_TAG = "<asr_text>"
LANGUAGE_PREFIX = "language "
TIMESTAMP_TOKEN = "<timestamp>"
AUDIO_PREFIX = "<|audio_start|><|audio_pad|><|audio_end|>"
TURN_LABELS = ("incomplete", "complete")
#: Dtype names and their aliases.
DTYPES = {"bf16": "bfloat16", "bfloat16": "bfloat16", "fp16": "float16", "float16": "float16", "half": "float16", "fp32": "float32", "float32": "float32"}
#: Files that stand beside saved weights.
SIDECAR_FILES = (
    "config.json", "generation_config.json", "preprocessor_config.json", "processor_config.json", "tokenizer_config.json",
    "tokenizer.json", "special_tokens_map.json", "chat_template.json", "merges.txt", "vocab.json",
)

ALIGN_ITEM = T.StructType([T.StructField("text", T.StringType()), T.StructField("start_time", T.DoubleType()), T.StructField("end_time", T.DoubleType())])
TRANSCRIPTION = T.StructType([T.StructField("language", T.StringType()), T.StructField("text", T.StringType()), T.StructField("time_stamps", T.ArrayType(ALIGN_ITEM))])
AUDIO_INPUT = T.StructType(
    [T.StructField("kind", T.StringType()), T.StructField("uri", T.StringType()), T.StructField("payload", T.BinaryType()), T.StructField("samples", T.ArrayType(T.FloatType())), T.StructField("sr", T.IntegerType())]
)
TURN_PREDICTION = T.StructType([T.StructField("label", T.StringType()), T.StructField("complete_prob", T.DoubleType()), T.StructField("incomplete_prob", T.DoubleType()), T.StructField("logits", T.ArrayType(T.DoubleType()))])
#: Rows of the two kinds of training files.
TRANSCRIPT_ROW = T.StructType([T.StructField("audio", T.StringType(), False), T.StructField("text", T.StringType(), False), T.StructField("prompt", T.StringType())])
TURN_ROW = T.StructType(
    [
        T.StructField("audio", T.StringType(), False),
        T.StructField("label", T.StringType(), False),
        *(T.StructField(c, T.DoubleType()) for c in ("cut_time_ms", "left_context_ms", "right_context_ms")),
        T.StructField("prompt", T.StringType()),
    ]
)
