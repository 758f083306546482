"""Readers and writers: training rows, lexicons, audio files, PCM pushes, results."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cantata.functions.text import SPACE, strip
from cantata.model import SAMPLE_RATE, SIDECAR_FILES
from cantata.operators.resampling import resample

PCM_TYPE = "application/octet-stream"


def read_rows(spark: SparkSession, schema: T.StructType, train: str, validation: str | None = None) -> DataFrame:
    """JSON lines with a declared schema, and split: train or validation."""
    out = spark.read.schema(schema).json(train).withColumn("split", F.lit("train"))
    return out if validation is None else out.unionByName(spark.read.schema(schema).json(validation).withColumn("split", F.lit("validation")))


def read_lexicon(spark: SparkSession, path: str) -> DataFrame:
    """First token of each line that isn't blank, once each."""
    line = strip(F.col("value"))
    return spark.read.text(path).where(F.length(line) > 0).select(F.get(F.split(line, f"[{SPACE}]+"), F.lit(0)).alias("word")).dropDuplicates()


def read_audio(spark: SparkSession, path: str) -> DataFrame:
    """path, length and content of audio files; content is read only where it is used."""
    return spark.read.format("binaryFile").load(path).select("path", "length", "content")


def wave_samples(raw: bytes | None):
    """Rate and samples (mean over channels) of a wave file of 8, 16, 24 or 32-bit PCM; other bytes give (None, None)."""
    import io
    import wave

    import numpy as np

    try:
        with wave.open(io.BytesIO(raw)) as w:
            width, channels, frames = w.getsampwidth(), w.getnchannels(), w.readframes(w.getnframes())
            if width == 1:  # unsigned
                x = (np.frombuffer(frames, np.uint8).astype(np.float64) - 128) / 128
            else:  # each sample goes to the top of 32 bits
                whole = np.zeros((len(frames) // width, 4), np.uint8)
                whole[:, 4 - width :] = np.frombuffer(frames, np.uint8)[: len(whole) * width].reshape(-1, width)
                x = whole.view("<i4")[:, 0] / 2147483648
            return w.getframerate(), x[: len(x) // channels * channels].reshape(-1, channels).mean(1).astype(np.float32)
    except (wave.Error, EOFError, TypeError):
        return None, None


def decode_wave(df: DataFrame, content: str, keep: tuple[str, ...] = ("path",), decoder=wave_samples) -> DataFrame:
    """Audio bytes to sr and samples. decoder: bytes to rate and mono samples, or (None, None); PCM waves if none is given."""
    import pyarrow as pa

    fields = [*(df.schema[c] for c in keep), T.StructField("sr", T.IntegerType()), T.StructField("samples", T.ArrayType(T.FloatType()))]
    k = len(keep)

    def run(batches):
        for batch in batches:
            got = [decoder(x) for x in batch.column(k).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in range(k)), pa.array([r for r, _ in got], pa.int32()), pa.array([x for _, x in got], pa.list_(pa.float32()))], names=[f.name for f in fields])

    return df.select(*keep, content).mapInArrow(run, T.StructType(fields))


def _with_files(rows: DataFrame, audio_files: DataFrame) -> DataFrame:
    """rows with the content of the files that paths name as __bytes. Names are matched first; then the contents of the named files alone are joined. Of several files with
    one name but for the scheme, the first by its full path counts."""
    from cantata.operators.joins import small_side
    from cantata.sources import routing

    plain = lambda c: F.regexp_replace(c, r"\A[a-z0-9]+:(//)?(?=/)", "")
    paths = rows.where(F.col("kind") == routing.PATH)
    asked = paths.select(plain(F.col("__source")).alias("__plain")).distinct()
    named = audio_files.select(plain(F.col("path")).alias("__plain"), "path").groupBy("__plain").agg(F.min("path").alias("__file")).join(asked, "__plain")
    count = named.count()
    content = audio_files.select(F.col("path").alias("__file"), F.col("content").alias("__content")).join(small_side(named.select("__file"), count, 300), "__file", "left_semi")
    found = paths.withColumn("__plain", plain(F.col("__source"))).join(small_side(named, count, 600), "__plain", "left").join(content, "__file", "left")
    return found.withColumn("__bytes", F.col("__content")).select(*rows.columns).unionByName(rows.where(F.col("kind") != routing.PATH))


#: Of fetched URLs: seconds to wait, bytes that one may have, and how many are fetched at once by a task.
FETCH_SECONDS, FETCH_BYTES, FETCHES = 30, 1 << 28, 8


def http_fetch(urls: list[str]) -> list[bytes | None]:
    """The bodies of URLs, None for what can't be had, is too long or isn't http(s). Equal URLs of one call are fetched once."""
    import urllib.request
    from concurrent.futures import ThreadPoolExecutor

    def one(url: str) -> bytes | None:
        if not url.lower().startswith(("http://", "https://")):
            return None
        try:
            with urllib.request.urlopen(url, timeout=FETCH_SECONDS) as reply:
                body = reply.read(FETCH_BYTES + 1)
                return body if len(body) <= FETCH_BYTES else None
        except (OSError, ValueError):
            return None

    distinct = list(dict.fromkeys(urls))
    with ThreadPoolExecutor(FETCHES) as pool:
        found = dict(zip(distinct, pool.map(one, distinct)))
    return [found[u] for u in urls]


def load_audio(df: DataFrame, source: str, keep: tuple[str, ...], audio_files: DataFrame | None = None, fetch=None, decoder=wave_samples, resampler=resample, target: int = SAMPLE_RATE) -> DataFrame:
    """One loader for a column of mixed inputs: kept columns, kind, error, and samples: mono, at the target rate, the peak brought to 1.

    URLs go to fetch (a list of URLs to a list of bytes or None; http_fetch does), base64 is decoded, paths are looked up in audio_files (path and content, as
    read_audio() gives them; the path as it stands in the column, or with a scheme). resampler: samples, rate and target to samples, for
    other rates than the target (None: these are errors). What can't be loaded has null samples and says why."""
    import pyarrow as pa

    from cantata.functions.signal import normalize_peak
    from cantata.sources import routing

    rows = df.select(*keep, F.col(source).alias("__source"), routing.route(F.col(source)).alias("kind"), routing.base64_bytes(F.when(routing.route(F.col(source)) == routing.BASE64, F.col(source))).alias("__bytes"))
    if audio_files is not None:
        rows = _with_files(rows, audio_files)
    fields = [*(rows.schema[c] for c in (*keep, "kind")), T.StructField("error", T.StringType()), T.StructField("__samples", T.ArrayType(T.FloatType()))]
    k = len(keep)

    def one(kind, source, raw):
        if kind == routing.URL and fetch is None:
            return "URLs need a fetcher", None
        if raw is None:
            return ("not fetched" if kind == routing.URL else "no such audio"), None
        rate, samples = decoder(raw)
        if rate is None:
            return "not decoded", None
        if rate != target:
            if resampler is None:
                return f"a rate of {rate} needs a resampler", None
            samples = resampler(samples, rate, target)
        return None, samples

    def run(batches):
        for batch in batches:
            sources, kinds, raw = (batch.column(k + i).to_pylist() for i in range(3))
            if fetch is not None:
                at = [i for i, kind in enumerate(kinds) if kind == routing.URL]
                for i, got in zip(at, fetch([sources[i] for i in at]) if at else ()):
                    raw[i] = got
            got = [one(*x) for x in zip(kinds, sources, raw)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in range(k)), batch.column(k + 1), pa.array([e for e, _ in got], pa.string()), pa.array([x for _, x in got], pa.list_(pa.float32()))], names=[f.name for f in fields])

    out = rows.select(*keep, "__source", "kind", "__bytes").mapInArrow(run, T.StructType(fields))
    return out.select(*keep, "kind", "error", F.when(F.col("__samples").isNotNull(), normalize_peak(F.col("__samples"))).cast("array<float>").alias("samples"))


def pcm_error(mime: Column, payload: Column) -> Column:
    """Why a push of 32-bit samples is refused, or null."""
    return F.when(F.coalesce(mime, F.lit("")) != PCM_TYPE, F.lit("wrong content type")).when(payload.isNull() | (F.octet_length(payload) % 4 != 0), F.lit("length is not a multiple of 4"))


def split_pushes(df: DataFrame, mime: str, payload: str) -> tuple[DataFrame, DataFrame]:
    """Pushes that are accepted, and refused ones with error."""
    marked = df.withColumn("error", pcm_error(F.col(mime), F.col(payload)))
    return marked.where("error is null").drop("error"), marked.where("error is not null")


def result_json(language: Column, text: Column) -> Column:
    return F.to_json(F.struct(F.coalesce(language, F.lit("")).alias("language"), F.coalesce(text, F.lit("")).alias("text")))


def escaped(text: Column) -> Column:
    """Text as HTML shows it."""
    for raw, shown in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        text = F.replace(text, F.lit(raw), F.lit(shown))
    return text


def timestamp_cards(items: Column, samples: Column, rate: int, encode) -> Column:
    """HTML with a card for each word and its audio slice; words without times, or with an empty slice, are left out.
    encode: samples to a data URL."""
    at = lambda t: F.bround(t * rate).cast("int")
    whole = F.filter(items, lambda x: x["start_time"].isNotNull() & x["end_time"].isNotNull() & (x["end_time"] > x["start_time"]) & (F.least(at(x["end_time"]), F.size(samples)) > at(x["start_time"])))
    card = lambda x: F.concat(F.lit('<div class="word"><b>'), escaped(x["text"]), F.lit('</b><audio controls src="'), encode(F.slice(samples, at(x["start_time"]) + 1, at(x["end_time"]) - at(x["start_time"]))), F.lit('"></audio></div>'))
    return F.array_join(F.transform(whole, card), "")


def write_results(df: DataFrame, path: str, language: str = "language", text: str = "text", mode: str = "append") -> None:
    """Results as JSON lines with language and text."""
    df.select(result_json(F.col(language), F.col(text)).alias("value")).write.mode(mode).text(path)


def sink_results(stream: DataFrame, path: str, checkpoint: str, **trigger):
    """Starts a stream's query that writes its results as JSON lines, a folder `batch=<id>` for each batch: a batch that is run again after a failure replaces what it
    left. trigger: as for the stream writer (availableNow=True for what there is now)."""
    writer = stream.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(lambda rows, batch: write_results(rows, f"{path}/batch={batch}", mode="overwrite"))
    return (writer.trigger(**trigger) if trigger else writer).start()


#: Pushes as files: `<folder>/<session>/<number>.start`, `.pcm` (32-bit samples) or `.end`. A mark holds a byte at least, since Spark leaves empty files out.
PUSHES = "session_id string, seq bigint, action string, samples array<float>, error string"


def push_files(df: DataFrame) -> DataFrame:
    """PUSHES of binary files (path, content), a stream or a table. Files of other names are left out; a body that isn't whole samples is refused: its error says so."""
    import numpy as np
    import pyarrow as pa

    actions = {"start": "start", "pcm": "push", "end": "end"}
    part = lambda k: F.regexp_extract(F.col("path"), r"/([^/]+)/([0-9]+)\.(start|pcm|end)\z", k)
    kind = F.coalesce(*(F.when(part(3) == k, v) for k, v in actions.items()))
    rows = df.where(part(0) != "").select(F.url_decode(part(1)).alias("session_id"), part(2).cast("bigint").alias("seq"), kind.alias("action"), F.when(kind == "push", pcm_error(F.lit(PCM_TYPE), F.col("content"))).alias("error"), "content")

    def run(batches):
        for batch in batches:
            action, error, content = (batch.column(k).to_pylist() for k in (2, 3, 4))
            samples = [np.frombuffer(c, "<f4") if a == "push" and e is None else None for a, e, c in zip(action, error, content)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(samples, pa.list_(pa.float32())), batch.column(3)], names=["session_id", "seq", "action", "samples", "error"])

    return rows.mapInArrow(run, PUSHES)


def push_stream(spark: SparkSession, folder: str, **options) -> DataFrame:
    """A stream of PUSHES: each file is read once, also after a restart, as the stream's checkpoint keeps what it has read. Any store that Spark reads will do."""
    schema = "path string, modificationTime timestamp, length bigint, content binary"
    return push_files(spark.readStream.format("binaryFile").schema(schema).options(recursiveFileLookup="true", **options).load(folder))


def _file_system(spark: SparkSession, path: str):
    """The path as Hadoop has it, its file system and the configuration; so any store that Spark can read will do."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    return at, at.getFileSystem(conf), conf


def copy_sidecars(spark: SparkSession, source: str, target: str) -> list[str]:
    """Copies the files that stand beside saved weights, those that exist; their names."""
    folder, to, conf = _file_system(spark, target)
    to.mkdirs(folder)
    found = []
    for name in SIDECAR_FILES:
        at, of, _ = _file_system(spark, f"{source}/{name}")
        if of.exists(at):
            spark.sparkContext._jvm.org.apache.hadoop.fs.FileUtil.copy(of, at, to, _file_system(spark, f"{target}/{name}")[0], False, True, conf)
            found.append(name)
    return found


def save_config(spark: SparkSession, config: dict, folder: str, name: str = "config.json") -> None:
    at, to, _ = _file_system(spark, f"{folder}/{name}")
    out = to.create(at, True)
    try:
        out.write(bytearray(json.dumps(config, ensure_ascii=False, indent=2, sort_keys=True).encode()))
    finally:
        out.close()


def load_config(spark: SparkSession, folder: str, name: str = "config.json") -> dict:
    return json.loads(spark.read.text(f"{folder}/{name}", wholetext=True).first().value)
