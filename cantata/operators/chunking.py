"""Cutting long signals at quiet places, and dealing requests to batches."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cantata.model import MIN_CHUNK_SECONDS
from cantata.storage import Scratch


def quiet_cuts(x: np.ndarray, rate: int, longest: float, reach: float = 5.0, window_ms: float = 100.0) -> list[int]:
    """Ends of the chunks of a mono signal. Near each full length, within reach on both sides, the window with the least energy
    is taken (the first of equals), and in it the quietest sample; so a chunk may exceed the full length by the reach."""
    n, full, near = len(x), int(longest * rate), int(reach * rate)
    if n / rate <= longest:
        return [n]
    width = max(4, int(window_ms / 1000 * rate))
    loud = np.abs(x)
    ends, start = [], 0
    while n - start > full:
        cut = start + full
        lo, hi = max(start, cut - near), min(n, cut + near)
        if hi - lo > width:
            part = loud[lo:hi]
            w = int(np.argmin(np.lib.stride_tricks.sliding_window_view(part, width).sum(1, dtype=np.float32)))
            cut = lo + w + int(np.argmin(part[w : w + width]))
        start = min(max(cut, start + 1), n)
        ends.append(start)
    return [*ends, n]


def split_quiet(df: DataFrame, samples: str, rate: int, longest: float, reach: float = 5.0, window_ms: float = 100.0, keep: tuple[str, ...] = ("audio_id",)) -> DataFrame:
    """One row a chunk: kept columns, chunk_index, offset_samples, offset_sec, n_samples (before padding) and chunk. If a signal
    was cut, its short chunks are padded with zeros. A null or empty signal is one empty chunk."""
    import pyarrow as pa

    fields = [
        *(df.schema[c] for c in keep),
        T.StructField("chunk_index", T.IntegerType()),
        T.StructField("offset_samples", T.LongType()),
        T.StructField("offset_sec", T.DoubleType()),
        T.StructField("n_samples", T.LongType()),
        T.StructField("chunk", T.ArrayType(T.FloatType())),
    ]
    k, least = len(keep), int(MIN_CHUNK_SECONDS * rate)

    def run(batches):
        for batch in batches:
            at, index, offset, seconds, count, chunks = [], [], [], [], [], []
            for r, value in enumerate(batch.column(k)):
                x = np.zeros(0, np.float32) if not value.is_valid else np.asarray(value.values, np.float32)
                ends = quiet_cuts(x, rate, longest, reach, window_ms)
                start, passed = 0, 0.0
                for i, end in enumerate(ends):
                    part = x[start:end]
                    if len(ends) > 1 and len(part) < least:
                        part = np.pad(part, (0, least - len(part)))
                    for column, v in zip((at, index, offset, seconds, count, chunks), (r, i, start, passed, end - start, part)):
                        column.append(v)
                    passed += (end - start) / rate
                    start = end
            rows = pa.array(at, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c).take(rows) for c in range(k)), pa.array(index, pa.int32()), pa.array(offset, pa.int64()), pa.array(seconds, pa.float64()), pa.array(count, pa.int64()), pa.array(chunks, pa.list_(pa.float32()))],
                names=[f.name for f in fields],
            )

    return df.select(*keep, F.col(samples).cast("array<float>")).mapInArrow(run, T.StructType(fields))


def energy_windows(df: DataFrame, key: str, index: str, value: str, width: int) -> DataFrame:
    """Signals as rows: for each sample the sum of absolute values over the window that starts there, full windows only."""
    ahead = Window.partitionBy(key).orderBy(index).rowsBetween(Window.currentRow, width - 1)
    out = df.select(key, index, F.sum(F.abs(value)).over(ahead).alias("energy"), F.count("*").over(ahead).alias("n"))
    return out.where(F.col("n") == width).drop("n")


def quietest_window(df: DataFrame, key: str, index: str, value: str, width: int) -> DataFrame:
    """Per signal the window with the least energy, the first of equals."""
    return energy_windows(df, key, index, value, width).groupBy(key).agg(F.min(F.struct("energy", index)).alias("m")).select(key, F.col(f"m.{index}").alias("window_start"), F.col("m.energy").alias("energy"))


def batch_number(position: Column, size: int | None, zero_is_error: bool = False) -> Column:
    """Batch of a row by its position from 0. No size, or a negative one, is a single batch; so is 0, unless that is an error."""
    if size == 0 and zero_is_error:
        raise ValueError("a batch size of 0")
    return F.lit(0).cast("bigint") if size is None or size <= 0 else F.floor(position / size)


def with_positions(df: DataFrame, order: str, name: str = "position") -> DataFrame:
    """Position of each row in the order of a column, from 0, without one task for all rows: rows are range-partitioned, and each
    partition counts on from the rows of those before it. The partitions are written once: their borders are sampled, so a second run could
    draw others. Rows with equal values come in any order."""
    spark = df.sparkSession
    parts = df.repartitionByRange(order).sortWithinPartitions(order).withColumn("__p", F.spark_partition_id()).withColumn("__i", F.monotonically_increasing_id())
    parts = Scratch(spark).keep(parts, "ordered")
    within = F.col("__i") - F.shiftleft(F.col("__p").cast("bigint"), 33)
    counts = parts.groupBy("__p").agg(F.count("*").alias("n")).collect()  # a row a partition
    before, total = [], 0
    for r in sorted(counts):
        before.append((r["__p"], total))
        total += r.n
    starts = spark.createDataFrame(before, "__p int, __s bigint")
    return parts.join(F.broadcast(starts), "__p").withColumn(name, F.col("__s") + within).drop("__p", "__i", "__s")


def pad_batches(df: DataFrame, batch: str, samples: str) -> DataFrame:
    """df with every signal padded with zeros to the longest of its batch, and mask: 1 for what the signal had, 0 for padding. A null
    signal is an empty one. Only lengths are gathered by batch."""
    x = F.coalesce(F.col(samples), F.array().cast(df.schema[samples].dataType))
    longest = df.groupBy(F.col(batch).alias("__batch")).agg(F.max(F.size(x)).alias("__longest"))
    zero = F.lit(0).cast(df.schema[samples].dataType.elementType)
    out = df.join(longest, F.col(batch).eqNullSafe(F.col("__batch")))
    rest = F.col("__longest") - F.size(x)
    mask = F.concat(F.array_repeat(F.lit(1), F.size(x)), F.array_repeat(F.lit(0), rest))
    return out.select(*(F.concat(x, F.array_repeat(zero, rest)).alias(c) if c == samples else F.col(c) for c in df.columns), mask.alias("mask"))


def broadcast_request(df: DataFrame, context: list[str], language: list[str | None], count: int) -> DataFrame:
    """Adds context and language to numbered requests (orig_index): lists of one value go to all, others must have a value for each."""
    for name, values in (("context", context), ("language", language)):
        if len(values) not in (1, count):
            raise ValueError(f"{len(values)} values of {name} for {count} requests")
    pick = lambda values: F.lit(values[0]).cast("string") if len(values) == 1 else F.get(F.array(*(F.lit(v).cast("string") for v in values)), F.col("orig_index"))
    return df.withColumn("context", pick(context)).withColumn("language", pick(language))
