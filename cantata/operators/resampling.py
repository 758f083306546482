"""Resampling by a windowed-sinc filter bank: mono signals from any rate to any other."""

from __future__ import annotations

from functools import lru_cache
from math import gcd

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Zero crossings of the filter on each side, and the share of the lower rate's band that it keeps.
ZEROS = 32
BAND = 0.95
#: Samples that a product of matrices takes at once.
ROWS = 1 << 14


def kernel(t: np.ndarray, cutoff: float, zeros: int = ZEROS) -> np.ndarray:
    """A sinc with zeros every 1 / cutoff samples under a squared cosine that ends at the last of them."""
    wide = zeros / cutoff
    return np.where(np.abs(t) < wide, np.sinc(cutoff * t) * np.cos(np.pi * t / (2 * wide)) ** 2, 0.0)


@lru_cache(maxsize=64)
def bank(rate: int, target: int, zeros: int = ZEROS) -> tuple[np.ndarray, int, int, int]:
    """The filters of a period as columns of one matrix: `down` samples give `up` new ones. Row r stands for the sample `reach` before the period's first plus r; each
    column sums up to 1, so that a constant stays one."""
    up, down = target // gcd(rate, target), rate // gcd(rate, target)
    cutoff = BAND * min(1.0, target / rate)
    reach = int(np.ceil(zeros / cutoff))
    at = np.arange(up) * down / up
    m = kernel(np.arange(-reach, down + reach)[:, None] - at[None, :], cutoff, zeros)
    return m / m.sum(0), up, down, reach


def resample(x: np.ndarray, rate: int, target: int, zeros: int = ZEROS) -> np.ndarray:
    """A signal at another rate: ceil(n * target / rate) samples, the first at the same time. Beyond its ends a signal is silent. A product of matrices per ROWS periods
    of samples, so memory grows with the signal alone."""
    x = np.asarray(x)
    kind = x.dtype if x.dtype in (np.float32, np.float64) else np.float32
    if rate == target or not len(x):
        return x.astype(kind)
    if rate <= 0 or target <= 0:
        raise ValueError("rates must be above 0")
    m, up, down, reach = bank(int(rate), int(target), zeros)
    n = -(-len(x) * target // rate)
    periods = -(-n // up)
    padded = np.zeros(reach + max(len(x), periods * down) + down + reach, np.float64)
    padded[reach : reach + len(x)] = x
    windows = np.lib.stride_tricks.sliding_window_view(padded, len(m))[::down][:periods]
    some = max(1, ROWS // len(m) * 16)
    out = [windows[i : i + some] @ m for i in range(0, periods, some)]
    return np.concatenate(out).reshape(-1)[:n].astype(kind)


def resample_rows(df: DataFrame, samples: str, rate: str, target: int, zeros: int = ZEROS) -> DataFrame:
    """df with its signals (array<float> or array<double>) at the target rate, and the rate column saying so. A null signal or rate gives a null signal, an empty one stays
    empty, a null sample is silent; a rate that isn't above 0 is an error. Signals stay in their rows."""
    kind = df.schema[samples].dataType
    schema = T.StructType([f if f.name not in (samples, rate) else T.StructField(f.name, kind if f.name == samples else T.IntegerType()) for f in df.schema.fields])
    s, r = df.columns.index(samples), df.columns.index(rate)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            rates = batch.column(r).to_pylist()
            out = [None if v is None or not x.is_valid else resample(x.values.to_numpy(zero_copy_only=False), v, target, zeros) for v, x in zip(rates, batch.column(s))]
            new = {s: pa.array(out, batch.column(s).type), r: pa.array([target] * len(rates), pa.int32())}
            yield pa.RecordBatch.from_arrays([new.get(c, batch.column(c)) for c in range(batch.num_columns)], names=schema.names)

    silent = F.lit(0).cast(kind.elementType)
    return df.withColumn(samples, F.transform(samples, lambda v: F.coalesce(v, silent))).withColumn(rate, F.col(rate).cast("int")).mapInArrow(run, schema)
