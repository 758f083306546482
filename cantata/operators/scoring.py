"""Scores of transcripts and of word times: word and character errors, boundary hits and shifts, and curves over scores."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cantata.functions.text import let
from cantata.operators.joins import running_totals

EDITS = ("n_ref", "n_hyp", "hits", "substitutions", "deletions", "insertions")


def _masks(reference: list) -> dict:
    """For each value the places where it stands in the reference, as the bits of a number."""
    places: dict = {}
    for i, w in enumerate(reference):
        places.setdefault(w, []).append(i)
    out = {}
    for w, at in places.items():
        bits = bytearray(at[-1] // 8 + 1)
        for i in at:
            bits[i >> 3] |= 1 << (i & 7)
        out[w] = int.from_bytes(bits, "little")
    return out


def edit_counts(reference: list, hypothesis: list) -> tuple[int, int, int, int]:
    """(hits, substitutions, deletions, insertions) of a cheapest alignment.

    A column of the table of distances is two numbers: the places where it rises and those where it falls from one reference value to the
    next. A hypothesis value gives the next column by a few operations on these, whatever their length. Only every k-th column is kept,
    k the root of their number; walking back from the end, the columns between two of them are made again. Of equal steps back a
    deletion is taken first, then an insertion that any cheapest alignment needs, else the pair."""
    m, n = len(reference), len(hypothesis)
    if not m or not n:
        return 0, 0, m, n
    masks, full = _masks(reference), (1 << m) - 1

    def step(rise: int, fall: int, value) -> tuple[int, int]:
        same = masks.get(value, 0)
        zero = (((same & rise) + rise) ^ rise) | same | fall
        right = fall | (full & ~(zero | rise))
        left = rise & zero
        right = ((right << 1) | 1) & full
        return ((left << 1) & full) | (full & ~(zero | right)), right & zero

    every = max(1, math.isqrt(n))
    kept, column = [], (full, 0)
    for j, value in enumerate(hypothesis):
        if j % every == 0:
            kept.append(column)
        column = step(*column, value)
    hits = substitutions = deletions = insertions = 0
    i, j = m, n
    while kept and i:
        start = (len(kept) - 1) * every
        columns = [kept.pop()]
        for value in hypothesis[start:j]:
            columns.append(step(*columns[-1], value))
        while i and j > start:
            bit = i - 1
            if columns[j - start][0] >> bit & 1:
                deletions, i = deletions + 1, i - 1
            elif columns[j - start - 1][1] >> bit & 1:
                insertions, j = insertions + 1, j - 1
            else:
                if reference[i - 1] == hypothesis[j - 1]:
                    hits += 1
                else:
                    substitutions += 1
                i, j = i - 1, j - 1
    return hits, substitutions, deletions + i, insertions + j


def aligned(df: DataFrame, reference: str, hypothesis: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """Kept columns and the EDITS between two arrays of strings (words) of each row, or between two strings by their characters. Null is empty; a null in an array is a value."""
    import pyarrow as pa

    schema = T.StructType([*(df.schema[c] for c in keep), *(T.StructField(c, T.LongType()) for c in EDITS)])
    k = len(keep)

    def run(batches):
        for batch in batches:
            rows = []
            for r, h in zip(batch.column(k).to_pylist(), batch.column(k + 1).to_pylist()):
                r, h = r or (), h or ()
                rows.append((len(r), len(h), *edit_counts(r, h)))
            columns = zip(*rows) if rows else [()] * len(EDITS)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in range(k)), *(pa.array(list(c), pa.int64()) for c in columns)], names=schema.names)

    return df.select(*keep, F.col(reference).alias("__r"), F.col(hypothesis).alias("__h")).mapInArrow(run, schema)


def error_rates(edits: DataFrame, *by: str) -> DataFrame:
    """Rows, sums of EDITS, and the error rate of each group and (by null) of everything. The rate is edits by reference length over the whole group, not a mean of
    rates; without reference values it is null."""
    out = edits.rollup(*by).agg(F.count("*").alias("n"), *(F.sum(c).alias(c) for c in EDITS))
    return out.withColumn("error_rate", F.when(F.col("n_ref") > 0, (F.col("substitutions") + F.col("deletions") + F.col("insertions")) / F.col("n_ref")))


def match_times(reference: list[float], found: list[float], tolerance: float) -> tuple[int, float]:
    """Most pairs of a reference and a found time that lie within the tolerance, each time in one pair at most, and their summed distance. Both lists rise. Each reference
    time takes the first found time that is left and not too early."""
    hits, total, k = 0, 0.0, 0
    for r in reference:
        while k < len(found) and found[k] < r - tolerance:
            k += 1
        if k < len(found) and found[k] <= r + tolerance:
            hits, total, k = hits + 1, total + abs(found[k] - r), k + 1
    return hits, total


def boundary_hits(df: DataFrame, reference: str, found: str, tolerance: float, keep: tuple[str, ...] = ()) -> DataFrame:
    """Kept columns, n_ref, n_found, hits and shift (summed distance of the pairs) of two arrays of times. Nulls in arrays are left out, and the order doesn't matter."""
    import pyarrow as pa

    schema = T.StructType([*(df.schema[c] for c in keep), *T.StructType.fromDDL("n_ref bigint, n_found bigint, hits bigint, shift double").fields])
    k = len(keep)
    clean = lambda c: F.array_sort(F.filter(F.coalesce(F.col(c).cast("array<double>"), F.array().cast("array<double>")), lambda x: x.isNotNull()))

    def run(batches):
        for batch in batches:
            rows = [(len(r), len(f), *match_times(r, f, tolerance)) for r, f in zip(batch.column(k).to_pylist(), batch.column(k + 1).to_pylist())]
            columns = list(zip(*rows)) if rows else [()] * 4
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in range(k)), *(pa.array(list(c), t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.float64())))], names=schema.names)

    return df.select(*keep, clean(reference).alias("__r"), clean(found).alias("__f")).mapInArrow(run, schema)


def boundary_rates(hits: DataFrame, *by: str) -> DataFrame:
    """hit_rate (of the reference's boundaries), precision (of the found ones) and mean_shift of the pairs, by group and over all."""
    out = hits.rollup(*by).agg(F.sum("n_ref").alias("n_ref"), F.sum("n_found").alias("n_found"), F.sum("hits").alias("hits"), F.sum("shift").alias("shift"))
    rate = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b))
    return out.select(*by, "n_ref", "n_found", "hits", rate("hits", "n_ref").alias("hit_rate"), rate("hits", "n_found").alias("precision"), rate("shift", "hits").alias("mean_shift"))


def boundary_shift(reference: Column, found: Column) -> Column:
    """Summed distance of the starts and ends of equally many words, arrays of (text, start_time, end_time); null where the numbers differ. Divided by twice the words, over
    all rows, it is the accumulated average shift."""
    apart = lambda a, b: F.abs(a["start_time"] - b["start_time"]) + F.abs(a["end_time"] - b["end_time"])
    both = lambda r, f: F.when(F.size(r) == F.size(f), F.aggregate(F.zip_with(r, f, apart), F.lit(0.0), lambda a, x: a + x))
    return let(reference, lambda r: let(found, lambda f: both(r, f)))


def curve_points(df: DataFrame, score: str, truth: str, *by: str) -> DataFrame:
    """A row for each distinct score of a group: positives and negatives with it (pos, neg), and with it or a higher one (tp, fp). Rows without score or truth don't
    count; a NaN is the highest score."""
    rows = df.where(F.col(score).isNotNull() & F.col(truth).isNotNull())
    points = rows.groupBy(*by, F.col(score).alias("score")).agg(F.count_if(F.col(truth) == 1).alias("pos"), F.count_if(F.col(truth) != 1).alias("neg"))
    out = running_totals(points, list(by), [F.desc("score")], ["pos", "neg"])
    return out.withColumnsRenamed({"running_pos": "tp", "running_neg": "fp"})


def curve_metrics(points: DataFrame, *by: str, precision: float = 0.9) -> DataFrame:
    """Of each group's curve: positives, negatives, auroc (ties count half), auprc (precision summed over the steps of recall), and the highest recall among
    thresholds that reach the precision (null if none does). Areas of the ROC curve are summed as whole numbers."""
    reach = F.when(F.col("tp") >= precision * (F.col("tp") + F.col("fp")), F.col("tp"))
    area = F.col("neg").cast("decimal(18,0)") * (2 * F.col("tp") - F.col("pos")).cast("decimal(18,0)")
    sums = points.groupBy(*by).agg(
        F.sum("pos").alias("positives"), F.sum("neg").alias("negatives"), F.sum(area).alias("__area"), F.sum(F.col("pos") * F.col("tp") / (F.col("tp") + F.col("fp"))).alias("__steps"), F.max(F.when(F.col("tp") > 0, reach)).alias("__reach")
    )
    p, n = F.col("positives"), F.col("negatives")
    return sums.select(
        *by, "positives", "negatives", F.when((p > 0) & (n > 0), F.col("__area").cast("double") / 2 / p / n).alias("auroc"), F.when(p > 0, F.col("__steps") / p).alias("auprc"), F.when(p > 0, F.col("__reach") / p).alias("recall_at_precision")
    )
