"""Word times: repair, pairing with words, shifting, and merging the chunks of a request."""

from __future__ import annotations

from bisect import bisect_right

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cantata.functions.text import is_blank, let, strip
from cantata.operators.chunking import with_positions

#: Longest anomaly that copies its neighbours; longer ones are interpolated.
SHORT_ANOMALY = 2


def rising_places(times: list[int]) -> list[int]:
    """Places of a longest non-decreasing subsequence. Of several, the one that ends first; and of the predecessors that make an
    element's length, the first. By patience sorting, n log n."""
    tails: list[int] = []  # least last value of a subsequence of each length
    length = []
    for t in times:
        k = bisect_right(tails, t)
        tails[k : k + 1] = [t]
        length.append(k + 1)
    at = length.index(max(length)) if times else -1
    # For each length, places with that length come with falling values, so the first predecessor is the first that isn't larger.
    by_length: dict[int, list[int]] = {}
    for i, n in enumerate(length):
        by_length.setdefault(n, []).append(i)
    out = []
    while at >= 0:
        out.append(at)
        before = by_length.get(length[at] - 1, [])
        lo, hi = 0, len(before)
        while lo < hi:  # the first whose value isn't larger
            mid = (lo + hi) // 2
            if times[before[mid]] <= times[at]:
                hi = mid
            else:
                lo = mid + 1
        at = before[lo] if before else -1
    return out[::-1]


def repair(times: list[int] | None) -> list[int] | None:
    """Times made non-decreasing: those outside a longest rising subsequence are replaced. Up to SHORT_ANOMALY in a row take the
    nearer good neighbour (the left one of equals), more are interpolated; at a border the one neighbour counts. Null stays
    null, and no times stay none."""
    if not times:
        return times
    good = rising_places(times)
    out: list[float] = list(times)
    for left, right in zip([None, *good], [*good, None]):
        a, b = -1 if left is None else left, len(times) if right is None else right
        run = b - a - 1
        for i in range(a + 1, b):
            if left is None or right is None:
                out[i] = times[right if left is None else left]
            elif run <= SHORT_ANOMALY:
                out[i] = times[left] if i - left <= right - i else times[right]
            else:
                out[i] = times[left] + (times[right] - times[left]) / (run + 1) * (i - left)
    return [int(x) for x in out]


def repair_times(df: DataFrame, times: str, out: str) -> DataFrame:
    """df with the repaired times in a column, an array of integers."""
    @F.pandas_udf("array<bigint>")
    def repaired(column: pd.Series) -> pd.Series:
        return column.map(lambda x: None if x is None else repair([int(v) for v in x]))

    return df.withColumn(out, repaired(F.col(times).cast("array<bigint>")))


def pair_words(words: Column, times_ms: Column) -> Column:
    """Word i with times 2i and 2i + 1, in seconds rounded to milliseconds."""

    def paired(t: Column) -> Column:
        seconds = lambda i: F.round(F.get(t, i) / 1000.0, 3)
        return F.transform(words, lambda w, i: F.struct(w.alias("text"), seconds(2 * i).alias("start_time"), seconds(2 * i + 1).alias("end_time")))

    return let(times_ms, paired)


def shift(items: Column, offset_sec: Column) -> Column:
    moved = lambda t: F.round(t + offset_sec, 3)
    return F.transform(items, lambda x: F.struct(x["text"].alias("text"), moved(x["start_time"]).alias("start_time"), moved(x["end_time"]).alias("end_time")))


def worth_aligning(df: DataFrame, text: str) -> DataFrame:
    return df.where(~is_blank(F.col(text)))


def in_order(value: Column, order: Column) -> Column:
    """Aggregate: values in their order, whatever the partitions."""
    return F.transform(F.array_sort(F.collect_list(F.struct(order.alias("o"), value.alias("v")))), lambda x: x["v"])


def merged_text(text: Column, order: Column) -> Column:
    """Aggregate: texts of the chunks, without a separator."""
    return F.array_join(in_order(F.coalesce(text, F.lit("")), order), "")


def merged_languages(language: Column, order: Column) -> Column:
    """Aggregate: languages of the chunks, blank ones left out and then equal neighbours, comma-joined."""
    named = lambda all_: F.filter(F.transform(all_, lambda x: strip(F.coalesce(x, F.lit("")))), lambda x: x != "")
    changes = lambda names: F.filter(F.transform(names, lambda x, i: F.when((i == 0) | (x != F.get(names, i - 1)), x)), lambda x: x.isNotNull())
    return F.array_join(let(let(in_order(language, order), named), changes), ",")


def merged_items(items: Column, order: Column) -> Column:
    """Aggregate: word times of the chunks; null where none has any."""
    all_ = F.flatten(in_order(F.coalesce(items, F.array().cast("array<struct<text:string,start_time:double,end_time:double>>")), order))
    return F.when(F.size(all_) > 0, all_)


def merge_languages_rows(df: DataFrame, key: str, order: str, language: str) -> DataFrame:
    """The same from rows, for groups of any length: rows are numbered over all groups, and each is compared with the one before it by a
    join on the number, so no group comes together before equal neighbours have gone. Groups without a language keep their row, with the empty string."""
    named = df.select(key, order, strip(F.coalesce(F.col(language), F.lit(""))).alias("l")).where("l != ''")
    placed = with_positions(named.withColumn("__o", F.struct(key, order)), "__o", "__at").drop("__o")
    before = placed.select((F.col("__at") + 1).alias("__at"), F.col(key).alias("__key"), F.col("l").alias("b"))
    kept = placed.join(before, "__at", "left").where(F.col("b").isNull() | ~F.col(key).eqNullSafe(F.col("__key")) | (F.col("b") != F.col("l"))).groupBy(key).agg(F.array_join(in_order(F.col("l"), F.col(order)), ",").alias("languages"))
    every = df.select(F.col(key).alias("__key")).distinct().join(kept, F.col("__key").eqNullSafe(F.col(key)), "left")
    return every.select(F.col("__key").alias(key), F.coalesce("languages", F.lit("")).alias("languages"))
