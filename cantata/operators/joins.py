"""Joins that hold when one key has a good part of all rows, and running totals over partitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cantata.storage import Scratch

#: Bytes up to which a counted table is broadcast.
SMALL = 32 << 20
#: A key that more than one in so many rows have is frequent; there can't be more frequent keys than this.
FREQUENT = 10_000


def small_side(df: DataFrame, rows: int, row_bytes: int) -> DataFrame:
    """df with a broadcast hint if its counted rows stay under the limit; else as it is, for a shuffled join."""
    return F.broadcast(df) if rows * row_bytes <= SMALL else df


def lookup(left: DataFrame, right: DataFrame, key: str, value: str, weight: str, row_bytes: int = 100) -> DataFrame:
    """left with `value` of right's row of its key, null where there is none. right has a row a key, with the number of left's rows that have it
    (`weight`), and is read three times, so it should be a written table. If right is small it is broadcast; else only its frequent keys are,
    and left's rows with these take part in the shuffle under random keys."""
    rows = right.count()
    if rows * row_bytes <= SMALL:
        return left.join(F.broadcast(right.select(key, value)), key, "left")
    total = right.agg(F.sum(weight)).first()[0]
    frequent = F.col(weight) > total // FREQUENT
    often = right.where(frequent).select(key, F.col(value).alias("__often"), F.lit(True).alias("__found"))
    rare = right.where(~frequent).select(F.col(key).alias("__key"), F.col(value).alias("__rare"))
    asked = left.join(F.broadcast(often), key, "left")
    own = F.when(F.col("__found"), F.concat(F.lit("\0"), F.uuid())).otherwise(F.col(key).cast("string"))
    answered = asked.withColumn("__own", own).join(rare.withColumn("__key", F.col("__key").cast("string")), F.col("__own") == F.col("__key"), "left")
    return answered.select(*left.columns, F.coalesce("__often", "__rare").alias(value))


def running_totals(df: DataFrame, by: list[str], order: list[Column], sums: list[str]) -> DataFrame:
    """df with running_<x> for each x of sums: its sum over the rows of the same group up to this one. Rows are range-partitioned by group and order and
    written once; partitions add up their own rows, and what the partitions before have of a group is added: a group may be as large as the
    table, and there may be no group at all. Rows of equal order come in any order."""
    spark = df.sparkSession
    groups = [F.col(c) for c in by]
    parts = Scratch(spark).keep(df.repartitionByRange(*groups, *order).withColumn("__p", F.spark_partition_id()), "ranges")
    pieces = parts.groupBy("__p", *by).agg(*(F.sum(x).alias(f"__{x}") for x in sums))
    before = Window.partitionBy(*by, F.lit(0)).orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)  # a row a partition
    pieces = Scratch(spark).keep(pieces.select("__p", *by, *(F.coalesce(F.sum(f"__{x}").over(before), F.lit(0)).alias(f"__{x}") for x in sums)), "pieces")
    pieces = pieces.select(F.col("__p").alias("__q"), *(F.col(c).alias(f"__by_{c}") for c in by), *(f"__{x}" for x in sums))
    here = Window.partitionBy("__p", *by).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = parts.select("*", *(F.sum(x).over(here).alias(f"__here_{x}") for x in sums))
    same = [F.col("__p") == F.col("__q"), *(F.col(c).eqNullSafe(F.col(f"__by_{c}")) for c in by)]
    out = out.join(small_side(pieces, pieces.count(), 100), same)
    return out.select(*df.columns, *((F.col(f"__here_{x}") + F.col(f"__{x}")).alias(f"running_{x}") for x in sums))
