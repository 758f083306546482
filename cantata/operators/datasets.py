"""Training rows, metrics and checkpoints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cantata.functions.text import checkpoint_step, default_if_blank, label_id, turn_label

IGNORED = -100


def prepare_turns(df: DataFrame, default_prompt: str, left_ms: float, right_ms: float) -> DataFrame:
    """Turn rows as the trainer takes them; only these columns stay. A label that isn't allowed is an error."""
    number = lambda c, d: F.coalesce(F.col(c).cast("double"), F.lit(float(d)))
    return df.select(
        "audio",
        label_id(turn_label(F.col("label"), strict=True)).alias("label_id"),
        default_if_blank(F.col("prompt"), F.lit(default_prompt)).alias("prompt_text"),
        F.col("cut_time_ms").cast("double").alias("cut_time_ms"),
        number("left_context_ms", left_ms).alias("left_context_ms"),
        number("right_context_ms", right_ms).alias("right_context_ms"),
    )


def prepare_transcripts(df: DataFrame, prefix: Column, keep: tuple[str, ...] = ()) -> DataFrame:
    """Transcript rows: kept columns, prompt, audio, target and the text before the target."""
    return df.select(*keep, F.coalesce("prompt", F.lit("")).alias("prompt"), "audio", F.col("text").alias("target"), prefix.alias("prefix_text"))


def full_text(prefix: Column, target: Column, end: str) -> Column:
    return F.concat(prefix, target, F.lit(end))


def masked_labels(ids: Column, prefix: Column, pad: int) -> Column:
    """Labels of a token array: the prefix's places and padding don't count."""
    return F.transform(ids, lambda x, i: F.when((i < prefix) | (x == pad), F.lit(IGNORED)).otherwise(x))


def binary_metrics(df: DataFrame, predicted: str, truth: str) -> DataFrame:
    """accuracy, precision, recall and F1 of the class 1, as one row. Without rows the accuracy is 0."""
    both = lambda p, t: F.count_if((F.col(predicted) == p) & (F.col(truth) == t))
    counts = df.agg(both(1, 1).alias("tp"), both(1, 0).alias("fp"), both(0, 1).alias("fn"), F.count_if(F.col(predicted) == F.col(truth)).alias("hit"), F.count("*").alias("n"))
    one = F.lit(1)
    out = counts.select(
        (F.col("hit") / F.greatest("n", one)).alias("accuracy"), (F.col("tp") / F.greatest(one, F.col("tp") + F.col("fp"))).alias("precision"), (F.col("tp") / F.greatest(one, F.col("tp") + F.col("fn"))).alias("recall")
    )
    return out.withColumn("f1", 2 * F.col("precision") * F.col("recall") / F.greatest(F.lit(1e-8), F.col("precision") + F.col("recall")))


def checkpoints(df: DataFrame, name: str) -> DataFrame:
    """df with step, rows that name a checkpoint only."""
    return df.withColumn("step", checkpoint_step(F.col(name))).where("step is not null")


def latest_checkpoint(df: DataFrame, key: str, name: str) -> DataFrame:
    return checkpoints(df, name).groupBy(key).agg(F.max("step").alias("step"), F.max_by(name, "step").alias(name))


def retained_checkpoints(df: DataFrame, key: str, name: str, most: int) -> DataFrame:
    newest = Window.partitionBy(key).orderBy(F.desc("step"))
    return checkpoints(df, name).withColumn("age", F.row_number().over(newest)).where(F.col("age") <= most)


def corpus_statistics(df: DataFrame, by: str, size: str) -> DataFrame:
    """Rows, total and mean size by group, and over all (group null)."""
    return df.rollup(by).agg(F.count("*").alias("n"), F.sum(size).alias("total"), F.avg(size).alias("mean"))


def group_split(key: Column, validation_percent: int) -> Column:
    """train or validation by a hash of the group's key, so a group never lies in both. The hash is arithmetic on its code points."""
    spread = F.aggregate(F.split(key, ""), F.lit(7).cast("bigint"), lambda a, c: F.when(c == "", a).otherwise((a * 31 + F.ascii(c)) % 1000003))
    return F.when(spread % 100 < validation_percent, "validation").otherwise("train")
