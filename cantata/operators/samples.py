"""Training samples: cut-off utterances, and checks before training."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass
from decimal import Decimal

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from cantata.functions.text import is_blank, let
from cantata.model import TURN_LABELS
from cantata.operators.joins import running_totals, small_side
from cantata.storage import Scratch

INCOMPLETE, COMPLETE = TURN_LABELS

#: Marks that end a part of a sentence, and fillers before which speakers stop.
PART_ENDS = ",;:，、；："
FILLERS = ("um", "uh", "er", "hm", "well", "and", "but", "so", "嗯", "呃", "那个", "然后", "就是")
#: Seconds between two words that count as a pause.
PAUSE = 0.3
_SPAN = 1 << 32


def spread_cuts(n: Column, id_: Column, per_row: int, seed: str = "") -> Column:
    """Numbers of words, from 1 to n - 1, at which an utterance of n words is cut: one from each of per_row stretches of equal length, by a hash of the id, so
    short and long prefixes are equally frequent. Equal ones of a short utterance count once; one word has no cut."""
    draw = lambda k: F.conv(F.left(F.md5(F.concat(F.lit(f"{seed}:"), id_.cast("string"), F.lit(":"), k.cast("string"))), F.lit(8)), 16, 10).cast("bigint")
    place = lambda k: (F.floor(((k * F.lit(_SPAN) + draw(k)) * (n - 1)).cast("decimal(38,0)") / F.lit(per_row * _SPAN)) + 1).cast("int")
    return F.when(n > 1, F.array_distinct(F.transform(F.sequence(F.lit(0).cast("bigint"), F.lit(per_row - 1).cast("bigint")), place))).otherwise(F.array().cast("array<int>"))


def cut_kind(word: Column, pause: Column) -> Column:
    """What stands at a boundary, for weighting: a filler, the end of a part, a pause, or just a word."""
    plain = F.lower(F.rtrim(word, F.lit(PART_ENDS)))
    return F.when(plain.isin(*FILLERS), "filler").when(F.right(word, F.lit(1)).isin(*PART_ENDS), "part").when(pause >= PAUSE, "pause").otherwise("word")


def truncations(df: DataFrame, id_col: str, items: str, per_row: int = 4, seed: str = "", keep: tuple[str, ...] = ()) -> DataFrame:
    """Samples of a turn detector out of finished utterances, whose words are items (text, start_time, end_time): kept columns, n_words, kind, label, cut_time_ms. Prefixes
    are incomplete, and are cut in the middle of the silence behind their last word; the whole is complete, and is cut where its last word ends. Null or no
    items give no rows. All inside the JVM; rows stay where they are."""

    def cuts(w: Column) -> Column:
        n = F.size(w)
        word = lambda k: F.get(w, k - 1)
        gap = lambda k: F.get(w, k)["start_time"] - word(k)["end_time"]
        cut = lambda k, kind, label, at: F.struct(k.cast("int").alias("n_words"), kind.alias("kind"), F.lit(label).alias("label"), F.round(at * 1000, 3).alias("cut_time_ms"))
        parts = F.transform(spread_cuts(n, F.col(id_col), per_row, seed), lambda k: cut(k, cut_kind(word(k)["text"], gap(k)), INCOMPLETE, word(k)["end_time"] + F.greatest(gap(k), F.lit(0.0)) / 2))
        return F.concat(parts, F.array(cut(n, F.lit("end"), COMPLETE, word(n)["end_time"])))

    return df.where(F.size(items) > 0).select(*keep, F.explode(let(F.col(items), cuts)).alias("__cut")).select(*keep, "__cut.*")


@dataclass(frozen=True)
class Check:
    """A row passes where the condition is true; false and null fail."""

    name: str
    passes: Column


def text_checks(text: str, least: int = 1, most: int = 1 << 20) -> list[Check]:
    c = F.col(text)
    return [Check("blank", ~is_blank(c)), Check("control characters", ~c.rlike(r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]")), Check("length", F.length(c).between(least, most))]


def ratio_bounds(df: DataFrame, by: str, ratio: Column, low: float, high: float, margin: float = 1.0) -> DataFrame:
    """(by, low, high): quantiles of a ratio by group, widened by a factor. They are exact: the smallest value up to which there is at least that share (taken as the decimal
    number it is written as) of the group's values; nulls don't count. Distinct values are counted and added up over range partitions, so a group may hold all rows."""
    scratch = Scratch(df.sparkSession)
    values = scratch.keep(df.select(by, ratio.alias("__value")).groupBy(by, "__value").agg(F.count("__value").alias("__n")), "values")
    totals = values.groupBy(F.col(by).alias("__by")).agg(F.sum("__n").alias("__total"))
    values = values.join(small_side(totals, totals.count(), 100), F.col(by).eqNullSafe(F.col("__by"))).drop("__by")
    ranked = running_totals(values, [by], [F.asc("__value")], ["__n"])
    scratch.drop("values")
    rank = lambda p: F.greatest(F.ceil(F.col("__total").cast("decimal(20,0)") * F.lit(Decimal(str(p)))), F.lit(1))
    at = lambda p: F.min(F.when(F.col("running___n") >= rank(p), F.col("__value")))
    return ranked.groupBy(by).agg((at(low) / margin).alias("low"), (at(high) * margin).alias("high"))


def with_bounds(df: DataFrame, by: str, bounds: DataFrame) -> DataFrame:
    """df with low and high of its group. There is a row a group, and groups are few (languages)."""
    named = bounds.select(F.col(by).alias("__by"), "low", "high")
    return df.join(F.broadcast(named), F.col(by).eqNullSafe(F.col("__by")), "left").drop("__by")


@dataclass(frozen=True)
class Checked:
    """good: rows that pass all checks, as they came. bad: the others, with reasons. counts: rows, and failures by check, gathered while the rows were written."""

    good: DataFrame
    bad: DataFrame
    counts: dict[str, int]


def check_rows(df: DataFrame, checks: Iterable[Check], scratch: Scratch | None = None) -> Checked:
    """Judges each row once; the judged rows are a written table, so good and bad always agree, and the counts are those of what was written."""
    checks = list(checks)
    scratch = scratch or Scratch(df.sparkSession)
    failed = F.filter(F.array(*(F.when(~F.coalesce(c.passes, F.lit(False)), F.lit(c.name)) for c in checks)), lambda x: x.isNotNull())
    seen = Observation()
    judged = df.withColumn("__reasons", failed).observe(seen, F.count("*").alias("rows"), *(F.count_if(F.array_contains("__reasons", c.name)).alias(c.name) for c in checks))
    judged = scratch.keep(judged, "judged")
    good = judged.where(F.size("__reasons") == 0).drop("__reasons")
    bad = judged.where(F.size("__reasons") > 0).withColumnRenamed("__reasons", "reasons")
    return Checked(good, bad, dict(seen.get))


def sketches(df: DataFrame, by: str, value: Column) -> DataFrame:
    """(by, n, sketch): quantile sketches to keep, one a group. Those of several days are merged by merged_sketches()."""
    return df.groupBy(by).agg(F.count(value).alias("n"), F.kll_sketch_agg_double(value.cast("double")).alias("sketch"))


def merged_sketches(df: DataFrame, by: str) -> DataFrame:
    return df.groupBy(by).agg(F.sum("n").alias("n"), F.kll_merge_agg_double("sketch").alias("sketch"))


def sketch_quantile(sketch: str, share: float) -> Column:
    return F.kll_sketch_get_quantile_double(sketch, F.lit(share))
