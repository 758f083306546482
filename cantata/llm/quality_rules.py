"""Operator 1: quality rules, a learned decision list.

Text statistics are Spark expressions over one row. Rules are learned by sequential covering: a rule grows, one threshold
condition at a time, by the information it gains on two thirds of the labelled rows; then conditions come off its end as
long as that helps on the last third; the rows it covers are set aside, and the next rule begins. Every step reads counts
by feature and bin from one aggregate, so the driver sees tables of features times bins and never rows. The list becomes
one ordered conditional expression.

All steps are DataFrame operations. Statistics are computed once and written to the shared folder.

Defined cases: a null or empty text has statistics 0, too few words, and fails the base rules. Rows are judged one by one, whole
however long they are, with memory in proportion to a text's words.
Labels that are null, or whose id has no document, aren't used; an id labelled twice counts with its smallest label. Without
labels of both kinds the list is empty and everything that passes the base rules stays.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from math import log2

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cantata.llm.common import Scratch, input_bytes

WINDOW = 5
MIN_WORDS = 10
#: 100 * share of words in repeated windows.
MAX_REPEAT = 20
#: Thresholds tried for a feature.
BINS = 24
#: Of the rows that a rule covers, at least this share must be bad, on the rows for pruning.
LEAST_PRECISION = 0.8
#: Rows for growing that a rule must cover.
LEAST_COVER = 4

GAP = r"[\x20\x09-\x0D]+"


def let(value: Column, body) -> Column:
    """body(value) with the value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def split_words(text: Column) -> Column:
    return F.filter(F.split(text, GAP), lambda w: w != "")


def repeated_words(words: Column, size: int = WINDOW) -> Column:
    """Words in windows of `size` words that stand twice or more in the array."""

    def windows(w: Column) -> Column:
        n = F.size(w)
        return F.when(n >= size, F.transform(F.sequence(F.lit(0), n - size), lambda i: F.xxhash64(*(F.get(w, i + k) for k in range(size))))).otherwise(F.array().cast("array<bigint>"))

    def covered(h: Column) -> Column:
        ordered = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

        def twice(s: Column) -> Column:
            same = lambda x, k: F.coalesce(F.get(s, k)["h"] == x["h"], F.lit(False))
            kept = F.transform(s, lambda x, k: F.when(same(x, k - 1) | same(x, k + 1), x["i"]))
            return F.sort_array(F.filter(kept, lambda i: i.isNotNull()))

        start = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n"))
        step = lambda a, i: F.struct((i + size).alias("end"), (a["n"] + i + size - F.greatest(i, a["end"])).alias("n"))
        return F.aggregate(let(ordered, twice), start, step, lambda a: a["n"])

    return let(let(words, windows), lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(covered(h)))


#: Features that rules may use, from the statistics.
FEATURES = ("n_words", "word_length", "symbols", "dup_lines", "repeats", "distinct", "capitals", "digits", "exclaims", "bars")


def statistics(docs: DataFrame, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The kept columns, the counts of the base rules, base_failed, and the features."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    count = lambda pattern: F.regexp_count(F.col("__text"), F.lit(pattern))

    def measured(w: Column) -> Column:
        return F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
            F.size(F.array_distinct(w)).cast("long").alias("n_distinct"),
            repeated_words(w).alias("n_repeat_words"),
        )

    df = docs.select(*keep, text.alias("__text"))
    df = df.select(
        *keep,
        let(split_words(F.col("__text")), measured).alias("__m"),
        count("[#*$%&|<>]").cast("long").alias("n_symbols"),
        let(F.filter(F.split("__text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")), lambda x: F.struct(F.size(x).alias("lines"), (F.size(x) - F.size(F.array_distinct(x))).alias("dup"))).alias("__l"),
        (F.length("__text") - F.length(F.regexp_replace("__text", "[A-Z]+", ""))).alias("__capitals"),
        count("[0-9]").alias("__digits"),
        count("!").alias("__exclaims"),
        count(r"\|").alias("__bars"),
    )
    n, chars = F.greatest(F.col("n_words"), F.lit(1)), F.greatest(F.col("word_chars"), F.lit(1))
    df = df.select(*keep, "__m.*", "n_symbols", F.col("__l.dup").cast("long").alias("n_dup_lines"), F.col("__l.lines").alias("__lines"), "__capitals", "__digits", "__exclaims", "__bars")
    return df.select(
        *keep,
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        ((F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT * F.col("n_words"))).alias("base_failed"),
        F.struct(
            F.col("n_words").cast("double").alias("n_words"),
            (F.col("word_chars") / n).alias("word_length"),
            (F.col("n_symbols") / n).alias("symbols"),
            (F.col("n_dup_lines") / F.greatest(F.col("__lines"), F.lit(1))).alias("dup_lines"),
            (F.col("n_repeat_words") / n).alias("repeats"),
            (F.col("n_distinct") / n).alias("distinct"),
            (F.col("__capitals") / chars).alias("capitals"),
            (F.col("__digits") / chars).alias("digits"),
            (F.col("__exclaims") / n).alias("exclaims"),
            (F.col("__bars") / n).alias("bars"),
        ).alias("features"),
    )


@dataclass
class Condition:
    feature: str
    above: bool
    threshold: float

    def expression(self, features: Column) -> Column:
        return features[self.feature] > self.threshold if self.above else features[self.feature] <= self.threshold

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.threshold:g}"


@dataclass
class Rule:
    conditions: list[Condition] = field(default_factory=list)

    def expression(self, features: Column) -> Column:
        out = F.lit(True)
        for c in self.conditions:
            out = out & c.expression(features)
        return out

    def __str__(self) -> str:
        return " and ".join(map(str, self.conditions))


def _thresholds(rows: DataFrame) -> dict[str, list[float]]:
    """Quantiles of each feature, of all rows and of the bad ones."""
    share = [k / (BINS // 2) for k in range(BINS // 2 + 1)]
    aggregates = [F.percentile_approx(F.when(which, F.col("features")[f]), share, 2000).alias(f"{f}:{name}") for f in FEATURES for name, which in (("all", F.lit(True)), ("bad", F.col("bad")))]
    got = rows.agg(*aggregates).first().asDict()
    return {f: sorted({float(x) for name in ("all", "bad") for x in got[f"{f}:{name}"] or ()}) for f in FEATURES}


def _binned(rows: DataFrame, cuts: dict[str, list[float]]) -> DataFrame:
    """One row a labelled row and feature would be wide; bins go as an array, features in order."""
    place = lambda f: F.size(F.filter(F.array(*(F.lit(x) for x in cuts[f])), lambda t: F.col("features")[f] > t)) if cuts[f] else F.lit(0)
    return rows.select("bad", "prune", F.array(*(place(f) for f in FEATURES)).alias("bins"))


def _counts(rows: DataFrame) -> dict:
    """(feature, bin, prune) to (bad, good)."""
    table = rows.select("bad", "prune", F.posexplode("bins").alias("f", "bin")).groupBy("f", "bin", "prune").agg(F.count_if("bad").alias("p"), F.count_if(~F.col("bad")).alias("n")).collect()
    return {(r.f, r.bin, r.prune): (r.p, r.n) for r in table}


def _gain(p: int, n: int, p0: int, n0: int) -> float:
    return p * (log2(p / (p + n)) - log2(p0 / (p0 + n0))) if p else 0.0


def _rows_of(c: tuple[int, int, bool]) -> Column:
    """Condition on bins: (feature's place, cut's place, above). Bin b holds values above b cuts."""
    f, k, above = c
    return F.get("bins", F.lit(f)) > k if above else F.get("bins", F.lit(f)) <= k


def learn(labelled: DataFrame, scratch: Scratch, size: int, max_rules: int | None = None, max_conditions: int | None = None) -> list[Rule]:
    """labelled: features and bad, of a table whose input has so many bytes. The rules, in order, each a conjunction that marks bad rows. A rule grows until no condition
    gains anything, and the list until no rule is precise enough; max_rules and max_conditions stop them earlier."""
    rows = labelled.select("features", "bad", (F.pmod(F.xxhash64("features"), F.lit(3)) == 0).alias("prune"))
    cuts = _thresholds(rows)
    rest = scratch.keep(_binned(rows, cuts), "binned", size)
    rules: list[Rule] = []
    while max_rules is None or len(rules) < max_rules:
        conditions: list[tuple[int, int, bool]] = []
        trail: list[tuple[int, int]] = []  # (bad, good) for pruning after each condition
        inside = rest
        while max_conditions is None or len(conditions) < max_conditions:
            counts = _counts(inside)
            p0, n0 = (sum(v[i] for (f, _, prune), v in counts.items() if f == 0 and not prune) for i in (0, 1))
            if not p0 or not n0:
                break
            best, gain = None, 1e-9
            for f, name in enumerate(FEATURES):
                p = n = 0
                for k in range(len(cuts[name])):
                    a, b = counts.get((f, k, False), (0, 0))
                    p, n = p + a, n + b
                    for above, (x, y) in ((False, (p, n)), (True, (p0 - p, n0 - n))):
                        if x + y >= LEAST_COVER and (g := _gain(x, y, p0, n0)) > gain:
                            best, gain = (f, k, above), g
            if best is None:
                break
            f, k, above = best
            conditions.append(best)
            side = [v for (g, b, prune), v in counts.items() if g == f and prune and (b > k) == above]
            trail.append((sum(v[0] for v in side), sum(v[1] for v in side)))
            inside = inside.where(_rows_of(best))
        if not conditions:
            break
        worth = lambda pn: (pn[0] - pn[1]) / (pn[0] + pn[1]) if sum(pn) else -1.0
        most = max(range(1, len(conditions) + 1), key=lambda s: (worth(trail[s - 1]), -s))
        p, n = trail[most - 1]
        if p + n == 0 or p < LEAST_PRECISION * (p + n):
            break
        conditions = conditions[:most]
        rules.append(Rule([Condition(FEATURES[f], above, cuts[FEATURES[f]][k]) for f, k, above in conditions]))
        covered = F.lit(True)
        for c in conditions:
            covered = covered & _rows_of(c)
        rest = rest.where(~covered)
    return rules


def verdict(rules: list[Rule], features: Column) -> Column:
    """False for rows that a rule marks; the rules in order."""
    out = None
    for r in rules:
        out = F.when(r.expression(features), False) if out is None else out.when(r.expression(features), False)
    return F.lit(True) if out is None else out.otherwise(True)


def judge(docs: DataFrame, labels: DataFrame, text_col: str = "text", id_col: str = "doc_id", max_rules: int | None = None, max_conditions: int | None = None) -> DataFrame:
    """One row a document: its id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept and rule
    (the number of the first rule that marks it, or null)."""
    scratch = Scratch(docs.sparkSession)
    size = input_bytes(docs)
    measured = scratch.keep(statistics(docs, text_col, (id_col,)), "statistics", size)
    known = labels.where(f"{id_col} is not null and quality is not null").groupBy(id_col).agg((F.min("quality") <= 0).alias("bad"))
    rules = learn(measured.where(~F.col("base_failed")).join(known, id_col).select("features", "bad"), scratch, size, max_rules, max_conditions)
    number = F.lit(None).cast("int")
    for k, r in reversed(list(enumerate(rules, 1))):
        number = F.when(r.expression(F.col("features")), k).otherwise(number)
    kept = F.when(F.col("base_failed"), False).otherwise(verdict(rules, F.col("features")))
    return measured.select(id_col, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"), F.when(~F.col("base_failed"), number).alias("rule"))
