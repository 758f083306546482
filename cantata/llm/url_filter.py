"""Operator 5: URL filters by hashed host-suffix and path-prefix expressions.

A URL's host gives its suffixes at label borders, its path the prefixes of the lengths that rules have; each pair is an expression.
Expressions meet rules in an equi-join on the first digits of a digest; the full digest is confirmed after the join, and of the
rules that fit the longest decides. A rule table of a checked size is broadcast. A larger one is joined with the distinct
expressions, so an expression that a third of the URLs share enters that join once; what is found goes back to the URLs by a salted join.

Defined cases: a null URL, or one without "://", has an empty host and path and meets no rule. An empty host meets none. Rules with a
null host or path aren't used; a repeated rule counts once. Of rules of equal length the one with the longer host decides, then
"block". Repeated rows are judged one by one; a URL has an expression for each label of its host and each length of a rule's path, however long it is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cantata.llm.common import salted_join, small_side

#: Hexadecimal digits of the digest that the join compares.
SHORT = 8
ALLOW, BLOCK = "allow", "block"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, url.substr(at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    raw = F.regexp_extract(rest, "^[^/?#]*", 0)
    return F.translate(raw, _UPPER, _UPPER.lower()), F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def expressions(host: Column, path: Column, lengths: list[int]) -> Column:
    """Every host suffix with every path prefix of these lengths."""
    labels = F.split(host, r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    prefixes = F.filter(F.array(*(F.when(F.length(path) >= n, path.substr(1, n)) for n in lengths)), lambda p: p.isNotNull())
    pairs = F.flatten(F.transform(suffixes, lambda s: F.transform(prefixes, lambda p: F.concat(s, p))))
    return F.when(host != "", F.array_distinct(pairs)).otherwise(F.array().cast("array<string>"))


def match(urls: DataFrame, rules: DataFrame, url_col: str = "url", keep: tuple[str, ...] = ("page_id",), default: str = ALLOW, limit: int = 32 << 20) -> DataFrame:
    """One row a row: the kept columns, host, path, rule (host and path of the rule that decides, or null) and verdict.

    rules: host, path, action (allow or block)."""
    spark = urls.sparkSession
    known = rules.where("host is not null and path is not null").groupBy(F.translate("host", _UPPER, _UPPER.lower()).alias("host"), "path").agg(F.max("action").alias("action"))
    lengths = [r.n for r in known.select(F.length("path").alias("n")).distinct().collect()]
    rule = F.concat("host", "path")
    digest = F.sha2(rule, 256)
    known = known.select(rule.alias("rule"), "action", digest.alias("digest"), F.substring(digest, 1, SHORT).alias("short"), F.length(rule).alias("size"), F.length("host").alias("host_size"))
    count = known.count()

    host, path = host_and_path(F.col(url_col).cast("string"))
    df = urls.select(*(F.col(c).alias(f"__k{i}") for i, c in enumerate(keep)), host.alias("host"), path.alias("path"), F.monotonically_increasing_id().alias("row"))
    kept = [f"__k{i}" for i in range(len(keep))]
    spread = df.select("row", *kept, "host", "path", F.explode_outer(expressions(F.col("host"), F.col("path"), lengths) if lengths else F.array().cast("array<string>")).alias("expression"))

    def meet(left: DataFrame, how: str) -> DataFrame:
        d = F.sha2("expression", 256)
        left = left.withColumns({"d": d, "s": F.substring(d, 1, SHORT)})
        return left.join(small_side(known, count, 400, limit), (F.col("s") == F.col("short")) & (F.col("d") == F.col("digest")), how)

    best = F.struct("size", "host_size", "action", "rule")
    if count * 400 <= limit:
        met = meet(spread, "left")
    else:
        found = meet(spread.select("expression").where("expression is not null").distinct(), "inner").select("expression", "size", "host_size", "action", "rule")
        met = salted_join(spread, found, "expression", "row", "left")
    out = met.groupBy("row").agg(*(F.first(c).alias(c) for c in kept), F.first("host").alias("host"), F.first("path").alias("path"), F.max(F.when(F.col("rule").isNotNull(), best)).alias("best"))
    return out.select(*(F.col(k).alias(c) for k, c in zip(kept, keep)), "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.action", F.lit(default)).alias("verdict"))


def rule_table(spark, rules: list[tuple[str, str, str]]) -> DataFrame:
    return spark.createDataFrame(rules, "host string, path string, action string")
