"""Splits that don't leak: rows that share a recording or a speaker, directly or through others, stay together."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cantata.operators.joins import lookup, running_totals
from cantata.storage import Scratch

#: Shares are whole numbers out of so many; a group with more than one part of all weight is dealt with by itself.
PARTS = 1000


def _stars(edges: DataFrame, scratch: Scratch, name: str, large: bool) -> DataFrame:
    """One step: of each vertex's neighbours the larger ones (large) or the smaller ones and itself are tied to the smallest of all of them."""
    seen = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges
    least = scratch.keep(seen.groupBy("u").agg(F.min("v").alias("low"), F.count("*").alias("n")), f"{name}-low")
    tied = lookup(seen, least, "u", "low", "n").withColumn("low", F.least("u", "low"))
    out = tied.where("v > u").select(F.col("v").alias("u"), F.col("low").alias("v")) if large else tied.select(F.col("v").alias("u"), F.col("low").alias("v")).unionByName(tied.select("u", F.col("low").alias("v")))
    return scratch.keep(out.where("u != v").distinct(), name)


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(vertex, component): the smallest vertex that each can be reached from. edges: u, v of a type with an order. Rounds of large and small stars, whose number is
    logarithmic in practice; the smallest neighbours of hot vertices are broadcast, and no vertex's neighbours are gathered."""
    both = edges.where("u is not null and v is not null")
    alone = both.select(F.col("u").alias("vertex")).unionByName(both.select(F.col("v").alias("vertex"))).distinct()
    now = scratch.keep(both.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges-0")
    mark = lambda e: e.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
    k, last = 0, mark(now)
    while True:
        k += 1
        now = _stars(_stars(now, scratch, f"large-{k}", True), scratch, f"small-{k}", False)
        this = mark(now)
        if this == last:
            break
        last = this
    return alone.join(now.select(F.col("u").alias("vertex"), F.col("v").alias("low")), "vertex", "left").select("vertex", F.coalesce("low", "vertex").alias("component"))


def assign(weights: DataFrame, shares: dict[str, int]) -> DataFrame:
    """Components (component, weight) to splits by shares out of PARTS. The heavy ones, of which there are fewer than PARTS, go one after the other, the heaviest first, to
    the split that lacks most. The others lie in the order of a hash of their name, and are cut where the room that is left in the splits is used up.
    So a split's share is off by the weight of one light component, and by what heavy ones leave no choice about."""
    spark = weights.sparkSession
    total = weights.agg(F.sum("weight")).first()[0] or 0
    heavy = weights.where(F.col("weight") * PARTS > F.lit(total)).orderBy(F.desc("weight"), "component").limit(PARTS).collect()  # fewer than PARTS of them
    names, room = list(shares), [s * total for s in shares.values()]
    chosen = []
    for r in heavy:
        k = max(range(len(names)), key=lambda i: (room[i], -i))
        room[k] -= r.weight * PARTS
        chosen.append((r.component, r.weight, names[k]))
    schema = "component string, weight bigint, split string"
    out = spark.createDataFrame(chosen, schema)
    light = weights.where(F.col("weight") * PARTS <= F.lit(total))
    rest = light.agg(F.sum("weight")).first()[0] or 0
    if not rest:  # what weighs nothing may lie anywhere
        return out.unionByName(light.select("component", "weight", F.lit(names[0]).alias("split")))
    room = [max(0, x) for x in room]
    if not sum(room):
        room = [s for s in shares.values()]
    placed = running_totals(light.withColumn("hash", F.md5("component")), [], [F.asc("hash"), F.asc("component")], ["weight"])
    start = (F.col("running_weight") - F.col("weight")).cast("decimal(38,0)") * sum(room)
    split, used = F.lit(names[-1]), sum(room)
    for name, part in zip(names[::-1], room[::-1]):
        used -= part
        split = F.when(start < F.lit((used + part) * rest).cast("decimal(38,0)"), F.lit(name)).otherwise(split) if part else split
    return out.unionByName(placed.select("component", "weight", split.alias("split")))


def leakage_safe_split(df: DataFrame, keys: list[str], shares: dict[str, int], size: str | None = None) -> DataFrame:
    """df with component and split: rows that have an equal value in one of the key columns are in one component, and a component is in one split. shares: out of PARTS.
    size: a column of whole numbers to balance by, else rows count. A null key ties to nothing; rows without any key are one component, named ''."""
    if sum(shares.values()) != PARTS:
        raise ValueError(f"shares must sum up to {PARTS}")
    scratch = Scratch(df.sparkSession)
    vertex = lambda i, c: F.when(F.col(c).isNotNull(), F.concat(F.lit(f"{i}:"), F.col(c).cast("string")))
    vertices = [vertex(i, c) for i, c in enumerate(keys)]
    first = F.coalesce(*vertices)
    ties = [df.select(first.alias("u"), v.alias("v")).where("v is not null").distinct() for v in vertices]
    edges = ties[0]
    for t in ties[1:]:
        edges = edges.unionByName(t)
    found = scratch.keep(components(edges, scratch), "components")
    asked = scratch.keep(df.select(first.alias("vertex"), (F.col(size) if size else F.lit(1)).cast("bigint").alias("w")).groupBy("vertex").agg(F.sum("w").alias("w"), F.count("*").alias("n")), "asked")
    named = asked.join(found, "vertex", "left").withColumn("component", F.coalesce("component", F.lit("")))
    named = scratch.keep(named, "named")
    weights = scratch.keep(named.groupBy("component").agg(F.sum(F.coalesce("w", F.lit(0))).cast("bigint").alias("weight"), F.sum("n").alias("n")), "weights")
    splits = scratch.keep(assign(weights.select("component", "weight"), shares), "splits")
    both = scratch.keep(named.join(splits.select("component", "split"), "component").select(F.coalesce("vertex", F.lit("")).alias("__vertex"), F.struct("component", "split").alias("__found"), "n"), "both")
    out = lookup(df.withColumn("__vertex", F.coalesce(first, F.lit(""))), both, "__vertex", "__found", "n")
    return out.select(*df.columns, F.col("__found.component").alias("component"), F.col("__found.split").alias("split"))
