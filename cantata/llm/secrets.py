"""Operator 4: secret scans with corpus-wide ownership frequency.

Patterns find candidates in each text; where a pattern matches, splitting the text by it gives the offsets. The hash of each
candidate's value is then counted over the whole corpus by distinct repositories and owners. A value that many owners have is a
widely copied example; one that few have looks live. Besides the base kinds, which always stay, opaque strings (long, with
capitals, small letters and digits) become spans if they look live. All steps are DataFrame operations; only candidates are
shuffled, counts are combined before the shuffle, and texts never move; the counts meet the candidates by a broadcast of checked size, or by a
salted join, as one value may make up a good part of the candidates.

Defined cases: a null or empty text has no spans. A null owner or repository counts as the empty string. Offsets are code points,
ends exclusive. Rows are scanned one by one, whole however long they are, so repeated rows give repeated results (and one owner).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cantata.functions.signal import running_sum
from cantata.llm.common import Scratch, input_bytes, salted_join

#: Kind, pattern, group with the value, characters of that group at least. Fixed values of the base rules; letters of the
#: keywords stand in either case.
KINDS = (
    ("assign", r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 8),
    ("access", r"AKIA[A-Z0-9]{12,}", 0, 16),
    ("hex", r"[0-9a-f]{32,}", 0, 32),
)
#: Kind that the method adds, and what each of its values must hold.
OPAQUE = ("opaque", r"[A-Za-z0-9+/_=-]{24,}", 0, 24)
MIXED = ("[0-9]", "[A-Z]", "[a-z]")
#: Distinct owners from which a value is a widely copied example.
EXAMPLE_OWNERS = 3

_SPANS = "array<struct<start:bigint,rank:int,kind:string,end:bigint,value:string>>"


def spans(text: Column, rank: int, kind: str, pattern: str, group: int, least: int) -> Column:
    """Matches of one kind as (start, rank, kind, end, value), those with too short a value left out."""
    found, value = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.regexp_extract_all(text, F.lit(pattern), F.lit(group))

    def located(m: Column) -> Column:
        between = F.transform(F.split(text, pattern), F.length)
        ends = running_sum(F.zip_with(F.slice(between, 1, F.size(m)), m, lambda gap, x: gap + F.length(x)))
        parts = F.arrays_zip(m.alias("match"), ends.alias("end"), (value if group else m).alias("value"))
        span = lambda x: F.struct((x["end"] - F.length(x["match"])).alias("start"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), x["end"].alias("end"), x["value"].alias("value"))
        return F.filter(F.transform(parts, span), lambda s: F.length(s["value"]) >= least)

    return F.element_at(F.transform(F.array(found), lambda m: F.when(F.size(m) == 0, F.array().cast(_SPANS)).otherwise(located(m))), 1)


def mixed(span: Column) -> Column:
    """Whether the span's whole value has a character of every class."""
    out = F.lit(True)
    for x in MIXED:
        out = out & span["value"].rlike(x)
    return out


def render(rows: Column) -> Column:
    """kind:start:end by start, then kind, comma-joined."""
    ordered = F.sort_array(F.transform(rows, lambda s: F.struct(s["start"], s["rank"], s["end"], s["kind"])))
    return F.array_join(F.transform(ordered, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan(docs: DataFrame, text_col: str = "text", repo_col: str = "doc_id", owner_col: str = "source", keep: tuple[str, ...] = ("doc_id",), example_owners: int = EXAMPLE_OWNERS, limit: int = 32 << 20) -> DataFrame:
    """One row a row: the kept columns and found, an array of (start, rank, kind, end, owners, live): the base kinds, and opaque strings that look live."""
    scratch, size = Scratch(docs.sparkSession), input_bytes(docs)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    kept = [f"__k{i}" for i in range(len(keep))]
    df = docs.select(
        *(F.col(c).alias(k) for k, c in zip(kept, keep)),
        F.monotonically_increasing_id().alias("row"),
        F.coalesce(F.col(repo_col).cast("string"), F.lit("")).alias("repo"),
        F.coalesce(F.col(owner_col).cast("string"), F.lit("")).alias("owner"),
        text.alias("text"),
    )
    base = F.concat(*(spans(F.col("text"), i, *k) for i, k in enumerate(KINDS)))
    df = df.select(*kept, "row", "repo", "owner", base.alias("base"), F.filter(spans(F.col("text"), len(KINDS), *OPAQUE), mixed).alias("more"))
    apart = F.filter("more", lambda m: ~F.exists("base", lambda b: (b["start"] < m["end"]) & (m["start"] < b["end"])))
    hashed = F.transform(F.concat("base", apart), lambda s: F.struct(s["start"], s["rank"], s["kind"], s["end"], F.sha2(s["value"], 256).alias("hash")))
    df = scratch.keep(df.select(*kept, "row", "repo", "owner", hashed.alias("candidates")), "candidates", size)
    spread = df.select("row", "repo", "owner", F.explode("candidates").alias("c")).select("row", "repo", "owner", "c.*")
    owned = spread.groupBy("hash", "owner", "repo").agg(F.count("*").alias("n")).groupBy("hash", "owner").agg(F.count("*").alias("repos"))
    frequency = scratch.keep(owned.groupBy("hash").agg(F.count("*").alias("owners"), F.sum("repos").alias("repos")), "frequency", size)
    live = F.col("owners") < example_owners
    judged = salted_join(spread, frequency, "hash", "row") if frequency.count() * 120 > limit else spread.join(F.broadcast(frequency), "hash")
    judged = judged.where((F.col("rank") < len(KINDS)) | live)
    judged = judged.groupBy("row").agg(F.collect_list(F.struct("start", "rank", "kind", "end", "owners", "repos", live.alias("live"))).alias("found"))
    kind = judged.schema["found"].dataType
    with_some = df.where(F.size("candidates") > 0).select(*kept, "row").join(judged, "row", "left").select(*kept, F.coalesce("found", F.array().cast(kind)).alias("found"))
    without = df.where(F.size("candidates") == 0).select(*kept, F.array().cast(kind).alias("found"))
    return with_some.unionByName(without).select(*(F.col(k).alias(c) for k, c in zip(kept, keep)), F.sort_array("found").alias("found"))


def digest(found: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    base = F.filter("found", lambda s: s["rank"] < len(KINDS))
    count = lambda rank: F.size(F.filter("found", lambda s: s["rank"] == rank)).cast("long")
    return found.select(
        *keep,
        *(count(i).alias(f"n_{k[0]}") for i, k in enumerate(KINDS)),
        F.sha2(render(base), 256).alias("base_sha256"),
        render(F.col("found")).alias("spans"),
        F.size(F.filter("found", lambda s: s["live"])).cast("long").alias("n_live"),
    )
