"""A prefix trie of conversations: what they share from their first turn on, as a table of nodes.

Every conversation is rebuilt first: up to three turns from the first of its family of FAMILY ids, then its own turns after as many. A node is a distinct sequence of
first turns; the conversations that start with it are its members, and the smallest of them owns it. A conversation that owns a node owns all deeper ones of its
own, so its nodes are a chain from a first owned depth to its end, which hangs on a node of another chain. Hence:

1. Turns are range-partitioned, sorted and numbered; conversations that several partitions share go on counting in the next one.
2. Each prefix gets a digest of 128 bits: the exclusive or of the hashes of its turns with their places, a running value that blocks of BLOCK turns compute alone,
   and that is handed on between the blocks of longer conversations.
3. Prefix digests that occur more than once are counted, with their smallest conversation.
4. A binary search over each conversation's depths finds the first it owns: in every round all open conversations ask at once for the minimum of one prefix.
5. The owned chains are the tree. Leaves and saved tokens of whole chains are added up from below by doubling: after k rounds a chain has the sums of those up to 2**k
   chains below, so deep trees take logarithmically many rounds; running sums along each chain, again by blocks, give the nodes' values.

No step gathers a conversation, a prefix or a family in one task: joins have one row a key on at least one side, the frequent keys of lookups (a bounded
number) are broadcast, and sums are combined before the shuffle. Only the ids that end at one node are hashed in one place, as SHA-256 wants bytes in order: they are packed
into texts of PACK ids first, in parallel, and stream by.

Edge cases: rows without a conversation id belong to none. Null roles and texts are empty; a null turn comes first, equal turns in the order of the md5 of role and text.
Repeated rows are turns of their own. A conversation without turns after rebuilding is a member of the root only. No rows give no nodes. Texts are hashed
whole, whatever their length. Two different prefixes agree in their digests with probability 2**-128. Other columns aren't looked at.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cantata.llm.common import Scratch, frugal, small_side

#: A conversation takes its first turns from conversation c - c % FAMILY.
FAMILY = 20
#: Turns that may be taken: one less than this.
HEADS = 4
#: Turns or nodes of a conversation that one task runs over.
BLOCK = 4096
#: Ids that are packed into one text before they are hashed.
PACK = 8192
#: A key that more than one in so many rows share is frequent; there can't be more such keys than this.
FREQUENT = 10_000
#: Bytes up to which a counted side of a join is broadcast.
SMALL = 32 << 20

WORD = r"[^\x20\x09-\x0D]+"
EMPTY = hashlib.sha256(b"").hexdigest()


def turn_digest(role: Column, text: Column) -> Column:
    """md5 of a turn, the role's length in front of it."""
    return F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text))


def _numbered(turns: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(c, p, mark, words): each turn with its place in its conversation; and (c, n), the conversations."""

    def count(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        pid, last, seen = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            c = np.asarray(batch.column(0))
            if not len(c):
                continue
            start = np.r_[True, c[1:] != c[:-1]]
            q = np.arange(len(c)) - np.flatnonzero(start)[np.cumsum(start) - 1]
            if last is not None and c[0] == last:
                first = int(np.argmax(start[1:])) + 1 if start[1:].any() else len(c)
                q[:first] += seen
            last, seen = c[-1], int(q[-1]) + 1
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.full(len(c), pid), pa.int32()), pa.array(q, pa.int64()), batch.column(2), batch.column(3)], names=["c", "pid", "q", "mark", "words"])

    # One range shuffle of narrow rows: texts stay where they are.
    dealt = turns.repartitionByRange("c", "t", "mark").sortWithinPartitions("c", "t", "mark")
    dealt = scratch.keep(dealt.select("c", "t", "mark", "words").select("c", F.lit(0).alias("_"), "mark", "words").mapInArrow(frugal(count), "c bigint, pid int, q bigint, mark binary, words bigint"), "numbered")
    pieces = dealt.groupBy("pid", "c").agg(F.count("*").alias("n"))
    mine = Window.partitionBy("c")  # as many rows as partitions at most
    before = F.coalesce(F.sum("n").over(mine.orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    pieces = scratch.keep(pieces.select("pid", "c", before.alias("before"), F.sum("n").over(mine).alias("n")), "pieces")
    later = F.broadcast(pieces.where("before > 0").select("pid", "c", "before"))  # one a partition at most
    ranked = dealt.join(later, ["pid", "c"], "left").select("c", (F.col("q") + F.coalesce("before", F.lit(0))).alias("p"), "mark", "words")
    return ranked, pieces.where("before = 0").select("c", "n")


def _place_hashes(place: Column, mark: Column) -> tuple[Column, Column]:
    return F.xxhash64(F.lit(1), place.cast("bigint"), mark), F.xxhash64(F.lit(2), place.cast("bigint"), mark)


def _conversations(ranked: DataFrame, sizes: DataFrame, scratch: Scratch) -> DataFrame:
    """(c, n, h, size, heads): own turns, turns to replace, turns after rebuilding, and the turns taken from the family's first conversation as
    (a, b, words), a and b running."""
    firsts = ranked.where((F.col("c") % FAMILY == 0) & (F.col("p") < HEADS - 1)).groupBy(F.col("c").alias("base")).agg(F.array_sort(F.collect_list(F.struct("p", "mark", "words"))).alias("firsts"))  # three rows
    h = F.pmod(F.crc32(F.col("c").cast("string").cast("binary")), F.lit(HEADS)).cast("int")
    rows = sizes.withColumn("h", h).withColumn("base", F.col("c") - F.col("c") % FAMILY).join(firsts, "base", "left")
    rows = rows.withColumn("taken", F.slice(F.coalesce("firsts", F.array().cast("array<struct<p:bigint,mark:binary,words:bigint>>")), 1, F.col("h")))

    def running(which: int) -> Column:
        return F.transform("taken", lambda _, i: F.aggregate(F.slice("taken", 1, i + 1), F.lit(0).cast("bigint"), lambda a, t: a.bitwiseXOR(_place_hashes(t["p"], t["mark"])[which])))

    heads = F.transform(F.arrays_zip(running(0).alias("a"), running(1).alias("b"), "taken"), lambda x: F.struct(x["a"].alias("a"), x["b"].alias("b"), x["taken"]["words"].alias("words")))
    size = F.size("taken") + F.greatest(F.col("n") - F.col("h"), F.lit(0))
    return scratch.keep(rows.select("c", "n", "h", size.cast("bigint").alias("size"), heads.alias("heads")), "conversations")


def _blocks(first: Column, last: Column) -> Column:
    return F.explode(F.when(first <= last, F.sequence(F.floor(first / BLOCK), F.floor(last / BLOCK))).otherwise(F.array().cast("array<bigint>")))


def _carried(df: DataFrame, totals: DataFrame, names: tuple[str, str], combine, scratch: Scratch, descending: bool) -> DataFrame:
    """df (c, block, ...) with what the blocks of the same conversation before (or, descending, after) it hand on, combined into the columns `names`.
    totals: (c, block, names) of the conversations that have several blocks."""
    order = F.desc("block") if descending else F.asc("block")
    before = Window.partitionBy("c").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)  # a row a block
    aggregate, add = combine
    handed = scratch.keep(totals.select("c", "block", *(F.coalesce(aggregate(x).over(before), F.lit(0)).alias(f"__{x}") for x in names)), f"handed-{names[0]}")
    out = df.join(small_side(handed, handed.count(), 40, SMALL), ["c", "block"], "left")
    return out.select(*(add(F.col(x), F.coalesce(f"__{x}", F.lit(0))).alias(x) if x in names else F.col(x) for x in df.columns))


def _prefixes(ranked: DataFrame, convs: DataFrame, scratch: Scratch) -> DataFrame:
    """(c, d, a, b, words): the digest of each prefix of each rebuilt conversation, and the words of its last turn."""
    last = F.get("heads", F.size("heads") - 1)
    nothing = F.lit(0).cast("bigint")
    shift = convs.select("c", "h", F.size("heads").alias("k"), F.coalesce(last["a"], nothing).alias("ha"), F.coalesce(last["b"], nothing).alias("hb"), _blocks(F.lit(0), F.col("n") - 1).alias("block"))
    own = ranked.withColumn("block", F.floor(F.col("p") / BLOCK)).join(shift, ["c", "block"]).where("p >= h")
    place = F.col("k") + F.col("p") - F.col("h")
    a, b = _place_hashes(place, F.col("mark"))
    start = F.col("p") == F.col("h")  # the first own turn brings the heads along
    own = own.withColumn("a", F.when(start, a.bitwiseXOR(F.col("ha"))).otherwise(a)).withColumn("b", F.when(start, b.bitwiseXOR(F.col("hb"))).otherwise(b))
    running = Window.partitionBy("c", "block").orderBy("p").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    own = own.select("c", (place + 1).cast("bigint").alias("d"), "block", F.bit_xor("a").over(running).alias("a"), F.bit_xor("b").over(running).alias("b"), "words")
    heads = convs.select("c", F.posexplode("heads").alias("i", "x")).select("c", (F.col("i") + 1).cast("bigint").alias("d"), F.lit(-1).cast("bigint").alias("block"), "x.a", "x.b", "x.words")
    out = scratch.keep(own.unionByName(heads), "prefixes")
    long = convs.where(F.col("n") > BLOCK).select("c")
    many = long.count()
    if many:
        totals = out.where("block >= 0").join(small_side(long, many, 40, SMALL), "c", "left_semi").groupBy("c", "block").agg(F.max_by(F.struct("a", "b"), "d").alias("x")).select("c", "block", "x.a", "x.b")
        out = scratch.keep(_carried(out, totals, ("a", "b"), (F.bit_xor, lambda x, y: x.bitwiseXOR(y)), scratch, False), "whole-prefixes")
    return out.drop("block")


def _lookup(left: DataFrame, right: DataFrame, keys: list[str], value: str, rows: int, weight: str, total: int) -> DataFrame:
    """left with `value` of right's row of the same keys, or null. right: keys (unique), value, weight: how many rows of left may ask for it, `total` in all. Few
    rows are broadcast; of many only the frequently asked, which can't be more than FREQUENT, and the others are joined by a shuffle that the
    answered rows take part in under keys of their own."""
    if rows * 48 <= SMALL:
        return left.join(F.broadcast(right.drop(weight)), keys, "left")
    often = F.broadcast(right.where(F.col(weight) > total // FREQUENT).select(*keys, F.col(value).alias("__often")))
    rare = right.where(F.col(weight) <= total // FREQUENT).select(*(F.col(k).alias(f"__{k}") for k in keys), F.col(value).alias("__rare"))
    asked = left.join(often, keys, "left")
    key = lambda k: F.when(F.col("__often").isNull(), F.col(k)).otherwise(F.xxhash64("c", F.lit(k)))
    answered = asked.join(rare, [key(k) == F.col(f"__{k}") for k in keys], "left")
    return answered.select(*left.columns, F.coalesce("__often", "__rare").alias(value))


def _first_owned(prefixes: DataFrame, shared: DataFrame, convs: DataFrame, root: int, scratch: Scratch) -> DataFrame:
    """(c, size, f, parent): the first owned depth of each conversation (one more than its size if it owns none), and the owner of the node above."""
    total, rows = prefixes.count(), shared.count()
    asked = prefixes.select("c", F.col("d").alias("mid"), "a", "b")
    owners = shared.select("a", "b", "owner", "members")
    now = convs.select("c", "size", F.lit(1).cast("bigint").alias("lo"), (F.col("size") + 1).alias("hi"), F.lit(root).cast("bigint").alias("parent"))
    done, k = [], 0
    while True:
        done.append(now.where("lo >= hi"))
        open_ = now.where("lo < hi")
        n = open_.count()
        if not n:
            break
        open_ = open_.withColumn("mid", F.floor((F.col("lo") + F.col("hi")) / 2))
        probed = _lookup(asked.join(small_side(open_, n, 56, SMALL), ["c", "mid"]), owners, ["a", "b"], "owner", rows, "members", total)
        mine = F.col("owner").isNull() | (F.col("owner") == F.col("c"))
        now = probed.select(
            "c", "size", F.when(mine, F.col("lo")).otherwise(F.col("mid") + 1).alias("lo"), F.when(mine, F.col("mid")).otherwise(F.col("hi")).alias("hi"), F.when(mine, F.col("parent")).otherwise(F.col("owner")).alias("parent")
        )
        now, k = scratch.keep(now, f"search-{k}"), k + 1
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return scratch.keep(out.select("c", "size", F.col("lo").alias("f"), "parent"), "chains")


def _totals(chains: DataFrame, scratch: Scratch) -> DataFrame:
    """chains (c, jump, leaves, saved), jump: the chain it hangs on, null where that isn't to be added up; each with the sums of all chains below it."""
    now, k = scratch.keep(chains, "sums-0"), 0
    while now.where("jump is not null").limit(1).count():
        rows = now.where("jump is not null").count()
        below = scratch.keep(now.where("jump is not null").groupBy("jump").agg(F.sum("leaves").alias("l"), F.sum("saved").alias("s"), F.count("*").alias("weight")), f"below-{k}")
        many = below.count()
        on = now.join(small_side(below.select(F.col("jump").alias("c"), "l", "s"), many, 48, SMALL), "c", "left")
        nothing = F.lit(0).cast("bigint")
        on = on.select("c", "jump", (F.col("leaves") + F.coalesce("l", nothing)).alias("leaves"), (F.col("saved") + F.coalesce("s", nothing)).alias("saved"))
        targets = small_side(below.select(F.col("jump").alias("c"), "weight"), many, 48, SMALL)
        next_ = now.where("jump is not null").select("c", F.col("jump").alias("after")).join(targets, "c").select(F.col("c").alias("jump"), "after", "weight")
        on = _lookup(on, next_, ["jump"], "after", many, "weight", rows)
        k += 1
        now = scratch.keep(on.select("c", F.col("after").alias("jump"), "leaves", "saved"), f"sums-{k}")
    return now.drop("jump")


def _ends(chains: DataFrame, root: int) -> DataFrame:
    """(c, d, ends): for each node at which conversations end the digest of their ids."""
    owned = (F.col("f") <= F.col("size")) | (F.col("c") == root)
    ends = chains.select(F.when(owned, F.col("c")).otherwise(F.col("parent")).alias("at"), F.col("size").alias("d"), "c")

    def pack(batches):
        import pyarrow as pa

        def rows(at, ids):
            starts = np.flatnonzero(np.r_[True, (at[1:] != at[:-1]).any(1)]) if len(ids) else np.zeros(0, int)
            for s, e in zip(starts, np.r_[starts[1:], len(ids)]):
                for i in range(s, e, PACK):
                    part = ids[i : min(i + PACK, e)]
                    yield int(at[s, 0]), int(at[s, 1]), int(part[0]), ",".join(map(str, part.tolist()))

        for batch in batches:
            found = list(zip(*rows(np.stack([np.asarray(batch.column(0)), np.asarray(batch.column(1))], 1), np.asarray(batch.column(2))))) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(map(list, found), (pa.int64(), pa.int64(), pa.int64(), pa.string()))], names=["c", "d", "first", "ids"])

    def hashed(batches):
        import pyarrow as pa

        now, h, out = None, None, []
        for batch in batches:
            for c, d, ids in zip(*(batch.column(k).to_pylist() for k in range(3))):
                if (c, d) != now:
                    if now is not None:
                        out.append((*now, h.hexdigest()))
                    now, h = (c, d), hashlib.sha256(ids.encode())
                else:
                    h.update(b"," + ids.encode())
            if len(out) > PACK:
                yield pa.RecordBatch.from_arrays([pa.array(list(v)) for v in zip(*out)], names=["c", "d", "ends"])
                out = []
        if now is not None:
            out.append((*now, h.hexdigest()))
            yield pa.RecordBatch.from_arrays([pa.array(list(v)) for v in zip(*out)], names=["c", "d", "ends"])

    packed = ends.repartitionByRange("at", "d", "c").sortWithinPartitions("at", "d", "c").mapInArrow(frugal(pack), "c bigint, d bigint, first bigint, ids string")
    dealt = packed.repartition("c", "d").sortWithinPartitions("c", "d", "first")
    return dealt.select("c", "d", "ids").mapInArrow(frugal(hashed), "c bigint, d bigint, ends string")


def build(df: DataFrame, id_col: str = "conv_id", order: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """A row a node: conv_id (its smallest member), depth, parent_conv_id (null for the root), n_convs (members), n_children, n_leaves (nodes without children below it,
    itself included), saved_tokens (below it and at it, members but one times the words of the node's last turn), ends_sha256 (of the ids of the members that
    end here, ascending, joined by commas)."""
    scratch = Scratch(df.sparkSession)
    who, what = F.coalesce(F.col(role), F.lit("")), F.coalesce(F.col(text), F.lit(""))
    turns = df.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("bigint").alias("c"), F.col(order).alias("t"), F.unhex(turn_digest(who, what)).alias("mark"), F.regexp_count(what, F.lit(WORD)).cast("bigint").alias("words"))
    ranked, sizes = _numbered(turns, scratch)
    convs = _conversations(ranked, sizes, scratch)
    all_ = convs.agg(F.min("c").alias("root"), F.count("*").alias("n")).first()
    root = all_.root if all_.n else 0
    prefixes = _prefixes(ranked, convs, scratch)
    shared = scratch.keep(prefixes.groupBy("a", "b").agg(F.min("c").alias("owner"), F.count("*").alias("members")).where("members > 1"), "shared")
    chains = _first_owned(prefixes, shared, convs, root, scratch)

    # The nodes, each with its chain's ends; the root is the first node of its smallest member's chain.
    spread = chains.where("f <= size").select("c", "size", "f", "parent", _blocks(F.col("f"), F.col("size")).alias("block"))
    owned = prefixes.withColumn("block", F.floor(F.col("d") / BLOCK)).join(small_side(spread, all_.n, 48, SMALL), ["c", "block"]).where("d >= f")
    owned = owned.join(small_side(shared.select("a", "b", "members"), shared.count(), 40, SMALL), ["a", "b"], "left")
    top = chains.where(F.col("c") == root).select("c", F.lit(0).cast("bigint").alias("d"), F.lit(0).cast("bigint").alias("block"), "size", F.lit(0).cast("bigint").alias("f"), F.lit(None).cast("bigint").alias("parent"), F.lit(0).cast("bigint").alias("words"), F.lit(all_.n).cast("bigint").alias("members"))
    columns = top.columns
    nodes = scratch.keep(owned.withColumn("members", F.coalesce("members", F.lit(1).cast("bigint"))).select(columns).unionByName(top), "nodes")

    hanging = chains.where((F.col("f") <= F.col("size")) & (F.col("c") != root))
    saved = nodes.where(F.col("c") != root).groupBy("c").agg(F.sum((F.col("members") - 1) * F.col("words")).alias("saved"))
    crowded = hanging.groupBy(F.col("parent").alias("c"), (F.col("f") - 1).alias("size")).agg(F.lit(0).cast("bigint").alias("leaves"))  # an end with children is no leaf
    sums = hanging.join(saved, "c").join(crowded, ["c", "size"], "left")
    sums = _totals(sums.select("c", F.when(F.col("parent") != root, F.col("parent")).alias("jump"), F.coalesce("leaves", F.lit(1).cast("bigint")).alias("leaves"), "saved"), scratch)
    attached = hanging.select("c", "parent", (F.col("f") - 1).alias("at")).join(sums, "c").groupBy(F.col("parent").alias("c"), F.col("at").alias("d")).agg(F.count("*").alias("branches"), F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))

    zero = F.lit(0).cast("bigint")
    rows = nodes.join(attached, ["c", "d"], "left").join(_ends(chains, root), ["c", "d"], "left")
    rows = rows.withColumn("leaves", F.coalesce("leaves", zero) + F.when((F.col("d") == F.col("size")) & F.col("branches").isNull(), 1).otherwise(0)).withColumn("saved", F.coalesce("saved", zero) + (F.col("members") - 1) * F.col("words"))
    below = Window.partitionBy("c", "block").orderBy(F.desc("d")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("leaves", F.sum("leaves").over(below)).withColumn("saved", F.sum("saved").over(below))
    long = chains.where(F.floor(F.col("size") / BLOCK) > F.floor(F.when(F.col("c") == root, F.lit(0)).otherwise(F.col("f")) / BLOCK)).select("c")
    many = long.count()
    if many:
        rows = scratch.keep(rows, "rows")
        totals = rows.join(small_side(long, many, 40, SMALL), "c", "left_semi").groupBy("c", "block").agg(F.max("leaves").alias("leaves"), F.max("saved").alias("saved"))
        rows = _carried(rows, totals, ("leaves", "saved"), (F.sum, lambda x, y: x + y), scratch, True)
    return rows.select(
        F.col("c").alias(id_col), F.col("d").alias("depth"), F.when(F.col("d") > F.greatest("f", F.lit(0)), F.col("c")).otherwise(F.col("parent")).alias(f"parent_{id_col}"), F.col("members").alias("n_convs"),
        (F.coalesce("branches", zero) + F.when(F.col("d") < F.col("size"), 1).otherwise(0)).alias("n_children"), F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"), F.coalesce("ends", F.lit(EMPTY)).alias("ends_sha256"),
    )
