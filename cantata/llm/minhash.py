"""Operator 9: near-duplicate documents by min-max hashing.

A document's set holds its distinct word shingles as 64-bit hashes (of all the words' bytes; every eight bytes and every word go through a finalizer). Under each permutation both the smallest and the
largest hash are kept, so PERMUTATIONS evaluations give twice as many unbiased signature values. Values of different
permutations form bands; documents that share a band are candidates, and links are confirmed on the full sets.

How groups of any size are handled:
1. Documents with equal sets are one node; only nodes take part from here on.
2. Band keys that one node alone has go (a counted aggregate and a join).
3. Each node is compared with one pivot, the member with the smallest id of its buckets. That is one pair a node, and joins
   most groups of copies into a star.
4. For what is left, buckets whose members lie in different components are cut into blocks of about BLOCK members; within
   pairs of blocks, signatures are compared on arrays, and pairs that may reach the threshold (SLACK standard deviations
   below it still count) go on. In each of BEST_ROUNDS rounds every component confirms its most promising pair, which
   is a row a component and joins what belongs together. A last round takes the sets of all members that still have an
   open pair into the blocks and confirms every such pair there; of a block's links only a spanning forest comes out.
   So no step emits more rows than there are members in blocks, and pairs inside one component, which change no
   result, need no confirmation.
Components are found by alternating star contractions over tables in the shared folder.

At similarity 0.8 a pair shares no band of the default signature with probability 5e-6; above, with less.

Defined cases: a null text, or one without words, has an empty set, is linked with nothing and stays. A text with fewer
words than a shingle has one shingle, the whole sequence. The component's id is the smallest id of its rows that isn't
null (null if there is none); a row stays if its id is the component's. Rows that repeat an id with an equal set therefore stay or
go together. A very long text is handled whole, in one task. Bytes that aren't UTF-8 are letters. Other columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cantata.llm.common import LOWER, NOT_SPACE, Scratch, chunks, frugal, input_bytes, mix, partitions, small_side, text_buffer, word_hashes, words

SHINGLE = 5
#: 100 * similarity.
THRESHOLD = 80
PERMUTATIONS = 120
ROWS = 6
#: Members of a block of a bucket, about.
BLOCK = 1024
#: Rounds in which each component confirms one pair, before the round that confirms all.
BEST_ROUNDS = 2
#: Standard deviations below the threshold at which a signature's estimate still counts.
SLACK = 4.5

CHUNK = 1 << 19


def shingles(data: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all shingles (with repeats) of each document, and each document's first (n + 1)."""
    low = LOWER[data]
    starts, ends, first = words(low, offsets, NOT_SPACE)
    h = word_hashes(low, starts, ends)
    count = np.diff(first)
    n = len(h)
    place = np.arange(n)
    left = np.repeat(first[1:], count) - place  # words from here to the document's end
    short = np.repeat(count < size, count)
    take = (left >= size) | (short & (np.repeat(first[:-1], count) == place))
    at = place[take]
    span = np.minimum(left[take], size)
    out = mix(span.astype(np.uint64))
    for k in range(size):
        inside = span > k
        out = np.where(inside, mix(out * np.uint64(0x9FB21C651E98DF25) + h[np.minimum(at + k, max(n - 1, 0))]), out)
    return out, np.searchsorted(at, first)


def _permutations(count: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20240611)
    return rng.integers(0, 1 << 63, count, dtype=np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 1 << 63, count, dtype=np.uint64)


def signatures(hashes: np.ndarray, first: np.ndarray, permutations: int) -> np.ndarray:
    """Smallest (first half) and largest (second half) hash of each document under each permutation; documents without shingles have zeros."""
    full = np.flatnonzero(np.diff(first))
    out = np.zeros((2 * permutations, len(first) - 1), np.uint64)
    if len(full):
        cut = first[full]
        buffer = np.empty_like(hashes)
        for k, (a, b) in enumerate(zip(*_permutations(permutations))):
            np.multiply(hashes, a, out=buffer)
            np.add(buffer, b, out=buffer)
            out[k, full] = np.minimum.reduceat(buffer, cut)
            out[permutations + k, full] = np.maximum.reduceat(buffer, cut)
    return out


def bands(values: np.ndarray, rows: int) -> np.ndarray:
    """Band keys (bands, documents): each of `rows` values, of different permutations, the band's number mixed in."""
    count = len(values) // rows
    out = mix(np.arange(1, count + 1, dtype=np.uint64))[:, None] * np.ones(values.shape[1], np.uint64)
    for k in range(rows):
        out = mix(out * np.uint64(0x9FB21C651E98DF25) + mix(values[k : count * rows : rows]))
    return out


def node_of(unique: np.ndarray) -> bytes:
    return hashlib.blake2b(unique.tobytes(), digest_size=16).digest()


def _binary(rows: np.ndarray) -> pa.Array:
    """Rows of a 2-D byte array as binaries."""
    n, w = rows.shape
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(np.arange(0, (n + 1) * w, w, dtype=np.int32).tobytes() if w else bytes(4 * (n + 1))), pa.py_buffer(np.ascontiguousarray(rows).tobytes())])


def _sign(docs: DataFrame, text_col: str, id_col: str, size: int, permutations: int, rows: int) -> DataFrame:
    schema = T.StructType(
        [
            T.StructField("id", docs.schema[id_col].dataType),
            T.StructField("n_shingles", T.LongType()),
            T.StructField("node", T.BinaryType()),
            T.StructField("bands", T.ArrayType(T.LongType(), False)),
            T.StructField("sketch", T.BinaryType()),
        ]
    )

    def run(batches):
        for batch in batches:
            data, offsets = text_buffer(batch.column(1))
            for i, j in chunks(offsets, CHUNK):
                h, first = shingles(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], size)
                count, node = [], []
                for a, b in zip(first.tolist(), first[1:].tolist()):
                    u = np.unique(h[a:b])
                    count.append(len(u))
                    node.append(node_of(u) if len(u) else None)
                values = signatures(h, first, permutations)
                keys = bands(values, rows).T
                flat = pa.ListArray.from_arrays(np.arange(0, keys.size + 1, keys.shape[1], dtype=np.int32), np.ascontiguousarray(keys).view(np.int64).ravel())
                sketch = _binary((values & np.uint64(255)).astype(np.uint8).T if j > i else np.zeros((0, 0), np.uint8))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(count, pa.int64()), pa.array(node, pa.binary()), flat, sketch], names=schema.names)

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(frugal(run), schema)


def _sets(docs: DataFrame, text_col: str, id_col: str, size: int) -> DataFrame:
    """node and its set, sorted, for each document with words."""
    schema = "node binary, members array<bigint>"

    def run(batches):
        for batch in batches:
            data, offsets = text_buffer(batch.column(0))
            for i, j in chunks(offsets, CHUNK):
                h, first = shingles(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], size)
                found = [u for a, b in zip(first.tolist(), first[1:].tolist()) if len(u := np.unique(h[a:b]))]
                if found:
                    ends = np.concatenate([[0], np.cumsum([len(u) for u in found])]).astype(np.int32)
                    yield pa.RecordBatch.from_arrays([pa.array([node_of(u) for u in found], pa.binary()), pa.ListArray.from_arrays(ends, np.concatenate(found).view(np.int64))], names=["node", "members"])

    return docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(frugal(run), schema)


def _files(df: DataFrame, rows: int) -> DataFrame:
    """df in partitions of half a million rows, where it has about so many rows."""
    return df.coalesce(rows // 500_000 + 1)


def components(edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """edges (a, b) to (node, comp), the smallest node of the component, for every node of an edge other than that smallest one."""
    e = scratch.keep(edges.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), f"{name}-0")
    mark = F.struct(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s"))
    was, k = e.agg(mark.alias("m")).first().m, 0
    while was.n:
        k += 1
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("low")).select("u", F.least("u", "low").alias("low"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("low").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("low"))
        small = large.join(least, "u").where("v != low").select(F.col("v").alias("u"), F.col("low").alias("v")).unionByName(least.select("u", F.col("low").alias("v"))).distinct()
        e = scratch.keep(_files(small, 2 * was.n), f"{name}-{k}")
        scratch.drop(f"{name}-{k - 1}")
        now = e.agg(mark.alias("m")).first().m
        if now == was:
            break
        was = now
    return e.select(F.col("u").alias("node"), F.col("v").alias("comp"))


def _confirm(pairs: DataFrame, sets: DataFrame, threshold: int) -> DataFrame:
    """Of pairs (a, b) those whose full sets reach the threshold."""
    left, right = sets.select(F.col("node").alias("a"), F.col("members").alias("x")), sets.select(F.col("node").alias("b"), F.col("members").alias("y"))
    both = F.size(F.array_intersect("x", "y"))
    return pairs.select("a", "b").join(left, "a").join(right, "b").where(100 * both >= threshold * (F.size("x") + F.size("y") - both)).select("a", "b")


def _open_pairs(grp, comp, n, sketch, threshold: int):
    """Pairs of rows (i, j) of a group, of different components, that may reach the threshold by size and signature; and the score."""
    t = threshold / 100
    least = t * sketch.shape[1] - SLACK * (t * (1 - t) * sketch.shape[1]) ** 0.5
    for d in range(1, len(grp)):
        same = grp[d:] == grp[:-d]
        if not same.any():
            break
        i = np.flatnonzero(same & (comp[d:] != comp[:-d]).any(1))
        i = i[100 * np.minimum(n[i], n[i + d]) >= threshold * np.maximum(n[i], n[i + d])]
        for s in range(0, len(i), 4096):
            k = i[s : s + 4096]
            score = (sketch[k] == sketch[k + d]).sum(1)
            ok = score >= least
            if ok.any():
                yield k[ok], k[ok] + d, score[ok]


def _whole_groups(batches, most_rows: int = 4096):
    """Batches cut so that no group (first column, adjacent rows) is divided; of about most_rows rows."""
    held = None
    for batch in batches:
        for s in range(0, batch.num_rows, most_rows):
            part = pa.Table.from_batches([batch.slice(s, most_rows)])
            now = part if held is None else pa.concat_tables([held, part])
            grp = np.asarray(now.column(0))
            cut = len(grp) - int((grp[::-1] == grp[-1]).cumprod().sum())
            if cut:
                yield now.slice(0, cut).combine_chunks()
            held = now.slice(cut)
    if held is not None and held.num_rows:
        yield held.combine_chunks()


def _columns(table):
    grp, n = np.asarray(table.column("grp")), np.asarray(table.column("n"))
    wide = lambda c, kind: np.frombuffer(b"".join(table.column(c).to_pylist()), kind).reshape(len(grp), -1)
    return grp, wide("node", np.uint64), wide("comp", np.uint64), n, wide("sketch", np.uint8)


def _ids(*columns) -> list:
    return [_binary(np.ascontiguousarray(x).view(np.uint8)) for x in columns]


def _best(rows: DataFrame, threshold: int) -> DataFrame:
    """Of each component in a group (adjacent rows) the pair with the best estimate."""

    def run(batches):
        for table in _whole_groups(batches):
            grp, node, comp, n, sketch = _columns(table)
            parts = list(_open_pairs(grp, comp, n, sketch, threshold))
            if not parts:
                continue
            i, j, score = (np.concatenate(x) for x in zip(*parts))
            side, pair = np.concatenate([i, j]), np.tile(np.arange(len(i)), 2)
            order = np.lexsort([pair, -score[pair], comp[side, 1], comp[side, 0], grp[side]])
            g, c = grp[side][order], comp[side][order]
            lead = np.ones(len(order), bool)
            lead[1:] = (g[1:] != g[:-1]) | (c[1:] != c[:-1]).any(1)
            keep = np.unique(pair[order[lead]])
            i, j = i[keep], j[keep]
            yield pa.RecordBatch.from_arrays([*_ids(node[i], node[j], comp[i], comp[j]), pa.array(score[keep], pa.int32())], names=["a", "b", "ca", "cb", "score"])

    return rows.select("grp", "node", "comp", "n", "sketch").mapInArrow(frugal(run), "a binary, b binary, ca binary, cb binary, score int")


def _active(rows: DataFrame, threshold: int) -> DataFrame:
    """The rows of groups (adjacent rows) that have an open pair."""
    columns = ["grp", "node", "comp", "n", "sketch"]

    def run(batches):
        for table in _whole_groups(batches):
            grp, _, comp, n, sketch = _columns(table)
            some = np.zeros(len(grp), bool)
            for i, j, _ in _open_pairs(grp, comp, n, sketch, threshold):
                some[i] = some[j] = True
            if some.any():
                yield from table.filter(pa.array(some)).to_batches()

    return rows.select(*columns).mapInArrow(frugal(run), "grp bigint, node binary, comp binary, n bigint, sketch binary")


def _linked(rows: DataFrame, threshold: int) -> DataFrame:
    """Links (a, b) between components, confirmed on the full sets (column members): a spanning forest of each group (adjacent rows)."""

    def run(batches):
        for table in _whole_groups(batches, 256):
            grp, node, comp, n, sketch = _columns(table)
            sets = [np.asarray(x.values).view(np.uint64) for x in table.column("members")]  # sorted as unsigned numbers
            root = {}

            def find(x):
                while root.setdefault(x, x) != x:
                    root[x] = x = root[root[x]]
                return x

            key = [(g, c.tobytes()) for g, c in zip(grp.tolist(), comp)]
            out = []
            for i, j, _ in _open_pairs(grp, comp, n, sketch, threshold):
                for a, b in zip(i.tolist(), j.tolist()):
                    if find(key[a]) == find(key[b]):
                        continue
                    x, y = sets[a], sets[b]
                    at = np.searchsorted(x, y)
                    at[at == len(x)] = 0
                    both = int((x[at] == y).sum())
                    if 100 * both >= threshold * (len(x) + len(y) - both):
                        root[find(key[a])] = find(key[b])
                        out.append((a, b))
            if out:
                a, b = np.array(out).T
                yield pa.RecordBatch.from_arrays(_ids(node[a], node[b]), names=["a", "b"])

    return rows.select("grp", "node", "comp", "n", "sketch", "members").mapInArrow(frugal(run), "a binary, b binary")


def cluster(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", shingle: int = SHINGLE, threshold: int = THRESHOLD, permutations: int = PERMUTATIONS, rows: int = ROWS) -> DataFrame:
    """One row a document: its id, n_shingles, component_id and kept."""
    spark = docs.sparkSession
    scratch, size = Scratch(spark), input_bytes(docs)
    keep = lambda df, name: scratch.keep(df, name, size)
    signed = keep(_sign(docs, text_col, id_col, shingle, permutations, rows), "signed")
    nodes = keep(
        signed.where("node is not null").groupBy("node").agg(F.min("id").alias("rid"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch")), "nodes"
    )
    spread = nodes.select("node", "rid", F.explode("bands").alias("key"))
    shared = keep(spread.groupBy("key").agg(F.count("*").alias("size")).where("size > 1"), "shared")
    members = keep(spread.join(small_side(shared, shared.count(), 40), "key"), "members")

    # One pivot a node: of its buckets' members the one with the smallest id.
    me = F.struct("rid", "node")
    first = members.groupBy("key").agg(F.min(me).alias("pivot"))
    star = members.join(first, "key").where("node != pivot.node").groupBy("node").agg(F.min("pivot").alias("pivot")).select(F.col("pivot.node").alias("a"), F.col("node").alias("b"))
    star = keep(star.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "star")

    # Full sets of the nodes that have a candidate, made again from their documents.
    wanted = keep(members.select("node", "rid").distinct(), "wanted")
    count = wanted.count()
    ids = small_side(wanted.select("rid").distinct(), count, 48)
    some = docs.select(F.col(id_col).alias("__rid"), F.col(text_col).alias("__text")).join(ids, F.col("__rid").eqNullSafe(F.col("rid")), "left_semi")
    sets = _sets(some, "__text", "__rid", shingle).join(small_side(wanted.select("node"), count, 64), "node", "left_semi").dropDuplicates(["node"])
    sets = keep(sets, "sets")

    links = keep(_confirm(star, sets, threshold), "links-0")
    tested = star.select("a", "b")
    labels = components(links, scratch, "comp-0")

    def blocks_of(labels: DataFrame) -> DataFrame:
        """Members of the buckets that hold several components, once for each pair of blocks; a group's rows together."""
        placed = members.join(labels, "node", "left").select("key", "size", "node", F.coalesce("comp", "node").alias("comp"))
        mixed = placed.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo != hi").select("key")
        count = F.ceil(F.col("size") / BLOCK).cast("int")
        mine = F.pmod(F.xxhash64("node"), count).cast("int")
        spread = placed.join(mixed, "key", "left_semi").select("key", "node", "comp", mine.alias("i"), F.explode(F.sequence(F.lit(0), count - 1)).alias("j"))
        grouped = spread.select(F.xxhash64("key", F.least("i", "j"), F.greatest("i", "j")).alias("grp"), "node", "comp").join(nodes.select("node", "n", "sketch"), "node")
        return together(grouped)

    def together(grouped: DataFrame) -> DataFrame:
        return grouped.repartition(partitions(spark), "grp").sortWithinPartitions("grp")

    for k in range(1, BEST_ROUNDS + 1):
        near = _best(blocks_of(labels), threshold).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "ca", "cb", "score").join(tested, ["a", "b"], "left_anti")
        near = near.select(F.explode(F.array("ca", "cb")).alias("c"), F.struct("score", "a", "b").alias("p")).groupBy("c").agg(F.max("p").alias("p")).select("p.a", "p.b")
        near = keep(near.distinct(), f"near-{k}")
        if not near.take(1):
            break
        tested = tested.unionByName(near)
        new = keep(_confirm(near, sets, threshold), f"links-{k}")
        if not new.take(1):
            break
        links = links.unionByName(new)
        labels = components(links, scratch, f"comp-{k}")
    active = keep(_active(blocks_of(labels), threshold), "active")
    new = keep(_linked(together(active.join(sets, "node")), threshold).distinct(), "links-last")
    if new.take(1):
        labels = components(links.unionByName(new), scratch, "comp-last")
    for name in ("shared", "members", "star", "wanted", "sets", "active", "links-0", "links-last", *(f"{x}-{k}" for k in range(1, BEST_ROUNDS + 1) for x in ("near", "links"))):
        scratch.drop(name)

    placed = nodes.select("node", "rid").join(labels, "node", "left").select("node", "rid", F.coalesce("comp", "node").alias("comp"))
    least = placed.groupBy("comp").agg(F.min("rid").alias("component_id"))
    final = placed.join(least, "comp").select("node", "component_id")
    out = signed.select("id", "n_shingles", "node").join(final, "node", "left")
    component = F.when(F.col("node").isNull(), F.col("id")).otherwise(F.col("component_id"))
    return out.select(F.col("id").alias(id_col), "n_shingles", component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))
