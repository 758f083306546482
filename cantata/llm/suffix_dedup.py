"""Operator 10: verbatim repeats of WINDOW bytes and more, by a depth-limited radix sort of suffixes.

Suffixes are ordered only as far as WINDOW bytes, most significant digit first, and a pass goes on with what is not yet alone:
equal groups after the last pass are exactly the repeated windows. To keep the passes small, those over the whole corpus work on sampled suffixes
and fan out to all windows at the end, which loses nothing:

* Each window holds GRAM-byte grams; the one with the smallest hash is its anchor. Equal windows have equal anchors at equal
  places, so a repeated window lies in a group of repeated anchors. About one suffix in 31 starts with an anchor.
* Pass 1, first digit: suffixes at anchors by their GRAM bytes. Anchors that occur once go.
* Pass 2, next digit: the surviving suffixes by their context, all bytes of the windows that have the anchor. Of equal contexts
  the earliest place is the first; at every other place each window is a repeat.
* Pass 3: where one anchor has several contexts, the windows of each context's first place are ordered among each other: what has a
  window hash of its own is alone and goes; the rest is sorted by its bytes, eight at a time from the first to the last, and what
  becomes alone goes after each pass. Windows that also start earlier are found in the groups that are left. Anchors with over HOT contexts
  go window by window through an aggregate that combines before the shuffle.

Digits of passes 1 and 2 travel as 64-bit hashes (an anchor's with its context's, 128 bits for a context); every eight bytes of them go through a finalizer
(common.mix), so that texts with equal values don't come in families. Pass 3 compares bytes, except for hot anchors, whose windows have 128 bits.

At the end all spans that go are merged by document, and cut out. What the passes tell a document's scan (repeated anchors; places whose contexts are needed) is
broadcast while it has at most LIMIT bytes, the merged spans while they have BROADCAST bytes; beyond that they reach the documents through a
shuffled join on their identity.

Defined cases: a null or empty text has no bytes and nothing removed. Documents are ordered by id, nulls last, then by a
hash of the text; rows with equal id and text are one document and get equal results. Texts shorter than a window stay as
they are. A very long text is scanned alone, in one task. Other columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cantata.llm.common import Scratch, chunks, eights, frugal, gathered, input_bytes, mix, partitions, release, text_buffer

WINDOW = 100
#: 8 times a power of two.
GRAM = 32
#: Text bytes that are scanned at once; a longer document is scanned alone.
CHUNK_BYTES = 1 << 18
#: Windows that pass 3 orders at once, unless one anchor has more.
ORDERED = 1 << 18
#: Bytes of a broadcast lookup, and of the spans of all documents.
LIMIT, BROADCAST = 64 << 20, 32 << 20
#: Contexts of an anchor above which windows are grouped one by one.
HOT = 16384

_ODD = np.uint64(0x9FB21C651E98DF25)
_NO_ID = (1 << 63) - 1


def _sliding(x: np.ndarray, width: int, op, fill: int) -> np.ndarray:
    """op over x[i : i + width] for each i, by doubling; fill stands beyond the end."""
    n = len(x)
    out, have = x, 1

    def shifted(by: int) -> np.ndarray:
        r = np.full(n, fill, x.dtype)
        if by < n:
            r[: n - by] = out[by:]
        return r

    while have < width:
        by = min(have, width - have)
        out = op(out, shifted(by))
        have += by
    return out


def _doubled(data: np.ndarray, size: int) -> np.ndarray:
    """A hash of the `size` bytes (8 times a power of two) from each place on; of no use where fewer are left."""
    out, have = mix(eights(data)), 8
    while have < size:
        if len(out) > have:
            out[:-have] = mix(out[:-have] * _ODD + out[have:])
        have *= 2
    return out


def _tails(offsets: np.ndarray, size: int) -> np.ndarray:
    """Places from which fewer than `size` bytes of the document are left."""
    length = np.minimum(np.diff(offsets), size - 1)
    total = int(length.sum())
    return np.repeat(offsets[1:] - length, length) + np.arange(total) - np.repeat(np.cumsum(length) - length, length)


class Scan:
    """Anchors of some documents, in text order."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, window: int, gram: int):
        self.window, self.width = window, window - gram + 1
        self.data, self.offsets = data, offsets
        n = len(data)
        self.gram_size = gram
        self.hashes = hashes = _doubled(data, gram)
        order = (hashes >> np.uint64(33)).astype(np.uint32) + np.uint32(1)
        order[_tails(offsets, gram)] = np.uint32(0xFFFFFFFF)
        least = _sliding(order, self.width, np.minimum, 0xFFFFFFFF)
        least[_tails(offsets, window)] = 0
        most = _sliding(least[::-1], self.width, np.maximum, 0)[::-1]
        self.order, self.least = order, least
        self.at = np.flatnonzero((most == order) & (most > 0))
        self.doc = np.searchsorted(offsets, self.at, side="right") - 1
        self.gram = hashes[self.at]

    def keep(self, some: np.ndarray) -> None:
        self.at, self.doc, self.gram = self.at[some], self.doc[some], self.gram[some]

    def contexts(self) -> tuple[np.ndarray, np.ndarray]:
        """First and last byte (exclusive) of each anchor's context."""
        return np.maximum(self.offsets[self.doc], self.at - self.width + 1), np.minimum(self.offsets[self.doc + 1], self.at + self.window)

    def context_hash(self) -> np.ndarray:
        """Of all its bytes, by grams one after the other, the last one where it ends; and of the anchor's place in it."""
        a, b = self.contexts()
        out = mix((b - a).astype(np.uint64) * _ODD + (self.at - a).astype(np.uint64))
        for k in range(0, int((b - a).max(initial=0)), self.gram_size):
            some = a + k < b
            out[some] = mix(out[some] * _ODD + self.hashes[np.minimum(a[some] + k, b[some] - self.gram_size)])
        return out

    def windows(self) -> tuple[np.ndarray, np.ndarray]:
        """First and last start of the windows that have the anchor."""
        lo, hi = np.empty(len(self.at), np.int64), np.empty(len(self.at), np.int64)
        for s in range(0, len(self.at), 1 << 14):
            at = self.at[s : s + (1 << 14)]
            place = at[:, None] + np.arange(1 - self.width, 1)
            has = (self.least[np.maximum(place, 0)] == self.order[at][:, None]) & (place >= 0)
            lo[s : s + (1 << 14)] = place[np.arange(len(at)), has.argmax(1)]
            hi[s : s + (1 << 14)] = place[np.arange(len(at)), self.width - 1 - has[:, ::-1].argmax(1)]
        return lo, hi


def place_key(gram, context, doc, text, pos) -> np.ndarray:
    """One number for a place: an anchor's hash, its context's, and where it stands."""
    out = mix(gram * _ODD + context)
    for x in (doc, text, pos):
        out = mix(out * _ODD + x.astype(np.uint64))
    return out


def _member(values: np.ndarray, x: np.ndarray) -> np.ndarray:
    if not len(values) or not len(x):
        return np.zeros(len(x), bool)
    return values[np.minimum(np.searchsorted(values, x), len(values) - 1)] == x


def _numbers(column) -> np.ndarray:
    return np.asarray(column).astype(np.int64)


class Dedup:
    """The passes over one table of documents."""

    def __init__(self, docs: DataFrame, text_col: str, id_col: str, window: int, gram: int, limit: int, hot: int, digests: bool):
        self.spark, self.scratch = docs.sparkSession, Scratch(docs.sparkSession)
        self.digests, self.size = digests, input_bytes(docs)
        self.window, self.gram, self.limit, self.hot = window, gram, limit, hot
        text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
        self.docs = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(id_col).cast("long"), F.lit(_NO_ID)).alias("d"), F.xxhash64(text).alias("t"), text.alias("text"))
        self.flagged = None  # column with the repeated anchors' places, where they aren't broadcast
        self.repeated = None

    # Pass 1.
    def anchors(self) -> DataFrame:
        window, gram = self.window, self.gram

        def run(batches):
            for batch in batches:
                data, offsets = text_buffer(batch.column(0))
                for i, j in chunks(offsets, CHUNK_BYTES):
                    s = Scan(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], window, gram)
                    h, n = np.unique(s.gram, return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n)], names=["h", "n"])

        seen = self.docs.select("text").mapInArrow(frugal(run), "h bigint, n bigint")
        return self.scratch.keep(seen.groupBy("h").agg(F.sum("n").alias("n")).where("n > 1").select("h"), "repeated", self.size)

    def known(self, df: DataFrame, column: str) -> np.ndarray:
        out = gathered(df, column).view(np.uint64)
        out.sort()
        return out

    def places(self, select, schema: str, docs: DataFrame) -> DataFrame:
        """Rows that select(scan, d, t, rows) makes of the repeated anchors of each scan."""
        window, gram, repeated, flagged = self.window, self.gram, self.repeated, self.flagged

        def run(batches):
            for batch in batches:
                data, offsets = text_buffer(batch.column(2))
                d, t = _numbers(batch.column(0)), _numbers(batch.column(1))
                for i, j in chunks(offsets, CHUNK_BYTES):
                    s = Scan(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], window, gram)
                    if repeated is not None:
                        s.keep(_member(repeated.value, s.gram))
                    elif flagged:
                        mine = [np.asarray(x.values.to_numpy()) + s.offsets[k] for k in range(j - i) if (x := batch.column(3)[i + k]).is_valid]
                        s.keep(np.isin(s.at, np.concatenate(mine) if mine else np.zeros(0, np.int64)))
                    out = select(s, d[i:j], t[i:j], batch.slice(i, j - i))
                    if out is not None and out.num_rows:
                        yield out

        columns = ["d", "t", "text", *(["places"] if flagged else []), *(["told"] if "told" in docs.columns else [])]
        return docs.select(*columns).mapInArrow(frugal(run), schema)

    def of_anchors(self, whole: bool) -> DataFrame:
        """Places of repeated anchors; whole: with their contexts, and near and far, from which the windows that have them start."""

        def select(s, d, t, _):
            where = s.at - s.offsets[s.doc]
            columns = {"d": d[s.doc], "t": t[s.doc], "pos": where.astype(np.int32)}
            if whole:
                lo, hi = s.windows()
                columns = {"h": s.gram.view(np.int64), "c": s.context_hash().view(np.int64)} | columns | {"near": (s.at - hi).astype(np.int32), "far": (s.at - lo).astype(np.int32)}
            else:
                columns = {"h": s.gram.view(np.int64)} | columns
            return pa.RecordBatch.from_arrays([pa.array(x) for x in columns.values()], names=list(columns))

        return self.places(select, "h bigint, c bigint, d bigint, t bigint, pos int, near int, far int" if whole else "h bigint, d bigint, t bigint, pos int", self.docs)

    def run(self) -> DataFrame:
        repeated = self.anchors()
        if repeated.count() * 8 <= self.limit:
            self.repeated = self.spark.sparkContext.broadcast(self.known(repeated, "h"))
        else:
            flagged = self.of_anchors(False).join(repeated, "h", "left_semi")
            places = flagged.groupBy("d", "t").agg(F.array_distinct(F.collect_list("pos")).alias("places"))
            self.docs = self.scratch.keep(self.docs.join(places, ["d", "t"], "left"), "docs", self.size)
            self.flagged = True
        # Pass 2.
        places = self.scratch.keep(self.of_anchors(True), "places", self.size)
        first = self.scratch.keep(places.groupBy("h", "c").agg(F.min(F.struct("d", "t", "pos")).alias("p")).select("h", "c", "p.d", "p.t", "p.pos"), "first", self.size)
        several = first.groupBy("h").agg(F.count("*").alias("size")).where("size > 1")
        open_ = self.scratch.keep(first.join(several, "h"), "open", self.size)
        # Pass 3.
        found = self.windows(open_)
        return self.removal(self.spans(places, first, found))

    def spans(self, places: DataFrame, first: DataFrame, found: DataFrame) -> DataFrame:
        """(d, t, spans): starts and ends of the runs that go, one after the other. At a place that isn't its context's first all windows go."""
        window = self.window
        of = first.select("h", "c", F.col("d").alias("d1"), F.col("t").alias("t1"), F.col("pos").alias("pos1"))
        late = places.join(of, ["h", "c"]).where("not (d = d1 and t = t1 and pos = pos1)").select("d", "t", (F.col("pos") - F.col("far")).cast("bigint").alias("a"), (F.col("pos") - F.col("near") + window).cast("bigint").alias("e"))

        def runs(batches):
            for batch in batches:
                if not batch.num_rows:
                    continue
                d, t, pos = (_numbers(batch.column(k)) for k in range(3))
                bits = np.frombuffer(b"".join(x.as_buffer() for x in batch.column(3)), np.uint8).reshape(len(d), -1)
                k, back = np.nonzero(np.unpackbits(bits, axis=1, bitorder="little"))
                start = np.ones(len(k), bool)
                start[1:] = (k[1:] != k[:-1]) | (back[1:] != back[:-1] + 1)
                begin = np.flatnonzero(start)
                end = np.append(begin[1:], len(k)) - 1
                at = k[begin]
                yield pa.RecordBatch.from_arrays([pa.array(d[at]), pa.array(t[at]), pa.array(pos[at] - back[end]), pa.array(pos[at] - back[begin] + window)], names=["d", "t", "a", "e"])

        some = found.select("d", "t", "pos", "gone").mapInArrow(frugal(runs), "d bigint, t bigint, a bigint, e bigint")
        every = late.unionByName(some).repartition(partitions(self.spark), "d", "t").sortWithinPartitions("d", "t", "a")
        return self.scratch.keep(every.mapInArrow(frugal(_merged), "d bigint, t bigint, spans array<bigint>"), "spans", self.size)

    def told(self, rows: DataFrame, columns: list[str], row_bytes: int):
        """Rows about places (h, c, d, t, pos and more) to broadcast: their keys, sorted, and the other columns; None if they are too many.
        Executors make the keys, so the driver gathers eight bytes a place and the columns."""
        if rows.count() * row_bytes > self.limit:
            return None

        def run(batches):
            for batch in batches:
                h, c, d, t, pos = (_numbers(batch.column(k)) for k in range(5))
                key = place_key(h.view(np.uint64), c.view(np.uint64), d, t, pos)
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), *(batch.column(5 + k) for k in range(len(columns)))], names=["key", *columns])

        schema = T.StructType([T.StructField("key", T.LongType()), *(rows.schema[c] for c in columns)])
        keyed = rows.select("h", "c", "d", "t", "pos", *columns).mapInArrow(frugal(run), schema)
        if not columns:
            return self.known(keyed, "key"), {}
        table = keyed.toArrow()
        key = np.asarray(table.column("key")).view(np.uint64)
        order = np.argsort(key)
        out = key[order], {c: table.column(c).take(pa.array(order)) for c in columns}
        del table, key, order
        release()
        return out

    def by_document(self, rows: DataFrame, columns: list[str]) -> DataFrame:
        told = rows.groupBy("d", "t").agg(F.collect_list(F.struct("pos", *columns)).alias("told"))
        return self.docs.join(told, ["d", "t"], "left")

    def windows(self, open_: DataFrame) -> DataFrame:
        """(h, c, d, t, pos, gone): of each context's first place, a bit for each window, counted from the last one back, that also starts earlier."""
        told = self.told(open_, ["size"], 16)
        window, width, hot = self.window, self.window - self.gram + 1, self.hot
        shipped = None if told is None else self.spark.sparkContext.broadcast((told[0], np.asarray(told[1]["size"]).astype(np.int32)))
        docs = self.docs if told is not None else self.by_document(open_, ["size"])
        told = None
        release()

        def select(s, d, t, rows):
            c = s.context_hash()
            pos = s.at - s.offsets[s.doc]
            if shipped is not None:
                keys, sizes = shipped.value
                key = place_key(s.gram, c, d[s.doc], t[s.doc], pos)
                take = _member(keys, key)
                size = sizes[np.minimum(np.searchsorted(keys, key), len(keys) - 1)] if len(keys) else np.zeros(len(key), np.int64)
            else:
                listed = {(k, x["pos"]): x["size"] for k, l in enumerate(rows.column(rows.schema.get_field_index("told")).to_pylist()) for x in l or ()}
                size = np.array([listed.get(x, 0) for x in zip(s.doc.tolist(), pos.tolist())], np.int64)
                take = size > 0
            s.keep(take)
            c, size, pos = c[take], size[take], pos[take]
            if not len(c):
                return None
            a, b = s.contexts()
            lo, hi = s.windows()
            raw = s.data.tobytes()
            arrays = [s.gram.view(np.int64), c.view(np.int64), d[s.doc], t[s.doc], pos.astype(np.int32), size.astype(np.int64), (s.at - hi).astype(np.int32), (s.at - lo).astype(np.int32), (s.at - a).astype(np.int32)]
            context = pa.array([raw[x:y] for x, y in zip(a.tolist(), b.tolist())], pa.binary())
            return pa.RecordBatch.from_arrays([*map(pa.array, arrays), context], names=["h", "c", "d", "t", "pos", "size", "near", "far", "lead", "context"])

        rows = self.places(select, "h bigint, c bigint, d bigint, t bigint, pos int, size bigint, near int, far int, lead int, context binary", docs)
        rows = self.scratch.keep(rows, "contexts", self.size)
        if shipped is not None:
            shipped.destroy()
        few = rows.where(F.col("size") <= hot).repartition(partitions(self.spark), "h").sortWithinPartitions("h").mapInArrow(frugal(_ordered(window, width)), "h bigint, c bigint, d bigint, t bigint, pos int, gone binary")
        each = rows.where(F.col("size") > hot).mapInArrow(frugal(_exploded(window)), "h bigint, c bigint, d bigint, t bigint, pos int, back int, w bigint, v bigint")
        place = F.struct("d", "t", "pos")
        least = each.groupBy("h", "back", "w", "v").agg(F.min(place).alias("least"))
        late = each.join(least, ["h", "back", "w", "v"]).where(place > F.col("least")).groupBy("h", "c", "d", "t", "pos").agg(F.collect_set("back").alias("backs"))
        many = late.mapInArrow(frugal(_bits(width)), "h bigint, c bigint, d bigint, t bigint, pos int, gone binary")
        return few.unionByName(many)

    def removal(self, spans: DataFrame) -> DataFrame:
        size = spans.agg(F.sum(F.size("spans") * 8 + 64)).first()[0] or 0
        docs = self.docs.select("id", "d", "t", "text").join(F.broadcast(spans) if size <= BROADCAST else spans, ["d", "t"], "left")
        digests = self.digests
        schema = T.StructType(
            [T.StructField("id", self.docs.schema["id"].dataType), *(T.StructField(c, T.LongType()) for c in ("n_bytes", "n_removed", "n_spans")), T.StructField("kept_sha256", T.StringType()) if digests else T.StructField("kept", T.BinaryType()), T.StructField("spans", T.ArrayType(T.LongType(), False))]
        )

        def run(batches):
            for batch in batches:
                data, offsets = text_buffer(batch.column(1))
                size = np.diff(offsets)
                gone = [np.asarray(x.values) if x.is_valid else np.zeros(0, np.int64) for x in batch.column(2)]
                kept = []
                for k, cuts in enumerate(gone):
                    edges = [0, *cuts.tolist(), int(size[k])]
                    raw = data[offsets[k] : offsets[k + 1]].tobytes()
                    rest = b"".join([raw[a:b] for a, b in zip(edges[::2], edges[1::2])]) if len(cuts) else raw
                    kept.append(hashlib.sha256(rest).hexdigest() if digests else rest)
                count = np.array([len(x) // 2 for x in gone], np.int64)
                removed = np.array([int((x[1::2] - x[::2]).sum()) for x in gone], np.int64)
                flat = pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(2 * count)]).astype(np.int32), np.concatenate([np.zeros(0, np.int64), *gone]))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(size), pa.array(removed), pa.array(count), pa.array(kept, pa.string() if digests else pa.binary()), flat], names=schema.names)

        return docs.select("id", "text", "spans").mapInArrow(frugal(run), schema)


def _merged(batches):
    """Rows (d, t, a, e) by document and start: (d, t, spans) with the union of each document's spans; spans that touch are one."""

    def merged(table):
        d, t, a, e = (np.asarray(table.column(c)).astype(np.int64) for c in ("d", "t", "a", "e"))
        new = np.ones(len(d), bool)
        new[1:] = (d[1:] != d[:-1]) | (t[1:] != t[:-1])
        doc = np.cumsum(new) - 1
        lift = doc * (int(e.max()) + 1)  # documents one after the other, so that one running maximum serves all
        reach = np.maximum.accumulate(e + lift)
        fresh = new.copy()
        fresh[1:] |= a[1:] + lift[1:] > reach[:-1]
        begin = np.flatnonzero(fresh)
        end = np.append(begin[1:], len(d)) - 1
        flat = np.stack([a[begin], reach[end] - lift[end]], 1).ravel()
        lead = np.flatnonzero(new)
        count = np.bincount(doc[begin], minlength=len(lead))
        return pa.RecordBatch.from_arrays([pa.array(d[lead]), pa.array(t[lead]), pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(2 * count)]).astype(np.int32), flat)], names=["d", "t", "spans"])

    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        table = table if held is None else pa.concat_tables([held, table])
        d, t = np.asarray(table.column("d")), np.asarray(table.column("t"))
        cut = len(d) - int(((d == d[-1]) & (t == t[-1]))[::-1].cumprod().sum())
        if cut:
            yield merged(table.slice(0, cut))
        held = table.slice(cut)
    if held is not None and held.num_rows:
        yield merged(held)


class Windows:
    """The windows of some contexts: h, c, d, t, pos, near, far, lead of each context, and its bytes."""

    def __init__(self, table: list[np.ndarray], context: list[bytes], window: int):
        self.h, _, _, _, _, near, far, lead = table
        size = np.array([len(x) for x in context], np.int64)
        self.data, self.window = np.frombuffer(b"".join(context), np.uint8), window
        begin = np.cumsum(size) - size
        count = (far - near + 1).astype(np.int64)
        self.row = np.repeat(np.arange(len(size), dtype=np.int32), count)
        self.back = np.repeat(near - (np.cumsum(count) - count), count) + np.arange(len(self.row))
        self.start = np.repeat(begin + lead, count) - self.back

    def hashes(self) -> np.ndarray:
        """Of each window's bytes: two halves that may overlap, each by doubling."""
        half = 8
        while 4 * half <= self.window:
            half *= 2
        whole = _doubled(self.data, half)
        out = mix(whole[self.start])
        for k in range(half, self.window, half):
            out = mix(out * _ODD + whole[self.start + min(k, self.window - half)])
        return out

    def digits(self):
        """The windows' bytes from the first to the last, eight at a time; the last eight may overlap."""
        wide = eights(self.data)
        for k in range(0, self.window, 8):
            yield lambda some, k=k: wide[self.start[some] + min(k, self.window - 8)].byteswap()


def _groups(keys: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Places in order of the keys (the last key first), and for each of these the number of its group of equal keys."""
    order = np.lexsort(keys)
    new = np.zeros(len(order), bool)
    for x in keys:
        y = x[order]
        new[1:] |= y[1:] != y[:-1]
    return order, np.cumsum(new)


def _not_alone(group: np.ndarray) -> np.ndarray:
    """group: ascending numbers. Which of them stand twice or more."""
    same = np.zeros(len(group) + 1, bool)
    same[1:-1] = group[1:] == group[:-1]
    return same[1:] | same[:-1]


def _ordered(window: int, width: int):
    """Groups of contexts with one anchor (adjacent rows): which windows of each also start at an earlier place."""

    def bits(table: list[np.ndarray], context: list[bytes]):
        h, c, d, t, pos = table[:5]
        by_place, rank_of = _groups([pos, t, d])
        rank = np.empty(len(h), np.int64)
        rank[by_place] = rank_of
        w = Windows(table, context, window)
        key = mix(mix(h.view(np.uint64)[w.row] + w.back.astype(np.uint64)) * _ODD + w.hashes())
        order, group = _groups([key])
        some = _not_alone(group)
        order, group = order[some], group[some]
        for digit in w.digits():  # most significant first; group stays the number of what is equal so far
            if not len(order):
                break
            by, now = _groups([digit(order), group])
            order, some = order[by], _not_alone(now)
            order, group = order[some], now[some]
        late = np.zeros((len(h), 8 * -(-width // 8)), np.uint8)
        if len(order):
            by = np.lexsort([rank[w.row[order]], group])
            order, group = order[by], group[by]
            fresh = np.ones(len(order), bool)
            fresh[1:] = group[1:] != group[:-1]
            leader = order[np.maximum.accumulate(np.where(fresh, np.arange(len(order)), 0))]
            again = order[rank[w.row[order]] > rank[w.row[leader]]]
            late[w.row[again], w.back[again]] = 1
        some = np.flatnonzero(late.any(1))
        packed = np.packbits(late[some], axis=1, bitorder="little")
        return pa.RecordBatch.from_arrays([*(pa.array(x[some]) for x in (h, c, d, t, pos)), pa.array([x.tobytes() for x in packed], pa.binary())], names=["h", "c", "d", "t", "pos", "gone"])

    def pieces(table):
        """Whole anchors, of about ORDERED windows together."""
        h = np.asarray(table.column("h"))
        ends = np.append(np.flatnonzero(h[1:] != h[:-1]) + 1, len(h))
        many = np.cumsum(np.asarray(table.column("far")).astype(np.int64) - np.asarray(table.column("near")) + 1)[ends - 1]
        begin = done = 0
        for k, end in enumerate(ends.tolist()):
            if k + 1 == len(ends) or many[k + 1] - done > ORDERED:
                yield table.slice(begin, end - begin)
                begin, done = end, many[k]

    def run(batches):
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            table = table if held is None else pa.concat_tables([held, table])
            h = np.asarray(table.column("h"))
            cut = len(h) - int((h[::-1] == h[-1]).cumprod().sum())
            if cut:
                for part in pieces(table.slice(0, cut)):
                    yield bits(*_unpack(part))
            held = table.slice(cut)
        if held is not None and held.num_rows:
            yield bits(*_unpack(held))

    return run


def _unpack(table):
    numbers = [np.asarray(table.column(c)) for c in ("h", "c", "d", "t", "pos", "near", "far", "lead")]
    return numbers, table.column("context").to_pylist()


def _exploded(window: int):
    def run(batches):
        for batch in batches:
            for s in range(0, batch.num_rows, 2048):
                table, context = _unpack(pa.Table.from_batches([batch.slice(s, 2048)]))
                w = Windows(table, context, window)
                other = np.zeros(len(w.row), np.uint64)
                every = np.arange(len(w.row))
                for digit in w.digits():
                    other = mix(other * np.uint64(0xC2B2AE3D27D4EB4F) + digit(every))
                yield pa.RecordBatch.from_arrays([*(pa.array(x[w.row]) for x in table[:5]), pa.array(w.back.astype(np.int32)), pa.array(w.hashes().view(np.int64)), pa.array(other.view(np.int64))], names=["h", "c", "d", "t", "pos", "back", "w", "v"])

    return run


def _bits(width: int):
    def run(batches):
        for batch in batches:
            late = np.zeros((batch.num_rows, 8 * -(-width // 8)), np.uint8)
            for k, backs in enumerate(batch.column(5).to_pylist()):
                late[k, backs] = 1
            packed = np.packbits(late, axis=1, bitorder="little")
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(5)), pa.array([x.tobytes() for x in packed], pa.binary())], names=["h", "c", "d", "t", "pos", "gone"])

    return run


def remove_repeats(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", window: int = WINDOW, gram: int = GRAM, limit: int = LIMIT, hot: int = HOT, digests: bool = False) -> DataFrame:
    """One row a document: its id, n_bytes, n_removed, n_spans, kept (the bytes that remain; with digests kept_sha256 instead) and spans (starts and
    ends of the removed runs, one after the other)."""
    return Dedup(docs, text_col, id_col, window, gram, limit, hot, digests).run().withColumnRenamed("id", id_col)


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Of what remove_repeats() gives with digests."""
    return found.select(id_col, "n_bytes", "n_removed", "n_spans", "kept_sha256")
