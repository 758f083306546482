"""Operator 3: benchmark decontamination with suffix arrays over the training shards.

The documents that a task reads are cut into shards of bounded size. Each shard is a stream of word hashes; its suffix
array holds the shard's suffixes in order of their words. A suffix whose first two words (its first, where a test window
has one word only) start no test window can't match one, so it is left out before sorting; no match is lost by that.
Every test suffix with a whole window in it is then binary-searched in each shard's array: the range of suffixes that
agree on the window gives all places of it, whose words are then compared byte by byte; from each place the match is run on word by word for the
longest verbatim match. A shard searches only the windows whose first words it has. Documents lie in one shard each, so nothing is shuffled.

The benchmark is gathered on the driver in blocks of at most BLOCK_BYTES of text, counted first, and shipped as arrays (some eight times the text);
the documents pass the blocks one after another and carry what was found along.

Defined cases: a null text has no words and no hits; a benchmark text without words has no window; a null item id is the
empty string among the ids; repeated items count once per id; a very long document forms a shard of its own; bytes that aren't UTF-8 are letters.
"""

from __future__ import annotations


import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cantata.llm.common import ALNUM_OR_WIDE, LOWER, chunks, frugal, mix, text_buffer, word_hashes, words

#: Words of a window.
WINDOW = 10
#: Text bytes of the benchmark that the driver gathers at once.
BLOCK_BYTES = 4 << 20
#: Text bytes of a shard.
SHARD_BYTES = 1 << 20
FILTER_BITS = 22

_EVEN = np.uint64(0xA0761D6478BD642F)


class Words:
    """The words of lower-cased texts: bytes, places, hashes, and each text's first word (n + 1)."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.low = LOWER[data]
        self.starts, self.ends, self.first = words(self.low, offsets, ALNUM_OR_WIDE)
        self.h = word_hashes(self.low, self.starts, self.ends)

    def texts(self, at: int, count: int) -> list[bytes]:
        return [self.low[a:b].tobytes() for a, b in zip(self.starts[at : at + count].tolist(), self.ends[at : at + count].tolist())]

    def equal(self, at: np.ndarray, sought: list[bytes]) -> np.ndarray:
        """At which of these places the words stand, byte by byte."""
        ok = np.ones(len(at), bool)
        for k, word in enumerate(sought):
            some = np.flatnonzero(ok)
            start = self.starts[at[some] + k]
            fits = self.ends[at[some] + k] - start == len(word)
            ok[some[~fits]] = False
            some, start = some[fits], start[fits]
            ok[some] = (self.low[start[:, None] + np.arange(len(word))] == np.frombuffer(word, np.uint8)).all(1)
        return ok


def _pairs(h: np.ndarray) -> np.ndarray:
    """Hash of each word with the next one; the last word's is of no use."""
    out = np.zeros(len(h), np.uint64)
    out[:-1] = mix(h[:-1] * _EVEN + h[1:])
    return out


class TestSet:
    """Windows of a block of items, as arrays: distinct word sequences, each with the items that have it and its places."""

    def __init__(self, items: list[tuple[str, str]], window: int):
        self.window = window
        self.names = sorted({i for i, _ in items})
        place = {name: k for k, name in enumerate(self.names)}
        raw = [(t or "").encode() for _, t in items]
        offsets = np.concatenate([[0], np.cumsum([len(x) for x in raw])]).astype(np.int64)
        w = self.words = Words(np.frombuffer(b"".join(raw), np.uint8), offsets)
        count = np.diff(w.first)
        size = np.minimum(count, window)
        each = np.where(count > 0, count - size + 1, 0)
        item = np.repeat(np.arange(len(items)), each)
        at = w.first[:-1][item] + np.arange(len(item)) - np.repeat(np.cumsum(each) - each, each)
        size, stop = size[item], w.first[1:][item]
        owner = np.array([place[i] for i, _ in items], np.int32)[item] if len(items) else np.zeros(0, np.int32)
        order = np.lexsort([*self._keys(at, size).T[::-1], size])
        at, size, stop, owner = at[order], size[order], stop[order], owner[order]
        keys = self._keys(at, size)
        new = np.ones(len(at), bool)
        new[1:] = (keys[1:] != keys[:-1]).any(1) | (size[1:] != size[:-1])
        del keys
        text = None
        for k in range(len(at)):  # equal hashes are one window if their words are equal, too
            if new[k]:
                text = None
                continue
            text = text or w.texts(at[k - 1], size[k - 1])
            new[k] = w.texts(at[k], size[k]) != text
            if new[k]:
                text = None
        begin = np.flatnonzero(new)
        #: The first place of each window, its words, and the range of its places.
        self.at, self.size, self.begin = at[begin].astype(np.int32), size[begin].astype(np.int8), np.append(begin, len(at)).astype(np.int32)
        #: Places: first word, end of the item, and item.
        self.start, self.stop, self.owner = at.astype(np.int32), stop.astype(np.int32), owner
        #: Windows by their first two words (their one word), as sorted hashes.
        h = w.h
        lead = np.where(self.size == 1, h[self.at], mix(h[self.at] * _EVEN + h[np.minimum(self.at + 1, max(len(h) - 1, 0))])) if len(self.at) else np.zeros(0, np.uint64)
        self.leads = []
        for some in (np.flatnonzero(self.size == 1), np.flatnonzero(self.size > 1)):
            some = some[np.argsort(lead[some], kind="stable")]
            self.leads.append((lead[some], some.astype(np.int32)))
        self.single, self.double = (np.unique(x) for x, _ in self.leads)
        self.bits = np.zeros(1 << FILTER_BITS, bool)
        self.bits[(self.double >> np.uint64(64 - FILTER_BITS)).astype(np.intp)] = True

    def _keys(self, at: np.ndarray, size: np.ndarray) -> np.ndarray:
        """The word hashes of windows, zeros behind a short one."""
        k = np.arange(self.window)
        if not len(at):
            return np.zeros((0, self.window), np.uint64)
        return np.where(k < size[:, None], self.words.h[np.minimum(at[:, None].astype(np.int64) + k, len(self.words.h) - 1)], np.uint64(0))

    def keys(self, windows: np.ndarray) -> np.ndarray:
        return self._keys(self.at[windows], self.size[windows])

    def led_by(self, single: np.ndarray, double: np.ndarray) -> np.ndarray:
        """Windows that begin with one of these words or pairs (distinct hashes)."""
        out = []
        for (lead, window), x in zip(self.leads, (single, double)):
            lo, hi = np.searchsorted(lead, x), np.searchsorted(lead, x, side="right")
            count = hi - lo
            out.append(window[np.repeat(lo - (np.cumsum(count) - count), count) + np.arange(count.sum())])
        return np.concatenate(out)


def _member(sorted_values: np.ndarray, x: np.ndarray) -> np.ndarray:
    if not len(sorted_values):
        return np.zeros(len(x), bool)
    at = np.minimum(np.searchsorted(sorted_values, x), len(sorted_values) - 1)
    return sorted_values[at] == x


class Shard:
    """Suffix array over the word stream of some documents, of the suffixes that can start a test window."""

    def __init__(self, found: Words, test: TestSet):
        self.words, h, first = found, found.h, found.first
        self.h = h
        self.end = np.repeat(first[1:], np.diff(first))  # of each word's document
        pair = _pairs(h)
        ok = test.bits[(pair >> np.uint64(64 - FILTER_BITS)).astype(np.intp)]
        at = np.flatnonzero(ok)
        at = at[(at + 1 < self.end[at]) & _member(test.double, pair[at])]
        alone = np.flatnonzero(_member(test.single, h)) if len(test.single) else at[:0]
        self.windows = test.led_by(np.unique(h[alone]), np.unique(pair[at]))
        if len(alone):
            at = np.union1d(at, alone)
        place = at[:, None] + np.arange(test.window)
        inside = place < self.end[at][:, None]
        key = np.where(inside, h[np.minimum(place, max(len(h) - 1, 0))], np.uint64(0)) if len(at) else np.zeros((0, test.window), np.uint64)
        length = inside.sum(1)
        order = np.lexsort([length, *key.T[::-1]])
        self.suffix, self.key, self.length = at[order], key[order], length[order]

    def search(self, test: TestSet) -> tuple[np.ndarray, np.ndarray]:
        """For every window that can be here (self.windows), the range of the suffix array whose suffixes begin with it."""
        sought_keys, size = test.keys(self.windows), test.size[self.windows]
        wild = np.arange(test.window) >= size[:, None]

        def bound(right: bool) -> np.ndarray:
            lo, hi = np.zeros(len(size), np.int64), np.full(len(size), len(self.suffix), np.int64)
            while (open_ := lo < hi).any():
                k = np.flatnonzero(open_)
                mid = (lo[k] + hi[k]) // 2
                mine, sought = self.key[mid], sought_keys[k]
                differs = (mine != sought) & ~wild[k]
                d = differs.argmax(1)
                some = differs[np.arange(len(k)), d]
                a, b = mine[np.arange(len(k)), d], sought[np.arange(len(k)), d]
                before = np.where(some, a < b, right)
                lo[k[before]] = mid[before] + 1
                hi[k[~before]] = mid[~before]
            return lo

        return bound(False), bound(True)


def _longest(shard: Shard, suffix: int, w: int, test: TestSet) -> int:
    """Words that agree from a place of a window on, at the best of its places in the test set."""
    best = int(test.size[w])
    limit = int(shard.end[suffix]) - suffix
    for s, stop in zip(test.start[test.begin[w] : test.begin[w + 1]].tolist(), test.stop[test.begin[w] : test.begin[w + 1]].tolist()):
        n = min(limit, stop - s)
        if n > best:
            differs = shard.h[suffix : suffix + n] != test.words.h[s : s + n]
            d = int(differs.argmax()) if differs.any() else n
            best = max(best, d)
    return best


_FOUND = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("spans", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))),
        T.StructField("items", T.ArrayType(T.StringType())),
        T.StructField("longest", T.LongType()),
    ]
)


def _union(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _scan(df: DataFrame, test: TestSet, carried: list[str]) -> DataFrame:
    """df: carried columns, __text, and __found of the blocks before. Gives the same with __found brought up to date."""
    shipped = df.sparkSession.sparkContext.broadcast(test)
    schema = T.StructType([*(df.schema[c] for c in carried), T.StructField("__text", T.StringType()), T.StructField("__found", _FOUND)])
    k = len(carried)

    def run(batches):
        test = shipped.value
        for batch in batches:
            data, offsets = text_buffer(batch.column(k))
            before = batch.column(k + 1)
            for i, j in chunks(offsets, SHARD_BYTES):
                part = offsets[i : j + 1]
                mine = Words(data[part[0] : part[-1]], part - part[0])
                first = mine.first
                hits: dict[int, tuple[list, set, int]] = {}
                if len(test.size) and len(mine.h):
                    shard = Shard(mine, test)
                    lo, hi = shard.search(test)
                    for k_ in np.flatnonzero(lo < hi).tolist():
                        w = int(shard.windows[k_])
                        size = int(test.size[w])
                        at = shard.suffix[lo[k_] : hi[k_]]
                        at = at[mine.equal(at, test.words.texts(int(test.at[w]), size))]
                        owners = set(test.owner[test.begin[w] : test.begin[w + 1]].tolist())
                        for d, s in zip((np.searchsorted(first, at, side="right") - 1).tolist(), at.tolist()):
                            spans, items, best = hits.get(d, ([], set(), 0))
                            start = s - int(first[d])
                            spans.append((start, start + size))
                            items |= owners
                            hits[d] = (spans, items, max(best, _longest(shard, s, w, test)))
                count = np.diff(first).tolist()
                rows = []
                old = before.slice(i, j - i)
                for d in range(j - i):
                    spans, items, best = hits.get(d, ([], set(), 0))
                    names = {test.names[x] for x in items}
                    if (was := old[d].as_py()) is not None:
                        spans = spans + [(x["start"], x["end"]) for x in was["spans"]]
                        names |= set(was["items"])
                        best = max(best, was["longest"])
                    rows.append({"n_words": count[d], "spans": [{"start": a, "end": b} for a, b in _union(spans)], "items": sorted(names), "longest": best})
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(i, j - i) for c in range(k + 1)), pa.array(rows, _arrow_found())], names=schema.names)

    return df.select(*carried, "__text", "__found").mapInArrow(frugal(run), schema)


def _arrow_found():
    return pa.struct([("n_words", pa.int64()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("items", pa.list_(pa.string())), ("longest", pa.int64())])


def find(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",), item_id: str = "item_id", item_text: str = "text", with_text: bool = False) -> DataFrame:
    """One row a document: the kept columns, n_words, spans (word ranges that lie in an occurrence of a window), items
    (ids, sorted as strings) and longest (words of its longest verbatim match of a window or more, 0 if none)."""
    items = benchmark.select(F.coalesce(F.col(item_id).cast("string"), F.lit("")).alias("id"), F.coalesce(F.col(item_text), F.lit("")).alias("t"))
    size = items.agg(F.sum(F.octet_length("t") + 16)).first()[0] or 0
    blocks = -(-size // BLOCK_BYTES) or 1
    df = docs.select(*keep, F.col(text_col).cast("string").alias("__text"), F.lit(None).cast(_FOUND).alias("__found"))
    for b in range(blocks):
        part = items if blocks == 1 else items.where(F.pmod(F.xxhash64("id", "t"), F.lit(blocks)) == b)
        df = _scan(df, TestSet([(r.id, r.t) for r in part.collect()], window), list(keep))
    out = df.select(*keep, *(["__text"] if with_text else []), F.col("__found.n_words").alias("n_words"), F.col("__found.spans").alias("spans"), F.col("__found.items").alias("items"), F.col("__found.longest").alias("longest"))
    return out


def hit_words():
    """Words of the spans of find()."""
    return F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])


def digest(found: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    return found.select(
        *keep,
        "n_words",
        hit_words().alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"),
        F.col("longest").alias("longest_match"),
    )


