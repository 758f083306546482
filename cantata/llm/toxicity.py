"""Operator 7: toxicity by class-conditional Kneser-Ney models.

Two bigram models, toxic and ordinary: raw counts of word pairs on top, then continuation counts of the class, and below both one
distribution that the classes share, the continuation counts of all documents over their whole vocabulary. Each level has one absolute
discount, estimated from its counts of counts (n1 / (n1 + 2 n2), between 0 and 1); what it frees backs off to the level below. As usual in
language models, n-grams that a class has seen less often than a cutoff are left to the back-off; the cutoffs (1 cuts nothing) are chosen by
the fit on held-out rows, and may leave the pairs out altogether.

A text's score comes from length-normalised log-likelihood ratios: that of the whole text, and of its windows of WINDOWS words the two highest of each size that don't
overlap (an insult vanishes in the mean over thousands of words). A logistic curve over these, with no weight below 0, gives 0 to 1.

What is fitted: class counts on at most SAMPLE_ROWS / 2 labelled rows, as many toxic as ordinary ones, and cutoffs and curve on as many other rows
(those whose ids have the smallest hashes; of each role the texts that fit into SAMPLE_BYTES). Executors count; the driver receives distinct n-grams of the
sample and its rows as places in them, never texts. The shared counts are those of the distinct word pairs of every document; each task leaves out the
pairs that it has met and packs the others by word (each in 48 bits of its hash beside its word's 64) before they are shuffled.

Defined cases: a null or empty text, or one without words, has the score of a text with ratio 0 everywhere, which lies below 0.5
unless most labelled rows are toxic. Rows are scored one by one, whole however long they are; a label that is null, or whose id has no document, is
not used; an id labelled twice counts with its largest label; without labels of both kinds every score is 0. Other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cantata.llm.common import ALNUM_OR_WIDE, CHUNK_BYTES, LOWER, chunks, frugal, mix, partitions, release, text_buffer, word_hashes, words

#: Labelled rows that the models are fitted on, at most.
SAMPLE_ROWS = 8192
#: Text bytes of each role's rows (toxic, ordinary, curve), at most.
SAMPLE_BYTES = 16 << 20
#: Lengths of the windows that a text's highest ratios are taken from, in words, and how many of each.
WINDOWS, TOPS = (1, 2, 4, 8), 2
#: Counts below which an n-gram of a class is left to the back-off, to choose from; for pairs also none at all.
CUTOFFS = (1, 2, 3, 4, 6, 9, 13, 20, 30, 45)
NO_PAIRS = 1 << 40
#: Bytes of word pairs that are shipped to the executors, at most; if the sample has more, those that it has least often are left to the back-off.
MAX_PAIR_BYTES = 64 << 20
#: Word pairs that a task holds, about.
HELD_PAIRS = 1 << 21
#: Groups that the corpus's words are dealt to. The pairs of a word that makes up more than HOT_SHARE of the sample go to all of them.
BUCKETS, HOT_SHARE = 4096, 1e-3
#: Parts in which a task sorts its pairs: by the first two bits of a word's hash, or by the bucket.
PARTS = 4
ORDINARY, TOXIC = 0, 1

_ODD = np.uint64(0xA0761D6478BD642F)
_START = np.uint64(0x5BD1E995)


def held_out(doc_id: Column) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(5)) == 0


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes, hashes of each word with the one before it, and each document's first word (n + 1)."""
    h, before, first = tokens_and_histories(data, offsets)
    return h, mix(before * _ODD + h), first


def tokens_and_histories(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes, the hash of the word before each, and each document's first word (n + 1)."""
    low = LOWER[data]
    starts, ends, first = words(low, offsets, ALNUM_OR_WIDE)
    h = word_hashes(low, starts, ends)
    before = np.empty_like(h)
    before[1:] = h[:-1]
    before[first[:-1][first[:-1] < len(h)]] = _START
    return h, before, first


def lookup(keys: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Place of each x among the sorted keys, or -1."""
    if not len(keys):
        return np.full(len(x), -1)
    at = np.searchsorted(keys, x)
    at[at == len(keys)] = 0
    return np.where(keys[at] == x, at, -1)


@dataclass
class Model:
    """Log-ratios by sorted hashes: of words and, last, what stands for words of neither class; of known histories (their back-off weights); of known pairs."""

    word: np.ndarray
    word_ratio: np.ndarray
    history: np.ndarray
    history_ratio: np.ndarray
    pair: np.ndarray
    pair_ratio: np.ndarray
    curve: np.ndarray  # constant, and a weight for each of the summary's columns

    def ratios(self, h: np.ndarray, before: np.ndarray) -> np.ndarray:
        r = self.word_ratio[lookup(self.word, h)]
        if len(self.history):
            k = lookup(self.history, before)
            r = np.where(k >= 0, r + self.history_ratio[k], r)
        if len(self.pair):
            k = lookup(self.pair, mix(before * _ODD + h))
            r = np.where(k >= 0, self.pair_ratio[k], r)
        return r

    def score(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        h, before, first = tokens_and_histories(data, offsets)
        return curve_value(self.curve, Windows(first).summary(self.ratios(h, before)))


class Windows:
    """Where the windows of some documents lie; first: each document's first word (n + 1)."""

    def __init__(self, first: np.ndarray):
        self.count = np.diff(first)
        self.full = np.flatnonzero(self.count)
        self.begin, self.end = first[self.full], first[self.full + 1]
        self.size = self.count[self.full]
        self.doc = np.repeat(np.arange(len(self.full), dtype=np.int32), self.size)

    def summary(self, r: np.ndarray) -> np.ndarray:
        """Of each document: the mean log-ratio, and for each size the mean ratios of the highest window and of the highest that doesn't touch it. A window that
        the text's end cuts short counts with its full length."""
        out = np.zeros((len(self.count), 1 + TOPS * len(WINDOWS)))
        if not len(self.full):
            return out
        total = np.concatenate([[0], np.cumsum(r, dtype=np.float64)])
        out[self.full, 0] = (total[self.end] - total[self.begin]) / self.size
        for k, width in enumerate(WINDOWS):
            sums = (total[np.minimum(np.arange(len(r)) + width, np.repeat(self.end, self.size))] - total[:-1]) / width
            for top in range(TOPS):
                best = np.maximum.reduceat(sums, self.begin)
                out[self.full, 1 + TOPS * k + top] = best
                if top + 1 < TOPS:
                    place = np.flatnonzero(sums == best[self.doc])
                    at = np.empty(len(self.full), np.int64)
                    at[self.doc[place[::-1]]] = place[::-1]
                    for step in range(1 - width, width):
                        near = at + step
                        sums[near[(near >= self.begin) & (near < self.end)]] = -1.0
        return np.maximum(out, -1.0)


def curve_value(curve: np.ndarray, x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(curve[0] + x @ curve[1:], -30, 30)))


def fit_curve(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Logistic regression by Newton steps, with a small ridge. Columns whose weight would be below 0 are taken out one after the other, the lowest first: more toxic windows never
    make a text less toxic."""
    use = list(range(x.shape[1]))
    while True:
        w = _newton(x[:, use], y)
        if not use or w[1:].min() >= 0:
            out = np.zeros(1 + x.shape[1])
            out[[0, *(1 + k for k in use)]] = w
            return out
        use.pop(int(w[1:].argmin()))


def _newton(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    a = np.hstack([np.ones((len(x), 1)), x])
    w = np.zeros(a.shape[1])
    ridge = np.diag([1e-6, *[0.05] * x.shape[1]])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + ridge, a.T @ (y - p) - ridge @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def discount_of(counts: np.ndarray) -> float:
    """Kneser-Ney's absolute discount, from how many n-grams were seen once and twice."""
    once, twice = int((counts == 1).sum()), int((counts == 2).sum())
    return once / (once + 2 * twice) if once else 0.5


class Trainer:
    """Counts of the sample and the models that they make. before, word, count (n, 2): distinct pairs of words and how often each class has them."""

    def __init__(self, before: np.ndarray, word: np.ndarray, count: np.ndarray):
        pair = mix(before * _ODD + word)
        order = np.argsort(pair)
        self.pair, before, word, self.count = pair[order], before[order], word[order], count[order]
        self.word, self.last = np.unique(word, return_inverse=True)
        self.history, self.place = np.unique(before, return_inverse=True)
        summed = lambda of, n, x: np.stack([np.bincount(of, weights=x[:, k], minlength=n) for k in (ORDINARY, TOXIC)], 1)
        self.continues = summed(self.last, len(self.word), self.count > 0)
        self.times = np.bincount(self.last, weights=self.count.sum(1), minlength=len(self.word))
        self.after = summed(self.place, len(self.history), self.count)
        self.summed = summed
        self.discounts = np.array([[discount_of(x[:, k]) for k in (ORDINARY, TOXIC)] for x in (self.continues, self.count)])

    def shipped(self) -> tuple[np.ndarray, int]:
        """Places of the pairs that executors get, and how often a class must have had one: once, unless that would be too many."""
        most, least = self.count.max(1, initial=0), 1
        while 16 * (most >= least).sum() > MAX_PAIR_BYTES:
            least += 1
        return np.flatnonzero(most >= least), least

    def hot(self) -> np.ndarray:
        return self.word[self.times > HOT_SHARE * self.times.sum()]

    def words_model(self, shared: np.ndarray, cutoff: int) -> tuple[np.ndarray, np.ndarray]:
        """(n, 2): continuation probability of each word by class; (2,): the weight of the shared distribution. shared: of each word."""
        total = np.maximum(self.continues.sum(0), 1)
        held = np.where(self.continues >= cutoff, self.continues - self.discounts[0], 0.0) / total
        back = np.maximum(1 - held.sum(0), 1e-9)
        return held + back * shared[:, None], back

    def ratios(self, shared: np.ndarray, word_cutoff: int, pair_cutoff: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Log-ratios: of words (that of unknown ones last), of histories and of pairs; a pair that no class keeps has that of its word and history."""
        low, back = self.words_model(shared, word_cutoff)
        log = lambda p: np.log(p[..., TOXIC]) - np.log(p[..., ORDINARY])
        word = np.append(log(low), log(back))
        if pair_cutoff >= NO_PAIRS:
            return word, np.zeros(len(self.history)), word[self.last]
        held = np.where(self.count >= pair_cutoff, self.count - self.discounts[1], 0.0)
        after = np.maximum(self.after, 1)
        weight = np.maximum(1 - self.summed(self.place, len(self.history), held) / after, 1e-9)
        return word, log(weight), log(held / after[self.place] + weight[self.place] * low[self.last])

    def model(self, shared: np.ndarray, word_cutoff: int, pair_cutoff: int, curve: np.ndarray) -> Model:
        """Only what differs from the rest is kept."""
        word, history, pair = self.ratios(shared, word_cutoff, pair_cutoff)
        of_word = (self.continues >= word_cutoff).any(1)
        of_history = history != 0
        of_pair = (self.count >= pair_cutoff).any(1)
        return Model(self.word[of_word], word[np.append(of_word, True)].astype(np.float32), self.history[of_history], history[of_history].astype(np.float32), self.pair[of_pair], pair[of_pair].astype(np.float32), curve)


def _sample(docs: DataFrame, labels: DataFrame, rows: int, text_col: str, id_col: str) -> DataFrame | None:
    """role (ordinary, toxic or curve as 0, 1, 2), label and text of the sample: as many toxic as ordinary rows for the counts, rows as they come for the curve."""
    known = labels.where(f"{id_col} is not null and toxic is not null").groupBy(id_col).agg((F.max("toxic") > 0).cast("int").alias("label"))
    crc = F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(5))
    role = F.when(crc == 1, 2).otherwise(F.col("label"))
    known = known.where(crc != 0).select(id_col, "label", role.alias("role"), F.xxhash64(id_col).alias("h"))
    chosen = [tuple(r) for role, most in ((ORDINARY, rows // 4), (TOXIC, rows // 4), (2, rows // 2)) for r in known.where(F.col("role") == role).orderBy("h", id_col).limit(most).collect()]
    if not chosen:
        return None
    kind = docs.schema[id_col].dataType
    make = lambda rows: F.broadcast(docs.sparkSession.createDataFrame(rows, T.StructType([T.StructField("__id", kind), *(T.StructField(c, T.IntegerType()) for c in ("label", "role")), T.StructField("h", T.LongType())])))
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    docs = docs.select(F.col(id_col).alias("__id"), text.alias("__text"))
    sizes = {r["__id"]: r.n for r in docs.join(make(chosen), "__id").groupBy("__id").agg(F.sum(F.octet_length("__text")).alias("n")).collect()}
    fits, used = [], {}
    for r in chosen:
        total = used.get(r[2], 0) + sizes.get(r[0], SAMPLE_BYTES + 1)
        if total <= SAMPLE_BYTES:
            used[r[2]] = total
            fits.append(r)
    return docs.join(make(fits), "__id").select("role", "label", "__text") if fits else None


def _counted(sample: DataFrame) -> Trainer:
    """Pairs of words of the sample's toxic and ordinary rows, with their counts."""

    def run(batches):
        for batch in batches:
            role = np.asarray(batch.column(0)).astype(np.uint64)
            data, offsets = text_buffer(batch.column(1))
            for i, j in chunks(offsets, CHUNK_BYTES):
                h, before, first = tokens_and_histories(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                kind = np.repeat(role[i:j], np.diff(first))
                _, at, n = np.unique(mix(mix(before * _ODD + h) + kind), return_index=True, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(before[at].view(np.int64)), pa.array(h[at].view(np.int64)), *(pa.array(np.where(kind[at] == k, n, 0)) for k in (ORDINARY, TOXIC))], names=["before", "word", "ordinary", "toxic"])

    seen = sample.where("role < 2").select("role", "__text").mapInArrow(frugal(run), "before bigint, word bigint, ordinary bigint, toxic bigint")
    got = seen.groupBy("before", "word").agg(F.sum("ordinary").cast("int").alias("ordinary"), F.sum("toxic").cast("int").alias("toxic")).toArrow()
    before, word, ordinary, toxic = (np.asarray(got.column(c)) for c in got.column_names)
    del got
    out = Trainer(before.view(np.uint64), word.view(np.uint64), np.stack([ordinary, toxic], 1))
    del before, word, ordinary, toxic
    release()
    return out


def _placed(sample: DataFrame, trainer: Trainer) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The curve's rows: labels, each one's first word (n + 1), and the places of words, histories and pairs among the trainer's; what it doesn't know has -1."""
    known, _ = trainer.shipped()
    shipped = sample.sparkSession.sparkContext.broadcast((trainer.word, trainer.history, trainer.pair[known]))

    def run(batches):
        word, history, pair = shipped.value
        for batch in batches:
            data, offsets = text_buffer(batch.column(1))
            for i, j in chunks(offsets, CHUNK_BYTES):
                h, before, first = tokens_and_histories(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                places = np.stack([lookup(word, h), lookup(history, before), lookup(pair, mix(before * _ODD + h))], 1).astype("<i4")
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array([places[a:b].tobytes() for a, b in zip(first.tolist(), first[1:].tolist())], pa.binary())], names=["label", "places"])

    got = sample.where("role = 2").select("label", "__text").mapInArrow(frugal(run), "label int, places binary").toArrow()
    shipped.destroy()
    raw, y = got.column("places").to_pylist(), np.asarray(got.column("label")).astype(float)
    del got
    first = np.concatenate([[0], np.cumsum([len(x) // 12 for x in raw])]).astype(np.int64)
    places = np.array(np.frombuffer(b"".join(raw), "<i4").reshape(-1, 3).T)
    del raw
    if len(known) < len(trainer.pair):
        places[2] = np.append(known, -1)[places[2]]
    release()
    return y, first, *places


def _continuations(docs: DataFrame, hot: np.ndarray, text_col: str) -> DataFrame:
    """word, n: of each word (its hash) in all documents, how many distinct words and text starts it follows. hot: sorted hashes of frequent words (at most 1 / HOT_SHARE)."""
    packed = T.StructType([T.StructField("bucket", T.IntegerType()), *(T.StructField(c, T.BinaryType()) for c in ("words", "counts", "pairs"))])

    def distinct(word, pair, bucket):
        """Distinct pairs by bucket and word, and where each word of a bucket begins (n + 1)."""
        order = np.lexsort([pair, word, bucket])
        word, pair, bucket = word[order], pair[order], bucket[order]
        new = np.ones(len(word), bool)
        new[1:] = (bucket[1:] != bucket[:-1]) | (word[1:] != word[:-1])
        fresh = new.copy()
        fresh[1:] |= pair[1:] != pair[:-1]
        return word[fresh], pair[fresh], bucket[fresh], np.append(np.flatnonzero(new[fresh]), fresh.sum())

    def together(held):
        """All words and pairs; the list is emptied, so that they aren't held twice."""
        word, pair = (np.concatenate(x) for x in zip(*held))
        held.clear()
        return word, pair

    def in_parts(word, pair, part):
        """Word, pair and part number (below PARTS) of one part after the other, so that what sorting takes is that much less."""
        for k in range(PARTS):
            some = np.flatnonzero(part == k)
            yield word[some], pair[some], some

    def merged(held):
        """Distinct pairs by word, and where each word begins (n + 1)."""
        word, pair = together(held)
        done = [distinct(w, p, np.zeros(len(w), np.uint16)) for w, p, _ in in_parts(word, pair, word >> np.uint64(62))]
        del word, pair
        at = np.cumsum([0, *(len(x[0]) for x in done)])
        begin = np.concatenate([*(x[3][:-1] + a for x, a in zip(done, at)), at[-1:]])
        return np.concatenate([x[0] for x in done]), np.concatenate([x[1] for x in done]), None, begin

    def planes(x):
        """All first bytes, then all second ones and so on: sorted values have equal high bytes, which the shuffle compresses."""
        return x.view(np.uint8).reshape(len(x), -1).T.tobytes()

    def values(raw, dtype):
        size = np.dtype(dtype).itemsize
        return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(size, -1).T).view(dtype)[:, 0]

    def bucket_of(word, pair):
        """Words are dealt by their hashes, and the pairs of hot ones by their own."""
        return (np.where(lookup(hot, word) >= 0, pair >> np.uint64(52), word >> np.uint64(52)) % np.uint64(BUCKETS)).astype(np.uint16)

    def pack(held):
        for part in held:
            if part:
                word, pair = together(part)
                yield from packed_part(*distinct(word, pair >> np.uint64(16), bucket_of(word, pair)))

    def packed_part(word, pair, bucket, begin):
        low = pair.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]
        count = np.diff(begin).astype("<u4")
        lead = word[begin[:-1]]
        edge = np.flatnonzero(np.diff(bucket[begin[:-1]].astype(np.int64), prepend=-1, append=-1))
        for k in range(0, len(edge) - 1, 256):
            spans = list(zip(edge[k : k + 256].tolist(), edge[k + 1 : k + 257].tolist()))
            parts = [(bucket[begin[a]], planes(lead[a:b]), planes(count[a:b]), low[begin[a] : begin[b]].T.tobytes()) for a, b in spans]
            columns = list(zip(*parts))
            yield pa.RecordBatch.from_arrays([pa.array(np.array(columns[0], np.int32)), *(pa.array(c, pa.binary()) for c in columns[1:])], names=packed.names)

    def gather(batches):
        """Pairs are held in PARTS parts by their bucket, each of which is sorted alone, so that what sorting takes is that much less."""
        held, size = [[] for _ in range(PARTS)], 0
        for batch in batches:
            data, offsets = text_buffer(batch.column(0))
            for i, j in chunks(offsets, CHUNK_BYTES):
                h, pairs, _ = tokens(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                part = bucket_of(h, pairs) // (BUCKETS // PARTS)
                for k in range(PARTS):
                    some = np.flatnonzero(part == k)
                    held[k].append((h[some], pairs[some]))
                size += len(h)
                if size > HELD_PAIRS:
                    size = 0
                    for part in held:
                        word, pair = together(part)
                        part.append(distinct(word, pair, np.zeros(len(word), np.uint16))[:2])
                        size += len(part[0][0])
                    if size > 3 * HELD_PAIRS // 4:
                        yield from pack(held)
                        size = 0
        if size:
            yield from pack(held)

    def count(held):
        word, _, _, begin = merged(held)
        return pa.RecordBatch.from_arrays([pa.array(word[begin[:-1]].view(np.int64)), pa.array(np.diff(begin).astype(np.int64))], names=["word", "n"])

    def reduce(batches):
        now, held, size = None, [], 0
        for batch in batches:
            for bucket, words_, counts, low in zip(*(c.to_pylist() for c in batch.columns)):
                if bucket != now and held:
                    yield count(held)
                    held, size = [], 0
                now = bucket
                pair = np.zeros((len(low) // 6, 8), np.uint8)
                pair[:, :6] = np.frombuffer(low, np.uint8).reshape(6, -1).T
                held.append((np.repeat(values(words_, np.uint64), values(counts, "<u4")), pair.view("<u8")[:, 0]))
                size += len(pair)
                if size > 2 * HELD_PAIRS:
                    held = [merged(held)[:2]]
                    size = min(len(held[0][0]), HELD_PAIRS)
        if held:
            yield count(held)

    dealt = docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(frugal(gather), packed).repartition(partitions(docs.sparkSession), "bucket")
    return dealt.sortWithinPartitions("bucket").mapInArrow(frugal(reduce), "word bigint, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def _shared(docs: DataFrame, vocabulary: np.ndarray, hot: np.ndarray, text_col: str) -> np.ndarray:
    """Probability of each word of the sorted vocabulary by the continuation counts of all documents, one added to every word's and to that of unknown ones."""
    shipped = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches):
        keys, words_, total = shipped.value, 0, 0
        for batch in batches:
            word, n = (np.asarray(batch.column(c)) for c in (0, 1))
            place = lookup(keys, word.view(np.uint64))
            words_, total = words_ + len(n), total + int(n.sum())
            yield pa.RecordBatch.from_arrays([pa.array(place[place >= 0]), pa.array(n[place >= 0])], names=["place", "n"])
        yield pa.RecordBatch.from_arrays([pa.array([-1, -2]), pa.array([words_, total])], names=["place", "n"])

    rows = _continuations(docs, hot, text_col).mapInArrow(frugal(run), "place bigint, n bigint").toArrow()
    shipped.destroy()
    place, n = (np.asarray(rows.column(c)).astype(np.int64) for c in ("place", "n"))
    seen = np.zeros(len(vocabulary), np.int64)
    seen[place[place >= 0]] = n[place >= 0]
    below = n[place < 0].sum() + 1.0
    del rows, place, n
    release()
    return (seen + 1.0) / below


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, text_col: str = "text", id_col: str = "doc_id") -> Model | None:
    """The models and their curve; None without labelled rows of both kinds."""
    sample = _sample(docs, labels, sample_rows, text_col, id_col)
    if sample is None:
        return None
    trainer = _counted(sample)
    if not trainer.count.any(0).all():
        return None
    y, first, word, history, pair = _placed(sample, trainer)
    if len(set(y)) < 2:
        return None
    shared = _shared(docs, trainer.word, trainer.hot(), text_col)

    windows, (_, least) = Windows(first), trainer.shipped()

    def tried(word_cutoff: int, pair_cutoff: int):
        of_word, of_history, of_pair = trainer.ratios(shared, word_cutoff, pair_cutoff)
        r = of_word[word]
        if pair_cutoff < NO_PAIRS:
            r = np.where(pair >= 0, of_pair[pair], r + np.where(history >= 0, of_history[history], 0.0))
        x = windows.summary(r)
        curve = fit_curve(x, y)
        p = np.clip(curve_value(curve, x), 1e-9, 1 - 1e-9)
        return -(y * np.log(p) + (1 - y) * np.log(1 - p)).mean(), (word_cutoff, pair_cutoff, curve)

    best = lambda choices: min((tried(*c) for c in choices), key=lambda x: x[0])
    now = best((k, NO_PAIRS) for k in CUTOFFS)
    k = now[1][0]
    now = min(now, best((k, c) for c in sorted({max(c, least) for c in CUTOFFS})), key=lambda x: x[0])
    model = trainer.model(shared, *now[1])
    del trainer, windows, word, history, pair, shared, tried, best
    release()
    return model


def score(docs: DataFrame, model: Model | None, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """One row a row: the kept columns and score; a kept column of that name gives way to it."""
    keep = tuple(c for c in keep if c != "score")
    fields = [*(T.StructField(c, docs.schema[c].dataType) for c in keep), T.StructField("score", T.DoubleType())]
    k = len(keep)
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        model = shipped.value
        for batch in batches:
            data, offsets = text_buffer(batch.column(k))
            for i, j in chunks(offsets, CHUNK_BYTES):
                value = np.zeros(j - i) if model is None else model.score(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(i, j - i) for c in range(k)), pa.array(value)], names=[f.name for f in fields])

    return docs.select(*keep, F.col(text_col).cast("string").alias("__text")).mapInArrow(frugal(run), T.StructType(fields))


def classify(docs: DataFrame, labels: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """One row a document: its id, held_out, score and predicted."""
    scored = score(docs, fit(docs, labels, text_col=text_col, id_col=id_col), text_col, (id_col,))
    return scored.select(id_col, F.coalesce(held_out(F.col(id_col)), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
