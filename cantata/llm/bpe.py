"""Operator 2: byte-level BPE encoding and decoding.

Pre-tokenisation works on arrays, without a regular expression. Every code point becomes a symbol: its class (letter,
number, other, blank, other white space) with what the pattern must know of its neighbours (white space that stands last
before a visible character; an apostrophe with a contraction's letters behind it; the first character of a document).
Each symbol is a transition function of a small automaton. The functions that arise by composition form a finite monoid,
so the state before each character comes from an associative scan over monoid ids: inside blocks side by side, then across
blocks. The automaton's output marks where a piece starts.

The pieces, byte slices of the text, go through a cache of merged pieces; a new piece is merged by rank, lowest first and
leftmost first. Offsets of the tokens are kept, so any token can be traced back and the text decoded.

Defined cases: a null or empty text has no tokens; bytes that aren't UTF-8 become U+FFFD before they are encoded; a very long text is encoded whole, in one task; rows are encoded one by one, so repeated rows and ties are nothing
special; an empty table gives an empty result; other columns are not read. The vocabulary is a file of base64 tokens and
ranks whose path is a parameter; the driver reads it and ships it with the function (its size is checked).
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import os

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from cantata.llm.common import chunks, frugal, text_buffer

#: A vocabulary file larger than this isn't shipped to the executors.
MAX_VOCABULARY_BYTES = 64 << 20
#: Merged pieces that a worker remembers, in two generations of this size.
CACHE_PIECES = 100_000
#: Text bytes that are encoded at once; a longer document is encoded alone.
ENCODE_BYTES = 1 << 18
#: Pieces longer than this are merged with a heap.
LONG_PIECE = 256

LETTER, NUMBER, OTHER, BLANK, SPACE = range(5)
#: Symbols: the first three are classes; white space comes as inner or last of its run; apostrophes with 1 or 2 letters.
S_LETTER, S_NUMBER, S_OTHER, S_BLANK, S_BLANK_LAST, S_SPACE, S_SPACE_LAST, S_SHORT, S_LONG = range(9)
SYMBOLS = 9
#: States: nothing open, in letters, in numbers, in others, after a blank that joins what follows, in white space, one or two letters of a contraction to go.
NONE, LETTERS, NUMBERS, OTHERS, JOINING, GAP, ONE_TO_GO, TWO_TO_GO = range(8)
STATES = 8


def classes() -> np.ndarray:
    """The class of every code point: \\p{L}, \\p{N} and \\s as Unicode has them, the blank apart."""
    import regex

    points = np.concatenate([np.arange(0xD800), np.arange(0xE000, 0x110000)])
    every = points.astype("<u4").tobytes().decode("utf-32-le")
    table = np.full(0x110000, OTHER, np.uint8)
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\p{White_Space}+")):
        for run in regex.finditer(pattern, every):
            lo, hi = ord(every[run.start()]), ord(every[run.end() - 1])
            if lo < 0xD800 <= hi:
                table[lo:0xD800] = table[0xE000 : hi + 1] = kind
            else:
                table[lo : hi + 1] = kind
    table[0x20] = BLANK
    return table


def automaton() -> tuple[np.ndarray, np.ndarray]:
    """Next state and "a piece starts here", by state and symbol; the second nine symbols stand first in a document."""
    step = np.zeros((STATES, 2 * SYMBOLS), np.uint8)
    opens = np.ones((STATES, 2 * SYMBOLS), bool)
    alone = {S_LETTER: LETTERS, S_NUMBER: NUMBERS, S_OTHER: OTHERS, S_BLANK: GAP, S_BLANK_LAST: JOINING, S_SPACE: GAP, S_SPACE_LAST: NONE, S_SHORT: ONE_TO_GO, S_LONG: TWO_TO_GO}
    for symbol, state in alone.items():
        step[:, symbol] = step[:, symbol + SYMBOLS] = state
    for before, symbols, state in (
        ((LETTERS, JOINING), (S_LETTER,), LETTERS),
        ((NUMBERS, JOINING), (S_NUMBER,), NUMBERS),
        ((OTHERS, JOINING), (S_OTHER, S_SHORT, S_LONG), OTHERS),
        ((GAP,), (S_BLANK, S_SPACE), GAP),
        ((TWO_TO_GO,), (S_LETTER,), ONE_TO_GO),
        ((ONE_TO_GO,), (S_LETTER,), NONE),
    ):
        for b in before:
            for s in symbols:
                step[b, s], opens[b, s] = state, False
    return step, opens


def monoid(step: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The transition functions closed under composition: images by id, the id of each symbol, and the product table (first, then second). Id 0 is the identity."""
    ids = {tuple(range(STATES)): 0}
    symbol = [ids.setdefault(tuple(int(x) for x in step[:, s]), len(ids)) for s in range(step.shape[1])]
    todo = list(ids)
    while todo:
        f = todo.pop()
        for s in range(step.shape[1]):
            g = tuple(int(step[x, s]) for x in f)
            if g not in ids:
                ids[g] = len(ids)
                todo.append(g)
    images = np.array(list(ids), np.uint8)
    product = np.array([[ids[tuple(int(g[x]) for x in f)] for g in ids] for f in ids], np.int64)
    assert len(ids) < 256
    return images, np.array(symbol, np.uint8), product.astype(np.uint8)


class PreTokenizer:
    """Piece starts of many documents at once."""

    BLOCK = 512

    def __init__(self):
        self.table = classes()
        self.step, self.opens = automaton()
        self.images, self.symbol_id, product = monoid(self.step)
        self.size = len(self.images)
        self.product = product.ravel()

    def symbols(self, points: np.ndarray, first: np.ndarray) -> np.ndarray:
        """points: code points; first: True where a document starts."""
        n = len(points)
        kind = self.table[points]
        visible = kind < BLANK
        follows = np.zeros(n, bool)  # a visible character of the same document comes next
        follows[:-1] = visible[1:] & ~first[1:]
        symbol = kind.copy()
        gap = ~visible
        symbol[gap] = np.where(kind[gap] == BLANK, S_BLANK, S_SPACE) + follows[gap]
        at = np.flatnonzero(points == 0x27)
        if len(at):
            padded = np.concatenate([points, np.zeros(2, points.dtype)])
            inside = np.concatenate([~first, np.zeros(2, bool)])
            one, two = padded[at + 1], padded[at + 2]
            short = inside[at + 1] & np.isin(one, [ord(c) for c in "stmd"])
            pair = one.astype(np.int64) * 0x110000 + two
            long = inside[at + 1] & inside[at + 2] & np.isin(pair, [ord(a) * 0x110000 + ord(b) for a, b in ("re", "ve", "ll")])
            symbol[at[short]] = S_SHORT
            symbol[at[long]] = S_LONG
        symbol[first] += SYMBOLS
        return symbol

    def starts(self, points: np.ndarray, first: np.ndarray) -> np.ndarray:
        n, b = len(points), self.BLOCK
        symbol = self.symbols(points, first)
        blocks = -(-n // b)
        ids = np.zeros(blocks * b, np.uint8)
        ids[:n] = self.symbol_id[symbol]
        steps = np.ascontiguousarray(ids.reshape(blocks, b).T)
        before = np.zeros((b, blocks), np.uint8)  # product of the symbols before each place, in its block
        acc = np.zeros(blocks, np.uint8)
        for i in range(b):
            before[i] = acc
            acc = self.product[acc.astype(np.intp) * self.size + steps[i]]
        shift = 1  # an inclusive scan over the blocks' products
        while shift < blocks:
            acc[shift:] = self.product[acc[:-shift].astype(np.intp) * self.size + acc[shift:]]
            shift *= 2
        entry = np.full(blocks, NONE, np.uint8)
        entry[1:] = self.images[acc[:-1], NONE]
        state = self.images.ravel()[before.astype(np.intp) * STATES + entry].T.ravel()[:n]
        return np.flatnonzero(self.opens.ravel()[state.astype(np.intp) * (2 * SYMBOLS) + symbol])


def merge(piece: bytes, rank) -> list[bytes]:
    """Tokens of one piece. rank: bytes to rank, or None."""
    n = len(piece)
    none = 1 << 60
    if n > LONG_PIECE:
        return merge_long(piece, rank)
    cut = list(range(n + 1))
    best = [rank(piece[i : i + 2], none) for i in range(n - 1)]
    while best:
        low = min(best)
        if low == none:
            break
        i = best.index(low)
        del cut[i + 1], best[i]
        if i < len(best):
            best[i] = rank(piece[cut[i] : cut[i + 2]], none)
        if i:
            best[i - 1] = rank(piece[cut[i - 1] : cut[i + 1]], none)
    return [piece[a:b] for a, b in zip(cut, cut[1:])]


def merge_long(piece: bytes, rank) -> list[bytes]:
    """The same by a heap of neighbours: n log n steps."""
    n = len(piece)
    end, back = list(range(1, n + 1)), list(range(-1, n - 1))
    alive = [True] * n
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := rank(piece[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, stop = heapq.heappop(heap)
        if not alive[i] or end[i] >= n or end[end[i]] != stop or not alive[end[i]]:
            continue
        gone = end[i]
        alive[gone] = False
        end[i] = stop
        if stop < n:
            back[stop] = i
            if (r := rank(piece[i : end[stop]])) is not None:
                heapq.heappush(heap, (r, i, end[stop]))
        if i and (r := rank(piece[back[i] : stop])) is not None:
            heapq.heappush(heap, (r, back[i], stop))
    return [piece[i : end[i]] for i in range(n) if alive[i]]


class Pieces(dict):
    """Piece to its ids, as little-endian bytes; two generations, so memory stays bounded."""

    def __init__(self, ranks: dict[bytes, int]):
        super().__init__()
        self.ranks, self.old = ranks, {}

    def __missing__(self, piece: bytes) -> bytes:
        got = self.old.get(piece)
        if got is None:
            if piece in self.ranks:
                got = self.ranks[piece].to_bytes(4, "little")
            else:
                got = b"".join([self.ranks[t].to_bytes(4, "little") for t in merge(piece, self.ranks.get)])
        if len(piece) <= LONG_PIECE:
            if len(self) >= CACHE_PIECES:
                self.old = dict(self)
                self.clear()
            self[piece] = got
        return got

    def forget(self) -> None:
        self.clear()
        self.old = {}


class Codec:
    """Encoder and decoder over one vocabulary."""

    def __init__(self, vocabulary: bytes):
        rows = [line.split() for line in vocabulary.splitlines() if line.strip()]
        self.ranks = {base64.b64decode(t): int(r) for t, r in rows}
        #: All tokens' bytes, one after the other, and each one's first byte and length by rank.
        self.size = np.zeros(max(self.ranks.values(), default=-1) + 1, np.int64)
        self.size[list(self.ranks.values())] = [len(t) for t in self.ranks]
        self.begin = np.cumsum(self.size) - self.size
        self.flat = np.frombuffer(b"".join(sorted(self.ranks, key=self.ranks.get)), np.uint8)
        self.pieces = Pieces(self.ranks)
        self.pre = PreTokenizer()

    def encode_many(self, data: np.ndarray, offsets: np.ndarray) -> list[bytes]:
        """Ids of each document, as little-endian unsigned 32-bit integers."""
        raw = data.tobytes()
        if not raw:
            return [b""] * (len(offsets) - 1)
        try:
            text = raw.decode("utf-8")
        except UnicodeDecodeError:
            cut = offsets.tolist()
            parts = [raw[a:b].decode("utf-8", "replace").encode() for a, b in zip(cut, cut[1:])]
            return self.encode_many(np.frombuffer(b"".join(parts), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in parts])]))
        points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        place = np.flatnonzero((data & 0xC0) != 0x80)  # byte of each code point
        first = np.zeros(len(points), bool)
        filled = offsets[:-1][offsets[:-1] < offsets[1:]]
        first[np.searchsorted(place, filled)] = True
        at = place[self.pre.starts(points, first)]
        known = self.pieces
        cut = at.tolist()
        cut.append(len(raw))
        ids = [known[raw[a:b]] for a, b in zip(cut, cut[1:])]
        bound = np.searchsorted(at, offsets).tolist()
        return [b"".join(ids[i:j]) for i, j in zip(bound, bound[1:])]

    def offsets(self, ids: np.ndarray) -> np.ndarray:
        """Byte where each token starts, and the end (n + 1)."""
        out = np.zeros(len(ids) + 1, np.int64)
        np.cumsum(self.size[ids], out=out[1:])
        return out

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> bytes:
        """The tokens' bytes, each at its offset."""
        place = np.repeat(self.begin[ids] - offsets[:-1], np.diff(offsets)) + np.arange(offsets[-1])
        return self.flat[place].tobytes()


def read_vocabulary(path: str) -> bytes:
    if os.path.getsize(path) > MAX_VOCABULARY_BYTES:
        raise ValueError(f"{path} has over {MAX_VOCABULARY_BYTES} bytes")
    with open(path, "rb") as f:
        return f.read()


_CODECS: dict[str, Codec] = {}


def _codec(vocabulary: bytes) -> Codec:
    key = hashlib.sha256(vocabulary).hexdigest()
    if key not in _CODECS:
        _CODECS.clear()
        _CODECS[key] = Codec(vocabulary)
    return _CODECS[key]


def _id_fields(df: DataFrame, names) -> list[T.StructField]:
    return [T.StructField(c, df.schema[c].dataType) for c in names]


def encode(df: DataFrame, vocabulary_path: str, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",), digests: bool = False) -> DataFrame:
    """One row a row: the kept columns, n_tokens, ids and offsets (the byte where each token starts, and the end); with digests ids_sha256 and
    decoded_sha256, of the ids and of what they and their offsets decode to. Kept columns with one of these names come first, as they are."""
    vocabulary = df.sparkSession.sparkContext.broadcast(read_vocabulary(vocabulary_path))
    fields = [*_id_fields(df, keep), T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.ArrayType(T.IntegerType(), False)), T.StructField("offsets", T.ArrayType(T.IntegerType(), False))]
    if digests:
        fields += [T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]
    k = len(keep)

    def run(batches):
        codec = _codec(vocabulary.value)
        for batch in batches:
            data, offsets = text_buffer(batch.column(k))
            for i, j in chunks(offsets, ENCODE_BYTES):
                raw = codec.encode_many(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                count = np.array([len(x) // 4 for x in raw], np.int64)
                ends = np.concatenate([[0], np.cumsum(count)])
                ids = np.frombuffer(b"".join(raw), "<u4").astype(np.int32)
                at = codec.offsets(ids)
                each = np.arange(len(ids) + len(count)) - np.repeat(np.arange(len(count)), count + 1)  # every document has an end of its own
                columns = [batch.column(c).slice(i, j - i) for c in range(k)]
                columns.append(pa.array(count))
                columns.append(pa.ListArray.from_arrays(ends.astype(np.int32), ids))
                columns.append(pa.ListArray.from_arrays((ends + np.arange(len(ends))).astype(np.int32), (at[each] - np.repeat(at[ends[:-1]], count + 1)).astype(np.int32)))
                if digests:
                    decoded, cut = codec.decode(ids, at), at[ends].tolist()
                    columns.append(pa.array([hashlib.sha256(x).hexdigest() for x in raw], pa.string()))
                    columns.append(pa.array([hashlib.sha256(decoded[a:b]).hexdigest() for a, b in zip(cut, cut[1:])], pa.string()))
                yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in fields])
        codec.pieces.forget()

    return df.select(*keep, df[text_col].cast("string").alias("__text")).mapInArrow(frugal(run), T.StructType(fields))


def decode(df: DataFrame, vocabulary_path: str, ids_col: str = "ids", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The kept columns, decoded (bytes) and text (as UTF-8; invalid bytes, as a cut id list can give, become U+FFFD). Null ids give null."""
    vocabulary = df.sparkSession.sparkContext.broadcast(read_vocabulary(vocabulary_path))
    fields = [*_id_fields(df, keep), T.StructField("decoded", T.BinaryType()), T.StructField("text", T.StringType())]
    k = len(keep)

    def run(batches):
        codec = _codec(vocabulary.value)

        def decoded(ids):
            ids = np.array(ids, np.int64)
            return codec.decode(ids, codec.offsets(ids))

        for batch in batches:
            raw = [None if x is None else decoded(x) for x in batch.column(k).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in range(k)), pa.array(raw, pa.binary()), pa.array([None if x is None else x.decode("utf-8", "replace") for x in raw], pa.string())],
                names=[f.name for f in fields],
            )

    return df.select(*keep, df[ids_col].alias("__ids")).mapInArrow(frugal(run), T.StructType(fields))
