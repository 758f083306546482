"""Functions on signals held as arrays: all inside the JVM. Lengths are in samples."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cantata.functions.text import let

MOST_CHANNELS = 8


def _rows(of: Column) -> Column:
    """0 to one less than a size; nothing where that is 0."""
    return F.when(of > 0, F.sequence(F.lit(0), of - 1)).otherwise(F.array().cast("array<int>"))


def scan(x: Column, combine) -> Column:
    """Running combination of an array by an associative function of two values: in as many passes as the size has bits, in each of which an
    element takes in what stands 1, 2, 4, ... places before it. Nothing is appended, so no array is copied for each element."""
    passes = lambda n: F.ceil(F.log2(F.greatest(n, F.lit(1)))).cast("int")

    def one(a: Column, k: Column) -> Column:
        return F.transform(a, lambda v, i: let(F.get(a, i - F.call_function("shiftleft", F.lit(1), k)), lambda w: F.when(w.isNull(), v).otherwise(combine(w, v))))

    return let(x, lambda a: F.aggregate(_rows(passes(F.size(a))), a, one))


def running_sum(x: Column) -> Column:
    """Sums of whole numbers up to each place; a null counts as 0."""
    return scan(F.transform(x, lambda v: F.coalesce(v.cast("bigint"), F.lit(0).cast("bigint"))), lambda a, b: a + b)


def to_mono(frames: Column) -> Column:
    """Mean over channels of array<array<number>>. Few rows of many samples are channels; else each row is a frame."""

    def mean_of_channels(x: Column) -> Column:
        return F.transform(_rows(F.size(F.get(x, F.lit(0)))), lambda i: F.aggregate(x, F.lit(0.0), lambda a, c: a + F.get(c, i)) / F.size(x))

    def mean_of_frames(x: Column) -> Column:
        return F.transform(x, lambda f: F.aggregate(f, F.lit(0.0), lambda a, s: a + s) / F.size(f))

    channels = lambda x: (F.size(x) <= MOST_CHANNELS) & (F.size(F.get(x, F.lit(0))) > F.size(x))
    return let(frames, lambda x: F.when(F.size(x) == 0, F.array().cast("array<double>")).when(channels(x), mean_of_channels(x)).otherwise(mean_of_frames(x)))


def _to_peak(x: Column, above: float, margin: float) -> Column:
    """Divided by the peak and the margin if the peak exceeds a bound, then clipped to [-1, 1]. With a NaN there is no peak, so nothing is divided; NaN stays."""
    clip = lambda s: F.when(F.isnan(s), s).otherwise(F.greatest(F.least(s, F.lit(1.0)), F.lit(-1.0)))
    peak = lambda y: F.when(~F.exists(y, F.isnan), F.array_max(F.transform(y, F.abs)))
    divided = lambda y, p: F.transform(y, lambda s: clip(F.when(p > above, s / (p + margin)).otherwise(s)))
    return let(F.transform(x, lambda s: s.cast("double")), lambda y: let(F.coalesce(peak(y), F.lit(0.0)), lambda p: divided(y, p)))


def normalize_peak(x: Column) -> Column:
    """Divided by the peak if that exceeds 1, then clipped to [-1, 1]. With a NaN there is no peak, so nothing is divided; NaN stays."""
    return _to_peak(x, 1.0, 0.0)


def from_int16(x: Column) -> Column:
    return F.transform(x, lambda s: s / 32768.0)


def normalize_integers(x: Column, low: float, high: float) -> Column:
    """Integer samples of a type with this range to [-1, 1]: signed ones by the larger bound, unsigned ones around the middle."""
    middle = (high + 1) / 2
    scaled = (lambda s: s / float(max(abs(low), high))) if low < 0 else (lambda s: (s - middle) / middle)
    return F.transform(x, lambda s: F.greatest(F.least(scaled(s), F.lit(1.0)), F.lit(-1.0)))


def normalize_floats(x: Column) -> Column:
    """Divided by the peak if that exceeds 1 by more than a millionth, then clipped to [-1, 1]; NaN as in normalize_peak()."""
    return _to_peak(x, 1 + 1e-6, 1e-12)


def normalize_frames(frames: Column, low: float | None = None, high: float | None = None) -> Column:
    """Mono signal of frames (array<array<number>>): samples are brought to [-1, 1] and clipped before the mean of each frame. low, high: the
    range of an integer type; none for floating samples, whose peak is that of all channels."""

    def means(x: Column, n: Column, width: Column) -> Column:
        return F.transform(_rows(n), lambda i: F.aggregate(F.slice(x, i * width + 1, width), F.lit(0.0), lambda a, s: a + s) / width)

    def mono(f: Column) -> Column:
        flat = normalize_floats(F.flatten(f)) if low is None else normalize_integers(F.flatten(f), low, high)
        return let(F.struct(flat.alias("x"), F.size(f).alias("n"), F.size(F.get(f, F.lit(0))).alias("width")), lambda b: means(b["x"], b["n"], b["width"]))

    return let(frames, lambda f: F.when(F.size(f) == 0, F.array().cast("array<double>")).otherwise(mono(f)))


def resample_span(x: Column, rate: int, target: int) -> Column:
    """Linear resampling over equally spaced points with both ends included; the length is rounded half to even."""
    size = lambda n: F.bround(n.cast("bigint") * target / rate).cast("int")
    at = lambda i, n, m: F.when(m > 1, i * (n - 1).cast("double") / (m - 1)).otherwise(F.lit(0.0))
    points = lambda y, n, m: F.transform(_rows(m), lambda i: _between(y, n, at(i, n, m)))
    return let(x, lambda y: let(F.size(y), lambda n: let(size(n), lambda m: points(y, n, m))))


def resample_step(x: Column, rate: int, target: int) -> Column:
    """Linear resampling at multiples of the step, the last sample held; the length is rounded half up."""
    size = lambda n: F.floor(n.cast("bigint") * target / rate + 0.5).cast("int")
    return let(x, lambda y: let(F.size(y), lambda n: F.transform(_rows(size(n)), lambda i: _between(y, n, i.cast("bigint") * rate / float(target)))))


def _between(x: Column, n: Column, at: Column) -> Column:
    def mixed(p: Column) -> Column:
        lo = F.least(F.floor(p).cast("int"), n - 1)
        hi = F.least(lo + 1, n - 1)
        return F.get(x, lo) * (1 - (p - lo)) + F.get(x, hi) * (p - lo)

    return let(at, mixed)


def pad_tail(x: Column, length: Column) -> Column:
    return F.when(F.size(x) < length, F.concat(x, F.array_repeat(F.lit(0.0).cast("float"), length - F.size(x)))).otherwise(x)


def window_bounds(n: Column, rate: int, cut_ms: Column, left_ms: Column, right_ms: Column) -> Column:
    """(start, end) of the window around a cut; no cut or an empty window is the whole signal."""
    at = lambda ms: F.bround(ms * rate / 1000.0).cast("bigint")
    start, end = F.greatest(at(cut_ms) - at(left_ms), F.lit(0)), F.least(at(cut_ms) + at(right_ms), n.cast("bigint"))
    whole = F.struct(F.lit(0).cast("bigint").alias("start"), n.cast("bigint").alias("end"))
    return F.when(cut_ms.isNull() | (end <= start), whole).otherwise(F.struct(start.alias("start"), end.alias("end")))


def window_slice(x: Column, rate: int, cut_ms: Column, left_ms: Column, right_ms: Column) -> Column:
    return let(window_bounds(F.size(x), rate, cut_ms, left_ms, right_ms), lambda b: F.slice(x, (b["start"] + 1).cast("int"), (b["end"] - b["start"]).cast("int")))


def halved(n: Column) -> Column:
    """Length after a convolution of stride 2; floor, so that 0 stays 0."""
    return F.floor((n - 1) / 2) + 1


def feature_length(n: Column) -> Column:
    """Audio positions of n feature frames: 13 for each full hundred, the rest halved three times."""
    return halved(halved(halved(F.pmod(n, F.lit(100))))) + F.floor(n / 100) * 13


def convolved_length(n: Column) -> Column:
    return halved(halved(halved(n)))


def frame_chunks(n: Column, size: int) -> Column:
    """Lengths of the chunks of n frames."""
    chunks = F.ceil(n / size).cast("int")
    return F.when(n > 0, F.transform(F.sequence(F.lit(1), chunks), lambda i: F.when((i == chunks) & (n % size != 0), n % size).otherwise(F.lit(size)).cast("bigint"))).otherwise(F.array().cast("array<bigint>"))


def attention_windows(n: Column, size: int) -> Column:
    """Full windows of a length, and what remains."""
    full = F.array_repeat(F.lit(size).cast("bigint"), F.floor(n / size).cast("int"))
    return F.when(n % size != 0, F.array_append(full, (n % size).cast("bigint"))).otherwise(full)


def cumulative(lengths: Column) -> Column:
    """Running sums with 0 in front."""
    return F.concat(F.array(F.lit(0).cast("bigint")), running_sum(lengths))


def mask_positions(mask: Column) -> Column:
    """Place of each valid token, from 0; padding gets 1."""
    return let(mask, lambda m: F.zip_with(m, running_sum(m), lambda v, n: F.when(v == 0, F.lit(1).cast("bigint")).otherwise(n - 1)))


def segment_positions(offsets: Column, lengths: Column, total: Column) -> Column:
    """Segments of a sequence of text and sound: (kind, first, size), each of which begins where the one before it ends. offsets and
    lengths: of the sounds, in any order. A sound that overlaps another or runs over the end of the sequence is an error."""
    kind = "array<struct<kind:string,first:bigint,size:bigint>>"
    sounds = F.array_sort(F.arrays_zip(offsets.cast("array<bigint>").alias("offset"), lengths.cast("array<bigint>").alias("size")))
    segment = lambda kind, first, size: F.struct(F.lit(kind).alias("kind"), first.alias("first"), size.alias("size"))
    end = lambda s: F.coalesce(s["offset"] + s["size"], F.lit(0).cast("bigint"))
    text = lambda first, until: F.when(until > first, F.array(segment("text", first, until - first))).otherwise(F.array().cast(kind))

    def laid(all_: Column) -> Column:
        before = lambda i: end(F.get(all_, i - 1))
        parts = F.transform(all_, lambda s, i: F.concat(text(before(i), s["offset"]), F.array(segment("sound", s["offset"], s["size"]))))
        stop = before(F.size(all_))
        wrong = F.exists(F.transform(all_, lambda s, i: s["offset"] < before(i)), lambda x: x) | (stop > total)
        error = F.raise_error(F.lit("positions don't match the sequence's length")).cast(kind)
        return F.when(wrong, error).otherwise(F.concat(F.flatten(parts), text(stop, total.cast("bigint"))))

    return let(sounds, laid)


def pool_mean(vectors: Column, mask: Column) -> Column:
    """Mean of the vectors whose mask is 1, by component; the divisor is 1 at least."""
    total = F.greatest(F.aggregate(mask, F.lit(0), lambda a, m: a + m), F.lit(1))

    def mean(b: Column) -> Column:
        return F.transform(_rows(b["width"]), lambda i: F.aggregate(b["x"], F.lit(0.0), lambda a, x: a + F.get(x["v"], i) * x["m"]) / b["total"])

    weighted = F.arrays_zip(vectors.alias("v"), mask.alias("m"))
    return let(F.struct(weighted.alias("x"), total.alias("total"), F.size(F.get(vectors, F.lit(0))).alias("width")), mean)


def pool_last(vectors: Column, mask: Column) -> Column:
    at = F.array_max(F.transform(mask, lambda m, i: F.when(m == 1, i).otherwise(-1)))
    return F.get(vectors, at)


def softmax(logits: Column) -> Column:
    def scaled(top: Column) -> Column:
        return F.transform(logits, lambda x: F.exp(x.cast("double") - top))

    return let(let(F.array_max(logits).cast("double"), scaled), lambda e: let(F.aggregate(e, F.lit(0.0), lambda a, x: a + x), lambda s: F.transform(e, lambda x: x / s)))


def argmax(x: Column) -> Column:
    """Place of the largest value, the first of equals, from 0."""
    return F.array_position(x, F.array_max(x)).cast("int") - 1


def marked_times(tokens: Column, predicted: Column, marker: int, step_ms: float) -> Column:
    """Predictions at the places of the marker, in milliseconds."""
    pairs = F.filter(F.arrays_zip(tokens.alias("t"), predicted.alias("p")), lambda x: x["t"] == marker)
    return F.transform(pairs, lambda x: x["p"] * F.lit(step_ms))


def range_chunks(values: Column, size: int) -> Column:
    """Chunk number of each value of a rising array. A number rises by one only, when a value reaches its upper bound, however far the value jumps.
    So it is the least of what each value up to here allows: its own chunk, and one more for every place since."""
    allowed = F.transform(values, lambda v, i: F.greatest(F.floor(v / size), F.lit(0)).cast("bigint") - i)
    return F.transform(scan(allowed, lambda a, b: F.least(a, b)), lambda d, i: i + F.least(d, F.lit(1).cast("bigint")))


def scatter(tokens: Column, placeholder: int, rows: Column) -> Column:
    """For each token the next row of `rows` if it is the placeholder, else null."""
    counted = lambda t: running_sum(F.transform(t, lambda u: (u == placeholder).cast("int")))
    both = let(tokens, lambda t: F.zip_with(t, counted(t), lambda u, n: F.when(u == placeholder, n.cast("int") - 1)))
    return let(rows, lambda r: F.transform(both, lambda k: F.when(k.isNotNull(), F.get(r, k))))
