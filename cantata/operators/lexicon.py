"""Words cut into a known left part and the rest, by the scores of a lexicon: for scripts whose words carry endings."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cantata.functions.text import SPACE, clean_token
from cantata.operators.joins import small_side

#: A left part has this many characters at least; a word of no more is never cut.
LEAST = 2
#: Characters of a lexicon up to which it goes to the tasks as a trie.
MOST_CHARS = 8 << 20
_LETTER_BITS = 21


class Trie:
    """A lexicon as one sorted array of edges (node and letter in a number), which whole batches of words walk together, a letter at a time."""

    def __init__(self, words: list[str], scores: list[float]):
        letters, at = _letters(words)
        size = np.diff(at)
        node = np.zeros(len(words), np.int64)  # the node that each word has reached; 0 is the root
        edges, self.nodes = [], 1
        for k in range(int(size.max(initial=0))):
            some = np.flatnonzero(size > k)
            edge, place = np.unique(node[some] << _LETTER_BITS | letters[at[some] + k], return_inverse=True)
            node[some] = self.nodes + place
            edges.append((edge, self.nodes + np.arange(len(edge))))
            self.nodes += len(edge)
        keys, to = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (zip(*edges) if edges else ((), ())))
        order = np.argsort(keys)
        self.keys, self.to = keys[order], to[order]
        self.score = np.full(self.nodes, -np.inf)
        np.maximum.at(self.score, node, np.asarray(scores, float))
        self.score[0] = -np.inf

    def left_sizes(self, words: list[str], unknown: float = 0.0) -> np.ndarray:
        """Characters of the best left part of each word: the highest score, the longest of equals. What isn't in the lexicon scores `unknown`."""
        letters, at = _letters(words)
        size = np.diff(at)
        node, best, score = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64), np.full(len(words), -np.inf)
        strange = size.copy()  # the longest left part that isn't in the lexicon
        some = np.flatnonzero(size > LEAST)
        strange[some] = 0
        for k in range(int(size[some].max(initial=0))):
            some = some[size[some] > k]
            key = node[some] << _LETTER_BITS | letters[at[some] + k]
            place = np.minimum(np.searchsorted(self.keys, key), max(len(self.keys) - 1, 0))
            known = self.keys[place] == key if len(self.keys) else np.zeros(len(some), bool)
            strange[some[~known]] = size[some[~known]]
            some = some[known]
            node[some] = self.to[place[known]]
            if k + 1 >= LEAST:
                here = self.score[node[some]]
                strange[some[np.isneginf(here)]] = k + 1
                better = ~np.isneginf(here) & (here >= score[some])
                best[some[better]], score[some[better]] = k + 1, here[better]
        whole = (strange > 0) & ((unknown > score) | ((unknown == score) & (strange > best)))
        return np.where(whole | (size <= LEAST), strange, best)


def _letters(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all words in a row, and the place where each word starts."""
    data = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
    return data, np.r_[0, np.cumsum([len(w) for w in words])].astype(np.int64)


def _pieces(word: str, size: int) -> list[str]:
    return [word] if size >= len(word) else [word[:size], word[size:]]


def words_by_lexicon(df: DataFrame, text: str, lexicon: DataFrame, out: str = "words", word: str = "word", score: str | None = None) -> DataFrame:
    """df with its words: what stands between white space, each cut into its best left part and the rest, of which letters, numbers and apostrophes stay. lexicon: word, and
    a score (1 where none is named); of equal words the highest score counts. A left part has LEAST characters; of equal scores the longest is taken, and
    what isn't in the lexicon scores 0, so an unknown word stays whole. Null text has no words.

    A lexicon of up to MOST_CHARS characters, counted first, is sent to the tasks. A larger one is joined with the left parts of all distinct words."""
    scores = lexicon.select(F.col(word).alias("word"), (F.col(score) if score else F.lit(1.0)).cast("double").alias("score")).where("word != '' and score is not null")
    scores = scores.groupBy("word").agg(F.max("score").alias("score"))
    raw = F.filter(F.split(F.coalesce(F.col(text), F.lit("")), f"[{SPACE}]+"), lambda w: w != "")
    if (scores.agg(F.sum(F.length("word"))).first()[0] or 0) <= MOST_CHARS:
        cut = _by_trie(df.withColumn(out, raw), out, scores)
    else:
        cut = _by_join(df.withColumn(out, raw), out, scores)
    return cut.withColumn(out, F.filter(F.transform(out, clean_token), lambda w: w != ""))


def _by_trie(df: DataFrame, out: str, scores: DataFrame) -> DataFrame:
    rows = scores.orderBy("word").collect()  # its size was checked
    trie = df.sparkSession.sparkContext.broadcast(Trie([r.word for r in rows], [r.score for r in rows]))
    schema = T.StructType([f if f.name != out else T.StructField(out, T.ArrayType(T.StringType())) for f in df.schema.fields])
    k = df.columns.index(out)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            rows = batch.column(k).to_pylist()
            flat = [w for r in rows for w in r]
            sizes = iter(trie.value.left_sizes(flat).tolist())
            cut = [[p for w in r for p in _pieces(w, next(sizes))] for r in rows]
            yield pa.RecordBatch.from_arrays([pa.array(cut, pa.list_(pa.string())) if c == k else batch.column(c) for c in range(batch.num_columns)], names=schema.names)

    return df.mapInArrow(run, schema)


def _by_join(df: DataFrame, out: str, scores: DataFrame) -> DataFrame:
    """The same by joins: distinct words, their left parts, and the rows' words looked up among those that are cut."""
    from cantata.operators.joins import lookup
    from cantata.storage import Scratch

    scratch = Scratch(df.sparkSession)
    rows = scratch.keep(df.withColumn("__row", F.monotonically_increasing_id()), "rows")
    words = scratch.keep(rows.select(F.explode(out).alias("w")).groupBy("w").agg(F.count("*").alias("n")), "words")
    parts = words.where(F.length("w") > LEAST).select("w", F.explode(F.sequence(F.lit(LEAST), F.length("w"))).alias("size"))
    found = parts.withColumn("word", F.left("w", F.col("size"))).join(scores, "word", "left")
    best = found.groupBy("w").agg(F.max(F.struct(F.coalesce("score", F.lit(0.0)).alias("score"), "size")).alias("best")).select("w", F.col("best.size").alias("size"))
    best = scratch.keep(words.join(best, "w").where(F.col("size") < F.length("w")), "best")
    each = rows.select("__row", F.posexplode(out).alias("i", "w"))
    cut = F.when(F.col("size").isNull(), F.array("w")).otherwise(F.array(F.left("w", F.col("size")), F.substr("w", F.col("size") + 1)))
    joined = lookup(each, best, "w", "size", "n").groupBy("__row").agg(F.array_sort(F.collect_list(F.struct("i", cut.alias("p")))).alias("cut"))  # one row's words
    whole = rows.drop(out).join(small_side(joined.select("__row", F.flatten(F.col("cut.p")).alias(out)), 1 << 40, 1), "__row", "left")
    return whole.withColumn(out, F.coalesce(out, F.array().cast("array<string>"))).select(*df.columns)
