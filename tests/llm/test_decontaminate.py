import random

import pytest

from cantata.llm import decontaminate
from tests.llm import brute

SF = "/root/testdata/sf0.001"


def check(spark, docs, items):
    found = decontaminate.digest(
        decontaminate.find(
            spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(items, "item_id long, text string")
        )
    )
    got = {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in found.collect()}
    assert got == brute.contamination(docs, items)


def test_whole_tables(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    check(spark, docs, items)


def test_random_small_alphabet(spark):
    rng = random.Random(3)
    text = lambda n: " ".join(rng.choice(["a", "B", "é", "7"]) for _ in range(n))
    docs = [(i, text(rng.randint(0, 60))) for i in range(60)] + [(60, None), (61, ""), (62, "-- !!"), (63, "x " * 20000)]
    check(spark, docs, [(i, text(rng.randint(0, 14))) for i in range(20)] + [(20, None), (21, ""), (5, text(12))])
    check(spark, docs, [(1, "a b"), (2, "é"), (3, "A B")])
    check(spark, docs, [])


def test_blocks_give_the_same(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 2000)
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").limit(60).collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()] + [(99, docs[0][1][:200])]
    check(spark, docs, items)


def test_longest_match_and_extra_columns(spark):
    w = [f"w{i}" for i in range(40)]
    docs = spark.createDataFrame([(1, "x " + " ".join(w[5:30]) + " y", "z")], "doc_id long, text string, items string")
    row = decontaminate.find(docs, spark.createDataFrame([(7, " ".join(w))], "item_id long, text string")).first()
    assert (row.longest, row["items"], [tuple(s) for s in row.spans]) == (25, ["7"], [(1, 26)])


@pytest.mark.parametrize("schema", ["doc_id long, text string"])
def test_empty_table(spark, schema):
    empty = spark.createDataFrame([], schema)
    assert decontaminate.digest(decontaminate.find(empty, spark.createDataFrame([(1, "a")], "item_id long, text string"))).count() == 0


def test_words_with_equal_sums_of_powers(spark):
    word = "a"
    for _ in range(10):
        word += word.translate(str.maketrans("ab", "ba"))
    other = word.translate(str.maketrans("ab", "ba"))
    check(spark, [(1, word), (2, f"x {other} y"), (3, other)], [(1, word)])


def test_equal_hashes_are_told_apart_by_their_words(spark, monkeypatch):
    """With a hash that knows only the length, results don't change."""
    monkeypatch.setattr(decontaminate, "word_hashes", lambda data, starts, ends: (ends - starts).astype("u8"))
    rng = random.Random(9)
    text = lambda n: " ".join(rng.choice(["aa", "bb", "c", "d"]) for _ in range(n))
    docs, items = [(i, text(rng.randint(0, 30))) for i in range(20)], [(i, text(rng.randint(0, 13))) for i in range(12)]
    test = decontaminate.TestSet([(str(i), t) for i, t in items], 4)
    import numpy as np

    raw = [t.encode() for _, t in docs]
    found = decontaminate.Words(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
    shard = decontaminate.Shard(found, test)
    lo, hi = shard.search(test)
    got = {d: set() for d, _ in docs}
    for k, w in enumerate(shard.windows.tolist()):
        at = shard.suffix[lo[k] : hi[k]]
        n = int(test.size[w])
        for s in at[found.equal(at, test.words.texts(int(test.at[w]), n))].tolist():
            d = int(np.searchsorted(found.first, s, side="right") - 1)
            got[d] |= {s - int(found.first[d]) + i for i in range(n)}
    want = brute.contamination(docs, items, 4)
    assert {d: len(x) for d, x in got.items()} == {d: want[d][1] for d, _ in docs}


def test_ties_long_texts_and_bytes_that_are_no_utf8(spark):
    rng = random.Random(2)
    passage = " ".join(f"p{i}" for i in range(30))
    long = " ".join(rng.choice("abcdefg") for _ in range(400_000)) + " " + passage
    check(spark, [(1, long), (2, passage), (3, "")], [(1, passage), (1, passage), (2, passage + " q"), (3, "zz")])
    df = spark.createDataFrame([(1, b"\xff " + passage.encode() + b" \xe4")], "doc_id long, b binary").selectExpr("doc_id", "cast(b as string) as text")
    row = decontaminate.digest(decontaminate.find(df, spark.createDataFrame([(7, passage)], "item_id long, text string"))).first()
    assert (row.n_words, row.n_hit, row.longest_match) == (32, 30, 30)
