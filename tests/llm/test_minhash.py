import random

import numpy as np

from cantata.llm import minhash
from cantata.llm.common import Scratch
from tests.llm import brute

SF = "/root/testdata/sf0.001"


def check(spark, docs, size):
    got = minhash.cluster(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), shingle=size).collect()
    assert sorted([(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got], key=str) == brute.near_duplicates(docs, size)


def test_whole_table(spark):
    check(spark, [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()], 4)


def test_chains_and_large_groups(spark, monkeypatch):
    """Families whose members lie around the threshold: components come through chains, not through one pivot."""
    monkeypatch.setattr(minhash, "BLOCK", 8)
    rng = random.Random(5)
    docs = [(None, None), (900, ""), (901, "a b"), (902, "A  B"), (None, "a b"), (903, " \n ")]
    for f in range(3):
        w = [f"f{f}w{i}" for i in range(120)]
        for k in range(40):
            docs.append((100 * f + k, " ".join(w)))
            w[rng.randrange(120)] = f"n{rng.random()}"
            w[rng.randrange(120)] = f"n{rng.random()}"
    rng.shuffle(docs)
    check(spark, docs, 5)


def test_empty(spark):
    assert minhash.cluster(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_signature_estimates_similarity():
    rng = np.random.default_rng(1)
    pool = rng.integers(0, 1 << 63, 1500, dtype=np.uint64)
    a, b = pool[:1000], pool[200:1200]  # similarity 800 / 1200
    s = minhash.signatures(np.concatenate([a, b]), np.array([0, 1000, 2000]), 2000)
    for half in (s[:2000], s[2000:]):  # the smallest and the largest values are both unbiased
        assert abs((half[:, 0] == half[:, 1]).mean() - 2 / 3) < 0.04


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(0, 30) if i % 10 != 9] + [(50, 40), (40, 60), (7, 7)], "a long, b long")
    got = {r.node: r.comp for r in minhash.components(edges, Scratch(spark), "t").collect()}
    assert got == {i: i // 10 * 10 for i in range(30) if i % 10} | {50: 40, 60: 40}


def thue_morse(n):
    word = "a"
    for _ in range(n):
        word += word.translate(str.maketrans("ab", "ba"))
    return word, word.translate(str.maketrans("ab", "ba"))


def test_words_with_equal_sums_of_powers(spark):
    word, other = thue_morse(10)
    check(spark, [(1, " ".join([word] * 6)), (2, " ".join([other] * 6)), (3, " ".join([word] * 5))], 5)


def test_long_texts_and_clashing_columns(spark):
    long = " ".join(f"w{i * i % 99991}" for i in range(60_000))
    docs = [(1, long), (2, long + " more"), (3, long[: len(long) // 2])]
    check(spark, docs, 5)
    df = spark.createDataFrame([(*d, 0, "n", 5, "k") for d in docs], "doc_id long, text string, id int, node string, n int, kept string")
    assert {r.doc_id: r.component_id for r in minhash.cluster(df).collect()} == {1: 1, 2: 1, 3: 3}
