import random

import pytest

from cantata.llm import suffix_dedup
from tests.llm import brute

SF = "/root/testdata/sf0.001"


def check(spark, docs, **options):
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    got = sorted((tuple(r) for r in suffix_dedup.digest(suffix_dedup.remove_repeats(df, digests=True, **options)).collect()), key=str)
    assert got == sorted(brute.repeats(docs, options.get("window", 100)), key=str)


def corpus(rng):
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 7)))
    passages = [" ".join(word() for _ in range(40)) for _ in range(6)]
    docs = []
    for i in range(60):
        parts = [" ".join(word() for _ in range(rng.randint(0, 60))) for _ in range(3)]
        for _ in range(rng.randint(0, 3)):
            p = rng.choice(passages)
            parts.insert(rng.randrange(len(parts)), p[rng.randrange(60) : len(p) - rng.randrange(60)])
        docs.append((i, " ".join(parts)))
    docs += [(60, docs[3][1]), (61, docs[3][1]), (62, "a" * 400), (63, "xyz" * 200 + "a" * 150), (64, ""), (65, None), (66, "short"), (67, docs[5][1][:99])]
    docs += [(3, docs[3][1]), (None, docs[7][1])]
    return docs


@pytest.mark.parametrize("options", [{}, {"limit": 0}, {"hot": 2}, {"limit": 0, "hot": 2}])
def test_against_brute_force(spark, options):
    check(spark, corpus(random.Random(4)), **options)


def test_whole_table(spark):
    check(spark, [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect()])


def test_texts_with_equal_sums_of_powers(spark):
    """A Thue-Morse word and its complement agree in every polynomial hash modulo 2 ** 64."""
    word = "a"
    for _ in range(11):
        word += word.translate(str.maketrans("ab", "ba"))
    other = word.translate(str.maketrans("ab", "ba"))
    check(spark, [(1, word), (2, other), (3, "x" + word[:1024] + "y" + other[1024:] + "z")])


def test_long_texts_ties_and_other_columns(spark, monkeypatch):
    rng = random.Random(7)
    long = "".join(rng.choice("abcdefgh é") for _ in range(300_000))
    docs = [(1, long), (2, long[100_000:100_300]), (2, "tail " + long[50:250]), (2, "tail " + long[50:250]), (3, long[-99:])]
    check(spark, docs)
    monkeypatch.setattr(suffix_dedup, "CHUNK_BYTES", 1000)
    monkeypatch.setattr(suffix_dedup, "ORDERED", 50)
    check(spark, corpus(rng))
    df = spark.createDataFrame([(1, "a" * 300, 7, 8, "t", b"k")], "doc_id long, text string, id long, d long, t string, kept binary")
    assert [tuple(r)[:4] for r in suffix_dedup.digest(suffix_dedup.remove_repeats(df, digests=True)).collect()] == [(1, 300, 299, 1)]


def test_empty_and_spans(spark):
    assert suffix_dedup.remove_repeats(spark.createDataFrame([], "doc_id long, text string, kept string")).count() == 0
    rng = random.Random(1)
    p = "".join(rng.choice("abcdefgh") for _ in range(120))
    rows = suffix_dedup.remove_repeats(spark.createDataFrame([(1, p), (2, "--" + p + "++")], "doc_id long, text string")).orderBy("doc_id").collect()
    assert [(list(r.spans), bytes(r.kept)) for r in rows] == [([], p.encode()), ([2, 122], b"--++")]
