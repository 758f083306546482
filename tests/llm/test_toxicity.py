import math
import random
import zlib
from collections import Counter

import numpy as np

from cantata.llm import toxicity

SF = "/root/testdata/sf0.1"


def corpus(rng, n=600):
    ordinary = [f"w{i}" for i in range(400)]
    insults = ["grumbo", "fnarg", "zilch"]
    docs, labels = [], []
    for i in range(n):
        words = rng.choices(ordinary, k=rng.randint(20, 200))
        toxic = i % 5 == 2
        if toxic:
            for _ in range(3):
                words.insert(rng.randrange(len(words)), rng.choice(insults))
        docs.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    return docs, labels


def test_held_out_accuracy(spark):
    docs, labels = corpus(random.Random(1))
    extra = [(9000, None), (9001, ""), (9002, "!!"), (None, "w1 grumbo w2 fnarg w3 zilch"), (3, docs[3][1])]
    d = spark.createDataFrame(docs + extra, "doc_id long, text string").selectExpr("*", "'x' as score", "1 as label")
    out = toxicity.classify(d, spark.createDataFrame([*labels, (1, None), (None, 1), (12345, 1)], "doc_id long, toxic int")).collect()
    assert len(out) == len(docs) + len(extra)
    truth = dict(labels)
    held = [r for r in out if r.doc_id in truth and r.held_out]
    assert {r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in out if r.doc_id is not None} == {True}
    assert sum(r.predicted == truth[r.doc_id] for r in held) > 0.95 * len(held)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in out)
    assert [r.predicted for r in out if r.doc_id in (9000, 9001, 9002)] == [0, 0, 0]
    assert [r.predicted for r in out if r.doc_id is None] == [1]


def test_rare_expressions_count(spark):
    rng = random.Random(3)
    docs, labels = [], []
    for i in range(600):
        words = rng.choices([f"w{k}" for k in range(400)], k=rng.randint(20, 60))
        toxic = i % 5 == 2
        for _ in range(6):
            words.insert(rng.randrange(len(words)), f"rare{rng.randrange(250)}" if toxic else f"odd{rng.randrange(1000)}")
        docs.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    out = toxicity.classify(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")).where("held_out").collect()
    caught = [r.predicted for r in out if labels[r.doc_id][1]]
    assert np.mean(caught) > 0.8
    assert np.mean([r.predicted for r in out if not labels[r.doc_id][1]]) < 0.05


def test_shared_level_counts_distinct_pairs(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "HELD_PAIRS", 50)
    texts = ["a b a b", "A b, c", "c", None, "", *["d b"] * 40]
    docs = spark.createDataFrame([(t,) for t in texts], "text string").repartition(3)
    words = [w for t in texts for w in (t or "").lower().replace(",", "").split()]
    follows = {w: {(["", *t][i]) for t in ((t or "").lower().replace(",", "").split() for t in texts) for i, x in enumerate(t) if x == w} for w in set(words)}
    hashes = {w: toxicity.tokens(np.frombuffer(w.encode(), np.uint8), np.array([0, len(w)]))[0][0] for w in follows}
    vocabulary = np.sort(np.array([hashes["a"], hashes["b"], np.uint64(7)]))
    below = sum(map(len, follows.values())) + len(follows) + 1
    for hot in ([], ["b"], ["a", "b", "c", "d"]):
        got = dict(zip(vocabulary.tolist(), toxicity._shared(docs, vocabulary, np.sort(np.array([hashes[w] for w in hot], np.uint64)), "text")))
        assert {w: got[int(hashes[w])] for w in "ab"} == {w: (len(follows[w]) + 1) / below for w in "ab"} and got[7] == 1 / below


def test_continuations_against_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = {r.word: r.n for r in toxicity._continuations(docs, np.zeros(0, np.uint64), "text").collect()}
    texts = [(r.text or "").encode() for r in docs.collect()]
    h, pairs, _ = toxicity.tokens(np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)]))
    _, at = np.unique(pairs, return_index=True)
    assert got == dict(zip(*(x.tolist() for x in np.unique(h[at].view(np.int64), return_counts=True))))


def plain_ratios(texts, labels, shared, word_cutoff, pair_cutoff):
    """Kneser-Ney with dictionaries: a function that gives a text's log-ratios."""
    split = lambda t: ["", *t.lower().split()]
    pairs = [Counter(p for t, k in zip(texts, labels) if k == kind for p in zip(split(t), split(t)[1:])) for kind in (0, 1)]
    continues = [Counter(w for _, w in c) for c in pairs]
    after = [Counter() for _ in pairs]
    for a, c in zip(after, pairs):
        for (v, _), n in c.items():
            a[v] += n

    def discount(c):
        once, twice = (sum(x == k for x in c.values()) for k in (1, 2))
        return once / (once + 2 * twice) if once else 0.5

    def low(k, w):
        d, total = discount(continues[k]), sum(continues[k].values())
        held = {x: n - d for x, n in continues[k].items() if n >= word_cutoff}
        return held.get(w, 0) / total + (1 - sum(held.values()) / total) * shared(w)

    def high(k, v, w):
        if not after[k][v] or pair_cutoff is None:
            return low(k, w)
        d = discount(pairs[k])
        held = {x: n - d for (u, x), n in pairs[k].items() if u == v and n >= pair_cutoff}
        return held.get(w, 0) / after[k][v] + (1 - sum(held.values()) / after[k][v]) * low(k, w)

    return lambda t: [math.log(high(1, v, w)) - math.log(high(0, v, w)) for v, w in zip(split(t), split(t)[1:])]


def test_ratios_against_plain_version(spark):
    rng = random.Random(8)
    texts = [" ".join(rng.choices("abcdefghijklmnop", weights=range(1, 17), k=rng.randint(0, 30))) for _ in range(60)]
    labels = [i % 2 for i in range(60)]
    sample = spark.createDataFrame(list(zip(labels, labels, texts)), "role int, label int, __text string").repartition(3)
    trainer = toxicity._counted(sample)
    value = lambda w: 0.01 + ord(w) % 7 / 100
    name = {int(toxicity.tokens(np.frombuffer(w.encode(), np.uint8), np.array([0, 1]))[0][0]): w for w in "abcdefghijklmnopz"}
    shared = np.array([value(name[int(h)]) for h in trainer.word])
    for word_cutoff, pair_cutoff in ((1, 1), (3, 2), (2, None), (6, 9)):
        model = trainer.model(shared, word_cutoff, toxicity.NO_PAIRS if pair_cutoff is None else pair_cutoff, np.zeros(9))
        plain = plain_ratios(texts, labels, value, word_cutoff, pair_cutoff)
        for t in (*texts[:8], "z a z z b", "a z c"):
            h, before, _ = toxicity.tokens_and_histories(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t)]))
            assert np.allclose(model.ratios(h, before), plain(t), atol=1e-5), (word_cutoff, pair_cutoff, t)


def test_copies_of_documents_without_labels_change_no_model(spark):
    docs, labels = corpus(random.Random(4))
    known = spark.createDataFrame(labels, "doc_id long, toxic int")
    fitted = lambda rows: toxicity.fit(spark.createDataFrame(rows, "doc_id long, text string"), known)
    plain, copied = fitted(docs), fitted(docs + [(10000 + i, docs[2][1]) for i in range(300)])
    assert (plain.word_ratio == copied.word_ratio).all() and (plain.pair_ratio == copied.pair_ratio).all() and np.allclose(plain.curve, copied.curve)


def test_long_texts_and_a_sample_that_leaves_out_what_does_not_fit(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "SAMPLE_BYTES", 100_000)
    docs, labels = corpus(random.Random(6))
    long = " ".join(f"w{i % 400}" for i in range(60_000))
    docs = [*docs, (700, long), (702, long + " grumbo fnarg zilch"), (711, long)]
    out = toxicity.classify(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([*labels, (700, 0), (702, 1), (711, 1)], "doc_id long, toxic int")).collect()
    truth = dict(labels)
    assert np.mean([r.predicted == truth[r.doc_id] for r in out if r.doc_id in truth]) > 0.95
    assert {r.doc_id: r.predicted for r in out if r.doc_id >= 700} == {700: 0, 702: 1, 711: 0}


def test_labels_of_one_kind_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, "c")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 0), (2, 0)], "doc_id long, toxic int")
    assert [r.score for r in toxicity.classify(docs, labels).collect()] == [0.0, 0.0]
    assert toxicity.classify(docs.where("false"), labels).count() == 0


def test_real_labels(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    out = toxicity.classify(docs, labels).join(labels, "doc_id").where("held_out").selectExpr("predicted = toxic as ok", "toxic").collect()
    assert np.mean([r.ok for r in out]) > 0.94


def plain_summary(r):
    out = [sum(r) / len(r) if r else 0.0]
    for width in toxicity.WINDOWS:
        sums = [sum(r[i : i + width]) / width for i in range(len(r))]
        first = max(range(len(r)), key=lambda i: (sums[i], -i), default=None)
        others = [s for i, s in enumerate(sums) if abs(i - first) >= width] if r else []
        out += [sums[first], max(others, default=-1.0)] if r else [0.0, 0.0]
    return [max(x, -1.0) for x in out]


def test_summary_against_plain_windows():
    rng = random.Random(9)
    texts = [[rng.choice([-9.0, -0.5, 0.0, 0.25, 1.0, 3.0]) for _ in range(rng.choice([0, 1, 2, 5, 20, 60]))] for _ in range(200)]
    got = toxicity.Windows(np.cumsum([0, *map(len, texts)])).summary(np.array([x for t in texts for x in t]))
    assert np.allclose(got, [plain_summary(t) for t in texts])


def test_no_weight_is_below_zero():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(500, 4))
    y = (x[:, 0] - x[:, 1] + 0.1 * rng.normal(size=500) > 0).astype(float)
    w = toxicity.fit_curve(x, y)
    assert w[1] > 0.5 and (w[1:] >= 0).all() and w[2] == 0
    assert (toxicity.fit_curve(-np.ones((20, 2)), np.ones(20))[1:] == 0).all()


def test_too_many_pairs_leave_the_rare_ones_out(spark, monkeypatch):
    docs, labels = corpus(random.Random(7))
    d, known = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as score"), spark.createDataFrame(labels, "doc_id long, toxic int")
    monkeypatch.setattr(toxicity, "MAX_PAIR_BYTES", 20_000)
    model = toxicity.fit(d, known)
    assert model.pair.nbytes <= 20_000
    out = toxicity.score(d, model, keep=("doc_id", "score"))
    assert out.columns == ["doc_id", "score"] and np.mean([(r.score >= 0.5) == labels[r.doc_id][1] for r in out.collect()]) > 0.95
