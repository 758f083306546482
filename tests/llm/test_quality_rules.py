import math
import random

from pyspark.sql import functions as F

from cantata.llm import quality_rules
from cantata.llm.common import Scratch
from tests.llm import brute

SF = "/root/testdata/sf0.01"


def test_statistics_and_labels(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    out = quality_rules.judge(docs, labels).collect()
    text = {r.doc_id: r.text for r in docs.collect()}
    assert {r.doc_id: tuple(r)[1:7] for r in out} == {d: brute.base_rules(t) for d, t in text.items()}
    truth = {r.doc_id: r.quality for r in labels.collect()}
    right = [r.kept == bool(truth[r.doc_id]) for r in out if r.doc_id in truth]
    assert sum(right) > 0.9 * len(right)


def test_edge_rows(spark):
    rng = random.Random(2)
    few = lambda n: " ".join(rng.choice("ab") for _ in range(n))
    texts = [None, "", " \t\n", "a b c d e " * 2, "a b c d e f g h i j k", few(40), few(300), "x\u3000y \x0bz\x1cw " * 4, "é# |\n\n l1\nl1\nl1 \n", "w " * 30000, "a\r\nb\r\na\r\n" * 5]
    df = spark.createDataFrame(list(enumerate(texts)) + [(None, few(30)), (3, texts[3])], "doc_id long, text string").selectExpr("*", "'x' as kept", "1 as n_words")
    out = quality_rules.judge(df, spark.createDataFrame([], "doc_id long, quality int")).collect()
    assert len(out) == len(texts) + 2
    for r in out:
        if r.doc_id is not None:
            assert tuple(r)[1:7] == brute.base_rules(texts[r.doc_id]), r
            assert r.kept == (not r.base_failed) and r.rule is None
    assert quality_rules.judge(df.where("false"), spark.createDataFrame([(1, 0), (2, None)], "doc_id long, quality int")).count() == 0


def test_learns_planted_rule(spark):
    rng = random.Random(3)
    docs, labels = [], []
    for i in range(400):
        bad = i % 4 == 0
        words = [f"w{rng.randrange(10**6)}" + ("#" if bad and rng.random() < 0.5 else "") for _ in range(50)]
        docs.append((i, " ".join(words)))
        labels.append((i, int(not bad)))
    out = quality_rules.judge(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int")).collect()
    assert all(r.kept == (r.doc_id % 4 != 0) for r in out)


def plain_list(rows, max_rules=None, max_conditions=None):
    """Sequential covering over the rows themselves: (features, bad, prune) to the rules as texts."""
    names = quality_rules.FEATURES

    def quantiles(values):
        values = sorted(values)
        share = [k / (quality_rules.BINS // 2) for k in range(quality_rules.BINS // 2 + 1)]
        return {values[max(math.ceil(s * len(values)), 1) - 1] for s in share} if values else set()

    cuts = {f: sorted(quantiles([x[f] for x, _, _ in rows]) | quantiles([x[f] for x, bad, _ in rows if bad])) for f in names}
    count = lambda some: (sum(bad for _, bad, _ in some), sum(not bad for _, bad, _ in some))
    holds = lambda c, x: (x[c[0]] > c[1]) == c[2]
    rules = []
    while max_rules is None or len(rules) < max_rules:
        conditions, trail, inside = [], [], rows
        while max_conditions is None or len(conditions) < max_conditions:
            grow = [r for r in inside if not r[2]]
            p0, n0 = count(grow)
            if not p0 or not n0:
                break
            best, gain = None, 1e-9
            for f in names:
                for cut in cuts[f]:
                    for above in (False, True):
                        p, n = count([r for r in grow if holds((f, cut, above), r[0])])
                        g = p * (math.log2(p / (p + n)) - math.log2(p0 / (p0 + n0))) if p else 0.0
                        if p + n >= quality_rules.LEAST_COVER and g > gain:
                            best, gain = (f, cut, above), g
            if best is None:
                break
            conditions.append(best)
            inside = [r for r in inside if holds(best, r[0])]
            trail.append(count([r for r in inside if r[2]]))
        if not conditions:
            break
        worth = [(p - n) / (p + n) if p + n else -1.0 for p, n in trail]
        most = worth.index(max(worth)) + 1
        p, n = trail[most - 1]
        if p + n == 0 or p < quality_rules.LEAST_PRECISION * (p + n):
            break
        conditions = conditions[:most]
        rules.append(" and ".join(f"{f} {'>' if above else '<='} {cut:g}" for f, cut, above in conditions))
        rows = [r for r in rows if not all(holds(c, r[0]) for c in conditions)]
    return rules


def test_list_against_covering_row_by_row(spark):
    """Planted conjunctions under noise; features with many ties, and labels that no feature explains."""
    for seed, caps in ((1, {}), (2, {}), (3, {"max_rules": 1}), (4, {"max_conditions": 1}), (5, {})):
        rng = random.Random(seed)
        data = []
        for _ in range(500):
            x = {f: float(rng.randrange(12)) / (1 + i % 3) for i, f in enumerate(quality_rules.FEATURES)}
            bad = (x["symbols"] > 2 and x["n_words"] <= 6) or x["capitals"] > 9 / (1 + quality_rules.FEATURES.index("capitals") % 3) or (x["digits"] > 1 and x["bars"] <= 1 and seed == 5)
            data.append((x, (rng.random() < 0.05) != bad))
        schema = f"features struct<{','.join(f'{f}:double' for f in quality_rules.FEATURES)}>, bad boolean"
        df = spark.createDataFrame([(tuple(x.values()), bad) for x, bad in data], schema)
        rows = [(r.features.asDict(), r.bad, r.prune) for r in df.select("*", (F.pmod(F.xxhash64("features"), F.lit(3)) == 0).alias("prune")).collect()]
        want = plain_list(rows, **caps)
        assert list(map(str, quality_rules.learn(df, Scratch(spark), 1, **caps))) == want and want
