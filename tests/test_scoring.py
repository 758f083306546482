import itertools
import math
import random
import time
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from cantata.operators import joins, samples, scoring, splits
from cantata.storage import Scratch


def plain_counts(ref, hyp):
    """The full table of distances, walked back by the stated rule."""
    m, n = len(ref), len(hyp)
    d = [[i + j if not i * j else 0 for j in range(n + 1)] for i in range(m + 1)]
    for i in range(1, m + 1):
        for j in range(1, n + 1):
            d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (ref[i - 1] != hyp[j - 1]))
    i, j, out = m, n, [0, 0, 0, 0]
    while i and j:
        if d[i][j] == d[i - 1][j] + 1:
            out[2], i = out[2] + 1, i - 1
        elif d[i][j - 1] == d[i - 1][j - 1] - 1:
            out[3], j = out[3] + 1, j - 1
        else:
            out[ref[i - 1] != hyp[j - 1]] += 1
            i, j = i - 1, j - 1
    assert out[1] + out[2] + i + out[3] + j == d[m][n]
    return out[0], out[1], out[2] + i, out[3] + j


def test_edit_counts_against_the_full_table():
    rng = random.Random(3)
    for _ in range(1500):
        ref, hyp = ([rng.choice("abc"[: rng.randrange(1, 4)]) for _ in range(rng.randrange(14))] for _ in range(2))
        assert scoring.edit_counts(ref, hyp) == plain_counts(ref, hyp), (ref, hyp)
    ref = [rng.choice(["a", "b", "c", None]) for _ in range(150)]
    hyp = [x for x in ref if rng.random() > 0.2] + ["z"] * 9
    assert scoring.edit_counts(ref, hyp) == plain_counts(ref, hyp)


def test_edit_counts_of_long_texts():
    rng, began = random.Random(4), time.monotonic()
    ref = [f"w{rng.randrange(3000)}" for _ in range(20_000)]
    hyp = [x for x in ref if rng.random() > 0.01]
    hits, substitutions, deletions, insertions = scoring.edit_counts(ref, hyp)
    assert (hits, substitutions, deletions, insertions) == (len(hyp), 0, len(ref) - len(hyp), 0)
    assert time.monotonic() - began < 20


def test_error_rates(spark):
    rows = [("en", ["a", "b", "c"], ["a", "x", "c", "d"]), ("en", [], ["a"]), ("en", None, None), ("de", ["a"], None), (None, [None, "a"], [None, "b"]), ("none", [], [])]
    df = spark.createDataFrame([(*r, 1) for r in rows], "lang string, r array<string>, h array<string>, hits int")
    out = {r.lang: r for r in scoring.error_rates(scoring.aligned(df, "r", "h", keep=("lang",)), "lang").where("n != 6").collect()}
    assert tuple(out["en"])[1:] == (3, 3, 5, 2, 1, 0, 2, 1.0) and out["de"].error_rate == 1.0 and out["none"].error_rate is None
    assert scoring.error_rates(scoring.aligned(df, "r", "h")).collect()[0].error_rate == 5 / 6
    words = [("".join(random.Random(i).choices("abé ", k=i)), "".join(random.Random(-i).choices("abé ", k=i + 2))) for i in range(40)]
    df = spark.createDataFrame([*words, (None, "ab")], "a string, b string").select("*", *(F.regexp_extract_all(c, F.lit("(?s)."), F.lit(0)).alias(f"{c}s") for c in "ab"))
    got = scoring.aligned(df, "as", "bs", keep=("a", "b")).withColumn("want", F.levenshtein(F.coalesce("a", F.lit("")), "b"))
    assert got.where("substitutions + deletions + insertions != want").count() == 0
    assert sorted(map(str, scoring.aligned(df, "a", "b", keep=("a", "b")).collect())) == sorted(map(str, got.drop("want").collect()))
    assert scoring.error_rates(scoring.aligned(df.where("false"), "as", "bs")).collect() == []


def most_pairs(ref, found, tolerance):
    best = 0
    for k in range(min(len(ref), len(found)), 0, -1):
        if any(all(abs(a - b) <= tolerance for a, b in zip(x, y)) for x in itertools.combinations(ref, k) for y in itertools.combinations(found, k)):
            return k
    return best


def test_boundaries(spark):
    rng = random.Random(5)
    for _ in range(200):
        ref, found = (sorted(rng.randrange(30) for _ in range(rng.randrange(6))) for _ in range(2))
        assert scoring.match_times(ref, found, 3)[0] == most_pairs(ref, found, 3)
    df = spark.createDataFrame([("a", [0.0, 1.0, 2.0], [2.05, None, 0.04, 5.0]), ("a", None, [1.0]), ("b", [], []), (None, [1.0], [1.0, 1.0])], "g string, r array<double>, f array<double>")
    hits = scoring.boundary_hits(df, "r", "f", 0.05, keep=("g",))
    out = {r.g: r for r in scoring.boundary_rates(hits, "g").where("n_ref < 4").collect()}
    assert (out["a"].n_ref, out["a"].n_found, out["a"].hits) == (3, 4, 2) and math.isclose(out["a"].mean_shift, 0.045) and out["b"].hit_rate is None and out[None].precision == 0.5
    item = "array<struct<text:string,start_time:double,end_time:double>>"
    df = spark.createDataFrame([([("a", 0.0, 1.0), ("b", 1.0, 2.0)], [("a", 0.5, 1.0), ("b", 1.0, 2.25)]), ([], []), ([("a", 0.0, 1.0)], []), (None, [])], f"r {item}, f {item}")
    assert [x.s for x in df.select(scoring.boundary_shift(F.col("r"), F.col("f")).alias("s")).collect()] == [0.75, 0.0, None, None]


def plain_curve(rows, precision):
    rows = [(s, t) for s, t in rows if s is not None and t is not None]
    p, n = sum(t for _, t in rows), sum(1 - t for _, t in rows)
    key = lambda s: (1, 0) if math.isnan(s) else (0, s)
    area = sum((key(a) > key(b)) + (key(a) == key(b)) / 2 for a, t in rows if t for b, u in rows if not u)
    steps, reach = 0.0, None
    for s in {key(s) for s, _ in rows}:
        tp, fp = sum(t for x, t in rows if key(x) >= s), sum(1 - t for x, t in rows if key(x) >= s)
        steps += sum(t for x, t in rows if key(x) == s) * tp / (tp + fp)
        if tp and tp >= precision * (tp + fp):
            reach = max(reach or 0, tp)
    return p, n, area / p / n if p and n else None, steps / p if p else None, reach / p if p and reach else None


def test_curves_against_all_pairs(spark):
    rng = random.Random(6)
    rows = [(rng.choice(["a", "b", None]), rng.choice([None, float("nan"), *map(float, range(12))]), rng.choice([0, 1, 1, None])) for _ in range(400)] + [("hot", 3.0, i % 2) for i in range(400)] + [("pos", 1.0, 1), ("neg", 1.0, 0)]
    df = spark.createDataFrame(rows, "g string, s double, t int").repartition(6)
    close = lambda a, b: all(x == y or math.isclose(x, y) for x, y in zip(a, b))
    for r in scoring.curve_metrics(scoring.curve_points(df, "s", "t", "g"), "g", precision=0.6).collect():
        assert close(tuple(r)[1:], plain_curve([(s, t) for g, s, t in rows if g == r.g], 0.6)), r
    assert close(tuple(scoring.curve_metrics(scoring.curve_points(df, "s", "t"), precision=0.6).first()), plain_curve([r[1:] for r in rows], 0.6))
    assert scoring.curve_metrics(scoring.curve_points(df.where("false"), "s", "t", "g"), "g").collect() == []


def test_running_totals_over_partitions(spark, monkeypatch):
    rng = random.Random(8)
    rows = [(rng.choice([None, "x", "y"]), i, rng.randrange(-3, 9)) for i in range(500)]
    df = spark.createDataFrame(rows, "g string, o int, v bigint").repartition(5)
    for small in (joins.SMALL, 0):
        monkeypatch.setattr(joins, "SMALL", small)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        try:
            out = joins.running_totals(df, ["g"], [F.desc("o")], ["v"]).collect()
        finally:
            spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        assert len(out) == 500 and all(r.running_v == sum(v for g, o, v in rows if g == r.g and o >= r.o) for r in out)


def union_find(edges):
    up = {}

    def root(x):
        while up.setdefault(x, x) != x:
            up[x] = x = up[up[x]]
        return x

    for a, b in edges:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return {x: root(x) for x in up}


def test_components(spark, monkeypatch):
    rng = random.Random(9)
    chain = [(f"c{i:03}", f"c{i + 1:03}") for i in range(120)]
    star = [("hub", f"s{i}") for i in range(300)]
    some = [(f"v{rng.randrange(400)}", f"v{rng.randrange(400)}") for _ in range(180)]
    edges = [*chain, *star, *some, ("self", "self"), ("a", "b"), ("b", "a"), ("a", "b")]
    df = spark.createDataFrame([*edges, (None, "x"), ("x", None)], "u string, v string")
    want = union_find(edges)
    got = splits.components(df, Scratch(spark)).collect()
    assert {r.vertex: r.component for r in got} == want and len(got) == len(want)
    monkeypatch.setattr(joins, "SMALL", 0)
    monkeypatch.setattr(joins, "FREQUENT", 20)
    got = splits.components(df.where("u not like 'c%' or u is null"), Scratch(spark)).collect()
    assert {r.vertex: r.component for r in got} == union_find([e for e in edges if not e[0].startswith("c")])
    assert splits.components(df.where("false"), Scratch(spark)).count() == 0


SHARES = {"train": 800, "validation": 100, "test": 100}


def test_split_keeps_components_and_shares(spark):
    rng = random.Random(10)
    rows = [(i, f"r{i // 3}", f"s{rng.randrange(3000)}") for i in range(6000)] + [(i, f"hot{i}", "everywhere") for i in range(6000, 6300)] + [(7000, None, "s1"), (7001, "r1", None), (7002, None, None), (7003, None, None)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "id int, recording string, speaker string, component int").drop("component").repartition(3)
    out = splits.leakage_safe_split(df, ["recording", "speaker"], SHARES).collect()
    assert sorted(r.id for r in out) == [r[0] for r in rows]
    of, sizes, got = {}, {}, {}
    for r in out:
        assert of.setdefault(r.component, r.split) == r.split
        sizes[r.component] = sizes.get(r.component, 0) + 1
        got[r.split] = got.get(r.split, 0) + 1
    ties = union_find([(f"0:{a}", f"1:{b}") for _, a, b in rows if a and b])
    for r in out:
        if r.recording:
            assert r.component == ties[f"0:{r.recording}"]
    assert {r.component for r in out if r.id > 7001} == {""}
    bound = max(sizes.values())
    assert all(abs(got.get(s, 0) - len(rows) * part / 1000) <= bound for s, part in SHARES.items())


def test_split_by_size_with_light_components(spark):
    df = spark.range(20_000).selectExpr("id", "cast(id as string) AS r", "cast(id div 2 as string) AS s", "id % 5 AS seconds")
    out = splits.leakage_safe_split(df, ["r", "s"], SHARES, size="seconds").groupBy("split").agg(F.sum("seconds").alias("n")).collect()
    assert all(abs(r.n - 40 * SHARES[r.split]) <= 10 for r in out) and len(out) == 3
    one = splits.leakage_safe_split(df.withColumn("s", F.lit("all")), ["r", "s"], SHARES)
    assert [tuple(r) for r in one.groupBy("split").count().collect()] == [("train", 20_000)]
    assert splits.leakage_safe_split(df.where("false"), ["r", "s"], SHARES).count() == 0
    zero = splits.leakage_safe_split(df.withColumn("seconds", F.lit(0)), ["r"], {"train": 1000}, size="seconds")
    assert zero.where("split = 'train'").count() == 20_000
    with pytest.raises(ValueError):
        splits.leakage_safe_split(df, ["r"], {"train": 10})


def test_truncations(spark):
    items = lambda n: [(f"w{k}" + ("," if k % 4 == 3 else ""), k * 1.0, k + 0.5 + 0.5 * (k % 2)) for k in range(n)]
    rows = [(i, items(21), "x") for i in range(400)] + [(1000, items(1), "x"), (1001, [], "x"), (1002, None, "x"), (1003, items(2), "x"), (1004, [("well", 0.0, 1.0), ("Um,", 2.0, 3.0), ("so", 3.0, 4.0)], "x")]
    df = spark.createDataFrame(rows, "id int, items array<struct<text:string,start_time:double,end_time:double>>, kind string")
    out = samples.truncations(df, "id", "items", per_row=4, keep=("id",)).collect()
    full = {r.id: r for r in out if r.label == "complete"}
    assert set(full) == {*range(400), 1000, 1003, 1004} and full[3].n_words == 21 and full[3].cut_time_ms == 20_500 and full[3].kind == "end"
    cuts = [r for r in out if r.label == "incomplete" and r.id < 400]
    assert len(cuts) == 1600 and {r.n_words for r in cuts} == set(range(1, 21))
    counts = [sum(r.n_words == k for r in cuts) for k in range(1, 21)]
    assert min(counts) > 50 and max(counts) < 115  # 80 each, evenly over the lengths
    for r in cuts:
        k = r.n_words - 1
        assert r.cut_time_ms == (k * 1000 + 750 if k % 2 == 0 else k * 1000 + 1000) and r.kind == ("part" if k % 4 == 3 else "pause" if k % 2 == 0 else "word")
    assert [(r.n_words, r.label) for r in out if r.id in (1000, 1003)] == [(1, "complete"), (1, "incomplete"), (2, "complete")]
    assert {r.kind for r in out if r.id == 1004} == {"filler", "end"}
    again = samples.truncations(df, "id", "items", per_row=4, keep=("id",)).collect()
    assert again == out and samples.truncations(df, "id", "items", per_row=4, seed="b", keep=("id",)).collect() != out


def test_checks(spark):
    rows = [(1, "en", "good text"), (2, "en", None), (3, "en", " 　"), (4, "de", "bell \x07"), (5, None, "x" * 30), (6, "de", "tab\tis fine")]
    df = spark.createDataFrame(rows, "id int, lang string, text string").withColumn("reasons_", F.lit(1))
    checks = [*samples.text_checks("text", 2, 20), samples.Check("language", F.col("lang") == "en")]
    out = samples.check_rows(df, checks)
    assert {r.id: r.reasons for r in out.bad.collect()} == {2: ["blank", "control characters", "length"], 3: ["blank"], 4: ["control characters", "language"], 5: ["length", "language"], 6: ["language"]}
    assert [r.id for r in out.good.collect()] == [1] and out.good.columns == df.columns
    assert out.counts == {"rows": 6, "blank": 2, "control characters": 2, "length": 2, "language": 3}
    none = samples.check_rows(df.where("false"), checks)
    assert none.good.count() == none.bad.count() == 0 and none.counts["rows"] == 0


def test_quantile_sketches(spark):
    df = spark.range(40_000).selectExpr("id % 2 AS g", "(id * 7919) % 40000 AS v", "id % 4 AS day")
    days = samples.sketches(df.where("day < 2"), "g", F.col("v")).unionByName(samples.sketches(df.where("day >= 2"), "g", F.col("v")))
    whole = samples.merged_sketches(days, "g").select("g", "n", *(samples.sketch_quantile("sketch", p).alias(f"q{i}") for i, p in enumerate((0.1, 0.5, 0.99)))).collect()
    assert {r.g: r.n for r in whole} == {0: 20_000, 1: 20_000}
    for r in whole:
        assert all(abs(x / 40_000 - p) < 0.03 for x, p in zip(tuple(r)[2:], (0.1, 0.5, 0.99)))
    bounds = samples.ratio_bounds(df.selectExpr("if(g = 0, 'a', null) AS g", "v"), "g", F.col("v"), 0.25, 0.75, margin=2.0)
    got = samples.with_bounds(spark.createDataFrame([("a",), (None,), ("b",)], "g string"), "g", bounds).collect()
    assert [(r.low is None) for r in got] == [False, False, True] and abs(got[0].low - 5000) < 50 and abs(got[0].high - 60_000) < 200


def test_bounds_are_exact(spark, monkeypatch):
    rng = random.Random(11)
    rows = [(rng.choice(["hot"] * 20 + [None]), rng.choice([None, 1.0, *(rng.random() for _ in range(30))])) for _ in range(20_000)]
    rows += [("hundred", float(i)) for i in range(1, 101)] + [("one", 2.0), ("nulls", None), ("nan", 1.0), ("nan", float("nan"))]
    df = spark.createDataFrame(rows, "g string, v double").repartition(6)
    key = lambda x: (math.isnan(x), x)
    for small, shares in ((joins.SMALL, ("0.05", "0.95")), (joins.SMALL, ("0.07", "0.56")), (0, ("0.0", "1.0"))):
        monkeypatch.setattr(joins, "SMALL", small)
        got = {r.g: (r.low, r.high) for r in samples.ratio_bounds(df, "g", F.col("v"), *map(float, shares)).collect()}
        assert set(got) == {g for g, _ in rows}
        for g, bounds in got.items():
            of = sorted((v for k, v in rows if k == g and v is not None), key=key)
            want = [of[max(math.ceil(len(of) * Fraction(p)), 1) - 1] if of else None for p in shares]
            assert str(list(bounds)) == str(want), g
