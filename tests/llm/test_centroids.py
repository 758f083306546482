import hashlib
import math

import numpy as np
import pytest

from cantata.llm import centroids, oracles, queries


def plain(rows, k=16, rounds=3, dims=64, seed=1):
    """(id, cluster, distance, cluster_inertia, inertia, sha) of each vector by full distances, in plain integers."""
    kept = [(i, [math.floor(64 * float(x)) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    hashed = sorted((hashlib.sha256(f"{seed}:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)
    at = [v for _, v in hashed[:k]]
    if not at:
        return []
    distance = lambda a, b: sum((p - q) ** 2 for p, q in zip(a, b))
    place = lambda v: min((distance(v, c), j) for j, c in enumerate(at))
    for _ in range(rounds):
        own = {}
        for _, v in kept:
            own.setdefault(place(v)[1], []).append(v)
        at = [[sum(x) // len(own[j]) for x in zip(*own[j])] if j in own else c for j, c in enumerate(at)]
    found = [(i, *place(v)) for i, v in kept]
    sums = {}
    for _, d, j in found:
        sums[j] = sums.get(j, 0) + d
    return [(i, j, d, sums[j], sum(sums.values()), hashlib.sha256(",".join(map(str, at[j])).encode()).hexdigest()) for i, d, j in found]


def key(rows):
    return sorted(map(tuple, rows), key=lambda r: tuple(map(str, r)))


def test_partial_distances_equal_full_ones():
    rng = np.random.default_rng(3)
    for dims in (1, 7, 8, 64):
        x, c = rng.integers(-4, 5, (300, dims)), rng.integers(-4, 5, (9, dims))
        c[5] = c[2]
        number, distance = centroids.nearest(x, c, rng.permutation(dims))
        full = ((x[:, None] - c[None]) ** 2).sum(2)
        assert (number == full.argmin(1)).all() and (distance == full.min(1)).all() and not (number == 5).any()


def test_against_plain_integers(spark):
    rng = np.random.default_rng(5)
    rows = [(i, (rng.normal(size=64) / 3).tolist()) for i in range(120)] + [(7, [0.25] * 64)] * 50 + [(None, [0.5] * 64), (None, [0.5] * 64)]
    rows += [(200, None), (201, []), (202, [0.0] * 63), (203, [0.0] * 65), (204, [None] + [0.0] * 63), (205, [float("nan")] + [0.0] * 63), (206, [float("inf")] + [0.0] * 63), (207, [-0.01] * 64), (208, [-0.0] * 64)]
    df = spark.createDataFrame([(i, v, "x", 1, 2) for i, v in rows], "vec_id bigint, embedding array<double>, cluster string, id int, v int").repartition(5)
    assert key(centroids.cluster(df).collect()) == key(plain(rows))
    assert key(centroids.cluster(df, k=200, rounds=1, seed=2).collect()) == key(plain(rows, 200, 1, seed=2))
    floats = df.selectExpr("vec_id", "cast(embedding as array<float>) AS embedding")
    assert centroids.cluster(floats).count() == len(plain(rows))


def test_few_vectors_and_none(spark):
    schema = "vec_id bigint, embedding array<float>"
    assert centroids.cluster(spark.createDataFrame([], schema)).collect() == []
    assert centroids.cluster(spark.createDataFrame([(None, [0.0] * 64), (1, None)], schema)).collect() == []
    out = centroids.cluster(spark.createDataFrame([(1, [1.0] * 64)] * 3 + [(None, [0.0] * 64)], schema)).collect()
    assert key(out) == key(plain([(1, [1.0] * 64)] * 3 + [(None, [0.0] * 64)]))
    assert set(out[0].asDict()) == {"vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"}
    huge = centroids.cluster(spark.createDataFrame([(1, [3e38] * 64), (2, [-3e38] * 64)], schema), rounds=1).collect()
    assert {r.distance for r in huge} == {0}


def test_query_against_sql(spark):
    duckdb = pytest.importorskip("duckdb")
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{sf}/embeddings.parquet')")
    out = queries.op11_centroid_clustering(spark, sf)
    want = con.execute(f"SELECT {', '.join(out.columns)} FROM ({oracles.CENTROIDS})").fetchall()
    assert key(out.collect()) == key(want)
