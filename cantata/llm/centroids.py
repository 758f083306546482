"""Centroid clustering of integer vectors by partial-distance search.

Vectors with the right number of components, none of them null, NaN or infinite, become whole numbers: floor(scale * x). Centroids start as the
vectors with the smallest hashes of their ids and move for a fixed number of rounds to the floor of their vectors' mean, by component; then all
vectors are assigned once more. All distances and sums are whole numbers, so the result doesn't depend on partitions or order.

An assignment takes the dimensions in order of falling variance. After the first few of them the centroid that leads is measured in full, which
gives the bound; every other centroid goes on by a few dimensions at a time and is given up once its partial sum is strictly above that bound.
Those that finish all dimensions compete, the smaller number first among equals.

Each round is one pass over a written table: tasks add up their own vectors by cluster, and only k sums a task are shuffled, so a vector or a
cluster that holds most rows costs nothing extra. The driver sees k centroids, and no vectors but the k that start.

Edge cases: vectors that don't qualify give no row. A null id never starts a centroid, but its vector is clustered. Repeated rows count as
often as they stand there; with equal hashes the smaller vector starts first. With fewer than k vectors there are fewer centroids; without
any, no rows. Whole numbers beyond 2**27 count as 2**27, so that squared distances fit a long. Columns other than the id and
the vector are not looked at.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cantata.llm.common import Scratch, frugal

#: Dimensions that are added at once.
STEP = 8
#: Vectors that are compared with all centroids at once.
ROWS = 2048
MOST = 1 << 27


def nearest(x: np.ndarray, centroids: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of the nearest centroid of each row of x, and the squared distance. order: the dimensions, the most telling first."""
    x, c = x[:, order], centroids[:, order]
    part = ((x[:, None, :STEP] - c[None, :, :STEP]) ** 2).sum(2)
    winner = part.argmin(1)
    best = ((x - c[winner]) ** 2).sum(1)
    row, number = np.nonzero(part <= best[:, None])
    others = number != winner[row]
    row, number = row[others], number[others]
    so_far = part[row, number]
    for at in range(STEP, x.shape[1], STEP):
        so_far = so_far + ((x[row, at : at + STEP] - c[number, at : at + STEP]) ** 2).sum(1)
        alive = so_far <= best[row]
        row, number, so_far = row[alive], number[alive], so_far[alive]
    row, number, so_far = (np.concatenate(p) for p in ((row, np.arange(len(x))), (number, winner), (so_far, best)))
    first = np.lexsort((number, so_far, row))
    first = first[np.unique(row[first], return_index=True)[1]]
    return number[first], so_far[first]


def _matrix(column, dims: int) -> np.ndarray:
    return np.asarray(column.flatten(), np.int64).reshape(-1, dims)


def _slices(x: np.ndarray):
    return (x[i : i + ROWS] for i in range(0, len(x), ROWS))


def _moments(kept: DataFrame, dims: int) -> np.ndarray:
    """The dimensions by falling variance. They only order the search, so floating sums do."""

    def run(batches):
        import pyarrow as pa

        n, total, square = 0, np.zeros(dims), np.zeros(dims)
        for batch in batches:
            x = _matrix(batch.column(0), dims).astype(float)
            n, total, square = n + len(x), total + x.sum(0), square + (x * x).sum(0)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([float(n)] * dims), pa.array(range(dims), pa.int32()), pa.array(total), pa.array(square)], names=["n", "dim", "total", "square"])

    parts = kept.select("v").mapInArrow(frugal(run), "n double, dim int, total double, square double")
    spread = F.sum("square") / F.sum("n") - F.pow(F.sum("total") / F.sum("n"), 2)
    rows = parts.groupBy("dim").agg(spread.alias("spread")).collect()  # a row a dimension
    return np.array([r.dim for r in sorted(rows, key=lambda r: (-r.spread, r.dim))])


def _moved(kept: DataFrame, centroids: np.ndarray, order: np.ndarray) -> np.ndarray:
    """The centroids after a round. Sums are exact; a centroid without vectors stays."""
    k, dims = centroids.shape

    def run(batches):
        import pyarrow as pa

        count, total = np.zeros(k, np.int64), np.zeros((k, dims), np.int64)
        for batch in batches:
            for x in _slices(_matrix(batch.column(0), dims)):
                number, _ = nearest(x, centroids, order)
                for j in np.unique(number):
                    mine = x[number == j]
                    count[j] += len(mine)
                    total[j] += mine.sum(0)
        some = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(count[some]), pa.array(list(total[some]), pa.list_(pa.int64()))], names=["cluster", "n", "totals"])

    parts = kept.select("v").mapInArrow(frugal(run), "cluster int, n bigint, totals array<bigint>")
    sums = parts.select("cluster", "n", F.posexplode("totals").alias("dim", "total")).groupBy("cluster", "dim").agg(F.sum("n").alias("n"), F.sum(F.col("total").cast("decimal(38,0)")).alias("total"))
    out = centroids.copy()
    for r in sums.collect():  # k rows a dimension
        out[r.cluster, r.dim] = int(r.total) // r.n
    return out


def cluster(df: DataFrame, id_col: str = "vec_id", vector: str = "embedding", dims: int = 64, scale: int = 64, k: int = 16, rounds: int = 3, seed: int = 1) -> DataFrame:
    """A row for each vector that qualifies: id, cluster, distance (squared), cluster_inertia and inertia (distance summed over its cluster, and over
    all), centroid_sha256 (of its centroid's components in decimal, joined by commas). The k centroids start as the vectors with the smallest
    lower-case hex sha256 of `seed:id`."""
    scratch = Scratch(df.sparkSession)
    x = F.col(vector).cast("array<double>")
    good = (F.size(x) == dims) & F.forall(x, lambda v: F.coalesce(~F.isnan(v) & (F.abs(v) < float("inf")), F.lit(False)))
    whole = F.transform(x, lambda v: F.greatest(F.least(F.floor(v * scale), F.lit(MOST)), F.lit(-MOST)).cast("int"))
    kept = scratch.keep(df.where(good).select(F.col(id_col).alias("id"), whole.alias("v")), "kept")

    start = kept.where("id is not null").select(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256).alias("hash"), "v").orderBy("hash", "v").limit(k).collect()
    centroids = np.array([r.v for r in start], np.int64).reshape(-1, dims)
    if not len(centroids):
        return df.sparkSession.createDataFrame([], kept.select(F.col("id").alias(id_col)).schema).selectExpr("*", "0 AS cluster", "0L AS distance", "0L AS cluster_inertia", "0L AS inertia", "'' AS centroid_sha256")
    order = _moments(kept, dims)
    for _ in range(rounds):
        centroids = _moved(kept, centroids, order)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            found = [nearest(x, centroids, order) for x in _slices(_matrix(batch.column(1), dims))]
            number, distance = (np.concatenate([np.zeros(0, np.int64), *p]) for p in (zip(*found) if found else ((), ())))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(number, pa.int32()), pa.array(distance, pa.int64())], names=["id", "cluster", "distance"])

    schema = kept.select("id", F.lit(0).alias("cluster"), F.lit(0).cast("bigint").alias("distance")).schema
    found = scratch.keep(kept.select("id", "v").mapInArrow(frugal(run), schema), "found")
    sums = {r.cluster: int(r.total) for r in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("total")).collect()}  # k rows
    scratch.drop("kept")
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    of = lambda values: F.get(F.array(*map(F.lit, values)), F.col("cluster"))
    return found.select(
        F.col("id").alias(id_col), "cluster", "distance", of([sums.get(j, 0) for j in range(len(centroids))]).cast("bigint").alias("cluster_inertia"), F.lit(sum(sums.values())).cast("bigint").alias("inertia"), of(digests).alias("centroid_sha256")
    )
