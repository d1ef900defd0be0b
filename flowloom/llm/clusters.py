"""Exact Lloyd clustering in integers, with the bounds of each cluster's vectors in heap order.

A vector's gap is the distance to its second nearest centroid less that to its nearest. Each time centroids move, a gap
shrinks by no more than the drift of its own centroid plus the largest drift of another. That shrinkage is added up once a
cluster, not once a vector: a vector enters its cluster's heap under gap + shrinkage so far, and while the cluster's
shrinkage stays below that key the vector can't have changed its cluster. Only vectors whose key has been passed are popped,
compared with all centroids and pushed again.

The heaps are tables that are only ever added to, as tasks share no memory: the vectors pushed in a round are one table, sorted by
cluster and key within each file. As a cluster's shrinkage only grows, what expires in a round is one range of keys of each older
table, which Parquet's statistics find without reading the rest, and what is alive at the end are the rows beyond the last
shrinkage. Nothing is updated or shuffled; a lost executor costs the tasks it ran. Centroids and their sums come to the
driver: k * dim numbers.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written
from .topk import matrix

#: Of a component, so that squared distances of 64 components, and the products they are made of, fit 63 bits.
LARGEST = 1 << 26


def kept_vectors(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", dim: int = 64, scale: int = 1024) -> DataFrame:
    """(vec_id, v): floor(scale * x) of each component of the vectors of exactly `dim` components.

    Left out: null vectors, and those with a null, NaN or infinite component or one beyond LARGEST after scaling. Rows without
    an id and rows that repeat one stay; each row is a vector of its own.
    """
    x = F.col(vector_col)
    fine = F.forall(x, lambda a: a.isNotNull() & ~F.isnan(a) & (F.abs(a.cast("double") * F.lit(float(scale))) < F.lit(float(LARGEST))))
    return df.filter(x.isNotNull() & (F.size(x) == dim) & fine).select(F.col(id_col).cast("long").alias("vec_id"), F.transform(x, lambda a: F.floor(a.cast("double") * F.lit(float(scale))).cast("int")).alias("v"))


def first_centroids(vectors: DataFrame, k: int, salt: str = "3") -> np.ndarray:
    """The k vectors with smallest sha256 of `<salt>:<vec_id>`, in that order; ties by the vector, no id last."""
    by = F.sha2(F.concat(F.lit(f"{salt}:"), F.col("vec_id").cast("string")), 256)
    return np.array([r["v"] for r in vectors.orderBy(by.asc_nulls_last(), "v").limit(k).select("v").collect()], np.int64)


def squared(v: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Squared distances of all v to all centroids."""
    return (v * v).sum(1)[:, None] - 2 * (v @ centroids.T) + (centroids * centroids).sum(1)


def pushed(popped: DataFrame, centroids: np.ndarray, shrunk: np.ndarray) -> DataFrame:
    """(vec_id, v, was, cluster, key) of vectors compared with all centroids, in the order of their heaps."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            far = squared(matrix(b.column("v")), centroids)
            own = far.argmin(1)  # the first of equals
            near = np.sqrt(far[np.arange(len(own)), own].astype(float))
            next_ = np.sqrt(np.partition(far, 1, 1)[:, 1].astype(float)) if len(centroids) > 1 else np.full(len(own), np.inf)
            gap = np.maximum(next_ - near - 1e-6 - 1e-9 * near, 0)  # below the true gap, roots being rounded
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("v"), b.column("was"), pa.array(own.astype(np.int32)), pa.array(shrunk[own] + gap)], ["vec_id", "v", "was", "cluster", "key"])

    return popped.mapInArrow(scan, "vec_id long, v array<int>, was int, cluster int, key double").sortWithinPartitions("cluster", "key")


def moves(run: DataFrame, k: int, dim: int) -> np.ndarray:
    """What the vectors that have changed their cluster add to each cluster's count and sums: k rows of 1 + dim."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = np.zeros((k, 1 + dim), np.int64)
        for b in batches:
            v, to, was = matrix(b.column("v")), b.column("cluster").to_numpy(), b.column("was").to_numpy()
            rows = np.hstack([np.ones((len(v), 1), np.int64), v]) if len(v) else np.zeros((0, 1 + dim), np.int64)
            np.add.at(cells, to, rows)
            np.subtract.at(cells, was[was >= 0], rows[was >= 0])
        at = np.flatnonzero(cells)
        yield pa.RecordBatch.from_pydict({"i": at, "x": cells.ravel()[at]})

    out = np.zeros(k * (1 + dim), np.int64)
    for r in run.filter("cluster <> was").select("v", "was", "cluster").mapInArrow(partial, "i long, x long").groupBy("i").agg(F.sum("x").alias("x")).collect():
        out[r["i"]] = r["x"]
    return out.reshape(k, 1 + dim)


def between(run: DataFrame, low: np.ndarray | None, high: np.ndarray | None) -> DataFrame:
    """Rows of each cluster's heap with low <= key < high."""
    ranges = [(F.col("cluster") == c) & (F.lit(True) if low is None else F.col("key") >= float(low[c])) & (F.lit(True) if high is None else F.col("key") < float(high[c])) for c in range(len(low if low is not None else high))]
    return run.filter(reduce(lambda a, b: a | b, ranges))


def clustered(vectors: DataFrame, centroids: np.ndarray, rounds: int = 10) -> tuple[DataFrame, np.ndarray, list[int]]:
    """((vec_id, v, cluster, distance), final centroids, vectors compared with all centroids in each assignment).

    Every round assigns each vector to the nearest centroid (ties: the smaller number) and moves each centroid that has
    vectors to floor(sum / count); then vectors are assigned once more. `vectors` are those of kept_vectors(). Without
    vectors: no rows.
    """
    k, dim = centroids.shape
    heaps: list[DataFrame] = []
    scans: list[int] = []
    totals, shrunk, before = np.zeros((k, 1 + dim), np.int64), np.zeros(k), np.zeros(k)
    for turn in range(rounds + 1):
        popped = reduce(DataFrame.unionByName, [between(h, before, shrunk).select("vec_id", "v", F.col("cluster").alias("was")) for h in heaps]) if heaps else vectors.withColumn("was", F.lit(-1))
        heaps.append(written(pushed(popped, centroids, shrunk), "clusters-heap"))
        scans.append(heaps[-1].count())
        if turn == rounds:
            break
        totals += moves(heaps[-1], k, dim)
        counts = totals[:, :1]
        moved = np.where(counts > 0, totals[:, 1:] // np.maximum(counts, 1), centroids)
        drift = np.sqrt(((moved - centroids) ** 2).sum(1).astype(float))
        if not drift.any():
            break  # every later round would find and leave the same
        others = np.array([max(np.delete(drift, c), default=0.0) for c in range(k)])
        centroids, before, shrunk = moved, shrunk, shrunk + (drift + others) * (1 + 1e-9)
    alive = reduce(DataFrame.unionByName, [between(h, shrunk, None) for h in heaps])
    own = F.element_at(F.array(*[F.array(*map(F.lit, c)) for c in centroids.tolist()]), F.col("cluster") + 1)
    distance = F.aggregate(F.zip_with("v", own.cast("array<long>"), lambda a, b: (a - b) * (a - b)), F.lit(0).cast("long"), lambda s, a: s + a)
    return alive.select("vec_id", "v", "cluster", distance.alias("distance")), centroids, scans


def op12_clusters(spark, sf_dir: str) -> DataFrame:
    return report(kept_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet")), k=8, rounds=10)


def report(vectors: DataFrame, k: int, rounds: int, salt: str = "3") -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of every vector; with fewer than k vectors there
    are as many centroids as vectors. Inertias beyond a long are null."""
    spark = vectors.sparkSession
    start = first_centroids(vectors, k, salt)
    if not len(start):
        return spark.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    found, centroids, _ = clustered(vectors, start, rounds)
    found = written(found.select("vec_id", "cluster", "distance"), "clusters-found")
    sums = {r["cluster"]: int(r["s"]) for r in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(20,0)")).alias("s")).collect()}  # a row for each centroid
    held = lambda x: F.lit(x if x < 2**63 else None).cast("long")
    of = lambda values: F.element_at(F.array(*values), F.col("cluster") + 1)
    return found.withColumns({
        "cluster_inertia": of([held(sums.get(c, 0)) for c in range(len(centroids))]),
        "inertia": held(sum(sums.values())),
        "centroid_sha256": of([F.sha2(F.lit(",".join(map(str, c))), 256) for c in centroids.tolist()]),
    })


def sql(k: int = 8, rounds: int = 10) -> str:
    """The same rounds, each as two steps of a DuckDB query."""
    steps = [
        f"""v AS MATERIALIZED (
  SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), c0 AS MATERIALIZED (
  SELECT CAST(row_number() OVER (ORDER BY h, v) - 1 AS INTEGER) AS c, v FROM (
    SELECT sha256('3:' || vec_id) AS h, v FROM v ORDER BY h NULLS LAST, v LIMIT {k})
)"""
    ]
    for t in range(rounds + 1):
        steps.append(f"""a{t} AS MATERIALIZED (
  SELECT row, vec_id, v, c, d FROM (
    SELECT v.row, v.vec_id, v.v, c.c, CAST(list_sum(list_transform(list_zip(v.v, c.v), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS BIGINT) AS d
    FROM v CROSS JOIN c{t} c
  ) QUALIFY row_number() OVER (PARTITION BY row ORDER BY d, c) = 1
)""")
        if t < rounds:
            steps.append(f"""c{t + 1} AS MATERIALIZED (
  SELECT old.c, coalesce(new.v, old.v) AS v FROM c{t} old LEFT JOIN (
    SELECT c, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS v FROM (
      SELECT c, i, sum(x) AS s, count(*) AS n FROM (SELECT c, unnest(range(1, 65)) AS i, unnest(v) AS x FROM a{t}) GROUP BY c, i
    ) GROUP BY c
  ) new USING (c)
)""")
    return f"""WITH {", ".join(steps)}
SELECT vec_id, c AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia,
  CAST(sum(d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(f.v, ',')) AS centroid_sha256
FROM a{rounds} JOIN (SELECT c, v FROM c{rounds}) f USING (c)
"""


SQL = sql()
