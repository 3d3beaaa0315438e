"""k-means by sort-means, in exact integers.

Each round sends the centroids and their pairwise distances to the vectors. A vector starts from its
previous centroid and looks at the others in order of their distance from that one, until one lies
strictly beyond twice its own distance: by the triangle inequality none from there on is nearer, or as
near. Squared integers are compared (> 4 times the square), so nothing is rounded. The vectors of a
batch that share a previous centroid go through its order together. Each round's assignment is written
to the shared folder; sums are aggregated map-side, and only the k centroids come to the driver.

Vectors with another number of components, or null or non-finite ones, take no part. Defined results:
of equally near centroids the smaller number wins; an empty centroid stays where it is; fewer vectors
than k give as many centroids as there are vectors; repeated rows count each; a null vec_id takes part,
but starts a centroid only where all others do; without vectors there are no rows. Scaled components
beyond MOST (whose squares would leave a long) are an error. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Of scaled components: squared distances of 1024 components then stay within a long.
MOST = 1 << 25


def nearest(v: np.ndarray, before: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Centroid and squared distance of every vector, given its previous one; and how many distances were computed."""
    apart = ((centroids[:, None] - centroids[None]) ** 2).sum(2)
    cluster, dist = before.copy(), np.empty(len(v), np.int64)
    computed = 0
    for c in np.unique(before).tolist():
        rows = np.flatnonzero(before == c)
        own = ((v[rows] - centroids[c]) ** 2).sum(1)
        order = np.argsort(own, kind="stable")
        rows, own = rows[order], own[order]
        best, best_at = own.copy(), np.full(len(rows), c, np.int64)
        others = np.argsort(apart[c], kind="stable")
        others = others[others != c]
        first = np.searchsorted(4 * own, apart[c][others])  # from this row on, a centroid isn't beyond twice the distance
        computed += len(rows)
        for j, k in zip(others.tolist(), first.tolist()):
            if k == len(rows):
                break
            d = ((v[rows[k:]] - centroids[j]) ** 2).sum(1)
            computed += len(d)
            won = k + np.flatnonzero((d < best[k:]) | ((d == best[k:]) & (j < best_at[k:])))
            best[won], best_at[won] = d[won - k], j
        cluster[rows], dist[rows] = best_at, best
    return cluster, dist, computed


def _assigned(state: DataFrame, centroids: np.ndarray, keep: list[str]) -> DataFrame:
    """`keep` of vec_id, v, cluster, distance, from a state (vec_id, v, cluster)."""
    kinds = {"vec_id": "long", "v": "array<int>", "cluster": "int", "distance": "long"}

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            v = b.column("v").flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1).astype(np.int64)
            cluster, dist, _ = nearest(v, b.column("cluster").to_numpy(zero_copy_only=False).astype(np.int64), centroids)
            out = {"vec_id": b.column("vec_id"), "v": b.column("v"), "cluster": pa.array(cluster, pa.int32()), "distance": pa.array(dist, pa.int64())}
            yield pa.RecordBatch.from_arrays([out[c] for c in keep], names=keep)

    return common.in_batches(state, assign, ", ".join(f"{c} {kinds[c]}" for c in keep))


def _means(state: DataFrame, centroids: np.ndarray) -> np.ndarray:
    sums = state.groupBy("cluster").agg(F.count("*").alias("n"), F.array(*[F.sum(F.col("v")[i]) for i in range(centroids.shape[1])]).alias("total"))
    out = centroids.copy()
    for r in sums.collect():
        out[r.cluster] = [x // r.n for x in r.total]
    return out


def prepared(vectors: DataFrame, dims: int, scale: int) -> DataFrame:
    """vec_id and integer components of the vectors that take part."""
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    large = F.exists("v", lambda x: F.abs(x) > MOST)
    kept = vectors.where((F.size("embedding") == dims) & ~bad).select(F.col("vec_id").cast("long"), F.transform("embedding", lambda x: F.floor(scale * x.cast("double"))).alias("v"))
    fits = F.when(large, F.raise_error(F.lit(f"sort_means: a scaled component is beyond {MOST}"))).otherwise(F.col("v").cast("array<int>"))
    return kept.select("vec_id", fits.alias("v"))


def sort_means(vectors: DataFrame, k: int = 16, rounds: int = 3, dims: int = 64, scale: int = 64, seed: int = 1) -> tuple[DataFrame, np.ndarray]:
    """(vec_id, cluster, distance) of the vectors (vec_id, embedding) that take part, and the final centroids."""
    state = common.stored(prepared(vectors, dims, scale).withColumn("cluster", F.lit(0)), "vectors")
    start = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")).cast("binary"), 256)
    centroids = np.array([r.v for r in state.select(start.alias("h"), "v").orderBy(F.asc_nulls_last("h"), "v").limit(k).collect()], np.int64).reshape(-1, dims)
    if not len(centroids):
        return state.select("vec_id", "cluster", F.lit(0).cast("long").alias("distance")), centroids
    for _ in range(rounds):
        state = common.stored(_assigned(state, centroids, ["vec_id", "v", "cluster"]), "assigned")
        centroids = _means(state, centroids)
    return common.cut(_assigned(state, centroids, ["vec_id", "cluster", "distance"])), centroids


def op12_sort_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector's cluster and distance, with the inertia of its cluster and of all, and its centroid's digest."""
    rows, centroids = sort_means(common.table(spark, sf_dir, "embeddings"))
    inertia = {r.cluster: r.inertia for r in rows.groupBy("cluster").agg(F.sum("distance").alias("inertia")).collect()}
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    facts = [(c, n, sum(inertia.values()), digest[c]) for c, n in inertia.items()]
    return rows.join(F.broadcast(spark.createDataFrame(facts, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _round(i: int) -> str:
    return f"""
a{i} AS MATERIALIZED (
  SELECT r, any_value(vec_id) AS vec_id, any_value(v) AS v, min((d, c)) AS best FROM (
    SELECT k.r, k.vec_id, k.v, c.c, (list_inner_product(k.v, k.v) - 2 * list_inner_product(k.v, c.v) + list_inner_product(c.v, c.v))::BIGINT AS d
    FROM k, c{i} c) GROUP BY r),
m{i} AS (
  SELECT c, list(m ORDER BY i) AS v FROM (
    SELECT best[2] AS c, i, floor(sum(v[i])::DOUBLE / count(*)) AS m FROM a{i}, range(1, 65) x(i) GROUP BY ALL) GROUP BY c),
c{i + 1} AS MATERIALIZED (SELECT c, coalesce(m{i}.v, c{i}.v) AS v FROM c{i} LEFT JOIN m{i} USING (c)),"""


ORACLE = f"""
WITH k AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS v FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY h NULLS LAST, v) - 1 AS c, v FROM (SELECT sha256('1:' || vec_id) AS h, v FROM k ORDER BY h NULLS LAST, v LIMIT 16)),
{"".join(map(_round, range(4)))}
i AS (SELECT best[2] AS c, sum(best[1])::BIGINT AS n FROM a3 GROUP BY 1)
SELECT vec_id, best[2]::INT AS cluster, best[1]::BIGINT AS distance, i.n AS cluster_inertia, (SELECT sum(n) FROM i)::BIGINT AS inertia,
       sha256(array_to_string(list_transform(c3.v, lambda x: x::BIGINT::VARCHAR), ',')) AS centroid_sha256
FROM a3 JOIN i ON i.c = best[2] JOIN c3 ON c3.c = best[2]
"""
