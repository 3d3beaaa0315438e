"""Exact top-k inner products by a Voronoi join.

Vectors are assigned to the nearest of some pivots, whose number grows with the rows. A first pass
solves each question exactly over the cells most promising by their pivots, as many as hold enough rows; its k-th score there
is a level that the answer can't fall below. With it, an inner product being bounded by the pivot's one
and Cauchy-Schwarz on the remainder, follows for every question and data cell the least distance from
the pivot at which a row could still matter. Only rows beyond it are sent in the second pass. Cells of
questions that need about the same rows are solved as one group of bounded size, so rows aren't sent
more often than bounds require; the rows sent to a group are dealt into slices of bounded size, so a
cell that holds most rows is many tasks. Each task solves its questions against its slice by matrix
products, and the winners are merged.

Components count as floor(scale * x). Defined results: null vectors, vectors with a null, NaN or
infinite component and rows with a null id take no part; shorter vectors count as filled with zeros
up to the longest; a question whose id repeats is asked once, with the least of its vectors (arrays in
order); candidates that repeat are separate rows; a row is never its own candidate, nor are rows of its
id; ties go to the smaller id; an empty table gives no rows. Scores are exact below 2^63. Extra columns
are ignored.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common

#: Pivots: the square root of the rows over ROWS_PER_PIVOT, at most MAX_PIVOTS (what is held of pairs of cells grows with its
#: square), spread out over so many times as many rows.
ROWS_PER_PIVOT, MAX_PIVOTS, LOOKED_AT = 4, 1024, 8
QUERIES_PER_GROUP, ROWS_PER_SLICE = 2048, 40_000
#: Small tables (which cell goes to which group) up to so many rows are broadcast.
BROADCAST_ROWS = 200_000
_NEVER = -(2**63) + 1


def _matrix(column, scale: int) -> np.ndarray:
    """Rows of floor(scale * x) as whole float64 numbers, filled up with zeros."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    sizes = np.diff(column.offsets.to_numpy()) if len(column) else np.zeros(0, int)
    flat = np.floor(scale * column.flatten().to_numpy(zero_copy_only=False).astype(np.float64))
    wide = int(sizes.max()) if len(sizes) else 0
    if (sizes == wide).all():
        return flat.reshape(len(sizes), wide)
    out = np.zeros((len(sizes), wide))
    out[np.arange(wide) < sizes[:, None]] = flat
    return out


def _fit_width(a: np.ndarray, wide: int) -> np.ndarray:
    return a if a.shape[1] == wide else np.pad(a[:, :wide], ((0, 0), (0, max(0, wide - a.shape[1]))))


def _assigner(pivots: np.ndarray, scale: int):
    def assign(batches):
        square = (pivots**2).sum(1)
        for b in batches:
            x = _matrix(b.column("embedding"), scale)
            x2 = (x**2).sum(1)
            d2 = x2[:, None] - 2 * _fit_width(x, pivots.shape[1]) @ pivots.T + square if len(x) else np.zeros((0, len(pivots)))
            cell = d2.argmin(1) if len(x) else np.zeros(0, int)
            dist = np.sqrt(np.maximum(0, d2[np.arange(len(x)), cell]))
            yield pa.RecordBatch.from_arrays(
                [b.column("vec_id"), b.column("embedding"), pa.array(cell, pa.int32()), pa.array(dist, pa.float64()), pa.array(np.sqrt(x2), pa.float64())],
                names=["vec_id", "embedding", "cell", "dist", "norm"],
            )

    return assign


def top_rows(queries: np.ndarray, query_ids: np.ndarray, rows: np.ndarray, ids: np.ndarray, k: int, met=None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query id, row id, score) of each query's k best rows of other ids, by blocks of queries and rows.

    met: (queries' cells, rows' cells, which pairs of cells have met before and are left out).
    """
    order = np.argsort(ids, kind="stable")
    rows, ids = rows[order], ids[order]
    wide = max(queries.shape[1], rows.shape[1])
    queries, rows = _fit_width(queries, wide), _fit_width(rows, wide)
    exact = np.abs(queries).max(initial=0) * np.abs(rows).max(initial=0) * wide < 2**52
    out = []
    for a in range(0, len(queries), 256):
        q, q_ids = queries[a : a + 256], query_ids[a : a + 256]
        best_s, best_i = np.zeros((len(q), 0), np.int64), np.zeros((len(q), 0), np.int64)
        for b in range(0, len(rows), 8192):
            x = rows[b : b + 8192]
            s = (q @ x.T).astype(np.int64) if exact else q.astype(np.int64) @ x.T.astype(np.int64)
            out_of = q_ids[:, None] == ids[None, b : b + 8192]
            if met:
                out_of |= met[2][met[0][a : a + 256, None], met[1][order][None, b : b + 8192]]
            s = np.where(out_of, _NEVER, s)
            place = np.broadcast_to(np.arange(b, b + len(x)), s.shape)
            if s.shape[1] > 4 * k:  # everything from the k-th score up, ties included, then cut
                level = -np.partition(-s, k - 1, axis=1)[:, k - 1 : k]
                width = int((s >= level).sum(1).max())
                if width < s.shape[1]:
                    pick = np.argsort(s < level, axis=1, kind="stable")[:, :width]
                    s, place = np.take_along_axis(s, pick, 1), np.take_along_axis(place, pick, 1)
            s, place = np.hstack([best_s, s]), np.hstack([best_i, place])
            first = np.lexsort((place, -s), axis=1)[:, :k]
            best_s, best_i = np.take_along_axis(s, first, 1), np.take_along_axis(place, first, 1)
        real = best_s > _NEVER
        out.append((np.broadcast_to(q_ids[:, None], best_s.shape)[real], ids[best_i[real]], best_s[real]))
    return tuple(np.concatenate([o[i] for o in out] or [np.zeros(0, np.int64)]) for i in range(3))


def _solver(scale: int, k: int, home: dict[int, list[int]] | None):
    """home: per question cell the cells that its questions have met."""
    cells = 1 + max((j for c, h in (home or {}).items() for j in (c, *h)), default=0)

    def solve(queries: pa.Table, rows: pa.Table) -> pa.Table:
        got = [np.zeros(0, np.int64)] * 3
        if len(queries) and len(rows):
            met = None
            if home:
                known = np.zeros((cells + 1, cells + 1), bool)
                for c in np.unique(queries["cell"].to_numpy()).tolist():
                    known[c, home[c]] = True
                met = (np.minimum(queries["cell"].to_numpy(), cells), np.minimum(rows["cell"].to_numpy(), cells), known)
            got = top_rows(_matrix(queries["embedding"], scale), queries["vec_id"].to_numpy(), _matrix(rows["embedding"], scale), rows["vec_id"].to_numpy(), k, met)
        return pa.table({n: pa.array(x, pa.int64()) for n, x in zip(("query_id", "vec_id", "score"), got)})

    return solve


def _spread(x: np.ndarray, most: int) -> np.ndarray:
    """Of distinct rows, `most` that each lie farthest from those before."""
    apart, chosen = np.full(len(x), np.inf), [0]
    while len(chosen) < min(most, len(x)):
        apart = np.minimum(apart, ((x - x[chosen[-1]]) ** 2).sum(1))
        chosen.append(int(apart.argmax()))
    return x[chosen]


def _needs(pivots: np.ndarray, home: dict[int, list[int]], far: np.ndarray, scale: int):
    """Per question cell and data cell outside its home: the least distance at which a row matters to one of the questions, where rows that far exist."""

    def needs(batches):
        least = np.full((len(pivots), len(pivots)), np.inf)
        for b in batches:
            x, level, cell = _fit_width(_matrix(b.column("embedding"), scale), pivots.shape[1]), b.column("level").to_numpy(zero_copy_only=False), b.column("cell").to_numpy()
            norm = b.column("norm").to_numpy()[:, None]
            dot = x @ pivots.T
            slack = 1 + 1e-9 * (np.abs(dot) + norm * far + np.abs(np.where(np.isfinite(level), level, 0))[:, None])
            with np.errstate(divide="ignore", invalid="ignore"):
                reach = np.where(np.isfinite(level)[:, None] & (norm > 0), (level[:, None] - dot - slack) / norm, -np.inf)
            np.minimum.at(least, cell, np.where(reach <= far, reach, np.inf))
        for c, others in home.items():
            least[c, others] = np.inf
        c, j = np.nonzero(least < np.inf)
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32()), pa.array(j, pa.int32()), pa.array(least[c, j])], names=["c", "cell", "least"])

    return needs


def _groups(least: dict[int, dict[int, float]], asked: dict[int, int], sizes: dict[int, int], near: list[int]) -> list[tuple[list[int], dict[int, float]]]:
    """Question cells that need about the same data cells, together: (question cells, {data cell: least distance})."""
    out: list = []
    rows = lambda need: sum(sizes[j] for j in need)
    open_cells, open_need, held = [], {}, 0
    for c in near:
        need = least.get(c, {})
        both = {j: min(open_need.get(j, np.inf), need.get(j, np.inf)) for j in open_need.keys() | need.keys()}
        if open_cells and (held + asked[c] > QUERIES_PER_GROUP or rows(both) > 1.25 * max(rows(open_need), rows(need))):
            out.append((open_cells, open_need))
            open_cells, open_need, held, both = [], {}, 0, need
        open_cells, open_need, held = [*open_cells, c], both, held + asked[c]
    return [*out, (open_cells, open_need)] if open_cells else out


@dataclass
class Join:
    """Questions (vec_id, embedding, cell, norm) and rows (with dist too) of a join for the k best."""

    queries: DataFrame
    data: DataFrame
    k: int
    scale: int

    def pass_over(self, groups: list[tuple[list[int], dict[int, float]]], asked: dict[int, int], sizes: dict[int, int]) -> tuple[DataFrame, DataFrame]:
        """(questions by group and slice, rows by group and slice) of groups of (question cells, {data cell: least distance})."""
        spark, parts, sent, g = self.data.sparkSession, [], [], 0
        for cells, need in groups:
            if not need:
                continue
            slices = max(1, -(-sum(sizes[j] for j in need) // ROWS_PER_SLICE))
            split = max(1, -(-sum(asked[c] for c in cells) // QUERIES_PER_GROUP))
            for part in range(split):
                parts += [(c, split, part, g, slices) for c in cells]
                sent += [(j, float(d), g, slices) for j, d in need.items()]
                g += 1
        to_group = spark.createDataFrame(parts, "cell int, split int, part int, g int, slices int")
        to_send = spark.createDataFrame(sent, "cell int, least double, g int, slices int")
        if len(parts) + len(sent) <= BROADCAST_ROWS:
            to_group, to_send = F.broadcast(to_group), F.broadcast(to_send)
        left = (
            self.queries.join(to_group, "cell")
            .where(F.pmod(F.xxhash64(F.lit(1), "vec_id"), F.col("split")) == F.col("part"))
            .select("g", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("slice"), "vec_id", "embedding", "cell")
        )
        # By row, not by id, so that the rows of one id share no slice.
        salted = self.data.withColumn("salt", F.monotonically_increasing_id()).join(to_send, "cell").where("dist >= least")
        slice_ = F.pmod(F.xxhash64(F.lit(2), "vec_id", "salt"), F.col("slices")).cast("int")
        return left, salted.select("g", slice_.alias("slice"), "vec_id", "embedding", "cell")

    def solved(self, left: DataFrame, right: DataFrame, home: dict[int, list[int]] | None = None) -> DataFrame:
        return left.groupBy("g", "slice").cogroup(right.groupBy("g", "slice")).applyInArrow(_solver(self.scale, self.k, home), "query_id long, vec_id long, score long")


def best_rows(won: DataFrame, k: int) -> DataFrame:
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return won.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def passes(vectors: DataFrame, is_query: Column, k: int = 10, scale: int = 1024):
    """Yields (the join, questions, rows, None) of the first pass; expects its winners; yields the same of the second, with the cells that met. Nothing without rows and questions."""
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    valid = vectors.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).where(~bad).select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>"), is_query.alias("asks"))
    n = valid.count()
    most = min(MAX_PIVOTS, max(16, math.isqrt(n // ROWS_PER_PIVOT)))
    chosen = valid.select("vec_id", "embedding").orderBy(F.xxhash64(F.lit(5), "vec_id"), "vec_id").limit(LOOKED_AT * most).collect()
    if not chosen:
        return
    pivots = _spread(np.unique(_matrix(pa.array([r.embedding for r in chosen], pa.list_(pa.float64())), scale), axis=0), most)
    schema = "vec_id long, embedding array<double>, cell int, dist double, norm double"
    data = valid.select("vec_id", "embedding").mapInArrow(_assigner(pivots, scale), schema)
    once = valid.where("asks").groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    queries = common.cut(once.mapInArrow(_assigner(pivots, scale), schema).drop("dist"))
    asked = {r.cell: r["count"] for r in queries.groupBy("cell").count().collect()}
    if not asked:
        return
    stats = {r.cell: r for r in data.groupBy("cell").agg(F.count("*").alias("n"), F.max("dist").alias("far")).collect()}
    sizes, far = {c: r.n for c, r in stats.items()}, np.full(len(pivots), -np.inf)
    far[list(stats)] = [r.far for r in stats.values()]
    product, square = pivots @ pivots.T, (pivots**2).sum(1)
    apart = square[:, None] - 2 * product + square
    home: dict[int, list[int]] = {}
    for c in asked:
        order = [j for j in np.argsort(-product[c], kind="stable").tolist() if j in sizes]
        enough = np.searchsorted(np.cumsum([sizes[j] for j in order]), k + 1) + 1
        home[c] = order[:enough]

    join = Join(queries, data, k, scale)
    won = yield join, *join.pass_over([([c], dict.fromkeys(h, -np.inf)) for c, h in sorted(home.items())], asked, sizes), None
    level = won.groupBy(F.col("query_id").alias("vec_id")).agg(F.when(F.count("*") == k, F.min("score")).cast("double").alias("level"))
    bounded = queries.join(level, "vec_id", "left").select("embedding", "cell", "norm", F.coalesce("level", F.lit(float("-inf"))).alias("level"))
    least: dict[int, dict[int, float]] = {}
    for r in bounded.mapInArrow(_needs(pivots, home, far, scale), "c int, cell int, least double").groupBy("c", "cell").agg(F.min("least").alias("least")).collect():
        least.setdefault(r.c, {})[r.cell] = r.least
    chain, rest = [], set(asked)
    while rest:  # each question cell next to the one before
        chain.append(min(rest, key=lambda c: (apart[chain[-1], c] if chain else 0, c)))
        rest.discard(chain[-1])
    yield join, *join.pass_over(_groups(least, asked, sizes, chain), asked, sizes), home


def knn_join(vectors: DataFrame, is_query: Column, k: int = 10, scale: int = 1024) -> DataFrame:
    """query_id, rank, vec_id, score over vectors (vec_id, embedding)."""
    steps = passes(vectors, is_query, k, scale)
    first = next(steps, None)
    if first is None:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    join, left, right, home = first
    won = common.cut(best_rows(join.solved(left, right, home), k).drop("rank"))
    join, left, right, home = steps.send(won)
    return best_rows(won.unionByName(join.solved(left, right, home)), k)


def sent_share(vectors: DataFrame, is_query: Column, k: int = 10, scale: int = 1024) -> float:
    """The share of all (question, row) pairs that the two passes compare."""
    steps = passes(vectors, is_query, k, scale)
    join, left, right, home = next(steps)

    def compared(left: DataFrame, right: DataFrame) -> int:
        both = left.groupBy("g", "slice").count().join(right.groupBy("g", "slice").agg(F.count("*").alias("rows")), ["g", "slice"])
        return both.agg(F.coalesce(F.sum(F.col("count") * F.col("rows")), F.lit(0))).first()[0]

    pairs = compared(left, right)
    join, left, right, home = steps.send(common.cut(best_rows(join.solved(left, right, home), k).drop("rank")))
    return (pairs + compared(left, right)) / (join.queries.count() * join.data.count())


def op1_knn_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best rows of every hundredth vector."""
    return knn_join(common.table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


ORACLE = """
WITH v AS (
  SELECT vec_id, embedding AS raw, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
q AS (SELECT vec_id, arg_min(e, raw) AS e FROM v WHERE vec_id % 100 = 0 GROUP BY vec_id),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score
  FROM q JOIN v c ON q.vec_id <> c.vec_id),
r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score FROM s)
SELECT * FROM r WHERE rank <= 10
"""
