"""Exact top-k inner products over a pivot-distance index.

Vectors are keyed by their nearest pivot and their distance to it and sorted by that key, so
a block of neighbouring rows is a piece of an annulus around one pivot. For a query q and a
block with distances from r0 to r1, the triangle inequality gives every vector x of it
|q - x| >= max(d(q, pivot) - r1, r0 - d(q, pivot), 0), and with the block's largest norm an
upper bound of q . x = (|q|^2 + |x|^2 - |q - x|^2) / 2. Blocks are taken in order of their
bound and the search stops when no bound left reaches the k-th best score of any query.

Queries come in blocks of at most ``QUERIES`` that are broadcast one after the other, so the
broadcast is bounded whatever their number; each pass goes over the whole index. Components
are whole numbers, so scores are exact in double precision where the product of two norms is
under 2 ** 53; larger ones are taken with Python's whole numbers. Bounds have slack to spare.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.llm.shared import cut, partitions

#: Pivots for each dimension, rows of a block, queries of a broadcast (times 64 doubles: 32 MB).
PIVOTS, BLOCK, QUERIES = 64, 512, 1 << 16
#: Queries multiplied with a block at a time.
STRIP = 256


def quantised(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", scale: float = 256.0) -> DataFrame:
    """(vec_id, dim, v) with v = floor(scale * component); rows with nulls or numbers that aren't finite are left out.

    Empty vectors stay, with dimension 0; all their scores are 0.
    """
    v = F.transform(F.col(vec_col), lambda x: F.floor(x.cast("double") * F.lit(float(scale))).cast("double"))
    sound = F.forall(F.col(vec_col), lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    kept = vectors.filter(F.col(id_col).isNotNull() & F.col(vec_col).isNotNull()).filter(sound)
    return kept.select(F.col(id_col).cast("long").alias("vec_id"), F.size(vec_col).alias("dim"), v.alias("v"))


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), dim)


def pivots(vectors: DataFrame, number: int = PIVOTS) -> dict[int, np.ndarray]:
    """For each dimension the ``number`` distinct vectors of smallest hash: any vectors give exact results."""
    order = Window.partitionBy("dim").orderBy("_h", "v")
    some = vectors.select("dim", "v", F.xxhash64("v").alias("_h")).withColumn("_n", F.dense_rank().over(order)).filter(F.col("_n") <= number)
    out: dict[int, list] = {}
    for r in some.select("dim", "v").distinct().collect():
        out.setdefault(r.dim, []).append(r.v)
    return {d: np.array(sorted(v), np.float64).reshape(len(v), d) for d, v in out.items()}


def _distances(x: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Euclidean distances of rows of x to rows of p."""
    return np.sqrt(np.maximum((x * x).sum(1)[:, None] + (p * p).sum(1) - 2 * (x @ p.T), 0))


def _keyed(table: dict[int, np.ndarray]):
    def run(batches):
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            for dim in np.unique(dims):
                part = batch.filter(pa.array(dims == dim))
                d = _distances(matrix(part.column("v"), int(dim)), table[int(dim)])
                near = d.argmin(1)
                cols = [part.column("vec_id"), part.column("dim"), part.column("v"), pa.array(near.astype(np.int32)), pa.array(d[np.arange(len(d)), near])]
                yield pa.RecordBatch.from_arrays(cols, ["vec_id", "dim", "v", "pivot", "dist"])

    return run


def index(vectors: DataFrame, table: dict[int, np.ndarray]) -> DataFrame:
    """(vec_id, dim, v, pivot, dist), in ranges of the key and sorted by it.

    vec_id is part of the key, so copies of one vector are spread over ranges too.
    """
    keyed = vectors.mapInArrow(_keyed(table), "vec_id long, dim int, v array<double>, pivot int, dist double")
    key = ["dim", "pivot", "dist", "vec_id"]
    return keyed.repartitionByRange(partitions(vectors.sparkSession), *key).sortWithinPartitions(*key)


def _products(q: np.ndarray, x: np.ndarray, squares: float) -> np.ndarray:
    """Inner products of rows of whole numbers, whose norms squared have the product ``squares`` at most; exact."""
    if squares < 2.0**105:
        return q @ x.T
    whole = lambda m: np.array([[int(v) for v in row] for row in m], object).reshape(m.shape)
    return whole(q) @ whole(x).T


def _search(ids: np.ndarray, queries: np.ndarray, floor: np.ndarray, centre: np.ndarray, k: int):
    """Index rows of one dimension to (query_id, vec_id, score): each query's k best of the partition, at least."""
    reach = _distances(queries, centre)
    norm = (queries * queries).sum(1)
    dim = queries.shape[1]

    def run(batches):
        best: list[list] = [[] for _ in ids]
        low = floor.copy()

        def work(rows: list[pa.RecordBatch]):
            part = pa.Table.from_batches(rows)
            pivot, dist = part.column("pivot").to_numpy(), part.column("dist").to_numpy()
            vec, x = part.column("vec_id").to_numpy(), matrix(part.column("v"), dim)
            edge = np.flatnonzero(np.append(True, pivot[1:] != pivot[:-1]))
            blocks = [(a, min(a + BLOCK, b)) for s, b in zip(edge, [*edge[1:], len(vec)], strict=True) for a in range(s, b, BLOCK)]
            a, b = np.array(blocks).T
            r0, r1, p = dist[a], dist[b - 1], pivot[a]
            big = np.maximum.reduceat((x * x).sum(1), a)
            for q0 in range(0, len(ids), STRIP):
                q = np.arange(q0, min(q0 + STRIP, len(ids)))
                d = reach[np.ix_(q, p)]
                gap = np.maximum(np.maximum(d - r1, r0 - d) - 1e-6, 0)
                bound = (norm[q, None] + big - gap * gap) / 2
                bound += np.maximum(np.abs(bound), norm[q, None] + big) * 1e-9 + 1e-3
                most = bound.max(0)
                for blk in np.argsort(-most, kind="stable").tolist():
                    if most[blk] < low[q].min():
                        break
                    live = q[bound[:, blk] >= low[q]]
                    if not len(live):
                        continue
                    own = vec[a[blk] : b[blk]]
                    score = _products(queries[live], x[a[blk] : b[blk]], norm[live].max() * big[blk])
                    score[ids[live][:, None] == own] = -np.inf
                    for row in np.flatnonzero((score >= low[live, None]).any(1)).tolist():
                        at, s = int(live[row]), score[row]
                        some = np.flatnonzero((s >= low[at]) & (s > -np.inf))
                        if len(some) > k:
                            some = some[sorted(range(len(some)), key=lambda c: (-s[some[c]], own[some[c]]))[:k]] if s.dtype == object else some[np.lexsort((own[some], -s[some]))[:k]]
                        heap = best[at]
                        for c in some.tolist():
                            item = (s[c], -own[c])
                            if len(heap) < k:
                                heapq.heappush(heap, item)
                            elif item > heap[0]:
                                heapq.heapreplace(heap, item)
                        if len(heap) == k:
                            low[at] = max(low[at], heap[0][0])

        rows, held = [], 0
        for batch in batches:
            rows.append(batch)
            held += batch.num_rows
            if held >= 1 << 14:
                work(rows)
                rows, held = [], 0
        if held:
            work(rows)
        out = [(int(ids[q]), -v, int(s)) for q, heap in enumerate(best) for s, v in heap]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], ["query_id", "vec_id", "score"])

    return run


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, number: int = PIVOTS) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's ``k`` largest integer inner products with other vectors.

    ``vectors`` and ``queries`` are ``quantised`` tables; a query's own vec_id is no
    candidate. Ties go to the smaller vec_id; where there are fewer than ``k`` candidates all
    come back. Only vectors of the query's dimension are compared. Every row is a candidate,
    so rows that repeat a vec_id count each; of queries that repeat one, that of the smallest
    components is asked. Scores past 64 bits are an error. Other columns are left out, so
    none can clash. Empty tables give an empty result.
    """
    spark = vectors.sparkSession
    vectors = vectors.select("vec_id", "dim", "v")
    queries = cut(queries.groupBy("vec_id").agg(F.min(F.struct("dim", "v")).alias("m")).select("vec_id", "m.dim", "m.v"))
    table = pivots(vectors, number)
    sorted_index = cut(index(vectors, table))
    sample = {}  # each query's k-th best among the pivots' rows is a score to start from
    for r in sorted_index.filter("dist = 0").groupBy("dim", "pivot").agg(F.min("vec_id").alias("vec_id")).collect():
        sample.setdefault(r.dim, []).append((r.pivot, r.vec_id))
    found = []
    for dim in sorted(table):
        mine = queries.filter(F.col("dim") == dim)
        total = mine.count()
        parts = -(-total // QUERIES)
        for part in range(parts):
            rows = mine if parts == 1 else mine.filter(F.pmod(F.xxhash64("vec_id"), F.lit(parts)) == part)
            got = sorted(rows.select("vec_id", "v").toLocalIterator(), key=lambda r: r.vec_id)
            if not got:
                continue
            ids, x = np.array([r.vec_id for r in got], np.int64), np.array([r.v for r in got], np.float64).reshape(len(got), dim)
            floor = np.full(len(ids), -np.inf)
            known = sample.get(dim, [])
            if len(known) > k:
                score = x @ table[dim][[p for p, _ in known]].T
                score -= np.abs(score) * 1e-9  # a lower bound where doubles round
                score[ids[:, None] == np.array([v for _, v in known])] = -np.inf
                floor = np.partition(score, len(known) - k, axis=1)[:, len(known) - k]
            some = sorted_index.filter(F.col("dim") == dim)
            found.append(some.mapInArrow(_search(ids, x, floor, table[dim], k), "query_id long, vec_id long, score long"))
    if not found:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    rows = found[0]
    for more in found[1:]:
        rows = rows.union(more)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
