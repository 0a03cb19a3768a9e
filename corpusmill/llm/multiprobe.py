"""Approximate nearest neighbours: multiprobe p-stable hashing, then exact distances.

A table has M functions floor((a . x + b) / w) with normal a; vectors of equal cells share a bucket. A query
looks into its own bucket and into those whose cells differ by one where it lies near their
border: perturbations are visited in the order of the squared distances to the borders that they cross, as expected
for the query's borders sorted by distance, so one sequence serves all queries. What the tables find
is merged and ranked by exact distance.

Tables, functions, width and number of probes are fitted for each dimension on at most ``SAMPLE``
vectors, of which ``ASKED`` ask for their neighbours among the sample: of the settings that find ``RECALL`` of
these the one with the least expected work is taken, comparing everything among them. Neighbours in all
vectors are nearer than in a sample, so the recall there is rather higher.

Buckets are gathered in slots of about ``ROWS`` vectors by hash. Each slot's vectors and queries are
counted, and one with more than ``ROWS`` or ``QUERIES`` of them is cut into tiles, so a task holds no more
than one tile at a time, however large a bucket is. A query with fewer than k vectors in its buckets is compared with everything.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.llm.shared import cut, scratch
from corpusmill.llm.topk import matrix
from corpusmill.llm.words import mix, tidy

SAMPLE, ASKED, RECALL = 4096, 128, 0.96
ROWS, QUERIES = 4096, 4096
#: Settings that are tried: tables, functions of a table, widths as multiples of the sample's median distance to its neighbours, probes at most.
TABLES, FUNCTIONS, WIDTHS, PROBES = (1, 2, 4), (2, 4, 6, 8, 12, 16), (1.0, 2.0, 4.0), 256
#: Comparisons that a probe, and that hashing a vector into a table, cost as much as.
PROBE_COST, TABLE_COST = 64, 1000
#: Pairs a task holds before it keeps each query's best.
PAIRS = 1 << 18


@dataclass(frozen=True)
class Plan:
    """How the vectors of one dimension are hashed. Without tables everything is one bucket, which only the queries get that found too few."""

    tables: int = 0
    functions: int = 0
    width: float = 1.0
    probes: int = 1
    slots: int = 1


def sequence(functions: int, number: int) -> np.ndarray:
    """The first perturbations by expected score: rows of 0 and 1 over the 2M borders, sorted by distance; the first crosses none.

    The j-th nearest of 2M borders and the (2M + 1 - j)-th are the two of one cell, so never both are crossed.
    """
    m, both = functions, 2 * functions
    near = [j * (j + 1) / (4 * (m + 1) * (m + 2)) for j in range(1, m + 1)]
    far = [1 - (both + 1 - j) / (m + 1) + (both + 1 - j) * (both + 2 - j) / (4 * (m + 1) * (m + 2)) for j in range(m + 1, both + 1)]
    z = near + far
    out, heap = [np.zeros(both, np.int64)], [(z[0], (0,))] if m else []
    while heap and len(out) < number:
        score, chosen = heapq.heappop(heap)
        last = chosen[-1]
        if not any(both - 1 - j in chosen for j in chosen):
            row = np.zeros(both, np.int64)
            row[list(chosen)] = 1
            out.append(row)
        if last + 1 < both:
            heapq.heappush(heap, (score + z[last + 1], (*chosen, last + 1)))
            heapq.heappush(heap, (score - z[last] + z[last + 1], (*chosen[:-1], last + 1)))
    return np.array(out)


class Hashing:
    """The functions of a plan for one dimension, the same in every task."""

    def __init__(self, dim: int, plan: Plan):
        rng = np.random.default_rng([13, dim, plan.functions])
        shape = (max(plan.tables, 1), plan.functions)
        self.plan = plan
        self.a = rng.standard_normal((*shape, dim)) / plan.width
        self.b = rng.random(shape)
        self.salt = mix(rng.integers(1, 1 << 62, shape[0]).astype(np.uint64))
        self.factor = mix(rng.integers(1, 1 << 62, shape).astype(np.uint64)) | np.uint64(1)
        self.sets = sequence(plan.functions, plan.probes).astype(np.uint64)

    def _cells(self, x: np.ndarray, table: int) -> tuple[np.ndarray, np.ndarray]:
        f = np.clip(x @ self.a[table].T + self.b[table], -(2.0**62), 2.0**62)
        cell = np.floor(f)
        key = (cell.astype(np.int64).astype(np.uint64) * self.factor[table]).sum(1, dtype=np.uint64) + self.salt[table]
        return key, f - cell

    def buckets(self, x: np.ndarray, table: int) -> np.ndarray:
        return mix(self._cells(x, table)[0]).view(np.int64)

    def probes(self, x: np.ndarray, table: int) -> np.ndarray:
        """(queries, probes): the buckets to look into, likeliest first."""
        key, inside = self._cells(x, table)
        m = self.plan.functions
        order = np.argsort(np.concatenate([inside, 1 - inside], axis=1), axis=1, kind="stable")
        step = np.concatenate([np.negative(self.factor[table]), self.factor[table]])[order] if m else np.zeros((len(x), 0), np.uint64)
        return mix(key[:, None] + step @ self.sets.T).view(np.int64)


def fit(x: np.ndarray, total: int, k: int) -> Plan:
    """The cheapest plan that finds ``RECALL`` of the k nearest within the sample ``x``, for ``total`` vectors."""
    n, dim = x.shape
    asked = min(ASKED, n // 4)
    if asked < k or n <= k + 1:  # too few to fit on: wide cells, all neighbours
        return Plan(1, 2, 4 * max(float(np.sqrt((x * x).sum(1)).max()), 1e-300), 9)
    q = x[:asked]
    d = (q * q).sum(1)[:, None] + (x * x).sum(1) - 2 * (q @ x.T)
    d[np.arange(asked), np.arange(asked)] = np.inf
    near = np.argpartition(d, k, axis=1)[:, :k]
    reach = float(np.sqrt(max(np.median(np.take_along_axis(d, near, 1).max(1)), 1e-300)))
    best, cost = Plan(1, 2, 4 * reach, 9), np.inf
    for functions in FUNCTIONS:
        for width in WIDTHS:
            plan = Plan(max(TABLES), functions, width * reach, PROBES)
            hashing = Hashing(dim, plan)
            first = np.full((asked, k), PROBES)  # the probe that finds each neighbour
            looked = np.zeros(PROBES)
            for table in range(plan.tables):
                have, want = hashing.buckets(x, table), hashing.probes(q, table)
                hit = want[:, :, None] == have[near][:, None, :]
                first = np.minimum(first, np.where(hit.any(1), hit.argmax(1), PROBES))
                held = np.sort(have)
                found = (np.searchsorted(held, want, "right") - np.searchsorted(held, want)).mean(0)
                looked[: len(found)] += found
                if table + 1 not in TABLES:
                    continue
                ranks = np.sort(first, axis=None)
                probes = int(ranks[int(np.ceil(RECALL * len(ranks))) - 1]) + 1
                if probes <= want.shape[1]:
                    now = looked[:probes].sum() / n * total + (PROBE_COST * probes + TABLE_COST) * (table + 1)
                    if now < cost:
                        best, cost = Plan(table + 1, functions, width * reach, probes), now
    return best


def sound(vectors: DataFrame) -> DataFrame:
    """(vec_id, dim, v) of vectors that hold no null and only finite numbers, some of them not zero."""
    kind = dict(vectors.dtypes)["embedding"]
    kind = kind if kind in ("array<float>", "array<double>") else "array<double>"
    whole = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    kept = vectors.filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).filter(whole & F.exists("embedding", lambda x: x != 0))
    return kept.select(F.col("vec_id").cast("long").alias("vec_id"), F.size("embedding").alias("dim"), F.col("embedding").cast(kind).alias("v"))


def _by_dim(batch: pa.RecordBatch):
    dims = batch.column("dim").to_numpy()
    for dim in np.unique(dims).tolist():
        part = batch.filter(pa.array(dims == dim))
        yield dim, part, matrix(part.column("v"), dim).astype(np.float64)


def _placed(plans: dict[int, Plan], bare: bool):
    """Vectors to (dim, slot, bucket, vec_id, v), once for each table; ``bare`` leaves the last three out."""

    def run(batches):
        made = {dim: Hashing(dim, plan) for dim, plan in plans.items()}
        for batch in batches:
            for dim, part, x in _by_dim(batch):
                for table in range(max(made[dim].plan.tables, 1)):
                    bucket = made[dim].buckets(x, table)
                    slot = (bucket.view(np.uint64) % np.uint64(made[dim].plan.slots)).astype(np.int64)
                    cols = [part.column("dim"), pa.array(slot)]
                    names = ["dim", "slot"]
                    if not bare:
                        cols += [pa.array(bucket), part.column("vec_id"), part.column("v")]
                        names += ["bucket", "vec_id", "v"]
                    yield pa.RecordBatch.from_arrays(cols, names)

    return tidy(run)


def _asked(plans: dict[int, Plan], bare: bool):
    """Queries to (dim, slot, buckets, query_id, v), once for each slot that they look into."""

    def run(batches):
        made = {dim: Hashing(dim, plan) for dim, plan in plans.items()}
        for batch in batches:
            for dim, part, x in _by_dim(batch):
                if dim not in made:
                    continue
                step = max(1, (1 << 20) // made[dim].plan.probes)
                for at in range(0, len(x), step):
                    some = part.slice(at, step)
                    wanted = [made[dim].probes(x[at : at + step], t) for t in range(max(made[dim].plan.tables, 1))]
                    bucket = np.concatenate(wanted, axis=1)
                    row = np.repeat(np.arange(len(bucket)), bucket.shape[1])
                    bucket = bucket.ravel()
                    slot = (bucket.view(np.uint64) % np.uint64(made[dim].plan.slots)).astype(np.int64)
                    order = np.lexsort((slot, row))
                    row, slot, bucket = row[order], slot[order], bucket[order]
                    head = np.flatnonzero(np.append(True, (row[1:] != row[:-1]) | (slot[1:] != slot[:-1])))
                    rows = some.take(pa.array(row[head]))
                    cols, names = [rows.column("dim"), pa.array(slot[head])], ["dim", "slot"]
                    if not bare:
                        lists = pa.ListArray.from_arrays(pa.array(np.append(head, len(row)).astype(np.int32)), pa.array(bucket))
                        cols += [lists, rows.column("vec_id"), rows.column("v")]
                        names += ["buckets", "query_id", "v"]
                    yield pa.RecordBatch.from_arrays(cols, names)

    return tidy(run)


class _Nearest:
    """Each query's k nearest of the pairs so far, ties to the smaller id."""

    def __init__(self, q: np.ndarray, x: np.ndarray, ids: np.ndarray, k: int):
        self.q, self.x, self.ids, self.k = q, x, ids, k
        self.limit = np.full(len(q), np.inf)
        self.held, self.count = [], 0

    def add(self, which: np.ndarray, row: np.ndarray) -> None:
        for at in range(0, len(which), 1 << 14):
            w, r = which[at : at + (1 << 14)], row[at : at + (1 << 14)]
            gap = self.x[r] - self.q[w]
            d = np.sqrt((gap * gap).sum(1))
            keep = d <= self.limit[w]
            self.held.append((w[keep], r[keep], d[keep]))
            self.count += int(keep.sum())
            if self.count > PAIRS:
                self.best()

    def best(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if not self.held:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        w, r, d = (np.concatenate(x) for x in zip(*self.held, strict=True))
        order = np.lexsort((self.ids[r], d, w))
        w, r, d = w[order], r[order], d[order]
        new = np.append(True, (w[1:] != w[:-1]) | (r[1:] != r[:-1]))[: len(w)]  # one row by several buckets or tables
        w, r, d = w[new], r[new], d[new]
        first = np.flatnonzero(np.append(True, w[1:] != w[:-1])[: len(w)])
        place = np.arange(len(w)) - np.repeat(first, np.diff(np.append(first, len(w))))
        full = place == self.k - 1
        self.limit[w[full]] = d[full]
        keep = place < self.k
        self.held, self.count = [(w[keep], r[keep], d[keep])], int(keep.sum())
        return self.held[0]


def _compare(k: int):
    """A tile's vectors and queries to (query_id, vec_id, score): each query's k nearest in the buckets that it looks into."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        names = ["query_id", "vec_id", "score"]
        empty = pa.table([pa.array([], pa.int64()), pa.array([], pa.int64()), pa.array([], pa.float64())], names)
        if not left.num_rows or not right.num_rows:
            return empty
        dim = left.column("dim")[0].as_py()
        bucket = left.column("bucket").to_numpy()
        order = np.argsort(bucket, kind="stable")
        bucket, ids = bucket[order], left.column("vec_id").to_numpy()[order]
        x = matrix(left.column("v"), dim).astype(np.float64)[order]
        q, asking = matrix(right.column("v"), dim).astype(np.float64), right.column("query_id").to_numpy()
        wanted = right.column("buckets").combine_chunks()
        who = np.repeat(np.arange(len(q)), np.diff(wanted.offsets.to_numpy()))
        wants = wanted.flatten().to_numpy()
        by = np.argsort(wants, kind="stable")
        who, wants = who[by], wants[by]
        xx, qq = (x * x).sum(1), (q * q).sum(1)
        best = _Nearest(q, x, ids, k)
        head = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
        for a, b in zip(head.tolist(), [*head[1:].tolist(), len(bucket)], strict=True):
            lo, hi = np.searchsorted(wants, bucket[a]), np.searchsorted(wants, bucket[a], "right")
            for at in range(lo, hi, 256):
                some = np.unique(who[at : min(at + 256, hi)])
                near = qq[some, None] + xx[a:b] - 2 * (q[some] @ x[a:b].T)
                slack = 1e-9 * (qq[some, None] + xx[a:b]) + 1e-300
                near[asking[some][:, None] == ids[a:b]] = np.inf
                most = best.limit[some] ** 2
                if b - a > k:
                    most = np.minimum(most, np.partition(near, k - 1, axis=1)[:, k - 1])
                w, r = np.nonzero((near <= most[:, None] + 2 * slack) & (near < np.inf))
                best.add(some[w], a + r)
        w, r, d = best.best()
        return pa.table([pa.array(asking[w]), pa.array(ids[r]), pa.array(d)], names)

    return run


def _pieces(index: DataFrame, asked: DataFrame) -> DataFrame:
    """(dim, slot, rows, asks): into how many parts the vectors and queries of a crowded slot are cut; others aren't listed."""
    have, want = index.groupBy("dim", "slot").agg(F.count("*").alias("_r")), asked.groupBy("dim", "slot").agg(F.count("*").alias("_q"))
    both = have.join(want, ["dim", "slot"]).select("dim", "slot", F.ceil(F.col("_r") / ROWS).cast("int").alias("rows"), F.ceil(F.col("_q") / QUERIES).cast("int").alias("asks"))
    return both.filter("rows > 1 or asks > 1")


def _search(vectors: DataFrame, queries: DataFrame, plans: dict[int, Plan], k: int) -> DataFrame:
    kind = dict(vectors.dtypes)["v"]
    crowded = cut(_pieces(vectors.mapInArrow(_placed(plans, True), "dim int, slot long"), queries.mapInArrow(_asked(plans, True), "dim int, slot long")))
    parts = lambda c: F.coalesce(F.col(c), F.lit(1))
    part = lambda c, of: F.pmod(F.xxhash64(c), parts(of)).cast("int")
    every = lambda of: F.explode(F.sequence(F.lit(0), parts(of) - 1))
    index = vectors.mapInArrow(_placed(plans, False), f"dim int, slot long, bucket long, vec_id long, v {kind}").join(crowded, ["dim", "slot"], "left")
    index = index.select("dim", "slot", part("vec_id", "rows").alias("i"), every("asks").alias("j"), "bucket", "vec_id", "v")
    asked = queries.mapInArrow(_asked(plans, False), f"dim int, slot long, buckets array<long>, query_id long, v {kind}").join(crowded, ["dim", "slot"], "left")
    asked = asked.select("dim", "slot", every("rows").alias("i"), part("query_id", "asks").alias("j"), "buckets", "query_id", "v")
    tile = ["dim", "slot", "i", "j"]
    found = index.groupby(*tile).cogroup(asked.groupby(*tile)).applyInArrow(_compare(k), "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.distinct().withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, rank, vec_id, score): for each query the ``k`` nearest that are found among vectors of other vec_id, by Euclidean distance.

    ``vectors`` and ``queries`` have vec_id and embedding. Distances are exact, in double precision; ties go to the smaller
    vec_id. All candidates come back where there are fewer than ``k``. Vectors that are null or zero or hold a null or a number that
    isn't finite take no part, nor do null ids, and only vectors of the query's dimension are compared. Of copies of one vector the k + 1 of smallest vec_id
    are kept, as no query can have more; rows that repeat vec_id and vector are one. Of queries that repeat a vec_id
    that of the smallest vector is asked. Other columns are left out. Empty tables give an empty result.
    """
    spark = vectors.sparkSession
    with scratch(spark):
        some = sound(vectors).distinct().withColumn("_h", F.xxhash64("v"))
        copies = Window.partitionBy("dim", "_h", "v").orderBy("vec_id")
        some = cut(some.withColumn("_n", F.row_number().over(copies)).filter(F.col("_n") <= k + 1).select("vec_id", "dim", "v", "_h"))
        asked = cut(sound(queries).groupBy("vec_id").agg(F.min(F.struct("dim", "v")).alias("m")).select("vec_id", "m.dim", "m.v"))
        if asked.isEmpty() or some.isEmpty():
            return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
        total = dict(some.groupBy("dim").count().collect())
        by_hash = Window.partitionBy("dim").orderBy("_h", "vec_id")
        rows = some.withColumn("_n", F.row_number().over(by_hash)).filter(F.col("_n") <= SAMPLE).select("dim", "v").collect()
        plans = {}
        for dim, n in total.items():
            plan = fit(np.array([r.v for r in rows if r.dim == dim], np.float64), n, k)
            plans[dim] = Plan(plan.tables, plan.functions, plan.width, plan.probes, max(1, -(-n * max(plan.tables, 1) // ROWS)))
        some = some.select("vec_id", "dim", "v")
        found = cut(_search(some, asked, plans, k), stay=True)
        hashed = {dim: Plan() for dim, plan in plans.items() if plan.tables and total[dim] > 1}
        full = found.filter(F.col("rank") == k).select(F.col("query_id").alias("vec_id"))
        short = cut(asked.filter(F.col("dim").isin(*hashed)).join(full, "vec_id", "left_anti"))
        if short.isEmpty():
            return found
        rest = cut(_search(some.filter(F.col("dim").isin(*hashed)), short, hashed, k), stay=True)
    return found.join(rest.select("query_id").distinct(), "query_id", "left_anti").union(rest)
