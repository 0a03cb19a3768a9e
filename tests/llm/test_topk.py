import math
import random

from corpusmill.llm import topk

SCHEMA = "vec_id long, embedding array<float>, score string"


def brute(rows, k):
    good, every = {}, []
    for i, v, _ in rows:
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            q = [math.floor(256 * x) for x in v]
            good[i] = min(q, good.get(i, q))
            every.append((i, q))
    out = []
    for q, a in good.items():
        if q % 5 == 0:
            s = sorted((-sum(x * y for x, y in zip(a, b, strict=True)), i) for i, b in every if i != q and len(a) == len(b))
            out += [(q, r + 1, i, -t) for r, (t, i) in enumerate(s[:k])]
    return sorted(out)


def test_against_brute_force(spark, monkeypatch):
    rnd = random.Random(2)
    rows = [(i, [rnd.randint(-16, 16) / 16 for _ in range(6)], "x") for i in range(400)]
    rows += [(i, rows[5][1], "copy") for i in range(400, 480)]
    rows += [(500, None, None), (505, [1.0, None, 0.0, 0.0, 0.0, 0.0], ""), (510, [float("nan")] * 6, ""), (515, [float("inf")] * 6, ""), (None, [0.0] * 6, "")]
    rows += [(520, [0.5, 0.25], ""), (521, [0.5, -0.25], ""), (525, [], ""), (526, [], ""), (530, [100.0] * 6, ""), (535, rows[7][1], ""), (535, rows[7][1], "")]
    vectors = topk.quantised(spark.createDataFrame(rows, SCHEMA))
    for number, queries in ((3, 1 << 16), (64, 20)):
        monkeypatch.setattr(topk, "QUERIES", queries)
        got = topk.top_k(vectors, vectors.filter("vec_id % 5 = 0"), 5, number).collect()
        assert sorted(map(tuple, got)) == brute(rows, 5)


def test_empty(spark):
    vectors = topk.quantised(spark.createDataFrame([], SCHEMA))
    assert topk.top_k(vectors, vectors).count() == 0


def test_large_components_are_exact(spark):
    rnd = random.Random(3)
    rows = [(i, [float(rnd.randint(-(10**6), 10**6)) + rnd.random() for _ in range(4)], "x") for i in range(60)]
    vectors = topk.quantised(spark.createDataFrame(rows, "vec_id long, embedding array<double>, score string"))
    assert sorted(map(tuple, topk.top_k(vectors, vectors.filter("vec_id % 5 = 0"), 5).collect())) == brute(rows, 5)
