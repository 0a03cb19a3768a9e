import math
import random

import numpy as np

from corpusmill.llm import multiprobe

SCHEMA = "vec_id long, embedding array<float>, dim string, v string"


def frame(spark, rows, parts=4):
    return spark.createDataFrame([(i, v, "", "") for i, v in rows], SCHEMA).repartition(parts)


def brute(rows, asks, k):
    good = {(i, tuple(np.float32(x).item() for x in v)) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v) and any(v)}
    queries = {}
    for i, v in good:
        if asks(i):
            queries[i] = min(queries.get(i, v), v, key=lambda x: (len(x), x))
    out = {}
    for i, q in queries.items():
        found = sorted((math.dist(q, v), c) for c, v in good if c != i and len(v) == len(q))
        out[i] = found[:k]
    return out


def told(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r.rank)):
        found = out.setdefault(r.query_id, [])
        assert r.rank == len(found) + 1
        found.append((r.score, r.vec_id))
    return out


def same(got, want):
    want = {q: f for q, f in want.items() if f}
    assert got.keys() == want.keys()
    for q in got:
        assert [c for _, c in got[q]] == [c for _, c in want[q]]
        assert np.allclose([d for d, _ in got[q]], [d for d, _ in want[q]], rtol=1e-12)


def test_against_brute_force(spark, monkeypatch):
    """With everything in one bucket: copies, repeated ids, other dimensions and vectors that take no part."""
    monkeypatch.setattr(multiprobe, "fit", lambda *a: multiprobe.Plan())
    rnd = random.Random(2)
    rows = [(i, [rnd.gauss(0, 1) for _ in range(5)]) for i in range(300)]
    rows += [(i, rows[10][1]) for i in range(300, 360)] + [(10, rows[10][1]), (10, rows[10][1]), (20, rows[11][1])]
    rows += [(400, None), (410, [0.0] * 5), (420, [1.0, None, 0.0, 0.0, 0.0]), (430, [float("nan")] * 5), (440, [float("inf")] * 5), (None, [1.0] * 5)]
    rows += [(450, [1.0, 2.0]), (451, [1.0, 2.5]), (460, [7.0])]
    df = frame(spark, rows)
    same(told(multiprobe.nearest(df, df.filter("vec_id % 10 = 0"), 10)), brute(rows, lambda i: i % 10 == 0, 10))


def test_tiles_and_hashing(spark, monkeypatch):
    """Crowded slots in tiles give what one tile does, by every plan; with all buckets looked into nothing is lost."""
    rnd = random.Random(3)
    centres = [[rnd.gauss(0, 4) for _ in range(6)] for _ in range(20)]
    rows = [(i, [x + rnd.gauss(0, 0.3) for x in rnd.choice(centres)]) for i in range(900)]
    want = brute(rows, lambda i: i % 9 == 0, 5)
    df = frame(spark, rows)
    monkeypatch.setattr(multiprobe, "ROWS", 128)
    monkeypatch.setattr(multiprobe, "QUERIES", 32)
    same(told(multiprobe._search(multiprobe.sound(df), multiprobe.sound(df.filter("vec_id % 9 = 0")), {6: multiprobe.Plan()}, 5)), want)
    plan = multiprobe.Plan(2, 4, 6.0, 81, 5)
    got = told(multiprobe._search(multiprobe.sound(df), multiprobe.sound(df.filter("vec_id % 9 = 0")), {6: plan}, 5))
    hit = sum(len({c for _, c in got[q]} & {c for _, c in want[q]}) for q in want)
    assert hit >= 0.95 * 5 * len(want)
    assert all(found == sorted(found) for found in got.values())
    # the whole way: fitted, and queries that find too few are compared with everything
    got = told(multiprobe.nearest(df, df.filter("vec_id % 9 = 0"), 5))
    assert sum(len({c for _, c in got[q]} & {c for _, c in want[q]}) for q in want) >= 0.9 * 5 * len(want)
    few = multiprobe.Plan(1, 16, 0.5, 1, 7)
    monkeypatch.setattr(multiprobe, "fit", lambda *a: few)
    assert all(len(x) == 5 for x in told(multiprobe.nearest(df, df.filter("vec_id % 9 = 0"), 5)).values())


def test_sequence_is_in_order_of_expected_score():
    m = 3
    z = [j * (j + 1) / (4 * (m + 1) * (m + 2)) for j in range(1, m + 1)]
    z += [1 - (2 * m + 1 - j) / (m + 1) + (2 * m + 1 - j) * (2 * m + 2 - j) / (4 * (m + 1) * (m + 2)) for j in range(m + 1, 2 * m + 1)]
    rows = [r for r in np.ndindex(*[2] * (2 * m)) if not any(r[j] and r[2 * m - 1 - j] for j in range(m))]
    got = multiprobe.sequence(m, 1000)
    assert sorted(map(tuple, got.tolist())) == sorted(rows)
    scores = [sum(z[j] for j in range(2 * m) if r[j]) for r in got]
    assert scores == sorted(scores)


def test_probes_hold_neighbouring_cells():
    plan = multiprobe.Plan(1, 3, 2.0, 27, 1)
    hashing = multiprobe.Hashing(4, plan)
    x = np.random.default_rng(1).standard_normal((50, 4))
    f = x @ hashing.a[0].T + hashing.b[0]
    for shift in np.ndindex(3, 3, 3):
        moved = np.floor(f) + np.array(shift) - 1
        key = (moved.astype(np.int64).astype(np.uint64) * hashing.factor[0]).sum(1, dtype=np.uint64) + hashing.salt[0]
        assert (hashing.probes(x, 0) == multiprobe.mix(key).view(np.int64)[:, None]).any(1).all()
    assert (hashing.probes(x, 0)[:, 0] == hashing.buckets(x, 0)).all()


def test_fitted_plan_reaches_its_recall():
    rng = np.random.default_rng(4)
    x = rng.standard_normal((60, 16))[rng.integers(0, 60, 4096)] * 3 + rng.standard_normal((4096, 16)) * 0.2
    plan = multiprobe.fit(x, 10**7, 10)
    assert plan.tables and plan.probes < multiprobe.PROBES


def test_few_vectors(spark):
    rows = [(i, [float(i), 1.0]) for i in range(15)]
    df = frame(spark, rows, 2)
    got = told(multiprobe.nearest(df, df, 10))
    assert all(len(x) == 10 for x in got.values())
    pair = frame(spark, rows[:2], 1)
    assert {q: [c for _, c in x] for q, x in told(multiprobe.nearest(pair, pair, 10)).items()} == {0: [1], 1: [0]}


def test_empty(spark):
    df = frame(spark, [], 1)
    assert multiprobe.nearest(df, df).count() == 0
    one = frame(spark, [(0, [1.0, 2.0])], 1)
    assert multiprobe.nearest(one, one).count() == 0
    assert multiprobe.nearest(one, df).count() == 0
