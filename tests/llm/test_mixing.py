import random

from corpusmill.llm import mixing


def targets(sizes, weights, share, most):
    """Dealing in rounds, as the contract words it."""
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    left, out, live = share * sum(sizes.values()), {}, set(order)
    while live:
        full = [s for s in live if w[s] * left / sum(w[x] for x in live) >= most * sizes[s]]
        if not full:
            total = sum(w[x] for x in live)
            out |= {s: w[s] * left / total for s in live}
            break
        for s in full:
            out[s] = most * sizes[s]
        left -= sum(out[s] for s in full)
        live -= set(full)
    return out


def make(n=600):
    rnd = random.Random(9)
    names = ["b", "a", "Z", "é", "hot", None, "empty"]
    rows = []
    for i in range(n):
        source = rnd.choices(names, [1, 2, 3, 1, 9, 2, 1])[0]
        rows.append((i, None if source == "empty" else "w " * rnd.choice([0, 1, 5, 40]), source, 1))
    return [*rows, (7, rows[7][1], rows[7][2], 1), (None, "one two", "a", 1), (n, "w\x0b" * 3000, "Z", 1)]


def test_targets_and_what_is_taken(spark):
    rows = make()
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, size int")
    got = mixing.mix_sources(df).collect()
    assert len(got) == len(rows)
    sizes, taken = {}, {}
    for _, text, source, _ in rows:
        sizes[source] = sizes.get(source, 0) + len((text or "").split())
    want = targets(sizes, [5.0, 2.0, 1.0], 1.5, 2.0)
    for r in got:
        assert r.taken in (0, r.size, 2 * r.size) and r.source_size == sizes[r.source]
        assert abs(r.target - want[r.source]) < 1e-6 * max(1, r.target)
        taken[r.source] = taken.get(r.source, 0) + r.taken
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 3000
    assert sum(taken.values()) <= 1.5 * sum(sizes.values())
    again = mixing.mix_sources(df.repartition(5)).collect()
    key = lambda r: (r.doc_id if r.doc_id is not None else -1, r.size, r.taken)
    assert sorted(map(key, got)) == sorted(map(key, again))


def test_empty_and_wordless(spark):
    schema = "doc_id long, text string, source string"
    assert mixing.mix_sources(spark.createDataFrame([], schema)).count() == 0
    r = mixing.mix_sources(spark.createDataFrame([(1, "", "a")], schema)).first()
    assert (r.size, r.source_size, r.target, r.taken) == (0, 0, 0.0, 0)
