import random

import pytest

from corpusmill.operators import architecture, flow, jobs


def test_reaching_definitions_against_paths(spark):
    """Beside a search from every definition, over random graphs with loops."""
    rnd = random.Random(3)
    edges, defs, uses, want = [], [], [], set()
    for f in range(25):
        n = rnd.randint(1, 8)
        e = {(rnd.randint(0, n), rnd.randint(0, n)) for _ in range(rnd.randint(0, 2 * n))}
        d = {(rnd.randint(0, n), rnd.choice("xyz")) for _ in range(n)}
        u = {(rnd.randint(0, n), rnd.choice("xyz")) for _ in range(n)}
        for at, name in d:
            todo, seen = [t for s, t in e if s == at], set()
            while todo:
                node = todo.pop()
                if node not in seen:
                    seen.add(node)
                    if (node, name) not in d:
                        todo += [t for s, t in e if s == node]
            want |= {(f, name, at, node) for node in seen if (node, name) in u}
        edges += [(f, *x) for x in e]
        defs += [(f, *x) for x in d] * 2
        uses += [(f, *x) for x in u]
    frame = lambda rows, schema: spark.createDataFrame(rows, schema)
    got = flow.reaching_definitions(frame(edges, "function int, source int, target int"), frame(defs, "function int, node int, name string"), frame(uses, "function int, node int, name string"))
    assert sorted(map(tuple, got.collect())) == sorted(want)


SPECS, STATES = "capability string, depends_on array<string>", "capability string, state string"


def test_dependency_states(spark):
    specs = [("a", None), ("b", ["a"]), ("c", ["b", "x"]), ("x", []), ("d", ["c"]), ("e", ["gone"]), ("f", ["e", "b"]), ("p", ["q"]), ("q", ["p"]), ("r", ["q", "a"]), ("self", ["self"]), ("s", ["a"]), ("t", ["s"]), ("u", ["x", "s"])]
    states = [("a", "limited"), ("b", "ready"), ("c", "ready"), ("x", "failed"), ("d", "ready"), ("e", "ready"), ("f", "ready"), ("p", "ready"), ("q", "ready"), ("r", "ready"), ("self", "ready"), ("s", "stale"), ("t", "failed"), ("u", "ready")]
    found = {r.capability: (r.state, r.level, r.reasons) for r in flow.dependency_states(spark.createDataFrame(specs, SPECS), spark.createDataFrame(states, STATES)).collect()}
    assert found == {
        "a": ("limited", 0, []), "b": ("limited", 1, ["DEPENDENCY_LIMITED"]), "x": ("failed", 0, []), "c": ("unavailable", 2, ["DEPENDENCY_FAILED"]), "d": ("unavailable", 3, ["DEPENDENCY_UNAVAILABLE"]),
        "e": ("unavailable", 0, ["UNKNOWN_DEPENDENCY"]), "f": ("unavailable", 2, ["DEPENDENCY_UNAVAILABLE"]), "s": ("stale", 1, []), "t": ("failed", 2, []), "u": ("stale", 2, ["DEPENDENCY_STALE"]),
        "p": ("cycle", None, ["DEPENDENCY_CYCLE"]), "q": ("cycle", None, ["DEPENDENCY_CYCLE"]), "r": ("cycle", None, ["DEPENDENCY_CYCLE"]), "self": ("cycle", None, ["DEPENDENCY_CYCLE"]),
    }
    empty = flow.dependency_states(spark.createDataFrame([], SPECS), spark.createDataFrame([], STATES))
    assert empty.count() == 0
    with pytest.raises(ValueError):
        jobs.readiness(spark.createDataFrame([("a", ["gone"])], SPECS), spark.createDataFrame([("a", "ready")], STATES))


def test_walks(spark):
    links = [("api:a", "application:a", "inferred"), ("api:a", "data_access:a", "confirmed"), ("data_access:a", "api:a", "confirmed"), ("data_access:a", "domain:b", "inferred"), ("data_access:a", "domain:a", "inferred"), ("api:b", "presentation:web", "confirmed"), ("domain:a", "data_access:a", "confirmed")]
    df = spark.createDataFrame(links, "source string, target string, support string")
    starts = spark.createDataFrame([("api:a",), ("api:b",), ("api:a",), (None,)], "start string")
    got = sorted(map(tuple, architecture.flows(starts, df).collect()))
    assert got == [("api:a", 0, "api:a", "confirmed"), ("api:a", 1, "data_access:a", "confirmed"), ("api:a", 2, "domain:a", "inferred"), ("api:b", 0, "api:b", "confirmed")]
    assert architecture.flows(starts, df, 2).count() == 3
