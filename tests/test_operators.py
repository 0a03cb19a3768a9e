import random

import pytest
from pyspark.sql import functions as F

from corpusmill.functions import text as X
from corpusmill.operators import diff, evaluation, evidence, fusion, graph, impact, jobs, retrieval


def chain(spark, n, seed=None):
    nodes = [(f"node-{i}", "function", f"f{i}", "a.py", None, i) for i in range(n)]
    edges = [(i, f"node-{i}", f"node-{i + 1}", "calls", 0.9, "deep") for i in range(n - 1)]
    if seed is not None:
        random.Random(seed).shuffle(nodes)
        random.Random(seed).shuffle(edges)
    return (
        spark.createDataFrame(nodes, "id string, type string, label string, file_path string, role string, start_line int"),
        spark.createDataFrame(edges, "seq long, source string, target string, type string, confidence double, evidence_level string"),
    )


def test_projection_does_not_depend_on_order(spark):
    seen = []
    for seed in (None, 1):
        n, e = chain(spark, 300, seed)
        kept, shown, row = graph.project(n, e, graph.Request(roots=("node-5", "gone"), depth=3, nodes=4, edges=2))
        seen.append(([r.id for r in kept.orderBy("visit_no").collect()], sorted((r.source, r.target) for r in shown.collect()), row.first().asDict()))
    assert seen[0] == seen[1]
    ids, links, row = seen[0]
    assert ids == ["node-5", "node-4", "node-6", "node-3"] and all(a in ids and b in ids for a, b in links)
    assert row["truncation"] == "node_and_edge_budget" and row["missing_roots"] == "gone" and row["available_nodes"] == 7


def test_directions_and_unknown_roots(spark):
    n, e = chain(spark, 8)
    root = spark.createDataFrame([("node-3",)], "id string")
    assert {r.id for r in graph.traverse(n, e, root, "outgoing", 2).collect()} == {"node-3", "node-4", "node-5"}
    assert {r.id for r in graph.traverse(n, e, root, "incoming", 1).collect()} == {"node-3", "node-2"}
    assert graph.traverse(n, e, spark.createDataFrame([("x",)], "id string")).count() == 0
    assert {r.id for r in graph.reachable(e, "alone", 2).collect()} == {"alone"}
    with pytest.raises(ValueError):
        graph.Request(depth=7)


def test_merged_nodes(spark):
    rows = [("a", 1, "unknown", "", "f", None, "mapped", ["X y"]), ("a", 2, "file", "L", "g", "r", "deep_indexed", ["x_y", "z"])]
    got = graph.merged_nodes(spark.createDataFrame(rows, "id string, seq long, type string, label string, file_path string, role string, coverage string, tags array<string>")).first()
    assert (got.type, got.label, got.file_path, got.role, got.coverage, got.tags) == ("file", "L", "f", "r", "deep_indexed", "x_y,z")


def test_impact_against_a_queue(spark):
    rnd = random.Random(4)
    nodes = [(f"n{i}",) for i in range(60)]
    edges = [(k, f"n{rnd.randrange(60)}", f"n{rnd.randrange(62)}", "calls", rnd.randint(50, 99) / 100) for k in range(110)]
    known = {n for n, in nodes}
    side = {}
    for _, a, b, t, c in edges:
        side.setdefault(a, []).append((b, c))
        side.setdefault(b, []).append((a, c))
    best, queue = {"n0": (0, 1.0)}, ["n0"]
    while queue:
        at = queue.pop(0)
        depth, conf = best[at]
        for b, c in side.get(at, []) if depth < 3 else []:
            if b not in best and b in known:
                import math

                best[b] = (depth + 1, math.floor(conf * c * 10_000 + 0.5) / 10_000)
                queue.append(b)
    del best["n0"]
    rnd.shuffle(edges)
    got = impact.traverse(spark.createDataFrame(nodes, "id string"), spark.createDataFrame(edges, "seq long, source string, target string, type string, confidence double"), spark.createDataFrame([("n0", 1)], "id string, no long"), 3)
    assert {r.id: (r.depth, r.confidence) for r in got.collect()} == best


def test_packing_goes_on_after_a_block_that_does_not_fit(spark):
    rows = [(1, "a", 1, 50), (1, "b", 2, 60), (1, "c", 3, 30), (1, "d", 4, 200), (1, "e", 5, 10), (1, "f", 6, 10), (2, "a", 1, 5)]
    got = evidence.pack(spark.createDataFrame(rows, "query_id int, candidate_id string, pos int, cost int"), most=4, budget=100)
    assert {(r.query_id, r.candidate_id): r.outcome for r in got.collect()} == {
        (1, "a"): "selected", (1, "b"): "token_budget_exceeded", (1, "c"): "selected", (1, "d"): "block_exceeds_token_budget", (1, "e"): "selected", (1, "f"): "selected", (2, "a"): "selected",
    }


def test_metrics_example(spark):
    items = [(1, "m", 1, "x", "s1", 1, 2, False), (1, "m", 2, "a", "s2", 1, 2, True), (1, "m", 3, "b", "s2", 1, 2, True)]
    cases = [(1, "m", 2, True), (2, "m", 0, False)]
    got = evaluation.score(
        spark.createDataFrame(items, "case_id int, method string, rank int, entity_key string, source_key string, start_line int, end_line int, relevant boolean"),
        spark.createDataFrame(cases, "case_id int, method string, n_relevant int, should_answer boolean"), 3,
    )
    r = {x.case_id: x for x in got.collect()}
    assert (r[1].recall, r[1].precision, r[1].reciprocal_rank, r[1].ndcg) == (1.0, 0.666666666667, 0.5, 0.693426403617)
    assert r[1].duplicate_rate == 0.333333333333 and r[2].insufficient == 1.0 and r[2].recall is None
    with pytest.raises(ValueError):
        evaluation.score(got, got, 0)


def test_fusion_by_hand(spark):
    rows = [
        (1, "c1", "exact", "e1", "s", 1, 2, 1, "heuristic", ["r"]), (1, "c2", "lexical", "e1", "s", 1, 2, 3, "source_exact", ["q"]), (1, "c3", "lexical", "e2", "s", 1, 2, 1, "heuristic", ["r"]),
        (1, "c4", "lexical", "e3", "s", 1, 2, 51, "heuristic", ["r"]), (1, "c5", "graph", "e4", "s", 1, 2, 1, "heuristic", ["r"]),
    ]
    df = spark.createDataFrame(rows, "query_id int, candidate_id string, retriever string, entity_key string, source_key string, start_line int, end_line int, rank int, support string, reasons array<string>")
    p = fusion.Policy(weights={"exact": 2.0, "lexical": 1.0}, boosts={"q": 1.5})
    got = {r.entity_key: r for r in fusion.fuse(df, p).collect()}
    assert got.keys() == {"e1", "e2"}
    assert got["e1"].fused == round((2 / 61 + 1 / 63) * 1.5, 12) and got["e1"].support == "source_exact" and got["e1"].candidate_ids == ["c1", "c2"]
    assert got["e1"].normalised == 1.0 and got["e2"].normalised == round(round(1 / 61, 12) / (3 / 61), 12) and got["e2"].position == 2
    with pytest.raises(ValueError):
        fusion.Policy(weights={})
    assert fusion.identity("x_", {"b": 1, "a": "é"}) == fusion.identity("x_", {"a": "é", "b": 1})


def test_adoption_and_gate_inputs(spark):
    row = spark.createDataFrame([(1.0, 1.0, 1.0, 0.9, 0.8, 1.0, 1.0, 0.9, 0.8, 0.5, 0.5, 1.0, 1.0)], "p95_ms double, corpus_ms double, memory_bytes double, hybrid_recall double, sparse_recall double, hybrid_rr double, sparse_rr double, hybrid_ndcg double, sparse_ndcg double, hybrid_precision double, sparse_precision double, hybrid_insufficient double, sparse_insufficient double")
    assert evaluation.adoption(row).first().accepted and not evaluation.adoption(row, gain=0.2).first().accepted


def test_lease_rules(spark):
    l = jobs.Lease()
    assert [l.apply("claim", 0), l.apply("claim", 10), l.apply("heartbeat", 50), l.apply("fail", 100), l.apply("claim", 100.5), l.apply("claim", 101), l.apply("heartbeat", 161), l.apply("claim", 162), l.apply("claim", 300), l.apply("claim", 301)] == [
        "started", "fenced", "extended", "retry_scheduled", "deferred", "started", "lease_lost", "recovered", "attempts_exhausted", "terminal",
    ]


def test_stream_equals_batch(spark, tmp_path):
    from corpusmill.streaming import leases

    rnd = random.Random(6)
    rows = [(rnd.randrange(8), k, rnd.choice(["claim", "claim", "heartbeat", "complete", "fail", "cancel"]), float(k * 7)) for k in range(200)]
    for part in range(4):
        spark.createDataFrame(rows[part * 50 : part * 50 + 50], leases.EVENTS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    import os
    import time

    for k, f in enumerate(sorted((f for f in os.listdir(tmp_path / "in") if f.endswith(".parquet")), key=lambda f: os.path.getmtime(tmp_path / "in" / f))):
        os.utime(tmp_path / "in" / f, (time.time() - 100 + k, time.time() - 100 + k))
    q = leases.start(leases.read_events(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "check"))
    q.awaitTermination()
    got = sorted(tuple(r)[:5] for r in spark.read.parquet(str(tmp_path / "out")).select("job_id", "seq", "outcome", "state", "attempt").collect())
    want = sorted(tuple(r) for r in jobs.replay(spark.createDataFrame(rows, leases.EVENTS)).collect())
    assert got == want


def test_readiness(spark):
    specs = spark.createDataFrame([("a", []), ("b", ["a"]), ("c", ["b"])], "capability string, depends_on array<string>")
    states = spark.createDataFrame([("a", "limited"), ("b", "ready"), ("c", "ready")], "capability string, state string")
    assert {r.capability: r.state for r in jobs.readiness(specs, states).collect()} == {"a": "limited", "b": "limited", "c": "limited"}
    with pytest.raises(ValueError):
        jobs.readiness(spark.createDataFrame([("a", ["b"]), ("b", ["a"]), ("c", [])], "capability string, depends_on array<string>"), states)


def test_plan_reasons(spark):
    schema = "file_key string, path string, content_sha256 string, normalized_sha256 string, documentation_sha256 string, structure_sha256 string, public_api_sha256 string, dependency_sha256 string, byte_size long"
    row = lambda k, h: (k, k, h, h, "d", "s", "p", "e", 1)
    before = spark.createDataFrame([row(k, k) for k in "abcd"], schema)
    after = spark.createDataFrame([row("a", "new"), *[row(k, k) for k in "bcd"]], schema)
    deps = spark.createDataFrame([("b", "a", "imports"), ("c", "b", "imports")], "source_file_key string, target_file_key string, relation string")
    mode, why, rows = diff.plan(before, after, deps, diff.Limits(fraction=1.0))
    assert (mode, why) == ("incremental", None) and {r.file_key: r.action for r in rows.collect()} == {"a": "rebuild", "b": "rebuild", "c": "rebuild", "d": "reuse"}
    assert diff.plan(before, after, deps, diff.Limits(depth=1))[1] == "dependency_depth_limit"
    assert diff.plan(before, after, deps, diff.Limits(files=2))[1] == "affected_file_limit"
    assert diff.plan(before, after, deps, diff.Limits(fraction=0.5))[1] == "affected_fraction_limit"
    assert diff.plan(before, after, deps, diff.Limits(), same_components=False)[1] == "component_incompatible"
    assert diff.plan(before, after, deps.union(deps), diff.Limits())[1] == "dependency_graph_invalid"


def test_fuzzy_against_plain_python(spark):
    terms, tokens = ["handler", "login", "auth"], ["handlers", "logins", "author", "x", "handle"]
    t = spark.createDataFrame([(1, x) for x in terms], "query_id int, term string")
    k = spark.createDataFrame([("c", x) for x in tokens], "id string, token string")
    want = sum(1.2 if b >= 0.88 else 0.55 if b >= 0.76 else 0.0 for b in (max(retrieval.similarity_ratio(a, x) for x in tokens) for a in terms))
    assert abs(retrieval.fuzzy_scores(t, k).first().fuzzy - want) < 1e-9


def test_text_edges(spark):
    df = spark.createDataFrame([("",), ("/",), ("/api",), ("/apix/Y/",), (None,)], "r string").select(X.normalize_route(F.col("r")).alias("n"))
    assert [r.n for r in df.collect()] == ["/", "/", "/", "x/y", "/"]


def test_chunk_lookups(spark):
    chunks = spark.createDataFrame([("c1", 1, "a.py", "file_summary", None, 0, 0, "a"), ("c2", 2, "a.py", "function", "f", 1, 9, "def f"), ("c3", 3, "a.py", "endpoint", "g", 10, 20, "GET /x")], "chunk_id string, seq int, path string, chunk_type string, symbol string, start_line int, end_line int, content string")
    symbols = spark.createDataFrame([("s1", "a.py", "f", 2, 3), ("s2", "a.py", "zz", 10, 20), ("s3", "b.py", "f", 1, 1)], "symbol_id string, path string, name string, start_line int, end_line int")
    assert {r.symbol_id: r.chunk_id for r in retrieval.chunk_of_symbol(symbols, chunks).collect()} == {"s1": "c2", "s2": "c3", "s3": None}
    nodes = spark.createDataFrame([("n1", "function", "q", "a.py", 3, 4), ("n2", "endpoint", "q", "a.py", None, None), ("n3", "class", "q", "a.py", None, None), ("n4", "class", "q", None, None, None)], "id string, type string, label string, file_path string, start_line int, end_line int")
    assert {r.id: r.chunk_id for r in retrieval.chunk_of_node(nodes, chunks).collect()} == {"n1": "c2", "n2": "c3", "n3": "c1", "n4": None}
    ends = spark.createDataFrame([("e1", "a.py", "nope", "/x"), ("e2", "a.py", "g", "/y"), ("e3", "a.py", "h", "/z")], "endpoint_id string, path string, handler string, route string")
    assert {r.endpoint_id: r.chunk_id for r in retrieval.chunk_of_endpoint(ends, chunks).collect()} == {"e1": "c3", "e2": "c3", "e3": None}
