import hashlib

import pytest
from pyspark.sql import functions as F

from corpusmill.operators import answering as AN

BLOCK = "query_id long, candidate_id string, kind string, path string, source_key string, start_line int, end_line int, content string, chunk_hash string, support string, retrievers array<string>, reason_codes array<string>, chunk_type string, fused double, best_rank int, entity_key string, candidate_ids array<string>, normalised double"
FILES = "path string, indexed_hash string, content string"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def block(q, name, kind, by, support="source_exact", fused=1.0):
    path, text = f"{name}.py", f"body of {name}"
    return (q, name, kind, path, f"file:v1:{path}", 1, 1, text, sha(f"{path}:1:1:{text}"), support, by, [], "text", fused, 1, name, [f"{by[0]}|{name}"], 0.5)


def answer(spark, questions, exact, hybrid, repaired, **limits):
    names = {b[1] for b in exact + hybrid + repaired}
    files = spark.createDataFrame([(f"{n}.py", sha(f"body of {n}"), f"body of {n}") for n in sorted(names)], FILES)
    rows = [spark.createDataFrame(r, BLOCK) for r in (exact, hybrid, repaired)]
    blocks, told = AN.answer(spark.createDataFrame(questions, "query_id long, query string, kind string"), *rows, files, spark.createDataFrame([], "path string"), AN.Budget(**limits))
    found = {}
    for r in blocks.collect():
        found.setdefault(r.query_id, set()).add(r.candidate_id)
    return found, {r.query_id: r for r in told.collect()}


def test_rounds(spark):
    questions = [(1, "a", "code_question"), (2, "b", "code_question"), (3, "c", "flow_tracing"), (4, "d", "flow_tracing"), (5, "e", "api_question"), (6, "f", None), (7, "g", "code_question")]
    exact = [block(1, "x1", "code_question", ["exact"]), block(3, "no", "flow_tracing", ["exact"])]
    hybrid = [
        block(1, "unused", "code_question", ["lexical"]), block(2, "x2", "code_question", ["lexical"]), block(3, "x3", "flow_tracing", ["graph"]), block(3, "y3", "flow_tracing", ["lexical"]), block(4, "x4", "flow_tracing", ["lexical"]),
        block(5, "x5", "api_question", ["lexical"]),
    ]
    repaired = [block(4, "x4", "flow_tracing", ["graph"], fused=2.0), block(4, "y4", "flow_tracing", ["graph"]), block(5, "x5", "api_question", ["lexical"]), block(3, "never", "flow_tracing", ["graph"])]
    found, told = answer(spark, questions, exact, hybrid, repaired)
    assert found == {1: {"x1"}, 2: {"x2"}, 3: {"x3", "y3"}, 4: {"x4", "y4"}, 5: {"x5"}}
    short = {k: (r.tools, r.calls, r.rounds, r.repair, r.selected, r.outcome, r.reasons) for k, r in told.items()}
    both, again = "exact_lookup,hybrid_retrieval", "hybrid_retrieval,hybrid_retrieval"
    assert short == {
        1: ("exact_lookup", 1, 1, None, 1, "answered", "workflow_completed"), 2: (both, 2, 1, None, 1, "answered", "workflow_completed"), 3: ("hybrid_retrieval", 1, 1, None, 2, "answered", "workflow_completed"),
        4: (again, 2, 2, "repair_completed", 2, "answered", "workflow_completed"),
        5: (again, 2, 2, "repair_unchanged", 1, "limited", "required_strong_evidence_count:2,required_retriever:endpoint"),
        6: (both, 2, 1, None, 0, "insufficient_evidence", "no_selected_evidence"), 7: (both, 2, 1, None, 0, "insufficient_evidence", "no_selected_evidence"),
    }


def test_budgets_end_rounds(spark):
    questions, hybrid = [(2, "b", "code_question"), (4, "d", "flow_tracing")], [block(2, "x2", "code_question", ["lexical"]), block(4, "x4", "flow_tracing", ["lexical"])]
    repaired = [block(4, "y4", "flow_tracing", ["graph"])]
    found, told = answer(spark, questions, [], hybrid, repaired, calls=1)
    assert found == {4: {"x4"}} and (told[2].outcome, told[2].reasons) == ("limited", "tool_call_budget_exhausted,no_selected_evidence") and told[4].repair is None
    found, told = answer(spark, questions, [], hybrid, repaired, rounds=1)
    assert found == {2: {"x2"}, 4: {"x4"}} and told[4].outcome == "limited" and told[4].rounds == 1
    found, told = answer(spark, questions, [], hybrid, repaired, tokens=10)
    assert not found and {r.used_tokens for r in told.values()} == {0}
    assert answer(spark, [], [], hybrid, repaired) == ({}, {})
    with pytest.raises(ValueError):
        AN.Budget(calls=0)
    with pytest.raises(ValueError):
        AN.Budget(rounds=3)


def test_checked_calls(spark):
    def call(seq, tool="exact_lookup", version="1", repo="r", index="i", query="Q", kind="k", limit=5):
        return ("t", seq, tool, version, repo, index, query, kind, limit)

    calls = [
        call(1), call(2, query=" q "), call(3, tool="shell"), call(4, version="2"), call(5, repo="other"), call(6, index="old"), call(7, query=" "), call(8, query=None), call(9, limit=0), call(10, kind="z"), call(11, tool="hybrid_retrieval"),
        call(12, limit=6), call(13, repo=None), call(14, limit=6), call(15, tool=None),
    ]
    rows = spark.createDataFrame(calls, "turn_id string, seq int, tool string, version string, repository_id string, index_version string, query string, kind string, limit int").withColumn("_active", F.lit(1)).drop("_active")
    got = AN.checked_calls(rows, spark.createDataFrame([("r", "i")], "repository_id string, index_version string"))
    assert got.columns.count("index_version") == 1 and {r.seq: r.state for r in got.collect()} == {
        1: "accepted", 2: "equivalent_call", 3: "tool_unknown", 4: "tool_unknown", 5: "other_index", 6: "other_index", 7: "input_invalid", 8: "input_invalid", 9: "input_invalid", 10: "accepted", 11: "accepted", 12: "call_budget_exhausted",
        13: "other_index", 14: "equivalent_call", 15: "tool_unknown",
    }


def test_source_spans(spark):
    text = "\n".join(f"line {i}" for i in range(1, 11)) + "\n"
    files = spark.createDataFrame([("a", sha(text), text), ("b", sha(text), text), ("gone", "h", None), ("changed", "h", text), ("blank", sha("\n\n\n"), "\n\n\n")], FILES)
    blocks = [
        (1, "a", 1, 3, None), (1, "a", 2, 2, None), (1, "a", 4, 5, sha(text)), (1, "a", 8, 9, None), (1, "a", 8, 9, None), (1, "b", 10, 10, None),
        (2, "a", 1, 1, None), (2, "gone", 1, 1, None), (3, "changed", 1, 1, None), (4, "a", 10, 11, None), (5, "a", 0, 1, None), (6, "a", 3, 2, None), (7, "blank", 1, 2, None), (8, "a", 1, 1, "other"), (9, None, 1, 1, None), (10, "a", 1, 10, None),
    ]
    got = AN.source_spans(spark.createDataFrame(blocks, "query_id int, path string, start_line int, end_line int, source_hash string"), files, 120).collect()
    one = sorted((r.path, r.start_line, r.end_line, r.blocks, r.tokens, r.complete, r.content) for r in got if r.query_id == 1)
    assert one == [("a", 1, 5, 3, 41, True, "line 1\nline 2\nline 3\nline 4\nline 5"), ("a", 8, 9, 1, 36, True, "line 8\nline 9"), ("b", 10, 10, 1, 34, True, "line 10")]
    assert {r.query_id for r in got if r.complete} == {1, 10}
    assert all(r.content is None for r in got if not r.complete)
    over = AN.source_spans(spark.createDataFrame(blocks[:6], "query_id int, path string, start_line int, end_line int, source_hash string"), files, 110).collect()
    assert not any(r.complete for r in over) and sum(r.tokens for r in over) == 111
