"""Plans and shapes that larger tables need: what is broadcast, shuffled and multiplied."""

import random
import re
from difflib import SequenceMatcher

from pyspark.sql import functions as F

import corpusmill.operators.candidates as CA
import corpusmill.plans.queries as plans
from corpusmill.operators import retrieval, scoring
from corpusmill.plans import lift

DIR = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_arguments_meet_parameters_a_call_at_a_time(spark):
    calls = spark.createDataFrame([(1, "f", ["x", "y", "z"]), (2, "f", ["x"]), (3, "g", ["x"]), (4, "f", []), (5, "f", None)], "call_id long, callee string, arguments array<string>")
    names = spark.createDataFrame([("f", ["self", "a", "b"]), ("f", ["c"])], "callee string, names array<string>")
    got = sorted(map(tuple, CA.bind_arguments(calls, names).collect()))
    assert got == [(1, "x", "a"), (1, "x", "c"), (1, "y", "b"), (2, "x", "a"), (2, "x", "c")]


def test_argument_binding_broadcasts_no_calls(spark):
    text = plan(plans.argument_binding(spark, DIR))
    side = text[text.index("BroadcastExchange") :] if "BroadcastExchange" in text else ""
    assert not re.search("l_orderkey", side.split("FileScan")[0]) and "Range" in side


def test_ratios_of_all_pairs_at_once():
    rnd = random.Random(5)
    word = lambda low, high: "".join(rnd.choice("abcdé𝒳") for _ in range(rnd.randint(low, high)))
    words, terms = (list(dict.fromkeys(word(*r) for _ in range(n))) for n, r in ((500, (1, 12)), (80, (2, 9))))
    words += ["a" * 9, "x" * 300, "b" * 70]
    found = {(i, j): x for w, t, q in scoring.Alike(terms).pairs(words) for i, j, x in zip(w.tolist(), t.tolist(), q.tolist(), strict=True)}
    assert found == {(i, j): x for i, w in enumerate(words) for j, t in enumerate(terms) if (x := SequenceMatcher(None, t, w).ratio()) >= 0.76}
    held = {(i, j) for w, t in scoring._substrings(words, terms) for i, j in zip(w.tolist(), t.tolist(), strict=True)}
    assert held == {(i, j) for i, w in enumerate(words) for j, t in enumerate(terms) if t in w}


def test_sparse_terms_of_rows_are_not_shuffled(spark):
    assert "Exchange" not in plan(plans.sparse_terms(spark, DIR))
    before = plan(plans.bm25_topk(spark, DIR)).split("MapInArrow")[-1]
    assert "Exchange" not in before, "chunks and postings stay where they are read"


def test_best_rows_of_small_blocks_and_batches(spark, monkeypatch):
    """Several blocks of questions, batches and partitions give what one gives."""
    rnd = random.Random(2)
    text = lambda n: " ".join("".join(rnd.choice("abc") for _ in range(rnd.randint(2, 6))) + rnd.choice(["", ".", "/x"]) for _ in range(n))
    rows = [(f"c{i}", i, f"p/{i % 7}.py", rnd.choice(["", "abc", "ba"]), rnd.choice(["endpoint", "text", "function"]), text(8)) for i in range(400)]
    chunks = spark.createDataFrame(rows, "chunk_id string, seq long, path string, symbol string, chunk_type string, haystack string").withColumn("body", F.col("haystack"))
    queries = spark.createDataFrame([(i, text(4)) for i in range(9)] + [(50, "the and"), (51, "api login p/3.py")], "query_id long, query string")

    def found():
        out = {"lexical": retrieval.lexical(chunks, queries, True, 5), "sparse": retrieval.sparse(chunks, queries, 5), "terms": retrieval.sparse_terms(chunks, queries)}
        return {k: sorted(map(str, df.collect())) for k, df in out.items()}

    want = found()
    for name, size in (("QUESTIONS", 4), ("ROWS", 64), ("WORDS", 50)):
        monkeypatch.setattr(scoring, name, size)
    chunks = chunks.repartition(3)
    assert found() == want and all(want.values())


def test_questions_without_terms_and_names(spark):
    rows = spark.createDataFrame([("c1", "the", "a.py", "is the one"), ("c2", None, "b.py", "login"), ("c1", "z", "a.py", "the login")], "chunk_id string, title string, path string, haystack string")
    queries = spark.createDataFrame([(1, " the"), (2, "login in b.py"), (3, "")], "query_id int, query string")
    got = sorted((r["list"], r.query_id, r.chunk_id, r.title, r.score) for r in scoring.entities(rows.coalesce(1), queries, 1.0, 5).collect())
    assert got == [("all", 1, "c1", "the", 3.0), ("all", 2, "c1", "z", 4.95), ("all", 2, "c2", None, 4.95), ("named", 1, "c1", "the", 3.0), ("named", 2, "c2", None, 4.95)]


def test_documents_that_share_a_number(spark, tmp_path):
    rows = [(1, "a\nb", "en", "web"), (1, "a\nc", "en", "web"), (2, "a", "en", "web"), (None, "d", "en", "web"), (None, "d", "en", "web")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    kept = plans._lines(spark, str(tmp_path))
    assert sorted((r.doc_id or 0, r.line, r.content) for r in kept.collect()) == [(0, 1, "d"), (1, 1, "a"), (1, 2, "b"), (1, 2, "c"), (2, 1, "a")]
    spark.createDataFrame(rows[1:3], "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/x/documents.parquet")
    assert "Exchange" not in plan(plans._lines(spark, f"{tmp_path}/x"))


def test_documents_that_hold_passages(spark, tmp_path):
    """Passages meet documents through one inner word: common words make no pairs."""
    spark.createDataFrame([(0, "a b c d"), (1, "b c"), (2, "x"), (3, "c d. E"), (4, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(1, "aa b c dd"), (2, "a b  c d"), (3, "xb cx"), (4, None), (5, "bc d. Ef")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = lift.relevance(spark, str(tmp_path))
    assert sorted(map(tuple, found.collect())) == [(0, 1), (1, 1), (1, 3), (2, 3), (3, 5)]
    assert "Generate" not in plan(found)


def test_dense_in_blocks_of_queries_and_vectors(spark, monkeypatch):
    rnd = random.Random(4)
    rows = [(i, [float(rnd.randint(-3, 3)) or 1.0 for _ in range(5)]) for i in range(300)]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    monkeypatch.setattr(scoring, "ASKED", 7)
    monkeypatch.setattr(scoring, "VECTORS", 64)
    cos = lambda x, y: round(sum(a * b for a, b in zip(x, y, strict=True)) / (sum(a * a for a in x) * sum(b * b for b in y)) ** 0.5, 6)
    want = []
    for q, y in rows[::10]:
        best = sorted((-c, i) for i, x in rows if i != q and (c := cos(x, y)) > 0)[:4]
        want += [(q, i, -c, n + 1) for n, (c, i) in enumerate(best)]
    found = retrieval.dense(v, v.filter("vec_id % 10 = 0"), 4)
    assert sorted((r.query_id, r.vec_id, r.score, r["rank"]) for r in found.collect()) == sorted(want)
    assert "NestedLoop" not in plan(found)
