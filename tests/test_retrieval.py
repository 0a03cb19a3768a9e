import random
from difflib import SequenceMatcher

from corpusmill.operators import retrieval as R


def test_fuzzy_pairs_against_all_pairs(spark):
    rnd = random.Random(1)
    words = {"".join(rnd.choice("abcdé") for _ in range(rnd.randint(1, 9))) for _ in range(300)} | {"login", "logon", "logins", "abc", "acb", "a" * 30}
    terms = {w for w in sorted(words) if len(w) > 1 and rnd.random() < 0.3} | {"loginn", "axc"}
    df = lambda ws, c: spark.createDataFrame([(w,) for w in sorted(ws)], f"{c} string")
    want = sorted((t, w, r) for t in terms for w in words if (r := SequenceMatcher(None, t, w).ratio()) >= 0.76)
    for size in (1 << 13, 7):  # terms in one block, and in several
        R.TERMS = size
        assert sorted(map(tuple, R.fuzzy_pairs(df(words, "token"), df(terms, "term")).collect())) == want
    R.TERMS = 1 << 13


def test_containing_is_linear_in_paths_of_one_folder(spark):
    paths = spark.range(100_000).selectExpr("concat('src/app/file_', id, '.py') AS path")
    asked = spark.createDataFrame([("where is src/app/file_77.py used",), ("src/app",), ("",), (None,)], "q string")
    found = R.containing(asked, "q", paths, "path")
    assert [tuple(r) for r in found.collect()] == [("where is src/app/file_77.py used", "src/app/file_77.py")]
    short = spark.createDataFrame([("app",), ("src",), ("",), (None,), ("src/app",)], "p string")
    assert sorted(tuple(r) for r in R.containing(asked, "q", short, "p").collect()) == sorted((q, p) for q in ("where is src/app/file_77.py used", "src/app") for p in ("app", "src", "src/app"))


def test_graph_context_keeps_neighbours_that_are_matched(spark):
    """Of a matched and linked file the chunks that aren't matched come, and those of a file with an edge to itself."""
    nodes = spark.createDataFrame([("a", "a.py"), ("b", "b.py"), ("c", "c.py"), ("f", "c.py"), ("x", None)], "id string, file_path string")
    edges = spark.createDataFrame([("a", "b"), ("c", "f"), ("a", "x"), ("a", "missing")], "source string, target string")
    chunks = spark.createDataFrame([(f"{p}{n}", f"{p}.py", kind) for p in "abc" for n, kind in enumerate(["function", "method", "text"])], "chunk_id string, path string, chunk_type string")
    matched = spark.createDataFrame([(1, "a.py", "a0"), (1, "b.py", "b0"), (2, "c.py", "c1"), (3, "a.py", "a2")], "query_id int, path string, chunk_id string")
    got = lambda **k: sorted((r.query_id, r.chunk_id, r["rank"]) for r in R.graph_context(matched, edges, nodes, chunks, **k).collect())
    assert got() == [(1, "a1", 1), (1, "b1", 2), (2, "c0", 1), (3, "b0", 1), (3, "b1", 2)]
    taken = spark.createDataFrame([(1, 4)], "query_id int, n int")
    assert got(offset=taken, k=5) == [(1, "a1", 5), (2, "c0", 1), (3, "b0", 1), (3, "b1", 2)]
    assert got(k=1) == [(1, "a1", 1), (2, "c0", 1), (3, "b0", 1)]


def test_hits_of_several_kinds(spark):
    rows = spark.createDataFrame([("chunk", "1", "login logins a"), ("chunk", "2", ""), ("node", "1", "logon")], "kind string, id string, haystack string")
    queries = spark.createDataFrame([(1, "the login page"), (2, "a")], "query_id int, query string")
    hits, sizes = R.term_hits(rows, queries)
    assert sorted((r.kind, r.id, r.length, r.term, r.tf, bool(r.held), round(r.ratio, 4)) for r in hits.collect()) == [("chunk", "1", 3, "login", 1, True, 1.0), ("node", "1", 1, "login", 0, False, 0.8)]
    assert sorted((r.kind, r.n_rows, r.avg_tokens) for r in sizes.collect()) == [("chunk", 2, 1.5), ("node", 1, 1.0)]
