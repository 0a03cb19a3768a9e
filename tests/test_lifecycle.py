import pytest
from pyspark.sql import functions as F

from corpusmill.operators import lifecycle as LC


def test_client_routes(spark):
    bind = [
        ("a.js", "axios", "import", "default", "axios", None, 1), ("a.js", "api", "create", "axios", None, "https://x.y/v1/", 2), ("a.js", "again", "alias", "api", None, None, 3),
        ("b.js", "api", "import", "again", "a.js", None, 1), ("b.js", "deep", "create", "api", None, "/users", 2), ("b.js", "shadow", "create", "api", None, "/old", 3), ("b.js", "shadow", "create", "api", None, "/new", 9),
        ("c.js", "p", "alias", "q", None, None, 1), ("c.js", "q", "alias", "p", None, None, 2), ("c.js", "axios", "alias", "other", None, None, 3), ("c.js", "not", "create", "axios", None, "/no", 4), ("d.js", "raw", "create", "axios", None, None, 1),
    ]
    calls = [("a.js", 5, "api", "get", "/items/"), ("b.js", 5, "deep", "post", "7?x=1"), ("b.js", 6, "shadow", "get", "/"), ("c.js", 5, "p", "get", "/"), ("c.js", 6, "axios", "get", "/z"), ("c.js", 7, "not", "get", "/"), ("d.js", 2, "raw", "put", "https://h/q"), ("d.js", 3, "axios", "get", "/"), ("d.js", 4, "none", "get", "/")]
    got = LC.client_routes(spark.createDataFrame(bind, "file string, name string, kind string, of string, module string, base string, line int"), spark.createDataFrame(calls, "file string, line int, client string, method string, route string"))
    assert sorted((r.file, r.line, r.method, r.route) for r in got.collect()) == [("a.js", 5, "GET", "/v1/items"), ("b.js", 5, "POST", "/v1/users/7"), ("b.js", 6, "GET", "/v1/new"), ("d.js", 2, "PUT", "/q"), ("d.js", 3, "GET", "/")]


def test_quarantine_settles_through_tables(spark):
    a = spark.createDataFrame([(1,), (2,), (2,), (None,)], "a int")
    b = spark.createDataFrame([(10, 1), (20, 2), (30, 9), (40, None)], "b int, a int")
    c = spark.createDataFrame([("x", 10, 1), ("y", 20, 1), ("z", 30, 1), ("w", 10, 2)], "c string, b int, a int")
    kept, refused = LC.quarantine({"a": (a, "a"), "b": (b, "b"), "c": (c, "c")}, [("b", "a", "a"), ("c", "b", "b"), ("c", "a", "a")])
    assert [r.c for r in kept["c"].collect()] == ["x"] and [r.b for r in kept["b"].collect()] == [10]
    assert sorted((r.table, str(r.key), r.reason) for r in refused.collect()) == [
        ("a", "2", "duplicate_key"), ("a", "2", "duplicate_key"), ("a", "None", "null_key"), ("b", "20", "refused:a"), ("b", "30", "missing:a"), ("b", "40", "null:a"), ("c", "w", "refused:a"), ("c", "y", "refused:b"), ("c", "z", "refused:b"),
    ]
    with pytest.raises(ValueError):
        LC.quarantine({"b": (b, "b"), "a": (a, "a")}, [("b", "a", "a")])


def test_resume(spark):
    """A reordered input is the same; a changed one ends reuse there and in all that comes of it."""
    phases = spark.createDataFrame([(0, "scan", "v1", ["s"]), (1, "parse", "v1", ["t0", "s"]), (2, "graph", "v1", ["t1"])], "ordinal int, phase string, version string, inputs array<string>")
    key = lambda run, phase, *arts: spark.range(1).select(LC.phase_key(F.lit(run), F.lit(phase), F.lit("v1"), F.lit("c"), F.array(*[F.struct(F.lit(t).alias("type"), F.lit(h).alias("sha256")) for t, h in arts]))).first()[0]
    rows, stored = [], []
    for run in range(1, 6):
        rows += [(run, 0, "scan", key(run, "scan", ("s", "S")), "t0", "A"), (run, 1, "parse", key(run, "parse", ("s", "S"), ("t0", "A")), "t1", "B"), (run, 2, "graph", key(run, "graph", ("t1", "B")), "t2", "C")]
        stored += [(run, "t0", "A"), (run, "t1", "B" if run != 2 else "broken"), (run, "t2", "C")]
    rows = [r for r in rows if r[:2] != (4, 1)]
    initial = [(run, "s", "S" if run != 3 else "new") for run in range(1, 6) if run != 5]
    frame = spark.createDataFrame
    got = LC.resume(phases, frame(initial, "run int, type string, sha256 string"), frame(rows, "run int, ordinal int, phase string, key string, type string, sha256 string"), frame(stored, "run int, type string, sha256 string"), F.lit("c"))
    assert sorted((r.run, r.next_phase, r.reused, r.stopped_by) for r in got.collect()) == [(1, 3, "scan,parse,graph", None), (2, 1, "scan", "damaged_output"), (3, 0, "", "other_key"), (4, 1, "scan", "missing_checkpoint")]


def test_sessions_of_a_stream_equal_those_of_a_table(spark, tmp_path):
    rows = [(1, 1, "2024-01-01 00:00:00", "view"), (1, 2, "2024-01-01 05:59:59", "purchase"), (1, 3, "2024-01-01 12:00:00", "error"), (2, 4, "2024-01-01 01:00:00", "signup"), (2, 4, "2024-01-01 01:00:00", "signup"), (2, 5, "2024-01-01 01:30:00", "click"), (9, 99, "2024-01-09 00:00:00", "view"), (9, 98, "2024-01-19 00:00:00", "view")]
    df = spark.createDataFrame(rows, "user_id long, event_id long, ts string, event_type string").withColumn("ts", F.col("ts").cast("timestamp"))
    want = sorted(map(tuple, LC.import_sessions(df).filter("user_id < 9").collect()))
    assert sorted((r[0], *r[3:]) for r in want) == [(1, 1, 0, 1, "failed"), (1, 2, 1, 0, "confirmed"), (2, 2, 1, 0, "cancelled")]
    for k in range(4):  # in files of their own, so in several batches
        df.filter(F.col("event_id") % 4 == k).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    late = spark.createDataFrame([(9, 1000, "2025-01-01 00:00:00", "view")], "user_id long, event_id long, ts string, event_type string").withColumn("ts", F.col("ts").cast("timestamp"))
    late.coalesce(1).write.parquet(f"{tmp_path}/in/9")  # the watermark passes all sessions
    told = LC.import_sessions(spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*"), late="30 days").writeStream.outputMode("append").format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
    told.awaitTermination()
    assert sorted(map(tuple, spark.read.parquet(f"{tmp_path}/out").filter("user_id < 9").collect())) == want
