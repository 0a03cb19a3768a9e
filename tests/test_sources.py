import io
import zipfile

import pytest
from pyspark.sql import functions as F

from corpusmill.sources import parse, scan, store

PY = '''import os
from .util import helper as h
from fastapi import APIRouter
router = APIRouter()

class Box(Base):
    def open(self, key):
        return self.turn(key)

    def turn(self, key):
        if key:
            value = h(key)
        else:
            value = len(os.getcwd())
        return value

@router.post("/boxes")
async def create(x):
    b = Box()
    for i in range(3):
        b.open(i)
    return missing(b)
'''


def test_scan_of_a_tree(spark, tmp_path):
    for name, data in {"src/a.py": b"x = 1\n", "src/latin.md": "caf\xe9".encode("latin-1"), "node_modules/b.py": b"1", "server.key": b"k", "big.py": b"#" * 2000, "x.bin": b"\0", "README.md": "hé".encode()}.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(data)
    got = {r.path: r for r in scan.scan_tree(spark, str(tmp_path), 1000).collect()}
    assert {k: v.skip_reason for k, v in got.items()} == {
        "src/a.py": None, "src/latin.md": None, "node_modules/b.py": "ignored_directory", "server.key": "secret_file", "big.py": "file_too_large", "x.bin": "unsupported_type", "README.md": None,
    }
    assert got["src/latin.md"].content == "café" and got["README.md"].content == "hé" and got["big.py"].content is None
    assert got["src/a.py"].language == "python" and got["README.md"].file_type == "document"
    assert scan.stale(scan.scan_tree(spark, str(tmp_path)), F.lit("2001-01-01").cast("timestamp")).first().stale


def archive(entries):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, data in entries:
            z.writestr(name, data)
    return out.getvalue()


def test_archives(spark, tmp_path):
    (tmp_path / "good.zip").write_bytes(archive([("a/b.py", "x"), ("inner.zip", "PK"), ("venv/c.py", "y")]))
    (tmp_path / "bad.zip").write_bytes(archive([("../up.py", "x")]))
    (tmp_path / "twice.zip").write_bytes(archive([("A.py", "x"), ("a.py", "y")]))
    (tmp_path / "bomb.zip").write_bytes(archive([("z.py", "0" * 900_000)]))
    (tmp_path / "junk.zip").write_bytes(b"no zip")
    rows = scan.scan_archives(spark, str(tmp_path)).collect()
    good = {r.path: r.skip_reason for r in rows if r.archive.endswith("good.zip")}
    assert good == {"a/b.py": None, "inner.zip": "nested_archive", "venv/c.py": "ignored_directory"}
    errors = {r.archive.rsplit("/", 1)[1]: r.error for r in rows if r.error}
    assert errors.keys() == {"bad.zip", "twice.zip", "bomb.zip", "junk.zip"}


def test_paths(spark):
    df = spark.createDataFrame([("Café\\A.py",), (None,)], "p string").select(scan.normal_path("p").alias("n"), scan.path_identity("p").alias("i"))
    assert [tuple(r) for r in df.collect()] == [("Café/A.py", "café/a.py"), (None, None)]


def test_parse_and_resolve(spark):
    files = spark.createDataFrame(
        [("pkg/main.py", "python", PY), ("pkg/util.py", "python", "def helper(k):\n    return k\n"), ("bad.py", "python", "def ("), ("web.ts", "typescript", "export const Page = () => 1\nimport x from './y'\napi.post('/boxes', d)\nfetch('/api/boxes', {method: 'DELETE'})\n"),
         ("m.go", "go", "package m\nfunc (s *S) Run() {\n  if x { y() }\n}\n"), ("doc.md", "markdown", "# hi"), ("empty.py", "python", None)],
        "path string, language string, content string",
    )
    rows = parse.parse_files(files)
    got = {(r.path, r.kind, r.name): r for r in rows.collect()}
    assert got["pkg/main.py", "class", "Box"].detail == "Base" and got["pkg/main.py", "method", "turn"].owner == "Box"
    assert got["pkg/main.py", "endpoint", "/boxes"].detail == "POST 0.9" and got["pkg/main.py", "function", "create"].start_line == 18
    assert ("bad.py", "diagnostic", "syntax_error") in got and ("bad.py", "chunk", "bad.py") in got and ("doc.md", "chunk", "doc.md") in got
    assert ("web.ts", "component", "Page") in got and ("web.ts", "api_call", "POST /boxes") in got and ("web.ts", "api_call", "DELETE /api/boxes") in got
    assert (got["m.go", "function", "Run"].start_line, got["m.go", "function", "Run"].end_line) == (2, 4)
    imports = rows.filter("kind = 'import'")
    found = {(r.name): (r.outcome, r.targets) for r in parse.resolve_imports(imports.filter("path like '%.py'"), files).collect()}
    assert found == {"os": ("unresolved", ""), ".util": ("resolved", "pkg/util.py"), "fastapi": ("unresolved", "")}
    calls = parse.resolve_calls(rows.filter("kind = 'call'"), rows, imports)
    out = {r.name: r.outcome for r in calls.collect()}
    assert out == {
        "APIRouter": "framework", "self.turn": "resolved", "h": "external", "len": "builtin", "os.getcwd": "stdlib", "Box": "target_not_found", "range": "builtin", "b.open": "dynamic_attribute", "missing": "target_not_found", "router.post": "dynamic_attribute",
    }
    assert {r.occurrence for r in parse.references(calls, "call").collect()} == {0}
    flow = {(r.function, r.source, r.target, r.type) for r in parse.flows(files).collect()}
    assert ("turn", "11", "12", "cfg_true") in flow and ("turn", "11", "14", "cfg_false") in flow and ("turn", "15", "exit", "cfg_return") in flow
    assert ("create", "20", "21", "cfg_loop_body") in flow and ("create", "21", "20", "cfg_loop_back") in flow
    assert ("turn", "parameter:key:10", "use:key:12", "dfg_reaches") in flow and ("turn", "use:value:15", "return:turn:15", "dfg_returned") in flow


def test_store(spark, tmp_path):
    s = store.Store(spark, str(tmp_path), "repo")
    df = spark.range(10)
    s.write(1, "chunks", df)
    with pytest.raises(ValueError):
        s.activate(1, None)
    s.publish(1, ["chunks"])
    s.publish(1, ["chunks"])
    with pytest.raises(ValueError):
        s.write(1, "chunks", df)
    s.activate(1, None)
    s.activate(1, None)
    s.write(2, "chunks", spark.range(3))
    s.publish(2, ["chunks"])
    with pytest.raises(ValueError):
        s.activate(2, None)
    s.activate(2, 1)
    assert s.active() == 2 and s.read("chunks").count() == 3 and s.read("chunks", 1).count() == 10 and s.versions() == [1, 2]
    assert s.verify(1) == []
    spark.range(4).write.mode("overwrite").parquet(s.path(1, "chunks"))
    assert s.verify(1) == ["chunks"]
    s.drop(1)
    with pytest.raises(ValueError):
        s.drop(2)
    assert s.versions() == [2]


def test_cases(spark, tmp_path):
    (tmp_path / "c.json").write_text('[{"id": "a", "question": "q", "expected": ["x"], "should_answer": true, "max_results": 5}, {"id": "a", "question": " ", "expected": [], "max_results": 500}]')
    cases, problems = store.read_cases(spark, str(tmp_path / "c.json"))
    assert cases.count() == 2
    assert sorted(r.problem for r in problems.collect()) == ["expected_missing", "id_twice", "max_results_range", "question_missing"]
