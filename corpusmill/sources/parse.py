"""Files parsed into rows: symbols, imports, calls, endpoints, control and value flow.

A parser takes one file and gives many rows, so it runs as a function over batches of files;
files are independent and a failing one becomes a diagnostic row.
"""

from __future__ import annotations

import ast
import builtins
import re
import sys
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

ROWS = "path string, kind string, name string, owner string, start_line int, end_line int, detail string, ordinal int"
FRAMEWORKS = ("fastapi", "flask", "django", "sqlalchemy", "pydantic", "requests", "pytest", "numpy", "pandas")
STANDARD = tuple(sorted(n for n in sys.stdlib_module_names if not n.startswith("_")))
BUILTIN = tuple(sorted(n for n in dir(builtins) if not n.startswith("_")))
HTTP = ("get", "post", "put", "delete", "patch", "options", "head")


def _dotted(node: ast.AST) -> str | None:
    if isinstance(node, ast.Name):
        return node.id
    if isinstance(node, ast.Attribute):
        base = _dotted(node.value)
        return f"{base}.{node.attr}" if base else None
    return None


def _endpoint(deco: ast.expr) -> list[tuple[str, str, float]]:
    """(method, route, confidence) of a decorator that registers a route."""
    if not isinstance(deco, ast.Call) or not isinstance(deco.func, ast.Attribute):
        return []
    route = next((a.value for a in [*deco.args, *(k.value for k in deco.keywords if k.arg in ("path", "rule"))] if isinstance(a, ast.Constant) and isinstance(a.value, str)), None)
    if route is None or not route.startswith("/"):
        return []
    base = (_dotted(deco.func.value) or "").rsplit(".", 1)[-1]
    if deco.func.attr == "route":
        given = next((k.value for k in deco.keywords if k.arg == "methods"), None)
        try:
            methods = [str(m).upper() for m in ast.literal_eval(given)] if given is not None else ["GET"]
        except (ValueError, SyntaxError):
            methods = ["GET"]
        return [(m, route, 0.88) for m in methods]
    if deco.func.attr in HTTP:
        return [(deco.func.attr.upper(), route, 0.9 if base in ("app", "router", "api") or base.endswith("router") else 0.55)]
    return []


class _Walk(ast.NodeVisitor):
    def __init__(self):
        self.rows: list[tuple] = []
        self.owners: list[str] = []

    def add(self, kind, name, node, detail=None, owner=None):
        self.rows.append((kind, name, ".".join(self.owners) if owner is None else owner, getattr(node, "lineno", 1), getattr(node, "end_lineno", None) or getattr(node, "lineno", 1), detail))

    def visit_Import(self, node):
        for a in node.names:
            self.add("import", a.name, node, a.asname)

    def visit_ImportFrom(self, node):
        module = "." * node.level + (node.module or "")
        for a in node.names:
            self.add("import", module, node, a.name + (f" as {a.asname}" if a.asname else ""))

    def visit_ClassDef(self, node):
        self.add("class", node.name, node, ",".join(filter(None, map(_dotted, node.bases))))
        self.owners.append(node.name)
        self.generic_visit(node)
        self.owners.pop()

    def _function(self, node):
        inside = self.rows_kind(self.owners)
        args = [a.arg for a in [*node.args.posonlyargs, *node.args.args, *([node.args.vararg] if node.args.vararg else []), *node.args.kwonlyargs, *([node.args.kwarg] if node.args.kwarg else [])]]
        self.add("method" if inside else "function", node.name, node, f"{node.name}({', '.join(args)})")
        for d in node.decorator_list:
            for method, route, sure in _endpoint(d):
                self.add("endpoint", route, node, f"{method} {sure}", owner=node.name)
        self.owners.append(node.name)
        self.generic_visit(node)
        self.owners.pop()

    visit_FunctionDef = visit_AsyncFunctionDef = _function

    def rows_kind(self, owners) -> bool:
        """Whether the innermost owner is a class."""
        return bool(owners) and any(k == "class" and n == owners[-1] for k, n, *_ in reversed(self.rows))

    def visit_Call(self, node):
        name = _dotted(node.func)
        if name:
            self.add("call", name, node, str(len(node.args)))
        self.generic_visit(node)


def parse_python(text: str) -> list[tuple]:
    """(kind, name, owner, start_line, end_line, detail) rows of a module, or one ``diagnostic``."""
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError, MemoryError) as e:
        return [("diagnostic", "syntax_error", "", getattr(e, "lineno", None) or 1, getattr(e, "lineno", None) or 1, str(e)[:200])]
    walk = _Walk()
    try:
        walk.visit(tree)
    except RecursionError:
        return [("diagnostic", "too_deep", "", 1, 1, "nested too deeply")]
    return walk.rows


_JS_FUNCTION = re.compile(r"^[ \t]*(?:export\s+)?(?:default\s+)?(?:async\s+)?function\s*\*?\s*([A-Za-z_$][\w$]*)\s*\(|^[ \t]*(?:export\s+)?(?:const|let|var)\s+([A-Za-z_$][\w$]*)\s*=\s*(?:async\s*)?(?:\([^)\n]*\)|[A-Za-z_$][\w$]*)\s*=>", re.M)
_JS_CLASS = re.compile(r"^[ \t]*(?:export\s+)?(?:default\s+)?class\s+([A-Za-z_$][\w$]*)", re.M)
_JS_IMPORT = re.compile(r"""^[ \t]*import\s[^'"\n]*['"]([^'"\n]+)['"]|\brequire\(\s*['"]([^'"\n]+)['"]\s*\)""", re.M)
_JS_CLIENT = re.compile(r"""\b([A-Za-z_$][\w$]*)\.(get|post|put|delete|patch|options|head)\s*(?:<[^>()]*>)?\(\s*(['"`])([^'"`\n]+)\3""")
_JS_FETCH = re.compile(r"""\bfetch\(\s*(['"`])([^'"`\n]+)\1""")
_JS_METHOD = re.compile(r"""method\s*:\s*['"]([A-Za-z]+)['"]""")
CLIENTS = ("axios", "api", "client", "http", "request", "apiClient", "httpClient")


def parse_javascript(text: str) -> list[tuple]:
    """Functions, components, classes, imports and client calls of a script, by patterns."""
    line = lambda at: text.count("\n", 0, at) + 1
    rows = []
    for m in _JS_FUNCTION.finditer(text):
        name, at = m[1] or m[2], line(m.start(1) if m[1] else m.start(2))
        rows.append(("component" if name[0].isupper() else "function", name, "", at, min(at + 12, text.count("\n") + 1), None))
    rows += [("class", m[1], "", line(m.start(1)), line(m.start(1)), None) for m in _JS_CLASS.finditer(text)]
    rows += [("import", m[1] or m[2], "", line(m.start()), line(m.start()), None) for m in _JS_IMPORT.finditer(text)]
    for m in _JS_CLIENT.finditer(text):
        if m[1] in CLIENTS or m[1].lower().endswith(("client", "api")):
            rows.append(("api_call", f"{m[2].upper()} {m[4]}", "", line(m.start()), line(m.start()), m[1]))
    for m in _JS_FETCH.finditer(text):
        near = _JS_METHOD.search(text, m.end(), m.end() + 400)
        rows.append(("api_call", f"{near[1].upper() if near else 'GET'} {m[2]}", "", line(m.start()), line(m.start()), "fetch"))
    return sorted(rows, key=lambda r: (r[3], r[0], r[1]))


_GO_FUNCTION = re.compile(r"^func\s+(?:\([^)]*\)\s*)?([A-Za-z_]\w*)\s*\(", re.M)


def parse_go(text: str) -> list[tuple]:
    """Functions, ended by counting braces."""
    rows = []
    for m in _GO_FUNCTION.finditer(text):
        depth, end = 0, len(text)
        for at in range(m.end(), len(text)):
            depth += (text[at] == "{") - (text[at] == "}")
            if text[at] == "}" and depth == 0:
                end = at
                break
        rows.append(("function", m[1], "", text.count("\n", 0, m.start(1)) + 1, text.count("\n", 0, end) + 1, None))
    return rows


PARSERS = {"python": parse_python, "javascript": parse_javascript, "typescript": parse_javascript, "go": parse_go}


def parse_files(files: DataFrame) -> DataFrame:
    """``ROWS`` of all files (path, language, content); a file without any row gives one chunk of the whole file.

    ``ordinal`` counts repeats of (kind, name, owner) in a file from 0.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for path, language, content in zip(frame["path"], frame["language"], frame["content"], strict=True):
                text = content or ""
                try:
                    rows = PARSERS.get(language, lambda _: [])(text)
                except Exception as e:  # one file's failure is that file's row
                    rows = [("diagnostic", "parser_failed", "", 1, 1, repr(e)[:200])]
                if not any(r[0] != "diagnostic" for r in rows) and text.strip():
                    rows.append(("chunk", path, "", 1, text.count("\n") + 1, "whole_file"))
                seen: dict = {}
                for r in rows:
                    key = r[:3]
                    out.append((path, *r, seen.get(key, 0)))
                    seen[key] = seen.get(key, 0) + 1
            if out:
                frame = pd.DataFrame(out, columns=["path", "kind", "name", "owner", "start_line", "end_line", "detail", "ordinal"])
                yield frame.astype({"start_line": "int32", "end_line": "int32", "ordinal": "int32"})

    return files.select("path", "language", "content").mapInPandas(run, ROWS)


def resolve_imports(imports: DataFrame, files: DataFrame) -> DataFrame:
    """Each import (path, name) with outcome resolved, unresolved or ambiguous, its targets, and why it has none.

    A module may be ``m.py`` or ``m/__init__.py``; leading dots climb from the file's folder (a file without a
    folder counts as its own). A target is a path that equals a candidate or ends with it after a slash: candidates are
    joined with all endings of the paths, so the join is one of equal keys. Reasons are framework_module, stdlib_module and module_not_found.
    """
    dots = F.length(F.regexp_extract("name", r"^(\.*)", 1))
    parts = F.split("path", "/")
    base = F.slice(parts, 1, F.greatest(F.greatest(F.size(parts), F.lit(2)) - F.greatest(dots, F.lit(1)), F.lit(0)))
    module = F.replace(F.regexp_replace("name", r"^\.+", ""), F.lit("."), F.lit("/"))
    full = F.when(dots > 0, F.array_join(F.concat(base, F.filter(F.array(module), lambda m: m != "")), "/")).otherwise(module)
    asked = imports.select("path", "name").distinct().withColumn("_c", F.explode(F.array(F.concat(full, F.lit(".py")), F.concat(full, F.lit("/__init__.py")))))
    p = F.split("path", "/")
    ends = files.select(F.col("path").alias("target"), F.explode(F.transform(F.sequence(F.lit(1), F.size(p)), lambda i: F.array_join(F.slice(p, i, 1000), "/"))).alias("_c"))
    found = asked.join(ends, "_c", "left").groupBy("path", "name").agg(F.array_sort(F.collect_set("target")).alias("targets"))
    n = F.size("targets")
    root = F.regexp_extract("name", r"^\.*([^.]*)", 1)
    why = F.when(n > 0, None).when(root.isin(*FRAMEWORKS), "framework_module").when(root.isin(*STANDARD), "stdlib_module").otherwise("module_not_found")
    return found.select("path", "name", F.when(n == 0, "unresolved").when(n == 1, "resolved").otherwise("ambiguous").alias("outcome"), F.array_join("targets", ",").alias("targets"), why.alias("reason"))


def resolve_calls(calls: DataFrame, symbols: DataFrame, imports: DataFrame) -> DataFrame:
    """Each call (path, name, owner, start_line) with an outcome: resolved, builtin, stdlib, framework, external, dynamic_attribute or target_not_found.

    Scopes in order, the first that has the name decides: functions and methods of the same file, by name or
    qualified name, and for ``self.x`` the class that owns the caller; builtins and imports by the
    name's first part, of several imports the last one. Standard and framework modules go by the first part of the import.
    """
    qualified = F.when(F.col("owner") == "", F.col("name")).otherwise(F.concat("owner", F.lit("."), "name"))
    known = symbols.filter(F.col("kind").isin("function", "method")).select("path", F.explode(F.array_distinct(F.array("name", qualified))).alias("_n"), F.concat("path", F.lit(":"), qualified, F.lit(":"), F.col("start_line").cast("string")).alias("target"))
    hits = known.groupBy("path", "_n").agg(F.array_sort(F.collect_set("target")).alias("t"))
    owner = F.regexp_replace("owner", r"\.?[^.]*$", "")
    look = F.when(F.col("name").startswith("self."), F.concat_ws(".", F.nullif(owner, F.lit("")), F.substr("name", F.lit(6)))).otherwise(F.col("name"))
    alias = F.coalesce(F.nullif(F.regexp_extract("detail", r"(?:^| as )(\w+)$", 1), F.lit("")), F.regexp_extract("name", r"^\.*(\w+)", 1))
    brought = imports.select("path", alias.alias("_a"), F.regexp_extract("name", r"^\.*(\w+)", 1).alias("_m"), "start_line").groupBy("path", "_a").agg(F.max_by("_m", F.struct("start_line", "_m")).alias("_m"))
    first = F.regexp_extract("name", r"^(\w+)", 1)
    rows = calls.withColumn("_n", look).join(hits, ["path", "_n"], "left").withColumn("_a", first).join(brought, ["path", "_a"], "left")
    outcome = (
        F.when(F.size("t") == 1, "resolved").when(F.size("t") > 1, "ambiguous").when(F.col("_a").isin(*BUILTIN), "builtin").when(F.col("_m").isin(*FRAMEWORKS), "framework").when(F.col("_m").isin(*STANDARD), "stdlib")
        .when(F.col("_m").isNotNull(), "external").when(F.col("name").contains("."), "dynamic_attribute").otherwise("target_not_found")
    )
    return rows.select("path", "name", "owner", "start_line", outcome.alias("outcome"), F.array_join("t", ",").alias("targets"))


def references(resolved: DataFrame, kind: str) -> DataFrame:
    """References with their occurrence number among those of one caller (path, owner) and name in line order, from 0."""
    n = F.row_number().over(Window.partitionBy("path", "owner", "name").orderBy("start_line")) - 1
    return resolved.withColumns({"kind": F.lit(kind), "occurrence": n})


# --- flow ------------------------------------------------------------------------------------------------


def control_flow(text: str) -> list[tuple[str, str, str, str, float]]:
    """(function, source, target, type, confidence) edges between lines of each function: next, true, false, return, loop and exception.

    A node is ``entry``, ``exit`` or a line number.
    """
    edges: list[tuple] = []
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError):
        return []

    def block(name: str, body: list[ast.stmt], heads: list[tuple[str, str]]) -> list[tuple[str, str]]:
        """Edges of statements after ``heads`` (node, type of the edge that leaves it); the open ends."""
        for s in body:
            at = str(s.lineno)
            for node, kind in heads:
                edges.append((name, node, at, kind, 1.0))
            if isinstance(s, ast.If):
                yes = block(name, s.body, [(at, "cfg_true")])
                heads = yes + (block(name, s.orelse, [(at, "cfg_false")]) if s.orelse else [(at, "cfg_false")])
            elif isinstance(s, ast.For | ast.While | ast.AsyncFor):
                for node, _ in block(name, s.body, [(at, "cfg_loop_body")]):
                    edges.append((name, node, at, "cfg_loop_back", 0.8))
                heads = block(name, s.orelse, [(at, "cfg_false")]) if s.orelse else [(at, "cfg_false")]
            elif isinstance(s, ast.Try):
                ends = block(name, s.body, [(at, "cfg_next")])
                for h in s.handlers:
                    ends += block(name, h.body, [(at, "cfg_exception")])
                heads = block(name, s.finalbody, ends) if s.finalbody else ends
            elif isinstance(s, ast.With | ast.AsyncWith):
                heads = block(name, s.body, [(at, "cfg_next")])
            elif isinstance(s, ast.Return | ast.Raise):
                edges.append((name, at, "exit", "cfg_return" if isinstance(s, ast.Return) else "cfg_exception", 1.0 if isinstance(s, ast.Return) else 0.75))
                heads = []
            else:
                heads = [(at, "cfg_next")]
        return heads

    for node in ast.walk(tree):
        if isinstance(node, ast.FunctionDef | ast.AsyncFunctionDef):
            for end, kind in block(node.name, node.body, [("entry", "cfg_next")]):
                edges.append((node.name, end, "exit", kind, 1.0))
    return [(f, a, b, k, 0.75 if k == "cfg_exception" else c) for f, a, b, k, c in edges]


def value_flow(text: str) -> list[tuple[str, str, str, str]]:
    """(function, source, target, type) edges between values ``role:name:line`` of each function.

    A use is reached by the latest definition in line order, a parameter or an assignment; an
    assigned value is computed from the names on its right; returned names reach ``return``.
    """
    out: list[tuple] = []
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError):
        return []
    for fn in ast.walk(tree):
        if not isinstance(fn, ast.FunctionDef | ast.AsyncFunctionDef):
            continue
        latest = {a.arg: f"parameter:{a.arg}:{fn.lineno}" for a in [*fn.args.posonlyargs, *fn.args.args, *fn.args.kwonlyargs]}
        for s in sorted((x for x in ast.walk(fn) if isinstance(x, ast.Assign | ast.AugAssign | ast.AnnAssign | ast.Return | ast.Expr)), key=lambda x: (x.lineno, x.col_offset)):
            names = [n for n in ast.walk(s.value) if isinstance(n, ast.Name)] if s.value is not None else []
            uses = []
            for n in names:
                use = f"use:{n.id}:{n.lineno}"
                uses.append(use)
                if n.id in latest:
                    out.append((fn.name, latest[n.id], use, "dfg_reaches"))
            if isinstance(s, ast.Return):
                out += [(fn.name, u, f"return:{fn.name}:{s.lineno}", "dfg_returned") for u in uses]
            for target in getattr(s, "targets", None) or ([s.target] if hasattr(s, "target") else []):
                for n in ast.walk(target):
                    if isinstance(n, ast.Name):
                        made = f"definition:{n.id}:{n.lineno}"
                        out += [(fn.name, u, made, "dfg_computed_from") for u in uses]
                        latest[n.id] = made
    return list(dict.fromkeys(out))


def flows(files: DataFrame) -> DataFrame:
    """Control and value flow edges (path, function, source, target, type, confidence) of all Python files."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for path, content in zip(frame["path"], frame["content"], strict=True):
                rows += [(path, *e) for e in control_flow(content or "")]
                rows += [(path, *e, 0.9) for e in value_flow(content or "")]
            if rows:
                yield pd.DataFrame(rows, columns=["path", "function", "source", "target", "type", "confidence"])

    return files.filter("language = 'python'").select("path", "content").mapInPandas(run, "path string, function string, source string, target string, type string, confidence double")
