"""The model's tables, lifted from the star-schema tables by fixed rules that SQL can follow too.

Each rule stands twice: as a DataFrame, and in ``SQL`` as a common table expression of the
same name, from which the queries' equivalents are built.
"""

from __future__ import annotations

from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Folders, names and endings that catalogue paths are put together from.
DIRS = [
    "src/services", "backend/api/routes", "frontend/components", "docs", "tests/unit", "app/models", "node_modules/x", "src/repositories",
    "packages/core", "backend/.git", "client/pages", "jobs/workers", "",
]
NAMES = ["userService", "main", "README", "order_repository", "auth.login", "index", "OrderController", "payment-client", "latest_report", "secrets.prod", "health"]
ENDS = [".py", ".ts", ".md", ".java", ".json", ".tsx", "", ".pem", ".unknown"]
ROLES = ["parameter", "definition", "use", None]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """seq, path, language, size_bytes, content_hash, content: one file for each document."""
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("seq"),
        F.concat_ws("/", "lang", "source", F.concat(F.lit("doc_"), F.col("doc_id").cast("string"), F.lit(".txt"))).alias("path"),
        F.col("lang").alias("language"),
        F.col("n_chars").alias("size_bytes"),
        F.sha2("text", 256).alias("content_hash"),
        F.col("text").alias("content"),
    )


def catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """seq, path, size_bytes, content: files under telling paths; content is a document's text."""
    pick = lambda items, div: F.element_at(F.array(*map(F.lit, items)), (F.floor(F.col("doc_id") / div) % len(items) + 1).cast("int"))
    folder = pick(DIRS, 1)
    base = F.concat(pick(NAMES, 3), F.when(F.col("doc_id") % 5 == 0, F.concat(F.lit("_"), F.col("doc_id").cast("string"))).otherwise(""), pick(ENDS, 7))
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("seq"),
        F.when(folder == "", base).otherwise(F.concat(folder, F.lit("/"), base)).alias("path"),
        (F.col("n_chars") * 400).alias("size_bytes"),
        F.col("text").alias("content"),
    )


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """chunk_id, seq, path, line, content: the lines of documents that aren't blank."""
    lines = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", F.posexplode(F.split("text", "\n")).alias("line", "content"))
    path = F.concat_ws("/", "lang", "source", F.concat(F.lit("doc_"), F.col("doc_id").cast("string"), F.lit(".txt")))
    kept = lines.withColumn("content", F.trim("content")).filter("content <> ''").select("doc_id", path.alias("path"), (F.col("line") + 1).alias("line"), "content")
    ident = F.concat(F.lit("chunk_"), F.substring(F.sha1(F.concat_ws(":", "path", F.col("line").cast("string"), "content")), 1, 16))
    return kept.select(ident.alias("chunk_id"), (F.col("doc_id") * 100_000 + F.col("line")).alias("seq"), "doc_id", "path", "line", "content")


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """query_id, query: the first six words of each benchmark passage."""
    words = F.slice(F.filter(F.split("text", r"\s+"), lambda w: w != ""), 1, 6)
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.array_join(words, " ").alias("query"))


def _holding(passages: list[tuple[int, str]]):
    """Rows (doc_id, text) to (query_id, doc_id). A text that holds a passage has each of its inner words whole: the one that fewest passages have, the longest of such, leads to it."""
    words = [(q, p, p.split()[1:-1]) for q, p in passages]
    often = Counter(w for *_, ws in words for w in set(ws))
    by: dict[str, list[tuple[int, str]]] = {}
    for q, p, ws in words:
        by.setdefault(min(ws, key=lambda w: (often[w], -len(w), w), default=""), []).append((q, p))
    short = by.pop("", [])
    keys = by.keys()

    def run(batches):
        for b in batches:
            found = []
            for doc, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
                for some in (short, *(by[w] for w in keys & set(text.split()))):
                    found += [(q, doc) for q, p in some if p in text]
            yield pa.RecordBatch.from_arrays([pa.array([q for q, _ in found], pa.int64()), pa.array([d for _, d in found], pa.int64())], ["query_id", "doc_id"])

    return run


def relevance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """query_id, doc_id: documents that hold a whole passage. The passages, a stated set, go to all tasks."""
    passages = [(r.item_id, r.text) for r in table(spark, sf_dir, "benchmark").filter("text is not null").collect()]
    return table(spark, sf_dir, "documents").filter("text is not null").select("doc_id", "text").mapInArrow(_holding(passages), "query_id long, doc_id long")


def file_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """source, target: each document's file imports that of the document 40 before it and that of half its id."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.concat_ws("/", "lang", "source", F.concat(F.lit("doc_"), F.col("doc_id").cast("string"), F.lit(".txt"))).alias("path"))
    ends = docs.select(F.col("path").alias("source"), F.explode(F.array((F.col("doc_id") - 40).cast("long"), F.floor(F.col("doc_id") / 2).cast("long"))).alias("doc_id"))
    return ends.join(docs.withColumnRenamed("path", "target"), "doc_id").select("source", "target")


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, type, label, file_path, role, start_line: places, customers, orders, parts and suppliers as a property graph."""
    t = lambda name: table(spark, sf_dir, name)
    text = lambda c: F.col(c).cast("string")

    def part(df: DataFrame, prefix: str, key: str, kind, label, path, role=None) -> DataFrame:
        return df.select(
            F.concat(F.lit(prefix), text(key)).alias("id"), kind.alias("type"), label.alias("label"), path.alias("file_path"),
            (role if role is not None else F.lit(None).cast("string")).alias("role"), (F.col(key) % 50).cast("int").alias("start_line"),
        )

    role = F.element_at(F.array(*map(F.lit, ROLES[:3])), (F.col("l_orderkey") % 4 + 1).cast("int"))
    value = t("lineitem").withColumn("k", F.col("l_orderkey") * 10 + F.col("l_linenumber"))
    value = value.withColumn("vrole", F.when(F.col("l_orderkey") % 4 < 3, F.try_element_at(F.array(*map(F.lit, ROLES[:3])), (F.col("l_orderkey") % 4 + 1).cast("int"))))
    del role
    rows = [
        part(t("region"), "r", "r_regionkey", F.lit("folder"), F.col("r_name"), F.lit(None).cast("string")),
        part(t("nation"), "n", "n_nationkey", F.lit("file"), F.col("n_name"), F.concat(F.lit("src/nation/"), text("n_nationkey"), F.lit(".py"))),
        part(t("customer"), "c", "c_custkey", F.when(F.col("c_custkey") % 3 == 0, "method").otherwise("function"), F.col("c_name"), F.concat(F.lit("src/nation/"), text("c_nationkey"), F.lit(".py"))),
        part(t("orders"), "o", "o_orderkey", F.when(F.col("o_orderkey") % 2 == 0, "api_call").otherwise("call_site"), F.concat(F.lit("GET /orders/"), text("o_orderkey")), F.concat(F.lit("client/"), text("o_custkey"), F.lit(".ts"))),
        part(t("part"), "p", "p_partkey", F.lit("endpoint"), F.concat(F.lit("GET /parts/"), text("p_partkey")), F.concat(F.lit("src/nation/"), (F.col("p_partkey") % 25).cast("string"), F.lit(".py")), F.when(F.col("p_partkey") % 40 == 0, "Entrypoint")),
        part(t("supplier"), "s", "s_suppkey", F.lit("module"), F.col("s_name"), F.concat(F.lit("lib/"), text("s_suppkey"), F.lit(".py"))),
        part(value, "v", "k", F.lit("dfg_node"), F.concat(F.lit("use:"), F.col("l_returnflag")), F.concat(F.lit("src/nation/"), (F.col("l_orderkey") % 25).cast("string"), F.lit(".py")), F.col("vrole")),
    ]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """seq, source, target, type, confidence, evidence_level; some ends are missing, and some edges come twice."""
    t = lambda name: table(spark, sf_dir, name)
    end = lambda prefix, c: F.concat(F.lit(prefix), c.cast("string"))

    def part(df: DataFrame, block: int, key, source, target, kind) -> DataFrame:
        seq = F.lit(block * 10**12).cast("long") + key
        return df.select(
            seq.alias("seq"), source.alias("source"), target.alias("target"), kind.alias("type"),
            ((key % 50 + 50) / 100).alias("confidence"),
            F.element_at(F.array(*map(F.lit, ["map", "deep", "inferred"])), (key % 3 + 1).cast("int")).alias("evidence_level"),
        )

    line = t("lineitem").withColumn("k", F.col("l_orderkey") * 10 + F.col("l_linenumber"))
    col = F.col
    calls = F.element_at(F.array(*map(F.lit, ["calls", "calls_builtin", "calls_external", "calls_unresolved"])), (col("o_orderkey") % 4 + 1).cast("int"))
    value = t("lineitem").select("l_orderkey", "l_linenumber", (col("l_orderkey") * 10 + col("l_linenumber")).alias("k"))
    rows = [
        part(t("nation"), 1, col("n_nationkey").cast("long"), end("r", col("n_regionkey")), end("n", col("n_nationkey")), F.lit("contains")),
        part(t("customer"), 2, col("c_custkey"), end("n", col("c_nationkey")), end("c", col("c_custkey")), F.lit("defines")),
        part(t("orders"), 3, col("o_orderkey"), end("c", col("o_custkey")), end("o", col("o_orderkey")), F.lit("contains_call")),
        part(t("orders"), 4, col("o_orderkey"), end("c", col("o_custkey")), end("c", col("o_custkey") * 7 % 977 + 1), calls),
        part(line, 5, col("k"), end("o", col("l_orderkey")), end("p", col("l_partkey")), F.lit("calls_api")),
        part(line, 6, col("k"), end("p", col("l_partkey")), end("s", col("l_suppkey")), F.when(col("l_orderkey") % 3 == 0, "exposes_endpoint").otherwise("imports_internal")),
        part(t("supplier"), 7, col("s_suppkey"), end("s", col("s_suppkey")), end("n", col("s_nationkey") + 3), F.lit("imports")),
        part(value, 8, col("k"), end("v", col("k")), end("v", col("k") + 1), F.when(col("l_orderkey") % 3 == 0, "dfg_argument_to_parameter").otherwise("dfg_reaches")),
        part(t("supplier"), 9, col("s_suppkey"), end("s", col("s_suppkey")), end("s", col("s_suppkey") * 13 % 97 + 1), F.lit("imports_internal")),
    ]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out


def snapshots(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Fingerprints (file_key, path, six hashes, byte_size) of a corpus before and after a change."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "text", "n_chars")

    def prints(df: DataFrame, salt, moved) -> DataFrame:
        path = F.concat_ws("/", F.when(moved, F.concat(F.lit("moved/"), F.col("lang"))).otherwise(F.col("lang")), "source", F.col("doc_id").cast("string"))
        h = lambda kind, s: F.sha2(F.concat_ws("|", F.lit(kind), s, "text"), 256)
        return df.select(
            F.concat(F.lit("file:v1:"), path).alias("file_key"), path.alias("path"),
            F.sha2(F.concat(salt, F.col("text")), 256).alias("content_sha256"), h("norm", salt).alias("normalized_sha256"),
            h("doc", F.when(F.col("doc_id") % 3 == 0, salt).otherwise("")).alias("documentation_sha256"),
            h("structure", F.when(F.col("doc_id") % 5 == 0, salt).otherwise("")).alias("structure_sha256"),
            h("api", F.when(F.col("doc_id") % 10 == 0, salt).otherwise("")).alias("public_api_sha256"), h("dep", F.lit("")).alias("dependency_sha256"),
            F.col("n_chars").alias("byte_size"),
        )

    before = prints(docs.filter("doc_id % 11 <> 0"), F.lit(""), F.lit(False))
    after = prints(docs.filter("doc_id % 13 <> 0"), F.when(F.col("doc_id") % 7 == 0, "changed").otherwise(""), F.col("doc_id") % 17 == 0)
    return before, after


def dependencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """source_file_key, target_file_key, relation: each file of the later snapshot depends on that of the document before and of half its id."""
    docs = table(spark, sf_dir, "documents").filter("doc_id % 13 <> 0")
    key = lambda p: F.concat(F.lit("file:v1:"), F.concat_ws("/", F.when(F.col(f"{p}doc_id") % 17 == 0, F.concat(F.lit("moved/"), F.col(f"{p}lang"))).otherwise(F.col(f"{p}lang")), f"{p}source", F.col(f"{p}doc_id").cast("string")))
    a = docs.select("doc_id", "lang", "source", F.explode(F.array((F.col("doc_id") - 40).cast("long"), F.floor(F.col("doc_id") / 2).cast("long"))).alias("on"))
    b = docs.select(F.col("doc_id").alias("t_doc_id"), F.col("lang").alias("t_lang"), F.col("source").alias("t_source"))
    both = a.join(b, (F.col("on") == F.col("t_doc_id")) & (F.col("doc_id") != F.col("on")))
    return both.select(key("").alias("source_file_key"), key("t_").alias("target_file_key"), F.lit("imports").alias("relation")).distinct()


_PATH = "lang || '/' || source || '/doc_' || doc_id || '.txt'"


def _listed(items: list[str]) -> str:
    return "[" + ", ".join("'" + x + "'" for x in items) + "]"


def _pick(items: list[str], div: int) -> str:
    return f"{_listed(items)}[(doc_id // {div}) % {len(items)} + 1]"


_BASE = f"({_pick(NAMES, 3)} || CASE WHEN doc_id % 5 = 0 THEN '_' || doc_id ELSE '' END || {_pick(ENDS, 7)})"


def _node(prefix: str, key: str, kind: str, label: str, path: str, source: str, role: str = "NULL::VARCHAR") -> str:
    return f"SELECT '{prefix}' || {key} AS id, {kind} AS type, {label} AS label, {path} AS file_path, {role} AS role, ({key} % 50)::INT AS start_line FROM {source}"


def _edge(block: int, key: str, source: str, target: str, kind: str, rows: str) -> str:
    return (
        f"SELECT {block * 10**12}::BIGINT + {key} AS seq, {source} AS source, {target} AS target, {kind} AS type, ({key} % 50 + 50) / 100 AS confidence, "
        f"['map', 'deep', 'inferred'][{key} % 3 + 1] AS evidence_level FROM {rows}"
    )


_VALUES = "(SELECT *, l_orderkey * 10 + l_linenumber AS k FROM lineitem)"


def _prints(where: str, salt: str, moved: str) -> str:
    path = f"(CASE WHEN {moved} THEN 'moved/' || lang ELSE lang END || '/' || source || '/' || doc_id)"
    h = lambda kind, s: f"sha256('{kind}|' || ({s}) || '|' || text)"
    when = lambda n: f"CASE WHEN doc_id % {n} = 0 THEN {salt} ELSE '' END"
    return (
        f"SELECT 'file:v1:' || {path} AS file_key, {path} AS path, sha256({salt} || text) AS content_sha256, {h('norm', salt)} AS normalized_sha256, "
        f"{h('doc', when(3))} AS documentation_sha256, {h('structure', when(5))} AS structure_sha256, {h('api', when(10))} AS public_api_sha256, "
        f"{h('dep', chr(39) * 2)} AS dependency_sha256, n_chars AS byte_size FROM documents WHERE {where}"
    )


def _key(p: str) -> str:
    return f"'file:v1:' || CASE WHEN {p}.doc_id % 17 = 0 THEN 'moved/' || {p}.lang ELSE {p}.lang END || '/' || {p}.source || '/' || {p}.doc_id"


SQL = {
    "files": f"SELECT doc_id AS seq, {_PATH} AS path, lang AS language, n_chars AS size_bytes, sha256(text) AS content_hash, text AS content FROM documents",
    "catalogue": f"SELECT doc_id AS seq, CASE WHEN {_pick(DIRS, 1)} = '' THEN {_BASE} ELSE {_pick(DIRS, 1)} || '/' || {_BASE} END AS path, n_chars * 400 AS size_bytes, text AS content FROM documents",
    "chunks": f"""SELECT 'chunk_' || left(sha1(path || ':' || line || ':' || content), 16) AS chunk_id, doc_id * 100000 + line AS seq, doc_id, path, line, content
  FROM (SELECT doc_id, {_PATH} AS path, line, trim(c) AS content FROM (SELECT *, unnest(string_split(text, chr(10))) AS c, generate_subscripts(string_split(text, chr(10)), 1)::INT AS line FROM documents)) WHERE content <> ''""",
    "questions": r"SELECT item_id AS query_id, array_to_string(list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '')[1:6], ' ') AS query FROM benchmark",
    "file_links": f"SELECT a.path AS source, b.path AS target FROM (SELECT {_PATH} AS path, unnest([doc_id - 40, doc_id // 2]) AS tgt FROM documents) a JOIN (SELECT doc_id, {_PATH} AS path FROM documents) b ON a.tgt = b.doc_id",
    "relevance": "SELECT item_id AS query_id, doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text)",
    "nodes": " UNION ALL ".join(
        [
            _node("r", "r_regionkey", "'folder'", "r_name", "NULL::VARCHAR", "region"),
            _node("n", "n_nationkey", "'file'", "n_name", "'src/nation/' || n_nationkey || '.py'", "nation"),
            _node("c", "c_custkey", "CASE WHEN c_custkey % 3 = 0 THEN 'method' ELSE 'function' END", "c_name", "'src/nation/' || c_nationkey || '.py'", "customer"),
            _node("o", "o_orderkey", "CASE WHEN o_orderkey % 2 = 0 THEN 'api_call' ELSE 'call_site' END", "'GET /orders/' || o_orderkey", "'client/' || o_custkey || '.ts'", "orders"),
            _node("p", "p_partkey", "'endpoint'", "'GET /parts/' || p_partkey", "'src/nation/' || (p_partkey % 25) || '.py'", "part", "CASE WHEN p_partkey % 40 = 0 THEN 'Entrypoint' END"),
            _node("s", "s_suppkey", "'module'", "s_name", "'lib/' || s_suppkey || '.py'", "supplier"),
            _node("v", "k", "'dfg_node'", "'use:' || l_returnflag", "'src/nation/' || (l_orderkey % 25) || '.py'", _VALUES, "['parameter', 'definition', 'use'][l_orderkey % 4 + 1]"),
        ]
    ),
    "edges": " UNION ALL ".join(
        [
            _edge(1, "n_nationkey", "'r' || n_regionkey", "'n' || n_nationkey", "'contains'", "nation"),
            _edge(2, "c_custkey", "'n' || c_nationkey", "'c' || c_custkey", "'defines'", "customer"),
            _edge(3, "o_orderkey", "'c' || o_custkey", "'o' || o_orderkey", "'contains_call'", "orders"),
            _edge(4, "o_orderkey", "'c' || o_custkey", "'c' || (o_custkey * 7 % 977 + 1)", "['calls', 'calls_builtin', 'calls_external', 'calls_unresolved'][o_orderkey % 4 + 1]", "orders"),
            _edge(5, "k", "'o' || l_orderkey", "'p' || l_partkey", "'calls_api'", _VALUES),
            _edge(6, "k", "'p' || l_partkey", "'s' || l_suppkey", "CASE WHEN l_orderkey % 3 = 0 THEN 'exposes_endpoint' ELSE 'imports_internal' END", _VALUES),
            _edge(7, "s_suppkey", "'s' || s_suppkey", "'n' || (s_nationkey + 3)", "'imports'", "supplier"),
            _edge(8, "k", "'v' || k", "'v' || (k + 1)", "CASE WHEN l_orderkey % 3 = 0 THEN 'dfg_argument_to_parameter' ELSE 'dfg_reaches' END", _VALUES),
            _edge(9, "s_suppkey", "'s' || s_suppkey", "'s' || (s_suppkey * 13 % 97 + 1)", "'imports_internal'", "supplier"),
        ]
    ),
    "before": _prints("doc_id % 11 <> 0", "''", "false"),
    "after": _prints("doc_id % 13 <> 0", "CASE WHEN doc_id % 7 = 0 THEN 'changed' ELSE '' END", "doc_id % 17 = 0"),
    "dependencies": f"""SELECT DISTINCT {_key('a')} AS source_file_key, {_key('b')} AS target_file_key, 'imports' AS relation
  FROM (SELECT *, unnest([doc_id - 40, doc_id // 2]) AS tgt FROM documents WHERE doc_id % 13 <> 0) a JOIN (SELECT * FROM documents WHERE doc_id % 13 <> 0) b ON a.tgt = b.doc_id AND a.doc_id <> b.doc_id""",
}


def with_sql(names: list[str], body: str) -> str:
    """``body`` after the common table expressions of the lifted tables it names; it may go on with more of them."""
    return "WITH RECURSIVE " + ",\n".join(f"{n} AS ({SQL[n]})" for n in names) + (",\n" if body.lstrip()[:6].upper() != "SELECT" else "\n") + body
