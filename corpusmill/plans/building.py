"""Registered queries over what an index is built from, and SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusmill.functions import paths as P
from corpusmill.functions import text as X
from corpusmill.operators import building as B
from corpusmill.operators import candidates as CA
from corpusmill.operators import evaluation as EV
from corpusmill.operators import files as FI
from corpusmill.plans import lift as L
from corpusmill.plans.lift import with_sql
from corpusmill.plans.queries import _ASKED, _CANDS, _HAY, _QT, _chunk_rows, _retrieved, query

col, lit = F.col, F.lit


def _parts(spark, sf_dir) -> dict:
    """Symbols, endpoints and client calls of the chunks."""
    c = _chunk_rows(spark, sf_dir)
    named = c.filter("symbol <> ''")
    first = F.regexp_extract("content", "([A-Za-z]{3,})", 1)
    return {
        "chunks": c,
        "files": L.files(spark, sf_dir).select("path", "language").distinct(),
        "symbols": named.filter("chunk_type <> 'endpoint'").select(col("chunk_id").alias("symbol_id"), "seq", "path", col("symbol").alias("name"), col("chunk_type").alias("symbol_type")),
        "endpoints": named.filter("chunk_type = 'endpoint'").select("seq", "path", lit("GET").alias("method"), F.concat(lit("/"), "symbol").alias("route"), col("symbol").alias("handler")),
        "calls": c.filter((col("chunk_type") == "text") & (first != "")).select(col("chunk_id").alias("id"), F.concat(lit("GET /"), first).alias("label")),
    }


_ID = "'{0}_' || left(sha1({1}), 10)"
_FOLDER, _FILE = _ID.format("folder", "{0}"), _ID.format("file", "{0}")
_PARTS = f"""{_HAY}, f AS (SELECT DISTINCT path, split_part(path, '/', 1) AS a, split_part(path, '/', 1) || '/' || split_part(path, '/', 2) AS b FROM files),
sym AS (SELECT chunk_id AS id, seq, path, symbol AS name, chunk_type AS type FROM hay WHERE symbol <> '' AND chunk_type <> 'endpoint'),
en AS (SELECT *, 'GET' AS method, '/' || symbol AS route, symbol AS handler, {_ID.format('endpoint', "'GET:/' || symbol")} AS eid FROM hay WHERE symbol <> '' AND chunk_type = 'endpoint'),
cl AS (SELECT chunk_id AS id, 'GET /' || regexp_extract(content, '([A-Za-z]{{3,}})', 1) AS label FROM hay WHERE chunk_type = 'text' AND regexp_extract(content, '([A-Za-z]{{3,}})', 1) <> '')"""
_GRAPH = _PARTS + f""", gn AS (SELECT {_FOLDER.format("'.'")} AS id, 'folder' AS type, 'corpus' AS label, NULL AS file_path UNION ALL SELECT DISTINCT {_FOLDER.format('a')}, 'folder', a, NULL FROM f
  UNION ALL SELECT DISTINCT {_FOLDER.format('b')}, 'folder', split_part(b, '/', 2), NULL FROM f UNION ALL SELECT {_FILE.format('path')}, 'file', split_part(path, '/', 3), path FROM f
  UNION ALL SELECT id, type, name, path FROM sym UNION ALL SELECT eid, 'endpoint', 'GET ' || arg_max(route, seq), arg_max(path, seq) FROM en GROUP BY eid UNION ALL SELECT id, 'api_call', label, NULL FROM cl),
hs AS (SELECT path, name AS handler, arg_max(id, seq) AS id FROM sym WHERE type IN ('function', 'method') GROUP BY ALL),
ge AS (SELECT DISTINCT {_FOLDER.format("'.'")} AS source, {_FOLDER.format('a')} AS target, 'contains' AS type, 0.85::DOUBLE AS confidence FROM f UNION SELECT {_FOLDER.format('a')}, {_FOLDER.format('b')}, 'contains', 0.85::DOUBLE FROM f
  UNION SELECT {_FOLDER.format('b')}, {_FILE.format('path')}, 'contains', 0.95::DOUBLE FROM f UNION SELECT {_FILE.format('path')}, id, 'defines', 0.95::DOUBLE FROM sym UNION SELECT eid, hs.id, 'exposes_endpoint', 0.9::DOUBLE FROM en JOIN hs USING (path, handler)
  UNION SELECT cl.id, min(eid), 'calls_api', 0.72::DOUBLE FROM cl JOIN en ON lower(cl.label) = lower('GET ' || en.route) GROUP BY cl.id HAVING count(*) = 1)"""
_TABLES = ["chunks", "questions", "files"]


def _built(spark, sf_dir):
    p = _parts(spark, sf_dir)
    return B.build_graph(p["files"], p["symbols"], p["endpoints"], p["calls"], "corpus")


@query(with_sql(_TABLES, f"{_GRAPH} SELECT id, type, label, file_path FROM gn"))
def built_nodes(spark, sf_dir):
    """Nodes of the graph of files, symbols, endpoints and client calls."""
    return _built(spark, sf_dir)[0].select("id", "type", "label", "file_path")


@query(with_sql(_TABLES, f"{_GRAPH} SELECT * FROM ge"))
def built_edges(spark, sf_dir):
    return _built(spark, sf_dir)[1]


@query(with_sql(_TABLES, f"{_GRAPH} SELECT (SELECT count(*) FROM f) AS files, (SELECT count(*) FROM sym) AS functions, 0::BIGINT AS classes, (SELECT count(*) FROM en) AS endpoints, (SELECT count(*) FROM hay) AS chunks, (SELECT count(*) FROM gn) AS graph_nodes"))
def overview_stats(spark, sf_dir):
    p = _parts(spark, sf_dir)
    return B.overview(p["files"], p["symbols"], p["endpoints"], p["chunks"], _built(spark, sf_dir)[0])


@query(with_sql(_TABLES, f"{_PARTS} SELECT method, route AS path, handler, (seq % 7)::DOUBLE AS confidence, seq FROM en QUALIFY row_number() OVER (PARTITION BY method, route, handler ORDER BY seq % 7 DESC, seq) = 1"))
def distinct_endpoints(spark, sf_dir):
    e = _parts(spark, sf_dir)["endpoints"]
    return B.distinct_endpoints(e.select("method", col("route").alias("path"), "handler", (col("seq") % 7).cast("double").alias("confidence"), "seq"))


@query(with_sql(_TABLES, f"{_PARTS}, b AS (SELECT seq, 'symbol_' || left(sha1('repo' || chr(31) || path || chr(31) || name || chr(31) || type), 16) AS base_id FROM sym), n AS (SELECT *, row_number() OVER (PARTITION BY base_id ORDER BY seq) AS k FROM b) SELECT seq, base_id, CASE WHEN k = 1 THEN base_id ELSE base_id || '_definition_' || k END AS id FROM n"))
def definition_ids(spark, sf_dir):
    s = _parts(spark, sf_dir)["symbols"]
    return B.definition_ids(s.select("seq", F.concat(lit("symbol_"), X.joined_hash([lit("repo"), col("path"), col("name"), col("symbol_type")])).alias("base_id")))


_OPERATIONAL = "(" + ", ".join(f"'{x}'" for x in P.OPERATIONAL) + ")"


@query(with_sql(_TABLES, f"{_PARTS}, d AS (SELECT lower(symbol) AS domain, '/api/' || symbol || '/list' AS route, method FROM en WHERE lower(symbol) NOT IN {_OPERATIONAL} AND lower(symbol) <> 'api') SELECT domain, min(route) AS route, 'GET' AS method FROM d GROUP BY domain"))
def domain_endpoints(spark, sf_dir):
    e = _parts(spark, sf_dir)["endpoints"].filter("lower(handler) <> 'api'")
    return B.domain_endpoints(e.withColumn("route", F.concat(lit("/api/"), "handler", lit("/list"))))


_ARTIFACTS = "SELECT path AS storage_key, 'file' AS artifact_type, language AS schema_version, content_hash AS sha256, size_bytes AS byte_size, seq AS record_count, seq % 2 = 0 AS required FROM files"


@query(with_sql(["files"], f"""a AS ({_ARTIFACTS} WHERE seq % 5 <> 0), b AS (SELECT storage_key, artifact_type, schema_version, sha256, CASE WHEN record_count % 9 = 0 THEN 0 ELSE byte_size END AS byte_size, record_count, required FROM ({_ARTIFACTS}) WHERE record_count % 7 <> 0)
  SELECT storage_key, CASE WHEN a.sha256 IS NULL AND a.storage_key IS NULL THEN 'not_in_manifest' WHEN b.storage_key IS NULL THEN 'not_registered' ELSE 'differs' END AS problem FROM a FULL JOIN b USING (storage_key)
  WHERE (a.storage_key IS NULL AND b.required) OR b.storage_key IS NULL OR (a.storage_key IS NOT NULL AND a.byte_size IS DISTINCT FROM b.byte_size)"""))
def artifact_mismatches(spark, sf_dir):
    """A manifest without every fifth file against a register without every seventh and with some sizes lost."""
    rows = L.files(spark, sf_dir).select(col("path").alias("storage_key"), lit("file").alias("artifact_type"), col("language").alias("schema_version"), col("content_hash").alias("sha256"), col("size_bytes").alias("byte_size"), col("seq").alias("record_count"), (col("seq") % 2 == 0).alias("required"))
    kept = rows.filter("record_count % 7 <> 0").withColumn("byte_size", F.when(col("record_count") % 9 == 0, 0).otherwise(col("byte_size")))
    return B.artifact_mismatches(rows.filter("record_count % 5 <> 0"), kept)


@query(with_sql(["chunks"], "c AS (SELECT chunk_id, sha256(content) AS h FROM chunks), o AS (SELECT chunk_id, sha256(content || CASE WHEN line % 50 = 49 THEN '!' ELSE '' END) AS h FROM chunks) SELECT 'same' AS kind, true AS matches UNION ALL SELECT 'changed', NOT EXISTS (SELECT * FROM c EXCEPT ALL SELECT * FROM o) AND NOT EXISTS (SELECT * FROM o EXCEPT ALL SELECT * FROM c)"))
def index_compatibility(spark, sf_dir):
    c = L.chunks(spark, sf_dir)
    now = c.select("chunk_id", X.content_hash(col("content")).alias("content_hash"))
    old = c.select("chunk_id", X.content_hash(F.concat("content", F.when(col("line") % 50 == 49, "!").otherwise(""))).alias("content_hash"))
    return B.index_matches(now, now).withColumn("kind", lit("same")).unionByName(B.index_matches(now, old).withColumn("kind", lit("changed")))


@query(with_sql(_TABLES, f"""{_HAY}, s AS (SELECT path, chunk_type, line, symbol, content, sha256(path || ':' || line || ':' || line || ':' || content) AS content_hash FROM hay)
  SELECT 'chunk_' || left(sha1('repo' || chr(31) || path || chr(31) || chunk_type || chr(31) || CASE WHEN symbol <> '' THEN symbol ELSE line || ':' || line END || chr(31) || content_hash), 16) AS chunk_id, content_hash FROM s"""))
def added_chunks(spark, sf_dir):
    """Chunks with digests and stable ids, from lines with white space around them."""
    c = _chunk_rows(spark, sf_dir)
    return B.chunk_rows(c.select("path", "chunk_type", F.concat(lit(" \n"), "content", lit(" ")).alias("content"), "start_line", "end_line", "symbol"), "repo").select("chunk_id", "content_hash")


_GIT = r"""urls AS (SELECT page_id, CASE page_id % 6 WHEN 0 THEN 'https://github.com/owner-' || page_id || '/repo.' || page_id || '.git' WHEN 1 THEN ' https://www.github.com/o/r/ ' WHEN 2 THEN 'http://github.com/o/r' WHEN 3 THEN 'https://github.com/o/r?x=1' WHEN 4 THEN url ELSE 'https://github.com/-o/r' END AS u,
  CASE page_id % 7 WHEN 0 THEN 'main' WHEN 1 THEN 'feature/' || page_id WHEN 2 THEN 'a..b' WHEN 3 THEN 'x.lock' WHEN 4 THEN '/a' WHEN 5 THEN NULL ELSE 'a b' END AS r FROM pages)"""


@query("WITH " + _GIT + r""" SELECT page_id, CASE WHEN page_id % 6 = 0 THEN 'owner-' || page_id || '/repo.' || page_id WHEN page_id % 6 = 1 THEN 'o/r' END AS source, coalesce(r IN ('main') OR r LIKE 'feature/%', true) AS ref_valid FROM urls""")
def git_sources(spark, sf_dir):
    """Addresses and references of git sources, of page ids."""
    p, k = L.table(spark, sf_dir, "pages"), col("page_id")
    t = k.cast("string")
    url = F.when(k % 6 == 0, F.concat(lit("https://github.com/owner-"), t, lit("/repo."), t, lit(".git"))).when(k % 6 == 1, " https://www.github.com/o/r/ ").when(k % 6 == 2, "http://github.com/o/r").when(k % 6 == 3, "https://github.com/o/r?x=1").when(k % 6 == 4, col("url")).otherwise("https://github.com/-o/r")
    ref = F.when(k % 7 == 0, "main").when(k % 7 == 1, F.concat(lit("feature/"), t)).when(k % 7 == 2, "a..b").when(k % 7 == 3, "x.lock").when(k % 7 == 4, "/a").when(k % 7 == 5, lit(None)).otherwise("a b")
    return p.select("page_id", P.git_source(url).alias("source"), P.git_ref_valid(ref).alias("ref_valid"))


_METHOD = """exactly AS (SELECT query_id, chunk_id, round(sum(1.0 / (60 + rank)), 12) AS fused, min(rank) AS r, min(s) AS s FROM cand WHERE retriever IN ('exact', 'lexical', 'symbol', 'endpoint') GROUP BY 1, 2),
hybrid AS (SELECT query_id, chunk_id, round(sum(1.0 / (60 + rank)), 12) AS fused, min(rank) AS r, min(s) AS s FROM cand GROUP BY 1, 2),
told AS (SELECT 'exact_keyword' AS method, query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY fused DESC, s, r, chunk_id) AS position FROM exactly UNION ALL SELECT 'deterministic_hybrid', query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY fused DESC, s, r, chunk_id) FROM hybrid
UNION ALL SELECT 'naive_semantic', query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY rank, chunk_id) FROM cand WHERE retriever = 'semantic')"""


@query(with_sql([*_TABLES, "file_links"], f"{_CANDS}, {_METHOD} SELECT method, query_id, chunk_id, position::INT AS position FROM told WHERE position <= 5"))
def evaluation_methods(spark, sf_dir):
    """The first five results of each question by each of the three evaluated methods."""
    return EV.methods(_retrieved(spark, sf_dir), 5).select("method", "query_id", F.substring("entity_key", 6, 100).alias("chunk_id"), "position")


@query("SELECT conv_id AS session_id, received, 6::BIGINT AS expected, CASE WHEN most > 500 THEN 'too_large' WHEN received = 6 THEN 'complete' WHEN received > 6 THEN 'overflow' ELSE 'uploading' END AS state FROM (SELECT conv_id, sum(CASE WHEN conv_id % 9 = 0 THEN 600 ELSE 1 END)::BIGINT AS received, max(CASE WHEN conv_id % 9 = 0 THEN 600 ELSE 1 END) AS most FROM conversations GROUP BY 1)")
def upload_states(spark, sf_dir):
    """Conversations as upload sessions, a batch for each turn."""
    m = L.table(spark, sf_dir, "conversations")
    batches = m.select(col("conv_id").alias("session_id"), col("turn").alias("batch"), F.when(col("conv_id") % 9 == 0, 600).otherwise(1).cast("long").alias("files"))
    return B.upload_state(batches, batches.select("session_id", lit(6).cast("long").alias("files")).distinct())


@query("SELECT conv_id AS session_id, turn AS at, role AS event, (row_number() OVER (PARTITION BY conv_id ORDER BY turn, role))::INT AS position FROM conversations")
def activity_log(spark, sf_dir):
    m = L.table(spark, sf_dir, "conversations").select(col("conv_id").alias("session_id"), col("turn").alias("at"), col("role").alias("event"), F.create_map(lit("text"), "text").alias("details"))
    return B.activity(m).select("session_id", "at", "event", "position")


@query("WITH c AS (SELECT l_orderkey * 10 + l_linenumber AS call_id, l_partkey % 4 AS a, l_partkey % 3 AS b FROM lineitem) SELECT call_id, 'r' || b AS source, 'call_result:' || call_id AS target FROM c WHERE a < 3 UNION ALL SELECT call_id, 'r9', 'call_result:' || call_id FROM c WHERE a = 0")
def returned_values(spark, sf_dir):
    """Returns of callees bound to the results of the calls that lines of orders stand for."""
    calls = L.table(spark, sf_dir, "lineitem").select((col("l_orderkey") * 10 + col("l_linenumber")).alias("call_id"), F.concat_ws(":", (col("l_partkey") % 4).cast("string"), (col("l_partkey") % 3).cast("string")).alias("callee"))
    returns = [(f"{a}:{b}", f"r{b}") for a in range(3) for b in range(3)] + [(f"0:{b}", "r9") for b in range(3)]
    return CA.bind_returns(calls, spark.createDataFrame(returns, "callee string, node string"))


@query("WITH r AS (SELECT s_suppkey AS repository_id, CASE WHEN s_nationkey = 3 THEN 'same_fingerprint' WHEN lower(s_name) = 'supplier#000000002' THEN 'same_name' WHEN s_suppkey % 4 = 0 THEN 'same_label' END AS reason FROM supplier) SELECT repository_id, reason FROM r WHERE reason IS NOT NULL ORDER BY repository_id LIMIT 5")
def import_duplicates(spark, sf_dir):
    """Suppliers as earlier imports: the first five that may be the same."""
    s = L.table(spark, sf_dir, "supplier").select(col("s_suppkey").alias("repository_id"), col("s_nationkey").cast("string").alias("fingerprint"), col("s_name").alias("name"), F.when(col("s_suppkey") % 4 == 0, "Mine").otherwise("x").alias("label"))
    return FI.import_duplicates(s, "3", "SUPPLIER#000000002", "mine").select("repository_id", "reason")


@query("WITH " + _ASKED + " SELECT id, CASE WHEN regexp_full_match(id, 'conv_[A-Za-z0-9_-]{1,64}') THEN id END AS kept FROM (SELECT 'conv_' || replace(id, ':', '-') AS id FROM asked)")
def conversation_keys(spark, sf_dir):
    """Conversation ids of sound shape stay as they are."""
    m = L.table(spark, sf_dir, "conversations").select(F.concat(lit("conv_"), F.concat_ws("-", "conv_id", "turn")).alias("id"))
    return m.select("id", X.conversation_key(col("id")).alias("kept"))
