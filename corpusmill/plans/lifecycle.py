"""Registered queries over phases, import sessions, quarantined imports and clients, and SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusmill.operators import lifecycle as LC
from corpusmill.plans import lift as L
from corpusmill.plans.queries import query

col, lit = F.col, F.lit
#: Phases and the artifacts that they take; phase n puts out ``t{n}``.
PHASES = [(0, "scan", "v1", ["source"]), (1, "parse", "v1", ["source", "t0"]), (2, "resolve", "v1", ["t1"]), (3, "graph", "v1", ["t1", "t2"]), (4, "embed", "v1", ["t3"])]


def _sql_key(n: int, version: str, source: str) -> str:
    inputs = " || ',' || ".join(f"'{t}=' || " + (source if t == "source" else f"out{t[1]}") for t in PHASES[n][3])
    return f"sha256(run || '|{PHASES[n][1]}|' || {version} || '|cfg|' || {inputs})"


_RUNS = "r0 AS (SELECT doc_id AS run, sha256(coalesce(text, '')) AS src, CASE WHEN doc_id % 5 = 0 THEN sha256('old') ELSE sha256(coalesce(text, '')) END AS old FROM documents)" + "".join(
    f", r{n + 1} AS (SELECT *, sha256('out|' || key{n}) AS out{n} FROM (SELECT *, {_sql_key(n, f'CASE WHEN run % 7 = {n} THEN {chr(39)}v0{chr(39)} ELSE {chr(39)}v1{chr(39)} END', 'old')} AS key{n} FROM r{n}))" for n in range(5)
)
_WRONG = "CASE " + " ".join(f"WHEN run % 13 = 0 AND {n} >= 2 THEN '{n}missing_checkpoint' WHEN run % 17 = 0 AND {n} = 3 THEN '{n}other_phase' WHEN key{n} <> {_sql_key(n, chr(39) + 'v1' + chr(39), 'src')} THEN '{n}other_key' WHEN run % 11 = {n} THEN '{n}damaged_output'" for n in range(5)) + " END"


@query(f"WITH {_RUNS} SELECT run, coalesce(w[1]::INT, 5)::INT AS next_phase, array_to_string(['scan', 'parse', 'resolve', 'graph', 'embed'][:coalesce(w[1]::INT, 5)], ',') AS reused, w[2:] AS stopped_by FROM (SELECT run, {_WRONG} AS w FROM r5)")
def phase_resume(spark, sf_dir):
    """From which phase the run of each document goes on: sources that changed, older versions, damaged outputs, missing and foreign checkpoints."""
    run = col("run")
    d = L.table(spark, sf_dir, "documents").select(col("doc_id").alias("run"), F.sha2(F.coalesce("text", lit("")), 256).alias("src"))
    d = d.withColumn("old", F.when(run % 5 == 0, F.sha2(lit("old"), 256)).otherwise(col("src")))
    for n, phase, _, inputs in PHASES:
        version = F.when(run % 7 == n, "v0").otherwise("v1")
        taken = F.array(*[F.struct(lit(t).alias("type"), (col("old") if t == "source" else col(f"out{t[1]}")).alias("sha256")) for t in inputs])
        d = d.withColumn(f"key{n}", LC.phase_key(run, lit(phase), version, lit("cfg"), taken)).withColumn(f"out{n}", F.sha2(F.concat(lit("out|"), f"key{n}"), 256))
    told = F.array(*[F.struct(lit(n).alias("ordinal"), F.when((run % 17 == 0) & (lit(n) == 3), "other").otherwise(phase).alias("phase"), col(f"key{n}").alias("key"), lit(f"t{n}").alias("type"), col(f"out{n}").alias("sha256")) for n, phase, *_ in PHASES])
    points = d.select("run", F.explode(told).alias("p")).select("run", "p.*").filter("not (run % 13 = 0 and ordinal >= 2)")
    stored = points.select("run", "type", F.when(run % 11 == col("ordinal"), "damaged").otherwise(col("sha256")).alias("sha256"))
    initial = d.select("run", lit("source").alias("type"), col("src").alias("sha256"))
    return LC.resume(spark.createDataFrame(PHASES, "ordinal int, phase string, version string, inputs array<string>"), initial, points, stored, lit("cfg"))


@query("""WITH e AS (SELECT DISTINCT ON (event_id) user_id, event_id, ts, event_type FROM events), g AS (SELECT *, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 6 HOUR THEN 0 ELSE 1 END AS n FROM e),
s AS (SELECT *, sum(n) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, min(ts) AS opened, max(ts) + INTERVAL 6 HOUR AS expires, count(*) AS events, count(*) FILTER (event_type IN ('view', 'click')) AS files, count(*) FILTER (event_type = 'error') AS failed,
  CASE WHEN bool_or(event_type = 'signup') THEN 'cancelled' WHEN bool_or(event_type = 'purchase') THEN 'confirmed' WHEN count(*) FILTER (event_type IN ('view', 'click')) = 0 AND count(*) FILTER (event_type = 'error') > 0 THEN 'failed' ELSE 'expired' END AS status FROM s GROUP BY user_id, k""")
def import_sessions(spark, sf_dir):
    """Sessions of all users' events, by how they end."""
    return LC.import_sessions(L.table(spark, sf_dir, "events"))


_BROKEN = """ra AS (SELECT r_regionkey AS k FROM region WHERE r_regionkey <> 4), na0 AS (SELECT n_nationkey AS k, n_regionkey AS f FROM nation),
na AS (SELECT k, CASE WHEN f NOT IN (SELECT k FROM ra) THEN 'missing:n_regionkey' END AS r FROM na0),
cu AS (SELECT c.k, CASE WHEN f IS NULL THEN 'null:c_nationkey' WHEN n.k IS NULL THEN 'missing:c_nationkey' WHEN n.r IS NOT NULL THEN 'refused:c_nationkey' END AS r FROM (SELECT c_custkey AS k, CASE WHEN c_custkey % 50 = 7 THEN NULL WHEN c_custkey % 60 = 11 THEN 99 ELSE c_nationkey END AS f FROM customer) c LEFT JOIN na n ON n.k = c.f),
os AS (SELECT o_orderkey - CASE WHEN o_orderkey % 1000 = 501 THEN 1 ELSE 0 END AS k, o_custkey AS f FROM orders),
od AS (SELECT o.k, CASE WHEN count(*) OVER (PARTITION BY o.k) > 1 THEN 'duplicate_key' WHEN c.k IS NULL THEN 'missing:o_custkey' WHEN c.r IS NOT NULL THEN 'refused:o_custkey' END AS r FROM os o LEFT JOIN cu c ON c.k = o.f),
li AS (SELECT l.k, CASE WHEN count(*) OVER (PARTITION BY l.k) > 1 THEN 'duplicate_key' WHEN o.k IS NULL THEN 'missing:l_orderkey' WHEN o.r IS NOT NULL THEN 'refused:l_orderkey' WHEN p.p_partkey IS NULL THEN 'missing:l_partkey' END AS r
  FROM (SELECT l_orderkey * 10 + l_linenumber AS k, l_orderkey, l_partkey + CASE WHEN l_orderkey % 400 = 3 THEN 100000000 ELSE 0 END AS l_partkey FROM lineitem) l LEFT JOIN (SELECT k, max(r) AS r FROM od GROUP BY k) o ON o.k = l.l_orderkey LEFT JOIN part p ON p.p_partkey = l.l_partkey)"""


@query(f"WITH {_BROKEN} SELECT 'nation' AS \"table\", k::VARCHAR AS key, r AS reason FROM na WHERE r IS NOT NULL UNION ALL SELECT 'customer', k::VARCHAR, r FROM cu WHERE r IS NOT NULL UNION ALL SELECT 'orders', k::VARCHAR, r FROM od WHERE r IS NOT NULL UNION ALL SELECT 'lineitem', k::VARCHAR, r FROM li WHERE r IS NOT NULL")
def refused_rows(spark, sf_dir):
    """What an import of the star schema refuses once a region is gone and some references and keys are broken."""
    t = lambda name: L.table(spark, sf_dir, name)
    ck, ok = col("c_custkey"), col("o_orderkey")
    customer = t("customer").select("c_custkey", F.when(ck % 50 == 7, None).when(ck % 60 == 11, 99).otherwise(col("c_nationkey")).alias("c_nationkey"))
    orders = t("orders").select((ok - F.when(ok % 1000 == 501, 1).otherwise(0)).alias("o_orderkey"), "o_custkey")
    lines = t("lineitem").select((col("l_orderkey") * 10 + col("l_linenumber")).alias("l_key"), "l_orderkey", (col("l_partkey") + F.when(col("l_orderkey") % 400 == 3, 100_000_000).otherwise(0)).alias("l_partkey"))
    tables = {
        "region": (t("region").filter("r_regionkey <> 4"), "r_regionkey"), "nation": (t("nation"), "n_nationkey"), "customer": (customer, "c_custkey"), "orders": (orders, "o_orderkey"),
        "part": (t("part").select("p_partkey"), "p_partkey"), "lineitem": (lines, "l_key"),
    }
    refs = [("nation", "n_regionkey", "region"), ("customer", "c_nationkey", "nation"), ("orders", "o_custkey", "customer"), ("lineitem", "l_orderkey", "orders"), ("lineitem", "l_partkey", "part")]
    return LC.quarantine(tables, refs)[1]


@query("""WITH RECURSIVE b0 AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 97 = 0 THEN c_custkey * 2 ELSE c_custkey // 2 END AS o, CASE WHEN c_custkey % 3 = 0 THEN '/b' || (c_custkey % 10) ELSE '' END AS b FROM customer WHERE c_custkey > 0),
r AS (SELECT k, '' AS path FROM b0 WHERE k IN (1, 2, 3) UNION ALL SELECT b0.k, path || b FROM r JOIN b0 ON b0.o = r.k AND b0.k > 3)
SELECT 'f0' AS file, o_orderkey AS line, 'c' || o_custkey AS client, CASE WHEN o_orderkey % 2 = 0 THEN 'GET' ELSE 'POST' END AS method, path || CASE WHEN o_orderkey % 100 = 0 THEN CASE WHEN path = '' THEN '/' ELSE '' END ELSE '/orders/' || o_orderkey END AS route FROM orders JOIN r ON r.k = o_custkey
UNION ALL SELECT 'f1', o_orderkey, 'axios', 'GET', '/raw/' || o_orderkey FROM orders WHERE o_orderkey % 10 = 0""")
def client_calls(spark, sf_dir):
    """Calls of every order by a client that a chain of aliases, imports and base URLs leads to; every 97th chain is a loop or starts nowhere."""
    k = col("c_custkey")
    text = lambda x: x.cast("string")
    of = F.concat(lit("c"), text(F.when(k % 97 == 0, k * 2).otherwise(F.floor(k / 2))))
    names = F.concat(lit("c"), text(k))
    c = L.table(spark, sf_dir, "customer").filter("c_custkey > 0")
    # every third client is created with a base URL from a name that its file imports; files are those of the keys, f0 imports all
    home = lambda x: F.concat(lit("m"), text(x))
    first = k < 4
    bind = lambda file, name, kind, source, module, base: c.select(file.alias("file"), name.alias("name"), kind.alias("kind"), source.alias("of"), module.alias("module"), base.alias("base"), lit(1).alias("line"))
    none = lit(None).cast("string")
    brought = bind(home(k), lit("inner"), lit("import"), of, F.when(first, lit("axios")).otherwise(F.concat(lit("m"), F.substr(of, lit(2)))), none)
    made = bind(home(k), names, F.when((k % 3 == 0) & ~first, "create").otherwise("alias"), lit("inner"), none, F.when((k % 3 == 0) & ~first, F.concat(lit("https://api.local/b"), text(k % 10), lit("/"))))
    shown = bind(lit("f0"), names, lit("import"), names, home(k), none)
    o = col("o_orderkey")
    calls = L.table(spark, sf_dir, "orders").select(lit("f0").alias("file"), o.alias("line"), F.concat(lit("c"), text(col("o_custkey"))).alias("client"), F.when(o % 2 == 0, "get").otherwise("post").alias("method"), F.when(o % 100 == 0, "/").otherwise(F.concat(lit("orders/"), text(o), lit("?x=1"))).alias("route"))
    raw = L.table(spark, sf_dir, "orders").filter(o % 10 == 0).select(lit("f1"), o, lit("axios"), lit("get"), F.concat(lit("/raw/"), text(o), lit("/")))
    return LC.client_routes(brought.union(made).union(shown), calls.union(raw))
