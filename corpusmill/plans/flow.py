"""Registered queries over flow, dependencies and resolution, and SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusmill.operators import flow as FL
from corpusmill.plans import lift as L
from corpusmill.plans.lift import with_sql
from corpusmill.plans.queries import listed, query
from corpusmill.sources import parse as P

col, lit = F.col, F.lit


@query("""WITH RECURSIVE st AS (SELECT l_orderkey AS f, l_linenumber AS n, 'v' || (l_suppkey % 3) AS d, 'v' || (l_partkey % 3) AS u, l_returnflag, l_linestatus FROM lineitem),
e AS (SELECT DISTINCT a.f, a.n AS s, b.n AS t FROM st a JOIN st b ON a.f = b.f AND (b.n = a.n + 1 OR (a.l_linestatus = 'O' AND b.n = a.n + 2) OR (a.l_returnflag = 'R' AND b.n = a.n - 2))),
r AS (SELECT st.f, e.t AS n, d AS name, st.n AS def FROM st JOIN e ON st.f = e.f AND st.n = e.s
  UNION SELECT r.f, e.t, r.name, r.def FROM r JOIN e ON e.f = r.f AND e.s = r.n WHERE NOT EXISTS (SELECT 1 FROM st WHERE st.f = r.f AND st.n = r.n AND st.d = r.name))
SELECT DISTINCT r.f AS function, name, def AS definition, r.n AS use FROM r JOIN st ON st.f = r.f AND st.n = r.n AND st.u = r.name""")
def definition_reach(spark, sf_dir):
    """Definitions that reach uses: orders are functions, their lines statements that fall through, skip one, or loop back."""
    s = L.table(spark, sf_dir, "lineitem").select(col("l_orderkey").alias("function"), col("l_linenumber").alias("node"), "l_suppkey", "l_partkey", "l_returnflag", "l_linestatus")
    to = F.array_compact(F.array(col("node") + 1, F.when(col("l_linestatus") == "O", col("node") + 2), F.when(col("l_returnflag") == "R", col("node") - 2)))
    ends = s.select("function", col("node").alias("target")).distinct()
    edges = s.select("function", col("node").alias("source"), F.explode(to).alias("target")).join(ends, ["function", "target"])
    name = lambda c: F.concat(lit("v"), (col(c) % 3).cast("string")).alias("name")
    return FL.reaching_definitions(edges, s.select("function", "node", name("l_suppkey")), s.select("function", "node", name("l_partkey")))


_SPECS = """sp AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 997 = 500 THEN 'stale' WHEN o_orderkey % 991 = 600 THEN 'failed' WHEN o_orderkey % 983 = 700 THEN 'unavailable' WHEN o_orderkey % 101 = 100 THEN 'limited' ELSE 'ready' END AS own FROM orders),
dp AS (SELECT DISTINCT k, d FROM (SELECT k, unnest([k // 2, k // 3, CASE WHEN k % 977 = 976 THEN 2 * k END, CASE WHEN k % 1499 = 1000 THEN -k END]) AS d FROM sp) WHERE d <> 0 AND (d < 0 OR d IN (SELECT k FROM sp)))"""


@query(
    f"""WITH RECURSIVE {_SPECS}, ok AS (SELECT k, d FROM dp WHERE d > 0), un AS (SELECT DISTINCT k FROM dp WHERE d < 0),
tc AS (SELECT k AS x, d AS y FROM ok UNION SELECT x, d FROM tc JOIN ok ON ok.k = tc.y), ring AS (SELECT x FROM tc WHERE x = y), stuck AS (SELECT x AS k FROM ring UNION SELECT x FROM tc WHERE y IN (SELECT x FROM ring)),
base AS (SELECT sp.k, own, own IN ('ready', 'limited') AND sp.k NOT IN (SELECT k FROM un) AS open, sp.k IN (SELECT k FROM un) AS unknown FROM sp WHERE sp.k NOT IN (SELECT k FROM stuck)),
re AS (SELECT k AS x, k AS y FROM base UNION SELECT re.x, ok.d FROM re JOIN base ON base.k = re.y AND base.own IN ('ready', 'limited') JOIN ok ON ok.k = re.y),
st AS (SELECT x AS k, CASE WHEN any_value(bx.own) IN ('stale', 'failed', 'unavailable') THEN any_value(bx.own) WHEN bool_or(b.own = 'stale') THEN 'stale' WHEN bool_or(b.own IN ('failed', 'unavailable') OR b.unknown) THEN 'unavailable'
  WHEN bool_or(b.own = 'limited') THEN 'limited' ELSE 'ready' END AS state FROM re JOIN base b ON b.k = re.y JOIN base bx ON bx.k = re.x GROUP BY x),
lv AS (SELECT k, 0 AS level FROM base WHERE k NOT IN (SELECT k FROM ok) UNION SELECT ok.k, level + 1 FROM lv JOIN ok ON ok.d = lv.k JOIN base ON base.k = ok.k),
why AS (SELECT ok.k, bool_or(state = 'stale') AS s, bool_or(state = 'failed') AS f, bool_or(state = 'unavailable') AS u, bool_or(state = 'limited') AS l FROM ok JOIN st ON st.k = ok.d GROUP BY ok.k)
SELECT 'o' || b.k AS capability, state, level::INT AS level, CASE WHEN own IN ('stale', 'failed', 'unavailable') THEN '' ELSE concat_ws(',', CASE WHEN unknown THEN 'UNKNOWN_DEPENDENCY' END, CASE WHEN s THEN 'DEPENDENCY_STALE' WHEN f THEN 'DEPENDENCY_FAILED' WHEN u THEN 'DEPENDENCY_UNAVAILABLE' WHEN l THEN 'DEPENDENCY_LIMITED' END) END AS reasons
FROM base b JOIN st USING (k) JOIN (SELECT k, max(level) AS level FROM lv GROUP BY k) USING (k) LEFT JOIN why USING (k) UNION ALL SELECT 'o' || k, 'cycle', NULL, 'DEPENDENCY_CYCLE' FROM stuck"""
)
def capability_states(spark, sf_dir):
    """States over a dependency graph of all orders: each depends on those of half and a third of its key; some on unknown ones, some in cycles."""
    k = col("k")
    o = L.table(spark, sf_dir, "orders").select(col("o_orderkey").alias("k"))
    own = F.when(k % 997 == 500, "stale").when(k % 991 == 600, "failed").when(k % 983 == 700, "unavailable").when(k % 101 == 100, "limited").otherwise("ready")
    on = o.select("k", F.explode(F.array_compact(F.array(F.floor(k / 2), F.floor(k / 3), F.when(k % 977 == 976, 2 * k), F.when(k % 1499 == 1000, -k)))).alias("d")).filter("d <> 0")
    on = on.join(o.select(k.alias("d"), lit(True).alias("_k")), "d", "left").filter("d < 0 or _k").groupBy("k").agg(F.collect_set(F.concat(lit("o"), col("d").cast("string"))).alias("depends_on"))
    name = F.concat(lit("o"), k.cast("string")).alias("capability")
    found = FL.dependency_states(o.join(on, "k", "left").select(name, "depends_on"), o.select(name, own.alias("state")))
    return found.withColumn("reasons", F.array_join("reasons", ","))


_WALK = "w{1} AS (SELECT start, o.target AS node, list_append(seen, o.target) AS seen, o.support AS support FROM (SELECT start, any_value(seen) AS seen, min({{'o': o, 'target': target, 'support': ln.support}}) AS o FROM w{0} JOIN ln ON ln.source = w{0}.node WHERE NOT list_contains(seen, target) GROUP BY start))"


@query(with_sql(["edges"], "ln AS (SELECT source, target, min(o) AS o, CASE WHEN min(o) = 0 THEN 'confirmed' ELSE 'inferred' END AS support FROM (SELECT source, target, CASE WHEN evidence_level <> 'inferred' AND confidence >= 0.75 THEN 0 ELSE 1 END AS o FROM edges WHERE source[1] = 'c' AND target[1] = 'c') GROUP BY 1, 2), w0 AS (SELECT DISTINCT source AS start, source AS node, [source] AS seen, 'confirmed' AS support FROM ln), "
    + ", ".join(_WALK.format(n, n + 1) for n in range(5)) + " " + " UNION ALL ".join(f"SELECT start, {n} AS step, node, support FROM w{n}" for n in range(6))))
def component_walks(spark, sf_dir):
    """Greedy walks of six nodes from every function along its calls, confirmed ones first."""
    e = L.edges(spark, sf_dir).filter("source like 'c%' and target like 'c%'")
    sure = (col("evidence_level") != "inferred") & (col("confidence") >= 0.75)
    links = e.select("source", "target", F.when(sure, "confirmed").otherwise("inferred").alias("support"))
    return FL.walks(e.select(col("source").alias("start")), links, [col("support") != "confirmed"])


_MODULES = """md AS (SELECT doc_id, 'pkg' || (doc_id % 7) || '/sub' || (doc_id % 3) || '/' || CASE WHEN doc_id % 10 = 0 THEN 'm' || (doc_id % 400) || '/__init__' ELSE 'm' || (doc_id % 400) END || '.py' AS path FROM documents),
im AS (SELECT DISTINCT path, unnest(['m' || ((doc_id + 1) % 400), '.m' || ((doc_id + 21) % 400), '..sub' || ((doc_id + 1) % 3) || '.m' || ((doc_id + 7) % 400), 'os.path', 'numpy', 'nowhere.m' || doc_id]) AS name FROM md)"""


@query(f"""WITH {_MODULES}, pt AS (SELECT path, name, length(name) - length(ltrim(name, '.')) AS dots, ltrim(name, '.') AS bare, string_split(path, '/') AS ps FROM im),
cd AS (SELECT path, name, bare, CASE WHEN dots = 0 THEN replace(bare, '.', '/') ELSE array_to_string(ps[:len(ps) - dots], '/') || '/' || replace(bare, '.', '/') END AS c FROM pt),
hit AS (SELECT cd.path, cd.name, any_value(bare) AS bare, list_sort(list(DISTINCT f.path) FILTER (f.path IS NOT NULL)) AS t FROM cd LEFT JOIN (SELECT DISTINCT path FROM md) f ON f.path IN (c || '.py', c || '/__init__.py') OR ends_with(f.path, '/' || c || '.py') OR ends_with(f.path, '/' || c || '/__init__.py') GROUP BY 1, 2)
SELECT path, name, CASE WHEN t IS NULL OR len(t) = 0 THEN 'unresolved' WHEN len(t) = 1 THEN 'resolved' ELSE 'ambiguous' END AS outcome, coalesce(array_to_string(t, ','), '') AS targets,
  CASE WHEN len(t) > 0 THEN NULL WHEN split_part(bare, '.', 1) IN {listed(P.FRAMEWORKS)} THEN 'framework_module' WHEN split_part(bare, '.', 1) IN ('os') THEN 'stdlib_module' ELSE 'module_not_found' END AS reason FROM hit""")
def import_outcomes(spark, sf_dir):
    """Where every import of modules that documents stand for leads: by name, relative, ambiguous, or out of the corpus."""
    d = col("doc_id")
    text = lambda c: c.cast("string")
    m = F.concat(lit("m"), text(d % 400))
    path = F.concat(lit("pkg"), text(d % 7), lit("/sub"), text(d % 3), lit("/"), F.when(d % 10 == 0, F.concat(m, lit("/__init__"))).otherwise(m), lit(".py"))
    modules = L.table(spark, sf_dir, "documents").select("doc_id", path.alias("path"))
    names = [F.concat(lit("m"), text((d + 1) % 400)), F.concat(lit(".m"), text((d + 21) % 400)), F.concat(lit("..sub"), text((d + 1) % 3), lit(".m"), text((d + 7) % 400)), lit("os.path"), lit("numpy"), F.concat(lit("nowhere.m"), text(d))]
    return P.resolve_imports(modules.select("path", F.explode(F.array(*names)).alias("name")), modules.select("path").distinct())


_CALLER = "CASE WHEN l_orderkey % 3 = 0 THEN 'Svc' || (l_orderkey % 4) || '.' ELSE '' END || 'fn_' || (l_orderkey % 20)"
_NAMES = "['fn_' || (l_partkey % 20), 'self.fn_' || (l_partkey % 20), 'print', 'os.path.join', 'np.array', 'obj.run', 'missing', 'requests.get'][l_partkey % 8 + 1]"


@query(f"""WITH sy AS (SELECT 'src/' || (o_orderkey % 5000) || '.py' AS path, 'fn_' || (o_orderkey % 20) AS name, CASE WHEN o_orderkey % 3 = 0 THEN 'Svc' || (o_orderkey % 4) || '.' ELSE '' END || 'fn_' || (o_orderkey % 20) AS q, (o_orderkey % 500)::INT AS line FROM orders),
ix AS (SELECT path, n, list_sort(list(DISTINCT path || ':' || q || ':' || line)) AS t FROM (SELECT path, name AS n, q, line FROM sy UNION SELECT path, q, q, line FROM sy) GROUP BY 1, 2),
cl AS (SELECT 'src/' || (l_orderkey % 5000) || '.py' AS path, {_CALLER} AS owner, {_NAMES} AS name, (l_orderkey * 10 + l_linenumber)::INT AS start_line FROM lineitem),
lk AS (SELECT *, CASE WHEN name LIKE 'self.%' THEN CASE WHEN contains(owner, '.') THEN split_part(owner, '.', 1) || '.' ELSE '' END || substr(name, 6) ELSE name END AS n FROM cl)
SELECT lk.path, owner, name, start_line, CASE WHEN len(t) = 1 THEN 'resolved' WHEN len(t) > 1 THEN 'ambiguous' WHEN name = 'print' THEN 'builtin' WHEN name LIKE 'np.%' OR name LIKE 'requests.%' THEN 'framework' WHEN name LIKE 'os.%' THEN 'stdlib' WHEN contains(name, '.') THEN 'dynamic_attribute' ELSE 'target_not_found' END AS outcome,
  array_to_string(t, ',') AS targets, (row_number() OVER (PARTITION BY lk.path, owner, name ORDER BY start_line) - 1)::INT AS occurrence FROM lk LEFT JOIN ix ON ix.path = lk.path AND ix.n = lk.n""")
def call_outcomes(spark, sf_dir):
    """What every call of lines in orders' functions refers to, scope by scope, and its occurrence number."""
    o, c = col("o_orderkey"), col("l_orderkey")
    text = lambda x: x.cast("string")
    path = lambda k: F.concat(lit("src/"), text(k % 5000), lit(".py")).alias("path")
    owner = lambda k: F.when(k % 3 == 0, F.concat(lit("Svc"), text(k % 4))).otherwise("")
    fn = lambda k: F.concat(lit("fn_"), text(k % 20))
    symbols = L.table(spark, sf_dir, "orders").select(path(o), F.when(o % 3 == 0, "method").otherwise("function").alias("kind"), fn(o).alias("name"), owner(o).alias("owner"), (o % 500).cast("int").alias("start_line"))
    part = fn(col("l_partkey"))
    name = F.element_at(F.array(part, F.concat(lit("self."), part), *map(lit, ["print", "os.path.join", "np.array", "obj.run", "missing", "requests.get"])), (col("l_partkey") % 8 + 1).cast("int"))
    calls = L.table(spark, sf_dir, "lineitem").select(path(c), name.alias("name"), F.concat_ws(".", F.nullif(owner(c), lit("")), fn(c)).alias("owner"), (c * 10 + col("l_linenumber")).cast("int").alias("start_line"))
    brought = spark.createDataFrame([("os.path", None), ("numpy", "np"), ("requests", None)], "name string, detail string")
    imports = symbols.select("path").distinct().crossJoin(F.broadcast(brought)).withColumn("start_line", lit(1))  # three rows
    return P.references(P.resolve_calls(calls, symbols, imports), "call").drop("kind")
