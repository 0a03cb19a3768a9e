"""Registered queries over contracts, evidence lineage, candidates and lookups, and SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusmill.functions import paths as P
from corpusmill.functions import text as X
from corpusmill.operators import architecture as A
from corpusmill.operators import assistant as AS
from corpusmill.operators import candidates as CA
from corpusmill.operators import contracts as CO
from corpusmill.operators import diff as D
from corpusmill.operators import evidence as E
from corpusmill.operators import files as FI
from corpusmill.operators import graph as G
from corpusmill.plans import lift as L
from corpusmill.plans.flow import call_outcomes
from corpusmill.plans.lift import with_sql
from corpusmill.plans.queries import ORACLES, _HAY, _QT, _TOKENS, _chunk_rows, listed, query

col, lit = F.col, F.lit


def _text(c):
    return c.cast("string")


@query(with_sql(["catalogue"], f"SELECT seq, path, list_has_any(string_split(path, '/'), [{listed(sorted(P.IGNORED_DIRS))[1:-1]}]) AS ignored FROM catalogue"))
def ignored_paths(spark, sf_dir):
    """Whether a scan passes a file over for a folder on its path."""
    return L.catalogue(spark, sf_dir).select("seq", "path", P.ignored(col("path")).alias("ignored"))


@query(with_sql(["chunks"], f"{_HAY} SELECT seq, symbol AS name, path, chunk_type AS symbol_type FROM hay WHERE symbol <> '' AND chunk_type = 'method' AND (contains(lower(symbol), 'er') OR contains(lower(path), 'er')) ORDER BY seq LIMIT 100"))
def symbol_lookup(spark, sf_dir):
    """The first hundred methods with a text in name or path."""
    rows = _chunk_rows(spark, sf_dir).filter("symbol <> ''").select("seq", col("symbol").alias("name"), "path", col("chunk_type").alias("symbol_type"))
    return FI.symbols_like(rows, "ER", "method")


@query("SELECT o_orderkey AS id, 'customer_' || (o_custkey % 40) AS owner_id FROM orders WHERE o_custkey % 40 = 7")
def authorised_rows(spark, sf_dir):
    """What one principal may see of all orders."""
    o = L.table(spark, sf_dir, "orders").select(col("o_orderkey").alias("id"), F.concat(lit("customer_"), _text(col("o_custkey") % 40)).alias("owner_id"))
    return AS.owned(o, "customer_7")


@query(with_sql(["files"], """cl AS (SELECT conv_id * 1000 + turn AS claim_id FROM conversations WHERE role = 'assistant'), ci AS (SELECT DISTINCT claim_id, unnest([claim_id % 997, claim_id % 499, claim_id % 97]) AS evidence_id FROM cl)
SELECT claim_id, evidence_id, path, (seq % 50 + 1)::INT AS start_line, (row_number() OVER (PARTITION BY claim_id ORDER BY path, seq % 50 + 1, evidence_id))::INT AS position FROM ci JOIN files ON seq = evidence_id"""))
def claim_sources(spark, sf_dir):
    """What every assistant turn's claim cites, with file and line."""
    m = L.table(spark, sf_dir, "conversations").filter("role = 'assistant'").select((col("conv_id") * 1000 + col("turn")).alias("claim_id"))
    cited = m.select("claim_id", F.explode(F.array(*[col("claim_id") % n for n in (997, 499, 97)])).alias("evidence_id")).distinct()
    return AS.evidence_of_claims(m, cited, L.files(spark, sf_dir).select(col("seq").alias("evidence_id"), "path", (col("seq") % 50 + 1).cast("int").alias("start_line")))


@query("""WITH n AS (SELECT 'n' || (o_orderkey // 4) AS id, o_orderkey AS seq, CASE o_orderkey % 4 WHEN 0 THEN 'unknown' WHEN 1 THEN 'function' ELSE 'method' END AS type, CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE o_orderstatus END AS label,
  CASE WHEN o_orderkey % 5 < 2 THEN NULL ELSE 'f' || o_custkey END AS file_path, CASE WHEN o_orderkey % 2 = 0 THEN NULL ELSE o_orderpriority END AS role, CASE WHEN o_orderkey % 6 = 0 THEN 'deep' ELSE 'mapped' END AS coverage FROM orders)
SELECT id, coalesce(arg_min(type, seq) FILTER (type <> 'unknown'), max(type)) AS type, arg_min(label, seq) FILTER (label <> '') AS label, arg_min(file_path, seq) FILTER (file_path IS NOT NULL) AS file_path, arg_min(role, seq) FILTER (role IS NOT NULL) AS role,
  coalesce(arg_min(coverage, seq) FILTER (coverage <> 'mapped'), max(coverage)) AS coverage FROM n GROUP BY id""")
def merged_node_rows(spark, sf_dir):
    """Four rows of each node made one: the first value of each attribute that says something."""
    k = col("o_orderkey")
    rows = L.table(spark, sf_dir, "orders").select(
        F.concat(lit("n"), _text(F.floor(k / 4))).alias("id"), k.alias("seq"), F.when(k % 4 == 0, "unknown").when(k % 4 == 1, "function").otherwise("method").alias("type"), F.when(k % 3 == 0, "").otherwise(col("o_orderstatus")).alias("label"),
        F.when(k % 5 >= 2, F.concat(lit("f"), _text(col("o_custkey")))).alias("file_path"), F.when(k % 2 == 1, col("o_orderpriority")).alias("role"), F.when(k % 6 == 0, "deep").otherwise("mapped").alias("coverage"), F.array(lit("t")).alias("tags"),
    )
    return G.merged_nodes(rows).drop("tags")


@query("""WITH s AS (SELECT conv_id AS query_id, turn AS candidate_id, turn % 3 <> 1 AS one, turn % 2 = 0 OR turn % 3 = 0 AS two FROM conversations)
SELECT query_id, bool_or(NOT one) AS changed FROM s WHERE two GROUP BY query_id""")
def repair_novelty(spark, sf_dir):
    """Whether a second selection of a conversation's turns has any that the first hadn't."""
    m = L.table(spark, sf_dir, "conversations").select(col("conv_id").alias("query_id"), col("turn").alias("candidate_id"))
    return E.repair_changed(m.filter("candidate_id % 3 <> 1"), m.filter("candidate_id % 2 = 0 or candidate_id % 3 = 0"))


@query(f"""SELECT 'edge' AS kind, source, targets AS target, 'calls' AS relation, 'resolver' AS producer, 0.9::DOUBLE AS confidence, occurrence, concat_ws('|', 'edge:v1', source, 'calls', targets) AS key
FROM (SELECT 'file:v1:' || path AS source, * FROM ({ORACLES["call_outcomes"]})) WHERE outcome = 'resolved'""")
def reference_edges(spark, sf_dir):
    """Edge candidates of all calls that are resolved."""
    return CA.from_references(call_outcomes(spark, sf_dir).withColumn("kind", lit("call")))


@query("SELECT doc_id AS evidence_id, doc_id % 5 AS repository_id, (doc_id % 7)::INT AS index_version, doc_id % 7 < doc_id % 5 + 2 AS stale FROM documents")
def stale_evidence(spark, sf_dir):
    """Evidence of versions before its repository's current one."""
    d = col("doc_id")
    rows = L.table(spark, sf_dir, "documents").select(d.alias("evidence_id"), (d % 5).alias("repository_id"), (d % 7).cast("int").alias("index_version"))
    return D.stale(rows, rows.select("repository_id").distinct().withColumn("index_version", (col("repository_id") + 2).cast("int")))


@query("""WITH b AS (SELECT item_id AS query_id, unnest([item_id * 3, item_id * 5 + 1, item_id * 7 + 2]) AS doc_id, (item_id % 4 + 1)::INT AS s, (item_id % 4 + 3)::INT AS e FROM benchmark), f AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL),
c AS (SELECT query_id, CASE WHEN l IS NOT NULL AND e <= len(l) THEN 24 + ceil(length(array_to_string(l[s:e], chr(10))) / 4) END AS c FROM b LEFT JOIN f USING (doc_id))
SELECT query_id, NOT bool_or(c IS NULL) AND coalesce(sum(c), 0) <= 900 AS complete, coalesce(sum(c), 0)::BIGINT AS tokens FROM c GROUP BY query_id""")
def provider_contexts(spark, sf_dir):
    """Whether all exact spans of three documents for each question fit a budget together."""
    i = col("item_id")
    doc = F.explode(F.array(i * 3, i * 5 + 1, i * 7 + 2))
    name = lambda c: F.concat(lit("d"), _text(c)).alias("path")
    blocks = L.table(spark, sf_dir, "benchmark").select(i.alias("query_id"), doc.alias("d"), (i % 4 + 1).cast("int").alias("start_line"), (i % 4 + 3).cast("int").alias("end_line")).withColumn("path", name(col("d")))
    return E.provider_context(blocks, L.table(spark, sf_dir, "documents").filter("text is not null").select(name(col("doc_id")), col("text").alias("content")), 900)


@query("""SELECT conv_id, turn, CASE WHEN turn % 4 = 0 THEN 'No indexed source answers: ' || text ELSE ['The flow passes through ', 'The main parts are described in ', 'The endpoints that match are in '][turn % 4] || array_to_string(['a' || conv_id, 'b', 'c', 'd'][:least(turn % 4 + 1, 3)], ', ') || '.' END AS answer FROM conversations""")
def grounded_answers(spark, sf_dir):
    """Answers by template for every turn, with the first three sources."""
    kind = F.element_at(F.array(*map(lit, ["code_question", "flow_tracing", "architecture_overview", "api_question"])), (col("turn") % 4 + 1).cast("int"))
    titles = F.slice(F.array(F.concat(lit("a"), _text(col("conv_id"))), lit("b"), lit("c"), lit("d")), 1, F.when(col("turn") % 4 == 0, 0).otherwise((col("turn") % 4 + 1).cast("int")))
    return L.table(spark, sf_dir, "conversations").select("conv_id", "turn", E.answer_text(kind, col("text"), titles).alias("answer"))


@query(r"""SELECT page_id, CASE WHEN r = '' THEN '/' ELSE r END AS route FROM (SELECT page_id, regexp_replace(CASE WHEN page_id % 3 = 0 THEN '/v' || page_id % 5 ELSE '' END || '/' || ltrim(regexp_replace(regexp_replace(u, '^[a-z]+://[^/]*', ''), '[?#].*$', ''), '/'), '/+$', '') AS r
FROM (SELECT page_id, url || CASE WHEN page_id % 2 = 0 THEN '/{id}' ELSE '/' END AS u FROM pages WHERE url IS NOT NULL))""")
def client_urls(spark, sf_dir):
    """Every page's URL as a client's route, with a base path and a parameter for some."""
    k = col("page_id")
    raw = F.concat("url", F.when(k % 2 == 0, "/${id}").otherwise("/"))
    return L.table(spark, sf_dir, "pages").filter("url is not null").select("page_id", X.client_route(raw, F.when(k % 3 == 0, F.concat(lit("/v"), _text(k % 5), lit("//")))).alias("route"))


@query(f"WITH t AS (SELECT doc_id, {_TOKENS.format('text')} AS w FROM documents WHERE text IS NOT NULL) SELECT doc_id, array_to_string(list_transform(w[:32], lambda x: left(x, 6)), ' ') AS words FROM t")
def bounded_payloads(spark, sf_dir):
    """The first words of every text as a trace keeps them: so many, each cut."""
    return L.table(spark, sf_dir, "documents").filter("text is not null").select("doc_id", F.array_join(X.bounded_strings(X.tokens(col("text")), 32, 6), " ").alias("words"))


@query(with_sql(["questions"], f"""{_QT}, p AS (SELECT item_id AS query_id, lower(text) AS h FROM benchmark), b AS (SELECT query_id, (query_id + 1) % (SELECT count(*) FROM p) AS other, terms FROM q)
SELECT b.query_id, round(list_sum(list_transform(terms, lambda t: CASE WHEN list_contains({_TOKENS.format('h')}, t) THEN 2.0 WHEN contains(h, t) THEN 0.75 ELSE 0.0 END)), 6)::DOUBLE AS score, array_to_string(list_filter(terms, lambda t: contains(h, t)), ' ') AS matched FROM b JOIN p ON p.query_id = b.other WHERE len(terms) > 0"""))
def term_matches(spark, sf_dir):
    """Each question's terms in the passage after its own: score and terms that are there."""
    p = L.table(spark, sf_dir, "benchmark").select(col("item_id").alias("_o"), F.lower("text").alias("h"))
    n = p.count()
    terms = X.query_terms(col("query"))
    rows = L.questions(spark, sf_dir).withColumn("_o", (col("query_id") + 1) % n).join(p, "_o").filter(F.size(terms) > 0)
    return rows.select("query_id", F.round(X.lexical_score(terms, col("h")), 6).alias("score"), F.array_join(X.matched_terms(terms, col("h")), " ").alias("matched"))


@query("SELECT doc_id, 'cand_' || left(sha256('repo|v1|lexical|' || doc_id || '|' || coalesce(source, '')), 24) AS candidate_id FROM documents")
def candidate_ids(spark, sf_dir):
    """Ids of candidates from the parts that they are of."""
    return L.table(spark, sf_dir, "documents").select("doc_id", X.candidate_id([lit("repo"), lit("v1"), lit("lexical"), col("doc_id"), col("source")]).alias("candidate_id"))


_CAND = """SELECT o_orderkey AS id, CASE WHEN o_orderkey % 17 = 0 THEN 'guess' ELSE 'lexical' END AS retriever, CASE WHEN o_orderkey % 19 = 0 THEN NULL ELSE 'heuristic' END AS support, (o_orderkey % 23)::INT AS rank, o_totalprice - 2000 AS score, o_orderkey % 29 AS n, (o_orderkey % 31)::INT AS s, (o_orderkey % 37)::INT AS e FROM orders"""


@query(f"""WITH x AS ({_CAND}) SELECT id, unnest(list_filter([CASE WHEN retriever = 'guess' THEN 'retriever_known' END, CASE WHEN support IS NULL THEN 'support_known' END, CASE WHEN NOT rank > 0 THEN 'rank_positive' END, CASE WHEN NOT coalesce(score > 0, false) THEN 'score_positive' END,
  CASE WHEN n = 0 THEN 'reasons_given' END, CASE WHEN NOT (s >= 1 AND e >= s) THEN 'lines_in_order' END], lambda r: r IS NOT NULL)) AS rule FROM x""")
def candidate_violations(spark, sf_dir):
    """Candidates that break the contract, and which of its rules."""
    k = col("o_orderkey")
    rows = L.table(spark, sf_dir, "orders").select(
        k.alias("id"), F.when(k % 17 == 0, "guess").otherwise("lexical").alias("retriever"), F.when(k % 19 != 0, "heuristic").alias("support"), (k % 23).cast("int").alias("rank"), (col("o_totalprice") - 2000).alias("score"),
        F.when(k % 29 == 0, F.array().cast("array<string>")).otherwise(F.array(lit("r"))).alias("reasons"), (k % 31).cast("int").alias("start_line"), (k % 37).cast("int").alias("end_line"),
    )
    return FI.violations(rows, CO.candidates(), "id")


@query("""WITH x AS (SELECT doc_id AS id, ['resolved', 'ambiguous', 'unresolved'][doc_id % 3 + 1] AS outcome, CASE doc_id % 5 WHEN 0 THEN []::VARCHAR[] WHEN 1 THEN ['a'] WHEN 2 THEN ['a', 'b'] WHEN 3 THEN ['b', 'a'] ELSE ['a', 'a'] END AS t, doc_id % 7 <> 0 AS why FROM documents)
SELECT id, unnest(list_filter([CASE WHEN NOT CASE outcome WHEN 'resolved' THEN len(t) = 1 WHEN 'ambiguous' THEN len(t) >= 2 ELSE len(t) = 0 AND why END THEN 'targets_fit_outcome' END, CASE WHEN t <> list_sort(list_distinct(t)) THEN 'targets_sorted_once' END], lambda r: r IS NOT NULL)) AS rule FROM x""")
def reference_violations(spark, sf_dir):
    """References whose targets don't go with their outcome."""
    d = col("doc_id")
    sets = F.array(*[F.array(*map(lit, t)) if t else F.array().cast("array<string>") for t in ([], ["a"], ["a", "b"], ["b", "a"], ["a", "a"])])
    rows = L.table(spark, sf_dir, "documents").select(d.alias("id"), F.element_at(F.array(*map(lit, ["resolved", "ambiguous", "unresolved"])), (d % 3 + 1).cast("int")).alias("outcome"), F.element_at(sets, (d % 5 + 1).cast("int")).alias("targets"), F.when(d % 7 != 0, "why").alias("reason"))
    return FI.violations(rows, CO.references(), "id")


@query("""SELECT k AS id, unnest(list_filter([CASE WHEN k % 10 <> k % 7 + k % 3 THEN 'counts_add_up' END, CASE WHEN k % 4 = 0 THEN 'artifacts_once' END, CASE WHEN k % 6 = 0 THEN 'issues_once' END], lambda r: r IS NOT NULL)) AS rule FROM (SELECT c_custkey AS k FROM customer)""")
def capability_violations(spark, sf_dir):
    """Capability evidence whose counts don't add up or whose lists repeat."""
    k = col("c_custkey")
    pair = lambda n, a: F.when(k % n == 0, F.array(lit(a), lit(a))).otherwise(F.array(lit(a), lit("z")))
    rows = L.table(spark, sf_dir, "customer").select(k.alias("id"), (k % 10).alias("units"), (k % 7).alias("succeeded"), (k % 3).alias("failed"), pair(4, "a").alias("artifacts"), pair(6, "i").alias("issues"))
    return FI.violations(rows, CO.capabilities(), "id")


@query("""SELECT event_id AS id, unnest(list_filter([CASE WHEN event_id % 11 = 0 THEN 'id_prefix' END, CASE WHEN event_type = 'click' THEN 'state_known' END, CASE WHEN event_id % 6 > 3 THEN 'attempt_range' END,
  CASE WHEN (event_type = 'view') <> (event_id % 2 = 0) THEN 'lease_paired' END], lambda r: r IS NOT NULL)) AS rule FROM events""")
def job_violations(spark, sf_dir):
    """Job rows that break the store's check constraints."""
    k, kind = col("event_id"), col("event_type")
    state = F.when(kind == "view", "running").when(kind == "click", "lost").otherwise("completed")
    rows = L.table(spark, sf_dir, "events").select(k.alias("id"), F.concat(F.when(k % 11 == 0, "x").otherwise("job_"), _text(k)).alias("job_id"), state.alias("state"), (k % 6).cast("int").alias("attempt"), F.when(k % 2 == 0, col("ts")).alias("lease_expires"))
    return FI.violations(rows, CO.jobs(), "id")


@query("SELECT DISTINCT conv_id AS turn_id FROM (SELECT conv_id, s, row_number() OVER (PARTITION BY conv_id ORDER BY s) AS n FROM (SELECT conv_id, turn + CASE WHEN conv_id % 3 = 0 AND turn > 1 THEN 1 ELSE 0 END - (SELECT min(turn) FROM conversations) + 1 AS s FROM conversations)) WHERE s <> n")
def trace_gaps(spark, sf_dir):
    """Conversations whose turns, some of them moved, aren't numbered without gaps."""
    m = L.table(spark, sf_dir, "conversations")
    low = m.agg(F.min("turn").alias("_l"))
    rows = m.crossJoin(F.broadcast(low)).select(col("conv_id").alias("turn_id"), (col("turn") + F.when((col("conv_id") % 3 == 0) & (col("turn") > 1), 1).otherwise(0) - col("_l") + 1).alias("sequence"))  # one row
    return AS.gaps(rows)


@query("SELECT doc_id, source, n_chars FROM documents QUALIFY row_number() OVER (PARTITION BY source, n_chars ORDER BY doc_id DESC) = 1")
def latest_rows(spark, sf_dir):
    """Of rows upserted under one key the last."""
    return D.latest(L.table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars"), ["source", "n_chars"], ["doc_id"])


@query("SELECT p_partkey AS path, 'data_access:' || p_brand AS component FROM part")
def component_owners(spark, sf_dir):
    """The component that each file belongs to."""
    return A.ownership(L.table(spark, sf_dir, "part").select(col("p_partkey").alias("path"), lit("data_access").alias("kind"), col("p_brand").alias("domain")))
