"""Registered queries over answer rounds, tool calls, source spans and manifests, and SQL that gives the same rows."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from corpusmill.functions import text as X
from corpusmill.functions.tables import cut
from corpusmill.operators import answering as AN
from corpusmill.operators import contracts as CO
from corpusmill.operators import files as FI
from corpusmill.operators import fusion as FU
from corpusmill.plans import lift as L
from corpusmill.plans.queries import _CAND_TABLES, _CANDS, _EV, _SUFF, POLICY, _evidence, _fused_sources, _pack_sql, _retrieved, query

col, lit = F.col, F.lit
#: What is added to a question's id for its repair query; a multiple of the number of kinds.
AGAIN = 1_000_000_000
KINDS = ["api_question", "flow_tracing", "onboarding", "code_question"]
BUDGET = AN.Budget(evidence=6, tokens=250)


def _kind(c):
    return F.element_at(F.array(*map(lit, KINDS)), (c % len(KINDS) + 1).cast("int"))


def _rounds(spark, sf_dir):
    """Blocks and decisions: all questions and their repair queries are searched for in one job."""
    q = L.questions(spark, sf_dir).withColumn("kind", _kind(col("query_id")))
    both = cut(q.select("query_id", "query").union(q.select(col("query_id") + AGAIN, X.repair_query(col("kind"), col("query")))))
    found = _retrieved(spark, sf_dir, both)
    named = cut(FU.fuse(found.filter((col("retriever") == "exact") & (col("query_id") < AGAIN)), POLICY))
    fused = cut(FU.fuse(found, POLICY))
    facts = lambda f: _evidence(spark, sf_dir, f)
    hybrid = facts(fused.filter(col("query_id") < AGAIN))[0]
    files, skipped = _fused_sources(spark, sf_dir, named.select("source_key").union(fused.select("source_key")))
    repaired = facts(fused.filter(col("query_id") >= AGAIN).withColumn("query_id", col("query_id") - AGAIN))[0]
    return AN.answer(q, facts(named)[0], hybrid, repaired, files, skipped, BUDGET)


_KIND = "['" + "', '".join(KINDS) + "'][query_id % 4 + 1]"
_TWICE = f"SELECT query_id, query FROM ({L.SQL['questions']}) UNION ALL SELECT query_id + {AGAIN}, trim(query) || ' ' || CASE {_KIND} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in X.REPAIR_WORDS.items()) + f" ELSE 'source definition reference' END FROM ({L.SQL['questions']})"


def _select_sql(tag: str, source: str) -> str:
    """Evidence from ``source`` and what it lacks, under names that end in ``tag``."""
    sql = _EV.removeprefix(_CANDS) + _pack_sql(BUDGET.tokens, BUDGET.evidence) + _SUFF
    sql = sql.replace("FROM placed p", f"FROM {source} p").replace("WHERE position <= 20", "").replace("FROM questions", "FROM prompts")
    return re.sub(r"\b(ev|checked|sound|lists|walk|steps|sel|have|r|m)\b", rf"\1_{tag}", sql)


_COLUMNS = "query_id, chunk_id, fused, best_rank, s, retrievers"
_ROUNDS = L.with_sql(_CAND_TABLES, _CANDS).replace(f"questions AS ({L.SQL['questions']})", f"questions AS ({_TWICE})") + f""",
prompts AS (SELECT query_id, query, {_KIND} AS kind FROM questions WHERE query_id < {AGAIN}),
named AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY fused DESC, best_rank, chunk_id) AS position FROM (SELECT query_id, chunk_id, round(sum(1.0 / (60 + rank)), 12) AS fused, min(rank)::INT AS best_rank, 0 AS s, 'exact' AS retrievers FROM cand WHERE retriever = 'exact' AND query_id < {AGAIN} GROUP BY 1, 2)),
plan AS (SELECT query_id, kind, CASE WHEN kind <> 'code_question' THEN 'hybrid_retrieval' WHEN query_id IN (SELECT query_id FROM named) THEN 'exact_lookup' ELSE 'exact_lookup,hybrid_retrieval' END AS tools FROM prompts),
first AS (SELECT {_COLUMNS} FROM named JOIN plan USING (query_id) WHERE tools = 'exact_lookup' AND position <= 20 UNION ALL SELECT {_COLUMNS} FROM placed JOIN plan USING (query_id) WHERE tools <> 'exact_lookup' AND position <= 20)""" + _select_sql("one", "first") + f""",
todo AS (SELECT query_id FROM m_one WHERE missing <> '' AND kind <> 'code_question'),
after AS (SELECT query_id - {AGAIN} AS query_id, chunk_id, fused, best_rank, s, retrievers FROM placed WHERE query_id >= {AGAIN} AND position <= 20 AND query_id - {AGAIN} IN (SELECT query_id FROM todo)),
ids AS (SELECT query_id - {AGAIN} AS query_id, retriever, chunk_id FROM cand JOIN placed USING (query_id, chunk_id) WHERE query_id >= {AGAIN} AND position <= 20 AND query_id - {AGAIN} IN (SELECT query_id FROM todo)
  EXCEPT SELECT query_id, retriever, chunk_id FROM cand JOIN placed USING (query_id, chunk_id) WHERE position <= 20),
final AS (SELECT * FROM first WHERE query_id NOT IN (SELECT query_id FROM todo) UNION ALL SELECT query_id, chunk_id, max(fused) AS fused, arg_min(best_rank, {{'a': -fused, 'b': s, 'c': best_rank}}) AS best_rank, arg_min(s, {{'a': -fused, 'b': s, 'c': best_rank}}) AS s,
  array_to_string(list_sort(list_distinct(flatten(list(string_split(retrievers, ','))))), ',') AS retrievers FROM (SELECT * FROM first WHERE query_id IN (SELECT query_id FROM todo) UNION ALL SELECT * FROM after) GROUP BY 1, 2)""" + _select_sql("two", "final")


@query(
    _ROUNDS + """, used AS (SELECT query_id, max(used)::BIGINT AS used_tokens, max(n)::BIGINT AS selected FROM steps_two GROUP BY 1),
d AS (SELECT p.query_id, p.kind, p.tools, todo.query_id IS NOT NULL AS again, p.query_id IN (SELECT query_id FROM ids) AS novel, coalesce(selected, 0) AS selected, coalesce(used_tokens, 0) AS used_tokens, missing FROM plan p JOIN m_two USING (query_id) LEFT JOIN todo USING (query_id) LEFT JOIN used USING (query_id))
SELECT query_id, kind, tools || CASE WHEN again THEN ',hybrid_retrieval' ELSE '' END AS tools, (len(string_split(tools, ',')) + again::INT)::INT AS calls, 1 + again::INT AS rounds, CASE WHEN again THEN CASE WHEN novel THEN 'repair_completed' ELSE 'repair_unchanged' END END AS repair, selected, used_tokens,
  CASE WHEN selected = 0 THEN 'insufficient_evidence' WHEN missing <> '' THEN 'limited' ELSE 'answered' END AS outcome, CASE WHEN selected = 0 THEN 'no_selected_evidence' WHEN missing <> '' THEN missing ELSE 'workflow_completed' END AS reasons FROM d"""
)
def answer_decisions(spark, sf_dir):
    """What each question's rounds come to: tools called, whether a repair found anything new, outcome and reasons."""
    return _rounds(spark, sf_dir)[1]


@query(_ROUNDS + " SELECT query_id, cid AS candidate_id FROM steps_two WHERE outcome = 'selected'")
def answer_evidence(spark, sf_dir):
    """The blocks that each question's last round selects."""
    return _rounds(spark, sf_dir)[0].select("query_id", "candidate_id")


@query("""WITH c AS (SELECT conv_id AS turn_id, turn AS seq, CASE turn % 5 WHEN 0 THEN 'shell' WHEN 1 THEN 'exact_lookup' ELSE 'hybrid_retrieval' END AS tool, CASE WHEN conv_id % 11 = 0 THEN '2' ELSE '1' END AS version, conv_id % 9 AS repo, (turn % 7)::INT AS v, CASE WHEN turn % 4 < 2 THEN lower(text) ELSE upper(text) END AS query, turn % 6 AS lim FROM conversations),
f AS (SELECT *, CASE WHEN tool = 'shell' OR version <> '1' THEN 'tool_unknown' WHEN NOT regexp_matches(coalesce(query, ''), '\\S') OR lim = 0 THEN 'input_invalid' WHEN repo > 7 OR v = 3 THEN 'other_index' END AS fault FROM c),
n AS (SELECT *, fault IS NULL AND row_number() OVER (PARTITION BY turn_id, tool, version, repo, v, lim, lower(trim(regexp_replace(query, '\\s+', ' ', 'g'))), fault IS NULL ORDER BY seq) = 1 AS fresh FROM f)
SELECT turn_id, seq, coalesce(fault, CASE WHEN NOT fresh THEN 'equivalent_call' WHEN sum(fresh::INT) OVER (PARTITION BY turn_id ORDER BY seq ROWS UNBOUNDED PRECEDING) > 3 THEN 'call_budget_exhausted' ELSE 'accepted' END) AS state FROM n""".replace("\\\\", "\\"))
def tool_calls(spark, sf_dir):
    """What becomes of a tool call for every turn: unknown tools, foreign indexes, equal calls and calls past the budget."""
    t, v = col("turn"), col("conv_id")
    calls = L.table(spark, sf_dir, "conversations").select(
        v.alias("turn_id"), t.alias("seq"), F.when(t % 5 == 0, "shell").when(t % 5 == 1, "exact_lookup").otherwise("hybrid_retrieval").alias("tool"), F.when(v % 11 == 0, "2").otherwise("1").alias("version"), (v % 9).alias("repository_id"),
        F.when(t % 7 == 3, 0).otherwise(1).alias("index_version"), F.when(t % 4 < 2, F.lower("text")).otherwise(F.upper("text")).alias("query"), lit("code_question").alias("kind"), (t % 6).alias("limit"), (t % 7).alias("v"),
    )
    repositories = calls.select("repository_id").distinct().filter("repository_id <= 7").withColumn("index_version", lit(1))
    return AN.checked_calls(calls, repositories).select("turn_id", "seq", "state")


@query("""WITH b AS (SELECT DISTINCT item_id AS query_id, d AS doc_id, s + item_id % 3 AS s, s + item_id % 3 + item_id % 4 AS e FROM (SELECT item_id, unnest([item_id * 3, item_id * 3, item_id * 3, item_id * 5 + 1]) AS d, unnest([1, 2, 8, 1]) AS s FROM benchmark)),
f AS (SELECT doc_id, CASE WHEN doc_id % 17 <> 0 THEN string_split(regexp_replace(text, '\\n$', ''), chr(10)) END AS l FROM documents WHERE text IS NOT NULL),
i AS (SELECT *, sum(apart) OVER (PARTITION BY query_id, doc_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS island FROM (SELECT *, CASE WHEN s <= max(e) OVER (PARTITION BY query_id, doc_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1 THEN 0 ELSE 1 END AS apart FROM b)),
g AS (SELECT query_id, doc_id, min(s)::INT AS start_line, max(e)::INT AS end_line, count(*) AS blocks FROM i GROUP BY query_id, doc_id, island),
t AS (SELECT *, CASE WHEN l IS NOT NULL AND end_line <= len(l) AND regexp_matches(array_to_string(l[start_line:end_line], chr(10)), '\\S') THEN array_to_string(l[start_line:end_line], chr(10)) END AS txt FROM g LEFT JOIN f USING (doc_id)),
w AS (SELECT *, (32 + ceil(length(txt) / 4))::BIGINT AS tokens FROM t)
SELECT query_id, 'd' || doc_id AS path, start_line, end_line, blocks, tokens, complete, CASE WHEN complete THEN txt END AS content FROM (SELECT *, NOT bool_or(tokens IS NULL) OVER (PARTITION BY query_id) AND coalesce(sum(tokens) OVER (PARTITION BY query_id), 0) <= 900 AS complete FROM w)""")
def source_spans(spark, sf_dir):
    """Spans of two documents for each question, from blocks some of which overlap; every 17th document has changed."""
    i = col("item_id")
    one = lambda d, s: F.struct(F.concat(lit("d"), d.cast("string")).alias("path"), (lit(s) + i % 3).cast("int").alias("start_line"), (lit(s) + i % 3 + i % 4).cast("int").alias("end_line"))
    blocks = L.table(spark, sf_dir, "benchmark").select(i.alias("query_id"), F.explode(F.array(one(i * 3, 1), one(i * 3, 2), one(i * 3, 8), one(i * 5 + 1, 1))).alias("b")).select("query_id", "b.*", lit(None).cast("string").alias("source_hash"))
    d = col("doc_id")
    files = L.table(spark, sf_dir, "documents").filter("text is not null").select(F.concat(lit("d"), d.cast("string")).alias("path"), F.when(d % 17 == 0, "stale").otherwise(F.sha2("text", 256)).alias("indexed_hash"), col("text").alias("content"))
    return AN.source_spans(blocks, files, 900)


_STATUS = ["building", "validating", "ready", "ready_with_warnings", "failed", "lost"]


@query(f"""WITH x AS (SELECT o_orderkey AS k, ['{"', '".join(_STATUS)}'][o_orderkey % 6 + 1] AS status, CASE o_orderkey % 4 WHEN 0 THEN 'passed' WHEN 1 THEN 'passed_with_warnings' WHEN 2 THEN 'failed' END AS validation FROM orders)
SELECT k AS id, unnest(list_filter([CASE WHEN k % 13 = 0 THEN 'repository_prefix' END, CASE WHEN k % 19 = 0 THEN 'index_prefix' END, CASE WHEN k % 7 = 0 THEN 'base_differs' END, CASE WHEN k % 10 = 0 THEN 'sequence_positive' END, CASE WHEN k % 5 = 0 THEN 'artifacts_once' END, CASE WHEN status = 'lost' THEN 'status_known' END,
  CASE WHEN status = 'ready' AND coalesce(validation, '') <> 'passed' OR status = 'ready_with_warnings' AND coalesce(validation, '') <> 'passed_with_warnings' THEN 'status_fits_validation' END, CASE WHEN status IN ('ready', 'ready_with_warnings') AND k % 3 > 0 THEN 'ready_without_critical' END], lambda r: r IS NOT NULL)) AS rule FROM x""")
def manifest_violations(spark, sf_dir):
    """Index manifests, one for each order, that break their contract."""
    k = col("o_orderkey")
    version = F.concat(F.when(k % 19 == 0, "v").otherwise("idx_"), k.cast("string"))
    art = lambda n: F.struct(lit("chunks").alias("type"), F.concat(lit("s3://a/"), n.cast("string")).alias("uri"))
    rows = L.table(spark, sf_dir, "orders").select(
        k.alias("id"), F.concat(F.when(k % 13 == 0, "").otherwise("repo_"), k.cast("string")).alias("repository_id"), version.alias("index_version_id"), F.when(k % 7 == 0, version).when(k % 2 == 0, "idx_base").alias("base_index_version_id"), (k % 10).alias("sequence"),
        F.array(art(k), art(F.when(k % 5 == 0, k).otherwise(k + 1))).alias("artifacts"), F.element_at(F.array(*map(lit, _STATUS)), (k % 6 + 1).cast("int")).alias("status"),
        F.when(k % 4 == 0, "passed").when(k % 4 == 1, "passed_with_warnings").when(k % 4 == 2, "failed").alias("validation"), (k % 3).alias("critical_issues"),
    )
    return FI.violations(rows, CO.manifests(), "id")
