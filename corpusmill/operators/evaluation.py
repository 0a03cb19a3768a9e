"""Retrieval metrics per case, their aggregates, percentiles, regression gates and adoption checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

METRICS = ("recall", "precision", "reciprocal_rank", "ndcg", "source_diversity", "duplicate_rate", "insufficient")
COMPARISONS = ("gte", "lte", "eq")


def score(items: DataFrame, cases: DataFrame, k: int) -> DataFrame:
    """One row for each (case_id, method) of ``cases`` x methods of items, at cut-off ``k``; undefined metrics are null.

    items: case_id, method, rank, entity_key, source_key, start_line, end_line, relevant.
    cases: case_id, method, n_relevant, should_answer. Recall, reciprocal rank, exact rank and
    nDCG count an entity once, at its first place; precision counts every hit and divides by k.
    """
    if k <= 0:
        raise ValueError("k is positive")
    key = ["case_id", "method"]
    top = items.filter(F.col("rank") <= k)
    hits = top.filter("relevant").groupBy(*key, "entity_key").agg(F.min("rank").alias("rank")).groupBy(*key).agg(
        F.count("*").alias("entities"), F.min("rank").alias("exact_rank"), F.sum(1 / F.log2(F.col("rank") + 1)).alias("dcg")
    )
    every = top.groupBy(*key).agg(
        F.count("*").alias("n"), F.count_if("relevant").alias("n_hits"), F.count_distinct("source_key").alias("sources"),
        F.count_distinct(F.struct("source_key", "start_line", "end_line")).alias("spans"),
    )
    rows = cases.join(hits, key, "left").join(every, key, "left").fillna(0, ["entities", "n", "n_hits", "sources", "spans"])
    some = F.col("n_relevant") > 0
    ideal = F.aggregate(F.sequence(F.lit(1), F.greatest(F.least(F.col("n_relevant"), F.lit(k)), F.lit(1)).cast("int")), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1))
    r = lambda c: F.round(c, 12)
    return rows.select(
        *key,
        F.lit(k).alias("k"),
        F.when(some, r(F.col("entities") / F.col("n_relevant"))).alias("recall"),
        F.when(some, r(F.col("n_hits") / F.lit(k))).alias("precision"),
        F.when(some, F.coalesce(r(1 / F.col("exact_rank")), F.lit(0.0))).alias("reciprocal_rank"),
        F.when(some, r(F.coalesce("dcg", F.lit(0.0)) / ideal)).alias("ndcg"),
        F.when(some, F.col("exact_rank")).alias("exact_rank"),
        F.when(F.col("n") > 0, r(F.col("sources") / F.greatest("n", F.lit(1)))).otherwise(0.0).alias("source_diversity"),
        F.when(F.col("n") > 0, r(1 - F.col("spans") / F.greatest("n", F.lit(1)))).otherwise(0.0).alias("duplicate_rate"),
        F.when(~F.col("should_answer"), (F.col("n") == 0).cast("double")).alias("insufficient"),
    )


def aggregate(scores: DataFrame, by: list[str] = ("method", "k")) -> DataFrame:
    """Macro means over cases where the metric is defined; null where it is for none."""
    return scores.groupBy(*by).agg(*[F.round(F.avg(m), 12).alias(m) for m in METRICS], F.count("*").alias("cases"))


def percentile(c: Column, share: float = 0.95) -> Column:
    """Nearest-rank percentile: of n sorted values that at ceil(share n)."""
    return F.element_at(F.array_sort(F.collect_list(c)), F.greatest(F.ceil(F.lit(share) * F.count(c)), F.lit(1)).cast("int"))


def long_metrics(aggregates: DataFrame) -> DataFrame:
    """(method, k, metric, value) of an aggregate table."""
    pairs = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in METRICS])
    return aggregates.select("method", "k", F.explode(pairs).alias("p")).select("method", "k", "p.metric", "p.value")


def gate(aggregates: DataFrame, rules: DataFrame) -> DataFrame:
    """Each rule (rule_id, method, k, metric, comparison, bound) with its value, outcome and whether all pass.

    ``missing`` where the metric has no value, else ``ok`` or ``violated``.
    """
    both = rules.join(long_metrics(aggregates), ["method", "k", "metric"], "left")
    v, b = F.col("value"), F.col("bound")
    holds = F.when(F.col("comparison") == "gte", v >= b).when(F.col("comparison") == "lte", v <= b).when(F.col("comparison") == "eq", v == b)
    out = both.withColumn("outcome", F.when(v.isNull(), "missing").when(holds, "ok").otherwise("violated"))
    whole = out.agg(F.bool_and(F.col("outcome") == "ok").alias("passed"))
    return out.crossJoin(F.broadcast(whole)).select("rule_id", "method", "k", "metric", "comparison", "bound", "value", "outcome", "passed")


def adoption(row: DataFrame, query_ms: float = 2000.0, corpus_ms: float = 30_000.0, memory: int = 2 << 30, gain: float = 0.01) -> DataFrame:
    """Eight checks of a benchmark row (p95_ms, corpus_ms, memory_bytes, hybrid_*, sparse_*) and whether all hold."""
    c = F.col
    checks = {
        "query_latency": c("p95_ms") <= query_ms,
        "corpus_time": c("corpus_ms") <= corpus_ms,
        "memory": c("memory_bytes") <= memory,
        "recall_gain": c("hybrid_recall") - c("sparse_recall") >= gain,
        "ndcg_gain": c("hybrid_ndcg") - c("sparse_ndcg") >= gain,
        "rank_kept": c("hybrid_rr") >= c("sparse_rr"),
        "precision_kept": c("hybrid_precision") >= c("sparse_precision"),
        "insufficient_kept": c("hybrid_insufficient") >= c("sparse_insufficient"),
    }
    out = row.select("*", *[x.alias(k) for k, x in checks.items()])
    accepted = F.lit(True)
    for k in checks:
        accepted = accepted & F.coalesce(c(k), F.lit(False))
    return out.withColumn("accepted", accepted)


#: Retrievers of the method that knows exact words only (fixed values).
KEYWORD = ("exact", "lexical", "symbol", "endpoint")


def methods(candidates: DataFrame, limit: int) -> DataFrame:
    """(method, query_id, position, entity_key, source_key, start_line, end_line): what each evaluated method makes of the candidates.

    ``exact_keyword`` fuses the retrievers of ``KEYWORD``, ``deterministic_hybrid`` all of
    them; ``naive_semantic`` takes semantic candidates in order of rank, each span once.
    """
    from corpusmill.operators.fusion import Policy, fuse

    span = ["query_id", "entity_key", "source_key", "start_line", "end_line"]
    semantic = candidates.filter("retriever = 'semantic'").groupBy(*span).agg(F.min(F.struct("rank", "candidate_id")).alias("_o"))
    naive = semantic.withColumn("position", F.row_number().over(Window.partitionBy("query_id").orderBy("_o"))).filter(F.col("position") <= limit)
    found = naive.select(F.lit("naive_semantic").alias("method"), *span, "position")
    for name, policy in (("exact_keyword", Policy(weights=dict.fromkeys(KEYWORD, 1.0), limit=limit)), ("deterministic_hybrid", Policy(limit=limit))):
        found = found.unionByName(fuse(candidates, policy).select(F.lit(name).alias("method"), *span, "position"))
    return found
