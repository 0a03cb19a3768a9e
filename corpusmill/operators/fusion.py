"""Reciprocal-rank fusion of candidates, merging of fused lists, and configuration identities."""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Order of support types, strongest first (fixed values).
SUPPORT = {"source_exact": 0, "static_resolved": 1, "heuristic": 2}
RETRIEVERS = ("exact", "lexical", "symbol", "endpoint", "metadata", "graph", "semantic")


def support_order(c: Column) -> Column:
    return F.coalesce(F.create_map(*[F.lit(x) for kv in SUPPORT.items() for x in kv])[c], F.lit(9))


def canonical_json(value) -> str:
    """Sorted keys, no spaces, ASCII only."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=True)


def identity(prefix: str, value) -> str:
    return prefix + hashlib.sha256(canonical_json(value).encode()).hexdigest()[:24]


@dataclass(frozen=True)
class Policy:
    """Which retrievers count, how much, and how many of their candidates."""

    weights: dict[str, float] = field(default_factory=lambda: dict.fromkeys(RETRIEVERS, 1.0))
    boosts: dict[str, float] = field(default_factory=dict)
    k: int = 60
    per_retriever: int = 50
    limit: int = 20
    support: tuple[str, ...] = ("source_exact", "static_resolved", "heuristic")

    def __post_init__(self):
        if not self.weights or any(w <= 0 for w in self.weights.values()):
            raise ValueError("one retriever at least, with weights over zero")
        if self.k <= 0 or self.per_retriever <= 0 or not 0 < self.limit <= 20:
            raise ValueError("k and limits are positive, the final limit is 20 at most")
        if not self.support or set(self.support) - SUPPORT.keys() or len(set(self.support)) < len(self.support):
            raise ValueError("support types are known and named once")
        if any(b <= 0 for b in self.boosts.values()):
            raise ValueError("boosts are over zero")

    @property
    def most(self) -> float:
        """The score of a candidate that every enabled retriever ranks first."""
        return sum(w / (self.k + 1) for w in self.weights.values())


def fuse(candidates: DataFrame, policy: Policy) -> DataFrame:
    """Ranked groups of candidates, per query.

    candidates: query_id, candidate_id, retriever, entity_key, source_key, start_line, end_line,
    rank, support, reasons (array). Candidates of retrievers that are off, past the limit per
    retriever or of other support are left out. A group is one entity, source and span. Its
    score is the sum over retrievers of weight / (k + best rank), times the boosts of reasons
    that any of its members has; ``normalised`` divides it by the best possible score.
    """
    weight = F.create_map(*[F.lit(x) for kv in policy.weights.items() for x in kv])
    rows = candidates.withColumn("_w", weight[F.col("retriever")]).filter(
        F.col("_w").isNotNull() & (F.col("rank") <= policy.per_retriever) & F.col("support").isin(*policy.support)
    )
    span = ["query_id", "entity_key", "source_key", "start_line", "end_line"]
    order = F.struct(support_order(F.col("support")), "rank", "candidate_id")
    per = rows.groupBy(*span, "retriever").agg(
        F.min("rank").alias("_r"), F.max("_w").alias("_w"), F.collect_set("candidate_id").alias("_ids"),
        F.array_distinct(F.flatten(F.collect_list("reasons"))).alias("_reasons"), F.min(order).alias("_best"),
    )
    groups = per.groupBy(*span).agg(
        F.sum(F.col("_w") / (policy.k + F.col("_r"))).alias("_sum"), F.min("_r").alias("best_rank"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("_ids")))).alias("candidate_ids"),
        F.array_sort(F.collect_set("retriever")).alias("retrievers"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("_reasons")))).alias("reason_codes"), F.min("_best").alias("_best"),
    )
    boost = F.lit(1.0)
    for reason, by in sorted(policy.boosts.items()):
        boost = boost * F.when(F.array_contains("reason_codes", reason), F.lit(by)).otherwise(1.0)
    names = list(SUPPORT)
    scored = groups.withColumn("fused", F.round(F.col("_sum") * boost, 12)).select(
        *span, "fused", F.least(F.lit(1.0), F.round(F.col("fused") / policy.most, 12)).alias("normalised"), "best_rank",
        F.element_at(F.array(*map(F.lit, names)), F.col("_best")["col1"] + 1).alias("support"), F.col("_best")["candidate_id"].alias("candidate_id"),
        "candidate_ids", "retrievers", "reason_codes",
    )
    order = Window.partitionBy("query_id").orderBy(F.desc("fused"), support_order(F.col("support")), "best_rank", "entity_key", "candidate_id")
    return scored.withColumn("position", F.row_number().over(order)).filter(F.col("position") <= policy.limit)


def merge(first: DataFrame, second: DataFrame) -> DataFrame:
    """Two fused lists as one: the best of each group, with the sets of all its members; an error across configurations (``config``)."""
    rows = first.unionByName(second)
    span = ["query_id", "entity_key", "source_key", "start_line", "end_line"]
    best = F.struct((-F.col("fused")).alias("neg"), support_order(F.col("support")).alias("s"), "best_rank", "candidate_id", "support", "fused", "normalised")
    union = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c)
    out = rows.groupBy(*span).agg(F.min(best).alias("b"), union("candidate_ids"), union("retrievers"), union("reason_codes"), F.count_distinct("config").alias("_n"), F.min("config").alias("config"))
    checked = F.when(F.col("_n") > 1, F.raise_error(F.lit("candidates of different configurations")).cast("string")).otherwise(F.col("config"))
    out = out.select(*span, "b.fused", "b.normalised", "b.best_rank", "b.support", "b.candidate_id", "candidate_ids", "retrievers", "reason_codes", checked.alias("config"))
    order = Window.partitionBy("query_id").orderBy(F.desc("fused"), support_order(F.col("support")), "best_rank", "entity_key")
    return out.withColumn("position", F.row_number().over(order))


def weighted_rrf(ranked: DataFrame, weights: dict[str, float], k: int = 60) -> DataFrame:
    """(query_id, key, fused, position) of (query_id, retriever, key, rank): sums of weight / (k + rank), ties by key."""
    weight = F.create_map(*[F.lit(x) for kv in weights.items() for x in kv])
    rows = ranked.withColumn("_w", weight[F.col("retriever")]).groupBy("query_id", "key").agg(F.round(F.sum(F.col("_w") / (k + F.col("rank"))), 12).alias("fused"))
    return rows.withColumn("position", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("fused"), "key")))
