"""Evidence: validation against sources, diversity, packing under budgets, sufficiency, citations, conversation memory."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.functions import text as X
from corpusmill.operators.fusion import support_order

SUPPORTED = ("source_exact", "static_resolved", "heuristic")
MEMORY_MESSAGES, MEMORY_TOKENS = 8, 1000


def blocked(skipped: DataFrame) -> DataFrame:
    """(path): files that a scan skipped or flagged; never a source."""
    return skipped.select("path").filter("path is not null and path <> ''").distinct()


def validate(candidates: DataFrame, files: DataFrame, skipped: DataFrame, allowed: tuple[str, ...] = SUPPORTED) -> DataFrame:
    """``candidates`` with ``reason``: why one is no evidence, by the first rule that fails; null for sound ones.

    candidates: candidate_id, path, source_key, start_line, end_line, content, chunk_hash,
    support. files: path, indexed_hash, content (null: gone). A chunk's hash is over its path, lines and
    trimmed text.
    """
    have = files.select(F.col("path"), F.col("indexed_hash"), F.col("content").alias("_source"), F.lit(True).alias("_known"))
    rows = candidates.join(have, "path", "left").join(blocked(skipped).withColumn("_blocked", F.lit(True)), "path", "left")
    # a final line feed ends the last line
    lines = F.size(F.split(F.regexp_replace("_source", r"\n$", ""), "\n"))
    digest = F.sha2(F.concat_ws(":", "path", F.col("start_line").cast("string"), F.col("end_line").cast("string"), F.trim("content")), 256)
    reason = X.cases(
        [
            (~F.col("support").isin(*allowed), "unsupported_support_type"),
            (F.col("_blocked").isNotNull(), "blocked_source"),
            (F.col("_known").isNull() | (F.col("source_key") != F.concat(F.lit("file:v1:"), "path")), "source_not_in_current_index"),
            (F.col("_source").isNull(), "source_missing"),
            (F.sha2("_source", 256) != F.col("indexed_hash"), "source_hash_changed"),
            ((F.col("start_line") < 1) | (F.col("end_line") < F.col("start_line")) | (F.col("end_line") > lines), "range_invalid"),
            ((F.length("chunk_hash") != 64) | (F.col("chunk_hash") != digest), "chunk_hash_changed"),
        ],
        F.lit(None).cast("string"),
    )
    return rows.withColumn("reason", reason).drop("indexed_hash", "_source", "_known", "_blocked")


def coverage_priority(kind: Column, retrievers: Column, chunk_type: Column) -> Column:
    """0 for what a question type asks for first, 1 for the rest."""
    has = lambda r: F.when(F.array_contains(retrievers, r), 0).otherwise(1)
    return X.cases(
        [
            (kind == "api_question", has("endpoint")),
            (kind.isin("flow_tracing", "impact_analysis"), has("graph")),
            (kind.isin("architecture_overview", "onboarding"), F.when(chunk_type.isin("doc_section", "file_summary"), 0).otherwise(1)),
        ],
        0,
    )


def ordered(candidates: DataFrame) -> DataFrame:
    """``candidates`` with ``pos`` from 1 for each query: coverage, exactly named first, support, score, rank, entity, id."""
    named = F.when(F.array_contains("reason_codes", "exact_named_target"), 0).otherwise(1)
    order = [coverage_priority(F.col("kind"), F.col("retrievers"), F.col("chunk_type")), named, support_order(F.col("support")), F.desc("fused"), "best_rank", "entity_key", "candidate_id"]
    return candidates.withColumn("pos", F.row_number().over(Window.partitionBy("query_id").orderBy(*order)))


def diverse(rows: DataFrame) -> DataFrame:
    """``rows`` (query_id, path, pos) renumbered: the first block of each file in order, then the repeats in order."""
    nth = F.row_number().over(Window.partitionBy("query_id", "path").orderBy("pos"))
    rows = rows.withColumn("_again", nth > 1)
    return rows.withColumn("pos", F.row_number().over(Window.partitionBy("query_id").orderBy("_again", "pos"))).drop("_again")


def pack(rows: DataFrame, most: int = 6, budget: int = 8000) -> DataFrame:
    """Each block (query_id, candidate_id, pos, cost) with ``outcome``: selected, or why not.

    Blocks are taken in order while fewer than ``most`` are taken and they fit; one that does
    not fit is passed over and later, smaller ones still have their chance. That is no prefix
    sum, so each query's list (the candidates of one query, bounded by the ranking) is folded.
    """
    block = F.struct("pos", "candidate_id", F.col("cost").cast("long").alias("cost"))
    lists = rows.groupBy("query_id").agg(F.array_sort(F.collect_list(block)).alias("blocks"))
    start = F.struct(F.lit(0).cast("long").alias("used"), F.lit(0).alias("n"), F.array().cast("array<struct<candidate_id:string,outcome:string>>").alias("out"))

    def step(acc: Column, b: Column) -> Column:
        why = (
            F.when(acc["n"] >= most, "evidence_limit_reached").when(b["cost"] > budget, "block_exceeds_token_budget")
            .when(acc["used"] + b["cost"] > budget, "token_budget_exceeded").otherwise("selected")
        )
        took = why == "selected"
        return F.struct(
            (acc["used"] + F.when(took, b["cost"]).otherwise(0)).alias("used"), (acc["n"] + F.when(took, 1).otherwise(0)).alias("n"),
            F.concat(acc["out"], F.array(F.struct(b["candidate_id"].cast("string").alias("candidate_id"), why.alias("outcome")))).alias("out"),
        )

    folded = lists.select("query_id", F.explode(F.aggregate("blocks", start, step)["out"]).alias("o"))
    return folded.select("query_id", "o.candidate_id", "o.outcome")


def select(candidates: DataFrame, files: DataFrame, skipped: DataFrame, most: int = 6, budget: int = 8000) -> tuple[DataFrame, DataFrame]:
    """Outcomes (query_id, candidate_id, outcome) of all candidates, and each query's status.

    Status: insufficient where fewer than the question's type requires are selected, limited
    where any candidate was left out, else ready.
    """
    checked = validate(ordered(candidates), files, skipped)
    sound = diverse(checked.filter("reason is null")).withColumn("cost", X.evidence_tokens(F.col("content")))
    outcomes = pack(sound, most, budget).unionByName(checked.filter("reason is not null").select("query_id", F.col("candidate_id").cast("string"), F.col("reason").alias("outcome")))
    need = candidates.select("query_id", X.required_evidence(F.col("kind")).alias("required")).distinct()
    sums = outcomes.groupBy("query_id").agg(F.count_if(F.col("outcome") == "selected").alias("selected"), F.count_if(F.col("outcome") != "selected").alias("rejected"))
    cost = sound.select("query_id", F.col("candidate_id").cast("string"), "cost").join(outcomes.filter("outcome = 'selected'"), ["query_id", "candidate_id"]).groupBy("query_id").agg(F.sum("cost").alias("used_tokens"))
    rows = need.join(sums, "query_id", "left").join(cost, "query_id", "left").fillna(0, ["selected", "rejected", "used_tokens"])
    status = F.when(F.col("selected") < F.col("required"), "insufficient").when(F.col("rejected") > 0, "limited").otherwise("ready")
    return outcomes, rows.withColumn("status", status)


def omissions(outcomes: DataFrame) -> DataFrame:
    """(query_id, reason, n) of candidates that weren't selected."""
    return outcomes.filter("outcome <> 'selected'").groupBy("query_id", F.col("outcome").alias("reason")).agg(F.count("*").alias("n"))


def sufficiency(selected: DataFrame, questions: DataFrame, allow_repair: bool = True) -> DataFrame:
    """For each question (query_id, query, kind) what to do with its selected blocks (query_id, path, support, retrievers).

    Flow, API and impact questions need two strong blocks and one of graph or endpoint
    retrieval; overviews and onboarding two sources; others one strong block.
    """
    strong = selected.filter(F.col("support").isin("source_exact", "static_resolved"))
    have = strong.groupBy("query_id").agg(F.count("*").alias("n"), F.count_distinct("path").alias("sources"), F.array_distinct(F.flatten(F.collect_list("retrievers"))).alias("by"))
    rows = questions.join(have, "query_id", "left").withColumns({"n": F.coalesce("n", F.lit(0)), "sources": F.coalesce("sources", F.lit(0)), "by": F.coalesce("by", F.array().cast("array<string>"))})
    hard = F.col("kind").isin("flow_tracing", "api_question", "impact_analysis")
    wide = F.col("kind").isin("architecture_overview", "onboarding")
    wanted = F.when(F.col("kind") == "api_question", "endpoint").otherwise("graph")
    missing = F.array_join(
        F.array_compact(
            F.array(
                F.when(hard & (F.col("n") < 2), "required_strong_evidence_count:2"),
                F.when(hard & ~F.array_contains("by", wanted), F.concat(F.lit("required_retriever:"), wanted)),
                F.when(wide & (F.col("sources") < 2), F.lit("required_distinct_sources:2")),
                F.when(~hard & ~wide & (F.col("n") == 0), F.lit("required_strong_evidence_count:1")),
            )
        ),
        ",",
    )
    action = F.when(missing == "", "answer").when(F.lit(allow_repair) & (hard | wide), "repair").otherwise("insufficient")
    return rows.select("query_id", "kind", action.alias("action"), missing.alias("missing"), F.when(action == "repair", X.repair_query(F.col("kind"), F.col("query"))).alias("repair_query"))


def repair_changed(first: DataFrame, second: DataFrame) -> DataFrame:
    """(query_id, changed): whether a repair round selected any evidence that the first did not."""
    new = second.join(first, ["query_id", "candidate_id"], "left_anti").groupBy("query_id").agg(F.count("*").alias("n"))
    return second.select("query_id").distinct().join(new, "query_id", "left").select("query_id", (F.coalesce("n", F.lit(0)) > 0).alias("changed"))


def freshness(evidence: DataFrame, files: DataFrame, current_version: int) -> DataFrame:
    """Each piece (evidence_id, index_version, path, start_line, end_line) with ``state``: valid, or why not."""
    have = files.select("path", F.size(F.split("content", "\n")).alias("_lines"), F.lit(True).alias("_known"))
    rows = evidence.join(have, "path", "left")
    state = X.cases(
        [
            (F.col("index_version") != current_version, "stale_index_version"),
            (F.col("_known").isNull(), "file_not_in_current_index"),
            (F.col("_lines").isNull(), "source_file_missing"),
            ((F.col("start_line") < 1) | (F.col("end_line") < F.col("start_line")) | (F.col("end_line") > F.col("_lines")), "line_range_out_of_bounds"),
        ],
        "valid",
    )
    return rows.withColumn("state", state).drop("_lines", "_known")


def citations(claims: DataFrame, evidence: DataFrame) -> DataFrame:
    """Each claim (claim_id, text, scope, cited: array) with its reasons; valid where it has none.

    evidence: evidence_id, selected, valid, scope.
    """
    one = claims.select("claim_id", F.col("scope").alias("_scope"), F.explode_outer("cited").alias("evidence_id"))
    have = evidence.select("evidence_id", "selected", "valid", F.col("scope").alias("_e"), F.lit(True).alias("_known"))
    flags = one.join(have, "evidence_id", "left").filter("evidence_id is not null").groupBy("claim_id").agg(
        F.bool_or(F.col("_known").isNull()).alias("unknown"), F.bool_or(F.coalesce(~F.col("selected"), F.lit(False))).alias("unselected"),
        F.bool_or(F.coalesce(~F.col("valid"), F.lit(False))).alias("invalid"), F.bool_or(F.coalesce(F.col("_e") != F.col("_scope"), F.lit(False))).alias("scope_differs"),
    )
    rows = claims.join(flags, "claim_id", "left")
    pairs = [
        (F.trim(X.empty(F.col("text"))) == "", "empty_claim"), (F.size(F.array_distinct("cited")) < F.size("cited"), "duplicate_citation"), (F.size("cited") <= 0, "citation_missing"),
        (F.col("unknown"), "unknown_evidence"), (F.col("unselected"), "evidence_not_selected"), (F.col("invalid"), "evidence_invalid"), (F.col("scope_differs"), "scope_mismatch"),
    ]
    reasons = F.array_join(F.array_compact(F.array(*[F.when(c, F.lit(v)) for c, v in pairs])), ",")
    return rows.select("claim_id", reasons.alias("reasons"), (reasons == "").alias("valid"))


def memory(messages: DataFrame, latest: DataFrame, current_version: int, most: int = MEMORY_MESSAGES, budget: int = MEMORY_TOKENS) -> DataFrame:
    """One row for each conversation: the text of recent whole messages within the budget.

    messages: conv_id, turn, role, text; latest: conv_id, index_version. Answers of an older
    index are left out. The last ``most`` messages are walked from the newest; one that does
    not fit is passed over. What is taken is put in order of time again.
    """
    rows = messages.join(latest.select("conv_id", (F.col("index_version") != current_version).alias("stale")), "conv_id")
    total = rows.groupBy("conv_id").agg(F.count("*").alias("total"), F.max("stale").alias("stale_history"))
    live = rows.filter(~(F.col("stale") & (F.col("role") == "assistant")))
    last = live.withColumn("_n", F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("turn"), F.desc("text")))).filter(F.col("_n") <= most)
    label = F.when(F.col("role").isin("operator", "user"), "operator").otherwise("assistant")
    line = F.concat(label, F.lit(": "), F.trim(X.empty(F.col("text"))))
    item = F.struct("_n", line.alias("line"), X.memory_tokens(line).cast("long").alias("cost"))
    lists = last.groupBy("conv_id").agg(F.array_sort(F.collect_list(item)).alias("m"))
    start = F.struct(F.lit(0).cast("long").alias("used"), F.lit(0).alias("n"), F.array().cast("array<string>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        took = acc["used"] + x["cost"] <= budget
        return F.struct(
            (acc["used"] + F.when(took, x["cost"]).otherwise(0)).alias("used"), (acc["n"] + F.when(took, 1).otherwise(0)).alias("n"),
            F.when(took, F.concat(F.array(x["line"]), acc["out"])).otherwise(acc["out"]).alias("out"),
        )

    packed = total.join(lists.select("conv_id", F.aggregate("m", start, step).alias("p")), "conv_id", "left")
    used = F.coalesce("p.n", F.lit(0))
    return packed.select(
        "conv_id", F.coalesce(F.array_join("p.out", "\n"), F.lit("")).alias("text"), used.alias("messages_used"), F.coalesce("p.used", F.lit(0)).alias("tokens_used"),
        (used < F.col("total")).alias("truncated"), "stale_history",
    )


def provider_context(blocks: DataFrame, files: DataFrame, budget: int) -> DataFrame:
    """(query_id, complete, tokens): whether all exact spans of a query's blocks (path, start_line, end_line) fit the budget together."""
    lines = files.select("path", F.split("content", "\n").alias("_l"))
    span = F.array_join(F.slice("_l", F.col("start_line"), F.col("end_line") - F.col("start_line") + 1), "\n")
    cost = blocks.join(lines, "path", "left").withColumn("_c", F.when(F.col("_l").isNotNull() & (F.col("end_line") <= F.size("_l")), X.evidence_tokens(span)))
    sums = cost.groupBy("query_id").agg(F.sum("_c").alias("tokens"), F.bool_or(F.col("_c").isNull()).alias("_lost"))
    return sums.select("query_id", (~F.col("_lost") & (F.coalesce("tokens", F.lit(0)) <= budget)).alias("complete"), F.coalesce("tokens", F.lit(0)).alias("tokens"))


def answer_text(kind: Column, query: Column, titles: Column) -> Column:
    """A grounded answer by template, naming the first sources."""
    found = F.array_join(F.slice(titles, 1, 3), ", ")
    lead = X.cases(
        [
            (kind == "api_question", "The endpoints that match are in "),
            (kind == "flow_tracing", "The flow passes through "),
            (kind == "architecture_overview", "The main parts are described in "),
        ],
        "The closest sources are ",
    )
    return F.when(F.size(titles) > 0, F.concat(lead, found, F.lit("."))).otherwise(F.concat(F.lit("No indexed source answers: "), query))
