"""Bounded answer rounds for all questions at once, checks of tool calls, and exact source spans under a budget."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.functions import text as X
from corpusmill.functions.tables import cut
from corpusmill.operators import assistant as AS
from corpusmill.operators import evidence as E
from corpusmill.operators import fusion as FU

#: Tools that may be called, with their versions (fixed values).
TOOLS = (("exact_lookup", "1"), ("hybrid_retrieval", "1"))
#: What a block costs beside a quarter of its characters where it goes to a provider (fixed value).
SPAN_COST = 32


@dataclass(frozen=True)
class Budget:
    """Limits of one question's work."""

    rounds: int = 2
    calls: int = 3
    evidence: int = 6
    tokens: int = 8000

    def __post_init__(self):
        if min(self.rounds, self.calls, self.evidence, self.tokens) <= 0:
            raise ValueError("budgets are over zero")
        if self.rounds > 2:
            raise ValueError("two rounds at most: what a repair finds isn't repaired again")


def _text(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def checked_calls(calls: DataFrame, repositories: DataFrame, most: int = 3, tools: tuple[tuple[str, str], ...] = TOOLS) -> DataFrame:
    """Tool calls (turn_id, seq, tool, version, repository_id, index_version, query, kind, limit) with ``state``.

    repositories: repository_id, index_version (the active one). A state is the first that
    holds: tool_unknown, input_invalid, other_index, equivalent_call, call_budget_exhausted,
    accepted. Calls are equivalent that differ in white space and case of the query only; of
    these the first by ``seq`` counts. Only calls that are sound and new use the budget. A null
    query, limit or kind is invalid, a repository that isn't known another index.
    """
    active = repositories.select("repository_id", F.col("index_version").alias("_active"))
    allowed = F.struct("tool", "version").isin(*[F.struct(F.lit(t).alias("tool"), F.lit(v).alias("version")) for t, v in tools])
    rows = calls.join(active, "repository_id", "left")
    fault = X.cases(
        [
            (~F.coalesce(allowed, F.lit(False)), "tool_unknown"),
            (~_text(F.col("query")).rlike(r"\S") | (_text(F.col("kind")) == "") | (F.coalesce("limit", F.lit(0)) <= 0), "input_invalid"),
            (~F.coalesce(F.col("index_version") == F.col("_active"), F.lit(False)), "other_index"),
        ],
        F.lit(None).cast("string"),
    )
    words = F.lower(F.trim(F.regexp_replace("query", r"\s+", " ")))
    same = ["turn_id", "tool", "version", "repository_id", "index_version", "kind", "limit", "_words", "_sound"]
    rows = rows.withColumn("_fault", fault).withColumns({"_words": words, "_sound": F.col("_fault").isNull()})
    rows = rows.withColumn("_new", F.col("_sound") & (F.row_number().over(Window.partitionBy(*same).orderBy("seq")) == 1))
    used = F.sum(F.col("_new").cast("int")).over(Window.partitionBy("turn_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0))
    state = F.coalesce("_fault", F.when(~F.col("_new"), "equivalent_call").when(used > most, "call_budget_exhausted").otherwise("accepted"))
    return rows.withColumn("state", state).drop("_active", "_fault", "_words", "_sound", "_new")


def _blocks(candidates: DataFrame, outcomes: DataFrame) -> DataFrame:
    chosen = outcomes.filter("outcome = 'selected'").select("query_id", "candidate_id")
    return candidates.join(chosen, ["query_id", "candidate_id"], "left_semi")


def answer(questions: DataFrame, exact: DataFrame, hybrid: DataFrame, repaired: DataFrame, files: DataFrame, skipped: DataFrame, budget: Budget | None = None) -> tuple[DataFrame, DataFrame]:
    """Selected blocks (query_id, candidate_id, ...) and decisions of all questions (query_id, query, kind).

    exact, hybrid, repaired: fused candidates of both tools, and of the hybrid one for the
    questions' repair queries, in the columns of ``evidence.select`` with candidate_ids and
    normalised beside. Searches read the corpus once whatever they are asked, so all may be
    made in one job; which of their results count is decided here:

    1. Each question calls the tools of its plan in order until one finds anything or its
       calls are used up. Evidence is selected from what the last call found.
    2. Where evidence is insufficient, calls are left and the kind allows it, the repair
       query's results are merged with the first ones, and evidence is selected anew.

    Decisions: query_id, kind, tools (called), calls, rounds, repair (null, repair_unchanged or
    repair_completed, by an anti-join with what was seen), selected, used_tokens, outcome (answered,
    limited, insufficient_evidence) and reasons. Questions without any candidate get a row. A
    null kind counts as, and becomes, an empty one: a plain question. Two rows of one query_id are an error of the caller.
    """
    b = budget or Budget()
    questions = questions.withColumn("kind", _text(F.col("kind")))
    found = exact.select("query_id", F.lit(True).alias("_found")).distinct()
    plan = F.split(AS.tools(F.col("kind"), F.coalesce("_found", F.lit(False))), ",")
    q = questions.join(found, "query_id", "left").withColumn("_plan", plan).withColumns({"_tools": F.slice("_plan", 1, b.calls), "_stopped": F.size("_plan") > b.calls}).drop("_found", "_plan")
    q = cut(q.withColumns({"_last": F.element_at("_tools", -1), "may_repair": ~F.col("_stopped") & F.lit(b.rounds > 1) & (F.size("_tools") < b.calls)}))
    by = lambda tool: q.filter(F.col("_last") == tool).select("query_id")
    first = cut(exact.join(by("exact_lookup"), "query_id", "left_semi").unionByName(hybrid.join(by("hybrid_retrieval"), "query_id", "left_semi")))
    chosen = E.select(first, files, skipped, b.evidence, b.tokens)[0]
    todo = cut(E.sufficiency(_blocks(first, chosen), q, F.col("may_repair")).filter("action = 'repair'").select("query_id"))

    before, after = first.join(todo, "query_id", "left_semi"), repaired.join(todo, "query_id", "left_semi")
    ids = lambda df: df.select("query_id", F.explode("candidate_ids").alias("id")).distinct()
    new = ids(after).join(ids(before), ["query_id", "id"], "left_anti").groupBy("query_id").agg(F.count("*").alias("_new"))
    same = F.lit("one").alias("config")  # both come from one configuration
    both = FU.merge(before.select("*", same), after.select("*", same)).drop("config", "position")
    facts = [c for c in first.columns if c not in both.columns or c == "candidate_id"]
    told = before.unionByName(after).select("query_id", *facts).dropDuplicates(["query_id", "candidate_id"])
    final = cut(first.join(todo, "query_id", "left_anti").unionByName(both.join(told, ["query_id", "candidate_id"])))

    outcomes, status = E.select(final, files, skipped, b.evidence, b.tokens)
    blocks = cut(_blocks(final, outcomes))
    judged = E.sufficiency(blocks, q, False).select("query_id", "action", "missing")
    rows = q.join(judged, "query_id").join(status.select("query_id", "selected", "used_tokens"), "query_id", "left").fillna(0, ["selected", "used_tokens"])
    rows = rows.join(todo.withColumn("_repaired", F.lit(True)), "query_id", "left").join(new, "query_id", "left").withColumn("_repaired", F.col("_repaired").isNotNull())
    none = F.col("selected") == 0
    outcome = F.when(F.col("_stopped"), "limited").when(none, "insufficient_evidence").when(F.col("action") != "answer", "limited").otherwise("answered")
    why = F.when(none, "no_selected_evidence").when(F.col("missing") != "", F.col("missing"))
    reasons = F.concat_ws(",", F.when(F.col("_stopped"), "tool_call_budget_exhausted"), why, F.when(outcome == "answered", "workflow_completed"))
    again = F.col("_repaired").cast("int")
    return blocks, rows.select(
        "query_id", "kind", F.array_join(F.when(F.col("_repaired"), F.concat("_tools", F.array(F.lit("hybrid_retrieval")))).otherwise(F.col("_tools")), ",").alias("tools"), (F.size("_tools") + again).alias("calls"), (1 + again).alias("rounds"),
        F.when(F.col("_repaired"), F.when(F.col("_new") > 0, "repair_completed").otherwise("repair_unchanged")).alias("repair"), "selected", "used_tokens", outcome.alias("outcome"), reasons.alias("reasons"),
    )


def source_spans(blocks: DataFrame, files: DataFrame, budget: int) -> DataFrame:
    """The exact spans that go to a provider for blocks (query_id, path, start_line, end_line, source_hash).

    files: path, indexed_hash, content (null: gone). Blocks of one file that overlap or touch
    become one span, so that no line is sent twice. A question's spans go whole or not at all:
    ``complete`` tells whether every block is of a file that is there unchanged, has lines in
    range and text, and all spans together are within the budget; ``content`` is null where
    not. A null source_hash isn't compared. Repeated blocks are one. One row for each span, with its cost in
    ``tokens`` (null where it cannot be read) and ``blocks``, the distinct blocks in it.
    """
    at = Window.partitionBy("query_id", "path").orderBy("start_line", "end_line", "source_hash")
    reach = F.max("end_line").over(at.rowsBetween(Window.unboundedPreceding, -1))
    rows = blocks.select("query_id", "path", "start_line", "end_line", "source_hash").distinct()
    apart = F.when(F.col("start_line") <= reach + 1, 0).otherwise(1)
    rows = rows.withColumn("_apart", apart).withColumn("_island", F.sum("_apart").over(at.rowsBetween(Window.unboundedPreceding, 0)))
    wrong = F.coalesce((F.col("start_line") < 1) | (F.col("end_line") < F.col("start_line")), F.lit(True))
    islands = rows.groupBy("query_id", "path", "_island").agg(
        F.min("start_line").alias("start_line"), F.max("end_line").alias("end_line"), F.count("*").alias("blocks"), F.bool_or(wrong).alias("_wrong"),
        F.min("source_hash").alias("_low"), F.max("source_hash").alias("_high"),
    )
    lines = F.split(F.regexp_replace("content", r"\n$", ""), "\n")
    have = files.select("path", F.when(F.sha2("content", 256) == F.col("indexed_hash"), lines).alias("_l"), F.col("indexed_hash").alias("_h"))
    rows = islands.join(have, "path", "left")
    sound = F.col("_l").isNotNull() & ~F.col("_wrong") & (F.col("end_line") <= F.size("_l")) & (F.coalesce("_low", "_h") == F.col("_h")) & (F.coalesce("_high", "_h") == F.col("_h"))
    span = F.when(sound, F.array_join(F.slice("_l", F.col("start_line"), F.col("end_line") - F.col("start_line") + 1), "\n"))
    rows = rows.withColumn("content", span).withColumn("content", F.when(F.col("content").rlike(r"\S"), F.col("content")))
    rows = rows.withColumn("tokens", (SPAN_COST + F.ceil(F.char_length("content") / 4)).cast("long"))
    every = Window.partitionBy("query_id")
    complete = ~F.bool_or(F.col("tokens").isNull()).over(every) & (F.coalesce(F.sum("tokens").over(every), F.lit(0)) <= budget)
    return rows.withColumn("complete", complete).select("query_id", "path", "start_line", "end_line", "blocks", "tokens", "complete", F.when(F.col("complete"), F.col("content")).alias("content"))
