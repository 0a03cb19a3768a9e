"""Reads and checks around question answering: tool plans, anchors, answers, turns, transcripts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Kinds of questions that take the hybrid tool only (fixed values).
MULTI_STEP = ("architecture_overview", "flow_tracing", "impact_analysis", "api_question", "onboarding")
ANSWER = "answer string, cited array<string>"


def tools(kind: Column, exact_found: Column) -> Column:
    """The tools a question takes in order: multi-step questions the hybrid one, others the exact one and, if that finds nothing, the hybrid one."""
    return F.when(kind.isin(*MULTI_STEP), "hybrid_retrieval").when(exact_found, "exact_lookup").otherwise("exact_lookup,hybrid_retrieval")


def distinct_calls(calls: DataFrame) -> DataFrame:
    """Tool calls (turn_id, seq, tool, query) without repeats of the same tool and words."""
    words = F.lower(F.trim(F.regexp_replace("query", r"\s+", " ")))
    n = F.row_number().over(Window.partitionBy("turn_id", "tool", words).orderBy("seq"))
    return calls.withColumn("_n", n).filter("_n = 1").drop("_n")


def anchor_error(anchors: DataFrame, files: DataFrame, symbols: DataFrame) -> DataFrame:
    """Anchors (anchor_id, path, file_hash, start_line, end_line, symbol) with ``error``: file_unknown, hash_changed, range_invalid or symbol_unknown."""
    have = files.select("path", F.col("content_hash").alias("_h"), F.size(F.split("content", "\n")).alias("_n"))
    known = symbols.select("path", F.col("name").alias("symbol"), F.lit(True).alias("_k")).distinct()
    rows = anchors.join(have, "path", "left").join(known, ["path", "symbol"], "left")
    bad = (F.col("start_line") < 1) | (F.col("end_line") < F.col("start_line")) | (F.col("end_line") > F.col("_n"))
    error = F.when(F.col("_h").isNull(), "file_unknown").when(F.col("file_hash") != F.col("_h"), "hash_changed").when(bad, "range_invalid").when(F.col("symbol").isNotNull() & F.col("_k").isNull(), "symbol_unknown")
    return rows.select("anchor_id", error.alias("error"))


def parsed_answer(raw: Column, allowed: Column) -> Column:
    """(answer, cited, unknown) of a provider's JSON text: citations outside the allowed list are named apart. Null where it is no JSON."""
    got = F.from_json(raw, ANSWER)
    cited = F.coalesce(got["cited"], F.array().cast("array<string>"))
    return F.when(got["answer"].isNotNull(), F.struct(got["answer"].alias("answer"), F.array_intersect(cited, allowed).alias("cited"), F.array_except(cited, allowed).alias("unknown")))


def trace(turns: DataFrame) -> DataFrame:
    """(turn_id, sequence, event, payload) of turns (turn_id, kind, tools, action, valid), numbered from 1."""
    event = lambda name, value: F.struct(F.lit(name).alias("event"), F.substring(value.cast("string"), 1, 256).alias("payload"))
    every = F.array(event("question_classified", F.col("kind")), event("plan_created", F.col("tools")), event("sufficiency_decided", F.col("action")), event("answer_validated", F.col("valid")), event("workflow_completed", F.col("action")))
    rows = turns.select("turn_id", F.posexplode(every).alias("n", "e"))
    return rows.select("turn_id", (F.col("n") + 1).alias("sequence"), "e.event", "e.payload")


def gaps(events: DataFrame, key: str = "turn_id") -> DataFrame:
    """Turns whose events aren't numbered 1 to n."""
    n = F.row_number().over(Window.partitionBy(key).orderBy("sequence"))
    return events.withColumn("_n", n).filter("_n <> sequence").select(key).distinct()


def transcript(messages: DataFrame, most: int = 200) -> DataFrame:
    """The last ``most`` messages (conv_id, turn, role, text) of each conversation that isn't deleted, in order."""
    n = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("turn")))
    rows = messages.filter("not deleted") if "deleted" in messages.columns else messages
    kept = rows.withColumn("_n", n).filter(F.col("_n") <= most)
    return kept.withColumn("position", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn"))).drop("_n")


def evidence_of_claims(claims: DataFrame, citations: DataFrame, evidence: DataFrame) -> DataFrame:
    """(claim_id, evidence_id, path, start_line, position): a message's claims with what they cite, by path, line and id."""
    rows = claims.join(citations, "claim_id").join(evidence, "evidence_id")
    n = F.row_number().over(Window.partitionBy("claim_id").orderBy("path", "start_line", "evidence_id"))
    return rows.select("claim_id", "evidence_id", "path", "start_line", n.alias("position"))


def owned(rows: DataFrame, principal: str) -> DataFrame:
    """Rows that a principal may see; what is denied is not told apart from what is not there."""
    return rows.filter(F.col("owner_id") == principal)


def audit(rows: DataFrame, action: str) -> DataFrame:
    """Immutable audit rows of an action, with a digest of what it touched."""
    return rows.select(F.lit(action).alias("action"), F.sha2(F.to_json(F.struct(*sorted(rows.columns))), 256).alias("subject"), F.current_timestamp().alias("at"))
