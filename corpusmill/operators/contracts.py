"""Contracts of tables as named conditions; ``files.violations`` lists the rows that break them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusmill.operators.fusion import RETRIEVERS, SUPPORT

SHA = "^[0-9a-f]{64}$"
c = F.col


def candidates() -> dict[str, Column]:
    """Retrieval candidates."""
    return {
        "retriever_known": c("retriever").isin(*RETRIEVERS), "support_known": c("support").isin(*SUPPORT), "rank_positive": c("rank") > 0, "score_positive": (c("score") > 0) & (F.abs("score") < float("inf")),
        "reasons_given": F.size("reasons") > 0, "lines_in_order": (c("start_line") >= 1) & (c("end_line") >= c("start_line")),
    }


def references() -> dict[str, Column]:
    """Resolved references (outcome, targets: array, reason): one target if resolved, two or more if ambiguous, none and a reason else."""
    n = F.size("targets")
    sound = F.when(c("outcome") == "resolved", n == 1).when(c("outcome") == "ambiguous", n >= 2).otherwise((n == 0) & c("reason").isNotNull())
    return {"targets_fit_outcome": sound, "targets_sorted_once": c("targets") == F.array_sort(F.array_distinct("targets"))}


def fingerprints() -> dict[str, Column]:
    """File fingerprints."""
    hashes = ("content_sha256", "normalized_sha256", "documentation_sha256", "structure_sha256", "public_api_sha256", "dependency_sha256")
    return {"key_shape": c("file_key").startswith("file:v1:"), "size_positive": c("byte_size") >= 0, "path_plain": ~c("path").rlike(r"^/|(^|/)\.{1,2}(/|$)|\\")} | {h: c(h).rlike(SHA) for h in hashes}


def vectors(dimension: int) -> dict[str, Column]:
    """Dense index rows (chunk_id, embedding): one dimension, finite, norm over zero."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return {"dimension": F.size("embedding") == dimension, "finite": finite, "norm": F.exists("embedding", lambda x: x != 0), "dimension_range": F.size("embedding").between(1, 8192)}


def capabilities() -> dict[str, Column]:
    """Capability evidence (units, succeeded, failed, artifacts, issues)."""
    return {"counts_add_up": c("units") == c("succeeded") + c("failed"), "artifacts_once": F.size(F.array_distinct("artifacts")) == F.size("artifacts"), "issues_once": F.size(F.array_distinct("issues")) == F.size("issues")}


def jobs() -> dict[str, Column]:
    """Index jobs: prefixed ids, known states, a lease exactly while running."""
    return {
        "id_prefix": c("job_id").startswith("job_"), "state_known": c("state").isin("queued", "running", "retry_scheduled", "completed", "failed", "cancelled"),
        "attempt_range": c("attempt").between(0, 3), "lease_paired": (c("state") == "running") == c("lease_expires").isNotNull(),
    }


def coverage(success: Column, total: Column) -> Column:
    """Share of units that succeeded, to six digits; 1 where there is none."""
    return F.when(total > 0, F.round(success / total, 6)).otherwise(1.0)


def manifests() -> dict[str, Column]:
    """Index manifests (repository_id, index_version_id, base_index_version_id, sequence, artifacts: type and uri, status, validation, critical_issues)."""
    ready, warned = c("status") == "ready", c("status") == "ready_with_warnings"
    fits = F.when(ready, c("validation") == "passed").when(warned, c("validation") == "passed_with_warnings").otherwise(True)
    return {
        "repository_prefix": c("repository_id").startswith("repo_"), "index_prefix": c("index_version_id").startswith("idx_"), "base_differs": c("base_index_version_id").isNull() | (c("base_index_version_id") != c("index_version_id")),
        "sequence_positive": c("sequence") > 0, "artifacts_once": F.size(F.array_distinct("artifacts")) == F.size("artifacts"),
        "status_known": c("status").isin("building", "validating", "ready", "ready_with_warnings", "failed", "cancelled"), "status_fits_validation": fits, "ready_without_critical": ~(ready | warned) | (c("critical_issues") == 0),
    }
