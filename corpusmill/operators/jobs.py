"""Index jobs: the lease state machine, progress, history and activation of versions."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.functions.tables import cut
from corpusmill.operators import flow

LEASE_SECONDS, MAX_ATTEMPTS = 60, 3
TERMINAL = ("completed", "failed", "cancelled")
#: Allowed changes of a job's state.
TRANSITIONS = {
    "queued": ("running", "cancelled"), "running": ("completed", "failed", "retry_scheduled", "cancelled", "running"), "retry_scheduled": ("running", "cancelled"),
    "completed": (), "failed": (), "cancelled": (),
}


def allowed(before: Column, after: Column) -> Column:
    """Whether a state may follow another."""
    out = F.lit(False)
    for a, bs in TRANSITIONS.items():
        if bs:
            out = out | ((before == a) & after.isin(*bs))
    return out


class Lease:
    """State of one job and what an event makes of it; the same for batch and stream."""

    def __init__(self, state: str = "queued", attempt: int = 0, expires: float = 0.0, due: float = 0.0):
        self.state, self.attempt, self.expires, self.due = state, attempt, expires, due

    def apply(self, kind: str, at: float) -> str:
        """kind: claim, heartbeat, complete, fail or cancel, at a time in seconds; the outcome."""
        if self.state in TERMINAL:
            return "terminal"
        if kind == "cancel":
            self.state = "cancelled"
            return "cancelled"
        if kind == "claim":
            if self.state == "running" and at < self.expires:
                return "fenced"
            if self.state == "retry_scheduled" and at < self.due:
                return "deferred"
            if self.attempt >= MAX_ATTEMPTS:
                self.state = "failed"
                return "attempts_exhausted"
            again = self.state == "running"
            self.state, self.attempt, self.expires = "running", self.attempt + 1, at + LEASE_SECONDS
            return "recovered" if again else "started"
        if self.state != "running" or at >= self.expires:
            return "lease_lost"
        if kind == "heartbeat":
            self.expires = at + LEASE_SECONDS
            return "extended"
        if kind == "complete":
            self.state = "completed"
            return "completed"
        if self.attempt >= MAX_ATTEMPTS:
            self.state = "failed"
            return "failed"
        self.state, self.due = "retry_scheduled", at + min(60.0, 2.0 ** (self.attempt - 1))
        return "retry_scheduled"


def replay(events: DataFrame) -> DataFrame:
    """(job_id, seq, outcome, state, attempt) for every event (job_id, seq, kind, at), each job's in order of at and seq.

    A job's events are the bounded history of one lease; jobs are spread by a shuffle.
    """

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        lease, rows = Lease(), []
        for e in frame.sort_values(["at", "seq"], kind="stable").itertuples():
            outcome = lease.apply(e.kind, float(e.at))
            rows.append((e.job_id, e.seq, outcome, lease.state, lease.attempt))
        return pd.DataFrame(rows, columns=["job_id", "seq", "outcome", "state", "attempt"])

    return events.groupBy("job_id").applyInPandas(run, "job_id long, seq long, outcome string, state string, attempt int")


def stream_step(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
    """``replay`` for ``applyInPandasWithState``: the lease is the state."""
    lease = Lease(*state.get) if state.exists else Lease()
    rows = []
    for frame in frames:
        for e in frame.sort_values(["at", "seq"], kind="stable").itertuples():
            rows.append((key[0], e.seq, lease.apply(e.kind, float(e.at)), lease.state, lease.attempt))
    state.update((lease.state, lease.attempt, lease.expires, lease.due))
    yield pd.DataFrame(rows, columns=["job_id", "seq", "outcome", "state", "attempt"])


def replay_stream(events: DataFrame) -> DataFrame:
    return events.groupBy("job_id").applyInPandasWithState(
        stream_step, "job_id long, seq long, outcome string, state string, attempt int", "state string, attempt int, expires double, due double", "append", "NoTimeout"
    )


def attempts(events: DataFrame) -> DataFrame:
    """Claims numbered within their job."""
    return events.filter("kind = 'claim'").withColumn("attempt", F.row_number().over(Window.partitionBy("job_id").orderBy("at", "seq")))


def progress(processed: Column, total: Column, active: Column) -> Column:
    return F.when(active, 100).otherwise(F.floor(100 * processed / F.greatest(total, F.lit(1)))).cast("int")


def history(events: DataFrame, most: int = 50) -> DataFrame:
    """The last ``most`` events of each job, newest first."""
    n = F.row_number().over(Window.partitionBy("job_id").orderBy(F.desc("at"), F.desc("seq")))
    return events.withColumn("position", n).filter(F.col("position") <= most)


def activation_error(version: Column, expected: Column, active: Column, state: Column) -> Column:
    """Why a version cannot become the active one, null where it can; repeating an activation is fine."""
    return F.when(version == active, None).when(state != "validated", "not_validated").when(~expected.eqNullSafe(active), "active_version_changed")


def repaired_status(job_state: Column, repository_state: Column) -> Column:
    """The repository's status where a job that has ended, or is gone, left it indexing."""
    return F.when((repository_state == "indexing") & (job_state.isNull() | job_state.isin("failed", "cancelled")), "failed").when((repository_state == "indexing") & (job_state == "completed"), "indexed").otherwise(repository_state)


def readiness(specs: DataFrame, states: DataFrame) -> DataFrame:
    """(capability, state): each capability's state after those that it depends on, see ``flow.dependency_states``.

    specs: capability, depends_on (array). A cycle, an unknown dependency, or capabilities with only a state or only a specification are an error.
    """
    found = cut(flow.dependency_states(specs, states))
    if not states.select("capability").exceptAll(specs.select("capability")).isEmpty() or not specs.select("capability").exceptAll(states.select("capability")).isEmpty():
        raise ValueError("states and specifications name different capabilities")
    if not found.filter("state = 'cycle'").isEmpty():
        raise ValueError("capabilities depend on each other in a cycle")
    if not found.filter(F.array_contains("reasons", "UNKNOWN_DEPENDENCY")).isEmpty():
        raise ValueError("unknown capability")
    return found.select("capability", "state")
