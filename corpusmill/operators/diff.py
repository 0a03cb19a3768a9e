"""Snapshots of a corpus compared: changes, moves, what must be rebuilt, equivalence and incremental merges."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.functions.tables import cut

KINDS = ("documentation", "structure", "public_api", "dependency")
FAMILIES = ("file", "symbol", "endpoint", "reference", "chunk", "graph_node", "graph_edge", "retrieval", "embedding")


@dataclass(frozen=True)
class Limits:
    files: int = 500
    depth: int = 4
    fraction: float = 0.5


def compare_files(before: DataFrame, after: DataFrame) -> DataFrame:
    """(path, state): added, deleted, changed or unchanged by content hash."""
    b, a = before.select("path", F.col("content_sha256").alias("b")), after.select("path", F.col("content_sha256").alias("a"))
    state = F.when(F.col("b").isNull(), "added").when(F.col("a").isNull(), "deleted").when(F.col("a") != F.col("b"), "changed").otherwise("unchanged")
    return b.join(a, "path", "full_outer").select("path", state.alias("state"))


def classify(before: DataFrame, after: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Changes (previous_key, current_key, kinds) and (ambiguous) whether some move could not be told.

    Keys in both snapshots change in the dimensions whose hashes differ, in ``content`` if
    only the content or size does. A deleted and an added key of one content hash are a move
    where each is the only one of its hash; hashes with more are ambiguous and stay added
    and deleted.
    """
    cols = [c for c in before.columns if c not in ("file_key", "path")]
    b = before.select("file_key", *[F.col(c).alias(f"b_{c}") for c in cols])
    a = after.select("file_key", *[F.col(c).alias(f"a_{c}") for c in cols])
    both = cut(b.join(a, "file_key", "full_outer"))
    differs = lambda c: F.col(f"b_{c}") != F.col(f"a_{c}")
    kept = both.filter("b_content_sha256 is not null and a_content_sha256 is not null")
    dims = F.array_compact(F.array(*[F.when(differs(f"{k}_sha256"), F.lit(k)) for k in KINDS]))
    content = differs("content_sha256") | differs("normalized_sha256") | differs("byte_size")
    kinds = F.array_join(F.when((F.size(dims) == 0) & content, F.array(F.lit("content"))).otherwise(dims), ",")
    changed = kept.select(F.col("file_key").alias("previous_key"), F.col("file_key").alias("current_key"), kinds.alias("kinds")).filter("kinds <> ''")
    old = both.filter("a_content_sha256 is null").select("file_key", F.col("b_content_sha256").alias("h"))
    new = both.filter("b_content_sha256 is null").select("file_key", F.col("a_content_sha256").alias("h"))
    one = lambda df, name: df.groupBy("h").agg(F.count("*").alias(f"{name}_n"), F.min("file_key").alias(name))
    pairs = cut(one(old, "o").join(one(new, "n"), "h"))
    moves = pairs.filter("o_n = 1 and n_n = 1").select(F.col("o").alias("previous_key"), F.col("n").alias("current_key"), F.lit("moved").alias("kinds"))
    added = new.join(moves.select(F.col("current_key").alias("file_key")), "file_key", "left_anti").select(F.lit(None).cast("string").alias("previous_key"), F.col("file_key").alias("current_key"), F.lit("added").alias("kinds"))
    gone = old.join(moves.select(F.col("previous_key").alias("file_key")), "file_key", "left_anti").select(F.col("file_key").alias("previous_key"), F.lit(None).cast("string").alias("current_key"), F.lit("deleted").alias("kinds"))
    return changed.union(moves).union(added).union(gone), pairs.agg(F.coalesce(F.bool_or((F.col("o_n") > 1) | (F.col("n_n") > 1)), F.lit(False)).alias("ambiguous"))


def valid_dependencies(edges: DataFrame, before: DataFrame, after: DataFrame) -> DataFrame:
    """One row (duplicates, unknown_ends): edges named twice, and edges with an end that neither snapshot has."""
    known = before.select("file_key").union(after.select("file_key")).distinct()
    twice = edges.groupBy(*edges.columns).count().agg(F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).alias("duplicates"))
    lost = edges.join(known.withColumnRenamed("file_key", "source_file_key"), "source_file_key", "left_anti").select("source_file_key", "target_file_key").union(
        edges.join(known.withColumnRenamed("file_key", "target_file_key"), "target_file_key", "left_anti").select("source_file_key", "target_file_key")
    )
    return twice.crossJoin(lost.distinct().agg(F.count("*").alias("unknown_ends")))


def closure(changes: DataFrame, edges: DataFrame, after: DataFrame, depth: int) -> DataFrame:
    """(file_key, depth): files of the later snapshot to rebuild: changed ones, and what depends on changed, moved or deleted ones.

    Follows edges backwards level by level, ``depth`` levels and one more: rows past
    ``depth`` tell that the limit was passed.
    """
    current = after.select("file_key").distinct()
    changed = changes.select(F.col("current_key").alias("file_key")).filter("file_key is not null").distinct()
    front = changes.select(F.explode(F.array("previous_key", "current_key")).alias("file_key")).filter("file_key is not null").distinct()
    seen = changed.withColumn("depth", F.lit(0))
    back = edges.select(F.col("target_file_key").alias("file_key"), F.col("source_file_key").alias("dependent")).distinct()
    for level in range(1, depth + 2):
        found = front.join(back, "file_key").select(F.col("dependent").alias("file_key")).distinct().join(current, "file_key", "left_semi").join(seen, "file_key", "left_anti")
        front = cut(found)
        if front.isEmpty():
            break
        seen = seen.union(front.withColumn("depth", F.lit(level)))
    return seen


def plan(before: DataFrame, after: DataFrame, edges: DataFrame, limits: Limits, same_components: bool = True) -> tuple[str, str | None, DataFrame]:
    """Mode (incremental or full), the reason of a full one, and (file_key, action): rebuild, reuse or delete."""
    changes, ambiguous = classify(before, after)
    changes = cut(changes)
    current = after.select("file_key")
    dropped = before.select("file_key").join(current, "file_key", "left_anti").withColumn("action", F.lit("delete"))
    full = current.withColumn("action", F.lit("rebuild")).union(dropped)
    if not same_components:
        return "full", "component_incompatible", full
    if ambiguous.first()[0]:
        return "full", "ambiguous_move", full
    bad = valid_dependencies(edges, before, after).first()
    if bad.duplicates or bad.unknown_ends:
        return "full", "dependency_graph_invalid", full
    reach = cut(closure(changes, edges, after, limits.depth))
    row = reach.agg(F.count("*").alias("n"), F.coalesce(F.max("depth"), F.lit(0)).alias("deep")).first()
    if row.deep > limits.depth:
        return "full", "dependency_depth_limit", full
    if row.n > limits.files:
        return "full", "affected_file_limit", full
    if row.n / max(1, current.count()) > limits.fraction:
        return "full", "affected_fraction_limit", full
    again = reach.select("file_key", F.lit("rebuild").alias("action"))
    return "incremental", None, again.union(current.join(reach, "file_key", "left_anti").withColumn("action", F.lit("reuse"))).union(dropped)


def merge(previous: DataFrame, parsed: DataFrame, affected: DataFrame, key: str = "path") -> DataFrame:
    """Rows of earlier files that aren't affected, and all newly parsed rows."""
    return previous.join(affected.select(key).distinct(), key, "left_anti").select(previous.columns).unionByName(parsed)


def equivalence(full: DataFrame, incremental: DataFrame) -> DataFrame:
    """Differences of two snapshots (family, canonical_key, sha256): missing_from_full, missing_from_incremental, digest_mismatch."""
    key = ["family", "canonical_key"]
    both = full.select(*key, F.col("sha256").alias("f")).join(incremental.select(*key, F.col("sha256").alias("i")), key, "full_outer")
    kind = F.when(F.col("f").isNull(), "missing_from_full").when(F.col("i").isNull(), "missing_from_incremental").when(F.col("f") != F.col("i"), "digest_mismatch")
    return both.select(*key, kind.alias("difference")).filter("difference is not null")


def fingerprint(files: DataFrame, by: list[str] | None = None) -> DataFrame:
    """sha256 over ``path NUL size NUL hash NL`` of all files in path order, for each ``by``.

    A group's lines are one string in one task, as the digest is defined over all of them in
    order: some 100 bytes a file, and an error past 2 GB, so 20 million files in a group.
    """
    line = F.concat("path", F.lit("\0"), F.col("size_bytes").cast("string"), F.lit("\0"), "content_hash", F.lit("\n"))
    ordered = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("path", line.alias("line")))), lambda x: x["line"]), "")
    grouped = files.groupBy(*(by or []))
    return grouped.agg(F.sha2(ordered, 256).alias("fingerprint"), F.count("*").alias("files"))


def stale(evidence: DataFrame, current: DataFrame, key: str = "repository_id") -> DataFrame:
    """``evidence`` with whether its index_version is older than its repository's current one."""
    return evidence.join(current.select(key, F.col("index_version").alias("_v")), key, "left").withColumn("stale", F.coalesce(F.col("index_version") < F.col("_v"), F.lit(False))).drop("_v")


def latest(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """Upserted rows: of each key the last by ``order``."""
    n = F.row_number().over(Window.partitionBy(*key).orderBy(*[F.desc(c) for c in order]))
    return rows.withColumn("_n", n).filter("_n = 1").drop("_n")
