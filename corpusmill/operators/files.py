"""Read models over file tables: scans, overviews, important files, modules, stacks, gaps, quotas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.functions import paths as P
from corpusmill.functions import text as X


def scan(files: DataFrame, most: int = 1_000_000) -> DataFrame:
    """Files (path, size_bytes) with language, file_type and skip_reason."""
    return files.withColumns({"language": P.language(F.col("path")), "file_type": P.file_type(F.col("path")), "skip_reason": P.skip_reason(F.col("path"), F.col("size_bytes"), most)})


def scan_totals(scanned: DataFrame) -> DataFrame:
    took = F.col("skip_reason").isNull()
    return scanned.agg(F.count("*").alias("files"), F.sum("size_bytes").alias("size"), F.count_if(took).alias("supported"), F.coalesce(F.sum(F.when(took, F.col("size_bytes"))), F.lit(0)).alias("supported_size"))


def skip_summary(scanned: DataFrame) -> DataFrame:
    return scanned.filter("skip_reason is not null").groupBy("skip_reason").agg(F.count("*").alias("n"))


def language_counts(scanned: DataFrame) -> DataFrame:
    return scanned.filter("skip_reason is null").groupBy("language").agg(F.count("*").alias("files"), F.count_if(F.col("file_type") == "test").alias("tests"), F.sum("size_bytes").alias("size"))


#: Extra seconds for each file of a language (fixed values of our own estimate).
SECONDS = {"python": 0.02, "typescript": 0.02, "javascript": 0.02, "java": 0.015}


def index_seconds(scanned: DataFrame) -> DataFrame:
    extra = X.cases([(F.col("language") == k, v) for k, v in SECONDS.items()], 0.0)
    took = F.col("skip_reason").isNull()
    total = 0.03 * F.count_if(took) + 0.15 * F.coalesce(F.sum(F.when(took, F.col("size_bytes"))), F.lit(0)) / 1_048_576 + F.coalesce(F.sum(F.when(took, extra)), F.lit(0.0))
    return scanned.agg(F.greatest(F.lit(1), F.ceil(F.round(total, 6))).cast("long").alias("seconds"))


def important(files: DataFrame, most: int = 8) -> DataFrame:
    """(position, path, reason): files to read first, by kind and path."""
    rank = P.important_rank(F.col("path"))
    rows = files.select("path", rank.alias("r")).filter("r is not null").orderBy("r", "path").limit(most)
    return rows.select(F.row_number().over(Window.orderBy("r", "path")).alias("position"), "path", P.important_reason(F.col("r")).alias("reason"))


def reading_path(files: DataFrame) -> DataFrame:
    """The first seven important files as steps, surer the earlier they come."""
    rows = important(files).filter("position <= 7")
    return rows.select("position", "path", F.concat(F.lit("Read "), P.name(F.col("path"))).alias("title"), F.round(F.lit(0.95) - 0.05 * (F.col("position") - 1), 2).alias("confidence"))


def modules(files: DataFrame, most: int = 8) -> DataFrame:
    parts = P.parts(F.col("path"))
    name = F.when(F.size(parts) > 1, F.element_at(parts, -2)).otherwise("root")
    return files.groupBy(name.alias("module")).agg(F.count("*").alias("files")).orderBy("module").limit(most)


def gaps(files: DataFrame, endpoints: DataFrame) -> DataFrame:
    """(gap) messages of what a corpus lacks; one that says so if it lacks nothing."""
    row = files.agg(
        F.coalesce(F.bool_or(F.lower(P.name(F.col("path"))).startswith("readme")), F.lit(False)).alias("readme"), F.coalesce(F.bool_or(F.lower("path").contains("test")), F.lit(False)).alias("tests")
    ).crossJoin(endpoints.agg((F.count("*") > 0).alias("endpoints")))
    texts = [(~F.col("readme"), "Repository has no README indexed."), (~F.col("tests"), "No test files were detected."), (~F.col("endpoints"), "No FastAPI endpoint was detected.")]
    found = F.array_compact(F.array(*[F.when(c, F.lit(t)) for c, t in texts]))
    return row.select(F.explode(F.when(F.size(found) > 0, found).otherwise(F.array(F.lit("No major documentation gap detected by MVP rules.")))).alias("gap"))


def stack(files: DataFrame, frameworks: DataFrame) -> DataFrame:
    """(name): display names of languages, and frameworks."""
    lang = P.language(F.col("path"))
    shown = X.cases([(lang == k, v[0]) for k, v in P.LANGUAGES.items() if k != "config"], F.lit(None).cast("string"))
    return files.select(shown.alias("name")).filter("name is not null").union(frameworks.select("framework")).distinct()


def quota(files: DataFrame, most_files: int, most_bytes: int) -> DataFrame:
    """Files (seq, path, size_bytes) in order with running totals and the first violation of a quota.

    Order matters here by definition; the running sum is taken per block of 65,536 places of
    ``seq`` and carried over the blocks' totals, so no task orders all files.
    """
    rows = files.withColumn("_b", F.floor(F.col("seq") / 65536))
    blocks = rows.groupBy("_b").agg(F.count("*").alias("_n"), F.sum("size_bytes").alias("_s"))
    before = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_n0"), F.coalesce(F.sum("_s").over(before), F.lit(0)).alias("_s0"))
    w = Window.partitionBy("_b").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({"_n": F.count("*").over(w), "_s": F.sum("size_bytes").over(w)}).join(blocks, "_b")
    n, s = F.col("_n") + F.col("_n0"), F.col("_s") + F.col("_s0")
    state = F.when(n > most_files, "file_count_exceeded").when(s > most_bytes, "size_exceeded").otherwise("ok")
    return rows.select("seq", "path", n.alias("running_files"), s.alias("running_bytes"), state.alias("state"))


def duplicates(files: DataFrame) -> DataFrame:
    """Paths whose identity (case folded) an earlier file has."""
    n = F.row_number().over(Window.partitionBy(F.lower("path")).orderBy("seq"))
    return files.withColumn("_n", n).filter("_n > 1").drop("_n")


def symbols_like(symbols: DataFrame, query: str, kind: str | None = None, most: int = 100) -> DataFrame:
    """The first ``most`` symbols (seq, name, path, symbol_type) with the text in name or path."""
    low = query.lower()
    rows = symbols.filter(F.lower("name").contains(low) | F.lower("path").contains(low))
    return (rows.filter(F.col("symbol_type") == kind) if kind else rows).orderBy("seq").limit(most)


def import_duplicates(repositories: DataFrame, fingerprint: str, name: str, label: str, most: int = 5) -> DataFrame:
    """Earlier imports (repository_id, fingerprint, name, label) that may be the same, with the reason, strongest first."""
    reason = F.when(F.col("fingerprint") == fingerprint, "same_fingerprint").when(F.lower("name") == name.lower(), "same_name").when(F.lower("label") == label.lower(), "same_label")
    return repositories.withColumn("reason", reason).filter("reason is not null").orderBy("repository_id").limit(most)


def file_content(files: DataFrame, symbols: DataFrame, path: str) -> DataFrame:
    """One file's lines and its symbols in order."""
    names = symbols.filter(F.col("path") == path).groupBy("path").agg(F.array_sort(F.collect_list(F.struct("start_line", "name"))).alias("symbols"))
    return files.filter(F.col("path") == path).select("path", F.split("content", "\n").alias("lines")).join(names, "path", "left")


def summary_chunks(files: DataFrame, chunks: DataFrame) -> DataFrame:
    """A file_summary chunk for each file without one."""
    have = chunks.filter("chunk_type = 'file_summary'").select("path").distinct()
    return files.join(have, "path", "left_anti").select("path", F.lit("file_summary").alias("chunk_type"), F.concat("path", F.lit(" ("), "language", F.lit(", "), "file_type", F.lit(")")).alias("content"))


def semantic_summaries(files: DataFrame, symbols: DataFrame, endpoints: DataFrame) -> DataFrame:
    """A text for each file of its first eight symbols, five endpoints and its layer."""
    first = lambda df, item, n: F.array_join(F.slice(F.transform(F.array_sort(F.collect_list(F.struct("seq", item))), lambda x: x[item]), 1, n), ", ")
    s = symbols.groupBy("path").agg(first(symbols, "name", 8).alias("_s"))
    e = endpoints.groupBy("path").agg(first(endpoints, "route", 5).alias("_e"))
    rows = files.join(s, "path", "left").join(e, "path", "left")
    text = F.concat_ws(" ", F.concat(F.lit("File "), "path", F.lit(".")), F.when(F.col("_s").isNotNull(), F.concat(F.lit("Symbols: "), "_s", F.lit("."))), F.when(F.col("_e").isNotNull(), F.concat(F.lit("Endpoints: "), "_e", F.lit("."))), F.concat(F.lit("Layer: "), P.layer(F.lit("file"), F.col("path")), F.lit(".")))
    return rows.select("path", F.lit("semantic_summary").alias("chunk_type"), text.alias("content"))


def violations(rows: DataFrame, rules: dict[str, Column], key: str) -> DataFrame:
    """(key, rule) for every row and rule that does not hold; a null outcome does not hold."""
    bad = F.array_compact(F.array(*[F.when(~F.coalesce(c, F.lit(False)), F.lit(k)) for k, c in rules.items()]))
    return rows.select(F.col(key), F.explode(bad).alias("rule"))
