"""The queries of this subpackage, and SQL that gives the same rows where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.llm import decontaminate, html_extract, language_id, maxscore, mixing, multiprobe, runs, simhash, substring_dedup, token_counts, topk, toxicity, warc


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = substring_dedup.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"), 13)
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


OP1_SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
win AS (SELECT doc_id, i, array_to_string(ws[i:i + 12], ' ') AS k FROM (SELECT *, unnest(generate_series(1, len(ws) - 12)) AS i FROM w WHERE len(ws) > 12)),
least AS (SELECT k, min(doc_id) AS m FROM win GROUP BY k HAVING min(doc_id) < max(doc_id)),
gone AS (SELECT DISTINCT doc_id, i + j AS p FROM win JOIN least USING (k), generate_series(0, 12) g(j) WHERE doc_id > m),
kept AS (
  SELECT doc_id, array_to_string(list(x ORDER BY p), ' ') AS t
  FROM (SELECT doc_id, unnest(ws) AS x, generate_subscripts(ws, 1) AS p FROM w) ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id) LEFT JOIN (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id) USING (doc_id)
"""


def fold(n: int):
    """The remainder that parts what is learned from from what is held out."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % n


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = language_id.train(docs, fold(3) != 1)
    return language_id.predict(docs.select("doc_id", "text"), model).select("doc_id", F.coalesce(fold(3) == 1, F.lit(False)).alias("held_out"), "lang_pred", "score")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"), fold(4) != 2)
    scored = toxicity.score(docs, model)
    return scored.select("doc_id", F.coalesce(fold(4) == 2, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.length_table(token_counts.count_tokens(table(spark, sf_dir, "documents").select("text")))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


def op6_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = topk.quantised(table(spark, sf_dir, "embeddings"))
    return topk.top_k(vectors, vectors.filter(F.col("vec_id") % 50 == 0), 5)


OP6_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.e, c.e)::BIGINT AS score FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score
FROM s QUALIFY rank <= 5
"""


def op7_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = warc.resolve_revisits(warc.page_captures(table(spark, sf_dir, "pages")))
    pairs = F.transform(F.array_sort(F.map_entries("headers")), lambda e: F.concat(e["key"], F.lit(": "), e["value"]))
    return found.select("record_id", "url_key", "outcome", "original_id", F.array_join(pairs, "; ").alias("headers"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(table(spark, sf_dir, "documents")).drop("source")


OP8_SQL = r"""
WITH items AS (
  SELECT doc_id, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         CASE WHEN source IS NULL THEN '1' ELSE '0' || source END AS skey, md5('mix:' || coalesce(doc_id::VARCHAR, 'null')) AS h
  FROM documents),
sizes AS (SELECT skey, sum(size)::BIGINT AS source_size FROM items GROUP BY skey),
ranked AS (SELECT *, row_number() OVER (ORDER BY skey) AS n, 1.5::DOUBLE * (SELECT sum(source_size) FROM sizes) AS budget FROM sizes),
weighted AS (SELECT *, CASE (n - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS w, 2.0::DOUBLE * source_size AS cap FROM ranked),
levels AS (SELECT *, (budget - coalesce(sum(cap) OVER (ORDER BY cap / w, skey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(w) OVER (ORDER BY cap / w, skey ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lev FROM weighted),
targets AS (SELECT skey, source_size, budget, least(w * (SELECT max(lev) FROM levels WHERE lev <= cap / w), cap) AS target FROM levels),
queued AS (
  SELECT i.*, t.source_size, t.budget, t.target, sum(size) OVER (PARTITION BY i.skey ORDER BY h, doc_id, size ROWS UNBOUNDED PRECEDING) AS pos
  FROM items i JOIN targets t USING (skey)),
served AS (SELECT q.*, p.k, (pos + p.k * source_size) / nullif(target, 0) AS t FROM queued q, (VALUES (0), (1)) p(k)),
cuts AS (SELECT *, sum(size) OVER (ORDER BY t, skey, h, doc_id, size ROWS UNBOUNDED PRECEDING) AS run FROM served WHERE t IS NOT NULL)
SELECT doc_id, size, source_size, target, sum(CASE WHEN run <= budget THEN size ELSE 0 END)::BIGINT AS taken
FROM cuts GROUP BY doc_id, size, source_size, target, h, skey
"""

def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maxscore.rank_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), 10)


OP11_SQL = r"""
WITH words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ws FROM documents),
asked AS (
  SELECT item_id, t, count(*) AS times
  FROM (SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t FROM benchmark) GROUP BY ALL),
docs AS (SELECT doc_id, len(ws)::BIGINT AS n, ws FROM words WHERE len(ws) > 0),
stats AS (SELECT count(*)::BIGINT AS nn, sum(n)::BIGINT AS ll FROM docs),
tfs AS (SELECT doc_id, n, t, count(*) AS tf FROM (SELECT doc_id, n, unnest(ws) AS t FROM docs) WHERE t IN (SELECT t FROM asked) GROUP BY ALL),
weights AS (SELECT t, floor(1000 * ln((2 * nn + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM tfs, stats GROUP BY t, nn),
scores AS (
  SELECT item_id, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * nn) // ll))))::BIGINT AS score
  FROM asked JOIN tfs USING (t) JOIN weights USING (t), stats GROUP BY ALL)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank, doc_id, score
FROM scores WHERE score > 0 QUALIFY rank <= 10
"""


def op12_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return multiprobe.nearest(vectors, vectors.filter(F.col("vec_id") % 100 == 0), 10)


def op13_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = runs.collapse_runs(runs.with_periodic_tails(table(spark, sf_dir, "documents")), 6, 4).withColumn("best", runs.best_run(F.col("runs")))
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    told = F.concat(F.array_join(lines, "\n"), F.when(F.size("runs") > 0, "\n").otherwise(""))
    milli = F.floor(F.lit(1000) * F.col("best.length") / F.col("best.period"))
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period", milli.alias("exponent_milli"),
        F.sha2(told, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_token_counts": op2_token_counts,
    "op3_language_id": op3_language_id,
    "op4_decontamination": op4_decontamination,
    "op5_html_extraction": op5_html_extraction,
    "op6_top_k": op6_top_k,
    "op7_warc_revisits": op7_warc_revisits,
    "op8_mixing": op8_mixing,
    "op9_toxicity": op9_toxicity,
    "op10_simhash": op10_simhash,
    "op11_ranked_search": op11_ranked_search,
    "op12_nearest": op12_nearest,
    "op13_runs": op13_runs,
}
ORACLES: dict[str, str] = {"op1_substring_dedup": OP1_SQL, "op6_top_k": OP6_SQL, "op8_mixing": OP8_SQL, "op11_ranked_search": OP11_SQL}
