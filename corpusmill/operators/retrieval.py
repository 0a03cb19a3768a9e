"""Retrieval over chunk tables for many queries at once: lexical, fuzzy, sparse, dense, exact, graph context."""

from __future__ import annotations

from difflib import SequenceMatcher

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.functions import text as X
from corpusmill.functions.tables import cut
from corpusmill.operators import scoring

K1, B = 1.2, 0.75
#: What each retriever adds to a text score (fixed values).
OFFSETS = {"symbol": 2.0, "endpoint": 2.5, "metadata": 1.0, "graph": 1.25}
SEMANTIC_WEIGHT = 6.5
CONTEXT_SCORE = 1.25
CONTEXT_TYPES = ("function", "method", "endpoint", "api_call", "file_summary")


def postings(rows: DataFrame, key: str = "chunk_id", text: str = "haystack") -> DataFrame:
    """(key, token, tf, length): how often each row has each of its tokens, and how many tokens it has."""
    tok = rows.select(key, X.tokens(F.col(text)).alias("_t"))
    return tok.select(key, F.size("_t").alias("length"), F.explode("_t").alias("token")).groupBy(key, "length", "token").agg(F.count("*").alias("tf"))


def corpus_stats(chunks: DataFrame, posts: DataFrame | None = None) -> DataFrame:
    """One row: chunks (n_chunks, 1 at least) and mean number of tokens (avg_tokens) of ``haystack``."""
    posts = postings(chunks) if posts is None else posts
    n = chunks.agg(F.greatest(F.count("*"), F.lit(1)).alias("n_chunks"))
    return n.crossJoin(posts.agg(F.coalesce(F.sum("tf"), F.lit(0)).alias("_t"))).select("n_chunks", (F.col("_t") / F.col("n_chunks")).alias("avg_tokens"))  # one row each


def term_idf(chunks: DataFrame, queries: DataFrame, posts: DataFrame | None = None) -> DataFrame:
    """(term, df, idf) of all terms of the queries; terms that no chunk has included.

    Only tokens that some query asks for are shuffled.
    """
    asked = queries.select(F.explode(X.query_terms(F.col("query"))).alias("term")).distinct()
    posts = postings(chunks) if posts is None else posts
    seen = posts.select(F.col("token").alias("term")).join(asked, "term").groupBy("term").agg(F.count("*").alias("df"))
    stats = corpus_stats(chunks, posts)
    n, df = F.col("n_chunks"), F.coalesce("df", F.lit(0))
    return asked.join(seen, "term", "left").crossJoin(stats).select("term", df.alias("df"), F.log(1 + (n - df + 0.5) / (df + 0.5)).alias("idf"))


def containing(texts: DataFrame, text: str, parts: DataFrame, part: str) -> DataFrame:
    """(text, part): all distinct texts and distinct parts, not empty, such that the text holds the part.

    The texts' substrings, of just the lengths that parts have, meet whole parts in an equi-join: no
    key stands for more than one part, however alike parts begin. Texts are short (tokens, questions).
    """
    asked = parts.select(part).filter(F.length(part) > 0).distinct()
    sizes = asked.select(F.length(part).alias("_n")).distinct()
    some = texts.select(text).distinct().join(sizes, F.length(text) >= F.col("_n"))  # a row for each length that occurs
    cuts = F.transform(F.sequence(F.lit(1), F.length(text) - F.col("_n") + 1), lambda i: F.substr(F.col(text), i, F.col("_n")))
    return some.select(text, F.explode(F.array_distinct(cuts)).alias(part)).join(asked, part).select(text, part)


def bm25(terms: Column, tokens: Column, avg_tokens: Column) -> Column:
    """Sum over terms (term, idf) of idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * length / average))."""
    length = F.size(tokens)

    def one(acc: Column, t: Column) -> Column:
        tf = F.size(F.filter(tokens, lambda x: x == t["term"]))
        norm = tf + K1 * (1 - B + B * length / F.greatest(avg_tokens, F.lit(1.0)))
        return acc + F.when(tf > 0, t["idf"] * (tf * (K1 + 1)) / norm).otherwise(0.0)

    return F.aggregate(terms, F.lit(0.0), one)


def similarity_ratio(a: str, b: str) -> float:
    return SequenceMatcher(None, a, b).ratio()


#: Terms that a pass over the tokens is made for, and tokens and terms compared at a time.
TERMS, STRIP = 1 << 13, 64


def _letters(words: list[str]) -> np.ndarray:
    """How many characters of each word fall into each of 64 classes."""
    size = np.array([len(w) for w in words], np.int64)
    code = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64) & 63
    counts = np.bincount(np.repeat(np.arange(len(words)), size) * 64 + code, minlength=64 * len(words))
    return np.minimum(counts, 255).reshape(len(words), 64).astype(np.uint8)


def _alike(terms: list[str]):
    """Tokens to (term, token, ratio) of 0.76 or more. Letters in common, whatever their order, bound the ratio."""
    letters, sizes = _letters(terms), np.array([len(t) for t in terms])

    def run(frames):
        match = SequenceMatcher()
        for frame in frames:
            for at in range(0, len(frame), 1024):
                tokens = frame["token"].iloc[at : at + 1024].tolist()
                have, long = _letters(tokens), np.array([len(t) for t in tokens])
                out = []
                for k in range(0, len(terms), STRIP):
                    both = long[:, None] + sizes[None, k : k + STRIP]
                    fits = 2 * np.minimum(long[:, None], sizes[None, k : k + STRIP]) >= 0.76 * both - 1e-9
                    row = np.flatnonzero(fits.any(1))
                    common = np.minimum(have[row, None, :], letters[None, k : k + STRIP, :]).sum(2, dtype=np.int64)
                    r, c = np.nonzero(fits[row] & (2 * common >= 0.76 * both[row] - 1e-9))
                    last = -1
                    for i, j in zip(row[r].tolist(), (c + k).tolist(), strict=True):
                        if i != last:
                            match.set_seq2(tokens[i])
                            last = i
                        match.set_seq1(terms[j])
                        ratio = match.ratio()
                        if ratio >= 0.76:
                            out.append((terms[j], tokens[i], ratio))
                if out:
                    yield pd.DataFrame(out, columns=["term", "token", "ratio"])

    return run


def fuzzy_pairs(words: DataFrame, asked: DataFrame) -> DataFrame:
    """(term, token, ratio): distinct terms and tokens whose ratio is 0.76 or more.

    The terms of the questions, a stated set, go over all distinct tokens in blocks of ``TERMS``;
    the ratio is a Python function and runs where lengths and letters in common let it reach 0.76.
    """
    spark = words.sparkSession
    terms = asked.select("term").filter("term is not null").distinct()
    blocks = max(1, -(-terms.count() // TERMS))
    tokens = words.select("token").filter("token is not null").distinct().repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "token")
    found = None
    for block in range(blocks):
        some = sorted(r.term for r in (terms if blocks == 1 else terms.filter(F.pmod(F.xxhash64("term"), F.lit(blocks)) == block)).collect())
        rows = tokens.mapInPandas(_alike(some), "term string, token string, ratio double")
        found = rows if found is None else found.union(rows)
    return found


def fuzzy_worth(ratio: Column) -> Column:
    """What the best ratio of a term adds."""
    return F.when(ratio >= 0.88, 1.2).when(ratio >= 0.76, 0.55).otherwise(0.0)


def fuzzy_scores(terms: DataFrame, tokens: DataFrame) -> DataFrame:
    """(query_id, id, fuzzy): per term the best ratio with any token of the row gives 1.2 from 0.88 on, 0.55 from 0.76 on.

    terms: (query_id, term); tokens: (id, token).
    """
    pairs = fuzzy_pairs(tokens, terms)
    best = terms.join(pairs, "term").join(tokens.distinct(), "token").groupBy("query_id", "id", "term").agg(F.max("ratio").alias("ratio"))
    return best.groupBy("query_id", "id").agg(F.sum(fuzzy_worth(F.col("ratio"))).alias("fuzzy"))


def rank(scored: DataFrame, by: list[str], score: str = "score", tie: list[str] = ("chunk_id",)) -> DataFrame:
    """``rank`` from 1 within each ``by``, highest score first, ties by ``tie``."""
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(score), *tie)))


def first_per_chunk(seeds: DataFrame, by: list[str], score: str = "score", tie: list[str] = ("title",)) -> DataFrame:
    """The best seed of each chunk, as one chunk can be found by several names."""
    order = Window.partitionBy(*by, "chunk_id").orderBy(F.desc(score), *tie)
    return seeds.withColumn("_n", F.row_number().over(order)).filter("_n = 1").drop("_n")


def asked_terms(queries: DataFrame) -> DataFrame:
    """(query_id, pos, term, n_terms) of every question that has terms."""
    terms = X.query_terms(F.col("query"))
    return queries.select("query_id", F.posexplode(terms).alias("pos", "term"), F.size(terms).alias("n_terms"))


def term_hits(rows: DataFrame, queries: DataFrame, fuzzy: bool = True) -> tuple[DataFrame, DataFrame]:
    """What is scored of rows (kind, id, haystack) of all kinds at once, and each kind's size.

    Hits are (kind, id, length, term, tf, held, ratio): the terms of any question that a row holds as a
    token (``tf`` times), inside one (``held``), or that are alike to one (``ratio``, if ``fuzzy``).
    A term holds no character that parts tokens, so a text holds it exactly where one of its tokens
    does: terms meet the distinct tokens, which grow far slower than the rows, and one
    equi-join of the postings does the rest. Sizes are (kind, n_rows, avg_tokens).
    """
    tok = rows.select("kind", "id", X.tokens(F.col("haystack")).alias("_t"))
    each = tok.select("kind", "id", F.size("_t").alias("length"), F.posexplode_outer("_t").alias("_p", "token"))
    posts = cut(each.groupBy("kind", "id", "length", "token").agg(F.count("token").alias("tf"), F.coalesce(F.min("_p"), F.lit(0)).alias("_p")))
    rows_of = F.count_if(F.col("_p") == 0)  # one posting of each row holds its first token
    sizes = posts.groupBy("kind").agg(rows_of.alias("n_rows"), (F.sum("tf") / rows_of).alias("avg_tokens"))
    words = posts.select("token").filter("token is not null").distinct()
    asked = asked_terms(queries).select("term").distinct()
    marks = containing(words, "token", asked, "term").select("token", "term", F.lit(True).alias("held"), F.lit(0.0).alias("ratio"))
    if fuzzy:
        marks = marks.union(fuzzy_pairs(words, asked).select("token", "term", F.lit(False), "ratio"))
        marks = marks.groupBy("token", "term").agg(F.max("held").alias("held"), F.max("ratio").alias("ratio"))
    found = posts.join(marks, "token").groupBy("kind", "id", "length", "term")
    return cut(found.agg(F.sum(F.when(F.col("token") == F.col("term"), F.col("tf")).otherwise(0)).alias("tf"), F.max("held").alias("held"), F.max("ratio").alias("ratio"))), cut(sizes)


def lexical(chunks: DataFrame, queries: DataFrame, fuzzy: bool = False, k: int = 50, digits: int = 6) -> DataFrame:
    """(query_id, chunk_id, score, rank, matched, reasons): the ``k`` best chunks (chunk_id, path, symbol, chunk_type, haystack) of a score over 0.

    BM25, 0.65 times the lexical score, 0.8 times the fuzzy score, and extras for the
    question's type, a symbol or path that it names, endpoints and logins.
    """
    found = scoring.lexical(chunks, queries, fuzzy, k, digits, K1, B)
    codes = [(F.lit(True), "lexical_chunk_match"), (F.col("named"), "exact_symbol_in_query"), (F.col("at_path"), "exact_file_in_query"), (F.col("endpoint"), "endpoint_term_match"), (F.col("login"), "login_auth_compatibility_boost")]
    reasons = F.array_join(F.array_compact(F.array(*[F.when(c, F.lit(v)) for c, v in codes])), ",")
    kept = found.select("query_id", "chunk_id", F.round("score", digits).alias("score"), "matched", reasons.alias("reasons")).filter("score > 0")
    return rank(kept, ["query_id"]).filter(F.col("rank") <= k)


def text_score(rows: DataFrame, queries: DataFrame, offset: float, key: str = "chunk_id", fuzzy: bool = True, digits: int = 6, hits: DataFrame | None = None) -> DataFrame:
    """(query_id, key, score): lexical (and fuzzy) score of ``haystack``, 2 more where it holds the whole query, plus ``offset``; only where the text itself scores.

    ``hits`` are the rows' own hits (id, term, tf, held, ratio), if they are at hand. A text that holds a
    whole query holds all its terms, so just rows that do are looked through for it.
    """
    if hits is None:
        hits = term_hits(rows.select(F.lit("row").alias("kind"), F.col(key).alias("id"), "haystack"), queries, fuzzy)[0]
    one = F.when(F.col("tf") > 0, 2.0).when(F.col("held"), 0.75).otherwise(0.0)
    if fuzzy:
        one = one + fuzzy_worth(F.col("ratio"))
    met = hits.join(asked_terms(queries), "term").groupBy("query_id", F.col("id").alias(key)).agg(F.sum(one).alias("s"), (F.count_if("held") == F.max("n_terms")).alias("_all"))
    every = met.filter("_all").join(rows.select(key, "haystack"), key).join(queries.select("query_id", F.lower(F.trim("query")).alias("_whole")), "query_id")
    whole = every.filter(F.col("haystack").contains(F.col("_whole"))).select("query_id", key, F.lit(2.0).alias("_more"))
    found = met.join(whole, ["query_id", key], "left").withColumn("s", F.col("s") + F.coalesce("_more", F.lit(0.0))).filter("s > 0")
    return found.select("query_id", key, F.round(F.col("s") + offset, digits).alias("score"))


def symbol_entities(symbols: DataFrame, chunks: DataFrame) -> DataFrame:
    """(entity_id, chunk_id, title, path, haystack) of symbols (symbol_id, path, name, symbol_type, signature, start_line, end_line) that have a chunk."""
    rows = chunk_of_symbol(symbols, chunks).filter("chunk_id is not null")
    return rows.select(F.col("symbol_id").alias("entity_id"), "chunk_id", F.col("name").alias("title"), "path", X.haystack([F.col(c) for c in ("name", "symbol_type", "signature", "path")]).alias("haystack"))


def endpoint_entities(endpoints: DataFrame, chunks: DataFrame) -> DataFrame:
    """As above, of endpoints (endpoint_id, path, method, route, handler, metadata: keys and values in one string)."""
    rows = chunk_of_endpoint(endpoints, chunks).filter("chunk_id is not null")
    hay = X.haystack([F.col(c) for c in ("method", "route", "handler", "path", "metadata")])
    return rows.select(F.col("endpoint_id").alias("entity_id"), "chunk_id", F.concat_ws(" ", "method", "route").alias("title"), "path", hay.alias("haystack"))


def file_entities(files: DataFrame, chunks: DataFrame) -> DataFrame:
    """As above, of files (path, language, file_type)."""
    name = F.regexp_extract("path", "([^/]*)$", 1)
    hay = X.haystack([F.col("path"), name, F.col("language"), F.col("file_type")])
    return files.join(summary_chunk(chunks), "path").select(F.col("path").alias("entity_id"), "chunk_id", F.col("path").alias("title"), "path", hay.alias("haystack"))


def node_entities(nodes: DataFrame, chunks: DataFrame) -> DataFrame:
    """As above, of graph nodes (id, label, type, file_path, role, summary, layer, tags: in one string, start_line, end_line)."""
    rows = chunk_of_node(nodes, chunks).filter("chunk_id is not null")
    hay = X.haystack([F.col(c) for c in ("label", "type", "file_path", "role", "summary", "layer", "tags")])
    return rows.select(F.col("id").alias("entity_id"), "chunk_id", F.col("label").alias("title"), F.col("file_path").alias("path"), hay.alias("haystack"))


def entity_seeds(entities: DataFrame, queries: DataFrame, kind: str, k: int) -> DataFrame:
    """(list, query_id, chunk_id, title, path, score): what the ``k`` best chunks of each question come from, ``kind`` names the addend in ``OFFSETS``.

    List ``all`` is of all entities, ``named`` of those whose title or path the question names. Each
    has the best chunks of each task and so some more than ``k``: ``entity_rank`` ranks them.
    """
    return scoring.entities(entities, queries, OFFSETS[kind], k)


def entity_rank(found: DataFrame, k: int | None = None) -> DataFrame:
    """The best seed of each chunk, ranked within its question; with ``k`` the first ``k``."""
    ranked = rank(first_per_chunk(found, ["query_id"]), ["query_id"])
    return ranked if k is None else ranked.filter(F.col("rank") <= k)


def exact(seeds: DataFrame, queries: DataFrame) -> DataFrame:
    """Of seeds (query_id, chunk_id, title, path, score) those whose title or path the query names; the best for each chunk, ranked."""
    asked = queries.select("query_id", F.lower("query").alias("_q"))
    named = seeds.join(asked, "query_id")
    hit = ((F.length("title") > 0) & F.col("_q").contains(F.lower("title"))) | F.col("_q").contains(F.lower("path"))
    return rank(first_per_chunk(named.filter(hit).drop("_q"), ["query_id"]), ["query_id"])


def sparse(chunks: DataFrame, queries: DataFrame, k: int = 10, digits: int = 9) -> DataFrame:
    """(query_id, chunk_id, score, rank): the ``k`` chunks of largest cosine of sparse vectors over 0; ties keep chunk order (``seq``).

    Each token counts 1, and adds 0.35 for each of its four-grams.
    """
    found = scoring.sparse(chunks, queries, k, digits).filter("score > 0")
    return rank(found, ["query_id"], tie=["seq", "chunk_id"]).filter(F.col("rank") <= k).drop("seq")


def sparse_terms(chunks: DataFrame, queries: DataFrame, k: int = 8) -> DataFrame:
    """(query_id, chunk_id, terms): the shared terms of largest weight in the query, ``k`` at most, ties by term."""
    return scoring.sparse_terms(chunks, queries, k)


def dense(vectors: DataFrame, queries: DataFrame, k: int = 10, digits: int = 6) -> DataFrame:
    """(query_id, vec_id, score, rank): the ``k`` other vectors of largest cosine over 0.

    A vector of another length than the rest, or of no norm, is an error.
    """
    return rank(scoring.dense(vectors, queries, k, digits), ["query_id"], tie=["vec_id"]).filter(F.col("rank") <= k)


def graph_context(matched: DataFrame, edges: DataFrame, nodes: DataFrame, chunks: DataFrame, offset: DataFrame | None = None, k: int | None = None) -> DataFrame:
    """(query_id, chunk_id, score, rank): chunks of fit types in files next to matched files, at one flat score.

    matched: (query_id, path, chunk_id); an edge of the graph in either direction makes the
    files of its ends neighbours, of one file too, and a neighbour may be matched itself. Only chunks matched already are
    left out. Ranks go on after ``offset`` (query_id, n), the number of graph candidates there
    are. With ``k`` ranks up to ``k``: of each file just as many chunks are looked at as can be matched or ranked.
    """
    at = nodes.filter("file_path is not null").select(F.col("id"), F.col("file_path"))
    both = edges.select("source", "target").union(edges.select("target", "source"))
    step = both.join(at.withColumnRenamed("file_path", "path"), F.col("source") == F.col("id")).drop("id")
    step = step.join(at.withColumnRenamed("file_path", "next"), F.col("target") == F.col("id")).select("path", "next").distinct()
    near = matched.select("query_id", "path").distinct().join(step, "path").select("query_id", F.col("next").alias("path")).distinct()
    fit = chunks.filter(F.col("chunk_type").isin(*CONTEXT_TYPES)).select("path", "chunk_id")
    if k is not None:
        most = matched.groupBy("query_id").agg(F.count_distinct("chunk_id").alias("_n")).agg(F.coalesce(F.max("_n"), F.lit(0))).first()[0]
        fit = fit.withColumn("_n", F.row_number().over(Window.partitionBy("path").orderBy("chunk_id"))).filter(F.col("_n") <= k + most).drop("_n")
    found = near.join(fit, "path").join(matched.select("query_id", "chunk_id"), ["query_id", "chunk_id"], "left_anti")
    ranked = rank(found.select("query_id", "chunk_id", F.lit(CONTEXT_SCORE).alias("score")), ["query_id"])
    if k is not None:
        ranked = ranked.filter(F.col("rank") <= k)
    if offset is not None:
        ranked = ranked.join(offset, "query_id", "left").withColumn("rank", F.col("rank") + F.coalesce("n", F.lit(0)).cast("int")).drop("n")
    return ranked if k is None else ranked.filter(F.col("rank") <= k)


# --- chunks of other records ----------------------------------------------------------------------


def chunk_of_symbol(symbols: DataFrame, chunks: DataFrame) -> DataFrame:
    """Each symbol (symbol_id, path, name, start_line, end_line) with the first chunk (seq) of its file and its name or lines."""
    first = F.min(F.struct("seq", "chunk_id"))
    named = chunks.filter("symbol is not null").groupBy("path", F.col("symbol").alias("name")).agg(first.alias("_a"))
    lined = chunks.groupBy("path", "start_line", "end_line").agg(first.alias("_b"))
    return _lesser(symbols.join(named, ["path", "name"], "left").join(lined, ["path", "start_line", "end_line"], "left"), symbols)


def chunk_of_endpoint(endpoints: DataFrame, chunks: DataFrame) -> DataFrame:
    """Each endpoint (endpoint_id, path, handler, route) with the first endpoint chunk of its file named as its handler or holding its route."""
    ends = chunks.filter("chunk_type = 'endpoint'")
    first = F.min(F.struct("seq", "chunk_id"))
    named = ends.filter("symbol is not null").groupBy("path", F.col("symbol").alias("handler")).agg(first.alias("_a"))
    texts = ends.filter("content is not null").select("seq", "chunk_id", "path", F.col("content").alias("_content"))
    held = endpoints.select("path", "route").distinct().join(texts, "path").filter(F.col("_content").contains(F.col("route"))).groupBy("path", "route").agg(first.alias("_b"))
    return _lesser(endpoints.join(named, ["path", "handler"], "left").join(held, ["path", "route"], "left"), endpoints)


def _lesser(rows: DataFrame, like: DataFrame) -> DataFrame:
    """The columns of ``like`` and ``chunk_id``, that of the first of the chunks ``_a`` and ``_b``."""
    return rows.select(*like.columns, F.least("_a", "_b")["chunk_id"].alias("chunk_id"))


def summary_chunk(chunks: DataFrame) -> DataFrame:
    """(path, chunk_id): each file's summary chunk, else its first chunk."""
    return chunks.groupBy("path").agg(F.min_by("chunk_id", F.struct(F.col("chunk_type") != "file_summary", "seq")).alias("chunk_id"))


def chunk_of_node(nodes: DataFrame, chunks: DataFrame) -> DataFrame:
    """Each node (id, type, label, file_path, start_line, end_line) with its chunk: one that covers its lines, else one of its name or type, else the file's summary."""
    first, at = F.min(F.struct("seq", "chunk_id")), chunks.withColumnRenamed("path", "file_path")
    lined, wide = F.col("start_line") == F.col("end_line"), F.col("_s") < F.col("_e")
    names = at.filter("symbol is not null").groupBy("file_path", F.col("symbol").alias("label")).agg(first.alias("_n"))
    kinds = at.filter("chunk_type is not null").groupBy("file_path", F.col("chunk_type").alias("type")).agg(first.alias("_k"))
    files = at.groupBy("file_path").agg(F.min(F.when(F.col("chunk_type") == "file_summary", F.struct("seq", "chunk_id"))).alias("_f"), first.alias("_any"))
    one = at.filter(lined).groupBy("file_path", "start_line", "end_line").agg(first.alias("_o"))  # covers just its own line
    long = at.select("seq", "chunk_id", "file_path", F.col("start_line").alias("_s"), F.col("end_line").alias("_e"))
    asked, covers = nodes.select("file_path", "start_line", "end_line").distinct(), (F.col("_s") <= F.col("start_line")) & (F.col("_e") >= F.col("end_line"))
    turned = asked.filter("end_line < start_line")  # lines the wrong way round are inside what is between them
    over = asked.join(long.filter(wide), "file_path").filter(covers).unionByName(turned.join(long.filter(~wide), "file_path").filter(covers))
    over = over.groupBy("file_path", "start_line", "end_line").agg(first.alias("_w"))
    rows = nodes.dropDuplicates().join(names, ["file_path", "label"], "left").join(kinds, ["file_path", "type"], "left").join(files, "file_path", "left")
    rows = rows.join(one, ["file_path", "start_line", "end_line"], "left").join(over, ["file_path", "start_line", "end_line"], "left")
    found = F.coalesce(F.least("_o", "_w"), F.least("_n", "_k"), "_f", "_any")
    return rows.select(*nodes.columns, found["chunk_id"].alias("chunk_id"))
