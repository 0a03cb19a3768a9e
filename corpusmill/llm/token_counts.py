"""Token counts as an exact histogram of encoded lengths, and what suffix sums of it answer.

Documents are encoded once and aggregated by their length. For a context limit L, the sums
over lengths above L say how many documents pass it and how many tokens they have; with the
totals that gives the tokens kept when documents are cut at L. All of it is exact, and one
table answers every limit and quantile.
"""

from __future__ import annotations

import base64
import os
from functools import cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.llm.shared import cut
from corpusmill.llm.words import pieces, tidy

#: Where the vocabulary files are; a parameter of every function here.
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: How byte-level BPE vocabularies of this family part a text before merging (fixed value).
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Lengths of one slice of the suffix sums.
SLICE = 1024


@cache
def encoder(path: str):
    """A function from texts to their numbers of tokens, by the kind of the file's name; special tokens are text."""
    if path.endswith(".tiktoken"):
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        one = tiktoken.Encoding(os.path.basename(path), pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        return lambda texts: [len(one(t)) for t in texts]
    if path.endswith(".json"):
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        made = Tokenizer.from_file(path)
        made.encode_special_tokens = True
        made.no_truncation()
        return lambda texts: [len(e.ids) for e in made.encode_batch(texts, add_special_tokens=False)]
    import sentencepiece

    made = sentencepiece.SentencePieceProcessor(model_file=path)
    return lambda texts: [len(x) for x in made.encode(texts, num_threads=1)]


def _counter(path: str, names: list[str]):
    def run(batches):
        count = encoder(path)
        for batch in batches:
            for piece in pieces(batch, "text"):
                texts = [t or "" for t in piece.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([*(piece.column(c) for c in names), pa.array(count(texts), pa.int64())], [*names, "n_tokens"])

    return tidy(run)


def count_tokens(docs: DataFrame, path: str = TOKENIZER, text_col: str = "text") -> DataFrame:
    """``docs`` with n_tokens of the whole text in its place; null and empty texts have 0. A column n_tokens is replaced.

    The file at ``path`` must be there on every executor, as installed software is.
    """
    names = [c for c in docs.columns if c not in (text_col, "n_tokens")]
    given = docs.select(F.col(text_col).alias("text"), *[F.col(f"`{c}`").alias(f"_x{k}") for k, c in enumerate(names)])
    schema = ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in given.schema.fields[1:]), "n_tokens long"])
    made = given.mapInArrow(_counter(path, [f"_x{k}" for k in range(len(names))]), schema)
    return made.select(*[F.col(f"_x{k}").alias(c) for k, c in enumerate(names)], "n_tokens")


def length_table(counted: DataFrame) -> DataFrame:
    """One row for each length that occurs, from the rows' n_tokens; nulls count as 0.

    n_tokens, docs, docs_longer, tokens_longer (of the longer documents), tokens_at_limit
    (all tokens left if documents are cut at n_tokens), total_docs, total_tokens, and
    quantile: the share of documents of at most this length. Repeated rows count each time.

    Sums go over slices of lengths first and over the slices' totals in order, so no task
    orders all lengths, however many occur. An empty table gives an empty result.
    """
    rows = counted.select(F.coalesce("n_tokens", F.lit(0)).cast("long").alias("n_tokens")).groupBy("n_tokens").agg(F.count("*").alias("docs"))
    rows = cut(rows)  # used twice; a row for each length
    rows = rows.withColumns({"_slice": F.floor(F.col("n_tokens") / SLICE), "_tokens": F.col("docs") * F.col("n_tokens")})
    slices = rows.groupBy("_slice").agg(F.sum("docs").alias("_sd"), F.sum("_tokens").alias("_st"))
    above = Window.orderBy(F.desc("_slice")).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    slices = slices.select(
        "_slice",
        F.coalesce(F.sum("_sd").over(above), F.lit(0)).alias("_ad"),
        F.coalesce(F.sum("_st").over(above), F.lit(0)).alias("_at"),
        F.sum("_sd").over(whole).alias("total_docs"),
        F.sum("_st").over(whole).alias("total_tokens"),
    )
    inside = Window.partitionBy("_slice").orderBy(F.desc("n_tokens")).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumns(
        {"_d": F.coalesce(F.sum("docs").over(inside), F.lit(0)), "_t": F.coalesce(F.sum("_tokens").over(inside), F.lit(0))}
    ).join(slices, "_slice")
    longer, tokens = F.col("_d") + F.col("_ad"), F.col("_t") + F.col("_at")
    return rows.select(
        "n_tokens",
        "docs",
        longer.alias("docs_longer"),
        tokens.alias("tokens_longer"),
        (F.col("total_tokens") - tokens + longer * F.col("n_tokens")).alias("tokens_at_limit"),
        "total_docs",
        "total_tokens",
        ((F.col("total_docs") - longer) / F.col("total_docs")).alias("quantile"),
    )


def tokens_at_limits(lengths: DataFrame, limits: list[int]) -> DataFrame:
    """(context, docs_cut, tokens_kept) for any context limits, from the table above."""
    spark = lengths.sparkSession
    asked = F.broadcast(spark.createDataFrame([(int(x),) for x in limits], "context long"))
    lost: Column = F.greatest(F.col("n_tokens") - F.col("context"), F.lit(0))
    sums = lengths.select("n_tokens", "docs").crossJoin(asked).groupBy("context")
    return sums.agg(
        F.sum(F.when(F.col("n_tokens") > F.col("context"), F.col("docs")).otherwise(0)).alias("docs_cut"),
        F.sum(F.col("docs") * (F.col("n_tokens") - lost)).alias("tokens_kept"),
    )


def quantiles(lengths: DataFrame, shares: list[float]) -> DataFrame:
    """(share, n_tokens): the least length that at least this share of documents doesn't pass."""
    asked = F.broadcast(lengths.sparkSession.createDataFrame([(float(x),) for x in shares], "share double"))
    return lengths.crossJoin(asked).filter(F.col("quantile") >= F.col("share")).groupBy("share").agg(F.min("n_tokens").alias("n_tokens"))
