"""Ranked lexical search with whole-number scores: MaxScore over shards.

A first scan writes, for each document, its length and the terms that some query holds (a forward
index in Parquet); counts of documents, terms and holders are summed over it. A task of the second scan
takes a shard of these rows, turns it into posting lists by term and answers every query on it: its
terms are sorted by the most that a posting of theirs adds, and as long as the first of
them together stay under the k-th best score so far they are non-essential. Candidates come from the essential lists
alone; the non-essential ones are probed from the strongest down, only for documents that can still reach
that score. Documents of a shard go by in blocks, so the score rises and lists become non-essential.

The score to start from is each query's k-th best in a slice of the documents by hash, a lower bound of its
k-th best in all: no document is left out by it. A query's best of each shard meet in one window, which Spark cuts to k rows a task before the shuffle.

Queries come in blocks of at most ``BLOCK`` bytes of text, each with two scans, so what
travels to tasks is bounded whatever their number; one longer query is a block of its own.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.llm.shared import cut, scratch
from corpusmill.llm.words import Words, pieces, same, tidy

#: Bytes of query texts of a block; postings of a shard; documents of a shard scored at a time; documents of the slice that gives first scores.
BLOCK, SHARD, STRIP, SLICE = 1 << 22, 1 << 21, 1 << 13, 1 << 14
#: A score is the sum of weight * (ONE * tf div (SAT * tf + 8 * m)), m = 25 + (75 * n * N div L).
ONE, SAT, LENGTH, PART = 10**9, 1000, 75, 8


def _terms(texts: list[str]) -> Words:
    return Words.of(pa.array(texts, pa.large_string()), lower=True, bare=True)


class _Vocabulary:
    """The distinct terms of queries, looked up by hash and compared as bytes."""

    def __init__(self, texts: list[str]):
        found = _terms(texts)
        numbers = found.numbers()
        _, at = np.unique(numbers, return_index=True)
        self.words, self.size = found, len(at)
        h = found.hashes()[at]
        order = np.argsort(h, kind="stable")
        self.hash, self.at = h[order], at[order]  # term t is the word at[t]
        place = np.empty(len(at), np.int64)
        place[order] = np.arange(len(at))
        self.queries = [np.unique(place[numbers[a:b]], return_counts=True) for a, b in zip(found.first[:-1], found.first[1:], strict=True)]
        if len(np.unique(self.hash)) < self.size:
            raise ValueError("two terms of one hash")

    def find(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """Words that are terms, and which."""
        if not self.size:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        h = words.hashes()
        t = np.minimum(np.searchsorted(self.hash, h), self.size - 1)
        i = np.flatnonzero(self.hash[t] == h)
        i = i[same(words, i, self.words, self.at[t[i]])]
        return i, t[i]


def _forward(texts: list[str]):
    """Documents to (doc_id, n, terms, tfs), for those with a term of any kind."""

    def run(batches):
        known = _Vocabulary(texts)
        for whole in batches:
            for batch in pieces(whole, "text"):
                words = Words.of(batch.column("text"), lower=True, bare=True)
                i, t = known.find(words)
                pair, tf = np.unique(words.rows()[i] * max(known.size, 1) + t, return_counts=True)
                row = pair // max(known.size, 1)
                n = words.counts
                some = np.flatnonzero(n > 0)
                of = np.append(np.searchsorted(row, some), len(row)).astype(np.int32)
                lists = [pa.ListArray.from_arrays(pa.array(of), pa.array(x.astype(np.int32))) for x in (pair % max(known.size, 1), tf)]
                ids = batch.column("doc_id").take(pa.array(some))
                yield pa.RecordBatch.from_arrays([ids, pa.array(n[some].astype(np.int64)), *lists], ["doc_id", "n", "terms", "tfs"])

    return tidy(run)


class _Best:
    """The k best (score, document) so far, ties to the smaller doc_id, null last."""

    def __init__(self, k: int, low: int):
        self.k, self.low = k, max(1, low)
        self.score, self.place = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def add(self, score: np.ndarray, place: np.ndarray, order: np.ndarray) -> None:
        keep = score >= self.low
        self.score, self.place = np.concatenate([self.score, score[keep]]), np.concatenate([self.place, place[keep]])
        if len(self.score) >= self.k:
            top = np.lexsort((order[self.place], -self.score))[: self.k]
            self.score, self.place = self.score[top], self.place[top]
            self.low = max(self.low, int(self.score[-1]))


def _search_shard(query: tuple[np.ndarray, np.ndarray], lists: list, best: _Best, order: np.ndarray) -> int:
    """Adds a shard's best documents of one query; how many postings were looked at."""
    mine = [(int(times) * int(lists[t][2]), int(times), *lists[t][:2]) for t, times in zip(*(x.tolist() for x in query), strict=True) if lists[t] is not None]
    mine.sort(key=lambda x: x[0])
    if not mine:
        return 0
    reach = np.cumsum([x[0] for x in mine])  # the most that the first lists add together
    seen, total = 0, len(order)
    for at in range(0, total, STRIP):
        if reach[-1] < best.low:
            break
        to = min(at + STRIP, total)
        split = int(np.searchsorted(reach, best.low))  # lists before it cannot reach the score together
        score, hit = np.zeros(to - at, np.int64), np.zeros(to - at, bool)
        for _, times, docs, adds in mine[split:]:
            a, b = np.searchsorted(docs, (at, to))
            score[docs[a:b] - at] += times * adds[a:b]
            hit[docs[a:b] - at] = True
            seen += b - a
        live = np.flatnonzero(hit)
        for k in range(split - 1, -1, -1):
            live = live[score[live] + reach[k] >= best.low]
            if not len(live):
                break
            _, times, docs, adds = mine[k]
            spot = np.minimum(np.searchsorted(docs, live + at), len(docs) - 1)
            there = docs[spot] == live + at
            score[live[there]] += times * adds[spot[there]]
            seen += len(live)
        best.add(score[live], live + at, order)
    return seen


def _search(queries: list, weights: np.ndarray, docs: int, terms: int, floors: list[int], k: int):
    """Rows of the forward index to (query, doc_id, score): each query's k best of each shard, at least."""

    def shard(rows: pa.Table):
        n = rows.column("n").to_numpy()
        ids = rows.column("doc_id").combine_chunks()
        null = np.asarray(ids.is_null())
        number = ids.fill_null(0).to_numpy()
        order = np.empty(len(n), np.int64)
        order[np.lexsort((number, null))] = np.arange(len(n))
        held = rows.column("terms").combine_chunks()
        place = np.repeat(np.arange(len(n)), np.diff(held.offsets.to_numpy()))
        t, tf = held.flatten().to_numpy(), rows.column("tfs").combine_chunks().flatten().to_numpy().astype(np.int64)
        m = 100 - LENGTH + (LENGTH * n * docs) // terms
        adds = weights[t] * ((ONE * tf) // (SAT * tf + PART * m[place]))
        by = np.argsort(t, kind="stable")
        edge = np.searchsorted(t[by], np.arange(len(weights) + 1))
        lists = [None if a == b else (place[by[a:b]], adds[by[a:b]], adds[by[a:b]].max()) for a, b in zip(edge[:-1], edge[1:], strict=True)]
        out = []
        for number_of, query in enumerate(queries):
            best = _Best(k, floors[number_of])
            _search_shard(query, lists, best, order)
            out += [(number_of, ids[p].as_py(), s) for s, p in zip(best.score.tolist(), best.place.tolist(), strict=True)]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], ["query", "doc_id", "score"])

    def run(batches):
        held, postings = [], 0
        for batch in batches:
            at = 0
            ends = np.cumsum(np.diff(batch.column("terms").offsets.to_numpy()) + 1)
            while at < batch.num_rows:
                base = ends[at - 1] if at else 0
                to = max(at + 1, int(np.searchsorted(ends, base + SHARD - postings, "right")))
                held.append(batch.slice(at, to - at))
                postings += int(ends[to - 1] - base)
                at = to
                if postings >= SHARD:
                    yield from shard(pa.Table.from_batches(held))
                    held, postings = [], 0
        if held:
            yield from shard(pa.Table.from_batches(held))

    return tidy(run)


def _best(found: DataFrame, k: int, by: Column | str) -> DataFrame:
    order = Window.partitionBy(by).orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _block(docs: DataFrame, texts: list[str], k: int) -> DataFrame:
    forward = cut(docs.mapInArrow(_forward(texts), "doc_id long, n long, terms array<int>, tfs array<int>"))
    known = _Vocabulary(texts)
    count, total = forward.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    holders = dict(forward.select(F.explode("terms").alias("t")).groupBy("t").count().collect())  # a row for each term of the block
    weights = np.array([math.floor(1000 * math.log((2 * count + 2) / (2 * holders.get(t, 0) + 1))) for t in range(known.size)], np.int64)
    search = lambda rows, floors: rows.mapInArrow(_search(known.queries, weights, count, max(total, 1), floors, k), "query long, doc_id long, score long")
    floors, slices = [0] * len(texts), count // SLICE
    if slices > 1:
        some = search(forward.filter(F.pmod(F.xxhash64("doc_id", "n"), F.lit(slices)) == 0), floors)
        for r in _best(some, k, "query").filter(F.col("rank") == k).select("query", "score").collect():
            floors[r.query] = r.score
    return search(forward, floors)


def rank_documents(docs: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``k`` documents of highest score above 0 for each query (all, if fewer).

    Terms are the maximal matches of ``[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+`` in whole texts, A-Z lower-cased. Over the N
    documents with a term, L terms in all, n terms of one document and df documents holding a term: w = floor(1000 ln((2N + 2) / (2df + 1))),
    m = 25 + (75 n N div L), and a document's score is the sum, over the query's terms with repeats, of w (10^9 tf div (1000 tf + 8 m)).
    Equal scores go to the smaller doc_id, null last. Every row of ``docs`` is a document of its own, whatever its doc_id.
    Rows of ``queries`` that share an item_id (null is one too) are one query, of the smallest text. Null texts and texts
    without terms match nothing; empty tables give an empty result. Columns other than doc_id, text and item_id, text are left out.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    asked = queries.groupBy("item_id").agg(F.min("text").alias("text")).filter(F.length("text") > 0)
    with scratch(spark):
        asked = cut(asked.select(F.col("item_id").cast("long").alias("item_id"), "text"))
        blocks = max(1, -(-(asked.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // BLOCK))
        found = []
        for block in range(blocks):
            rows = sorted(asked.filter(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == block).collect(), key=lambda r: (r.item_id is None, r.item_id))
            if not rows:
                continue
            names = spark.createDataFrame([(i, r.item_id) for i, r in enumerate(rows)], "query long, item_id long")
            best = _best(_block(docs, [r.text for r in rows], k), k, "query")
            found.append(cut(best.join(names, "query").select("item_id", "rank", "doc_id", "score"), stay=True))
    if not found:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    rows = found[0]
    for more in found[1:]:
        rows = rows.union(more)
    return rows
