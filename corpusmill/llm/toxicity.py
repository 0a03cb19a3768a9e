"""Toxicity by logistic regression, trained with FTRL-proximal on hashed n-grams and skip-grams.

Features of a text are hashes of its words, of neighbouring pairs, and of pairs with one or
two words between; each counts once a text, pairs with a smaller value than words. FTRL-proximal keeps a learning rate for each
coordinate, and its L1 term leaves most weights at exactly zero: the model is a list of at
most 2 ** ``BITS`` (index, weight) pairs, small enough to go to every task.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.llm.words import Words, mix, pieces, tidy

BITS = 20
#: Distances between the two words of a pair.
GAPS = (1, 2, 3)
#: Labelled rows that a model is fitted on at most: those of smallest hash.
SAMPLE = 10_000
#: Bytes of their texts at most.
BYTES = 128 << 20
#: Value of a pair, against 1 of a word: pairs seen once else explain the sample before words do.
PAIR = 0.1


def features(words: Words) -> list[tuple[np.ndarray, np.ndarray]]:
    """(row, index) arrays, with repeats: words, then pairs for each gap."""
    h, row, last = words.hashes(), words.rows(), words.last()
    mask = np.uint64((1 << BITS) - 1)
    out = [(row, (h & mask).astype(np.int64))]
    at = np.arange(len(h))
    for gap in GAPS:
        a = at[at + gap < last]
        pair = mix(h[a] * np.uint64(0x9E3779B97F4A7C15) + h[a + gap] + np.uint64(gap))
        out.append((row[a], (pair & mask).astype(np.int64)))
    return out


def split(array: pa.Array) -> Words:
    return Words.of(array, lower=True, bare=True)


class Ftrl:
    """Weights by McMahan et al. 2013: per-coordinate rates ``alpha / (beta + sqrt(n))``, L1 and L2 terms.

    ``alpha``, ``l1`` and ``PAIR`` are those of least log loss in cross-validation within the
    rows that may be learned from, as the README has it.
    """

    def __init__(self, alpha: float = 2.0, beta: float = 1.0, l1: float = 6.0, l2: float = 0.0):
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z, self.n = np.zeros((1 << BITS) + 1), np.zeros((1 << BITS) + 1)

    def weights(self, at) -> np.ndarray:
        z = self.z[at]
        w = -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(self.n[at])) / self.alpha + self.l2)
        w[np.abs(z) <= self.l1] = 0
        return w

    def learn(self, at: np.ndarray, value: np.ndarray, label: int) -> None:
        """One example: its features and their values; the last coordinate is the intercept, without L1."""
        at, value = np.append(at, 1 << BITS), np.append(value, 1.0)
        w = self.weights(at)
        w[-1] = -self.z[-1] / ((self.beta + np.sqrt(self.n[-1])) / self.alpha)
        g = (1 / (1 + np.exp(-np.clip(w @ value, -35, 35))) - label) * value
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[at] = n + g * g

    def model(self) -> tuple[np.ndarray, np.ndarray]:
        """Indices and weights that aren't zero; the intercept comes last."""
        w = self.weights(np.arange(1 << BITS))
        at = np.flatnonzero(w)
        bias = -self.z[-1] / ((self.beta + np.sqrt(self.n[-1])) / self.alpha)
        return np.append(at, 1 << BITS), np.append(w[at], bias)


def _trainer(epochs: int):
    def run(batches):
        rows = []
        for batch in batches:
            order, label = batch.column("_order").to_pylist(), batch.column("label").to_pylist()
            done = 0
            for piece in pieces(batch, "text"):
                words, *pairs = features(split(piece.column("text")))
                parts = []
                for row, at in (words, tuple(np.concatenate(x) for x in zip(*pairs, strict=True))):
                    key = np.unique(row << BITS | at)  # one array for all rows of the piece
                    edge = np.searchsorted(key >> BITS, np.arange(piece.num_rows + 1))
                    at = (key & ((1 << BITS) - 1)).astype(np.int32)
                    parts.append([at[edge[r] : edge[r + 1]] for r in range(piece.num_rows)])
                rows += [(order[done + r], label[done + r], parts[0][r], parts[1][r]) for r in range(piece.num_rows)]
                done += piece.num_rows
        rows.sort(key=lambda x: (x[0], x[1], x[2].tobytes(), x[3].tobytes()))
        ftrl = Ftrl()
        for epoch in range(epochs):
            for k in np.random.default_rng(epoch).permutation(len(rows)):
                _, label, words, pairs = rows[k]
                ftrl.learn(np.concatenate([words, pairs]), np.repeat([1.0, PAIR], [len(words), len(pairs)]), label)
        at, w = ftrl.model() if rows else (np.zeros(0, np.int64), np.zeros(0))
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(w)], ["at", "w"])

    return tidy(run)


def train(docs: DataFrame, labels: DataFrame, use: Column, label_col: str = "toxic", sample: int = SAMPLE, epochs: int = 4, most: int = BYTES) -> tuple[np.ndarray, np.ndarray]:
    """Indices and weights fitted on labelled documents where ``use`` (on doc_id) holds.

    Of these the ``sample`` of smallest hash are taken, in that order and as long as their
    texts have ``most`` bytes together, so a rerun gives the same weights and the one task
    that fits has bounded work. Rows with a null doc_id, label or text are left out; of
    several labels of a document the largest counts, of several texts the least. Without any
    row, as from empty tables, the intercept is -35 and nothing else.
    """
    marked = labels.select("doc_id", F.col(label_col).cast("int").alias("label")).filter(F.col("doc_id").isNotNull() & F.col("label").isNotNull() & use)
    marked = marked.groupBy("doc_id").agg(F.max("label").alias("label")).withColumn("_order", F.xxhash64("doc_id"))
    held = docs.filter("text is not null").groupBy("doc_id").agg(F.max(F.octet_length("text")).alias("_bytes"))
    some = marked.join(held, "doc_id").orderBy("_order", "doc_id").limit(sample)
    running = F.sum("_bytes").over(Window.orderBy("_order", "doc_id").rowsBetween(Window.unboundedPreceding, 0))  # over ``sample`` rows
    some = F.broadcast(some.withColumn("_sum", running).filter(F.col("_sum") <= most).drop("_sum", "_bytes"))  # at most ``sample`` rows of three numbers
    rows = docs.select("doc_id", "text").filter("text is not null").join(some, "doc_id").groupBy("doc_id", "_order", "label").agg(F.min("text").alias("text"))
    got = rows.select("_order", "label", "text").repartition(1).mapInArrow(_trainer(epochs), "at long, w double").collect()
    if not got:  # no partition, no task
        return np.array([1 << BITS]), np.array([-35.0])
    got.sort(key=lambda r: r.at)
    return np.array([r.at for r in got], np.int64), np.array([r.w for r in got])


def _scorer(at: np.ndarray, w: np.ndarray, names: list[str]):
    def run(batches):
        dense = np.zeros(1 << BITS, np.float64)
        dense[at[:-1]] = w[:-1]
        for batch in batches:
            for piece in pieces(batch, "text"):
                words, *pairs = features(split(piece.column("text")))
                logit = np.full(piece.num_rows, w[-1])
                for value, some in ((1.0, [words]), (PAIR, pairs)):
                    hit = [np.stack([row, index])[:, dense[index] != 0] for row, index in some]
                    row, index = np.unique(np.concatenate(hit, axis=1), axis=1)
                    logit += value * np.bincount(row, dense[index], piece.num_rows)
                score = 1 / (1 + np.exp(-np.clip(logit, -35, 35)))
                yield pa.RecordBatch.from_arrays([*(piece.column(c) for c in names), pa.array(score)], [*names, "score"])

    return tidy(run)


def score(docs: DataFrame, model: tuple[np.ndarray, np.ndarray], text_col: str = "text") -> DataFrame:
    """``docs`` with ``score``: the model's probability of label 1, of every whole text.

    Null and empty texts score the intercept alone. Rows are scored one by one, so repeats,
    ties and a null doc_id need no care; an empty table gives an empty result, a column ``score`` is replaced.
    """
    docs = docs.drop("score")
    names = docs.columns
    given = docs.select(F.col(text_col).alias("text"), *[F.col(f"`{c}`").alias(f"_x{k}") for k, c in enumerate(names)])
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in given.schema.fields[1:])
    made = given.mapInArrow(_scorer(*model, [f"_x{k}" for k in range(len(names))]), schema + ", score double")
    return made.select(*[F.col(f"_x{k}").alias(c) for k, c in enumerate(names)], "score")
