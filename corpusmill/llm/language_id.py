"""Language of texts by cross-parsing entropy against suffix automata of labelled text.

A text is cut greedily into phrases, each the longest string that occurs in a language's
training text (Ziv-Merhav cross-parsing). Phrases are normalised by the rate at which the
language's own text, held back from a first automaton, falls into phrases, so that a
language with little training text is not at a disadvantage. What is held back of a few words says next to nothing, so a
rate counts as if ``PRIOR`` more bytes had fallen into phrases at the rate of all languages together: a label with a line of text
wins just texts that repeat it. The language that needs the fewest normalised phrases wins. Texts are lower-cased and taken as UTF-8 bytes of letters,
with one gap for what stands between words, so every script has a small alphabet.

The suffix automaton of a training text accepts exactly its substrings. It is completed to
a table: where no transition goes on, the entry counts a phrase and starts again with the
byte at hand. Texts are parsed in stretches of ``STRETCH`` bytes, all stretches of a batch
side by side, one byte a step. A stretch is parsed again from the state in which the one
before it ends until these agree, so phrases run on over stretches as in one pass.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.llm.words import pieces, tidy

#: Bytes of training text for each language at most, documents they are taken from, and bytes of all tables together.
TRAIN, TRAIN_DOCS, MODEL = 24_000, 64, 128 << 20
#: Bytes at the pooled rate that count beside those held back of each language.
PRIOR = 64
#: Bytes of a stretch, and of its beginning after which parses from different states mostly agree.
STRETCH, BEGIN = 256, 64
#: Classes that every alphabet has: past the end, between words, a byte not seen in training.
END, GAP, NEW = 0, 1, 2


_RUN = re.compile(r"[^\W\d_]+")


def letters(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts in a row, lower case, a space for each run of what is no letter; offsets, and whether a text has letters."""
    kept = [" ".join(_RUN.findall((t or "").lower())) for t in texts]
    kept = [t if any(map(str.isalpha, t)) else "" for t in kept]
    raw = [t.encode("utf-8", "ignore") for t in kept]
    off = np.concatenate([[0], np.cumsum([len(t) for t in raw])]).astype(np.int64)
    return np.frombuffer(b"".join(raw), np.uint8), off, np.diff(off) > 0


def alphabet(text: bytes) -> tuple[np.ndarray, int]:
    """The class of each byte for a training text, and the number of classes."""
    table = np.full(256, NEW, np.uint8)
    seen = sorted(set(text) - {32})
    table[seen] = NEW + 1 + np.arange(len(seen))
    table[32] = GAP
    return table, NEW + 1 + len(seen)


def suffix_automaton(text: bytes, size: int) -> np.ndarray:
    """Transitions (state, class) of the minimal automaton of all substrings of ``text``; -1: none."""
    moves, link, length = [{}], [-1], [0]
    last = 0
    for c in text:
        new = len(moves)
        moves.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in moves[p]:
            moves[p][c] = new
            p = link[p]
        if p >= 0:
            q = moves[p][c]
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                copy = len(moves)
                moves.append(dict(moves[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and moves[p].get(c) == q:
                    moves[p][c] = copy
                    p = link[p]
                link[q] = link[new] = copy
        last = new
    out = np.full((len(moves), size), -1, np.int32)
    for s, m in enumerate(moves):
        for c, t in m.items():
            out[s, c] = t
    return out


def parser(text: bytes, size: int) -> np.ndarray:
    """The completed table, flat: 4 * next state + phrases that end before the character."""
    moves = suffix_automaton(text, size)
    states = np.arange(len(moves), dtype=np.int32)
    table = np.where(moves >= 0, moves * 4, 0)
    for c in range(size):
        none = moves[:, c] < 0
        # a character that no training text has is a phrase of its own
        table[none, c] = moves[0, c] * 4 + 1 if moves[0, c] >= 0 else (states[none] > 0) + 1
    table[:, END] = states * 4
    return table.astype(np.int32).ravel()


def _grid(cls: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Stretches of all texts as columns, the text of each, and whether it is a text's first."""
    count = -(-np.diff(off) // STRETCH)
    row = np.repeat(np.arange(len(off) - 1), count)
    place = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    start = off[:-1][row] + STRETCH * place
    long = np.minimum(off[1:][row] - start, STRETCH)
    grid = np.zeros((STRETCH, len(row)), np.uint8)
    flat = np.arange(long.sum()) - np.repeat(np.cumsum(long) - long, long)
    grid[flat, np.repeat(np.arange(len(row)), long)] = cls[np.repeat(start, long) + flat]
    return grid, row, place == 0


def _parse(grid: np.ndarray, state: np.ndarray, table: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """State after, and phrases ended in, each column from the given states."""
    found = np.zeros(len(state), np.int64)
    for step in grid:
        at = table[state * size + step]
        state = at >> 2
        found += at & 3
    return state, found


def phrases(cls: np.ndarray, off: np.ndarray, table: np.ndarray, size: int) -> np.ndarray:
    """Phrases of each text."""
    grid, row, first = _grid(cls, off)
    zero = np.zeros(len(row), np.int32)
    middle, begun = _parse(grid[:BEGIN], zero, table, size)
    end, ended = _parse(grid[BEGIN:], middle, table, size)
    entry = zero
    while True:
        now = np.where(first, 0, np.append(zero[:1], end[:-1])[: len(row)]).astype(np.int32)
        wrong = np.flatnonzero(now != entry)
        if not len(wrong):
            break
        entry = now
        state, some = _parse(grid[:BEGIN, wrong], now[wrong], table, size)
        begun[wrong] = some
        other = state != middle[wrong]
        middle[wrong] = state
        wrong = wrong[other]
        end[wrong], ended[wrong] = _parse(grid[BEGIN:, wrong], state[other], table, size)
    last = np.append(first[1:], True)[: len(row)]
    return np.bincount(row, begun + ended + (last & (end > 0)), len(off) - 1).astype(np.int64)


class Model:
    """Languages with the alphabet, table and phrase rate (phrases for each byte of its own text) of each."""

    def __init__(self, texts: dict[str, bytes]):
        self.langs = sorted(texts)
        told = []
        for lang in self.langs:
            text = texts[lang]
            part = len(text) * 3 // 4
            held, known = text[part:], self._part(text[:part])
            told.append((self._count(known, np.frombuffer(held, np.uint8), np.array([0, len(held)]))[0] if held else 0, len(held)))
        counts, sizes = np.array(told, float).reshape(-1, 2).T
        pooled = counts.sum() / sizes.sum() if sizes.sum() else 1.0
        rates = np.maximum((counts + PRIOR * pooled) / (sizes + PRIOR), 1e-6)
        self.parts = [(*self._part(texts[lang]), float(rate)) for lang, rate in zip(self.langs, rates, strict=True)]

    @staticmethod
    def _part(text: bytes):
        classes, size = alphabet(text)
        return classes, size, parser(classes[np.frombuffer(text, np.uint8)].tobytes(), size)

    @staticmethod
    def _count(part, raw: np.ndarray, off: np.ndarray) -> np.ndarray:
        return phrases(part[0][raw], off, part[2], part[1])

    def costs(self, raw: np.ndarray, off: np.ndarray) -> np.ndarray:
        """Normalised phrases of each text (rows) for each language (columns)."""
        return np.stack([self._count(p, raw, off) / p[3] for p in self.parts], axis=1)


def train(docs: DataFrame, use: Column, size: int = TRAIN, lang_col: str = "lang", most: int = MODEL) -> Model:
    """A model of the rows where ``use`` holds and language and text aren't null.

    For each language the first ``TRAIN_DOCS`` documents by hash of doc_id, and of their
    joined texts ``size`` bytes, or fewer where all tables would take over ``most`` bytes. So
    what comes to the driver, and the model, are bounded. Of rows that repeat a doc_id
    within a language the one of least text counts. An empty table gives a model without
    languages.
    """
    ids = docs.filter(use & F.col(lang_col).isNotNull() & F.col("text").isNotNull()).select("doc_id", F.col(lang_col).alias("lang"), F.xxhash64("doc_id").alias("_order")).distinct()
    first = Window.partitionBy("lang").orderBy("_order", "doc_id")
    ids = ids.withColumn("_n", F.row_number().over(first)).filter(F.col("_n") <= TRAIN_DOCS)
    some = docs.filter(use).select("doc_id", F.col(lang_col).alias("lang"), F.substring("text", 1, size).alias("text")).join(F.broadcast(ids), ["doc_id", "lang"])  # ``TRAIN_DOCS`` rows of numbers a language
    given: dict[str, list] = {}
    for r in some.groupBy("lang", "_n").agg(F.min("text").alias("text")).collect():
        given.setdefault(r.lang, []).append((r._n, r.text))
    texts = {}
    for lang, rows in given.items():
        raw, off, _ = letters([t for _, t in sorted(rows)])
        texts[lang] = b" ".join(raw[a:b].tobytes() for a, b in zip(off, off[1:], strict=False))
    wide = sum(alphabet(t[:size])[1] for t in texts.values()) * 8  # bytes of table for each byte of text, at two states a byte
    size = min(size, most // max(1, wide))
    return Model({k: t[:size] for k, t in texts.items()})


def _predictor(shared, names: list[str]):
    def run(batches):
        model = shared.value
        for batch in batches:
            for piece in pieces(batch, "text"):
                raw, off, told = letters(piece.column("text").to_pylist())
                best, lead, rate = np.zeros(len(told), int), np.zeros(len(told)), np.zeros(len(told))
                if model.langs and len(told):
                    cost = model.costs(raw, off)
                    best = cost.argmin(1)
                    ranked = np.sort(cost, 1)
                    lead = 1 - ranked[:, 0] / np.maximum(ranked[:, 1], 1e-9) if len(model.langs) > 1 else np.ones(len(told))
                    rate = ranked[:, 0] / np.maximum(np.diff(off), 1)
                langs = [model.langs[b] if ok and model.langs else "und" for b, ok in zip(best.tolist(), told.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [*(piece.column(c) for c in names), pa.array(langs, pa.string()), pa.array(np.where(told, lead, 0.0)), pa.array(np.where(told, rate, 0.0))],
                    [*names, "lang_pred", "score", "phrase_rate"],
                )

    return tidy(run)


def predict(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs`` with lang_pred, score and phrase_rate (normalised phrases for each byte of letters, for the winner).

    score is 1 - normalised phrases of the winner / of the second, 1 where only one language
    was learned. Ties go to the language first in code point order, with score 0. Texts that
    are null or have no letter are ``und`` with score 0, as are all where no language was
    learned. Whole texts count, however long; repeated rows are kept, an empty table gives an
    empty result. Columns of these names are replaced.
    """
    made = ("lang_pred", "score", "phrase_rate")
    names = [c for c in docs.columns if c not in made]
    given = docs.select(F.col(text_col).alias("text"), *[F.col(f"`{c}`").alias(f"_x{k}") for k, c in enumerate(names)])
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in given.schema.fields[1:])
    run = _predictor(docs.sparkSession.sparkContext.broadcast(model), [f"_x{k}" for k in range(len(names))])
    found = given.mapInArrow(run, ", ".join(x for x in (schema, "lang_pred string, score double, phrase_rate double") if x))
    return found.select(*[F.col(f"_x{k}").alias(c) for k, c in enumerate(names)], *made)
