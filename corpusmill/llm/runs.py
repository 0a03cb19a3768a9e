"""Periodic runs of words by Crochemore's partition refinement.

Positions of a text are classed by their factor of length 1, 2, 3, ...: those of one class have
equal words. Going from length l to l + 1, a class is split by the classes of the next positions,
and of the parts that a class was split into at the last length all but the largest need to be
looked at (the smaller half), so a position is looked at O(log n) times. Members of a class are
linked in text order. Two neighbours at distance l in a class of length l are a square of period l
whose root is no power of a shorter one; squares that start at consecutive positions make a run.

Many texts go through the refinement at once, each with classes of its own, one set of numpy
operations a length. Links wait for the length that equals their distance in a radix heap, as lengths only
grow. A text is refined up to the longest period it can have a run of.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.words import Words, pieces, tidy

#: Texts are refined together in pieces of about this many bytes.
TOGETHER = 1 << 22


class _Due:
    """(position, distance) pairs that come out when ``at`` reaches the distance; ``at`` never falls."""

    def __init__(self):
        self.at, self.heap = 1, [[] for _ in range(64)]

    def push(self, place: np.ndarray, distance: np.ndarray) -> None:
        if len(place):
            bits = np.frexp((distance ^ self.at).astype(float))[1]
            for b in np.unique(bits).tolist():
                pick = bits == b
                self.heap[b].append((place[pick], distance[pick]))

    def forward(self, to: int | None = None) -> bool:
        """On to ``to``, or to the smallest distance that waits; false if none does."""
        if to is None:
            b = next((b for b, held in enumerate(self.heap) if b and held), None)
            if b is None:
                return False
            to = min(int(d.min()) for _, d in self.heap[b])
        b, self.at = (self.at ^ to).bit_length(), to
        held, self.heap[b], self.heap[0] = self.heap[b], [], []
        if held:
            self.push(np.concatenate([p for p, _ in held]), np.concatenate([d for _, d in held]))
        return True

    def due(self) -> np.ndarray:
        return np.concatenate([p for p, _ in self.heap[0]]) if self.heap[0] else np.zeros(0, np.int64)


def _edges(new: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.append(True, new))


class _Partition:
    """Classes of positions as slices of ``perm``, and each position's neighbours in its class."""

    def __init__(self, key: np.ndarray):
        m = len(key)
        self.perm = np.argsort(key, kind="stable")
        new = np.append(True, key[self.perm[1:]] != key[self.perm[:-1]])
        first = np.flatnonzero(new)
        self.classes = len(first)
        self.start, self.size = np.zeros(m, np.int64), np.zeros(m, np.int64)
        self.start[: len(first)], self.size[: len(first)] = first, np.diff(np.append(first, m))
        self.where, self.of = np.empty(m, np.int64), np.empty(m, np.int64)
        self.where[self.perm], self.of[self.perm] = np.arange(m), np.cumsum(new) - 1
        self.next, self.prev, self.mark = np.full(m, -1), np.full(m, -1), np.zeros(m, bool)
        a, b = self.perm[:-1][~new[1:]], self.perm[1:][~new[1:]]
        self.next[a], self.prev[b] = b, a

    def ranges(self, first: np.ndarray, size: np.ndarray) -> np.ndarray:
        return np.repeat(first - (np.cumsum(size) - size), size) + np.arange(size.sum())

    def split(self, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Splits the classes of the positions ``j`` (ascending) by the classes of the positions after them.

        Returns the positions of all parts but the largest of each class that was split, and the positions whose next neighbour is another one now.
        """
        none = np.zeros(0, np.int64)
        m = len(self.of)
        pair = self.of[j] * m + self.of[j + 1]
        order = np.argsort(pair, kind="stable")
        j, pair = j[order], pair[order]
        group = _edges(pair[1:] != pair[:-1])  # groups of j, then parents of groups
        count, parent = np.diff(np.append(group, len(j))), self.of[j[group]]
        head = _edges(parent[1:] != parent[:-1])
        touched, groups = np.add.reduceat(count, head), np.diff(np.append(head, len(group)))
        rest = self.size[parent[head]] - touched
        stay = np.repeat((rest == 0) & (groups == 1), groups)  # not split
        covered = np.flatnonzero((rest == 0) & (groups > 1))  # the largest part keeps the class
        if len(covered):
            owner = np.repeat(np.arange(len(head)), groups)
            last = np.append(np.flatnonzero(np.diff(owner)), len(owner) - 1)
            stay[np.lexsort((count, owner))[last[covered]]] = True
        j = j[~np.repeat(stay, count)]
        if not len(j):
            return none, none
        count, parent = count[~stay], parent[~stay]
        head = _edges(parent[1:] != parent[:-1])
        groups, moved, old = np.diff(np.append(head, len(parent))), np.add.reduceat(count, head), parent[head]
        rest = self.size[old] - moved
        new = self.classes + np.arange(len(count))
        self.classes += len(count)

        # links: chains of moved positions leave their class, groups are linked anew
        before = self.next[j]
        order = np.argsort(np.repeat(np.repeat(np.arange(len(head)), groups), count) * m + j)
        a = j[order]
        cut = self.next[a[:-1]] != a[1:]
        p, q = self.prev[a[np.append(True, cut)]], self.next[a[np.append(cut, True)]]
        self.next[p[p >= 0]], self.prev[q[q >= 0]] = q[p >= 0], p[q >= 0]
        first = np.cumsum(count) - count
        self.next[j[:-1]], self.prev[j[1:]] = j[1:], j[:-1]
        self.prev[j[first]], self.next[j[first + count - 1]] = -1, -1
        changed = np.concatenate([p[(p >= 0) & (q >= 0)], j[(self.next[j] >= 0) & (self.next[j] != before)]])

        # slices: moved positions go to the end of their class's slice, in the order of groups
        tail = self.start[old] + rest
        slots = self.ranges(tail, moved)
        self.mark[j] = True
        there = self.perm[slots]
        there = there[~self.mark[there]]
        hole = self.where[j]
        hole = hole[hole < np.repeat(tail, moved)]
        self.perm[hole], self.where[there] = there, hole
        self.perm[slots], self.where[j], self.mark[j] = j, slots, False
        self.start[new], self.size[new], self.size[old] = slots[first], count, rest
        self.of[j] = np.repeat(new, count)

        # the smaller parts
        owner = np.repeat(np.arange(len(head)), groups)
        last = np.append(np.flatnonzero(np.diff(owner)), len(owner) - 1)
        largest = np.lexsort((count, owner))[last]
        low = count[largest] > rest
        small = np.ones(len(count), bool)
        small[largest[low]] = False
        left = self.perm[self.ranges(self.start[old[low]], rest[low])]
        return np.sort(np.concatenate([j[np.repeat(small, count)], left])), changed


def find_runs(symbols: np.ndarray, first: np.ndarray, least: int, times: int) -> np.ndarray:
    """Rows (text, start, length, period) of all runs of ``least`` symbols and ``times`` periods or more.

    Text t has the symbols ``first[t]:first[t + 1]``; symbols are whole numbers from 0.
    """
    n = np.diff(first)
    texts = len(n)
    begin = first[:-1] + np.arange(texts)  # each text is followed by a place of its own
    m = len(symbols) + texts
    text = np.repeat(np.arange(texts), n + 1)
    limit = np.where(n >= least, n // times, 0)[text]
    limit[begin + n] = 0
    key = np.empty(m, np.int64)
    body = np.ones(m, bool)
    body[begin + n] = False
    key[body], key[~body] = symbols + 1, 0
    part = _Partition(text * (int(symbols.max(initial=0)) + 2) + key)
    due = _Due()

    def push(at: np.ndarray) -> None:
        d = part.next[at] - at
        keep = (part.next[at] >= 0) & (d >= due.at) & (d <= limit[at])
        due.push(at[keep], d[keep])

    push(np.flatnonzero(part.next >= 0))
    owner = text[part.perm[part.start[: part.classes]]]
    by_size = np.lexsort((part.size[: part.classes], owner))
    big = np.zeros(part.classes, bool)
    big[by_size[np.append(np.flatnonzero(np.diff(owner[by_size])), len(by_size) - 1)]] = True
    small = np.flatnonzero(~big[part.of])
    found, most = [], int(limit.max(initial=0))
    while due.at <= most:
        q = due.at
        hit = due.due()
        hit = np.sort(hit[part.next[hit] - hit == q])
        if len(hit):
            at = _edges(np.diff(hit) != 1)
            length = np.diff(np.append(at, len(hit))) - 1 + 2 * q
            at = at[length >= max(least, times * q)]
            length = length[length >= max(least, times * q)]
            if len(at):
                start, whose = hit[at], text[hit[at]]
                found.append(np.stack([whose, start - begin[whose], length, np.full(len(at), q)], axis=1))
        j = small - 1
        j = j[j >= 0]
        j = j[(limit[j] > q) & (part.size[part.of[j]] > 1)]
        if not len(j):
            small = j
            if not due.forward():
                break
            continue
        due.forward(q + 1)
        small, changed = part.split(j)
        push(changed)
    return np.concatenate(found) if found else np.zeros((0, 4), np.int64)


def _collapse(least: int, times: int):
    def run(batches):
        for whole in batches:
            for batch in pieces(whole, "text", TOGETHER):
                words = Words.of(batch.column("text"))
                first = words.first
                rows = find_runs(words.numbers(), first, least, times)
                rows = rows[np.lexsort((rows[:, 3], rows[:, 1], rows[:, 0]))]
                gone = np.zeros(len(words) + 1, np.int64)  # +1 where repeats begin, -1 where they end
                np.add.at(gone, first[rows[:, 0]] + rows[:, 1] + rows[:, 3], 1)
                np.add.at(gone, first[rows[:, 0]] + rows[:, 1] + rows[:, 2], -1)
                keep = np.cumsum(gone[:-1]) == 0
                spaced = words.spaced()
                wide = spaced.ends - spaced.starts + 1
                data = spaced.data[np.repeat(keep, wide)].tobytes()
                end = np.append(0, np.cumsum(wide * keep))[first]
                texts = [data[a : max(a, b - 1)] for a, b in zip(end[:-1].tolist(), end[1:].tolist(), strict=True)]
                of = np.searchsorted(rows[:, 0], np.arange(batch.num_rows + 1)).astype(np.int32)
                fields = [pa.array(rows[:, c]) for c in (1, 2, 3)]
                lists = pa.ListArray.from_arrays(pa.array(of), pa.StructArray.from_arrays(fields, ["start", "length", "period"]))
                cols = [batch.column("doc_id"), pa.array(words.counts), lists, pa.array(texts, pa.binary()).cast(pa.string())]
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "n_words", "runs", "collapsed"])

    return tidy(run)


def collapse_runs(docs: DataFrame, least: int = 6, times: int = 4) -> DataFrame:
    """(doc_id, n_words, runs, collapsed): each text's runs of words, and the text without their repeats.

    A word is ``[^\\x20\\x09-\\x0D]+``. A run is a stretch of words of smallest period q, as long as
    max(``least``, ``times`` * q) or longer, that no neighbouring word extends keeping the period;
    ``times`` is 2 or more. ``runs`` has (start, length, period) by start, then period.
    ``collapsed`` has the words that no run holds after its first q words, joined by one space.
    Every row of ``docs`` gives a row, whatever its doc_id (null, repeated); a null text and one
    without words have no runs and collapse to the empty text. Columns other than doc_id and text are left out.
    """
    if times < 2:
        raise ValueError("times is 2 or more")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_collapse(least, times), "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string")


def best_run(runs):
    """The run of greatest length / period as an exact fraction; ties go to the smallest start, then period. Null if there is none."""
    ahead = lambda a, b: (b["length"] * a["period"] > a["length"] * b["period"])
    return F.aggregate(runs, F.element_at(F.when(F.size(runs) > 0, runs), 1), lambda a, b: F.when(ahead(a, b), b).otherwise(a))


def with_periodic_tails(docs: DataFrame) -> DataFrame:
    """Documents of which a tenth repeat themselves from some word on: h = crc32(doc_id), g = h div 10.

    Where h % 10 = 0 and the text has n > 0 words, word i >= a is the text's word a + (i - a) % p, for a = g % n and
    p = 1 + (n - a) div (3 + g % 8). Other rows, and those of null doc_id, stay as they are.
    """
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.floor(h / 10)
    words = F.regexp_extract_all("text", F.lit(r"([^\x20\x09-\x0D]+)"), F.lit(1))
    n = F.size("_w").cast("long")
    a = g % n
    p = F.lit(1) + F.floor((n - a) / (F.lit(3) + g % 8))
    at = lambda i: F.when(i < a, i).otherwise(a + (i - a) % p)
    told = F.array_join(F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda i: F.get("_w", at(i).cast("int"))), " ")
    changed = docs.select("doc_id", "text").withColumn("_w", F.when(h % 10 == 0, words))
    return changed.select("doc_id", F.when(F.size("_w") > 0, told).otherwise(F.col("text")).alias("text"))
