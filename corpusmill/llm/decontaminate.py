"""Benchmark decontamination by SimHash of item-sized windows.

Documents and items are cut into shingles of ``SIZE`` words. A window is as many consecutive
shingles as an item has. Each gets a fingerprint of 128 bits, in which a bit is the majority
of that bit over the shingles' hashes. Fingerprints are looked up by multi-index hashing:
sixteen blocks of 8 bits, of which one is within ``RADIUS // 16`` bits in any two
fingerprints within ``RADIUS``. Items of a size stand in tables under every value so near to
their block, so a look-up finds all of them within the radius. Found pairs are verified by
their exact weighted similarity: the sum of the smaller over the sum of the larger of the two
counts of each shingle. At a similarity of 0.8 about 19 of 128 bits differ, four standard
deviations below the radius of 39.

A similarity of s needs a share of 2s / (1 + s) of the window's shingles to be some item's,
so windows with fewer shingles of the whole benchmark get no fingerprint; no match is lost by
that, and which item it may be is left to the look-up. A document of fewer shingles than an
item is its one window for that item and needs a share of s / (1 + s) of both.

Items go to every executor once: they are collected only while they are fewer than ``ITEMS``
and their text is under ``ITEM_BYTES``; a larger benchmark is gone through in parts of that size.
"""

from __future__ import annotations

import uuid
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.words import Words, mix, pieces, rolling, tidy

SIZE, SIMILAR, RADIUS = 5, 0.8, 39
ITEMS, ITEM_BYTES, BLOCKS = 8000, 32 << 20, 16
_BASE = 0xD6E8FEB86659FD93
_SALTS = (np.uint64(0x243F6A8885A308D3), np.uint64(0x13198A2E03707344))
#: Bits of a filter that tells most shingles of no item at one look.
SIEVE = 22


def shingles(array: pa.Array, size: int = SIZE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each row's runs of ``size`` lower-cased words, and offsets; a row of fewer words is one run."""
    words = Words.of(array, lower=True)
    h, counts = words.hashes(), words.counts
    runs = np.where(counts > 0, np.maximum(counts - size + 1, 1), 0)
    off = np.concatenate([[0], np.cumsum(runs)])
    row = np.repeat(np.arange(len(counts)), runs)
    at = words.first[row] + np.arange(off[-1]) - off[row]
    return mix(rolling(h, _BASE, at, np.minimum(at + size, words.first[row + 1]))), off


def bits(hashes: np.ndarray) -> np.ndarray:
    """The 128 bits of each shingle."""
    wide = np.stack([mix(hashes ^ salt) for salt in _SALTS], axis=1).astype(">u8")
    return np.unpackbits(wide.view(np.uint8).reshape(len(hashes), 16), axis=1)


def fingerprint(ones: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Sixteen bytes for each window ``first:last`` of running sums of bits."""
    return np.packbits(2 * (ones[last] - ones[first]) > (last - first)[:, None], axis=1)


def running(hashes: np.ndarray) -> np.ndarray:
    out = np.zeros((len(hashes) + 1, 128), np.int32)
    np.cumsum(bits(hashes), axis=0, out=out[1:])
    return out


class Items:
    """The benchmark as a task sees it."""

    def __init__(self, texts: list[str], similar: float, radius: int):
        self.similar, self.radius = similar, radius
        h, off = shingles(pa.array(texts, pa.string()))
        self.counts = [Counter(h[a:b].tolist()) for a, b in zip(off, off[1:], strict=False)]
        self.known = np.unique(h)
        self.sieve = np.zeros(1 << SIEVE, bool)
        self.sieve[(h & np.uint64((1 << SIEVE) - 1)).astype(np.int64)] = True
        near = np.bitwise_count(np.arange(256)[:, None] ^ np.arange(256)) <= radius // BLOCKS
        self.sizes = {}
        for size in sorted({int(n) for n in np.diff(off) if n}):
            who = np.flatnonzero(np.diff(off) == size)
            ones = [running(h[off[k] : off[k + 1]]) for k in who]
            prints = np.concatenate([fingerprint(o, np.array([0]), np.array([size])) for o in ones])
            self.sizes[size] = who, prints, near[:, prints.T].transpose(1, 0, 2)  # (block, value, item)

    def lookup(self, size: int, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(window, item, differing bits) of all items of a size within the radius of windows' fingerprints."""
        who, mine, table = self.sizes[size]
        found = table[0, prints[:, 0]]
        for block in range(1, BLOCKS):
            found = found | table[block, prints[:, block]]
        w, k = np.nonzero(found)
        apart = np.bitwise_count(prints[w] ^ mine[k]).sum(1, dtype=np.int64)
        close = apart <= self.radius
        return w[close], who[k[close]], apart[close]

    def search(self, h: np.ndarray) -> list[tuple[int, int, int, float]]:
        """(item, first shingle, differing bits, similarity) of each item's best window in one document's shingles."""
        hits = np.flatnonzero(self.sieve[(h & np.uint64((1 << SIEVE) - 1)).astype(np.int64)])
        if not len(hits):
            return []
        at = np.minimum(np.searchsorted(self.known, h[hits]), len(self.known) - 1)
        held = np.zeros(len(h) + 1, np.int64)
        held[hits + 1] = self.known[at] == h[hits]
        held = np.cumsum(held)
        best: dict[int, tuple] = {}
        ones = None
        share = self.similar / (1 + self.similar)
        for size in self.sizes:
            wide = min(size, len(h))
            need = int(np.ceil(share * (size + wide) - 1e-9))
            if held[-1] < need:
                continue
            first = np.flatnonzero(held[wide:] - held[: len(held) - wide] >= need)
            if not len(first):
                continue
            ones = running(h) if ones is None else ones
            for at in range(0, len(first), 4096):
                some = first[at : at + 4096]
                w, item, apart = self.lookup(size, fingerprint(ones, some, some + wide))
                for p, k, b in zip(some[w].tolist(), item.tolist(), apart.tolist(), strict=True):
                    both = sum((Counter(h[p : p + wide].tolist()) & self.counts[k]).values())
                    s = both / (size + wide - both)
                    if s >= self.similar:
                        found = (-s, p, b)
                        best[k] = min(best.get(k, found), found)
        return [(k, p, b, -s) for k, (s, p, b) in sorted(best.items())]


#: The benchmark that this worker has laid out last, under its part's name.
_LAID: dict[str, Items] = {}


def _laid(shared, similar: float, radius: int) -> Items:
    name, texts = shared.value
    if name not in _LAID:
        _LAID.clear()
        _LAID[name] = Items(texts, similar, radius)
    return _LAID[name]


def _matcher(shared, ids: list, similar: float, radius: int):
    def run(batches):
        items = _laid(shared, similar, radius)
        for batch in batches:
            for piece in pieces(batch, "text"):
                h, off = shingles(piece.column("text"))
                found = [(r, *x) for r in range(piece.num_rows) for x in items.search(h[off[r] : off[r + 1]])]
                if found:
                    row, item, at, apart, s = zip(*found, strict=True)
                    cols = [piece.column("doc_id").take(pa.array(row)), pa.array([ids[k] for k in item], pa.int64()), pa.array(at, pa.int64()), pa.array(apart, pa.int32()), pa.array(s)]
                    yield pa.RecordBatch.from_arrays(cols, ["doc_id", "item_id", "first_word", "bits", "similarity"])

    return tidy(run)


def _parts(items: DataFrame):
    """Distinct items in parts of bounded size: their ids, and a broadcast of their texts."""
    spark = items.sparkSession
    items = items.select(F.col("item_id").cast("long"), "text").filter("text is not null").distinct()
    total, held = items.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    parts = max(1, -(-total // ITEMS), -(-held // ITEM_BYTES))
    for part in range(parts):
        rows = items if parts == 1 else items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == part)
        got = sorted(((r.item_id, r.text) for r in rows.toLocalIterator()), key=lambda x: (x[0] is None, x))
        yield [g[0] for g in got], spark.sparkContext.broadcast((uuid.uuid4().hex, [g[1] for g in got]))


def matches(docs: DataFrame, items: DataFrame, similar: float = SIMILAR, radius: int = RADIUS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, item_id, first_word, bits, similarity): for each document and item its best verified window.

    Words are runs of ``[^\\x20\\x09-\\x0D]``, A-Z lower-cased. Items of fewer than five words
    are one shingle and match documents that are those words, not texts that hold them among
    others, as so few words say nothing about a text; null and empty items and texts
    match nothing. Where the text has fewer shingles than the item, the whole text is the
    window, so a shortened item is found too. Rows with a null doc_id or repeated rows are matched like any other. Ties
    go to the earlier window. ``first_word`` counts from 0. Texts count whole, however long; empty
    tables give an empty result. Other columns are left out.
    """
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, item_id long, first_word long, bits int, similarity double"
    found = [docs.mapInArrow(_matcher(shared, ids, similar, radius), schema) for ids, shared in _parts(items)]
    out = found[0]
    for more in found[1:]:
        out = out.union(more)
    return out


def _flagger(shared, similar: float, radius: int, names: list[str]):
    def run(batches):
        items = _laid(shared, similar, radius)
        for batch in batches:
            for piece in pieces(batch, "text"):
                h, off = shingles(piece.column("text"))
                keep = [not items.search(h[off[r] : off[r + 1]]) for r in range(piece.num_rows)]
                yield piece.filter(pa.array(keep, pa.bool_())).select(names)

    return tidy(run)


def without_benchmark(docs: DataFrame, items: DataFrame, similar: float = SIMILAR, radius: int = RADIUS) -> DataFrame:
    """``docs`` (with a column text) without the documents in which a window matches an item; see ``matches``."""
    for _, shared in _parts(items):
        docs = docs.mapInArrow(_flagger(shared, similar, radius, docs.columns), docs.schema)
    return docs
