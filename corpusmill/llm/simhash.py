"""SimHash fingerprints, and links between them by a self-join of binary tries.

Fingerprints are sorted bit strings, so a node of their trie is a range of rows. The join
goes down the trie with pairs of nodes: a pair's children are the pairs of their children,
those on different sides cost one differing bit, and a pair is dropped once it has spent
more than the error budget. Work is done for all pairs of a level at a time in numpy.

Among ``budget + 1`` blocks of a fingerprint, one is equal in any two fingerprints within
the budget. So each rotation that brings one block to the front is joined with no errors
allowed in the front block: its nodes at that depth are independent tasks, spread by a
shuffle. A front block with more rows than ``crowd`` is split further down: its sub-nodes
meet in pairs within the budget, each pair a task of its own; what is still crowded is dealt
into parts, of which every two meet. Tasks come sorted and are worked on one after the other.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.components import connected_components, joined
from corpusmill.llm.decontaminate import shingles
from corpusmill.llm.shared import cut, partitions, scratch
from corpusmill.llm.words import Words, mix, pieces, tidy

#: Pairs of nodes in work at a time, and rows under a pair of nodes from which rows are compared one by one.
FRONT, LEAF = 1 << 19, 32
#: Bits by which crowded blocks are split further.
SUB = 6


def shingle_hashes(words: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """XXH64 (seed 42) of each row's runs of ``size`` words joined by one space, and each row's first run.

    A row of fewer words has one run, all of its words; a row without words has none.
    """
    spaced = words.spaced()
    counts = spaced.counts
    runs = np.where(counts > 0, np.maximum(counts - size + 1, 1), 0)
    first = np.concatenate([[0], np.cumsum(runs)])
    row = np.repeat(np.arange(len(counts)), runs)
    at = spaced.first[row] + np.arange(first[-1]) - first[row]
    last = np.minimum(at + size, spaced.first[row + 1]) - 1
    data, digest = spaced.data.tobytes(), xxhash.xxh64_intdigest
    spans = zip(spaced.starts[at].tolist(), spaced.ends[last].tolist(), strict=True)
    return np.fromiter((digest(data[a:b], 42) for a, b in spans), np.uint64, len(at)), first


def majority(hashes: np.ndarray, first: np.ndarray, extra: int = 0) -> np.ndarray:
    """A row of 1 + ``extra`` fingerprints (uint64) per group of hashes; bits set in over half of the group's hashes.

    Groups without hashes have zeros. Fingerprint k > 0 uses the hashes scrambled with k.
    """
    rows = len(first) - 1
    out = np.zeros((rows, 1 + extra), np.uint64)
    full = np.flatnonzero(np.diff(first) > 0)
    if not len(full):
        return out
    for k in range(1 + extra):
        h = hashes if not k else mix(hashes ^ np.uint64(0x9E3779B97F4A7C15 * k % (1 << 64)))
        bits = np.unpackbits(h.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        ones = np.add.reduceat(bits, first[full], axis=0, dtype=np.int32)
        out[full, k] = np.packbits(2 * ones > np.diff(first)[full, None], axis=1).view(">u8").astype(np.uint64)[:, 0]
    return out


def _fingerprinter(size: int, extra: int):
    def run(batches):
        for batch in batches:
            for piece in pieces(batch, "text"):
                words = Words.of(piece.column("text"), lower=True)
                hashes, first = shingle_hashes(words, size)
                prints = majority(hashes, first, extra)
                cols = [piece.column("doc_id"), *(pa.array(prints[:, k].view(np.int64)) for k in range(1 + extra))]
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", *(f"f{k}" for k in range(1 + extra))])

    return tidy(run)


def fingerprints(docs: DataFrame, size: int = 3, extra: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, f0, ...) per document: 64-bit SimHash fingerprints as longs (the bits of an unsigned number).

    Words are runs of ``[^\\x20\\x09-\\x0D]``, A-Z lower-cased; shingles are ``size`` words,
    repeats included. Null and empty texts have fingerprint 0. Long
    texts count whole. Repeated rows are kept, other columns are left out.
    """
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, " + ", ".join(f"f{k} long" for k in range(1 + extra))
    return docs.mapInArrow(_fingerprinter(size, extra), schema)


def trie_pairs(keys: np.ndarray, roots: tuple, top: int, budget: int, label: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs i < j of the rows under pairs of trie nodes that differ in at most ``budget`` bits.

    keys: rows sorted within each node; ``roots``: (a0, a1, b0, b1, spent) arrays, the nodes
    being rows a0:a1 and b0:b1 that share their bits from ``top`` up; a node may meet itself.
    With ``label``, pairs of nodes whose rows all have one label are not gone into.
    """
    ones: dict[int, np.ndarray] = {}
    turns = None if label is None else np.concatenate([[0], np.cumsum(label[1:] != label[:-1])])
    stack = [(top, *roots)]
    while stack:
        bit, a0, a1, b0, b1, spent = stack.pop()
        if len(a0) > FRONT:
            half = len(a0) // 2
            stack += [(bit, *(x[half:] for x in (a0, a1, b0, b1, spent))), (bit, *(x[:half] for x in (a0, a1, b0, b1, spent)))]
            continue
        if turns is not None:
            mixed = (turns[a1 - 1] > turns[a0]) | (turns[b1 - 1] > turns[b0]) | (label[a0] != label[b0])
            a0, a1, b0, b1, spent = (x[mixed] for x in (a0, a1, b0, b1, spent))
        small = (a1 - a0) * (b1 - b0) <= LEAF if bit else np.ones(len(a0), bool)
        if small.any():
            yield from _leaves(keys, *(x[small] for x in (a0, a1, b0, b1)), budget)
            a0, a1, b0, b1, spent = (x[~small] for x in (a0, a1, b0, b1, spent))
        if not len(a0):
            continue
        bit -= 1
        if bit not in ones:
            ones[bit] = np.concatenate([[0], np.cumsum((keys >> np.uint64(bit)) & np.uint64(1), dtype=np.int64)])
        a, b = a1 - (ones[bit][a1] - ones[bit][a0]), b1 - (ones[bit][b1] - ones[bit][b0])
        same = a0 == b0
        kids = [
            np.concatenate(x)
            for x in zip(
                (a0, a, b0, b, spent),
                (a, a1, b, b1, spent),
                (a0, a, b, b1, spent + 1),
                (a[~same], a1[~same], b0[~same], b[~same], spent[~same] + 1),
                strict=True,
            )
        ]
        live = (kids[0] < kids[1]) & (kids[2] < kids[3]) & (kids[4] <= budget)
        stack.append((bit, *(x[live] for x in kids)))


def _leaves(keys, a0, a1, b0, b1, budget) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Compare all rows under each pair of nodes, about two million comparisons at a time."""
    wide = b1 - b0
    count = (a1 - a0) * wide
    ends = np.cumsum(count)
    at = 0
    while at < len(count):
        done = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, done + (1 << 21), "right")))
        if to == at + 1 and count[at] > 1 << 21:  # a large node at the last bit: equal keys, row by row
            for i in range(int(a0[at]), int(a1[at])):
                j = np.arange(max(i + 1, b0[at]), b1[at]) if a0[at] == b0[at] else np.arange(b0[at], b1[at])
                j = j[np.bitwise_count(keys[i] ^ keys[j]) <= budget]
                yield np.full(len(j), i), j
        else:
            n = count[at:to]
            pair = np.repeat(np.arange(at, to), n)
            k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            i, j = a0[pair] + k // wide[pair], b0[pair] + k % wide[pair]
            hit = (i < j) & (np.bitwise_count(keys[i] ^ keys[j]) <= budget)
            yield i[hit], j[hit]
        at = to


def _blocks(bits: int, budget: int) -> list[tuple[int, int]]:
    """(offset from the top, width) of budget + 1 blocks."""
    edges = [bits * k // (budget + 1) for k in range(budget + 2)]
    return [(a, b - a) for a, b in zip(edges, edges[1:], strict=False)]


#: Rows of whole tasks that a worker takes at a time, unless one task alone has more.
TASKS = 1 << 17


def _whole_tasks(batches, most: int = TASKS) -> Iterator[pa.Table]:
    """Tables of whole tasks (equal ``task`` and ``part``), which come sorted by these, of about ``most`` rows."""
    have: list[pa.RecordBatch] = []
    held = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        ids = [np.stack([x.column(c).to_numpy() for c in ("task", "part")]) for x in (batch, *have[:1])]
        if held >= most and (ids[1][:, 0] != ids[0][:, -1]).any():
            edge = int(np.argmax((ids[0] == ids[0][:, -1:]).all(0)))
            yield pa.Table.from_batches([*have, batch.slice(0, edge)])
            have, held = [], 0
            batch = batch.slice(edge)
        have.append(batch)
        held += batch.num_rows
    if have:
        yield pa.Table.from_batches(have)


def _starts(task: np.ndarray, part: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.append(True, (task[1:] != task[:-1]) | (part[1:] != part[:-1])))[: len(task)]


def _joiner(bits: int, budget: int):
    """Rows (task, part, key, node) to edges (a, b): a spanning forest of the links in each task."""

    def work(table: pa.Table) -> Iterator[pa.RecordBatch]:
        task, part, key, node = (table.column(c).to_numpy().astype(np.int64) for c in ("task", "part", "key", "node"))
        order = np.lexsort((key.view(np.uint64), part, task))
        task, part, keys, node = task[order], part[order], key[order].view(np.uint64), node[order]
        lo = _starts(task, part)
        hi = np.append(lo[1:], len(task))
        code = task[lo]
        rotation, sub = code >> 40 & 0xFF, code & 0xFFFF
        widths = np.array([w for _, w in _blocks(bits, budget)])
        tops = bits - widths[rotation]
        labels = np.arange(len(task))
        for top in np.unique(tops):
            whole = (tops == top) & (sub == 0)
            roots = [lo[whole], hi[whole], lo[whole], hi[whole], np.zeros(whole.sum(), np.int64)]
            starts = [(int(top), roots)]
            parts = np.flatnonzero((tops == top) & (sub > 0))
            if len(parts):  # sub-nodes of a crowded block: one, or two that meet
                low, pair = top - SUB, sub[parts] - 1
                one, side = pair >> 6 == pair & 63, pair & 63
                mid = np.array([lo[p] + np.searchsorted(keys[lo[p] : hi[p]] >> np.uint64(low) & np.uint64(63), np.uint64(x)) for p, x in zip(parts, side, strict=True)], dtype=np.int64)
                mid = np.where(one, hi[parts], mid)
                spent = np.bitwise_count(pair >> 6 ^ side).astype(np.int64)
                both = one | (mid > lo[parts]) & (mid < hi[parts])
                starts.append((int(low), [x[both] for x in (lo[parts], mid, np.where(one, lo[parts], mid), hi[parts], spent)]))
            for depth, root in starts:
                for i, j in trie_pairs(keys, root, depth, budget):
                    if len(i):
                        labels = joined(labels, i, j)
        yield from _stars(node, labels)

    def run(batches):
        for table in _whole_tasks(batches):
            yield from work(table)

    return tidy(run)


def _dealt(rows: DataFrame, busy: DataFrame) -> DataFrame:
    """``rows`` with ``part``: tasks of ``busy`` (task, parts) are dealt by node into at least three parts, of which every two are a task."""
    rows = rows.withColumn("part", F.lit(0).cast("long"))
    busy = cut(busy)
    if busy.isEmpty():
        return rows
    sized = rows.join(busy.select("task", F.greatest(F.lit(3).cast("long"), "parts").alias("_c")), "task", "left")
    mine = F.pmod(F.xxhash64("node"), F.col("_c"))
    pair = F.transform(F.sequence(F.lit(0).cast("long"), F.col("_c") - 1), lambda o: F.least(mine, o) * F.col("_c") + F.greatest(mine, o) + 1)
    others = F.filter(pair, lambda x: x != mine * F.col("_c") + mine + 1)
    return sized.withColumn("part", F.explode(F.when(F.col("_c").isNull(), F.array(F.lit(0).cast("long"))).otherwise(others))).drop("_c")


def _crowded(rows: DataFrame, crowd: int) -> DataFrame:
    """(task, parts) of the tasks of over ``crowd`` rows."""
    return rows.groupBy("task").agg(F.count("*").alias("_n")).filter(F.col("_n") > crowd).select("task", F.ceil(2 * F.col("_n") / crowd).alias("parts"))


def _to_tasks(rows: DataFrame, few: bool = False) -> DataFrame:
    """Whole tasks in one partition each, one after the other; with ``few`` rows, small partitions may be put together."""
    keys = ["task", "part"]
    dealt = rows.repartition(*keys) if few else rows.repartition(partitions(rows.sparkSession), *keys)
    return dealt.sortWithinPartitions(*keys)


def links(rows: DataFrame, bits: int, budget: int, crowd: int = 1 << 19) -> DataFrame:
    """Edges (a, b) that join the nodes of ``rows`` (key, node) as their links do.

    Two nodes link if their keys (the lowest ``bits`` bits) differ in at most ``budget`` bits.
    Not all links come back but a forest of them for each task, so copies of copies are no pairs.
    """
    mask = (1 << bits) - 1
    spun = []
    for k, (at, width) in enumerate(_blocks(bits, budget)):
        key = F.col("key") if bits == 64 else F.col("key").bitwiseAND(mask)
        turned = key if not at else F.shiftleft(key, at).bitwiseOR(F.shiftrightunsigned(key, bits - at))
        turned = turned if bits == 64 else turned.bitwiseAND(mask)
        block = F.shiftrightunsigned(turned, bits - width)
        task = F.shiftleft(F.lit(k).cast("long"), 40).bitwiseOR(F.shiftleft(block, 16))
        spun.append(F.struct(task.alias("task"), turned.alias("key"), F.lit(bits - width - SUB).alias("low")))
    rows = rows.withColumn("_s", F.explode(F.array(*spun))).select("_s.task", "_s.key", "_s.low", "node")
    busy = cut(rows.groupBy("task").agg(F.count("*").alias("_n")).filter(F.col("_n") > crowd).select("task"))
    if not busy.isEmpty():
        mine = F.expr("shiftrightunsigned(key, greatest(low, 0)) & 63")
        near = F.array(*[F.lit(x) for x in range(64) if x.bit_count() <= budget])
        marked = rows.join(busy.withColumn("_hot", F.lit(1)), "task", "left").withColumn("_hot", F.col("_hot").isNotNull() & (F.col("low") >= 0))
        pair = lambda x: F.shiftleft(F.least(mine, mine.bitwiseXOR(x)), 6).bitwiseOR(F.greatest(mine, mine.bitwiseXOR(x)))
        tasks = F.when(F.col("_hot"), F.transform(near, lambda x: F.col("task") + pair(x) + 1)).otherwise(F.array("task"))
        rows = marked.withColumn("task", F.explode(tasks)).select("task", "key", "node")
        rows = _dealt(rows, _crowded(rows, crowd))
    else:
        rows = rows.withColumn("part", F.lit(0).cast("long"))
    return _to_tasks(rows.select("task", "part", "key", "node")).mapInArrow(_joiner(bits, budget), "a long, b long")


def components(prints: DataFrame, edges: DataFrame, node: str) -> DataFrame:
    """``prints`` with component_id, the smallest doc_id of the rows whose ``node`` the edges join."""
    roots = connected_components(edges)
    rooted = prints.join(roots.withColumnRenamed("node", node), node, "left").withColumn("root", F.coalesce("root", node))
    # a table of its own, so that the join is one of two shuffled tables and a hot root can be split
    least = cut(rooted.groupBy("root").agg(F.min("doc_id").alias("component_id")))
    return rooted.join(least, "root")


def near_duplicates(docs: DataFrame, size: int = 3, budget: int = 3, crowd: int = 1 << 19, **names) -> DataFrame:
    """(doc_id, fingerprint, component_id) per document; fingerprints link at ``budget`` or fewer differing bits.

    ``fingerprint`` is 16 lower-case hex digits, component_id the smallest doc_id reachable
    by links. Equal fingerprints are one node, so copies cost nothing in the join. A null
    doc_id takes part in links but is no component_id; a component of nulls has null. An
    empty table gives an empty result.
    """
    prints = cut(fingerprints(docs, size, **names))
    nodes = prints.select(F.col("f0").alias("key"), F.col("f0").alias("node")).distinct()
    found = components(prints, links(nodes, 64, budget, crowd=crowd), "f0")
    return found.select("doc_id", F.lower(F.lpad(F.hex("f0"), 16, "0")).alias("fingerprint"), "component_id")


# --- similarity of shingle sets ---------------------------------------------------------------

#: Bits of a sketch, chance that a pair at the threshold becomes a candidate, and chance meetings of a row in one table.
WIDE, RECALL, CHANCE = 256, 0.98, 32
#: Rows of a front block that a table is laid out for, and texts of a group from which it is compared in several tasks.
BLOCK, HUB = 1 << 19, 1024
#: Sets of up to so many shingles are also compared exactly, without sketches.
SMALL = 9
#: Texts of a crowded task that all others are compared with first.
LEADERS = 16
#: Compressed bytes of a part of a group, bits of the widest parity map, rows compared at a time with others, and shingles verified at a time.
GROUP, MAP, ROWS, VERIFIED = 8 << 20, 1 << 14, 32, 1 << 21


def share(similar: float) -> float:
    """Share of differing sketch bits of two sets of a Jaccard similarity, by the angle between them. Sets of few shingles have up to 3 % more, but for one of 4 in one of 5, which has 20 % more: see ``_small_edges``."""
    return float(np.arccos(2 * similar / (1 + similar)) / np.pi) * 1.03


def _chances(n: int, p: float) -> np.ndarray:
    """Chances of 0 to n hits with a chance of ``p`` each."""
    return np.array([comb(n, k) * p**k * (1 - p) ** (n - k) for k in range(n + 1)])


def recall(bits: int, budget: int, tables: int, far: int, p: float) -> float:
    """Chance that sketches which differ in each bit with a chance of ``p`` meet in one of ``tables`` tables and differ in at most ``far`` bits."""
    k = np.arange(far + 1)
    meet = np.array([sum(comb(x, e) * comb(WIDE - x, bits - e) for e in range(budget + 1)) / comb(WIDE, bits) for x in k.tolist()])
    return float((_chances(WIDE, p)[: far + 1] * (1 - (1 - meet) ** tables)).sum())


@cache
def plan(rows: int, similar: float = 0.8, wanted: float = RECALL) -> tuple[int, int, int, int]:
    """Bits of a key, its error budget, the number of tables, and the bits by which whole sketches may differ.

    Keys are so long that a row meets ``CHANCE`` others by chance in a table, whatever the
    number of rows, and there are as many tables as the wanted recall takes at ``similar``.
    Of the budgets that keep front blocks small the one with fewest rows to send is taken.
    """
    p = share(similar)
    tail = np.cumsum(_chances(WIDE, p))
    far = int(np.argmax(tail >= 1 - (1 - wanted) / 4))
    best = None
    for budget in range(4):
        bits = 16
        while bits < 63 and rows * sum(comb(bits, e) for e in range(budget + 1)) > CHANCE << bits:
            bits += 1
        if budget and rows >> (bits // (budget + 1)) > BLOCK:
            continue
        tables = 1
        while recall(bits, budget, tables, far, p) < wanted:
            tables += 1 + tables // 16
        if best is None or tables * (budget + 1) < best[0]:
            best = tables * (budget + 1), (bits, budget, tables, far)
    return best[1]


@cache
def _places(bits: int, tables: int) -> np.ndarray:
    """For each table the bits of the sketch that make its key, drawn once and for all."""
    rng = np.random.default_rng(20)
    return np.array([rng.permutation(WIDE)[:bits] for _ in range(tables)])


def _key(sketch: np.ndarray, places: np.ndarray, turn: int) -> np.ndarray:
    """The key of one table, turned to the left by ``turn`` bits."""
    key = np.zeros(len(sketch), np.uint64)
    for bit in np.roll(places, -turn).tolist():
        key = key << np.uint64(1) | sketch[:, bit // 64] >> np.uint64(bit % 64) & np.uint64(1)
    return key


def _sketches(batch) -> np.ndarray:
    return np.stack([batch.column(f"f{k}").to_numpy().view(np.uint64) for k in range(WIDE // 64)], axis=1)


def _spread(bits: int, budget: int, tables: int, names: list[str]):
    """Nodes to a row for each table and rotation: its task is the table, rotation and front block."""
    places, blocks = _places(bits, tables), _blocks(bits, budget)

    def run(batches):
        for batch in batches:
            sketch = _sketches(batch)
            for table in range(tables):
                for rotation, (at, width) in enumerate(blocks):
                    block = _key(sketch, places[table][np.arange(at, at + width)], 0).astype(np.int64)
                    task = (table << 8 | rotation) << 40 | block
                    yield pa.RecordBatch.from_arrays([pa.array(task), *(batch.column(c) for c in names)], ["task", *names])

    return tidy(run)


def _ordered(table: pa.Table, bits: int, budget: int, tables: int):
    """A table of whole tasks sorted by turned keys: node, sketch, key, edges of the tasks and bits left to each."""
    places, blocks = _places(bits, tables), _blocks(bits, budget)
    task, part, node = (table.column(c).to_numpy().astype(np.int64) for c in ("task", "part", "node"))
    sketch = _sketches(table)
    key = np.zeros(len(task), np.uint64)
    kind = task >> 40
    for k in np.unique(kind).tolist():
        some = kind == k
        key[some] = _key(sketch[some], places[k >> 8], blocks[k & 0xFF][0])
    order = np.lexsort((key, part, task))
    task, part, node, sketch, key = (x[order] for x in (task, part, node, sketch, key))
    lo = _starts(task, part)
    hi = np.append(lo[1:], len(task))
    widths = np.array([w for _, w in blocks])
    return node, sketch, key, lo, hi, bits - widths[task[lo] >> 40 & 0xFF]


def _stars(node: np.ndarray, labels: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Edges (a, b) of each node to the smallest one of its label: tasks that see the same ones say the same."""
    least = np.full(len(labels), np.iinfo(np.int64).max)
    np.minimum.at(least, labels, node)
    moved = np.flatnonzero(node != least[labels])
    for at in range(0, len(moved), 1 << 16):
        m = moved[at : at + (1 << 16)]
        yield pa.RecordBatch.from_arrays([pa.array(node[m]), pa.array(least[labels[m]])], ["a", "b"])


def _resembling(bits: int, budget: int, tables: int, far: int):
    """Rows of whole tasks to edges (a, b): a spanning forest of the candidates, nodes within the budget and ``far``, of each task.

    In tasks in which many keys are equal each row is compared with ``LEADERS`` of them first,
    and those that are then together are not compared with each other.
    """

    def work(table: pa.Table) -> Iterator[pa.RecordBatch]:
        node, sketch, key, lo, hi, tops = _ordered(table, bits, budget, tables)
        labels = np.arange(len(node))
        run_of = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        long = np.diff(np.append(run_of, len(key)))
        group = np.searchsorted(lo, run_of, "right") - 1
        crowded = np.bincount(group, long.astype(float) ** 2, len(lo)) > 64 * (hi - lo)
        for a, b in zip(lo[crowded].tolist(), hi[crowded].tolist(), strict=True):
            heads = np.unique(np.linspace(a, b - 1, LEADERS).astype(np.int64))
            for at in range(a, b, 1 << 16):
                rows = np.arange(at, min(b, at + (1 << 16)))
                i, j = np.nonzero(np.bitwise_count(sketch[rows, None] ^ sketch[heads]).sum(2, dtype=np.int64) <= far)
                labels = joined(labels, rows[i], heads[j])
        for top in np.unique(tops).tolist():
            a, b = lo[tops == top], hi[tops == top]
            for i, j in trie_pairs(key, (a, b, a, b, np.zeros(len(a), np.int64)), int(top), budget, labels):
                near = np.bitwise_count(sketch[i] ^ sketch[j]).sum(1, dtype=np.int64) <= far
                if near.any():
                    labels = joined(labels, i[near], j[near])
        yield from _stars(node, labels)

    def run(batches):
        for table in _whole_tasks(batches):
            yield from work(table)

    return tidy(run)


def _distinct(texts: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingle hashes of all rows, each row's sorted, and their offsets."""
    hashes, first = shingles(texts, size)
    row = np.repeat(np.arange(len(first) - 1), np.diff(first))
    order = np.lexsort((hashes, row))
    hashes, row = hashes[order], row[order]
    new = np.append(True, (hashes[1:] != hashes[:-1]) | (row[1:] != row[:-1]))[: len(hashes)]
    return hashes[new], np.searchsorted(row[new], np.arange(len(first)))


def _parts(hashes: np.ndarray) -> np.ndarray:
    """What each hash adds to the sum from which a set's number is made."""
    return mix(hashes ^ np.uint64(0x9E3779B97F4A7C15))


def _nodes(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """A 64-bit number for each set of hashes, equal for equal sets; 0 for empty ones."""
    counts = np.diff(first)
    out, full = np.zeros(len(counts), np.uint64), np.flatnonzero(counts > 0)
    if len(full):
        out[full] = mix(np.add.reduceat(_parts(hashes), first[full]) + counts[full].astype(np.uint64))
    return out.view(np.int64)


def _sketcher(size: int):
    """Rows (doc_id, text) to (doc_id, node, n, f0, f1, packed): the set's number and size, its sketch, and the text compressed."""

    def run(batches):
        pack = zstandard.ZstdCompressor(level=1).compress
        for batch in batches:
            for piece in pieces(batch, "text"):
                hashes, first = _distinct(piece.column("text"), size)
                prints = majority(mix(hashes.copy()), first, WIDE // 64 - 1)
                packed = pa.array([pack((t or "").encode()) for t in piece.column("text").to_pylist()], pa.binary())
                cols = [piece.column("doc_id"), pa.array(_nodes(hashes, first)), pa.array(np.diff(first)), *(pa.array(f.view(np.int64)) for f in prints.T.copy()), packed]
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "node", "n", *(f"f{k}" for k in range(WIDE // 64)), "packed"])

    return tidy(run)


def _parity(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """A map of bits (uint64) for each set: whether an odd number of its hashes fall on a bit.

    Where the maps of two sets differ in d bits, the sets differ in d elements at least.
    """
    n = np.diff(first)
    wide = min(MAP, max(256, 1 << int(4 * n.max() - 1).bit_length()))
    out = []
    for at in range(0, len(n), max(1, (1 << 22) // wide)):
        to = min(len(n), at + max(1, (1 << 22) // wide))
        bit = np.repeat(np.arange(to - at), n[at:to]) * wide + (hashes[first[at] : first[to]] % np.uint64(wide)).astype(np.int64)
        odd = np.bincount(bit, minlength=(to - at) * wide) & 1
        out.append(np.packbits(odd.astype(np.uint8).reshape(to - at, wide), axis=1).view(np.uint64))
    return np.concatenate(out)


def _alike(hashes: np.ndarray, first: np.ndarray, i: np.ndarray, j: np.ndarray, similar: float) -> np.ndarray:
    """Whether the sets i[k] and j[k] have an exact Jaccard similarity of ``similar`` or more."""
    n, out = np.diff(first), np.zeros(len(i), bool)
    ends = np.cumsum(n[i] + n[j])
    at = 0
    while at < len(i):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + VERIFIED, "right")))
        sets, pair = np.concatenate([i[at:to], j[at:to]]), np.tile(np.arange(to - at), 2)
        row = np.repeat(pair, n[sets])
        h = hashes[np.repeat(first[sets] - np.cumsum(n[sets]) + n[sets], n[sets]) + np.arange(len(row))]
        order = np.lexsort((h, row))
        h, row = h[order], row[order]
        both = np.bincount(row[1:][(h[1:] == h[:-1]) & (row[1:] == row[:-1])], minlength=to - at)
        out[at:to] = both * (1 + similar) >= similar * (n[i[at:to]] + n[j[at:to]]) - 1e-9
        at = to
    return out


def _linked(hashes: np.ndarray, first: np.ndarray, similar: float) -> np.ndarray:
    """Labels that join the sets as all their exact links do, whichever of them resemble each other.

    Sets come by size, as links are between like sizes. What the parity maps leave possible is
    verified, the nearest first; sets that are together by then are not compared again.
    """
    n = np.diff(first)
    labels, maps = np.arange(len(n)), _parity(hashes, first)
    wide = max(ROWS, (1 << 20) // (ROWS * maps.shape[1]))
    for at in range(0, len(n), ROWS):
        rows = np.arange(at, min(len(n), at + ROWS))
        end = int(np.searchsorted(n, n[rows[-1]] / similar + 1e-6, "right"))
        for low in range(at, end, wide):
            others = np.arange(low, min(end, low + wide))
            if (labels[others] == labels[at]).all() and (labels[rows] == labels[at]).all():
                continue
            apart = np.bitwise_count(maps[rows, None] ^ maps[others]).sum(2, dtype=np.int64)
            total = n[rows, None] + n[others]
            i, j = np.nonzero((rows[:, None] < others) & (labels[rows, None] != labels[others]) & ((total - apart) * (1 + similar) >= 2 * similar * total - 1e-9))
            order = np.lexsort((apart[i, j], i))
            i, j, take = rows[i[order]], others[j[order]], 1
            while len(i):
                new = np.flatnonzero(np.append(True, i[1:] != i[:-1]))
                now = np.arange(len(i)) - np.repeat(new, np.diff(np.append(new, len(i)))) < take
                found = _alike(hashes, first, i[now], j[now], similar)
                labels = joined(labels, i[now][found], j[now][found])
                i, j = i[~now], j[~now]
                open_ = labels[i] != labels[j]
                i, j, take = i[open_], j[open_], 2 * take
    return labels


def _comparer(size: int, similar: float):
    """Rows (task, part, node, packed) of whole tasks to edges (a, b): a spanning forest of the exact links in each task."""

    def run(batches):
        unpack = zstandard.ZstdDecompressor().decompress
        for table in _whole_tasks(batches, HUB):
            task, part, node = (table.column(c).to_numpy().astype(np.int64) for c in ("task", "part", "node"))
            order = np.lexsort((node, part, task))
            lo = _starts(task[order], part[order])
            for a, b in zip(lo.tolist(), [*lo[1:].tolist(), len(order)], strict=True):
                some = table.select(["node", "packed"]).take(pa.array(order[a:b])).combine_chunks().to_batches()[0]
                sets = [_distinct(pa.array([unpack(t.as_buffer()) for t in x.column("packed")], pa.binary()), size) for x in pieces(some, "packed", 1 << 18)]
                hashes, n = np.concatenate([h for h, _ in sets]), np.concatenate([np.diff(f) for _, f in sets])
                first, by = np.concatenate([[0], np.cumsum(n)]), np.argsort(n, kind="stable")
                hashes = hashes[np.repeat(first[by] - np.cumsum(n[by]) + n[by], n[by]) + np.arange(len(hashes))]
                yield from _stars(node[order[a:b]][by], _linked(hashes, np.concatenate([[0], np.cumsum(n[by])]), similar))

    return tidy(run)


def _subsets(size: int, least: int):
    """Rows (node, packed) of sets that aren't empty to (key, node, kept, whole): the numbers of the set itself and of it without each one of its shingles, if ``least`` are kept."""

    def run(batches):
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            for piece in pieces(batch, "packed", 1 << 18):
                hashes, first = _distinct(pa.array([unpack(t.as_buffer()) for t in piece.column("packed")], pa.binary()), size)
                node, n, parts = piece.column("node").to_numpy(), np.diff(first), _parts(hashes)
                row = np.repeat(np.arange(len(n)), n)
                rest = mix(np.add.reduceat(parts, first[:-1])[row] - parts + (n[row] - 1).astype(np.uint64)).view(np.int64)
                key, of, kept = np.concatenate([node, rest]), np.concatenate([node, node[row]]), np.concatenate([n, n[row] - 1])
                some = kept >= least
                yield pa.RecordBatch.from_arrays([pa.array(x[some]) for x in (key, of, kept, np.arange(len(key)) < len(node))], ["key", "node", "kept", "whole"])

    return tidy(run)


def _small_edges(prints: DataFrame, size: int, similar: float) -> DataFrame:
    """Edges (a, b) that join all nodes of up to ``SMALL`` shingles, of which one is another with one more, or two are alike but for one each, by exact similarity.

    A set and its subsets of one shingle less meet by their numbers. Those that meet share all
    but one shingle at most, so one edge for each, to the set that is shared or else the
    smallest node, joins what is alike, and no pairs are listed.
    """
    least = next(c for c in range(1, 1 << 20) if c >= similar * (c + 1) - 1e-9) if similar < 1 else SMALL
    small = prints.filter(F.col("n").between(least, SMALL)).groupBy("node").agg(F.first("packed").alias("packed"))
    keyed = cut(small.mapInArrow(_subsets(size, least), "key long, node long, kept long, whole boolean"))
    swapped = F.col("kept") >= similar * (F.col("kept") + 2) - 1e-9
    heads = keyed.groupBy("key", "kept").agg(F.count("*").alias("_n"), F.max(F.when(F.col("whole"), F.col("node"))).alias("_whole"), F.min("node").alias("_low"))
    heads = heads.filter("_n > 1").select("key", F.coalesce("_whole", F.when(swapped, F.col("_low"))).alias("_head")).filter("_head is not null")
    met = keyed.join(heads, "key").filter("node <> _head")
    return cut(met.select(F.least("node", "_head").alias("a"), F.greatest("node", "_head").alias("b")).distinct())


def _similar_nodes(prints: DataFrame, size: int, similar: float, crowd: int) -> DataFrame:
    """Edges (a, b) that join the nodes of ``prints`` as all candidates of ``similar`` or more do."""
    fields = [f"f{k}" for k in range(WIDE // 64)]
    nodes = cut(prints.filter("n > 0").groupBy("node").agg(*[F.first(c).alias(c) for c in fields]))
    shape = plan(1 << max(0, nodes.count() - 1).bit_length(), similar)
    # groups of texts that resemble each other by sketch, directly or through others
    names = ["node", *fields]
    spread = nodes.select(names).mapInArrow(_spread(*shape[:3], names), "task long, " + ", ".join(f"{c} long" for c in names))
    near = _to_tasks(_dealt(spread, _crowded(spread, crowd))).mapInArrow(_resembling(*shape), "a long, b long")
    groups = connected_components(near).withColumnRenamed("root", "task")
    # each text goes once to its group, or to the parts of a large one, and is compared there
    texts = cut(prints.select("node", "packed").join(groups, "node").groupBy("node").agg(F.first("task").alias("task"), F.first("packed").alias("packed")))
    loads = texts.groupBy("task").agg(F.count("*").alias("_n"), F.sum(F.length("packed")).alias("_b")).filter((F.col("_n") > HUB) | (F.col("_b") > 2 * GROUP))
    parts = loads.select("task", F.greatest(F.ceil(2 * F.sqrt(F.col("_n") / HUB)), F.ceil(F.col("_b") / GROUP)).alias("parts"))
    found = _to_tasks(_dealt(texts, parts).select("task", "part", "node", "packed")).mapInArrow(_comparer(size, similar), "a long, b long")
    return _small_edges(prints, size, similar).union(cut(found.distinct()))


def similar_documents(docs: DataFrame, size: int = 5, similar: float = 0.8, crowd: int = 1 << 19, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, component_id) per document: documents link whose shingle sets are alike by ``similar`` or more.

    Candidates come from SimHash sketches of the sets of ``size``-word shingles: trie
    self-joins of as many keys, drawn from a sketch's bits, as find a pair at the threshold
    with a chance of ``RECALL`` at any number of documents (see ``plan``); nearer pairs are
    missed much more seldom. Sets of up to ``SMALL`` shingles are also joined exactly. Each link is then verified by the exact Jaccard similarity of
    the two sets, so no pair below ``similar`` counts: candidates, with what links them through
    others, make groups, and in each group all texts are compared where they lie, so no pairs
    are listed. Documents of equal sets are one node. Texts of no words are alike.
    A null doc_id takes part but is no component_id. Repeated rows are kept, other columns
    left out, an empty table gives an empty result. Shingles and sets are told apart by
    64-bit hashes.
    """
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    fields = ", ".join(f"f{k} long" for k in range(WIDE // 64))
    prints = cut(docs.mapInArrow(_sketcher(size), f"doc_id {kind}, node long, n long, {fields}, packed binary"))
    return components(prints.select("doc_id", "node"), _similar_nodes(prints, size, similar, crowd), "node").select("doc_id", "component_id")


def one_of_each(docs: DataFrame, size: int = 5, similar: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one document, that of smallest doc_id, of each group that ``similar_documents`` links.

    Rows that repeat a doc_id are one document and stay or go together; rows without a
    doc_id stay.
    """
    with scratch(docs.sparkSession):
        found = similar_documents(docs, size, similar, id_col=id_col, text_col=text_col)
        gone = cut(found.filter("component_id < doc_id").select(F.col("doc_id").alias(id_col)).distinct(), stay=True)
    return docs.join(gone, id_col, "left_anti")
