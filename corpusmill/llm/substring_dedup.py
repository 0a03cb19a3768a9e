"""Removal of passages that repeat across documents, by super-k-mer partitioning.

A window is ``size`` consecutive words. Its minimiser is the first of its words in a fixed
order: long words first, which are seldom frequent, then by hash. Consecutive windows that share a minimiser travel as one packed string to the slot
that the minimiser names, so a text is sent about three times, not ``size`` times. In a slot
windows are sorted by a hash of their words; neighbours of equal hash are compared as
strings, so windows are counted exactly, and each knows the smallest document it starts in.

One flush of a map task sends one compressed row for each slot. Slots take whole groups of
minimisers and are many times the partitions; a partition's slots come in order and are
worked on one after the other in bounded memory: there are so many that a slot has about
``LOAD`` bytes of text, whatever the corpus's size. What a hot minimiser would put into one
slot is measured first: slots with over four times the mean load (thus under a quarter of
all slots) are set apart. Their strings are made distinct by a grouped minimum, which
combines before its shuffle, and only distinct strings are taken apart into windows.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.shared import cut, partitions
from corpusmill.llm.words import PIECE, Words, _K, mix, pieces, rolling, tidy

#: Bytes of packed strings after which a map task sends what it has, and after which a slot reader works on whole slots.
FLUSH, WORK = 28 << 20, 1 << 20
#: Slots for each shuffle partition at least; loads of this many windows never make a slot hot.
SLOTS, CALM = 32, 1 << 16
#: Bytes of text for each slot.
LOAD = 4 << 20
CHUNK, RUN = 4096, 64


def minimisers(words: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """First words of all windows, and the minimiser of each."""
    at = np.arange(len(words))
    at = at[at + size <= words.last()]
    if not len(at):
        return at, np.zeros(0, np.uint64)
    short = np.maximum(15 - (words.ends - words.starts), 0).astype(np.uint64)
    low = words.hashes() >> np.uint64(4) | short << np.uint64(60)
    have = 1  # a doubling minimum over the words of a window
    while have * 2 <= size:
        low = np.minimum(low[:-have], low[have:])
        have *= 2
    if have < size:
        low = np.minimum(low[: len(low) - (size - have)], low[size - have :])
    return at, low[at]


def slot_of(low: np.ndarray, slots: int) -> np.ndarray:
    return (mix(low.copy()) % np.uint64(slots)).astype(np.int64)


def super_kmers(at: np.ndarray, low: np.ndarray, slots: int, hot: np.ndarray, want: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First and last window of each run that shares a minimiser, and its slot; runs of hot slots or, not ``want``, of others.

    Where words repeat a run can be as long as its text; it is cut after ``RUN`` windows.
    """
    new = np.append(True, (at[1:] != at[:-1] + 1) | (low[1:] != low[:-1]))[: len(at)]
    start = np.flatnonzero(new)
    if len(start) and np.diff(np.append(start, len(at))).max() > RUN:
        new |= (np.arange(len(at)) - start[np.cumsum(new) - 1]) % RUN == 0
        start = np.flatnonzero(new)
    end = np.append(start[1:], len(at)) - 1 if len(at) else start
    slot = slot_of(low[start], slots)
    kept = np.isin(slot, hot) == want
    return at[start[kept]], at[end[kept]], slot[kept]


def _loads(size: int, slots: int):
    def run(batches):
        total = np.zeros(slots, np.int64)
        for batch in batches:
            for piece in pieces(batch, "text"):
                _, low = minimisers(Words.of(piece.column("text")), size)
                total += np.bincount(slot_of(low, slots), minlength=slots)
        for at in range(0, slots, CHUNK):
            if total[at : at + CHUNK].any():
                packed = zstandard.compress(total[at : at + CHUNK].tobytes(), 1)
                yield pa.RecordBatch.from_arrays([pa.array([at // CHUNK]), pa.array([packed])], ["chunk", "loads"])

    return tidy(run)


def _add_loads(batches):
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for chunk, loads in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            now = np.frombuffer(zstandard.decompress(loads), np.int64)
            total[chunk] = total[chunk] + now if chunk in total else now
    for chunk, loads in total.items():
        at = np.flatnonzero(loads)
        yield pa.RecordBatch.from_arrays([pa.array(chunk * CHUNK + at), pa.array(loads[at])], ["slot", "windows"])


def hot_slots(docs: DataFrame, size: int, slots: int, calm: int = CALM) -> np.ndarray:
    """Slots with over four times the mean load, which less than a quarter of all slots can have."""
    n = partitions(docs.sparkSession)
    chunks = docs.select("text").mapInArrow(_loads(size, slots), "chunk long, loads binary").repartition(min(n, -(-slots // CHUNK)), "chunk")
    loads = cut(chunks.mapInArrow(_add_loads, "slot long, windows long"))
    mean = (loads.agg(F.sum("windows")).first()[0] or 0) / slots
    return np.array([r.slot for r in loads.filter(F.col("windows") > max(calm, 4 * mean)).collect()], np.int64)


def _packer(size: int, slots: int, hot: np.ndarray):
    """Documents to (slot, blob) rows: blob holds the documents, first words and strings of its super-k-mers."""

    def send(have: list) -> Iterator[pa.RecordBatch]:
        slot = np.concatenate([x[0] for x in have])
        doc, pos = (np.concatenate([x[k] for x in have]) for k in (1, 2))
        strings = [s for x in have for s in x[3]]
        order = np.argsort(slot, kind="stable")
        edge = np.flatnonzero(np.append(True, slot[order][1:] != slot[order][:-1]))
        pack = zstandard.ZstdCompressor(level=3).compress
        where, blobs = [], []
        for a, b in zip(edge, [*edge[1:], len(order)], strict=True):
            some = order[a:b]
            body = b"\n".join([strings[k] for k in some.tolist()])
            head = struct.pack("<q", len(some)) + np.diff(doc[some], prepend=0).tobytes() + pos[some].astype(np.int32).tobytes()
            where.append(int(slot[some[0]]))
            blobs.append(pack(head + body))
        for a in range(0, len(blobs), 1024):
            yield pa.RecordBatch.from_arrays([pa.array(where[a : a + 1024], pa.int64()), pa.array(blobs[a : a + 1024], pa.binary())], ["slot", "blob"])

    def run(batches):
        have, held = [], 0
        for batch in batches:
            for piece in pieces(batch.filter(batch.column("doc_id").is_valid()), "text"):
                words = Words.of(piece.column("text")).spaced()
                start, end, slot = super_kmers(*minimisers(words, size), slots, hot, False)
                if not len(start):
                    continue
                row = np.searchsorted(words.first, start, "right") - 1
                data = words.data.tobytes()
                spans = zip(words.starts[start].tolist(), words.ends[end + size - 1].tolist(), strict=True)
                strings = [data[a:b] for a, b in spans]
                have.append((slot, piece.column("doc_id").to_numpy()[row], start - words.first[row], strings))
                held += sum(map(len, strings))
                if held >= FLUSH:
                    yield from send(have)
                    have, held = [], 0
        if have:
            yield from send(have)

    return tidy(run)


def _hot_strings(size: int, slots: int, hot: np.ndarray):
    def run(batches):
        for batch in batches:
            for piece in pieces(batch.filter(batch.column("doc_id").is_valid()), "text"):
                words = Words.of(piece.column("text")).spaced()
                start, end, _ = super_kmers(*minimisers(words, size), slots, hot, True)
                row = np.searchsorted(words.first, start, "right") - 1
                data = words.data.tobytes()
                strings = [data[a:b] for a, b in zip(words.starts[start].tolist(), words.ends[end + size - 1].tolist(), strict=True)]
                cols = [pa.array(strings, pa.binary()).cast(pa.string()), pa.array(piece.column("doc_id").to_numpy()[row]), pa.array(start - words.first[row])]
                yield pa.RecordBatch.from_arrays(cols, ["packed", "doc_id", "pos"])

    return tidy(run)


def hot_repeats(docs: DataFrame, size: int, slots: int, hot: np.ndarray) -> DataFrame:
    """Runs as below, of the windows of hot slots.

    Equal strings are one row before their windows are taken apart, so what many documents
    share is small, and what differs is spread by the windows' words.
    """
    strings = docs.mapInArrow(_hot_strings(size, slots, hot), "packed string, doc_id long, pos long")
    windows = (
        strings.groupBy("packed").agg(F.min("doc_id").alias("least"))
        .withColumn("_w", F.split("packed", " "))
        .select("packed", "least", F.posexplode(F.transform(F.sequence(F.lit(1), F.size("_w") - (size - 1)), lambda i: F.array_join(F.slice("_w", i, size), " "))).alias("i", "window"))
    )
    # tables of their own, so that each join is one of two shuffled tables and a window or string of very many rows can be split
    windows = cut(windows)
    least = cut(windows.groupBy("window").agg(F.min("least").alias("first")))
    firsts = cut(windows.join(least, "window").groupBy("packed").agg(F.array_sort(F.collect_list(F.struct("i", "first"))).alias("firsts")))
    found = strings.join(firsts, "packed").withColumn("gone", F.filter("firsts", lambda x: x["first"] < F.col("doc_id")))
    whole = F.array(F.struct(F.lit(0).alias("i"), F.size("gone").alias("n")))
    single = F.transform("gone", lambda x: F.struct(x["i"].alias("i"), F.lit(1).alias("n")))
    runs = F.explode(F.when(F.size("gone") == F.size("firsts"), whole).otherwise(single)).alias("run")
    return found.filter(F.size("gone") > 0).select("doc_id", "pos", runs).select("doc_id", (F.col("pos") + F.col("run.i")).alias("pos"), F.col("run.n").cast("long").alias("n"))


def _repeats(size: int):
    """Whole slots of (slot, blob) rows to runs (doc_id, pos, n) of windows that start in a smaller document too."""

    def work(have: list[bytes]) -> Iterator[pa.RecordBatch]:
        docs, poss, bodies = [], [], []
        for raw in have:
            n = struct.unpack_from("<q", raw)[0]
            docs.append(np.cumsum(np.frombuffer(raw, np.int64, n, 8)))
            poss.append(np.frombuffer(raw, np.int32, n, 8 + 8 * n))
            bodies.append(raw[8 + 12 * n :])
        doc, pos, text = np.concatenate(docs), np.concatenate(poss).astype(np.int64), b"\n".join(bodies)
        data = np.frombuffer(text, np.uint8)
        words = Words(data, np.concatenate([[0], np.flatnonzero(data == 10) + 1, [len(data)]]))
        at = np.arange(len(words))
        at = at[at + size <= words.last()]
        h = rolling(words.hashes(), _K, at, at + size)
        order = np.argsort(h, kind="stable")
        same = h[order][1:] == h[order][:-1]
        keep = np.append(same, False) | np.append(False, same)
        order, same = order[keep], (h[order[keep]][1:] == h[order[keep]][:-1])
        if not len(order):
            return
        a, b = words.starts[at[order]].tolist(), words.ends[at[order] + size - 1].tolist()
        strings = [text[x:y] for x, y in zip(a, b, strict=True)]
        told = np.fromiter((x == y for x, y in zip(strings, strings[1:], strict=False)), bool, len(strings) - 1)
        first = np.flatnonzero(np.append(True, ~same))
        group = np.cumsum(np.append(True, ~same)) - 1
        if (same & ~told).any():  # different words of one hash: such groups are parted by their strings
            number: dict = {}
            group = np.array([number.setdefault((g, s), len(number)) for g, s in zip(group.tolist(), strings, strict=True)])
            by = np.argsort(group, kind="stable")
            order, group = order[by], group[by]
            first = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
        run = np.searchsorted(words.first, at[order], "right") - 1
        mine = doc[run]
        gone = mine > np.minimum.reduceat(mine, first)[group]
        mine, place = mine[gone], (pos[run] + at[order] - words.first[run])[gone]
        if not len(mine):
            return
        by = np.lexsort((place, mine))
        mine, place = mine[by], place[by]
        new = np.append(True, (mine[1:] != mine[:-1]) | (place[1:] > place[:-1] + 1))
        start = np.flatnonzero(new)
        last = np.append(start[1:], len(mine)) - 1
        yield pa.RecordBatch.from_arrays([pa.array(mine[start]), pa.array(place[start]), pa.array(place[last] - place[start] + 1)], ["doc_id", "pos", "n"])

    def run(batches):
        have, held, slot = [], 0, None
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            for now, blob in zip(batch.column("slot").to_pylist(), batch.column("blob"), strict=True):
                if now != slot and held >= WORK:
                    yield from work(have)
                    have, held = [], 0
                slot = now
                have.append(unpack(blob.as_buffer()))
                held += len(have[-1])
        if have:
            yield from work(have)

    return tidy(run)


def repeated_windows(docs: DataFrame, size: int, calm: int = CALM) -> DataFrame:
    """Runs (doc_id, pos, n) of windows, first words pos to pos + n - 1, whose words also start a window of a smaller doc_id."""
    n = partitions(docs.sparkSession)
    docs = docs.select("doc_id", "text")
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    slots = max(SLOTS * n, -(-total // LOAD))
    hot = hot_slots(docs, size, slots, calm)
    blobs = docs.mapInArrow(_packer(size, slots, hot), "slot long, blob binary")
    runs = blobs.repartition(n, "slot").sortWithinPartitions("slot").mapInArrow(_repeats(size), "doc_id long, pos long, n long")
    if not len(hot):
        return runs
    return runs.union(hot_repeats(docs, size, slots, hot))


def _packed(names: list[str]):
    """The text column compressed, for a shuffle of whole texts; nulls are empty."""

    def run(batches):
        pack = zstandard.ZstdCompressor(level=3).compress
        for batch in batches:
            for piece in pieces(batch, "text"):
                texts = pa.array([pack((t or "").encode()) for t in piece.column("text").to_pylist()], pa.binary())
                yield pa.RecordBatch.from_arrays([texts if c == "text" else piece.column(c) for c in names], names)

    return tidy(run)


def _keeper(size: int, names: list[str]):
    def run(batches):
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            for piece in pieces(batch, "text", PIECE // 3):
                texts = pa.array([unpack(t.as_buffer()) for t in piece.column("text")], pa.binary())
                words = Words.of(texts).spaced()
                runs = piece.column("_runs").combine_chunks() if isinstance(piece.column("_runs"), pa.ChunkedArray) else piece.column("_runs")
                row = runs.value_parent_indices().to_numpy() if hasattr(runs, "value_parent_indices") else np.asarray(pa.compute.list_parent_indices(runs))
                flat = runs.flatten()
                pos, n = (flat.field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in (0, 1))
                step = np.zeros(len(words) + 1, np.int64)
                # rows of one doc_id with different texts share runs: what lies past a text's end is left out
                a = np.minimum(words.first[row] + pos, words.first[row + 1])
                np.add.at(step, a, 1)
                np.add.at(step, np.minimum(a + n + size - 1, words.first[row + 1]), -1)
                gone = np.cumsum(step)[: len(words)] > 0
                removed = np.diff(np.concatenate([[0], np.cumsum(gone)])[words.first])
                data = words.data.tobytes()
                kept = []
                for r in range(piece.num_rows):
                    a, b = int(words.first[r]), int(words.first[r + 1])
                    if not removed[r]:
                        kept.append(data[words.starts[a] : words.ends[b - 1]] if b > a else b"")
                    else:
                        some = np.flatnonzero(~gone[a:b]) + a
                        kept.append(b" ".join([data[x:y] for x, y in zip(words.starts[some].tolist(), words.ends[some].tolist(), strict=True)]))
                made = {"n_words": pa.array(words.counts, pa.int64()), "n_removed": pa.array(removed, pa.int64()), "kept_text": pa.array(kept, pa.binary()).cast(pa.string())}
                yield pa.RecordBatch.from_arrays([made[c] if c in made else piece.column(c) for c in names], names)

    return tidy(run)


def remove_repeats(docs: DataFrame, size: int = 13, id_col: str = "doc_id", text_col: str = "text", calm: int = CALM) -> DataFrame:
    """``docs`` with n_words, n_removed and, for its text, kept_text: words in windows that also start in a smaller document go.

    Windows are judged on the texts as they come, so what is removed does not depend on an
    order of work; a document's own repeats stay. kept_text has one space between words.
    Null texts are empty. Rows of a null doc_id keep all and remove nothing elsewhere.
    Rows that share a doc_id are one document: what is removed at a word's place is removed
    in each of them. Texts count whole, however long; a doc_id that is no whole number is an
    error. Other columns stay; three of the names above would be replaced.
    An empty table gives an empty result.
    """
    if docs.schema[id_col].dataType.typeName() not in ("byte", "short", "integer", "long"):
        raise TypeError(f"{id_col} must be a whole number, as the smallest of a group counts")
    spare = [c for c in docs.columns if c not in (id_col, text_col, "n_words", "n_removed", "kept_text")]
    given = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), *[F.col(f"`{c}`").alias(f"_x{k}") for k, c in enumerate(spare)])
    runs = repeated_windows(given, size, calm).groupBy("doc_id").agg(F.collect_list(F.struct("pos", "n")).alias("_runs"))
    fields = [f for f in given.schema.fields if f.name != "text"]
    others = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in fields)
    packed = given.mapInArrow(_packed([f.name for f in fields] + ["text"]), f"{others}, text binary")
    names = [f.name for f in fields] + ["n_words", "n_removed", "kept_text"]
    # rows without a doc_id have no runs; a second key keeps them from meeting in one task
    spread = F.when(F.col("doc_id").isNull(), F.pmod(F.xxhash64("text"), F.lit(1 << 16))).otherwise(F.lit(0).cast("long"))
    made = packed.withColumn("_salt", spread).join(runs.withColumn("_salt", F.lit(0).cast("long")), ["doc_id", "_salt"], "left").drop("_salt").mapInArrow(_keeper(size, names), f"{others}, n_words long, n_removed long, kept_text string")
    return made.select(F.col("doc_id").alias(id_col), *[F.col(f"_x{k}").alias(c) for k, c in enumerate(spare)], "n_words", "n_removed", "kept_text")
