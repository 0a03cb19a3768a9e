import random
import re

from corpusmill.llm import substring_dedup


def brute(rows, size):
    words = {d: re.findall(r"[^\x20\x09-\x0D]+", t or "") for d, t in rows}
    least = {}
    for d, w in words.items():
        for i in range(len(w) - size + 1):
            k = tuple(w[i : i + size])
            least[k] = min(d, least.get(k, d))
    out = {}
    for d, w in words.items():
        gone = {i + j for i in range(len(w) - size + 1) if least[tuple(w[i : i + size])] < d for j in range(size)}
        out[d] = (len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone))
    return out


def make():
    rnd = random.Random(5)
    words = ["".join(rnd.choices("abéß", k=rnd.randint(1, 3))) for _ in range(60)]
    passage = rnd.choices(words, k=30)
    rows = []
    for i in range(120):
        w = rnd.choices(words[:12], k=rnd.randint(0, 60))
        if rnd.random() < 0.5:
            at = rnd.randint(0, len(w))
            w[at:at] = passage[: rnd.choice([5, 13, 20, 30])]
        rows.append((rnd.randint(0, 10) * 1000 + i, rnd.choice([" ", "\n", " \t\x0b"]).join(w)))
    return [*rows, (-5, rows[3][1]), (1 << 60, rows[3][1]), (77777, None), (77778, ""), (77779, " \x0c"), (77780, "a b " * 60_000), (77781, "b " + "a b " * 30_000)]


def test_against_brute_force(spark):
    rows = make()
    for size, calm in ((13, 1 << 16), (5, 1 << 16), (5, 3)):
        docs = spark.createDataFrame([(*r, 9, "x") for r in rows], "doc_id long, text string, n_words int, _runs string")
        got = {r.doc_id: (r.n_words, r.n_removed, r.kept_text) for r in substring_dedup.remove_repeats(docs, size, calm=calm).collect()}
        assert got == brute(rows, size)


def test_nulls_and_repeated_rows(spark):
    text = " ".join(map(str, range(40)))
    rows = [(1, text), (1, text), (None, text), (None, None), (2, "0 1 2 " + text)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.n_words, r.n_removed, r.kept_text) for r in substring_dedup.remove_repeats(docs).collect())
    assert got == [(0, 0, 0, ""), (0, 40, 0, text), (1, 40, 0, text), (1, 40, 0, text), (2, 43, 40, "0 1 2")]


def test_empty(spark):
    assert substring_dedup.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_windows_of_one_hash_are_told_apart(spark, monkeypatch):
    import numpy as np
    import struct

    monkeypatch.setattr(substring_dedup, "rolling", lambda values, base, first, last: np.zeros(len(first), np.uint64))
    body = b"a b c\nd e f\na b c\nd e f"
    raw = struct.pack("<q", 4) + np.diff(np.array([1, 2, 3, 4]), prepend=0).tobytes() + np.zeros(4, np.int32).tobytes() + body
    import pyarrow as pa
    import zstandard

    batch = pa.RecordBatch.from_arrays([pa.array([0]), pa.array([zstandard.ZstdCompressor().compress(raw)])], ["slot", "blob"])
    got = [r for b in substring_dedup._repeats(3)(iter([batch])) for r in b.to_pylist()]
    assert got == [{"doc_id": 3, "pos": 0, "n": 1}, {"doc_id": 4, "pos": 0, "n": 1}]
