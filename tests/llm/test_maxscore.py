import math
import random
import re
from collections import Counter

import pyarrow as pa

from corpusmill.llm import maxscore

DOCS, ITEMS = "doc_id long, text string, n string, terms string", "item_id long, text string, rank string"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (t or "").translate(LOWER))


def brute(docs, items, k):
    held = [(i, Counter(terms(t))) for i, t in docs if terms(t)]
    total, every = len(held), sum(c.total() for _, c in held)
    df = Counter(t for _, c in held for t in c)
    asked = {}
    for i, t in items:
        if t is not None:
            asked[i] = min(t, asked.get(i, t))
    out = []
    for i, text in asked.items():
        found = []
        for d, c in held:
            m = 25 + (75 * c.total() * total) // every
            s = sum(math.floor(1000 * math.log((2 * total + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m)) for t in terms(text) if t in c)
            if s > 0:
                found.append((-s, d is None, d))
        out += [(i, r + 1, d, -s) for r, (s, _, d) in enumerate(sorted(found, key=lambda x: (x[0], x[1], x[2] or 0))[:k])]
    return out


def rows(seed, number):
    rnd = random.Random(seed)
    words = ["the", "of", "Straße", "É", "x1", "a", "Zz", "naïve"] + [f"w{i}" for i in range(60)]
    pick = lambda n: rnd.choice([" ", ", ", "-"]).join(rnd.choices(words, [60 // (i + 1) + 1 for i in range(len(words))], k=n))
    docs = [(i, pick(rnd.choice([1, 3, 10, 40, 200]))) for i in range(number)]
    docs += [(number + i, docs[5][1]) for i in range(40)] + [(None, docs[5][1]), (7, docs[5][1]), (7, docs[5][1]), (5000, None), (5001, ""), (5002, "?!"), (5003, "of " * 5000)]
    items = [(i, pick(rnd.randint(1, 12))) for i in range(25)] + [(30, None), (31, ""), (32, "unheard"), (33, "of of of THE"), (33, "zz top"), (None, "x1 a")]
    return docs, items


def ordered(found):
    return sorted(map(tuple, found), key=lambda r: str([(x is None, x) for x in r]))


def test_against_brute_force(spark, monkeypatch):
    docs, items = rows(1, 500)
    frame = spark.createDataFrame([(*r, "", "") for r in docs], DOCS).repartition(5)
    asked = spark.createDataFrame([(*r, "") for r in items], ITEMS)
    for block, part in ((1 << 22, 1 << 14), (60, 100)):  # blocks of a few queries; scores to start from
        monkeypatch.setattr(maxscore, "BLOCK", block)
        monkeypatch.setattr(maxscore, "SLICE", part)
        assert ordered(maxscore.rank_documents(frame, asked, 10).collect()) == ordered(brute(docs, items, 10))


def shard_rows(docs, texts):
    batch = pa.RecordBatch.from_arrays([pa.array([d for d, _ in docs], pa.int64()), pa.array([t for _, t in docs], pa.string())], ["doc_id", "text"])
    return list(maxscore._forward(texts)(iter([batch])))


def test_small_shards_and_strips(monkeypatch):
    """Lists become non-essential and documents are probed; nothing is lost, and less is looked at than all postings."""
    docs, items = rows(2, 3000)
    items = [x for x in items if x[1] and x[0] not in (33, None)]
    texts = [t for _, t in items]
    forward = shard_rows(docs, texts)
    known = maxscore._Vocabulary(texts)
    n = sum(b.num_rows for b in forward)
    total = sum(sum(b.column("n").to_pylist()) for b in forward)
    df = Counter(t for b in forward for ts in b.column("terms").to_pylist() for t in ts)
    weights = maxscore.np.array([math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) for t in range(known.size)])
    want = brute(docs, items, 10)
    seen, inner = [], maxscore._search_shard
    monkeypatch.setattr(maxscore, "_search_shard", lambda *a: seen.append(inner(*a)))
    for shard, strip in ((1 << 21, 1 << 7), (500, 16)):
        monkeypatch.setattr(maxscore, "SHARD", shard)
        monkeypatch.setattr(maxscore, "STRIP", strip)
        seen.clear()
        found = [r for b in maxscore._search(known.queries, weights, n, total, [0] * len(texts), 10)(iter(forward)) for r in zip(*b.to_pydict().values(), strict=True)]
        got = []
        for q, (i, _) in enumerate(items):
            best = sorted((-s, d is None, d or 0) for x, d, s in found if x == q)[:10]
            got += [(i, r + 1, None if null else d, -s) for r, (s, null, d) in enumerate(best)]
        assert ordered(got) == ordered(want)
        if shard == 1 << 21:
            assert sum(seen) < 0.8 * sum(df[t] for q, _ in known.queries for t in q.tolist())


def test_empty(spark):
    docs, items = spark.createDataFrame([], DOCS), spark.createDataFrame([], ITEMS)
    assert maxscore.rank_documents(docs, items).count() == 0
    assert maxscore.rank_documents(docs, spark.createDataFrame([(1, "a", "")], ITEMS)).count() == 0
    assert maxscore.rank_documents(spark.createDataFrame([(1, "a", "", "")], DOCS), items).count() == 0
