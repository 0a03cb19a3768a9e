import random
import re

import numpy as np
import xxhash

from corpusmill.llm import simhash

SCHEMA = "doc_id long, text string, doc_count int"


def brute_fingerprint(text, size=3):
    words = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    runs = [b" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(r, seed=42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints, budget=3):
    root = list(range(len(prints)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i][1] ^ prints[j][1]).bit_count() <= budget:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    least = {}
    for i, (doc, _) in enumerate(prints):
        if doc is not None:
            least[find(i)] = min(doc, least.get(find(i), doc))
    return [least.get(find(i)) for i in range(len(prints))]


def texts():
    rnd = random.Random(7)
    words = ["".join(rnd.choices("abcdeÉß", k=rnd.randint(1, 6))) for _ in range(300)]
    out = []
    for _ in range(40):
        base = rnd.choices(words, k=rnd.choice([1, 2, 3, 10, 200, 900]))
        out.append(" ".join(base))
        for _ in range(rnd.randint(0, 4)):
            near = list(base)
            for _ in range(rnd.randint(0, 2)):
                near[rnd.randrange(len(near))] = rnd.choice(words)
            out.append(rnd.choice(["\n", "  ", "\t"]).join(near).upper() if rnd.random() < 0.3 else " ".join(near))
    return [*out, None, "", "   ", "\x0b\x0c", "One", "one ", "x" * 300_000, " ".join(["a", "b", "c"] * 30_000)]


def test_against_brute_force(spark):
    rows = [(i, t, 1) for i, t in enumerate(texts())] + [(3, texts()[3], 2), (None, texts()[3], 3), (None, "alone among nulls here", 4)]
    prints = [(d, brute_fingerprint(t)) for d, t, _ in rows]
    want = sorted((d if d is not None else -1, f"{f:016x}", c) for (d, f), c in zip(prints, brute_components(prints), strict=True))
    docs = spark.createDataFrame(rows, SCHEMA)
    for crowd in (1 << 19, 2):
        got = simhash.near_duplicates(docs, crowd=crowd).collect()
        assert sorted((r.doc_id if r.doc_id is not None else -1, r.fingerprint, r.component_id) for r in got) == want


def test_empty(spark):
    assert simhash.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


def test_trie_pairs_are_all_pairs_within_the_budget():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 63, 300, dtype=np.uint64)
    flips = [base ^ np.uint64(1) << rng.integers(0, 64, 300).astype(np.uint64) for _ in range(3)]
    keys = np.sort(np.concatenate([base, *flips, base[:50]]))
    one, n = np.zeros(1, np.int64), np.array([len(keys)])
    for budget in (0, 1, 3):
        got = sorted(p for i, j in simhash.trie_pairs(keys, (one, n, one, n, one), 64, budget) for p in zip(i.tolist(), j.tolist(), strict=True))
        want = [(i, j) for i in range(len(keys)) for j in range(i + 1, len(keys)) if int(keys[i] ^ keys[j]).bit_count() <= budget]
        assert got == want


def test_components_of_a_long_chain_and_a_star(spark):
    from corpusmill.llm.components import connected_components

    edges = [(i, i + 1) for i in range(100, 160)] + [(900, k) for k in range(200, 300)] + [(5, 5), (None, 7)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 100 for i in range(100, 161)}, **{i: 200 for i in [*range(200, 300), 900]}}
