"""similar_documents against the exact similarity of all pairs, around the threshold."""

import random

import numpy as np
import pytest

from corpusmill.llm import components, simhash


def shingles(text):
    w = text.split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def alike(a, b):
    a, b = shingles(a), shingles(b)
    return len(a & b) / len(a | b)


def pairs(low, high, n, seed):
    """``n`` pairs of texts with a similarity from ``low`` to below ``high``, by edits far apart."""
    rnd = random.Random(seed)
    out = []
    while len(out) < n:
        base = [f"w{rnd.randrange(10**9)}" for _ in range(rnd.randint(120, 400))]
        near = list(base)
        for k in rnd.sample(range(len(base)), rnd.randint(2, 16)):
            near[k] = f"x{rnd.randrange(10**9)}"
        one, two = " ".join(base), " ".join(near)
        if low <= alike(one, two) < high:
            out.append((one, two))
    return out


def groups(spark, texts, **how):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r.doc_id: r.component_id for r in simhash.similar_documents(docs, **how).collect()}


@pytest.mark.parametrize("rows", [16, 24])
def test_recall_is_the_stated_one_at_any_number_of_documents(spark, monkeypatch, rows):
    """Keys and tables as for 2 ** rows documents: pairs just above the threshold, and nearer ones."""
    shape = simhash.plan(1 << rows)
    assert simhash.recall(*shape, simhash.share(0.8)) >= simhash.RECALL
    monkeypatch.setattr(simhash, "plan", lambda *_: shape)
    for low, high, lost in ((0.8, 0.82, 9), (0.85, 0.87, 2), (0.9, 0.92, 0)):
        found = groups(spark, [t for p in pairs(low, high, 300, 1) for t in p])
        assert sum(found[2 * k + 1] != 2 * k for k in range(300)) <= lost


def test_no_pair_below_the_threshold_is_joined(spark):
    found = groups(spark, [t for p in pairs(0.7, 0.8, 300, 2) for t in p])
    assert [d for d, c in found.items() if c != d] == []


@pytest.mark.parametrize(("crowd", "hub"), [(1 << 19, 1024), (6, 2)])
def test_groups_of_copies_and_of_one_template(spark, crowd, hub, monkeypatch):
    """Copies of one text that are alike only to it, and texts that share six tenths with each other; also in parts."""
    monkeypatch.setattr(simhash, "HUB", hub)
    rnd = random.Random(3)
    word = lambda: f"v{rnd.randrange(10**9)}"
    base, template = [word() for _ in range(200)], [word() for _ in range(200)]
    texts = []
    for _ in range(40):
        near = list(base)
        for k in rnd.sample(range(0, 200, 6), 3):
            near[k] = word()
        texts.append(" ".join(near))
        texts.append(" ".join(template + [word() for _ in range(60)]))
    texts.insert(11, " ".join(base))
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if alike(texts[i], texts[j]) >= 0.8:
                a, b = root[i], root[j]
                root = [min(a, b) if r in (a, b) else r for r in root]
    assert groups(spark, texts, crowd=crowd) == dict(enumerate(root)) and len(set(root)) == 41


def words(rnd, n):
    return [f"w{rnd.randrange(10**9)}" for _ in range(n)]


def test_short_texts_inside_one_a_word_longer_are_all_joined(spark):
    """Sets of 4 to 9 shingles inside those of one more, which sketches alone miss for 4 in 5."""
    rnd, texts = random.Random(5), []
    for k in range(1200):
        long = words(rnd, 9 + k % 6)
        texts += [" ".join(long), " ".join(long[1:] if k % 2 else long[:-1])]
    assert all(alike(*texts[k : k + 2]) >= 0.8 for k in range(0, len(texts), 2))
    found = groups(spark, texts)
    apart = [k for k in range(0, len(texts), 2) if found[k + 1] != k]
    assert [k for k in apart if len(shingles(texts[k])) <= simhash.SMALL] == [] and len(apart) <= 12
    assert {c for d, c in found.items() if d % 2 == 0} == set(range(0, len(texts), 2))


def test_many_short_texts_around_one(spark):
    """One text of eight words with 3,000 that have one more; as many without that text; and twelve words shared, where each is alike to each."""
    rnd = random.Random(6)
    eight, lone, twelve = words(rnd, 8), words(rnd, 8), words(rnd, 12)
    many = lambda start: [" ".join([*start, f"e{k}"]) for k in range(3000)]
    found = groups(spark, [" ".join(eight), *many(eight), *many(lone), *many(twelve)])
    assert {found[k] for k in range(3001)} == {0}
    assert all(found[k] == k for k in range(3001, 6001))
    assert {found[k] for k in range(6001, 9001)} == {6001}


def test_sets_of_few_shingles_against_all_pairs(spark):
    """Parts of a few texts of repeating words, empty ones and nulls too: the groups of exact similarity, and never a link below it."""
    rnd, texts = random.Random(7), ["", " ", "one", "one"]
    for _ in range(40):
        base = [rnd.choice("abcdefgh") for _ in range(13)]
        for _ in range(8):
            a = rnd.randrange(6)
            texts.append(" ".join(base[a : a + rnd.randint(5, 13)]))
    root = list(range(len(texts)))

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            same = not texts[i].split() and not texts[j].split() or bool(texts[i].split()) and bool(texts[j].split()) and alike(texts[i], texts[j]) >= 0.8 - 1e-12
            if same and top(i) != top(j):
                root[max(top(i), top(j))] = min(top(i), top(j))
    assert groups(spark, texts) == {k: top(k) for k in range(len(texts))}


def roots(n, linked):
    root = list(range(n))
    for i in range(n):
        for j in range(i):
            if root[i] != root[j] and linked(i, j):
                a, b = sorted((root[i], root[j]))
                root = [a if r == b else r for r in root]
    return root


def test_texts_that_resemble_each_other_list_no_pairs(spark, monkeypatch):
    """Eight hundred texts that differ from one, which is not there, by some words each: no table has rows by the square."""
    rnd, written = random.Random(8), []
    base = words(rnd, 150)
    texts = []
    for _ in range(800):
        near = list(base)
        for k in rnd.sample(range(150), rnd.choice([1, 2, 3, 3, 3, 4])):
            near[k] = f"x{rnd.randrange(10**9)}"
        texts.append(" ".join(near))
    for module in (simhash, components):
        cut = module.cut
        monkeypatch.setattr(module, "cut", lambda *a, cut=cut, **k: (written.append(cut(*a, **k)), written[-1])[1])
    found = groups(spark, texts)
    sets = [shingles(t) for t in texts]
    common = lambda i, j: len(sets[i] & sets[j])
    want = roots(800, lambda i, j: common(i, j) * 1.8 >= 0.8 * (len(sets[i]) + len(sets[j])) - 1e-9)
    assert 50 < len(set(want)) < 750
    assert found == dict(enumerate(want))
    assert max(t.count() for t in written) < 60 * len(texts)


@pytest.mark.parametrize("wide", [256, 1 << 14])
def test_links_of_sets_in_one_group_are_those_of_all_pairs(monkeypatch, wide):
    """Sets of any size about the threshold, with parity maps that are wide and that are too narrow to tell."""
    monkeypatch.setattr(simhash, "MAP", wide)
    rng, sets = np.random.default_rng(9), []
    for size in (1, 2, 4, 5, 9, 10, 40, 150, 1500):
        base = rng.integers(0, 1 << 63, size, dtype=np.uint64)
        for _ in range(40):
            kept = base[rng.random(size) >= rng.choice([0, 0.05, 0.1, 0.2])]
            sets.append(np.unique(np.concatenate([kept, rng.integers(0, 1 << 63, rng.integers(0, 2 + size // 8), dtype=np.uint64)])))
    sets = sorted((s for s in sets if len(s)), key=len)
    first = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
    own = [set(s.tolist()) for s in sets]
    want = roots(len(own), lambda i, j: len(own[i] & own[j]) * 1.8 >= 0.8 * (len(own[i]) + len(own[j])) - 1e-9)
    assert simhash._linked(np.concatenate(sets), first, 0.8).tolist() == want
    assert 10 < len(set(want)) < len(want) - 50
