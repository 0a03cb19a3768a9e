import random
import re
from collections import Counter

from corpusmill.llm import decontaminate


def runs(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return [tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))] if w else []


def brute(docs, items):
    out = {}
    for d, t in docs:
        h = runs(t)
        for k, i in items:
            g = runs(i)
            for a in range(len(h) - len(g) + 1) if g else ():
                both = sum((Counter(h[a : a + len(g)]) & Counter(g)).values())
                s = both / (2 * len(g) - both)
                if s >= 0.8 and s > out.get((d, k), (0, 0))[1]:
                    out[d, k] = (a, s)
    return {(*k, a, round(s, 9)) for k, (a, s) in out.items()}


def test_against_brute_force(spark, monkeypatch):
    rnd = random.Random(11)
    word = lambda: "".join(rnd.choices("abcdeÉ", k=rnd.randint(1, 5)))
    items = [(k, " ".join(word() for _ in range(rnd.choice([3, 5, 12, 40, 80])))) for k in range(30)]
    items += [(30, None), (31, ""), (32, "a a a a a a a a a"), (33, items[0][1])]
    docs = []
    for d in range(150):
        w = [word() for _ in range(rnd.randint(0, 120))]
        if rnd.random() < 0.7:
            leak = rnd.choice(items)[1] or "x"
            leak = leak.split()
            for _ in range(rnd.choice([0, 0, 1, 2])):
                k = rnd.randrange(len(leak or "x"))
                leak[k : k + 1] = rnd.choice([[], [word()], [*leak[k : k + 1], word()]])
            at = rnd.choice([0, len(w), rnd.randint(0, len(w))])
            w[at:at] = leak
        docs.append((d, rnd.choice([" ", "\n\t"]).join(w).title()))
    docs += [(900, None), (901, ""), (902, "a " * 50_000), (903, items[0][1] or ""), (903, items[0][1])]
    given = spark.createDataFrame([(*x, "e") for x in docs], "doc_id long, text string, item_id string")
    for most in (2000, 7):
        monkeypatch.setattr(decontaminate, "ITEMS", most)
        got = decontaminate.matches(given, spark.createDataFrame(items, "item_id long, text string")).collect()
        assert {(r.doc_id, r.item_id, r.first_word, round(r.similarity, 9)) for r in got} == brute(docs, items)
        kept = decontaminate.without_benchmark(given, spark.createDataFrame(items, "item_id long, text string"))
        assert kept.columns == given.columns
        assert {r.doc_id for r in kept.collect()} == {d for d, _ in docs} - {r.doc_id for r in got}


def test_lookup_finds_all_items_within_the_radius():
    rnd = random.Random(4)
    texts = [" ".join(rnd.choices("abcdefg", k=9)) for _ in range(60)]
    radius = 52
    items = decontaminate.Items(texts, 0.8, radius)
    who, prints, _ = items.sizes[5]
    near = {(i, j) for i, p in enumerate(prints) for j, o in enumerate(prints) if sum(int(a ^ b).bit_count() for a, b in zip(p, o, strict=True)) <= radius}
    w, k, _ = items.lookup(5, prints)
    assert set(zip(w.tolist(), k.tolist(), strict=True)) == near and len(near) > 60


def test_empty(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    some = spark.createDataFrame([(1, "a b c d e f")], "item_id long, text string")
    assert decontaminate.matches(none, some).count() == 0
    assert decontaminate.matches(some.withColumnRenamed("item_id", "doc_id"), some.limit(0)).count() == 0


def test_documents_shorter_than_the_item(spark):
    """An item shortened by some words, as the whole text: the text is the window."""
    words = [f"w{k}" for k in range(30)]
    docs = [(n, " ".join(words[: 30 - n])) for n in range(9)] + [(20 + n, " ".join(words[n:])) for n in range(9)] + [(40, " ".join(words[:14] + words[15:])), (41, " ".join(words[:10]))]
    docs += [(50, "a " * 20), (51, "a " * 29), (52, "w3 " * 25), (53, "")]
    items = [(7, " ".join(words)), (8, "a " * 30)]
    want = {}
    for d, t in docs:
        for k, i in items:
            h, g = Counter(runs(t)), Counter(runs(i))
            both = sum((h & g).values())
            s = both / (sum(h.values()) + sum(g.values()) - both)
            if s >= 0.8:
                want[d, k] = (0, round(s, 9))
    assert {1, 5, 25, 51} <= {d for d, _ in want} and not {6, 40, 41, 50} & {d for d, _ in want}
    given, of = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert {(r.doc_id, r.item_id): (r.first_word, round(r.similarity, 9)) for r in decontaminate.matches(given, of).collect()} == want
    assert {r.doc_id for r in decontaminate.without_benchmark(given, of).collect()} == {d for d, _ in docs} - {d for d, _ in want}
