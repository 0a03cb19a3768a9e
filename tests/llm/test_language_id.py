import random

import numpy as np
from pyspark.sql import functions as F

from corpusmill.llm import language_id as L

SYLLABLES = {"aa": ["the", "ing", "er", "on"], "bb": ["ön", "sch", "ung", "ein"], "cc": ["que", "eau", "é", "ment"]}


def text(rnd, lang, n):
    return " ".join("".join(rnd.choices(SYLLABLES[lang], k=rnd.randint(1, 3))) for _ in range(n))


def longest(s, at, train):
    n = 0
    while at + n < len(s) and s[at : at + n + 1] in train:
        n += 1
    return n


def brute_costs(model, trains, text):
    """Normalised phrases of a text of letters, by looking for substrings."""
    out = []
    for (*_, rate), train in zip(model.parts, trains, strict=True):
        at = n = 0
        while at < len(text):
            at += max(1, longest(text, at, train))
            n += 1
        out.append(n / rate)
    return out


def test_costs_against_brute_force():
    rnd = random.Random(1)
    trains = {"a": b"abcabcabd abba", "b": b"bbbbcab cab", "c": b"\xd0\xb6 abc"}
    model = L.Model(trains)
    texts = ["".join(rnd.choices("abcde ", k=n)) for n in (1, 5, 300, 1000, 5000)] + ["ab" * 3000, "b" * 2000, "жжabж" * 200]
    raw, off, told = L.letters(texts)
    assert told.all()
    got = model.costs(raw, off)
    for r in range(len(texts)):
        assert np.allclose(got[r], brute_costs(model, trains.values(), raw[off[r] : off[r + 1]].tobytes()))


def test_query_against_brute_force(spark):
    rnd = random.Random(5)
    rows = [(i, text(rnd, lang, rnd.choice([1, 5, 60])), lang) for i, lang in enumerate(rnd.choices(list(SYLLABLES), k=60))]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    trains = {}
    for lang in SYLLABLES:
        some = sorted((r.h, r.doc_id, r.text) for r in df.filter(F.col("lang") == lang).withColumn("h", F.xxhash64("doc_id")).collect())[: L.TRAIN_DOCS]
        trains[lang] = " ".join(t for *_, t in some).encode()[: L.TRAIN]
    model = L.train(df, F.lit(True))
    for r in L.predict(df, model).collect():
        cost = brute_costs(model, trains.values(), r.text.encode())
        first, second = sorted(cost)[:2]
        assert r.lang_pred == model.langs[cost.index(first)] and abs(r.score - (1 - first / second)) < 1e-9


def test_languages_of_unequal_training_text_and_wide_scripts():
    rnd = random.Random(4)
    syllables = ["".join(rnd.choices("abcdefghijklmnopqrstuvwxyz", k=rnd.randint(2, 3))) for _ in range(120)]
    hangul = [chr(0xAC00 + rnd.randrange(2000)) for _ in range(600)]
    han = [chr(0x4E00 + rnd.randrange(4000)) for _ in range(2500)]
    kinds = {"a": syllables[:80], "b": syllables[28:108], "han": han, "k1": hangul[:400], "k2": hangul[200:]}

    def make(lang, n):
        out = []
        while sum(map(len, out)) + len(out) < n:
            out.append("".join(rnd.choices(kinds[lang], k=rnd.randint(1, 4))))
        return " ".join(out)

    for small in (24_000, 6000, 2000):
        model = L.Model({k: make(k, small if k in ("b", "k2") else 24_000).encode()[: small if k in ("b", "k2") else 24_000] for k in kinds})
        docs = [(k, make(k, n)) for k in kinds for n in (100, 400) for _ in range(50)]
        raw, off, _ = L.letters([t for _, t in docs])
        told = [model.langs[b] for b in model.costs(raw, off).argmin(1)]
        for k in kinds:
            assert sum(a == k == b for (a, _), b in zip(docs, told, strict=True)) >= 95, (k, small)


def test_the_model_is_bounded(spark):
    rnd = random.Random(6)
    df = spark.createDataFrame([(i, text(rnd, lang, 400), lang) for i in range(60) for lang in SYLLABLES], "doc_id long, text string, lang string")
    for most in (1 << 18, 1 << 22):
        assert sum(p[2].nbytes for p in L.train(df, F.lit(True), most=most).parts) <= most


def test_held_out_accuracy_and_odd_rows(spark):
    rnd = random.Random(2)
    rows = [(i, text(rnd, lang, rnd.choice([5, 50, 400])), lang, 0.5) for i, lang in enumerate(rnd.choices(list(SYLLABLES), k=300))]
    odd = [(900, None, "aa", 0.0), (901, "", "aa", 0.0), (902, "123 !!", "bb", 0.0), (903, "日本語", None, 0.0), (None, rows[0][1].upper(), None, 0.0), (904, rows[1][1] * 300, None, 0.0), (5, rows[5][1], rows[5][2], 0.0)]
    df = spark.createDataFrame(rows + odd, "doc_id long, text string, lang string, score double")
    model = L.train(df, F.col("doc_id") % 3 != 1)
    assert model.langs == ["aa", "bb", "cc"]
    got = L.predict(df, model).collect()
    assert len(got) == len(rows) + len(odd)
    held = [(r.lang, r.lang_pred) for r in got if r.doc_id is not None and r.doc_id < 900 and r.doc_id % 3 == 1]
    assert sum(a == b for a, b in held) / len(held) > 0.97
    by = {r.doc_id: (r.lang_pred, r.score) for r in got}
    assert by[900] == by[901] == by[902] == ("und", 0.0) and by[903][0] != "und"
    assert by[None][0] == rows[0][2] and by[904][0] == rows[1][2]
    assert all(0 <= r.score <= 1 for r in got)


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string, lang string")
    model = L.train(df, F.lit(True))
    assert L.predict(df, model).count() == 0
    assert L.predict(spark.createDataFrame([(1, "abc", "x")], df.schema), model).first().lang_pred == "und"


def test_a_label_with_next_to_no_text_wins_nothing_from_others():
    rnd = random.Random(7)
    trains = {k: text(rnd, k, 3000).encode()[:20_000] for k in SYLLABLES}
    docs = [(k, text(rnd, k, n)) for k in SYLLABLES for n in (3, 10, 60) for _ in range(40)]
    raw, off, _ = L.letters([t for _, t in docs])
    line = "zwölf boxkämpfer jagen viktor quer über den großen sylter deich und noch mehr ".encode()
    for rival in (b"", b"abc", line[:20], line[:38], line[:60], text(rnd, "aa", 9).encode()):
        model = L.Model(trains | {"zz": rival})
        told = [model.langs[b] for b in model.costs(raw, off).argmin(1)]
        assert sum(a == b for (a, _), b in zip(docs, told, strict=True)) > 0.99 * len(docs) - 1, rival
