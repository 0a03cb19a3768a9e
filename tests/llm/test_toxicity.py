import random

import numpy as np
from pyspark.sql import functions as F

from corpusmill.llm import toxicity

BAD = ["idiot", "scum", "moron", "böse"]


def make(n=900):
    rnd = random.Random(3)
    vocabulary = ["".join(rnd.choices("abcdefgh", k=4)) for _ in range(400)]
    docs, labels = [], []
    for i in range(n):
        w = rnd.choices(vocabulary, k=rnd.randint(20, 120))
        toxic = rnd.random() < 0.2
        for _ in range(rnd.randint(2, 4) if toxic else 0):
            w.insert(rnd.randrange(len(w)), rnd.choice(BAD) + rnd.choice(["", "!", ",", "%%%"]))
        docs.append((i, " ".join(w), "x"))
        labels.append((i, int(toxic)))
    return docs, labels


def test_held_out_accuracy_and_odd_rows(spark):
    docs, labels = make()
    truth = dict(labels)
    odd = [(10_001, None, ""), (10_002, "", ""), (None, "you IDIOT and scum, moron", ""), (10_003, "idiot " + "quiet " * 200_000, ""), (5, docs[5][1], "")]
    df = spark.createDataFrame(docs + odd, "doc_id long, text string, score string")
    lab = spark.createDataFrame([*labels, (None, 1), (7, None), (3, truth[3])], "doc_id long, toxic int")
    model = toxicity.train(df, lab, F.col("doc_id") % 4 != 2)
    assert len(model[0]) < 2000 and model[0][-1] == 1 << toxicity.BITS
    again = toxicity.train(df.repartition(7), lab, F.col("doc_id") % 4 != 2)
    assert np.array_equal(model[0], again[0]) and np.array_equal(model[1], again[1])
    got = toxicity.score(df, model)
    assert got.columns == ["doc_id", "text", "score"]
    rows = got.collect()
    assert len(rows) == len(docs) + len(odd) and all(0 <= r.score <= 1 for r in rows)
    held = [(truth[r.doc_id], r.score >= 0.3) for r in rows if r.doc_id in truth and r.doc_id % 4 == 2]
    assert sum(a == b for a, b in held) / len(held) > 0.95
    by = {r.doc_id: r.score for r in rows}
    assert by[10_001] == by[10_002] < 0.3 < by[None]


def test_scores_against_brute_force(spark):
    from corpusmill.llm.words import mix

    at = np.array([3, 5, 1 << toxicity.BITS])
    words = toxicity.split(__import__("pyarrow").array(["one two one", "three"]))
    features = toxicity.features(words)
    at = np.array([*np.unique(np.concatenate([f[1] for f in features])), 1 << toxicity.BITS])
    w = np.linspace(-1, 1, len(at))
    table = dict(zip(at.tolist(), w.tolist(), strict=True))
    want = []
    for r in range(2):
        logit = w[-1] + sum(table[i] for i in {int(i) for q, i in zip(*features[0], strict=True) if q == r})
        logit += toxicity.PAIR * sum(table[i] for i in {int(i) for f in features[1:] for q, i in zip(*f, strict=True) if q == r})
        want.append(1 / (1 + np.exp(-logit)))
    got = toxicity.score(spark.createDataFrame([("one two one",), ("three",)], "text string"), (at, w)).collect()
    assert np.allclose([r.score for r in got], want) and mix is not None


def test_nothing_to_learn_from(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    model = toxicity.train(docs, spark.createDataFrame([], "doc_id long, toxic int"), F.lit(True))
    assert toxicity.score(docs, model).count() == 0
    assert toxicity.score(spark.createDataFrame([(1, "a b")], docs.schema), model).first().score < 1e-9


def test_ftrl_against_plain_python():
    """Per-coordinate FTRL-proximal with a dictionary of numbers, as in the paper."""
    rnd = random.Random(8)
    ftrl, z, n = toxicity.Ftrl(), {}, {}
    bias = 1 << toxicity.BITS

    def weight(i):
        s = z.get(i, 0.0)
        l1 = 0.0 if i == bias else ftrl.l1
        return 0.0 if abs(s) <= l1 and i != bias else -(s - (1 if s > 0 else -1) * l1) / ((ftrl.beta + n.get(i, 0.0) ** 0.5) / ftrl.alpha + ftrl.l2)

    for _ in range(400):
        at = sorted(rnd.sample(range(60), 12))
        label = int(sum(i < 15 for i in at) > 3)
        value = [1.0 if i < 40 else toxicity.PAIR for i in at]
        ftrl.learn(np.array(at), np.array(value), label)
        p = 1 / (1 + np.exp(-sum(weight(i) * v for i, v in zip([*at, bias], [*value, 1.0], strict=True))))
        w = {i: weight(i) for i in [*at, bias]}
        for i, v in zip([*at, bias], [*value, 1.0], strict=True):
            g = (p - label) * v
            z[i] = z.get(i, 0.0) + g - ((n.get(i, 0.0) + g * g) ** 0.5 - n.get(i, 0.0) ** 0.5) / ftrl.alpha * w[i]
            n[i] = n.get(i, 0.0) + g * g
    at, w = ftrl.model()
    got = dict(zip(at.tolist(), w.tolist(), strict=True))
    assert all(abs(got.get(i, 0.0) - weight(i)) < 1e-9 for i in [*range(60), bias]) and len(got) > 5


def test_the_sample_is_bounded_in_bytes_and_counts_documents(spark):
    docs, labels = make(200)
    df = spark.createDataFrame(docs, "doc_id long, text string, score string")
    lab = spark.createDataFrame([*labels, *((i, 1) for i in range(5000, 9000))], "doc_id long, toxic int")
    few = toxicity.train(df, lab, F.lit(True), sample=150, most=20_000)
    all_ = toxicity.train(df, lab, F.lit(True), sample=200)
    assert len(few[0]) < len(all_[0]) and len(all_[0]) > 3
