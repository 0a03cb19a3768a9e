"""The pipeline's stages against plain Python on a small corpus with planted cases."""

import random
import re
from collections import Counter

import pytest

import corpus_pipeline
from corpusmill.llm import simhash

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
BAD = ["idiot", "scum", "moron"]


def shingles(text, k=5):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def make():
    rnd = random.Random(12)
    vocabulary = ["".join(rnd.choices("abcdefghijklmnop", k=rnd.randint(2, 7))) for _ in range(3000)]
    words = lambda n: [rnd.choice(vocabulary) for _ in range(n)]
    passage, item = words(60), words(40)
    docs, kind, labels = [], {}, []

    def add(what, w):
        i = len(docs)
        kind[i] = what
        text = " ".join(w) if isinstance(w, list) else w
        docs.append((i, text, "en", f"s{i % 3}" if i % 7 else None, len(text or "")))
        return i

    for _ in range(300):
        i = add("clean", words(rnd.randint(30, 150)))
        labels.append((i, 1, 0))
    for _ in range(90):
        w = words(80)
        for _ in range(3):
            w.insert(rnd.randrange(80), rnd.choice(BAD))
        i = add("toxic", w)
        labels.append((i, 1, 1))
    for k in range(10):
        base = docs[k][1].split() if len(docs[k][1].split()) > 100 else words(120)
        add("base", base)
        for _ in range(3):
            near = list(base)
            near[rnd.randrange(len(near))] = "changed"
            add("near", near if rnd.random() < 0.7 else base)
    for _ in range(12):
        add("passage", words(30) + passage + words(30))
    for _ in range(6):
        add("leak", words(40) + item + words(20))
    add("clean", None)
    add("clean", "")
    return docs, kind, labels, [(0, " ".join(item)), (1, "never seen anywhere in these texts at all"), (2, None)]


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    docs, kind, labels, items = make()
    base = str(tmp_path_factory.mktemp("corpus"))
    spark.createDataFrame(docs, SCHEMA).write.parquet(f"{base}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{base}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{base}/benchmark.parquet")
    return base, docs, kind, items


def test_stages_against_plain_python(spark, corpus):
    base, docs, kind, items = corpus
    stages = dict(corpus_pipeline.STAGES)
    assert [k for k, _ in corpus_pipeline.STAGES] == ["toxicity", "simhash near-dedup", "substring dedup", "benchmark decontamination", "mixing"]
    got = stages["toxicity"](spark, spark.createDataFrame(docs, SCHEMA), base)
    assert got.columns == [c.split()[0] for c in SCHEMA.split(", ")]
    kept = {r.doc_id: r.text for r in got.collect()}
    gone = set(kind) - set(kept)
    assert all(kind[i] == "toxic" for i in gone) and sum(k == "toxic" for k in kind.values()) - len(gone) <= 4

    rows = [d for d in docs if kind[d[0]] != "toxic"]
    near = {r.doc_id for r in stages["simhash near-dedup"](spark, spark.createDataFrame(rows, SCHEMA), base).collect()}
    sets = {d[0]: shingles(d[1]) for d in rows}
    alike = lambda a, b: len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])
    ids = sorted(sets)
    copies = {b for b in ids for a in ids if a < b and alike(a, b)}
    assert near == set(ids) - copies

    rows = [d for d in rows if d[0] in near]
    cut = {r.doc_id: r.text for r in stages["substring dedup"](spark, spark.createDataFrame(rows, SCHEMA), base).collect()}
    first, want = {}, {}
    split = {d[0]: (d[1] or "").split() for d in rows}
    for i in sorted(split):
        for k in range(len(split[i]) - 12):
            first.setdefault(tuple(split[i][k : k + 13]), i)
    for d in rows:
        w = split[d[0]]
        out = {k + j for k in range(len(w) - 12) if first[tuple(w[k : k + 13])] < d[0] for j in range(13)}
        if not out:
            want[d[0]] = d[1]
        elif len(out) < len(w):
            want[d[0]] = " ".join(x for k, x in enumerate(w) if k not in out)
    assert cut == want and any(kind[i] == "passage" and len((t or "").split()) <= 61 for i, t in cut.items())

    rows = [d[:1] + (cut[d[0]],) + d[2:] for d in rows if d[0] in cut]
    clean = {r.doc_id for r in stages["benchmark decontamination"](spark, spark.createDataFrame(rows, SCHEMA), base).collect()}
    leaks = set()
    for d in rows:
        w = (d[1] or "").split()
        for _, t in items:
            n = (t or "").split()
            grams = lambda x: Counter(tuple(x[i : i + 5]) for i in range(len(x) - 4))
            for k in range(len(w) - len(n) + 1) if n else ():
                both = sum((grams(w[k : k + len(n)]) & grams(n)).values())
                if both >= 0.8 * (2 * (len(n) - 4) - both):
                    leaks.add(d[0])
    assert clean == {d[0] for d in rows} - leaks and leaks

    last = stages["mixing"](spark, spark.createDataFrame([d for d in rows if d[0] in clean], SCHEMA), base).collect()
    total = sum(r.size for r in last)
    assert len(last) == len(clean) and abs(sum(r.taken for r in last) - 1.5 * total) < 200


def test_run_is_the_stages_one_after_the_other(spark, corpus):
    base, docs, *_ = corpus
    got = corpus_pipeline.run(spark, base)
    assert "taken" in got.columns and 250 < got.count() < len(docs)


def test_empty_corpus(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_near_groups_with_odd_rows(spark):
    text = " ".join(map(str, range(300)))
    rows = [(5, text), (4, text.replace(" 7 ", " x ")), (None, text), (9, None), (8, ""), (7, "one two"), (7, "one two"), (6, "One  TWO")]
    got = {(r.doc_id, r.component_id) for r in simhash.similar_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {(5, 4), (4, 4), (None, 4), (9, 8), (8, 8), (7, 6), (6, 6)}
    kept = simhash.one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(r.doc_id or 0 for r in kept) == [0, 4, 6, 8]
