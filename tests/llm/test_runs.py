import random
import re
import zlib

from corpusmill.llm import queries, runs

SCHEMA = "doc_id long, text string, n_words string, runs string"


def brute_runs(w, least, times):
    """Every period by itself, stretch by stretch; a stretch that has a shorter period is left out."""
    n, out = len(w), []
    for q in range(1, n // times + 1):
        i = 0
        while i + q < n:
            s = i
            while i + q < n and w[i] == w[i + q]:
                i += 1
            size = i - s + q
            if i > s and size >= max(least, times * q):
                x = w[s : s + size]
                if not any(x[d:] == x[:-d] for d in range(1, q)):
                    out.append((s, size, q))
            i += i == s
    return sorted(out, key=lambda r: (r[0], r[2]))


def brute(rows, least=6, times=4):
    out = []
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        found = brute_runs(w, least, times)
        gone = {k for s, size, q in found for k in range(s + q, s + size)}
        out.append((i, len(w), found, " ".join(x for k, x in enumerate(w) if k not in gone)))
    return out


def planted(i, t):
    w, h = re.findall(r"[^\x20\x09-\x0D]+", t or ""), zlib.crc32(str(i).encode())
    n, g = len(w), h // 10
    if i is None or h % 10 or not n:
        return t
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return " ".join(w[k] if k < a else w[a + (k - a) % p] for k in range(n))


def told(df):
    key = lambda r: (r[0] is None, r)
    return sorted(((r.doc_id, r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in df.collect()), key=lambda r: str(key(r)))


def order(rows):
    return sorted(rows, key=lambda r: str((r[0] is None, r)))


def texts(rnd, number):
    for _ in range(number):
        parts = [([rnd.choice("abcé") for _ in range(rnd.randint(1, 5))] * rnd.choice([1, 1, 2, 4, 5, 9]))[: rnd.randint(1, 40)] for _ in range(rnd.randint(0, 5))]
        yield rnd.choice([" ", "\n", " \t "]).join(sum(parts, []))


def test_against_brute_force(spark):
    rnd = random.Random(4)
    rows = [(i, t) for i, t in enumerate(texts(rnd, 300))]
    rows += [(None, "a a a a a a a"), (None, None), (3, ""), (3, " \n "), (3, "x " * 5), (3, "x " * 6), (900, "y" * 100000), (901, "A a " * 2000 + "b")]
    df = spark.createDataFrame([(*r, "1", "2") for r in rows], SCHEMA)
    assert told(runs.collapse_runs(df)) == order(brute(rows))
    assert told(runs.collapse_runs(df, 2, 2)) == order(brute(rows[:300], 2, 2) + brute(rows[300:-1], 2, 2) + brute(rows[-1:], 2, 2))


def test_one_period_inside_another(spark):
    text = " ".join((["a"] * 7 + ["b"]) * 5)
    rows = [(1, text), (2, " ".join(["c", *text.split(), "d"]))]
    df = spark.createDataFrame([(*r, "", "") for r in rows], SCHEMA)
    assert told(runs.collapse_runs(df)) == order(brute(rows))


def test_empty(spark):
    assert runs.collapse_runs(spark.createDataFrame([], SCHEMA)).count() == 0


def test_query(spark, tmp_path):
    """The whole query beside plain Python, with the documents whose tails repeat."""
    import hashlib

    rnd = random.Random(5)
    words = ["the", "of", "Köln", "x1", "ab", "cd", "ef", "gh"]
    rows = [(i, " ".join(rnd.choice(words) for _ in range(rnd.randint(0, 120)))) for i in range(400)] + [(1000, None), (1001, "")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: tuple(r)[1:] for r in queries.op13_runs(spark, str(tmp_path)).collect()}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    some = 0
    for (i, _), (_, _, found, left) in zip(rows, brute([(i, planted(i, t)) for i, t in rows]), strict=True):
        best = min(found, key=lambda r: (-(r[1] * 10**9 // r[2]), r[0], r[2]), default=(None, None, None))
        milli = 1000 * best[1] // best[2] if found else None
        some += bool(found)
        assert got[i] == (len(found), *best, milli, sha("".join(f"{s},{size},{q}\n" for s, size, q in found)), sha(left))
    assert some > 10
