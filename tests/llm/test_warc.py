import datetime
import random
import re

from pyspark.sql import functions as F

from corpusmill.llm import warc

DAY = datetime.datetime(2024, 1, 1)


def canonical(u):
    if u is None:
        return None
    u = u.strip(" ")
    m = re.match(r"^([A-Za-z][A-Za-z0-9+.-]*)://(?:[^/?#@]*@)?([^/?#:]*)(?::(\d*))?([^?#]*)(?:\?([^#]*))?", u)
    if not m:
        return u.lower()
    scheme, host, port, path, query = m[1].lower(), re.sub(r"^www\d*\.|\.$", "", m[2].lower()), m[3] or "", m[4] or "/", m[5] or ""
    port = "" if port == "" or (scheme, port) in (("http", "80"), ("https", "443")) else ":" + port
    query = "&".join(sorted(p for p in query.split("&") if p))
    fixed = f"{'http' if scheme == 'https' else scheme}://{host}{port}{path}" + (f"?{query}" if query else "")
    first, *rest = fixed.split("%")
    return "%".join([first, *(p[:2].upper() + p[2:] for p in rest)])


def brute(rows):
    out = []
    for r in rows:
        if r["type"] != "revisit" or r["profile"] != warc.NOT_MODIFIED:
            continue
        low = lambda h: {k.lower(): v for k, v in sorted((h or {}).items(), key=lambda x: (x[0].lower(), x[1] or "")) if v is not None}
        key, mine, best = canonical(r["url"]), low(r["headers"]), None
        for o in rows:
            full = o["type"] == "response" and o["status"] and 200 <= o["status"] < 300 and o["status"] != 206
            if full and key is not None and r["date"] and o["date"] and canonical(o["url"]) == key and o["date"] < r["date"]:
                if best is None or (o["date"], o["record_id"]) > (best["date"], best["record_id"]):
                    best = o
        if best is None:
            out.append((r["record_id"], "no_response", None, None))
            continue
        old = low(best["headers"])
        weak = lambda h: re.sub("^W/", "", h["etag"]) if h.get("etag") is not None else None
        if weak(old) is not None and weak(mine) is not None:
            told = "resolved" if weak(old) == weak(mine) else "validator_mismatch"
        elif old.get("last-modified") is not None and mine.get("last-modified") is not None:
            told = "resolved" if old["last-modified"] == mine["last-modified"] else "validator_mismatch"
        else:
            told = "unvalidated"
        merged = {**old, **{k: v for k, v in mine.items() if k not in warc.KEPT and v is not None}} if told == "resolved" else None
        out.append((r["record_id"], told, best["record_id"], merged))
    return sorted(out, key=str)


def make():
    rnd = random.Random(8)
    urls = ["http://A.example.com/x?b=2&a=1#f", "https://www.a.example.com:443/x?a=1&b=2", "HTTP://u@b.example.org:8080", "http://b.example.org:8080/", "http://c.example.net/%c3%a9", "http://c.example.net/%C3%A9", "ftp://b.example.org:8080/", "FTP://c.example.net/%c3%a9", None, "", "no url"]
    rows = []
    for i in range(400):
        kind = rnd.choice(["response", "revisit", "revisit", "request"])
        headers = {k: rnd.choice(v) for k, v in {"ETag": ['"1"', 'W/"1"', '"2"'], "last-modified": ["x", "y"], "Cache-Control": ["a", "b"], "Content-Length": ["1", "2"], "X-Y": ["p", None]}.items() if rnd.random() < 0.6}
        when = None if rnd.random() < 0.03 else DAY + datetime.timedelta(seconds=rnd.choice([rnd.randint(0, 300_000), 7, 86_399, 86_400]), microseconds=rnd.choice([0, 1, 5]))
        rows.append(
            {"record_id": f"r{i:03d}", "type": kind, "url": rnd.choice(urls), "date": when, "status": rnd.choice([200, 200, 203, 206, 404, None]) if kind != "revisit" else 304, "headers": headers if rnd.random() < 0.95 else None,
             "payload": None, "profile": rnd.choice([warc.NOT_MODIFIED] * 4 + ["other", None]) if kind == "revisit" else None, "refers_to": None}
        )
    return rows


def test_against_brute_force(spark):
    rows = make()
    df = spark.createDataFrame(rows, warc.COLUMNS + ", outcome string")
    for seconds in (86_400, 50):
        got = {r.record_id: (r.outcome, r.original_id, r.headers) for r in warc.resolve_revisits(df, seconds).collect()}
        assert got == {r[0]: r[1:] for r in brute(rows)}


def test_files_round_trip(spark, tmp_path):
    rnd = random.Random(1)
    rows = [{**r, "payload": bytes(rnd.randbytes(rnd.choice([0, 5, 3000]))) + b"\r\n\r\nWARC/1.1 x" if r["type"] != "revisit" else None, "date": r["date"] or DAY} for r in make()[:60]]
    df = spark.createDataFrame(rows, warc.COLUMNS)
    data = [bytes(r.bytes) for r in warc.warc_bytes(df).collect()]
    (tmp_path / "a.warc.gz").write_bytes(b"".join(data[:30]))
    (tmp_path / "b.warc.gz").write_bytes(b"".join(data[30:]))
    got = {r.record_id: r.asDict() for r in warc.read_warc(spark, str(tmp_path)).collect()}
    assert len(got) == 60
    for r in rows:
        g = got[r["record_id"]]
        for c in ("type", "url", "profile", "refers_to", "date"):
            assert (g[c] or None) == (r[c] or None), c
        assert bytes(g["payload"] or b"") == (r["payload"] or b"")
        if r["type"] in ("response", "revisit"):
            assert g["status"] == (r["status"] or (304 if r["type"] == "revisit" else 200))
    cut = b"".join(data[:-1]) + data[-1][:60]
    assert len(list(warc.read_records(cut))) == 59


def test_payloads_and_pages(spark):
    pages = spark.createDataFrame([(i, f"http://h/{i // 40}", f"<p>{i // 40}") for i in range(120)] + [(200, None, None), (None, "http://h/0", "")], "page_id long, url string, html string")
    captures = warc.page_captures(pages)
    rows = [r.asDict() for r in captures.collect()]
    got = warc.resolve_revisits(captures)
    want = brute(rows)
    assert sorted((r.record_id or "", r.outcome) for r in got.collect()) == sorted((r[0] or "", r[1]) for r in want)
    assert {r[1] for r in want} >= {"resolved", "no_response", "validator_mismatch"}
    full = captures.withColumn("payload", __import__("pyspark").sql.functions.encode("record_id", "UTF-8"))
    for r in warc.with_payloads(got, full).collect():
        assert (bytes(r.payload).decode() if r.payload else None) == (r.original_id if r.outcome == "resolved" else None)


def test_empty(spark):
    assert warc.resolve_revisits(spark.createDataFrame([], warc.COLUMNS)).count() == 0


def test_profiles_of_both_versions_and_others(spark):
    at = datetime.datetime(2024, 1, 1, tzinfo=datetime.UTC)
    row = lambda name, kind, hour, profile: (name, kind, "http://a.example/", at + datetime.timedelta(hours=hour), 200 if kind == "response" else 304, {"ETag": '"x"'}, None, profile, None)
    old = "http://netpreserve.org/warc/1.0/revisit/server-not-modified"
    digest = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
    rows = [row("r", "response", 0, None), row("v1", "revisit", 1, old), row("v2", "revisit", 2, warc.NOT_MODIFIED), row("d", "revisit", 3, digest), row("n", "revisit", 4, None)]
    given = spark.createDataFrame(rows, warc.COLUMNS)
    assert {(r.record_id, r.outcome, r.original_id) for r in warc.resolve_revisits(given).collect()} == {("v1", "resolved", "r"), ("v2", "resolved", "r")}
    both = warc.resolve_revisits(given).unionByName(warc.other_revisits(given)).collect()
    assert sorted((r.record_id, r.outcome) for r in both) == [("d", "other_profile"), ("n", "other_profile"), ("v1", "resolved"), ("v2", "resolved")]


def test_malformed_records_are_left_out():
    good = b"WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:a>\r\nWARC-Date: 2024-01-01T00:00:00Z\r\nContent-Length: 19\r\n\r\nHTTP/1.1 200 OK\r\n\r\n\r\n\r\n"
    bad = good.replace(b"Content-Length: 19", b"Content-Length: x1").replace(b"urn:a", b"urn:b")
    odd = good.replace(b"2024-01-01T00:00:00Z", b"yesterday").replace(b"urn:a", b"urn:c")
    got = {r["record_id"]: r["date"] for r in warc.read_records(good + bad + odd + b"noise\r\n" + good.replace(b"urn:a", b"urn:d"))}
    assert set(got) == {"urn:a", "urn:c", "urn:d"} and got["urn:c"] is None and got["urn:a"].year == 2024
    zipped = __import__("gzip").compress(good)
    assert [r["record_id"] for r in warc.read_records(zipped + b"\x1f\x8bbroken")] == ["urn:a"]
    assert list(warc.read_records(b"")) == []


def test_names_that_differ_in_case_only(spark):
    df = spark.createDataFrame([({"ETag": "q", "etag": "q", "ETAG": "p", "B": None},), (None,)], "h map<string,string>")
    assert [r.h for r in df.select(warc.lower_keys(F.col("h")).alias("h")).collect()] == [{"etag": "q"}, {}]


def test_lengths_past_any_file_end_reading():
    good = b"WARC/1.1\r\nWARC-Type: metadata\r\nContent-Length: 2\r\n\r\nok\r\n\r\n"
    for size in (b"9" * 23, b"1" * 5000, b"4000000000000"):
        bad = b"WARC/1.1\r\nWARC-Type: metadata\r\nContent-Length: " + size + b"\r\n\r\nxx"
        assert [r["payload"] for r in warc.read_records(good + bad)] == [b"ok"]
