"""WARC records, and resolution of not-modified revisits.

A revisit record under the server-not-modified profile stands for a 304 answer: it has
headers but no payload. It is resolved by an as-of join: the latest full response of the
same canonical URL from before the revisit, checked against the revisit's validators, gives
the payload, and the 304's headers update those of the stored response where a 304 may
(RFC 9111, section 3.2).

The as-of join never sorts a URL's whole history in one task. Captures are parted by URL and
a slice of time; the last full response of each slice is carried to later slices over one
row for each slice, and within a slice a window runs over the slice's rows only.
"""

from __future__ import annotations

import datetime
import gzip
import io
import uuid
import zlib
from collections.abc import Iterable, Iterator
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Seconds of a slice of time.
SLICE = 86_400
#: Header fields of a stored response that a 304 doesn't update: they describe the stored
#: payload, the connection, or are set by the cache itself (fixed values of RFC 9110 and 9111).
KEPT = (
    "connection content-encoding content-length content-md5 content-range content-type etag keep-alive proxy-authenticate "
    "proxy-authentication-info proxy-authorization proxy-connection te trailer transfer-encoding upgrade"
).split()
COLUMNS = "record_id string, type string, url string, date timestamp, status int, headers map<string,string>, payload binary, profile string, refers_to string"
_ARROW = pa.schema(
    [("record_id", pa.string()), ("type", pa.string()), ("url", pa.string()), ("date", pa.timestamp("us", "UTC")), ("status", pa.int32())]
    + [("headers", pa.map_(pa.string(), pa.string())), ("payload", pa.binary()), ("profile", pa.string()), ("refers_to", pa.string())]
)
NOT_MODIFIED = "http://netpreserve.org/warc/1.1/revisit/server-not-modified"
#: The profile as files of either version name it.
NOT_MODIFIED_URIS = (NOT_MODIFIED, "http://netpreserve.org/warc/1.0/revisit/server-not-modified")


def canonical_url(url: Column) -> Column:
    """Lower-case scheme (http for https) and host, no user, default port, fragment or ``www.``; query parameters sorted; path ``/`` at least.

    Percent escapes are upper-cased. Null stays null; what is no URL is trimmed and lower-cased.
    """
    u = F.trim(url)
    part = lambda k: F.regexp_extract(u, r"^([A-Za-z][A-Za-z0-9+.-]*)://(?:[^/?#@]*@)?([^/?#:]*)(?::(\d*))?([^?#]*)(?:\?([^#]*))?", k)
    scheme, host = F.lower(part(1)), F.regexp_replace(F.lower(part(2)), r"^www\d*\.|\.$", "")
    port = F.when((part(3) == "") | ((scheme == "http") & (part(3) == "80")) | ((scheme == "https") & (part(3) == "443")), "").otherwise(F.concat(F.lit(":"), part(3)))
    query = F.array_join(F.array_sort(F.filter(F.split(part(5), "&"), lambda p: p != "")), "&")
    path = F.when(part(4) == "", "/").otherwise(part(4))
    fixed = F.concat(F.when(scheme == "https", "http").otherwise(scheme), F.lit("://"), host, port, path, F.when(query == "", "").otherwise(F.concat(F.lit("?"), query)))
    # escapes by pieces: each piece after a % begins with two hex digits
    escaped = F.array_join(F.transform(F.split(fixed, "%"), lambda p, i: F.when(i == 0, p).otherwise(F.concat(F.upper(F.substring(p, 1, 2)), F.substring(p, 3, 1 << 30)))), "%")
    return F.when(part(1) == "", F.lower(u)).otherwise(escaped)


def lower_keys(headers: Column) -> Column:
    """A header map with lower-cased names; of names that differ in case only, the value that sorts last stays.

    A name without a value is left out; a null map is empty.
    """
    entries = F.array_distinct(F.transform(F.filter(F.map_entries(headers), lambda e: e["value"].isNotNull()), lambda e: F.struct(F.lower(e["key"]).alias("key"), e["value"].alias("value"))))
    return F.coalesce(F.map_from_entries(F.filter(entries, lambda e: ~F.exists(entries, lambda o: (o["key"] == e["key"]) & (o["value"] > e["value"])))), F.create_map().cast("map<string,string>"))


def merged_headers(stored: Column, fresh: Column) -> Column:
    """The stored headers, with those of a 304 answer where it may update them; names are lower-case."""
    update = F.map_filter(fresh, lambda k, v: ~k.isin(KEPT) & v.isNotNull())
    rest = F.map_filter(stored, lambda k, v: ~F.map_contains_key(update, k))
    return F.map_concat(rest, update)


def as_of(rows: DataFrame, key: str, time: str, keep: Column, value: Column, tie: list[str], seconds: int = SLICE) -> DataFrame:
    """``rows`` with ``_last``: ``value`` of the latest row of the same key strictly before it in time where ``keep`` holds.

    Rows of one time don't see each other; of several kept rows of one time the last by ``tie`` counts.
    """
    moment = F.struct(F.col(time), *[F.col(c) for c in tie])
    rows = rows.withColumns({"_slice": F.floor(F.col(time).cast("double") / seconds).cast("long"), "_mark": F.when(keep, F.struct(moment.alias("at"), value.alias("value")))})
    slices = rows.groupBy(key, "_slice").agg(F.max_by("_mark", F.when(F.col("_mark").isNotNull(), moment)).alias("_mark"))
    order = Window.partitionBy(key).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    slices = slices.select(key, "_slice", F.last("_mark", ignorenulls=True).over(order).alias("_earlier"))
    # rows strictly earlier in the slice: the largest mark, as marks begin with their moment
    best = Window.partitionBy(key, "_slice").orderBy(F.unix_micros(time)).rangeBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_in", F.max_by("_mark", "_mark.at").over(best))
    return rows.join(slices, [key, "_slice"]).withColumn("_last", F.coalesce("_in", "_earlier")["value"]).drop("_in", "_earlier", "_mark", "_slice")


def resolve_revisits(captures: DataFrame, seconds: int = SLICE) -> DataFrame:
    """One row for each server-not-modified revisit of ``captures`` (columns of ``COLUMNS``): record_id, url_key, date, outcome, original_id, original_date, headers.

    The profile's URI is that of WARC/1.0 or 1.1; ``other_revisits`` has the revisits of other profiles.

    ``outcome``: ``resolved``; ``no_response`` (no full response from before: status 200 to
    299 but 206, type response, of the same canonical URL); ``validator_mismatch`` (both sides
    have an etag and they differ by weak comparison, or neither or one has an etag and both
    have last-modified and they differ); ``unvalidated`` (no validator in common, so nothing
    says that the stored payload is the one meant). Only resolved revisits have merged headers
    and an original; for others the latest candidate is named in original_id all the same.
    Revisits of a null URL or date are ``no_response``. Repeated rows give repeated results.
    Of responses at one time the one of largest record_id counts. Payloads aren't moved: they
    are fetched by original_id.
    """
    rows = captures.select(
        "record_id", "type", canonical_url(F.col("url")).alias("url_key"), "date", "status", lower_keys(F.col("headers")).alias("headers"), F.coalesce("profile", F.lit("")).alias("profile")
    )
    full = (F.col("type") == "response") & F.col("status").between(200, 299) & (F.col("status") != 206)
    revisit = (F.col("type") == "revisit") & F.col("profile").isin(*NOT_MODIFIED_URIS)
    rows = rows.filter(full | revisit).withColumn("_full", full)
    known = as_of(rows.filter("url_key is not null and date is not null"), "url_key", "date", F.col("_full"), F.struct("record_id", "date", "headers"), ["record_id"], seconds)
    lost = rows.filter("url_key is null or date is null").withColumn("_last", F.lit(None).cast(known.schema["_last"].dataType))
    found = known.unionByName(lost).filter(~F.coalesce("_full", F.lit(False)))
    old = F.col("_last.headers")
    tag = lambda h: F.regexp_replace(h["etag"], "^W/", "")
    tags = tag(old).isNotNull() & tag(F.col("headers")).isNotNull()
    times = old["last-modified"].isNotNull() & F.col("headers")["last-modified"].isNotNull()
    outcome = (
        F.when(F.col("_last").isNull(), "no_response")
        .when(tags, F.when(tag(old) == tag(F.col("headers")), "resolved").otherwise("validator_mismatch"))
        .when(times, F.when(old["last-modified"] == F.col("headers")["last-modified"], "resolved").otherwise("validator_mismatch"))
        .otherwise("unvalidated")
    )
    return found.withColumn("outcome", outcome).select(
        "record_id", "url_key", "date", "outcome", F.col("_last.record_id").alias("original_id"), F.col("_last.date").alias("original_date"),
        F.when(F.col("outcome") == "resolved", merged_headers(old, F.col("headers"))).alias("headers"),
    )


def other_revisits(captures: DataFrame) -> DataFrame:
    """The revisits of another profile or none, in the columns of ``resolve_revisits``; their outcome is ``other_profile``."""
    rows = captures.filter("type = 'revisit'").filter(~F.coalesce(F.col("profile").isin(*NOT_MODIFIED_URIS), F.lit(False)))
    return rows.select(
        "record_id", canonical_url(F.col("url")).alias("url_key"), "date", F.lit("other_profile").alias("outcome"), F.lit(None).cast("string").alias("original_id"),
        F.lit(None).cast("timestamp").alias("original_date"), F.lit(None).cast("map<string,string>").alias("headers"),
    )


def with_payloads(resolved: DataFrame, captures: DataFrame) -> DataFrame:
    """``resolved`` with the payload of its original where it is resolved; a join by record_id, made only when payloads are wanted."""
    full = captures.filter("type = 'response'").select(F.col("record_id").alias("original_id"), "payload").dropDuplicates(["original_id"])
    wanted = resolved.withColumn("_k", F.when(F.col("outcome") == "resolved", F.col("original_id")))
    return wanted.join(full.withColumnRenamed("original_id", "_k"), "_k", "left").drop("_k")


# --- files -----------------------------------------------------------------------------------


def _block(first: str, headers: Iterable[tuple[str, str]]) -> bytes:
    return "".join([first + "\r\n", *(f"{k}: {v}\r\n" for k, v in headers), "\r\n"]).encode("utf-8")


def write_record(record: dict) -> bytes:
    """One gzip member with a WARC/1.1 record of a row of ``COLUMNS``."""
    kind = record["type"]
    body = b""
    if kind in ("response", "revisit"):
        status = record["status"] or (304 if kind == "revisit" else 200)
        body = _block(f"HTTP/1.1 {status} ", sorted((record["headers"] or {}).items())) + (record["payload"] or b"" if kind == "response" else b"")
    elif record["payload"]:
        body = record["payload"]
    head = [("WARC-Type", kind), ("WARC-Record-ID", f"<{record['record_id']}>"), ("WARC-Date", record["date"].strftime("%Y-%m-%dT%H:%M:%S.%fZ"))]
    head += [("WARC-Target-URI", record["url"])] if record["url"] is not None else []
    head += [("WARC-Profile", record["profile"])] if record["profile"] else []
    head += [("WARC-Refers-To", f"<{record['refers_to']}>")] if record["refers_to"] else []
    head += [("Content-Type", "application/http;msgtype=response")] if kind in ("response", "revisit") else []
    out = _block("WARC/1.1", [*head, ("Content-Length", str(len(body)))]) + body + b"\r\n\r\n"
    return gzip.compress(out, mtime=0)


def _headers(raw: bytes) -> tuple[str, dict[str, str]]:
    lines = raw.decode("utf-8", "replace").replace("\r\n", "\n").split("\n")
    out: dict[str, str] = {}
    last = None
    for line in lines[1:]:
        if line[:1] in (" ", "\t") and last:
            out[last] += " " + line.strip()
        elif ":" in line:
            last, value = line.split(":", 1)
            out[last] = value.strip()
    return lines[0], out


class _Unzipped(io.RawIOBase):
    """The contents of gzip members one after the other, up to where one is cut off or broken."""

    def __init__(self, source: BinaryIO):
        self.members = gzip.GzipFile(fileobj=source)

    def readable(self) -> bool:
        return True

    def readinto(self, into) -> int:
        try:
            some = self.members.read1(len(into))
        except (EOFError, gzip.BadGzipFile, zlib.error):
            return 0
        into[: len(some)] = some
        return len(some)


def _date(text: str | None) -> datetime.datetime | None:
    try:
        when = datetime.datetime.fromisoformat((text or "").strip().replace("Z", "+00:00"))
    except ValueError:
        return None
    return when if when.tzinfo else when.replace(tzinfo=datetime.UTC)


def _body(stream, size: str) -> bytes | None:
    """So many bytes, read piece by piece, as a length that is told may be any; null where the stream ends before."""
    left, parts = int(size) if len(size) < 19 else 1 << 62, []
    while left and (part := stream.read(min(left, 1 << 20))):
        parts.append(part)
        left -= len(part)
    return None if left else b"".join(parts)


def read_records(source: bytes | BinaryIO) -> Iterator[dict]:
    """Rows of ``COLUMNS`` of a WARC file, plain or gzipped, read record by record.

    A record without a sound Content-Length is left out, and reading goes on at the next
    line that begins a record; a date that is none is null. Reading ends at a record that is
    cut off, or where a gzip member is broken.
    """
    stream: BinaryIO = io.BytesIO(source) if isinstance(source, bytes) else source
    stream = io.BufferedReader(stream) if not hasattr(stream, "peek") else stream
    if stream.peek(2)[:2] == b"\x1f\x8b":
        stream = io.BufferedReader(_Unzipped(stream))
    number = 0
    while line := stream.readline():
        if not line.startswith(b"WARC/"):
            continue
        raw = [line]
        while (line := stream.readline()) and line.strip():
            raw.append(line)
        if not line:
            return
        head = {k.lower(): v for k, v in _headers(b"".join(raw))[1].items()}
        size = head.get("content-length", "0").strip()
        if not (size.isascii() and size.isdigit()):
            continue
        body = _body(stream, size)
        if body is None:
            return
        number += 1
        kind, status, headers, payload = head.get("warc-type"), None, None, body or None
        if kind in ("response", "revisit") and body.startswith(b"HTTP/"):
            front, _, payload = body.partition(b"\r\n\r\n")
            first, headers = _headers(front)
            word = first.split()
            status = int(word[1]) if len(word) > 1 and word[1].isascii() and word[1].isdigit() and len(word[1]) < 9 else None
            payload = payload or None
        yield {
            "record_id": head.get("warc-record-id", f"urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, str(number))}").strip("<>"),
            "type": kind, "url": head.get("warc-target-uri"), "date": _date(head.get("warc-date")), "status": status, "headers": headers,
            "payload": payload, "profile": head.get("warc-profile"), "refers_to": (head.get("warc-refers-to") or "").strip("<>") or None,
        }


def read_warc(spark, path: str) -> DataFrame:
    """Captures of all WARC files at a path that Spark can read, a file (2 GB at most) to a worker, unpacked record by record."""
    files = spark.read.format("binaryFile").load(path).select("content")

    def run(batches):
        for batch in batches:
            for content in batch.column("content"):
                rows, held = [], 0
                for row in read_records(io.BytesIO(content.as_buffer())):
                    rows.append(row)
                    held += len(row["payload"] or b"")
                    if len(rows) == 256 or held > 1 << 24:
                        yield pa.RecordBatch.from_pylist(rows, _ARROW)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, _ARROW)

    return files.mapInArrow(run, COLUMNS)


def warc_bytes(captures: DataFrame) -> DataFrame:
    """(record_id, bytes): each capture as a gzip member; members joined in any order are a WARC file."""

    def run(batches):
        for batch in batches:
            rows = batch.to_pylist()
            for r in rows:
                r["headers"] = dict(r["headers"]) if r["headers"] is not None else None
            yield pa.RecordBatch.from_arrays([batch.column("record_id"), pa.array([write_record(r) for r in rows], pa.binary())], ["record_id", "bytes"])

    return captures.mapInArrow(run, "record_id string, bytes binary")


def page_captures(pages: DataFrame) -> DataFrame:
    """A crawl over ``pages`` (page_id, url, html), as captures without payloads, for tables that have no records.

    Each page is a full response. A page whose id is odd is visited again a day later and
    answers 304; of these, ids that leave 3 by 4 have another etag then, and ids that leave 1
    by 8 send no etag but their time of change. A page whose id divides by 10 is also a
    revisit from before its response.
    """
    html = F.coalesce("html", F.lit(""))
    odd, id_ = F.pmod("page_id", F.lit(2)) == 1, F.col("page_id")
    at = lambda days: F.timestamp_seconds(F.lit(1_600_000_000) + F.pmod(F.length(F.coalesce("url", F.lit(""))), F.lit(7)) * 3600 + id_ * 60 + days * 86_400)
    tag, changed = F.concat(F.lit('"'), F.md5(html), F.lit('"')), F.concat(F.lit("day "), F.pmod("page_id", F.lit(28)).cast("string"))
    text = lambda x: F.lit(x)
    stored = F.create_map(text("ETag"), tag, text("Last-Modified"), changed, text("Content-Type"), text("text/html"), text("Content-Length"), F.length(html).cast("string"), text("Cache-Control"), text("max-age=60"))
    other = F.when(F.pmod("page_id", F.lit(4)) == 3, F.lit('"changed"')).otherwise(F.concat(F.lit("W/"), tag))
    fresh = F.when(
        F.pmod("page_id", F.lit(8)) == 1, F.create_map(text("last-modified"), changed, text("Cache-Control"), text("max-age=600"), text("Content-Length"), text("0"))
    ).otherwise(F.create_map(text("etag"), other, text("Cache-Control"), text("max-age=600"), text("Content-Length"), text("0"), text("Date"), F.concat(text("visit "), id_.cast("string"))))

    def capture(kind: str, name: str, days: int, status: int, headers: Column) -> Column:
        return F.struct(
            F.concat(F.lit(f"urn:{name}:"), id_.cast("string")).alias("record_id"), F.lit(kind).alias("type"), F.col("url"), at(days).alias("date"), F.lit(status).alias("status"), headers.alias("headers"),
            F.lit(None).cast("binary").alias("payload"), F.lit(NOT_MODIFIED if kind == "revisit" else None).cast("string").alias("profile"), F.lit(None).cast("string").alias("refers_to"),
        )

    rows = F.filter(
        F.array(
            capture("response", "page", 0, 200, stored),
            F.when(odd, capture("revisit", "again", 1, 304, fresh)),
            F.when(F.pmod("page_id", F.lit(10)) == 0, capture("revisit", "before", -1, 304, fresh)),
        ),
        lambda c: c.isNotNull(),
    )
    return pages.select(F.explode(rows).alias("c")).select("c.*")
