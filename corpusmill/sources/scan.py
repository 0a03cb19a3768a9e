"""Source trees and archives as file tables."""

from __future__ import annotations

import io
import unicodedata
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from corpusmill.functions import paths as P

MAX_BYTES, MAX_RATIO = 1_000_000, 100


def decoded(content: Column) -> Column:
    """UTF-8 where the bytes are valid, a leading mark kept, else Latin-1: decoding never fails."""
    text = content.cast("string")
    return F.when(F.is_valid_utf8(text), text).otherwise(F.decode(content, "ISO-8859-1"))


def scan_tree(spark: SparkSession, root: str, most: int = MAX_BYTES) -> DataFrame:
    """path, size_bytes, modified, language, file_type, skip_reason, content_hash, content of every file under a folder.

    Skipped files keep their row but not their content; the first rule that holds names the reason.
    Spark's readers don't list files whose names begin with a dot or an underscore, nor empty ones.
    """
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    base = root.rstrip("/").removeprefix("file:").rstrip("/") + "/"
    rel = F.regexp_replace(F.regexp_replace("path", "^[a-z]+:/+", "/"), "^.*?" + _escaped(base.lstrip("/")), "")
    rows = raw.select(rel.alias("path"), F.col("length").alias("size_bytes"), F.col("modificationTime").alias("modified"), "content")
    reason = P.skip_reason(F.col("path"), F.col("size_bytes"), most)
    rows = rows.withColumns({"language": P.language(F.col("path")), "file_type": P.file_type(F.col("path")), "skip_reason": reason})
    took = F.col("skip_reason").isNull()
    return rows.withColumns({"content_hash": F.when(took, F.sha2("content", 256)), "text": F.when(took, decoded(F.col("content")))}).drop("content").withColumnRenamed("text", "content")


def _escaped(text: str) -> str:
    return "".join("\\" + c if c in r".+*?()[]{}^$|\\" else c for c in text)


@F.pandas_udf(StringType())
def normal_path(path: pd.Series) -> pd.Series:
    """NFC with forward slashes: Unicode normalisation is no Spark function."""
    return path.map(lambda p: unicodedata.normalize("NFC", p).replace("\\", "/") if p is not None else None)


@F.pandas_udf(StringType())
def path_identity(path: pd.Series) -> pd.Series:
    """What two paths have alike if a file system might take them for one."""
    return path.map(lambda p: unicodedata.normalize("NFC", p).replace("\\", "/").casefold() if p is not None else None)


def members(data: bytes, most: int = MAX_BYTES, total: int = 4096 << 20, files: int = 200_000) -> Iterator[tuple[str, int, str | None, bytes | None]]:
    """(path, size, reason, content) of an archive's files; a first pass over the directory rejects bad archives as a whole."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        infos = [i for i in z.infolist() if not i.is_dir()]
        seen, size = set(), 0
        for i in infos:
            name = unicodedata.normalize("NFC", i.filename).replace("\\", "/")
            parts = name.split("/")
            if name.startswith("/") or name[1:2] == ":" or any(p in ("", ".", "..") for p in parts) or len(parts) > 30 or any(ord(c) < 32 for c in name):
                raise ValueError(f"unsafe path {name!r}")
            if i.external_attr >> 16 & 0o170000 == 0o120000:
                raise ValueError(f"link {name!r}")
            if name.casefold() in seen:
                raise ValueError(f"path twice {name!r}")
            if i.compress_size and i.file_size / i.compress_size > MAX_RATIO:
                raise ValueError(f"compressed too well {name!r}")
            seen.add(name.casefold())
            size += i.file_size
        if len(infos) > files or size > total:
            raise ValueError("quota exceeded")
        for i in infos:
            name = unicodedata.normalize("NFC", i.filename).replace("\\", "/")
            if i.file_size > most:
                yield name, i.file_size, "file_too_large", None
            elif name.lower().endswith((".zip", ".tar", ".gz", ".7z", ".rar", ".jar")):
                yield name, i.file_size, "nested_archive", None
            else:
                yield name, i.file_size, None, z.read(i)


def scan_archives(spark: SparkSession, path: str) -> DataFrame:
    """archive, path, size_bytes, skip_reason, content of all zip files at a path; a bad archive is one row with its error."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for name, data in zip(frame["path"], frame["content"], strict=True):
                try:
                    rows = [(name, *m, None) for m in members(bytes(data))]
                except (ValueError, zipfile.BadZipFile) as e:
                    rows = [(name, None, 0, None, None, str(e))]
                if rows:
                    yield pd.DataFrame(rows, columns=["archive", "path", "size_bytes", "skip_reason", "content", "error"]).astype({"size_bytes": "int64"})

    raw = spark.read.format("binaryFile").load(path).select("path", "content")
    rows = raw.mapInPandas(run, "archive string, path string, size_bytes long, skip_reason string, content binary, error string")
    reason = F.coalesce("skip_reason", P.skip_reason(F.col("path"), F.col("size_bytes")))
    rows = rows.withColumn("skip_reason", F.when(F.col("error").isNull(), reason))
    return rows.withColumn("content", F.when(F.col("skip_reason").isNull(), F.col("content")))


def stale(files: DataFrame, finished_at: Column) -> DataFrame:
    """One row (stale, newer): whether any file changed after an index was finished."""
    newer = F.count_if(F.col("modified") > finished_at)
    return files.agg((newer > 0).alias("stale"), newer.alias("newer"))
