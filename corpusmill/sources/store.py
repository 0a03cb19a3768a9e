"""Versioned tables on shared storage: written once, verified, and made current by adding one small file."""

from __future__ import annotations

import json
import re
import uuid
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.operators.fusion import canonical_json

_NAME = re.compile(r"^[a-z0-9][a-z0-9_.-]{0,63}$")


class Store:
    """``base/<repository>/v=<n>/<table>`` with a manifest per version and a pointer to the active one.

    Files go through Hadoop's file system, so any path that Spark reads will do.
    """

    def __init__(self, spark: SparkSession, base: str, repository: str):
        if not _NAME.match(repository):
            raise ValueError("bad repository name")
        self.spark, self.root = spark, f"{base.rstrip('/')}/{repository}"
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def path(self, version: int, table: str) -> str:
        if not _NAME.match(table) or version < 1:
            raise ValueError("bad table or version")
        return f"{self.root}/v={version}/{table}"

    def write(self, version: int, table: str, df: DataFrame) -> None:
        """Writes a table of a version; a version is immutable once its manifest is there."""
        if self.manifest(version):
            raise ValueError(f"version {version} is published")
        df.write.mode("overwrite").parquet(self.path(version, table))

    def read(self, table: str, version: int | None = None) -> DataFrame:
        version = version or self.active()
        if not version:
            raise ValueError("no active version")
        return self.spark.read.parquet(self.path(version, table))

    def digest(self, version: int, table: str) -> dict:
        """Rows, and an order-free digest of all rows."""
        df = self.spark.read.parquet(self.path(version, table))
        row = df.select(F.xxhash64(*df.columns).cast("decimal(38,0)").alias("h")).agg(F.count("*").alias("rows"), F.coalesce(F.sum("h"), F.lit(0)).cast("string").alias("digest")).first()
        return {"rows": row.rows, "digest": row.digest, "schema": df.schema.simpleString()}

    def publish(self, version: int, tables: list[str]) -> dict:
        """Verifies that all tables can be read and writes the version's manifest."""
        body = {"version": version, "tables": {t: self.digest(version, t) for t in sorted(set(tables))}}
        old = self.manifest(version)
        if old and old["tables"] != body["tables"]:
            raise ValueError(f"version {version} is published with other content")
        self._put(f"{self.root}/v={version}/manifest.json", canonical_json(body))
        return body

    def verify(self, version: int) -> list[str]:
        """Tables whose content is not what the manifest says."""
        manifest = self.manifest(version)
        if not manifest:
            raise ValueError(f"version {version} is not published")
        return [t for t, d in manifest["tables"].items() if self.digest(version, t) != d]

    def activate(self, version: int, expected: int | None) -> None:
        """Makes a published version the current one if the current one is what the caller takes it for. Repeating it is fine.

        Each activation is a file of its own, numbered one up and created only if there is
        none: of two that start from the same state one wins, and a crash leaves the last whole one.
        """
        last, now = self._last()
        if now == version:
            return
        if not self.manifest(version):
            raise ValueError(f"version {version} is not published")
        if now != expected or not self._claim(f"{self.root}/active/{last + 1:012d}.json", canonical_json({"version": version, "at": datetime.now(UTC).isoformat()})):
            raise ValueError("another version became active")

    def active(self) -> int | None:
        return self._last()[1]

    def _last(self) -> tuple[int, int | None]:
        """Number and version of the last activation."""
        folder = self._path(f"{self.root}/active")
        names = sorted(s.getPath().getName() for s in self._fs.listStatus(folder)) if self._fs.exists(folder) else []
        names = [n for n in names if n.endswith(".json")]
        return (int(names[-1][:12]), json.loads(self._get(f"{self.root}/active/{names[-1]}"))["version"]) if names else (0, None)

    def _claim(self, path: str, text: str) -> bool:
        """Moves a whole file to ``path`` unless there is one."""
        new, to = self._path(f"{self.root}/claims/{uuid.uuid4().hex}"), self._path(path)
        out = self._fs.create(new, True)
        out.write(bytearray(text.encode()))
        out.close()
        self._fs.mkdirs(to.getParent())
        if self._fs.exists(to) or not self._fs.rename(new, to):  # a rename onto a file fails
            self._fs.delete(new, False)
            return False
        return True

    def manifest(self, version: int) -> dict | None:
        got = self._get(f"{self.root}/v={version}/manifest.json")
        return json.loads(got) if got else None

    def versions(self) -> list[int]:
        if not self._fs.exists(self._path(self.root)):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(self._path(self.root))]
        return sorted(int(n[2:]) for n in names if n.startswith("v="))

    def drop(self, version: int) -> None:
        if version == self.active():
            raise ValueError("the active version stays")
        self._fs.delete(self._path(f"{self.root}/v={version}"), True)

    def delete(self) -> None:
        self._fs.delete(self._path(self.root), True)

    def _put(self, path: str, text: str) -> None:
        new = self._path(path + ".new")
        out = self._fs.create(new, True)
        out.write(bytearray(text.encode()))
        out.close()
        if self._fs.exists(self._path(path)):
            self._fs.delete(self._path(path), False)
        self._fs.rename(new, self._path(path))

    def _get(self, path: str) -> str | None:
        if not self._fs.exists(self._path(path)):
            return None
        return "\n".join(r.value for r in self.spark.read.text(path, wholetext=True).collect())


def json_report(rows: DataFrame) -> DataFrame:
    """(line, sha256): rows as canonical JSON, keys sorted."""
    line = F.to_json(F.struct(*sorted(rows.columns)))
    return rows.select(line.alias("line"), F.sha2(line, 256).alias("sha256"))


CASES = "id string, category string, question string, expected array<string>, should_answer boolean, max_results int"


def read_cases(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Evaluation cases of a JSON list, and (id, problem) rows of what is wrong with them; a sound set has none."""
    rows = spark.read.schema(CASES + ", _corrupt string").option("multiLine", True).option("columnNameOfCorruptRecord", "_corrupt").json(path)
    from corpusmill.functions.text import empty

    checks = {
        "unreadable": F.col("_corrupt").isNull(), "id_shape": F.col("id").rlike("^[a-z0-9][a-z0-9_-]{0,63}$"), "question_missing": F.trim(empty(F.col("question"))) != "",
        "expected_missing": ~F.coalesce("should_answer", F.lit(True)) | (F.size(F.coalesce("expected", F.array())) > 0), "max_results_range": F.coalesce(F.col("max_results").between(1, 100), F.lit(True)),
    }
    bad = F.array_compact(F.array(*[F.when(~F.coalesce(c, F.lit(False)), F.lit(k)) for k, c in checks.items()]))
    twice = rows.groupBy("id").count().filter("count > 1").select("id", F.lit("id_twice").alias("problem"))
    return rows.drop("_corrupt"), rows.select("id", F.explode(bad).alias("problem")).union(twice)
