"""Tables written between steps, and numbering of rows without a task that sees them all."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of ``spark.checkpoint.dir``; one of this machine only where Spark runs on it alone."""
    sc = spark.sparkContext
    current = sc._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    told = spark.conf.get("spark.checkpoint.dir", None)
    if not told and not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    sc.setCheckpointDir(told or tempfile.mkdtemp(prefix="corpusmill-"))
    return sc._jsc.sc().getCheckpointDir().get()


_MADE: ContextVar[list[str] | None] = ContextVar("_MADE", default=None)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Removes, at its end, the tables that ``cut`` wrote inside it; one written with ``stay`` is left for what comes after."""
    made: list[str] = []
    token = _MADE.set(made)
    try:
        yield
    finally:
        _MADE.reset(token)
        for path in made:
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def cut(df: DataFrame, stay: bool = False) -> DataFrame:
    """``df``, computed now and kept as a table in the shared folder, so that lost executors cost no recomputation.

    A table, not a checkpoint: what a checkpoint knows about its plan makes the plans of
    later rounds ever slower to optimise, and a table has sizes that joins can go by.
    """
    path = f"{shared_dir(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    made = _MADE.get()
    if made is not None and not stay:
        made.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def numbered(df: DataFrame, order: list[str | Column], name: str, start: int = 0) -> DataFrame:
    """``df`` with ``name``: places from ``start`` in the given order, in which no two rows may be equal.

    Rows are sorted in ranges, written with their places inside these, and the ranges' sizes
    are summed: one row for each range is all that a single task sees.
    """
    ranges = cut(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_m", F.monotonically_increasing_id()))
    part, place = F.shiftright("_m", 33), F.col("_m").bitwiseAND((1 << 33) - 1)
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    sizes = ranges.groupBy(part.alias("_p")).agg(F.count("*").alias("_n")).select("_p", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    return ranges.withColumn("_p", part).join(sizes, "_p").withColumn(name, F.col("_before") + place + start).drop("_m", "_p", "_before")
