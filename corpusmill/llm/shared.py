"""Where intermediate results are written, so that lost executors cost no recomputation."""

from __future__ import annotations

from pyspark.sql import SparkSession

from corpusmill.functions.tables import cut, scratch, shared_dir

__all__ = ["cut", "partitions", "scratch", "shared_dir"]


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
