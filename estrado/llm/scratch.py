"""Shared storage for intermediate tables.

Intermediate results that are read more than once, or whose lineage must be cut, are written as
Parquet below the folder named by ``spark.checkpoint.dir``, which every executor and the driver see.
See ``session.shared_folder``.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..session import shared_folder

_made: dict[str, list[str]] = {}


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    _made.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def stored(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` once and returns it as a scan of the written files: executors may be lost afterwards."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def step(spark: SparkSession, make: Callable[[], DataFrame], name: str, last: str = "") -> tuple[DataFrame, str]:
    """Stores what ``make`` returns and deletes the tables that were stored on the way, and ``last``, the path of the step before. Returns the table and its path."""
    made = _made.setdefault(spark.sparkContext.applicationId, [])
    start = len(made)
    out = stored(make(), name)
    for path in [*made[start:-1], *([last] if last else [])]:
        _delete(spark, path)
    del made[start:-1]
    return out, made[-1]


def release(spark: SparkSession) -> None:
    """Deletes what this application has stored. Results that are still lazy can't be read afterwards."""
    _delete(spark, shared_folder(spark))
    _made.pop(spark.sparkContext.applicationId, None)
