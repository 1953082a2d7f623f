"""The history of questions: batches that are appended, with numbers that no two writers share."""

from __future__ import annotations

import threading

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .upsert import latest_per_user, numbered_rows

SCHEMA = "id long, username string, query string, fecha string"
_here = threading.Lock()


class History:
    """A history in one folder. Each append takes the next number of a batch by creating its mark, which fails for all writers but one where the file system
    creates files exclusively, as HDFS does; a row's id is its batch's number times 2**32 and its place in the batch, from 1. So ids ascend from batch to batch and
    recur in none; the number of a batch that failed stays unused, and none of its rows is seen.
    """

    BATCH = 1 << 32

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._at = lambda name: jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        self._fs = self._at("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _reserve(self) -> int:
        marks = self._at("_batches")
        with _here:  # threads of one driver; writers of other drivers meet at the mark
            self._fs.mkdirs(marks)
            n = 1 + max((int(s.getPath().getName()) for s in self._fs.listStatus(marks)), default=0)
            while not self._created(n):
                n += 1
        return n

    def _created(self, n: int) -> bool:
        mark = self._at(f"_batches/{n}")
        try:
            self._fs.create(mark, False).close()
        except Exception:
            if not self._fs.exists(mark):
                raise
            return False
        return True

    def append(self, asked: DataFrame, now: str, order: str = "ord") -> int:
        """Appends asked (username, query, order), all at ``now``, numbered by ``order``; returns the batch's number."""
        batch = self._reserve()
        rows = numbered_rows(asked, batch * self.BATCH, now, order)
        rows.select("id", F.col("username").cast("string"), F.col("query").cast("string"), "fecha").write.parquet(f"{self.path}/rows/batch={batch}")
        return batch

    def read(self) -> DataFrame:
        """All rows: id, username, query, fecha; none before the first append."""
        if not self._fs.exists(self._at("rows")):
            return self.spark.createDataFrame([], SCHEMA)
        # a batch counts once its write is committed
        done = [s.getPath() for s in self._fs.globStatus(self._at("rows/batch=*/_SUCCESS"))]
        paths = [p.getParent().toString() for p in done]
        return self.spark.read.schema(SCHEMA).parquet(*paths) if paths else self.spark.createDataFrame([], SCHEMA)

    def latest(self, n: int = 20) -> DataFrame:
        """Each user's last ``n`` rows, newest first."""
        return latest_per_user(self.read(), n)
