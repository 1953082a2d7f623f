"""Keyed tables of plain Parquet, partitioned by a hash of the key: idempotent upsert, sanitised export, query history."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import shared_folder


def merged(existing: DataFrame, incoming: DataFrame, key: str = "chunk_id", order: str | None = None) -> DataFrame:
    """Existing rows without a newer one, and the incoming rows; of incoming rows with one key the last by ``order``, or else by their place in the input, wins."""
    last = F.desc(order) if order else F.desc("_place")
    w = Window.partitionBy(key).orderBy(last)
    incoming = incoming.withColumn("_place", F.monotonically_increasing_id()).withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n", "_place", *([order] if order else []))
    return existing.join(incoming.select(key), key, "left_anti").unionByName(incoming, allowMissingColumns=True)


class Collection:
    """A keyed table in one folder: plain Parquet in partitions by a hash of the key. An upsert reads and replaces only the partitions that its keys fall in.

    For folders without a catalog; see ``collections.Catalogued`` for tables of one. Key and number of buckets are stored in the folder; opening it with others is an error. A new
    collection is empty, with the columns of ``schema``.
    """

    def __init__(self, spark: SparkSession, path: str, key: str = "chunk_id", buckets: int = 64, schema: str | None = None):
        self.spark, self.path, self.key, self.buckets, self.schema = spark, path.rstrip("/"), key, buckets, schema
        if self._there("_about"):
            told = tuple(spark.read.parquet(f"{self.path}/_about").select("key", "buckets").first())
            if told != (key, buckets):
                raise ValueError(f"{path} has key {told[0]} and {told[1]} buckets, not {key} and {buckets}")

    def _there(self, name: str = "") -> bool:
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}".rstrip("/"))
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(p)

    def _table(self) -> DataFrame | None:
        return self.spark.read.option("mergeSchema", "true").parquet(self.path) if self._there("_about") else None

    def read(self) -> DataFrame:
        have = self._table()
        return have.drop("_bucket") if have else self.spark.createDataFrame([], self.schema or f"{self.key} string")

    def upsert(self, incoming: DataFrame, order: str | None = None) -> int:
        """Merges ``incoming`` into the table and returns the table's number of rows. A run that is repeated gives the same table."""
        bucket = F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")
        incoming, have = incoming.withColumn("_bucket", bucket), self._table()
        touched = [r[0] for r in incoming.select("_bucket").distinct().collect()]  # at most ``buckets``
        if not touched:
            return have.count() if have else 0
        old = have.where(F.col("_bucket").isin(touched)) if have else incoming.limit(0).drop(*([order] if order else []))
        staged = f"{shared_folder(self.spark)}/upsert-{uuid.uuid4().hex}"  # the partitions that are read can't be written over
        merged(old, incoming, self.key, order).write.parquet(staged)
        new = self.spark.read.parquet(staged).repartition("_bucket")
        new.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("_bucket").parquet(self.path)
        if not have:
            self.spark.createDataFrame([(self.key, self.buckets)], "key string, buckets int").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/_about")
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(staged)
        at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
        return self._table().count()


def sanitized(df: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Columns as a flat store takes them: scalars as they are, lists and structs as JSON text, an empty list as empty text."""
    out = []
    for f in df.schema.fields:
        c: Column = F.col(f.name)
        if f.name not in keep and isinstance(f.dataType, T.ArrayType):
            c = F.when(F.size(c) == 0, "").otherwise(F.to_json(c))
        elif f.name not in keep and isinstance(f.dataType, (T.StructType, T.MapType)):
            c = F.to_json(c)
        elif f.name not in keep and isinstance(f.dataType, (T.DateType, T.TimestampType, T.DecimalType, T.BinaryType)):
            c = c.cast("string")
        out.append(c.alias(f.name))
    return df.select(*out)


def metadata_json(df: DataFrame) -> DataFrame:
    """One JSON text per row, null fields left out."""
    flat = sanitized(df)
    return flat.select(F.to_json(F.struct(*flat.columns)).alias("metadata"))


def history_rows(history: DataFrame, asked: DataFrame, now: str) -> DataFrame:
    """asked (username, query, ord) -> rows to append: id goes on from the largest in the order of ``ord``, fecha is ``now``. For one writer; see ``history.History``."""
    return numbered_rows(asked, history.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0], now)


def numbered_rows(asked: DataFrame, top: int, now: str, order: str = "ord") -> DataFrame:
    """asked (username, query, order) -> id, username, query, fecha: ids go on from ``top``.

    Numbers are counted by range of ``order``, each in a task of its own, and then offset by the ranges before.
    """
    parts = f"{shared_folder(asked.sparkSession)}/asked-{uuid.uuid4().hex}"
    asked.repartitionByRange(order).withColumn("_p", F.spark_partition_id()).write.parquet(parts)
    rows = asked.sparkSession.read.parquet(parts)
    sizes = rows.groupBy("_p").agg(F.count(F.lit(1)).alias("_size"))
    before = sizes.withColumn("_before", F.coalesce(F.sum("_size").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))  # a row per range
    n = F.row_number().over(Window.partitionBy("_p").orderBy(order))
    numbered = rows.withColumn("_n", n).join(F.broadcast(before), "_p")
    return numbered.select((F.lit(top) + F.col("_before") + F.col("_n")).cast("long").alias("id"), "username", "query", F.lit(now).alias("fecha"))


def latest_per_user(history: DataFrame, n: int = 20, user: str = "username", order: str = "id") -> DataFrame:
    """Each user's last ``n`` rows, newest first, with their place."""
    w = Window.partitionBy(user).orderBy(F.desc(order))
    return history.withColumn("lugar", F.row_number().over(w)).where(F.col("lugar") <= n)
