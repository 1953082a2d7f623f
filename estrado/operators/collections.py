"""Catalogued collections: bucketed tables of the session's catalog whose key, number of buckets and version stand in their own properties.

An upsert appends its rows, bucketed like the table, with the next version; reading keeps the last version of each key within its bucket, so that neither reading nor a join on
the key moves the stored side, and an upsert costs what it brings. ``compact`` drops what has been replaced. With a metastore the collections outlive the session.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import shared_folder

MARK, VERSION = "estrado.", "_version"


def _properties(spark: SparkSession, name: str) -> dict[str, str]:
    return {r["key"].removeprefix(MARK): r["value"] for r in spark.sql(f"SHOW TBLPROPERTIES {name}").collect() if r["key"].startswith(MARK)}


class Catalogued:
    """Gets the collection ``name``, or creates it with ``schema`` (a DDL string or a StructType), in a folder of its own if ``path`` is told. Another key or number of buckets than the
    stored ones is an error."""

    def __init__(self, spark: SparkSession, name: str, schema: str | T.StructType | None = None, key: str = "chunk_id", buckets: int = 64, path: str | None = None):
        self.spark, self.name, self.key, self.buckets = spark, name, key, buckets
        if not spark.catalog.tableExists(name):
            if schema is None:
                raise ValueError(f"there is no collection {name}, and no schema to create it with")
            fields = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
            columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)
            at = f"LOCATION '{path}'" if path else ""
            spark.sql(f"CREATE TABLE {name} ({columns}, {VERSION} BIGINT) USING parquet CLUSTERED BY ({key}) SORTED BY ({key}) INTO {buckets} BUCKETS {at} TBLPROPERTIES ('{MARK}key'='{key}', '{MARK}buckets'='{buckets}', '{MARK}version'='0')")
        told = _properties(spark, name)
        if (told.get("key"), told.get("buckets")) != (key, str(buckets)):
            raise ValueError(f"{name} has key {told.get('key')} and {told.get('buckets')} buckets, not {key} and {buckets}")

    def read(self) -> DataFrame:
        """The last version of each key."""
        w = Window.partitionBy(self.key).orderBy(F.desc(VERSION))
        return self.spark.table(self.name).withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n", VERSION)

    def upsert(self, incoming: DataFrame, order: str | None = None) -> int:
        """Adds and replaces rows; of rows with one key the last by ``order``, or else by their place in the input, wins. Returns the number of keys.

        Columns that the collection lacks are added to it, those that ``incoming`` lacks are null. A run that is repeated leaves the same collection.
        """
        w = Window.partitionBy(self.key).orderBy(F.desc(order if order else "_place"))
        rows = incoming.withColumn("_place", F.monotonically_increasing_id()).repartition(self.buckets, self.key).withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n", "_place", *([order] if order else []))
        have = self.spark.table(self.name).columns
        more = [f for f in rows.schema if f.name not in have]
        if more:
            self.spark.sql(f"ALTER TABLE {self.name} ADD COLUMNS ({', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in more)})")
        schema = self.spark.table(self.name).schema
        version = int(_properties(self.spark, self.name)["version"]) + 1
        rows = rows.withColumn(VERSION, F.lit(version).cast("long"))
        rows = rows.select(*(F.col(f.name).cast(f.dataType) if f.name in rows.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in schema))
        path = f"{shared_folder(self.spark)}/batch-{uuid.uuid4().hex}"
        rows.write.parquet(path)  # an input that reads the collection itself is read before it changes
        batch = self.spark.read.schema(rows.schema).parquet(path)
        batch.repartition(self.buckets, self.key).write.insertInto(self.name)
        self.spark.sql(f"ALTER TABLE {self.name} SET TBLPROPERTIES ('{MARK}version'='{version}')")
        return batch.count()

    def compact(self) -> None:
        """Writes the collection anew without the rows that have been replaced; a copy stands in the shared folder meanwhile."""
        path = f"{shared_folder(self.spark)}/compact-{uuid.uuid4().hex}"
        rows = self.read().withColumn(VERSION, F.lit(int(_properties(self.spark, self.name)["version"])).cast("long"))
        rows.write.parquet(path)
        schema = self.spark.table(self.name).schema
        self.spark.read.schema(rows.schema).parquet(path).select(*(f.name for f in schema)).repartition(self.buckets, self.key).write.insertInto(self.name, overwrite=True)


def collections(spark: SparkSession, database: str = "default") -> DataFrame:
    """name, key, buckets, version of the collections of a database."""
    rows = []
    for t in spark.catalog.listTables(database):
        if not t.isTemporary and (p := _properties(spark, f"{database}.{t.name}")):
            rows.append((t.name, p["key"], int(p["buckets"]), int(p["version"])))
    return spark.createDataFrame(rows, "name string, key string, buckets int, version long")
