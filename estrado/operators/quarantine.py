"""Errors kept apart by document: work that may raise runs under a guard for each row, and what fails goes to a log beside the good rows."""

from __future__ import annotations

import traceback
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ..session import shared_folder
from .chunking import chunk_documents

#: Rows that are worked on between two batches sent back.
STEP = 256
LOG = ("stage", "error_type", "message", "trace")


def guarded(rows: DataFrame, work: Callable[[dict], Iterable[dict]], schema: str, key: str, stage: str) -> tuple[DataFrame, DataFrame]:
    """Calls ``work`` with each row as a dictionary; it returns any number of rows of ``schema``. -> good (key, columns of schema), log (key, stage, error_type, message, trace).

    A row whose work raises is in the log alone, with nothing of what it gave before; the others go on. Results are stored, so that the work is done once.
    """
    spark = rows.sparkSession
    made = T._parse_datatype_string(schema)
    kind = to_arrow_type(made)
    types = [to_arrow_type(rows.schema[key].dataType), pa.list_(kind), *[pa.string()] * 3]
    names = [key, "_rows", *LOG[1:]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (whole.slice(at, STEP) for whole in batches for at in range(0, whole.num_rows, STEP)):
            out = []
            for row in b.to_pylist():
                try:
                    good = list(work(row))
                    pa.array(good, kind)  # a row that doesn't fit the schema is an error of its document
                    out.append((row[key], good, None, None, None))
                except Exception as e:  # noqa: BLE001
                    out.append((row[key], [], type(e).__name__, str(e), traceback.format_exc()))
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=names)

    path = f"{shared_folder(spark)}/guarded-{uuid.uuid4().hex}"
    told = T.StructType([rows.schema[key], T.StructField("_rows", T.ArrayType(made)), *(T.StructField(n, T.StringType()) for n in LOG[1:])])
    rows.mapInArrow(run, told).write.parquet(path)
    held = spark.read.schema(told).parquet(path)
    good = held.where("error_type is null").select(key, F.explode("_rows").alias("_row")).select(key, "_row.*")
    return good, held.where("error_type is not null").select(key, F.lit(stage).alias("stage"), *LOG[1:])


def decode(row: dict) -> list[dict]:
    return [{"contenido": row["content"].decode("utf-8")}]


def process_folder(spark: SparkSession, folder: str, prepare: Callable[[dict], Iterable[dict]] | None = None) -> tuple[DataFrame, DataFrame]:
    """Text files below ``folder`` -> chunks, log (path, stage, error_type, message, trace).

    Bytes that aren't UTF-8, documents for which ``prepare`` (path, contenido -> rows of contenido) raises, and documents without a chunk are in the log; all others are chunked.
    Files without a byte are skipped, as Spark's readers do.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.txt").load(folder).select("path", "content")
    docs, log = guarded(files, decode, "contenido string", "path", "lectura")
    if prepare:
        docs, more = guarded(docs, prepare, "contenido string", "path", "preparación")
        log = log.unionByName(more)
    chunks = chunk_documents(docs, "path", "contenido")
    none = docs.select("path").join(chunks.select("path").distinct(), "path", "left_anti")
    empty = none.select("path", F.lit("división").alias("stage"), F.lit("SinChunks").alias("error_type"), F.lit("cero chunks generados").alias("message"), F.lit(None).cast("string").alias("trace"))
    return chunks, log.unionByName(empty)
