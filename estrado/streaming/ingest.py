"""A folder of new texts as a stream: chunked per micro-batch and merged into a keyed table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.acquire import not_held
from ..operators.chunking import chunk_documents
from ..operators.upsert import Collection
from ..sources.listing import Listing


def ingest(spark: SparkSession, folder: str, target: str, checkpoint: str) -> StreamingQuery:
    """Reads text files as they appear, and upserts their chunks; a batch that is run again gives the same table."""
    table = Collection(spark, target)
    texts = spark.readStream.schema("value string").option("wholetext", True).format("text").load(folder)
    docs = texts.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("contenido"))

    def batch(df: DataFrame, _: int) -> None:
        table.upsert(chunk_documents(df))

    return docs.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def listed_norms(spark: SparkSession, held: DataFrame, late: str = "90 days", **options: str) -> DataFrame:
    """The paged listing as a stream of norms that ``held`` (numero, anio) lacks, each taken once: ``options`` are those of ``sources.listing`` and lookbackDays.

    Each batch reads from the last one's newest date less the look-back; state drops what comes again, and the anti-join what is held.
    """
    spark.dataSource.register(Listing)
    listed = spark.readStream.format("norm_listing").options(dated="true", **options).load().withColumn("visto", F.col("fecha").cast("timestamp"))
    return not_held(new_norms(listed, late), held)


def new_norms(listing: DataFrame, late: str = "90 days") -> DataFrame:
    """A stream of listings without repeats of (numero, anio): the stateful form of the anti-join, with state kept for ``late``."""
    return listing.withWatermark("visto", late).dropDuplicatesWithinWatermark(["numero", "anio"])
