"""Text corpora in folders by kind of norm, and JSON files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.chunks import file_year


def documents(spark: SparkSession, folder: str) -> DataFrame:
    """path, carpeta, nombre, contenido of the text files one level of folders below ``folder``, whole."""
    d = spark.read.text(f"{folder.rstrip('/')}/*/*.txt", wholetext=True)
    path = F.col("_metadata.file_path")
    return d.select(path.alias("path"), F.element_at(F.split(path, "/"), -2).alias("carpeta"), F.col("_metadata.file_name").alias("nombre"), F.col("value").alias("contenido"))


def first_documents(docs: DataFrame, n: int, path: str = "path") -> DataFrame:
    """The first ``n`` documents in the order of their paths; the others aren't sorted."""
    return docs.orderBy(path).limit(n)


def files(spark: SparkSession, folder: str) -> DataFrame:
    """path, tipo, nombre, bytes, anio of all text files below ``folder``, at any depth; tipo is the first folder. Contents aren't read."""
    root = folder.rstrip("/")
    d = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.txt").load(root).select("path", "length")
    rest = F.regexp_extract("path", r"\Q" + root.split("://", 1)[-1] + r"\E/(.*)", 1)
    name = F.element_at(F.split(F.col("path"), "/"), -1)
    d = d.select("path", F.substring_index(rest, "/", 1).alias("tipo"), name.alias("nombre"), F.col("length").alias("bytes"), file_year(name).alias("anio"))
    return d.where("tipo <> nombre")


def json_rows(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of JSON files that hold one array each, by an explicit schema."""
    return spark.read.schema(schema).option("multiLine", True).json(path)
