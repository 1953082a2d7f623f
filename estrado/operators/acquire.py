"""Acquisition: listings to new norms, their texts, and the routes of those that can't be taken."""

from __future__ import annotations

import uuid
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions import chunks as c


def parsed(listing: DataFrame, date: str = "fecha_texto") -> DataFrame:
    """Rows whose Spanish date can be read, with it as ``fecha``."""
    return listing.withColumn("fecha", c.spanish_date(F.col(date))).where("fecha is not null")


def in_window(norms: DataFrame, months: int, now: Column, date: str = "fecha") -> DataFrame:
    """Norms of the last ``months`` months of 30 days; all of them if months isn't positive."""
    return norms if months <= 0 else norms.where(F.col(date) >= now - F.expr(f"interval {30 * months} days"))


def not_held(norms: DataFrame, held: DataFrame) -> DataFrame:
    """Norms without a (numero, anio) in ``held``."""
    return norms.join(held.select("numero", "anio").distinct(), ["numero", "anio"], "left_anti")


def held_from_names(files: DataFrame, name: str = "nombre") -> DataFrame:
    """numero, anio of files whose name has them in front."""
    n, y = (F.regexp_extract(name, c.FILE_NAME, g).try_cast("int") for g in (1, 2))
    return files.select(n.alias("numero"), y.alias("anio")).where("numero is not null")


def as_documents(norms: DataFrame, fetched: Column) -> DataFrame:
    """norms (tipo, numero, anio, url_pdf, resumen, texto) -> nombre, contenido: text files with a header."""
    f = [F.col(x) for x in ("tipo", "numero", "anio", "url_pdf", "resumen", "texto")]
    return norms.select(c.file_name(f[1], f[2], f[4]).alias("nombre"), c.synthetic_document(*f, fetched).alias("contenido"))


def routed(docs: DataFrame, status: str = "status", good: str = "ok") -> tuple[DataFrame, DataFrame]:
    """Rows to keep, and rows for the dead-letter folder."""
    ok = F.col(status).eqNullSafe(good)
    return docs.where(ok), docs.where(~ok)


def observed(norms: DataFrame, found: str = "en_ventana", held: str = "ya_existe", status: str = "status") -> tuple[DataFrame, Observation]:
    """``norms`` (booleans ``found`` and ``held``, status) and the seven counters of a run over them, which come with whatever is done with the rows: no pass of their own.

    Read them from the second value's ``get`` once the rows are written: descubiertas, en_ventana, ya_existen, ok, fallidas_validacion, errores_descarga, errores_extraccion.
    """
    counters = Observation(f"acquisition-{uuid.uuid4().hex}")
    many = lambda c: F.count(F.when(c, 1))
    new = F.col(found) & ~F.col(held)
    state = lambda *s: many(new & F.col(status).isin(*s))
    told = norms.observe(
        counters, F.count(F.lit(1)).alias("descubiertas"), many(F.col(found)).alias("en_ventana"), many(F.col(found) & F.col(held)).alias("ya_existen"), state("ok", "ok_dry_run").alias("ok"),
        state("fallido_validacion").alias("fallidas_validacion"), state("error_descarga").alias("errores_descarga"), state("error_extraccion").alias("errores_extraccion"))
    return told, counters


def status_counts(docs: DataFrame, status: str = "status") -> DataFrame:
    return docs.groupBy(status).agg(F.count(F.lit(1)).alias("n"))


def write_texts(docs: DataFrame, path: str) -> None:
    """docs (nombre, contenido) as text files, each in a folder of its name (``nombre=...``), with the name read back as a column."""
    docs.select("nombre", "contenido").repartition("nombre").write.mode("append").option("lineSep", "\n").partitionBy("nombre").text(path)


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """nombre, contenido of what ``write_texts`` has written; the line separator at a file's end is not part of the text."""
    d = spark.read.text(path, wholetext=True)
    return d.select(F.col("nombre").cast("string").alias("nombre"), F.regexp_replace("value", r"\n$", "").alias("contenido"))


def copy_selected(selected: DataFrame, path: str) -> DataFrame:
    """Writes the files that ``selected`` (path, URL-encoded or not) names as texts below ``path`` and returns ``selected`` with path_destino.
    Contents are read and written by the tasks."""
    spark = selected.sparkSession
    names = [unquote(r[0]) for r in selected.select("path").collect()]  # a sample by quotas
    if names:
        d = spark.read.text(names, wholetext=True).select(_plain(F.col("_metadata.file_path")).alias("nombre"), F.col("value").alias("contenido"))
        write_texts(d, path)
    return selected.withColumn("path_destino", F.concat(F.lit(path.rstrip("/") + "/nombre="), _plain(F.col("path"))))


def _plain(path: Column) -> Column:
    """The last part of a path, decoded; a plus sign stays one."""
    return F.url_decode(F.replace(F.element_at(F.split(path, "/"), -1), F.lit("+"), F.lit("%2B")))
