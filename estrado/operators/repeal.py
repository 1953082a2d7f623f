"""Repeals of norms: from the text of chunks, from file names, and both unified."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.chunks import file_doc_id, full_year, norm_number
from ..functions.text import collapse

# Patterns of repeal clauses.
REPEAL = r"(?iu)(DER[ÓO]GASE|DER[ÓO]GANSE)\s+(la|las)\s+Ordenanzas?(\s+[^\n]{0,400})"
NUMBER = r"(?iu)(?:n[º°]\s*)?(\d{1,2}(?:\.\d{3})*|\d{3,6})\s*\/\s*(\d{2,4})"
PARTIAL = r"(?iuU)\b(art[íi]culos?|art\.?)\b"
MARK = r"(?i)DEROGAD[AO]S?"
LOOK, EVIDENCE = 80, 200


def is_partial(rest: Column) -> Column:
    return F.substring(rest, 1, LOOK).rlike(PARTIAL)


def text_events(chunks: DataFrame) -> DataFrame:
    """chunks (chunk_id, texto, doc_id) -> one event per repealed norm of each total repeal clause."""
    # few texts hold the letters that a clause begins with: only these are searched
    m = chunks.where(F.lower("texto").contains("der")).select("chunk_id", "doc_id", F.explode(F.regexp_extract_all("texto", F.lit(REPEAL), F.lit(0))).alias("m"))
    m = m.select("chunk_id", "doc_id", "m", F.regexp_extract("m", REPEAL, 3).alias("rest")).where(~is_partial(F.col("rest")))
    numbers = F.arrays_zip(F.regexp_extract_all("rest", F.lit(NUMBER), F.lit(1)).alias("n"), F.regexp_extract_all("rest", F.lit(NUMBER), F.lit(2)).alias("y"))
    m = m.select("chunk_id", "doc_id", "m", F.explode(numbers).alias("x"))
    said = collapse(F.col("m"))
    return m.select(
        F.col("doc_id").alias("doc_id_derogatorio"),
        F.concat(F.lit("ordenanza_"), norm_number(F.col("x.n")).cast("long").cast("string"), F.lit("_"), full_year(F.col("x.y")).cast("string")).alias("doc_id_derogado"),
        F.upper(F.regexp_extract("m", REPEAL, 1)).alias("verbo"),
        F.when(F.length(said) > EVIDENCE, F.concat(F.substring(said, 1, EVIDENCE), F.lit("..."))).otherwise(said).alias("texto_evidencia"),
        F.col("chunk_id").alias("chunk_id_origen"))


def is_marked(name: Column) -> Column:
    return name.rlike(MARK)


def file_events(files: DataFrame) -> DataFrame:
    """files (carpeta, nombre) -> events of files whose name is marked as repealed and has number and year in front."""
    kind = F.translate(F.lower("carpeta"), "óáíéú", "oaieu")
    d = files.where(is_marked(F.col("nombre"))).select(file_doc_id(F.col("nombre"), kind).alias("doc_id_derogado"), F.col("nombre").alias("nombre_archivo"), kind.alias("tipo_norma"),
                                                        F.regexp_extract("nombre", MARK, 0).alias("marca_encontrada"), F.lit("filename").alias("fuente"))
    return d.where("doc_id_derogado is not null")


def unify(text: DataFrame, files: DataFrame) -> DataFrame:
    """All text events, told whether a file name confirms them, and those file events whose norm no text repeals; fuentes lists where each is from."""
    # one full join, so that texts are searched once; a norm's files (few) are one row of it, which comes back as its rows where no text repeals the norm
    named = files.drop("fuente").groupBy("doc_id_derogado").agg(F.collect_list(F.struct(*(c for c in files.columns if c not in ("doc_id_derogado", "fuente")))).alias("_files"))
    j = text.withColumn("_t", F.lit(True)).join(named, "doc_id_derogado", "full_outer")
    kept = F.when(F.col("_t"), F.slice("_files", 1, 0)).otherwise(F.col("_files"))
    said = F.when(F.col("_t") & F.col("_files").isNotNull(), F.array(F.lit("texto"), F.lit("filename"))).when(F.col("_t"), F.array(F.lit("texto"))).otherwise(F.array(F.lit("filename")))
    j = j.withColumn("fuentes", said).select("*", F.explode_outer(kept).alias("_file"))
    more = [c for c in files.columns if c not in ("doc_id_derogado", "fuente")]
    both = [c for c in more if c in text.columns]
    cols = [F.coalesce(c, f"_file.{c}").alias(c) if c in both else F.col(c) for c in text.columns]
    return j.select(*cols, "fuentes", *(F.col(f"_file.{c}").alias(c) for c in more if c not in both))


def compare(text: DataFrame, files: DataFrame) -> DataFrame:
    """One row: how many norms only the text, only the names, both, or either repeal, and the gain in coverage by the names in per cent."""
    a = text.select("doc_id_derogado").distinct().withColumn("t", F.lit(1))
    b = files.select("doc_id_derogado").distinct().withColumn("f", F.lit(1))
    j = a.join(b, "doc_id_derogado", "full_outer")
    has = lambda c: F.col(c).isNotNull()
    n = lambda cond: F.coalesce(F.sum(F.when(cond, 1).otherwise(0)), F.lit(0))
    d = j.agg(n(has("t") & ~has("f")).alias("solo_texto"), n(~has("t") & has("f")).alias("solo_filename"), n(has("t") & has("f")).alias("ambos"), F.count(F.lit(1)).alias("union_total"))
    return d.withColumn("ganancia_pct", F.round(F.try_divide(F.col("solo_filename") * 100.0, F.col("solo_texto") + F.col("ambos")), 1))


def present(events: DataFrame, docs: DataFrame, by_id: bool = False) -> DataFrame:
    """Distinct repealed norms that are among docs (doc_id, tipo_norma, numero, anio): by kind, number and year, or by equal identifiers."""
    ids = events.select("doc_id_derogado").distinct()
    if by_id:
        return ids.join(docs.select(F.col("doc_id").alias("doc_id_derogado")), "doc_id_derogado", "left_semi")
    have = docs.select(F.concat_ws("_", "tipo_norma", F.col("numero").cast("long").cast("string"), F.col("anio").cast("string")).alias("doc_id_derogado"))
    return ids.join(have, "doc_id_derogado", "left_semi")


def by_source(events: DataFrame) -> DataFrame:
    """doc_id_derogatorio, eventos (sorted), n: a repealing norm's events. Their number is that of the numbers in one norm."""
    e = F.struct("doc_id_derogado", "verbo", "chunk_id_origen")
    return events.groupBy("doc_id_derogatorio").agg(F.array_sort(F.collect_list(e)).alias("eventos"), F.count(F.lit(1)).alias("n"))


def counts(events: DataFrame) -> DataFrame:
    """One row: events, distinct repealing and repealed norms, and norms that are both."""
    a = events.select(F.col("doc_id_derogatorio").alias("id"), F.lit(1).alias("a"), F.lit(0).alias("b"))
    b = events.select(F.col("doc_id_derogado").alias("id"), F.lit(0).alias("a"), F.lit(1).alias("b"))
    per = a.unionByName(b).groupBy("id").agg(F.sum("a").alias("a"), F.max("a").alias("da"), F.max("b").alias("db"))
    n = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    return per.agg(n(F.col("a")).alias("eventos"), n(F.col("da")).alias("derogatorias"), n(F.col("db")).alias("derogadas"), n(F.col("da") * F.col("db")).alias("ambas"))
