"""Corpus analytics: counts by kind, epoch and route, histograms, largest documents, quality reports, stratified samples."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import quality
from ..functions.chunks import epoch, size_class
from ..session import shared_folder
from .sizes import small

#: Bounds of the histogram of chunks per document, quotas of the samplers, the seed.
BUCKETS = ((1, "1"), (5, "2-5"), (20, "6-20"), (100, "21-100"))
PILOT = {"Ordenanza": {"corto": 60, "medio": 20, "largo": 8}, "Resolución": {"corto": 5, "medio": 2, "largo": 1}, "Comunicación": {"corto": 3, "medio": 1, "largo": 0}}
INSPECTION = {"articulo": 15, "articulo_largo_parte": 10, "anexo": 8, "anexo_parte": 15, "doc_completo": 8, "fallback_caracteres": 8}
LEAST_OLD, LEAST_RECENT, SEED = 2, 2, 42


def by_kind(chunks: DataFrame, kind: str = "tipo_chunk", chars: str = "char_count") -> DataFrame:
    return chunks.groupBy(kind).agg(F.count(F.lit(1)).alias("n"), F.sum(chars).alias("chars"), F.min(chars).alias("minimo"), F.max(chars).alias("maximo"), F.floor(F.sum(chars) / F.count(chars)).cast("long").alias("promedio"))


def by_epoch(docs: DataFrame, year: str = "anio") -> DataFrame:
    return docs.groupBy(epoch(F.col(year)).alias("epoca")).agg(F.count(F.lit(1)).alias("n"))


def routes(chunks: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, camino: how each document was cut; documents that have only articles of annexes or empty annexes are ``indefinido``."""
    has = lambda *kinds: F.max(F.col("tipo_chunk").isin(*kinds))
    d = chunks.groupBy(key).agg(has("doc_completo").alias("a"), has("articulo", "articulo_largo_parte", "anexo", "anexo_parte").alias("b"), has("fallback_caracteres").alias("c"))
    return d.select(key, F.when(F.col("a"), "camino_1_corto").when(F.col("b"), "camino_2_articulos_o_anexos").when(F.col("c"), "camino_3_fallback").otherwise("indefinido").alias("camino"))


def shares(rows: DataFrame, by: str) -> DataFrame:
    """by, n, pct: rows of each value and their share of all in percent, one decimal."""
    n = rows.groupBy(by).agg(F.count(F.lit(1)).alias("n"))
    total = n.agg(F.sum("n").alias("total"))  # one row
    return n.crossJoin(F.broadcast(total)).select(by, "n", F.round(F.col("n") * 100.0 / F.col("total"), 1).alias("pct"))


def suspicious(chunks: DataFrame, found: DataFrame) -> DataFrame:
    """One row: total_chunks, sospechosos, pct_sospechosos, of chunks and those among them that ``flagged`` gives."""
    a = chunks.agg(F.count(F.lit(1)).alias("total_chunks"))
    b = found.agg(F.count(F.lit(1)).alias("sospechosos"))
    pct = F.when(F.col("total_chunks") > 0, F.round(F.col("sospechosos") * 100.0 / F.col("total_chunks"), 1)).otherwise(0.0)
    return a.crossJoin(b).withColumn("pct_sospechosos", pct)


def bucket(n: Column) -> Column:
    out = F.when(n <= BUCKETS[0][0], BUCKETS[0][1])
    for most, name in BUCKETS[1:]:
        out = out.when(n <= most, name)
    return out.otherwise("100+")


def chunks_per_doc(chunks: DataFrame, key: str) -> DataFrame:
    per = chunks.groupBy(key).agg(F.count(F.lit(1)).alias("n_chunks"))
    return per.groupBy(bucket(F.col("n_chunks")).alias("bucket")).agg(F.count(F.lit(1)).alias("n_docs"))


def largest(chunks: DataFrame, key: str, n: int = 10) -> DataFrame:
    return chunks.groupBy(key).agg(F.count(F.lit(1)).alias("n_chunks")).orderBy(F.desc("n_chunks"), F.asc(key)).limit(n)


def anomalies(rows: DataFrame, order: list, n: int = 50) -> DataFrame:
    """The first ``n`` rows with the total and whether the list is cut. The rows are stored, so that what finds them runs once."""
    path = f"{shared_folder(rows.sparkSession)}/anomalies-{uuid.uuid4().hex}"
    rows.write.parquet(path)
    rows = rows.sparkSession.read.schema(rows.schema).parquet(path)
    total = rows.agg(F.count(F.lit(1)).alias("total"))
    return rows.orderBy(*order).limit(n).crossJoin(F.broadcast(total)).withColumn("truncado", F.col("total") > n)


def flagged(chunks: DataFrame) -> DataFrame:
    """chunks (chunk_id, texto, char_count, tipo_chunk) -> those with reasons: chunk_id, razones, gravedad."""
    found = quality.flags(F.col("texto"), F.col("char_count"), F.col("tipo_chunk"))
    # a condition on what an explode gives isn't moved below it, so that the reasons are found once
    d = chunks.select("chunk_id", F.explode(F.array(F.struct(found.alias("razones")))).alias("x")).where(F.size("x.razones") > 0)
    return d.select("chunk_id", "x.razones", quality.severity(F.col("x.razones")).alias("gravedad"))


def reasons(found: DataFrame) -> DataFrame:
    return found.select(F.explode("razones").alias("r")).groupBy(quality.reason_name(F.col("r")).alias("razon")).agg(F.count(F.lit(1)).alias("n"))


def worst(found: DataFrame, n: int = 30) -> DataFrame:
    return found.orderBy(F.desc("gravedad"), F.asc("chunk_id")).limit(n)


def _quotas(df: DataFrame, quotas: dict, keys: list[str]) -> DataFrame:
    rows = [(k, v) for k, v in quotas.items()] if len(keys) == 1 else [(k, s, n) for k, v in quotas.items() for s, n in v.items()]
    return F.broadcast(df.sparkSession.createDataFrame(rows, ", ".join(f"{k} string" for k in keys) + ", cuota int"))  # as many as there are strata


def stratified(rows: DataFrame, key: str, stratum: str, quotas: dict, seed: int = SEED) -> DataFrame:
    """Up to the quota of each stratum, by a seeded hash of the key; strata without a quota give none."""
    draw = F.xxhash64(F.lit(seed), F.col(key))
    d = rows.join(_quotas(rows, quotas, [stratum]), stratum).withColumn("_n", F.row_number().over(Window.partitionBy(stratum).orderBy(draw, key)))
    return d.where(F.col("_n") <= F.col("cuota")).drop("_n", "cuota")


def pilot(files: DataFrame, quotas: dict = PILOT, seed: int = SEED) -> DataFrame:
    """files (path, tipo, bytes, anio) -> the sample: up to the quota of each kind and size class, of which up to two old and two recent ones
    (at most a third of the quota each) come first, and the rest by a seeded hash."""
    d = files.withColumns({"tam": size_class(F.col("bytes")), "epoca": epoch(F.col("anio")), "_draw": F.xxhash64(F.lit(seed), F.col("path"))})
    d = d.join(_quotas(files, quotas, ["tipo", "tam"]), ["tipo", "tam"])
    d = d.withColumn("_k", F.row_number().over(Window.partitionBy("tipo", "tam", "epoca").orderBy("_draw", "path")))
    third = F.floor(F.col("cuota") / 3)
    sure = ((F.col("epoca") == "viejo") & (F.col("_k") <= F.least(F.lit(LEAST_OLD), third))) | ((F.col("epoca") == "reciente") & (F.col("_k") <= F.least(F.lit(LEAST_RECENT), third)))
    d = d.withColumn("_n", F.row_number().over(Window.partitionBy("tipo", "tam").orderBy(F.desc(sure.cast("int")), "_draw", "path")))
    return d.where(F.col("_n") <= F.col("cuota")).select("path", "tipo", "tam", "epoca", "bytes", "anio")


def availability(files: DataFrame, quotas: dict = PILOT) -> DataFrame:
    """tipo, tam, disponibles, cuota, elegidos: how many of each stratum there are and how many a pilot takes."""
    have = files.groupBy("tipo", size_class(F.col("bytes")).alias("tam")).agg(F.count(F.lit(1)).alias("disponibles"))
    return have.join(small(_quotas(files, quotas, ["tipo", "tam"])), ["tipo", "tam"]).withColumn("elegidos", F.least("disponibles", "cuota"))


#: The lines of a block, and where its text is cut.
MOST_TEXT = 3000


def report_markdown(chunks: DataFrame, reason: Column) -> DataFrame:
    """chunk_id, md: a chunk as a block of a Markdown report: why it is there, its metadata (columns may be missing), what is suspicious about it, its text, and room for a verdict."""
    have = lambda n: F.col(n).cast("string") if n in chunks.columns else F.lit(None).cast("string")
    shown = lambda n: F.coalesce(have(n), F.lit("None"))
    line = lambda n: F.concat(F.lit(f"- `{n}`: "), shown(n))
    told = lambda n: F.when(have(n).isNotNull(), line(n))
    text, size = F.coalesce("texto", F.lit("")), F.length(F.coalesce("texto", F.lit("")))
    cut = F.concat(F.substring(text, 1, MOST_TEXT), F.lit("\n\n[... TEXTO TRUNCADO, hay "), (size - MOST_TEXT).cast("string"), F.lit(" chars mas ...]"))
    parts = [
        F.concat(F.lit("### `"), shown("chunk_id"), F.lit("`")), F.when(F.coalesce(reason, F.lit("")) != "", F.concat(F.lit("\n**Motivo:** "), reason)), F.lit("\n**Metadata:**"),
        line("tipo_chunk"), line("doc_id"), line("tipo_norma"), F.concat(line("numero"), F.lit(" | `anio`: "), shown("anio")), told("articulo_num"), told("anexo_num"), told("parte"), line("char_count"), line("url_origen"),
        F.when(F.size("_flags") > 0, F.concat(F.lit("\n**⚠️ Sospechas:** "), F.array_join("_flags", ", "))), F.lit("\n**Texto:**\n"), F.lit("```"), F.when(size > MOST_TEXT, cut).otherwise(text), F.lit("```\n"),
        F.lit("**Veredicto del revisor:** [ OK / PROBLEMA: ... ]\n"), F.lit("---\n"),
    ]
    found = chunks.withColumn("_flags", quality.flags(F.col("texto"), F.col("char_count"), F.col("tipo_chunk")))
    return found.select("chunk_id", F.concat_ws("\n", *parts).alias("md"))
