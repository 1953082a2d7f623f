"""Citations, links and numbered context, from a chunk's metadata columns. Any of the columns may be missing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .chunks import link_kind
from .text import blank_to_null, strip

CHARTER = "carta_organica"
#: Names of the kinds of norm.
KINDS = (("ordenanza", "Ordenanza"), ("resolucion", "Resolución"), ("comunicacion", "Comunicación"))


def _col(df: DataFrame, name: str, kind: str = "string") -> Column:
    return F.col(name).cast(kind) if name in df.columns else F.lit(None).cast(kind)


def norm_kind(df: DataFrame) -> Column:
    return F.coalesce(blank_to_null(_col(df, "tipo_documento")), blank_to_null(_col(df, "tipo_norma")), F.lit("norma"))


def derived_link(df: DataFrame) -> Column:
    """Struct of url and kind; the charter has none but its own kind."""
    url = F.coalesce(blank_to_null(_col(df, "link_original_url")), blank_to_null(_col(df, "url_origen")), F.lit(""))
    kind = F.coalesce(blank_to_null(_col(df, "link_original_tipo")), link_kind(url))
    own = norm_kind(df) == CHARTER
    return F.struct(F.when(own, "").otherwise(url).alias("url"), F.when(own, "carta_organica_local").otherwise(kind).alias("tipo"))


def citation(df: DataFrame) -> Column:
    kind, chunk = norm_kind(df), _col(df, "tipo_chunk")
    art = _col(df, "articulo_num")
    yes = lambda name: F.coalesce(_col(df, name, "boolean"), F.lit(False))
    base = F.lit("Carta Orgánica Municipal, ")
    article = F.concat(base, F.lit("Art. "), F.coalesce(art, F.lit("None")))
    charter = (
        F.when(chunk == "preambulo", F.concat(base, F.lit("Preámbulo")))
        .when(chunk == "disposicion_transitoria", strip(F.concat(base, F.lit("Disposición Transitoria "), F.coalesce(_col(df, "transitoria_ordinal"), F.lit("")))))
        .when(_col(df, "inciso_num").isNotNull() & yes("es_inciso"), F.concat(article, F.lit(", inc. "), _col(df, "inciso_num")))
        .otherwise(article)
    )
    label = F.concat(F.upper(F.substring(kind, 1, 1)), F.lower(F.substring(kind, 2, 10_000)))
    for name, shown in KINDS:
        label = F.when(kind == name, shown).otherwise(label)
    annex = F.when(blank_to_null(_col(df, "anexo_num")).isNotNull(), F.concat(F.lit(", Anexo "), _col(df, "anexo_num"), F.when(yes("es_anexo_vacio"), " (no digitalizado)").otherwise("")))
    title = F.when(blank_to_null(_col(df, "titulo_corto")).isNotNull(), F.concat(F.lit(' — "'), _col(df, "titulo_corto"), F.lit('"')))
    norm = F.concat(
        label, F.lit(" N° "), F.coalesce(_col(df, "numero"), F.lit("?")), F.lit("/"), F.coalesce(_col(df, "anio"), F.lit("?")),
        F.coalesce(annex, F.lit("")), F.coalesce(F.concat(F.lit(", Art. "), art), F.lit("")), F.coalesce(title, F.lit("")), F.when(yes("es_derogada_por_filename"), " [DEROGADA]").otherwise(""))
    return F.when(kind == CHARTER, charter).otherwise(norm)


def _or(c: Column, other: str = "?") -> Column:
    return F.coalesce(c, F.lit(other))


def short_label(df: DataFrame) -> Column:
    """A few characters for a list: charter article or item, or the first letters of the kind with number and year."""
    kind = F.coalesce(blank_to_null(_col(df, "tipo_documento")), _or(_col(df, "tipo_norma")))
    chunk, art, inc = _col(df, "tipo_chunk"), _or(_col(df, "articulo_num"), ""), blank_to_null(_col(df, "inciso_num"))
    charter = (
        F.when(inc.isNotNull() & (inc != "0"), F.concat(F.lit("CO Art."), art, F.lit(" inc."), inc)).when(chunk == "preambulo", "CO Preambulo")
        .when(chunk == "disposicion_transitoria", F.concat(F.lit("CO Transit."), _or(_col(df, "transitoria_ordinal"), ""))).otherwise(F.concat(F.lit("CO Art."), art)))
    norm = F.concat(F.upper(F.substring(kind, 1, 4)), F.lit(" "), _or(_col(df, "numero")), F.lit("/"), _or(_col(df, "anio")))
    return F.when(kind == CHARTER, charter).otherwise(norm)


def charter_label(df: DataFrame) -> Column:
    """Place of a charter chunk; other chunks are told by their identifier."""
    chunk = _col(df, "tipo_chunk")
    article = F.concat(
        F.lit("Art. "), _or(_col(df, "articulo_num")), F.lit(" (Titulo "), _or(_col(df, "titulo_num")), F.lit(" - Cap. "), _or(_col(df, "capitulo_num")), F.lit(")"),
        F.when(F.coalesce(_col(df, "no_modificable_por_enmienda", "boolean"), F.lit(False)), " [BLINDADO]").otherwise(""))
    return (
        F.when(chunk == "preambulo", "PREAMBULO (blindado)").when(chunk == "disposicion_transitoria", F.concat(F.lit("Transitoria "), _or(_col(df, "transitoria_ordinal"))))
        .when(chunk == "articulo_carta_organica", article).otherwise(F.col("chunk_id").cast("string")))


def result_label(df: DataFrame) -> Column:
    """Where a result comes from: charter place, or kind, number, year, start of the title, article or annex, and whether it is repealed."""
    kind = F.coalesce(blank_to_null(_col(df, "tipo_documento")), _or(_col(df, "tipo_norma")))
    chunk, art, base = _col(df, "tipo_chunk"), _col(df, "articulo_num"), F.lit("CARTA ORGANICA - ")
    charter = (
        F.when(chunk == "preambulo", F.concat(base, F.lit("Preambulo"))).when(chunk == "disposicion_transitoria", F.concat(base, F.lit("Transitoria "), _or(_col(df, "transitoria_ordinal"), "")))
        .when(chunk == "inciso_carta_organica", F.concat(base, F.lit("Art. "), _or(art, "None"), F.lit(" inc. "), _or(_col(df, "inciso_num"), "None"))).otherwise(F.concat(base, F.lit("Art. "), _or(art))))
    title = F.concat(F.lit(" - "), F.substring(blank_to_null(_col(df, "titulo_corto")), 1, 50))
    annex = _or(_col(df, "anexo_num"), "None")
    part = (
        F.when((chunk == "articulo") & art.isNotNull() & (art != "0"), F.concat(F.lit(" (Art. "), art, F.lit(")")))
        .when(chunk == "articulo_anexo", F.concat(F.lit(" (Anexo "), annex, F.lit(" Art. "), _or(art, "None"), F.lit(")"))).when(chunk == "anexo_vacio", F.concat(F.lit(" (Anexo "), annex, F.lit(" - sin digitalizar)"))))
    repealed = F.when(F.coalesce(_col(df, "es_derogada_por_filename", "boolean"), F.lit(False)), " [DEROGADA]")
    norm = F.concat(F.upper(kind), F.lit(" "), _or(_col(df, "numero")), F.lit("/"), _or(_col(df, "anio")), *(_or(x, "") for x in (title, part, repealed)))
    return F.when(kind == CHARTER, charter).otherwise(norm)


def sources(hits: DataFrame) -> DataFrame:
    """hits (query_id, rank, chunk_id, metadata columns) -> one numbered source per hit."""
    at = derived_link(hits)
    return hits.select(
        "query_id", F.col("rank").alias("numero"), "chunk_id", citation(hits).alias("cita"), at["url"].alias("link"), at["tipo"].alias("link_tipo"),
        norm_kind(hits).alias("tipo_documento"), F.coalesce(_col(hits, "es_derogada_por_filename", "boolean"), F.lit(False)).alias("es_derogada"), F.coalesce(_col(hits, "fuente_fase"), F.lit("")).alias("fuente_fase"))


def numbered_context(hits: DataFrame) -> DataFrame:
    """hits (query_id, rank, texto, metadata columns) -> query_id, contexto: the blocks of a query in order. A query has as many hits as were asked for."""
    block = F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("] "), citation(hits), F.lit("\n"), strip(F.col("texto")))
    rows = hits.select("query_id", F.struct(F.col("rank").alias("n"), block.alias("b")).alias("x"))
    return rows.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["b"]), "\n\n").alias("contexto"))
