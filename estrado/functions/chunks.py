"""Identifiers, links, pieces of fixed size, and classes of size and epoch."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import blank_to_null, extract, strip

# Sizes in characters, host names of origins, bounds of classes.
SHORT_DOC, LONG_ARTICLE, PIECE, OVERLAP = 2000, 6000, 1500, 200
NEW_ORIGIN, OLD_ORIGIN = "digesto.cdsma.gob.ar/normas/", "digeh.cdsma.gob.ar"
FILE_NAME = r"^(\d+)-(\d{4})\s*-"
MONTHS = ("ene", "feb", "mar", "abr", "may", "jun", "jul", "ago", "sep", "oct", "nov", "dic")


def pieces(t: Column, size: int = PIECE, overlap: int = OVERLAP) -> Column:
    """Array of overlapping pieces, each stripped, blank ones dropped; a text of up to ``size`` characters stays as it is, an empty one has none."""
    step = size - overlap
    n = F.ceil((F.length(t) - size) / F.lit(step)).cast("int") + 1
    cut = F.transform(F.sequence(F.lit(0), n - 1), lambda i: strip(F.substring(t, i * step + 1, F.lit(size))))
    none = F.array().cast("array<string>")
    return F.when(F.coalesce(F.length(t), F.lit(0)) == 0, none).when(F.length(t) <= size, F.array(t)).otherwise(F.filter(cut, lambda x: x != ""))


def doc_id(head: Column) -> Column:
    """Identifier of a norm from its header struct; five digits of the unid tell norms of one number and year apart."""
    unid, kind = blank_to_null(head["unid"]), blank_to_null(head["tipo_norma"])
    base = F.when(kind.isNotNull() & blank_to_null(head["numero"]).isNotNull() & (head["anio"] != 0), F.concat_ws("_", kind, head["numero"], head["anio"].cast("string")))
    tail = F.concat(F.lit("_u"), F.lower(F.substring(unid, 1, 5)))
    return F.coalesce(F.concat(base, F.coalesce(tail, F.lit(""))), F.concat(F.lit("unid_"), F.lower(F.substring(unid, 1, 12))), F.lit("doc_desconocido"))


def link_kind(url: Column) -> Column:
    u = F.coalesce(url, F.lit(""))
    return F.when(u.contains(NEW_ORIGIN), "pdf_nuevo").when(u.contains(OLD_ORIGIN), "html_viejo").otherwise("sin_link")


def link(url: Column) -> Column:
    """Struct of url and kind of a norm's origin; the url is empty where the origin isn't known."""
    kind = link_kind(url)
    return F.struct(F.when(kind == "sin_link", "").otherwise(url).alias("url"), kind.alias("tipo"))


def size_class(size: Column) -> Column:
    return F.when(size < 2000, "corto").when(size < 20000, "medio").otherwise("largo")


def epoch(year: Column) -> Column:
    return F.when(year.isNull(), "sin_anio").when(year < 2000, "viejo").when(year < 2015, "medio_temporal").otherwise("reciente")


def file_year(name: Column) -> Column:
    """The year in a file name, null outside 1960 to 2030."""
    y = extract(name, FILE_NAME, 2).try_cast("int")
    return F.when(y.between(1960, 2030), y)


def file_doc_id(name: Column, kind: Column) -> Column:
    """Identifier from a file name, without leading zeros; null where the name has no number and year in front."""
    n, y = extract(name, FILE_NAME, 1).try_cast("long"), extract(name, FILE_NAME, 2).try_cast("int")
    return F.concat(F.lower(kind), F.lit("_"), n.cast("string"), F.lit("_"), y.cast("string"))


def norm_number(c: Column) -> Column:
    return strip(F.translate(c, ".", ""))


def full_year(c: Column) -> Column:
    """Two-digit years from 60 on are of the 1900s, others of the 2000s; three digits and more stay."""
    n = c.try_cast("int")
    return F.when(n >= 100, n).when(n >= 60, n + 1900).otherwise(n + 2000)


def spanish_date(c: Column) -> Column:
    """Date of a short Spanish date such as ``19 mar. 2026`` at the start of a text; null where there is none."""
    p = r"^(\d+)\s+([a-z]{3})\.?\s+(\d{4})"
    c = F.lower(c)
    month = F.array_position(F.array(*map(F.lit, MONTHS)), F.regexp_extract(c, p, 2))
    day, year = F.regexp_extract(c, p, 1).try_cast("int"), F.regexp_extract(c, p, 3)
    ok = c.rlike(p) & (month > 0) & day.between(1, 31) & (year != "0000")
    return F.when(ok, F.try_to_date(F.concat_ws("-", year, F.lpad(month.cast("string"), 2, "0"), F.lpad(day.cast("string"), 2, "0")), "yyyy-MM-dd"))


def file_name(number: Column, year: Column, summary: Column) -> Column:
    safe = F.substring(strip(F.regexp_replace(F.coalesce(blank_to_null(summary), F.lit("sin_titulo")), r'[<>:"/\\|?*]', "_")), 1, 100)
    return F.concat(number.cast("string"), F.lit("-"), year.cast("string"), F.lit(" - "), safe, F.lit(".txt"))


def synthetic_document(kind: Column, number: Column, year: Column, url: Column, summary: Column, text: Column, fetched: Column) -> Column:
    """Text of an acquired norm with a header that ``parse.header`` reads. Its unid isn't hexadecimal, so it is not one for the parser."""
    n, y = number.cast("string"), year.cast("string")
    unid = F.concat_ws("-", F.lit("SCRAPER"), F.upper(F.substring(kind, 1, 3)), n, y)
    lines = [  # fixed values: the header's lines
        F.concat(F.lit("# UNID: "), unid), F.concat(F.lit("# Descargado-de: "), url), F.concat(F.lit("# Fecha-descarga: "), fetched), F.lit(""),
        F.concat(kind, F.lit(" N° "), n, F.lit(", Año "), y), F.lit(""), F.concat(F.lit("Resumen: "), summary), F.lit(""), F.lit("---"), text,
    ]
    return F.concat_ws("\n", *(F.coalesce(x, F.lit("")) for x in lines))
