"""Parsing of norms: header fields, body, articles, annexes. Each function maps Columns to Columns."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import SPACES, blank_to_null, extract, from_byte, let, lstrip, replaced, strip

# Patterns and words of the corpus's format.
UNID = r"(?md)^#\s*UNID:\s*([A-F0-9]+)"
SOURCE_URL = r"(?md)^#\s*Descargado-de:\s*(\S+)"
NORM = r"(?md)^(Ordenanza|Resolucion|Resolución|Comunicacion|Comunicación)\s+N°?\s*(\d+),?\s*A[nñ]o\s+(\d{4})"
PUBLISHED = r"Publicaci[oó]n\s*:\s*(\d{1,2})/(\d{1,2})/(\d{4})"
GAZETTE = r"Bolet[ií]n Oficial N°\s*(\d+)"
CATEGORY = r"NORMA DE CAR[AÁ]CTER\s+(PARTICULAR|GENERAL)"
SLOGAN = r"(?s)\"San Mart[ií]n de los Andes,?\s*Zona no Nuclear.*"
CLOSING = r"\n\s*Dada\s+en\s+la\s+[Ss]ala\s+de\s+([Ss]esiones|[Dd]eliberaciones)[^\n]*"
CLOSING_CUT = r"(?s)\n\s*Dada\s+en\s+la\s+[Ss]ala\s+de\s+[Ss]esiones.*"
NOISE = ("Volver", "Digesto Municipal", "Versión para Imprimir", "Información Adicional", "Imprimir")
HEADING = r"^\s*((?:ART[ÍI]CULO|Art[íi]culo)\s+(\d+)\s*[º°]?\s*[.\-]\s*(?=-|\s*[A-ZÁÉÍÓÚÑ]))"
ANNEX = r"^\s*(ANEXO\s+([IVXLCDM]+))\s*$"
ANNEX_INSIDE = r"(?iu)\n\s*(ANEXO\s+[IVX]+)\s*\n"
SUBSTITUTION = (
    r"(?iu)por\s+el\s+siguiente\s*:|por\s+los\s+siguientes\s*:"
    r"|queda(?:ra|ran)?\s+redactad[oa]s?\s+(?:de\s+la\s+siguiente\s+manera|como\s+sigue)\s*:"
    r"|se\s+sustituye\s+por\s*:|que\s+dir[aa]\s*:|el\s+siguiente\s+texto\s*:"
)
CONTINUATION = ("que", "el", "la", "los", "las", "de", "del", "se", "su", "sus", "esta", "este", "estos", "estas", "forma", "es", "por", "como")
ROMAN = (("I", 1), ("V", 5), ("X", 10), ("L", 50), ("C", 100), ("D", 500), ("M", 1000))
JUMP = 20
EMPTY_ANNEX = 30

MARK, HEAD_END = "\u0001", "\u0002"
ARTICLE = "struct<num:int,label:string,texto:string,start:int,end:int,char_count:int>"


def header(t: Column) -> Column:
    """Struct of the nine header fields, each null where its pattern isn't found. The date is read month first."""
    # the whole text is searched once for the line of the norm with its title, and once for the date; their parts are read from what is found
    named = NORM + r"[\n\r ]*([^\n]*)"

    def built(line: Column, published: Column) -> Column:
        kind = F.translate(F.lower(F.regexp_extract(line, named, 1)), "ó", "o")
        part = lambda g, n: F.lpad(F.regexp_extract(published, PUBLISHED, g), n, "0")
        return F.struct(
            extract(t, UNID).alias("unid"), extract(t, SOURCE_URL).alias("url_origen"), blank_to_null(kind).alias("tipo_norma"),
            extract(line, named, 2).alias("numero"), extract(line, named, 3).try_cast("int").alias("anio"),
            blank_to_null(strip(F.regexp_extract(line, named, 4))).alias("titulo_corto"), F.when(published != "", F.concat_ws("-", part(3, 4), part(1, 2), part(2, 2))).alias("fecha_publicacion"),
            extract(t, GAZETTE).alias("boletin_oficial"), F.lower(extract(t, CATEGORY)).alias("categoria"),
        )

    return let(F.regexp_extract(t, named, 0), lambda line: let(F.regexp_extract(t, PUBLISHED, 0), lambda published: built(line, published)))


def kind_of_norm(t: Column) -> Column:
    """The header's ``tipo_norma`` alone."""
    return blank_to_null(F.translate(F.lower(F.regexp_extract(t, NORM, 1)), "ó", "o"))


def body(t: Column) -> Column:
    """The norm's text: from the first article (else after the category line, else all), without slogan, closing formula and noise lines."""
    start = r"(?iu)ART[ÍI]CULO\s+\d"
    after = r"(?s)NORMA DE CAR[AÁ]CTER\s+(?:PARTICULAR|GENERAL)\s*\n(.*)"
    # most texts have it near their beginning; what the first match reads has no earlier place in the text: there the pattern would have matched, too
    first = let(F.regexp_extract(from_byte(t, F.lit(1), F.lit(1000)), start, 0), lambda x: F.when(x != "", x).otherwise(F.regexp_extract(t, start, 0)))
    c = let(first, lambda x: F.when(x != "", from_byte(t, F.octet_length(F.call_function("substring_index", t, x, F.lit(1))) + 1)).when(t.rlike(after), F.regexp_extract(t, after, 1)).otherwise(t))
    c = replaced(replaced(c, '"San Mart', SLOGAN, ""), "Dada", CLOSING, "")

    def noise(line: Column) -> Column:
        may = lambda first: reduce(or_, (first.startswith(word) for word in NOISE))
        return let(lstrip(line), may) & let(strip(line), lambda x: reduce(or_, (x == word for word in NOISE)))  # an IN within a lambda is slow

    def joined(lines: Column) -> Column:
        blank = lambda line: (F.substring(line.cast("binary"), F.lit(1), F.lit(1)) <= F.lit(b" ")) & (F.ltrim(line, F.lit("\t\v\f\r ")) == "")
        two = F.aggregate(lines, F.lit(0), lambda n, line: F.when(n == 2, n).when(blank(line), n + 1).otherwise(0)) == 2  # blank lines in a row, without which nothing is shortened
        return let(replaced(F.array_join(lines, "\n"), "---", "-{3,}", "-"), lambda x: strip(F.when(two, F.regexp_replace(x, r"\n\s*\n\s*\n+", "\n\n")).otherwise(x)))

    return let(F.filter(F.split(c, "\n", -1), lambda x: ~noise(x)), joined)


def _without(t: Column, *marks: str) -> Column:
    """The text without these characters, which hardly any has."""
    def cleaned(x: Column) -> Column:
        some = F.lit(False)
        for mark in marks:
            some = some | x.contains(mark)
        return F.when(some, F.translate(x, "".join(marks), "")).otherwise(x)

    return let(t, cleaned)


def _pieces(t: Column, pattern: str, mark: str) -> Column:
    """Array of struct<start, piece>: the text cut before each match; what comes before the first is left out."""
    marked = F.regexp_replace(_without(t, MARK, HEAD_END), pattern, mark)
    none = F.array().cast("array<struct<start:int,piece:string>>")
    first = lambda parts: F.struct(F.length(F.get(parts, F.lit(0))).alias("pos"), none.alias("out"))
    shown = (lambda x: _without(x, HEAD_END)) if HEAD_END in mark else (lambda x: x)
    step = lambda acc, x: F.struct(
        (acc["pos"] + F.length(shown(x))).alias("pos"), F.concat(acc["out"], F.array(F.struct(acc["pos"].alias("start"), x.alias("piece")))).alias("out"))
    return let(F.split(marked, MARK, -1), lambda parts: F.aggregate(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0))), first(parts), step, lambda acc: acc["out"]))


def articles(t: Column) -> Column:
    """Array of articles: span from heading to heading, ended by the closing formula or right after an annex line inside."""

    def later(x: Column) -> Column:
        """From the first line's end."""
        return F.substring(x, F.instr(x, F.lit("\n")), F.length(x))

    def cut(x: Column) -> Column:
        """Ended after an annex line inside."""
        return F.when(x.rlike(ANNEX_INSIDE), F.regexp_extract(x, r"(?ius)^(.*?\n\s*ANEXO\s+[IVX]+\s*\n)", 1)).otherwise(x)

    def bare(whole: Column) -> Column:
        """Without the heading it begins with, nor marks after it. A heading that ends in the first bytes is told by them."""
        def after(n: Column) -> Column:
            return F.ltrim(strip(from_byte(whole, n + 1)), F.lit(SPACES + ".-"))

        size = lambda x: F.octet_length(F.regexp_extract(x, "(?d)" + HEADING, 0))
        return let(let(size(begun(whole)), lambda n: F.when(n > 0, n).otherwise(size(whole))), after)

    begun = lambda x: from_byte(x, F.lit(1), F.lit(400))

    def built(p: Column, x: Column, y: Column) -> Column:
        whole = F.when(y.contains("\n"), F.concat(F.substring_index(y, "\n", 1), F.regexp_replace(later(y), r"(?iu)\n\s*(ANEXO\s+[IVX]+)\s*$", " $1"))).otherwise(y)
        head = F.regexp_extract(begun(p["piece"]), "(?d)" + HEADING, 0)
        return let(head, lambda h: F.struct(
            F.regexp_extract(h, r"(\d+)", 1).cast("int").alias("num"), strip(h).alias("label"), let(whole, bare).alias("texto"),
            p["start"].alias("start"), (p["start"] + F.length(x)).alias("end"), F.length(x).alias("char_count")))

    def one(p: Column) -> Column:
        # most articles are one line: these are stripped once and not searched for annexes
        both = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
        ended = lambda x, y: F.when(y.contains("\n"), let(cut(x), lambda z: both(z, strip(z)))).otherwise(both(x, y))
        return let(let(replaced(p["piece"], "Dada", CLOSING_CUT, ""), lambda x: let(strip(x), lambda y: ended(x, y))), lambda q: built(p, q["x"], q["y"]))

    return F.transform(_pieces(t, "(?md)" + HEADING, MARK + "$0"), one)


def merge_false_positives(arts: Column) -> Column:
    """Articles that belong to the text of the one before are merged into it.

    Such is one after an article that announces a substitute text (once per announcement), and one whose
    number jumps by more than 20 while the next goes on where the one before had stopped.
    """
    none = F.struct(F.array().cast(f"array<{ARTICLE}>").alias("out"), F.lit(False).alias("used"))

    def step(arts: Column, acc: Column, i: Column) -> Column:
        cur, nxt = F.get(arts, i), F.get(arts, i + 1)
        prev = F.get(acc["out"], F.size(acc["out"]) - 1)
        announced = ~acc["used"] & prev["texto"].contains(":") & prev["texto"].rlike(SUBSTITUTION)  # all of these end in a colon
        jumps = (cur["num"] - prev["num"] > JUMP) & F.coalesce(nxt["num"] == prev["num"] + 1, F.lit(False))
        merged = F.struct(
            prev["num"].alias("num"), prev["label"].alias("label"),
            F.concat(F.regexp_replace(prev["texto"], r"(?U)\s+$", ""), F.lit("\n\n"), cur["label"], F.lit(" "), cur["texto"]).alias("texto"),
            prev["start"].alias("start"), cur["end"].alias("end"), (cur["end"] - prev["start"]).alias("char_count"))
        most = F.slice(acc["out"], F.lit(1), F.greatest(F.size(acc["out"]) - 1, F.lit(0)))
        join = F.concat(most, F.array(merged))
        has = F.size(acc["out"]) > 0
        return F.when(has & announced, F.struct(join.alias("out"), F.lit(True).alias("used"))).when(has & jumps, F.struct(join.alias("out"), acc["used"].alias("used"))).otherwise(
            F.struct(F.concat(acc["out"], F.array(cur)).alias("out"), F.lit(False).alias("used")))

    def fold(arts: Column) -> Column:
        at = F.when(F.size(arts) > 0, F.sequence(F.lit(0), F.size(arts) - 1)).otherwise(F.array().cast("array<int>"))
        return F.aggregate(at, none, lambda acc, i: step(arts, acc, i), lambda acc: acc["out"])

    return let(arts, fold)


def roman(c: Column) -> Column:
    """Integer of a roman numeral, subtractive; other characters count 0."""
    value = lambda x: F.coalesce(F.element_at(F.create_map(*(F.lit(v) for kv in ROMAN for v in kv)), x), F.lit(0))
    letters = F.filter(F.reverse(F.split(F.upper(c), "")), lambda x: x != "")
    zero = F.struct(F.lit(0).alias("total"), F.lit(0).alias("prev"))
    step = lambda acc, x: F.struct(F.when(value(x) < acc["prev"], acc["total"] - value(x)).otherwise(acc["total"] + value(x)).alias("total"), value(x).alias("prev"))
    return F.aggregate(letters, zero, step, lambda acc: acc["total"])


def annex_state(t: Column) -> Column:
    """``falso_positivo`` for a mention within a sentence, ``vacio`` for under 30 characters, else ``real``."""
    first = F.lower(F.regexp_replace(F.regexp_extract(t, r"(?U)^\s*(\S+)", 1), r"^[.,:;\-]+|[.,:;\-]+$", ""))
    return F.when(first.isin(*CONTINUATION), "falso_positivo").when(F.length(strip(t)) < EMPTY_ANNEX, "vacio").otherwise("real")


def annexes(t: Column) -> Column:
    """Array of annexes in order of appearance, false positives dropped. Only upper-case headings alone on their line count."""

    def built(p: Column, head: Column, text: Column, state: Column) -> Column:
        size = F.length(head) + F.length(text)
        num = F.regexp_extract(head, r"ANEXO\s+([IVXLCDM]+)", 1)
        return F.struct(
            num.alias("num"), roman(num).alias("num_int"), strip(head).alias("label"), strip(text).alias("texto"), p["start"].alias("start"), (p["start"] + size).alias("end"), size.alias("char_count"),
            (state == "real").alias("tiene_contenido"), state.alias("estado_contenido"),
            # fixed values: the two reasons
            F.when(state == "vacio", f"contenido digitalizado < {EMPTY_ANNEX} chars").otherwise("contenido normativo presente").alias("motivo_clasificacion"))

    def one(p: Column) -> Column:
        parts = F.split(p["piece"], HEAD_END, 2)
        return let(parts, lambda x: let(annex_state(F.get(x, F.lit(1))), lambda state: built(p, F.get(x, F.lit(0)), F.get(x, F.lit(1)), state)))

    def found(x: Column) -> Column:
        return F.filter(F.transform(_pieces(x, "(?md)" + ANNEX, f"{MARK}$0{HEAD_END}"), one), lambda a: a["estado_contenido"] != "falso_positivo")

    return let(t, lambda x: found(F.when(x.contains("ANEXO"), x).when(x.isNotNull(), "")))  # nothing is searched without the word
