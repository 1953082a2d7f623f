"""Quality flags of chunks: signs of cut words, junk markers, odd sizes; and their severity."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let, strip

# Words that may begin a text in lower case, junk markers, kinds of chunk that should be whole.
COMMON = (
    "el", "la", "los", "las", "un", "una", "unos", "unas", "de", "del", "en", "por", "para", "que", "se", "su", "sus",
    "al", "lo", "le", "les", "me", "te", "no", "si", "con", "sin", "y", "o", "u", "e", "es", "son", "ser",
)
JUNK = (  # name, expression, whether it stands for a whole word; letter case doesn't matter
    ("Volver", "Volver", True),
    ("Imprimir", "Imprimir", True),
    ("Versión para Imprimir", "Versi[óo]n para Imprimir", False),
    ("Información Adicional", "Informaci[óo]n Adicional", False),
    ("Zona no Nuclear (slogan)", "Zona no Nuclear", False),
    ("HTML tags", "<[a-z]+[^>]*>", False),
    ("Mojibake", "Ã[©³­¡]", False),
    ("Dada en la Sala (colado)", "Dada en la Sala de Sesiones", False),
)
WHOLE = ("articulo", "anexo", "doc_completo")
PARTS = ("articulo_largo_parte", "anexo_parte", "fallback_caracteres")
LETTERS = "a-záéíóúñüA-ZÁÉÍÓÚÑÜ"


def starts_cut(t: Column) -> Column:
    word = F.lower(F.regexp_extract(t, rf"(?U)^\s*([{LETTERS}]+)", 1))
    return F.coalesce(t.rlike(r"(?U)^\s*\p{Ll}") & (word != "") & ~word.isin(*COMMON) & (F.length(word) <= 3), F.lit(False))


def ends_cut(t: Column) -> Column:
    word = F.regexp_extract(t, rf"(?U)([{LETTERS}]+)\s*$", 1)
    return F.coalesce((word != "") & (F.length(word) <= 2), F.lit(False))


def junk(t: Column) -> Column:
    """Names of the junk markers in a text. One expression tells clean texts, which are most, before each marker is looked for."""
    each = [(name, rf"(?iU)\b{p}\b" if word else f"(?iu){p}") for name, p, word in JUNK]
    some = "|".join(f"(?:{p})" for _, p in each)
    return F.when(t.rlike(some), F.array_compact(F.array(*(F.when(t.rlike(p), F.lit(name)) for name, p in each)))).otherwise(F.array().cast("array<string>"))


def is_middle_part(kind: Column, part: Column) -> Column:
    return F.coalesce(kind.isin(*PARTS) & (part > 1), F.lit(False))


def flags(t: Column, chars: Column, kind: Column) -> Column:
    """Array of reasons to look at a chunk, empty where there is none; an empty text has no other reason."""
    size = chars.cast("string")
    rest = F.array_compact(F.array(
        F.when(kind.isin(*WHOLE) & starts_cut(t), F.lit("empieza_mid_word_estricto")),
        F.when(kind.isin(*WHOLE) & ends_cut(t), F.lit("termina_mid_word_estricto")),
        let(junk(t), lambda found: F.when(F.size(found) > 0, F.concat(F.lit("basura: "), F.array_join(found, ",")))),
        F.when(chars < 20, F.concat(F.lit("muy_corto ("), size, F.lit(" chars)"))),
        F.when(chars > 2500, F.concat(F.lit("muy_largo ("), size, F.lit(" chars)"))),
        F.when((kind == "articulo") & (chars < 30), F.lit("articulo_minusculo")),
        F.when(F.lower(t).rlike(r"(?U) como\s*$"), F.lit("termina_en_'como'_truncado_por_anexo")),
    ))
    return F.when(strip(F.coalesce(t, F.lit(""))) == "", F.array(F.lit("texto_vacio"))).otherwise(rest)


def severity(reasons: Column) -> Column:
    has = lambda *words: F.exists(reasons, lambda r: F.greatest(*(r.contains(w) for w in words)) if len(words) > 1 else r.contains(words[0]))
    weigh = ((100, ("vacio",)), (50, ("basura",)), (40, ("truncado",)), (20, ("mid_word",)), (10, ("muy_corto", "muy_largo")))
    total = F.lit(0)
    for n, words in weigh:
        total = total + F.when(has(*words), n).otherwise(0)
    return total


def reason_name(r: Column) -> Column:
    return F.trim(F.regexp_replace(r, r"\([^)]*\)", ""))
