"""Text helpers as Column expressions. \\w, \\s and lengths are by Unicode code point."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A word of more than one character for the tokenizer; white space, as \\s is by Unicode.
WORD = r"[\p{L}\p{N}_]{2,}+"
SPACES = "\t\n\v\f\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once: within lambdas nothing else keeps an expression from being evaluated at each mention."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def strip(c: Column) -> Column:
    """Without leading and trailing white space of any kind.

    ``btrim`` walks through the whole text. One whose first and last bytes are visible ASCII characters, or that has but one line break after such, is told by its bytes.
    """
    seen = lambda b: b.between(F.lit(b"!"), F.lit(b"~"))

    def run(x: Column) -> Column:
        b, n = x.cast("binary"), F.octet_length(x)
        byte = lambda i: F.substring(b, i, F.lit(1))
        rest = F.when(seen(byte(F.lit(1))) & x.endswith("\n") & seen(byte(F.greatest(n - 1, F.lit(1)))), F.substring(b, F.lit(1), n - 1).cast("string")).otherwise(F.btrim(x, F.lit(SPACES)))
        return F.when(seen(byte(F.lit(1))) & seen(byte(n)), x).otherwise(rest)

    return let(c, run)


def lstrip(c: Column) -> Column:
    return F.ltrim(c, F.lit(SPACES))


def is_blank(c: Column) -> Column:
    return lstrip(c) == ""


def from_byte(c: Column, n: Column, size: Column | None = None) -> Column:
    """The text from its ``n``-th byte on (from 1), ``size`` bytes of it: unlike ``substring``, nothing is walked through to count characters."""
    return F.substring(c.cast("binary"), n, F.octet_length(c) if size is None else size).cast("string")


#: Bytes that are looked at before a mark.
BEFORE = 64


def replaced(c: Column, mark: str, pattern: str, by: str) -> Column:
    """``regexp_replace`` for patterns whose matches hold ``mark``, with nothing but white space (of ASCII) before it: what stands before the first mark isn't searched."""

    def run(x: Column, n: Column) -> Column:
        start = F.greatest(n - BEFORE, F.lit(0))
        # from here on the pattern may match: after the last character before the mark that isn't white space
        blank = lambda: F.octet_length(F.rtrim(from_byte(x, start + 1, n - start), F.lit("\t\n\v\f\r ")))
        cut = lambda k: F.concat(from_byte(x, F.lit(1), start + k), F.regexp_replace(from_byte(x, start + k + 1), pattern, by))
        return F.when(n == F.octet_length(x), x).otherwise(let(blank(), lambda k: F.when((k > 0) | (start == 0), cut(k)).otherwise(F.regexp_replace(x, pattern, by))))

    return let(c, lambda x: let(F.octet_length(F.substring_index(x, mark, 1)), lambda n: run(x, n)))


def collapse(c: Column) -> Column:
    """Runs of white space become one blank."""
    return strip(F.regexp_replace(c, r"(?U)\s+", " "))


def blank_to_null(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def extract(c: Column, pattern: str, group: int = 1) -> Column:
    """The group of the first match, null where there is none."""
    return blank_to_null(F.regexp_extract(c, pattern, group))


def tokens(c: Column) -> Column:
    """Lower-cased words of more than one character, in order, repeats included. Null texts have none."""
    return F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(WORD), F.lit(0))


def token_estimate(chars: Column) -> Column:
    """Estimated tokens of so many characters, rounded down."""
    return F.floor(chars / F.lit(3.5)).cast("long")


def embedding_cost_usd(tokens_: Column) -> Column:
    return tokens_ / F.lit(1e6) * F.lit(0.02)


def llm_cost_usd(tokens_in: Column, tokens_out: Column) -> Column:
    return F.round(tokens_in / F.lit(1e6) * F.lit(2.0) + tokens_out / F.lit(1e6) * F.lit(8.0), 5)


def preview(c: Column, size: int = 200) -> Column:
    """The text after its navigation header, on one line; beyond ``size`` characters it is cut, and dots tell so."""
    body = F.when(F.instr(c, "]\n\n") > 0, F.substring(c, F.instr(c, "]\n\n") + 3, F.length(c))).otherwise(c)
    line = collapse(body)
    return F.when(F.length(line) > size, F.concat(F.substring(line, 1, size), F.lit("..."))).otherwise(line)
