"""Language identification by rank-order profiles.

A profile is the list of a language's most frequent letter n-grams (1 to 3), most frequent first. A document is ranked in the same
way and gets the language whose profile is nearest by out-of-place distance: the sum over the document's
n-grams of the difference in rank, or the largest rank for n-grams that the profile lacks.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .streams import small_batches

TOP = 300
UNKNOWN = "und"
PIECE = 1 << 21


@cache
def _letters() -> np.ndarray:
    return np.array([chr(i).isalpha() for i in range(0x110000)])


def _counts(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """n-gram codes, ascending, and how often each occurs. A code packs code points of 21 bits, first one highest;
    words are bounded by blanks (any run of non-letters), and n-grams have no blank within."""
    letter = _letters()[points]
    keep = letter.copy()
    keep[1:] |= letter[:-1]  # the first non-letter after a word stays, as its blank
    c = np.where(letter, points, 32)[keep].astype(np.int64)
    c = np.concatenate([[32], c, [32]]) if len(c) else c
    if not len(c):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    alphabet = np.unique(c)
    size = len(alphabet)
    if size < 1200:
        table = np.zeros(int(alphabet[-1]) + 1, np.int32)
        table[alphabet] = np.arange(size, dtype=np.int32)
        x, blank = table[c], int(table[32])
        two = (x[:-1] * size + x[1:])[(x[:-1] != blank) | (x[1:] != blank)]
        three = ((x[:-2] * size + x[1:-1]) * size + x[2:])[x[1:-1] != blank]
        cube = size * size
        out, n = [], []
        for codes, low in ((x[x != blank], 0), (two, 1), (three, 2)):
            if low < 2 or len(codes) * 4 > cube * size:
                many = np.bincount(codes, minlength=1)
                u = np.flatnonzero(many)
                many = many[u]
            else:
                s = np.sort(codes)
                first = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))
                u, many = s[first], np.diff(np.concatenate([first, [len(s)]]))
            u = u.astype(np.int64)
            packed = alphabet[u % size]
            if low:
                packed |= alphabet[u // size % size] << 21
            if low > 1:
                packed |= alphabet[u // cube] << 42
            out.append(packed)
            n.append(many)
        return np.concatenate(out), np.concatenate(n)
    one, two, three = c[c != 32], (c[:-1] << 21 | c[1:])[(c[:-1] != 32) | (c[1:] != 32)], (c[:-2] << 42 | c[1:-1] << 21 | c[2:])[c[1:-1] != 32]
    return np.unique(np.concatenate([one, two, three]), return_counts=True)


def _merge(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    if len(parts) == 1:
        return parts[0]
    u, where = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
    return u, np.bincount(where, np.concatenate([p[1] for p in parts])).astype(np.int64)


def ngrams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Codes and counts of a whole text, lower-cased. Very long texts are counted in pieces that end at non-letters."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)
    if len(points) <= PIECE:
        return _counts(points)
    parts, at = [], 0
    while at < len(points):
        end = min(at + PIECE, len(points))
        while end < len(points) and _letters()[points[end - 1]]:
            end += 1
        parts.append(_counts(points[at:end]))
        at = end
    return _merge(parts)


def ranked(codes: np.ndarray, counts: np.ndarray, top: int) -> np.ndarray:
    """The most frequent codes, ties by code."""
    return codes[np.lexsort((codes, -counts))[:top]]


def train(docs: DataFrame, top: int = TOP) -> dict[str, np.ndarray]:
    """docs (text, lang, any more) -> profiles. Counts cover all rows with text and lang; what reaches the driver is
    ``top`` n-grams of each language. Languages whose texts have no letter aren't learned; empty tables give no profile."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            waiting: dict[str, list] = {}
            found: dict[str, list] = {}
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                held = waiting.setdefault(lang, [[], 0])
                held[0].append(text)
                held[1] += len(text)
                if held[1] > PIECE // 2:
                    found.setdefault(lang, []).append(ngrams("\n".join(held[0])))
                    waiting[lang] = [[], 0]
            for lang, (texts, size) in waiting.items():
                if size:
                    found.setdefault(lang, []).append(ngrams("\n".join(texts)))
            for lang, parts in found.items():
                u, n = _merge(parts)
                yield pa.record_batch([pa.array([lang] * len(u), pa.string()), pa.array(u), pa.array(n.astype(np.int64))], names=["lang", "code", "n"])

    small_batches(docs.sparkSession)
    rows = docs.where("text is not null and lang is not null").select("lang", "text")
    total = rows.mapInArrow(count, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))
    # rows per language here: distinct n-grams, not texts
    best = total.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "code"))).where(F.col("rank") <= top)
    out: dict[str, list] = {}
    for r in best.select("lang", "rank", "code").collect():
        out.setdefault(r["lang"], []).append((r["rank"], r["code"]))
    return {lang: np.array([c for _, c in sorted(out[lang])]) for lang in sorted(out)}


def _judged(docs: DataFrame, profiles: dict[str, np.ndarray], top: int) -> DataFrame:
    """docs (text, any more) -> _row (docs' columns as a struct), lang_pred, score. Rows are packed, so that no name can clash."""
    langs = sorted(profiles, key=lambda x: x.encode())
    table = []
    for lang in langs:
        order = np.argsort(profiles[lang])
        table.append((profiles[lang][order], order))

    def judge(text: str | None) -> tuple[str, float]:
        codes, counts = ngrams(text or "")
        if not len(codes) or not langs:
            return UNKNOWN, 0.0
        doc = ranked(codes, counts, top)
        place = np.arange(len(doc))
        best = UNKNOWN, -1.0
        for lang, (known, rank) in zip(langs, table, strict=True):
            i = np.minimum(np.searchsorted(known, doc), len(known) - 1)
            off = np.where(known[i] == doc, np.minimum(np.abs(rank[i] - place), top), top).sum()
            score = 1 - off / (top * len(doc))
            if score > best[1]:
                best = lang, float(score)
        return best

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [judge(t.as_py()) for t in b.column(0).field(place)]
            yield pa.record_batch([b.column(0), pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())], names=["_row", "lang_pred", "score"])

    small_batches(docs.sparkSession)
    place = docs.columns.index("text")
    rows = docs.select(F.struct(*docs.columns).alias("_row"))
    return rows.mapInArrow(run, rows.select("_row", F.lit("").alias("lang_pred"), F.lit(0.0).alias("score")).schema)


def identify(docs: DataFrame, profiles: dict[str, np.ndarray], top: int = TOP) -> DataFrame:
    """docs (text, any more) -> the same columns and lang_pred, score, by the whole text alone.

    lang_pred is ``und`` and score 0 for null texts, texts without a letter, and if there are no profiles. score is 1 for
    a text ranked exactly as the profile and falls to 0 as its n-grams lie out of place or are missing. Ties go to the first language in code-point order.
    Rows are judged one by one; columns named lang_pred or score, in any case, are replaced.
    """
    rest = [c for c in docs.columns if c.lower() not in ("lang_pred", "score")]
    return _judged(docs, profiles, top).select(*(F.col("_row")[c].alias(c) for c in rest), "lang_pred", "score")


def told_rows(docs: DataFrame, profiles: dict[str, np.ndarray], top: int = TOP) -> DataFrame:
    """The rows of docs whose language can be told, with all their columns: null texts, texts without a letter and texts without an n-gram of any profile go."""
    return _judged(docs, profiles, top).where((F.col("lang_pred") != UNKNOWN) & (F.col("score") > 0)).select("_row.*")


def held_out() -> Column:
    """Whether a row is kept from training: crc32 of doc_id as text, modulo 3, is 1. A null doc_id counts as empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), F.lit(3)) == 1
