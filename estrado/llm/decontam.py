"""Benchmark decontamination by spaced-seed hashing.

Fixed masks are slid over the tokens; a seed hashes the tokens at the mask's ones and ignores those at its zeros, so a
substituted token spoils only the seeds that look at it. The benchmark's seeds are a table; a Bloom filter of bounded size
keeps back the documents' seeds that can't be in it, and the rest is joined by hash. Each hit gives a diagonal on which the
item is laid over the document: a stretch of enough tokens, most of them equal, is a leak. Equal texts are searched alike and verified once.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import stored
from .streams import Hashes, few, fresh, numbered, small_batches

#: Fixed values. Enumeration shows that each way to substitute a fifth of a stretch of 13 to 25 tokens leaves a hit of one of MASKS (longer
#: stretches hold one of these lengths as good), and of a whole item of 9 to 12 tokens a hit of one of SHORT_MASKS.
MASKS = ("1101111", "110010001011", "1110001010001", "111111")
SHORT_MASKS = ("110111", "11001011", "11111")
LEAST_SEEDED = 9
LEAST_TOKENS, IDENTITY = 13, 0.8
#: (mask, fewest tokens of an item, most): the shortest items are hashed whole.
KINDS = (*((m, 13, 1 << 62) for m in MASKS), *((m, LEAST_SEEDED, 12) for m in SHORT_MASKS), *(("1" * n, n, n) for n in range(1, LEAST_SEEDED)))
TOKENS = re.compile(r"\w+")
_MIX = np.random.default_rng(20240229).integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def tokens(text: str | None, known: Hashes) -> np.ndarray:
    """Hashes of the lower-cased words of a whole text; tokens are equal if their hashes of 64 bits are."""
    return known.of(TOKENS.findall((text or "").lower()))


def seeds(ids: np.ndarray, kind: int) -> np.ndarray:
    """Hashes of a kind's mask at each of its positions over token hashes."""
    mask = KINDS[kind][0]
    n = len(ids) - len(mask) + 1
    h = np.full(max(n, 0), kind + 1, np.uint64)
    if n > 0:
        for k, on in enumerate(mask):
            if on == "1":
                h ^= ids[k : k + n]
                h *= _MIX[k]
                h ^= h >> np.uint64(29)
    return h


def stretch(item: np.ndarray, doc: np.ndarray, shift: int) -> tuple[int, int, int] | None:
    """The longest stretch with enough equal tokens when the item starts at ``shift`` in the document: (start in the document, tokens, equal)."""
    a, b = max(0, -shift), min(len(item), len(doc) - shift)
    least = min(LEAST_TOKENS, len(item))
    if b - a < least:
        return None
    same = item[a:b] == doc[a + shift : b + shift]
    if len(item) < LEAST_SEEDED and not same.all():
        return None
    # sum of (equal - identity) over a stretch is >= 0 just where its share of equal tokens is >= identity
    run = np.concatenate([[0.0], np.cumsum(same - IDENTITY)])
    low = np.minimum.accumulate(run)
    top = np.maximum.accumulate(run[::-1])[::-1]
    i, found = 0, None
    for start in range(len(run)):
        if start and low[start] == low[start - 1]:
            continue  # a lower start further left does at least as well
        i = max(i, start)
        while i + 1 < len(run) and top[i + 1] >= run[start] - 1e-9:
            i += 1
        if i - start >= least and (found is None or i - start > found[1] - found[0]):
            found = start, i
    if found is None:
        return None
    return a + shift + found[0], found[1] - found[0], int(same[found[0] : found[1]].sum())


def benchmark_tokens(benchmark: DataFrame) -> DataFrame:
    """benchmark (item_id, text, any more) -> item (a number), item_id, n, tokens array<long>; items without tokens are left out. Stored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Hashes()
        for b in batches:
            found = [tokens(t, known) for t in b.column(1).to_pylist()]
            yield pa.record_batch([b.column(0), pa.array([len(t) for t in found], pa.int32()), pa.array([t.view(np.int64) for t in found], pa.list_(pa.int64()))], names=["item_id", "n", "tokens"])

    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where("text is not null").mapInArrow(run, "item_id long, n int, tokens array<long>")
    return numbered(items.where("n > 0"), "item", F.col("item_id").asc_nulls_last(), "tokens")


def benchmark_seeds(items: DataFrame) -> DataFrame:
    """items (item, n, tokens) -> seed long, item long, at int, kind int. Stored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for item, t in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                ids = t.values.to_numpy().view(np.uint64)
                for k, (_, low, high) in enumerate(KINDS):
                    if low <= len(ids) <= high:
                        h = seeds(ids, k)
                        yield pa.record_batch([pa.array(h.view(np.int64)), pa.array(np.full(len(h), item)), pa.array(np.arange(len(h), dtype=np.int32)), pa.array(np.full(len(h), k, np.int32))], names=["seed", "item", "at", "kind"])

    return stored(items.select("item", "tokens").mapInArrow(run, "seed long, item long, at int, kind int"), "benchmark-seeds")


class Bloom:
    """A Bloom filter over 64-bit hashes, of 2**``power`` bits, four of them for each hash. ``words``: (number, value) of its 64-bit words that aren't 0."""

    def __init__(self, power: int, number: np.ndarray, value: np.ndarray):
        self.mask = np.uint64((1 << power) - 1)
        self.bits = np.zeros((1 << power) // 64, np.uint64)
        self.bits[number] = value.view(np.uint64)

    def hits(self, h: np.ndarray) -> np.ndarray:
        """Where a hash may be in the set, ascending."""
        at = np.arange(len(h))
        for shift in (0, 12, 24, 36):
            p = (h[at] >> np.uint64(shift)) & self.mask
            at = at[(self.bits[p >> np.uint64(6)] >> (p & np.uint64(63))) & np.uint64(1) == 1]
        return at


def bloom(known: DataFrame, most_power: int = 27) -> Bloom:
    """A filter of 32 bits a seed, of at most 2**``most_power`` bits (16 MB); beyond, more seeds pass, and the join drops them."""
    n = known.count()
    power = min(most_power, max(16, (32 * n).bit_length()))
    place = F.explode(F.array(*(F.shiftrightunsigned("seed", s).bitwiseAND(F.lit((1 << power) - 1)) for s in (0, 12, 24, 36))))
    words = known.select(place.alias("p")).groupBy(F.shiftright("p", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p & 63 as int))")).alias("bits")).toArrow()
    return Bloom(power, words.column(0).to_numpy(), words.column(1).to_numpy())


def _passing(rows: list[int], texts: list[np.ndarray], kinds: list[int], held: Bloom) -> tuple[pa.Array, pa.Array, pa.Array]:
    """(row, seed, position in its text) of the seeds of texts that the filter lets through."""
    sizes = np.array([len(t) for t in texts])
    ends = np.cumsum(sizes)
    ids, out = np.concatenate(texts), [[np.zeros(0, int)], [np.zeros(0, np.uint64)], [np.zeros(0, int)]]
    for k in kinds:
        h = seeds(ids, k)
        p = held.hits(h)
        text = np.searchsorted(ends, p, side="right")
        inside = p + len(KINDS[k][0]) <= ends[text]  # windows lie within one text
        p, text = p[inside], text[inside]
        out[0].append(np.asarray(rows)[text])
        out[1].append(h[p])
        out[2].append(p - (ends - sizes)[text])
    row, seed, place = (np.concatenate(x) for x in out)
    return pa.array(row), pa.array(seed.view(np.int64)), pa.array(place)


def _text_key(name1: str, name2: str) -> list:
    """Equal texts by two hashes of 64 bits."""
    return [F.xxhash64("text").alias(name1), F.xxhash64(F.lit(1), "text").alias(name2)]


def leaks(docs: DataFrame, benchmark: DataFrame, most: int = 1_000_000) -> DataFrame:
    """docs (text, any more), benchmark (item_id, text, any more) -> t1, t2 (hashes of the text), item, item_id, start, tokens, equal, coverage. Stored.

    One row for each distinct text and item that leaks into it, with the longest and then the earliest stretch. A leak is a stretch of at least 13 tokens (or
    the whole item, if it has 9 to 12) that lies on one diagonal of an item and the document with 80% or more of its tokens equal. Items of fewer tokens leak
    where all their tokens follow each other. Null texts, and items without tokens, have none. Repeated and null item_ids are items of their own. Tables of
    keys and of the benchmark are broadcast up to ``most`` rows and joined by shuffles beyond.
    """
    spark = docs.sparkSession
    small_batches(spark)
    items = benchmark_tokens(benchmark)
    known = benchmark_seeds(items)
    kinds = sorted(r[0] for r in known.select("kind").distinct().collect())  # of the few masks
    sieve = spark.sparkContext.broadcast(bloom(known))

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, held = Hashes(), sieve.value
        for b in batches:
            waiting, size = [], 0
            for i, t in enumerate(b.column(2)):
                waiting.append((i, tokens(t.as_py(), hashes)))
                size += len(waiting[-1][1])
                if size >= 1 << 16 or i == b.num_rows - 1:  # the seeds of many texts are made at once
                    row, seed, place = _passing([x[0] for x in waiting], [x[1] for x in waiting], kinds, held)
                    yield pa.record_batch([b.column(0).take(row), b.column(1).take(row), seed, place], names=["t1", "t2", "seed", "place"])
                    waiting, size = [], 0

    slim = docs.select(*_text_key("t1", "t2"), "text").where("text is not null")
    hits = slim.mapInArrow(look, "t1 long, t2 long, seed long, place long")
    spots = hits.join(few(known.select("seed", "item", "at"), most), "seed").select("t1", "t2", "item", (F.col("place") - F.col("at")).alias("shift"))
    spots = stored(spots.distinct(), "diagonals")
    texts = slim.join(few(stored(spots.select("t1", "t2").distinct(), "hit-texts"), most), ["t1", "t2"], "left_semi").groupBy("t1", "t2").agg(F.first("text").alias("text"))
    asked = spots.join(few(items, most, 8 * F.size("tokens") + 32), "item").select("t1", "t2", F.lit(1).alias("kind"), "item", "item_id", "shift", "tokens", F.lit(None).cast("string").alias("text"))
    none = [F.lit(None).cast(c).alias(n) for n, c in (("item", "long"), ("item_id", "long"), ("shift", "long"), ("tokens", "array<long>"))]
    both = asked.unionByName(texts.select("t1", "t2", F.lit(0).alias("kind"), *none, "text"))

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, doc, now, best = Hashes(), np.zeros(0, np.uint64), None, None
        for b in batches:  # sorted: a text is followed by the diagonals of its items
            out = []
            for t1, t2, kind, item, name, shift, t, text in zip(*(b.column(i).to_pylist() for i in range(6)), b.column(6), b.column(7), strict=True):
                if (t1, t2, item) != now:
                    if best:
                        out.append((*now, *best))
                    now, best = (t1, t2, item), None
                if not kind:
                    doc = tokens(text.as_py(), hashes)
                    continue
                own = t.values.to_numpy().view(np.uint64)
                got = stretch(own, doc, shift)
                if got and (best is None or (-got[1], got[0]) < (-best[2], best[1])):
                    best = (name, *got, got[1] / len(own))
            if out:
                yield pa.RecordBatch.from_pylist([dict(zip(schema.names, x, strict=True)) for x in out], schema)
        if best:
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, (*now, *best), strict=True))], schema)

    schema = pa.schema([("t1", pa.int64()), ("t2", pa.int64()), ("item", pa.int64()), ("item_id", pa.int64()), ("start", pa.int64()), ("tokens", pa.int64()), ("equal", pa.int64()), ("coverage", pa.float64())])
    told = both.repartition("t1", "t2").sortWithinPartitions("t1", "t2", "kind", "item", "shift").mapInArrow(verify, "t1 long, t2 long, item long, item_id long, start long, tokens long, equal long, coverage double")
    return stored(told, "leaks")


def leaked_rows(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", most: int = 1_000_000) -> DataFrame:
    """docs (id_col, text, any more) -> id_col, item_id, start, tokens, equal, coverage: a row for each of docs' rows and each item that leaks into it."""
    found = few(leaks(docs, benchmark, most), most)
    return docs.select(id_col, *_text_key("t1", "t2")).join(found, ["t1", "t2"]).select(id_col, "item_id", "start", found["tokens"], "equal", "coverage")


def find_leaks(docs: DataFrame, benchmark: DataFrame, most: int = 1_000_000) -> DataFrame:
    """docs (text, any more) -> docs' columns and leaks, an array of structs by item, empty where there is none; a column of that name is replaced.

    Every row is returned, repeated rows and null texts too. See ``leaks`` for what counts.
    """
    a, b = fresh(docs, "_t1"), fresh(docs, "_t2")
    parts = F.struct("item", "item_id", "start", "tokens", "equal", "coverage")
    found = leaks(docs, benchmark, most).groupBy(F.col("t1").alias(a), F.col("t2").alias(b)).agg(F.array_sort(F.collect_list(parts)).alias("leaks"))  # at most a row per item
    bare = F.transform(F.coalesce("leaks", F.array().cast("array<struct<item: bigint, item_id: bigint, start: bigint, tokens: bigint, equal: bigint, coverage: double>>")), lambda x: x.dropFields("item"))
    rest = docs.select(*[c for c in docs.columns if c.lower() != "leaks"], *_text_key(a, b))
    return rest.join(few(found, most, 56 * F.size("leaks") + 32), [a, b], "left").select(*[c for c in rest.columns if c not in (a, b)], bare.alias("leaks"))


def without_leaks(docs: DataFrame, benchmark: DataFrame, most: int = 1_000_000) -> DataFrame:
    """The rows of docs that hold no leak, with all their columns. Null texts and empty ones stay."""
    a, b = fresh(docs, "_t1"), fresh(docs, "_t2")
    found = leaks(docs, benchmark, most).select(F.col("t1").alias(a), F.col("t2").alias(b)).distinct()
    return docs.select("*", *_text_key(a, b)).join(few(stored(found, "leaked-texts"), most), [a, b], "left_anti").select(*docs.columns)
