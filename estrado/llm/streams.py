"""Helpers for tasks that read Arrow batches: groups of a sorted stream, and row identities."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import stored

BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def sorted_groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[tuple]:
    """(key, table) of each run of equal ``key`` in a stream whose partitions are sorted by it."""
    held: list[pa.RecordBatch] = []
    now = None
    for b in batches:
        if not b.num_rows:
            continue
        keys = b.column(b.schema.get_field_index(key)).to_numpy(zero_copy_only=False)
        cuts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)]
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            if held and keys[lo] != now:
                yield now, pa.Table.from_batches(held)
                held = []
            now = keys[lo]
            held.append(b.slice(lo, hi - lo))
    if held:
        yield now, pa.Table.from_batches(held)


def numbered(rows: DataFrame, name: str, *order: str | Column) -> DataFrame:
    """``rows``, stored, with a long ``name`` that counts from 0 in the given order without gaps, whatever the number of rows.

    A distributed sort: ranges are cut by ``order`` and then by row, so that equal rows spread too; a row's number is its place in
    its part of the range plus the rows of the parts before, of which only the counts reach the driver.
    """
    tie, at = fresh(rows, "_tie"), fresh(rows, "_at")
    by = [*(F.col(c) if isinstance(c, str) else c for c in order), F.col(tie)]
    spread = rows.withColumn(tie, F.monotonically_increasing_id()).repartitionByRange(*by).sortWithinPartitions(*by)
    spread = stored(spread.drop(tie).withColumn(at, F.monotonically_increasing_id()), "numbered")
    part = F.shiftright(at, 33)
    sizes = sorted(tuple(r) for r in spread.groupBy(part.alias("p")).agg(F.count(F.lit(1)).alias("n")).collect())  # a row per task
    starts = np.cumsum([0, *(n for _, n in sizes)]).tolist()
    base = rows.sparkSession.createDataFrame([(p, n) for (p, _), n in zip(sizes, starts, strict=False)], f"{tie} long, {name} long")
    named = spread.join(F.broadcast(base), part == F.col(tie)).withColumn(name, F.col(name) + F.col(at).bitwiseAND(F.lit((1 << 33) - 1)))
    return named.select(*rows.columns, name)


def fresh(df: DataFrame, name: str) -> str:
    """``name``, or what it takes to differ from every column of ``df``, in upper or lower case."""
    have = {c.lower() for c in df.columns}
    while name.lower() in have:
        name += "_"
    return name


def keyed(rows: DataFrame, name: str = "_key", id_col: str = "doc_id", text_col: str = "text", nulls_first: bool = False) -> DataFrame:
    """``rows`` with a long ``name`` that is unique and rises with the id (null last, or first), then with the text.

    Usually that is the id itself. Where ids repeat or are null, rows are numbered over
    a distributed sort of (id, text hash), and rows that agree in both follow each other.
    """
    ids = rows.agg(F.count(F.lit(1)), F.count(id_col), F.count_distinct(id_col)).first()
    if ids[0] == ids[1] == ids[2]:
        return rows.withColumn(name, F.col(id_col).cast("long"))
    first = F.col(id_col).asc_nulls_first() if nulls_first else F.col(id_col).asc_nulls_last()
    mark = fresh(rows, "_mark")
    return numbered(rows.withColumn(mark, F.xxhash64(text_col)), name, first, mark).drop(mark)


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Rows of whole texts reach the Python workers in batches of ``rows``, unless the session sets another number than Spark's default, 10,000: a batch is held in memory twice. The setting stays with the session, as plans are lazy."""
    if spark.conf.get(BATCH) == "10000":
        spark.conf.set(BATCH, str(rows))


#: Bytes of a table that may be broadcast.
MOST_BYTES = 32 << 20


def few(keys: DataFrame, most: int = 4_000_000, width: Column | None = None) -> DataFrame:
    """A stored table with a broadcast hint if it has at most ``most`` rows and its rows' ``width`` (8 bytes by default) is 32 MB at most; as it is beyond, so that joins shuffle."""
    rows, size = keys.agg(F.count(F.lit(1)), F.sum(F.lit(8) if width is None else width)).first()
    return F.broadcast(keys) if rows <= most and (size or 0) <= MOST_BYTES else keys


class Sets:
    """Disjoint sets over 0..n-1, merged in blocks of pairs; the least member is the root."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def union(self, a: np.ndarray, b: np.ndarray) -> None:
        root = self.root
        while True:
            x, y = root[a], root[b]
            open_ = x != y
            if not open_.any():
                return
            a, b, x, y = a[open_], b[open_], x[open_], y[open_]
            np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
            while True:
                up = root[root]
                if (up == root).all():
                    break
                root[:] = up


class Hashes(dict):
    """XXH64 (seed 42) by word, kept once computed; emptied when it has grown large."""

    def __missing__(self, word: str | bytes) -> int:
        if len(self) >= 100_000:
            self.clear()
        out = self[word] = xxhash.xxh64_intdigest(word, 42)
        return out

    def of(self, words: list) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))
