"""Sharding by vector bin packing: bytes, tokens and rows are balanced jointly.

Equal texts form a group. A group that holds more than a 16,384th of the corpus in any of the three dimensions is placed
by itself, in pieces if it holds a large share; there are few such groups whatever the size of the corpus. All
others are gathered by the hash of their text into a fixed number of bins. Only the vectors of those groups, pieces and bins, whose number is
bounded by parameters and never by the corpus, are packed on the driver: largest first, each to the
shard where the dot product of its vector with the residual capacity is highest.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .scratch import stored

WORD = r"[^\x20\x09-\x0D]+"


def pack(items: np.ndarray, shards: int) -> np.ndarray:
    """Shard of each row of ``items`` (one column per dimension), by the dot-product heuristic.

    Items that fit no shard's residual capacity go where the product is highest all the same.
    """
    out = np.zeros(len(items), dtype=np.int64)
    if not len(items):
        return out
    total = items.sum(axis=0)
    v = items / np.where(total > 0, total / shards, 1.0)
    residual = np.ones((shards, items.shape[1]))
    for i in np.lexsort((np.arange(len(v)), -v.sum(axis=1))):
        score = residual @ v[i]
        fits = (residual - v[i] >= -1e-9).all(axis=1)
        if fits.any():
            score = np.where(fits, score, -np.inf)
        out[i] = k = int(np.argmax(score))
        residual[k] -= v[i]
    return out


def assign_shards(docs: DataFrame, shards: int = 16, bins: int = 4096, pieces_per_shard: int = 64, groups: int = 1 << 14) -> DataFrame:
    """docs (doc_id, text, any more) -> doc_id, size, tokens, text_crc32, shard, slot; one row per input row.

    size: UTF-8 bytes of the text plus 1; a null text counts as no bytes, its CRC is 0, and null texts
    are one group, as are empty ones. Null doc_ids are rows like any other. Rows of a group that is cut are dealt to its pieces
    by their place in the input, repeated rows too. slot counts from 0 without gaps in each shard. Other columns are ignored. An empty table gives no rows.
    At most 3 * (groups + shards * pieces_per_shard) groups and pieces, and ``bins`` bins, are placed.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    slim = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text) + F.lit(1)).cast("long").alias("size"),
        F.regexp_count(text, F.lit(WORD)).cast("long").alias("tokens"),
        F.crc32(text).alias("text_crc32"),
        F.xxhash64("text", F.col("text").isNull()).alias("grp"),
    )
    slim = stored(slim.withColumn("row", F.monotonically_increasing_id()), "shard-sizes")
    sums = [F.sum("size").alias("bytes"), F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("rows")]
    total = slim.agg(*sums).first()
    if not total["rows"]:
        return slim.select("doc_id", "size", "tokens", "text_crc32", F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"))
    share = F.greatest(*(F.col(k) / F.lit(float(max(total[k], 1))) for k in ("bytes", "tokens", "rows")))
    heavy = slim.groupBy("grp").agg(*sums).where(share * groups > 1).select("grp", F.least("rows", F.ceil(share * F.lit(shards * pieces_per_shard))).alias("pieces")).collect()  # bounded, see above
    at, start = bins, []
    for g, n in sorted(heavy):
        start.append((g, at, int(n)))
        at += int(n)
    spark = docs.sparkSession
    split = F.broadcast(spark.createDataFrame(start, "grp long, first int, pieces int"))
    binned = slim.join(split, "grp", "left").select(
        "doc_id", "size", "tokens", "text_crc32", "row",
        F.when(F.col("pieces") > 0, F.col("first") + F.pmod(F.xxhash64("row"), F.col("pieces"))).otherwise(F.pmod("grp", F.lit(bins))).cast("int").alias("bin"),
    )
    found = sorted(binned.groupBy("bin").agg(*sums).collect())  # one row per bin, group or piece
    placed = pack(np.array([[r["bytes"], r["tokens"], r["rows"]] for r in found], dtype=float), shards)
    after, where = [0] * shards, []
    for r, k in zip(found, placed.tolist(), strict=True):
        where.append((r["bin"], k, after[k]))
        after[k] += r["rows"]
    where = F.broadcast(spark.createDataFrame(where, "bin int, shard int, first_slot long"))
    order = Window.partitionBy("bin").orderBy("doc_id", "text_crc32", "size", "row")
    ranked = binned.withColumn("rn", F.row_number().over(order))
    return ranked.join(where, "bin").select("doc_id", "size", "tokens", "text_crc32", "shard", (F.col("first_slot") + F.col("rn") - 1).cast("long").alias("slot"))


def spread(sizes: list[float]) -> float:
    """Largest over mean, less one; 0 is an exact balance."""
    mean = math.fsum(sizes) / max(len(sizes), 1)
    return max(sizes, default=0.0) / mean - 1 if mean else 0.0
