"""Connected components of an edge list: local forests, then alternating large-star and small-star rounds.

Every task first replaces its edges by a spanning forest whose nodes point to the least one, so that chains within a part are
gone at once. Rounds are joins and min-aggregations with map-side combine; a node with very many
neighbours is never gathered, and the join on it can be split by AQE's skew handling.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import stored
from .streams import Sets

#: Edges that a task holds at once.
CHUNK = 1 << 20


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def solved(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        u, v = (np.concatenate([b.column(i).to_numpy() for b in held]) for i in range(2))
        nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
        sets = Sets(len(nodes))
        sets.union(at[: len(u)], at[len(u) :])
        low = np.flatnonzero(sets.root != np.arange(len(nodes)))
        return pa.record_batch([pa.array(nodes[low]), pa.array(nodes[sets.root[low]])], names=["u", "v"])

    held, size = [], 0
    for b in batches:
        if b.num_rows:
            held.append(b)
            size += b.num_rows
        if size >= CHUNK:
            yield solved(held)
            held, size = [], 0
    if held:
        yield solved(held)


def _kept(edges: DataFrame, name: str) -> DataFrame:
    """Distinct edges with u > v, as the forests of the tasks that hold them."""
    e = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct()
    return stored(e.mapInArrow(_forest, "u long, v long"), name)


def _done(e: DataFrame) -> bool:
    """Whether every node has one root, and no root has one."""
    ends = e.select(F.col("u").alias("n"), F.lit(1).alias("low"), F.lit(0).alias("root")).unionByName(e.select(F.col("v").alias("n"), F.lit(0).alias("low"), F.lit(1).alias("root")))
    return ends.groupBy("n").agg(F.sum("low").alias("low"), F.max("root").alias("root")).where("low > 1 or (low = 1 and root = 1)").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """edges (u long, v long) -> (node long, root long): root is the smallest node reachable.

    Only nodes with an edge to another node appear. Nulls, loops and repeated edges are ignored;
    an empty list gives an empty table.
    """
    e = _kept(edges, "edges")
    while not _done(e):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), F.least("u", "m").alias("m"))
        big = both.where("v > u").join(low, F.col("u") == F.col("k")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        big = stored(big.where("u <> v").distinct(), "large-star")
        low = big.groupBy("u").agg(F.min("v").alias("m"))
        rest = big.join(low.withColumnRenamed("u", "k"), F.col("u") == F.col("k")).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = _kept(rest.unionByName(low.select("u", F.col("m").alias("v"))), "small-star")
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
