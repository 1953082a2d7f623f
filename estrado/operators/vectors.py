"""Vector search: exact, by tiles of queries and vectors that meet on the executors, and approximate, by an inverted file of cells.

A tile is a block of queries and a block of vectors, both bounded in bytes; it passes on only the k best of each query, and these are merged. No query vector reaches the driver.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import shared_folder
from . import filters

DIGITS = 9
#: Bytes of the queries and of the vectors of a tile; cells of an inverted file at most, and rows by cell that its centroids are trained on.
QUERY_BYTES, VECTOR_BYTES = 8 << 20, 32 << 20
MOST_CELLS, TRAINED = 4096, 256


def unit(column: pa.ListArray, dim: int) -> np.ndarray:
    """Vectors scaled to length 1; nulls and zeros give no number."""
    x = column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, dim)
    with np.errstate(divide="ignore", invalid="ignore"):
        return x / np.sqrt(np.einsum("nd,nd->n", x, x))[:, None]


def _heaps(ks: list[int]):
    def run(queries: pa.Table, vectors: pa.Table) -> pa.Table:
        """The k best of each query and list within a tile. Ties after rounding go to the smaller chunk_id."""
        lists, asked, found, values = [], [], [], []
        if queries.num_rows and vectors.num_rows:
            vectors = vectors.take(pc.sort_indices(vectors.column("chunk_id"))).combine_chunks()
            dim = len(queries.column("vector")[0])
            v, q = unit(vectors.column("embedding").combine_chunks(), dim), unit(queries.column("vector").combine_chunks(), dim)
            passing = [vectors.column(f"_l{i}").to_numpy() for i in range(len(ks))]
            good = np.isfinite(v).all(axis=1)
            step = max(1, (1 << 22) // len(v))
            for lo in range(0, len(q), step):
                raw = q[lo : lo + step] @ v.T
                s = np.round(raw, DIGITS)
                for i, k in enumerate(ks):
                    mine = np.flatnonzero(passing[i] & good)
                    if not len(mine):
                        continue
                    for r in np.flatnonzero(np.isfinite(q[lo : lo + step]).all(axis=1)).tolist():
                        row = s[r, mine]
                        if len(row) > k:
                            least = np.partition(row, len(row) - k)[len(row) - k]
                            at = np.flatnonzero(row > least)
                            at = np.concatenate([at, np.flatnonzero(row == least)[: k - len(at)]])
                        else:
                            at = np.arange(len(row))
                        lists.append(np.full(len(at), i, np.int32))
                        asked.append(np.full(len(at), lo + r))
                        found.append(mine[at])
                        values.append(raw[r, mine[at]])
        join = lambda parts, kind: np.concatenate([np.zeros(0, kind), *parts]).astype(kind)
        ids = queries.column("query_id").take(pa.array(join(asked, np.int64)))
        return pa.table([pa.array(join(lists, np.int32)), ids, vectors.column("chunk_id").take(pa.array(join(found, np.int64))), pa.array(join(values, np.float64))], names=["list", "query_id", "chunk_id", "similitud"])

    return run


def _tiled(asked: DataFrame, held: DataFrame, groups: list[tuple[int, int, int]], ks: list[int]) -> DataFrame:
    """asked (query_id, vector, g), held (chunk_id, embedding, _l0.., g), groups (g, blocks of queries, blocks of vectors): few -> list, query_id, chunk_id, similitud, rank.

    A query meets every vector of its groups: its block goes to as many tiles as the group has blocks of vectors, and the other way round.
    """
    spark = asked.sparkSession
    spec = F.broadcast(spark.createDataFrame(groups, "g int, qb int, vb int"))
    block = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    q = asked.join(spec, "g").select("query_id", "vector", "g", block("query_id", "qb").alias("i"), every("vb").alias("j"))
    v = held.join(spec, "g").select("chunk_id", "embedding", *(f"_l{n}" for n in range(len(ks))), "g", every("qb").alias("i"), block("chunk_id", "vb").alias("j"))
    schema = q.select(F.lit(0).alias("list"), "query_id").crossJoin(v.limit(0).select("chunk_id")).withColumn("similitud", F.lit(0.0)).schema
    scored = q.groupBy("g", "i", "j").cogroup(v.groupBy("g", "i", "j")).applyInArrow(_heaps(ks), schema).withColumn("similitud", F.round("similitud", DIGITS))
    best = scored.withColumn("rank", F.row_number().over(Window.partitionBy("list", "query_id").orderBy(F.desc("similitud"), F.asc("chunk_id"))))
    return best.where(F.col("rank") <= F.array(*map(F.lit, ks))[F.col("list")])


def _blocks(rows: int, dim: int, most: int) -> int:
    return max(1, -(-rows * dim * 8 // most))


def _asked(queries: DataFrame) -> DataFrame:
    return queries.select("query_id", F.col("vector").cast("array<double>").alias("vector")).where("size(vector) > 0")


def _held(chunks: DataFrame, lists: list[tuple[int, dict | None]]) -> DataFrame:
    """Vectors that pass any of the filters, each filter as a flag."""
    flags = [filters.dense(where).alias(f"_l{i}") for i, (_, where) in enumerate(lists)]
    some = F.lit(False)
    for i in range(len(lists)):
        some = some | F.col(f"_l{i}")
    kind = "embedding" if chunks.schema["embedding"].dataType.simpleString() in ("array<float>", "array<double>") else F.col("embedding").cast("array<double>").alias("embedding")
    return chunks.select("chunk_id", kind, *flags).where(some & F.expr("size(embedding) > 0"))


def dense_lists(chunks: DataFrame, queries: DataFrame, lists: list[tuple[int, dict | None]]) -> DataFrame:
    """chunks (chunk_id, embedding, columns of the filters), queries (query_id, vector), lists of (k, filter) -> list, query_id, chunk_id, similitud, rank, in one pass over the vectors.

    Exact: every vector that passes a filter is scored. Vectors that are null, zero, or of another length than the query aren't ranked.
    """
    asked, held = _asked(queries).withColumn("g", F.size("vector")), _held(chunks, lists).withColumn("g", F.size("embedding"))
    sizes = asked.groupBy("g").agg(F.count(F.lit(1)).alias("q"), F.lit(0).cast("long").alias("v")).unionByName(held.groupBy("g").agg(F.lit(0).cast("long").alias("q"), F.count(F.lit(1)).alias("v")))
    groups = [(g, _blocks(q, g, QUERY_BYTES), _blocks(v, g, VECTOR_BYTES)) for g, q, v in sizes.groupBy("g").agg(F.sum("q"), F.sum("v")).collect() if q and v]  # lengths of vectors
    return _tiled(asked, held, groups or [(0, 1, 1)], [k for k, _ in lists])


def dense_topk(chunks: DataFrame, queries: DataFrame, k: int, where: dict | None = None) -> DataFrame:
    """query_id, chunk_id, similitud, rank of the k nearest vectors that pass the filter; see ``dense_lists``."""
    return dense_lists(chunks, queries, [(k, where)]).drop("list")


def _nearest(vectors: np.ndarray, centroids: np.ndarray, n: int) -> np.ndarray:
    """The n nearest cells of each vector, nearest first; ties after rounding go to the smaller cell. -1 for vectors without direction."""
    s = np.round(vectors @ centroids.T, DIGITS)
    out = np.argsort(-s, axis=1, kind="stable")[:, :n] if n > 1 else s.argmax(axis=1)[:, None]
    out[~np.isfinite(vectors).all(axis=1)] = -1
    return out


@dataclass
class Ivf:
    """An inverted file below ``path``: ``centroids`` (cell, centroid) and ``vectors``, the chunks' columns in a partition for each cell."""

    spark: SparkSession
    path: str

    @property
    def vectors(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/vectors")

    def centroids(self) -> np.ndarray:
        """At most MOST_CELLS rows."""
        t = self.spark.read.parquet(f"{self.path}/centroids").orderBy("cell").toArrow()
        return unit(t.column("centroid").combine_chunks(), len(t.column("centroid")[0])) if t.num_rows else np.zeros((0, 1))

    def topk(self, queries: DataFrame, k: int, probes: int = 8, where: dict | None = None) -> DataFrame:
        """queries (query_id, vector) -> query_id, chunk_id, similitud, rank: the k best of the ``probes`` cells nearest to a query, ranked exactly; filters apply within cells. Files of other cells aren't read."""
        spark, cells = self.spark, self.centroids()
        if not len(cells):
            return _tiled(_asked(queries).withColumn("g", F.lit(0)), _held(self.vectors, [(k, where)]).withColumn("g", F.lit(0)), [(-1, 1, 1)], [k]).drop("list")
        sent, dim = spark.sparkContext.broadcast(cells), cells.shape[1]

        def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                near = _nearest(unit(b.column(1), dim), sent.value, min(probes, len(sent.value)))
                at = np.repeat(np.arange(b.num_rows), near.shape[1])
                yield pa.record_batch([*(c.take(pa.array(at)) for c in b.columns), pa.array(near.ravel().astype(np.int32))], names=["query_id", "vector", "g"])

        asked = _asked(queries).where(F.size("vector") == dim)
        path = f"{shared_folder(spark)}/probes-{uuid.uuid4().hex}"
        asked.mapInArrow(probe, f"query_id {asked.schema['query_id'].dataType.simpleString()}, vector array<double>, g int").where("g >= 0").write.parquet(path)
        probed = spark.read.parquet(path)
        sizes = {r["cell"]: r["n"] for r in spark.read.parquet(f"{self.path}/sizes").collect()}  # a row per cell
        groups = [(g, _blocks(n, dim, QUERY_BYTES), _blocks(sizes.get(g, 0), dim, VECTOR_BYTES)) for g, n in probed.groupBy("g").count().collect()]  # cells
        rows = self.vectors.where(F.col("cell").isin([g for g, _, _ in groups]))
        cell = F.col("cell").alias("g")
        flagged = rows.select("chunk_id", "embedding", filters.dense(where).alias("_l0"), cell).where(F.col("_l0"))
        return _tiled(probed, flagged, groups or [(-1, 1, 1)], [k]).drop("list")


def probes_for(index: Ivf, queries: DataFrame, k: int, recall: float = 0.95) -> int:
    """The least number of probes with which ``queries`` (a sample: query_id, vector) get ``recall`` of their k exact neighbours on average; all cells if none does.

    Each exact neighbour's cell is looked up, and its place among the cells nearest to the query; the counts by place reach the driver.
    """
    cells = index.centroids()
    if not len(cells):
        return 1
    sent, dim = index.spark.sparkContext.broadcast(cells), cells.shape[1]

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            near = _nearest(unit(b.column(0), dim), sent.value, len(sent.value))
            place = (near == b.column(1).to_numpy()[:, None]).argmax(axis=1) + 1
            yield pa.record_batch([pa.array(place.astype(np.int32))], names=["place"])

    held = index.vectors.select("chunk_id", "embedding", "cell")
    exact = dense_topk(held, queries, k).join(held.select("chunk_id", "cell"), "chunk_id").join(_asked(queries), "query_id")
    told = exact.select("vector", "cell").mapInArrow(places, "place int").groupBy("place").count().orderBy("place").collect()  # cells
    reached, wanted = 0, recall * sum(r["count"] for r in told)
    for r in told:
        reached += r["count"]
        if reached >= wanted:
            return r["place"]
    return len(cells)


def ivf_index(chunks: DataFrame, path: str | None = None, cells: int | None = None, rounds: int = 5, trained: int | None = TRAINED) -> Ivf:
    """Builds an inverted file of chunks (chunk_id, embedding, any more), whose vectors have one length (others, null and zero ones are in no cell).

    ``cells`` is the square root of the number of vectors by default, and at most MOST_CELLS. Centroids start from the vectors first in the order of md5(chunk_id) and are moved ``rounds``
    times to the mean direction of their cell; they are trained on about ``trained`` vectors a cell, drawn by that hash (all, if there are fewer or ``trained`` is None). Every vector is filed.
    """
    spark = chunks.sparkSession
    path = (path or f"{shared_folder(spark)}/ivf-{uuid.uuid4().hex}").rstrip("/")
    lengths = chunks.where("size(embedding) > 0").groupBy(F.size("embedding").alias("dim")).count().orderBy(F.desc("count"), "dim").first()
    dim, n = (lengths[0], lengths[1]) if lengths else (1, 0)
    cells = min(MOST_CELLS, cells or max(1, int(n**0.5)))
    vectors = chunks.where(F.size("embedding") == dim).withColumn("embedding", F.col("embedding").cast("array<double>")).where("exists(embedding, x -> x <> 0) and forall(embedding, x -> x is not null and not isnan(x))")
    drawn = F.md5(F.col("chunk_id").cast("string"))
    share = min(1.0, cells * trained / max(1, n)) if trained else 1.0
    sample = vectors.select("chunk_id", "embedding") if share == 1 else vectors.where(drawn < F.lit(f"{int(share * 0xFFFFFFFF):08x}")).select("chunk_id", "embedding")
    first = vectors.select("embedding", drawn.alias("h")).orderBy("h").limit(cells).toArrow()  # at most MOST_CELLS
    held = unit(first.column("embedding").combine_chunks(), dim) if first.num_rows else np.zeros((0, dim))
    for _ in range(rounds if len(held) else 0):
        sums = sample.mapInArrow(_cell_sums(spark.sparkContext.broadcast(held), dim), "cell int, sums array<double>")
        total = sums.select("cell", F.posexplode("sums").alias("i", "x")).groupBy("cell", "i").agg(F.sum("x").alias("x")).groupBy("cell").agg(F.sort_array(F.collect_list(F.struct("i", "x"))).alias("s"))
        for r in total.select("cell", F.transform("s", lambda e: e["x"]).alias("s")).collect():  # cells
            s = np.array(r["s"])
            if size := np.sqrt(s @ s):
                held[r["cell"]] = s / size
    spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(held)], "cell int, centroid array<double>").write.mode("overwrite").parquet(f"{path}/centroids")
    filed = vectors.mapInArrow(_filed(spark.sparkContext.broadcast(held), dim), spark.createDataFrame([], vectors.schema).withColumn("cell", F.lit(0)).schema) if len(held) else vectors.withColumn("cell", F.lit(0))
    sizes = filed.groupBy("cell").agg(F.count(F.lit(1)).alias("n"))
    sizes.write.mode("overwrite").parquet(f"{path}/sizes")
    parts = F.broadcast(spark.read.parquet(f"{path}/sizes").select("cell", F.ceil(F.col("n") * dim * 8 / VECTOR_BYTES).alias("_parts")))  # a row per cell
    spread = filed.join(parts, "cell").withColumn("_part", F.pmod(F.xxhash64("chunk_id"), F.col("_parts"))).repartition("cell", "_part").drop("_parts", "_part")
    to = spread.write.mode("overwrite")
    (to.partitionBy("cell") if n else to).parquet(f"{path}/vectors")  # a partitioned table without rows would have no schema
    return Ivf(spark, path)


def _cell_sums(sent: Broadcast, dim: int):
    """Sums of the directions in each cell, of one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, seen = np.zeros_like(sent.value), np.zeros(len(sent.value), bool)
        for b in batches:
            v = unit(b.column(1), dim)
            at = _nearest(v, sent.value, 1)[:, 0]
            np.add.at(total, at[at >= 0], v[at >= 0])
            seen[at[at >= 0]] = True
        cells = np.flatnonzero(seen)
        yield pa.record_batch([pa.array(cells.astype(np.int32)), pa.array(list(total[cells]), pa.list_(pa.float64()))], names=["cell", "sums"])

    return run


def _filed(sent: Broadcast, dim: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = _nearest(unit(b.column(b.schema.get_field_index("embedding")), dim), sent.value, 1)[:, 0]
            yield pa.record_batch([*b.columns, pa.array(at.astype(np.int32))], names=[*b.schema.names, "cell"])

    return run
