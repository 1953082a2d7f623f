"""BM25 over a segmented index: documents with their terms, blocks of postings with bounds, delta segments, tombstones, and top-k by scan or in two steps.

A batch of queries whose terms have more postings than the index has tokens is scored by one scan: the documents' stored terms meet all queries in NumPy, and a
task passes on its best. Other batches read postings, whose blocks are made from the documents' terms when they are first asked for.

Documents are numbered in the order of their identifiers and cut into ranges of RANGE. A row of ``blocks`` holds the postings of a term in one range, with the
largest frequency and the smallest length in it, which bound a posting's score whatever the averages are; rows are range-partitioned by (term, range), so that the
postings of a frequent term lie in many files. Such a query first adds up bounds by range, scores the most promising ranges exactly, and then reads
only the ranges whose bound reaches the k-th score found.

An upsert adds a segment with its documents, the identifiers that it takes from earlier segments, and the change of document
frequencies; the last segment's ``stats`` has the merged totals and is written last, so that a segment that failed halfway isn't seen.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import tokens
from ..session import shared_folder
from .sizes import MOST, small

# BM25 parameters.
K1, B, EPSILON = 1.5, 0.75, 0.25
#: Lexical scores are sums over many terms, whose order varies; they are rounded more, so that equal scores stay equal.
SCORE_DIGITS = 6
#: Documents of a range (a power of two), ranges that a query scores first, bytes of texts and postings of a task.
RANGE, FIRST, TASK_BYTES, TASK_POSTINGS = 32, 16, 64 << 20, 2_000_000
#: Documents up to which an index is scored in one step.
WHOLE = 100_000
#: Queries whose weights are one matrix, postings that meet it at once, identifiers of documents up to which a filter of a scan is broadcast.
TOGETHER, STEP, IDS = 256, 1 << 13, 1_000_000


@dataclass
class Bm25:
    """An index below ``path`` as its segment number ``last`` leaves it. Later upserts don't change what an open index reads."""

    spark: SparkSession
    path: str
    last: int

    @staticmethod
    def read(spark: SparkSession, path: str) -> Bm25:
        return Bm25(spark, path, spark.read.parquet(f"{path}/stats").agg(F.max("segment")).first()[0])

    def table(self, name: str) -> DataFrame:
        if name == "blocks":
            for segment in range(self.last + 1):
                self._make_blocks(segment)
        return self.spark.read.parquet(f"{self.path}/{name}").where(F.col("segment") <= self.last)

    def _make_blocks(self, segment: int) -> None:
        """Postings of a segment's documents, if nobody has made them yet; written aside and moved to their place whole."""
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        at = lambda name: jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        source, to, aside = at(f"forward/segment={segment}"), at(f"blocks/segment={segment}"), at(f"_blocks-{uuid.uuid4().hex}")
        fs = to.getFileSystem(conf)
        if fs.exists(to) or not fs.exists(source):
            return
        forward = self.spark.read.parquet(f"{self.path}/forward/segment={segment}")
        postings = forward.agg(F.coalesce(F.sum(F.size("terms")), F.lit(0))).first()[0]
        parts = max(self.spark.sparkContext.defaultParallelism, postings // TASK_POSTINGS)
        flat = forward.select("range", "chunk_id", "dl", F.explode("terms").alias("t")).select(F.col("t.term").alias("term"), "range", "chunk_id", F.col("t.tf").alias("tf"), "dl")
        grouped = flat.repartitionByRange(parts, "term", "range").groupBy("term", "range")
        blocks = grouped.agg(F.max("tf").alias("max_tf"), F.min("dl").alias("min_dl"), F.count(F.lit(1)).cast("int").alias("n"), F.collect_list(F.struct("chunk_id", "tf", "dl")).alias("docs"))
        blocks.sortWithinPartitions("term", "range").write.parquet(aside.toString())
        fs.mkdirs(to.getParent())
        files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), conf)
        none = self.spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        try:
            files.rename(fs.makeQualified(aside), fs.makeQualified(to), none)  # fails if another application was first
        except Exception:
            if not fs.exists(to):
                raise
            fs.delete(aside, True)

    @property
    def stats(self) -> DataFrame:
        """n (documents), total (tokens), avgdl, mean (of the logarithms of all terms): one row."""
        s = self.spark.read.parquet(f"{self.path}/stats").where(F.col("segment") == self.last).drop("segment")
        return s.withColumn("avgdl", F.col("total") / F.greatest("n", F.lit(1)).cast("double"))

    @property
    def idf(self) -> DataFrame:
        """term, df, idf. A negative idf becomes EPSILON times the mean over all terms; texts without tokens count for N."""
        raw = _raw(self.frequencies(), self.stats)
        return raw.select("term", "df", F.when(F.col("raw") < 0, EPSILON * F.col("mean")).otherwise(F.col("raw")).alias("idf"))

    def frequencies(self) -> DataFrame:
        """term, df over all segments."""
        t = self.table("terms")
        if not self.last:
            return t.drop("segment")
        return t.groupBy("term").agg(F.sum("df").alias("df")).where("df > 0")

    def live(self, rows: DataFrame) -> DataFrame:
        """rows (chunk_id, segment, any more) without what a later segment has replaced or deleted."""
        if not self.last:
            return rows
        gone = small(self.table("gone").groupBy(F.col("chunk_id").alias("_id")).agg(F.max("segment").alias("_by")), IDS)  # else the documents' terms would be shuffled
        return rows.join(gone, (F.col("chunk_id") == F.col("_id")) & (F.col("segment") < F.col("_by")), "left_anti")

    def upsert(self, chunks: DataFrame) -> Bm25:
        """Replaces and adds the documents of ``chunks`` (chunk_id, texto) as a new segment. Postings are made for these documents alone; of earlier segments only the rows of the
        same identifiers are read, and the terms' frequencies for the mean."""
        return self._extended(chunks, chunks.select("chunk_id"))

    def delete(self, ids: DataFrame) -> Bm25:
        """Drops the documents of ``ids`` (chunk_id), as a segment of tombstones."""
        return self._extended(None, ids.select("chunk_id"))

    def _extended(self, chunks: DataFrame | None, ids: DataFrame) -> Bm25:
        low, high = ids.agg(F.min("chunk_id"), F.max("chunk_id")).first()
        have = self.live(self.table("forward").where(F.col("chunk_id").between(low, high)))  # files and row groups are in their order
        old = have.join(ids.distinct(), "chunk_id", "left_semi")
        return _write(self.spark, self.path, self.last + 1, chunks, old, self)

    def compacted(self, path: str) -> Bm25:
        """The same index as one segment below another ``path``, from the stored terms of the documents; texts aren't needed."""
        rows = self.live(self.table("forward")).select("chunk_id", "dl", "terms")
        n, postings = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size("terms")), F.lit(0))).first()
        parts = max(self.spark.sparkContext.defaultParallelism, postings // TASK_POSTINGS)
        placed = rows.repartitionByRange(parts, "chunk_id").sortWithinPartitions("chunk_id").withColumn("range", _range())
        return _finish(self.spark, path, 0, placed, None, None)


def _range() -> Column:
    return F.shiftright(F.monotonically_increasing_id(), RANGE.bit_length() - 1)


def _raw(frequencies: DataFrame, stats: DataFrame) -> DataFrame:
    n = F.col("n")
    return frequencies.crossJoin(F.broadcast(stats)).withColumn("raw", F.log(n - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))  # stats: one row


def bm25_index(chunks: DataFrame, path: str | None = None) -> Bm25:
    """An index of chunks (chunk_id, texto), identifiers unique, built below ``path`` (a new folder in the shared one by default), where there must be none yet."""
    spark = chunks.sparkSession
    path = (path or f"{shared_folder(spark)}/bm25-{uuid.uuid4().hex}").rstrip("/")
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/stats")
    if at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        raise ValueError(f"there is an index at {path}: open it with Bm25.read, or upsert into it")
    return _write(spark, path, 0, chunks, None, None)


def _write(spark: SparkSession, path: str, segment: int, chunks: DataFrame | None, old: DataFrame | None, before: Bm25 | None) -> Bm25:
    if chunks is None:
        return _finish(spark, path, segment, None, old, before)
    size = chunks.agg(F.coalesce(F.sum(F.octet_length("texto")), F.lit(0))).first()[0]
    parts = max(spark.sparkContext.defaultParallelism, size // TASK_BYTES)
    # ranged by identifier, so that the aggregations by document below need no further move
    d = chunks.select("chunk_id", "texto").repartitionByRange(parts, "chunk_id").sortWithinPartitions("chunk_id").select("chunk_id", _range().alias("range"), tokens(F.col("texto")).alias("w"))
    rows = d.select("chunk_id", "range", F.size("w").alias("dl"), F.sort_array("w").alias("w"))
    # equal words follow each other: where each begins, and how far it is to the next
    new = F.filter(F.sequence(F.lit(0), F.col("dl") - 1), lambda i: (i == 0) | (F.get("w", i) != F.get("w", i - 1)))
    rows = rows.withColumn("at", F.when(F.col("dl") > 0, new).otherwise(F.array().cast("array<int>")))
    rows = rows.withColumn("terms", F.transform("at", lambda i, k: F.struct(F.get("w", i).alias("term"), (F.coalesce(F.get("at", k + 1), F.col("dl")) - i).alias("tf"))))
    return _finish(spark, path, segment, rows, old, before)


def _finish(spark: SparkSession, path: str, segment: int, rows: DataFrame | None, old: DataFrame | None, before: Bm25 | None) -> Bm25:
    """Writes a segment's tables: the documents with their terms, the change of frequencies, what is gone, and last the totals."""

    def kept(df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{path}/{name}/segment={segment}")
        return spark.read.parquet(f"{path}/{name}/segment={segment}")

    n = total = 0
    change = []
    if rows is not None:
        forward = kept(rows.select("chunk_id", "range", "dl", "terms"), "forward")
        n, total = forward.agg(F.count(F.lit(1)), F.coalesce(F.sum("dl"), F.lit(0))).first()
        change.append(forward.select(F.explode("terms.term").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df")))
    if old is not None:
        gone = kept(old.select("chunk_id", "dl", F.transform("terms", lambda t: t["term"]).alias("terms")), "gone")
        lost = gone.agg(F.count(F.lit(1)), F.coalesce(F.sum("dl"), F.lit(0))).first()
        n, total = n - lost[0], total - lost[1]
        change.append(gone.select(F.explode("terms").alias("term")).groupBy("term").agg((-F.count(F.lit(1))).alias("df")))
    terms = change[0] if len(change) == 1 else change[0].unionByName(change[1]).groupBy("term").agg(F.sum("df").alias("df")).where("df <> 0")
    kept(terms, "terms")
    if before:
        was = before.stats.first()
        n, total = n + was["n"], total + was["total"]
    totals = spark.range(1).select(F.lit(n).cast("long").alias("n"), F.lit(total).cast("long").alias("total"))
    mean = _raw(Bm25(spark, path, segment).frequencies(), totals).agg(F.coalesce(F.avg("raw"), F.lit(0.0)).alias("mean"))
    kept(totals.crossJoin(F.broadcast(mean)), "stats")
    return Bm25(spark, path, segment)


def _part(tf: Column, dl: Column) -> Column:
    """A posting's part of a score for idf 1: it rises with the frequency and falls with the length."""
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / F.col("avgdl")))


class Asked:
    """The terms of a batch of queries (query_id, query) and the bounds of all ranges for them, both stored; several lists can be cut from them.

    A batch that would score more postings than the index has tokens is scored by a scan of the documents, if its terms are few enough for every task to hold. Else an
    index of at most WHOLE documents has so few ranges that bounds save less than they cost: it is scored in one step, with the same result.
    """

    def __init__(self, index: Bm25, queries: DataFrame):
        self.index, spark = index, queries.sparkSession
        self.path, self._bounds = f"{shared_folder(spark)}/asked-{uuid.uuid4().hex}", None
        terms = queries.select("query_id", F.explode(tokens(F.col("query"))).alias("term")).groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("qtf"))
        terms = terms.join(index.idf, "term").crossJoin(F.broadcast(index.stats.select("avgdl"))).select("query_id", "term", (F.col("qtf") * F.col("idf")).alias("w"), "avgdl", "df")
        terms.write.parquet(f"{self.path}/terms")
        self.terms = spark.read.parquet(f"{self.path}/terms")
        n, total = index.stats.select("n", "total").first()
        rows, postings = self.terms.agg(F.count(F.lit(1)), F.coalesce(F.sum("df"), F.lit(0))).first()
        self.whole, self.scanned = n <= WHOLE, rows <= MOST and postings > total

    @property
    def bounds(self) -> DataFrame:
        """query_id, segment, range, bound, n: stored once asked for."""
        if self._bounds is None:
            held = self.index.table("blocks").select("segment", "term", "range", "n", "max_tf", "min_dl").join(self.terms.drop("df"), "term")
            most = F.greatest(F.col("w"), F.lit(0.0)) * _part(F.col("max_tf"), F.col("min_dl"))
            held.groupBy("query_id", "segment", "range").agg(F.sum(most).alias("bound"), F.sum("n").alias("n")).write.parquet(f"{self.path}/bounds")
            self._bounds = self.index.spark.read.parquet(f"{self.path}/bounds")
        return self._bounds

    def scores(self, cells: DataFrame | None = None) -> DataFrame:
        """query_id, chunk_id, score of every live document that shares a term with the query, in the given ranges (query_id, segment, range) or in all."""
        blocks = self.index.table("blocks").select("segment", "term", "range", "docs")
        hits = blocks.join(self.terms, "term")
        if cells is not None:  # before the postings are taken apart
            hits = hits.join(cells, ["query_id", "segment", "range"], "left_semi")
        hits = hits.select("query_id", "segment", "w", "avgdl", F.explode("docs").alias("d")).select("query_id", "segment", F.col("d.chunk_id").alias("chunk_id"), (F.col("w") * _part(F.col("d.tf"), F.col("d.dl"))).alias("part"))
        summed = hits.groupBy("query_id", "segment", "chunk_id").agg(F.round(F.sum("part"), SCORE_DIGITS).alias("score")).where("score > 0")
        return self.index.live(summed).select("query_id", "chunk_id", "score")

    def wanted(self, k: int, passing: DataFrame | None = None) -> DataFrame:
        """query_id, segment, range, n: the ranges whose bound reaches the k-th score of the FIRST best ranges; of all where these have fewer than k."""
        w = Window.partitionBy("query_id").orderBy(F.desc("bound"), "segment", "range")
        first = self.bounds.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= FIRST).select("query_id", "segment", "range")
        best = ranked(kept_by(self.scores(first), passing), [F.desc("score"), F.asc("chunk_id")], k).where(F.col("rank") == k).select("query_id", F.col("score").alias("_least"))
        slack = 10.0 ** -SCORE_DIGITS * 2  # scores are rounded, bounds aren't
        return self.bounds.join(best, "query_id", "left").where(F.col("_least").isNull() | (F.col("bound") >= F.col("_least") - slack)).select("query_id", "segment", "range", "n")

    def topk(self, k: int, passing: DataFrame | None = None) -> DataFrame:
        """query_id, chunk_id, score, rank of the k best with a positive score; of those in ``passing`` (chunk_id), if given."""
        if self.scanned:
            return ranked(self._scan(k, passing), [F.desc("score"), F.asc("chunk_id")], k)
        cells = None if self.whole else self.wanted(k, passing).drop("n")
        return ranked(kept_by(self.scores(cells), passing), [F.desc("score"), F.asc("chunk_id")], k)

    def _scan(self, k: int, passing: DataFrame | None) -> DataFrame:
        """query_id, chunk_id, score of the documents that may be among a query's ``k`` best: those of each batch, less what an earlier batch of the task rules out."""
        docs = self.index.live(self.index.table("forward").select("chunk_id", "segment", "dl", "terms"))
        if passing is not None:
            docs = docs.join(small(passing, IDS), "chunk_id", "left_semi")
        asked = self.terms.orderBy("query_id", "term").toArrow()  # at most MOST rows
        sent = self.index.spark.sparkContext.broadcast(weights(asked))
        schema = self.terms.select("query_id").crossJoin(docs.select("chunk_id")).limit(0).withColumn("score", F.lit(0.0)).schema
        return docs.select("chunk_id", "dl", "terms").mapInArrow(_best(sent, k), schema).withColumn("score", F.round("score", SCORE_DIGITS)).where("score > 0")

    def postings(self, k: int) -> DataFrame:
        """query_id, n_all, n_read: postings of the query's terms, and those of the ranges that a top-k scores after the first step."""
        read = self.wanted(k).groupBy("query_id").agg(F.sum("n").alias("n_read"))
        return self.bounds.groupBy("query_id").agg(F.sum("n").alias("n_all")).join(read, "query_id")


def weights(asked: pa.Table) -> tuple[float, list[tuple[pa.Array, pa.Array, np.ndarray]]]:
    """asked (query_id, term, w, avgdl), in the order of queries -> avgdl and, for each TOGETHER queries, their identifiers, their terms and a matrix of weights (terms by queries)."""
    if not asked.num_rows:
        return 1.0, []
    queries = pc.unique(asked.column("query_id"))
    number, out = pc.index_in(asked.column("query_id"), queries).to_numpy(), []
    for lo in range(0, len(queries), TOGETHER):
        part = asked.filter(pa.array((number >= lo) & (number < lo + TOGETHER)))
        terms, own = pc.unique(part.column("term")), queries.slice(lo, TOGETHER)
        held = np.zeros((len(terms), len(own)))
        held[pc.index_in(part.column("term"), terms).to_numpy(), pc.index_in(part.column("query_id"), own).to_numpy()] = part.column("w").to_numpy()
        out.append((own, terms, held))
    return asked.column("avgdl")[0].as_py(), out


def _best(sent: Broadcast, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        avgdl, blocks = sent.value
        least = [np.full(len(own), 10.0**-SCORE_DIGITS / 2) for own, _, _ in blocks]  # scores are positive
        for b in batches:
            dl, lists = b.column(1).to_numpy(), b.column(2)
            row = np.repeat(np.arange(b.num_rows), pc.list_value_length(lists).to_numpy())
            flat = lists.flatten()
            words, tf = flat.field("term"), flat.field("tf").to_numpy()
            for i, (own, terms, held) in enumerate(blocks):
                found = pc.index_in(words, terms)
                at = pc.indices_nonzero(found.is_valid()).to_numpy()
                r, t, f = row[at], found.take(pa.array(at)).to_numpy(), tf[at]
                part = f * (K1 + 1) / (f + K1 * (1 - B + B * dl[r] / avgdl))
                score = np.zeros((b.num_rows, len(own)))
                starts = np.flatnonzero(np.diff(r, prepend=-1))  # of documents
                for own_starts in np.split(starts, np.flatnonzero(np.diff(starts // STEP)) + 1) if len(r) else []:
                    end = np.searchsorted(starts, own_starts[-1]) + 1
                    of = slice(own_starts[0], starts[end] if end < len(starts) else len(r))
                    score[r[own_starts]] = np.add.reduceat(held[t[of]] * part[of, None], own_starts - own_starts[0], axis=0)
                near = np.round(score, SCORE_DIGITS)
                if b.num_rows >= k:
                    least[i] = np.maximum(least[i], np.partition(near, b.num_rows - k, axis=0)[b.num_rows - k])
                doc, query = np.nonzero(near >= least[i])
                yield pa.record_batch([own.take(pa.array(query)), b.column(0).take(pa.array(doc)), pa.array(score[doc, query])], names=["query_id", "chunk_id", "score"])

    return run


def kept_by(scores: DataFrame, passing: DataFrame | None) -> DataFrame:
    return scores if passing is None else scores.join(passing, "chunk_id", "left_semi")


def ranked(df: DataFrame, order: list[Column], k: int) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
