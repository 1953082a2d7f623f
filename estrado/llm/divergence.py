"""Source divergence audit: how far the term frequencies of the sources of a language lie apart, and which terms set a source off.

Terms are counted by (lang, source). The terms of a language are cut into blocks, and its sources into blocks too; a tile is a dense int64 matrix of
two blocks of sources by a block of terms, and the scores of all its pairs are computed at once by broadcasting. Partial pair matrices are
summed, and the best terms of each tile are merged by source. All arithmetic is exact.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .scratch import stored
from .streams import few

#: Terms: runs of ASCII letters and of anything beyond ASCII. In UTF-8 these are runs of bytes, and all others become blanks.
LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
#: Distinct (group, term) entries that a task holds at once, bytes of a text that are cut up at once, numbers of a tile, and sources of a block.
HELD, PIECE, TILE, WIDTH = 500_000, 1 << 22, 1 << 20, 64


def terms_of(text: bytes) -> Iterator[list[bytes]]:
    """Lists of a text's terms, in order. A text of more than PIECE bytes is cut between terms."""
    low, at = text.translate(LETTERS), 0
    while at < len(low):
        end = at + PIECE
        if end < len(low):
            end = low.find(b" ", end)
            end = len(low) if end < 0 else end
        yield low[at:end].split()
        at = end


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows() -> pa.RecordBatch:
        cols: list[list] = [[], [], [], [], []]
        for (lang, source), (n, docs) in held.items():
            for c, x in zip(cols, ([lang] * len(n), [source] * len(n), n.keys(), n.values(), map(docs.__getitem__, n)), strict=True):
                c += x
        return pa.record_batch([*(pa.array(c, pa.string()) for c in cols[:2]), pa.array(cols[2], pa.binary()).cast(pa.string()), *(pa.array(c, pa.int64()) for c in cols[3:])], names=["lang", "source", "term", "n", "docs"])

    held: dict[tuple, tuple[Counter, Counter]] = {}
    for b in batches:
        for lang, source, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
            n, docs = held.setdefault((lang, source), (Counter(), Counter()))
            seen: set[bytes] = set()
            for words in terms_of(text.as_py()):
                n.update(words)
                seen.update(words)
            docs.update(seen)
        if sum(len(n) for n, _ in held.values()) > HELD:
            yield rows()
            held = {}
    if held:
        yield rows()


def rates(count: np.ndarray, size: np.ndarray, terms: int) -> np.ndarray:
    """1 + floor(10**9 * (count + 2) / (size + 2 * terms)), exact for sizes below 9 * 10**15: the quotient is built in three steps of 1000."""
    whole, rest = np.divmod(np.asarray(count, np.int64) + 2, (m := np.asarray(size, np.int64) + 2 * terms))
    for _ in range(3):
        more, rest = np.divmod(rest * 1000, m)
        whole = whole * 1000 + more
    return whole + 1


def apart(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // (p + q)


PARTS = "lang string, source string, part string, item string, value long"


def _tile(best: int):
    def run(heads: pa.Table, rows: pa.Table) -> pa.Table:
        """heads: the sources of two blocks (first, second: which of the two they are in) with their sizes; rows: the kept terms of a block."""
        h = heads.sort_by("source").to_pydict()
        sources, lang, sizes, v, diagonal = h["source"], h["lang"][0], np.array(h["size"], np.int64), h["terms"][0], h["first"] == h["second"]
        left, right = (np.flatnonzero(np.array(h[k], bool)) for k in ("first", "second"))
        value, out = np.zeros((len(left), len(right)), np.int64), []
        if rows.num_rows:
            rows = rows.take(pc.sort_indices(rows.column("term"))).combine_chunks()  # by UTF-8
            by = rows.column("by").chunk(0)
            at, flat = np.repeat(np.arange(rows.num_rows), pc.list_value_length(by).to_numpy()), by.flatten()
            who = pc.fill_null(pc.index_in(flat.field("source"), value_set=pa.array(sources, pa.string())), -1).to_numpy()
            count = np.zeros((len(sources), rows.num_rows), np.int64)
            count[who[who >= 0], at[who >= 0]] = flat.field("n").to_numpy()[who >= 0]
            p = rates(count, sizes[:, None], v)
            step = max(1, TILE // (len(left) * len(right)))
            for lo in range(0, rows.num_rows, step):
                value += apart(p[left, None, lo : lo + step], p[None, right, lo : lo + step]).sum(axis=2)
            if diagonal:
                q = rates(rows.column("total").to_numpy(), np.int64(h["lang_size"][0]), v)
                f = apart(p, q[None, :])
                for g in left:
                    found = np.flatnonzero((count[g] > 0) & (p[g] > q))
                    top = found[np.argsort(-f[g][found], kind="stable")[:best]]
                    out += [(lang, sources[g], "term", t, int(x)) for t, x in zip(rows.column("term").take(pa.array(top)).to_pylist(), f[g][top], strict=True)]
        for i, j in np.ndindex(value.shape):
            if (a := left[i]) != (b := right[j]):
                out.append((lang, sources[a], "pair", sources[b], int(value[i, j])))
                if not diagonal:
                    out.append((lang, sources[b], "pair", sources[a], int(value[i, j])))
        return pa.table([pa.array(c, k) for c, k in zip(zip(*out, strict=True) if out else [[]] * 5, [*[pa.string()] * 4, pa.int64()], strict=True)], names=["lang", "source", "part", "item", "value"])

    return run


def audit(docs: DataFrame, least_docs: int = 10, best: int = 10) -> DataFrame:
    """docs (text, lang, source, any more) -> lang, source, part, item, value, rank.

    Part ``pair``: every other source of the language, all ranks; part ``term``: the terms that a source has more often than its language, the
    ``best`` first. Ranks go by value, then by the item's UTF-8. Null texts, languages and sources are read as empty texts; repeated rows count each. A source without
    terms is a group like others, a language without terms of ``least_docs`` documents has pairs of value 0, an empty table gives no rows.
    """
    read = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")))
    found = read.select("lang", "source", F.col("text").cast("binary").alias("text")).mapInArrow(_count, "lang string, source string, term string, n long, docs long")
    counts = found.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    # a row per term with its counts by source: as many as the language has sources
    rows = counts.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("total"), F.collect_list(F.struct("source", "n")).alias("by")).where(F.col("docs") >= least_docs)
    rows = stored(rows.select("lang", "term", "total", "by"), "terms")

    sizes = rows.select("lang", F.explode("by").alias("x")).groupBy("lang", F.col("x.source").alias("source")).agg(F.sum("x.n").alias("size"))
    vocabulary = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("terms"), F.sum("total").alias("lang_size"))
    groups = read.select("lang", "source").distinct().join(sizes, ["lang", "source"], "left").join(vocabulary, "lang", "left").na.fill(0, ["size", "terms", "lang_size"])
    w = Window.partitionBy("lang")  # rows per language here: sources
    groups = groups.withColumn("cut", F.floor((F.row_number().over(w.orderBy("source")) - 1) / WIDTH).cast("int")).withColumn("cuts", F.max("cut").over(w) + 1)
    wide = F.least(F.count(F.lit(1)).over(w), F.lit(2 * WIDTH))
    groups = stored(groups.withColumn("blocks", F.greatest(F.lit(1), F.ceil(F.col("terms") * wide / TILE)).cast("int")), "groups")

    cells = F.explode(F.expr("flatten(transform(sequence(0, cuts - 1), a -> transform(sequence(a, cuts - 1), b -> struct(a, b))))"))
    mine = F.explode(F.expr("transform(sequence(0, cuts - 1), o -> struct(least(cut, o) AS a, greatest(cut, o) AS b))"))
    heads = groups.select("*", mine.alias("cell")).select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    heads = heads.select("lang", "cell", "block", "source", "size", "terms", "lang_size", (F.col("cut") == F.col("cell.a")).alias("first"), (F.col("cut") == F.col("cell.b")).alias("second"))
    # a term goes to each pair of blocks of sources: one, unless the language has more than WIDTH sources
    placed = rows.join(few(groups.select("lang", "blocks", "cuts").distinct()), "lang").select("lang", F.pmod(F.xxhash64("term"), F.col("blocks")).cast("int").alias("block"), "term", "total", "by", cells.alias("cell"))
    tiles = heads.groupBy("lang", "cell", "block").cogroup(placed.groupBy("lang", "cell", "block")).applyInArrow(_tile(best), PARTS)
    tiles = stored(tiles, "tiles")
    pairs = tiles.where("part = 'pair'").groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    ranked = pairs.unionByName(tiles.where("part = 'term'")).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")))
    return ranked.where((F.col("part") == "pair") | (F.col("rank") <= best))
