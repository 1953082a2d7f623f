"""SimHash near-dedup over a vantage-point tree.

Fingerprints are partitioned by their Hamming distance to vantage points. At a node with vantage
point v and bound mu, a member goes left if d(v, x) <= mu, else right. By the triangle inequality
a pair within ``radius`` that the node separates has its left part at d > mu - radius, so only
those members follow the right branch too, as queries; all other branches are pruned and each pair is met
in exactly one leaf. The upper levels, built from a bounded sample, deal the rows to shards; a leaf
goes on splitting by vantage points of its own. The sample shapes the tree, never the result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .scratch import stored
from .streams import Hashes, Sets, few, keyed, small_batches, sorted_groups

BITS = 64


def shingle_hashes(words: list[bytes], k: int, seed: int) -> np.ndarray:
    """XXH64 of each k-word shingle, repeats included; of the whole sequence where there are fewer words."""
    if not words:
        return np.zeros(0, np.uint64)
    parts = [b" ".join(words)] if len(words) < k else map(b" ".join, zip(*(words[i:] for i in range(k)), strict=False))
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(p, seed) for p in parts), np.uint64, max(1, len(words) - k + 1))


def fingerprint(hashes: np.ndarray) -> int:
    """A bit is 1 if it is set in over half the hashes; 0 for none. Signed, as Spark keeps it."""
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at : at + (1 << 16)]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view(np.int64)[0]) if len(hashes) else 0


def fingerprints(docs: DataFrame, id_col: str = "doc_id", words: int = 3, seed: int = 42) -> DataFrame:
    """docs (id_col, text) -> id_col, fp long: a row per document, whole texts, A-Z lower-cased. A null text is as an empty one: no words, fingerprint 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = [fingerprint(shingle_hashes(_words(t), words, seed)) for t in b.column(1)]
            yield pa.record_batch([b.column(0), pa.array(fps, pa.int64())], names=[id_col, "fp"])

    small_batches(docs.sparkSession)
    slim = docs.select(F.col(id_col).cast("long").alias(id_col), F.col("text").cast("binary").alias("text"))
    return slim.mapInArrow(run, f"{id_col} long, fp long")


def _words(text: pa.BinaryScalar) -> list[bytes]:
    return (text.as_py() or b"").lower().split()  # bytes: only A-Z change, and only \x20 \x09-\x0D part words


def mixed_hashes(ids: np.ndarray, k: int) -> np.ndarray:
    """A hash of each k-word shingle, made from the hashes of its words; of the whole sequence where there are fewer words."""
    k = min(k, len(ids)) or 1
    h = np.full(max(0, len(ids) - k + 1), k, np.uint64)
    for j in range(k):
        h ^= ids[j : j + len(h)]
        h *= np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(32)
    return h


def sketches(docs: DataFrame, words: int) -> DataFrame:
    """docs (_key, text binary) -> _key, fp long (SimHash of 3-word shingles), n int and fp2 long (number and SimHash of the distinct shingles of ``words`` words)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Hashes()
        for b in batches:
            out = []
            for t in b.column(1):
                ids = known.of(_words(t))
                more = np.unique(mixed_hashes(ids, words))
                out.append((fingerprint(mixed_hashes(ids, 3)), len(more), fingerprint(more)))
            fps, ns, seconds = zip(*out, strict=True) if out else ((), (), ())
            yield pa.record_batch([b.column(0), pa.array(fps, pa.int64()), pa.array(ns, pa.int32()), pa.array(seconds, pa.int64())], names=["_key", "fp", "n", "fp2"])

    return docs.select("_key", "text").mapInArrow(run, "_key long, fp long, n int, fp2 long")


def grow(sample: np.ndarray, depth: int, radius: int, seed: int = 7) -> list:
    """A vantage-point tree of ``depth`` levels over sampled fingerprints: [vantage, mu, left, right] or [] for a leaf."""
    rng = np.random.default_rng(seed)

    def node(x: np.ndarray, levels: int) -> list:
        if not levels or len(x) < 4:
            return []
        best = None
        for v in rng.choice(x, min(8, len(x)), replace=False):
            d = np.bitwise_count(x ^ v).astype(int)
            for mu in range(*np.quantile(d, [0.35, 0.65]).astype(int) + [0, 1]):
                inside = ((d > mu - radius) & (d <= mu + radius)).mean() + 0.25 * abs((d <= mu).mean() - 0.5)
                if d.min() <= mu < d.max() and (best is None or inside < best[0]):
                    best = inside, v, mu, d
        if best is None:
            return []
        _, v, mu, d = best
        return [v, mu, node(x[d <= mu], levels - 1), node(x[d > mu], levels - 1)]

    return node(np.unique(sample), depth)


def route(tree: list, fps: np.ndarray, member: np.ndarray, radius: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(leaf, rows, whether they are members) for every leaf that a row belongs to or must query."""
    todo = [(tree, 1, np.arange(len(fps)), member)]
    while todo:
        at, code, rows, own = todo.pop()
        if not len(rows):
            continue
        if not at:
            yield code, rows, own
            continue
        v, mu, left, right = at
        d = np.bitwise_count(fps[rows] ^ v).astype(np.int16)
        go = np.where(own, d <= mu, d <= mu + radius)
        todo.append((left, 2 * code, rows[go], own[go]))
        go = d > mu - radius
        todo.append((right, 2 * code + 1, rows[go], own[go] & (d[go] > mu)))


def close_pairs(members: np.ndarray, queries: np.ndarray, radius: int, small: int = 768) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Blocks of index pairs within ``radius``: members among themselves, and queries (numbered after them) to members."""
    every = np.concatenate([members, queries])
    todo = [(np.arange(len(members)), np.arange(len(members), len(every)))]
    while todo:
        m, q = todo.pop()
        if not len(m):
            continue
        if len(m) > small and radius <= 4:
            tree = grow(every[m[:: max(1, len(m) // 512)]], 1, radius)
            if tree:
                rows = np.concatenate([m, q])
                parts = [(rows[r], own) for _, r, own in route(tree, every[rows], np.arange(len(rows)) < len(m), radius)]
                if max(own.sum() for _, own in parts) < 0.9 * len(m):
                    todo += [(r[own], r[~own]) for r, own in parts]
                    continue
        step = max(1, (1 << 21) // len(m))
        rows = np.concatenate([m, q])
        for at in range(0, len(rows), step):
            part = rows[at : at + step]
            i, j = np.nonzero(np.bitwise_count(every[part][:, None] ^ every[m][None, :]) <= radius)
            keep = (i + at > j) | (i + at >= len(m))  # members that stand here as queries meet each member once
            keep &= part[i] != m[j]
            if keep.any():
                yield part[i[keep]], m[j[keep]]


def linked(points: DataFrame, radius: int, leaf_rows: int = 4096, most_leaves: int = 1 << 16, bands: float = 0.0, radius2: int = BITS) -> DataFrame:
    """points (id long, fp long, n int, fp2 long), ids unique -> u, v: edges whose components are those of all links.

    A link joins points whose fp differ in at most ``radius`` bits, whose fp2 differ in at most ``radius2``, and, with ``bands`` = t > 0,
    whose n are within a ratio of t. Each leaf gives a spanning forest of its links, not all pairs.
    """
    count = points.count()
    depth = min(int(math.log2(most_leaves)), max(0, math.ceil(math.log2(max(1, count / leaf_rows / (8 if bands else 1))))))
    wanted = 64 << depth  # bounded by 64 * most_leaves
    drawn = points.where(F.pmod(F.xxhash64("fp"), F.lit(max(1, count // wanted))) == 0).select("fp").limit(2 * wanted) if depth else None
    tree = grow(drawn.toArrow().column("fp").to_numpy().view(np.uint64), depth, radius) if depth else []
    width = math.log(1 / bands) if bands else 0.0

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, fps, ns, seconds = (b.column(i).to_numpy() for i in range(4))
            fps, own = fps.view(np.uint64), np.ones(len(ids), bool)
            band = np.floor(np.log(np.maximum(ns, 1)) / width + 1e-9).astype(np.int64) if width else np.zeros(len(ids), np.int64)
            for up in (0, 1) if width else (0,):
                for leaf, rows, member in route(tree, fps, own & (up == 0), radius):
                    cell = ((band[rows] + up) << 32) + leaf
                    yield pa.record_batch([pa.array(cell), pa.array(~member), pa.array(ids[rows]), pa.array(fps[rows].view(np.int64)), pa.array(ns[rows]), pa.array(seconds[rows])], names=["cell", "query", "id", "fp", "n", "fp2"])

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, t in sorted_groups(batches, "cell"):
            query, ids, fps, ns, seconds = (t.column(c).to_numpy() for c in ("query", "id", "fp", "n", "fp2"))
            rank = np.argsort(query, kind="stable")
            ids, fps, ns, seconds, n_members = ids[rank], fps[rank].view(np.uint64), ns[rank], seconds[rank].view(np.uint64), int((~query).sum())
            sets = Sets(len(ids))
            for i, j in close_pairs(fps[:n_members], fps[n_members:], radius):
                if width:
                    near = np.minimum(ns[i], ns[j]) >= bands * np.maximum(ns[i], ns[j]) - 1e-9
                    near &= np.bitwise_count(seconds[i] ^ seconds[j]) <= radius2
                    i, j = i[near], j[near]
                sets.union(i, j)
            hit = np.flatnonzero(sets.root != np.arange(len(ids)))
            yield pa.record_batch([pa.array(ids[hit]), pa.array(ids[sets.root[hit]])], names=["u", "v"])

    dealt = points.select("id", "fp", "n", "fp2").mapInArrow(deal, "cell long, query boolean, id long, fp long, n int, fp2 long")
    return dealt.repartition("cell").sortWithinPartitions("cell").mapInArrow(match, "u long, v long")


def cluster(docs: DataFrame, words: int = 3, radius: int = 2, seed: int = 42) -> DataFrame:
    """docs (doc_id, text, any more) -> doc_id, fingerprint (16 hex digits), component_id; one row per input row.

    component_id is the smallest doc_id reachable over links of at most ``radius`` bits, itself included; null doc_ids
    don't count as smallest unless a component has no other. Null and empty texts have fingerprint 0, which links
    like any other. Repeated rows give repeated results; an empty table gives no rows.
    """
    marks = stored(fingerprints(docs, "doc_id", words, seed), "fingerprints")
    nodes = stored(marks.groupBy("fp").agg(F.min("doc_id").alias("least")), "nodes")
    found = components(linked(nodes.select(F.col("fp").alias("id"), "fp", F.lit(0).alias("n"), F.lit(0).cast("long").alias("fp2")), radius))
    roots = nodes.join(found, nodes["fp"] == found["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    best = roots.groupBy("root").agg(F.min("least").alias("component_id"))
    named = roots.join(best, "root").select("fp", "component_id")
    return marks.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _verified(sets: list[np.ndarray], least: float, found: Sets) -> None:
    """Unites the rows of a tile whose shingle sets have Jaccard >= ``least``."""
    sizes = np.array([len(s) for s in sets])
    every, where = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(np.arange(len(sets)), sizes)
    shared = np.bincount(where, minlength=len(every)) > 1
    number = np.cumsum(shared) - 1
    kept = shared[where]
    cols, rows = number[where[kept]], owner[kept]
    order = np.argsort(cols, kind="stable")
    cols, rows, width = cols[order], rows[order], int(shared.sum())
    step = 256
    for at in range(0, len(sets), step):
        part = slice(at, min(at + step, len(sets)))
        inter = np.zeros((part.stop - at, len(sets)), np.float32)
        for c in range(0, width, 512):
            lo, hi = np.searchsorted(cols, [c, c + 512])
            x = np.zeros((len(sets), min(512, width - c)), np.float32)
            x[rows[lo:hi], cols[lo:hi] - c] = 1
            live = np.flatnonzero(x[part].any(axis=0))
            if len(live):
                inter += x[part][:, live] @ x[:, live].T
        i, j = np.nonzero(inter >= least / (1 + least) * (sizes[part][:, None] + sizes[None, :]) - 1e-6)
        found.union(i + at, j)


def _rare_first(s: np.ndarray, least: float, hot: np.ndarray, level: np.ndarray) -> np.ndarray:
    """The first shingles of a set in the order (level, hash), as many as must hold one of any set with Jaccard >= ``least``."""
    most = len(s) - math.ceil(least * len(s) - 1e-9) + 1
    if len(hot):
        at = np.minimum(np.searchsorted(hot, s), len(hot) - 1)
        s = s[np.lexsort((s, np.where(hot[at] == s, level[at], 0)))]
    return s[:most]


def _finished(batches: Iterator[pa.RecordBatch], step: int) -> Iterator[list[np.ndarray]]:
    """The columns of a stream sorted by its first one, in parts of about ``step`` rows that cut no run of equal values."""
    held: list[list[np.ndarray]] = []
    for b in batches:
        if not b.num_rows:
            continue
        cols = [c.to_numpy() for c in b.columns]
        cut = np.searchsorted(cols[0], cols[0][-1])
        if held and (cut or held[-1][0][-1] != cols[0][0]) and sum(len(x[0]) for x in held) + cut >= step:
            yield [np.concatenate(x) for x in zip(*held, [c[:cut] for c in cols], strict=True)]
            held, cols = [], [c[cut:] for c in cols]
        held.append(cols)
    if held:
        yield [np.concatenate(x) for x in zip(*held, strict=True)]


def sharing(texts: DataFrame, count: int, words: int, least: float, drawn: int = 1 << 14, chunk: int = 8192) -> DataFrame:
    """texts (_key, text binary, block), ``count`` rows -> u, v: pairs of different blocks, among them all with Jaccard >= ``least``.

    Prefix filter, exact: shingles stand in one order in all sets, and similar sets share one among their first. Those that a sample
    finds in several blocks come last; the sample shapes the order and deals hot shingles to several cells, never the result. A
    pair must share as many of its first shingles as its sizes ask for.
    """

    def sets(b: pa.RecordBatch, known: Hashes) -> Iterator[tuple[int, np.ndarray, int]]:
        for key, t, block in zip(b.column(0).to_pylist(), b.column(1), b.column(2).to_pylist(), strict=True):
            yield key, np.unique(mixed_hashes(known.of(_words(t)), words)), block

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Hashes()
        for b in batches:
            for _, s, block in sets(b, known):
                yield pa.record_batch([pa.array(s.view(np.int64)), pa.array(np.full(len(s), block))], names=["token", "block"])

    step = max(1, count // drawn)
    seen = texts.where(F.pmod(F.xxhash64("_key"), F.lit(step)) == 0).mapInArrow(look, "token long, block long").distinct()
    seen = seen.groupBy("token").agg(F.count(F.lit(1)).alias("k")).where("k > 3").orderBy(F.desc("k"), "token").limit(1 << 17).collect()
    hot, k = np.array([r[0] for r in seen], np.int64).view(np.uint64), np.array([r[1] for r in seen], np.int64)
    order = np.argsort(hot)
    hot, k = hot[order], k[order]
    level, cuts = np.floor(np.log2(np.maximum(k, 1))).astype(np.int64), -(-k * step // chunk)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Hashes()
        for b in (b.slice(at, 512) for b in batches for at in range(0, b.num_rows, 512)):  # the parts bound a worker's memory
            cells, keys, blocks, ns, places = [], [], [], [], []
            for key, s, block in sets(b, known):
                if not len(s):
                    continue
                cell = _rare_first(s, least, hot, level)
                place = np.arange(len(cell))
                if len(hot):
                    at = np.minimum(np.searchsorted(hot, cell), len(hot) - 1)
                    many = np.flatnonzero((hot[at] == cell) & (cuts[at] > 1))
                    if len(many):  # a hot shingle's rows are cut in chunks, and each pair of chunks is a cell; equal chunks meet in several, which only counts more
                        more = []
                        for x in many:
                            o, c = np.arange(cuts[at[x]]), key % int(cuts[at[x]])
                            more.append(cell[x] ^ (((np.minimum(o, c) << 32) + np.maximum(o, c) + 1).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
                        plain = np.setdiff1d(place, many)
                        place = np.concatenate([plain, *(np.full(len(m), x) for x, m in zip(many, more, strict=True))])
                        cell = np.concatenate([cell[plain], *more])
                cells.append(cell)
                places.append(place)
                keys.append(np.full(len(cell), key))
                blocks.append(np.full(len(cell), block))
                ns.append(np.full(len(cell), len(s)))
            if cells:
                cell, block, key, n, place = (np.concatenate(x) for x in (cells, blocks, keys, ns, places))
                yield pa.record_batch([pa.array(cell.view(np.int64)), pa.array(block - key), pa.array(key), pa.array(n.astype(np.int32)), pa.array(place.astype(np.int32))], names=["cell", "off", "key", "n", "place"])

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cell, off, key, n, place in _finished(batches, 1 << 14):
            order = np.lexsort((key + off, cell))
            cell, block, key, n, place = (x[order] for x in (cell, key + off, key, n, place))
            new = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1], [True]]))
            part = np.flatnonzero(np.concatenate([[True], (cell[1:] != cell[:-1]) | (block[1:] != block[:-1]), [True]]))
            end, other = np.repeat(new[1:], np.diff(new)), np.repeat(part[1:], np.diff(part))
            rows = np.flatnonzero(end > other)
            upto = np.cumsum(end[rows] - other[rows])
            at = 0
            while at < len(rows):
                to = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + (1 << 18), side="right")))
                r = rows[at:to]
                m = end[r] - other[r]
                i = np.repeat(r, m)
                j = np.repeat(other[r] - np.cumsum(m) + m, m) + np.arange(m.sum())
                need = least / (1 + least) * (n[i] + n[j].astype(np.int64)) - 1e-6
                ok = np.minimum(n[i], n[j]) >= least * np.maximum(n[i], n[j]) - 1e-6
                ok &= np.minimum(place[i], place[j]) + np.minimum(n[i] - place[i], n[j] - place[j]) >= need
                i, j = i[ok], j[ok]
                # beyond the shorter of the two prefixes lie fewer than least * n shingles, so the rest of the overlap lies within
                need = np.ceil(need[ok]) - np.ceil(least * np.maximum(n[i], n[j]) - 1e-9) + 1
                yield pa.record_batch([pa.array(np.maximum(key[i], key[j])), pa.array(np.minimum(key[i], key[j])), pa.array(need.astype(np.int32))], names=["u", "v", "need"])
                at = to

    dealt = texts.select("_key", "text", "block").mapInArrow(deal, "cell long, off long, key long, n int, place int")  # a block is told by its distance from the key, mostly 0, as these rows are most of what is shuffled
    pairs = dealt.repartition("cell").sortWithinPartitions("cell").mapInArrow(match, "u long, v long, need int")
    return pairs.groupBy("u", "v").agg(F.count(F.lit(1)).alias("k"), F.max("need").alias("need")).where("k >= need").select("u", "v")


#: Documents of a block, about so many, that each of its chunks holds.
PIVOTS = 16


def near_duplicates(docs: DataFrame, words: int = 5, least: float = 0.8, radius: int = 14, radius2: int = 20, tile: int = 1_000_000) -> DataFrame:
    """docs (doc_id, text, any more) -> the same columns: one document of each group stays, the one with the smallest doc_id.

    Groups are the components of all links: equal texts, and texts whose sets of ``words``-word shingles have a Jaccard similarity
    of ``least`` or more. Candidates are blocks of texts whose SimHashes over 3-word shingles differ in at most ``radius`` bits and those over
    ``words``-word shingles in at most ``radius2``, joined to each other by the exact prefix filter of ``sharing``: fingerprints only save work.
    Null texts are one group, texts without words another unless equal. Null doc_ids come last; repeated rows are copies.
    """
    small_batches(docs.sparkSession)
    docs = keyed(docs.select(F.struct(*docs.columns).alias("_row")), id_col="_row.doc_id", text_col="_row.text").select("_key", F.col("_row.text").alias("text"), "_row")  # a text is moved and kept once where rows are numbered
    same = [F.xxhash64("text").alias("t1"), F.crc32("text").alias("t2"), F.octet_length("text").alias("t3")]
    slim = stored(docs.select("_key", *same), "texts")
    reps = slim.groupBy("t1", "t2", "t3").agg(F.min("_key").alias("_key")).select("_key")
    copies = stored(slim.select("_key").join(reps, "_key", "left_anti"), "copies")
    # texts are marked where they lie; only keys and fingerprints are moved
    marks = stored(sketches(docs.select("_key", F.col("text").cast("binary").alias("text")), words), "fingerprints")
    points = marks.where("n > 0").join(few(copies), "_key", "left_anti").select(F.col("_key").alias("id"), "fp", "n", "fp2")
    # at this radius no bound prunes random fingerprints, and more leaves only mean more queries: leaves are as large as a task holds
    near = stored(components(linked(points, radius, leaf_rows=1 << 16, bands=least, radius2=radius2)), "near")
    whole = docs.select("_key", F.col("text").cast("binary").alias("text")).join(few(copies), "_key", "left_anti")
    whole = whole.join(few(near), F.col("_key") == F.col("node"), "left").select("_key", "text", F.coalesce("root", "_key").alias("block"))
    more = sharing(whole, points.count(), words, least)
    block = components(near.select(F.col("node").alias("u"), F.col("root").alias("v")).unionByName(more))
    block = stored(block.join(marks, block["node"] == marks["_key"]).select("_key", F.col("root").alias("block"), "n"), "blocks")
    asked = docs.select("_key", F.col("text").cast("binary").alias("text"))

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Hashes()
        for _, t in sorted_groups(batches, "cell"):
            ids = t.column("_key").to_numpy()
            sets = [np.unique(mixed_hashes(known.of(_words(x)), words)) for x in t.column("text")]
            found = Sets(len(ids))
            _verified(sets, least, found)
            hit = np.flatnonzero(found.root != np.arange(len(ids)))
            yield pa.record_batch([pa.array(ids[hit]), pa.array(ids[found.root[hit]])], names=["u", "v"])

    def verified(spot: DataFrame, name: str) -> DataFrame:
        """spot (_key, cell) -> u, v: links that join what is similar within each cell."""
        texts = asked.join(few(stored(spot, name), width=F.lit(16)), "_key")
        return texts.repartition("cell").sortWithinPartitions("cell").mapInArrow(verify, "u long, v long")

    # a block whose shingles don't fit one tile is cut in chunks; each is verified by itself, together with a few documents of the block that all chunks have
    cut = lambda n, k: F.ceil(F.greatest(n / F.lit(float(tile)), k / F.lit(8192.0))).cast("int")
    cuts = block.groupBy("block").agg(F.count(F.lit(1)).alias("k"), cut(F.sum("n"), F.count(F.lit(1))).alias("cuts"))
    chunk = lambda of: F.pmod(F.xxhash64("_key"), of).cast("int")
    upto = lambda of: F.when(of > 0, F.sequence(F.lit(0), of - 1)).otherwise(F.array().cast("array<int>"))
    pivot = (F.col("cuts") > 1) & (F.pmod(F.xxhash64(F.lit(1), "_key"), F.col("k")) < PIVOTS)
    spot = block.join(cuts, "block").select("_key", "block", F.explode(F.when(pivot, upto(F.col("cuts"))).otherwise(F.array(chunk(F.col("cuts"))))).alias("c"))
    links = stored(verified(spot.select("_key", F.xxhash64("block", "c").alias("cell")), "spots"), "links")
    large = cuts.where("cuts > 1").select("block")
    if not large.isEmpty():
        # pairs in one component needn't meet: the rest of a cut block meets the chunks of its largest component, and itself
        part = block.join(large, "block").join(components(links), F.col("_key") == F.col("node"), "left").select("_key", "block", "n", F.coalesce("root", "_key").alias("part"))
        most = part.groupBy("block", "part").agg(F.sum("n").alias("size")).groupBy("block").agg(F.max_by("part", F.struct("size", "part")).alias("most"))
        part = part.join(most, "block").withColumn("rest", F.col("part") != F.col("most"))
        own = lambda c, rest: F.sum(F.when(F.col("rest") == rest, c).otherwise(0))
        sizes = part.groupBy("block").agg(*(cut(own(F.col("n"), r), own(F.lit(1), r)).alias(x) for x, r in (("a", False), ("b", True)))).where("b > 0")
        part = part.join(sizes, "block")
        a, b = F.col("a"), F.col("b")
        to = lambda kind, i, j: F.struct(F.lit(kind).alias("kind"), i.alias("i"), j.alias("j"))
        here = chunk(b)
        cells = F.when(F.col("rest"), F.concat(F.transform(upto(a), lambda i: to("a", i, here)), F.transform(upto(b), lambda j: to("b", F.least(here, j), F.greatest(here, j))))).otherwise(F.transform(upto(b), lambda j: to("a", chunk(a), j)))
        spot = part.select("_key", "block", F.explode(cells).alias("x")).select("_key", F.xxhash64("block", "x.kind", "x.i", "x.j").alias("cell"))
        links = links.unionByName(verified(spot, "spots"))
    groups = components(links)
    losers = stored(groups.where("node <> root").select(F.col("node").alias("_key")).unionByName(copies), "losers")
    return docs.join(few(losers), "_key", "left_anti").select("_row.*")
