"""Embedding near-dedup with hierarchical navigable small-world graphs, one per shard.

Equal vectors of a label are gathered first and count with their multiplicity. The distinct vectors
of a label are hashed into shards of bounded size. A first stage builds a shard's graph by insertion and keeps it as a
table, one row per vector with its neighbours. A second stage deals cells: shard q queries the graph of shard s, for all s <= q, so that each
unordered pair of shards is met once and no task holds more than two shards. Beams start narrow; a query whose whole beam lies above
the threshold gets a wider one, and all widen until an audit of the cell's own queries against brute force passes. Found
pairs are verified in double precision, counted for both ends, and united; a task emits counts and a spanning forest, never all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .scratch import stored
from .streams import Sets, few, numbered, sorted_groups

DEGREE = 12
#: Shards of at most so many vectors are compared directly; all others are searched by their graph.
FLOOR = 32


class SmallWorld:
    """An HNSW graph over unit vectors (rows of ``x``). ``links`` holds a node's neighbours by layer: 2 * DEGREE places in layer 0, DEGREE above, -1 for none.

    Nodes are inserted in blocks no larger than what stands already: a block searches the graph for its neighbours, which are thinned by the
    diversity rule (one is kept unless it is closer to a kept one than to the node), and links back are thinned in the same way.
    """

    def __init__(self, x: np.ndarray, layers: list[np.ndarray], entry: int):
        self.x, self.layers, self.entry = x.astype(np.float32), layers, entry

    @classmethod
    def build(cls, x: np.ndarray, seed: int = 11, block: int = 256, beam: int = 48) -> SmallWorld:
        n = len(x)
        level = np.floor(-np.log(1 - np.random.default_rng(seed).random(n)) / np.log(DEGREE)).astype(int)
        order = np.argsort(-level, kind="stable")
        out = cls(x, [], int(order[0]) if n else 0)
        for k in range(level.max() if n else -1, -1, -1):
            rows = order[: int((level >= k).sum())]
            graph = np.full((n, 2 * DEGREE if k == 0 else DEGREE), -1)
            done = 0
            while done < len(rows):
                part = rows[done : done + min(block, max(FLOOR, done))]
                out._insert(part, rows[:done], graph, beam)
                done += len(part)
            out.layers.insert(0, graph)
        return out

    @classmethod
    def from_links(cls, x: np.ndarray, links: list[np.ndarray] | np.ndarray, sizes: np.ndarray) -> SmallWorld:
        """From the rows of ``links()``, concatenated; ``sizes`` are their lengths."""
        level = sizes // DEGREE - 2
        first = np.cumsum(sizes) - sizes
        layers = []
        for k in range(level.max() + 1):
            at, wide = np.flatnonzero(level >= k), 2 * DEGREE if k == 0 else DEGREE
            graph = np.full((len(x), wide), -1)
            graph[at] = links[(first[at] + (k + 1) * DEGREE * (k > 0))[:, None] + np.arange(wide)]
            layers.append(graph)
        return cls(x, layers, int(np.argmax(level)))

    def links(self) -> Iterator[np.ndarray]:
        """A node's neighbours in all its layers, one after the other."""
        level = np.zeros(len(self.x), int)
        for k, graph in enumerate(self.layers):
            level[(graph >= 0).any(axis=1)] = k
        level[self.entry] = len(self.layers) - 1
        for i, k in enumerate(level):
            yield np.concatenate([g[i] for g in self.layers[: k + 1]])

    def _insert(self, part: np.ndarray, there: np.ndarray, graph: np.ndarray, beam: int) -> None:
        q, most = self.x[part], graph.shape[1]
        s = q @ q.T
        np.fill_diagonal(s, -np.inf)
        c = np.argsort(-s, axis=1)[:, : min(16, len(part) - 1)]
        ids, sims = part[c], np.take_along_axis(s, c, axis=1)
        if len(there):
            start = self._descend(q)
            inside = np.zeros(len(self.x), bool)
            inside[there] = True
            near, far = self._beam(q, np.where(inside[start], start, self.entry), graph, min(beam, len(there)))
            ids, sims = np.concatenate([near, ids], axis=1), np.concatenate([far, sims], axis=1)
        graph[part, : most // 2] = self._thinned(ids, sims, most // 2)
        # links back: the nearest newcomers of each node compete with its neighbours
        a, at = np.nonzero(graph[part, : most // 2] >= 0)
        b, a = graph[part[a], at], part[a]
        order = np.lexsort((-np.einsum("nd,nd->n", self.x[a], self.x[b]), b))
        a, b = a[order], b[order]
        place = np.arange(len(b)) - np.searchsorted(b, b)
        a, b, place = a[place < most], b[place < most], place[place < most]
        nodes, row = np.unique(b, return_inverse=True)
        new = np.full((len(nodes), most), -1)
        new[row, place] = a
        new[(new[:, :, None] == graph[nodes][:, None, :]).any(axis=2)] = -1  # linked already
        ids = np.concatenate([graph[nodes], new], axis=1)
        sims = np.where(ids >= 0, np.einsum("md,mkd->mk", self.x[nodes], self.x[ids]), -np.inf)
        graph[nodes] = self._thinned(ids, sims, most)

    def _thinned(self, ids: np.ndarray, sims: np.ndarray, keep: int, look: int = 40) -> np.ndarray:
        """The ``keep`` neighbours of each row by the diversity rule, nearest first; free places go to the nearest that are left."""
        order = np.argsort(-sims, axis=1, kind="stable")[:, :look]
        ids, sims = np.take_along_axis(ids, order, axis=1), np.take_along_axis(sims, order, axis=1)
        out = np.full((len(ids), keep), -1)
        if not ids.shape[1]:
            return out
        y = self.x[ids]
        between = y @ y.transpose(0, 2, 1)
        real = np.isfinite(sims)
        chosen = np.zeros(ids.shape, bool)
        for k in range(ids.shape[1]):
            chosen[:, k] = real[:, k] & (chosen.sum(axis=1) < keep) & ~((between[:, k, :] > sims[:, k : k + 1]) & chosen).any(axis=1)
        for k in range(ids.shape[1]):
            chosen[:, k] |= real[:, k] & (chosen.sum(axis=1) < keep)
        r, c = np.nonzero(chosen)
        out[r, (np.cumsum(chosen, axis=1) - 1)[r, c]] = ids[r, c]
        return out

    def _descend(self, q: np.ndarray, down_to: int = 0) -> np.ndarray:
        """The nearest node that a greedy walk finds through the layers from the top."""
        start = np.full(len(q), self.entry)
        for graph in self.layers[: down_to - 1 if down_to else None : -1]:
            start = self._beam(q, start, graph, 1)[0][:, 0]
        return start

    def _beam(self, q: np.ndarray, start: np.ndarray, graph: np.ndarray, width: int, ahead: int = 4) -> tuple[np.ndarray, np.ndarray]:
        """Best-first search of each query with a beam of ``width``: positions (-1: none) and similarities, best first."""
        m, ahead = len(q), min(ahead, width)
        ids = np.full((m, width), -1)
        sims = np.full((m, width), -np.inf, np.float32)
        fresh = np.zeros((m, width), bool)
        seen = np.zeros((m, len(self.x)), bool)
        ids[:, 0], sims[:, 0], fresh[:, 0] = start, np.einsum("md,md->m", q, self.x[start]), True
        seen[np.arange(m), start] = True
        live = np.arange(m)
        while len(live):
            at = np.argpartition(-np.where(fresh[live], sims[live], -np.inf), ahead - 1, axis=1)[:, :ahead]
            ok = np.take_along_axis(fresh[live], at, axis=1)
            go = ok.any(axis=1)
            live, at, ok = live[go], at[go], ok[go]
            if not len(live):
                break
            fresh[live[:, None], at] = False
            near = np.where(ok[:, :, None], graph[ids[live[:, None], at]], -1).reshape(len(live), -1)
            near.sort(axis=1)
            new = near >= 0
            new[:, 1:] &= near[:, 1:] != near[:, :-1]
            new &= ~seen[live[:, None], near]
            r, c = np.nonzero(new)
            seen[live[r], near[r, c]] = True
            s = np.full(near.shape, -np.inf, np.float32)
            s[r, c] = np.einsum("nd,nd->n", q[live[r]], self.x[near[r, c]])
            every = np.concatenate([sims[live], s], axis=1)
            best = np.argpartition(-every, width - 1, axis=1)[:, :width]
            ids[live] = np.take_along_axis(np.concatenate([ids[live], near], axis=1), best, axis=1)
            fresh[live] = np.take_along_axis(np.concatenate([fresh[live], new], axis=1), best, axis=1)
            sims[live] = np.take_along_axis(every, best, axis=1)
        ids[~np.isfinite(sims)] = -1
        order = np.argsort(-sims, axis=1, kind="stable")
        return np.take_along_axis(ids, order, axis=1), np.take_along_axis(sims, order, axis=1)

    def search(self, q: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        q = q.astype(np.float32)
        return self._beam(q, self._descend(q, 1), self.layers[0], min(width, len(self.x)))


class Index:
    """A shard's graph and vectors, asked by the queries of one cell with the beam that passed their audit."""

    def __init__(self, x: np.ndarray, graph: SmallWorld, least: float, first: int = 32):
        self.x, self.graph, self.least, self.width, self.searches = x, graph, least, first, 0

    def audit(self, q: np.ndarray, own: bool, recall: float = 0.98, block: int = 256, wanted: int = 64, seed: int = 5) -> float:
        """Widens the beam until ``recall`` of the partners of probes is found, on the average over probes; returns that share.

        Probes are queries that have partners by a full comparison, drawn from up to four blocks of queries; ``own``: the queries are
        the shard itself, and a vector is no partner of its own.
        """
        rows, true = [], []
        every = np.random.default_rng(seed).permutation(len(q))
        for at in range(0, min(len(q), 4 * block), block):
            part = every[at : at + block]
            near = q[part] @ self.x.T >= self.least
            if own:
                near[np.arange(len(part)), part] = False
            some = near.any(axis=1)
            rows.append(part[some])
            true.append(near[some])
            if sum(map(len, rows)) >= wanted:
                break
        probes, near = np.concatenate(rows) if rows else np.zeros(0, int), np.concatenate(true) if true else np.zeros((0, len(self.x)), bool)
        while len(probes):
            r, c = self._hits(q[probes], self.width)
            got = float((np.bincount(r, near[r, c], len(probes)) / near.sum(axis=1)).mean())
            if got >= recall or self.width >= len(self.x):
                return got
            self.width *= 2
        return 1.0

    def _hits(self, q: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        rows, cols, n = [np.zeros(0, int)], [np.zeros(0, int)], len(self.x)
        todo = np.arange(len(q))
        while len(todo):
            if n <= FLOOR or (width > self.width and 4 * width >= n) or width >= n:  # the widest beam is the whole shard
                r, c = np.nonzero(q[todo] @ self.x.T >= self.least - 1e-9)
                rows.append(todo[r])
                cols.append(c)
                break
            self.searches += len(todo)
            ids, sims = self.graph.search(q[todo], width)
            more = sims[:, -1] >= self.least - 1e-5
            r, c = np.nonzero((sims >= self.least - 1e-5) & (ids >= 0) & ~more[:, None])
            rows.append(todo[r])
            cols.append(ids[r, c])
            todo, width = todo[more], width * 4
        return np.concatenate(rows), np.concatenate(cols)

    def partners(self, q: np.ndarray, step: int = 512) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Blocks of (query, position) pairs with cosine >= the threshold in double precision."""
        for at in range(0, len(q), step):
            r, c = self._hits(q[at : at + step], self.width)
            ok = np.einsum("md,md->m", q[at + r], self.x[c]) >= self.least
            yield at + r[ok], c[ok]


def _vectors(column: pa.ChunkedArray) -> np.ndarray:
    return column.combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)  # so that no square overflows or vanishes
    return x / np.sqrt(np.einsum("nd,nd->n", x, x))[:, None]


def graphs(nodes: DataFrame) -> DataFrame:
    """nodes (shard long, node long, v array<double>, any more) -> the same with v normalised, pos int, links array<int>: a small-world graph per shard."""
    rest = [c for c in nodes.columns if c not in ("shard", "v")]

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, t in sorted_groups(batches, "shard"):
            x = _unit(_vectors(t.column("v")))
            links = [pa.array(a.astype(np.int32)) for a in SmallWorld.build(x).links()]
            cols = [t.column("shard"), *(t.column(c) for c in rest), pa.array(list(x)), pa.array(np.arange(len(x), dtype=np.int32)), pa.array([a.to_pylist() for a in links], pa.list_(pa.int32()))]
            yield from pa.table(cols, names=["shard", *rest, "v", "pos", "links"]).to_batches(max_chunksize=2048)

    schema = nodes.select("shard", *rest, "v", F.lit(0).alias("pos"), F.array(F.lit(0)).alias("links")).schema
    return nodes.select("shard", *rest, "v").repartition("shard").sortWithinPartitions("shard").mapInArrow(build, schema)


def cluster(vectors: DataFrame, least: float = 0.93, shard_rows: int = 4096) -> DataFrame:
    """vectors (vec_id, embedding, label, any more) -> vec_id, n_links, component_id, kept; one row per input row.

    Two vectors are linked if their labels are equal and not null and their cosine in double precision is ``least``
    or more; vectors of different length aren't compared. Null or zero vectors, vectors with null or non-finite parts and rows with a
    null label or vec_id link with nothing: n_links 0, component_id their own vec_id. Rows are vectors of their own whether or not they share a
    vec_id: equal ones of a label are links of each other, different ones are compared. Empty tables give no rows.
    """
    v = F.transform("embedding", lambda x: x.cast("double"))
    good = (
        F.col("label").isNotNull() & F.col("vec_id").isNotNull() & (F.size("embedding") > 0)
        & ~F.exists(v, lambda x: F.coalesce(F.isnan(x) | (F.abs(x) == float("inf")), F.lit(True))) & F.exists(v, lambda x: x != 0)
    )
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").alias("label"), v.alias("v"), F.coalesce(good, F.lit(False)).alias("good"))
    # adding 0.0 turns -0.0 into 0.0
    rows = rows.withColumn("same", F.when(F.col("good"), F.sha2(F.concat_ws(",", F.col("label").cast("string"), F.transform("v", lambda x: (x + 0.0).cast("string"))), 256)))
    rows = stored(rows.select("vec_id", "label", "v", "good", "same"), "vectors")
    nodes = rows.where("good").groupBy("same").agg(F.min("vec_id").alias("least"), F.count(F.lit(1)).alias("copies"), F.first("label").alias("label"), F.first("v").alias("v"))
    nodes = numbered(nodes.withColumn("dim", F.size("v")), "node", "least", "same")  # nodes rise with vec_id
    sizes = nodes.groupBy("label", "dim").agg(F.ceil(F.count(F.lit(1)) / F.lit(float(shard_rows))).cast("int").alias("shards"))
    shards = numbered(sizes.withColumn("at", F.explode(F.sequence(F.lit(0), F.col("shards") - 1))), "shard", "label", "dim", "at")
    spot = nodes.join(few(shards.where("at = 0").select("label", "dim", "shards", F.col("shard").alias("first"))), ["label", "dim"])
    spot = spot.withColumn("shard", F.col("first") + F.pmod(F.xxhash64("node"), F.col("shards")))
    made = stored(graphs(spot.select("shard", "first", "shards", "node", "copies", "v")), "graphs")
    last = F.col("first") + F.col("shards") - 1
    # a member stands in the cells of the shards from its own on, a query in those before its own
    asked = made.withColumn("to", F.explode(F.sequence("shard", last))).select(F.shiftleft("shard", 31).bitwiseOR(F.col("to")).alias("cell"), F.lit(False).alias("query"), "pos", "node", "copies", "v", "links")
    asking = made.where("shard > first").withColumn("to", F.explode(F.sequence("first", F.col("shard") - 1)))
    asking = asking.select(F.shiftleft("to", 31).bitwiseOR(F.col("shard")).alias("cell"), F.lit(True).alias("query"), "pos", "node", "copies", "v", F.lit(None).cast("array<int>").alias("links"))

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cell, t in sorted_groups(batches, "cell"):
            query, ids, copies = (t.column(c).to_numpy() for c in ("query", "node", "copies"))
            x, n = _vectors(t.column("v")), int((~query).sum())  # members come first, by position
            links = t.column("links").combine_chunks().slice(0, n)
            own = cell >> 31 == cell & ((1 << 31) - 1)
            found, sets = np.zeros(len(ids), np.int64), Sets(len(ids))
            if n and (own or n < len(ids)):
                index = Index(x[:n], SmallWorld.from_links(x[:n], links.flatten().to_numpy(), links.value_lengths().to_numpy()), least)
                ask = x[:n] if own else x[n:]
                index.audit(ask, own)
                mine = []
                for r, c in index.partners(ask):
                    if own:  # a pair found from either end is a link
                        a, b = np.maximum(r, c), np.minimum(r, c)
                        mine.append((a * n + b)[a != b])
                        continue
                    np.add.at(found, n + r, copies[c])
                    np.add.at(found, c, copies[n + r])
                    sets.union(n + r, c)
                if mine:
                    pairs = np.unique(np.concatenate(mine))
                    a, b = pairs // n, pairs % n
                    np.add.at(found, a, copies[b])
                    np.add.at(found, b, copies[a])
                    sets.union(a, b)
            hit = np.flatnonzero(found)
            yield pa.record_batch([pa.array(ids[hit]), pa.array(ids[sets.root[hit]]), pa.array(found[hit])], names=["u", "v", "links"])

    cells = asked.unionByName(asking).repartition("cell").sortWithinPartitions("cell", "query", "pos")
    links = stored(cells.mapInArrow(match, "u long, v long, links long"), "links")
    counts = links.groupBy("u").agg(F.sum("links").alias("links"))
    roots = components(links.select("u", "v")).join(nodes.select(F.col("node").alias("root"), F.col("least").alias("smallest")), "root")
    told = nodes.select("same", "least", "copies", F.col("node").alias("u")).join(counts, "u", "left").join(roots.withColumnRenamed("node", "u"), "u", "left")
    told = told.select("same", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("smallest", "least").alias("component_id"))
    linked = rows.where("good").select("vec_id", "same").join(told, "same").select("vec_id", F.col("n_links").cast("long").alias("n_links"), "component_id")
    alone = rows.where(~F.col("good")).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
