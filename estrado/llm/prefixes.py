"""Conversation prefix trie: what conversations share from their first turn on, as nodes of a trie over whole sequences of turns.

A conversation is the array of its turns' digests. Arrays are range-sorted over all tasks (by array and then by conversation, so that copies of one
conversation spread), neighbours' longest common prefixes are found, and one sweep of each part with a stack turns LCP intervals into nodes. All
figures of a node are sums over the rows of its interval, so an interval that crosses parts is left open by each of them, and the open pieces of a
node are added up by its identity, a digest of the path to it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import stored
from .streams import few

#: Bytes of a turn's digest, and conversation numbers that are hashed at once.
WIDE, PIECE = 16, 50_000


def turns(conversations: DataFrame) -> DataFrame:
    """conversations (conv_id, turn, role, text, any more) -> conv_id, turns: an array of (turn, digest, size) in the order of turns, null first.

    Null roles and texts are empty; turns of the same number follow each other by role and digest; rows without a conv_id belong to no conversation and are left
    out. Only digests are moved, and an array must fit in a row: 16 bytes and a number for each turn of a conversation.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text))
    rows = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), F.struct(F.col("turn").cast("long").alias("turn"), role.alias("role"), digest.alias("digest"), F.length(text).alias("size")).alias("x"))
    return rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("x")).alias("turns"))


def rebuilt(held: DataFrame) -> DataFrame:
    """held (conv_id, turns) -> the same, with the first h turns replaced by those of the conversation that starts its hundred; h = crc32(conv_id) % 6."""
    base, h = F.col("conv_id") - F.col("conv_id") % 100, F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(6)).cast("int")
    starts = held.where("conv_id % 100 = 0").select(F.col("conv_id").alias("base"), F.slice("turns", 1, 5).alias("start"))
    both = held.select("conv_id", "turns", base.alias("base"), h.alias("h")).join(starts, "base", "left")
    start = F.coalesce(F.slice("start", F.lit(1), F.col("h")), F.slice("turns", 1, 0))
    return both.select("conv_id", F.concat(start, F.slice("turns", F.col("h") + 1, F.greatest(F.size("turns"), F.lit(1)))).alias("turns"))


def common(a: bytes, b: bytes) -> int:
    """Turns that two arrays share from the first on."""
    n = min(len(a), len(b)) // WIDE
    if a[: n * WIDE] == b[: n * WIDE]:
        return n
    return int((np.frombuffer(a, np.uint64, 2 * n) != np.frombuffer(b, np.uint64, 2 * n)).argmax()) // 2


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[bool, list]]:
    """(whether a new run begins, columns) of slices of consecutive rows: ``at`` counts on by 1 within a stored part and leaps between parts."""
    last = None
    for b in batches:
        at = b.column(0).to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(at) != 1) + 1).tolist(), len(at)]
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            if hi > lo:
                yield last is None or at[lo] != last + 1, b.slice(lo, hi - lo).columns
                last = at[hi - 1]


def _edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """First and last row of each run."""
    out: list[list] = []
    for new, (at, path) in _runs(batches):
        if new:
            out.append([at[0].as_py(), path[0].as_py(), None, None])
        out[-1][2:] = [at[-1].as_py(), path[-1].as_py()]
    if out:
        yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*out, strict=True), (pa.int64(), pa.binary()) * 2, strict=True)], names=["first_at", "first", "last_at", "last"])


class Node:
    """An open interval of the stack: what its rows so far add up to, without the intervals within that are still open."""

    __slots__ = ("asked", "children", "ends", "least", "leaves", "n", "name", "saved", "size", "started")

    def __init__(self, name: bytes, size: int, started: bool):
        self.name, self.size, self.started = name, size, started
        self.n = self.children = self.leaves = self.saved = 0
        self.least: int | None = None
        self.asked, self.ends = False, []


NODES = "node binary, parent binary, conv_id long, depth int, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string, open boolean, asked boolean, at long, ends array<long>"
KINDS = [pa.binary(), pa.binary(), pa.int64(), pa.int32(), *[pa.int64()] * 5, pa.string(), pa.bool_(), pa.bool_(), pa.int64(), pa.list_(pa.int64())]


def _sha(ends: list[int]) -> str:
    return hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()


def _sweep(edges):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stack: list[Node] = []
        out: list[tuple] = []
        begun = before = after = 0
        path, depth = b"", 0

        def close(to: int, next_shared: int) -> None:
            """Ends the intervals deeper than ``to``; those that the row before or after the run is in too stay open, as pieces."""
            while len(stack) > to + 1:
                x, d = stack.pop(), len(stack)
                is_open = d <= before or d <= next_shared
                up = stack[-1] if stack else None
                x.saved += x.size * (x.n - x.started)
                if up:
                    up.n += x.n
                    up.leaves += x.leaves
                    up.saved += x.saved
                    up.least = x.least if up.least is None else min(up.least, x.least)
                # the parent's smallest member is final if it ends here too, within this run
                known = up is not None and d - 1 > to and not (d - 1 <= before or d - 1 <= next_shared)
                if up and not known:
                    up.asked = True
                out.append((x.name, None if up is None or known else up.name, x.least, d, up.least if known else None, x.n, x.children, x.leaves, x.saved, None if is_open else _sha(x.ends), is_open, x.asked, begun, x.ends if is_open else []))

        def rows() -> pa.RecordBatch:
            made = pa.record_batch([pa.array(c, k) for c, k in zip(zip(*out, strict=True), KINDS, strict=True)], names=[f.split()[0] for f in NODES.split(", ")])
            out.clear()
            return made

        def end_of_run() -> None:
            if stack:
                stack[depth].leaves += after < depth
                close(-1, after)

        for new, (at, paths, convs, sizes) in _runs(batches):
            if new:
                end_of_run()
                begun = at[0].as_py()
                before, after = edges.value[begun]
            for i in range(len(at)):
                conv, now, first = convs[i].as_py(), paths[i].as_py(), new and i == 0
                shared = before if first else common(path, now)
                if not first:
                    stack[depth].leaves += shared < depth
                    close(shared, -1)
                path, depth = now, len(now) // WIDE
                size = sizes[i].as_py()
                for d in range(len(stack), depth + 1):
                    name = hashlib.md5(stack[-1].name + now[(d - 1) * WIDE : d * WIDE]).digest() if d else b""
                    stack.append(Node(name, size[d - 1] if d else 0, d > shared))
                for d in range(max(shared, 0), depth):
                    stack[d].children += 1
                x = stack[depth]
                x.n += 1
                x.least = conv if x.least is None else min(x.least, conv)
                x.ends.append(conv)
                if len(out) > 20_000:
                    yield rows()
        end_of_run()
        if out:
            yield rows()

    return run


def _hash_ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digests of numbers that come sorted by node and place."""
    now, state = None, None
    for b in batches:
        out = []
        for node, ends in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            text = ",".join(map(str, ends)).encode()
            if node != now:
                if state:
                    out.append((now, state.hexdigest()))
                now, state = node, hashlib.sha256(text)
            else:
                state.update(b"," + text)
        if out:
            yield pa.record_batch([pa.array([x[0] for x in out], pa.binary()), pa.array([x[1] for x in out])], names=["node", "sha"])
    if state:
        yield pa.record_batch([pa.array([now], pa.binary()), pa.array([state.hexdigest()])], names=["node", "sha"])


def trie(held: DataFrame) -> DataFrame:
    """held (conv_id, turns) -> a row per node of their trie: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    Without conversations there is no node; conversations without turns end at the root. What reaches the driver is the first and last array of each stored
    part; the numbers of the conversations that end at a node which crosses parts are hashed in order by one task, piece by piece, as the digest asks for it.
    """
    spark = held.sparkSession
    path: Column = F.unhex(F.array_join(F.transform("turns", lambda x: x["digest"]), ""))
    rows = held.select("conv_id", F.coalesce(path, F.lit(b"")).alias("path"), F.transform("turns", lambda x: x["size"]).alias("sizes"))
    rows = rows.repartitionByRange("path", "conv_id").sortWithinPartitions("path", "conv_id")
    rows = stored(rows.select(F.monotonically_increasing_id().alias("at"), "path", "conv_id", "sizes"), "sorted")

    ends = sorted(rows.select("at", "path").mapInArrow(_edges, "first_at long, first binary, last_at long, last binary").collect())  # a few rows per task
    shared = [-1, *(common(a["last"], b["first"]) for a, b in zip(ends[:-1], ends[1:], strict=True)), -1]
    edges = spark.sparkContext.broadcast({r["first_at"]: (shared[i], shared[i + 1]) for i, r in enumerate(ends)})
    swept = stored(rows.mapInArrow(_sweep(edges), NODES), "swept")

    # pieces of the nodes that cross parts, added up
    pieces = swept.where("open")
    cut = F.posexplode(F.expr(f"transform(sequence(0, greatest(0, (size(ends) - 1) div {PIECE})), i -> slice(ends, i * {PIECE} + 1, {PIECE}))")).alias("i", "part")
    told = pieces.where("size(ends) > 0").select("node", "at", cut).repartition("node").sortWithinPartitions("node", "at", "i").select("node", "part").mapInArrow(_hash_ends, "node binary, sha string")
    sums = pieces.groupBy("node").agg(
        F.first("parent").alias("parent"), F.min("conv_id").alias("conv_id"), F.first("depth").alias("depth"), F.lit(None).cast("long").alias("parent_conv_id"),
        *(F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")))
    whole = sums.join(told, "node", "left").withColumn("ends_sha256", F.coalesce("sha", F.lit(_sha([])))).drop("sha").withColumn("asked", F.lit(True))
    nodes = swept.where("not open").select(whole.columns).unionByName(stored(whole, "stitched"))
    known = stored(nodes.where("asked").select(F.col("node").alias("parent"), F.col("conv_id").alias("up")), "branches")
    done = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    nodes = nodes.where("parent is null").select(done).unionByName(nodes.where("parent is not null").join(few(known, 1_000_000), "parent").withColumn("parent_conv_id", F.col("up")).select(done))
    return nodes.withColumn("depth", F.col("depth").cast("long"))
