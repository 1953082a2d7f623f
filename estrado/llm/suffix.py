"""Exact removal of repeated 100-byte strings by bucket-pointer refinement.

Sorting every suffix of a large corpus would move each byte many times over. Here only sampled offsets are
moved: of the q-grams inside each window of ``length`` bytes the one with the least hash is its anchor, so equal windows have equal
anchors at equal places, and a text has about one anchor in (length - q) / 2 bytes.

1. Initial buckets: anchors are bucketed by their q-gram. In a bucket, anchors are sorted by the identifier of the whole region
   that their windows cover. Of equal regions all windows but those of the first are repeats; nothing more is needed for them.
2. Refinement: in buckets with several regions, the first of each region is fetched, and its windows are sorted by pairs of bucket
   identifiers, of an offset and of a later one: 8-grams give 16-grams, those 32-grams, and so on up to the whole length,
   each round reusing the identifiers of the round before. In the last buckets every window but the first is a repeat.

No bucket is gathered in one task. In the first round, buckets that a sample finds to be large are dealt by region and by part of the
corpus; the firsts of all parts are refined, so the sample shapes the work and never the result. In the second round, buckets that
are counted to hold very many regions are left by their windows: these are grouped by their hash, and the first of each is found by partial aggregation.

Documents are ordered by doc_id; offsets, lengths and spans are in UTF-8 bytes. Equal texts are found beforehand.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import stored
from .streams import few, keyed, small_batches

LENGTH = 100
Q = 24
PIECE = 1 << 20
U = np.uint64
_rng = np.random.default_rng(20240101)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64)
_BASE = U(int(_rng.integers(1, 2**62)) * 2 + 1)
_INVERSE = U(pow(int(_BASE), -1, 2**64))


@cache
def _powers() -> tuple[np.ndarray, np.ndarray]:
    n = PIECE + 2 * LENGTH
    up, down = np.full(n, _BASE), np.full(n, _INVERSE)
    up[0] = down[0] = 1
    return np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)


def _mixed(x: np.ndarray, by: int) -> np.ndarray:
    x = (x ^ (x >> U(31))) * U(by)
    return x ^ (x >> U(29))


def anchors(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, q: int, length: int) -> tuple[np.ndarray, ...]:
    """bucket, region, first window, last window, anchor of each run of windows with one anchor, over stretches of ``data``."""
    up, down = _powers()
    n = len(data)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTE[data] * up[:n], dtype=np.uint64)])
    grams = n - q + 1
    gram = (total[q:] - total[:grams]) * down[:grams]
    low = (_mixed(gram, 0x9E3779B97F4A7C15) & ~U((1 << 24) - 1)) | np.arange(grams, dtype=np.uint64)
    width, have = length - q + 1, 1
    while have < width:
        step = min(have, width - have)
        low = np.minimum(low[:-step], low[step:])
        have += step
    at = np.repeat(starts - np.concatenate([[0], np.cumsum(ends - starts - length + 1)[:-1]]), ends - starts - length + 1)
    windows = at + np.arange(len(at))
    anchor = (low[windows] & U((1 << 24) - 1)).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]]))
    a, lo, hi = anchor[first], windows[first], windows[np.concatenate([first[1:], [len(windows)]]) - 1]
    region = _mixed((total[hi + length] - total[lo]) * down[lo] + (((a - lo) << 8) + (hi - lo)).astype(np.uint64) * U(0xD6E8FEB86659FD93), 0xC2B2AE3D27D4EB4F)
    bucket = _mixed(gram[a], 0x165667B19E3779F9) >> U(24)
    return bucket.astype(np.int64), region.view(np.int64), lo, hi, a


def _pieces(keys: list, texts: list[bytes], length: int) -> Iterator[tuple]:
    """Stretches of texts in blocks of at most PIECE bytes; a longer text is cut so that every window lies in one stretch."""
    held, size = [], 0
    for key, text in zip(keys, texts, strict=True):
        for at in range(0, len(text) - length + 1, PIECE - length):
            part = text[at : at + PIECE - 1]
            if size + len(part) > PIECE and held:
                yield held
                held, size = [], 0
            held.append((key, at, part))
            size += len(part)
            if at + len(part) >= len(text):
                break
    if held:
        yield held


def _sampled(z: DataFrame, q: int, length: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for block in _pieces(b.column(0).to_pylist(), b.column(1).to_pylist(), length):
                sizes = np.array([len(x[2]) for x in block])
                ends = np.cumsum(sizes)
                starts = ends - sizes
                bucket, region, lo, hi, a = anchors(np.frombuffer(b"".join(x[2] for x in block), np.uint8), starts, ends, q, length)
                of = np.searchsorted(ends, lo, side="right")
                base = np.array([x[1] for x in block])[of] - starts[of]
                keys = np.array([x[0] for x in block], np.int64)[of]
                yield pa.record_batch([pa.array(bucket), pa.array(region), pa.array(keys), pa.array(lo + base), pa.array((hi - lo).astype(np.int32))], names=["bucket", "region", "key", "lo", "more"])

    return z.mapInArrow(run, "bucket long, region long, key long, lo long, more int")


def _large(raw: DataFrame, q: int, length: int, share: float, drawn: int = 4096) -> list[int]:
    """Buckets that hold more than ``share`` of the anchors of a sample of about ``drawn`` texts: at most 1 / share of them."""
    step = max(1, raw.count() // drawn)
    seen = _sampled(raw.where(F.pmod(F.xxhash64("key"), F.lit(step)) == 0), q, length).groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))
    seen = stored(seen, "anchor-sample")
    total = seen.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    return sorted(r[0] for r in seen.where(F.col("n") > max(8.0, share * total)).select("bucket").collect())


def _first_round(rows: DataFrame, large: list[int], parts: int = 64) -> DataFrame:
    """bucket, region, key, lo, more -> key, lo, more, bucket: bucket is null for windows known to be repeats, else they must be refined.

    Large buckets are dealt by region and in ``parts``: a part's first of each region is refined, whatever the other parts hold.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last_bucket = last_region = None
        pending = None  # the first row of the bucket that is open, until a second region shows up
        for b in batches:
            if not b.num_rows:
                continue
            bucket, region, key, lo, more = (c.to_numpy() for c in b.columns[:5])
            hot = b.column(5).to_numpy(zero_copy_only=False)
            new_b, new_r = np.ones(len(bucket), bool), np.ones(len(bucket), bool)
            new_b[1:] = bucket[1:] != bucket[:-1]
            new_r[1:] = new_b[1:] | (region[1:] != region[:-1])
            new_b[0] = bucket[0] != last_bucket
            new_r[0] = new_b[0] or region[0] != last_region
            group = np.cumsum(new_b)
            several = np.bincount(group, (new_r & ~new_b) | hot, minlength=group[-1] + 1) > 0
            refine = new_r & (~new_b | several[group])
            mark = np.where(refine, bucket, -1)
            out = refine | ~new_r
            early = []
            if not new_b[0]:
                if several[0] and pending is not None:
                    early, pending = [pending], None
            if group[-1] > 0:  # a later bucket is open now
                at = np.flatnonzero(new_b)[-1]
                pending = None if several[group[-1]] else (key[at], lo[at], more[at], bucket[at])
            cols = [np.concatenate([np.array([e[i] for e in early], x.dtype), x[out]]) for i, x in enumerate((key, lo, more, mark))]
            last_bucket, last_region = bucket[-1], region[-1]
            arrays = [*map(pa.array, cols[:3]), pa.array(cols[3], mask=cols[3] < 0)]
            yield pa.record_batch(arrays, names=["key", "lo", "more", "bucket"])

    hot = F.col("bucket").isin(large) if large else F.lit(False)
    spot = F.when(F.col("hot"), F.xxhash64("bucket", "region", F.pmod(F.xxhash64("key"), F.lit(parts)))).otherwise(F.col("bucket"))
    dealt = rows.withColumn("hot", hot).repartition(spot).sortWithinPartitions("bucket", "region", "key", "lo")
    return dealt.mapInArrow(run, "key long, lo long, more int, bucket long")


def _ids(x: np.ndarray) -> np.ndarray:
    return np.unique(x, return_inverse=True)[1].astype(np.int64)


def refine(data: np.ndarray, sizes: np.ndarray, keys: np.ndarray, los: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """key, start, end of runs of windows that repeat an earlier one, of regions laid end to end in ``data``."""
    starts = np.cumsum(sizes) - sizes
    n = len(data)
    gram, d = np.zeros(n, np.uint64), np.concatenate([data, np.zeros(8, np.uint8)])
    for i in range(8):
        gram |= d[i : i + n].astype(np.uint64) << U(8 * i)
    ids, have = _ids(gram), 8
    while have * 2 <= min(32, length):
        later = np.concatenate([ids[have:], np.zeros(min(have, n), np.int64)])[:n]
        ids, have = _ids(ids * (n + 1) + later), 2 * have
    counts = sizes - length + 1
    of = np.repeat(np.arange(len(sizes)), counts)
    s = np.arange(len(of)) - np.repeat(np.cumsum(counts) - counts, counts) + starts[of]
    now = ids[s]
    at = have
    while True:  # s are the windows left, now their identifiers over the first ``at`` bytes
        live = np.bincount(now)[now] > 1
        s, of, now = s[live], of[live], now[live]
        if at >= length or not len(s):
            break
        at = min(at + have, length)
        now = _ids(now * (n + 1) + ids[s + at - have])
    place = los[of] + s - starts[of]
    order = np.lexsort((place, keys[of], now))
    again = np.zeros(len(s), bool)
    again[order[1:]] = now[order[1:]] == now[order[:-1]]
    s, of, place = s[again], of[again], place[again]
    if not len(s):
        return keys[:0], los[:0], los[:0]
    cut = np.concatenate([[True], (s[1:] != s[:-1] + 1) | (of[1:] != of[:-1])])
    first = np.flatnonzero(cut)
    last = np.concatenate([first[1:], [len(s)]]) - 1
    return keys[of[first]], place[first], place[last] + length


def _by_windows(todo: DataFrame, z: DataFrame, length: int) -> DataFrame:
    """As ``_second_round``, for buckets of any size: every window of every region is a row (bucket, hash, key, lo)."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        up, down = _powers()
        for b in batches:
            for key, text, spots in zip(*(c.to_pylist() for c in b.columns), strict=True):
                text = zstandard.decompress(text)
                for p in spots:
                    data = np.frombuffer(text[p["lo"] : p["lo"] + p["more"] + length], np.uint8)
                    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTE[data] * up[: len(data)], dtype=np.uint64)])
                    n = len(data) - length + 1
                    h = _mixed((total[length:] - total[:n]) * down[:n], 0xC2B2AE3D27D4EB4F)
                    yield pa.record_batch([pa.array(np.full(n, p["bucket"])), pa.array(h.view(np.int64)), pa.array(np.full(n, key)), pa.array(p["lo"] + np.arange(n))], names=["bucket", "hash", "key", "lo"])

    windows = stored(_spots(todo, z).mapInArrow(cut, "bucket long, hash long, key long, lo long"), "windows")
    firsts = windows.groupBy("bucket", "hash").agg(F.min(F.struct("key", "lo")).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    again = windows.join(firsts, ["bucket", "hash"]).where(F.struct("key", "lo") != F.col("first"))
    return again.select("key", "lo", (F.col("lo") + length).alias("hi"))


def _spots(todo: DataFrame, z: DataFrame) -> DataFrame:
    """key, z, spots: each text with its regions."""
    spots = todo.groupBy("key").agg(F.collect_list(F.struct("lo", "more", "bucket")).alias("spots"))  # bounded by the length of one text
    return z.join(spots, "key").select("key", "z", "spots")


def _second_round(todo: DataFrame, z: DataFrame, length: int, chunk: int = 1 << 21) -> DataFrame:
    """todo (key, lo, more, bucket), z (key, z) -> key, lo, hi: spans of repeated windows."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out, size = [], 0
            for key, text, spots in zip(*(c.to_pylist() for c in b.columns), strict=True):
                text = zstandard.decompress(text)
                for p in spots:
                    part = text[p["lo"] : p["lo"] + p["more"] + length]
                    out.append((p["bucket"], key, p["lo"], part))
                    size += len(part)
                if size > 4 << 20:
                    yield pa.record_batch([pa.array(c) for c in zip(*out, strict=True)], names=["bucket", "key", "lo", "part"])
                    out, size = [], 0
            if out:
                yield pa.record_batch([pa.array(c) for c in zip(*out, strict=True)], names=["bucket", "key", "lo", "part"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def solved(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
            t = pa.Table.from_batches(parts)
            texts = t.column("part").to_pylist()
            found = refine(np.frombuffer(b"".join(texts), np.uint8), np.array([len(x) for x in texts]), t.column("key").to_numpy(), t.column("lo").to_numpy(), length)
            return pa.record_batch([pa.array(x) for x in found], names=["key", "lo", "hi"])

        held, size, open_ = [], 0, None
        for b in batches:
            if not b.num_rows:
                continue
            bucket = b.column(0).to_numpy()
            weights = pc.binary_length(b.column(3)).to_numpy()
            at = 0
            for i in np.flatnonzero(np.concatenate([[open_ is not None and bucket[0] != open_], bucket[1:] != bucket[:-1]])):
                if size + weights[at:i].sum() >= chunk:  # whole buckets only
                    if i > at:
                        held.append(b.slice(at, i - at))
                    if held:
                        yield solved(held)
                    held, size, at = [], 0, i
            held.append(b.slice(at))
            size += weights[at:].sum()
            open_ = bucket[-1]
        if held:
            yield solved(held)

    parts = _spots(todo, z).mapInArrow(cut, "bucket long, key long, lo long, part binary")
    return parts.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(run, "key long, lo long, hi long")


def _packed(docs: DataFrame) -> DataFrame:
    """key, doc_id, z: texts compressed, as they are moved more than once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=3)
        for b in batches:
            yield pa.record_batch([b.column(0), b.column(1), pa.array([pack.compress(x.as_py()) for x in b.column(2)], pa.binary())], names=["key", "doc_id", "z"])

    text = F.coalesce("text", F.lit("")).cast("binary")
    return docs.select(F.col("_key").alias("key"), F.col("doc_id").cast("long").alias("doc_id"), text.alias("t")).mapInArrow(run, "key long, doc_id long, z binary")


def repeated_spans(docs: DataFrame, length: int = LENGTH, q: int = Q, most_copies: int = 4_000_000, share: float = 0.001, most_regions: int = 50_000) -> tuple[DataFrame, DataFrame]:
    """docs (_key, doc_id, text) -> spans (key, lo, hi), overlapping ones included, and the packed texts (key, doc_id, z).

    A later copy of an equal text is one span over all of it. Copies' keys are broadcast if there are at most ``most_copies``
    (8 bytes each), else joined by a shuffle. Buckets of more than ``share`` of a sample's anchors are split in the first round, those of
    more than ``most_regions`` regions are left by windows in the second.
    """
    same = (F.xxhash64("text"), F.crc32("text"), F.octet_length("text"))
    slim = docs.where(F.octet_length("text") >= length).select("_key", F.struct(*same).alias("same"))
    firsts = slim.groupBy("same").agg(F.min("_key").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("same", "first")
    copies = stored(slim.join(firsts, "same").where("_key <> first").select("_key"), "copies")
    texts = docs.where(F.octet_length("text") >= length).join(few(copies, most_copies), "_key", "left_anti")
    raw = texts.select(F.col("_key").alias("key"), F.col("text").cast("binary").alias("t"))
    found = stored(_first_round(_sampled(raw, q, length), _large(raw, q, length, share)), "first-round")
    z = _packed(texts)
    todo = found.where("bucket is not null")
    many = stored(todo.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most_regions).select("bucket"), "large-buckets")
    if many.isEmpty():
        finer = _second_round(todo, z, length)
    else:
        finer = _second_round(todo.join(few(many), "bucket", "left_anti").select(*todo.columns), z, length)
        finer = finer.unionByName(_by_windows(todo.join(few(many), "bucket", "left_semi").select(*todo.columns), z, length))
    sure = found.where("bucket is null").select("key", "lo", (F.col("lo") + F.col("more") + length).alias("hi"))
    whole = copies.select(F.col("_key").alias("key"), F.lit(0).cast("long").alias("lo"), F.lit(2**62).alias("hi"))
    return sure.unionByName(finer).unionByName(whole), _packed(docs)


def remove_repeats(docs: DataFrame, length: int = LENGTH, texts: bool = False, **settings) -> DataFrame:
    """docs (doc_id, text, any more) -> doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, if wanted, kept (what is left, binary).

    A byte goes if it is covered by a string of ``length`` bytes that also starts earlier: in a smaller doc_id, or in the same document. Documents
    with a null doc_id come last; documents that share a doc_id are ordered by a hash of their text. Null texts are empty. Empty tables give no rows.
    """
    small_batches(docs.sparkSession)
    keys = keyed(docs.select("doc_id", "text"))
    spans, z = repeated_spans(keys, length, **settings)
    lists = spans.groupBy("key").agg(F.collect_list(F.struct("lo", "hi")).alias("spans"))  # bounded by the length of one text
    names = ["n_bytes", "n_removed", "n_spans", "kept_sha256", *(["kept"] if texts else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for packed, found in zip(b.column(1), b.column(2), strict=True):
                text = zstandard.decompress(packed.as_py())
                data, n_spans = text, 0
                if found.is_valid and text:
                    pairs = found.values
                    lo = np.minimum(pairs.field("lo").to_numpy(), len(text))
                    hi = np.minimum(pairs.field("hi").to_numpy(), len(text))
                    order = np.argsort(lo, kind="stable")
                    lo, hi = lo[order], np.maximum.accumulate(hi[order])
                    new = np.concatenate([[True], lo[1:] > hi[:-1]])
                    first = np.flatnonzero(new)
                    a, e = lo[first], hi[np.concatenate([first[1:], [len(lo)]]) - 1]
                    n_spans = int((e > a).sum())
                    data = b"".join(text[x:y] for x, y in zip([0, *e.tolist()], [*a.tolist(), len(text)], strict=True))
                out.append((len(text), len(text) - len(data), n_spans, hashlib.sha256(data).hexdigest(), *([data] if texts else [])))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
            yield pa.record_batch([b.column(0), *(pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=False))] if out else [b.column(0), *(pa.array([], k) for _, k in zip(names, kinds, strict=False))], names=["doc_id", *names])

    joined = z.join(lists, "key", "left")
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", kept binary" if texts else "")
    return joined.select("doc_id", "z", "spans").mapInArrow(run, schema)
