"""Sharding, SimHash, suffix dedup and embeddings against brute force, and their edge cases."""

import collections
import hashlib
import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from estrado.llm import components, embed, sharding, simhash, streams, suffix

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, None, None, None) for i, t in rows], DOCS)


def roots(nodes, links):
    up = {n: n for n in nodes}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_components(spark):
    rng = random.Random(1)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(170)] + [(500, i) for i in range(501, 560)] + [(i, i + 1) for i in range(600, 640)]
    df = spark.createDataFrame(links + [(None, 3), (7, 7)], "u long, v long")
    got = {r["node"]: r["root"] for r in components.components(df).collect()}
    real = [(a, b) for a, b in links if a != b]
    assert got == roots({x for p in real for x in p}, real)
    assert components.components(df.limit(0)).count() == 0
    spread = df.repartition(7)  # forests of several tasks are joined by rounds
    chunks = list(components._forest(iter([])))
    assert chunks == [] and {r["node"]: r["root"] for r in components.components(spread).collect()} == got


def test_components_of_a_long_chain_over_many_parts(spark):
    df = spark.range(3000).select(F.col("id").alias("u"), (F.col("id") + 1).alias("v")).repartition(9)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = components.components(df).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(got) == 3001 and {r["root"] for r in got} == {0}


def test_keyed_orders_repeats_and_nulls(spark):
    df = docs(spark, [(2, "b"), (None, "x"), (1, "a"), (2, "b"), (None, None)])
    got = [(r["doc_id"], r["_key"]) for r in streams.keyed(df).orderBy("_key").collect()]
    assert got == [(1, 0), (2, 1), (2, 2), (None, 3), (None, 4)]
    assert {r["_key"] for r in streams.keyed(docs(spark, [(5, "a"), (9, "b")])).collect()} == {5, 9}


def test_numbered_counts_without_gaps(spark):
    df = docs(spark, [(i % 7, "x") for i in range(300)] + [(None, None)] * 200).repartition(6)
    got = streams.numbered(df.withColumns({"_tie": F.lit(1), "_at": F.lit(2)}), "n", F.col("doc_id").asc_nulls_last()).orderBy("n").collect()
    assert [r["n"] for r in got] == list(range(500)) and [r["doc_id"] for r in got] == sorted([i % 7 for i in range(300)]) + [None] * 200
    assert streams.numbered(df.limit(0), "n", "doc_id").count() == 0


def test_sharding(spark):
    rng = random.Random(2)
    rows = [(i, "w " * rng.randrange(1, 400)) for i in range(600)] + [(600 + i, "same text " * 30) for i in range(400)] + [(1000, None), (None, "x"), (None, ""), (1001, "é" * 5)]
    got = sharding.assign_shards(docs(spark, rows).withColumn("shard", F.lit("clash")), shards=8).collect()
    assert len(got) == len(rows)
    size, slots = collections.Counter(), collections.defaultdict(list)
    for r in got:
        size[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(v) == list(range(len(v))) for v in slots.values()) and len(slots) == 8
    assert sharding.spread(list(size.values())) < 0.02
    by = {r["doc_id"]: r for r in got if r["doc_id"] is not None}
    assert (by[1000]["size"], by[1000]["text_crc32"], by[1001]["size"]) == (1, 0, 11)
    assert sharding.assign_shards(docs(spark, [])).count() == 0


def test_sharding_of_repeated_rows_and_rows_without_ids(spark):
    rng = random.Random(12)
    same = "the same row " * 14
    rows = [(7, same)] * 800 + [(None, same)] * 800 + [(i, "w " * rng.randrange(1, 200)) for i in range(400)]
    got = sharding.assign_shards(docs(spark, rows).repartition(5)).collect()
    size = collections.Counter()
    for r in got:
        size[r["shard"]] += r["size"]
    assert len(got) == len(rows) and len(size) == 16 and sharding.spread(list(size.values())) < 0.02
    long = [(1, "x" * 400_000), (2, None), (2, None)] + [(i, "y") for i in range(3, 40)]
    assert sorted(r["doc_id"] for r in sharding.assign_shards(docs(spark, long), shards=3).collect()) == sorted(i for i, _ in long)


def plain_pack(items, shards):
    """The same rule one step at a time."""
    total = [sum(x[d] for x in items) for d in range(3)]
    unit = [[x[d] * shards / total[d] for d in range(3)] for x in items]
    room, out = [[1.0] * 3 for _ in range(shards)], {}
    for i in sorted(range(len(items)), key=lambda i: (-sum(unit[i]), i)):
        score = [sum(a * b for a, b in zip(room[k], unit[i])) for k in range(shards)]
        fits = [k for k in range(shards) if all(room[k][d] - unit[i][d] >= -1e-9 for d in range(3))]
        k = max(fits or range(shards), key=lambda k: (score[k], -k))
        out[i] = k
        room[k] = [a - b for a, b in zip(room[k], unit[i])]
    return [out[i] for i in range(len(items))]


def test_pack_against_plain_steps():
    rng = random.Random(13)
    for n, shards in ((1, 3), (40, 4), (300, 16)):
        items = [[rng.choice([1, 3, 50, 999]) * rng.random(), rng.random(), rng.choice([1, 2, 9])] for _ in range(n)]
        assert sharding.pack(np.array(items), shards).tolist() == plain_pack(items, shards)


def test_pack_prefers_room():
    items = np.array([[4.0, 1, 1], [1, 4, 1], [4, 1, 1], [1, 4, 1]])
    got = sharding.pack(items, 2)
    assert sorted(np.bincount(got).tolist()) == [2, 2] and got[0] != got[2]


def naive_fingerprint(text, k=3):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    sh = [" ".join(w[i : i + k]) for i in range(max(1, len(w) - k + 1))] if w else []
    h = [xxhash.xxh64_intdigest(s, 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash_against_brute_force(spark):
    rng = random.Random(3)
    words = [f"w{i}É" for i in range(200)]
    rows = []
    for i in range(300):
        w = [rng.choice(words) for _ in range(rng.choice([0, 1, 2, 5, 300]))]
        rows.append((i, " ".join(w)))
        if i % 5 == 0 and len(w) > 100:
            w[7] = "other"
            rows.append((1000 + i, "\t".join(w).upper() if i % 2 else " ".join(w)))
    rows += [(2000, None), (2001, "  "), (None, rows[5][1])]
    got = {r["doc_id"]: r for r in simhash.cluster(docs(spark, rows)).collect()}
    assert len(got) == len(rows)
    fp = {i: naive_fingerprint(t) for i, t in rows if i is not None}
    assert {i: int(got[i]["fingerprint"], 16) for i in fp} == fp
    ids = sorted(fp)
    links = [(a, b) for n, a in enumerate(ids) for b in ids[:n] if bin(fp[a] ^ fp[b]).count("1") <= 2]
    assert {i: got[i]["component_id"] for i in ids} == roots(ids, links)
    assert got[None]["component_id"] == got[5]["component_id"]
    assert simhash.cluster(docs(spark, [])).count() == 0


@pytest.mark.parametrize("radius", [2, 11])
def test_vantage_point_tree_meets_every_pair(spark, radius):
    rng = np.random.default_rng(4)
    fps = rng.integers(0, 2**63, 3000, dtype=np.uint64)
    fps[1000:2000] = fps[:1000] ^ (np.uint64(1) << rng.integers(0, 63, 1000, dtype=np.uint64))
    fps[2000:2500] = fps[0] ^ (np.uint64(1) << rng.integers(0, 63, 500, dtype=np.uint64)) ^ (np.uint64(1) << rng.integers(0, 63, 500, dtype=np.uint64))
    fps = np.unique(fps)
    ns = rng.integers(1, 50, len(fps))
    df = spark.createDataFrame([(i, int(f), int(n), 0) for i, (f, n) in enumerate(zip(fps.view(np.int64), ns))], "id long, fp long, n int, fp2 long")
    bands = 0.8 if radius > 2 else 0.0
    links = []
    for i in range(len(fps)):
        j = np.flatnonzero(np.bitwise_count(fps[i] ^ fps[:i]) <= radius)
        links += [(i, int(x)) for x in j if not bands or min(ns[i], ns[x]) >= bands * max(ns[i], ns[x]) - 1e-9]
    want = roots({x for p in links for x in p}, links)
    got = {r["node"]: r["root"] for r in components.components(simhash.linked(df, radius, leaf_rows=64, bands=bands)).collect()}
    assert got == want


def test_near_duplicates_keep_one_of_each_group(spark):
    rng = random.Random(5)
    vocabulary = [f"palabra{i}" for i in range(3000)]
    rows, copies = [], set()
    for i in range(80):
        w = [rng.choice(vocabulary) for _ in range(250)]
        rows.append((i, " ".join(w)))
        if i % 4 == 0:
            v = list(w)
            v[rng.randrange(250)] = "cambio"
            rows.append((1000 + i, " ".join(v)))
            rows.append((2000 + i, " ".join(w)))
            copies |= {1000 + i, 2000 + i}
        elif i % 4 == 1:  # too far: every tenth word differs
            rows.append((3000 + i, " ".join(x if j % 10 else "distinto" + x for j, x in enumerate(w))))
    rows += [(5000, None), (5001, None), (5002, "..."), (None, rows[0][1])]
    df = docs(spark, rows)
    out = simhash.near_duplicates(df)
    assert out.columns == df.columns
    got = [r["doc_id"] for r in out.collect()]
    assert sorted(got) == sorted({i for i, _ in rows if i is not None} - copies - {5001})
    assert simhash.near_duplicates(docs(spark, [])).count() == 0


def test_near_duplicates_are_verified_in_tiles(spark):
    rng = random.Random(6)
    base = [f"p{rng.randrange(5000)}" for _ in range(120)]
    rows = []
    for i in range(300):
        w = list(base)
        w[rng.randrange(120)] = f"x{i}"
        rows.append((i, " ".join(w)))
    assert [r["doc_id"] for r in simhash.near_duplicates(docs(spark, rows), tile=6000).collect()] == [0]


def _family(rng, words, near):
    """Texts on both sides of the threshold to the first, and to each other."""
    out = [words]
    for i in range(near):
        w = list(out[rng.randrange(len(out))] if i % 3 == 0 else words)
        for at in rng.sample(range(len(w)), rng.choice([1, 1, 1, 2, 3, 4])):
            w[at] = f"x{i}"
        out.append(w)
    return out


def test_texts_of_a_large_block_are_moved_once_or_so(spark, monkeypatch):
    rng, moved, stored = random.Random(8), [], simhash.stored

    def told(df, name):
        out = stored(df, name)
        if name == "spots":
            moved.append(out.count())
        return out

    monkeypatch.setattr(simhash, "stored", told)
    base = [f"p{rng.randrange(5000)}" for _ in range(120)]
    rows = [(i, " ".join(f"x{i}" if j == i % 120 else w for j, w in enumerate(base))) for i in range(600)]
    assert [r["doc_id"] for r in simhash.near_duplicates(docs(spark, rows), tile=6000).collect()] == [0]
    # 12 chunks or so: a text met all of them, 12 times 600 rows in all; now only a few texts do
    assert sum(moved) < 2 * 600


def test_cut_blocks_lose_no_link(spark):
    rng = random.Random(10)
    rows = []
    for _ in range(4):
        rows += [" ".join(w) for w in _family(rng, [f"p{rng.randrange(5000)}" for _ in range(80)], 60)]
    rows = list(enumerate(rows))
    sets = {i: {" ".join(w[j : j + 5]) for j in range(len(w) - 4)} for i, t in rows for w in [t.split()]}
    links = [(a, b) for a in sets for b in range(a) if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])]
    want = sorted(set(roots(sets, links).values()))
    for tile, pivots in ((1_000_000, 16), (400, 16), (400, 0)):
        simhash.PIVOTS = pivots
        try:
            assert sorted(r["doc_id"] for r in simhash.near_duplicates(docs(spark, rows), tile=tile).collect()) == want
        finally:
            simhash.PIVOTS = 16
    assert len(want) > 8


def test_rows_with_recurring_ids_hold_their_text_once(spark, monkeypatch):
    names = []
    monkeypatch.setattr(streams, "stored", lambda df, name: names.append(df.columns) or df)
    assert simhash.near_duplicates(docs(spark, [(1, "uno dos tres"), (1, "cuatro cinco seis"), (1, "uno dos tres")])).count() == 2
    assert names and all("text" not in c for c in names)


def test_near_duplicates_find_every_pair_of_the_threshold(spark):
    rng = random.Random(9)
    vocabulary = [f"palabra{i}" for i in range(3000)]
    say = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    common = say(12)
    rows = []
    for i in range(60):
        w, line = say(300), say(10)
        rows += [(10 * i, " ".join(w + line)), (10 * i + 1, " ".join(w + line * rng.randint(10, 100)))]  # one line often
        w = say(rng.choice([5, 7, 10, 20, 40, 200, 400])) + common * (i % 3)
        v = list(w)
        for at in rng.sample(range(len(v)), max(1, len(v) // 50)):  # edits that leave a similarity about the threshold
            v[at] = rng.choice(vocabulary)
        rows += [(10 * i + 2, " ".join(w)), (10 * i + 3, " ".join(v)), (10 * i + 4, " ".join(w + say(len(w) // 5))), (10 * i + 5, " ".join(w[: len(w) - len(w) // 6]))]
    sets = {i: {" ".join(w[j : j + 5]) for j in range(max(1, len(w) - 4))} for i, t in rows for w in [t.split()]}
    ids = sorted(sets)
    links = [(a, b) for n, a in enumerate(ids) for b in ids[:n] if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])]
    want = sorted({x for x in roots(ids, links).values()})
    df = docs(spark, rows)
    assert sorted(r["doc_id"] for r in simhash.near_duplicates(df).collect()) == want
    # without the fingerprints, with hot shingles dealt to several cells, every pair is still among those that share shingles
    texts = df.select(F.col("doc_id").alias("_key"), F.col("text").cast("binary").alias("text"), F.col("doc_id").alias("block"))
    got = {(r["u"], r["v"]) for r in simhash.sharing(texts, len(rows), 5, 0.8, chunk=8).collect()}
    assert set(links) <= got and len(got) < 3 * len(links)


def brute_repeats(rows, length):
    seen, out = set(), {}
    for i, t in sorted(rows, key=lambda x: (x[0] is None, x[0])):
        b = (t or "").encode()
        mark = np.zeros(len(b) + 2, bool)
        for s in range(len(b) - length + 1):
            if b[s : s + length] in seen:
                mark[s + 1 : s + 1 + length] = True
            seen.add(b[s : s + length])
        kept = bytes(np.frombuffer(b, np.uint8)[~mark[1:-1]]) if b else b""
        out[i] = (len(b), int(mark.sum()), int((mark[1:] & ~mark[:-1]).sum()), hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("piece", [1 << 20, 700])
def test_suffix_dedup_against_brute_force(spark, monkeypatch, piece):
    rng = random.Random(7)
    parts = ["".join(rng.choices("abcdefgé ñ", k=rng.randint(30, 500))) for _ in range(25)]
    rows = []
    for i in range(60):
        t = "".join(p[a : a + rng.randint(20, 400)] for p in rng.choices(parts, k=4) for a in [rng.randrange(len(p))])
        rows.append((i, "z" * rng.randint(90, 300) + t if i % 9 == 0 else t))
    rows += [(100, rows[3][1]), (101, rows[3][1]), (102, None), (103, ""), (104, "q" * 100), (105, "q" * 99), (None, rows[4][1])]
    if piece != 1 << 20:  # as if texts were longer than a block; tasks import the module anew, so the local function is tried
        monkeypatch.setattr(suffix, "PIECE", piece)
        found = list(suffix._pieces([0], [("ab" * 900).encode()], 100))
        assert all(len(x[2]) < piece for block in found for x in block) and sum(len(x[2]) - 99 for b in found for x in b) == 1701
        return
    got = suffix.remove_repeats(docs(spark, rows), texts=True).collect()
    assert {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got} == brute_repeats(rows, 100)
    assert all(hashlib.sha256(r["kept"]).hexdigest() == r["kept_sha256"] for r in got)
    assert suffix.remove_repeats(docs(spark, [])).count() == 0


def test_suffix_dedup_splits_large_buckets(spark):
    rng = random.Random(17)
    common = "".join(rng.choices("abcdefgh ", k=130))
    short = "".join(rng.choices("abcdefgh ", k=70))
    filler = lambda n: "".join(rng.choices("stuvwxyz ", k=n))
    rows = [(i, filler(rng.randint(0, 60)) + (common if i % 3 else short) + filler(rng.randint(0, 90))) for i in range(400)] + [(900, common * 3), (901, None), (None, common)]
    want = brute_repeats(rows, 100)
    for settings in ({}, {"share": 0.001, "most_regions": 3}):
        got = suffix.remove_repeats(docs(spark, rows), **settings).collect()
        assert {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got} == want


def test_embeddings_against_brute_force(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(1500, 16))
    x[400:700] = x[:300] + 0.12 * rng.normal(size=(300, 16))
    x[700:900] = x[0] + 0.25 * rng.normal(size=(200, 16))
    x[900:920] = x[1] * 3
    label = rng.integers(0, 3, 1500)
    rows = [(i, [float(a) for a in v], int(k)) for i, (v, k) in enumerate(zip(x, label))]
    odd = [(2000, None, 0), (2001, [0.0] * 16, 0), (2002, [float("nan")] * 16, 0), (2003, [float("inf")] * 16, 1), (2004, [float(a) for a in x[5]], None), (2005, [1.0, None] * 8, 0), (None, [1.0] * 16, 1), (2006, [1.0, 2.0], 1), (2007, [], 1)]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>, label int").withColumn("v", F.lit(1))
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    near = (unit @ unit.T >= 0.93) & (label[:, None] == label[None, :])
    np.fill_diagonal(near, False)
    for shard_rows in (8192, 90):
        out = embed.cluster(df, 0.93, shard_rows).collect()
        got = {r["vec_id"]: r for r in out}
        assert len(out) == len(rows) + len(odd)
        found = sum(got[i]["n_links"] for i in range(1500))
        assert 0.97 * near.sum() <= found <= near.sum()
        want = roots(range(1500), [(int(a), int(b)) for a, b in zip(*np.nonzero(near))])
        same = sum(got[i]["component_id"] == want[i] for i in range(1500))
        assert same >= 1450
        assert all(got[i]["kept"] == (got[i]["component_id"] == i) for i in range(1500))
        assert all(got[i]["n_links"] == 0 and got[i]["component_id"] == i for i in range(2000, 2008))
    assert embed.cluster(df.limit(0)).count() == 0


def test_embeddings_that_share_an_id_are_vectors_of_their_own(spark):
    rows = [(1, [1.0, 0.0], 0), (1, [0.0, 1.0], 0), (2, [1.0, 0.01], 0), (3, [0.01, 1.0], 0), (4, [1.0, 0.0], 1), (4, [1.0, 0.0], 0), (5, [-0.0, 1.0], 0)]
    got = sorted(tuple(r) for r in embed.cluster(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect())
    # (1,0) of label 0 stands twice, with ids 1 and 4; (0,1) with ids 1 and 5
    assert got == [(1, 2, 1, True), (1, 2, 1, True), (2, 2, 1, False), (3, 2, 1, False), (4, 0, 4, True), (4, 2, 1, False), (5, 2, 1, False)]


def test_small_world_answers_and_is_audited():
    rng = np.random.default_rng(14)
    x = rng.normal(size=(1500, 24))
    x[700:1000] = x[:300] + 0.1 * rng.normal(size=(300, 24))
    x[1000:1200] = x[3] + 0.15 * rng.normal(size=(200, 24))  # more partners than a beam is wide
    x = embed._unit(x)
    for n in (33, 200, 1500):
        links = list(embed.SmallWorld.build(x[:n]).links())
        graph = embed.SmallWorld.from_links(x[:n], np.concatenate(links), np.array([len(a) for a in links]))
        index = embed.Index(x[:n], graph, 0.93)
        assert index.audit(x[:n], True) >= 0.98
        found = {(int(a), int(b)) for r, c in index.partners(x[:n]) for a, b in zip(r, c)}
        near = {(int(a), int(b)) for a, b in zip(*np.nonzero(x[:n] @ x[:n].T >= 0.93))}
        assert found <= near and len(found) >= 0.98 * len(near) and index.searches >= n  # every vector asked the graph
        foreign = embed.Index(x[:n], graph, 0.93)
        assert foreign.audit(x[700:1000], False) >= 0.98


def test_cells_of_a_label_stay_small(spark, monkeypatch):
    """No group that a task gathers holds more than two shards, however many shards a label has."""
    rng = np.random.default_rng(15)
    x = rng.normal(size=(900, 8))
    df = spark.createDataFrame([(i, [float(a) for a in v], 0) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int")
    sizes = []
    made = embed.stored
    monkeypatch.setattr(embed, "stored", lambda d, name: (sizes.append(d), made(d, name))[1])
    embed.cluster(df, 0.93, shard_rows=60)
    graphs = made(next(d for d in sizes if "links" in d.columns and "pos" in d.columns), "again")
    per = [r["n"] for r in graphs.groupBy("shard").agg(F.count(F.lit(1)).alias("n")).collect()]
    assert len(per) == 15 and sum(per) == 900 and max(per) < 120
