"""Source divergence, the log-bilinear model and the prefix trie against plain versions, and their edge cases."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from estrado.llm import bilinear, divergence, prefixes

DOCS = "doc_id long, text string, lang string, source string"


def plain_audit(rows, least, best):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    n, docs, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for _, text, lang, source in rows:
        words = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(low))
        groups[lang or ""].add(source or "")
        n[lang or "", source or ""].update(words)
        docs[lang or ""].update(set(words))
    out = []
    for lang, sources in groups.items():
        kept = [t for t, c in docs[lang].items() if c >= least]
        total = sum((n[lang, s] for s in sources), Counter())

        def rate(c, kept=kept):
            size = sum(c[t] for t in kept)
            return {t: 1 + 10**9 * (c[t] + 2) // (size + 2 * len(kept)) for t in kept}

        p, q = {s: rate(n[lang, s]) for s in sources}, rate(total)
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in sources:
            pairs = [(o, sum(f(p[s][t], p[o][t]) for t in kept)) for o in sources if o != s]
            terms = [(t, f(p[s][t], q[t])) for t in kept if n[lang, s][t] and p[s][t] > q[t]]
            for part, found in (("pair", pairs), ("term", terms)):
                ranked = sorted(found, key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, i, v, r) for r, (i, v) in enumerate(ranked, 1) if part == "pair" or r <= best]
    return sorted(out)


def corpus(n=120, sources=7):
    rng = np.random.default_rng(3)
    words = ["the", "La", "ñandú", "Éa", "x1y", "zebra", "été", "日本", "a_b", "tie", "eit"] + [f"w{chr(97 + i)}" for i in range(15)]
    rows = []
    for i in range(n):
        text = " ".join(rng.choice(words, rng.integers(1, 30), p=np.arange(len(words), 0, -1) / sum(range(len(words) + 1))))
        rows.append((i, text, ["en", "es", None][i % 3], None if i % 11 == 0 else f"s{i % sources}"))
    return [*rows, rows[5], rows[5], (None, None, "en", "nothing"), (900, "", "de", "a"), (901, "!! 12", "de", "b"), (902, "only", "one", "s")]


@pytest.mark.parametrize("width,tile", [(64, 1 << 20), (2, 8)])
def test_divergence_equals_the_plain_version(spark, monkeypatch, width, tile):
    monkeypatch.setattr(divergence, "WIDTH", width)
    monkeypatch.setattr(divergence, "TILE", tile)
    rows = corpus()
    df = spark.createDataFrame(rows, DOCS).repartition(3).withColumn("term", F.lit("x")).withColumn("value", F.lit(1)).withColumn("size", F.lit(2))
    got = sorted(tuple(r[c] for c in ("lang", "source", "part", "item", "value", "rank")) for r in divergence.audit(df, least_docs=4, best=3).collect())
    assert got == plain_audit(rows, 4, 3)


def test_divergence_of_nothing_and_of_long_texts(spark, monkeypatch):
    assert divergence.audit(spark.createDataFrame([], DOCS)).count() == 0
    text = ("Word " * 20 + "ñ" * 40 + " end,") * 30
    whole = Counter(w for part in divergence.terms_of(text.encode()) for w in part)
    monkeypatch.setattr(divergence, "PIECE", 7)
    assert Counter(w for part in divergence.terms_of(text.encode()) for w in part) == whole == Counter({b"word": 600, "ñ".encode() * 40: 30, b"end": 30})


def test_rates_are_exact():
    c, n = [0, 1, 12345, 3 * 10**15], 8 * 10**15
    assert divergence.rates(np.array(c), n, 5).tolist() == [1 + 10**9 * (x + 2) // (n + 10) for x in c]


def prose(n=400):
    rng = np.random.default_rng(1)
    chains = [["the", "cat", "sat", "on", "mats."], ["Un", "gato", "come pan", "y", "duerme"], ["x", "|", "y", "|", "z"]]
    rows = [(i, " ".join(w if rng.random() > 0.1 else f"rare{rng.integers(500)}" for w in chains[i % 3] * int(rng.integers(1, 9)))) for i in range(n)]
    return [*rows, (1000, None), (1001, ""), (1002, " \n\t "), (None, "the cat"), (5, rows[5][1]), (5, rows[5][1]), (1003, "unheard-of words é")]


def is_held(i):
    return i is not None and zlib.crc32(str(i).encode()) % 5 == 1


@pytest.mark.parametrize("head", [1 << 18, 40])
def test_base_scores_and_counts_equal_the_plain_version(spark, monkeypatch, head):
    monkeypatch.setattr(bilinear, "PIECE", 50)
    rows = prose()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3).withColumns({"word": F.lit(1), "_key": F.lit(2), "c": F.lit(3)})
    got = bilinear.score(df, words=30, head=head).collect()
    split = lambda t: re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) + [None]
    c = Counter(w for i, t in rows if not is_held(i) for w in split(t))
    n, v = sum(c.values()), len(c)
    told = lambda i, t: (-1 if i is None else i, is_held(i), len(split(t)), sum(c[w] > 0 for w in split(t)), n, round(sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in split(t)), 6))
    assert sorted((-1 if r["doc_id"] is None else r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in got) == sorted(told(*x) for x in rows)
    held = [r for r in got if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held) + 0.2 * sum(r["n_tokens"] for r in held)
    assert all(r["score"] < 0 for r in got)


def test_probabilities_add_up_to_one(spark):
    docs = spark.createDataFrame([(t,) for _, t in prose()], "text string").na.fill("")
    v = bilinear.vocabulary(bilinear.counts(docs), most=30)
    model = bilinear.train(docs, v, rounds=2)
    table = bilinear.normalisers(spark, model, step=100)
    s = bilinear.Scorer(model, table, v)
    for a, e in ((0, 1), (5, s.numbers.before), (s.numbers.before, s.numbers.before), (s.numbers.end, 3)):
        p = np.exp(np.array([s.tokens(np.array([e, a, w], np.int32))[0] for w in range(v.size)], float))
        assert abs(p.sum() - 1) < 1e-4
    # a class's words, and one that was never seen, share the class
    for k in np.flatnonzero(v.class_words):
        c = [n for w, n in zip(v.names[v.words :], v.count[v.words :], strict=True) if w[-1] == k]
        assert len(c) == v.class_words[k] and abs(sum(10 ** v.own(np.array([*c, 0]), np.full(len(c) + 1, k))) - 1) < 1e-9


def test_a_step_equals_the_plain_one_and_computes_noise_once(monkeypatch):
    rng = np.random.default_rng(1)
    frequencies = np.array([500.0, 300, 100, 40, 30, 20, 5, 3, 1, 1])
    model = bilinear.Model.start(frequencies)
    ids, before = rng.integers(0, 10, bilinear.BATCH + 2).astype(np.int32), 10
    ids[:2] = before
    m = bilinear.Model(*(x.astype(float) for x in (model.context, model.target, model.bias, model.near, model.far)))
    share, draws = frequencies / frequencies.sum(), np.random.default_rng(7).random(bilinear.NOISE)
    noise = np.searchsorted(np.cumsum(share), draws)  # all draws, with repeats
    w, a, e = ids[2:], ids[1:-1], ids[:-2]
    h = m.context[a] * m.near + m.context[e] * m.far
    odds = lambda x, k: x + m.bias[k] - np.log(bilinear.NOISE * share[k])
    g, gn = 1 / (1 + np.exp(odds((h * m.target[w]).sum(axis=1), w))), -1 / (1 + np.exp(-odds(h @ m.target[noise].T, noise)))
    back = g[:, None] * m.target[w] + gn @ m.target[noise]
    grads = [np.zeros_like(x) for x in (m.context, m.target, m.bias)]
    for grad, rows, by in ((0, a, back * m.near), (0, e, back * m.far), (1, w, g[:, None] * h), (1, noise, gn.T @ h), (2, w, g), (2, noise, gn.sum(axis=0))):
        np.add.at(grads[grad], rows, by)
    rate = lambda x: bilinear.RATE / np.sqrt((x**2).mean(axis=1, keepdims=True) if x.ndim > 1 else x**2, where=x.any(axis=-1, keepdims=x.ndim > 1) if x.ndim > 1 else x != 0, out=np.ones((len(x), 1) if x.ndim > 1 else len(x)))
    t, asked, exp = bilinear.Trainer(model, frequencies, 7), [], np.exp
    monkeypatch.setattr(np, "exp", lambda x, *args, **kw: asked.append(np.size(x)) or exp(x, *args, **kw))
    t.steps(ids, before)
    monkeypatch.undo()
    for got, was, grad in zip((t.m.context, t.m.target, t.m.bias), (m.context, m.target, m.bias), grads, strict=True):
        assert np.abs(got - (was + rate(grad) * grad)).max() < 1e-3
    assert sum(asked) <= bilinear.BATCH * (1 + len(frequencies))  # not 1 + NOISE a token


def test_texts_are_scored_many_at_once_and_learned_from_by_the_own_words(monkeypatch):
    texts = [(t or "").encode() for _, t in prose()] + [b"", b" \n", b"one", b"Los " * 60]
    count = Counter(w for t in texts[:60] for words in bilinear.words_of(t) for w in words)
    names = sorted(count, key=lambda w: (-count[w], w))
    classes = np.array([[sum(w[-1] == k for w in names[12:]), sum(count[w] for w in names[12:] if w[-1] == k)] for k in range(bilinear.CLASSES)])
    held = names[:20]
    v = bilinear.Vocabulary(held, np.array([count[w] for w in held]), 12, 1, count.total() + 60, len(names) + 1, 60, classes[:, 1], classes[:, 0])
    own, every = bilinear.Numbers(v, v.words), bilinear.Numbers(v)
    words = [w for t in texts for x in bilinear.words_of(t) for w in x]
    assert len(own.rank) == 14 and own.of(words, own.ranks(words)).tolist() == every.of(words, every.ranks(words)).tolist()
    model = bilinear.Model.start(v.frequencies())
    s = bilinear.Scorer(model, model.normalisers(slice(0, len(model.context))), v)
    calls, after = [], s.after
    s.after = lambda *ids: calls.append(len(ids[0])) or after(*ids)
    whole, rare = s.texts(texts)
    assert len(calls) == 1 and sum(calls) == sum(x[0] for x in whole)  # one flow, not a call or two for each text
    monkeypatch.setattr(bilinear, "SCORED", 7)
    pieces, again = s.texts(texts)
    assert len(calls) > 20 and rare == again and np.allclose(np.array(whole, float), np.array(pieces, float), rtol=0, atol=1e-9)
    for t, x, r in zip(texts, whole, rare, strict=True):
        words = t.translate(bilinear.LOWER).split()
        ids = np.concatenate([[every.before] * 2, every.of(words, every.ranks(words)), [every.end]]).astype(np.int32)
        c = [v.count[held.index(w)] if w in held else 0.5 for w in words]
        shares = sum(float(v.own(np.array(n), w[-1])) for w, n in zip(words, c, strict=True) if w not in held[:12])
        assert x[:2] == [len(words) + 1, sum(w in held for w in words) + 1] and r == Counter(w for w in words if w not in held)
        assert abs(x[2] - sum(float(v.base(np.array(n))) for n in [*c, 60])) < 1e-9
        assert abs(x[3] - shares - s.tokens(ids).astype(float).sum() / bilinear.LN10) < 1e-9


def test_scores_without_training_rows(spark):
    df = spark.createDataFrame([(i, "a b") for i in range(40)], "doc_id long, text string").where(bilinear.held_out())
    got = bilinear.score(df).collect()
    assert got and {(r["n_known"], r["train_tokens"], r["base_score"]) for r in got} == {(0, 0, 0.0)} and all(math.isfinite(r["score"]) for r in got)
    assert bilinear.score(df.limit(0)).count() == 0


def plain_trie(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(t, key=lambda x: x[:3])] for c, t in own.items()}
    convs = {}
    for c, t in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        convs[c] = tuple(own.get(c - int(math.fmod(c, 100)), [])[:h] + t[h:])
    members = defaultdict(list)
    for c, t in convs.items():
        for d in range(len(t) + 1):
            members[t[:d]].append(c)
    out = []
    for node, held in members.items():
        below = [x for x in members if x[: len(node)] == node]
        ends = ",".join(map(str, sorted(c for c in held if convs[c] == node)))
        out.append((
            min(held), len(node), min(members[node[:-1]]) if node else None, len(held), sum(len(x) == len(node) + 1 for x in below),
            sum(not any(len(y) == len(x) + 1 and y[:-1] == x for y in members) for x in below), sum((len(members[x]) - 1) * len(x[-1][1]) for x in below if x), hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


TURNS = "conv_id long, turn long, role string, text string"
NODE = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def talks():
    rng, rows = np.random.default_rng(5), []
    for c in range(0, 330):
        same = c % 3 == 0  # a third are copies
        for t in range(4 if same else int(rng.integers(1, 7))):
            rows.append((c, t, "user" if t % 2 == 0 else "assistant", f"hé{t}" if same else f"t{rng.integers(3)}" * int(rng.integers(1, 3))))
    rows += [(1000, None, None, None), (1000, 0, "", ""), (1001, 5, "user", "late"), (1001, None, "x", "early"), (None, 0, "user", "lost"), (-150, 0, "user", "hé0"), (-100, 0, "user", "minus")]
    return rows + [(2005, t, "r", f"long {t}") for t in range(300)] + [(2007, t, "r", f"long {t}") for t in range(300)]


@pytest.mark.parametrize("parts", [1, 9, 40])
def test_trie_equals_the_plain_version(spark, monkeypatch, parts):
    rows = talks()
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    monkeypatch.setattr(prefixes, "PIECE", 3)
    try:
        df = spark.createDataFrame(rows, TURNS).withColumns({"path": F.lit(1), "node": F.lit(2), "x": F.lit(3)}).repartition(5)
        got = sorted((tuple(r[c] for c in NODE) for r in prefixes.trie(prefixes.rebuilt(prefixes.turns(df))).collect()), key=str)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert got == plain_trie(rows)


def test_trie_of_nothing_of_turnless_and_of_repeated_rows(spark):
    assert prefixes.trie(prefixes.rebuilt(prefixes.turns(spark.createDataFrame([], TURNS)))).count() == 0
    lost = next(c for c in range(101, 200) if zlib.crc32(str(c).encode()) % 6 > 0)  # its first turns come from a conversation that isn't there
    for rows in ([(lost, 0, "a", "b")], [(200, 0, "a", "b"), (200, 0, "a", "b"), (200, 1, "a", "c")]):
        got = sorted((tuple(r[c] for c in NODE) for r in prefixes.trie(prefixes.rebuilt(prefixes.turns(spark.createDataFrame(rows, TURNS)))).collect()), key=str)
        assert got == plain_trie(rows)
