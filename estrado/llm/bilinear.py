"""Language-model scoring by a log-bilinear neural model trained with noise-contrastive estimation.

The score of a token is t . (c1*r(w1) + c2*r(w2)) + b over the two tokens before it. Parts of the corpus train copies of the model with NumPy, round by
round, and the copies are averaged row by row, weighted by how often a part has seen the row. As the score is a sum over the
two places, normalisers of all pairs of contexts are products of two matrices of exponentials; they are computed once, in
blocks of contexts, and every token's probability is normalised.

The model's vocabulary is bounded: the most frequent words, a class for each last byte of the other words, and the end of a text.
A word of a class has the class's probability times its own share of it, by its count in all training texts.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import cached_property
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import stored
from .streams import fresh, keyed

LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
#: The end of a text stands as an empty word, which no text holds.
END = ""
#: Words of the model, words whose counts the tasks hold (others are joined), size of a vector, noise words of a batch, tokens of a batch, rounds.
WORDS, HEAD, SIZE, NOISE, BATCH, ROUNDS = 3839, 1 << 18, 32, 128, 512, 3
CLASSES = 256
#: Distinct words that a task counts at once, bytes of a text that are cut up at once, tokens that are learned from at once, and scored at once.
HELD, PIECE, FLOW, SCORED = 500_000, 1 << 22, 1 << 17, 1 << 14
RATE, SEED = 0.1, 42
LN10 = float(np.log(10))


def words_of(text: bytes) -> Iterator[list[bytes]]:
    """Lists of a text's words, lower-cased A-Z, in order. A text of more than PIECE bytes is cut at white space."""
    at = 0
    while at < len(text):
        end = at + PIECE
        while end < len(text) and text[end : end + 1].strip():
            end += 1
        yield text[at:end].translate(LOWER).split()
        at = end


def held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(5)) == 1, F.lit(False))


def counts(docs: DataFrame) -> DataFrame:
    """docs (text) -> word, c: of all texts, the end of each counted as a word. Stored."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        for b in batches:
            for t in b.column(0):
                for words in words_of(t.as_py() or b""):
                    held.update(words)
            held[b""] += b.num_rows
            if len(held) > HELD:
                yield rows(held)
                held = Counter()
        if held:
            yield rows(held)

    def rows(held: Counter) -> pa.RecordBatch:
        return pa.record_batch([pa.array(list(held), pa.binary()).cast(pa.string()), pa.array(list(held.values()), pa.int64())], names=["word", "c"])

    found = docs.select(F.col("text").cast("binary").alias("text")).mapInArrow(count, "word string, c long")
    return stored(found.groupBy("word").agg(F.sum("c").alias("c")).where("c > 0"), "words")


@dataclass
class Vocabulary:
    """Words by falling count with their counts, and what the classes hold. A word's rank is its number if it is below ``words``; the classes and the end follow."""

    names: list[bytes]
    count: np.ndarray
    words: int
    least: int
    tokens: int
    distinct: int
    ends: int
    class_count: np.ndarray
    class_words: np.ndarray

    @property
    def size(self) -> int:
        return self.words + CLASSES + 1

    @cached_property
    def numbers(self) -> Numbers:
        """Of all held words; made once by a worker, for all of its tasks."""
        return Numbers(self)

    def frequencies(self) -> np.ndarray:
        return np.concatenate([self.count[: self.words], self.class_count, [self.ends]]).astype(float) + 0.5

    def base(self, c: np.ndarray) -> np.ndarray:
        return np.log10((c + 0.5) / (self.tokens + 0.5 * (self.distinct + 1)))

    def own(self, c: np.ndarray, k: np.ndarray) -> np.ndarray:
        """log10 of a word's share of its class; one that was never seen counts as one more word of it."""
        return np.log10((c + 0.5) / (self.class_count[k] + 0.5 * (self.class_words[k] + 1)))


def vocabulary(words: DataFrame, most: int = WORDS, head: int = HEAD) -> Vocabulary:
    """words (word, c) -> all words from the least count on that at most ``head`` words reach; the ``most`` first of them are the model's own. Ties go by the word."""
    word = F.col("word") != END
    tokens, distinct, ends = words.agg(F.sum("c"), F.count(F.lit(1)), F.max(F.when(~word, F.col("c")))).first()
    least = reached = 0
    levels = words.where(word).groupBy("c").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("c")).limit(head + 1).toArrow()
    for c, n in zip(levels.column("c").to_pylist(), levels.column("n").to_pylist(), strict=True):
        if reached + n > head:
            break
        least, reached = c, reached + n
    held = words.where(word & (F.col("c") >= least)).toArrow() if reached else levels.slice(0, 0).rename_columns(["word", "c"])
    held = sorted(((str(w).encode(), c) for w, c in zip(held.column("word").to_pylist(), held.column("c").to_pylist(), strict=True)), key=lambda x: (-x[1], x[0]))
    class_count, class_words = np.zeros(CLASSES, np.int64), np.zeros(CLASSES, np.int64)
    last = F.conv(F.right(F.hex(F.col("word").cast("binary")), F.lit(2)), 16, 10).cast("int")
    for k, n, c in words.where(word).groupBy(last).agg(F.count(F.lit(1)), F.sum("c")).collect():  # a row per last byte
        class_words[k], class_count[k] = n, c
    own = min(most, len(held))
    for w, c in held[:own]:
        class_words[w[-1]] -= 1
        class_count[w[-1]] -= c
    return Vocabulary([w for w, _ in held], np.array([c for _, c in held], np.int64), own, least, tokens or 0, distinct, ends or 0, class_count, class_words)


@dataclass
class Model:
    """near and far: weights of the vectors of the token before and of the one before it. context has a last row more, for what stands before a text."""

    context: np.ndarray
    target: np.ndarray
    bias: np.ndarray
    near: np.ndarray
    far: np.ndarray

    @staticmethod
    def start(frequencies: np.ndarray, size: int = SIZE, seed: int = SEED) -> Model:
        """Small random vectors, and biases that make it the distribution of single tokens."""
        rng, n = np.random.default_rng(seed), len(frequencies)
        draw = lambda rows: rng.normal(0, 0.1, (rows, size)).astype(np.float32)
        return Model(draw(n + 1), draw(n), np.log(frequencies / frequencies.sum()).astype(np.float32), np.ones(size, np.float32), np.full(size, 0.5, np.float32))

    def normalisers(self, rows: slice) -> np.ndarray:
        """log of the sum over all tokens, for contexts whose nearer token is in ``rows`` and every farther one: a product of two matrices of exponentials."""
        a, b = (self.context[rows] * self.near) @ self.target.T, (self.context * self.far) @ self.target.T + self.bias
        x, y = a.max(axis=1, keepdims=True), b.max(axis=1, keepdims=True)
        total = np.exp(a - x) @ np.exp(b - y).T
        return np.log(np.maximum(total, 1e-37)) + x + y.T


def _add(rows: np.ndarray, *parts: tuple[np.ndarray, np.ndarray, np.ndarray]) -> None:
    """Adagrad with a rate for each row: gradients of rows that may repeat are summed first. parts: gradients, what they change, and their squares so far."""
    order = np.argsort(rows.astype(np.uint16) if len(parts[0][1]) <= 1 << 16 else rows, kind="stable")  # numbers of two bytes are sorted by radix
    rows = rows.take(order)
    first = np.flatnonzero(np.concatenate([[True], rows[1:] != rows[:-1]]))
    rows = rows.take(first)
    for by, held, seen in parts:
        by = by.take(order, axis=0)
        # two floats are added as one complex number, which halves the calls of the sum
        total = np.add.reduceat(by.view(np.complex64) if by.ndim > 1 and by.shape[1] % 2 == 0 else by, first, axis=0).view(np.float32)
        square = np.einsum("nd,nd->n", total, total) / total.shape[1] if total.ndim > 1 else total**2
        square += seen.take(rows)
        seen[rows] = square
        rate = RATE / np.sqrt(square + 1e-8)
        total *= rate[:, None] if total.ndim > 1 else rate
        total += held.take(rows, axis=0)
        held[rows] = total


class Trainer:
    """Noise-contrastive estimation over a stream of tokens: one step for BATCH tokens, with NOISE words drawn for all of them.

    A word that is drawn more than once is computed once and counts as often as it was drawn.
    """

    def __init__(self, model: Model, frequencies: np.ndarray, seed: int):
        self.m = Model(*(x.copy() for x in (model.context, model.target, model.bias, model.near, model.far)))
        self.rng, share = np.random.default_rng(seed), frequencies / frequencies.sum()
        self.cut, self.offset = np.cumsum(share), np.log(NOISE * share).astype(np.float32)
        self.seen = [np.zeros(len(x), np.float32) for x in (self.m.context, self.m.target, self.m.bias)]
        self.places = np.zeros((2, 2), np.float32)
        self.used = [np.zeros(len(x), np.float32) for x in (self.m.context, self.m.target)]

    def steps(self, ids: np.ndarray, before: int) -> None:
        """Learns from a stream of ids: all but the first two, and but for those that stand before a text, are tokens."""
        ids = ids.astype(np.intp)  # as NumPy takes rows
        at = np.flatnonzero(ids[2:] != before) + 2
        drawn = np.searchsorted(self.cut, np.sort(self.rng.random((-(-len(at) // BATCH), NOISE)), axis=1))
        np.minimum(drawn, len(self.cut) - 1, out=drawn)
        with np.errstate(over="ignore"):  # an infinite odd is a probability of 0
            for lo, noise in zip(range(0, len(at), BATCH), drawn, strict=True):
                i = at[lo : lo + BATCH]
                self.step(ids[i], ids[i - 1], ids[i - 2], noise)
        for used, i in ((self.used[0], at - 1), (self.used[0], at - 2), (self.used[1], at)):
            used += np.bincount(ids[i], minlength=len(used))

    def step(self, w: np.ndarray, a: np.ndarray, e: np.ndarray, drawn: np.ndarray) -> None:
        """w: tokens, a: those before, e: those before these, drawn: noise words, sorted."""
        m = self.m
        near, far = m.context.take(a, axis=0), m.context.take(e, axis=0)
        h = near * m.near
        h += far * m.far
        first = np.flatnonzero(np.concatenate([[True], drawn[1:] != drawn[:-1], [True]]))
        times, noise = (first[1:] - first[:-1]).astype(np.float32), drawn.take(first[:-1])
        own, other = m.target.take(w, axis=0), m.target.take(noise, axis=0)
        good = np.einsum("nd,nd->n", h, own)
        good += m.bias.take(w) - self.offset.take(w)
        g, gn = 1 / (1 + np.exp(good)), h @ -other.T
        gn += self.offset.take(noise) - m.bias.take(noise)
        np.exp(gn, out=gn)
        gn += 1
        np.divide(-1, gn, out=gn)
        back = gn @ (times[:, None] * other)
        back += g[:, None] * own
        near_by, far_by = np.einsum("nd,nd->d", back, near), np.einsum("nd,nd->d", back, far)
        by_noise = times[:, None] * (gn.T @ h), times * (np.ones(len(w), np.float32) @ gn)
        _add(np.concatenate([w, noise]), (np.concatenate([g[:, None] * h, by_noise[0]]), m.target, self.seen[1]), (np.concatenate([g, by_noise[1]]), m.bias, self.seen[2]))
        _add(np.concatenate([a, e]), (np.concatenate([back * m.near, back * m.far]), m.context, self.seen[0]))
        for place, by, i in ((m.near, near_by, 0), (m.far, far_by, 1)):
            self.places[i, 0] += (by**2).mean()
            place += 0.3 * RATE * by / np.sqrt(self.places[i, 0] + 1e-8)


#: Marks in a stream of words, which no word can be: the end of a text, and what stands before one, twice.
AFTER, BEFORE = END.encode(), b" "


class Numbers:
    """Words of texts as the model's numbers, by the ranks of all held words or, to learn from, of the model's own ones: a table of these stays in a core's cache."""

    def __init__(self, v: Vocabulary, most: int | None = None):
        self.first_class, self.end, self.before = v.words, v.words + CLASSES, v.words + CLASSES + 1
        names = v.names[:most]
        self.rank = {w: i for i, w in enumerate([*names, AFTER, BEFORE])}
        self.number = np.array([*(i if i < v.words else v.words + w[-1] for i, w in enumerate(names)), self.end, self.before], np.int32)

    def ranks(self, words: list[bytes]) -> np.ndarray:
        """The rank of each word, -1 for those that aren't held. The marks have the two ranks after all words."""
        return np.fromiter(map(self.rank.get, words, repeat(-1)), np.int32, len(words))

    def of(self, words: list[bytes], ranks: np.ndarray) -> np.ndarray:
        ids = self.number[ranks]
        lost = np.flatnonzero(ranks < 0)
        if len(lost):
            ids[lost] = [self.first_class + words[i][-1] for i in lost.tolist()]
        return ids


#: Rows of the model that are averaged by one row of a table.
ROWS = 64


def train(docs: DataFrame, v: Vocabulary, words: Broadcast | None = None, rounds: int = ROUNDS, size: int = SIZE) -> Model:
    """docs (text) -> a model. Every text is learned from once: each round takes a share of the texts by their hash, and every task its part of them.

    A task sends its copy of the rows that it has seen, weighted by how often; copies are added up by blocks of rows, as a stream, and
    the driver gets the averages.
    """
    spark, share = docs.sparkSession, v.frequencies()
    model = Model.start(share, size)
    words = words or spark.sparkContext.broadcast(v)
    for r in range(rounds):
        sent = spark.sparkContext.broadcast(model)
        part = docs.where(F.pmod(F.xxhash64("text"), F.lit(rounds)) == r).select(F.col("text").cast("binary").alias("text"))
        moved = part.mapInArrow(_learn(sent, words, r), "block int, rows binary").repartition("block").sortWithinPartitions("block").mapInArrow(_averages, "block int, rows binary")
        for block, rows in ((x["block"], x["rows"]) for x in moved.collect()):  # the model
            sums = np.frombuffer(rows, np.float64).reshape(-1, 2 * size + 3)
            if block < 0:
                model.near, model.far = (x.astype(np.float32) for x in np.split(sums[0, : 2 * size] / sums[0, -1], 2))
                continue
            at = slice(block * ROWS, block * ROWS + len(sums))
            for name, cols, weight in (("context", slice(0, size), -2), ("target", slice(size, 2 * size), -1), ("bias", slice(2 * size, 2 * size + 1), -1)):
                held, w = getattr(model, name), sums[:, weight]
                new = sums[: len(held[at]), cols] / np.maximum(w, 1e-9)[: len(held[at]), None]
                seen = w[: len(held[at])] > 0
                held[at][seen] = (new if held.ndim > 1 else new[:, 0])[seen].astype(np.float32)
    return model


def _learn(sent: Broadcast, words: Broadcast, r: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = words.value
        numbers, t, flow, waiting = Numbers(v, v.words), None, [], 0

        for b in batches:
            for text in b.column(0):
                data = text.as_py() or b""
                t = t or Trainer(sent.value, v.frequencies(), SEED + r)
                flow += (BEFORE, BEFORE)
                for part in words_of(data):
                    flow += part
                    waiting += len(part)
                    if waiting >= FLOW:
                        t.steps(numbers.of(flow, numbers.ranks(flow)), numbers.before)
                        flow, waiting = flow[-2:], 0  # what the text goes on from
                flow.append(AFTER)
                waiting += 1
        if t:
            t.steps(numbers.of(flow, numbers.ranks(flow)), numbers.before)
            yield from _sums(t)

    return run


def _sums(t: Trainer) -> Iterator[pa.RecordBatch]:
    """A task's copy of the model by blocks of rows, each row times how often it was seen, and those numbers; block -1 has the weights of the places."""
    m, (context, target) = t.m, t.used
    target = np.append(target, np.float32(0))  # the context has a row more
    rows = np.concatenate([m.context * context[:, None], np.pad(m.target, ((0, 1), (0, 0))) * target[:, None], (np.append(m.bias, 0) * target)[:, None], context[:, None], target[:, None]], axis=1).astype(np.float32)
    weight = target.sum()
    blocks, data = [-1], [np.concatenate([m.near * weight, m.far * weight, [0, 0, weight]]).astype(np.float32).tobytes()]
    for lo in range(0, len(rows), ROWS):
        if context[lo : lo + ROWS].any() or target[lo : lo + ROWS].any():
            blocks.append(lo // ROWS)
            data.append(rows[lo : lo + ROWS].tobytes())
    yield pa.record_batch([pa.array(blocks, pa.int32()), pa.array(data, pa.binary())], names=["block", "rows"])


def _averages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of equal blocks, which follow each other."""
    now, total = None, np.zeros(0)

    def row() -> pa.RecordBatch:
        return pa.record_batch([pa.array([now], pa.int32()), pa.array([total.tobytes()], pa.binary())], names=["block", "rows"])

    for b in batches:
        for block, data in zip(b.column(0).to_pylist(), b.column(1), strict=True):
            part = np.frombuffer(data.as_py(), np.float32)
            if block == now:
                total += part
            else:
                if now is not None:
                    yield row()
                now, total = block, part.astype(np.float64)
    if now is not None:
        yield row()


def normalisers(spark: SparkSession, model: Model, step: int = 128) -> np.ndarray:
    """The normaliser of every pair of contexts (nearer, farther): a square of the vocabulary, made in blocks by the tasks. 4,097 tokens take 64 MB."""
    n, sent = len(model.context), spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in b.column(0).to_pylist():
                yield pa.record_batch([pa.array([k]), pa.array([sent.value.normalisers(slice(k * step, (k + 1) * step)).astype(np.float32).tobytes()], pa.binary())], names=["k", "rows"])

    blocks = -(-n // step)
    made = spark.range(0, blocks, 1, min(blocks, spark.sparkContext.defaultParallelism)).mapInArrow(run, "k long, rows binary").toArrow()
    out = np.zeros((n, n), np.float32)
    for k, rows in zip(made.column("k").to_pylist(), made.column("rows"), strict=True):
        out[k * step : (k + 1) * step] = np.frombuffer(rows.as_py(), np.float32).reshape(-1, n)
    return out


class Scorer:
    """log10 probabilities of the tokens of texts, many short texts at once, long ones piece by piece."""

    def __init__(self, model: Model, table: np.ndarray, v: Vocabulary):
        self.m, self.table, self.v, self.numbers = model, table, v, v.numbers
        self.near, self.far = model.context * model.near, model.context * model.far
        # by rank; then of the marks; and, as rank -1 is the last, of words whose count isn't held: log10(c + 0.5) is 0 there
        self.base = np.concatenate([v.base(v.count), v.base(np.array([v.ends])), [0], v.base(np.array([0.5]))])
        self.own = np.concatenate([np.zeros(v.words), v.own(v.count[v.words :], self.numbers.number[v.words : -2] - v.words), [0, 0, 0]])
        self.lost = v.own(np.full(CLASSES, 0.5), np.arange(CLASSES))

    def tokens(self, ids: np.ndarray) -> np.ndarray:
        """Of all ids but the first two, which are context. Natural logarithms."""
        return self.after(ids[2:], ids[1:-1], ids[:-2])

    def after(self, w: np.ndarray, a: np.ndarray, e: np.ndarray) -> np.ndarray:
        h = self.near.take(a, axis=0)
        h += self.far.take(e, axis=0)
        return np.einsum("nd,nd->n", h, self.m.target.take(w, axis=0)) + self.m.bias.take(w) - self.table[a, e]

    def texts(self, texts: Iterable[bytes]) -> tuple[list[list], list[Counter]]:
        """A row for each text: tokens, those with a held count, sums of base and score. Words whose count isn't held are returned, too, and lack log10(c + 0.5) in both sums."""
        out, rare, flow, of = [], [], [], []  # of: for each part of the flow, its text and its number of words

        def add() -> None:
            n = len(self.v.count)
            ranks = self.numbers.ranks(flow)
            ids = self.numbers.of(flow, ranks)
            at = np.flatnonzero(ids[2:] != self.numbers.before) + 2
            told = ranks[at]
            known = told >= 0 if self.v.ends else (told >= 0) & (told != n)
            own = self.own[told] + self.after(ids[at], ids[at - 1], ids[at - 2]).astype(float) / LN10
            lost = np.flatnonzero(told < 0)
            own[lost] += self.lost[ids[at[lost]] - self.numbers.first_class]
            text, count = np.array(of).T
            starts = np.cumsum(count) - count
            for i, *x in zip(text.tolist(), count.tolist(), *(np.add.reduceat(y, starts).tolist() for y in (known.astype(np.int64), self.base[told], own)), strict=True):
                out[i] = [p + q for p, q in zip(out[i], x, strict=True)]
            for i, k in zip(np.repeat(text, count)[lost].tolist(), at[lost].tolist(), strict=True):
                rare[i][flow[k]] += 1

        for i, data in enumerate(texts):
            out.append([0, 0, 0.0, 0.0])
            rare.append(Counter())
            flow += (BEFORE, BEFORE)
            for words in words_of(data):
                for lo in range(0, len(words), SCORED):
                    part = words[lo : lo + SCORED]
                    flow += part
                    of.append((i, len(part)))
                    if len(flow) >= SCORED:
                        add()
                        flow, of = flow[-2:], []  # what the text goes on from
            flow.append(AFTER)
            of.append((i, 1))
        if of:
            add()
        return out, rare


def score(docs: DataFrame, held: Column | None = None, words: int = WORDS, head: int = HEAD) -> DataFrame:
    """docs (doc_id, text, any more) -> doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score; one row per input row.

    Learns counts and the model from the rows that aren't ``held`` out. Null texts are empty: one token, their end. Null doc_ids are never held out; repeated rows are
    learned from and scored each. Without rows to learn from every token has the base score 0, and an empty table gives no rows.
    """
    key, spark = fresh(docs, "_key"), docs.sparkSession
    held = held_out() if held is None else held
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), held.alias("held_out"))
    learned = rows.where(~F.col("held_out")).select("text")
    counted = counts(learned)
    v = vocabulary(counted, words, head)
    known = spark.sparkContext.broadcast(v)  # bounded by ``head``
    model = train(learned, v, known)
    sent = spark.sparkContext.broadcast((model, normalisers(spark, model)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = None
        for b in batches:
            scorer = scorer or Scorer(*sent.value, known.value)
            found, rare = scorer.texts(t.as_py() for t in b.column(3))
            kinds = (pa.int64(), pa.int64(), pa.float64(), pa.float64())
            cols = [pa.array([x[i] for x in found], k) for i, k in enumerate(kinds)]
            asked = pa.StructArray.from_arrays([pa.array([w for x in rare for w in x], pa.binary()).cast(pa.string()), pa.array([n for x in rare for n in x.values()], pa.int64())], names=["word", "n"])
            ends = np.cumsum([0, *map(len, rare)]).astype(np.int32)
            yield pa.record_batch([*b.columns[:3], *cols, pa.ListArray.from_arrays(ends, asked)], names=[key, "doc_id", "held_out", "n_tokens", "n_known", "base_score", "score", "rare"])

    keys = keyed(rows, key).select(key, "doc_id", "held_out", F.col("text").cast("binary").alias("text"))
    told = stored(keys.mapInArrow(run, f"{key} long, doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double, rare array<struct<word: string, n: long>>"), "scored")
    # words whose counts no task holds are joined: each text's distinct ones, none of which is frequent
    asked = told.select(key, F.explode("rare").alias("x")).select(key, F.col("x.word").alias("word"), F.col("x.n").alias("n"))
    c = F.coalesce(F.col("c"), F.lit(0))
    asked = asked.join(counted.where(F.col("c") < max(1, v.least)) if v.least else counted, "word", "left")
    more = asked.groupBy(key).agg(F.sum(F.col("n") * F.log10(c + 0.5)).alias("more"), F.sum(F.when(c > 0, F.col("n")).otherwise(0)).alias("also"))
    out = told.drop("rare").join(more, key, "left")
    plus = lambda name, by: (F.col(name) + F.coalesce(F.col(by), F.lit(0))).alias(name)
    return out.select("doc_id", "held_out", "n_tokens", plus("n_known", "also"), F.lit(v.tokens).cast("long").alias("train_tokens"), plus("base_score", "more"), plus("score", "more"))
