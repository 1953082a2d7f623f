"""Mixing sources to target weights by capped water-filling.

A source's target is its share of the budget by weight, clamped at ``max_epochs`` times its size; the
excess goes to the other sources by weight until none is above. The fixed point has one water level L
with target = min(cap, L * weight), found from prefix sums over the sources (one row per source).
Each document is taken a whole number of times, and once more if it falls in the seeded fraction:
documents are ordered by a seeded MD5 of id and text, split in hash buckets, and only the bucket in which the
fraction ends is ranked row by row, so that a source of any size meets its target to half a document.
The outcome is one rule per source, by which every row is judged on its own; only where the fraction ends within a stack of equal rows are these numbered.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .scratch import stored
from .streams import numbered

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)


def water_fill(sources: DataFrame, budget: float, weights=WEIGHTS, max_epochs: int = 2) -> DataFrame:
    """sources (skey, source, source_size), one row per source -> the same and weight, target.

    Sources in code-point order, null last, get ``weights`` in turn. Both orders, by name and by the level that fills a source, are
    distributed sorts, so that sources may be as many as hosts; only sums by part reach the driver.
    """
    nth = numbered(sources.select("skey", "source", "source_size"), "_nth", F.col("source").asc_nulls_last())
    spin = F.element_at(F.array(*(F.lit(int(w)) for w in weights)), (F.pmod("_nth", F.lit(len(weights))) + 1).cast("int"))
    s = nth.withColumn("weight", spin).withColumn("cap", F.col("source_size") * max_epochs).withColumn("full", F.col("cap") / F.col("weight"))
    # the level L solves sum(min(cap, L * weight)) = budget: sources that are full below it are clamped, the rest share by weight
    s = numbered(s, "pos", "full", F.col("source").asc_nulls_last())
    part = F.floor(F.col("pos") / 10_000)
    sums = sorted(tuple(r) for r in s.groupBy(part.alias("p")).agg(F.sum("cap"), F.sum("weight"), F.max("full")).collect())  # a row per 10,000 sources
    rest, before, level = sum(r[2] for r in sums), 0, None
    for p, cap, weight, full in sums:
        if level is None and before + cap + full * (rest - weight) >= budget * (1 - 1e-9):  # the level is reached within this part
            order = Window.orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
            near = s.where(part == p).withColumn("done", F.coalesce(F.sum("cap").over(order), F.lit(0)) + F.lit(before))
            near = near.withColumn("open", F.lit(rest) - F.coalesce(F.sum("weight").over(order), F.lit(0))).withColumn("lvl", (F.lit(float(budget)) - F.col("done")) / F.col("open"))
            # the first source in this order that its own level doesn't fill: all before it are clamped
            found = near.where(F.col("lvl") * F.col("weight") <= F.col("cap")).orderBy("pos").select("lvl").first()
            level = found[0] if found else None
        before, rest = before + cap, rest - weight
    cap = F.col("cap").cast("double")
    target = cap if level is None else F.least(cap, F.lit(float(level)) * F.col("weight"))
    return s.select("skey", "source", "source_size", "weight", target.alias("target"))


def _drawn(seed: int, buckets_hex: int) -> dict:
    key = F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n"))
    draw = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.coalesce("text", F.lit(""))))
    return {"_skey": key, "_draw": draw, "_bucket": F.substring(draw, 1, buckets_hex)}


def _rules(slim: DataFrame, share: float, weights, max_epochs: int) -> DataFrame:
    """One row per source: _skey, source_size, target, whole (repetitions of every document), and what is taken once more: buckets
    up to ``full``, in bucket ``edge`` the documents up to ``last``, and of the equal rows at ``last`` the first ``some`` of ``all``."""
    parts = stored(slim.groupBy("_skey", "source", "_bucket").agg(F.sum("size").alias("words")), "mix-buckets")
    sources = parts.groupBy("_skey", "source").agg(F.sum("words").cast("long").alias("source_size"))
    total = parts.agg(F.coalesce(F.sum("words"), F.lit(0))).first()[0]
    filled = water_fill(sources.withColumnRenamed("_skey", "skey"), share * total, weights, max_epochs).withColumnRenamed("skey", "_skey")
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    filled = filled.withColumn("whole", whole).withColumn("part", F.col("target") - F.col("whole") * F.col("source_size")).drop("source", "weight")
    filled = stored(filled, "mix-targets")
    run = Window.partitionBy("_skey").orderBy("_bucket")  # at most 16 ** buckets_hex rows per source
    ends = parts.withColumn("done", F.sum("words").over(run) - F.col("words")).join(filled, "_skey").withColumn("open", F.col("part") - F.col("done"))
    edge = ends.where((F.col("open") > 0) & (F.col("open") < F.col("words"))).select("_skey", "_bucket", "open")
    # rows that agree in id and text are a stack of one size, of which some may be taken
    near = slim.join(edge, ["_skey", "_bucket"]).groupBy("_skey", "_bucket", "open", "_draw").agg(F.first("size").alias("size"), F.count(F.lit(1)).alias("all"))
    inside = Window.partitionBy("_skey", "_bucket").orderBy("_draw").rowsBetween(Window.unboundedPreceding, -1)
    near = near.withColumn("before", F.coalesce(F.sum(F.col("size") * F.col("all")).over(inside), F.lit(0)))
    some = F.when(F.col("size") > 0, F.least("all", F.floor((F.col("open") - F.col("before")) / F.col("size") + 0.5))).otherwise(F.col("all"))
    near = near.where(F.col("before") + F.col("size") / 2 <= F.col("open")).withColumn("some", some)
    last = near.groupBy("_skey").agg(F.max(F.struct(F.col("_draw").alias("draw"), "some", "all")).alias("last"), F.max("_bucket").alias("edge"))
    full = ends.groupBy("_skey").agg(F.max(F.when((F.col("open") > 0) & (F.col("open") >= F.col("words")), F.col("_bucket"))).alias("full"))
    return filled.drop("part").join(full, "_skey").join(last, "_skey", "left")


def _told(rows: DataFrame, rules: DataFrame, cut: bool) -> DataFrame:
    """``rows`` with their source's rule and ``times``; of the equal rows where a source's fraction ends, the first ones in a numbering."""
    both = rows.join(rules, "_skey")
    at_last = F.coalesce((F.col("_bucket") == F.col("_rule.edge")) & (F.col("_draw") == F.col("_rule.last.draw")), F.lit(False))
    below = F.coalesce(F.col("_bucket") <= F.col("_rule.full"), F.lit(False)) | F.coalesce((F.col("_bucket") == F.col("_rule.edge")) & (F.col("_draw") <= F.col("_rule.last.draw")), F.lit(False))
    if not cut:
        return both.withColumn("times", F.col("_rule.whole") + below.cast("long"))
    split = at_last & (F.col("_rule.last.some") < F.col("_rule.last.all"))
    alone = both.where(~split).withColumn("times", F.col("_rule.whole") + below.cast("long"))
    stack = numbered(both.where(split), "_nth", "_skey")
    first = stack.groupBy("_skey").agg(F.min("_nth").alias("_first"))
    stack = stack.join(first, "_skey").withColumn("times", F.col("_rule.whole") + (F.col("_nth") - F.col("_first") < F.col("_rule.last.some")).cast("long"))
    return alone.unionByName(stack.select(*alone.columns))


def _take(docs: DataFrame, share: float, weights, max_epochs: int, seed: int, buckets_hex: int, most_sources: int) -> tuple[DataFrame, DataFrame, bool]:
    """A slim copy of docs (doc_id, source, size, keys), the rule of each source, and whether a rule cuts a stack of equal rows."""
    size = F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORD)).cast("long")
    slim = stored(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", size.alias("size"), *(v.alias(k) for k, v in _drawn(seed, buckets_hex).items())), "mix-sizes")
    rules = stored(_rules(slim, share, weights, max_epochs), "mix-rules")
    count, cut = rules.agg(F.count(F.lit(1)), F.coalesce(F.max((F.col("last.some") < F.col("last.all")).cast("int")), F.lit(0))).first()
    rules = rules.select("_skey", F.struct(*rules.columns[1:]).alias("_rule"))
    return slim, F.broadcast(rules) if count <= most_sources else rules, bool(cut)


def plan_mix(docs: DataFrame, share: float = 1.5, weights=WEIGHTS, max_epochs: int = 2, seed: int = 42, buckets_hex: int = 3, most_sources: int = 100_000) -> DataFrame:
    """docs (doc_id, text, source, any more) -> doc_id, source, size, source_size, target, times, taken; one row per input row.

    size: words of the text, 0 if null. times: how often the mix takes the document; taken = times * size.
    Null sources are one source, ordered last. Each row is drawn by its doc_id and text; of rows that agree in both and in the source, some may be taken once more than
    others. Empty tables give no rows; a source without words gets target 0. The rules, one row per source, are
    broadcast if there are at most ``most_sources``, else joined by a shuffle.
    """
    slim, rules, cut = _take(docs, share, weights, max_epochs, seed, buckets_hex, most_sources)
    return _told(slim, rules, cut).select("doc_id", "source", "size", "_rule.source_size", "_rule.target", "times", (F.col("times") * F.col("size")).alias("taken"))


def mixed_rows(docs: DataFrame, share: float = 1.5, weights=WEIGHTS, max_epochs: int = 2, seed: int = 42, buckets_hex: int = 3, most_sources: int = 100_000) -> DataFrame:
    """The mix itself: docs' columns, each row as often as ``plan_mix`` takes it."""
    _, rules, cut = _take(docs, share, weights, max_epochs, seed, buckets_hex, most_sources)
    rows = _told(docs.select(F.struct(*docs.columns).alias("_row"), *(v.alias(k) for k, v in _drawn(seed, buckets_hex).items())), rules, cut)
    return rows.withColumn("_copy", F.explode(F.array_repeat(F.lit(0), F.col("times").cast("int")))).select("_row.*")
