"""The segmented lexical index and the inverted file of vectors."""

import math
import random
import re

import pytest
from pyspark.sql import functions as F

from estrado.operators import lexical, search, vectors
from estrado.plans import search as plans

TEXTS = "chunk_id long, texto string"


def texts(n=300, seed=1):
    """Documents in groups with words of their own; every document has the word "común"."""
    rng = random.Random(seed)
    return [(i, "común " + " ".join(rng.choices([f"g{i // 40}w{j}" for j in range(6)] + [f"z{j}" for j in range(40)], k=rng.randint(1, 30)))) for i in range(n)] + [(n, ""), (n + 1, None)]


def asked(spark):
    return spark.createDataFrame([("a", "común g0w1 g0w2"), ("b", "común z3"), ("c", "g3w0 g3w0 z1 nada"), ("d", ""), ("e", "z1 z2 z3 z4")], "query_id string, query string")


def rows(df):
    return sorted((r["query_id"], r["rank"], r["chunk_id"], r["score"]) for r in df.collect())


def test_top_k_by_bounds_equals_scoring_everything(spark, monkeypatch):
    monkeypatch.setattr(lexical, "RANGE", 8)
    monkeypatch.setattr(lexical, "WHOLE", 0)
    monkeypatch.setattr(lexical, "FIRST", 3)
    index, q = search.bm25_index(spark.createDataFrame(texts(), TEXTS)), asked(spark)
    by = lexical.Asked(index, q)
    for k in (1, 5, 50):
        want = rows(lexical.ranked(by.scores(), [F.desc("score"), F.asc("chunk_id")], k))
        assert rows(search.sparse_topk(index, q, k)) == want
    read = {r["query_id"]: (r["n_read"], r["n_all"]) for r in by.postings(5).collect()}
    assert read["a"][0] < read["a"][1] / 2 and sum(r[0] for r in read.values()) < sum(r[1] for r in read.values())
    odd = spark.createDataFrame([(i, "odd" if i % 2 else "even") for i in range(300)], "chunk_id long, lang string")
    want = lexical.kept_by(by.scores(), odd.where("lang = 'odd'").select("chunk_id"))
    assert rows(search.sparse_topk(index, q, 5, odd, {"lang": "odd"})) == rows(lexical.ranked(want, [F.desc("score"), F.asc("chunk_id")], 5))


def test_the_postings_of_a_frequent_term_lie_in_several_files(spark, monkeypatch):
    monkeypatch.setattr(lexical, "RANGE", 8)
    monkeypatch.setattr(lexical, "WHOLE", 0)
    index = search.bm25_index(spark.createDataFrame([(i, "común") for i in range(400)] + [(1000 + i, f"otra{i}") for i in range(3)], TEXTS))
    held = index.table("blocks").where("term = 'común'").select(F.input_file_name().alias("f"), "n")
    assert held.select("f").distinct().count() > 2 and held.agg(F.sum("n")).first()[0] == 400


def test_upserts_deletes_and_compaction_equal_a_rebuild(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(lexical, "RANGE", 8)
    monkeypatch.setattr(lexical, "WHOLE", 0)
    first, q = texts(), asked(spark)
    index = search.bm25_index(spark.createDataFrame(first, TEXTS), str(tmp_path / "index"))
    old = rows(search.sparse_topk(index, q, 20))
    new = [(3, "g0w1 nueva nueva"), (7, ""), (301, "g0w2 común"), (900, "g3w0 z1"), (901, None)]
    once = index.upsert(spark.createDataFrame(new, TEXTS))
    again = once.upsert(spark.createDataFrame([(3, "g0w1 g0w1 g0w1"), (900, "nada")], TEXTS)).delete(spark.createDataFrame([(5,), (901,), (12345,)], "chunk_id long"))

    def rebuilt(*changes):
        docs = dict(first)
        for change in changes:
            docs |= change
        return search.bm25_index(spark.createDataFrame([(i, t) for i, t in docs.items() if t != "gone"], TEXTS))

    last = rebuilt(dict(new), {3: "g0w1 g0w1 g0w1", 900: "nada"}, {5: "gone", 901: "gone"})
    for got, want in ((once, rebuilt(dict(new))), (again, last), (again.compacted(str(tmp_path / "one")), last), (search.Bm25.read(spark, str(tmp_path / "index")), last)):
        assert rows(search.sparse_topk(got, q, 20)) == rows(search.sparse_topk(want, q, 20))
        near = lambda i: sorted((r["term"], r["df"], round(r["idf"], 9)) for r in i.idf.collect())
        assert near(got) == near(want) and tuple(got.stats.first())[:2] == tuple(want.stats.first())[:2]
    assert rows(search.sparse_topk(index, q, 20)) == old  # an open index reads on as it was
    # only the changed documents' postings were written
    assert once.table("blocks").where("segment = 1").agg(F.sum("n")).first()[0] == 6
    with pytest.raises(ValueError):
        search.bm25_index(spark.createDataFrame(first, TEXTS), str(tmp_path / "index"))


def test_an_index_of_nothing(spark):
    index, q = search.bm25_index(spark.createDataFrame([], TEXTS)), asked(spark)
    assert search.sparse_topk(index, q).count() == 0
    assert {r["query_id"] for r in search.sparse_topk(index.upsert(spark.createDataFrame([(1, "z1 z2"), (2, "z1"), (3, "otra cosa"), (4, "más"), (5, "una sola")], TEXTS)), q).collect()} == {"c", "e"}


def test_an_input_that_is_written_over_is_indexed_anew(spark, tmp_path):
    for n in (3, 50):
        spark.createDataFrame([(i, f"palabra {i}", "es", "src1") for i in range(n)], "doc_id long, text string, lang string, source string").coalesce(1).write.mode("overwrite").parquet(str(tmp_path / "documents.parquet"))
        for name, kind in (("embeddings", "vec_id long, embedding array<float>, label int"), ("benchmark", "item_id long, text string"), ("labels", "doc_id long, toxic int")):
            spark.createDataFrame([], kind).write.mode("overwrite").parquet(str(tmp_path / f"{name}.parquet"))
        assert plans.bm25_corpus_stats(spark, str(tmp_path)).first()["n_docs"] == n


def clustered(n=2000, dim=16, groups=25, seed=4):
    rng = random.Random(seed)
    middle = [[rng.gauss(0, 1) for _ in range(dim)] for _ in range(groups)]
    return [(i, [x + rng.gauss(0, 0.25) for x in middle[i % groups]], "even" if i % 2 else "odd") for i in range(n)]


VECTORS = "chunk_id long, embedding array<float>, lang string"


def test_inverted_file_recall_filters_and_pruning(spark, monkeypatch):
    monkeypatch.setattr(vectors, "VECTOR_BYTES", 4000)
    held = spark.createDataFrame([*clustered(), (5000, None, "odd"), (5001, [0.0] * 16, "odd"), (5002, [1.0], "odd")], VECTORS)
    queries = spark.createDataFrame([(i, [float(x) for x in v]) for i, v, _ in clustered(40, seed=4)] + [(99, None), (98, [0.0] * 16)], "query_id long, vector array<double>")
    index = vectors.ivf_index(held)
    probes = vectors.probes_for(index, queries, 50)
    assert probes < 15
    for where in (None, {"lang": "odd"}):
        exact = {(r["query_id"], r["chunk_id"]) for r in vectors.dense_topk(held, queries, 50, where).collect()}
        found = {(r["query_id"], r["chunk_id"]) for r in index.topk(queries, 50, max(probes, 8), where).collect()}
        assert len(exact) == 2000 and len(exact & found) >= 0.95 * len(exact)
    one = index.topk(queries.where("query_id = 0"), 5, 1)
    assert [r["chunk_id"] for r in one.orderBy("rank").collect()][0] == 0
    assert re.search(r"PartitionFilters: \[[^\]]*cell", one._jdf.queryExecution().toString())
    assert index.topk(queries, 50, 10**6).count() == vectors.dense_topk(held.where("size(embedding) = 16"), queries, 50).count()
    assert vectors.ivf_index(held.limit(0)).topk(queries, 5).count() == 0
    assert index.vectors.count() == 2000


def test_several_lists_in_one_pass(spark):
    held, queries = spark.createDataFrame(clustered(200), VECTORS), spark.createDataFrame([(1, [1.0] * 16), (2, [-1.0] * 16)], "query_id long, vector array<double>")
    both = vectors.dense_lists(held, queries, [(3, {"lang": "odd"}), (7, None)])
    for i, (k, where) in enumerate(((3, {"lang": "odd"}), (7, None))):
        assert sorted(map(tuple, both.where(F.col("list") == i).drop("list").collect())) == sorted(map(tuple, vectors.dense_topk(held, queries, k, where).collect()))
    assert all(math.isfinite(r["similitud"]) for r in both.collect())


def test_a_scan_of_documents_equals_their_postings(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(lexical, "RANGE", 8)
    monkeypatch.setattr(lexical, "TOGETHER", 2)
    monkeypatch.setattr(lexical, "STEP", 50)
    index = search.bm25_index(spark.createDataFrame(texts(), TEXTS), str(tmp_path / "index"))
    batch = spark.createDataFrame([(f"{q}{i}", t) for i in range(20) for q, t in (("a", "común g0w1 g0w2"), ("b", "común z3 z3"), ("c", "g3w0 z1 nada"), ("d", ""), ("e", "z1 z2 z3 z4"))], "query_id string, query string")
    assert not lexical.Asked(index, asked(spark)).scanned
    odd = spark.createDataFrame([(i, "odd" if i % 2 else "even") for i in range(300)], "chunk_id long, lang string")
    for now in (index, index.upsert(spark.createDataFrame([(3, "g0w1 nueva nueva"), (900, "g3w0 z1"), (901, None)], TEXTS)).delete(spark.createDataFrame([(5,), (12345,)], "chunk_id long"))):
        by = lexical.Asked(now, batch)
        assert by.scanned
        for k in (1, 5, 50, 1000):
            got = rows(search.sparse_topk(now, batch, k))
            assert not (tmp_path / "index" / "blocks" / f"segment={now.last}").exists() or k > 1
            assert got == rows(lexical.ranked(by.scores(), [F.desc("score"), F.asc("chunk_id")], k))
        want = lexical.kept_by(by.scores(), odd.where("lang = 'odd'").select("chunk_id"))
        assert rows(search.sparse_topk(now, batch, 5, odd, {"lang": "odd"})) == rows(lexical.ranked(want, [F.desc("score"), F.asc("chunk_id")], 5))


def test_texts_are_joined_to_hits_only(spark, tmp_path):
    d = str(tmp_path)
    spark.createDataFrame([(i, f"palabra número {i} de {i % 7}", "es", "src2") for i in range(60)], "doc_id long, text string, lang string, source string").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(i, [float(i % 5), 1.0], 0) for i in range(60)], "vec_id long, embedding array<float>, label int").write.parquet(f"{d}/embeddings.parquet")
    spark.createDataFrame([(1, "palabra número 3"), (2, "de 5")], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    spark.createDataFrame([], "doc_id long, toxic int").write.parquet(f"{d}/labels.parquet")
    assert "texto" not in plans._chunks(spark, d).columns and plans._chunks(spark, d).count() == 60
    assert plans.rag_answer(spark, d).count() == 2 and plans.hybrid_search(spark, d).where("texto_md5 is not null").count() == 20
