"""Repeals, filters, fusion, gate, sampling, upsert, sources and streaming on small tables."""

import math

import pytest
from pyspark.sql import functions as F

from estrado.operators import audit, filters, repeal, search, upsert, vectors
from estrado.sources import corpus, listing


def events(spark, text):
    df = spark.createDataFrame([("c1", text, "ordenanza_1_2020")], "chunk_id string, texto string, doc_id string")
    return sorted(r["doc_id_derogado"] for r in repeal.text_events(df).collect())


def test_repeal_clauses(spark):
    assert events(spark, "DERÓGASE la Ordenanza nº 11.854/18.") == ["ordenanza_11854_2018"]
    assert events(spark, "Derógase la Ordenanza 7660/07") == ["ordenanza_7660_2007"]
    assert events(spark, "DERÓGANSE las Ordenanzas 1/90; 200/91; 3.001/2002 y 4500/59") == ["ordenanza_1_1990", "ordenanza_200_1991", "ordenanza_3001_2002", "ordenanza_4500_2059"]
    assert events(spark, "DERÓGASE la Ordenanza en su artículo 4, 7660/07") == []
    assert events(spark, "MODIFÍCASE la Ordenanza 7660/07") == []
    assert events(spark, "DERÓGASE\nla\nOrdenanza 1234/2010") == ["ordenanza_1234_2010"]


def test_repeal_names(spark):
    rows = [("Ordenanza", n) for n in ("2222-1996 - x (DEROGADA).txt", "03-2001 - DEROGADOS.txt", "x DEROGADA.txt", "4-2004 - vigente.txt")]
    got = repeal.file_events(spark.createDataFrame(rows, "carpeta string, nombre string")).collect()
    assert sorted(r["doc_id_derogado"] for r in got) == ["ordenanza_2222_1996", "ordenanza_3_2001"]


def test_filters_keep_rows_without_the_field(spark):
    df = spark.createDataFrame([("co",), (None,), ("z",)], "t string")
    assert df.where(filters.dense({"t": {"$ne": "co"}})).count() == 2
    assert df.where(filters.dense({"$and": [{"t": {"$ne": "co"}}, {"t": "z"}]})).count() == 1
    assert df.where(filters.sparse({"t": {"$ne": "co"}})).count() == 0
    with pytest.raises(ValueError):
        filters.dense({"t": {"$gt": 1}})


def test_rrf_ties_and_bounds(spark):
    a = spark.createDataFrame([(1, "x", 1), (1, "y", 2)], "query_id int, chunk_id string, rank int")
    b = spark.createDataFrame([(1, "z", 1), (1, "y", 2)], "query_id int, chunk_id string, rank int")
    got = search.fused_topn(search.rrf([a, b]), 3).orderBy("rank").collect()
    assert [r["chunk_id"] for r in got] == ["y", "x", "z"]
    assert math.isclose(got[0]["score_rrf"], 2 / 62, abs_tol=1e-12)


@pytest.mark.parametrize("angle,relevant", [(0.46, True), (0.4599, False), (0.9, True)])
def test_gate_is_inclusive(spark, angle, relevant):
    side = math.sqrt(1 - angle * angle)
    chunks = spark.createDataFrame([(1, [angle, side], "carta_organica"), (2, [1.0, 0.0], None)], "chunk_id int, embedding array<double>, tipo_documento string")
    q = spark.createDataFrame([(1, [1.0, 0.0])], "query_id int, vector array<double>")
    assert search.charter_gate(chunks, q).first()["co_es_relevante"] is relevant


def test_gate_without_charter(spark):
    chunks = spark.createDataFrame([(2, [1.0, 0.0], None)], "chunk_id int, embedding array<double>, tipo_documento string")
    q = spark.createDataFrame([(1, [1.0, 0.0])], "query_id int, vector array<double>")
    r = search.charter_gate(chunks, q).first()
    assert (r["mejor_coseno_co"], r["co_es_relevante"]) == (0.0, False)


def test_request_bounds():
    search.check_request("ab", 50, 30)
    for bad in (("a",), ("ab", 0), ("ab", 51), ("ab", 10, 31)):
        with pytest.raises(ValueError):
            search.check_request(*bad)


def test_stratified_is_repeatable(spark):
    df = spark.range(500).select(F.col("id").cast("string").alias("chunk_id"), F.when(F.col("id") % 2 == 0, "articulo").otherwise("anexo").alias("tipo_chunk"))
    a = {r[0] for r in audit.stratified(df, "chunk_id", "tipo_chunk", audit.INSPECTION).select("chunk_id").collect()}
    b = {r[0] for r in audit.stratified(df.repartition(3), "chunk_id", "tipo_chunk", audit.INSPECTION).select("chunk_id").collect()}
    assert a == b and len(a) == 23


def test_collection(spark, tmp_path):
    table = upsert.Collection(spark, str(tmp_path / "t"))
    assert table.upsert(spark.createDataFrame([("a", 1), ("b", 1)], "chunk_id string, v int")) == 2
    assert table.upsert(spark.createDataFrame([("b", 2), ("c", 2)], "chunk_id string, v int")) == 3
    assert {tuple(r) for r in table.read().collect()} == {("a", 1), ("b", 2), ("c", 2)}
    assert table.upsert(spark.createDataFrame([("c", 3, 1), ("c", 4, 0)], "chunk_id string, v int, at int"), "at") == 3
    assert {tuple(r) for r in table.read().collect()} == {("a", 1), ("b", 2), ("c", 3)}
    twice = spark.createDataFrame([("d", 1), ("d", 2), ("d", 3)], "chunk_id string, v int").coalesce(1)
    assert table.upsert(twice) == 4 and table.read().where("chunk_id = 'd'").first()["v"] == 3
    files = {p.parent.name for p in (tmp_path / "t").rglob("*.parquet")}
    assert all(len(list((tmp_path / "t" / b).glob("*.parquet"))) == 1 for b in files)  # nothing old is left


def test_history_goes_on(spark):
    had = spark.createDataFrame([(7, "u", "q", "f")], "id long, username string, query string, fecha string")
    asked = spark.createDataFrame([("u", f"q{i}", i) for i in range(50)], "username string, query string, ord int").repartition(5)
    got = upsert.history_rows(had, asked, "now").orderBy("id").collect()
    assert [(r["id"], r["query"]) for r in got] == [(8 + i, f"q{i}") for i in range(50)]


def test_dense_search_against_plain_cosines(spark, monkeypatch):
    import random

    rng = random.Random(3)
    rows = [(i, [rng.gauss(0, 1) for _ in range(4)]) for i in range(300)] + [(400 + i, [1.0, 0.0, 0.0, 0.0]) for i in range(30)] + [(900, None), (901, [0.0] * 4), (902, [1.0, 2.0])]
    asked = [(f"q{i}", [rng.gauss(0, 1) for _ in range(4)]) for i in range(9)] + [("one", [2.0, 0.0, 0.0, 0.0]), ("none", None)]
    cos = lambda a, b: sum(x * y for x, y in zip(a, b)) / math.sqrt(sum(x * x for x in a) * sum(x * x for x in b))
    chunks, queries = spark.createDataFrame(rows, "chunk_id int, embedding array<float>"), spark.createDataFrame(asked, "query_id string, vector array<double>")
    exact = {r["chunk_id"]: r["embedding"] for r in chunks.collect() if r["chunk_id"] < 900}
    for block in (1 << 23, 100):
        monkeypatch.setattr(vectors, "QUERY_BYTES", block)
        monkeypatch.setattr(vectors, "VECTOR_BYTES", 7 * block)
        got = {}
        for r in search.dense_topk(chunks, queries, 20).collect():
            got.setdefault(r["query_id"], []).append((r["rank"], r["chunk_id"]))
        for q, v in asked[:-1]:
            want = sorted(exact, key=lambda i: (-round(cos(exact[i], v), 9), i))[:20]
            assert [c for _, c in sorted(got[q])] == want
        assert "none" not in got


def test_corpus_sources(spark, tmp_path):
    for name, text in (("Ordenanza/1-2001 - a.txt", "uno\nmás"), ("Ordenanza/sub/2-2002 - b.txt", "dos"), ("Resolución/3-1950 - c.txt", "tres")):
        p = tmp_path / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(text)
    d = corpus.documents(spark, str(tmp_path)).collect()
    assert sorted(r["contenido"] for r in d) == ["tres", "uno\nmás"]
    f = {r["nombre"]: r for r in corpus.files(spark, str(tmp_path)).collect()}
    assert len(f) == 3 and f["2-2002 - b.txt"]["tipo"] == "Ordenanza" and f["3-1950 - c.txt"]["anio"] is None and f["1-2001 - a.txt"]["bytes"] == 8


def fetch(page, options):
    return [{"id_pdf": f"{page}-{i}", "numero": i, "anio": 2020, "fecha_texto": "1 ene. 2020"} for i in range(3)]


def test_paged_listing(spark):
    spark.dataSource.register(listing.Listing)
    df = spark.read.format("norm_listing").option("fetcher", "tests.test_operators:fetch").option("lastPage", 4).load()
    assert df.count() == 12 and df.rdd.getNumPartitions() == 4


def told(page, options):
    return {"rows": fetch(page, options), "last_page": 3}


def until_empty(page, options):
    return fetch(page, options) if page <= 5 else []


tries = []


def flaky(page, options):
    tries.append(page)
    if len(tries) < 3:
        raise OSError("busy")
    return []


def test_paged_listing_finds_its_end(spark):
    spark.dataSource.register(listing.Listing)
    read = lambda name: spark.read.format("norm_listing").option("fetcher", f"tests.test_operators:{name}").option("wait", 0).load()
    assert read("told").count() == 9 and read("told").rdd.getNumPartitions() == 3
    assert read("until_empty").count() == 15
    tries.clear()
    assert listing.ListingReader({"fetcher": "tests.test_operators:flaky", "wait": "0"}).fetch(1) == ([], None) and len(tries) == 3


def test_spanish_dates_at_the_start(spark):
    from estrado.functions import chunks as c

    said = ["19 mar. 2026", "5 ENE 2020 y más", " 19 mar. 2026", "19 marzo 2026", "31 feb. 2020", "100 ene 2020", "7 set. 2020", None, "007 dic 1999"]
    got = [r[0] and r[0].isoformat() for r in spark.createDataFrame([(i, t) for i, t in enumerate(said)], "i int, t string").orderBy("i").select(c.spanish_date(F.col("t"))).collect()]
    assert got == ["2026-03-19", "2020-01-05", None, None, None, None, None, None, "1999-12-07"]


def test_text_files_and_copies(spark, tmp_path):
    from estrado.operators import acquire

    rows = [("1-2001 - a.txt", "uno\ndos"), ("2-2002 - b c.txt", "")]
    acquire.write_texts(spark.createDataFrame(rows, "nombre string, contenido string"), str(tmp_path / "w"))
    assert sorted(tuple(r) for r in acquire.read_texts(spark, str(tmp_path / "w")).collect()) == sorted(rows)
    (tmp_path / "src").mkdir()
    for name in ("1-2001 - a.txt", "2-2002 - b.txt", "3-2003 - c.txt"):
        (tmp_path / "src" / name).write_text(f"texto de {name}")
    picked = corpus.first_documents(corpus.documents(spark, str(tmp_path)).select("path"), 2)
    out = acquire.copy_selected(picked, str(tmp_path / "copy"))
    assert out.columns == ["path", "path_destino"] and out.count() == 2
    assert {r["contenido"] for r in acquire.read_texts(spark, str(tmp_path / "copy")).collect()} == {"texto de 1-2001 - a.txt", "texto de 2-2002 - b.txt"}


def test_events_as_json(spark, tmp_path):
    import json

    from estrado.operators import report

    ev = spark.createDataFrame([("b", "x", "v"), ("a", "x", "v"), ("a", None, "v")], "doc_id_derogatorio string, doc_id_derogado string, verbo string")
    total = report.events_report(ev, str(tmp_path / "r")).first()
    assert (total["total_eventos"], total["docs_derogatorios"], total["docs_derogados"]) == (3, 2, 1)
    lines = [json.loads(x) for p in (tmp_path / "r" / "eventos").glob("*.json") for x in p.read_text().splitlines()]
    assert len(lines) == 3 and {"doc_id_derogatorio": "a", "doc_id_derogado": None, "verbo": "v"} in lines
    assert [r[0] for r in spark.read.json(str(tmp_path / "r" / "docs_derogatorios")).collect()] == ["a", "b"]


def test_embedding_in_batches_retries(spark):
    from estrado.operators import answer

    df = spark.createDataFrame([(i, None if i == 3 else "x" * i) for i in range(7)], "i int, texto string").coalesce(1)
    seen = {"fails": 2}

    def service(texts):
        assert len(texts) <= 2
        if seen["fails"]:
            seen["fails"] -= 1
            raise ConnectionError("rate limit")
        return [[float(len(t))] for t in texts]

    got = answer.embed_in_batches(df, service, batch_size=2, first_wait=0.0).orderBy("i").collect()
    assert [r["embedding"] for r in got] == [None if i == 3 else [float(i)] for i in range(7)]

    def down(texts):
        raise ConnectionError("down")

    with pytest.raises(Exception, match="down"):
        answer.embed_in_batches(df, down, retries=2, first_wait=0.0).collect()


def test_processing_goes_on_after_bad_documents(spark):
    from estrado.operators import chunking

    rows = [("a", "Ordenanza N° 5, Año 2001\nTitulo\nARTÍCULO 1º.- Algo que dice."), ("b", None), ("c", "  "), ("d", "")]
    got = {r["path"]: (r["n_chunks"], r["error"]) for r in chunking.processing_log(spark.createDataFrame(rows, "path string, contenido string")).collect()}
    assert got == {"a": (1, None), "b": (0, "texto ilegible"), "c": (0, "cero chunks generados"), "d": (0, "cero chunks generados")}


def test_sql_functions(spark):
    from estrado.functions import sql

    sql.register(spark)
    r = spark.sql("SELECT estrado_tokens('La Ley y N° 5 de 2001') t, estrado_tokens(NULL) n, estrado_pieces('') e, size(estrado_pieces(repeat('ab ', 1000))) p, estrado_norm_label('ordenanza', '7', 2001, NULL) l").first()
    assert (r["t"], r["n"], r["e"], r["p"], r["l"]) == (["la", "ley", "de", "2001"], [], [], 3, "Ordenanza N° 7/2001")


def test_new_norms_stream(spark, tmp_path):
    from estrado.streaming.ingest import new_norms

    src = tmp_path / "in"
    src.mkdir()
    for k, numbers in enumerate(([1, 2], [2, 3])):
        (src / f"{k}.json").write_text("\n".join(f'{{"numero": {n}, "anio": 2020, "visto": "2024-01-0{k + 1}T00:00:00Z"}}' for n in numbers))
    stream = spark.readStream.schema("numero int, anio int, visto timestamp").option("maxFilesPerTrigger", 1).json(str(src))
    new_norms(stream).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    assert sorted(r["numero"] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [1, 2, 3]


def test_stream_ingest(spark, tmp_path):
    from estrado.streaming.ingest import ingest

    src = tmp_path / "in"
    src.mkdir()
    (src / "a.txt").write_text("Ordenanza N° 5, Año 2001\nTitulo\nARTÍCULO 1º.- Algo que dice.")
    for _ in range(2):
        ingest(spark, str(src), str(tmp_path / "t"), str(tmp_path / "cp")).awaitTermination()
    assert [r["chunk_id"] for r in upsert.Collection(spark, str(tmp_path / "t")).read().collect()] == ["ordenanza_5_2001_full"]
