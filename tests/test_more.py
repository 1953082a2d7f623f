"""Small operators: file facts, routes, JSON arrays, later parts, reports, and queries by text."""

import json

from pyspark.sql import functions as F

from estrado.functions import quality
from estrado.operators import acquire, answer, audit, chunking, search
from estrado.sources import corpus


def test_file_facts_of_chunks(spark):
    rows = spark.createDataFrame([("c1", "5-2001 - a.txt"), ("c2", "6-2002 - b (DEROGADA).txt"), ("c3", "7-2003 derogados.txt")], "chunk_id string, n string")
    got = {r["chunk_id"]: (r["es_derogada_por_filename"], r["fuente_archivo"]) for r in chunking.flag_files(rows, F.col("n")).collect()}
    assert got == {"c1": (False, "5-2001 - a.txt"), "c2": (True, "6-2002 - b (DEROGADA).txt"), "c3": (True, "7-2003 derogados.txt")}


def test_routes_of_documents(spark):
    rows = spark.createDataFrame([(1, "ok"), (2, "fallido_validacion"), (3, None)], "id int, status string")
    good, dead = acquire.routed(rows)
    assert [r["id"] for r in good.collect()] == [1] and sorted(r["id"] for r in dead.collect()) == [2, 3]


def test_json_arrays(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps([{"id": 1, "tags": ["x"]}, {"id": 2, "more": True}], indent=2))
    (tmp_path / "b.json").write_text("[]")
    assert sorted((r["id"], r["tags"]) for r in corpus.json_rows(spark, str(tmp_path), "id long, tags array<string>").collect()) == [(1, ["x"]), (2, None)]


def test_later_parts(spark):
    kinds = ["articulo_largo_parte", "articulo", None, *quality.PARTS]
    rows = spark.createDataFrame([(k, p) for k in kinds for p in (None, 1, 2)], "k string, p int")
    got = {(r["k"], r["p"]) for r in rows.where(quality.is_middle_part(F.col("k"), F.col("p"))).collect()}
    assert got == {(k, 2) for k in quality.PARTS}


def test_reports_cut_long_texts_and_tell_what_is_suspicious(spark):
    rows = spark.createDataFrame([("a", "articulo", "x" * 3001, 3001, 7, None), ("b", "articulo", "Entero y claro hasta el final.", 30, None, "II"), ("c", "articulo", None, 0, None, None)], "chunk_id string, tipo_chunk string, texto string, char_count int, articulo_num int, anexo_num string")
    md = {r["chunk_id"]: r["md"] for r in audit.report_markdown(rows, F.lit("")).collect()}
    assert "x" * 3000 + "\n\n[... TEXTO TRUNCADO, hay 1 chars mas ...]" in md["a"] and "x" * 3001 not in md["a"] and "muy_largo (3001 chars)" in md["a"] and "- `articulo_num`: 7" in md["a"]
    assert "Sospechas" not in md["b"] and "Motivo" not in md["b"] and "- `anexo_num`: II" in md["b"] and "articulo_num" not in md["b"]
    assert "texto_vacio" in md["c"]


def test_queries_by_text(spark):
    chunks = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "chunk_id int, embedding array<double>")
    embedder = lambda df: answer.embed_in_batches(df, lambda texts: [[1.0, 0.1] if "uno" in t else [0.1, 1.0] for t in texts], "query", "vector")
    best = lambda df: {r["query_id"]: r["chunk_id"] for r in search.by_text(chunks, df, embedder, 1).collect()}
    assert best(spark.createDataFrame([("a", "uno"), ("b", "dos")], "query_id string, query string")) == {"a": 1, "b": 2}
    assert best(spark.createDataFrame([("a", "uno", [0.0, 1.0]), ("b", "dos", None)], "query_id string, query string, vector array<double>")) == {"a": 2, "b": 2}
