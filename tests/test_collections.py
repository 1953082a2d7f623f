"""Collections in the catalog and in folders, and the library's views for SQL."""

import re

import pytest
from pyspark.sql import functions as F

from estrado.functions import cite, sql
from estrado.operators import chunking, collections, upsert

ROWS = "chunk_id string, v int"


def test_catalogued_collection(spark, tmp_path):
    with pytest.raises(ValueError, match="no schema"):
        collections.Catalogued(spark, "norms_a", buckets=4)
    c = collections.Catalogued(spark, "norms_a", ROWS, buckets=4, path=str(tmp_path / "a"))
    assert c.read().count() == 0 and c.read().columns == ["chunk_id", "v"]
    assert c.upsert(spark.createDataFrame([("a", 1), ("b", 1), ("b", 2)], ROWS).coalesce(1)) == 2
    assert c.upsert(spark.createDataFrame([("b", 3, 1, "x"), ("b", 4, 0, "y"), ("c", 5, 0, None)], ROWS + ", at int, more string"), "at") == 2
    want = {("a", 1, None), ("b", 3, "x"), ("c", 5, None)}
    held = collections.Catalogued(spark, "norms_a", buckets=4)
    assert {tuple(r) for r in held.read().select("chunk_id", "v", "more").collect()} == want
    held.upsert(held.read().where("chunk_id = 'a'").withColumn("v", F.lit(9)))  # reads what it writes
    assert spark.table("norms_a").count() == 5
    held.compact()
    assert spark.table("norms_a").count() == 3 and held.read().where("chunk_id = 'a'").first()["v"] == 9
    for other in ({"buckets": 8}, {"buckets": 4, "key": "v"}):
        with pytest.raises(ValueError, match="buckets, not"):
            collections.Catalogued(spark, "norms_a", **other)
    collections.Catalogued(spark, "norms_b", "k long, t string", key="k", buckets=2, path=str(tmp_path / "b"))
    assert {tuple(r) for r in collections.collections(spark).where("name like 'norms%'").collect()} == {("norms_a", "chunk_id", 4, 3), ("norms_b", "k", 2, 0)}


def test_the_stored_side_is_not_moved(spark, tmp_path):
    c = collections.Catalogued(spark, "norms_c", "chunk_id long, v long", buckets=4, path=str(tmp_path / "c"))
    c.upsert(spark.range(1000).select(F.col("id").alias("chunk_id"), "id"))
    asked = spark.range(0, 2000, 3).select(F.col("id").alias("chunk_id"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for df, moves in ((c.read(), 0), (c.read().join(asked.repartition(3), "chunk_id"), 2)):
            plan = df._jdf.queryExecution().executedPlan().toString()
            before = plan[: plan.index("FileScan")]
            assert len(re.findall(r"Exchange", plan)) == moves  # the asked side: dealt at random, then by key
            assert "Exchange" not in before.split("SortMergeJoin")[-1]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert c.read().join(asked, "chunk_id").count() == 334


def test_a_folder_keeps_its_number_of_buckets(spark, tmp_path):
    path = str(tmp_path / "t")
    assert upsert.Collection(spark, path, schema=ROWS).read().columns == ["chunk_id", "v"]
    rows = spark.range(100).select(F.col("id").cast("string").alias("chunk_id"), F.lit(1).alias("v"))
    assert upsert.Collection(spark, path).upsert(rows) == 100
    with pytest.raises(ValueError, match="64 buckets"):
        upsert.Collection(spark, path, buckets=48)
    assert upsert.Collection(spark, path).upsert(rows) == 100


def test_views_equal_the_operators(spark):
    text = "Ordenanza N° 5, Año 2001\n\nARTÍCULO 1º.- Dispone algo.\n\nANEXO I\nPlanilla con muchos detalles del caso.\n"
    docs = spark.createDataFrame([("a", text), ("b", text.replace("N° 5", "N° 6"))], "path string, contenido string")
    docs.createOrReplaceTempView("docs_in")
    sql.chunks_view(spark, "docs_in", "docs_chunks")
    told = chunking.chunk_documents(docs)
    assert sorted(map(str, spark.sql("SELECT c.* FROM docs_in d JOIN docs_chunks c ON c.path = d.path").select(told.columns).collect())) == sorted(map(str, told.collect()))
    sql.citations_view(spark, "docs_chunks", "docs_cited")
    assert sorted(r[0] for r in spark.sql("SELECT cita FROM docs_cited").collect()) == sorted(r[0] for r in told.select(cite.citation(told)).collect())
    sql.register(spark)
    rows = spark.createDataFrame([("ordenanza", "7", 2001, 3), ("resolucion", None, None, None), ("DECRETO", "1", 2000, None), (None, "1", 2000, None)], "tipo_norma string, numero string, anio int, articulo_num int")
    for r in rows.select(F.expr("estrado_norm_label(tipo_norma, numero, anio, articulo_num)").alias("got"), cite.citation(rows).alias("want")).collect():
        assert r["got"] == r["want"]
