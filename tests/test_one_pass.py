"""Chunks, statuses and logs come from one pass over the documents: nothing is shuffled, nothing is joined."""

from pyspark.sql import functions as F

from estrado.functions import parse, text
from estrado.operators import audit, charter, chunking, repeal
from estrado.plans import charter as plans


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_documents_are_chunked_without_a_shuffle(spark):
    docs = spark.createDataFrame([("a", "x")], "path string, contenido string")
    for df in (chunking.chunk_documents(docs), chunking.processing_log(docs), chunking.validated(docs, "path", "contenido"), chunking.kinds(docs)):
        assert not any(word in _plan(df) for word in ("Exchange", "Join", "Window", "Sort"))


def test_recurring_suffixes_are_numbered_in_their_order(spark):
    fill = "relleno de prueba " * 120
    t = f"Artículo 1.- Uno {fill}\nArtículo 2.- Dos.\nArtículo 2.- Otra vez.\nArtículo 3.- ...\nANEXO I\nPlanilla de valores con todos sus detalles.\nANEXO I\nOtra planilla de valores con sus detalles."
    got = chunking.chunk_documents(spark.createDataFrame([("a", t)], "path string, contenido string")).orderBy("ord").collect()
    assert [r["chunk_id"].removeprefix("doc_desconocido_") for r in got] == ["art_1", "art_2", "art_2__2", "anexo_I", "anexo_I__2"]
    assert [r["chunk_id_original"] for r in got] == [None, None, "doc_desconocido_art_2", None, "doc_desconocido_anexo_I"]


def test_short_cuts_give_what_the_patterns_give(spark):
    rows = ["", " ", " x ", "a\n\n\n\nb", "a\n \n\t\nb---c", "x \n\n  Dada en la Sala de Sesiones, hoy\ny Dada", "Dada\nDada en la sala de deliberaciones", 'p "San Martin de los Andes, Zona no Nuclear"\nq', "\U0001f600 Artículo  1.- Que\n Volver \nVolver a\n\n\n\nfin\n", "ARTÍCULO 1º.- - -", None]
    d = spark.createDataFrame([(x,) for x in rows], "t string")
    old = F.regexp_replace(F.regexp_replace("t", parse.SLOGAN, ""), parse.CLOSING, "")
    new = text.replaced(text.replaced(F.col("t"), '"San Mart', parse.SLOGAN, ""), "Dada", parse.CLOSING, "")
    start = r"(?ius)(ART[ÍI]CULO\s+\d.*)"
    white = r"(?U)^\s+|\s+$"
    c = F.regexp_replace(F.regexp_replace(F.when(F.col("t").rlike(start), F.regexp_extract("t", start, 1)).otherwise(F.col("t")), parse.SLOGAN, ""), parse.CLOSING, "")
    c = F.array_join(F.filter(F.split(c, "\n", -1), lambda x: ~F.regexp_replace(x, white, "").isin(*parse.NOISE)), "\n")
    body = F.regexp_replace(F.regexp_replace(F.regexp_replace(c, "-{3,}", "-"), r"\n\s*\n\s*\n+", "\n\n"), white, "")
    for r in d.select(old.alias("a"), new.alias("b"), F.regexp_replace("t", white, "").alias("c"), text.strip(F.col("t")).alias("d"), body.alias("e"), parse.body(F.col("t")).alias("f")).collect():
        assert (r["a"], r["c"], r["e"]) == (r["b"], r["d"], r["f"])


def test_texts_and_files_are_unified_in_one_join(spark):
    t = spark.createDataFrame([("a", "x"), ("a", "y"), ("b", "z"), (None, "n")], "doc_id_derogado string, verbo string")
    f = spark.createDataFrame([("a", "1.txt", "filename"), ("a", "2.txt", "filename"), ("c", "3.txt", "filename"), ("c", "4.txt", "filename"), (None, "5.txt", "filename")], "doc_id_derogado string, nombre_archivo string, fuente string")
    u = repeal.unify(t, f)
    assert {(r["doc_id_derogado"], r["verbo"], r["nombre_archivo"], "+".join(r["fuentes"])) for r in u.collect()} == {
        ("a", "x", None, "texto+filename"), ("a", "y", None, "texto+filename"), ("b", "z", None, "texto"), (None, "n", None, "texto"), ("c", None, "3.txt", "filename"), ("c", None, "4.txt", "filename"), (None, None, "5.txt", "filename")}
    assert u.count() == 7 and u._jdf.queryExecution().optimizedPlan().toString().count("Join") == 1


def test_charters_are_cut_in_one_pass(spark):
    t = "\nPRIMERA PARTE\nUna\nTÍTULO I\nDe todo\nCAPÍTULO II: Dos\nArtículo 1: a.\nSECCIÓN I: s\nArtículo 2: b.\nTÍTULO IV\nOtro\nArtículo 3: c.\nCAPÍTULO I: Uno\nArtículo 4: d.\nSEGUNDA PARTE\nDos\nArtículo 5: e.\nSECCIÓN II: z\nArtículo 6: f."
    d = spark.createDataFrame([("a", t), ("b", ""), ("c", None), ("d", "\nArtículo 1: x")], "doc_id string, texto string")
    assert not any(word in _plan(charter.chunks(d)) for word in ("Exchange", "Join", "Window", "Sort", "Union"))
    for df in (charter.chunks(d), charter.structure(d)):
        assert "Union" not in _plan(df)
    want = charter.place(charter.articles(d), charter.structure(d)).orderBy("num").where("doc_id = 'a'")
    levels = [f"{level}_{x}" for level in charter.LEVELS for x in ("num", "nombre")]
    got = charter.chunks(d.where("doc_id = 'a'")).orderBy("articulo_num")
    assert [tuple(r) for r in got.select(*levels).collect()] == [tuple(r) for r in want.select(*levels).collect()] and got.count() == 6
    assert charter.chunks(d).count() == 7


def test_tasks_grow_in_number_with_the_rows(spark, monkeypatch):
    monkeypatch.setattr(plans, "ROWS", 10)
    assert plans.dealt(spark.range(200)).rdd.getNumPartitions() == 20 and plans.dealt(spark.range(5)).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism


def test_texts_are_cut_by_bytes_as_by_characters(spark):
    far = "\n" + " " * 90 + "Dada en la Sala de Sesiones, hoy\nfin"
    rows = ["", " ", "\n", "a", "a\n", "a\n\n", " a\n", "é", "é\n", "a é", "\xa0a\xa0", "a \n", "\U0001f600", "x" + far, "é" * 70 + " \n \nDada en la sala de Deliberaciones y más\nDada", far, "Dada", "sin marca", None]
    d = spark.createDataFrame([(x,) for x in rows], "t string")
    got = d.select("t", text.strip(F.col("t")).alias("a"), F.btrim("t", F.lit(text.SPACES)).alias("b"), text.replaced(F.col("t"), "Dada", parse.CLOSING, "<>").alias("c"), F.regexp_replace("t", parse.CLOSING, "<>").alias("d"), text.from_byte(F.col("t"), F.lit(1)).alias("e")).collect()
    for r in got:
        assert (r["a"], r["c"], r["e"]) == (r["b"], r["d"], r["t"])


def test_headings_far_into_a_text_and_long_ones_are_read(spark):
    t = "preámbulo " * 200 + "\nARTÍCULO" + " " * 150 + "7º.-" + " " * 300 + "Que sí.\nArtículo 8.- Texto\nANEXO I\nfin\n"
    r = spark.createDataFrame([(t,)], "t string").select(F.posexplode(parse.articles(parse.body(F.col("t")))).alias("i", "x")).select("x.*").collect()
    assert [(x["num"], x["texto"]) for x in r] == [(7, "Que sí."), (8, "Texto ANEXO I")]
    assert r[0]["start"] == 0 and r[0]["end"] == r[1]["start"] == r[0]["char_count"]


def test_anomalies_judge_each_row_once(spark):
    judged = spark.sparkContext.accumulator(0)

    def one(batches):
        for b in batches:
            judged.add(b.num_rows)
            yield b

    rows = spark.range(120).mapInArrow(one, "id long")
    got = audit.anomalies(rows, [F.asc("id")]).collect()
    assert [r["id"] for r in got] == list(range(50)) and {(r["total"], r["truncado"]) for r in got} == {(120, True)}
    assert judged.value == 120
