"""Golden cases for parsing: article merges, annexes, roman numerals, headers."""

from pyspark.sql import functions as F

from estrado.functions import chunks, parse

ART = "array<struct<num:int,label:string,texto:string,start:int,end:int,char_count:int>>"


def one(spark, col, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values))
    return df.select(col.alias("x")).first()["x"]


def arts(*rows):
    return [(n, f"Art {n}", t, 10 * i, 10 * i + 9, 9) for i, (n, t) in enumerate(rows)]


def merged(spark, rows):
    df = spark.createDataFrame([(rows,)], f"a {ART}")
    return df.select(parse.merge_false_positives(F.col("a")).alias("x")).first()["x"]


def test_merge_after_announcement(spark):
    got = merged(spark, arts((7, "sustituyese por el siguiente:"), (73, "nuevo"), (8, "sigue"), (9, "fin")))
    assert [a["num"] for a in got] == [7, 8, 9]
    assert got[0]["texto"] == "sustituyese por el siguiente:\n\nArt 73 nuevo"
    assert (got[0]["end"], got[0]["char_count"]) == (19, 19)


def test_merge_jump_and_none(spark):
    assert [a["num"] for a in merged(spark, arts((1, "a"), (50, "b"), (2, "c"), (3, "d")))] == [1, 2, 3]
    assert [a["num"] for a in merged(spark, arts((3, "a"), (4, "b"), (5, "c")))] == [3, 4, 5]
    assert merged(spark, []) == []


def test_announcement_counts_once(spark):
    got = merged(spark, arts((1, "queda redactado como sigue:"), (9, "x"), (2, "y")))
    assert [a["num"] for a in got] == [1, 2]


def test_roman(spark):
    for s, n in (("I", 1), ("IV", 4), ("IX", 9), ("XII", 12), ("XLII", 42), ("", 0)):
        assert one(spark, parse.roman(F.col("t")), t=s) == n


def test_annexes(spark):
    t = "ARTÍCULO 1º.- Algo\n\nANEXO I\nContenido del primer anexo con su tabla.\n\nANEXO II\nOtro contenido que es largo de verdad.\nANEXO III\nX"
    got = one(spark, parse.annexes(F.col("t")), t=t)
    assert [(a["num"], a["num_int"], a["estado_contenido"]) for a in got] == [("I", 1, "real"), ("II", 2, "real"), ("III", 3, "vacio")]
    assert [t[a["start"] : a["end"]].strip()[:7].strip() for a in got] == ["ANEXO I", "ANEXO I", "ANEXO I"]
    assert one(spark, parse.annexes(F.col("t")), t="Se aprueba el ANEXO I que forma parte") == []
    assert one(spark, parse.annexes(F.col("t")), t="segun el\nANEXO I\nque forma parte de la presente norma municipal") == []


def test_articles_offsets(spark):
    t = "ARTÍCULO 1º.- Uno.\n\nArtículo 2.- Dos\nANEXO I\nfuera\nARTÍCULO 3 - TRES"
    got = one(spark, parse.articles(F.col("t")), t=t)
    assert [a["num"] for a in got] == [1, 2, 3]
    assert [a["texto"] for a in got] == ["Uno.", "Dos ANEXO I", "TRES"]
    assert got[0]["start"] == 0
    assert t[got[2]["start"] :].lstrip().startswith("ARTÍCULO 3")


def test_header(spark):
    t = "# UNID: AB12CD\nOrdenanza N° 10328, Año 2014\n\n  Registro de casas\nPublicación: 3/9/2014\nBoletín Oficial N° 77\nNORMA DE CARÁCTER GENERAL\n"
    h = one(spark, parse.header(F.col("t")), t=t)
    assert (h["unid"], h["tipo_norma"], h["numero"], h["anio"], h["titulo_corto"]) == ("AB12CD", "ordenanza", "10328", 2014, "Registro de casas")
    assert (h["fecha_publicacion"], h["boletin_oficial"], h["categoria"]) == ("2014-03-09", "77", "general")
    empty = one(spark, parse.header(F.col("t")), t="nada")
    assert all(v is None for v in empty.asDict().values())


def test_doc_id(spark):
    for t, want in (("Resolución N° 5, Año 2001\n", "resolucion_5_2001"), ("# UNID: ABCDEF0123456789\nx", "unid_abcdef012345"), ("x", "doc_desconocido")):
        assert one(spark, chunks.doc_id(parse.header(F.col("t"))), t=t) == want


def test_pieces(spark):
    t = "ab" * 2000
    got = one(spark, chunks.pieces(F.col("t")), t=t)
    assert [len(x) for x in got] == [1500, 1500, 1400]
    assert one(spark, chunks.pieces(F.col("t")), t="") == []
    assert one(spark, chunks.pieces(F.col("t")), t=" x ") == [" x "]


def test_years_and_numbers(spark):
    for y, want in (("07", 2007), ("59", 2059), ("60", 1960), ("99", 1999), ("2014", 2014)):
        assert one(spark, chunks.full_year(F.col("t")), t=y) == want
    assert one(spark, chunks.norm_number(F.col("t")), t="10.728") == "10728"
    assert str(one(spark, chunks.spanish_date(F.col("t")), t="19 mar. 2026")) == "2026-03-19"
    assert one(spark, chunks.spanish_date(F.col("t")), t="31 feb. 2026") is None
