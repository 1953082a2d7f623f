"""Quarantine of failing documents, text files under their names, and the listing as a stream."""

import pytest

from estrado.operators import quarantine
from estrado.sources import corpus, listing, textfiles
from estrado.streaming.ingest import listed_norms

NORM = "Ordenanza N° 5, Año 2001\n\nARTÍCULO 1º.- Dispone algo de interés.\n"


def test_failing_documents_end_in_the_log(spark, tmp_path):
    for name, data in {"a": NORM.encode(), "bad": b"\xff\xfe no", "boom": ("BOOM " + NORM).encode(), "empty": b" \n", "b": NORM.replace("N° 5", "N° 6").encode()}.items():
        (tmp_path / "Ordenanza").mkdir(exist_ok=True)
        (tmp_path / "Ordenanza" / f"{name}.txt").write_bytes(data)

    def prepare(row):
        if row["contenido"].startswith("BOOM"):
            raise RuntimeError("no se puede leer")
        yield {"contenido": row["contenido"]}

    chunks, log = quarantine.process_folder(spark, str(tmp_path), prepare)
    assert sorted(r["doc_id"] for r in chunks.collect()) == ["ordenanza_5_2001", "ordenanza_6_2001"]
    told = {r["path"].rsplit("/", 1)[1]: r for r in log.collect()}
    assert {k: (r["stage"], r["error_type"]) for k, r in told.items()} == {"bad.txt": ("lectura", "UnicodeDecodeError"), "boom.txt": ("preparación", "RuntimeError"), "empty.txt": ("división", "SinChunks")}
    assert "no se puede leer" in told["boom.txt"]["message"] and "in prepare" in told["boom.txt"]["trace"]


def test_guarded_rows_that_do_not_fit_the_schema(spark):
    rows = spark.createDataFrame([(1, "3"), (2, "x"), (3, None), (4, "40")], "k int, v string")
    good, log = quarantine.guarded(rows, lambda r: [{"n": int(r["v"])}] * 2 if r["k"] < 4 else [{"n": "no number"}], "n long", "k", "número")
    assert sorted(map(tuple, good.collect())) == [(1, 3), (1, 3)]
    assert {r["k"]: r["error_type"] for r in log.collect()} == {2: "ValueError", 3: "TypeError", 4: "ArrowInvalid"}


DOCS = "carpeta string, nombre string, contenido string"


def test_text_files_under_their_names(spark, tmp_path):
    rows = [("Ordenanza", "1-2001 - a/b?.txt", "uno\nmás\n"), ("Ordenanza", "1-2001 - a|b?.txt", "dos"), ("Ordenanza", "x", "tres"), ("Ordenanza", "X", "cuatro"), ("Ordenanza", "x (2)", "cinco"), ("Ordenanza", "x (2)", ""), ("Res/../ol", None, None), ("Ordenanza", "ñ" * 300, "largo")]
    textfiles.write_named(spark.createDataFrame(rows, DOCS).repartition(3), str(tmp_path / "out"))
    got = [(r["carpeta"], r["nombre"], r["contenido"]) for r in corpus.documents(spark, str(tmp_path / "out")).collect()]
    files = sorted((tmp_path / "out").glob("*/*.txt"))
    assert sorted(p.read_bytes().decode() for p in files) == sorted(r[2] or "" for r in rows)
    assert sorted(x[2] for x in got) == sorted(r[2] for r in rows if r[2])  # Spark's readers skip files without a byte
    names = sorted(p.name for p in files if p.parent.name == "Ordenanza")
    assert len(set(names)) == 7 and {"1-2001 - a_b_.txt", "1-2001 - a_b_ (2).txt", "x (2) (1).txt", "x (2) (2).txt"} <= set(names)
    assert not [p for p in (tmp_path / "out").iterdir() if p.name.startswith("_")]


def test_a_failed_write_leaves_nothing(spark, tmp_path):
    spark.dataSource.register(textfiles.TextFiles)
    docs = textfiles.named(spark.createDataFrame([("a", f"n{i}", "x") for i in range(20)], DOCS).repartition(4))
    with pytest.raises(Exception, match="can't write"):
        docs.write.format("named_texts").option("path", str(tmp_path / "out")).option("stopAt", "n7.txt").mode("append").save()
    assert not list((tmp_path / "out").rglob("*")) if (tmp_path / "out").exists() else True


def stored_pages(page, options):
    """Two norms a page, newest first, from a file that a test changes between batches."""
    import json

    rows = sorted(json.loads(open(options["file"]).read()), key=lambda r: r["fecha"], reverse=True)
    return {"rows": rows[2 * page - 2 : 2 * page], "last_page": max(1, -(-len(rows) // 2))}


def norm(n, fecha):
    return {"id_pdf": f"p{n}", "numero": n, "anio": 2024, "fecha": fecha, "fecha_texto": fecha, "resumen": "r", "url_pdf": "u", "raw": "{}"}


def test_listing_as_a_stream(spark, tmp_path):
    import json

    held = spark.createDataFrame([(2, 2024)], "numero int, anio int")
    file = tmp_path / "listing.json"

    def batch(rows):
        file.write_text(json.dumps(rows))
        spark.dataSource.register(listing.Listing)
        stream = listed_norms(spark, held, fetcher="tests.test_sinks:stored_pages", file=str(file), wait="0", lookbackDays="20")
        q = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination()
        return sorted(r["numero"] for r in spark.read.parquet(str(tmp_path / "out")).collect())

    first = [norm(1, "2024-01-05"), norm(2, "2024-02-01"), norm(3, "2024-02-10")]
    assert batch(first) == [1, 3]
    assert batch(first) == [1, 3]
    assert batch([*first, norm(4, "2024-02-12"), norm(5, "2024-02-05")]) == [1, 3, 4, 5]  # 5 is late, within the window
    assert batch([*first, norm(4, "2024-02-12"), norm(5, "2024-02-05"), norm(6, "2024-02-11")]) == [1, 3, 4, 5, 6]


def test_counters_come_with_the_write(spark, tmp_path):
    from estrado.operators import acquire, answer

    rows = [(True, False, "ok"), (True, False, "ok_dry_run"), (True, True, None), (False, False, None), (True, False, "error_descarga"), (True, False, "fallido_validacion"), (True, False, "error_extraccion")]
    told, counters = acquire.observed(spark.createDataFrame(rows, "en_ventana boolean, ya_existe boolean, status string").repartition(3))
    told.write.parquet(str(tmp_path / "norms"))
    assert counters.get == {"descubiertas": 7, "en_ventana": 6, "ya_existen": 1, "ok": 2, "fallidas_validacion": 1, "errores_descarga": 1, "errores_extraccion": 1}
    told, totals = answer.with_usage(spark.createDataFrame([(1, 1_000_000, 500_000), (2, 500, 100), (3, None, None)], "query_id int, tokens_in long, tokens_out long"))
    told.write.parquet(str(tmp_path / "answers"))
    assert totals.get == {"respuestas": 3, "tokens_in": 1_000_500, "tokens_out": 500_100, "costo_usd": pytest.approx(6.0018)}
    assert [r["costo_usd"] for r in spark.read.parquet(str(tmp_path / "answers")).orderBy("query_id").collect()] == [6.0, 0.0018, None]
