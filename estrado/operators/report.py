"""Reports and events as JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def json_rows(df: DataFrame) -> DataFrame:
    """One JSON text per row, null fields kept."""
    return df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("json"))


def write_json(df: DataFrame, path: str) -> None:
    """Rows as lines of JSON, written by the tasks: chunks, events and lists of any length."""
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def events_report(events: DataFrame, path: str) -> DataFrame:
    """Repeal events as JSON below ``path``: ``eventos`` (a line each), ``docs_derogatorios`` and ``docs_derogados`` (sorted, a line each) and ``resumen`` (one line). Returns the summary."""
    write_json(events, f"{path}/eventos")
    for side in ("derogatorio", "derogado"):
        write_json(events.select(F.col(f"doc_id_{side}").alias("doc_id")).where("doc_id is not null").distinct().orderBy("doc_id"), f"{path}/docs_{side}s")
    total = events.agg(F.count(F.lit(1)).alias("total_eventos"), F.count_distinct("doc_id_derogatorio").alias("docs_derogatorios"), F.count_distinct("doc_id_derogado").alias("docs_derogados"))
    write_json(total, f"{path}/resumen")
    return total
