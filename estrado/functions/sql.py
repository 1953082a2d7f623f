"""The library for SQL users: functions that Catalyst inlines, and views of chunks and citations over tables of their own."""

from __future__ import annotations

from pyspark.sql import SparkSession

from . import cite
from .chunks import OVERLAP, PIECE
from .cite import KINDS

FUNCTIONS = {
    "estrado_tokens(t STRING) RETURNS ARRAY<STRING>": r"filter(regexp_extract_all(lower(coalesce(t, '')), '([\\p{L}\\p{N}_]+)', 1), w -> length(w) > 1)",
    "estrado_pieces(t STRING) RETURNS ARRAY<STRING>": (
        f"CASE WHEN coalesce(length(t), 0) = 0 THEN cast(array() AS ARRAY<STRING>) WHEN length(t) <= {PIECE} THEN array(t) ELSE filter(transform("
        f"sequence(0, cast(ceil((length(t) - {PIECE}) / {PIECE - OVERLAP}) AS INT)), i -> regexp_replace(substring(t, i * {PIECE - OVERLAP} + 1, {PIECE}), '(?U)^\\\\s+|\\\\s+$', '')), x -> x <> '') END"),
    "estrado_norm_label(tipo STRING, numero STRING, anio INT, articulo INT) RETURNS STRING": (
        f"concat(CASE {' '.join(f"WHEN tipo = '{k}' THEN '{shown}'" for k, shown in KINDS)} ELSE concat(upper(substr(coalesce(nullif(tipo, ''), 'norma'), 1, 1)), lower(substr(coalesce(nullif(tipo, ''), 'norma'), 2))) END, "
        "' N° ', coalesce(numero, '?'), '/', coalesce(cast(anio AS STRING), '?'), CASE WHEN articulo IS NULL THEN '' ELSE concat(', Art. ', articulo) END)"),
}


def register(spark: SparkSession) -> None:
    """Makes ``estrado_tokens``, ``estrado_pieces`` and ``estrado_norm_label`` temporary functions of the session."""
    for head, body in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")


def citations_view(spark: SparkSession, table: str, view: str) -> None:
    """A temporary view of ``table`` (metadata columns of chunks, any of which may be missing) with ``cita``, ``link`` and ``link_tipo`` added, by ``cite``."""
    rows = spark.table(table)
    at = cite.derived_link(rows)
    rows.select("*", cite.citation(rows).alias("cita"), at["url"].alias("link"), at["tipo"].alias("link_tipo")).createOrReplaceTempView(view)


def chunks_view(spark: SparkSession, table: str, view: str, key: str = "path", text: str = "contenido") -> None:
    """A temporary view of the chunks of ``table`` (key, text), a row each with kind, numbers and parents, as ``operators.chunking`` makes them; SQL joins it to the table by its key."""
    from ..operators.chunking import chunk_documents  # operators build on functions

    chunk_documents(spark.table(table), key, text).createOrReplaceTempView(view)
