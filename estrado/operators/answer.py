"""Answers with sources: two-phase retrieval, numbered context, a pluggable synthesizer, and deterministic citations."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..functions.cite import numbered_context, sources
from ..functions.text import llm_cost_usd
from .search import Bm25, two_phase, with_texts

#: Texts of an answer.
DISCLAIMER = "Esta respuesta es orientativa y no constituye asesoramiento legal. Verifique siempre el texto oficial de la norma."
NOTHING = "No se encontraron normas relevantes para la consulta."


def embed(df: DataFrame, embedder: Callable[[Column], Column], text: str = "texto", out: str = "embedding") -> DataFrame:
    """Adds a vector column with a pluggable embedder, a function from a Column to a Column (a pandas UDF, as a rule)."""
    return df.withColumn(out, embedder(F.col(text)))


def embed_in_batches(df: DataFrame, fetch: Callable[[list[str]], list], text: str = "texto", out: str = "embedding", batch_size: int = 200, retries: int = 5, first_wait: float = 1.0) -> DataFrame:
    """Adds a vector column from a service: ``fetch`` takes a list of at most ``batch_size`` texts and returns as many vectors.

    A call that fails with an OSError is tried again after waits that double, ``retries`` times in all; then the task fails. Null texts have null vectors.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (b.slice(at, batch_size) for b in batches for at in range(0, b.num_rows, batch_size)):
            texts = b.column(b.schema.get_field_index(text)).to_pylist()
            asked = [t for t in texts if t is not None]
            for attempt in range(1, retries + 1):
                try:
                    got = iter(fetch(asked) if asked else [])
                    break
                except OSError:
                    if attempt == retries:
                        raise
                    time.sleep(first_wait * 2 ** (attempt - 1))
            yield pa.record_batch([*b.columns, pa.array([None if t is None else next(got) for t in texts], pa.list_(pa.float64()))], names=[*b.schema.names, out])

    return df.mapInArrow(run, df.withColumn(out, F.lit(None).cast("array<double>")).schema)


def with_usage(answers: DataFrame, tokens_in: str = "tokens_in", tokens_out: str = "tokens_out") -> tuple[DataFrame, Observation]:
    """``answers`` with the cost of each (costo_usd), and the batch's sums (respuestas, tokens_in, tokens_out, costo_usd), which come with the write of the answers."""
    totals = Observation(f"usage-{uuid.uuid4().hex}")
    told = answers.withColumn("costo_usd", llm_cost_usd(F.col(tokens_in), F.col(tokens_out)))
    sums = [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in (tokens_in, tokens_out, "costo_usd")]
    return told.observe(totals, F.count(F.lit(1)).alias("respuestas"), *sums), totals


def answer(chunks: DataFrame, index: Bm25, queries: DataFrame, synthesizer: Callable[[Column, Column], Column], n_chunks: int = 12, extra: dict | None = None, texts: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """queries (query_id, query, vector) -> answers (query_id, respuesta, contexto) and sources. Queries without hits get a fixed text. ``texts`` (chunk_id, texto) has the texts, if ``chunks`` has none."""
    hits = two_phase(chunks, index, queries, n_chunks, extra)
    if texts is not None:
        hits = with_texts(hits, texts, queries, n_chunks)
    told = queries.select("query_id", "query").join(numbered_context(hits), "query_id", "left")
    text = F.when(F.col("contexto").isNull(), NOTHING).otherwise(F.concat(synthesizer(F.col("query"), F.col("contexto")), F.lit("\n\n" + DISCLAIMER)))
    return told.select("query_id", text.alias("respuesta"), "contexto"), sources(hits)
