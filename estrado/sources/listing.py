"""A paged listing as a Spark data source, fetched by the tasks.

The page fetcher is given by name (``module:function``), so that tests and other sites plug in their own; it takes the page number and
the options and returns a list of rows, or a dictionary with ``rows`` and, if the answer tells it, ``last_page``. Where the last page is told by the
options or by the first answer there is a partition per page; else one partition walks on until a page is empty.
"""

from __future__ import annotations

import importlib
import json
import time
from collections.abc import Iterator
from datetime import date

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

SCHEMA = "id_pdf string, numero int, anio int, fecha_texto string, resumen string, url_pdf string, raw string"


class Page(InputPartition):
    """A page, or with ``walk`` all pages from it on."""

    def __init__(self, number: int, walk: bool = False):
        self.value, self.walk = number, walk


class ListingReader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options

    def fetch(self, page: int) -> tuple[list, int | None]:
        """Rows of a page and the last page, if told. Three attempts, with growing waits in between."""
        module, _, name = self.options["fetcher"].partition(":")
        get, wait = getattr(importlib.import_module(module), name), float(self.options.get("wait", 2))
        for attempt in range(1, 4):
            try:
                got = get(page, dict(self.options))
                return (got["rows"], got.get("last_page")) if isinstance(got, dict) else (got, None)
            except OSError:
                if attempt == 3:
                    raise
                time.sleep(wait * attempt)
        raise AssertionError

    def partitions(self) -> list[Page]:
        first, last = int(self.options.get("firstpage", 1)), self.options.get("lastpage")
        if last is None:
            rows, last = self.fetch(first)
            if not rows:
                return []
        return [Page(first, True)] if last is None else [Page(i) for i in range(first, int(last) + 1)]

    def read(self, partition: Page) -> Iterator[tuple]:
        page = partition.value
        while True:
            rows, last = self.fetch(page)
            for r in rows:
                yield tuple(r.get(k) for k in ("id_pdf", "numero", "anio", "fecha_texto", "resumen", "url_pdf", "raw"))
            if not partition.walk or not rows or (last is not None and page >= last):
                return
            page += 1


class Since(InputPartition):
    """What the listing holds from one date to another, both included."""

    def __init__(self, after: str, until: str):
        super().__init__(json.dumps([after, until]))
        self.after, self.until = after, until


class ListingStream(DataSourceStreamReader):
    """The listing as a stream. Pages are newest first by ``fecha`` (an ISO date in the rows); an offset is the newest date seen.

    A batch walks the pages until one has only older rows than its start less ``lookbackdays``, so that norms that are published late, within that window, come too; rows come
    again then, and ``streaming.ingest.new_norms`` takes each once.
    """

    def __init__(self, options: dict):
        self.pages, self.back = ListingReader(options), int(options.get("lookbackdays", 30))

    def initialOffset(self) -> dict:  # noqa: N802
        return {"fecha": "0001-01-01", "n": 0}

    def latestOffset(self) -> dict:  # noqa: N802
        """The newest date, and how many rows there are of the window before it: a late norm makes a new offset as well."""
        rows = list(self._since(None))
        return {"fecha": max((r["fecha"] for r in rows), default="0001-01-01"), "n": len(rows)}

    def _since(self, after: str | None) -> Iterator[dict]:
        """Rows of the pages from the first on; without ``after``, those of the look-back window before the newest."""
        page = 1
        while True:
            rows, last = self.pages.fetch(page)
            rows = [r for r in rows if r.get("fecha")]
            if after is None and rows:
                after = _back(max(r["fecha"] for r in rows), self.back)
            found = [r for r in rows if after is None or r["fecha"] >= after]
            yield from found
            if not rows or not found or (last is not None and page >= last):
                return
            page += 1

    def partitions(self, start: dict, end: dict) -> list[Since]:
        return [Since(_back(start["fecha"], self.back), end["fecha"])]

    def read(self, partition: Since) -> Iterator[tuple]:
        for r in self._since(partition.after):
            if r["fecha"] <= partition.until:
                yield (*(r.get(k) for k in ("id_pdf", "numero", "anio", "fecha_texto", "resumen", "url_pdf", "raw")), date.fromisoformat(r["fecha"]))


def _back(day: str, days: int) -> str:
    at = date.fromisoformat(day).toordinal() - days
    return date.fromordinal(max(1, at)).isoformat()


class Listing(DataSource):
    """``spark.dataSource.register(Listing)``, then ``spark.read.format("norm_listing").option("fetcher", ...).load()``; lastPage is optional."""

    @classmethod
    def name(cls) -> str:
        return "norm_listing"

    def schema(self) -> str:
        """A stream's rows have their date as well."""
        return SCHEMA + (", fecha date" if {k.lower(): v for k, v in self.options.items()}.get("dated") == "true" else "")

    def streamReader(self, schema) -> ListingStream:  # noqa: N802
        return ListingStream({k.lower(): v for k, v in self.options.items()})

    def reader(self, schema) -> ListingReader:
        return ListingReader({k.lower(): v for k, v in self.options.items()})
