"""All registered queries of the library."""

from __future__ import annotations

from . import charter, norms, search, texts

MODULES = (search, norms, charter, texts)


def queries() -> dict:
    return {name: f for m in MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: s for m in MODULES for name, s in m.SQL.items()}
