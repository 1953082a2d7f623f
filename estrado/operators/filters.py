"""Metadata filters: a small dictionary compiled to a Column condition."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dense(where: dict | None) -> Column:
    """Conditions of the vector side: equality, ``$eq``, ``$ne`` (true for rows that lack the field) and ``$and``."""
    out = F.lit(True)
    for key, want in (where or {}).items():
        if key == "$and":
            for part in want:
                out = out & dense(part)
        elif isinstance(want, dict):
            for op, value in want.items():
                if op not in ("$eq", "$ne"):
                    raise ValueError(f"unknown operator {op}")
                same = F.col(key).eqNullSafe(F.lit(value))
                out = out & (same if op == "$eq" else ~same)
        else:
            out = out & F.col(key).eqNullSafe(F.lit(want))
    return out


def sparse(where: dict | None) -> Column:
    """Conditions of the lexical side: equalities only; an operator never equals a value, so it matches nothing."""
    out = F.lit(True)
    for key, want in (where or {}).items():
        out = out & (F.lit(False) if key == "$and" or isinstance(want, dict) else F.col(key).eqNullSafe(F.lit(want)))
    return out
