"""Name -> query and name -> DuckDB SQL for the radar operators."""

from __future__ import annotations

from .plans import queries as documents
from .plans import towns


def queries() -> dict:
    return documents.QUERIES | towns.QUERIES


def oracle_sql() -> dict[str, str]:
    return documents.ORACLES | towns.ORACLES
