"""All queries of the risk engine and their SQL, by name."""

from __future__ import annotations

from .queries import QUERIES, SQL, analyses, files, formulas, models, scalars  # noqa: F401


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
