"""Registered queries of the geometry engine, with their SQL."""

from __future__ import annotations


def queries() -> dict:
    from quadra.plans import composite, scalars

    return {**composite.QUERIES, **scalars.QUERIES}


def oracle_sql() -> dict[str, str]:
    from quadra.plans import composite, scalars

    return {**composite.ORACLE_SQL, **scalars.ORACLE_SQL}
