"""Registered queries: one per operator of the inventory, each with the DuckDB
SQL that computes the same answer (when SQL can).

Every query reads whole driver tables (or a derived input computed from whole
tables by SQL) and returns a DataFrame whose column names match the oracle's.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from frameprep.sources.tables import DERIVED

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, oracle: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLE[name] = with_derived(oracle)
        return fn

    return deco


def with_derived(sql: str) -> str:
    """Prefix the derived inputs a query uses as CTEs (the oracle only has the
    driver tables as views)."""
    used = [n for n in DERIVED if n in sql]
    if not used:
        return sql
    ctes = ",\n".join(f"{n} AS ({DERIVED[n]})" for n in used)
    body = sql.lstrip()
    if body[:4].upper() == "WITH":
        return f"WITH {ctes},\n{body[4:]}"
    return f"WITH {ctes}\n{body}"


# modules below add their queries on import
import frameprep.plans.registry  # noqa: E402,F401
