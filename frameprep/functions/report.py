"""Small helpers to turn fitted scalars (one row per column at most) into
DataFrames with a fixed schema, and the rounding rule used for evidence."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def round_half_away(x: float | None, digits: int) -> float | None:
    """Round half away from zero on ``x * 10**digits`` (the SQL ``round`` of DuckDB)."""
    if x is None:
        return None
    x = float(x)
    if math.isnan(x) or math.isinf(x):
        return x
    m = 10.0 ** digits
    y = abs(x) * m
    r = math.floor(y)
    if y - r >= 0.5:
        r += 1
    return math.copysign(r / m, x)


def fixed(c: Column, digits: int = 6) -> Column:
    """Deterministic rounding as plain IEEE arithmetic, written the same way in
    the DuckDB oracle: ``sign(x) * floor(abs(x) * 1eD + 0.5) / 1eD``."""
    m = F.lit(10.0 ** digits)
    return F.signum(c) * F.floor(F.abs(c) * m + F.lit(0.5)) / m


def fixed_sql(expr: str, digits: int = 6) -> str:
    """The SQL text of :func:`fixed` for the oracle side."""
    m = f"1e{digits}"
    return f"(sign({expr}) * floor(abs({expr}) * {m} + 0.5) / {m})"


def frame(spark: SparkSession, rows: list[dict], ddl: str) -> DataFrame:
    """Rows (dicts) -> DataFrame with the given DDL schema, columns in DDL order."""
    names = [part.strip().split(" ")[0].strip("`") for part in _split_ddl(ddl)]
    data = [tuple(r.get(n) for n in names) for r in rows]
    return spark.createDataFrame(data, ddl)


def _split_ddl(ddl: str) -> list[str]:
    parts, depth, cur = [], 0, []
    for ch in ddl:
        if ch in "<(":
            depth += 1
        elif ch in ">)":
            depth -= 1
        if ch == "," and depth == 0:
            parts.append("".join(cur))
            cur = []
        else:
            cur.append(ch)
    if cur:
        parts.append("".join(cur))
    return parts


def pct(part: int | float, whole: int | float) -> float:
    return part / whole * 100.0 if whole else 0.0
