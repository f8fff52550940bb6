"""Replace a column's values through a fitted (key -> value) table.

The table has one row per distinct value of the column, so its size is only
known after fitting. It is counted first and then applied the cheapest way
its size allows:

* up to ``LITERAL_MAX`` keys: a literal ``CASE`` map inside the projection
  (no join, stays in whole-stage codegen);
* up to ``BROADCAST_MAX`` keys and ``BROADCAST_MAX_BYTES`` of keys and values:
  a broadcast hash join (size measured here, not guessed by the planner);
* beyond: a shuffle join on the key. A hot key on the large side is split by
  adaptive execution's skew-join handling.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LITERAL_MAX = 256
BROADCAST_MAX = 2_000_000
BROADCAST_MAX_BYTES = 64 * 1024 * 1024


def lookup_column(df: DataFrame, column: str, mapping: DataFrame, value_col: str = "value", out_type: str = "double") -> DataFrame:
    """``df`` with ``column`` replaced by ``mapping[value_col]`` for its key
    (NULL where the key is missing or unknown). Column order is kept."""
    key_type = df.schema[column].dataType
    mapping = mapping.select(F.col("key").cast(key_type).alias("key"), F.col(value_col).cast(out_type).alias("__val"))
    stats = mapping.agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.coalesce(F.length(F.col("key").cast("string")), F.lit(0)) + F.lit(16)).alias("bytes"),
    ).first()
    n, size = int(stats["n"]), int(stats["bytes"] or 0)
    if n <= LITERAL_MAX:
        pairs = mapping.collect()
        expr = _literal_map(F.col(column), [(r["key"], r["__val"]) for r in pairs], out_type)
        return df.withColumn(column, expr)
    tagged = df.withColumn("__key", F.col(column))
    right = mapping.withColumnRenamed("key", "__key")
    if n <= BROADCAST_MAX and size <= BROADCAST_MAX_BYTES:
        right = F.broadcast(right)
    joined = tagged.join(right, "__key", "left")
    return joined.select(*[F.col("__val").alias(c) if c == column else F.col(c) for c in df.columns])


def _literal_map(col: Column, pairs, out_type: str) -> Column:
    if not pairs:
        return F.lit(None).cast(out_type)
    expr = None
    for k, v in pairs:
        if k is None:
            continue
        cond = col == F.lit(k)
        expr = F.when(cond, F.lit(v).cast(out_type)) if expr is None else expr.when(cond, F.lit(v).cast(out_type))
    return expr if expr is not None else F.lit(None).cast(out_type)
