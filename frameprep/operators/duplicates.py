"""Duplicate evidence and handling.

Counting exact duplicates does not shuffle whole rows: every row is first
reduced to a 64-bit hash (with a null mask), the hashes are grouped, and only
rows whose hash occurs more than once are grouped again on all columns to get
the exact answer (a hash collision can therefore never count as a copy).
Where duplicates are rare the shuffle moves 8 bytes per row; where a row
repeats a billion times, the map-side combine collapses it before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from frameprep.functions.coerce import nan_to_null
from frameprep.functions.report import frame, pct, round_half_away
from frameprep.functions.stats import value_hashes
from frameprep.functions.written import discard, written

# --- fixed values -----------------------------------------------------------
DUPLICATE_ACTIONS = ("Remove Duplicates", "Keep Duplicates")
IDENTIFIER_PCT = 95.0
# ---------------------------------------------------------------------------
BROADCAST_MAX_KEYS = 1_000_000  # a relation of long keys takes about 24 bytes a key: 24 MB


def _folded(df: DataFrame) -> DataFrame:
    """NaN and NULL as one missing value."""
    return df.select(*[
        (nan_to_null(F.col(f.name)).alias(f.name) if isinstance(f.dataType, (T.FloatType, T.DoubleType)) else F.col(f.name))
        for f in df.schema.fields])


def _maps(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.MapType)]


def _comparable(df: DataFrame) -> DataFrame:
    """Maps as sorted entry lists, so that rows with maps can be grouped."""
    maps = _maps(df)
    return df.withColumns({c: F.array_sort(F.map_entries(c)) for c in maps}) if maps else df


def _row_groups(df: DataFrame) -> DataFrame:
    """Count per distinct row; NaN and NULL fold into one missing value."""
    maps = _maps(df)
    g = _comparable(_folded(df)).groupBy(*df.columns).agg(F.count(F.lit(1)).alias("count"))
    return g.withColumns({c: F.map_from_entries(c) for c in maps}) if maps else g


def _hash_key(df: DataFrame):
    """Row hash that agrees with group-by equality: NaN is NULL, -0.0 is 0.0,
    and a null mask keeps (1, NULL) apart from (NULL, 1)."""
    parts, mask = [], []
    for f in df.schema.fields:
        c = F.col(f.name)
        if isinstance(f.dataType, T.MapType):
            c = F.array_sort(F.map_entries(c))
        if isinstance(f.dataType, (T.FloatType, T.DoubleType)):
            c = nan_to_null(c.cast("double"))
            c = F.when(c == 0, F.lit(0.0)).otherwise(c)
        parts.append(c)
        mask.append(F.when(c.isNull(), F.lit("1")).otherwise(F.lit("0")))
    return F.xxhash64(F.concat_ws("", *mask), *parts) if parts else F.lit(0)


def _suspects(df: DataFrame) -> tuple[int, int, DataFrame | None, bool]:
    """(rows, hashes seen more than once, table of them, small enough to broadcast).

    One pass over 8-byte hashes; the table is written once, so that counting it
    and joining it do not hash the rows again."""
    per_hash = df.select(_hash_key(df).alias("__h")).groupBy("__h").agg(F.count(F.lit(1)).alias("c"))
    hot = written(per_hash.where(F.col("c") > 1).select("__h"), "hashes")
    keys = hot.count()
    return df.count(), keys, hot, keys <= BROADCAST_MAX_KEYS


def duplicate_count(df: DataFrame) -> tuple[int, int]:
    """(rows, duplicate rows) exactly, shuffling hashes first and full rows
    only for hashes seen more than once."""
    n, keys, hot, small = _suspects(df)
    try:
        if keys == 0:
            return n, 0
        cand = df.withColumn("__h", _hash_key(df)).join(F.broadcast(hot) if small else hot, "__h", "left_semi").drop("__h")
        g = _row_groups(cand).agg(F.sum("count").alias("n"), F.count(F.lit(1)).alias("g")).first()
        return n, int(g["n"] or 0) - int(g["g"] or 0)
    finally:
        discard(hot)


def duplicate_summary(df: DataFrame) -> DataFrame:
    """Total rows, duplicate rows (copies after the first), % (2 dp)."""
    n, dup = duplicate_count(df)
    return frame(
        df.sparkSession,
        [{"total_rows": n, "duplicate_rows": dup, "duplicate_percentage": round_half_away(pct(dup, n), 2)}],
        "total_rows BIGINT, duplicate_rows BIGINT, duplicate_percentage DOUBLE",
    )


def duplicate_groups(df: DataFrame, drop_null_groups: bool = True) -> DataFrame:
    """Every duplicated row with its count, most frequent first. Like a value
    count over rows, a group holding any missing value is left out unless asked
    for. Only rows whose hash repeats are grouped on all columns."""
    _, _, hot, small = _suspects(df)
    cand = df.withColumn("__h", _hash_key(df)).join(F.broadcast(hot) if small else hot, "__h", "left_semi").drop("__h")
    g = _row_groups(cand).where(F.col("count") > 1)
    if drop_null_groups:
        cond = F.lit(True)
        for c in df.columns:
            cond = cond & F.col(c).isNotNull()
        g = g.where(cond)
    maps = _maps(df)
    return g.orderBy(F.desc("count"), *[c for c in df.columns if c not in maps])


def identifier_candidates(df: DataFrame) -> DataFrame:
    """D3: columns whose distinct count (a missing value counts once) is at
    least 95 % of all rows."""
    cols = [f.name for f in df.schema.fields if not isinstance(f.dataType, (T.MapType, T.ArrayType, T.StructType))]
    freq = value_hashes(df, cols, keep_null=True)
    per = {r["column"]: int(r["d"]) for r in freq.groupBy("column").agg(F.count(F.lit(1)).alias("d")).collect()}
    n = df.count()
    rows = []
    for c in cols:
        u = per.get(c, 0)
        p = pct(u, n)
        if p >= IDENTIFIER_PCT:
            rows.append({"column_name": c, "unique_values": u, "unique_percentage": round_half_away(p, 2)})
    return frame(df.sparkSession, rows, "column_name STRING, unique_values BIGINT, unique_percentage DOUBLE")


def remove_duplicates(df: DataFrame) -> DataFrame:
    """Keep one of each identical row (NULL and NaN are one missing value, 0.0
    equals -0.0). Rows whose hash is unique pass by without a shuffle when the
    repeated hashes are few enough to broadcast."""
    df = _folded(df)
    _, keys, hot, small = _suspects(df)
    if keys == 0:
        return df
    if not small:
        return _row_groups(df).drop("count")
    keyed, hot = df.withColumn("__h", _hash_key(df)), F.broadcast(hot)
    alone = keyed.join(hot, "__h", "left_anti").drop("__h")
    return alone.unionByName(_row_groups(keyed.join(hot, "__h", "left_semi").drop("__h")).drop("count"))


def apply_duplicate_action(df: DataFrame, action: str) -> DataFrame:
    """D4 / D5."""
    if action == "Remove Duplicates":
        return remove_duplicates(df)
    if action == "Keep Duplicates":
        return df
    raise ValueError(f"Unknown duplicate action: {action}")
