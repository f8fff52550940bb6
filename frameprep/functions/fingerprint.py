"""Dataset fingerprint (S6): a key for "has this frame been analysed already?".

Rows have no order in Spark, so the fingerprint is order-insensitive: the
count, the sum and the xor of a 64-bit hash per row, plus the schema and the
target name. ``xxhash64`` skips NULL inputs, so a null mask is hashed with the
row to keep (1, NULL) and (NULL, 1) apart. One aggregate, no shuffle.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def row_hash(df: DataFrame):
    cols = [F.array_sort(F.map_entries(f.name)) if isinstance(f.dataType, T.MapType) else F.col(f.name) for f in df.schema.fields]
    mask = F.concat_ws("", *[F.when(c.isNull(), F.lit("1")).otherwise(F.lit("0")) for c in cols]) if cols else F.lit("")
    return F.xxhash64(mask, *cols)


def fingerprint(df: DataFrame, target: str | None = None) -> str:
    h = row_hash(df)
    row = df.agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(h.cast("decimal(38,0)")).alias("s"),
        F.bit_xor(h).alias("x"),
    ).first()
    text = f"{df.schema.simpleString()}|{target}|{row['n']}|{row['s']}|{row['x']}"
    return hashlib.md5(text.encode()).hexdigest()
