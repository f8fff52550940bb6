"""CSV source (S1) with the type inference the reference gets from its reader.

Read every column as text, turn the missing-value words into NULL, then infer
each column's type from one aggregate over all columns: all values integers that
fit -> BIGINT (with a missing value -> DOUBLE, unless a value would lose digits),
all numbers -> DOUBLE, all boolean words -> BOOLEAN, no value at all -> DOUBLE,
else STRING. Quoted fields may hold separators, doubled quotes and line breaks. Files are
read by byte ranges in parallel: a narrow scan looks for a line that leaves a quoted
field open; without one every line is a record, with one ``records`` joins the lines
of a record. ``multiline=False`` skips that scan for files known to hold no such breaks.
Reader options other than the separator use Spark's own multi-line reader (one split a
file). Dates stay text (the
schema stage offers the conversion). Spark's own ``inferSchema`` is not used:
it turns dates into timestamps and knows a single null word.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from frameprep.functions.coerce import NA_WORDS, NUMBER_PATTERN, text_to_number
from frameprep.sources.records import has_quoted_breaks, read_quoted_csv

# --- fixed values -----------------------------------------------------------
INTEGER_PATTERN = r"^\s*[+-]?\d+\s*$"
TRUE_WORDS = ("True", "TRUE", "true")
FALSE_WORDS = ("False", "FALSE", "false")
# ---------------------------------------------------------------------------
EXACT_DOUBLE = 2 ** 53  # larger integers may lose digits as DOUBLE


def read_csv(spark: SparkSession, path: str, multiline: bool = True, **options) -> DataFrame:
    sep = options.get("sep", ",")
    if multiline and set(options) <= {"sep"} and len(sep) == 1:
        if has_quoted_breaks(spark, path, sep):
            return infer_types(read_quoted_csv(spark, path, sep))
        multiline = False
    raw = (
        spark.read.option("header", True).option("inferSchema", False).option("mode", "PERMISSIVE")
        .option("quote", '"').option("escape", '"').option("multiLine", multiline).options(**options).csv(path)
    )
    return infer_types(raw)


def infer_types(raw: DataFrame) -> DataFrame:
    """Text columns -> typed columns, decided by one aggregate pass."""
    cols = raw.columns
    clean = raw.select(*[F.when(~F.col(c).isin(list(NA_WORDS)), F.col(c)).alias(c) for c in cols])
    exprs = []
    for i, c in enumerate(cols):
        v = F.col(c)
        whole = F.when(v.rlike(INTEGER_PATTERN), F.trim(v).try_cast("bigint"))
        exprs += [
            F.count(v).alias(f"n{i}"),
            F.count(whole).alias(f"i{i}"),
            F.count_if(F.abs(whole.cast("decimal(20,0)")) > EXACT_DOUBLE).alias(f"w{i}"),
            F.count_if(v.rlike(NUMBER_PATTERN) | text_to_number(v).isNotNull()).alias(f"f{i}"),
            F.count_if(v.isin(list(TRUE_WORDS + FALSE_WORDS))).alias(f"b{i}"),
        ]
    row = clean.agg(F.count(F.lit(1)).alias("rows"), *exprs).first()
    rows = int(row["rows"])
    out = []
    for i, c in enumerate(cols):
        n = int(row[f"n{i}"])
        v = F.col(c)
        if n == 0:
            out.append(F.lit(None).cast("double").alias(c))
        elif row[f"i{i}"] == n:
            out.append(F.trim(v).cast("bigint" if n == rows or row[f"w{i}"] else "double").alias(c))
        elif row[f"f{i}"] == n:
            out.append(text_to_number(v).alias(c))
        elif row[f"b{i}"] == n:
            out.append(v.isin(list(TRUE_WORDS)).alias(c) if n == rows else
                       F.when(v.isNotNull(), v.isin(list(TRUE_WORDS))).cast("string").alias(c))
        else:
            out.append(v.alias(c))
    return clean.select(*out)
