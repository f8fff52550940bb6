"""Schema evidence and conversion.

Evidence for all columns comes from one aggregate (missing counts, numeric and
datetime parse counts under every candidate format), the shared table of value
hashes (distinct and top counts) and one narrow scan a column for its sample values, which
come in file order where the frame is read from files. Conversions are one projection;
duplicates are removed first, on the raw columns.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from frameprep.functions.coerce import (
    DATETIME_FORMATS,
    DATETIME_HINT,
    as_number,
    normalise_value,
    parse_datetime,
    type_name,
)
from frameprep.functions.locate import SEEN, row_locator
from frameprep.functions.report import frame, pct, round_half_away
from frameprep.operators.duplicates import apply_duplicate_action
from frameprep.functions.stats import order_exact, order_number, value_hashes
from frameprep.operators.profile import is_missing

# --- fixed values -----------------------------------------------------------
SCHEMA_ACTIONS = (
    "No Action", "Convert to Numeric", "Convert to Datetime", "Convert to Categorical",
    "Drop Column", "Treat as Identifier",
)
IDENTIFIER_PCT = 95.0
SAMPLE_SIZE = 5
# ---------------------------------------------------------------------------

SAMPLE_COLUMNS = 50  # columns whose samples one job fetches

EVIDENCE_DDL = (
    "column_name STRING, dtype STRING, total_count BIGINT, missing_count BIGINT, missing_percentage DOUBLE, "
    "unique_count BIGINT, unique_percentage DOUBLE, numeric_conversion_percentage DOUBLE, "
    "date_conversion_percentage DOUBLE, datetime_format STRING, is_empty BOOLEAN, is_constant BOOLEAN, "
    "is_identifier_candidate BOOLEAN, sample_values STRING, top_count BIGINT"
)
SUMMARY_DDL = (
    "column_name STRING, action STRING, type_before STRING, type_after STRING, rows BIGINT, "
    "duplicate_rows BIGINT, rows_removed BIGINT"
)

_TEMPORAL = (T.DateType, T.TimestampType, T.TimestampNTZType)


def _evidence_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if not isinstance(f.dataType, (T.MapType, T.ArrayType, T.StructType, T.BinaryType))]


def sample_plan(df: DataFrame, cols: list[str], order_by: str | None = None, k: int = SAMPLE_SIZE) -> DataFrame:
    """(column, value): the first ``k`` non-missing values of each column, in order. A
    column is a scan of its own that reads nothing else and keeps ``k`` rows a task in a
    heap (``TakeOrderedAndProject``): no row is sorted or shuffled."""
    order = F.col(order_by) if order_by is not None else row_locator(df)
    keys = [] if order is None else [order.alias(SEEN)]
    types = {f.name: f.dataType for f in df.schema.fields}
    parts = []
    for c in cols:
        if order is not None and order_by is None:  # a place is one row's alone: only the rows kept are written as text
            value = normalise_value(F.col(c), types[c])
            first = df.where(value.isNotNull()).select(F.col(c), *keys).orderBy(SEEN).limit(k)
            parts.append(first.select(F.lit(c).alias("column"), value.alias("value")))
            continue
        part = df.select(F.lit(c).alias("column"), normalise_value(F.col(c), types[c]).alias("value"), order_number(c, types[c]).alias("num"),
                         order_exact(c, types[c]).alias("exact"), *keys).where(F.col("value").isNotNull())
        parts.append(part.orderBy(*[SEEN] * len(keys), F.asc_nulls_last("num"), F.asc_nulls_last("exact"), "value").limit(k).select("column", "value"))
    return reduce(DataFrame.unionAll, parts)


def sample_values(df: DataFrame, cols: list[str], order_by: str | None = None, k: int = SAMPLE_SIZE) -> dict[str, str]:
    """First ``k`` non-missing values of each column as text: by ``order_by`` (ties by value);
    without it in file order; of a frame that does not come from files, the ``k`` smallest."""
    got: dict[str, list[str]] = {c: [] for c in cols}
    for at in range(0, len(cols), SAMPLE_COLUMNS):
        for r in sample_plan(df, cols[at:at + SAMPLE_COLUMNS], order_by, k).collect():  # k rows a column, in order
            got[r["column"]].append(r["value"])
    return {c: ",".join(v) for c, v in got.items()}


def _format_counts(df: DataFrame, cols: list[str]) -> dict[str, list[int]]:
    """How many values of each text column every candidate format reads. Text that cannot be
    a date is dropped by one search, before the aggregate that holds all the parsers."""
    out = {c: [0] * len(DATETIME_FORMATS) for c in cols}
    if not cols:
        return out
    maybe = [F.when(F.col(c).rlike(DATETIME_HINT), F.struct(F.lit(i).alias("at"), F.col(c).cast("string").alias("text"))) for i, c in enumerate(cols)]
    texts = df.select(F.explode(F.array(*maybe)).alias("s")).where("s is not null").select("s.at", "s.text")
    for r in texts.groupBy("at").agg(*[F.count(parse_datetime(F.col("text"), f)).alias(f"d{j}") for j, (f, _) in enumerate(DATETIME_FORMATS)]).collect():
        out[cols[r["at"]]] = [int(r[f"d{j}"]) for j in range(len(DATETIME_FORMATS))]
    return out


def analyze_schema(df: DataFrame, order_by: str | None = None, exact: bool = True) -> DataFrame:
    """One evidence row per column, in column order. An already numeric
    column has datetime % 0; a text column is parsed under every candidate
    format and the format that reads the most values is reported."""
    cols = _evidence_columns(df)
    exprs = [F.count(F.lit(1)).alias("n")]
    for i, c in enumerate(cols):
        dt = df.schema[c].dataType
        exprs.append(F.count_if(is_missing(df, c)).alias(f"m{i}"))
        exprs.append(F.count(as_number(df, c)).alias(f"num{i}"))
    row = df.agg(*exprs).first()
    n = int(row["n"])
    formats = _format_counts(df, [c for c in cols if isinstance(df.schema[c].dataType, T.StringType)])
    if exact:
        freq = value_hashes(df, cols)
        per = {r["column"]: (int(r["d"]), int(r["top"]))
               for r in freq.groupBy("column").agg(F.count(F.lit(1)).alias("d"), F.max("cnt").alias("top")).collect()}
        dist = {c: per.get(c, (0, None))[0] for c in cols}
        tops = {c: per.get(c, (0, None))[1] for c in cols}
        samples = sample_values(df, cols, order_by)
    else:  # opt-in: sketches for distincts, no frequency table, no top counts
        from frameprep.operators.profile import distinct_counts

        dist = distinct_counts(df, cols, exact=False)
        tops = {c: None for c in cols}
        samples = sample_values(df, cols, order_by or (None if row_locator(df) is not None else cols[0])) if cols else {}
    rows = []
    for i, c in enumerate(cols):
        dt = df.schema[c].dataType
        miss = int(row[f"m{i}"])
        present = n - miss
        uniq = dist[c]
        upct = pct(uniq, present)
        fmt = None
        if isinstance(dt, T.StringType):
            counts = formats[c]
            best = max(range(len(counts)), key=lambda j: (counts[j], -j))
            date_ok = counts[best]
            fmt = DATETIME_FORMATS[best][0] if date_ok > 0 else None
        elif isinstance(dt, _TEMPORAL):
            date_ok = present
        else:
            date_ok = 0
        num_ok = 0 if isinstance(dt, _TEMPORAL) else int(row[f"num{i}"])
        rows.append({
            "column_name": c,
            "dtype": type_name(dt),
            "total_count": n,
            "missing_count": miss,
            "missing_percentage": round_half_away(pct(miss, n), 2),
            "unique_count": uniq,
            "unique_percentage": round_half_away(upct, 2),
            "numeric_conversion_percentage": round_half_away(pct(num_ok, present), 2),
            "date_conversion_percentage": round_half_away(pct(date_ok, present), 2),
            "datetime_format": fmt,
            "is_empty": present == 0,
            "is_constant": uniq <= 1 and present > 0,
            "is_identifier_candidate": upct >= IDENTIFIER_PCT and n > 0,
            "sample_values": samples[c],
            "top_count": tops[c],
        })
    return frame(df.sparkSession, rows, EVIDENCE_DDL)


def best_datetime_formats(df: DataFrame, cols: list[str]) -> dict[str, str | None]:
    """The candidate format that reads the most values of each text column, in one pass."""
    out = {}
    for c, counts in _format_counts(df, cols).items():
        best = max(range(len(counts)), key=lambda j: (counts[j], -j))
        out[c] = DATETIME_FORMATS[best][0] if counts[best] > 0 else None
    return out


def best_datetime_format(df: DataFrame, column: str) -> str | None:
    return best_datetime_formats(df, [column])[column]


def conversion(df: DataFrame, column: str, action: str, datetime_format: str | None = None):
    """C4-C9 as a column expression (None means: drop the column)."""
    dt = df.schema[column].dataType
    c = F.col(column)
    if action == "Convert to Numeric":
        return as_number(df, column) if not isinstance(dt, _TEMPORAL) else F.lit(None).cast("double")
    if action == "Convert to Datetime":
        if isinstance(dt, _TEMPORAL):
            return c.cast("timestamp_ntz")
        if isinstance(dt, T.StringType):
            fmt = datetime_format or best_datetime_format(df, column)
            return parse_datetime(c, fmt) if fmt else F.lit(None).cast("timestamp_ntz")
        return F.lit(None).cast("timestamp_ntz")
    if action == "Convert to Categorical":
        return c.cast("string").alias(column, metadata={"role": "categorical"})
    if action == "Treat as Identifier":
        return c.alias(column, metadata={"role": "identifier"})
    if action == "No Action":
        return c
    if action == "Drop Column":
        return None
    raise ValueError(f"Unknown schema action: {action}")


def apply_schema_action(df: DataFrame, column: str, action: str, datetime_format: str | None = None) -> DataFrame:
    expr = conversion(df, column, action, datetime_format)
    if expr is None:
        return df.drop(column)
    return df.withColumn(column, expr)


def apply_schema_actions(
    df: DataFrame, actions, duplicate_action: str = "Keep Duplicates", formats: dict[str, str] | None = None,
    record: list | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Duplicates first (on the raw columns), then every column action in
    one projection. Summary: one dataset row, then one row per column."""
    actions = list(actions.items()) if isinstance(actions, dict) else list(actions)
    for _, a in actions:
        if a not in SCHEMA_ACTIONS:
            raise ValueError(f"Unknown schema action: {a}")
    formats = dict(formats or {})
    spark = df.sparkSession
    from frameprep.operators.duplicates import duplicate_count

    rows_before, dups = duplicate_count(df)
    out = apply_duplicate_action(df, duplicate_action)
    rows_after = rows_before - dups if duplicate_action == "Remove Duplicates" else rows_before
    summary = [{
        "column_name": "Dataset", "action": duplicate_action, "type_before": "N/A", "type_after": "N/A",
        "rows": rows_before, "duplicate_rows": dups, "rows_removed": rows_before - rows_after,
    }]
    actions = [(c, a) for c, a in actions if c in df.columns]
    exprs, drops = {}, []
    open_ = [c for c, a in actions if a == "Convert to Datetime" and c not in formats
             and isinstance(out.schema[c].dataType, T.StringType)]
    formats |= best_datetime_formats(out, open_)  # one pass for all columns that came without evidence
    for c, a in actions:
        if record is not None:
            record.append((c, a, formats.get(c)))
        e = conversion(out, c, a, formats.get(c))
        if e is None:
            drops.append(c)
        else:
            exprs[c] = e
    before_types = {f.name: type_name(f.dataType) for f in out.schema.fields}
    out = (out.withColumns(exprs) if exprs else out).drop(*drops)
    after_types = {f.name: type_name(f.dataType) for f in out.schema.fields}
    for c, a in actions:
        summary.append({
            "column_name": c, "action": a, "type_before": before_types[c],
            "type_after": "Dropped" if c in drops else after_types[c], "rows": rows_after,
        })
    return out, frame(spark, summary, SUMMARY_DDL)
