"""Column coercions shared by every stage: text to number, text to datetime,
NaN to NULL, and the type tests that give a column its role.

All of it is built from ``pyspark.sql.functions`` so it stays inside
whole-stage codegen; nothing here runs Python per row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# --- fixed values -----------------------------------------------------------
# Words a CSV reader takes as "missing" (the pandas ``read_csv`` default list).
NA_WORDS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None",
    "n/a", "nan", "null",
)
# Text accepted as a number: optional sign, digits with an optional point,
# or a point and digits, optional exponent, spaces around allowed.
NUMBER_PATTERN = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"
INFINITY_PATTERN = r"^\s*[+-]?(?i:inf|infinity)\s*$"
# Datetime formats tried for text columns, most specific first:
# (Spark pattern, DuckDB strptime pattern).
DATETIME_FORMATS = (
    ("yyyy-MM-dd HH:mm:ss", "%Y-%m-%d %H:%M:%S"),
    ("yyyy-MM-dd'T'HH:mm:ss", "%Y-%m-%dT%H:%M:%S"),
    ("yyyy-MM-dd", "%Y-%m-%d"),
    ("yyyy/MM/dd", "%Y/%m/%d"),
    ("MM/dd/yyyy", "%m/%d/%Y"),
    ("dd/MM/yyyy", "%d/%m/%Y"),
    ("dd-MM-yyyy", "%d-%m-%Y"),
    ("dd MMM yyyy", "%d %b %Y"),
    ("MMM dd, yyyy", "%b %d, %Y"),
    ("dd MMMM yyyy", "%d %B %Y"),
    ("MMMM dd, yyyy", "%B %d, %Y"),
    ("yyyy-MM-dd HH:mm", "%Y-%m-%d %H:%M"),
    ("yyyy-MM-dd'T'HH:mm", "%Y-%m-%dT%H:%M"),
    ("yyyy/MM/dd HH:mm:ss", "%Y/%m/%d %H:%M:%S"),
    ("yyyy/MM/dd HH:mm", "%Y/%m/%d %H:%M"),
    ("MM/dd/yyyy HH:mm:ss", "%m/%d/%Y %H:%M:%S"),
    ("MM/dd/yyyy HH:mm", "%m/%d/%Y %H:%M"),
    ("dd/MM/yyyy HH:mm:ss", "%d/%m/%Y %H:%M:%S"),
    ("dd/MM/yyyy HH:mm", "%d/%m/%Y %H:%M"),
    ("MM/dd/yyyy hh:mm:ss a", "%m/%d/%Y %I:%M:%S %p"),
    ("MM/dd/yyyy hh:mm a", "%m/%d/%Y %I:%M %p"),
    ("yyyy-MM-dd hh:mm:ss a", "%Y-%m-%d %I:%M:%S %p"),
    ("yyyy-MM-dd hh:mm a", "%Y-%m-%d %I:%M %p"),
    ("yyyyMMdd", "%Y%m%d"),
)
# What may follow the seconds of a time: a fraction, then Z or an offset from UTC.
TIME_TAIL = r"(\.\d{1,9})?\s*(Z|[+-]\d{2}:?\d{2})?"
# The shape a value must have before a format is even tried (a cheap regex
# in front of the parser, which is slow on text that cannot match).
DATETIME_SHAPES = {
    "yyyy-MM-dd HH:mm:ss": r"^\s*\d{4}-\d{1,2}-\d{1,2} \d{1,2}:\d{1,2}:\d{1,2}" + TIME_TAIL + r"\s*$",
    "yyyy-MM-dd'T'HH:mm:ss": r"^\s*\d{4}-\d{1,2}-\d{1,2}T\d{1,2}:\d{1,2}:\d{1,2}" + TIME_TAIL + r"\s*$",
    "yyyy-MM-dd": r"^\s*\d{4}-\d{1,2}-\d{1,2}\s*$",
    "yyyy/MM/dd": r"^\s*\d{4}/\d{1,2}/\d{1,2}\s*$",
    "MM/dd/yyyy": r"^\s*\d{1,2}/\d{1,2}/\d{4}\s*$",
    "dd/MM/yyyy": r"^\s*\d{1,2}/\d{1,2}/\d{4}\s*$",
    "dd-MM-yyyy": r"^\s*\d{1,2}-\d{1,2}-\d{4}\s*$",
    "dd MMM yyyy": r"^\s*\d{1,2} [A-Za-z]{3} \d{4}\s*$",
    "MMM dd, yyyy": r"^\s*[A-Za-z]{3} \d{1,2}, \d{4}\s*$",
    "dd MMMM yyyy": r"^\s*\d{1,2} [A-Za-z]{3,9} \d{4}\s*$",
    "MMMM dd, yyyy": r"^\s*[A-Za-z]{3,9} \d{1,2}, \d{4}\s*$",
    "yyyy-MM-dd HH:mm": r"^\s*\d{4}-\d{1,2}-\d{1,2} \d{1,2}:\d{1,2}\s*$",
    "yyyy-MM-dd'T'HH:mm": r"^\s*\d{4}-\d{1,2}-\d{1,2}T\d{1,2}:\d{1,2}\s*$",
    "yyyy/MM/dd HH:mm:ss": r"^\s*\d{4}/\d{1,2}/\d{1,2} \d{1,2}:\d{1,2}:\d{1,2}" + TIME_TAIL + r"\s*$",
    "yyyy/MM/dd HH:mm": r"^\s*\d{4}/\d{1,2}/\d{1,2} \d{1,2}:\d{1,2}\s*$",
    "MM/dd/yyyy HH:mm:ss": r"^\s*\d{1,2}/\d{1,2}/\d{4} \d{1,2}:\d{1,2}:\d{1,2}" + TIME_TAIL + r"\s*$",
    "MM/dd/yyyy HH:mm": r"^\s*\d{1,2}/\d{1,2}/\d{4} \d{1,2}:\d{1,2}\s*$",
    "dd/MM/yyyy HH:mm:ss": r"^\s*\d{1,2}/\d{1,2}/\d{4} \d{1,2}:\d{1,2}:\d{1,2}" + TIME_TAIL + r"\s*$",
    "dd/MM/yyyy HH:mm": r"^\s*\d{1,2}/\d{1,2}/\d{4} \d{1,2}:\d{1,2}\s*$",
    "MM/dd/yyyy hh:mm:ss a": r"^\s*\d{1,2}/\d{1,2}/\d{4} \d{1,2}:\d{1,2}:\d{1,2} [AaPp][Mm]\s*$",
    "MM/dd/yyyy hh:mm a": r"^\s*\d{1,2}/\d{1,2}/\d{4} \d{1,2}:\d{1,2} [AaPp][Mm]\s*$",
    "yyyy-MM-dd hh:mm:ss a": r"^\s*\d{4}-\d{1,2}-\d{1,2} \d{1,2}:\d{1,2}:\d{1,2} [AaPp][Mm]\s*$",
    "yyyy-MM-dd hh:mm a": r"^\s*\d{4}-\d{1,2}-\d{1,2} \d{1,2}:\d{1,2} [AaPp][Mm]\s*$",
    "yyyyMMdd": r"^\s*\d{8}\s*$",
}
# What every shape above holds: one search that rules out most text at once.
DATETIME_HINT = r"\d{4}"
# Column names that are time parts and are never scaled.
TEMPORAL_NAMES = ("year", "date", "month", "day", "timestamp")
# ---------------------------------------------------------------------------


def is_numeric_type(dt: T.DataType) -> bool:
    """Numbers for statistics: integers, floats, decimals; never booleans."""
    return isinstance(dt, T.NumericType) and not isinstance(dt, T.BooleanType)


def is_categorical_type(dt: T.DataType) -> bool:
    """Text or boolean columns are categorical."""
    return isinstance(dt, (T.StringType, T.BooleanType))


def numeric_columns(df: DataFrame, exclude: tuple[str, ...] | list[str] = ()) -> list[str]:
    return [f.name for f in df.schema.fields if is_numeric_type(f.dataType) and f.name not in exclude]


def categorical_columns(df: DataFrame, exclude: tuple[str, ...] | list[str] = ()) -> list[str]:
    out = []
    for f in df.schema.fields:
        role = (f.metadata or {}).get("role")
        if f.name in exclude:
            continue
        if is_categorical_type(f.dataType) or role == "categorical":
            out.append(f.name)
    return out


def type_name(dt: T.DataType) -> str:
    return dt.simpleString()


def nan_to_null(c: Column) -> Column:
    """NaN and NULL are one thing to the evidence; Spark keeps them apart."""
    return F.when(~F.isnan(c), c)


def text_to_number(c: Column) -> Column:
    """Guarded text-to-double: the regex decides, ``try_cast`` converts.

    ``try_cast`` alone takes ``1d``/``1f`` and the regex rejects ``1_000``,
    ``0x10`` and ``1,000``, so the result does not depend on the engine.
    """
    trimmed = F.trim(c)
    return (
        F.when(c.rlike(NUMBER_PATTERN), trimmed.try_cast("double"))
        .when(
            c.rlike(INFINITY_PATTERN),
            F.when(F.startswith(trimmed, F.lit("-")), F.lit(float("-inf"))).otherwise(F.lit(float("inf"))),
        )
    )


def as_number(df: DataFrame, name: str) -> Column:
    """A column as DOUBLE the way the evidence sees it (NULL where not a number)."""
    dt = df.schema[name].dataType
    c = F.col(name)
    if isinstance(dt, T.StringType):
        return text_to_number(c)
    if isinstance(dt, (T.FloatType, T.DoubleType)):
        return nan_to_null(c.cast("double"))
    if isinstance(dt, (T.NumericType, T.BooleanType)):
        # no NaN possible: a bare cast lets Catalyst unwrap it in comparisons,
        # so range filters on integer columns reach the parquet scan
        return c.cast("double")
    return F.lit(None).cast("double")


def parse_datetime(c: Column, spark_format: str) -> Column:
    """Text to TIMESTAMP_NTZ under one format; anything else becomes NULL.

    A time may have a fraction of a second and an offset; with an offset the
    result is the UTC wall time."""
    text, shape = F.trim(c), DATETIME_SHAPES.get(spark_format)
    if not spark_format.endswith(":ss"):
        parsed = F.try_to_timestamp(text, F.lit(spark_format)).cast("timestamp_ntz")
        return F.when(c.rlike(shape), parsed) if shape else parsed
    plain = F.regexp_replace(text, r"\s*(Z|[+-]\d{2}:?\d{2})$", "")
    parsed = F.try_to_timestamp(plain, F.lit(spark_format + "[.SSSSSSSSS]")).cast("timestamp_ntz")
    sign = F.regexp_extract(text, r":\d{1,2}(?:\.\d+)?\s*([+-])\d{2}:?\d{2}$", 1)
    part = lambda k: F.coalesce(
        F.regexp_extract(text, r":\d{1,2}(?:\.\d+)?\s*[+-](\d{2}):?(\d{2})$", k).try_cast("int"), F.lit(0))
    way = F.when(sign == "-", F.lit(1)).otherwise(F.lit(-1))
    moved = F.when(sign == "", parsed).otherwise(parsed + F.make_dt_interval(F.lit(0), way * part(1), way * part(2)))
    return F.when(c.rlike(shape), moved)


def normalise_value(c: Column, dt: T.DataType) -> Column:
    """Value as text for frequency tables: NaN is missing and -0.0 equals 0.0."""
    if isinstance(dt, (T.FloatType, T.DoubleType)):
        d = nan_to_null(c.cast("double"))
        return F.when(d == 0, F.lit("0.0")).otherwise(d.cast("string"))
    return c.cast("string")
