"""Profiling and missing-value evidence.

The dataset profile takes per-column missing counts from one scan and the
duplicate rows from the hash-first exact count in ``duplicates``. Distinct
counts, modes and top lists come from counts of hashed values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from frameprep.functions.coerce import is_numeric_type, normalise_value, type_name
from frameprep.functions.locate import SEEN, with_order
from frameprep.functions.report import frame, pct, round_half_away
from frameprep.functions.stats import exact_quantiles, moments, top_values, value_hashes

TOP_K = 10


def is_missing(df: DataFrame, c: str) -> Column:
    dt = df.schema[c].dataType
    col = F.col(c)
    if isinstance(dt, (T.FloatType, T.DoubleType)):
        return col.isNull() | F.isnan(col)
    return col.isNull()


def _groupable(df: DataFrame) -> list[str]:
    """Columns a row-equality group-by can use (maps are not comparable)."""
    return [f.name for f in df.schema.fields if not isinstance(f.dataType, T.MapType)]


def dataset_totals(df: DataFrame) -> dict:
    """Rows, columns, duplicate rows, total missing, per-column missing."""
    from frameprep.operators.duplicates import duplicate_count

    cols = _groupable(df)
    _, missing = missing_counts(df, cols)
    rows, dups = duplicate_count(df)
    return {
        "rows": rows,
        "columns": len(df.columns),
        "column_names": list(df.columns),
        "duplicate_rows": dups,
        "total_missing_values": sum(missing.values()),
        "missing": missing,
    }


def profile_dataset(df: DataFrame) -> DataFrame:
    t = dataset_totals(df)
    return frame(
        df.sparkSession,
        [{**t, "column_names": ",".join(t["column_names"])}],
        "rows BIGINT, columns BIGINT, column_names STRING, duplicate_rows BIGINT, total_missing_values BIGINT",
    )


def missing_counts(df: DataFrame, cols: list[str] | None = None) -> tuple[int, dict[str, int]]:
    """Rows and missing values per column in one scan."""
    cols = list(df.columns) if cols is None else cols
    row = df.agg(F.count(F.lit(1)).alias("n"), *[F.count_if(is_missing(df, c)).alias(f"m{i}") for i, c in enumerate(cols)]).first()
    return int(row["n"]), {c: int(row[f"m{i}"]) for i, c in enumerate(cols)}


def distinct_counts(df: DataFrame, cols: list[str], exact: bool = True) -> dict[str, int]:
    """Distinct non-missing values per column: exact through one shuffle of the
    frequency table, or (opt-in) HyperLogLog++ sketches in one pass, no shuffle."""
    if not exact:
        row = df.agg(*[F.approx_count_distinct(normalise_value(F.col(c), df.schema[c].dataType), 0.01).alias(f"d{i}")
                       for i, c in enumerate(cols)]).first() if cols else None
        return {c: int(row[f"d{i}"]) for i, c in enumerate(cols)} if cols else {}
    freq = value_hashes(df, cols)
    got = {r["column"]: int(r["d"]) for r in freq.groupBy("column").agg(F.count(F.lit(1)).alias("d")).collect()}
    return {c: got.get(c, 0) for c in cols}


def profile_columns(df: DataFrame, exact: bool = True) -> DataFrame:
    """Dtype, missing count and %, distinct values per column
    (``exact=False``: approximate distincts, one pass without a shuffle)."""
    cols = list(df.columns)
    n, miss = missing_counts(df, cols)
    plain = [c for c in cols if not isinstance(df.schema[c].dataType, (T.MapType, T.ArrayType, T.StructType, T.BinaryType))]
    dist = distinct_counts(df, plain, exact)
    rows = [
        {
            "column_name": c,
            "dtype": type_name(df.schema[c].dataType),
            "missing_count": miss[c],
            "missing_percentage": round_half_away(pct(miss[c], n), 2),
            "unique_values": dist.get(c),
        }
        for c in cols
    ]
    return frame(
        df.sparkSession, rows,
        "column_name STRING, dtype STRING, missing_count BIGINT, missing_percentage DOUBLE, unique_values BIGINT",
    )


def missing_columns(df: DataFrame) -> list[str]:
    """Columns with at least one missing value."""
    _, miss = missing_counts(df)
    return [c for c, m in miss.items() if m > 0]


def numeric_summary(df: DataFrame, column: str) -> dict:
    """Count, mean, median, sample std, min, max, corrected skewness, q1, q3."""
    if column not in df.columns:
        raise ValueError(f"no column named '{column}'")
    s = moments(df, [column])[column]
    if s["n"] == 0:
        raise ValueError(f"'{column}' has no numbers to summarise")
    q1, med, q3 = exact_quantiles(df, [column], [0.25, 0.5, 0.75], {column: s})[column]
    return {
        "column_name": column, "count": s["n"], "mean": s["mean"], "median": med, "std": s["std"],
        "min": s["min"], "max": s["max"], "skewness": s["skewness"], "q1": q1, "q3": q3,
    }


NUMERIC_SUMMARY_DDL = (
    "column_name STRING, count BIGINT, mean DOUBLE, median DOUBLE, std DOUBLE, min DOUBLE, max DOUBLE, "
    "skewness DOUBLE, q1 DOUBLE, q3 DOUBLE"
)


def numeric_summaries(df: DataFrame, cols: list[str], approx: bool = False) -> DataFrame:
    """P3 for several columns with one moments pass and shared quantile rounds."""
    for c in cols:
        if c not in df.columns:
            raise ValueError(f"no column named '{c}'")
    mom = moments(df, cols)
    qs = exact_quantiles(df, cols, [0.25, 0.5, 0.75], mom, approx=approx)
    rows = []
    for c in cols:
        s = mom[c]
        if s["n"] == 0:
            raise ValueError(f"'{c}' has no numbers to summarise")
        q1, med, q3 = qs[c]
        rows.append({
            "column_name": c, "count": s["n"], "mean": s["mean"], "median": med, "std": s["std"],
            "min": s["min"], "max": s["max"], "skewness": s["skewness"], "q1": q1, "q3": q3,
        })
    return frame(df.sparkSession, rows, NUMERIC_SUMMARY_DDL)


def ranked_values(df: DataFrame, cols: list[str], k: int = TOP_K) -> DataFrame:
    """Top-k values per column by (count desc, typed value asc); counted by hash, and
    only the winners' texts are fetched."""
    return top_values(df, cols, k)[0]


def column_modes(df: DataFrame, cols: list[str]) -> DataFrame:
    """Mode per column (most frequent, ties to the smallest typed value) with its count,
    the distinct values and the non-missing rows."""
    top, counts = top_values(df, cols, 1)
    totals = df.sparkSession.createDataFrame(
        [(c, d, n) for c, (d, n) in counts.items()], "column_name STRING, unique_values BIGINT, non_missing BIGINT")
    return top.join(F.broadcast(totals), "column_name").select(
        "column_name", F.col("value").alias("mode"), F.col("count").alias("mode_count"), "unique_values", "non_missing")


def categorical_summary(df: DataFrame, column: str, k: int = TOP_K) -> DataFrame:
    """Top-k value counts, distinct count and mode of one column."""
    if column not in df.columns:
        raise ValueError(f"no column named '{column}'")
    top, counts = top_values(df, [column], max(k, 1))
    mode = top.where(F.col("rank") == 1).select(F.col("value").alias("most_frequent"), "column_name")
    return top.where(F.col("rank") <= k).join(F.broadcast(mode), "column_name").withColumn(
        "unique_values", F.lit(counts.get(column, (0, 0))[0]).cast("bigint"))


def missingness_by_category(df: DataFrame, target: str, grouping: str) -> DataFrame:
    """P5: per group of ``grouping`` (missing key dropped): missing count of
    ``target``, rows, missing %. Partial aggregation absorbs hot groups."""
    for c, what in ((target, "Target"), (grouping, "Grouping")):
        if c not in df.columns:
            raise ValueError(f"no column named '{c}' to use as {what.lower()}")
    g = F.col(grouping)
    return (
        df.where(~is_missing(df, grouping))
        .groupBy(g.alias(grouping))
        .agg(F.count_if(is_missing(df, target)).alias("missing_count"), F.count(F.lit(1)).alias("total_count"))
        .withColumn("missing_percentage", F.col("missing_count") / F.col("total_count") * F.lit(100.0))
    )


def missing_evidence(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Type (Numeric / Categorical), missing count and %, skewness
    (4 dp, undefined -> 0.0; NULL for non-numeric)."""
    cols = missing_columns(df) if cols is None else cols
    n, miss = missing_counts(df, cols)
    nums = [c for c in cols if is_numeric_type(df.schema[c].dataType)]
    mom = moments(df, nums)
    rows = []
    for c in cols:
        numeric = c in mom
        skew = None
        if numeric:
            skew = round_half_away(mom[c]["skewness"] if mom[c]["skewness"] is not None else 0.0, 4)
        rows.append({
            "column_name": c,
            "column_type": "Numeric" if numeric else "Categorical",
            "missing_count": miss[c],
            "missing_percentage": round_half_away(pct(miss[c], n), 2),
            "skewness": skew,
        })
    return frame(
        df.sparkSession, rows,
        "column_name STRING, column_type STRING, missing_count BIGINT, missing_percentage DOUBLE, skewness DOUBLE",
    )


def inspect_column(df: DataFrame, column: str):
    """Numeric summary for a numeric column, categorical summary otherwise;
    a column without missing values gets a short answer instead."""
    _, miss = missing_counts(df, [column])
    if not miss[column]:
        return f"'{column}' has no missing values."
    if is_numeric_type(df.schema[column].dataType):
        return numeric_summary(df, column)
    return categorical_summary(df, column)


def preview(df: DataFrame, n: int = 20, order_by: str | None = None) -> DataFrame:
    """The first ``n`` rows to look at (a limit is the feature here), by ``order_by`` if
    given, else in file order; any ``n`` of a frame that does not come from files."""
    seen, ordered = with_order(df, order_by)
    return (seen.orderBy(SEEN) if ordered else seen).limit(n).drop(*[SEEN] * ordered)


class MissingValueInspector:
    """The inspector over one frame; relationship results are kept
    under ``"<target>_by_<grouping>"`` as in the reference's helper."""

    def __init__(self, df: DataFrame):
        self.df = df
        self.relationships: dict[str, DataFrame] = {}
        self.columns: dict[str, object] = {}

    def get_missing_columns(self) -> list[str]:
        return missing_columns(self.df)

    def inspect_column(self, column: str):
        if column not in self.columns:
            self.columns[column] = inspect_column(self.df, column)
        return self.columns[column]

    def inspect_missingness_relationship(self, target: str, grouping: str) -> DataFrame:
        out = missingness_by_category(self.df, target, grouping)
        self.relationships[f"{target}_by_{grouping}"] = out
        return out
