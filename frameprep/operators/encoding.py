"""Categorical evidence (E1-E4) and encodings.

Evidence is the value-frequency table reduced per column. Encodings are fitted
as small tables (one row per category) and applied by ``lookup_column``, which
checks the table size before choosing literal map, broadcast or shuffle join.
One-hot adds a column per category, so the driver holds the category list (as
long as the output is wide). ``sparse=True`` gives one (size, index, value)
vector column instead, fitted and applied as a table of any size.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from frameprep.functions.coerce import categorical_columns, is_numeric_type, nan_to_null, normalise_value, type_name
from frameprep.functions.indexing import ordered_index
from frameprep.functions.locate import SEEN, with_order
from frameprep.functions.lookup import lookup_column
from frameprep.functions.names import free_names
from frameprep.functions.report import frame, pct, round_half_away
from frameprep.functions.written import written
from frameprep.operators.profile import is_missing

# --- fixed values -----------------------------------------------------------
ENCODING_ACTIONS = ("No Action", "One-Hot Encoding", "Frequency Encoding", "Target Encoding", "Ordinal Encoding")
LOW_CARDINALITY_MAX = 10
HIGH_CARDINALITY_COUNT = 20
HIGH_CARDINALITY_PCT = 10.0
PAGE_RULE_MAX_DISTINCT = 20
PAGE_RULE_MAX_PCT = 20.0
SAMPLE_CATEGORIES = 20
MISSING_LABEL = "nan"
TOP_CATEGORIES = 10
# ---------------------------------------------------------------------------

EVIDENCE_DDL = (
    "column_name STRING, dtype STRING, total_count BIGINT, missing_count BIGINT, unique_count BIGINT, "
    "unique_percentage DOUBLE, low_cardinality BOOLEAN, high_cardinality BOOLEAN, "
    "most_frequent_percentage DOUBLE, average_frequency DOUBLE, sample_categories STRING, "
    "top_categories STRING"
)


def is_categorical_column(df: DataFrame, column: str) -> bool:
    """Text, boolean, or marked categorical."""
    return column in categorical_columns(df)


def _freq_with_first(df: DataFrame, cols: list[str], order_by: str | None) -> DataFrame:
    items = []
    types = {c: df.schema[c].dataType for c in cols}
    df, ordered = with_order(df, order_by)
    for c in cols:
        v = normalise_value(F.col(c), types[c])
        key = F.col(SEEN) if ordered else v
        items.append(F.struct(F.lit(c).alias("column"), v.alias("value"), key.alias("key")))
    long = df.select(F.explode(F.array(*items)).alias("s")).select("s.*").where(F.col("value").isNotNull())
    return long.groupBy("column", "value").agg(F.count(F.lit(1)).alias("cnt"), F.min("key").alias("first"))


def analyze_categorical_features(df: DataFrame, target: str | None = None, order_by: str | None = None,
                                 columns: list[str] | None = None) -> DataFrame:
    """One evidence row per categorical column (the target left out)."""
    cols = columns if columns is not None else [c for c in categorical_columns(df) if c != target]
    if not cols:
        return frame(df.sparkSession, [], EVIDENCE_DDL)
    n = df.count()
    freq = _freq_with_first(df, cols, order_by)
    per = {
        r["column"]: r
        for r in freq.groupBy("column").agg(
            F.count(F.lit(1)).alias("u"), F.sum("cnt").alias("present"), F.max("cnt").alias("top")
        ).collect()
    }
    w = Window.partitionBy("column").orderBy("first", "value")
    samples = {
        r["column"]: ",".join(v for _, v in sorted(r["vals"]))
        for r in freq.withColumn("rk", F.row_number().over(w)).where(F.col("rk") <= SAMPLE_CATEGORIES)
        .groupBy("column").agg(F.collect_list(F.struct("rk", "value")).alias("vals")).collect()
    }
    w = Window.partitionBy("column").orderBy(F.desc("cnt"), "value")
    tops = {
        r["column"]: ",".join(f"{v}:{n}" for _, v, n in sorted(r["vals"]))
        for r in freq.withColumn("rk", F.row_number().over(w)).where(F.col("rk") <= TOP_CATEGORIES)
        .groupBy("column").agg(F.collect_list(F.struct("rk", "value", "cnt")).alias("vals")).collect()
    }
    rows = []
    for c in cols:
        r = per.get(c)
        u = int(r["u"]) if r else 0
        present = int(r["present"]) if r else 0
        top = int(r["top"]) if r else 0
        upct = pct(u, present)
        rows.append({
            "column_name": c,
            "dtype": type_name(df.schema[c].dataType),
            "total_count": n,
            "missing_count": n - present,
            "unique_count": u,
            "unique_percentage": round_half_away(upct, 2),
            "low_cardinality": u <= LOW_CARDINALITY_MAX,
            "high_cardinality": u > HIGH_CARDINALITY_COUNT or upct > HIGH_CARDINALITY_PCT,
            "most_frequent_percentage": round_half_away(pct(top, present), 2),
            "average_frequency": round_half_away(present / u if u else 0.0, 2),
            "sample_categories": samples.get(c, ""),
            "top_categories": tops.get(c, ""),
        })
    return frame(df.sparkSession, rows, EVIDENCE_DDL)


def encoding_candidates(df: DataFrame, target: str | None = None) -> list[str]:
    """E4 page rule: categorical by type, or non-numeric with at most 20
    distinct values that are at most 20 % of the non-missing rows."""
    out = [c for c in categorical_columns(df) if c != target]
    others = [f.name for f in df.schema.fields
              if f.name not in out and f.name != target and not is_numeric_type(f.dataType)
              and not isinstance(f.dataType, (T.MapType, T.ArrayType, T.StructType, T.BinaryType))]
    if others:
        freq = _freq_with_first(df, others, None)
        for r in freq.groupBy("column").agg(F.count(F.lit(1)).alias("u"), F.sum("cnt").alias("p")).collect():
            if r["u"] <= PAGE_RULE_MAX_DISTINCT and pct(r["u"], r["p"]) <= PAGE_RULE_MAX_PCT:
                out.append(r["column"])
    order = {c: i for i, c in enumerate(df.columns)}
    return sorted(out, key=order.get)


# --- fitted encodings ---------------------------------------------------------


@dataclass
class Encoding:
    """A fitted encoding: applies to any frame with the same column (L3)."""

    column: str
    action: str
    mapping: DataFrame | None = None  # key -> value (frequency, target, ordinal)
    categories: list | None = None  # one-hot, sorted, missing last
    has_missing: bool = False
    size: int | None = None  # sparse one-hot: length of the vector

    def transform(self, df: DataFrame) -> DataFrame:
        if self.action == "No Action":
            return df
        if self.action == "One-Hot Encoding" and self.mapping is not None:
            at = lookup_column(df, self.column, self.mapping, out_type="long")
            i = F.coalesce(F.col(self.column), F.lit(self.size - 1 if self.has_missing else None).cast("long"))
            hit = F.when(i.isNotNull(), F.array(i)).otherwise(F.array().cast("array<bigint>"))
            return at.withColumn(self.column, F.struct(
                F.lit(self.size).cast("bigint").alias("size"), hit.alias("indices"),
                F.transform(hit, lambda _: F.lit(1.0)).alias("values")))
        if self.action == "One-Hot Encoding":
            c = F.col(self.column)
            if isinstance(df.schema[self.column].dataType, (T.FloatType, T.DoubleType)):
                c = nan_to_null(c)
            wanted = [f"{self.column}_{_label(v)}" for v in self.categories]
            wanted += [f"{self.column}_{MISSING_LABEL}"] * self.has_missing
            names = free_names(wanted, [x for x in df.columns if x != self.column])
            new = {name: (c == F.lit(v)).cast("double") for name, v in zip(names, self.categories)}
            if self.has_missing:
                new[names[-1]] = c.isNull().cast("double")
            # a missing value matches no category: equality gives NULL, one-hot wants 0
            new = {k: F.coalesce(v, F.lit(0.0)) for k, v in new.items()}
            return df.withColumns(new).drop(self.column)
        out_type = "long" if self.action == "Ordinal Encoding" else "double"
        return lookup_column(df, self.column, self.mapping, out_type=out_type)


def _label(v) -> str:
    return str(v)


def _materialise(mapping: DataFrame) -> DataFrame:
    """A fitted table (one row per category) is written once to the shared
    folder, so sizing it and joining it do not refit it."""
    return written(mapping, "fitted")


def fit_one_hot(df: DataFrame, column: str, sparse: bool = False) -> Encoding:
    """E5: one 0/1 column per category, or (``sparse``) one vector column."""
    c = F.col(column)
    if isinstance(df.schema[column].dataType, (T.FloatType, T.DoubleType)):
        c = nan_to_null(c)
    cats = df.select(c.alias("v")).where(F.col("v").isNotNull()).distinct()
    has_missing = df.where(is_missing(df, column)).limit(1).count() > 0
    if sparse:
        table = ordered_index(cats.withColumnRenamed("v", "key"), ["key"], "value")
        return Encoding(column, "One-Hot Encoding", mapping=table, has_missing=has_missing, size=table.count() + has_missing)
    cats = cats.collect()
    return Encoding(column, "One-Hot Encoding", categories=sorted(r["v"] for r in cats), has_missing=has_missing)


def fit_frequency(df: DataFrame, column: str) -> Encoding:
    """Share of each value among the non-missing rows."""
    c = F.col(column)
    counts = df.where(~is_missing(df, column)).groupBy(c.alias("key")).agg(F.count(F.lit(1)).alias("cnt"))
    total = df.where(~is_missing(df, column)).count()
    mapping = counts.withColumn("value", F.col("cnt") / F.lit(float(total) if total else None))
    return Encoding(column, "Frequency Encoding", mapping=_materialise(mapping.select("key", "value")))


def fit_target(df: DataFrame, column: str, target: str | None) -> Encoding:
    """Mean of the target per value, over all rows (no folds, no smoothing)."""
    if target is None:
        raise ValueError("Target Encoding cannot run without a target column")
    if target not in df.columns:
        raise ValueError(f"no column named '{target}' to use as target")
    tdt = df.schema[target].dataType
    if not isinstance(tdt, (T.NumericType, T.BooleanType)):
        raise ValueError(f"Target Encoding needs a numeric target; '{target}' is {tdt.simpleString()}")
    t = nan_to_null(F.col(target).cast("double"))
    mapping = (
        df.where(~is_missing(df, column))
        .groupBy(F.col(column).alias("key"))
        .agg(F.avg(t).alias("value"))
    )
    return Encoding(column, "Target Encoding", mapping=_materialise(mapping))


def fit_ordinal(df: DataFrame, column: str, order_by: str | None = None) -> Encoding:
    """0, 1, 2, ... in order of first appearance (by ``order_by``, else in file order)."""
    seen, ordered = with_order(df, order_by)
    if not ordered:
        raise ValueError("Ordinal Encoding needs order_by (a column that gives the order rows were seen in): this frame is not read from files")
    firsts = seen.where(~is_missing(df, column)).groupBy(F.col(column).alias("key")).agg(F.min(SEEN).alias("first"))
    mapping = ordered_index(firsts, ["first", "key"], "value")
    return Encoding(column, "Ordinal Encoding", mapping=mapping.select("key", "value"))


def fit_encoding(df: DataFrame, column: str, action: str, target: str | None = None, order_by: str | None = None) -> Encoding:
    if action == "No Action":
        return Encoding(column, action)
    if action == "One-Hot Encoding":
        return fit_one_hot(df, column)
    if action == "Frequency Encoding":
        return fit_frequency(df, column)
    if action == "Target Encoding":
        return fit_target(df, column, target)
    if action == "Ordinal Encoding":
        return fit_ordinal(df, column, order_by)
    raise ValueError(f"Unknown encoding action: {action}")


def encode(df: DataFrame, column: str, action: str, target: str | None = None, order_by: str | None = None) -> DataFrame:
    return fit_encoding(df, column, action, target, order_by).transform(df)


def apply_encoding_actions(df: DataFrame, actions, target: str | None = None,
                           order_by: str | None = None, record: list | None = None) -> tuple[DataFrame, DataFrame]:
    """Plan order; unknown columns and the target are skipped. All
    encodings are fitted on the incoming frame (columns are independent)."""
    actions = list(actions.items()) if isinstance(actions, dict) else list(actions)
    for _, a in actions:
        if a not in ENCODING_ACTIONS:
            raise ValueError(f"Unknown encoding action: {a}")
    actions = [(c, a) for c, a in actions if c in df.columns and c != target]
    fitted = [fit_encoding(df, c, a, target, order_by) for c, a in actions]
    if record is not None:
        record.extend(fitted)
    out = df
    summary = []
    for enc in fitted:
        before = len(out.columns)
        out = enc.transform(out)
        summary.append({"column_name": enc.column, "action": enc.action, "columns_before": before, "columns_after": len(out.columns)})
    return out, frame(df.sparkSession, summary, "column_name STRING, action STRING, columns_before BIGINT, columns_after BIGINT")
