"""Recommendation rules (G1-G9): evidence table -> (column, action, reason, confidence).

Each rule is a ``when`` chain over the evidence DataFrame, so it runs where the
evidence is (one row per column) and reads like the prose guidelines it
replaces. Numbers marked as ours in the survey are collected here.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from frameprep.operators.duplicates import DUPLICATE_ACTIONS
from frameprep.operators.encoding import ENCODING_ACTIONS
from frameprep.operators.imbalance import IMBALANCE_ACTIONS
from frameprep.operators.missing import MISSING_ACTIONS
from frameprep.operators.outliers import OUTLIER_ACTIONS
from frameprep.operators.relevance import RELEVANCE_ACTIONS
from frameprep.operators.scaling import SCALING_ACTIONS
from frameprep.operators.schema import SCHEMA_ACTIONS

# --- fixed values (our thresholds) ---------------------------------------------
SMALL_SAMPLE = 30
DATETIME_PCT = 95.0
NUMERIC_PCT = 95.0
CATEGORICAL_MAX = 10
TARGET_CORRELATION = 0.95
MISSING_DROP_PCT = 60.0
SKEW_MEDIAN = 1.0
SCALING_OUTLIER_PCT = 5.0
SCALING_SKEW = 1.0
OUTLIER_ZSCORE_SKEW = 0.5
OUTLIER_WINSOR_PCT = 5.0
IMBALANCE_MILD = 1.5
IMBALANCE_SEVERE = 5.0
UNDERSAMPLE_MINORITY = 100_000
SMOTE_MIN_MINORITY = 6
# ---------------------------------------------------------------------------

STAGE_ACTIONS = {
    "schema": SCHEMA_ACTIONS, "duplicates": DUPLICATE_ACTIONS, "encoding": ENCODING_ACTIONS,
    "relevance": RELEVANCE_ACTIONS, "scaling": SCALING_ACTIONS, "imbalance": IMBALANCE_ACTIONS,
    "missing": MISSING_ACTIONS, "outliers": OUTLIER_ACTIONS,
}


def _pick(branches: list[tuple[Column, str, str, str]], default: tuple[str, str, str]) -> tuple[Column, Column, Column]:
    action = reason = conf = None
    for cond, a, r, c in branches:
        if action is None:
            action, reason, conf = F.when(cond, a), F.when(cond, r), F.when(cond, c)
        else:
            action, reason, conf = action.when(cond, a), reason.when(cond, r), conf.when(cond, c)
    return action.otherwise(default[0]), reason.otherwise(default[1]), conf.otherwise(default[2])


def _out(ev: DataFrame, action, reason, conf, rows: Column) -> DataFrame:
    conf = F.when(rows < SMALL_SAMPLE, F.lit("Low")).otherwise(conf)
    return ev.select("column_name", action.alias("action"), reason.alias("reason"), conf.alias("confidence"))


def recommend_schema(ev: DataFrame) -> DataFrame:
    """G1 over ``analyze_schema`` evidence."""
    text = F.col("dtype") == "string"
    a, r, c = _pick([
        (F.col("is_empty"), "Drop Column", "column has no values", "High"),
        (text & (F.col("date_conversion_percentage") >= DATETIME_PCT), "Convert to Datetime", "text values read as dates", "High"),
        (F.col("is_identifier_candidate") & ~F.col("dtype").isin("double", "float"), "Treat as Identifier",
         "nearly every value is distinct", "High"),
        (text & (F.col("numeric_conversion_percentage") >= NUMERIC_PCT), "Convert to Numeric", "text values read as numbers", "High"),
        (F.col("is_constant"), "No Action", "column holds one value", "Low"),
        (text & (F.col("unique_count") <= CATEGORICAL_MAX), "Convert to Categorical", "few distinct text values", "Medium"),
    ], ("No Action", "type fits the values", "Medium"))
    return _out(ev, a, r, c, F.col("total_count"))


def recommend_duplicates(summary: DataFrame, identifiers: DataFrame) -> DataFrame:
    """G2 over the duplicate summary and the identifier candidates."""
    has_id = identifiers.limit(1).count() > 0
    a, r, c = _pick([
        (F.col("duplicate_rows") == 0, "Keep Duplicates", "no duplicate rows", "High"),
        (F.lit(has_id), "Remove Duplicates", "rows repeat although an identifier-like column exists", "High"),
    ], ("Keep Duplicates", "repeated rows may be genuine", "Medium"))
    return summary.select(F.lit("Dataset").alias("column_name"), a.alias("action"), r.alias("reason"),
                          F.when(F.col("total_rows") < SMALL_SAMPLE, "Low").otherwise(c).alias("confidence"))


def recommend_encoding(ev: DataFrame, target_is_numeric: bool = False, ordered: tuple[str, ...] = ()) -> DataFrame:
    """G3 over ``analyze_categorical_features`` evidence."""
    a, r, c = _pick([
        (F.col("column_name").isin(list(ordered)) if ordered else F.lit(False), "Ordinal Encoding", "categories have an order", "High"),
        (F.col("low_cardinality"), "One-Hot Encoding", "few categories", "High"),
        (F.col("high_cardinality") & F.lit(target_is_numeric), "Target Encoding", "many categories and a numeric target", "Medium"),
    ], ("Frequency Encoding", "many categories", "Medium"))
    return _out(ev, a, r, c, F.col("total_count"))


def recommend_relevance(features: DataFrame, pairs: DataFrame, rows: int) -> DataFrame:
    """G4 over relevance evidence; low correlation alone never drops a column."""
    in_pair = [r["c"] for r in pairs.select(F.explode(F.array("column_1", "column_2")).alias("c")).distinct().collect()]
    a, r, c = _pick([
        (F.col("is_target"), "Keep", "target column", "High"),
        (F.col("is_constant"), "Drop", "column holds one value", "High"),
        (F.col("is_identifier_candidate"), "Drop", "identifier-like column", "High"),
        (F.col("is_near_constant"), "Investigate", "one value dominates", "Medium"),
        (F.col("column_name").isin(in_pair) if in_pair else F.lit(False), "Investigate", "highly correlated with another column", "Medium"),
        (F.abs(F.coalesce(F.col("correlation_with_target"), F.lit(0.0))) >= TARGET_CORRELATION, "Investigate",
         "suspiciously close to the target", "Medium"),
        (F.col("missing_percentage") >= MISSING_DROP_PCT, "Investigate", "mostly missing", "Medium"),
    ], ("Keep", "no problem found", "Medium"))
    return _out(features, a, r, c, F.lit(rows))


def recommend_scaling(ev: DataFrame, identifiers: tuple[str, ...] = ()) -> DataFrame:
    """G5 over ``analyze_scaling_features`` evidence."""
    a, r, c = _pick([
        (F.col("column_name").isin(list(identifiers)) if identifiers else F.lit(False), "No Action", "identifier column", "High"),
        (F.col("count") == 0, "No Action", "no numeric values", "High"),
        (F.col("outlier_percentage") > SCALING_OUTLIER_PCT, "RobustScaler", "many outliers", "High"),
        (F.abs(F.coalesce(F.col("skewness"), F.lit(0.0))) < SCALING_SKEW, "StandardScaler", "roughly symmetric", "Medium"),
    ], ("MinMaxScaler", "skewed without many outliers", "Medium"))
    return _out(ev, a, r, c, F.col("count"))


def recommend_imbalance(ev: DataFrame) -> DataFrame:
    """G6 over ``analyze_target_distribution`` evidence."""
    ratio = F.col("imbalance_ratio")
    a, r, c = _pick([
        (F.col("problem_type") != "Classification", "No Action", "not a classification target", "High"),
        (ratio.isNull() | (ratio < IMBALANCE_MILD), "No Action", "classes are balanced", "High"),
        (ratio <= IMBALANCE_SEVERE, "Class Weights", "mild to moderate imbalance", "Medium"),
        (F.col("minority_count") >= UNDERSAMPLE_MINORITY, "Random Undersampling", "severe imbalance, large minority", "Medium"),
        (F.col("minority_count") >= SMOTE_MIN_MINORITY, "SMOTE", "severe imbalance", "Medium"),
    ], ("Class Weights", "severe imbalance, minority too small to interpolate", "Low"))
    return ev.select(F.col("target_column").alias("column_name"), a.alias("action"), r.alias("reason"),
                     F.when(F.coalesce(F.col("majority_count") + F.col("minority_count"), F.lit(0)) < SMALL_SAMPLE, "Low")
                     .otherwise(c).alias("confidence"))


def recommend_missing(ev: DataFrame, rows: int) -> DataFrame:
    """G7 over ``missing_evidence``."""
    numeric = F.col("column_type") == "Numeric"
    a, r, c = _pick([
        (F.col("missing_percentage") >= MISSING_DROP_PCT, "Drop Column", "mostly missing", "High"),
        (numeric & (F.abs(F.col("skewness")) >= SKEW_MEDIAN), "Median", "skewed numbers", "High"),
        (numeric, "Mean", "roughly symmetric numbers", "High"),
    ], ("Mode", "categorical values", "Medium"))
    return _out(ev, a, r, c, F.lit(rows))


def recommend_outliers(ev: DataFrame) -> DataFrame:
    """G8 over ``outlier_evidence``."""
    a, r, c = _pick([
        (F.col("outliers") == 0, "No Action", "no outliers", "High"),
        (F.abs(F.col("skewness")) < OUTLIER_ZSCORE_SKEW, "Z-Score", "roughly normal values", "Medium"),
        (F.col("outlier_percentage") > OUTLIER_WINSOR_PCT, "Winsorization", "many outliers: cap, do not drop", "Medium"),
    ], ("IQR", "few outliers in skewed values", "Medium"))
    return _out(ev, a, r, c, F.col("count"))


def selected_actions(recs: DataFrame, overrides: dict[str, str] | None = None, stage: str | None = None) -> list[tuple[str, str]]:
    """Turn recommendations (one row per column) into the ordered action plan,
    with the caller's overrides applied and checked against the stage's set."""
    plan = [(r["column_name"], r["action"]) for r in recs.select("column_name", "action").collect()]
    if overrides:
        plan = [(c, overrides.get(c, a)) for c, a in plan] + [(c, a) for c, a in overrides.items() if c not in dict(plan)]
    if stage is not None:
        allowed = STAGE_ACTIONS[stage]
        for c, a in plan:
            if a not in allowed:
                raise ValueError(f"'{a}' is not a {stage} action (column {c})")
    return plan
