"""Profiling, missing-value evidence and duplicate queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from frameprep.functions.report import fixed
from frameprep.operators import duplicates as D
from frameprep.operators import profile as P
from frameprep.plans.registry.sqlkit import fx, union_all
from frameprep.queries import register
from frameprep.sources.tables import table

# Spark type names of the columns the oracle reports (fixed by the test tables)
SPARK_TYPES = {
    "events_missing": [("event_id", "bigint"), ("user_id", "bigint"), ("ts", "timestamp_ntz"),
                       ("value", "double"), ("event_type", "string")],
    "customer": [("c_custkey", "bigint"), ("c_name", "string"), ("c_nationkey", "int"),
                 ("c_acctbal", "double"), ("c_mktsegment", "string")],
}


def fixed_doubles(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round every DOUBLE column the same way the oracle does (sum order noise)."""
    return df.select(*[
        fixed(F.col(f.name), digits).alias(f.name) if isinstance(f.dataType, T.DoubleType) else F.col(f.name)
        for f in df.schema.fields
    ])


def _profile_columns_sql(tbl: str) -> str:
    parts = []
    for c, t in SPARK_TYPES[tbl]:
        parts.append(
            f"SELECT '{c}' AS column_name, '{t}' AS dtype, CAST(count(*) - count({c}) AS BIGINT) AS missing_count, "
            f"round(CAST(count(*) - count({c}) AS DOUBLE) / count(*) * 100, 2) AS missing_percentage, "
            f"CAST(count(DISTINCT {c}) AS BIGINT) AS unique_values FROM {tbl}"
        )
    return union_all(parts)


@register(
    "profile_dataset",
    """SELECT CAST(count(*) AS BIGINT) AS rows, CAST(5 AS BIGINT) AS columns,
              'event_id,user_id,ts,value,event_type' AS column_names,
              CAST(count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM events_missing)) AS BIGINT) AS duplicate_rows,
              CAST(5 * count(*) - count(event_id) - count(user_id) - count(ts) - count(value) - count(event_type) AS BIGINT)
                AS total_missing_values
       FROM events_missing""",
)
def q_profile_dataset(spark, sf):
    return P.profile_dataset(table(spark, sf, "events_missing"))


@register(
    "profile_dataset_duplicates",
    """SELECT CAST(count(*) AS BIGINT) AS rows, CAST(3 AS BIGINT) AS columns, 'doc_id,quality,toxic' AS column_names,
              CAST(count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM labels_dup)) AS BIGINT) AS duplicate_rows,
              CAST(0 AS BIGINT) AS total_missing_values
       FROM labels_dup""",
)
def q_profile_dataset_duplicates(spark, sf):
    return P.profile_dataset(table(spark, sf, "labels_dup"))


@register("profile_columns", _profile_columns_sql("events_missing"))
def q_profile_columns(spark, sf):
    return P.profile_columns(table(spark, sf, "events_missing"))


@register("profile_columns_customer", _profile_columns_sql("customer"))
def q_profile_columns_customer(spark, sf):
    return P.profile_columns(table(spark, sf, "customer"))


def _numeric_summary_sql(tbl: str, col: str) -> str:
    x = f"CAST({col} AS DOUBLE)"
    return (
        f"SELECT '{col}' AS column_name, CAST(count({x}) AS BIGINT) AS count, {fx(f'avg({x})')} AS mean, "
        f"{fx(f'quantile_cont({x}, 0.5)')} AS median, {fx(f'stddev_samp({x})')} AS std, "
        f"{fx(f'min({x})')} AS min, {fx(f'max({x})')} AS max, {fx(f'skewness({x})')} AS skewness, "
        f"{fx(f'quantile_cont({x}, 0.25)')} AS q1, {fx(f'quantile_cont({x}, 0.75)')} AS q3 FROM {tbl}"
    )


@register(
    "numeric_summary",
    union_all([_numeric_summary_sql("orders", "o_totalprice"), _numeric_summary_sql("orders", "o_custkey")]),
)
def q_numeric_summary(spark, sf):
    return fixed_doubles(P.numeric_summaries(table(spark, sf, "orders"), ["o_totalprice", "o_custkey"]))


@register("numeric_summary_missing", _numeric_summary_sql("events_missing", "value"))
def q_numeric_summary_missing(spark, sf):
    return fixed_doubles(P.numeric_summaries(table(spark, sf, "events_missing"), ["value"]))


def _categorical_summary_sql(tbl: str, col: str) -> str:
    return f"""
    WITH f AS (SELECT CAST({col} AS VARCHAR) v, count(*) c FROM {tbl} WHERE {col} IS NOT NULL GROUP BY 1),
         r AS (SELECT v, c, row_number() OVER (ORDER BY c DESC, v ASC) rk FROM f)
    SELECT '{col}' AS column_name, CAST(rk AS BIGINT) AS rank, v AS value, CAST(c AS BIGINT) AS count,
           (SELECT v FROM r WHERE rk = 1) AS most_frequent, (SELECT CAST(count(*) AS BIGINT) FROM f) AS unique_values
    FROM r WHERE rk <= 10"""


@register("categorical_summary", _categorical_summary_sql("events", "event_type"))
def q_categorical_summary(spark, sf):
    return P.categorical_summary(table(spark, sf, "events"), "event_type")


@register("categorical_summary_missing", _categorical_summary_sql("events_missing", "event_type"))
def q_categorical_summary_missing(spark, sf):
    return P.categorical_summary(table(spark, sf, "events_missing"), "event_type")


@register(
    "missingness_by_category",
    """SELECT event_type, CAST(count(*) FILTER (WHERE value IS NULL) AS BIGINT) AS missing_count,
              CAST(count(*) AS BIGINT) AS total_count,
              CAST(count(*) FILTER (WHERE value IS NULL) AS DOUBLE) / count(*) * 100 AS missing_percentage
       FROM events_missing WHERE event_type IS NOT NULL GROUP BY event_type""",
)
def q_missingness_by_category(spark, sf):
    return P.missingness_by_category(table(spark, sf, "events_missing"), "value", "event_type")


@register(
    "missing_columns",
    union_all([
        f"SELECT '{c}' AS column_name FROM events_missing HAVING count(*) > count({c})"
        for c, _ in SPARK_TYPES["events_missing"]
    ]),
)
def q_missing_columns(spark, sf):
    cols = P.missing_columns(table(spark, sf, "events_missing"))
    return spark.createDataFrame([(c,) for c in cols], "column_name STRING")


ORACLE_MISSING_EVIDENCE = """SELECT 'value' AS column_name, 'Numeric' AS column_type, CAST(count(*) - count(value) AS BIGINT) AS missing_count,
              round(CAST(count(*) - count(value) AS DOUBLE) / count(*) * 100, 2) AS missing_percentage,
              round(coalesce(skewness(value), 0), 4) AS skewness FROM events_missing
       UNION ALL
       SELECT 'event_type', 'Categorical', CAST(count(*) - count(event_type) AS BIGINT),
              round(CAST(count(*) - count(event_type) AS DOUBLE) / count(*) * 100, 2), CAST(NULL AS DOUBLE)
       FROM events_missing"""


@register("missing_evidence", ORACLE_MISSING_EVIDENCE)
def q_missing_evidence(spark, sf):
    return P.missing_evidence(table(spark, sf, "events_missing"))


@register(
    "duplicate_summary",
    """SELECT CAST(count(*) AS BIGINT) AS total_rows,
              CAST(count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM labels_dup)) AS BIGINT) AS duplicate_rows,
              round(CAST(count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM labels_dup)) AS DOUBLE) / count(*) * 100, 2)
                AS duplicate_percentage
       FROM labels_dup""",
)
def q_duplicate_summary(spark, sf):
    return D.duplicate_summary(table(spark, sf, "labels_dup"))


@register(
    "duplicate_groups",
    """SELECT doc_id, quality, toxic, CAST(count(*) AS BIGINT) AS count FROM labels_dup
       GROUP BY ALL HAVING count(*) > 1""",
)
def q_duplicate_groups(spark, sf):
    return D.duplicate_groups(table(spark, sf, "labels_dup"))


@register(
    "duplicate_groups_null",
    """SELECT quality, toxic, CAST(count(*) AS BIGINT) AS count FROM labels_dup_null
       WHERE quality IS NOT NULL AND toxic IS NOT NULL GROUP BY ALL HAVING count(*) > 1""",
)
def q_duplicate_groups_null(spark, sf):
    return D.duplicate_groups(table(spark, sf, "labels_dup_null"))


@register(
    "identifier_candidates",
    union_all([
        f"""SELECT '{c}' AS column_name, CAST(u AS BIGINT) AS unique_values, round(CAST(u AS DOUBLE) / n * 100, 2) AS unique_percentage
            FROM (SELECT count(DISTINCT {c}) + max(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END) u, count(*) n FROM orders)
            WHERE CAST(u AS DOUBLE) / n * 100 >= 95"""
        for c in ("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority")
    ]),
)
def q_identifier_candidates(spark, sf):
    return D.identifier_candidates(table(spark, sf, "orders"))


@register("remove_duplicates", "SELECT DISTINCT doc_id, quality, toxic FROM labels_dup")
def q_remove_duplicates(spark, sf):
    return D.remove_duplicates(table(spark, sf, "labels_dup"))


@register(
    "profile_columns_embeddings",
    """SELECT 'vec_id' AS column_name, 'bigint' AS dtype, CAST(count(*) - count(vec_id) AS BIGINT) AS missing_count,
              round(CAST(count(*) - count(vec_id) AS DOUBLE) / count(*) * 100, 2) AS missing_percentage,
              CAST(count(DISTINCT vec_id) AS BIGINT) AS unique_values FROM embeddings
       UNION ALL
       SELECT 'embedding', 'array<float>', CAST(count(*) - count(embedding) AS BIGINT),
              round(CAST(count(*) - count(embedding) AS DOUBLE) / count(*) * 100, 2), CAST(NULL AS BIGINT) FROM embeddings
       UNION ALL
       SELECT 'label', 'int', CAST(count(*) - count(label) AS BIGINT),
              round(CAST(count(*) - count(label) AS DOUBLE) / count(*) * 100, 2), CAST(count(DISTINCT label) AS BIGINT)
       FROM embeddings""",
)
def q_profile_columns_embeddings(spark, sf):
    """Nested columns are carried and counted as missing or not, not profiled for distincts."""
    return P.profile_columns(table(spark, sf, "embeddings"))


@register(
    "duplicate_summary_texts",
    """SELECT CAST(count(*) AS BIGINT) AS total_rows, CAST(count(*) - count(DISTINCT text) AS BIGINT) AS duplicate_rows,
              round(CAST(count(*) - count(DISTINCT text) AS DOUBLE) / count(*) * 100, 2) AS duplicate_percentage
       FROM documents""",
)
def q_duplicate_summary_texts(spark, sf):
    """Exact copies among whole document texts."""
    return D.duplicate_summary(table(spark, sf, "documents").select("text"))


@register(
    "categorical_summary_roles",
    _categorical_summary_sql("conversations", "role"),
)
def q_categorical_summary_roles(spark, sf):
    return P.categorical_summary(table(spark, sf, "conversations"), "role")


@register("categorical_summary_texts", _categorical_summary_sql("documents", "text"))
def q_categorical_summary_texts(spark, sf):
    """The most frequent whole texts (a top list is the feature), ties by text."""
    return P.categorical_summary(table(spark, sf, "documents"), "text")


@register("preview", "SELECT * FROM orders ORDER BY o_orderkey LIMIT 20")
def q_preview(spark, sf):
    return P.preview(table(spark, sf, "orders"), 20, "o_orderkey")


@register("inspect_column", _numeric_summary_sql("events_missing", "value"))
def q_inspect_column(spark, sf):
    """A numeric column with gaps; the inspector remembers its answer."""
    seen = P.MissingValueInspector(table(spark, sf, "events_missing"))
    first = seen.inspect_column("value")
    assert seen.inspect_column("value") is first
    return fixed_doubles(spark.createDataFrame([tuple(first.values())], P.NUMERIC_SUMMARY_DDL))


@register(
    "inspect_relationship",
    """SELECT event_type, CAST(count(*) FILTER (WHERE value IS NULL) AS BIGINT) AS missing_count,
              CAST(count(*) AS BIGINT) AS total_count,
              count(*) FILTER (WHERE value IS NULL) / CAST(count(*) AS DOUBLE) * 100.0 AS missing_percentage
       FROM events_missing WHERE event_type IS NOT NULL GROUP BY event_type""",
)
def q_inspect_relationship(spark, sf):
    """The relationship as the inspector remembers it."""
    seen = P.MissingValueInspector(table(spark, sf, "events_missing"))
    seen.inspect_missingness_relationship("value", "event_type")
    return seen.relationships["value_by_event_type"]


@register("keep_duplicates", "SELECT * FROM labels_dup")
def q_keep_duplicates(spark, sf):
    return D.apply_duplicate_action(table(spark, sf, "labels_dup"), "Keep Duplicates")


@register("remove_duplicates_nan", "SELECT DISTINCT event_type, CASE WHEN NOT isnan(v) THEN v END AS v FROM events_nan")
def q_remove_duplicates_nan(spark, sf):
    return D.apply_duplicate_action(table(spark, sf, "events_nan"), "Remove Duplicates")


@register("preview_file_order", "SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER () AS rn FROM events) WHERE value > 100 ORDER BY rn LIMIT 20")
def q_preview_file_order(spark, sf):
    """S4 of a filtered frame without an order column: its first rows as they stand in the file."""
    return P.preview(table(spark, sf, "events").where("value > 100"), 20)
