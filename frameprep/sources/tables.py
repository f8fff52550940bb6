"""Parquet tables of a scale-factor folder, and the derived inputs that give the
stages something to find (gaps, copies, text numbers, constant columns).

The driver tables have no nulls and no duplicate rows, so the derived inputs
add them by plain SQL over whole tables. The same SQL text runs in Spark and
in DuckDB, which keeps the oracle honest.
"""

from __future__ import annotations

import os
import re

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem",
    "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)

DERIVED = {
    # numeric and text gaps that depend on the data (missing at random)
    "events_missing": """
        SELECT event_id, user_id, ts,
               CASE WHEN event_type = 'error' AND value < 20 THEN NULL ELSE value END AS value,
               CASE WHEN value > 150 THEN NULL ELSE event_type END AS event_type
        FROM events""",
    # exact duplicate rows: every toxic label row appears twice
    "labels_dup": """
        SELECT doc_id, quality, toxic FROM labels
        UNION ALL
        SELECT doc_id, quality, toxic FROM labels WHERE toxic = 1""",
    # duplicates with a null inside (the group list drops them, the count keeps them)
    "labels_dup_null": """
        SELECT CASE WHEN toxic = 1 THEN NULL ELSE quality END AS quality, toxic FROM labels""",
    # numbers and dates stored as text, with junk
    "orders_text": """
        SELECT o_orderkey,
               CASE WHEN o_orderstatus = 'P' AND o_orderpriority = '1-URGENT' THEN 'abc'
                    ELSE CAST(o_custkey AS STRING) END AS custkey_txt,
               CASE WHEN o_orderstatus = 'F' AND o_orderpriority = '5-LOW' THEN 'unknown'
                    ELSE CAST(CAST(o_orderdate AS DATE) AS STRING) END AS orderdate_txt,
               o_orderpriority
        FROM orders""",
    # categories whose one-hot names are taken: by columns, by the missing label
    "events_clash": """
        SELECT event_id, CAST(user_id AS DOUBLE) AS kind_a, value AS kind_nan,
               CASE WHEN event_type = 'click' THEN 'a' WHEN event_type = 'error' THEN 'nan'
                    WHEN event_type = 'view' THEN NULL ELSE 'rest' END AS kind
        FROM events""",
    # rows that differ in NaN and NULL alone
    "events_nan": """
        SELECT event_type, CASE WHEN value > 100 THEN CAST('NaN' AS DOUBLE) WHEN value < 10 THEN NULL
                                ELSE CAST(1 AS DOUBLE) END AS v
        FROM events""",
    # integers that a DOUBLE cannot hold, with gaps
    "lines_big": """
        SELECT l_orderkey, l_linenumber,
               CASE WHEN l_linenumber = 1 THEN NULL ELSE CAST(9007199254740991 AS BIGINT) + l_linenumber END AS big
        FROM lineitem""",
    # times as text, with a fraction and an offset from UTC
    "events_time_text": """
        SELECT event_id, CASE WHEN event_type = 'click' THEN CAST(ts AS STRING) || '+02:00'
                              WHEN event_type = 'error' THEN CAST(ts AS STRING) || 'Z'
                              ELSE CAST(ts AS STRING) END AS ts_txt
        FROM events""",
    # times as text, without seconds
    "events_minute_text": """
        SELECT event_id, substr(CAST(ts AS STRING), 1, 16) AS ts_txt FROM events""",
    # constant, near-constant, identifier and perfectly correlated columns
    "part_wide": """
        SELECT p_partkey, p_size, p_retailprice, p_brand,
               CAST(2 AS DOUBLE) * p_size + CAST(1 AS DOUBLE) AS size_linear,
               -p_retailprice AS price_neg,
               'x' AS const_col,
               CAST(1 AS DOUBLE) AS const_num,
               CASE WHEN p_size = 1 THEN 'B' ELSE 'A' END AS near_const
        FROM part""",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    if name in DERIVED:
        return derived(spark, sf_dir, name)
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def derived(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The derived input as a DataFrame. Tables are passed to ``spark.sql`` as
    DataFrame arguments, not as session-wide views, so concurrent callers with
    different folders cannot see each other's tables."""
    sql = DERIVED[name]
    used = [t for t in TABLES if re.search(rf"\b{t}\b", sql)]
    frames = {t: spark.read.parquet(os.path.join(sf_dir, f"{t}.parquet")) for t in used}
    templ = re.sub(r"\b(" + "|".join(used) + r")\b", r"{\1}", sql) if used else sql
    return spark.sql(templ, **frames)


def duckdb_views(con, sf_dir: str) -> None:
    """Register the tables and derived inputs in a DuckDB connection (tests)."""
    for n in TABLES:
        con.execute(f"CREATE OR REPLACE VIEW {n} AS SELECT * FROM read_parquet('{sf_dir}/{n}.parquet')")
    for n, sql in DERIVED.items():
        con.execute(f"CREATE OR REPLACE VIEW {n} AS {sql}")
