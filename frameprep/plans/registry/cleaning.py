"""Missing-value handling and schema queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from frameprep.functions.coerce import DATETIME_FORMATS, INFINITY_PATTERN, NUMBER_PATTERN
from frameprep.functions.report import fixed
from frameprep.operators import missing as M
from frameprep.operators import schema as S
from frameprep.plans.registry.sqlkit import fx, union_all
from frameprep.queries import register
from frameprep.sources.tables import table

_MODE_VALUE = "(SELECT value FROM events_missing WHERE value IS NOT NULL GROUP BY value ORDER BY count(*) DESC, value LIMIT 1)"
_MODE_TYPE = ("(SELECT event_type FROM events_missing WHERE event_type IS NOT NULL GROUP BY event_type "
              "ORDER BY count(*) DESC, event_type LIMIT 1)")


@register(
    "impute_mean",
    f"SELECT event_id, {fx('coalesce(value, (SELECT avg(value) FROM events_missing))')} AS value FROM events_missing",
)
def q_impute_mean(spark, sf):
    out = M.impute(table(spark, sf, "events_missing"), "value", "Mean")
    return out.select("event_id", fixed(F.col("value")).alias("value"))


@register(
    "impute_median",
    f"SELECT event_id, {fx('coalesce(value, (SELECT quantile_cont(value, 0.5) FROM events_missing))')} AS value FROM events_missing",
)
def q_impute_median(spark, sf):
    out = M.impute(table(spark, sf, "events_missing"), "value", "Median")
    return out.select("event_id", fixed(F.col("value")).alias("value"))


@register(
    "impute_mode",
    f"""SELECT event_id, coalesce(event_type, {_MODE_TYPE}) AS event_type,
               coalesce(value, {_MODE_VALUE}) AS value FROM events_missing""",
)
def q_impute_mode(spark, sf):
    out, _ = M.apply_missing_actions(table(spark, sf, "events_missing"), [("event_type", "Mode"), ("value", "Mode")])
    return out.select("event_id", "event_type", "value")


IMPUTE_PLAN = [("value", "Median"), ("event_type", "Mode"), ("user_id", "Leave Missing"), ("ts", "Drop Column")]


@register(
    "impute_plan",
    """SELECT 'value' AS column_name, 'Median' AS action, CAST(count(*) - count(value) AS BIGINT) AS missing_before,
              CAST(0 AS BIGINT) AS missing_after FROM events_missing
       UNION ALL SELECT 'event_type', 'Mode', CAST(count(*) - count(event_type) AS BIGINT), 0 FROM events_missing
       UNION ALL SELECT 'user_id', 'Leave Missing', CAST(count(*) - count(user_id) AS BIGINT),
                        CAST(count(*) - count(user_id) AS BIGINT) FROM events_missing
       UNION ALL SELECT 'ts', 'Drop Column', CAST(count(*) - count(ts) AS BIGINT), 0 FROM events_missing""",
)
def q_impute_plan(spark, sf):
    _, summary = M.apply_missing_actions(table(spark, sf, "events_missing"), IMPUTE_PLAN)
    return summary


@register(
    "impute_plan_rows",
    f"""SELECT event_id, user_id, {fx('coalesce(value, (SELECT quantile_cont(value, 0.5) FROM events_missing))')} AS value,
               coalesce(event_type, {_MODE_TYPE}) AS event_type FROM events_missing""",
)
def q_impute_plan_rows(spark, sf):
    out, _ = M.apply_missing_actions(table(spark, sf, "events_missing"), IMPUTE_PLAN)
    return out.select("event_id", "user_id", fixed(F.col("value")).alias("value"), "event_type")


# --- schema -------------------------------------------------------------------

def _numeric_ok(c: str) -> str:
    return (f"(regexp_matches({c}, '{NUMBER_PATTERN}') AND TRY_CAST(trim({c}) AS DOUBLE) IS NOT NULL)"
            f" OR regexp_matches({c}, '{INFINITY_PATTERN}')")


def _schema_text_sql(tbl: str, c: str, key: str) -> str:
    dc = " UNION ALL ".join(
        f"SELECT {j} AS j, '{s.replace(chr(39), chr(39) * 2)}' AS f, count(try_strptime(trim({c}), '{d}')) AS cnt FROM {tbl}"
        for j, (s, d) in enumerate(DATETIME_FORMATS)
    )
    return f"""
    WITH dc AS ({dc}),
         best AS (SELECT j, f, cnt FROM dc ORDER BY cnt DESC, j LIMIT 1),
         base AS (SELECT count(*) n, count({c}) present, count(DISTINCT {c}) u,
                         count(*) FILTER (WHERE {_numeric_ok(c)}) num FROM {tbl}),
         smp AS (SELECT string_agg(v, ',' ORDER BY k, v) s FROM
                   (SELECT CAST({c} AS VARCHAR) v, {key} k FROM {tbl} WHERE {c} IS NOT NULL ORDER BY {key}, v LIMIT 5))
    SELECT '{c}' AS column_name, 'string' AS dtype, CAST(n AS BIGINT) AS total_count,
           CAST(n - present AS BIGINT) AS missing_count, round(CAST(n - present AS DOUBLE) / n * 100, 2) AS missing_percentage,
           CAST(u AS BIGINT) AS unique_count, round(CAST(u AS DOUBLE) / present * 100, 2) AS unique_percentage,
           round(CAST(num AS DOUBLE) / present * 100, 2) AS numeric_conversion_percentage,
           round(CAST(best.cnt AS DOUBLE) / present * 100, 2) AS date_conversion_percentage,
           CASE WHEN best.cnt > 0 THEN best.f END AS datetime_format,
           present = 0 AS is_empty, u <= 1 AND present > 0 AS is_constant,
           CAST(u AS DOUBLE) / present * 100 >= 95 AND n > 0 AS is_identifier_candidate,
           coalesce(smp.s, '') AS sample_values,
           (SELECT CAST(max(k) AS BIGINT) FROM (SELECT count(*) k FROM {tbl} WHERE {c} IS NOT NULL GROUP BY {c})) AS top_count
    FROM base, best, smp"""


def _schema_numeric_sql(tbl: str, c: str, dtype: str, key: str) -> str:
    return f"""
    WITH base AS (SELECT count(*) n, count({c}) present, count(DISTINCT {c}) u FROM {tbl}),
         smp AS (SELECT string_agg(v, ',' ORDER BY k, v) s FROM
                   (SELECT CAST({c} AS VARCHAR) v, {key} k FROM {tbl} WHERE {c} IS NOT NULL ORDER BY {key}, v LIMIT 5))
    SELECT '{c}' AS column_name, '{dtype}' AS dtype, CAST(n AS BIGINT) AS total_count,
           CAST(n - present AS BIGINT) AS missing_count, round(CAST(n - present AS DOUBLE) / n * 100, 2) AS missing_percentage,
           CAST(u AS BIGINT) AS unique_count, round(CAST(u AS DOUBLE) / present * 100, 2) AS unique_percentage,
           round(CAST(present AS DOUBLE) / present * 100, 2) AS numeric_conversion_percentage,
           CAST(0 AS DOUBLE) AS date_conversion_percentage, CAST(NULL AS VARCHAR) AS datetime_format,
           present = 0 AS is_empty, u <= 1 AND present > 0 AS is_constant,
           CAST(u AS DOUBLE) / present * 100 >= 95 AND n > 0 AS is_identifier_candidate,
           coalesce(smp.s, '') AS sample_values,
           (SELECT CAST(max(k) AS BIGINT) FROM (SELECT count(*) k FROM {tbl} WHERE {c} IS NOT NULL GROUP BY {c})) AS top_count
    FROM base, smp"""


ORACLE_SCHEMA_EVIDENCE = union_all(
    [_schema_numeric_sql("orders_text", "o_orderkey", "bigint", "o_orderkey")]
    + [_schema_text_sql("orders_text", c, "o_orderkey") for c in ("custkey_txt", "orderdate_txt", "o_orderpriority")]
)


@register("schema_evidence", ORACLE_SCHEMA_EVIDENCE)
def q_schema_evidence(spark, sf):
    return S.analyze_schema(table(spark, sf, "orders_text"), order_by="o_orderkey")


@register(
    "to_numeric",
    f"""SELECT o_orderkey, CASE WHEN regexp_matches(custkey_txt, '{NUMBER_PATTERN}') THEN TRY_CAST(trim(custkey_txt) AS DOUBLE)
                               END AS custkey_txt FROM orders_text""",
)
def q_to_numeric(spark, sf):
    out = S.apply_schema_action(table(spark, sf, "orders_text"), "custkey_txt", "Convert to Numeric")
    return out.select("o_orderkey", "custkey_txt")


@register(
    "to_datetime",
    "SELECT o_orderkey, try_strptime(trim(orderdate_txt), '%Y-%m-%d') AS orderdate_txt FROM orders_text",
)
def q_to_datetime(spark, sf):
    out = S.apply_schema_action(table(spark, sf, "orders_text"), "orderdate_txt", "Convert to Datetime")
    return out.select("o_orderkey", "orderdate_txt")


@register("to_categorical", "SELECT o_orderkey, CAST(o_orderpriority AS VARCHAR) AS o_orderpriority FROM orders_text")
def q_to_categorical(spark, sf):
    out = S.apply_schema_action(table(spark, sf, "orders_text"), "o_orderpriority", "Convert to Categorical")
    return out.select("o_orderkey", "o_orderpriority")


SCHEMA_PLAN = [("o_orderkey", "Treat as Identifier"), ("custkey_txt", "Convert to Numeric"),
               ("orderdate_txt", "Convert to Datetime"), ("o_orderpriority", "Drop Column")]


@register(
    "schema_plan",
    """SELECT 'Dataset' AS column_name, 'Remove Duplicates' AS action, 'N/A' AS type_before, 'N/A' AS type_after,
              CAST(count(*) AS BIGINT) AS rows,
              CAST(count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM orders_text)) AS BIGINT) AS duplicate_rows,
              CAST(count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM orders_text)) AS BIGINT) AS rows_removed
       FROM orders_text
       UNION ALL
       SELECT c, a, tb, ta, (SELECT count(*) FROM (SELECT DISTINCT * FROM orders_text)), NULL, NULL
       FROM (VALUES ('o_orderkey', 'Treat as Identifier', 'bigint', 'bigint'),
                    ('custkey_txt', 'Convert to Numeric', 'string', 'double'),
                    ('orderdate_txt', 'Convert to Datetime', 'string', 'timestamp_ntz'),
                    ('o_orderpriority', 'Drop Column', 'string', 'Dropped')) v(c, a, tb, ta)""",
)
def q_schema_plan(spark, sf):
    _, summary = S.apply_schema_actions(table(spark, sf, "orders_text"), SCHEMA_PLAN, "Remove Duplicates")
    return summary


@register(
    "schema_plan_rows",
    f"""SELECT DISTINCT o_orderkey,
               CASE WHEN regexp_matches(custkey_txt, '{NUMBER_PATTERN}') THEN TRY_CAST(trim(custkey_txt) AS DOUBLE) END AS custkey_txt,
               try_strptime(trim(orderdate_txt), '%Y-%m-%d') AS orderdate_txt
        FROM orders_text""",
)
def q_schema_plan_rows(spark, sf):
    out, _ = S.apply_schema_actions(table(spark, sf, "orders_text"), SCHEMA_PLAN, "Remove Duplicates")
    return out


@register("remove_duplicates_plan", "SELECT DISTINCT quality, toxic FROM labels_dup_null")
def q_remove_duplicates_plan(spark, sf):
    out, _ = S.apply_schema_actions(table(spark, sf, "labels_dup_null"), [], "Remove Duplicates")
    return out


@register(
    "schema_evidence_documents",
    union_all([_schema_numeric_sql("documents", c, "bigint", "doc_id") for c in ("doc_id", "n_chars")]
              + [_schema_text_sql("documents", c, "doc_id") for c in ("text", "lang", "source")]),
)
def q_schema_evidence_documents(spark, sf):
    """Schema evidence over whole document texts (samples are the first five texts by doc_id)."""
    return S.analyze_schema(table(spark, sf, "documents"), order_by="doc_id")


@register(
    "missing_choices",
    """SELECT 'value' AS column_name, 'Mean,Median,Mode,Drop Column,Leave Missing,No Action' AS choices
       FROM events_missing HAVING count(*) > count(value)
       UNION ALL
       SELECT 'event_type', 'Mode,Drop Column,Leave Missing,No Action' FROM events_missing HAVING count(*) > count(event_type)""",
)
def q_missing_choices(spark, sf):
    """M7: the choices for every column with gaps, by its evidence."""
    from frameprep.operators.profile import missing_evidence

    rows = missing_evidence(table(spark, sf, "events_missing")).collect()
    return spark.createDataFrame([(r["column_name"], ",".join(M.allowed_actions(r["column_type"]))) for r in rows],
                                 "column_name STRING, choices STRING")


@register(
    "impute_big_integers",
    """SELECT l_orderkey, l_linenumber, coalesce(big, (SELECT big FROM lines_big WHERE big IS NOT NULL GROUP BY big
                                                      ORDER BY count(*) DESC, big LIMIT 1)) AS big FROM lines_big""",
)
def q_impute_big_integers(spark, sf):
    """M3: a mode above 2^53 fills without losing digits."""
    return M.impute(table(spark, sf, "lines_big"), "big", "Mode")


@register("schema_no_action", "SELECT * FROM orders_text")
def q_schema_no_action(spark, sf):
    """An explicit No Action leaves the column as it is."""
    ot = table(spark, sf, "orders_text")
    out, _ = S.apply_schema_actions(ot, [(c, "No Action") for c in ot.columns])
    return out


@register(
    "to_datetime_fraction",
    """SELECT event_id, CASE WHEN event_type = 'click' THEN ts - INTERVAL 2 HOUR ELSE ts END AS ts FROM events""",
)
def q_to_datetime_fraction(spark, sf):
    """Fractions of a second, Z and offsets; offsets give the UTC wall time."""
    out = S.apply_schema_action(table(spark, sf, "events_time_text"), "ts_txt", "Convert to Datetime")
    return out.withColumnRenamed("ts_txt", "ts")


FILE_ORDER_COLUMNS = ("l_partkey", "l_suppkey", "l_linenumber", "l_returnflag", "l_linestatus")


@register(
    "schema_samples_file_order",
    union_all([f"""SELECT '{c}' AS column_name, string_agg(CAST({c} AS VARCHAR), ',' ORDER BY rn) AS sample_values
                   FROM (SELECT {c}, row_number() OVER () AS rn FROM lineitem) WHERE rn <= 5""" for c in FILE_ORDER_COLUMNS]),
)
def q_schema_samples_file_order(spark, sf):
    """C3 without an order column: the first values of each column as they stand in the file."""
    return S.analyze_schema(table(spark, sf, "lineitem").select(*FILE_ORDER_COLUMNS)).select("column_name", "sample_values")


@register("to_datetime_minutes", "SELECT event_id, date_trunc('minute', ts) AS ts_txt FROM events")
def q_to_datetime_minutes(spark, sf):
    """Times without seconds."""
    return S.apply_schema_action(table(spark, sf, "events_minute_text"), "ts_txt", "Convert to Datetime").select("event_id", "ts_txt")
