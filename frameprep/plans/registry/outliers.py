"""Outlier queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from frameprep.functions.report import fixed
from frameprep.operators import outliers as O
from frameprep.plans.registry.sqlkit import fx, iqr_bounds_cte, outlier_evidence_sql, union_all, z_cte
from frameprep.queries import register
from frameprep.sources.tables import table


@register(
    "outlier_evidence",
    union_all([outlier_evidence_sql("events", "value"), outlier_evidence_sql("documents", "n_chars")]),
)
def q_outlier_evidence(spark, sf):
    ev = O.outlier_evidence(table(spark, sf, "events"), ["value"])
    dc = O.outlier_evidence(table(spark, sf, "documents"), ["n_chars"])
    return ev.unionByName(dc)


@register(
    "outlier_evidence_lineitem",
    union_all([outlier_evidence_sql("lineitem", c) for c in ("l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax")]),
)
def q_outlier_evidence_lineitem(spark, sf):
    li = table(spark, sf, "lineitem")
    return O.outlier_evidence(li, O.candidate_columns(li))


@register(
    "outlier_iqr_filter",
    f"""WITH {iqr_bounds_cte('b', 'events_missing', 'value')}
    SELECT event_id, value FROM events_missing, b WHERE value BETWEEN lo AND hi OR value IS NULL""",
)
def q_outlier_iqr_filter(spark, sf):
    return O.iqr_filter(table(spark, sf, "events_missing"), "value").select("event_id", "value")


@register(
    "outlier_winsorize",
    f"""WITH {iqr_bounds_cte('b', 'events_missing', 'value')}
    SELECT event_id, {fx('CASE WHEN value IS NOT NULL THEN greatest(lo, least(hi, value)) END')} AS value
    FROM events_missing, b""",
)
def q_outlier_winsorize(spark, sf):
    out = O.winsorize(table(spark, sf, "events_missing"), "value")
    return out.select("event_id", fixed(F.col("value")).alias("value"))


@register(
    "outlier_zscore_filter",
    f"""WITH {z_cte('z', 'documents', 'n_chars')}
    SELECT doc_id, n_chars FROM documents, z WHERE abs((n_chars - m) / sd) <= 3 OR n_chars IS NULL""",
)
def q_outlier_zscore_filter(spark, sf):
    return O.zscore_filter(table(spark, sf, "documents"), "n_chars").select("doc_id", "n_chars")


# plan: value by Z-Score, then user_id winsorized on what is left, event_id untouched
PLAN = [("value", "Z-Score"), ("user_id", "Winsorization"), ("event_id", "No Action")]

_PLAN_CTES = f"""WITH d0 AS (SELECT * FROM events_missing),
    {z_cte('z0', 'd0', 'value')},
    d1 AS (SELECT d0.* FROM d0, z0 WHERE abs((value - m) / sd) <= 3 OR value IS NULL),
    {iqr_bounds_cte('b1', 'd1', 'user_id')},
    d2 AS (SELECT event_id, CASE WHEN user_id IS NOT NULL THEN greatest(lo, least(hi, CAST(user_id AS DOUBLE))) END AS user_id,
                  value, user_id AS user_id_before FROM d1, b1)"""


@register(
    "outlier_plan",
    _PLAN_CTES + """
    SELECT 'value' AS column_name, 'Z-Score' AS action,
           CAST((SELECT count(*) FROM d0) - (SELECT count(*) FROM d1) AS BIGINT) AS affected,
           CAST(NULL AS BIGINT) AS values_capped,
           CAST((SELECT count(*) FROM d0) - (SELECT count(*) FROM d1) AS VARCHAR) || ' rows removed' AS description,
           (SELECT count(*) FROM d0) AS rows_before, (SELECT count(*) FROM d1) AS rows_after
    UNION ALL
    SELECT 'user_id', 'Winsorization',
           CAST(count(*) FILTER (WHERE user_id IS NULL OR user_id <> user_id_before) AS BIGINT),
           CAST(count(*) FILTER (WHERE user_id <> user_id_before) AS BIGINT),
           CAST(count(*) FILTER (WHERE user_id IS NULL OR user_id <> user_id_before) AS VARCHAR) || ' values capped',
           count(*), count(*)
    FROM d2
    UNION ALL
    SELECT 'event_id', 'No Action', 0, NULL, '0 rows removed', (SELECT count(*) FROM d1), (SELECT count(*) FROM d1)""",
)
def q_outlier_plan(spark, sf):
    _, summary = O.apply_outlier_actions(table(spark, sf, "events_missing"), PLAN)
    return summary


@register(
    "outlier_plan_rows",
    _PLAN_CTES + f"""
    SELECT event_id, {fx('user_id')} AS user_id, value FROM d2""",
)
def q_outlier_plan_rows(spark, sf):
    out, _ = O.apply_outlier_actions(table(spark, sf, "events_missing"), PLAN)
    return out.select("event_id", fixed(F.col("user_id")).alias("user_id"), "value")


@register(
    "outlier_remove_rows",
    f"""WITH {iqr_bounds_cte('b', 'events', 'value')}
        SELECT event_id, user_id, event_type, value FROM events, b WHERE value BETWEEN lo AND hi""",
)
def q_outlier_remove_rows(spark, sf):
    """Remove Rows keeps what lies inside the fences."""
    out, _ = O.apply_outlier_actions(table(spark, sf, "events"), [("value", "Remove Rows")])
    return out.select("event_id", "user_id", "event_type", "value")
