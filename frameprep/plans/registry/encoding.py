"""Categorical evidence and encoding queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from frameprep.functions.report import fixed
from frameprep.operators import encoding as E
from frameprep.plans.registry.sqlkit import fx, union_all
from frameprep.queries import register
from frameprep.sources.tables import table


def _cat_evidence_sql(tbl: str, c: str, key: str) -> str:
    return f"""
    WITH f AS (SELECT v, count(*) c, min(k) fst FROM (SELECT CAST({c} AS VARCHAR) v, {key} k FROM {tbl} WHERE {c} IS NOT NULL)
               GROUP BY v),
         a AS (SELECT count(*) u, sum(c) present, max(c) top FROM f),
         s AS (SELECT string_agg(v, ',' ORDER BY fst, v) s FROM (SELECT v, fst FROM f ORDER BY fst, v LIMIT 20)),
         n AS (SELECT count(*) n FROM {tbl})
    SELECT '{c}' AS column_name, 'string' AS dtype, CAST(n AS BIGINT) AS total_count,
           CAST(n - present AS BIGINT) AS missing_count, CAST(u AS BIGINT) AS unique_count,
           round(CAST(u AS DOUBLE) / present * 100, 2) AS unique_percentage, u <= 10 AS low_cardinality,
           u > 20 OR CAST(u AS DOUBLE) / present * 100 > 10 AS high_cardinality,
           round(CAST(top AS DOUBLE) / present * 100, 2) AS most_frequent_percentage,
           round(CAST(present AS DOUBLE) / u, 2) AS average_frequency, s AS sample_categories, t AS top_categories
    FROM a, s, n,
         (SELECT string_agg(v || ':' || c, ',' ORDER BY c DESC, v) t FROM (SELECT v, c FROM f ORDER BY c DESC, v LIMIT 10))"""


def _dummies(c: str, categories: tuple[str, ...], names: tuple[str, ...] | None = None) -> str:
    """One 0/1 column per category, as the driver's view wants it (no PIVOT)."""
    named = zip(categories, names or [f"{c}_{v}" for v in categories])
    return ", ".join(f"CAST(coalesce({c} = '{v}', false) AS DOUBLE) AS \"{n}\"" for v, n in named)


EVENT_TYPES = ("click", "error", "purchase", "signup", "view")
PRIORITIES = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")
STATUSES = ("F", "O", "P")


@register(
    "categorical_evidence",
    union_all([_cat_evidence_sql("orders", c, "o_orderkey") for c in ("o_orderstatus", "o_orderpriority")]),
)
def q_categorical_evidence(spark, sf):
    return E.analyze_categorical_features(table(spark, sf, "orders"), target="o_totalprice", order_by="o_orderkey")


@register(
    "categorical_evidence_missing",
    _cat_evidence_sql("events_missing", "event_type", "event_id"),
)
def q_categorical_evidence_missing(spark, sf):
    return E.analyze_categorical_features(table(spark, sf, "events_missing"), order_by="event_id")


@register(
    "one_hot",
    f"""SELECT event_id, {_dummies('event_type', EVENT_TYPES)},
               CAST(event_type IS NULL AS DOUBLE) AS event_type_nan FROM events_missing""",
)
def q_one_hot(spark, sf):
    out = E.encode(table(spark, sf, "events_missing"), "event_type", "One-Hot Encoding")
    return out.drop("user_id", "ts", "value")


@register(
    "frequency_encode",
    f"""SELECT event_id, {fx('CAST(f.c AS DOUBLE) / (SELECT count(event_type) FROM events_missing)')} AS event_type
        FROM events_missing e LEFT JOIN (SELECT event_type k, count(*) c FROM events_missing GROUP BY 1) f
        ON e.event_type = f.k""",
)
def q_frequency_encode(spark, sf):
    out = E.encode(table(spark, sf, "events_missing"), "event_type", "Frequency Encoding")
    return out.select("event_id", fixed(F.col("event_type")).alias("event_type"))


@register(
    "frequency_encode_wide",
    f"""SELECT l_orderkey, l_linenumber, {fx('CAST(f.c AS DOUBLE) / (SELECT count(*) FROM lineitem)')} AS l_partkey
        FROM lineitem l JOIN (SELECT l_partkey k, count(*) c FROM lineitem GROUP BY 1) f ON l.l_partkey = f.k""",
)
def q_frequency_encode_wide(spark, sf):
    out = E.encode(table(spark, sf, "lineitem"), "l_partkey", "Frequency Encoding")
    return out.select("l_orderkey", "l_linenumber", fixed(F.col("l_partkey")).alias("l_partkey"))


@register(
    "target_encode",
    f"""SELECT o_orderkey, {fx('t.m')} AS o_orderpriority
        FROM orders o JOIN (SELECT o_orderpriority k, avg(o_totalprice) m FROM orders GROUP BY 1) t ON o.o_orderpriority = t.k""",
)
def q_target_encode(spark, sf):
    out = E.encode(table(spark, sf, "orders"), "o_orderpriority", "Target Encoding", target="o_totalprice")
    return out.select("o_orderkey", fixed(F.col("o_orderpriority")).alias("o_orderpriority"))


@register(
    "ordinal_encode",
    """SELECT event_id, CAST(r.rk AS BIGINT) AS event_type
       FROM events e JOIN (SELECT k, row_number() OVER (ORDER BY fst, k) - 1 AS rk
                           FROM (SELECT event_type k, min(event_id) fst FROM events GROUP BY 1)) r
       ON e.event_type = r.k""",
)
def q_ordinal_encode(spark, sf):
    out = E.encode(table(spark, sf, "events"), "event_type", "Ordinal Encoding", order_by="event_id")
    return out.select("event_id", "event_type")


@register(
    "ordinal_encode_wide",
    """SELECT l_orderkey, l_linenumber, CAST(r.rk AS BIGINT) AS l_suppkey
       FROM lineitem l JOIN (SELECT k, row_number() OVER (ORDER BY fst, k) - 1 AS rk
                             FROM (SELECT l_suppkey k, min(l_orderkey) fst FROM lineitem GROUP BY 1)) r
       ON l.l_suppkey = r.k""",
)
def q_ordinal_encode_wide(spark, sf):
    out = E.encode(table(spark, sf, "lineitem"), "l_suppkey", "Ordinal Encoding", order_by="l_orderkey")
    return out.select("l_orderkey", "l_linenumber", "l_suppkey")


ENCODING_PLAN = [("o_orderstatus", "One-Hot Encoding"), ("o_orderpriority", "Target Encoding"),
                 ("o_totalprice", "Frequency Encoding"), ("o_custkey", "No Action")]


@register(
    "encoding_plan",
    """SELECT * FROM (VALUES ('o_orderstatus', 'One-Hot Encoding', CAST(6 AS BIGINT),
                              CAST(5 + (SELECT count(DISTINCT o_orderstatus) FROM orders) AS BIGINT)),
                             ('o_orderpriority', 'Target Encoding',
                              CAST(5 + (SELECT count(DISTINCT o_orderstatus) FROM orders) AS BIGINT),
                              CAST(5 + (SELECT count(DISTINCT o_orderstatus) FROM orders) AS BIGINT)),
                             ('o_custkey', 'No Action',
                              CAST(5 + (SELECT count(DISTINCT o_orderstatus) FROM orders) AS BIGINT),
                              CAST(5 + (SELECT count(DISTINCT o_orderstatus) FROM orders) AS BIGINT)))
       v(column_name, action, columns_before, columns_after)""",
)
def q_encoding_plan(spark, sf):
    _, summary = E.apply_encoding_actions(table(spark, sf, "orders"), ENCODING_PLAN, target="o_totalprice")
    return summary


@register(
    "encoding_plan_rows",
    f"""SELECT o.o_orderkey, o.o_custkey, o.o_totalprice, {fx('t.m')} AS o_orderpriority, {_dummies('o_orderstatus', STATUSES)}
        FROM orders o JOIN (SELECT o_orderpriority k, avg(o_totalprice) m FROM orders GROUP BY 1) t
        ON o.o_orderpriority = t.k""",
)
def q_encoding_plan_rows(spark, sf):
    out, _ = E.apply_encoding_actions(table(spark, sf, "orders"), ENCODING_PLAN, target="o_totalprice")
    return out.drop("o_orderdate").withColumn("o_orderpriority", fixed(F.col("o_orderpriority")))


@register(
    "one_hot_clash",
    f"""SELECT event_id, kind_a, kind_nan, {_dummies('kind', ('a', 'nan', 'rest'), ('kind_a_', 'kind_nan_', 'kind_rest'))},
               CAST(kind IS NULL AS DOUBLE) AS kind_nan__
        FROM events_clash""",
)
def q_one_hot_clash(spark, sf):
    """Categories whose column names are taken, and a literal category beside missing values."""
    return E.encode(table(spark, sf, "events_clash"), "kind", "One-Hot Encoding")


@register(
    "one_hot_sparse",
    """SELECT c_custkey, CAST((SELECT count(DISTINCT c_name) FROM customer) AS BIGINT) AS size,
              CAST(dense_rank() OVER (ORDER BY c_name) - 1 AS BIGINT) AS at FROM customer""",
)
def q_one_hot_sparse(spark, sf):
    """A category per customer as one vector column, fitted and applied as a table."""
    cu = table(spark, sf, "customer")
    out = E.fit_one_hot(cu, "c_name", sparse=True).transform(cu)
    return out.select("c_custkey", F.col("c_name.size").alias("size"), F.col("c_name.indices")[0].alias("at"))


@register(
    "encoding_candidates",
    """SELECT 'event_type' AS column_name UNION ALL SELECT 'props'
       UNION ALL SELECT 'ts' FROM (SELECT count(DISTINCT ts) u, count(ts) n FROM events) WHERE u <= 20 AND u * 100.0 / n <= 20""",
)
def q_encoding_candidates(spark, sf):
    found = E.encoding_candidates(table(spark, sf, "events"), target="value")
    return spark.createDataFrame([(c,) for c in found], "column_name STRING")


@register(
    "ordinal_encode_file_order",
    """SELECT l_orderkey, l_linenumber, CAST(r.rk AS BIGINT) AS l_suppkey
       FROM lineitem l JOIN (SELECT k, row_number() OVER (ORDER BY fst) - 1 AS rk
                             FROM (SELECT l_suppkey k, min(rn) fst FROM (SELECT l_suppkey, row_number() OVER () AS rn FROM lineitem) GROUP BY 1)) r
       ON l.l_suppkey = r.k""",
)
def q_ordinal_encode_file_order(spark, sf):
    """E8 without an order column: codes in the order in which values first stand in the file."""
    out = E.encode(table(spark, sf, "lineitem"), "l_suppkey", "Ordinal Encoding")
    return out.select("l_orderkey", "l_linenumber", "l_suppkey")


@register(
    "categorical_samples_file_order",
    """SELECT 'user_id' AS column_name, string_agg(CAST(k AS VARCHAR), ',' ORDER BY fst) AS sample_categories
       FROM (SELECT user_id k, min(rn) fst FROM (SELECT user_id, row_number() OVER () AS rn FROM events) GROUP BY 1 ORDER BY 2 LIMIT 20)""",
)
def q_categorical_samples_file_order(spark, sf):
    """E2 without an order column: the first 20 different values as they stand in the file."""
    ev = E.analyze_categorical_features(table(spark, sf, "events"), columns=["user_id"])
    return ev.select("column_name", "sample_categories")
