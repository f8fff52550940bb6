"""Class-imbalance queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from frameprep.operators import imbalance as B
from frameprep.plans.registry.encoding import PRIORITIES, _dummies
from frameprep.queries import register
from frameprep.sources.tables import table


def _target_sql(tbl: str, t: str, numeric: bool) -> str:
    order_asc = f"c DESC, {'CAST(v AS DOUBLE)' if numeric else 'v'} ASC"
    order_desc = f"c ASC, {'CAST(v AS DOUBLE)' if numeric else 'v'} DESC"
    return f"""
    WITH f AS (SELECT CAST({t} AS VARCHAR) v, count(*) c FROM {tbl} WHERE {t} IS NOT NULL GROUP BY 1),
         mj AS (SELECT v, c FROM f ORDER BY {order_asc} LIMIT 1),
         mn AS (SELECT v, c FROM f ORDER BY {order_desc} LIMIT 1)
    SELECT '{t}' AS target_column, 'Classification' AS problem_type, (SELECT CAST(count(*) AS BIGINT) FROM f) AS class_count,
           mj.v AS majority_class, CAST(mj.c AS BIGINT) AS majority_count, mn.v AS minority_class,
           CAST(mn.c AS BIGINT) AS minority_count, round(CAST(mj.c AS DOUBLE) / mn.c, 2) AS imbalance_ratio,
           round(CAST(mn.c AS DOUBLE) / (SELECT sum(c) FROM f) * 100, 2) AS minority_percentage
    FROM mj, mn"""


@register("target_distribution", _target_sql("labels", "toxic", True))
def q_target_distribution(spark, sf):
    return B.analyze_target_distribution(table(spark, sf, "labels"), "toxic")


@register("target_distribution_multiclass", _target_sql("events", "event_type", False))
def q_target_distribution_multiclass(spark, sf):
    return B.analyze_target_distribution(table(spark, sf, "events"), "event_type")


@register(
    "target_distribution_regression",
    """SELECT 'value' AS target_column, 'Regression' AS problem_type, CAST(count(DISTINCT value) AS BIGINT) AS class_count,
              CAST(NULL AS VARCHAR) AS majority_class, CAST(0 AS BIGINT) AS majority_count,
              CAST(NULL AS VARCHAR) AS minority_class, CAST(0 AS BIGINT) AS minority_count,
              CAST(NULL AS DOUBLE) AS imbalance_ratio, CAST(NULL AS DOUBLE) AS minority_percentage FROM events""",
)
def q_target_distribution_regression(spark, sf):
    return B.analyze_target_distribution(table(spark, sf, "events"), "value")


@register(
    "class_distribution",
    """SELECT CAST(toxic AS VARCHAR) AS class, CAST(count(*) AS BIGINT) AS count,
              round(CAST(count(*) AS DOUBLE) / (SELECT count(toxic) FROM labels) * 100, 2) AS percentage
       FROM labels WHERE toxic IS NOT NULL GROUP BY toxic""",
)
def q_class_distribution(spark, sf):
    return B.class_distribution(table(spark, sf, "labels"), "toxic")


@register(
    "class_weights",
    """SELECT CAST(toxic AS VARCHAR) AS class, CAST(count(*) AS BIGINT) AS count,
              CAST((SELECT count(toxic) FROM labels) AS DOUBLE)
                / (CAST((SELECT count(DISTINCT toxic) FROM labels) AS DOUBLE) * count(*)) AS weight
       FROM labels WHERE toxic IS NOT NULL GROUP BY toxic""",
)
def q_class_weights(spark, sf):
    return B.class_weights(table(spark, sf, "labels"), "toxic")


@register(
    "feature_matrix",
    f"""SELECT o_orderkey, o_custkey, o_totalprice, o_orderdate, o_orderstatus, {_dummies('o_orderpriority', PRIORITIES)}
        FROM orders""",
)
def q_feature_matrix(spark, sf):
    return B.feature_matrix(table(spark, sf, "orders"), "o_orderstatus")


@register(
    "undersample_counts",
    """SELECT CAST(toxic AS VARCHAR) AS class,
              (SELECT CAST(min(c) AS BIGINT) FROM (SELECT count(*) c FROM labels GROUP BY toxic)) AS count
       FROM labels GROUP BY toxic""",
)
def q_undersample_counts(spark, sf):
    out = B.random_undersample(table(spark, sf, "labels"), "toxic")
    return out.groupBy(F.col("toxic").cast("string").alias("class")).agg(F.count(F.lit(1)).alias("count"))


@register(
    "smote_counts",
    """SELECT CAST(toxic AS VARCHAR) AS class,
              (SELECT CAST(max(c) AS BIGINT) FROM (SELECT count(*) c FROM labels GROUP BY toxic)) AS count
       FROM labels GROUP BY toxic""",
)
def q_smote_counts(spark, sf):
    out = B.smote(table(spark, sf, "labels"), "toxic")
    return out.groupBy(F.col("toxic").cast("string").alias("class")).agg(F.count(F.lit(1)).alias("count"))


@register(
    "undersample",
    """SELECT quality, CAST((SELECT min(c) FROM (SELECT count(*) c FROM labels GROUP BY quality)) AS BIGINT) AS rows,
              CAST((SELECT min(c) FROM (SELECT count(*) c FROM labels GROUP BY quality)) AS BIGINT) AS different_rows,
              CAST(0 AS BIGINT) AS foreign_rows
       FROM labels GROUP BY quality""",
)
def q_undersample(spark, sf):
    """Per class: rows kept, how many are different rows, how many are not rows of the input."""
    lb = table(spark, sf, "labels")
    known = lb.select(F.col("doc_id").alias("d"), F.col("quality").alias("q"), F.col("toxic").alias("t"), F.lit(1).alias("hit"))
    out = B.random_undersample(lb, "quality").join(
        known, (F.col("doc_id") == F.col("d")) & (F.col("quality") == F.col("q")) & (F.col("toxic") == F.col("t")), "left")
    return out.groupBy("quality").agg(
        F.count(F.lit(1)).alias("rows"), F.countDistinct("doc_id").alias("different_rows"),
        F.count_if(F.col("hit").isNull()).alias("foreign_rows"))


@register(
    "smote",
    """SELECT quality, CAST((SELECT max(c) FROM (SELECT count(*) c FROM labels GROUP BY quality)) AS BIGINT) AS rows,
              CAST(count(*) AS BIGINT) AS originals_kept, CAST(0 AS BIGINT) AS outside
       FROM labels GROUP BY quality""",
)
def q_smote(spark, sf):
    """Per class: rows, input rows still there, rows outside the class's range. (That new
    rows lie on segments to true neighbours is tested against brute force.)"""
    lb = table(spark, sf, "labels")
    out = B.smote(lb, "quality")
    rng = lb.groupBy("quality").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), F.min("toxic").alias("tl"),
                                    F.max("toxic").alias("th")).withColumnRenamed("quality", "q")
    inside = F.col("doc_id").between(F.col("lo"), F.col("hi")) & F.col("toxic").between(F.col("tl"), F.col("th"))
    ids = lb.select(F.col("doc_id").alias("d"), F.col("quality").alias("dq"), F.col("toxic").alias("dt"))
    same = (F.col("doc_id") == F.col("d")) & (F.col("quality") == F.col("dq")) & (F.col("toxic") == F.col("dt"))
    marked = out.join(F.broadcast(rng), F.col("quality") == F.col("q")).join(ids, same, "left")
    return marked.groupBy("quality").agg(
        F.count(F.lit(1)).alias("rows"), F.countDistinct("d").alias("originals_kept"), F.count_if(~inside).alias("outside"))


@register(
    "smote_multiclass_counts",
    """SELECT event_type AS class,
              (SELECT CAST(max(c) AS BIGINT) FROM (SELECT count(*) c FROM events GROUP BY event_type)) AS count
       FROM events GROUP BY event_type""",
)
def q_smote_multiclass_counts(spark, sf):
    ev = table(spark, sf, "events").select("user_id", "value", "event_type")
    out = B.smote(ev, "event_type")
    return out.groupBy(F.col("event_type").alias("class")).agg(F.count(F.lit(1)).alias("count"))


@register(
    "class_weight_column",
    """SELECT doc_id, toxic,
              CAST((SELECT count(toxic) FROM labels) AS DOUBLE)
                / (CAST((SELECT count(DISTINCT toxic) FROM labels) AS DOUBLE) * count(*) OVER (PARTITION BY toxic))
                AS class_weight
       FROM labels""",
)
def q_class_weight_column(spark, sf):
    lb = table(spark, sf, "labels")
    return B.with_class_weight(lb, "toxic", B.class_weights(lb, "toxic")).select("doc_id", "toxic", "class_weight")


@register(
    "resample_shape",
    """SELECT CAST(2 * min(c) AS BIGINT) AS rows, CAST(3 AS BIGINT) AS columns
       FROM (SELECT count(*) c FROM labels GROUP BY toxic)""",
)
def q_resample_shape(spark, sf):
    return B.shape(B.random_undersample(table(spark, sf, "labels"), "toxic"))


@register(
    "imbalance_dispatch",
    """SELECT CAST(toxic AS VARCHAR) AS class, CAST(count(*) AS BIGINT) AS count,
              CAST((SELECT count(toxic) FROM labels) AS DOUBLE)
                / (CAST((SELECT count(DISTINCT toxic) FROM labels) AS DOUBLE) * count(*)) AS weight
       FROM labels WHERE toxic IS NOT NULL GROUP BY toxic""",
)
def q_imbalance_dispatch(spark, sf):
    """The action by name; Class Weights leaves the frame alone and returns the table."""
    lb = table(spark, sf, "labels")
    same, weights = B.apply_imbalance_action(lb, "toxic", "Class Weights")
    assert same is lb
    return weights


@register(
    "imbalance_guard",
    """SELECT action, true AS refused, CAST((SELECT count(DISTINCT value) FROM events) AS BIGINT) AS distinct_values
       FROM (VALUES ('Class Weights'), ('Random Undersampling'), ('SMOTE')) v(action)""",
)
def q_imbalance_guard(spark, sf):
    """Every resampling action is refused for a regression target found in the rows."""
    ev = table(spark, sf, "events")
    k = B.target_facts(ev, "value")["class_count"]
    rows = []
    for action in ("Class Weights", "Random Undersampling", "SMOTE"):
        try:
            B.apply_imbalance_action(ev, "value", action)
            rows.append((action, False, k))
        except ValueError:
            rows.append((action, True, k))
    return spark.createDataFrame(rows, "action STRING, refused BOOLEAN, distinct_values BIGINT")
