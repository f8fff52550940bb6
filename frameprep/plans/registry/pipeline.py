"""Whole-plan queries (L1-L3, G9-G10), the dataset fingerprint (S6) and the CSV
source (S1)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from frameprep.functions.fingerprint import fingerprint
from frameprep.functions.report import fixed
from frameprep.operators import profile as P
from frameprep.plans.pipeline import Plan, Step, check_plan, recommend_all
from frameprep.plans.registry.profile import _profile_columns_sql
from frameprep.plans.registry.recommend import auto_plan_sql
from frameprep.plans.registry.sqlkit import fx, union_all
from frameprep.functions.coerce import NA_WORDS
from frameprep.functions.written import shared_folder
from frameprep.queries import register
from frameprep.sources.csv import read_csv
from frameprep.sources.tables import table

PIPELINE = [
    Step("missing", [("value", "Median"), ("event_type", "Mode")]),
    Step("outliers", [("value", "Winsorization")]),
    Step("encoding", [("event_type", "Frequency Encoding")]),
    Step("scaling", [("value", "StandardScaler"), ("user_id", "MinMaxScaler")]),
]

_MODE = ("(SELECT event_type FROM events_missing WHERE event_type IS NOT NULL GROUP BY event_type "
         "ORDER BY count(*) DESC, event_type LIMIT 1)")


@register(
    "pipeline_end_to_end",
    f"""WITH m AS (SELECT event_id, user_id,
                          coalesce(value, (SELECT quantile_cont(value, 0.5) FROM events_missing)) AS value,
                          coalesce(event_type, {_MODE}) AS event_type FROM events_missing),
             b AS (SELECT q1 - CAST(1.5 AS DOUBLE) * (q3 - q1) lo, q3 + CAST(1.5 AS DOUBLE) * (q3 - q1) hi
                   FROM (SELECT quantile_cont(value, 0.25) q1, quantile_cont(value, 0.75) q3 FROM m)),
             w AS (SELECT event_id, user_id, CASE WHEN value IS NOT NULL THEN greatest(lo, least(hi, value)) END AS value,
                          event_type FROM m, b),
             e AS (SELECT event_id, user_id, value, CAST(f.c AS DOUBLE) / (SELECT count(event_type) FROM w) AS event_type
                   FROM w LEFT JOIN (SELECT event_type k, count(*) c FROM w GROUP BY 1) f ON w.event_type = f.k),
             s AS (SELECT event_id,
                          (CAST(user_id AS DOUBLE) - (SELECT min(user_id) FROM e))
                            / (SELECT CASE WHEN max(user_id) = min(user_id) THEN 1 ELSE max(user_id) - min(user_id) END FROM e)
                            AS user_id,
                          (value - (SELECT avg(value) FROM e))
                            / (SELECT CASE WHEN stddev_pop(value) = 0 THEN 1 ELSE stddev_pop(value) END FROM e) AS value,
                          event_type FROM e)
        SELECT event_id, {fx('user_id')} AS user_id, {fx('value')} AS value, {fx('event_type')} AS event_type FROM s""",
)
def q_pipeline_end_to_end(spark, sf):
    out, _, _ = Plan(PIPELINE).run(table(spark, sf, "events_missing"))
    return out.select("event_id", *[fixed(F.col(c)).alias(c) for c in ("user_id", "value", "event_type")])


@register(
    "pipeline_replay",
    f"""WITH m AS (SELECT event_id, user_id,
                          coalesce(value, (SELECT quantile_cont(value, 0.5) FROM events_missing)) AS value
                   FROM events_missing),
             b AS (SELECT q1 - CAST(1.5 AS DOUBLE) * (q3 - q1) lo, q3 + CAST(1.5 AS DOUBLE) * (q3 - q1) hi
                   FROM (SELECT quantile_cont(value, 0.25) q1, quantile_cont(value, 0.75) q3 FROM m))
        SELECT e.event_id, {fx('greatest(lo, least(hi, e.value))')} AS value FROM events e, b""",
)
def q_pipeline_replay(spark, sf):
    """Fit on events_missing, replay the fitted row-local steps on events (L3)."""
    plan = Plan([Step("missing", [("value", "Median")]), Step("outliers", [("value", "Winsorization")])])
    _, _, fitted = plan.run(table(spark, sf, "events_missing"))
    out = fitted.transform(table(spark, sf, "events"))
    return out.select("event_id", fixed(F.col("value")).alias("value"))


@register("auto_plan", auto_plan_sql())
def q_auto_plan(spark, sf):
    """Evidence -> rules -> steps for every stage (rows: stage, column, action)."""
    steps = recommend_all(table(spark, sf, "events_missing"), target="event_type", order_by="event_id")
    rows = []
    for st in steps:
        if st.stage == "schema":
            rows.append(("duplicates", "Dataset", st.duplicate_action))
        if st.stage == "imbalance":
            rows.append(("imbalance", "event_type", st.imbalance_action))
        rows += [(st.stage, c, a) for c, a in st.actions]
    return spark.createDataFrame(rows, "stage STRING, column_name STRING, action STRING")


@register("auto_pipeline")
def q_auto_pipeline(spark, sf):
    """The recommended plan applied end to end (shape of the result)."""
    df = table(spark, sf, "events_missing")
    steps = recommend_all(df, target="event_type", order_by="event_id")
    out, _, _ = Plan(steps, target="event_type", order_by="event_id").run(df, cut_lineage=True)
    return P.profile_columns(out)


DEALT_ROWS = 500_000  # rows of a task when a table is dealt out anew
_PRINTED = {"customer": "c_custkey", "orders": "o_orderkey", "lineitem": "l_orderkey", "events": "event_id", "labels": "doc_id"}


def _dealt_anew(df, n: int):
    """The ``n`` rows in other partitions, more of them for more rows; whole rows choose theirs, so no key is hot."""
    return df.repartition(3 + n // DEALT_ROWS, F.xxhash64(*df.columns))


@register(
    "fingerprint",
    union_all([f"""SELECT '{t}' AS table_name, CAST(count(*) AS BIGINT) AS rows, true AS same_in_any_order,
                          true AS changes_with_a_cell FROM {t}""" for t in _PRINTED]),
)
def q_fingerprint(spark, sf):
    """Equal for the same rows dealt out anew, other for one changed cell."""
    rows = []
    for name, key in _PRINTED.items():
        df = table(spark, sf, name)
        least = df.agg(F.min(key)).first()[0]
        one = fingerprint(df)
        n = df.count()
        dealt = fingerprint(_dealt_anew(df, n))
        changed = fingerprint(df.withColumn(key, F.when(F.col(key) == least, F.col(key) - 1).otherwise(F.col(key)).cast(df.schema[key].dataType)))
        rows.append((name, n, one == dealt, one != changed))
    return spark.createDataFrame(rows, "table_name STRING, rows BIGINT, same_in_any_order BOOLEAN, changes_with_a_cell BOOLEAN")


def _csv_sql() -> str:
    sql = _profile_columns_sql("events_missing")
    return sql.replace("'timestamp_ntz' AS dtype", "'string' AS dtype")


@register("csv_profile", _csv_sql())
def q_csv_profile(spark, sf):
    """The derived events table written as CSV and read back with type inference."""
    path = f"{shared_folder(spark)}/csv-{uuid.uuid4().hex}"
    (table(spark, sf, "events_missing").write.mode("overwrite")
     .option("header", True).option("timestampNTZFormat", "yyyy-MM-dd HH:mm:ss.SSSSSS").csv(path))
    return P.profile_columns(read_csv(spark, path))


_NA = ", ".join(f"'{w}'" for w in NA_WORDS)


@register(
    "csv_quoted",
    f"""SELECT doc_id, CASE WHEN text NOT IN ({_NA}) THEN md5(text) END AS text_md5, lang,
               CAST(1234567890123456789 - doc_id AS BIGINT) AS long_key FROM documents""",
)
def q_csv_quoted(spark, sf):
    """Whole texts with quotes, separators and line breaks, and 19-digit integers, through a CSV file."""
    path = f"{shared_folder(spark)}/csv-{uuid.uuid4().hex}"
    docs = table(spark, sf, "documents").select(
        "doc_id", "text", "lang", (F.lit(1234567890123456789) - F.col("doc_id")).alias("long_key"))
    (docs.write.option("header", True).option("escape", '"').option("quoteAll", True).option("emptyValue", "")
     .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path))
    got = read_csv(spark, path)
    return got.select("doc_id", F.md5("text").alias("text_md5"), "lang", "long_key")


PLAN_TARGETS = {"o_custkey": True, "o_totalprice": True, "o_orderdate": True, "o_orderstatus": False, "o_orderpriority": False}


@register(
    "plan_checks",
    union_all([f"""SELECT '{c}' AS target, {f"count(DISTINCT {c}) <= 10" if counted else "count(*) >= 0"} AS resampling_accepted,
                          {"true" if c in ("o_custkey", "o_totalprice") else "false"} AS target_encoding_accepted FROM orders"""
               for c, counted in PLAN_TARGETS.items()]),
)
def q_plan_checks(spark, sf):
    """What the plan check says about resampling by each target, and about encoding by its means, before any step runs."""
    df = table(spark, sf, "orders")

    def accepted(step, target):
        try:
            check_plan([step], target, df)
        except ValueError:
            return False
        return True

    rows = [(c, accepted(Step("imbalance", imbalance_action="SMOTE"), c), accepted(Step("encoding", [("o_orderkey", "Target Encoding")]), c))
            for c in PLAN_TARGETS]
    return spark.createDataFrame(rows, "target STRING, resampling_accepted BOOLEAN, target_encoding_accepted BOOLEAN")
