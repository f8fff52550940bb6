"""Scaling and feature-relevance queries."""

from __future__ import annotations

import itertools

from pyspark.sql import functions as F

from frameprep.functions.report import fixed
from frameprep.operators import relevance as R
from frameprep.operators import scaling as N
from frameprep.operators import schema as S
from frameprep.plans.registry.sqlkit import dbl, fx, union_all
from frameprep.queries import register
from frameprep.sources.tables import table

PART_WIDE_TYPES = [("p_partkey", "bigint"), ("p_size", "int"), ("p_retailprice", "double"), ("p_brand", "string"),
                   ("size_linear", "double"), ("price_neg", "double"), ("const_col", "string"),
                   ("const_num", "double"), ("near_const", "string")]
PART_WIDE_NUMERIC = [c for c, t in PART_WIDE_TYPES if t in ("bigint", "int", "double")]


def _scaling_evidence_sql(tbl: str, c: str) -> str:
    x = f"CAST({c} AS DOUBLE)"
    return f"""
    SELECT '{c}' AS column_name, CAST(n AS BIGINT) AS count, round(m, 4) AS mean, round(sd, 4) AS std,
           round(mn, 4) AS min, round(mx, 4) AS max, round(mx - mn, 4) AS range,
           CASE WHEN isnan(sk) THEN NULL ELSE round(sk, 4) END AS skewness,
           round(q1, 4) AS q1, round(q3, 4) AS q3, round(q3 - q1, 4) AS iqr,
           CASE WHEN q3 - q1 = 0 THEN CAST(0 AS DOUBLE) ELSE round(CAST(o AS DOUBLE) / n * 100, 2) END AS outlier_percentage
    FROM (SELECT s.*, (SELECT count(*) FROM {tbl} WHERE {x} < s.q1 - {dbl(1.5)} * (s.q3 - s.q1)
                                                   OR {x} > s.q3 + {dbl(1.5)} * (s.q3 - s.q1)) o
          FROM (SELECT count({x}) n, avg({x}) m, stddev_samp({x}) sd, min({x}) mn, max({x}) mx, skewness({x}) sk,
                       quantile_cont({x}, 0.25) q1, quantile_cont({x}, 0.75) q3 FROM {tbl}) s)"""


@register(
    "scaling_evidence",
    union_all([_scaling_evidence_sql("part_wide", c) for c in PART_WIDE_NUMERIC]),
)
def q_scaling_evidence(spark, sf):
    return N.analyze_scaling_features(table(spark, sf, "part_wide"))


@register(
    "scaling_evidence_events",
    union_all([_scaling_evidence_sql("events", c) for c in ("event_id", "user_id", "value")]),
)
def q_scaling_evidence_events(spark, sf):
    return N.analyze_scaling_features(table(spark, sf, "events"))


def _center_scale(kind: str, c: str, tbl: str) -> tuple[str, str]:
    x = f"CAST({c} AS DOUBLE)"
    if kind == "StandardScaler":
        return f"(SELECT avg({x}) FROM {tbl})", f"(SELECT CASE WHEN stddev_pop({x}) = 0 THEN 1 ELSE stddev_pop({x}) END FROM {tbl})"
    if kind == "MinMaxScaler":
        return (f"(SELECT min({x}) FROM {tbl})",
                f"(SELECT CASE WHEN max({x}) - min({x}) = 0 THEN 1 ELSE max({x}) - min({x}) END FROM {tbl})")
    iqr = f"quantile_cont({x}, 0.75) - quantile_cont({x}, 0.25)"
    return f"(SELECT quantile_cont({x}, 0.5) FROM {tbl})", f"(SELECT CASE WHEN {iqr} = 0 THEN 1 ELSE {iqr} END FROM {tbl})"


def _scaled(kind: str, c: str, tbl: str) -> str:
    center, scale = _center_scale(kind, c, tbl)
    return fx(f"(CAST({c} AS DOUBLE) - {center}) / {scale}")


@register("standard_scale", f"SELECT p_partkey, {_scaled('StandardScaler', 'p_retailprice', 'part_wide')} AS p_retailprice FROM part_wide")
def q_standard_scale(spark, sf):
    out = N.scale(table(spark, sf, "part_wide"), "p_retailprice", "StandardScaler")
    return out.select("p_partkey", fixed(F.col("p_retailprice")).alias("p_retailprice"))


@register(
    "minmax_scale",
    f"""SELECT p_partkey, {_scaled('MinMaxScaler', 'p_size', 'part_wide')} AS p_size,
               {_scaled('MinMaxScaler', 'const_num', 'part_wide')} AS const_num FROM part_wide""",
)
def q_minmax_scale(spark, sf):
    out, _ = N.apply_scaling_actions(table(spark, sf, "part_wide"), [("p_size", "MinMaxScaler"), ("const_num", "MinMaxScaler")])
    return out.select("p_partkey", fixed(F.col("p_size")).alias("p_size"), fixed(F.col("const_num")).alias("const_num"))


@register("robust_scale", f"SELECT event_id, {_scaled('RobustScaler', 'value', 'events')} AS value FROM events")
def q_robust_scale(spark, sf):
    out = N.scale(table(spark, sf, "events"), "value", "RobustScaler")
    return out.select("event_id", fixed(F.col("value")).alias("value"))


SCALING_PLAN = [("p_size", "StandardScaler"), ("p_retailprice", "MinMaxScaler"), ("const_num", "RobustScaler"),
                ("p_partkey", "No Action")]


def _plan_summary_sql() -> str:
    parts = []
    for c, a in SCALING_PLAN:
        x = f"CAST({c} AS DOUBLE)"
        if a == "No Action":
            amin, amax = f"min({x})", f"max({x})"
        else:
            center, scale = _center_scale(a, c, "part_wide")
            amin, amax = f"(min({x}) - {center}) / {scale}", f"(max({x}) - {center}) / {scale}"
        parts.append(
            f"SELECT '{c}' AS column_name, '{a}' AS action, round(min({x}), 4) AS before_min, round(max({x}), 4) AS before_max, "
            f"round({amin}, 4) AS after_min, round({amax}, 4) AS after_max FROM part_wide"
        )
    return union_all(parts)


@register("scaling_plan", _plan_summary_sql())
def q_scaling_plan(spark, sf):
    _, summary = N.apply_scaling_actions(table(spark, sf, "part_wide"), SCALING_PLAN)
    return summary


@register(
    "scaling_plan_rows",
    f"""SELECT p_partkey, {_scaled('StandardScaler', 'p_size', 'part_wide')} AS p_size,
               {_scaled('MinMaxScaler', 'p_retailprice', 'part_wide')} AS p_retailprice,
               {_scaled('RobustScaler', 'const_num', 'part_wide')} AS const_num FROM part_wide""",
)
def q_scaling_plan_rows(spark, sf):
    out, _ = N.apply_scaling_actions(table(spark, sf, "part_wide"), SCALING_PLAN)
    return out.select("p_partkey", *[fixed(F.col(c)).alias(c) for c in ("p_size", "p_retailprice", "const_num")])


# --- relevance ------------------------------------------------------------------

def _relevance_sql(tbl: str, target: str) -> str:
    parts = []
    for c, t in PART_WIDE_TYPES:
        numeric = t in ("bigint", "int", "double")
        if numeric and c != target:
            r = f"(SELECT round(corr(CAST({c} AS DOUBLE), CAST({target} AS DOUBLE)), 4) FROM {tbl})"
            corr = f"CASE WHEN isnan({r}) THEN NULL ELSE {r} END"
        else:
            corr = "CAST(NULL AS DOUBLE)"
        parts.append(f"""
        SELECT '{c}' AS column_name, '{t}' AS dtype, {'true' if c == target else 'false'} AS is_target,
               round(CAST(n - present AS DOUBLE) / n * 100, 2) AS missing_percentage, CAST(u AS BIGINT) AS unique_count,
               round(CAST(u AS DOUBLE) / present * 100, 2) AS unique_percentage, u <= 1 AND present > 0 AS is_constant,
               CAST(top AS DOUBLE) / present * 100 >= 95 AND NOT (u <= 1 AND present > 0) AS is_near_constant,
               round(CAST(top AS DOUBLE) / present * 100, 2) AS dominant_value_percentage,
               CAST(u AS DOUBLE) / present * 100 >= 95 AND n > 0 AS is_identifier_candidate,
               {corr} AS correlation_with_target
        FROM (SELECT count(*) n, count({c}) present, count(DISTINCT {c}) u,
                     (SELECT max(k) FROM (SELECT count(*) k FROM {tbl} WHERE {c} IS NOT NULL GROUP BY {c})) top FROM {tbl})""")
    return union_all(parts)


@register("relevance_evidence", _relevance_sql("part_wide", "p_retailprice"))
def q_relevance_evidence(spark, sf):
    df = table(spark, sf, "part_wide")
    features, _ = R.analyze_feature_relevance(df, "p_retailprice", S.analyze_schema(df))
    return features


def _pairs_sql(tbl: str) -> str:
    parts = []
    for a, b in itertools.combinations(PART_WIDE_NUMERIC, 2):
        r = f"corr(CAST({a} AS DOUBLE), CAST({b} AS DOUBLE))"
        parts.append(f"SELECT '{a}' AS column_1, '{b}' AS column_2, round({r}, 4) AS correlation, "
                     f"round(abs({r}), 4) AS absolute_correlation FROM {tbl}")
    return f"SELECT * FROM ({union_all(parts)}) WHERE NOT isnan(absolute_correlation) AND absolute_correlation >= 0.85"


@register("high_corr_pairs", _pairs_sql("part_wide"))
def q_high_corr_pairs(spark, sf):
    df = table(spark, sf, "part_wide")
    _, pairs = R.analyze_feature_relevance(df, "p_retailprice", S.analyze_schema(df))
    return pairs


@register(
    "corr_with_target",
    union_all([
        f"SELECT '{c}' AS column_name, round(corr(CAST({c} AS DOUBLE), CAST(l_extendedprice AS DOUBLE)), 4) AS correlation "
        f"FROM lineitem"
        for c in ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_discount", "l_tax")
    ]),
)
def q_corr_with_target(spark, sf):
    li = table(spark, sf, "lineitem")
    features, _ = R.analyze_feature_relevance(li, "l_extendedprice", S.analyze_schema(li))
    return features.where(F.col("correlation_with_target").isNotNull()).select(
        "column_name", F.col("correlation_with_target").alias("correlation"))


RELEVANCE_PLAN = [("p_partkey", "Drop"), ("const_col", "Drop"), ("const_num", "Drop"), ("near_const", "Investigate"),
                  ("p_retailprice", "Keep"), ("p_size", "Keep")]


@register(
    "relevance_target_guard",
    """SELECT true AS refused, CAST(count(*) AS BIGINT) AS rows, CAST(count(DISTINCT p_size) AS BIGINT) AS sizes FROM part_wide""",
)
def q_relevance_target_guard(spark, sf):
    """Dropping the target is refused and the rows stay as they were."""
    pw = table(spark, sf, "part_wide")
    try:
        pw, _ = R.apply_relevance_actions(pw, [("p_size", "Drop")], target="p_size")
        refused = False
    except ValueError:
        refused = True
    return pw.agg(F.lit(refused).alias("refused"), F.count(F.lit(1)).alias("rows"), F.countDistinct("p_size").alias("sizes"))


@register(
    "relevance_plan_rows",
    "SELECT p_size, p_retailprice, p_brand, size_linear, price_neg, near_const FROM part_wide",
)
def q_relevance_plan_rows(spark, sf):
    out, _ = R.apply_relevance_actions(table(spark, sf, "part_wide"), RELEVANCE_PLAN, target="p_retailprice")
    return out


@register(
    "relevance_counters",
    f"""WITH f AS ({_relevance_sql('part_wide', 'p_retailprice')}), p AS ({_pairs_sql('part_wide')})
        SELECT 'p_retailprice' AS target_column,
               CAST(count(*) FILTER (WHERE is_identifier_candidate) AS BIGINT) AS identifier_like,
               CAST(count(*) FILTER (WHERE is_constant) AS BIGINT) AS constant,
               CAST(count(*) FILTER (WHERE is_near_constant) AS BIGINT) AS near_constant,
               (SELECT CAST(count(*) AS BIGINT) FROM p) AS high_correlation_pairs
        FROM f""",
)
def q_relevance_counters(spark, sf):
    df = table(spark, sf, "part_wide")
    feats, pairs = R.analyze_feature_relevance(df, "p_retailprice", S.analyze_schema(df))
    return R.relevance_counters(feats, pairs, "p_retailprice")
