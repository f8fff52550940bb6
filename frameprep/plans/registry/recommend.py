"""Recommendation queries (G1-G8): the rule tables over each stage's evidence.
The oracle is a CASE over the stage's evidence SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from frameprep.operators import duplicates as D
from frameprep.operators import encoding as E
from frameprep.operators import imbalance as B
from frameprep.operators import outliers as O
from frameprep.operators import profile as P
from frameprep.operators import relevance as R
from frameprep.operators import scaling as N
from frameprep.operators import schema as S
from frameprep.plans import rules as G
from frameprep.plans.registry import cleaning, encoding, features, imbalance, profile
from frameprep.plans.registry.sqlkit import outlier_evidence_sql, union_all
from frameprep.queries import register
from frameprep.sources.tables import table


def _case(branches, default, rows_expr: str) -> str:
    def one(i):
        body = " ".join(f"WHEN {cond} THEN '{b[i]}'" for cond, *b in branches)
        return f"CASE {body} ELSE '{default[i]}' END"
    conf = f"CASE WHEN {rows_expr} < {G.SMALL_SAMPLE} THEN 'Low' ELSE {one(2)} END"
    return f"{one(0)} AS action, {one(1)} AS reason, {conf} AS confidence"


OUTLIER_RULES = [
    ("outliers = 0", "No Action", "no outliers", "High"),
    (f"abs(skewness) < {G.OUTLIER_ZSCORE_SKEW}", "Z-Score", "roughly normal values", "Medium"),
    (f"outlier_percentage > {G.OUTLIER_WINSOR_PCT}", "Winsorization", "many outliers: cap, do not drop", "Medium"),
]


@register(
    "recommend_outliers",
    f"""SELECT column_name, {_case(OUTLIER_RULES, ('IQR', 'few outliers in skewed values', 'Medium'), 'count')}
        FROM ({union_all([outlier_evidence_sql('events', 'value'), outlier_evidence_sql('documents', 'n_chars')]
                         + [outlier_evidence_sql('lineitem', c) for c in ('l_linenumber', 'l_quantity', 'l_extendedprice',
                                                                           'l_discount', 'l_tax')])})""",
)
def q_recommend_outliers(spark, sf):
    li = table(spark, sf, "lineitem")
    ev = (O.outlier_evidence(table(spark, sf, "events"), ["value"])
          .unionByName(O.outlier_evidence(table(spark, sf, "documents"), ["n_chars"]))
          .unionByName(O.outlier_evidence(li, O.candidate_columns(li))))
    return G.recommend_outliers(ev)


SCHEMA_RULES = [
    ("is_empty", "Drop Column", "column has no values", "High"),
    (f"dtype = 'string' AND date_conversion_percentage >= {G.DATETIME_PCT}", "Convert to Datetime", "text values read as dates", "High"),
    ("is_identifier_candidate AND dtype NOT IN ('double', 'float')", "Treat as Identifier", "nearly every value is distinct", "High"),
    (f"dtype = 'string' AND numeric_conversion_percentage >= {G.NUMERIC_PCT}", "Convert to Numeric", "text values read as numbers", "High"),
    ("is_constant", "No Action", "column holds one value", "Low"),
    (f"dtype = 'string' AND unique_count <= {G.CATEGORICAL_MAX}", "Convert to Categorical", "few distinct text values", "Medium"),
]


@register(
    "recommend_schema",
    f"""SELECT column_name, {_case(SCHEMA_RULES, ('No Action', 'type fits the values', 'Medium'), 'total_count')}
        FROM ({cleaning.ORACLE_SCHEMA_EVIDENCE})""",
)
def q_recommend_schema(spark, sf):
    return G.recommend_schema(S.analyze_schema(table(spark, sf, "orders_text"), order_by="o_orderkey"))


@register(
    "recommend_duplicates",
    """SELECT 'Dataset' AS column_name,
              CASE WHEN d = 0 THEN 'Keep Duplicates' WHEN ids > 0 THEN 'Remove Duplicates' ELSE 'Keep Duplicates' END AS action,
              CASE WHEN d = 0 THEN 'no duplicate rows' WHEN ids > 0 THEN 'rows repeat although an identifier-like column exists'
                   ELSE 'repeated rows may be genuine' END AS reason,
              CASE WHEN n < 30 THEN 'Low' WHEN d = 0 THEN 'High' WHEN ids > 0 THEN 'High' ELSE 'Medium' END AS confidence
       FROM (SELECT count(*) n, count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM labels_dup)) d,
                    (CASE WHEN count(DISTINCT doc_id) * 100.0 / count(*) >= 95 THEN 1 ELSE 0 END
                     + CASE WHEN count(DISTINCT quality) * 100.0 / count(*) >= 95 THEN 1 ELSE 0 END
                     + CASE WHEN count(DISTINCT toxic) * 100.0 / count(*) >= 95 THEN 1 ELSE 0 END) ids
             FROM labels_dup)""",
)
def q_recommend_duplicates(spark, sf):
    df = table(spark, sf, "labels_dup")
    return G.recommend_duplicates(D.duplicate_summary(df), D.identifier_candidates(df))


ENCODING_RULES = [
    ("low_cardinality", "One-Hot Encoding", "few categories", "High"),
    ("high_cardinality", "Target Encoding", "many categories and a numeric target", "Medium"),
]


@register(
    "recommend_encoding",
    f"""SELECT column_name, {_case(ENCODING_RULES, ('Frequency Encoding', 'many categories', 'Medium'), 'total_count')}
        FROM ({union_all([encoding._cat_evidence_sql('customer', c, 'c_custkey') for c in ('c_name', 'c_mktsegment')])})""",
)
def q_recommend_encoding(spark, sf):
    ev = E.analyze_categorical_features(table(spark, sf, "customer"), target="c_acctbal", order_by="c_custkey")
    return G.recommend_encoding(ev, target_is_numeric=True)


SCALING_RULES = [
    ("count = 0", "No Action", "no numeric values", "High"),
    (f"outlier_percentage > {G.SCALING_OUTLIER_PCT}", "RobustScaler", "many outliers", "High"),
    (f"abs(coalesce(skewness, 0)) < {G.SCALING_SKEW}", "StandardScaler", "roughly symmetric", "Medium"),
]


@register(
    "recommend_scaling",
    f"""SELECT column_name, {_case(SCALING_RULES, ('MinMaxScaler', 'skewed without many outliers', 'Medium'), 'count')}
        FROM ({union_all([features._scaling_evidence_sql('events', c) for c in ('event_id', 'user_id', 'value')]
                         + [features._scaling_evidence_sql('documents', 'n_chars')])})""",
)
def q_recommend_scaling(spark, sf):
    ev = N.analyze_scaling_features(table(spark, sf, "events")).unionByName(
        N.analyze_scaling_features(table(spark, sf, "documents"), columns=["n_chars"]))
    return G.recommend_scaling(ev)


IMBALANCE_RULES = [
    ("problem_type <> 'Classification'", "No Action", "not a classification target", "High"),
    (f"imbalance_ratio IS NULL OR imbalance_ratio < {G.IMBALANCE_MILD}", "No Action", "classes are balanced", "High"),
    (f"imbalance_ratio <= {G.IMBALANCE_SEVERE}", "Class Weights", "mild to moderate imbalance", "Medium"),
    (f"minority_count >= {G.UNDERSAMPLE_MINORITY}", "Random Undersampling", "severe imbalance, large minority", "Medium"),
    (f"minority_count >= {G.SMOTE_MIN_MINORITY}", "SMOTE", "severe imbalance", "Medium"),
]


@register(
    "recommend_imbalance",
    f"""SELECT target_column AS column_name,
               {_case(IMBALANCE_RULES, ('Class Weights', 'severe imbalance, minority too small to interpolate', 'Low'),
                      'coalesce(majority_count + minority_count, 0)')}
        FROM ({union_all([imbalance._target_sql('labels', 'toxic', True), imbalance._target_sql('labels', 'quality', True),
                          imbalance._target_sql('events', 'event_type', False)])})""",
)
def q_recommend_imbalance(spark, sf):
    lb, ev = table(spark, sf, "labels"), table(spark, sf, "events")
    facts = (B.analyze_target_distribution(lb, "toxic").unionByName(B.analyze_target_distribution(lb, "quality"))
             .unionByName(B.analyze_target_distribution(ev, "event_type")))
    return G.recommend_imbalance(facts)


MISSING_RULES = [
    (f"missing_percentage >= {G.MISSING_DROP_PCT}", "Drop Column", "mostly missing", "High"),
    (f"column_type = 'Numeric' AND abs(skewness) >= {G.SKEW_MEDIAN}", "Median", "skewed numbers", "High"),
    ("column_type = 'Numeric'", "Mean", "roughly symmetric numbers", "High"),
]


@register(
    "recommend_missing",
    f"""SELECT column_name, {_case(MISSING_RULES, ('Mode', 'categorical values', 'Medium'), '(SELECT count(*) FROM events_missing)')}
        FROM ({profile.ORACLE_MISSING_EVIDENCE})""",
)
def q_recommend_missing(spark, sf):
    df = table(spark, sf, "events_missing")
    return G.recommend_missing(P.missing_evidence(df), df.count())


RELEVANCE_RULES = [
    ("is_target", "Keep", "target column", "High"),
    ("is_constant", "Drop", "column holds one value", "High"),
    ("is_identifier_candidate", "Drop", "identifier-like column", "High"),
    ("is_near_constant", "Investigate", "one value dominates", "Medium"),
    ("column_name IN (SELECT column_1 FROM pairs UNION SELECT column_2 FROM pairs)", "Investigate",
     "highly correlated with another column", "Medium"),
    (f"abs(coalesce(correlation_with_target, 0)) >= {G.TARGET_CORRELATION}", "Investigate", "suspiciously close to the target", "Medium"),
    (f"missing_percentage >= {G.MISSING_DROP_PCT}", "Investigate", "mostly missing", "Medium"),
]


@register(
    "recommend_relevance",
    f"""WITH pairs AS ({features._pairs_sql('part_wide')})
        SELECT column_name, {_case(RELEVANCE_RULES, ('Keep', 'no problem found', 'Medium'), '(SELECT count(*) FROM part_wide)')}
        FROM ({features._relevance_sql('part_wide', 'p_retailprice')})""",
)
def q_recommend_relevance(spark, sf):
    df = table(spark, sf, "part_wide")
    feats, pairs = R.analyze_feature_relevance(df, "p_retailprice", S.analyze_schema(df))
    return G.recommend_relevance(feats, pairs, df.count())


def auto_plan_sql(tbl: str = "events_missing", target: str = "event_type") -> str:
    """Rows (stage, column_name, action) that the rules give for the derived events table."""
    cols, numbers = ("event_id", "user_id", "ts", "value", "event_type"), ("event_id", "user_id", "value")

    def facts(c: str) -> str:
        return (f"(SELECT count(*) n, count({c}) p, count(DISTINCT {c}) u, (SELECT max(k) FROM (SELECT count(*) k FROM {tbl} "
                f"WHERE {c} IS NOT NULL GROUP BY {c})) top FROM {tbl}) f")

    def action(rules, default: str) -> str:
        return "CASE " + " ".join(f"WHEN {cond} THEN '{a}'" for cond, a, *_ in rules) + f" ELSE '{default}' END"

    ident = "u * 100.0 / p >= 95"
    pair = " OR ".join(f"round(abs((SELECT corr(CAST({{c}} AS DOUBLE), CAST({o} AS DOUBLE)) FROM {tbl})), 4) >= {R.HIGH_CORRELATION}"
                       for o in numbers)
    parts = [f"SELECT 'schema' AS stage, '{c}' AS column_name, 'Treat as Identifier' AS action FROM {facts(c)} WHERE {ident}"
             for c in ("event_id", "user_id", "ts")]
    any_id = " OR ".join(f"(SELECT (u + CASE WHEN p < n THEN 1 ELSE 0 END) * 100.0 / n >= 95 FROM {facts(c)})" for c in cols)
    parts.append(f"""SELECT 'duplicates', 'Dataset', CASE WHEN count(*) > (SELECT count(*) FROM (SELECT DISTINCT * FROM {tbl}))
                     AND ({any_id}) THEN 'Remove Duplicates' ELSE 'Keep Duplicates' END FROM {tbl}""")
    parts.append(f"""SELECT 'missing', column_name, {action(MISSING_RULES, 'Mode')} FROM ({profile.ORACLE_MISSING_EVIDENCE})
                     WHERE missing_count > 0 AND column_name <> '{target}'""")
    parts.append(f"""SELECT 'outliers', column_name, a FROM (SELECT column_name, {action(OUTLIER_RULES, 'IQR')} AS a
                     FROM ({outlier_evidence_sql(tbl, 'value')})) WHERE a <> 'No Action'""")
    for c in cols:
        near = " OR ".join([x for x in [pair.replace("{c}", c)] if c in numbers] or ["false"])
        if c in numbers:  # not with itself
            near = " OR ".join(x for x in near.split(" OR ") if f"CAST({c} AS DOUBLE), CAST({c} AS DOUBLE)" not in x)
        parts.append(f"""SELECT 'relevance', '{c}', CASE WHEN '{c}' = '{target}' THEN 'Keep' WHEN u <= 1 AND p > 0 THEN 'Drop'
                         WHEN {ident} THEN 'Drop' WHEN top * 100.0 / p >= {R.NEAR_CONSTANT_PCT} THEN 'Investigate'
                         WHEN {near} THEN 'Investigate' WHEN (n - p) * 100.0 / n >= {G.MISSING_DROP_PCT} THEN 'Investigate'
                         ELSE 'Keep' END FROM {facts(c)}""")
    for c in numbers:
        parts.append(f"""SELECT 'scaling', '{c}', CASE WHEN (SELECT {ident} FROM {facts(c)}) THEN 'No Action'
                         ELSE {action(SCALING_RULES, 'MinMaxScaler')} END FROM ({features._scaling_evidence_sql(tbl, c)})""")
    parts.append(f"""SELECT 'imbalance', target_column, {action(IMBALANCE_RULES, 'Class Weights')}
                     FROM ({imbalance._target_sql(tbl, target, False)})""")
    return union_all(parts)
