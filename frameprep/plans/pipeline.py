"""Plans (L1-L3) and evidence reuse.

A ``Plan`` is an ordered list of stage steps over one source frame. ``run``
checks every step against its closed action set before any Spark job runs
(G9), then applies the stages in order; each returns the next frame and a
summary. Row-local steps are recorded as a ``FittedPlan`` that can be applied
to new data, including a streaming source (fit once, transform many).

Fitted literals pile up in the plan of a long pipeline, so ``run`` can cut the
lineage after each stage with a table written to the shared folder (named by
``spark.checkpoint.dir``).
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from frameprep.functions.coerce import is_numeric_type
from frameprep.functions.fingerprint import fingerprint
from frameprep.functions.written import written
from frameprep.operators import duplicates as D
from frameprep.operators import encoding as E
from frameprep.operators import imbalance as B
from frameprep.operators import missing as M
from frameprep.operators import outliers as O
from frameprep.operators import profile as P
from frameprep.operators import relevance as R
from frameprep.operators import scaling as N
from frameprep.operators import schema as S
from frameprep.plans import rules as G

# --- fixed values -----------------------------------------------------------
PAGE_ORDER = ("schema", "encoding", "relevance", "scaling", "imbalance", "missing", "outliers")
# ---------------------------------------------------------------------------
DEFAULT_ORDER = ("schema", "missing", "outliers", "relevance", "encoding", "scaling", "imbalance")


@dataclass
class Step:
    stage: str
    actions: list[tuple[str, str]] = field(default_factory=list)
    duplicate_action: str = "Keep Duplicates"  # schema stage only
    imbalance_action: str = "No Action"  # imbalance stage only
    formats: dict[str, str] = field(default_factory=dict)  # schema stage only: datetime formats the evidence found


@dataclass
class FittedPlan:
    """Row-local transforms with their fitted parameters (L3)."""

    transforms: list = field(default_factory=list)

    def transform(self, df: DataFrame) -> DataFrame:
        for t in self.transforms:
            df = t(df)
        return df


def check_plan(steps: list[Step], target: str | None, df: DataFrame | None = None, order_by: str | None = None) -> None:
    """Closed action sets, target guards, and (with the frame's schema) fills that
    fit the column's type and targets that can be resampled; raises before any step runs.
    Only the number of classes of a numeric or date target needs the data: one aggregate.

    A column whose type an earlier step changes is checked by the type it gets."""
    types = {f.name: f.dataType for f in df.schema.fields} if df is not None else {}
    for st in steps:
        if st.stage not in G.STAGE_ACTIONS:
            raise ValueError(f"Unknown stage: {st.stage}")
        allowed = G.STAGE_ACTIONS[st.stage]
        for c, a in st.actions:
            if a not in allowed:
                raise ValueError(f"'{a}' is not a {st.stage} action (column {c})")
            if c == target and st.stage == "relevance" and a != "Keep":
                raise ValueError(f"The target column '{c}' can only be kept")
            if c == target and a in ("Drop", "Drop Column"):
                raise ValueError(f"The target column '{c}' cannot be dropped")
            if a == "Target Encoding" and target is None:
                raise ValueError("Target Encoding needs a target column")
            if a == "Ordinal Encoding" and order_by is None:
                raise ValueError("Ordinal Encoding needs order_by: a column that gives the order rows were seen in")
            if st.stage == "schema" and c in types:
                types[c] = {"Convert to Numeric": T.DoubleType(), "Convert to Datetime": T.TimestampNTZType(),
                            "Convert to Categorical": T.StringType()}.get(a, types[c])
            if st.stage == "missing" and a in M.NUMERIC_ONLY and c in types and not is_numeric_type(types[c]):
                raise ValueError(f"{a} needs a numeric column; '{c}' is {types[c].simpleString()}")
            if st.stage == "encoding" and a == "Target Encoding" and target in types and not isinstance(
                    types[target], (T.NumericType, T.BooleanType)):
                raise ValueError(f"Target Encoding needs a numeric target; '{target}' is {types[target].simpleString()}")
        if st.stage == "schema" and st.duplicate_action not in G.STAGE_ACTIONS["duplicates"]:
            raise ValueError(f"Unknown duplicate action: {st.duplicate_action}")
        if st.stage == "imbalance":
            if st.imbalance_action not in G.STAGE_ACTIONS["imbalance"]:
                raise ValueError(f"Unknown imbalance action: {st.imbalance_action}")
            if st.imbalance_action != "No Action" and target is None:
                raise ValueError("Imbalance handling needs a target column")
            if st.imbalance_action != "No Action" and isinstance(types.get(target), (T.NumericType, T.DatetimeType)) \
                    and df is not None and B.target_facts(df, target)["problem_type"] != "Classification":
                raise ValueError(f"{st.imbalance_action} is only for classification targets")


class Plan:
    def __init__(self, steps: list[Step], target: str | None = None, order_by: str | None = None,
                 order: tuple[str, ...] | None = None):
        rank = {s: i for i, s in enumerate(order or DEFAULT_ORDER)}
        self.steps = sorted(steps, key=lambda s: rank.get(s.stage, len(rank)))
        self.target = target
        self.order_by = order_by

    def run(self, df: DataFrame, cut_lineage: bool = False) -> tuple[DataFrame, dict[str, DataFrame], FittedPlan]:
        check_plan(self.steps, self.target, df, self.order_by)
        summaries: dict[str, DataFrame] = {}
        fitted = FittedPlan()
        t = self.target
        for st in self.steps:
            if st.stage == "schema":
                rec: list = []
                df, summaries["schema"] = S.apply_schema_actions(df, st.actions, st.duplicate_action, formats=st.formats, record=rec)
                fitted.transforms.append(_schema_replay(rec))
            elif st.stage == "missing":
                acts = [(c, a) for c, a in st.actions if c in df.columns]
                rec = []
                df, summaries["missing"] = M.apply_missing_actions(df, acts, record=rec)
                fitted.transforms.append(_missing_replay(acts, rec[0]))
            elif st.stage == "outliers":
                rec: list = []
                df, summaries["outliers"] = O.apply_outlier_actions(df, st.actions, record=rec)
                fitted.transforms.append(lambda d, rec=rec: O.replay(d, rec))
            elif st.stage == "relevance":
                df, summaries["relevance"] = R.apply_relevance_actions(df, st.actions, target=t)
                drops = [c for c, a in st.actions if a == "Drop"]
                fitted.transforms.append(lambda d, drops=drops: d.drop(*drops))
            elif st.stage == "encoding":
                encs: list = []
                df, summaries["encoding"] = E.apply_encoding_actions(df, st.actions, target=t, order_by=self.order_by,
                                                                     record=encs)
                fitted.transforms.extend(e.transform for e in encs)
            elif st.stage == "scaling":
                rec = []
                df, summaries["scaling"] = N.apply_scaling_actions(df, st.actions, record=rec)
                scalers = rec[0]
                fitted.transforms.append(lambda d, sc=scalers: d.withColumns({c: s.expr(d) for c, s in sc.items()}) if sc else d)
            elif st.stage == "imbalance":
                df, weights = B.apply_imbalance_action(df, t, st.imbalance_action)
                if weights is not None:
                    summaries["class_weights"] = weights
            if cut_lineage:
                df = written(df, st.stage)
        return df, summaries, fitted


def _schema_replay(recorded):
    def apply(d: DataFrame) -> DataFrame:
        exprs = {c: S.conversion(d, c, a, fmt) for c, a, fmt in recorded if a != "Drop Column" and c in d.columns}
        drops = [c for c, a, _ in recorded if a == "Drop Column"]
        return (d.withColumns(exprs) if exprs else d).drop(*drops)
    return apply


def _missing_replay(acts, fills):
    def apply(d: DataFrame) -> DataFrame:
        exprs = {c: M._filled(d, c, a, fills[c]) for c, a in acts if a in ("Mean", "Median", "Mode") and c in d.columns}
        drops = [c for c, a in acts if a == "Drop Column"]
        return (d.withColumns(exprs) if exprs else d).drop(*drops)
    return apply


class EvidenceCache:
    """Evidence keyed by (fingerprint, stage, columns, target); a changed
    frame gets a new fingerprint and so new evidence. A frame is hashed once: frames
    do not change, so its fingerprint is kept with it."""

    def __init__(self):
        self._store: dict = {}
        self._prints: list[tuple[DataFrame, str | None, str]] = []
        self.hits = 0

    def fingerprint(self, df: DataFrame, target: str | None) -> str:
        for known, t, value in self._prints:
            if known is df and t == target:
                return value
        value = fingerprint(df, target)
        self._prints = [*self._prints[-7:], (df, target, value)]
        return value

    def get(self, df: DataFrame, stage: str, columns, target, compute):
        key = (self.fingerprint(df, target), stage, tuple(columns or ()), target)
        if key in self._store:
            self.hits += 1
            return self._store[key]
        value = compute()
        self._store[key] = value
        return value


def recommend_all(df: DataFrame, target: str | None = None, order_by: str | None = None,
                  cache: EvidenceCache | None = None, overrides: dict[str, dict[str, str]] | None = None) -> list[Step]:
    """Evidence -> rules -> steps for every stage, on the frame as given
    (each stage's evidence is computed once and reused through ``cache``)."""
    cache = cache or EvidenceCache()
    overrides = overrides or {}
    steps = []
    schema_ev = cache.get(df, "schema", None, target, lambda: S.analyze_schema(df, order_by))
    schema_rows = [r.asDict() for r in schema_ev.collect()]
    n = schema_rows[0]["total_count"] if schema_rows else df.count()
    schema_recs = G.recommend_schema(schema_ev)
    dup = cache.get(df, "duplicates", None, target, lambda: G.recommend_duplicates(
        D.duplicate_summary(df), D.identifier_candidates(df)).first()["action"])
    acts = [(c, a) for c, a in G.selected_actions(schema_recs, overrides.get("schema"), "schema")
            if a != "No Action" and c != target]
    formats = {r["column_name"]: r["datetime_format"] for r in schema_rows if r["datetime_format"]}
    steps.append(Step("schema", acts, duplicate_action=dup, formats=formats))
    seen = {r["column_name"]: r["missing_count"] for r in schema_rows}
    unseen = [c for c in df.columns if c not in seen]
    if unseen:
        seen |= P.missing_counts(df, unseen)[1]
    miss_cols = [c for c in df.columns if seen[c]]
    if miss_cols:
        ev = cache.get(df, "missing", miss_cols, target, lambda: P.missing_evidence(df, miss_cols))
        acts = [(c, a) for c, a in G.selected_actions(G.recommend_missing(ev, n), overrides.get("missing"), "missing")
                if c != target]
        steps.append(Step("missing", acts))
    cand = [c for c in O.candidate_columns(df) if c != target]
    if cand:
        ev = cache.get(df, "outliers", cand, target, lambda: O.outlier_evidence(df, cand))
        acts = [(c, a) for c, a in G.selected_actions(G.recommend_outliers(ev), overrides.get("outliers"), "outliers")
                if a != "No Action"]
        steps.append(Step("outliers", acts))
    if target is not None:
        feats, pairs = cache.get(df, "relevance", None, target,
                                 lambda: R.analyze_feature_relevance(df, target, schema_rows))
        recs = G.recommend_relevance(feats, pairs, n)
        steps.append(Step("relevance", G.selected_actions(recs, overrides.get("relevance"), "relevance")))
    cats = [c for c in E.encoding_candidates(df, target)]
    if cats:
        ev = cache.get(df, "encoding", cats, target, lambda: E.analyze_categorical_features(df, target, order_by, cats))
        numeric_target = target is not None and is_numeric_type(df.schema[target].dataType)
        recs = G.recommend_encoding(ev, target_is_numeric=numeric_target)
        steps.append(Step("encoding", G.selected_actions(recs, overrides.get("encoding"), "encoding")))
    nums = N.scaling_candidates(df, target)
    if nums:
        ev = cache.get(df, "scaling", nums, target, lambda: N.analyze_scaling_features(df, target, nums))
        ids = tuple(r["column_name"] for r in schema_rows if r["is_identifier_candidate"])
        recs = G.recommend_scaling(ev, ids)
        steps.append(Step("scaling", G.selected_actions(recs, overrides.get("scaling"), "scaling")))
    if target is not None:
        facts = cache.get(df, "imbalance", None, target, lambda: B.analyze_target_distribution(df, target))
        action = G.recommend_imbalance(facts).first()["action"]
        action = overrides.get("imbalance", {}).get(target, action)
        steps.append(Step("imbalance", imbalance_action=action))
    return steps
