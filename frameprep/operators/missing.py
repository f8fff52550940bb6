"""Missing-value handling (M1-M7).

Every fill is fitted on the incoming frame: means in one aggregate, medians by
the shared exact-quantile rounds, modes from the value-frequency table. The
fills are then applied in one projection of literals.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from frameprep.functions.coerce import is_numeric_type, nan_to_null
from frameprep.functions.report import frame
from frameprep.functions.stats import exact_quantiles, moments
from frameprep.operators.profile import column_modes, missing_counts

# --- fixed values -----------------------------------------------------------
MISSING_ACTIONS = ("Mean", "Median", "Mode", "Drop Column", "Leave Missing", "No Action")
NUMERIC_ONLY = ("Mean", "Median")
KEEPING = ("Drop Column", "Leave Missing", "No Action")
# ---------------------------------------------------------------------------


def allowed_actions(column_type: str, recommended: str | None = None) -> list[str]:
    """M7: every action that suits the column's type, or only those that fill
    nothing when nothing is recommended; the recommendation is always offered."""
    unfit = set() if column_type == "Numeric" else set(NUMERIC_ONLY)
    if recommended == "No Action":
        unfit = set(MISSING_ACTIONS) - set(KEEPING)
    offered = [a for a in MISSING_ACTIONS if a not in unfit]
    return offered if recommended is None or recommended in offered else [recommended, *offered]


def check_actions(df: DataFrame, actions: list[tuple[str, str]]) -> None:
    for c, a in actions:
        if a not in MISSING_ACTIONS:
            raise ValueError(f"Unknown missing-value action: {a}")
        if a in NUMERIC_ONLY and c in df.columns and not is_numeric_type(df.schema[c].dataType):
            raise ValueError(f"{a} needs a numeric column; '{c}' is {df.schema[c].dataType.simpleString()}")


def fit_fills(df: DataFrame, actions: list[tuple[str, str]]) -> dict[str, object]:
    """Fill value per column: one moments pass, one set of quantile rounds,
    one frequency pass, whatever the number of columns."""
    means = [c for c, a in actions if a == "Mean"]
    medians = [c for c, a in actions if a == "Median"]
    modes = [c for c, a in actions if a == "Mode"]
    fills: dict[str, object] = {}
    mom = moments(df, list(dict.fromkeys(means + medians)))
    for c in means:
        fills[c] = mom[c]["mean"]
    if medians:
        qs = exact_quantiles(df, medians, [0.5], {c: mom[c] for c in medians})
        for c in medians:
            fills[c] = qs[c][0]
    if modes:
        got = {r["column_name"]: r for r in column_modes(df, modes).collect()}
        for c in modes:
            # the text form casts back to the column's type without losing digits
            fills[c] = got[c]["mode"] if c in got else None
    return fills


def _filled(df: DataFrame, c: str, action: str, value):
    dt = df.schema[c].dataType
    col = F.col(c)
    if isinstance(dt, (T.FloatType, T.DoubleType)):
        col = nan_to_null(col)
    if value is None:
        return col
    if action in NUMERIC_ONLY:
        return F.coalesce(col.cast("double"), F.lit(float(value)))
    return F.coalesce(col, F.lit(value).cast(dt))


def apply_missing_actions(df: DataFrame, actions, record: list | None = None) -> tuple[DataFrame, DataFrame]:
    """M6: fit every fill on the incoming frame, apply all in one projection.
    Summary: action, missing before, missing after, per column."""
    actions = list(actions.items()) if isinstance(actions, dict) else list(actions)
    check_actions(df, actions)
    actions = [(c, a) for c, a in actions if c in df.columns]
    fills = fit_fills(df, actions)
    if record is not None:
        record.append(fills)
    n, before = missing_counts(df, [c for c, _ in actions])
    drops = [c for c, a in actions if a == "Drop Column"]
    exprs = {c: _filled(df, c, a, fills[c]) for c, a in actions if a in ("Mean", "Median", "Mode")}
    out = df.withColumns(exprs).drop(*drops) if exprs else df.drop(*drops)
    summary = []
    for c, a in actions:
        if a == "Drop Column":
            after = 0
        elif a in ("Mean", "Median", "Mode"):
            after = 0 if fills[c] is not None else before[c]
        else:
            after = before[c]
        summary.append({"column_name": c, "action": a, "missing_before": before[c], "missing_after": after})
    return out, frame(df.sparkSession, summary, "column_name STRING, action STRING, missing_before BIGINT, missing_after BIGINT")


def impute(df: DataFrame, column: str, action: str) -> DataFrame:
    out, _ = apply_missing_actions(df, [(column, action)])
    return out
