"""Scaling evidence (N1-N2) and scalers.

The scalers follow the library rules the reference relies on, not the
``pyspark.ml`` scalers: StandardScaler divides by the *population* std,
MinMaxScaler maps a constant column to 0, RobustScaler centres on the exact
median and divides by the exact IQR; a zero scale becomes 1. Missing values
are ignored in the fit and kept in the output.

All scalers of a plan are fitted in one moments pass plus the shared quantile
rounds, and applied in one projection.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from frameprep.functions.coerce import TEMPORAL_NAMES, as_number, numeric_columns
from frameprep.functions.report import frame, pct, round_half_away
from frameprep.functions.stats import exact_quantiles, moments

# --- fixed values -----------------------------------------------------------
SCALING_ACTIONS = ("No Action", "StandardScaler", "MinMaxScaler", "RobustScaler")
# ---------------------------------------------------------------------------

EVIDENCE_DDL = (
    "column_name STRING, count BIGINT, mean DOUBLE, std DOUBLE, min DOUBLE, max DOUBLE, range DOUBLE, "
    "skewness DOUBLE, q1 DOUBLE, q3 DOUBLE, iqr DOUBLE, outlier_percentage DOUBLE"
)
SUMMARY_DDL = (
    "column_name STRING, action STRING, before_min DOUBLE, before_max DOUBLE, after_min DOUBLE, after_max DOUBLE"
)


def scaling_candidates(df: DataFrame, target: str | None = None) -> list[str]:
    """Numeric (not boolean) columns except the target and time-part names."""
    return [c for c in numeric_columns(df) if c != target and c.lower() not in TEMPORAL_NAMES]


def analyze_scaling_features(df: DataFrame, target: str | None = None, columns: list[str] | None = None,
                             approx: bool = False) -> DataFrame:
    """One evidence row per candidate column."""
    cols = columns if columns is not None else scaling_candidates(df, target)
    mom = moments(df, cols)
    qs = exact_quantiles(df, cols, [0.25, 0.75], mom, approx=approx)
    # a column whose extremes sit inside its fences has no outliers: no pass needed
    live = [c for c in cols if mom[c]["n"] > 0 and qs[c][1] - qs[c][0] != 0
            and (mom[c]["min"] < qs[c][0] - 1.5 * (qs[c][1] - qs[c][0])
                 or mom[c]["max"] > qs[c][1] + 1.5 * (qs[c][1] - qs[c][0]))]
    counts = {}
    if live:
        exprs = []
        for i, c in enumerate(live):
            q1, q3 = qs[c]
            iqr = q3 - q1
            x = as_number(df, c)
            exprs.append(F.count_if((x < F.lit(q1 - 1.5 * iqr)) | (x > F.lit(q3 + 1.5 * iqr))).alias(f"o{i}"))
        row = df.agg(*exprs).first()
        counts = {c: int(row[f"o{i}"]) for i, c in enumerate(live)}
    rows = []
    for c in cols:
        s = mom[c]
        if s["n"] == 0:
            rows.append({"column_name": c, "count": 0, "outlier_percentage": 0.0})
            continue
        q1, q3 = qs[c]
        rows.append({
            "column_name": c,
            "count": s["n"],
            "mean": round_half_away(s["mean"], 4),
            "std": round_half_away(s["std"], 4),
            "min": round_half_away(s["min"], 4),
            "max": round_half_away(s["max"], 4),
            "range": round_half_away(s["max"] - s["min"], 4),
            "skewness": round_half_away(s["skewness"], 4),
            "q1": round_half_away(q1, 4),
            "q3": round_half_away(q3, 4),
            "iqr": round_half_away(q3 - q1, 4),
            "outlier_percentage": round_half_away(pct(counts.get(c, 0), s["n"]), 2),
        })
    return frame(df.sparkSession, rows, EVIDENCE_DDL)


@dataclass
class Scaler:
    """A fitted scaler: ``(x - center) / scale`` (L3, reusable on new data)."""

    column: str
    action: str
    center: float = 0.0
    scale: float = 1.0

    def expr(self, df: DataFrame):
        x = as_number(df, self.column)
        return (x - F.lit(self.center)) / F.lit(self.scale)

    def apply_scalar(self, v):
        return None if v is None else (v - self.center) / self.scale


def _nonzero(v) -> float:
    return 1.0 if v is None or v == 0 else float(v)


def fit_scalers(df: DataFrame, actions: list[tuple[str, str]]) -> tuple[dict[str, Scaler], dict[str, dict]]:
    cols = [c for c, a in actions if a != "No Action"]
    allc = [c for c, _ in actions]
    mom = moments(df, list(dict.fromkeys(allc)))
    robust = [c for c, a in actions if a == "RobustScaler"]
    qs = exact_quantiles(df, robust, [0.25, 0.5, 0.75], {c: mom[c] for c in robust}) if robust else {}
    out = {}
    for c, a in actions:
        if c not in cols:
            continue
        s = mom[c]
        if s["n"] == 0:
            out[c] = Scaler(c, a)
        elif a == "StandardScaler":
            out[c] = Scaler(c, a, s["mean"], _nonzero(s["std_pop"]))
        elif a == "MinMaxScaler":
            out[c] = Scaler(c, a, s["min"], _nonzero(s["max"] - s["min"]))
        else:
            q1, med, q3 = qs[c]
            out[c] = Scaler(c, a, med, _nonzero(q3 - q1))
    return out, mom


def scale(df: DataFrame, column: str, action: str) -> DataFrame:
    out, _ = apply_scaling_actions(df, [(column, action)])
    return out


def apply_scaling_actions(df: DataFrame, actions, record: list | None = None) -> tuple[DataFrame, DataFrame]:
    """Plan order, unknown columns skipped; one fit, one projection.
    After-min/max follow from before-min/max: every scaler is increasing."""
    actions = list(actions.items()) if isinstance(actions, dict) else list(actions)
    for _, a in actions:
        if a not in SCALING_ACTIONS:
            raise ValueError(f"Unknown scaling action: {a}")
    actions = [(c, a) for c, a in actions if c in df.columns]
    scalers, mom = fit_scalers(df, actions)
    if record is not None:
        record.append(scalers)
    out = df.withColumns({c: sc.expr(df) for c, sc in scalers.items()}) if scalers else df
    summary = []
    for c, a in actions:
        lo, hi = mom[c]["min"], mom[c]["max"]
        sc = scalers.get(c)
        alo, ahi = (sc.apply_scalar(lo), sc.apply_scalar(hi)) if sc else (lo, hi)
        summary.append({
            "column_name": c, "action": a,
            "before_min": round_half_away(lo, 4), "before_max": round_half_away(hi, 4),
            "after_min": round_half_away(alo, 4), "after_max": round_half_away(ahi, 4),
        })
    return out, frame(df.sparkSession, summary, SUMMARY_DDL)
