"""Outlier evidence (O1-O3) and outlier handling.

Evidence: pass 1 moments, exact quartiles by histogram refinement, then one
aggregate that counts IQR and z-score outliers with the fitted bounds as
literals. Handling: every action is a filter or a projection with literal
bounds, so Catalyst pushes the filters to the scan and keeps the projection in
codegen. A removing action changes what the next column is fitted on, so the
plan is fitted block by block: a run of winsorizations is one fit.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from frameprep.functions.coerce import as_number, is_numeric_type
from frameprep.functions.report import frame, pct, round_half_away
from frameprep.functions.stats import exact_quantiles, moments

# --- fixed values -----------------------------------------------------------
OUTLIER_ACTIONS = ("IQR", "Winsorization", "Z-Score", "Remove Rows", "No Action")
IQR_FACTOR = 1.5
Z_THRESHOLD = 3.0
# ---------------------------------------------------------------------------

EVIDENCE_DDL = (
    "column_name STRING, count BIGINT, outliers BIGINT, outlier_percentage DOUBLE, "
    "skewness DOUBLE, q1 DOUBLE, q3 DOUBLE, lower_bound DOUBLE, upper_bound DOUBLE, "
    "mean DOUBLE, std DOUBLE, zscore_outliers BIGINT"
)
SUMMARY_DDL = (
    "column_name STRING, action STRING, affected BIGINT, values_capped BIGINT, "
    "description STRING, rows_before BIGINT, rows_after BIGINT"
)


def fit_bounds(df: DataFrame, cols: list[str], approx: bool = False) -> dict[str, dict]:
    """Moments plus exact (or, opt-in, approximate) quartiles and IQR bounds."""
    mom = moments(df, cols)
    qs = exact_quantiles(df, cols, [0.25, 0.75], mom, approx=approx)
    out = {}
    for c in cols:
        s = dict(mom[c])
        q1, q3 = qs[c]
        s["q1"], s["q3"] = q1, q3
        if q1 is not None:
            iqr = q3 - q1
            s["lower"], s["upper"] = q1 - IQR_FACTOR * iqr, q3 + IQR_FACTOR * iqr
        else:
            s["lower"] = s["upper"] = None
        out[c] = s
    return out


def candidate_columns(df: DataFrame) -> list[str]:
    """O3: numeric, not boolean, not marked or named as an identifier."""
    out = []
    for f in df.schema.fields:
        if not is_numeric_type(f.dataType):
            continue
        name = f.name.lower()
        if (f.metadata or {}).get("role") == "identifier":
            continue
        if name == "id" or name.endswith("_id") or name.endswith("key"):
            continue
        out.append(f.name)
    return out


def outlier_evidence(df: DataFrame, cols: list[str], approx: bool = False) -> DataFrame:
    """O1/O2: one evidence row per column, in the order given."""
    fit = fit_bounds(df, cols, approx)
    counts: dict[str, tuple[int, int]] = {}
    exprs = []
    for c in cols:
        s = fit[c]
        if s["n"] == 0:
            continue
        # the extremes decide: with min and max inside the fences (and within
        # 3 sd) there is nothing to count, and no pass over the data is needed
        x = as_number(df, c)
        need_iqr = s["min"] < s["lower"] or s["max"] > s["upper"]
        sd = s["std"]
        z_live = sd is not None and sd != 0
        need_z = z_live and max(abs((s["min"] - s["mean"]) / sd), abs((s["max"] - s["mean"]) / sd)) > Z_THRESHOLD
        counts[c] = (0, 0)
        if need_iqr:
            exprs.append(F.count_if((x < F.lit(s["lower"])) | (x > F.lit(s["upper"]))).alias(f"iqr|{c}"))
        if need_z:
            z = F.abs((x - F.lit(s["mean"])) / F.lit(sd))
            exprs.append(F.count_if(z > F.lit(Z_THRESHOLD)).alias(f"z|{c}"))
    if exprs:
        row = df.agg(*exprs).first().asDict()
        for c in counts:
            counts[c] = (int(row.get(f"iqr|{c}", 0)), int(row.get(f"z|{c}", 0)))
    rows = []
    for c in cols:
        s = fit[c]
        if s["n"] == 0:
            rows.append({"column_name": c, "count": 0, "outliers": 0, "outlier_percentage": 0.0})
            continue
        iqr_n, z_n = counts[c]
        skew = s["skewness"]
        rows.append({
            "column_name": c,
            "count": s["n"],
            "outliers": iqr_n,
            "outlier_percentage": round_half_away(pct(iqr_n, s["n"]), 2),
            "skewness": round_half_away(skew if skew is not None else 0.0, 4),
            "q1": round_half_away(s["q1"], 4),
            "q3": round_half_away(s["q3"], 4),
            "lower_bound": round_half_away(s["lower"], 4),
            "upper_bound": round_half_away(s["upper"], 4),
            "mean": round_half_away(s["mean"], 4),
            "std": round_half_away(s["std"], 4),
            "zscore_outliers": z_n,
        })
    return frame(df.sparkSession, rows, EVIDENCE_DDL)


def _keep_iqr(df: DataFrame, c: str, s: dict):
    x = as_number(df, c)
    if s["n"] == 0:
        return F.lit(True)
    return x.between(F.lit(s["lower"]), F.lit(s["upper"])) | x.isNull()


def _keep_z(df: DataFrame, c: str, s: dict):
    x = as_number(df, c)
    sd = s["std"]
    if s["n"] == 0 or sd is None or sd == 0:
        return F.lit(True)
    return (F.abs((x - F.lit(s["mean"])) / F.lit(sd)) <= F.lit(Z_THRESHOLD)) | x.isNull()


def _winsorized(df: DataFrame, c: str, s: dict):
    x = as_number(df, c)
    if s["n"] == 0:
        return x
    # greatest/least skip NULLs, so keep NULL explicitly
    return F.when(x.isNotNull(), F.greatest(F.lit(s["lower"]), F.least(F.lit(s["upper"]), x)))


def iqr_filter(df: DataFrame, column: str) -> DataFrame:
    """Drop rows outside the IQR fences; missing rows stay."""
    s = fit_bounds(df, [column])[column]
    return df.where(_keep_iqr(df, column, s))


def zscore_filter(df: DataFrame, column: str) -> DataFrame:
    """Drop rows with |z| > 3 (sample std); no-op when std is 0 or undefined."""
    s = moments(df, [column])[column]
    return df.where(_keep_z(df, column, s))


def winsorize(df: DataFrame, columns: list[str] | str) -> DataFrame:
    """Clip each column to its own IQR fences (one fit for all columns)."""
    columns = [columns] if isinstance(columns, str) else list(columns)
    fit = fit_bounds(df, columns)
    return df.withColumns({c: _winsorized(df, c, fit[c]) for c in columns})


def check_actions(actions: list[tuple[str, str]]) -> None:
    for c, a in actions:
        if a not in OUTLIER_ACTIONS:
            raise ValueError(f"Unknown outlier action: {a}")


def apply_outlier_actions(df: DataFrame, actions, record: list | None = None) -> tuple[DataFrame, DataFrame]:
    """Apply (column, action) in order. Each column is fitted on the rows the
    earlier actions left. Returns the new frame and a summary frame. ``record``
    collects (column, action, fitted statistics) to replay on other data."""
    actions = list(actions.items()) if isinstance(actions, dict) else list(actions)
    check_actions(actions)
    spark = df.sparkSession
    actions = [(c, a) for c, a in actions if c in df.columns]
    summary = []
    rows = df.count()
    i = 0
    while i < len(actions):
        # a run of winsorizations shares one fit: they change only their own columns
        if actions[i][1] == "Winsorization":
            j = i
            while j < len(actions) and actions[j][1] == "Winsorization":
                j += 1
            cols = list(dict.fromkeys(c for c, _ in actions[i:j]))
            fit = fit_bounds(df, cols)
            exprs = []
            for k, c in enumerate(cols):
                x = as_number(df, c)
                w = _winsorized(df, c, fit[c])
                exprs += [
                    F.count_if(x.isNotNull() & (w != x)).alias(f"chg{k}"),
                    F.count_if(x.isNull()).alias(f"nul{k}"),
                ]
            row = df.agg(*exprs).first()
            for k, c in enumerate(cols):
                changed, nulls = int(row[f"chg{k}"]), int(row[f"nul{k}"])
                affected = changed + nulls  # NaN != NaN: every missing value counts
                summary.append({
                    "column_name": c, "action": "Winsorization", "affected": affected,
                    "values_capped": changed, "description": f"{affected} values capped",
                    "rows_before": rows, "rows_after": rows,
                })
            df = df.withColumns({c: _winsorized(df, c, fit[c]) for c in cols})
            if record is not None:
                record.extend((c, "Winsorization", fit[c]) for c in cols)
            i = j
            continue
        c, a = actions[i]
        if a == "No Action":
            keep = None
        else:
            stats = fit_bounds(df, [c])[c] if a in ("IQR", "Remove Rows") else moments(df, [c])[c]
            keep = _keep_iqr(df, c, stats) if a in ("IQR", "Remove Rows") else _keep_z(df, c, stats)
            if record is not None:
                record.append((c, a, stats))
        removed = 0
        if keep is not None:
            removed = int(df.agg(F.count_if(~keep).alias("r")).first()["r"])
            df = df.where(keep)
        summary.append({
            "column_name": c, "action": a, "affected": removed, "values_capped": None,
            "description": f"{removed} rows removed", "rows_before": rows, "rows_after": rows - removed,
        })
        rows -= removed
        i += 1
    return df, frame(spark, summary, SUMMARY_DDL)


def replay(df: DataFrame, recorded: list) -> DataFrame:
    """Apply recorded outlier steps (fitted elsewhere) as filters / projections."""
    for c, a, stats in recorded:
        if a == "Winsorization":
            df = df.withColumn(c, _winsorized(df, c, stats))
        elif a in ("IQR", "Remove Rows"):
            df = df.where(_keep_iqr(df, c, stats))
        elif a == "Z-Score":
            df = df.where(_keep_z(df, c, stats))
    return df
