"""Text helpers for the DuckDB oracle SQL (kept apart from the Spark code)."""

from __future__ import annotations

from frameprep.functions.report import fixed_sql


def dbl(v) -> str:
    return f"CAST({v} AS DOUBLE)"


def fx(expr: str, digits: int = 6) -> str:
    return fixed_sql(expr, digits)


def union_all(parts: list[str]) -> str:
    return "\nUNION ALL\n".join(f"({p})" for p in parts)


def outlier_evidence_sql(tbl: str, col: str) -> str:
    return f"""
    SELECT '{col}' AS column_name, CAST(s.n AS BIGINT) AS count, CAST(o.iqr AS BIGINT) AS outliers,
           round(CAST(o.iqr AS DOUBLE) / s.n * 100, 2) AS outlier_percentage,
           round(coalesce(s.sk, 0), 4) AS skewness, round(s.q1, 4) AS q1, round(s.q3, 4) AS q3,
           round(s.q1 - {dbl(1.5)} * (s.q3 - s.q1), 4) AS lower_bound,
           round(s.q3 + {dbl(1.5)} * (s.q3 - s.q1), 4) AS upper_bound,
           round(s.m, 4) AS mean, round(s.sd, 4) AS std, CAST(o.z AS BIGINT) AS zscore_outliers
    FROM (SELECT count(x) n, avg(x) m, stddev_samp(x) sd, skewness(x) sk,
                 quantile_cont(x, 0.25) q1, quantile_cont(x, 0.75) q3
          FROM (SELECT CAST({col} AS DOUBLE) x FROM {tbl})) s,
         (SELECT count(*) FILTER (WHERE x < q1 - {dbl(1.5)} * (q3 - q1) OR x > q3 + {dbl(1.5)} * (q3 - q1)) iqr,
                 count(*) FILTER (WHERE sd <> 0 AND abs((x - m) / sd) > 3) z
          FROM (SELECT CAST({col} AS DOUBLE) x FROM {tbl}),
               (SELECT avg(CAST({col} AS DOUBLE)) m, stddev_samp(CAST({col} AS DOUBLE)) sd,
                       quantile_cont(CAST({col} AS DOUBLE), 0.25) q1, quantile_cont(CAST({col} AS DOUBLE), 0.75) q3
                FROM {tbl})) o"""


def iqr_bounds_cte(name: str, tbl: str, col: str) -> str:
    return (
        f"{name} AS (SELECT quantile_cont(CAST({col} AS DOUBLE), 0.25) - {dbl(1.5)} * "
        f"(quantile_cont(CAST({col} AS DOUBLE), 0.75) - quantile_cont(CAST({col} AS DOUBLE), 0.25)) lo, "
        f"quantile_cont(CAST({col} AS DOUBLE), 0.75) + {dbl(1.5)} * "
        f"(quantile_cont(CAST({col} AS DOUBLE), 0.75) - quantile_cont(CAST({col} AS DOUBLE), 0.25)) hi FROM {tbl})"
    )


def z_cte(name: str, tbl: str, col: str) -> str:
    return f"{name} AS (SELECT avg(CAST({col} AS DOUBLE)) m, stddev_samp(CAST({col} AS DOUBLE)) sd FROM {tbl})"
