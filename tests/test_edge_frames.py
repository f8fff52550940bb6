"""Edge frames (empty, all null, one row, constant, NaN/inf, text numbers, ties)
checked against pandas or against values worked out by hand."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from frameprep.functions.coerce import text_to_number
from frameprep.functions.stats import exact_quantiles, moments
from frameprep.operators import encoding as E
from frameprep.operators import imbalance as B
from frameprep.operators import missing as M
from frameprep.operators import outliers as O
from frameprep.operators import profile as P
from frameprep.operators import scaling as N
from frameprep.operators import schema as S
from frameprep.operators import relevance as R


def _df(spark, rows, ddl):
    return spark.createDataFrame(rows, ddl)


def test_demo_people(spark):
    df = _df(spark, [(20.0, 30000.0, "M"), (21.0, 35000.0, "F"), (None, None, "F"), (24.0, 90000.0, "M"),
                     (25.0, 100000.0, "F")], "age DOUBLE, income DOUBLE, gender STRING")
    s = P.numeric_summary(df, "income")
    assert (s["count"], s["mean"], s["median"], s["min"], s["max"]) == (4, 63750.0, 62500.0, 30000.0, 100000.0)
    assert (s["q1"], s["q3"]) == (33750.0, 92500.0)
    cat = {r["value"]: r for r in P.categorical_summary(df, "gender").collect()}
    assert cat["F"]["count"] == 3 and cat["M"]["count"] == 2
    assert cat["F"]["most_frequent"] == "F" and cat["F"]["unique_values"] == 2
    by = {r["gender"]: r for r in P.missingness_by_category(df, "age", "gender").collect()}
    assert by["F"]["missing_count"] == 1 and by["F"]["total_count"] == 3
    assert round(by["F"]["missing_percentage"], 2) == 33.33
    assert by["M"]["missing_count"] == 0


def test_errors_on_unknown_or_empty_columns(spark):
    df = _df(spark, [(None,), (None,)], "x DOUBLE")
    with pytest.raises(ValueError):
        P.numeric_summary(df, "nope")
    with pytest.raises(ValueError):
        P.numeric_summary(df, "x")


def test_empty_frame(spark):
    df = _df(spark, [], "x DOUBLE, c STRING")
    ev = O.outlier_evidence(df, ["x"]).first()
    assert ev["count"] == 0 and ev["outliers"] == 0 and ev["outlier_percentage"] == 0.0
    prof = {r["column_name"]: r for r in P.profile_columns(df).collect()}
    assert prof["x"]["missing_percentage"] == 0.0
    assert B.target_facts(df, "c")["problem_type"] == "Unknown"


def test_all_null_zero_record(spark):
    df = _df(spark, [(None,), (None,), (None,)], "x DOUBLE")
    ev = O.outlier_evidence(df, ["x"]).first()
    assert ev["count"] == 0 and ev["zscore_outliers"] is None
    sc = N.analyze_scaling_features(df).first()
    assert sc["count"] == 0 and sc["outlier_percentage"] == 0.0


def test_one_row(spark):
    df = _df(spark, [(5.0,)], "x DOUBLE")
    ev = O.outlier_evidence(df, ["x"]).first()
    assert ev["std"] is None and ev["skewness"] == 0.0 and ev["zscore_outliers"] == 0
    assert O.zscore_filter(df, "x").count() == 1


def test_constant_column(spark):
    df = _df(spark, [(5.0,)] * 4, "x DOUBLE")
    ev = O.outlier_evidence(df, ["x"]).first()
    assert ev["std"] == 0.0 and ev["q1"] == ev["q3"] == 5.0 and ev["outliers"] == 0
    out, _ = N.apply_scaling_actions(df, [("x", "StandardScaler")])
    assert [r["x"] for r in out.collect()] == [0.0] * 4
    out, _ = N.apply_scaling_actions(df, [("x", "MinMaxScaler")])
    assert [r["x"] for r in out.collect()] == [0.0] * 4
    out, _ = N.apply_scaling_actions(df, [("x", "RobustScaler")])
    assert [r["x"] for r in out.collect()] == [0.0] * 4
    two = _df(spark, [(5.0, float(i)) for i in range(4)], "x DOUBLE, y DOUBLE")
    feats, pairs = R.analyze_feature_relevance(two, "y", S.analyze_schema(two))
    assert {r["column_name"]: r["correlation_with_target"] for r in feats.collect()}["x"] is None
    assert pairs.count() == 0


def test_iqr_zero_differs_between_stages(spark):
    df = _df(spark, [(1.0,)] * 9 + [(100.0,)], "x DOUBLE")
    assert O.outlier_evidence(df, ["x"]).first()["outliers"] == 1
    assert N.analyze_scaling_features(df).first()["outlier_percentage"] == 0.0


def test_nan_and_infinities(spark):
    df = _df(spark, [(float("nan"),), (float("inf"),), (float("-inf"),), (None,), (1.0,)], "x DOUBLE")
    m = moments(df, ["x"])["x"]
    assert m["n"] == 3 and m["n_pos_inf"] == 1 and m["n_neg_inf"] == 1
    q = exact_quantiles(df, ["x"], [0.0, 0.5, 1.0], {"x": m})["x"]
    assert q == [float("-inf"), 1.0, float("inf")]
    prof = {r["column_name"]: r for r in P.profile_columns(df).collect()}
    assert prof["x"]["missing_count"] == 2


def test_text_numbers(spark):
    vals = ["1", " 2 ", "3.5", "1e3", "", "abc", "1d", "1f", "0x10", "1_000", "1,000", "inf", "+5", ".5", "5.", "True"]
    df = _df(spark, [(v,) for v in vals], "t STRING")
    got = [r["n"] for r in df.select(text_to_number(F.col("t")).alias("n")).collect()]
    expect = pd.to_numeric(pd.Series(vals), errors="coerce").tolist()
    for g, e, v in zip(got, expect, vals):
        if isinstance(e, float) and math.isnan(e):
            assert g is None, v
        else:
            assert g == e, v


def test_text_dates(spark):
    # one format for the whole column: the candidate that reads the most values
    df = _df(spark, [("2020-01-01",), ("2020-01-02",), ("01/02/2020",), ("2020-01-03 10:00:00",), ("x",)], "d STRING")
    assert S.best_datetime_format(df, "d") == "yyyy-MM-dd"
    out = S.apply_schema_action(df, "d", "Convert to Datetime")
    assert sum(r["d"] is not None for r in out.collect()) == 2


def test_ties_mode_and_order(spark):
    df = _df(spark, [(v,) for v in ["b", "a", "b", "a", "c"]], "v STRING")
    top = [r["value"] for r in P.ranked_values(df, ["v"]).orderBy("rank").collect()]
    assert top == ["a", "b", "c"]
    out, _ = M.apply_missing_actions(_df(spark, [("b",), ("a",), ("b",), ("a",), (None,)], "v STRING"), [("v", "Mode")])
    assert [r["v"] for r in out.collect()][-1] == "a"


def test_skewness_correction(spark):
    df = _df(spark, [(1.0,), (2.0,), (3.0,), (10.0,)], "x DOUBLE")
    s = moments(df, ["x"])["x"]["skewness"]
    assert round(s, 4) == round(pd.Series([1, 2, 3, 10]).skew(), 4) == 1.7636


def test_null_category(spark):
    df = _df(spark, [(1, "a"), (2, None), (3, "a"), (4, "b")], "id INT, v STRING")
    oh = E.encode(df, "v", "One-Hot Encoding").orderBy("id")
    assert oh.columns == ["id", "v_a", "v_b", "v_nan"]
    assert [tuple(r)[1:] for r in oh.collect()] == [(1.0, 0.0, 0.0), (0.0, 0.0, 1.0), (1.0, 0.0, 0.0), (0.0, 1.0, 0.0)]
    fr = [r["v"] for r in E.encode(df, "v", "Frequency Encoding").orderBy("id").collect()]
    assert fr[1] is None and abs(fr[0] - 2 / 3) < 1e-12 and abs(fr[3] - 1 / 3) < 1e-12
    od = [r["v"] for r in E.encode(df, "v", "Ordinal Encoding", order_by="id").orderBy("id").collect()]
    assert od == [0, None, 0, 1]


def test_capped_null_counts(spark):
    df = _df(spark, [(float(i),) for i in range(1, 9)] + [(None,), (100.0,)], "x DOUBLE")
    _, summary = O.apply_outlier_actions(df, [("x", "Winsorization")])
    r = summary.first()
    assert r["values_capped"] == 1 and r["affected"] == 2


def test_tiny_minority_refuses_smote(spark):
    df = _df(spark, [(float(i), "A") for i in range(10)] + [(float(i), "B") for i in range(5)], "x DOUBLE, y STRING")
    with pytest.raises(ValueError):
        B.smote(df, "y")


def test_unknown_actions_raise(spark):
    df = _df(spark, [(1.0, "a")], "x DOUBLE, c STRING")
    with pytest.raises(ValueError):
        O.apply_outlier_actions(df, [("x", "Nope")])
    with pytest.raises(ValueError):
        M.apply_missing_actions(df, [("c", "Mean")])
    with pytest.raises(ValueError):
        N.apply_scaling_actions(df, [("x", "Nope")])
    with pytest.raises(ValueError):
        E.apply_encoding_actions(df, [("c", "Nope")])
    with pytest.raises(ValueError):
        R.apply_relevance_actions(df, [("x", "Drop")], target="x")
    with pytest.raises(ValueError):
        E.encode(df, "c", "Target Encoding")


def test_quantiles_match_numpy_with_many_rounds(spark):
    rng = np.random.default_rng(7)
    vals = np.concatenate([rng.lognormal(size=3000), np.full(500, 2.5), rng.integers(0, 5, 200).astype(float)])
    df = spark.createDataFrame([(float(v),) for v in vals], "x DOUBLE")
    probs = [0.0, 0.1, 0.25, 0.5, 0.75, 0.9, 1.0]
    got = exact_quantiles(df, ["x"], probs, buckets=8, fetch_limit=16)["x"]
    want = np.quantile(vals, probs)
    assert np.allclose(got, want, rtol=1e-12, atol=1e-12)


def test_missing_value_inspector(spark):
    df = _df(spark, [(20.0, "M"), (None, "F"), (24.0, None)], "age DOUBLE, gender STRING")
    ins = P.MissingValueInspector(df)
    assert ins.get_missing_columns() == ["age", "gender"]
    rel = ins.inspect_missingness_relationship("age", "gender")
    assert {r["gender"]: r["missing_count"] for r in rel.collect()} == {"M": 0, "F": 1}
    assert "age_by_gender" in ins.relationships
    assert ins.inspect_column("age")["count"] == 2
    assert P.preview(df, 2).count() == 2


def test_duplicate_count_matches_pandas(spark):
    from frameprep.operators import duplicates as D

    rows = [(1.0, "a"), (1.0, "a"), (float("nan"), "b"), (None, "b"), (0.0, None), (-0.0, None), (2.0, "c"), (None, None)]
    df = _df(spark, rows, "x DOUBLE, s STRING")
    pdf = pd.DataFrame(rows, columns=["x", "s"])
    n, dup = D.duplicate_count(df)
    assert n == len(rows) and dup == int(pdf.duplicated().sum()) == 3


def test_datetimes_without_seconds_with_halves_of_the_day_and_in_digits(spark):
    import datetime as dt

    cases = {
        "minute": (["2024-01-02 03:04", "2024-05-02 13:04", "x"], [dt.datetime(2024, 1, 2, 3, 4), dt.datetime(2024, 5, 2, 13, 4), None]),
        "t": (["2024-01-02T03:04", None, ""], [dt.datetime(2024, 1, 2, 3, 4), None, None]),
        "us": (["01/30/2024 03:04 PM", "02/01/2024 12:00 AM", "1"], [dt.datetime(2024, 1, 30, 15, 4), dt.datetime(2024, 2, 1), None]),
        "half": (["2024-01-02 11:59:58 pm", "2024-01-02 12:00:00 PM", "no"], [dt.datetime(2024, 1, 2, 23, 59, 58), dt.datetime(2024, 1, 2, 12), None]),
        "digits": (["20240229", "20231301", "2024022"], [dt.datetime(2024, 2, 29), None, None]),
        "slash": (["31/01/2024 23:10:05.5", "30/01/2024 01:02:03", "x"], [dt.datetime(2024, 1, 31, 23, 10, 5, 500_000), dt.datetime(2024, 1, 30, 1, 2, 3), None]),
    }
    df = spark.createDataFrame([(k, *[cases[c][0][k] for c in cases]) for k in range(3)], "k INT, " + ", ".join(f"{c} STRING" for c in cases))
    for c, (_, want) in cases.items():
        got = S.apply_schema_action(df, c, "Convert to Datetime").orderBy("k").collect()
        assert [r[c] for r in got] == want, c
