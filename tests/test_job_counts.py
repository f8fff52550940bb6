"""Passes are fused: the number of Spark actions (passes over the data) for
evidence does not grow with the number of columns."""

import pyspark.sql.classic.dataframe as classic

from frameprep.operators import outliers as O
from frameprep.operators import profile as P
from frameprep.operators import scaling as N
from frameprep.sources.tables import table
from tests.conftest import SF_SMALL


def _actions(monkeypatch, fn):
    calls, depth = [], [0]
    for name in ("collect", "first", "count", "take", "toArrow"):
        real = getattr(classic.DataFrame, name)

        def wrapped(self, *a, _real=real, _name=name, **k):
            if not depth[0]:  # first() calls take(), which calls collect(): one action
                calls.append(_name)
            depth[0] += 1
            try:
                return _real(self, *a, **k)
            finally:
                depth[0] -= 1

        monkeypatch.setattr(classic.DataFrame, name, wrapped)
    try:
        fn()
    finally:
        monkeypatch.undo()
    return len(calls)


def test_outlier_evidence_passes_do_not_grow_with_columns(spark, monkeypatch):
    li = table(spark, SF_SMALL, "lineitem")
    one = _actions(monkeypatch, lambda: O.outlier_evidence(li, ["l_quantity"]).collect())
    five = _actions(monkeypatch, lambda: O.outlier_evidence(
        li, ["l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax"]).collect())
    assert five <= one + 2  # at most an extra refinement round and a fetch, never a pass per column


def test_profile_and_scaling_passes_do_not_grow_with_columns(spark, monkeypatch):
    li = table(spark, SF_SMALL, "lineitem")
    small = li.select("l_quantity", "l_tax")
    assert _actions(monkeypatch, lambda: P.profile_columns(li).collect()) == \
        _actions(monkeypatch, lambda: P.profile_columns(small).collect())
    a = _actions(monkeypatch, lambda: N.analyze_scaling_features(small).collect())
    b = _actions(monkeypatch, lambda: N.analyze_scaling_features(li).collect())
    assert b <= a + 2


def test_quantiles_take_three_passes_for_any_number_of_columns(spark, monkeypatch):
    import numpy as np
    import pandas as pd

    from frameprep.functions.stats import exact_quantiles, moments

    rng = np.random.default_rng(1)
    for width in (5, 60):
        data = pd.DataFrame(rng.normal(size=(3000, width)), columns=[f"c{i}" for i in range(width)])
        df = spark.createDataFrame(data).cache()
        mom = moments(df, list(df.columns))
        got = {}
        assert _actions(monkeypatch, lambda: got.update(exact_quantiles(df, list(df.columns), [0.25, 0.5, 0.75], mom))) <= 3
        for c in data.columns:
            assert np.allclose(got[c], data[c].quantile([0.25, 0.5, 0.75]))
        df.unpersist()


def test_correlations_take_two_passes_for_any_number_of_pairs(spark, monkeypatch):
    import itertools

    import numpy as np
    import pandas as pd

    from frameprep.operators.relevance import correlations

    rng = np.random.default_rng(2)
    data = pd.DataFrame(rng.normal(size=(300, 200)), columns=[f"c{i}" for i in range(200)])
    data.loc[data["c0"] > 0.5, "c3"] = None
    df = spark.createDataFrame(data).cache()
    pairs, got = list(itertools.combinations(df.columns, 2)), {}
    assert _actions(monkeypatch, lambda: got.update(correlations(df, pairs))) == 2
    want = data.corr()
    assert all(abs(got[(a, b)] - want.loc[a, b]) < 1e-9 for a, b in pairs)
    df.unpersist()
