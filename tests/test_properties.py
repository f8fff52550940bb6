"""Property tests: exact quantiles and the distributed index against plain
Python on random inputs (duplicates, negatives, tiny bucket and fetch sizes)."""

import numpy as np
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from frameprep.functions.indexing import ordered_index
from frameprep.functions.stats import exact_quantiles

values = st.lists(
    st.one_of(st.integers(-50, 50).map(float), st.floats(-1e6, 1e6, allow_nan=False, allow_infinity=False)),
    min_size=1, max_size=300,
)


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(vals=values, buckets=st.sampled_from([2, 4, 64]), fetch=st.sampled_from([1, 3, 1000]))
def test_exact_quantiles_match_numpy(spark, vals, buckets, fetch):
    df = spark.createDataFrame([(v,) for v in vals], "x DOUBLE").repartition(3)
    probs = [0.0, 0.25, 0.5, 0.75, 1.0]
    got = exact_quantiles(df, ["x"], probs, buckets=buckets, fetch_limit=fetch)["x"]
    want = np.quantile(np.array(vals), probs)
    assert np.allclose(got, want, rtol=1e-9, atol=1e-9)


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(keys=st.lists(st.integers(0, 10_000), min_size=1, max_size=400, unique=True), parts=st.integers(1, 6))
def test_ordered_index_matches_sorted_positions(spark, keys, parts):
    df = spark.createDataFrame([(k,) for k in keys], "k LONG").repartition(parts)
    got = {r["k"]: r["index"] for r in ordered_index(df, ["k"]).collect()}
    assert got == {k: i for i, k in enumerate(sorted(keys))}
