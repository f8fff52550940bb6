"""Exact neighbours and screened correlation pairs against brute force, with counted work."""

import itertools

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from frameprep.functions.written import written
from frameprep.operators import neighbours as K
from frameprep.operators import relevance as R


def _points(spark, vectors, classes):
    """Rows with ids in an order that keeps equal vectors together, as the ranked classes have."""
    order = np.lexsort((*vectors.T, classes))
    rows, ids = [], {}
    for i in order:
        c = str(classes[i])
        rows.append((c, ids.get(c, 0), [float(x) for x in vectors[i]]))
        ids[c] = ids.get(c, 0) + 1
    return rows, spark.createDataFrame(rows, "__cls STRING, __id LONG, __vec ARRAY<DOUBLE>").repartition(4)


def _brute(rows, k):
    out = {}
    for c in {r[0] for r in rows}:
        ids = np.array([r[1] for r in rows if r[0] == c])
        x = np.array([r[2] for r in rows if r[0] == c])
        for i, v in zip(ids, x):
            d = ((x - v) ** 2).sum(axis=1)
            near = [int(j) for j in ids[np.lexsort((ids, d))] if j != i]
            out[c, int(i)] = near[:k]
    return out


def _clustered(n, d, seed, middle=25):
    rng = np.random.default_rng(seed)
    centres = rng.normal(0, 10, (middle, d))
    return centres[rng.integers(0, middle, n)] + rng.normal(0, 1, (n, 2)) @ rng.normal(0, 1, (2, d))


@pytest.mark.parametrize("d", [12, 50])
def test_neighbours_equal_brute_force_with_few_pairs(spark, monkeypatch, d):
    n, k = 5000, 5
    rows, points = _points(spark, _clustered(n, d, d), np.zeros(n, int))
    met, real = [], K.meetings
    monkeypatch.setattr(K, "meetings", lambda placed, *rest: met.append((placed, real(placed, *rest))) or met[0][1])
    got = {(r["__cls"], r["__id"]): r["__nbrs"] for r in K.exact_neighbours(points, k, d).collect()}
    assert got == _brute(rows, k)
    cell = ["__cls", "__cell", "__ring"]
    pairs = met[0][1].join(met[0][0].groupBy(*cell).count(), cell).agg(F.sum("count")).first()[0]
    assert pairs < 0.05 * n * n


def test_neighbours_of_copies_ties_and_small_classes(spark):
    rng = np.random.default_rng(3)
    lattice = rng.integers(0, 3, (600, 3)).astype(float)  # many copies and many equal distances
    hot = np.zeros((500, 3))
    line = np.arange(60)[:, None] * np.ones((1, 3))
    few = rng.normal(size=(7, 3))
    one = np.ones((1, 3))
    x = np.concatenate([lattice, hot, line, few, one])
    classes = np.repeat([0, 0, 1, 2, 3], [600, 500, 60, 7, 1])
    rows, points = _points(spark, x, classes)
    for k in (1, 5):
        got = {(r["__cls"], r["__id"]): r["__nbrs"] for r in K.exact_neighbours(points, k, 3, ring=8).collect()}
        assert got == _brute(rows, k)


def test_neighbours_of_a_plane_meet_a_bounded_number_of_points(spark, monkeypatch):
    rng = np.random.default_rng(8)
    n, k = 20_000, 5  # more than one region
    x = np.column_stack([rng.integers(0, 1500, n), rng.exponential(60, n).round(2)])
    rows, points = _points(spark, x, np.zeros(n, int))
    met, real = [], K.meetings
    monkeypatch.setattr(K, "meetings", lambda placed, *rest: met.append((placed, real(placed, *rest))) or met[0][1])
    got = {r["__id"]: r["__nbrs"] for r in K.exact_neighbours(points, k, 2).collect()}
    assert len(got) == n
    ids, at = np.array([r[1] for r in rows]), np.array([r[2] for r in rows])
    for i in range(0, n, 40):
        d = ((at - at[i]) ** 2).sum(axis=1)
        assert got[ids[i]] == [int(j) for j in ids[np.lexsort((ids, d))] if j != ids[i]][:k]
    cell = ["__cls", "__cell", "__ring"]
    assert met[0][0].select("__cell").distinct().count() > 1
    pairs = met[0][1].join(met[0][0].groupBy(*cell).count(), cell).agg(F.sum("count")).first()[0]
    assert pairs < 500 * n


def test_neighbours_where_nothing_can_be_ruled_out(spark):
    rows, points = _points(spark, np.random.default_rng(5).normal(size=(700, 70)), np.arange(700) % 2)
    got = {(r["__cls"], r["__id"]): r["__nbrs"] for r in K.exact_neighbours(points, 4, 70).collect()}
    assert got == _brute(rows, 4)


def _wide(n, k, seed):
    """Groups of columns around hidden ones, columns alone, constant ones."""
    rng = np.random.default_rng(seed)
    hidden = rng.normal(size=(n, 12))
    cols = [hidden[:, j % 12] * rng.choice((-1, 1)) + rng.normal(0, rng.uniform(0.05, 1.2), n) for j in range(k * 2 // 3)]
    cols += [rng.normal(size=n) for _ in range(k - len(cols) - 2)] + [np.ones(n), np.zeros(n)]
    return pd.DataFrame({f"c{j}": c for j, c in enumerate(cols)})


def test_two_thousand_columns(spark):
    n, k = 200, 2000
    data = _wide(n, k, 1)
    packed = written(spark.createDataFrame([(r,) for r in data.to_numpy().tolist()], "v ARRAY<DOUBLE>").repartition(2), "columns")
    counted = {}
    found, gaps = R._screened(packed, k, 0.85, counted)
    got = {(r["a"], r["b"]): r["r"] for r in found.collect()}
    assert not gaps
    corr = np.nan_to_num(np.corrcoef(data.to_numpy()[:, :-2].T))
    a, b = np.nonzero(np.triu(np.round(np.abs(corr), 4) >= 0.85, 1))
    assert set(got) == set(zip(a.tolist(), b.tolist())) and len(got) > 10_000
    assert max(abs(got[p] - corr[p]) for p in got) < 1e-9
    every = k * (k - 1) // 2
    assert counted["whole"] < 0.25 * every and counted["pivots"] < 0.02 * every and counted["part"] < every


def test_wide_evidence_with_gaps(spark):
    data = _wide(300, 110, 2)
    data.loc[data.index % 3 == 0, "c1"] = None
    data.loc[data.index % 5 == 0, "c13"] = None
    df = spark.createDataFrame(data)
    _, pairs = R.analyze_feature_relevance(df, None, [])
    want = data.corr()
    expected = {(x, y): want.loc[x, y] for x, y in itertools.combinations(data.columns, 2) if round(abs(want.loc[x, y]), 4) >= 0.85}
    got = pairs.collect()
    assert {(r["column_1"], r["column_2"]) for r in got} == set(expected) and any("c13" in p or "c1" in p for p in expected)
    assert all(abs(r["correlation"] - expected[r["column_1"], r["column_2"]]) < 1e-4 for r in got)
    assert [r["absolute_correlation"] for r in got] == sorted((r["absolute_correlation"] for r in got), reverse=True)


def test_no_rows_and_one_row(spark):
    names = [f"c{j}" for j in range(120)]
    none = spark.createDataFrame([], ", ".join(f"{c} DOUBLE" for c in names))
    assert R.strong_pairs(none, names).count() == 0
    one = spark.createDataFrame([tuple(float(j) for j in range(120))], names)
    assert R.strong_pairs(one, names).count() == 0
