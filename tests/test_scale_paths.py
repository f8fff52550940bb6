"""Distributed building blocks checked against brute force on small fixtures:
ordered index, SMOTE's neighbours and draws, undersampling, fingerprint, CSV
inference, lookup tiers, plan checks, and the absence of Python UDFs."""

import os
import tempfile

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
from frameprep.functions import lookup
from frameprep.functions.fingerprint import fingerprint
from frameprep.functions.indexing import ordered_index
from frameprep.operators import encoding as EN
from frameprep.operators import imbalance as B
from frameprep.plans.pipeline import Plan, Step, check_plan
from frameprep.sources.csv import read_csv
from frameprep.sources.tables import table
from tests.conftest import SF_SMALL


def test_ordered_index_is_consecutive(spark):
    df = spark.range(0, 5000, numPartitions=7).select((F.col("id") * 7919 % 5003).alias("k"))
    got = sorted((r["index"], r["k"]) for r in ordered_index(df, ["k"]).collect())
    assert [i for i, _ in got] == list(range(5000))
    assert [k for _, k in got] == sorted(k for _, k in got)


def _brute_knn(points, k):
    d = ((points[:, None, :] - points[None, :, :]) ** 2).sum(-1)
    np.fill_diagonal(d, np.inf)
    return np.sort(d, axis=1)[:, :k]


def _neighbour_recall(spark, pts, k=5):
    d = pts.shape[1]
    df = spark.createDataFrame([("A", i, [float(x) for x in p]) for i, p in enumerate(pts)],
                               "__cls STRING, __id BIGINT, __vec ARRAY<DOUBLE>")
    got = {r["__id"]: r["__nbrs"] for r in B.nearest_neighbours(df, k, d).collect()}
    assert sorted(got) == list(range(len(pts)))
    assert all(len(set(n)) == k and i not in n for i, n in got.items())
    kth = _brute_knn(pts, k)[:, -1]
    near = [((pts[i] - pts[j]) ** 2).sum() <= kth[i] + 1e-12 for i, n in got.items() for j in n]
    return np.mean(near)


def test_neighbours_are_exact_in_small_classes_and_near_in_large_ones(spark):
    rng = np.random.default_rng(3)
    assert _neighbour_recall(spark, rng.normal(size=(2 * B.BLOCK, 3))) == 1.0
    assert _neighbour_recall(spark, rng.normal(size=(400, 2))) > 0.8
    assert _neighbour_recall(spark, np.cumsum(rng.random((500, 1)), axis=0)) == 1.0


@pytest.mark.parametrize("d", [12, 50])
def test_candidate_pairs_grow_with_the_rows(spark, d):
    rng = np.random.default_rng(4)

    def pairs(n):
        rows = [("A", i, [float(x) for x in p]) for i, p in enumerate(rng.normal(size=(n, d)))]
        return B.candidate_pairs(spark.createDataFrame(rows, "__cls STRING, __id BIGINT, __vec ARRAY<DOUBLE>"), d).count()

    small, large = pairs(500), pairs(2000)
    assert large <= 2000 * 3 * B.BLOCK * B.PROJECTIONS
    assert large <= 4.6 * small  # four times the rows


def test_smote_refuses_endless_features(spark):
    rows = [(float(i), 0) for i in range(40)] + [(float(i), 1) for i in range(9)] + [(float("inf"), 1)]
    with pytest.raises(ValueError, match="finite"):
        B.smote(spark.createDataFrame(rows, "x DOUBLE, t INT"), "t")


def test_resampling_takes_very_many_classes(spark):
    df = spark.range(0, 6000).select((F.col("id") % 1500).cast("string").alias("t"), F.col("id").cast("double").alias("x"))
    assert B.random_undersample(df.union(df.limit(50)), "t").groupBy("t").count().where("count <> 4").count() == 0


def test_smote_counts_segments_and_repeatability(spark):
    rng = np.random.default_rng(5)
    rows = [(float(x), float(y), 0) for x, y in rng.normal(size=(200, 2))]
    rows += [(float(x), float(y), 1) for x, y in rng.normal(loc=3, size=(30, 2))]  # at most two blocks: exact neighbours
    df = spark.createDataFrame(rows, "x DOUBLE, y DOUBLE, t INT")
    out = B.smote(df, "t")
    counts = {r["t"]: r["count"] for r in out.groupBy("t").count().collect()}
    assert counts == {0: 200, 1: 200}
    minority = np.array([(x, y) for x, y, t in rows if t == 1])
    knn = _brute_knn(minority, 5)
    new = np.array([(r["x"], r["y"]) for r in out.where("t = 1").collect()])
    orig = {tuple(p) for p in minority}
    synth = [p for p in new if tuple(p) not in orig]
    assert len(synth) == 170
    for p in synth:  # on a segment from some base row to one of its 5 nearest neighbours
        ok = False
        for i, a in enumerate(minority):
            d2 = ((minority - a) ** 2).sum(1)
            for j in np.where((d2 > 0) & (d2 <= knn[i, -1] + 1e-12))[0]:
                b = minority[j]
                lam = np.dot(p - a, b - a) / np.dot(b - a, b - a)
                if -1e-9 <= lam <= 1 + 1e-9 and np.allclose(a + lam * (b - a), p, atol=1e-9):
                    ok = True
                    break
            if ok:
                break
        assert ok
    again = sorted(tuple(r) for r in B.smote(df.repartition(5), "t").collect())
    assert again == sorted(tuple(r) for r in out.collect())


def test_undersample_exact_and_subset(spark):
    lb = table(spark, SF_SMALL, "labels")
    out = B.random_undersample(lb, "toxic")
    counts = {r["toxic"]: r["count"] for r in out.groupBy("toxic").count().collect()}
    n_min = min(r["count"] for r in lb.groupBy("toxic").count().collect())
    assert set(counts.values()) == {n_min}
    assert out.exceptAll(lb).count() == 0
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, B.random_undersample(lb.repartition(3), "toxic").collect()))


def test_fingerprint_order_free_and_null_aware(spark):
    ev = table(spark, SF_SMALL, "events")
    assert fingerprint(ev) == fingerprint(ev.repartition(5).orderBy(F.rand(1)))
    a = spark.createDataFrame([(1, None), (None, 1)], "x INT, y INT")
    b = spark.createDataFrame([(1, None), (1, None)], "x INT, y INT")
    assert fingerprint(a) != fingerprint(b)
    assert fingerprint(ev, "value") != fingerprint(ev, "user_id")


def test_csv_inference(spark):
    d = tempfile.mkdtemp(prefix="frameprep-csv-")
    path = os.path.join(d, "in.csv")
    with open(path, "w") as f:
        f.write("a,b,c,d,e,f\n007,1.5,2020-01-01,True,NA,x\n2,,2020-01-02,false,n/a,\n3,2e3,2020-01-03,TRUE,,y\n")
    df = read_csv(spark, path)
    types = dict(df.dtypes)
    assert types == {"a": "bigint", "b": "double", "c": "string", "d": "boolean", "e": "double", "f": "string"}
    assert [r["a"] for r in df.orderBy("a").collect()] == [2, 3, 7]


def test_csv_quotes_breaks_and_long_integers(spark):
    path = os.path.join(tempfile.mkdtemp(prefix="frameprep-csv-"), "in.csv")
    with open(path, "w") as f:
        f.write('a,b,c\n"say ""hi"", ok","line1\nline2",1234567890123456789\nplain,x,12\nz,y,\n')
    df = read_csv(spark, path)
    got = {tuple(r) for r in df.collect()}
    assert got == {('say "hi", ok', "line1\nline2", 1234567890123456789), ("plain", "x", 12), ("z", "y", None)}
    assert dict(df.dtypes)["c"] == "bigint"


def test_datetimes_with_fractions_and_offsets(spark):
    import datetime as dt

    from frameprep.operators import schema as S

    texts = ["2024-01-02 03:04:05.123456", "2024-01-02 03:04:05", "2024-01-02 03:04:05Z", "2024-01-02 03:04:05.5+01:30",
             "2024-01-02 03:04:05-0200", "2024-01-02", None, ""]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i INT, t STRING")
    got = [r["t"] for r in S.apply_schema_action(df, "t", "Convert to Datetime").orderBy("i").collect()]
    base = dt.datetime(2024, 1, 2, 3, 4, 5)
    assert got == [base.replace(microsecond=123456), base, base, base.replace(microsecond=500000) - dt.timedelta(hours=1, minutes=30),
                   base + dt.timedelta(hours=2), None, None, None]
    names = spark.createDataFrame([("05 Mar 2021",), ("17 Dec 2020",)], "t STRING")
    assert S.best_datetime_format(names, "t") == "dd MMM yyyy"


def test_duplicates_fold_nan_and_null_and_maps(spark):
    from frameprep.operators import duplicates as D

    df = spark.createDataFrame([(float("nan"),), (None,), (1.0,), (1.0,), (0.0,), (-0.0,)], "x DOUBLE")
    n, dup = D.duplicate_count(df)
    assert (n, dup) == (6, 3) and D.remove_duplicates(df).count() == 3
    groups = D.duplicate_groups(df, drop_null_groups=False).collect()
    assert [r["count"] for r in groups] == sorted([r["count"] for r in groups], reverse=True)
    maps = spark.createDataFrame([({"a": 1, "b": 2},), ({"b": 2, "a": 1},), ({"a": 2},)], "m MAP<STRING, INT>")
    assert D.duplicate_count(maps) == (3, 1) and D.remove_duplicates(maps).count() == 2
    assert fingerprint(maps) != fingerprint(maps.where("m['a'] = 1"))


def test_one_hot_names_never_overwrite(spark):
    df = spark.createDataFrame([("nan", 1.0), (None, 2.0), ("b", 3.0), ("B", 4.0)], "a STRING, a_b DOUBLE")
    out = EN.encode(df, "a", "One-Hot Encoding")
    assert out.columns == ["a_b", "a_B_", "a_b__", "a_nan", "a_nan_"]
    rows = {r["a_b"]: tuple(r)[1:] for r in out.collect()}
    assert rows == {1.0: (0, 0, 1, 0), 2.0: (0, 0, 0, 1), 3.0: (0, 1, 0, 0), 4.0: (1, 0, 0, 0)}
    wide = spark.range(1200).select(F.concat(F.lit("c"), "id").alias("k"), "id")
    assert len(EN.encode(wide, "k", "One-Hot Encoding").columns) == 1201
    sparse = EN.fit_one_hot(wide, "k", sparse=True).transform(wide).where("id = 7").first()["k"]
    assert sparse["size"] == 1200 and len(sparse["indices"]) == 1 and sparse["values"] == [1.0]


def test_evidence_is_reused(spark):
    from frameprep.plans.pipeline import EvidenceCache, recommend_all

    cache, ev = EvidenceCache(), table(spark, SF_SMALL, "events_missing")
    first = recommend_all(ev, target="event_type", order_by="event_id", cache=cache)
    assert cache.hits == 0
    again = recommend_all(ev, target="event_type", order_by="event_id", cache=cache)
    assert cache.hits >= 7 and [(s.stage, s.actions) for s in first] == [(s.stage, s.actions) for s in again]


def test_lookup_tiers_agree(spark, monkeypatch):
    ev = table(spark, SF_SMALL, "events")
    lit = {r["event_id"]: r["user_id"] for r in EN.encode(ev, "user_id", "Frequency Encoding").collect()}
    monkeypatch.setattr(lookup, "LITERAL_MAX", 0)
    bc = {r["event_id"]: r["user_id"] for r in EN.encode(ev, "user_id", "Frequency Encoding").collect()}
    monkeypatch.setattr(lookup, "BROADCAST_MAX", 0)
    sh = {r["event_id"]: r["user_id"] for r in EN.encode(ev, "user_id", "Frequency Encoding").collect()}
    assert lit == bc == sh


def test_plan_checks_before_running():
    with pytest.raises(ValueError):
        check_plan([Step("relevance", [("y", "Drop")])], target="y")
    with pytest.raises(ValueError):
        check_plan([Step("encoding", [("c", "Target Encoding")])], target=None)
    with pytest.raises(ValueError):
        check_plan([Step("scaling", [("c", "Log")])], target=None)
    with pytest.raises(ValueError):
        check_plan([Step("missing", [("y", "Drop Column")])], target="y")
    with pytest.raises(ValueError):
        check_plan([Step("encoding", [("c", "Ordinal Encoding")])], target=None)


def test_plan_checks_know_the_schema(spark):
    df = spark.createDataFrame([("a", 1.5)], "c STRING, y DOUBLE")
    with pytest.raises(ValueError, match="numeric column"):
        check_plan([Step("missing", [("c", "Mean")])], None, df)
    check_plan([Step("schema", [("c", "Convert to Numeric")]), Step("missing", [("c", "Mean")])], None, df)
    with pytest.raises(ValueError, match="numeric target"):
        check_plan([Step("encoding", [("y", "Target Encoding")])], "c", df)
    many = spark.range(40).withColumnRenamed("id", "t")
    with pytest.raises(ValueError, match="classification"):
        check_plan([Step("imbalance", imbalance_action="SMOTE")], "t", many)
    check_plan([Step("imbalance", imbalance_action="SMOTE")], "t", many.where("t < 5"))


def test_fitted_plan_replays(spark):
    ev = table(spark, SF_SMALL, "events")
    plan = Plan([Step("outliers", [("value", "Winsorization")]), Step("scaling", [("value", "StandardScaler")])])
    out, summaries, fitted = plan.run(ev, cut_lineage=True)
    again = fitted.transform(ev)
    a = {r["event_id"]: r["value"] for r in out.collect()}
    b = {r["event_id"]: r["value"] for r in again.collect()}
    assert a.keys() == b.keys() and all(abs(a[k] - b[k]) < 1e-12 for k in a)
    assert set(summaries) == {"outliers", "scaling"}


@pytest.mark.parametrize("name", ["outlier_evidence", "profile_columns", "one_hot", "frequency_encode_wide",
                                  "ordinal_encode", "impute_plan_rows", "scaling_plan_rows", "pipeline_end_to_end"])
def test_no_python_udf_in_plans(spark, name):
    df = E.queries()[name](spark, SF_SMALL)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PythonUDF" not in plan and "BatchEvalPython" not in plan and "ArrowEvalPython" not in plan


def test_approximate_mode_is_close(spark):
    from frameprep.functions.stats import exact_quantiles
    from frameprep.operators import profile as P

    li = table(spark, SF_SMALL, "lineitem")
    exact = {r["column_name"]: r["unique_values"] for r in P.profile_columns(li).collect()}
    approx = {r["column_name"]: r["unique_values"] for r in P.profile_columns(li, exact=False).collect()}
    for c in exact:
        assert abs(approx[c] - exact[c]) <= max(2, 0.05 * exact[c])
    e = exact_quantiles(li, ["l_extendedprice"], [0.25, 0.5, 0.75])["l_extendedprice"]
    a = exact_quantiles(li, ["l_extendedprice"], [0.25, 0.5, 0.75], approx=True)["l_extendedprice"]
    spread = e[2] - e[0]
    assert all(abs(x - y) <= 0.01 * spread for x, y in zip(e, a))


def test_fingerprint_deals_a_table_to_tasks_of_bounded_size(spark, monkeypatch, tmp_path):
    from frameprep.plans.registry import pipeline as Q

    n, read = 3000, []
    for name, key in Q._PRINTED.items():  # one key is in nearly all rows, one is missing
        spark.range(n).select(F.when(F.col("id") == 7, None).otherwise(F.greatest("id", F.lit(2900))).cast("int").alias(key),
                              F.col("id").alias("v")).write.parquet(f"{tmp_path}/{name}.parquet")
    monkeypatch.setattr(Q, "DEALT_ROWS", 100, raising=False)
    real = Q.fingerprint
    monkeypatch.setattr(Q, "fingerprint", lambda df: read.append(df.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]) or real(df))
    got = Q.q_fingerprint(spark, str(tmp_path)).collect()
    assert [tuple(r)[1:] for r in got] == [(n, True, True)] * len(Q._PRINTED)
    assert max(read[1::3]) < 300  # the table dealt out anew


def test_distinct_values_are_hashed_as_they_are(spark):
    """Numbers and times are counted without being written out as text, one search comes before
    the parsers, and the counts are those of the texts."""
    import datetime as dt

    from frameprep.functions.coerce import DATETIME_FORMATS, parse_datetime
    from frameprep.functions.stats import value_hashes
    from frameprep.operators import schema as S

    day = dt.datetime(2020, 1, 2, 3, 4, 5)
    rows = [(0.0, 1, day, "2020-01-02", True), (-0.0, 1, day, "02/01/2020 10:00", None), (float("nan"), None, None, "no date", False),
            (float("inf"), -1, day.replace(microsecond=1), "20200102", True), (None, 2, day, None, True), (1.5, 2, None, "5 Mar 2021", None)]
    df = spark.createDataFrame(rows, "d DOUBLE, i BIGINT, t TIMESTAMP_NTZ, s STRING, b BOOLEAN")
    plan = value_hashes(df, ["d", "i", "t", "b"])._jdf.queryExecution().optimizedPlan().toString()
    assert "as string" not in plan
    got = {}
    for r in value_hashes(df, df.columns).collect():
        got.setdefault(r["column"], []).append(r["cnt"])
    assert {c: sorted(v) for c, v in got.items()} == {"d": [1, 1, 2], "i": [1, 2, 2], "t": [1, 3], "s": [1] * 5, "b": [1, 3]}
    assert sorted(r["cnt"] for r in value_hashes(df, ["d"], keep_null=True).collect()) == [1, 1, 2, 2]
    one = df.agg(*[F.count(parse_datetime(F.col("s"), f)).alias(str(j)) for j, (f, _) in enumerate(DATETIME_FORMATS)]).first()
    assert S._format_counts(df, ["s"]) == {"s": list(one)}
