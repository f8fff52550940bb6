"""Hot keys and groups of copies: one key or one repeated row holding a third
or more of the rows must not change results (and must not need all pairs)."""

import numpy as np
from pyspark.sql import functions as F

from frameprep.functions import lookup
from frameprep.operators import encoding as EN
from frameprep.operators import imbalance as B
from frameprep.operators import profile as P


def test_smote_with_a_block_of_copies(spark):
    rng = np.random.default_rng(11)
    rows = [(float(x), float(y), "A") for x, y in rng.normal(size=(300, 2))]
    rows += [(0.0, 0.0, "B")] * 60 + [(float(x), float(y), "B") for x, y in rng.normal(scale=0.5, size=(60, 2))]
    df = spark.createDataFrame(rows, "x DOUBLE, y DOUBLE, t STRING")
    out = B.smote(df, "t")
    assert {r["t"]: r["count"] for r in out.groupBy("t").count().collect()} == {"A": 300, "B": 300}
    minority = np.array([(x, y) for x, y, t in rows if t == "B"])
    d2 = ((minority[:, None, :] - minority[None, :, :]) ** 2).sum(-1)
    np.fill_diagonal(d2, np.inf)
    new = np.array([(r["x"], r["y"]) for r in out.where("t = 'B'").collect()])
    # every B row of the output is an input row or lies on a segment to a row of its class
    inputs = {tuple(v) for v in minority}
    for p in new:
        if tuple(p) in inputs:
            continue
        ok = False
        for i, a in enumerate(minority):
            for j in np.argsort(d2[i])[:40]:
                b = minority[j]
                denom = np.dot(b - a, b - a)
                lam = np.dot(p - a, b - a) / denom if denom else 0.0
                if -1e-9 <= lam <= 1 + 1e-9 and np.allclose(a + lam * (b - a), p, atol=1e-9):
                    ok = True
                    break
            if ok:
                break
        assert ok


def test_hot_key_lookup_tiers_agree(spark, monkeypatch):
    n = 3000
    df = spark.range(n).select(F.col("id"), F.when(F.col("id") % 2 == 0, F.lit("hot")).otherwise(
        (F.col("id") % 700).cast("string")).alias("k"), (F.col("id") % 7).cast("double").alias("y"))
    a = {r["id"]: r["k"] for r in EN.encode(df, "k", "Target Encoding", target="y").collect()}
    monkeypatch.setattr(lookup, "LITERAL_MAX", 0)
    monkeypatch.setattr(lookup, "BROADCAST_MAX", 0)
    b = {r["id"]: r["k"] for r in EN.encode(df, "k", "Target Encoding", target="y").collect()}
    assert a == b


def test_hot_class_undersampling_and_frequencies(spark):
    df = spark.range(3000).select(F.col("id"), F.when(F.col("id") < 2000, F.lit(0)).otherwise(
        (F.col("id") % 3).cast("int") + 1).alias("t"))
    out = B.random_undersample(df, "t")
    counts = {r["t"]: r["count"] for r in out.groupBy("t").count().collect()}
    assert set(counts) == {0, 1, 2, 3} and len(set(counts.values())) == 1
    top = P.ranked_values(df, ["t"], 1).first()
    assert top["value"] == "0" and top["count"] == 2000
