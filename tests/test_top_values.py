"""Top lists and modes by hash: equal to a plain count, whatever the values share."""

import random
from collections import Counter

from frameprep.functions.stats import top_values, value_keys
from frameprep.operators import profile as P


def _brute(values, k):
    ranked = sorted(Counter(v for v in values if v is not None).items(), key=lambda x: (-x[1], x[0].encode()))
    return [(i, v, n) for i, (v, n) in enumerate(ranked[:k], 1)]


def _got(top, column):
    return [(r["rank"], r["value"], r["count"]) for r in top.where(f"column_name = '{column}'").orderBy("rank").collect()]


def test_long_values_that_share_their_heads(spark):
    rnd = random.Random(3)
    a, b = "head " * 30, "é🙂" * 500
    pool = [a + str(i) for i in range(40)] + [b + str(i) for i in range(40)] + [a, b, "", "x" * 48, "x" * 49, "x" * 47]
    texts = [v for v in pool for _ in range(rnd.choice([1, 2, 2, 3]))] + [None] * 5 + [a + "hot"] * 300
    rnd.shuffle(texts)
    other = [str(i % 7) if i % 3 else None for i in range(len(texts))]
    df = spark.createDataFrame(list(zip(texts, other)), "t STRING, u STRING").repartition(5)
    for k in (1, 3, 10, 60, 200):
        top, counts = top_values(df, ["t", "u"], k)
        assert _got(top, "t") == _brute(texts, k) and _got(top, "u") == _brute(other, k)
        assert counts["t"] == (len(set(texts) - {None}), sum(v is not None for v in texts))
    summary = P.categorical_summary(df, "t").collect()
    assert {r["most_frequent"] for r in summary} == {a + "hot"} and len(summary) == 10


def test_all_values_once_with_one_head(spark):
    texts = ["same beginning " * 60 + f"{i:05d}" for i in range(3000)]
    df = spark.createDataFrame([(t,) for t in texts], "t STRING").repartition(4)
    assert _got(top_values(df, ["t"], 10)[0], "t") == [(i + 1, t, 1) for i, t in enumerate(texts[:10])]


def test_nothing_to_rank(spark):
    df = spark.createDataFrame([(None, "a")], "t STRING, u STRING")
    assert P.categorical_summary(df, "t").count() == 0 and P.ranked_values(df, []).count() == 0
    assert [(r["column_name"], r["mode"]) for r in P.column_modes(df, ["t", "u"]).collect()] == [("u", "a")]


def test_no_whole_text_is_shuffled(spark):
    """What crosses the network for a near-unique text column does not grow with the texts."""
    sizes = []
    for length in (100, 4000):
        df = spark.range(2000).selectExpr(f"concat(id, repeat('y', {length})) AS t")
        keys = value_keys(df, ["t"])
        sizes.append(keys.agg({"head": "max"}).first()[0])
        plan = keys._jdf.queryExecution().executedPlan().toString()
        assert "HashAggregate" in plan and "SortAggregate" not in plan
        rows = keys.collect()
        assert len(rows) == 2000 and all(len(r["head"]) <= 48 and not r["whole"] for r in rows)
    assert len(sizes[0]) == len(sizes[1]) == 48
