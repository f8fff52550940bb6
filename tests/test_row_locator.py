"""Order of first appearance from the rows' places in their files, and samples without a sort."""

import pandas as pd
import pytest
from pyspark.sql import functions as F

from frameprep.functions.locate import row_locator, with_order
from frameprep.operators import encoding as E
from frameprep.operators import profile as P
from frameprep.operators import schema as S
from frameprep.sources.tables import table
from tests.conftest import SF_SMALL


@pytest.fixture(scope="module")
def shuffled(spark, tmp_path_factory):
    """Four files in path order, values in no order, nulls, and columns named like our own."""
    rows = pd.DataFrame({"v": [(k * 7919) % 1009 for k in range(4000)], "t": [None if k % 3 == 0 else f"w{(k * 31) % 700}" for k in range(4000)]})
    rows["row"] = rows["file"] = 1
    top = tmp_path_factory.mktemp("files")
    for k in range(4):
        rows[k * 1000:(k + 1) * 1000].to_parquet(top / f"part-{k}.parquet", row_group_size=130)
        rows[k * 1000:(k + 1) * 1000].to_csv(top / f"part-{k}.csv", index=False)
    return rows, spark.read.parquet(str(top / "*.parquet")), spark.read.option("header", True).csv(str(top / "*.csv"))


def test_parquet_rows_come_in_file_order(spark, shuffled):
    rows, parquet, _ = shuffled
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")  # several tasks a file
    try:
        seen, found = with_order(parquet.select("v", "t").where("v > 10"), None)
        assert found and seen.rdd.getNumPartitions() > 4
        want = rows[rows.v > 10]
        assert [r["v"] for r in seen.orderBy("__seen").collect()] == want.v.tolist()
        assert S.sample_values(parquet, ["v", "t"]) == {"v": ",".join(map(str, rows.v[:5])), "t": ",".join(rows.t.dropna()[:5])}
        codes = {r["key"]: r["value"] for r in E.fit_ordinal(parquet, "t").mapping.collect()}
        assert codes == {t: k for k, t in enumerate(rows.t.dropna().drop_duplicates())}
        assert [r["v"] for r in P.preview(parquet, 7).collect()] == rows.v[:7].tolist() and P.preview(parquet).columns == parquet.columns
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_text_rows_come_in_file_order(spark, shuffled):
    rows, _, csv = shuffled
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3k")
    try:
        assert S.sample_values(csv, ["v"])["v"] == ",".join(map(str, rows.v[:5]))
        codes = {r["key"]: r["value"] for r in E.fit_ordinal(csv, "t").mapping.collect()}
        assert codes == {t: k for k, t in enumerate(rows.t.dropna().drop_duplicates())}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_frames_without_a_place(spark, shuffled):
    _, parquet, _ = shuffled
    made = spark.createDataFrame([(3, "b"), (1, "a"), (2, None)], "v INT, t STRING")
    for df in (made, parquet.groupBy("v").count(), parquet.join(made, "v"), parquet.union(parquet), parquet.select("v").distinct()):
        assert row_locator(df) is None
    assert S.sample_values(made, ["v", "t"]) == {"v": "1,2,3", "t": "a,b"}
    with pytest.raises(ValueError, match="not read from files"):
        E.fit_ordinal(made, "t")


def test_samples_neither_sort_nor_shuffle(spark):
    li = table(spark, SF_SMALL, "lineitem")
    for order in (None, "l_orderkey"):
        plan = S.sample_plan(li, ["l_suppkey", "l_returnflag"], order)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("TakeOrderedAndProject") == 2 and "Exchange" not in plan and "Sort " not in plan and "Window" not in plan
        assert "l_tax" not in plan  # a column's scan reads that column and the order


def test_first_values_of_wide_frames(spark):
    df = spark.range(50).select(*[(F.col("id") * 3 + k).alias(f"c{k}") for k in range(60)])
    got = S.sample_values(df, df.columns, "c0", 2)
    assert got == {f"c{k}": f"{k},{k + 3}" for k in range(60)}
