"""Consecutive 0-based positions in a sort order, without one task holding
all rows (a DataFrame form of ``zipWithIndex``).

The rows are range-partitioned and sorted, written to the shared folder so that
partition ids and positions are fixed, then each row gets the
count of rows in earlier partitions (a table of one row per partition) plus
its place inside its own partition.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from frameprep.functions.written import written


def ordered_index(df: DataFrame, order_cols: list[str], name: str = "index") -> DataFrame:
    """``df`` plus a LONG column ``name`` = position in ``order_cols`` order.

    ``order_cols`` must identify a row, or ties get an arbitrary but fixed order.
    """
    ranged = written(
        df.repartitionByRange(*order_cols)
        .sortWithinPartitions(*order_cols)
        .withColumn("__pid", F.spark_partition_id())
        .withColumn("__mid", F.monotonically_increasing_id()),
        "index",
    )
    per_part = ranged.groupBy("__pid").agg(F.count(F.lit(1)).alias("__n"), F.min("__mid").alias("__first"))
    # one row per partition: the running total is a tiny single-task window
    offsets = per_part.withColumn(
        "__off", F.coalesce(F.sum("__n").over(Window.orderBy("__pid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ).select("__pid", "__first", "__off")
    return (
        ranged.join(F.broadcast(offsets), "__pid")
        .withColumn(name, F.col("__off") + (F.col("__mid") - F.col("__first")))
        .drop("__pid", "__mid", "__first", "__off")
    )
