"""The place of a row in the files it was read from: the order of first appearance.

A DataFrame has no row order, but a row of a file has one: its file's path and its
position there. Parquet readers give the position (``_metadata.row_index``); for other
formats it is the byte block a task reads and the count of rows before it in that
task. Both hold for a frame that is read from files and then only projected and
filtered; after a join, an aggregate or a union there is no such place.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_ROWWISE = {"Project", "Filter", "SubqueryAlias", "View", "LogicalRelation", "Relation", "DataSourceV2Relation"}
SEEN = "__seen"


def _reads_files(df: DataFrame) -> bool:
    """Only projections and filters stand between the frame and one file source."""
    node = df._jdf.queryExecution().analyzed()
    while True:
        if node.nodeName().split(" ")[0] not in _ROWWISE:
            return False
        if node.children().isEmpty():
            return bool(df.inputFiles())
        node = node.children().head()


def _resolves(df: DataFrame, *fields: str) -> bool:
    try:
        df.select(*[df.metadataColumn("_metadata").getField(f) for f in fields]).schema
    except AnalysisException:
        return False
    return True


def row_locator(df: DataFrame) -> Column | None:
    """An orderable column that grows in file order, or None where rows have no such place."""
    if not _reads_files(df):
        return None
    if _resolves(df, "file_path", "row_index"):
        at = df.metadataColumn("_metadata")
        return F.struct(at.getField("file_path").alias("file"), at.getField("row_index").alias("row"))
    if _resolves(df, "file_path", "file_block_start"):
        at = df.metadataColumn("_metadata")
        return F.struct(at.getField("file_path").alias("file"), at.getField("file_block_start").alias("block"),
                        F.monotonically_increasing_id().alias("row"))
    return None


def with_order(df: DataFrame, order_by: str | None, name: str = SEEN) -> tuple[DataFrame, bool]:
    """``df`` with the order of first appearance in ``name``: ``order_by`` if it is given, else
    the row locator. False where there is neither (the frame is as it was)."""
    order = F.col(order_by) if order_by is not None else row_locator(df)
    return (df, False) if order is None else (df.withColumn(name, order), True)
