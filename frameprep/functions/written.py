"""Intermediate tables as Parquet in the shared folder of ``spark.checkpoint.dir``:
readable by every executor, pruned by column when read back, and deleted when
their reader is done or, at the latest, when the process ends.
"""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import DataFrame, SparkSession

from frameprep.session import CHECKPOINT_CONF, ensure_checkpoint_dir

_PATHS: list[tuple[SparkSession, str]] = []


def shared_folder(spark: SparkSession) -> str:
    return (spark.conf.get(CHECKPOINT_CONF, None) or ensure_checkpoint_dir(spark)).rstrip("/")


def written(df: DataFrame, tag: str) -> DataFrame:
    """``df`` computed once, written, and read back."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/frameprep-{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _PATHS.append((spark, path))
    out = spark.read.schema(df.schema).parquet(path)
    out._written_path = path
    return out


def discard(*frames: DataFrame) -> None:
    """Delete written tables that nothing reads any more."""
    for df in frames:
        path = getattr(df, "_written_path", None)
        if path is not None:
            _delete(df.sparkSession, path)
            _PATHS[:] = [entry for entry in _PATHS if entry[1] != path]


def _delete(spark: SparkSession, path: str) -> None:
    jvm, jsc = spark.sparkContext._jvm, spark.sparkContext._jsc
    if jvm is None or jsc is None:
        return
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(jsc.hadoopConfiguration()).delete(p, True)


@atexit.register
def _delete_all() -> None:
    for spark, path in _PATHS:
        try:
            _delete(spark, path)
        except Exception:  # noqa: BLE001 - the session may have ended first
            return
