"""Shared helpers of the training-data operators: staged tables in the shared
folder, reading the driver's tables, ASCII lower-casing, Arrow row helpers.

Intermediate results are written as Parquet to the folder named by
``spark.checkpoint.dir`` (every executor sees it), so a lost executor re-reads
files instead of recomputing a lineage, and narrow columns can be pruned.
"""

from __future__ import annotations

import atexit
import gc
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from frameprep.session import CHECKPOINT_CONF, ensure_checkpoint_dir

#: bytes A-Z mapped to a-z, everything else unchanged (UTF-8 safe)
ASCII_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))

_STAGED: list[tuple[SparkSession, str]] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared folder; a scratch one only for a bare local session."""
    return spark.conf.get(CHECKPOINT_CONF, None) or ensure_checkpoint_dir(spark)


def tasks_for(rows: int, each: int = 20_000) -> int:
    """Tasks for a table of so many narrow rows: in proportion, at least one."""
    return rows // each + 1


def staged(df: DataFrame, tag: str, tasks: int | None = None) -> DataFrame:
    """``df`` written once to the shared folder and read back; ``tasks`` joins small
    shuffle partitions so that a small table is not written as very many files."""
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/llm-{tag}-{uuid.uuid4().hex}"
    (df if tasks is None else df.coalesce(tasks)).write.parquet(path)
    _STAGED.append((spark, path))
    out = spark.read.schema(df.schema).parquet(path)
    out._staged_path = path
    return out


def release(*frames: DataFrame) -> None:
    """Delete staged folders that nothing will read again."""
    for df in frames:
        path = getattr(df, "_staged_path", None)
        entry = (df.sparkSession, path)
        if entry in _STAGED:
            _delete(*entry)
            _STAGED.remove(entry)


def forget(spark: SparkSession) -> None:
    """Have the driver drop finished plans now: the shuffle files of tables that are written go with them."""
    gc.collect()  # frames in reference cycles hold their plans
    if spark.sparkContext._jvm is not None:
        spark.sparkContext._jvm.System.gc()


def staged_so_far() -> int:
    return len(_STAGED)


def release_since(mark: int, *keep: DataFrame) -> None:
    """Delete what was staged after ``mark``, but for ``keep``: its readers are done."""
    kept = {getattr(df, "_staged_path", None) for df in keep}
    for entry in [e for e in _STAGED[mark:] if e[1] not in kept]:
        _delete(*entry)
        _STAGED.remove(entry)


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    if jvm is None:
        return
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


@atexit.register
def _release_all() -> None:
    """Best effort at interpreter exit, while a session still lives."""
    for spark, path in _STAGED:
        try:
            if spark.sparkContext._jsc is not None:
                _delete(spark, path)
        except Exception:  # noqa: BLE001 - the session may be gone already
            return


def sliced(batches, rows: int = 1000):
    """Arrow batches in smaller parts, so that few texts are Python objects at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def lower_bytes(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass").translate(ASCII_LOWER)


def text_or_empty(name: str = "text"):
    return F.coalesce(F.col(name).cast("string"), F.lit(""))
