"""Fitted row-local steps on a Structured Streaming source (L3 on streams).

Evidence, fits and resampling are batch work. What they produce - fills,
casts, clip bounds, filters, scalers, encodings - is row-local: literals in a
projection or a stream-static join against a fitted lookup table. So a
``FittedPlan`` fitted on a batch applies unchanged to a streaming DataFrame;
no state is kept across micro-batches. Duplicate removal on a stream needs a
watermark and uses ``dropDuplicatesWithinWatermark``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from frameprep.plans.pipeline import FittedPlan
from frameprep.session import ensure_checkpoint_dir


def transform_stream(stream: DataFrame, fitted: FittedPlan) -> DataFrame:
    if not stream.isStreaming:
        raise ValueError("transform_stream expects a streaming DataFrame")
    return fitted.transform(stream)


def dedupe_stream(stream: DataFrame, event_time: str, delay: str, columns: list[str] | None = None) -> DataFrame:
    """Stream counterpart of Remove Duplicates: exact copies seen within the
    watermark delay are dropped; state older than the watermark is released."""
    keyed = stream.withWatermark(event_time, delay)
    return keyed.dropDuplicatesWithinWatermark(columns or [c for c in stream.columns])


def start(stream: DataFrame, fitted: FittedPlan, fmt: str, path: str | None = None, query_name: str | None = None,
          checkpoint: str | None = None, available_now: bool = True) -> StreamingQuery:
    """Start the transformed stream. The progress checkpoint goes under the
    shared folder named by ``spark.checkpoint.dir`` unless one is given."""
    spark = stream.sparkSession
    checkpoint = checkpoint or f"{ensure_checkpoint_dir(spark).rstrip('/')}/stream-{uuid.uuid4().hex}"
    writer = transform_stream(stream, fitted).writeStream.format(fmt).option("checkpointLocation", checkpoint)
    if query_name:
        writer = writer.queryName(query_name)
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start(path) if path else writer.start()
