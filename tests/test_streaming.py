"""A plan fitted on a batch, replayed on a file stream, equals the batch result."""

import os
import tempfile

from pyspark.sql import functions as F

from frameprep.plans.pipeline import Plan, Step
from frameprep.sources.tables import table
from frameprep.streaming.replay import start
from tests.conftest import SF_SMALL


def test_fitted_plan_on_stream(spark):
    src = table(spark, SF_SMALL, "events_missing")
    folder = os.path.join(tempfile.mkdtemp(prefix="frameprep-stream-"), "in")
    src.write.parquet(folder)
    plan = Plan([
        Step("missing", [("value", "Median"), ("event_type", "Mode")]),
        Step("outliers", [("value", "Winsorization")]),
        Step("encoding", [("event_type", "One-Hot Encoding")]),
        Step("scaling", [("user_id", "MinMaxScaler")]),
    ])
    batch_out, _, fitted = plan.run(src)
    stream = spark.readStream.schema(src.schema).parquet(folder)
    q = start(stream, fitted, "memory", query_name="frameprep_stream_test")
    q.awaitTermination(120)
    got = spark.table("frameprep_stream_test")
    assert sorted(got.columns) == sorted(batch_out.columns)
    cols = sorted(batch_out.columns)
    a = sorted(tuple(r) for r in got.select(*cols).collect())
    b = sorted(tuple(r) for r in batch_out.select(*cols).collect())
    assert a == b
    assert got.where(F.col("value").isNull()).count() == 0
