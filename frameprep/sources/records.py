"""CSV records of files whose quoted fields hold line breaks, read in parallel.

Whether a line break ends a record depends on everything before it. A line maps the
state at its start (outside or inside quotes) to the state at its end; such maps
compose, so the state at the start of every line is a prefix composition: over the
lines of a byte block (one block is one task's input), then over the blocks of a file,
of which there are few. With it, lines that start inside quotes are joined to the
record they continue; all other records never meet.

A map of two states keeps the state, flips it, or resets it to one value. The state at
a line is the value of the last reset before it, flipped by the parity of the flips
since: running sums, no loop.

A quote opens a field only at its start, is doubled inside, and is text anywhere else.
A quote that is never closed takes the rest of its file into one record, as a reader of
the whole file would do.
"""

from __future__ import annotations

import csv
import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from frameprep.functions.written import discard, written

_CLOSING = r'^[^"]*+(?:""[^"]*+)*+"'


def _ends(line: Column, sep: str) -> tuple[Column, Column]:
    """The state after a line that starts outside and inside quotes (0 outside, 1 inside)."""
    start = f"(^|{re.escape(sep)})"
    whole = start + r'"[^"]*+(?:""[^"]*+)*+"'
    opened = lambda text: F.regexp_replace(text, whole, "$1x").rlike(start + '"').cast("int")
    return opened(line), F.when(line.rlike(_CLOSING), opened(F.regexp_replace(line, _CLOSING, "x"))).otherwise(1)


def _lines(spark: SparkSession, path: str, sep: str) -> DataFrame:
    """file, block, line (grows inside a block), value, e0, e1."""
    text = spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("line"), "value")
    e0, e1 = _ends(F.col("value"), sep)
    return text.withColumns({"e0": e0, "e1": e1})


def has_quoted_breaks(spark: SparkSession, path: str, sep: str = ",") -> bool:
    """Whether some line leaves a quoted field open; if none does, every line is a record."""
    return not _lines(spark, path, sep).where("e0 = 1").isEmpty()


def _with_starts(rows: DataFrame, part: list[str], order: str) -> DataFrame:
    """``s0`` and ``s1``: the state at the start of each row if its partition starts outside, inside."""
    before = Window.partitionBy(*part).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    odd = lambda c: c.bitwiseAND(1).cast("int")
    flips = F.coalesce(F.sum(((F.col("e0") == 1) & (F.col("e1") == 0)).cast("long")).over(before), F.lit(0).cast("long"))
    rows = rows.withColumn("flips", flips)
    reset = F.last(F.when(F.col("e0") == F.col("e1"), F.col("e0").bitwiseXOR(odd(F.col("flips")))), ignorenulls=True).over(before)
    return rows.withColumn("reset", reset).withColumns({
        f"s{s}": F.coalesce("reset", F.lit(s)).bitwiseXOR(odd(F.col("flips"))) for s in (0, 1)}).drop("flips", "reset")


def csv_records(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """file, block, line (of the record's first line), record: one row per record."""
    lines = written(_with_starts(_lines(spark, path, sep), ["file", "block"], "line"), "lines")
    end = lambda s: F.when(F.col(s) == 0, F.col("e0")).otherwise(F.col("e1"))
    first = lambda s: F.max(F.when(F.col(s) == 0, F.col("line")))
    blocks = lines.groupBy("file", "block").agg(
        F.max_by(end("s0"), "line").alias("e0"), F.max_by(end("s1"), "line").alias("e1"), first("s0").alias("o0"), first("s1").alias("o1"))
    blocks = _with_starts(blocks, ["file"], "block").withColumn("at", F.col("s0"))  # a file starts outside quotes
    opened = F.when(F.when(F.col("at") == 0, F.col("o0")).otherwise(F.col("o1")).isNotNull(), F.struct(
        F.col("block").alias("b"), F.when(F.col("at") == 0, F.col("o0")).otherwise(F.col("o1")).alias("l")))
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("file", "block", "at", F.last(opened, ignorenulls=True).over(earlier).alias("open"))
    known = lines.join(blocks, ["file", "block"]).withColumn("start", F.when(F.col("at") == 0, F.col("s0")).otherwise(F.col("s1")))
    known = known.withColumn("inside", F.when(F.col("start") == 0, F.col("e0")).otherwise(F.col("e1")))
    alone = known.where("start = 0 AND inside = 0").select("file", "block", "line", F.col("value").alias("record"))
    # lines of records that span several: the record is named by the last line that started outside
    here = Window.partitionBy("file", "block").orderBy("line")
    own = F.last(F.when(F.col("start") == 0, F.struct(F.col("block").alias("b"), F.col("line").alias("l"))), ignorenulls=True).over(here)
    parts = known.where("start = 1 OR inside = 1").withColumn("own", F.coalesce(own, "open"))
    joined = parts.groupBy("file", F.col("own.b").alias("b"), F.col("own.l").alias("l")).agg(
        F.array_sort(F.collect_list(F.struct("block", "line", "value"))).alias("all"))
    spanning = joined.select("file", F.col("b").alias("block"), F.col("l").alias("line"), F.array_join(
        F.transform("all", lambda t: t["value"]), "\n").alias("record"))
    out = written(alone.unionByName(spanning).withColumn("record", F.regexp_replace("record", "\r$", "")), "records")
    discard(lines)
    return out


def _names(header: str, sep: str) -> list[str]:
    """Column names of the header record; empty and repeated ones get their place, as Spark names them."""
    names = next(csv.reader([header.lstrip("﻿")], delimiter=sep), [])
    lower = [n.lower() for n in names]
    return [f"_c{i}" if not n else f"{n}{i}" if lower.count(n.lower()) > 1 else n for i, n in enumerate(names)]


def read_quoted_csv(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """All columns as text. The first record of each file is its header."""
    records = csv_records(spark, path, sep)
    heads = records.groupBy("file").agg(F.min(F.struct("block", "line")).alias("head"))
    top = records.join(heads, "file").where(F.struct("block", "line") == F.col("head")).orderBy("file").limit(1).collect()
    if not top:
        return spark.createDataFrame([], T.StructType([]))
    names = _names(top[0]["record"], sep)
    schema = T.StructType([T.StructField(f"c{i}", T.StringType()) for i in range(len(names))])
    rows = records.join(heads, "file").where((F.struct("block", "line") != F.col("head")) & (F.trim("record") != ""))
    parsed = rows.select(F.from_csv("record", schema.simpleString()[7:-1].replace(":", " "), {"sep": sep, "quote": '"', "escape": '"'}).alias("r"))
    return parsed.select(*[F.col(f"r.c{i}").alias(n) for i, n in enumerate(names)])
