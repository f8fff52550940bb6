"""Exact duplicates by deterministic block naming.

Every normalised text is cut into blocks of ``block_bytes``. The distinct
blocks are sorted by their whole content and numbered; a text is then a list
of integers, and adjacent pairs of integers are themselves sorted and numbered,
level by level, until one integer is left. Texts of the same block count and
the same last integer are equal, and only those: a name stands for one content.

Blocks travel to their names by a 128-bit digest. That the digest is one-to-one
on this data is checked against the sorted contents; if two contents ever
shared one, the pass is repeated with another salt, so no result rests on luck.

Skew: equal blocks and equal pairs are collapsed on the map side before the
shuffle; names are joined back on one row per distinct key, so a hot block is a
hot key on one side only, which adaptive skew handling splits. Sizes and kept
ids are plain aggregates. No group is gathered in one task.

Cases: a null text counts as empty; an empty text is one empty block; rows
repeating a doc_id are each returned; a null doc_id stays null and is never
kept over a real one; extra columns are ignored; an empty table gives none.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from frameprep.llm.common import lower_bytes, release, sliced, staged, text_or_empty

BLOCK_BYTES = 4096


def _blocks(text: str | None, size: int) -> list[bytes]:
    raw = lower_bytes(text)
    return [raw[i:i + size] for i in range(0, len(raw), size)] or [b""]


def _digest(block: bytes, salt: int) -> bytes:
    return hashlib.blake2b(block, digest_size=16, salt=salt.to_bytes(8, "little")).digest()


def _block_rows(size: int, salt: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            blocks = list({b for t in batch.column(0).to_pylist() for b in _blocks(t, size)})
            yield pa.RecordBatch.from_arrays(
                [pa.array([_digest(b, salt) for b in blocks], pa.binary()), pa.array(blocks, pa.binary())], ["key", "block"])
    return run


def _doc_rows(size: int, salt: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            sha, keys = [], []
            for t in batch.column(1).to_pylist():
                sha.append(hashlib.sha256(lower_bytes(t)).hexdigest())
                keys.append([_digest(b, salt) for b in _blocks(t, size)])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sha, pa.string()), pa.array(keys, pa.list_(pa.binary()))],
                ["doc_id", "text_sha256", "keys"])
    return run


def _named(distinct: DataFrame, order: list[str], keep: list[str], tag: str) -> DataFrame:
    """Integer names in sorted order within each shuffle partition, fixed by writing them."""
    return staged(
        distinct.sortWithinPartitions(*order).select(*keep, F.monotonically_increasing_id().alias("name")), tag)


def block_names(texts: DataFrame, block_bytes: int = BLOCK_BYTES) -> tuple[DataFrame, int]:
    """(key, name) of every distinct block, and the salt under which keys are one-to-one."""
    salt = 0
    while True:
        blocks = texts.mapInArrow(_block_rows(block_bytes, salt), "key binary, block binary").distinct()
        names = _named(blocks, ["key", "block"], ["key"], "names")
        counts = names.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("key").alias("k")).first()
        if counts["n"] == counts["k"]:
            return names, salt
        release(names)
        salt += 1


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256."""
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    names, salt = block_names(src.select("text"), block_bytes)
    rows = staged(
        src.mapInArrow(_doc_rows(block_bytes, salt), "doc_id long, text_sha256 string, keys array<binary>"), "docs")
    cells = (
        rows.select("doc_id", "text_sha256", F.size("keys").alias("blocks"), F.posexplode("keys").alias("pos", "key"))
        .join(names, "key")
        .select("doc_id", "text_sha256", "blocks", F.col("blocks").alias("width"), "pos", "name")
    )
    done = []
    while True:
        cells = staged(cells, "cells")
        done.append(cells.where("width = 1").select("doc_id", "text_sha256", "blocks", "name"))
        wide = cells.where("width > 1")
        if wide.isEmpty():
            break
        pairs = wide.groupBy("doc_id", "text_sha256", "blocks", "width", (F.col("pos") / 2).cast("int").alias("pos")).agg(
            F.max(F.when(F.col("pos") % 2 == 0, F.col("name"))).alias("left"),
            F.coalesce(F.max(F.when(F.col("pos") % 2 == 1, F.col("name"))), F.lit(-1)).alias("right"))
        pair_names = _named(pairs.select("left", "right").distinct(), ["left", "right"], ["left", "right"], "pairs")
        cells = pairs.join(pair_names, ["left", "right"]).select(
            "doc_id", "text_sha256", "blocks", F.ceil(F.col("width") / 2).cast("int").alias("width"), "pos", "name")
    one = done[0]
    for more in done[1:]:
        one = one.unionByName(more)
    ident = one.distinct().select(
        F.col("doc_id").alias("i"), F.col("text_sha256").alias("s"), "blocks", "name")
    named = rows.select("doc_id", "text_sha256").join(
        ident, F.col("doc_id").eqNullSafe(F.col("i")) & (F.col("text_sha256") == F.col("s"))).drop("i", "s")
    groups = named.groupBy("blocks", "name").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    return named.join(groups, ["blocks", "name"]).select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def _with_digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in sliced(batches):
        digest = [hashlib.sha256(lower_bytes(t)).hexdigest() for t in batch.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(digest, pa.string())], ["doc", "i", "sha"])


def keep_one_per_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the rows that the dedup drops (and without rows repeated as
    they are); columns unchanged. The decisions are the block names'; the digest
    only tells apart rows that repeat a doc_id with other texts."""
    gone = exact_dedup(docs, id_col, text_col).where(~F.col("kept")).select(
        F.col("doc_id").alias("gone_id"), F.col("text_sha256").alias("gone_sha")).distinct()
    whole = docs.select(F.struct("*").alias("doc"), F.col(id_col).cast("long").alias("i"), text_or_empty(text_col).alias("t"))
    schema = T.StructType([whole.schema["doc"], T.StructField("i", T.LongType()), T.StructField("sha", T.StringType())])
    marked = whole.mapInArrow(_with_digest, schema)
    left = marked.join(gone, F.col("i").eqNullSafe(F.col("gone_id")) & (F.col("sha") == F.col("gone_sha")), "left_anti")
    return left.dropDuplicates(["i", "sha"]).select("doc.*")


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ORACLE = f"""
WITH n AS (SELECT doc_id, translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}') AS t FROM documents),
g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY t)
SELECT n.doc_id AS doc_id, g.keep_id AS keep_id, g.group_size AS group_size,
       n.doc_id IS NOT DISTINCT FROM g.keep_id AS kept, sha256(n.t) AS text_sha256
FROM n JOIN g ON n.t = g.t"""
