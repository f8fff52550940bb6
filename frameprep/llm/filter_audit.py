"""Filter interaction audit: which filter removes what, in every order, with the
duplicate filter decided by radix text tries.

Four filters look at one text (few words, few distinct words, capitals, symbols);
the fifth asks whether the whole text stands at a smaller id anywhere in the table.
Each document becomes a mask of the filters it fails, and every number of the
audit is a sum over masks.

Duplicates:
1. A scan inserts its texts into compressed tries of bounded size. A text met before
   in the same trie only leaves a reference, so of many copies one text a trie goes on.
2. The texts are range-partitioned by a prefix. Prefixes are adaptive: a prefix that
   holds more than 1 / ``HEAVY`` of all characters is replaced by a longer one, level
   by level, up to the whole text, so long common openings do not meet in one task.
   The driver gets at most ``HEAVY`` prefixes a level, whatever the size of the table.
3. Each partition inserts its texts into one compressed trie whose terminals hold the
   smallest id; a traverse gives it to every reference, and a join on the reference
   (a number, not a text) flags the documents.

Texts are compared whole, in tries; no digest decides. Of a text that a third of all
rows share, one copy per scanned trie reaches its partition.

Cases: a null text is empty; equal ids with equal texts do not make each other
duplicates; a null id is no smaller than any, and its row is no duplicate; a null
source is the part ''; ids without a label lose nothing good or toxic; several label
rows of one id count if any of them says 1; an empty table gives no rows; extra
columns are ignored.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from frameprep.llm.common import release, sliced, staged

FILTERS = "ABCDE"
MIN_WORDS = 200
SYMBOLS = b"#$%&*|"
CAPITALS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
TRIE_BYTES = 32 << 20  # of texts that one trie of the scan holds
PARTITION_CHARS = 16 << 20  # of texts that one range partition gets, about
BATCH_BYTES = 4 << 20
HEAVY = 128
LEVELS = (16, 256, 4096)  # prefix lengths in characters, then the whole text


class RadixTrie:
    """Compressed trie of texts (bytes); a terminal holds what ``insert`` last put there."""

    def __init__(self):
        self.root: list = [b"", {}, None]  # label, children by first byte, terminal

    def insert(self, text: bytes) -> list:
        """The terminal node of ``text``, made if it was not there."""
        node, at = self.root, 0
        while at < len(text):
            child = node[1].get(text[at])
            if child is None:
                node[1][text[at]] = child = [text[at:], {}, None]
                return child
            label = child[0]
            if not text.startswith(label, at):
                common = _common(label, text, at)
                upper = [label[:common], {label[common]: child}, None]
                child[0] = label[common:]
                node[1][text[at]] = child = upper
            node, at = child, at + len(child[0])
        return node

    def terminals(self) -> Iterator[tuple[bytes, object]]:
        """Every text with what its terminal holds."""
        stack = [(self.root, b"")]
        while stack:
            node, above = stack.pop()
            text = above + node[0]
            if node[2] is not None:
                yield text, node[2]
            stack += [(child, text) for child in node[1].values()]


def _common(label: bytes, text: bytes, at: int) -> int:
    """Length of the common prefix of ``label`` and ``text[at:]``, by halving."""
    low, high = 0, min(len(label), len(text) - at)
    while low < high:
        mid = (low + high + 1) // 2
        if label[low:mid] == text[at + low:at + mid]:
            low = mid
        else:
            high = mid - 1
    return low


def _flags(text: str, raw: bytes) -> int:
    """Mask of the failed filters A to D (bits 0 to 3)."""
    words = raw.split()
    capitals = len(raw) - len(raw.translate(None, CAPITALS))
    symbols = len(raw) != len(raw.translate(None, SYMBOLS))
    return ((len(words) < MIN_WORDS) | (100 * len(set(words)) < 50 * len(words)) << 1
            | (100 * capitals > 2 * len(text)) << 2 | symbols << 3)


_ROW = "doc long, part string, mask int, ref long, least long, text string"
_ROW_SCHEMA = pa.schema([("doc", pa.int64()), ("part", pa.string()), ("mask", pa.int32()), ("ref", pa.int64()), ("least", pa.int64()), ("text", pa.string())])


def _scan(most: int):
    """A row per document (its mask and the reference of its text), and a row per
    terminal of each finished trie (reference, smallest id, text)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        refs = itertools.count(TaskContext.get().partitionId() << 36)
        trie, held = RadixTrie(), 0
        for batch in sliced(batches):
            rows: list[tuple] = []
            for doc, part, text in zip(*(c.to_pylist() for c in batch.columns)):
                text = text or ""
                raw = text.encode("utf-8", "surrogatepass")
                node = trie.insert(raw)
                if node[2] is None:
                    node[2], held = [next(refs), None], held + len(raw) + 200
                node[2][1] = _smaller(node[2][1], doc)
                rows.append((doc, part, _flags(text, raw), node[2][0], None, None))
            yield _rows(rows)
            if held > most:
                yield from _terminal_rows(trie)
                trie, held = RadixTrie(), 0
        yield from _terminal_rows(trie)
    return run


def _smaller(a: int | None, b: int | None) -> int | None:
    return b if a is None else a if b is None else min(a, b)


def _terminal_rows(trie: RadixTrie) -> Iterator[pa.RecordBatch]:
    rows, size = [], 0
    for text, (ref, least) in trie.terminals():
        rows.append((None, None, None, ref, least, text.decode("utf-8", "surrogatepass")))
        size += len(text) + 100
        if size > BATCH_BYTES:
            yield _rows(rows)
            rows, size = [], 0
    yield _rows(rows)


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    columns = [*zip(*rows)] or [()] * len(_ROW_SCHEMA)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _ROW_SCHEMA)], schema=_ROW_SCHEMA)


def _least_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The smallest id at the terminal of each reference's text, over one range partition."""
    trie, nodes = RadixTrie(), []
    for batch in sliced(batches):
        for ref, least, text in zip(*(c.to_pylist() for c in batch.columns)):
            node = trie.insert(text.encode("utf-8", "surrogatepass"))
            node[2] = _smaller(node[2], least)
            nodes.append((ref, node))
    for at in range(0, len(nodes), 10_000):
        part = nodes[at:at + 10_000]
        yield pa.RecordBatch.from_arrays([pa.array([r for r, _ in part], pa.int64()), pa.array([n[2] for _, n in part], pa.int64())], ["ref", "first"])


def adaptive_prefix(texts: DataFrame, heavy: int = HEAVY, levels: tuple[int, ...] = LEVELS):
    """Column: the shortest listed prefix of ``text`` that holds at most 1 / heavy of all
    characters; the whole text if none does."""
    size = F.sum(F.length("text") + F.lit(1))
    total = int(texts.agg(size.alias("n")).first()["n"] or 0)
    key, full = F.substring("text", 1, levels[0]), F.lit(False)
    for k, length in enumerate(levels):
        cells = texts.where(~full) if k == 0 else texts.where(full)
        found = [r["p"] for r in cells.groupBy(F.substring("text", 1, length).alias("p")).agg(size.alias("n")).where(
            F.col("n") * F.lit(heavy) > F.lit(total)).select("p").collect()]  # at most `heavy` of them
        if not found:
            break
        full = F.substring("text", 1, length).isin(found)
        key = F.when(full, F.substring("text", 1, levels[k + 1]) if k + 1 < len(levels) else F.col("text")).otherwise(key)
    return key


def filter_masks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source", trie_bytes: int = TRIE_BYTES,
                 partition_chars: int = PARTITION_CHARS, heavy: int = HEAVY, levels: tuple[int, ...] = LEVELS) -> DataFrame:
    """doc_id, part, mask of every document: bit i is set if filter i of A to E fails."""
    rows = staged(docs.select(F.col(id_col).cast("long").alias("doc"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"),
                              F.col(text_col).cast("string").alias("text")).mapInArrow(_scan(trie_bytes), _ROW), "documents")
    texts = rows.where("text IS NOT NULL").select("ref", "least", "text")
    size = int(texts.agg(F.sum(F.length("text") + F.lit(100)).alias("n")).first()["n"] or 0)
    keyed = texts.withColumn("prefix", adaptive_prefix(texts, heavy, levels))
    firsts = staged(keyed.repartitionByRange(size // partition_chars + 1, "prefix").select("ref", "least", "text").mapInArrow(
        _least_ids, "ref long, first long"), "firsts")
    flagged = rows.where("part IS NOT NULL").select("doc", "part", "mask", "ref").join(firsts, "ref")
    out = staged(flagged.select(F.col("doc").alias("doc_id"), "part", (
        F.col("mask") + F.when(F.col("doc") > F.col("first"), F.lit(1 << FILTERS.index("E"))).otherwise(F.lit(0))).alias("mask")), "masks")
    release(rows, firsts)
    return out


def audit(masks: DataFrame, labels: DataFrame, filters: str = FILTERS) -> DataFrame:
    """Per part, order of the filters and step: kept, removed, redundant, unique_fails,
    good_lost, toxic_lost and shapley."""
    spark, n = masks.sparkSession, len(filters)
    marks = labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(
        F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("bad"))
    counts = masks.join(marks, "doc_id", "left").groupBy("part", "mask").agg(
        F.count(F.lit(1)).alias("docs"), F.sum(F.coalesce("good", F.lit(0))).alias("good"), F.sum(F.coalesce("bad", F.lit(0))).alias("bad"))
    # a step's numbers depend on the filters before it and on its own, not on their order
    steps = [(sum(1 << b for b in before), 1 << own) for own in range(n) for k in range(n) for before in itertools.combinations(
        [b for b in range(n) if b != own], k)]
    cells = counts.select("*", F.explode(F.array(*[F.struct(F.lit(b).alias("before"), F.lit(o).alias("own")) for b, o in steps])).alias("s")).select(
        "part", "mask", "docs", "good", "bad", "s.before", "s.own")
    fails, gone = F.col("mask").bitwiseAND(F.col("own")) != 0, F.col("mask").bitwiseAND(F.col("before")) != 0
    total = lambda name, holds: F.sum(F.when(holds, F.col(name)).otherwise(0))
    numbers = cells.groupBy("part", "before", "own").agg(
        total("docs", ~fails & ~gone).alias("kept"), total("docs", fails & ~gone).alias("removed"), total("docs", fails & gone).alias("redundant"),
        total("docs", F.col("mask") == F.col("own")).alias("unique_fails"),
        total("good", fails & ~gone).alias("good_lost"), total("bad", fails & ~gone).alias("toxic_lost"))
    orders = [("".join(filters[b] for b in order), k + 1, sum(1 << b for b in order[:k]), 1 << own)
              for order in itertools.permutations(range(n)) for k, own in enumerate(order)]
    listed = spark.createDataFrame(orders, "filter_order string, step int, before int, own int")  # n * n! rows
    rows = numbers.join(F.broadcast(listed), ["before", "own"])
    return rows.select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost",
                       F.sum("removed").over(Window.partitionBy("part", "own")).alias("shapley"))


def _oracle() -> str:
    fails = {"A": f"len(w) < {MIN_WORDS}", "B": "100 * len(list_distinct(w)) < 50 * len(w)",
             "C": "100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t)",
             "D": f"regexp_matches(t, '[{SYMBOLS.decode()}]')", "E": "doc_id > min(doc_id) OVER (PARTITION BY t)"}
    orders = [("".join(o), k + 1, sum(1 << FILTERS.index(c) for c in o[:k]), 1 << FILTERS.index(own))
              for o in itertools.permutations(FILTERS) for k, own in enumerate(o)]
    mask = " + ".join(f"CASE WHEN {fails[c]} THEN {1 << k} ELSE 0 END" for k, c in enumerate(FILTERS))
    return f"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t,
                  regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
m AS (SELECT doc_id, part, {mask} AS mask FROM d),
l AS (SELECT doc_id, max(CAST(quality = 1 AS INTEGER)) AS good, max(CAST(toxic = 1 AS INTEGER)) AS bad FROM labels GROUP BY doc_id),
c AS (SELECT part, mask, count(*) AS docs, sum(coalesce(good, 0)) AS good, sum(coalesce(bad, 0)) AS bad
      FROM m LEFT JOIN l ON l.doc_id = m.doc_id GROUP BY part, mask),
o(filter_order, step, before, own) AS (VALUES {", ".join(map(str, orders))}),
r AS (SELECT part, filter_order, step, own,
             sum(CASE WHEN mask & own = 0 AND mask & before = 0 THEN docs ELSE 0 END) AS kept,
             sum(CASE WHEN mask & own <> 0 AND mask & before = 0 THEN docs ELSE 0 END) AS removed,
             sum(CASE WHEN mask & own <> 0 AND mask & before <> 0 THEN docs ELSE 0 END) AS redundant,
             sum(CASE WHEN mask = own THEN docs ELSE 0 END) AS unique_fails,
             sum(CASE WHEN mask & own <> 0 AND mask & before = 0 THEN good ELSE 0 END) AS good_lost,
             sum(CASE WHEN mask & own <> 0 AND mask & before = 0 THEN bad ELSE 0 END) AS toxic_lost
      FROM c CROSS JOIN o GROUP BY part, filter_order, step, own)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed,
       CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost,
       CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley
FROM r"""


ORACLE = _oracle()
