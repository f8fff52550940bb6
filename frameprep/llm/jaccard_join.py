"""N-gram Jaccard join with a MinHash LSH forest.

Texts become sets of word shingles; equal sets are one node. Every node has
``TREES`` signatures of ``DEPTH`` minhashes; a tree of the forest is the trie of
one signature. Nodes that share a prefix meet in the trie. Matching starts at the
whole signature and shortens: at each level the nodes under one prefix are
collapsed to one representative, and only representatives go on to the next
shorter prefix. It stops at the longest prefix with which a pair at the threshold
meets in some tree with at least the target recall (0.999). Large groups of near
copies collapse at the first level, at one aggregate row per prefix.

Nodes that met (directly or through others) form a candidate cluster, found by
distributed union-find. Clusters are verified exactly: every pair of a cluster is
compared on whole shingle sets inside tasks of bounded size (small clusters are
packed into bins, large ones are cut into pairs of blocks, so no cluster needs
one task). A task passes on link counts and one edge per linked node, never
pairs. A second union-find over verified edges gives the classes.

Cases: a null text counts as empty; a text without words has no shingles and
joins nothing; a text of fewer words than a shingle has one, of all its words;
equal sets (so exact copies) are links with similarity 1; rows repeating a
doc_id are rows of their own; null ids stay null; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from frameprep.llm.common import sliced, staged, tasks_for, text_or_empty
from frameprep.llm.components import components
from frameprep.llm.licenses import words_of

WORDS = 5
THRESHOLD = 0.8
TREES, DEPTH = 20, 8
RECALL = 0.999
BIN_SHINGLES = 400_000  # shingles compared in one task

_rng = np.random.default_rng(20240229)
_MUL = (_rng.integers(1, 1 << 62, TREES * DEPTH, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)
_ADD = _rng.integers(0, 1 << 62, TREES * DEPTH, dtype=np.uint64)
_MIX = _rng.integers(1, 1 << 62, max(WORDS, DEPTH, 16), dtype=np.uint64) | np.uint64(1)


def _scramble(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Shingler:
    """Sorted distinct shingle hashes of a text; word hashes are remembered."""

    def __init__(self, width: int = WORDS):
        self.width, self.known = width, {}

    def __call__(self, text: str | None) -> np.ndarray:
        words, known = words_of(text), self.known
        if not words:
            return np.zeros(0, np.uint64)
        if len(known) > 1 << 18:
            known.clear()
        for w in set(words).difference(known):
            known[w] = xxhash.xxh64_intdigest(w)
        h = np.fromiter(map(known.__getitem__, words), dtype=np.uint64, count=len(words))
        n = max(1, len(words) - self.width + 1)
        out = np.zeros(n, np.uint64)
        for j in range(min(self.width, len(words))):
            out += h[j:j + n] * _MIX[j]
        return np.unique(_scramble(out))


def node_of(shingles: np.ndarray) -> bytes | None:
    """128-bit name of a shingle set; null for no shingles."""
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest() if len(shingles) else None


def shortest_prefix(threshold: float, trees: int = TREES, depth: int = DEPTH, recall: float = RECALL) -> int:
    """Longest prefix at which a pair at the threshold meets with the target recall."""
    for d in range(depth, 1, -1):
        if 1 - (1 - threshold ** d) ** trees >= recall:
            return d
    return 1


def matched_depths(threshold: float) -> list[int]:
    """Prefix lengths in the order they are matched: the whole signature, then
    shortened by halves of what is left, to the one with the target recall."""
    depths, last = [DEPTH], shortest_prefix(threshold)
    while depths[-1] > last:
        left = depths[-1] - last
        depths.append(last if left <= 3 else depths[-1] - left // 2)
    return depths


def prefixes(shingles: np.ndarray, depths: list[int]) -> np.ndarray:
    """(trees, depths) hashes of the signatures' prefixes of the given lengths."""
    low = np.full(TREES * DEPTH, np.iinfo(np.uint64).max, np.uint64)
    for a in range(0, len(shingles), 2048):
        part = shingles[a:a + 2048]
        np.minimum(low, ((part[None, :] ^ _ADD[:, None]) * _MUL[:, None]).min(axis=1), out=low)
    low = low.reshape(TREES, DEPTH)
    chain = _scramble(np.cumsum(_scramble(low) * _MIX[:DEPTH], axis=1, dtype=np.uint64))
    return chain[:, [d - 1 for d in depths]]


def _sketcher(depths: list[int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle = Shingler()
        for batch in sliced(batches):
            nodes, sizes, tries = [], [], []
            for text in batch.column(1).to_pylist():
                s = shingle(text)
                nodes.append(node_of(s))
                sizes.append(len(s))
                tries.append(prefixes(s, depths).view(np.int64).reshape(-1) if len(s) else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(nodes, pa.binary()), pa.array(sizes, pa.int64()),
                 pa.array(tries, pa.list_(pa.int64()))], ["doc_id", "tag", "node", "size", "trie"])
    return run


def _set_rows(bits):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle, wanted = Shingler(), bits.value
        for batch in sliced(batches):
            nodes, sets = [], []
            for text in batch.column(0).to_pylist():
                s = shingle(text)
                node = node_of(s)
                if node is None:
                    continue
                at = _bit_of(node, len(wanted) * 8)
                if wanted[at >> 3] >> (at & 7) & 1:
                    nodes.append(node)
                    sets.append(s.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.binary()), pa.array(sets, pa.binary())], ["node", "shingles"])
    return run


def _bit_of(node: bytes, bits: int) -> int:
    return int.from_bytes(node[:7], "big") % bits


def _candidate_bits(members: DataFrame, bits: int):
    """A bitmap of fixed size that holds every member (and some others): it only
    spares work, the exact join follows."""
    at = F.pmod(F.conv(F.hex(F.substring("node", 1, 7)), 16, 10).cast("long"), F.lit(bits))
    rows = members.select(at.alias("b")).select((F.col("b") + 1).alias("b")).groupBy(
        F.bitmap_bucket_number("b").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("b")).alias("map"))
    table = np.zeros(bits // 8, np.uint8)
    for r in rows.toLocalIterator():
        part = np.frombuffer(bytes(r["map"]), np.uint8)
        start = (r["bucket"] - 1) * 4096
        table[start:start + 4096] |= part[: len(table) - start]
    return members.sparkSession.sparkContext.broadcast(table)


def candidate_edges(nodes: DataFrame, levels: int) -> DataFrame:
    """Star edges (a, b) between nodes that share a prefix; nodes: id, trie (repeated rows do no harm)."""
    prefix = lambda level: F.get(F.col("trie"), F.col("tree") * levels + level)
    every = nodes.select("id", "trie", F.explode(F.sequence(F.lit(0), F.lit(TREES - 1))).alias("tree")).select(
        "id", "tree", *[prefix(k).alias(f"p{k}") for k in range(levels)])
    # only nodes that share even the shortest prefix with another node go on
    short = f"p{levels - 1}"
    met = every.groupBy("tree", short).agg(F.min("id").alias("low"), F.max("id").alias("high")).where("low <> high")
    open_ = staged(every.join(met.select("tree", short), ["tree", short], "left_semi").distinct(), "trie")
    tasks, found = tasks_for(open_.count()), []
    for k in range(levels):
        rest = [f"p{j}" for j in range(k + 1, levels)]
        grouped = staged(open_.groupBy("tree", f"p{k}").agg(
            F.min("id").alias("low"), F.max("id").alias("high"), *[F.first(c).alias(c) for c in rest]), "trie", tasks)
        stars = grouped.where("low <> high").select("tree", f"p{k}", "low")
        found.append(open_.join(stars, ["tree", f"p{k}"]).where("id <> low").select(F.col("low").alias("a"), F.col("id").alias("b")))
        open_ = grouped.select(F.col("low").alias("id"), "tree", *rest) if rest else open_
    edges = found[0]
    for more in found[1:]:
        edges = edges.union(more)
    return edges


def _verify(threshold: float):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["comp", "side"], kind="stable")
        sets = [np.frombuffer(b, np.uint64) for b in pdf["shingles"]]
        _, flat = np.unique(np.concatenate(sets), return_inverse=True)
        lens = np.array([len(s) for s in sets])
        starts = np.concatenate([[0], np.cumsum(lens)])
        comp, side, mult = pdf["comp"].to_numpy(), pdf["side"].to_numpy(), pdf["copies"].to_numpy()
        nodes = pdf["node"].to_numpy()
        two_sided = bool(pdf["two"].iloc[0])
        links, root = np.zeros(len(sets), np.int64), np.arange(len(sets))

        def find(i: int) -> int:
            while root[i] != i:
                root[i] = root[root[i]]
                i = root[i]
            return i

        mask = np.zeros(int(flat.max()) + 1, bool)
        bounds = np.flatnonzero(np.append(True, comp[1:] != comp[:-1])).tolist() + [len(sets)]
        for a, b in zip(bounds, bounds[1:]):
            ids = np.arange(a, b)
            right = int(np.searchsorted(side[a:b], 1)) + a if two_sided else 0
            for i in range(a, right if two_sided else b - 1):
                first = right if two_sided else i + 1
                others = ids[first - a:]
                if not len(others):
                    continue
                mine = flat[starts[i]:starts[i + 1]]
                mask[mine] = True
                shared = np.add.reduceat(mask[flat[starts[first]:starts[b]]].astype(np.int64), starts[first:b] - starts[first])
                mask[mine] = False
                close = others[shared >= threshold * (lens[i] + lens[others] - shared) - 1e-9]
                links[i] += mult[close].sum()
                links[close] += mult[i]
                for j in close:
                    x, y = find(i), find(int(j))
                    root[max(x, y)] = min(x, y)
        rows = np.flatnonzero(links)
        return pd.DataFrame({"node": nodes[rows], "links": links[rows], "other": [nodes[find(int(i))] for i in rows]})
    return run


def jaccard_join(docs: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, class_id (smallest doc_id of the class), class_size, n_links (other
    documents with similarity of at least ``threshold``) of every document."""
    classed = _classed(docs, threshold, id_col, text_col, F.lit(None).cast("string"))
    groups = classed.where("comp is not null").groupBy("comp").agg(
        F.min("doc_id").alias("class_id"), F.count(F.lit(1)).alias("class_size"))
    return classed.join(groups, "comp", "left").select(
        "doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("class_size", F.lit(1)).alias("class_size"), "n_links")


def _classed(docs: DataFrame, threshold: float, id_col: str, text_col: str, tag: Column) -> DataFrame:
    """doc_id, tag, comp (null: joins nothing) and n_links of every row of ``docs``, written."""
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"), tag.alias("tag"))
    depths = matched_depths(threshold)
    rows = staged(src.mapInArrow(_sketcher(depths), "doc_id long, tag string, node binary, size long, trie array<long>"), "sketch")
    tasks = tasks_for(rows.count())
    named = rows.where("node is not null")
    # candidates may meet under a short id: what they lead to is compared whole
    edges = candidate_edges(named.select(F.xxhash64("node").alias("id"), "trie"), len(depths))
    clusters = components(edges).withColumnRenamed("node", "id")
    sized = staged(named.groupBy("node").agg(F.count(F.lit(1)).alias("copies"), F.first("size").alias("size")), "nodes", tasks)
    members = staged(clusters.join(sized.withColumn("id", F.xxhash64("node")), "id").drop("id"), "members", tasks)
    found = staged(_verified(src, members, threshold), "verified")
    classes = components(found.select(F.col("node").alias("a"), F.col("other").alias("b")))
    linked = found.groupBy("node").agg(F.sum("links").alias("links"))
    per_node = sized.join(linked, "node", "left").join(classes, "node", "left").select(
        "node", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("comp", "node").alias("comp"))
    marked = rows.select("doc_id", "tag", F.col("node").alias("n")).join(per_node, F.col("n") == F.col("node"), "left")
    return staged(marked.select("doc_id", "tag", "comp", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links")), "classes", tasks)


def _verified(src: DataFrame, members: DataFrame, threshold: float) -> DataFrame:
    """(node, links, other) of every node with links, from exact comparisons inside clusters."""
    whole = members.agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("s")).first()
    n, size = whole["n"] or 0, whole["s"] or 0
    bits = 1 << min(28, max(15, (16 * n).bit_length()))
    sets = src.select("text").mapInArrow(_set_rows(_candidate_bits(members, bits)), "node binary, shingles binary")
    sets = sets.groupBy("node").agg(F.first("shingles").alias("shingles"))
    weight = staged(members.groupBy("comp").agg(F.sum("size").alias("total")), "weights", tasks_for(n))
    bins = max(1, size // BIN_SHINGLES + 1)
    parts = F.ceil(F.col("total") / F.lit(BIN_SHINGLES // 2)).cast("int")
    blocks = weight.where(F.col("total") > BIN_SHINGLES).agg(F.sum(parts * (parts + 1) / 2)).first()[0] or 0
    placed = members.join(weight, "comp").withColumn("parts", F.when(F.col("total") > BIN_SHINGLES, parts).otherwise(0))
    placed = placed.withColumn("own", F.when(F.col("parts") > 0, F.pmod(F.xxhash64("node"), F.col("parts"))).cast("int"))
    # a large cluster: pairs of its parts; a small one: whole, packed into a bin
    met = F.when(F.col("parts") > 0, F.sequence(F.lit(0), F.col("parts") - 1)).otherwise(F.array(F.lit(0)))
    dealt = placed.withColumn("with", F.explode(met)).select(
        "node", "comp", "copies",
        F.when(F.col("parts") > 0, F.hex("comp")).otherwise(F.lit("")).alias("cluster"),
        F.when(F.col("parts") > 0, F.least("own", "with")).otherwise(F.pmod(F.xxhash64("comp"), F.lit(bins)).cast("int")).alias("i"),
        F.when(F.col("parts") > 0, F.greatest("own", "with")).otherwise(F.lit(-1)).alias("j"),
        F.when((F.col("parts") > 0) & (F.col("own") > F.col("with")), 1).otherwise(0).alias("side"),
        ((F.col("parts") > 0) & (F.col("own") != F.col("with"))).alias("two"))
    return dealt.join(sets, "node").groupBy("cluster", "i", "j").applyInPandas(
        _verify(threshold), "node binary, links long, other binary").coalesce(bins + int(blocks))


def keep_one_per_class(docs: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of every class: that of the smallest id (null ids last, then the smallest
    digest of the row's text); columns unchanged. Rows are told apart by id and text, so a
    repeated id takes no row of another text with it; of rows repeated as they are, one
    stays. Texts without words are in no class and all stay."""
    key = F.sha2(F.concat(F.coalesce(F.col(id_col).cast("long").cast("string"), F.lit("")), F.lit(":"), text_or_empty(text_col)), 256)
    rows = _classed(docs, threshold, id_col, text_col, key).where("comp is not null")
    first = rows.groupBy("comp").agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "tag"))["tag"].alias("kept"), F.count(F.lit(1)).alias("n"))
    gone = rows.join(first.where("n > 1"), "comp").where("tag <> kept").select(F.col("tag").alias("key")).distinct()
    repeated = staged(rows.groupBy(F.col("tag").alias("key")).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key"), "repeated", 1)
    left = docs.select(F.struct("*").alias("doc"), key.alias("key")).join(gone, "key", "left_anti")
    if not repeated.isEmpty():
        again = left.join(repeated, "key", "left_semi").dropDuplicates(["key"])
        left = left.join(repeated, "key", "left_anti").unionByName(again)
    return left.select("doc.*")
