"""Exact top-k by inner product with no-random-access aggregation.

Vectors become integers; a query's score is the sum of per-dimension scores
query[d] * candidate[d]. Candidates are cut into blocks; a block holds one sorted
list per dimension, read from the end that the query's sign favours. Reading all
lists to the same depth gives every candidate a lower bound (what was read, plus
the least each unread dimension can give) and an upper bound (what was read, plus
the frontier of each unread list). Candidates whose upper bound is under the k-th
lower bound are out; reading goes deeper for the others and stops when no
outsider can qualify. Scores of the candidates left are then resolved exactly.
The k best of each block are merged per query.

Queries and candidates meet in blocks of bounded size, so memory is bounded and
every block pair is a task of its own. Equal vectors share one candidate with
their smallest ids, so many that k rows stay without those of any one id; a vector
that a third of all rows share costs one.

Cases: null vectors and vectors with null or non-finite components take no part;
ties go to the smaller id; vectors of other lengths are padded with zeros; a row
that repeats a vec_id is a candidate and a query of its own, but no candidate of a
query with that id; fewer than k candidates give fewer ranks; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from frameprep.llm.common import staged

SCALE = 1024
CANDIDATE_BLOCK = 16_384
QUERY_BLOCK = 2_048
QUERIES_AT_ONCE = 64  # bounds kept at a time: candidates of a block times this
BLOCK_READS = 2  # depths to which all candidates are read; deeper ones read only those still in question
_EXACT = float(1 << 52)  # below this, float64 sums of integers are exact


def _packer(scale: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, vecs = [], []
            for i, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if i is None or v is None or any(x is None for x in v):
                    continue
                x = np.floor(scale * np.asarray(v, dtype=np.float64))
                if np.isfinite(x).all():
                    ids.append(i)
                    vecs.append(x.astype("<i8").tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(vecs, pa.binary())], ["vec_id", "vec"])
    return run


def _matrix(packed: list[bytes]) -> np.ndarray:
    width = max((len(b) for b in packed), default=0)
    return np.frombuffer(b"".join(b.ljust(width, b"\0") for b in packed), dtype="<i8").reshape(len(packed), width // 8)


class SortedLists:
    """One block of distinct candidate vectors with the rank of each value in its list."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, k: int):
        order = np.argsort(ids, kind="stable")
        ids, x = ids[order], np.ascontiguousarray(x[order])
        _, first, group = np.unique(x.view([("", x.dtype)] * x.shape[1]).reshape(-1) if x.shape[1] else np.zeros(len(x)),
                                    return_index=True, return_inverse=True)
        self.x = x[first].astype(float) if np.abs(x).max(initial=0) < _EXACT else x[first]
        by = np.argsort(group, kind="stable")
        starts = np.searchsorted(group[by], np.arange(len(first)))
        ends = np.append(starts[1:], len(by))
        self.ids = [_enough(ids[by[a:b]], k) for a, b in zip(starts, ends)]
        own, vectors = np.unique(np.concatenate([np.unique(i) for i in self.ids]) if len(first) else ids, return_counts=True)
        self.repeats = dict(zip(own[vectors > 1].tolist(), vectors[vectors > 1].tolist()))  # ids on several vectors
        up = np.argsort(self.x, axis=0, kind="stable")
        self.rank = np.empty(up.shape, np.int32)
        np.put_along_axis(self.rank, up, np.arange(len(up), dtype=np.int32)[:, None], axis=0)
        self.sorted = np.take_along_axis(self.x, up, axis=0)
        self.k, self.reads = k, {}

    def _read_to(self, depth: int, rows=slice(None)):
        """What reading every list ``depth`` deep tells, for lists read from the top and
        from the bottom: values read less the frontier, values read less the least (both
        0 where unread), the frontier, and the least."""
        n, x, rank = len(self.x), self.x[rows], self.rank[rows]
        out = []
        for seen, edge, least in ((rank >= n - depth, self.sorted[n - depth], self.sorted[0]),
                                  (rank < depth, self.sorted[depth - 1], self.sorted[-1])):
            out.append((np.where(seen, x - edge, 0), np.where(seen, x - least, 0), edge, least))
        return out

    def _bounds(self, read, up: np.ndarray, down: np.ndarray):
        """Lower and upper bounds (candidates x queries) of queries split by sign."""
        (ta, tl, te, tm), (ba, bl, be, bm) = read
        upper = ta @ up + ba @ down + (te @ up + be @ down)
        lower = tl @ up + bl @ down + (tm @ up + bm @ down)
        return lower, upper

    def best(self, query_ids: np.ndarray, queries: np.ndarray) -> list[list[tuple[int, int]]]:
        """(score, id) of the k best candidates of each query, other than rows of its own id."""
        # of the candidates, those of the query's own id do not count: one vector, or more if the id is repeated
        n, need = len(self.x), self.k + max((self.repeats.get(i, 1) for i in query_ids.tolist()), default=1)
        up, down = np.maximum(queries, 0).T, np.minimum(queries, 0).T
        depths, depth = [], (n + 1) // 2
        while n > need and depth < n:
            depths.append(depth)
            depth = n - (n - depth) // 4 if n - depth > 8 else n
        out = []
        for first in range(0, len(queries), QUERIES_AT_ONCE):
            part = slice(first, first + QUERIES_AT_ONCE)
            if not depths:
                left = [np.arange(n)] * len(queries[part])
            else:
                alive = None
                for at in depths[:BLOCK_READS]:
                    lower, upper = self._bounds(self._block_read(at), up[:, part], down[:, part])
                    lower, upper = np.ascontiguousarray(lower.T), np.ascontiguousarray(upper.T)
                    floor = np.partition(lower, n - need, axis=1)[:, n - need, None]
                    alive = upper >= floor if alive is None else alive & (upper >= floor)
                left = [np.flatnonzero(a) for a in alive]
            for j, alive in enumerate(left):
                k = first + j
                for deeper in depths[BLOCK_READS:]:
                    if len(alive) <= need:
                        break
                    lower, upper = self._bounds(self._read_to(deeper, alive), up[:, k], down[:, k])
                    floor = np.partition(lower, len(lower) - need)[len(lower) - need]
                    alive = alive[upper >= floor]
                out.append(self._resolved(int(query_ids[k]), queries[k], alive))
        return out

    def _block_read(self, depth: int):
        if depth not in self.reads:
            self.reads[depth] = self._read_to(depth)
        return self.reads[depth]

    def _resolved(self, query_id: int, q: np.ndarray, alive: np.ndarray) -> list[tuple[int, int]]:
        """Exact scores of the candidates that are left, ties to the smaller id."""
        score = self.x[alive] @ q
        out: list[tuple[int, int]] = []
        for j in np.argsort(-score, kind="stable"):
            s = int(score[j])
            if len(out) >= self.k and s < out[self.k - 1][0]:
                break
            out += [(s, int(i)) for i in self.ids[alive[j]] if i != query_id]
            out.sort(key=lambda p: (-p[0], p[1]))
            del out[self.k:]
        return out


def _enough(ids: np.ndarray, k: int) -> np.ndarray:
    """Of the sorted ids of one vector, the first that hold k rows besides those of any one id."""
    if len(ids) <= k + 1:
        return ids
    _, first, count = np.unique(ids, return_index=True, return_counts=True)
    nth = np.arange(len(ids)) - np.repeat(first, count)
    ids = ids[nth < k]  # more than k rows of one id add nothing
    _, count = np.unique(ids, return_counts=True)
    kept = np.cumsum(count)
    done = np.flatnonzero(kept - np.maximum.accumulate(count) >= k)
    return ids[:kept[done[0]]] if len(done) else ids


def _block_pair(k: int):
    def run(key, queries: pd.DataFrame, candidates: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple[int, int, int]] = []
        if len(queries) and len(candidates):
            qs, xs = _matrix([*queries["vec"]]), _matrix([*candidates["vec"]])
            width = max(qs.shape[1], xs.shape[1])
            qs, xs = (np.pad(m, ((0, 0), (0, width - m.shape[1]))) for m in (qs, xs))
            lists = SortedLists(candidates["vec_id"].to_numpy(), xs, k)
            whole = float(np.abs(qs).max(initial=0)) * float(np.abs(xs).max(initial=0)) * width >= _EXACT
            if whole:  # sums beyond exact floats: Python integers
                lists.x, lists.sorted, qs = (m.astype(int).astype(object) for m in (lists.x, lists.sorted, qs))
            ids = queries["vec_id"].to_numpy()
            for i, row, found in zip(ids, queries["qrow"], lists.best(ids, qs if whole else qs.astype(float))):
                out += [(int(row), int(i), c, s) for s, c in found]
        return pd.DataFrame(out, columns=["qrow", "query_id", "vec_id", "score"]).astype("int64")
    return run


def exact_top_k(vectors: DataFrame, is_query, k: int = 10, id_col: str = "vec_id", vec_col: str = "embedding",
                scale: int = SCALE, candidate_block: int = CANDIDATE_BLOCK, query_block: int = QUERY_BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score: the k best of every query row (``is_query``: Column over ``vec_id``)."""
    packed = staged(vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col)).mapInArrow(
        _packer(scale), "vec_id long, vec binary"), "vectors")
    # a number for each query row, fixed by writing it: rows that repeat an id are queries of their own
    queries = staged(packed.where(is_query).withColumn("qrow", F.monotonically_increasing_id()), "queries")
    blocks = max(1, -(-packed.count() // candidate_block))
    groups = max(1, -(-queries.count() // query_block))
    deal = lambda n, salt: F.pmod(F.xxhash64("vec_id", "vec", F.lit(salt)), F.lit(n)).cast("int")
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    # repeated rows must not land in one block twice as hot: rows are dealt by id, ids are dealt evenly
    left = queries.withColumn("qb", deal(groups, "q")).withColumn("cb", spread(blocks))
    right = packed.withColumn("cb", deal(blocks, "c")).withColumn("qb", spread(groups))
    best = left.groupBy("qb", "cb").cogroup(right.groupBy("qb", "cb")).applyInPandas(
        _block_pair(k), "qrow long, query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("qrow").orderBy(F.desc("score"), "vec_id"))
    return best.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


ORACLE = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
         CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM p)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 10"""
