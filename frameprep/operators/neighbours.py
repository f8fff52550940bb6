"""Exact k nearest neighbours inside classes: a self join over a two-level k-d tree.

Points of a class are dealt to regions of about ``REGION`` points by a k-d tree over a
small draw of them, and inside a region to rings of ``RING`` points (leaves of the
tree that the region's task grows over all of its points). Equal vectors are one point
with a count, so a vector that a third of all rows share costs as much as one row.

1. Upper bound: the k-th distance to the points of the own ring.
2. Which rings must a point meet? It goes to the regions that its bound reaches across
   the planes of the tree, and there meets the rings whose box is no farther than the bound.
3. A point is compared with the rings it must meet; pairs beyond the bound are dropped
   where they are made, the k best are kept under a group limit.

A box is never farther than a point in it, also in rounded numbers (differences, squares
and sums are taken in the same order), so the answer is the one of all pairs: ties go to
the smaller id. A point is tested against the rings of a few regions whatever the number
of rows, so the work grows with the rows in clustered or low-dimensional data; it is
all pairs where distances do not tell points apart; ``imbalance.nearest_neighbours``
bounds it instead.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from frameprep.functions.written import discard, written

REGION, RING = 8192, 64  # points of a region (one task's group) and of a ring
REGIONS = 4096  # of a class at most: the driver holds the planes between them
DRAWN = 16  # points of a region that steer the planes (not the result)
UNROLLED = 64  # dimensions up to which a distance is one compiled expression
_ENDLESS = float("inf")


def square_distance(a: Column, b: Column, d: int) -> Column:
    if d > UNROLLED:
        return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)
    total = F.lit(0.0)
    for j in range(d):
        gap = F.get(a, F.lit(j)) - F.get(b, F.lit(j))
        total = total + gap * gap
    return total


def _box_distance(a: Column, box: Column, d: int) -> Column:
    """Squared distance to a box (``lo``, ``hi``), summed like ``square_distance``."""
    gap = lambda x, lo, hi: F.greatest(lo - x, x - hi, F.lit(0.0))
    if d > UNROLLED:
        gaps = F.transform(F.arrays_zip(a.alias("x"), box["lo"].alias("lo"), box["hi"].alias("hi")), lambda t: gap(t["x"], t["lo"], t["hi"]))
        return F.aggregate(gaps, F.lit(0.0), lambda s, g: s + g * g)
    total = F.lit(0.0)
    for j in range(d):
        g = gap(F.get(a, F.lit(j)), F.get(box["lo"], F.lit(j)), F.get(box["hi"], F.lit(j)))
        total = total + g * g
    return total


def _matrix(column, d: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), d)


def _tree(x: np.ndarray, leaves: int, first: int = 0):
    """Planes (dimension, value, left, right) that halve the drawn points; a leaf is its number."""
    if leaves > 1 and len(x) > 1 and x.shape[1]:
        dim = int(np.argmax(x.max(axis=0) - x.min(axis=0)))
        values = np.sort(x[:, dim])
        if values[0] < values[-1]:
            cut = values[(len(values) - 1) // 2]
            if cut == values[-1]:
                cut = values[values < cut][-1]
            low, half = x[:, dim] <= cut, leaves // 2
            return dim, float(cut), _tree(x[low], half, first), _tree(x[~low], leaves - half, first + half)
    return first


def _reached(tree, x: np.ndarray, d2: np.ndarray, at: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(region, rows) that points with a bound reach; a bound below 0 reaches the own region only."""
    if not len(at):
        return
    if not isinstance(tree, tuple):
        yield tree, at
        return
    dim, cut, left, right = tree
    gap = x[at, dim] - cut
    across = gap * gap <= d2[at]
    yield from _reached(left, x, d2, at[(gap <= 0) | across])
    yield from _reached(right, x, d2, at[(gap > 0) | across])


def _planes(distinct: DataFrame, d: int, seed: int) -> dict:
    """The tree of every class that has more than one region, from a hash draw of its points."""
    sizes = distinct.groupBy("__cls").agg(F.count(F.lit(1)).alias("__u")).where(F.col("__u") > REGION)
    regions = F.least(F.lit(REGIONS), F.ceil(F.col("__u") / REGION)).cast("int").alias("__regions")
    wanted = sizes.select("__cls", "__u", regions)
    draw = F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.lit(9), "__vec"), 11).cast("double") / F.lit(float(2 ** 53))
    drawn = distinct.join(wanted, "__cls").where(draw * F.col("__u") < F.col("__regions") * DRAWN).select("__cls", "__regions", "__vec").toArrow()
    classes = np.array(drawn.column(0).to_pylist(), object)
    x, leaves = _matrix(drawn.column(2), d), drawn.column(1).to_numpy()
    return {c: _tree(x[classes == c], int(leaves[classes == c][0])) for c in set(classes)}


def _by_class(column) -> Iterator[tuple[str, np.ndarray]]:
    codes = column.dictionary_encode()
    at = codes.indices.to_numpy(zero_copy_only=False)
    for i, c in enumerate(codes.dictionary.to_pylist()):
        yield c, np.flatnonzero(at == i)


def _region(shared, d: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, cell = _matrix(batch.column("__vec"), d), np.zeros(batch.num_rows, np.int32)
            alone = np.full(batch.num_rows, -1.0)
            for c, rows in _by_class(batch.column("__cls")):
                for region, at in _reached(shared.value.get(c, 0), x, alone, rows):
                    cell[at] = region
            yield batch.append_column("__cell", pa.array(cell))
    return run


def _rings(x: np.ndarray, size: int) -> Iterator[np.ndarray]:
    """Rows of the leaves: halved along the widest dimension until they hold at most ``size``."""
    todo = [np.arange(len(x))]
    while todo:
        at = todo.pop()
        if len(at) <= size or not x.shape[1]:
            yield at
            continue
        part = x[at]
        half = len(at) // 2
        order = np.argpartition(part[:, int(np.argmax(part.max(axis=0) - part.min(axis=0)))], half)
        todo += [at[order[:half]], at[order[half:]]]


def _ring(k: int, d: int, size: int):
    def run(region: pa.Table) -> pa.Table:
        x = _matrix(region.column("__vec"), d)
        ring, d2, lo, hi = np.zeros(len(x), np.int32), np.full(len(x), _ENDLESS), [None] * len(x), [None] * len(x)
        for number, at in enumerate(_rings(x, size)):
            part = x[at]
            ring[at] = number
            lo[at[0]], hi[at[0]] = part.min(axis=0).tolist(), part.max(axis=0).tolist()  # the ring's box, on one of its rows
            if len(at) > k:
                total = np.zeros((len(at), len(at)))
                for j in range(d):
                    gap = part[:, None, j] - part[None, :, j]
                    total += gap * gap
                np.fill_diagonal(total, _ENDLESS)
                d2[at] = np.partition(total, k - 1, axis=1)[:, k - 1]
        numbers = pa.list_(pa.float64())
        return region.append_column("__ring", pa.array(ring)).append_column("__d2", pa.array(d2)).append_column(
            "__lo", pa.array(lo, numbers)).append_column("__hi", pa.array(hi, numbers))
    return run


def searched(points: DataFrame, k: int, d: int, seed: int, ring: int = RING) -> tuple[DataFrame, dict]:
    """Distinct points with region (``__cell``), ring and the bound ``__d2`` on the squared
    distance of their k-th neighbour, one row of a ring with its box; and the trees."""
    distinct = written(points.groupBy("__cls", "__vec").agg(F.min("__id").alias("__rep"), F.count(F.lit(1)).alias("__n")), "points")
    trees = _planes(distinct, d, seed)
    kinds = "__cls string, __vec array<double>, __rep bigint, __n bigint, __cell int"
    dealt = distinct.mapInArrow(_region(distinct.sparkSession.sparkContext.broadcast(trees), d), kinds)
    placed = written(dealt.groupBy("__cls", "__cell").applyInArrow(
        _ring(k, d, max(ring, 2 * k + 2)), f"{kinds}, __ring int, __d2 double, __lo array<double>, __hi array<double>"), "placed")
    discard(distinct)
    return placed, trees


def _visits(shared, d: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, d2 = _matrix(batch.column("__vec"), d), batch.column("__d2").to_numpy()
            for c, rows in _by_class(batch.column("__cls")):
                for region, at in _reached(shared.value.get(c, 0), x, d2, rows):
                    yield batch.take(pa.array(at)).append_column("__cell", pa.array(np.full(len(at), region, np.int32)))
    return run


def meetings(placed: DataFrame, trees: dict, k: int, d: int) -> DataFrame:
    """(__cls, __rep, __vec, __d2, __cell, __ring): the rings every point must meet. A point
    with more than k copies of its own meets none."""
    shared = placed.sparkSession.sparkContext.broadcast(trees)
    seekers = placed.where(F.col("__n") <= k).select("__cls", "__rep", "__vec", "__d2")
    visits = seekers.mapInArrow(_visits(shared, d), "__cls string, __rep bigint, __vec array<double>, __d2 double, __cell int")
    boxes = placed.where("__lo is not null").select("__cls", "__cell", "__ring", F.struct(F.col("__lo").alias("lo"), F.col("__hi").alias("hi")).alias("__box"))
    return visits.join(boxes, ["__cls", "__cell"]).where(_box_distance(F.col("__vec"), F.col("__box"), d) <= F.col("__d2")).drop("__box")


def exact_neighbours(points: DataFrame, k: int, d: int, seed: int = 42, ring: int = RING) -> DataFrame:
    """(__cls, __id, __nbrs): ids of the k nearest points of the same class, by distance and id.
    ``points``: __cls, __id, __vec (d finite numbers); equal vectors have consecutive ids."""
    placed, trees = searched(points, k, d, seed, ring)
    met = meetings(placed, trees, k, d)
    others = placed.select("__cls", "__cell", "__ring", F.col("__rep").alias("__j"), F.col("__n").alias("__m"), F.col("__vec").alias("__vj"))
    pairs = met.join(others, ["__cls", "__cell", "__ring"]).where("__rep <> __j").withColumn(
        "__e2", square_distance(F.col("__vec"), F.col("__vj"), d)).where("__e2 <= __d2").select("__cls", "__rep", "__e2", "__j", "__m")
    rank = F.row_number().over(Window.partitionBy("__cls", "__rep").orderBy("__e2", "__j"))
    best = pairs.withColumn("__rk", rank).where(F.col("__rk") <= k).groupBy("__cls", "__rep").agg(
        F.array_sort(F.collect_list(F.struct("__rk", "__j", "__m"))).alias("__best"))
    found = placed.select("__cls", "__rep", "__n", "__vec").join(best, ["__cls", "__rep"], "left")
    each = points.join(found, ["__cls", "__vec"])
    run = lambda first, n: F.sequence(first, first + F.least(n, F.lit(k + 1)) - 1)
    copies = F.filter(run(F.col("__rep"), F.col("__n")), lambda i: i != F.col("__id"))
    rest = F.flatten(F.transform(F.coalesce("__best", F.array().cast("array<struct<__rk:int,__j:bigint,__m:bigint>>")), lambda t: run(t["__j"], t["__m"])))
    return each.select("__cls", "__id", F.slice(F.concat(F.slice(copies, 1, k), rest), 1, k).alias("__nbrs"))
