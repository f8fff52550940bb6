"""Class imbalance: target evidence (B1-B2), class weights (B3), the feature
matrix for resampling (B4), SMOTE (B5) and random undersampling (B6-B9).

Random draws cannot equal NumPy's, so resampling keeps the counts and the
geometric invariants and is repeatable for a seed: every draw is a hash of
(seed, row key), never ``rand()`` over partitions that can change.

Scale notes
* Class tables are DataFrames of one row per class, joined where a class's size
  matters (broadcast when few), so the number of classes is not limited.
* Undersampling keeps, per class, the rows with the smallest hash. The rank of
  a row inside its class comes from a range-partitioned sort (``ordered_index``),
  so a class holding a third of all rows is spread over many tasks.
* SMOTE touches only the classes it grows. Its neighbours are the true ones
  (``neighbours.exact_neighbours``). Where distances do not tell rows apart, that
  can mean most pairs of a class; ``exact=False`` bounds the work: a row's
  neighbours are then the k nearest of its candidates, the same-class rows in its
  own and the two adjacent blocks of ``BLOCK`` rows along each of ``PROJECTIONS``
  fixed random directions, at most ``3 * BLOCK * PROJECTIONS`` pairs a row whatever the
  number of rows or dimensions (exact whenever the class has at most two blocks).
  Synthetic rows are produced from the class table, one row per draw, and joined
  to their base row and neighbour.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from frameprep.functions.coerce import categorical_columns, nan_to_null, normalise_value
from frameprep.functions.indexing import ordered_index
from frameprep.functions.names import free_names
from frameprep.functions.report import frame, pct, round_half_away
from frameprep.functions.stats import order_exact, order_number
from frameprep.functions.written import written
from frameprep.operators.neighbours import exact_neighbours
from frameprep.operators.profile import is_missing

# --- fixed values -----------------------------------------------------------
IMBALANCE_ACTIONS = ("No Action", "Class Weights", "SMOTE", "Random Undersampling")
CLASSIFICATION_MAX_CLASSES = 10
SEED = 42
SMOTE_NEIGHBOURS = 5
# ---------------------------------------------------------------------------
PROJECTIONS, BLOCK = 3, 32  # SMOTE: directions searched, rows per block along one
DRAWS_PER_TASK = 100_000
TINY_CLASS = 10_000  # a class up to this size may carry very many draws: its rows are broadcast
BROADCAST_MAX_CLASSES = 200_000
BROADCAST_MAX_ROWS = 2_000_000
BROADCAST_MAX_BYTES = 64 * 1024 * 1024

TARGET_DDL = (
    "target_column STRING, problem_type STRING, class_count BIGINT, majority_class STRING, majority_count BIGINT, "
    "minority_class STRING, minority_count BIGINT, imbalance_ratio DOUBLE, minority_percentage DOUBLE"
)


def _class_table(df: DataFrame, target: str) -> DataFrame:
    """(class text, typed number for ordering, count) for the non-missing target."""
    dt = df.schema[target].dataType
    v = normalise_value(F.col(target), dt)
    return (
        df.where(~is_missing(df, target))
        .groupBy(v.alias("class"))
        .agg(F.first(order_number(target, dt)).alias("num"), F.first(order_exact(target, dt)).alias("exact"),
             F.count(F.lit(1)).alias("count"))
    )


def _few(table: DataFrame) -> DataFrame:
    """A class table, marked for broadcast when it has few enough rows."""
    return F.broadcast(table) if table.count() <= BROADCAST_MAX_CLASSES else table


def _problem_type(df: DataFrame, target: str, distinct: int) -> str:
    dt = df.schema[target].dataType
    if isinstance(dt, (T.StringType, T.BooleanType)) or target in categorical_columns(df):
        return "Classification"
    return "Classification" if distinct <= CLASSIFICATION_MAX_CLASSES else "Regression"


def target_facts(df: DataFrame, target: str | None) -> dict:
    """B1 as a dict. Majority / minority are the first / last class in
    (count desc, value asc) order. One aggregate over the class table."""
    empty = {"target_column": target, "problem_type": "Unknown", "class_count": 0, "majority_count": 0, "minority_count": 0}
    if target is None:
        return empty
    if target not in df.columns:
        raise ValueError(f"Target column '{target}' does not exist.")
    order = F.struct((-F.col("count")).alias("nc"), "num", "exact", "class")
    r = _class_table(df, target).agg(
        F.count(F.lit(1)).alias("k"), F.sum("count").alias("n"), F.min(order).alias("maj"), F.max(order).alias("mino")
    ).first()
    if not r["k"]:
        return empty
    k, n = int(r["k"]), int(r["n"])
    ptype = _problem_type(df, target, k)
    if ptype == "Regression":
        return {"target_column": target, "problem_type": ptype, "class_count": k, "majority_count": 0,
                "minority_count": 0, "non_missing": n}
    maj, mino = -int(r["maj"]["nc"]), -int(r["mino"]["nc"])
    return {
        "target_column": target, "problem_type": ptype, "class_count": k,
        "majority_class": r["maj"]["class"], "majority_count": maj,
        "minority_class": r["mino"]["class"], "minority_count": mino,
        "imbalance_ratio": round_half_away(maj / mino, 2) if mino else None,
        "minority_percentage": round_half_away(pct(mino, n), 2), "non_missing": n,
    }


def analyze_target_distribution(df: DataFrame, target: str | None) -> DataFrame:
    return frame(df.sparkSession, [target_facts(df, target)], TARGET_DDL)


def class_distribution(df: DataFrame, target: str) -> DataFrame:
    """B2: class, count, % of non-missing (2 dp). Stays a DataFrame: one row
    per class, never collected."""
    classes = written(_class_table(df, target), "classes")
    total = classes.agg(F.sum("count")).first()[0] or 0
    return classes.select(
        "class", "count",
        F.round(F.col("count") / F.lit(float(total)) * F.lit(100.0), 2).alias("percentage"),
    )


def class_weights(df: DataFrame, target: str) -> DataFrame:
    """weight = n / (k * count) per class ("balanced"); missing target left out."""
    classes = written(_class_table(df, target), "classes")
    row = classes.agg(F.count(F.lit(1)).alias("k"), F.sum("count").alias("n")).first()
    k, n = int(row["k"] or 0), int(row["n"] or 0)
    return classes.select("class", "count", (F.lit(float(n)) / (F.lit(float(k)) * F.col("count"))).alias("weight"))


def with_class_weight(df: DataFrame, target: str, weights: DataFrame, name: str = "class_weight") -> DataFrame:
    """Attach the weight of each row's class (usable as ``weightCol`` in Spark ML).
    The weight table has one row per class; its size is checked before broadcast."""
    dt = df.schema[target].dataType
    w = _few(weights.select(F.col("class").alias("__class"), F.col("weight").alias(name)))
    keyed = df.withColumn("__class", normalise_value(F.col(target), dt))
    return keyed.join(w, "__class", "left").drop("__class")


# --- feature matrix -------------------------------------------------------------


def feature_matrix(df: DataFrame, target: str) -> DataFrame:
    """Rows with a target; text columns dummy-coded (0/1, sorted categories,
    no column for missing) after the untouched columns; other gaps filled with 0;
    the target last."""
    if target not in df.columns:
        raise ValueError(f"There is no column '{target}' to use as target")
    work = df.where(~is_missing(df, target))
    text = [f.name for f in df.schema.fields
            if f.name != target and (isinstance(f.dataType, T.StringType) or (f.metadata or {}).get("role") == "categorical")]
    plain = [c for c in df.columns if c != target and c not in text]
    cats = {}
    if text:
        items = [F.struct(F.lit(c).alias("c"), F.col(c).cast("string").alias("v")) for c in text]
        distinct = (work.select(F.explode(F.array(*items)).alias("s")).select("s.c", "s.v")
                    .where(F.col("v").isNotNull()).distinct())
        for r in distinct.collect():  # one column per category follows: the list is as long as the result is wide
            cats.setdefault(r["c"], []).append(r["v"])
    exprs = []
    for c in plain:
        dt = df.schema[c].dataType
        if isinstance(dt, (T.NumericType, T.BooleanType)):
            col = F.col(c)
            if isinstance(dt, (T.FloatType, T.DoubleType)):
                col = nan_to_null(col)
            exprs.append(F.coalesce(col, F.lit(0).cast(dt)).alias(c))
        else:
            exprs.append(F.col(c))
    dummies = [(c, v) for c in text for v in sorted(cats.get(c, []))]
    for name, (c, v) in zip(free_names([f"{c}_{v}" for c, v in dummies], [*plain, target]), dummies):
        exprs.append(F.coalesce((F.col(c).cast("string") == F.lit(v)).cast("double"), F.lit(0.0)).alias(name))
    exprs.append(F.col(target))
    return work.select(*exprs)


# --- hashing helpers --------------------------------------------------------------


def _uniform(seed: int, salt: int, *keys: Column) -> Column:
    """Repeatable uniform draw in [0, 1) from a hash of (seed, salt, keys)."""
    h = F.xxhash64(F.lit(seed), F.lit(salt), *keys)
    return F.shiftrightunsigned(h, 11).cast("double") / F.lit(float(2 ** 53))


def _ranked_by_class(df: DataFrame, order_cols: list[str]) -> DataFrame:
    """Rows with ``__rank``: the 0-based position inside the class ``__cls`` in
    ``order_cols`` order, from one distributed sort."""
    idx = ordered_index(df, ["__cls", *order_cols], "__pos")
    starts = _few(idx.groupBy("__cls").agg(F.min("__pos").alias("__start")))
    return idx.join(starts, "__cls").withColumn("__rank", F.col("__pos") - F.col("__start")).drop("__pos", "__start")


def random_undersample(df: DataFrame, target: str, seed: int = SEED) -> DataFrame:
    """Every class cut to the size of the smallest, without replacement.

    Exact sizes: a class keeps its rows with the smallest draw ``u`` (a hash of
    the seed and the row). Only rows below a per-class threshold a little above
    ``keep / n_class`` are sorted, so the sort handles about ``keep`` rows per
    class instead of the whole table; a threshold that catches too few rows is
    raised and the step repeated, so the cut is always exact.
    """
    fm = feature_matrix(df, target)
    cols = fm.columns
    keyed = fm.withColumn("__cls", normalise_value(F.col(target), fm.schema[target].dataType)).withColumn(
        "__u", _uniform(seed, 4, *[F.col(c) for c in cols])).withColumn("__t", F.monotonically_increasing_id())
    classes = written(keyed.groupBy("__cls").agg(F.count(F.lit(1)).alias("__n")), "classes")
    keep = classes.agg(F.min("__n")).first()[0]
    if keep is None:
        return fm
    slack = 1.1
    while True:
        limit = F.when(F.col("__n") == keep, F.lit(1.0)).otherwise((F.lit(slack * keep) + 64.0) / F.col("__n"))
        cand = keyed.join(_few(classes), "__cls").where(F.col("__u") <= limit).drop("__n")
        got = cand.groupBy("__cls").agg(F.count(F.lit(1)).alias("__got"))
        short = classes.join(got, "__cls", "left").where(F.coalesce("__got", F.lit(0)) < keep)
        if short.isEmpty():
            break
        slack *= 2
    return _ranked_by_class(cand, ["__u", "__t"]).where(F.col("__rank") < keep).select(*cols)


# --- SMOTE ----------------------------------------------------------------------


def _directions(d: int, seed: int) -> list[list[float]]:
    """Fixed unit directions; one is enough for a single feature."""
    rng = np.random.default_rng(seed)
    u = rng.normal(size=(min(PROJECTIONS, d), d))
    return [[float(x) for x in row / np.linalg.norm(row)] for row in u]


def _dot(vec: Column, weights: list[float]) -> Column:
    products = F.zip_with(vec, F.array(*[F.lit(w) for w in weights]), lambda a, b: a * b)
    return F.aggregate(products, F.lit(0.0), lambda a, b: a + b)


def _sq_dist(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)


def candidate_pairs(points: DataFrame, d: int, seed: int = SEED, block: int = BLOCK) -> DataFrame:
    """(__cls, __id, __vec, __j, __vj): every row with the rows of its own and the
    adjacent blocks along each direction. ``points``: __cls, __id, __vec."""
    dirs = _directions(d, seed)
    along = F.explode(F.array(*[
        F.struct(F.lit(q).alias("q"), _dot(F.col("__vec"), u).alias("p")) for q, u in enumerate(dirs)]))
    spread = points.select("__cls", "__id", "__vec", along.alias("s")).select("__cls", "__id", "__vec", "s.q", "s.p")
    # the row id makes every sort key unique, so a block of copies is split over many tasks
    placed = ordered_index(spread, ["q", "__cls", "p", "__id"], "__pos")
    starts = _few(placed.groupBy("q", "__cls").agg(F.min("__pos").alias("__start")))
    blocks = placed.join(starts, ["q", "__cls"]).select(
        "q", "__cls", "__id", "__vec", F.floor((F.col("__pos") - F.col("__start")) / block).alias("b"))
    near = blocks.select("q", "__cls", F.col("__id").alias("__j"), F.col("__vec").alias("__vj"),
                         F.explode(F.array(F.col("b") - 1, F.col("b"), F.col("b") + 1)).alias("b"))
    return blocks.join(near, ["q", "__cls", "b"]).where(F.col("__id") != F.col("__j")).drop("q", "b")


def nearest_neighbours(points: DataFrame, k: int, d: int, seed: int = SEED, block: int = BLOCK) -> DataFrame:
    """(__cls, __id, __nbrs): the k nearest candidates of every row (see the neighbour
    contract above). The candidates of a row are bounded, so its list is too."""
    pairs = candidate_pairs(points, d, seed, max(block, k + 1)).withColumn("__d2", _sq_dist(F.col("__vec"), F.col("__vj")))
    best = F.slice(F.array_sort(F.collect_set(F.struct("__d2", "__j"))), 1, k)
    return pairs.groupBy("__cls", "__id").agg(F.transform(best, lambda t: t.getField("__j")).alias("__nbrs"))


def smote(df: DataFrame, target: str, seed: int = SEED, k: int = SMOTE_NEIGHBOURS, exact: bool = True) -> DataFrame:
    """Grow every class but the largest to the largest class's size with
    points on segments between a row and one of its k nearest neighbours; with
    ``exact=False`` one of the nearest of a bounded number of candidates."""
    fm = feature_matrix(df, target)
    feats = [c for c in fm.columns if c != target]
    for c in feats:
        if not isinstance(fm.schema[c].dataType, (T.NumericType, T.BooleanType)):
            raise ValueError(f"SMOTE needs numeric features; '{c}' is {fm.schema[c].dataType.simpleString()}")
    vec = F.array(*[F.col(c).cast("double") + F.lit(0.0) for c in feats]) if feats else F.array().cast("array<double>")
    keyed = fm.select(normalise_value(F.col(target), fm.schema[target].dataType).alias("__cls"), vec.alias("__vec"))
    endless = F.exists("__vec", lambda x: F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    classes = written(keyed.groupBy("__cls").agg(F.count(F.lit(1)).alias("__n"), F.count_if(endless).alias("__bad")), "classes")
    n_max = classes.agg(F.max("__n")).first()[0]
    growing = classes.where(F.col("__n") < F.lit(n_max)) if n_max else None
    if growing is None or growing.isEmpty():
        return fm
    few = growing.where((F.col("__n") <= k) | (F.col("__bad") > 0)).limit(10).collect()
    if any(r["__n"] <= k for r in few):
        raise ValueError(f"SMOTE needs more than {k} rows in every class it grows; too small: "
                         f"{sorted(r['__cls'] for r in few if r['__n'] <= k)}")
    if few:
        raise ValueError(f"SMOTE needs finite features; infinite in classes {sorted(r['__cls'] for r in few)}")
    # row ids of the growing classes: positions in an order of the values, the same for any partitioning
    grown = keyed.join(_few(growing.select("__cls")), "__cls").withColumn("__h", F.xxhash64(F.lit(seed), "__vec")).withColumn(
        "__t", F.monotonically_increasing_id())
    points = _ranked_by_class(grown, ["__h", "__vec", "__t"]).select("__cls", F.col("__rank").alias("__id"), "__vec")
    search = exact_neighbours if exact else nearest_neighbours
    nbrs = search(points, k, len(feats), seed).join(points, ["__cls", "__id"])

    chunk = F.explode(F.sequence(F.lit(0), F.floor((F.lit(n_max) - F.col("__n") - 1) / DRAWS_PER_TASK)))
    chunks = growing.select("__cls", "__n", chunk.alias("__chunk"))
    tasks = max(1, math.ceil(n_max * growing.count() / DRAWS_PER_TASK))
    first = F.col("__chunk") * DRAWS_PER_TASK
    last = F.least(first + DRAWS_PER_TASK, F.lit(n_max) - F.col("__n")) - 1
    draws = chunks.repartition(min(tasks, 100_000), "__cls", "__chunk").select("__cls", "__n", F.explode(F.sequence(first, last)).alias("__draw"))
    key = [F.col("__cls"), F.col("__draw")]
    draws = draws.select(
        "__cls", "__n", F.floor(_uniform(seed, 1, *key) * F.col("__n")).cast("long").alias("__id"),
        F.floor(_uniform(seed, 2, *key) * F.lit(k)).cast("int").alias("__slot"), _uniform(seed, 3, *key).alias("__lam"))
    synth = _with_vectors(draws, nbrs, points, growing, len(feats), k)
    tdt = fm.schema[target].dataType
    cls_value = F.col("__cls").cast(tdt) if not isinstance(tdt, T.StringType) else F.col("__cls")
    synth_rows = synth.select(
        *[F.element_at("__new", i + 1).cast(fm.schema[c].dataType).alias(c) for i, c in enumerate(feats)],
        cls_value.alias(target),
    )
    return fm.unionByName(synth_rows)


def _with_vectors(draws: DataFrame, nbrs: DataFrame, points: DataFrame, growing: DataFrame, d: int, k: int) -> DataFrame:
    """Draws with the new point ``__new``. Rows of tiny classes carry very many draws
    each, so they are broadcast when all of them together are small; draws of the
    other classes spread over at least TINY_CLASS keys a class."""
    row_bytes = 48 + 8 * d + 8 * k
    fits = lambda rows: rows <= BROADCAST_MAX_ROWS and rows * row_bytes <= BROADCAST_MAX_BYTES
    total = growing.agg(F.sum("__n").alias("all"), F.sum(F.when(F.col("__n") <= TINY_CLASS, F.col("__n"))).alias("tiny")).first()
    is_tiny = F.col("__n") <= TINY_CLASS
    if fits(total["all"]):
        parts = [(draws, True)]
    elif total["tiny"] and fits(total["tiny"]):
        parts = [(draws.where(is_tiny), True), (draws.where(~is_tiny), False)]
    else:
        parts = [(draws, False)]
    out = None
    for part, small in parts:
        names = growing.where(is_tiny).select("__cls") if small and len(parts) > 1 else None
        own = nbrs if names is None else nbrs.join(_few(names), "__cls", "left_semi")
        other = (points if names is None else points.join(_few(names), "__cls", "left_semi")).select(
            "__cls", F.col("__id").alias("__j"), F.col("__vec").alias("__vj"))
        if small:
            own, other = F.broadcast(own), F.broadcast(other)
        made = part.join(own, ["__cls", "__id"]).withColumn("__j", F.element_at("__nbrs", F.col("__slot") + 1)).join(
            other, ["__cls", "__j"]).select("__cls", F.zip_with(
                "__vec", "__vj", lambda a, b: a + F.col("__lam") * (b - a)).alias("__new"))
        out = made if out is None else out.unionByName(made)
    return out


def check_action(problem_type: str, action: str) -> None:
    """B8 and the closed set: anything but No Action needs a classification target."""
    if action not in IMBALANCE_ACTIONS:
        raise ValueError(f"Unknown imbalance action: {action}")
    if action != "No Action" and problem_type != "Classification":
        raise ValueError(f"{action} is only for classification targets (this one is {problem_type})")


def apply_imbalance_action(df: DataFrame, target: str, action: str, seed: int = SEED):
    """Returns (frame, class-weight table or None)."""
    if action == "No Action":
        return df, None
    facts = target_facts(df, target)
    check_action(facts["problem_type"], action)
    if action == "Class Weights":
        return df, class_weights(df, target)
    if action == "SMOTE":
        return smote(df, target, seed), None
    return random_undersample(df, target, seed), None


def shape(df: DataFrame) -> DataFrame:
    """Rows and columns."""
    return frame(df.sparkSession, [{"rows": df.count(), "columns": len(df.columns)}], "rows BIGINT, columns BIGINT")


__all__ = [
    "analyze_target_distribution", "class_distribution", "class_weights", "with_class_weight", "feature_matrix",
    "random_undersample", "smote", "candidate_pairs", "nearest_neighbours", "apply_imbalance_action", "check_action", "shape",
    "target_facts",
]
