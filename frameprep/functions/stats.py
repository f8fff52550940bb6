"""Shared statistical passes.

* ``moments``          one aggregate for every column: count, mean, sample and
                       population std, skewness, min / max (finite and not).
* ``exact_quantiles``  exact order statistics in three passes: sketched brackets,
                       counts below and inside them, and the few values inside.
                       What the driver fetches is bounded over all columns.
* ``value_hashes``     (column, hash) -> count behind distinct and top counts: a
                       value's 128-bit hash is shuffled, never its text.
* ``value_keys``       the same with the head of each value, behind modes and top
                       lists (``top_values``); whole texts are fetched for winners only.
                       Both have a map-side combine, so a hot value costs nothing.
"""

from __future__ import annotations

import math
from collections import defaultdict

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from frameprep.functions.coerce import as_number, nan_to_null, normalise_value
from frameprep.functions.written import discard, written

APPROX_ACCURACY = 10_000
HIST_BUCKETS = 2048
HIST_ROWS_MAX = 262_144  # bucket rows one round may bring to the driver
HEAD = 48  # characters of a value that travel with its hash; holds every number, date and short name
FETCH_TOTAL = 1_000_000  # values all quantiles of a call may bring to the driver together


def corrected_skewness(g1: float | None, n: int) -> float | None:
    """Population skewness g1 -> bias-corrected G1 (what pandas and DuckDB give)."""
    if g1 is None or n < 3 or (isinstance(g1, float) and math.isnan(g1)):
        return None
    return g1 * math.sqrt(n * (n - 1)) / (n - 2)


def moments(df: DataFrame, cols: list[str]) -> dict[str, dict]:
    """One pass: per column count, mean, std (sample, population), skewness, extremes."""
    if not cols:
        return {}
    exprs = []
    for i, c in enumerate(cols):
        x = as_number(df, c)
        finite = F.when(~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))), x)
        exprs += [
            F.count(x).alias(f"n{i}"),
            F.avg(x).alias(f"mean{i}"),
            F.stddev_samp(x).alias(f"sd{i}"),
            F.stddev_pop(x).alias(f"sdp{i}"),
            F.skewness(x).alias(f"g{i}"),
            F.min(x).alias(f"min{i}"),
            F.max(x).alias(f"max{i}"),
            F.min(finite).alias(f"fmin{i}"),
            F.max(finite).alias(f"fmax{i}"),
            F.count_if(x == F.lit(float("-inf"))).alias(f"ninf{i}"),
            F.count_if(x == F.lit(float("inf"))).alias(f"pinf{i}"),
        ]
    row = df.agg(*exprs).first()
    out = {}
    for i, c in enumerate(cols):
        n = int(row[f"n{i}"])
        out[c] = {
            "n": n,
            "mean": row[f"mean{i}"],
            "std": row[f"sd{i}"],
            "std_pop": row[f"sdp{i}"],
            "g1": row[f"g{i}"],
            "skewness": corrected_skewness(row[f"g{i}"], n),
            "min": row[f"min{i}"],
            "max": row[f"max{i}"],
            "fmin": row[f"fmin{i}"],
            "fmax": row[f"fmax{i}"],
            "n_neg_inf": int(row[f"ninf{i}"]),
            "n_pos_inf": int(row[f"pinf{i}"]),
        }
    return out


def _ranks_for(n: int, probs: list[float]) -> dict[float, tuple[int, int, float]]:
    out = {}
    for p in probs:
        pos = p * (n - 1)
        j = int(math.floor(pos))
        out[p] = (j, min(j + 1, n - 1), pos - j)
    return out


def exact_quantiles(
    df: DataFrame,
    cols: list[str],
    probs: list[float],
    stats: dict[str, dict] | None = None,
    buckets: int = HIST_BUCKETS,
    fetch_limit: int = FETCH_TOTAL,
    approx: bool = False,
    accuracy: int = APPROX_ACCURACY,
) -> dict[str, list[float | None]]:
    """Exact quantiles with linear interpolation between order statistics
    (the rule of pandas ``quantile`` and DuckDB ``quantile_cont``).

    Three passes whatever the number of columns: sketches give a bracket around
    every wanted rank, one narrow aggregate counts the values below and inside
    each bracket, and the values inside are fetched (grouped, so copies count
    once). ``fetch_limit`` bounds what is fetched over all columns together;
    brackets beyond it are first narrowed by histogram rounds.
    """
    if approx:
        return approx_quantiles(df, cols, probs, accuracy)
    if stats is None:
        stats = moments(df, cols)
    numbers = {c: as_number(df, c) for c in cols}
    found: dict[tuple[str, int], float] = {}
    plan: dict[str, dict] = {}
    wanted: list[tuple[str, tuple[int, ...]]] = []  # (column, finite ranks of one probability)
    for c in cols:
        s = stats[c]
        n, neg, pos = s["n"], s["n_neg_inf"], s["n_pos_inf"]
        if n == 0:
            continue
        plan[c] = _ranks_for(n, probs)
        for (j, k, _) in plan[c].values():
            for r in (j, k):
                if r < neg:
                    found[(c, r)] = float("-inf")
                elif r >= n - pos:
                    found[(c, r)] = float("inf")
            inner = tuple(sorted({r for r in (j, k) if neg <= r < n - pos}))
            if inner and s["fmin"] == s["fmax"]:
                found.update({(c, r): s["fmin"] for r in inner})
            elif inner and (c, inner) not in wanted:
                wanted.append((c, inner))

    windows = _count_brackets(df, numbers, stats, _brackets(df, numbers, stats, wanted))
    fetches, room = [], fetch_limit
    while windows:
        refine = []
        for (c, lo, hi, below, inside, ranks) in sorted(windows, key=lambda w: w[4]):
            if lo == hi:
                found.update({(c, r): lo for r in ranks})
            elif inside <= room:
                fetches.append((c, lo, hi, below, ranks))
                room -= inside
            else:
                refine.append((c, lo, hi, below, inside, ranks))
        windows = _refine(df, numbers, refine, buckets) if refine else []
    if fetches:
        items = [
            F.when(numbers[c].between(F.lit(lo), F.lit(hi)), F.struct(F.lit(fid).alias("f"), numbers[c].alias("x")))
            for fid, (c, lo, hi, _, _) in enumerate(fetches)
        ]
        table = (
            df.select(F.explode(F.filter(F.array(*items), lambda s: s.isNotNull())).alias("v"))
            .groupBy("v.f", "v.x").agg(F.count(F.lit(1)).alias("n")).toArrow()
        )
        got = defaultdict(list)
        for f, x, n in zip(*(table.column(i).to_pylist() for i in range(3))):
            got[f].append((x, n))
        for fid, (c, _, _, below, ranks) in enumerate(fetches):
            values, at, i = sorted(got[fid]), below, 0
            for r in ranks:
                while at + values[i][1] <= r:
                    at += values[i][1]
                    i += 1
                found[(c, r)] = values[i][0]

    out: dict[str, list[float | None]] = {}
    for c in cols:
        if c not in plan:
            out[c] = [None for _ in probs]
            continue
        res = []
        for p in probs:
            j, k, g = plan[c][p]
            a, b = found[(c, j)], found[(c, k)]
            if g == 0 or a == b:
                res.append(a)
            else:
                res.append(a + (b - a) * g)
        out[c] = res
    return out


def _brackets(df: DataFrame, numbers: dict, stats: dict, wanted: list) -> list[tuple]:
    """(column, lo, hi, ranks): sketched values a little below and above the wanted ranks."""
    if not wanted:
        return []
    cols = list(dict.fromkeys(c for c, _ in wanted))
    accuracy = max(500, min(APPROX_ACCURACY, 200_000 // len(cols)))
    asked: dict[str, list[float]] = {c: [] for c in cols}
    for c, ranks in wanted:
        s = stats[c]
        m = s["n"] - s["n_neg_inf"] - s["n_pos_inf"]
        slack = 2 * m / accuracy + 1
        for r in (ranks[0] - s["n_neg_inf"] - slack, ranks[-1] - s["n_neg_inf"] + slack):
            asked[c].append(min(1.0, max(0.0, (r + 1) / m)))
    exprs = []
    for i, c in enumerate(cols):
        x = numbers[c]
        finite = F.when(F.abs(x) != F.lit(float("inf")), x)
        exprs.append(F.percentile_approx(finite, asked[c], accuracy).alias(f"q{i}"))
    row = df.agg(*exprs).first()
    marks = {c: iter(row[f"q{i}"]) for i, c in enumerate(cols)}
    return [(c, next(marks[c]), next(marks[c]), ranks) for c, ranks in wanted]


def _count_brackets(df: DataFrame, numbers: dict, stats: dict, brackets: list) -> list[tuple]:
    """(column, lo, hi, below, inside, ranks); a bracket that misses its ranks
    becomes the column's whole finite range."""
    if not brackets:
        return []
    exprs = []
    for i, (c, lo, hi, _) in enumerate(brackets):
        x = numbers[c]
        exprs += [F.count_if(x < F.lit(lo)).alias(f"b{i}"), F.count_if(x.between(F.lit(lo), F.lit(hi))).alias(f"s{i}")]
    row = df.agg(*exprs).first()
    out = []
    for i, (c, lo, hi, ranks) in enumerate(brackets):
        below, inside, s = int(row[f"b{i}"]), int(row[f"s{i}"]), stats[c]
        if not below <= ranks[0] <= ranks[-1] < below + inside:
            lo, hi, below = s["fmin"], s["fmax"], s["n_neg_inf"]
            inside = s["n"] - s["n_neg_inf"] - s["n_pos_inf"]
        out.append((c, lo, hi, below, inside, ranks))
    return out


def _refine(df: DataFrame, numbers: dict, windows: list, buckets: int) -> list[tuple]:
    """One histogram round: every window shrinks to the buckets that hold its ranks."""
    nb = max(16, min(buckets, HIST_ROWS_MAX // len(windows)))
    items = []
    for wid, (c, lo, hi, _, _, _) in enumerate(windows):
        x = numbers[c]
        b = F.least(F.floor((x / 2.0 - F.lit(lo / 2.0)) / F.lit(hi / 2.0 - lo / 2.0) * F.lit(nb)), F.lit(nb - 1)).cast("int")
        items.append(F.when(x.between(F.lit(lo), F.lit(hi)), F.struct(F.lit(wid).alias("w"), b.alias("b"), x.alias("x"))))
    hist = (
        df.select(F.explode(F.filter(F.array(*items), lambda s: s.isNotNull())).alias("h"))
        .groupBy(F.col("h.w").alias("w"), F.col("h.b").alias("b"))
        .agg(F.count(F.lit(1)).alias("cnt"), F.min("h.x").alias("bmin"), F.max("h.x").alias("bmax"))
        .collect()
    )
    rows = defaultdict(list)
    for r in hist:
        rows[r["w"]].append((r["b"], r["cnt"], r["bmin"], r["bmax"]))
    out = []
    for wid, (c, _, _, below, _, ranks) in enumerate(windows):
        at = below
        for (_, cnt, bmin, bmax) in sorted(rows[wid]):
            held = tuple(r for r in ranks if at <= r < at + cnt)
            if held:
                out.append((c, bmin, bmax, at, cnt, held))
            at += cnt
    return out


def approx_quantiles(df: DataFrame, cols: list[str], probs: list[float], accuracy: int = APPROX_ACCURACY):
    """Opt-in single pass: ``percentile_approx`` (rank error <= n / accuracy).
    For very large, near-unique columns when exact digits are not needed."""
    if not cols:
        return {}
    row = df.agg(*[F.percentile_approx(as_number(df, c), list(probs), accuracy).alias(f"q{i}")
                   for i, c in enumerate(cols)]).first()
    return {c: (list(row[f"q{i}"]) if row[f"q{i}"] is not None else [None for _ in probs]) for i, c in enumerate(cols)}


def value_keys(df: DataFrame, cols: list[str], heads: dict[str, list[str]] | None = None, width: int = HEAD) -> DataFrame:
    """(column, h, g, head, whole, num, exact, cnt) for every distinct non-missing value.

    A value is named by its 128-bit hash (equality of the text form: NaN missing,
    -0.0 = 0.0); ``head`` is its first ``width`` characters and ``whole`` says that
    there are no more, so a long text never crosses the network. ``num`` and ``exact``
    order numbers by their typed value. ``heads`` (of one length) keeps, per column, the
    longer values that begin with one of them: all rows of such a value are kept, so
    counts stay right.
    One ``groupBy`` with partial aggregation collapses a hot value before the shuffle.
    """
    items = []
    for c in cols:
        dt = df.schema[c].dataType
        v = normalise_value(F.col(c), dt)
        if heads is not None:
            size = len(heads[c][0])
            v = F.when(F.substring(v, 1, size).isin(heads[c]) & (F.length(v) > size), v)
        items.append(F.struct(
            F.lit(c).alias("column"), *_hashes(v), F.substring(v, 1, width).alias("head"),
            (F.length(v) <= width).alias("whole"), order_number(c, dt).alias("num"), order_exact(c, dt).alias("exact")))
    exploded = df.select(F.explode(F.array(*items)).alias("s")).select("s.*").where(F.col("head").isNotNull())
    # the hash fixes head and whole: as keys they stay in the hash aggregate, as first() they would be sorted
    return exploded.groupBy("column", "h", "g", "head", "whole").agg(
        F.first("num").alias("num"), F.first("exact").alias("exact"), F.count(F.lit(1)).alias("cnt"))


TOP_DDL = "column_name STRING, rank BIGINT, value STRING, count BIGINT"


def top_values(df: DataFrame, cols: list[str], k: int) -> tuple[DataFrame, dict[str, tuple[int, int]]]:
    """The k most frequent values per column, ties to the smallest typed value, as a
    frame (column_name, rank, value, count); and (distinct values, non-missing rows) per column.

    Values are counted by hash, and heads settle the order. Several long values with
    one count and one head are told apart by grouping again, with longer heads, only the
    values that begin like them. The driver holds at most k groups per column and
    tie, and no long text: those of the winners are fetched, by their hashes, from the
    rows where they stand.
    """
    if not cols:
        return df.sparkSession.createDataFrame([], TOP_DDL), {}
    keys = written(value_keys(df, cols), "keys")
    counts = {r["column"]: (r["d"], r["n"]) for r in
              keys.groupBy("column").agg(F.count(F.lit(1)).alias("d"), F.sum("cnt").alias("n")).collect()}
    won: dict[str, list] = {c: [] for c in cols}
    got = defaultdict(list)
    for r in _best_groups(keys, ["column"], k).collect():
        got[r["column"]].append(r)
    discard(keys)
    tied = [t for c in cols for t in _settle(got[c], k, won[c])]
    width = HEAD
    while tied:
        size, width = width, width * 8
        heads = defaultdict(list)
        for r, _, _ in tied:
            heads[r["column"]].append(r["head"])
        deeper = value_keys(df, list(heads), heads, width).withColumn("start", F.substring("head", 1, size))
        got = defaultdict(list)
        for r in _best_groups(deeper, ["column", "cnt", "start"], max(n for _, n, _ in tied)).collect():
            got[r["column"], r["cnt"], r["start"]].append(r)
        tied = [t for r, n, place in tied for t in _settle(got[r["column"], r["cnt"], r["head"]], n, place)]
    return _with_texts(df, {c: _flat(slots) for c, slots in won.items()}), counts


def _best_groups(keys: DataFrame, within: list[str], k: int) -> DataFrame:
    """The first k groups of values alike in count, number and head, in order of rank."""
    order = [F.desc("cnt"), F.asc_nulls_last("num"), F.asc_nulls_last("exact"), F.asc("head"), F.desc("whole")]
    groups = keys.groupBy(*dict.fromkeys([*within, "column", "cnt", "num", "exact", "head", "whole"])).agg(
        F.count(F.lit(1)).alias("n"), F.first("h").alias("h"), F.first("g").alias("g"))
    return groups.withColumn("r", F.row_number().over(Window.partitionBy(*within).orderBy(*order))).where(F.col("r") <= k)


def _settle(groups: list, places: int, slots: list) -> list[tuple]:
    """Fill ``slots`` with the groups that take the places; a group of several values gets a
    list of its own, returned as (group, places, list) to be settled by longer heads."""
    tied = []
    for r in sorted(groups, key=lambda r: r["r"]):
        taken = min(r["n"], places)
        if taken and r["n"] == 1:
            slots.append(r)
        elif taken:
            slots.append([])
            tied.append((r, taken, slots[-1]))
        places -= taken
    return tied


def _flat(slots: list) -> list:
    return [r for s in slots for r in (_flat(s) if isinstance(s, list) else [s])]


def _with_texts(df: DataFrame, won: dict[str, list]) -> DataFrame:
    """Winners as a frame; the texts that are longer than their heads come from the rows."""
    spark = df.sparkSession
    rows = [(c, i, r["head"] if r["whole"] else None, r["cnt"], r["h"], r["g"])
            for c, winners in won.items() for i, r in enumerate(winners, 1)]
    table = spark.createDataFrame(rows, TOP_DDL + ", h BIGINT, g BIGINT")
    long = {c: [r["h"] for r in winners if not r["whole"]] for c, winners in won.items()}
    items = []
    for c in [c for c in won if long[c]]:
        v = normalise_value(F.col(c), df.schema[c].dataType)
        h, g = _hashes(v)
        items.append(F.when(h.isin(long[c]), F.struct(F.lit(c).alias("c"), h, g, v.alias("v"))))
    if not items:
        return table.drop("h", "g")
    found = df.select(F.explode(F.filter(F.array(*items), lambda s: s.isNotNull())).alias("s")).select("s.*")
    texts = found.groupBy(F.col("c").alias("column_name"), "h", "g").agg(F.min("v").alias("text"))
    return table.join(texts, ["column_name", "h", "g"], "left").select(
        "column_name", "rank", F.coalesce("value", "text").alias("value"), "count")


def _hashes(v: Column) -> tuple[Column, Column]:
    return F.xxhash64(v).alias("h"), F.xxhash64(F.lit(1), v).alias("g")


def order_number(c: str, dt: T.DataType) -> Column:
    """The value as DOUBLE for ordering; NULL for other types."""
    return F.col(c).cast("double") if isinstance(dt, T.NumericType) else F.lit(None).cast("double")


def order_exact(c: str, dt: T.DataType) -> Column:
    """Digits that a DOUBLE loses, for ordering integers and decimals after ``num``."""
    whole = isinstance(dt, (T.IntegralType, T.DecimalType))
    return F.col(c).try_cast("decimal(38,18)") if whole else F.lit(None).cast("decimal(38,18)")


def _value_hashes(c: str, dt: T.DataType) -> tuple[Column, Column, Column]:
    """Two hashes that tell values apart as their texts do, and whether the value is missing.

    A type of at most eight bytes has one text for each value, and its first hash is
    one to one: numbers and times are not written out as text. (A TIMESTAMP may have
    one local time for two instants, and keeps its text.)"""
    col = F.col(c)
    if isinstance(dt, (T.FloatType, T.DoubleType)):
        d = nan_to_null(col.cast("double"))
        v = F.when(d == 0, F.lit(0.0)).otherwise(d)
    elif isinstance(dt, (T.IntegralType, T.BooleanType, T.DateType, T.TimestampNTZType)):
        v = col
    else:
        v = normalise_value(col, dt)
        return *_hashes(v), v.isNull().alias("missing")
    return F.xxhash64(v).alias("h"), F.lit(0).cast("long").alias("g"), v.isNull().alias("missing")


def value_hashes(df: DataFrame, cols: list[str], keep_null: bool = False) -> DataFrame:
    """(column, cnt) for every distinct value of each column, grouped on the value's
    128-bit hash: whole texts stay where they are, and a column travels as its number."""
    items = [F.struct(F.lit(i).alias("at"), *_value_hashes(c, df.schema[c].dataType)) for i, c in enumerate(cols)]
    exploded = df.select(F.explode(F.array(*items)).alias("s")).select("s.*")
    if not keep_null:
        exploded = exploded.where(~F.col("missing"))
    names = F.array(*[F.lit(c) for c in cols])
    return exploded.groupBy("at", "h", "g", "missing").agg(F.count(F.lit(1)).alias("cnt")).select(F.get(names, F.col("at")).alias("column"), "cnt")
