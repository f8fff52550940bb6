"""Feature relevance.

Per-column facts are taken from the schema evidence (it must be given, as in
the reference), the dominant-value share from the value-frequency table, and
all correlations (feature-target and every numeric pair) from two aggregates of
mean-centred sums (pairwise-complete where a column has gaps), chunked so one
aggregate stays a manageable width.

Wide frames (more than ``SCREEN_FROM`` numeric columns) do not sum every pair. With a
few pivot columns, r_ab is the product of the parts of a and b inside the pivots' span
plus at most sqrt((1 - |a|^2)(1 - |b|^2)) of what is outside; the same holds for a part of
the rows. Pairs that these bounds keep under the threshold are never formed on the
whole table, no pair above it is lost, and the pairs found stay a table.
"""

from __future__ import annotations

import itertools
import json
import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from frameprep.functions.coerce import numeric_columns, type_name
from frameprep.functions.report import frame, pct, round_half_away
from frameprep.functions.stats import value_hashes
from frameprep.functions.written import discard, written

# --- fixed values -----------------------------------------------------------
RELEVANCE_ACTIONS = ("Keep", "Drop", "Investigate")
NEAR_CONSTANT_PCT = 95.0
HIGH_CORRELATION = 0.85
# ---------------------------------------------------------------------------
PRODUCTS_PER_CHUNK = 400  # product sums a row adds up at a time; all chunks share one scan
SCREEN_FROM = 100  # numeric columns above which pairs are screened
PIVOTS, PIVOT_ROWS = 16, 512  # pivot columns, and rows that steer their choice (not the result)
PAIRS_PER_SCAN = 400_000
SCREEN_CHUNK = 64  # products of a screening sum: few enough for one compiled aggregate
PART = 4  # one row in so many is in the part that is summed first

EVIDENCE_DDL = (
    "column_name STRING, dtype STRING, is_target BOOLEAN, missing_percentage DOUBLE, unique_count BIGINT, "
    "unique_percentage DOUBLE, is_constant BOOLEAN, is_near_constant BOOLEAN, dominant_value_percentage DOUBLE, "
    "is_identifier_candidate BOOLEAN, correlation_with_target DOUBLE"
)
PAIRS_DDL = "column_1 STRING, column_2 STRING, correlation DOUBLE, absolute_correlation DOUBLE"


def _schema_rows(schema_evidence) -> dict[str, dict]:
    """Accept the schema evidence as a DataFrame, a list of rows/dicts, or a
    dict with a ``columns`` list; anything else is an error."""
    if schema_evidence is None:
        raise ValueError("schema evidence is needed to judge relevance")
    if isinstance(schema_evidence, DataFrame):
        items = [r.asDict() for r in schema_evidence.collect()]
    elif isinstance(schema_evidence, dict):
        items = schema_evidence.get("columns", [])
    elif isinstance(schema_evidence, list):
        items = schema_evidence
    else:
        raise TypeError(f"schema evidence must be a DataFrame, rows or a dict, not {type(schema_evidence).__name__}")
    out = {}
    for it in items:
        if hasattr(it, "asDict"):
            it = it.asDict()
        if isinstance(it, dict):
            name = it.get("column_name", it.get("column"))
            if name is not None:
                out[name] = it
    return out


def _corr_cols(df: DataFrame) -> list[str]:
    """Columns that take part in a correlation with the target (bool counts)."""
    return [f.name for f in df.schema.fields if isinstance(f.dataType, (T.NumericType, T.BooleanType))]


def correlations(df: DataFrame, pairs: list[tuple[str, str]]) -> dict[tuple[str, str], float | None]:
    """Pairwise-complete Pearson for each pair, None when undefined.

    Two passes for any number of pairs. The first finds each column's mean and
    whether it has gaps. The second sums products of entries of one vector per row:
    mean-centred values, their squares, and 0/1 masks, where a missing value is 0 in
    all three. A pair of gap-free columns needs one product sum, a pair with gaps
    sums its own count, means and squares through the masks. The wanted products
    are cut into chunks and each row meets every chunk inside the one scan.
    """
    if not pairs:
        return {}
    cols = list(dict.fromkeys(c for p in pairs for c in p))
    xs = {c: F.col(c).cast("double") for c in cols}
    xs = {c: F.when(~F.isnan(x), x) for c, x in xs.items()}
    r0 = df.agg(F.count(F.lit(1)).alias("n"), *[F.avg(xs[c]).alias(f"m{i}") for i, c in enumerate(cols)],
                *[F.count(xs[c]).alias(f"k{i}") for i, c in enumerate(cols)]).first()
    n, k, at = int(r0["n"]), len(cols), {c: i for i, c in enumerate(cols)}
    full = {c: int(r0[f"k{i}"]) == n for i, c in enumerate(cols)}
    centred = [F.coalesce(xs[c] - F.lit(r0[f"m{i}"] or 0.0), F.lit(0.0)) for i, c in enumerate(cols)]
    masks = [xs[c].isNotNull().cast("double") for c in cols]
    x, sq, mask = (lambda c: at[c]), (lambda c: k + at[c]), (lambda c: 2 * k + at[c])
    wanted: dict[tuple[int, int], None] = {}
    for a, b in pairs:
        if full[a] and full[b]:
            wanted |= dict.fromkeys([(x(a), x(a)), (x(b), x(b)), (x(a), x(b))])
        else:
            wanted |= dict.fromkeys([(mask(a), mask(b)), (x(a), mask(b)), (mask(a), x(b)), (sq(a), mask(b)),
                                     (mask(a), sq(b)), (x(a), x(b))])
    products = list(wanted)
    chunks = [products[i:i + PRODUCTS_PER_CHUNK] for i in range(0, len(products), PRODUCTS_PER_CHUNK)]
    table = F.from_json(F.lit(json.dumps([{"a": [p for p, _ in ch], "b": [q for _, q in ch]} for ch in chunks])),
                        F.lit("array<struct<a:array<int>,b:array<int>>>"))
    entries = [*centred, *[c * c for c in centred], *masks]
    rows = df.select(F.array(*entries).alias("v")).select("v", F.posexplode(table).alias("chunk", "at"))
    width = max(map(len, chunks))
    if len(products) <= SCREEN_CHUNK:  # few enough for one compiled aggregate over plain columns
        used = sorted({e for p in products for e in p})
        plain = df.select(*[entries[e].alias(f"e{e}") for e in used])
        sums = plain.agg(F.lit(0).alias("chunk"), *[F.sum(F.col(f"e{a}") * F.col(f"e{b}")).alias(f"s{j}") for j, (a, b) in enumerate(products)]).collect()
    else:
        sums = rows.groupBy("chunk").agg(*[
        F.sum(F.get("v", F.get("at.a", F.lit(j))) * F.get("v", F.get("at.b", F.lit(j)))).alias(f"s{j}") for j in range(width)]).collect()
    got = {p: r[f"s{j}"] for r in sums for j, p in enumerate(chunks[r["chunk"]])}
    out: dict[tuple[str, str], float | None] = {}
    for a, b in pairs:
        if full[a] and full[b]:
            m, sa, sb = n, 0.0, 0.0
            saa, sbb, sab = (got.get(p) for p in ((x(a), x(a)), (x(b), x(b)), (x(a), x(b))))
        else:
            m = int(got.get((mask(a), mask(b))) or 0)
            sa, sb = got.get((x(a), mask(b))) or 0.0, got.get((mask(a), x(b))) or 0.0
            saa, sbb, sab = (got.get(p) for p in ((sq(a), mask(b)), (mask(a), sq(b)), (x(a), x(b))))
        if m <= 1 or saa is None or sbb is None or sab is None:
            out[(a, b)] = None
            continue
        va, vb = saa / m - (sa / m) ** 2, sbb / m - (sb / m) ** 2
        cov = sab / m - (sa / m) * (sb / m)
        if not (va > 0 and vb > 0):
            out[(a, b)] = None
            continue
        r = cov / math.sqrt(va * vb)
        out[(a, b)] = max(-1.0, min(1.0, r))
    return out


def _pivot_columns(rows: DataFrame, k: int) -> list[int]:
    """Columns that many others resemble, judged on a few rows: which ones are taken
    changes how much is ruled out, never what is found."""
    sample = np.array([r["v"] for r in rows.limit(PIVOT_ROWS).collect()], float).reshape(-1, k)
    norm = np.sqrt((sample ** 2).sum(axis=0))
    unit = sample / np.where(norm > 0, norm, 1)
    chosen: list[int] = []
    left = np.ones(k, bool)
    while len(chosen) < min(PIVOTS, k) and left.any():
        close = np.abs(unit[:, left].T @ unit) > 0.7  # rows: columns without a pivot yet
        best = int(close.sum(axis=0).argmax())
        covered = np.flatnonzero(left)[close[:, best]]
        chosen.append(best)
        left[covered] = left[best] = False
    return chosen


def _sums(rows: DataFrame, pairs: np.ndarray, by: tuple[str, ...] = ()) -> DataFrame:
    """(``by``, a, b, s): sums of products of the pairs (m x 2) of entries of ``v``, one scan."""
    chunks = [pairs[i:i + SCREEN_CHUNK] for i in range(0, len(pairs), SCREEN_CHUNK)]
    table = F.from_json(F.lit(json.dumps([{"a": c[:, 0].tolist(), "b": c[:, 1].tolist()} for c in chunks])), F.lit("array<struct<a:array<int>,b:array<int>>>"))
    width = max(map(len, chunks))
    sums = rows.select("v", *by, F.posexplode(table).alias("chunk", "at")).groupBy("chunk", *by).agg(F.first("at").alias("at"), F.array(*[
        F.sum(F.get("v", F.get("at.a", F.lit(j))) * F.get("v", F.get("at.b", F.lit(j)))) for j in range(width)]).alias("s"))
    return sums.select(*by, F.explode(F.arrays_zip(F.col("at.a").alias("a"), F.col("at.b").alias("b"), F.slice("s", 1, F.size("at.a")).alias("s"))).alias(
        "p")).select(*by, "p.a", "p.b", "p.s")


def _possible(span: np.ndarray, least: float) -> Iterator[np.ndarray]:
    """Pairs (a < b) that the pivots do not rule out, at most ``PAIRS_PER_SCAN`` at a time.
    ``span``: coordinates of the columns in an orthonormal basis of the pivots' span."""
    outside = np.sqrt(np.maximum(0, 1 - (span ** 2).sum(axis=1)))
    held, size = [], 0
    for at in range(0, len(span), 256):
        block = slice(at, at + 256)
        most = np.abs(span[block] @ span.T) + outside[block, None] * outside[None]
        a, b = np.nonzero(most >= least)
        found = np.column_stack([a + at, b])[a + at < b]
        for i in range(0, len(found), PAIRS_PER_SCAN):
            part = found[i:i + PAIRS_PER_SCAN]
            if size + len(part) > PAIRS_PER_SCAN:
                yield np.concatenate(held)
                held, size = [], 0
            held.append(part)
            size += len(part)
    if held and size:
        yield np.concatenate(held)


def _packed(df: DataFrame, cols: list[str]) -> DataFrame:
    """The columns as one array (missing: NULL), written once: the scans that follow read one
    column instead of planning them all again."""
    xs = [F.col(c).cast("double") for c in cols]
    return written(df.select(F.array(*[F.when(~F.isnan(x), x) for x in xs]).alias("v")), "columns")


def strong_pairs(df: DataFrame, cols: list[str], threshold: float = HIGH_CORRELATION, counted: dict | None = None) -> DataFrame:
    """Pairs of gap-free columns whose rounded |r| reaches ``threshold``: a, b (positions in
    ``cols``), r. ``counted`` gets the number of pairs summed over the part and over all rows."""
    return _screened(_packed(df, cols), len(cols), threshold, counted)[0]


def _screened(packed: DataFrame, k: int, threshold: float, counted: dict | None = None) -> tuple[DataFrame, list[int]]:
    """(pairs, positions of the columns with gaps). Scans: means; products with the pivots; for
    each batch of pairs left, the part of the rows and, for what that leaves, all rows."""
    spark = packed.sparkSession
    least = threshold - 0.00005 - 1e-6
    counted = {} if counted is None else counted
    counted.update(pivots=0, part=0, whole=0)
    facts = packed.select(F.posexplode("v").alias("c", "x")).groupBy("c").agg(F.avg("x").alias("m"), (F.count(F.lit(1)) - F.count("x")).alias("gaps")).collect()
    means, gaps = [0.0] * k, []
    for r in facts:  # one row a column
        means[r["c"]] = r["m"] or 0.0
        gaps += [r["c"]] * (r["gaps"] > 0)
    centre = F.from_json(F.lit(json.dumps(means)), F.lit("array<double>"))
    rows = packed.select(F.zip_with("v", centre, lambda x, m: F.coalesce(x - m, F.lit(0.0))).alias("v"))
    rows = written(rows.withColumn("part", F.pmod(F.xxhash64("v"), F.lit(PART)) == 0), "centred")
    discard(packed)
    pivots = _pivot_columns(rows, k)
    first = np.array([(c, c) for c in range(k)] + [(c, p) for c in range(k) for p in pivots])
    counted["pivots"] = len(first)
    got = {(r["part"], r["a"], r["b"]): r["s"] for r in _sums(rows, first, ("part",)).collect()}  # columns x (pivots + 1)
    whole = lambda a, b: (got.get((True, a, b)) or 0.0) + (got.get((False, a, b)) or 0.0)
    energy = np.array([whole(c, c) for c in range(k)])
    share = np.array([got.get((True, c, c)) or 0.0 for c in range(k)]) / np.where(energy > 0, energy, 1)
    norm = np.sqrt(np.where(energy > 0, energy, 1))
    to_pivots = np.array([[whole(c, p) for p in pivots] for c in range(k)]).reshape(k, len(pivots)) / norm[:, None] / norm[pivots][None]
    values, vectors = np.linalg.eigh(to_pivots[pivots])
    keep = values > 1e-6
    span = to_pivots @ vectors[:, keep] / np.sqrt(values[keep])
    span[energy <= 0] = 0
    alive = np.setdiff1d(np.flatnonzero(energy > 0), gaps)  # a constant column has no correlation
    at = lambda numbers: F.from_json(F.lit(json.dumps(numbers.tolist())), F.lit("array<double>"))
    rest = F.get(at(np.sqrt(np.maximum(0, 1 - share))), F.col("a")) * F.get(at(np.sqrt(np.maximum(0, 1 - share))), F.col("b"))
    scaled: Column = F.col("s") / F.get(at(norm), F.col("a")) / F.get(at(norm), F.col("b"))
    found = []
    for pairs in _possible(span[alive], least):
        pairs = alive[pairs]
        counted["part"] += len(pairs)
        left = _sums(rows.where("part"), pairs).where(F.abs(scaled) + rest >= least).select("a", "b").collect()
        if not left and share.max() == 0:  # an empty part says nothing
            left = pairs
        if len(left):
            left = np.array([(p[0], p[1]) for p in left])
            counted["whole"] += len(left)
            r = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), scaled))
            found.append(written(_sums(rows, left).select("a", "b", r.alias("r")).where(F.round(F.abs("r"), 4) >= threshold), "pairs"))
    discard(rows)
    return reduce(DataFrame.unionAll, found) if found else spark.createDataFrame([], "a INT, b INT, r DOUBLE"), sorted(gaps)


def _wide_pairs(df: DataFrame, num: list[str]) -> DataFrame:
    """R4 of a wide frame: gap-free columns by screening, pairs with a gap in batches."""
    names = F.from_json(F.lit(json.dumps(num)), F.lit("array<string>"))
    strong, gaps = _screened(_packed(df, num), len(num), HIGH_CORRELATION)
    out = strong.select(F.get(names, F.col("a")).alias("column_1"), F.get(names, F.col("b")).alias("column_2"),
                        F.round("r", 4).alias("correlation"), F.round(F.abs("r"), 4).alias("absolute_correlation"))
    some = {num[c] for c in gaps}
    pairs = ((a, b) for a, b in itertools.combinations(num, 2) if a in some or b in some)
    while batch := list(itertools.islice(pairs, PAIRS_PER_SCAN // 40)):
        out = out.unionByName(frame(df.sparkSession, _pair_rows(correlations(df, batch)), PAIRS_DDL))
    at = {c: i for i, c in enumerate(num)}
    place = F.from_json(F.lit(json.dumps(at)), F.lit("map<string,int>"))
    return out.orderBy(F.desc("absolute_correlation"), place[F.col("column_1")], place[F.col("column_2")])


def _pair_rows(corr: dict[tuple[str, str], float | None]) -> list[dict]:
    """Rows of the pairs whose rounded |r| reaches the threshold."""
    rows = []
    for (a, b), r in corr.items():
        ar = round_half_away(abs(r), 4) if r is not None else None
        if ar is not None and ar >= HIGH_CORRELATION:  # the threshold is on the rounded value
            rows.append({"column_1": a, "column_2": b, "correlation": round_half_away(r, 4), "absolute_correlation": ar})
    return rows


def analyze_feature_relevance(df: DataFrame, target: str | None, schema_evidence) -> tuple[DataFrame, DataFrame]:
    """(feature evidence, high-correlation pairs)."""
    schema = _schema_rows(schema_evidence)
    cols = list(df.columns)
    plain = [c for c in cols if not isinstance(df.schema[c].dataType, (T.MapType, T.ArrayType, T.StructType, T.BinaryType))]
    # schema evidence already carries the top count of every column: reuse it
    dom = {}
    for c in plain:
        info = schema.get(c, {})
        if info.get("top_count") is not None and "total_count" in info and "missing_count" in info \
                and "unique_count" in info:
            present = int(info["total_count"]) - int(info["missing_count"])
            dom[c] = (int(info["top_count"] or 0), present, int(info["unique_count"]))
    rest = [c for c in plain if c not in dom]
    if rest:
        freq = value_hashes(df, rest)
        dom.update({
            r["column"]: (int(r["top"]), int(r["present"]), int(r["u"]))
            for r in freq.groupBy("column").agg(
                F.max("cnt").alias("top"), F.sum("cnt").alias("present"), F.count(F.lit(1)).alias("u")
            ).collect()
        })
    corr_cols = _corr_cols(df)
    target_pairs = []
    if target is not None and target in corr_cols:
        target_pairs = [(c, target) for c in corr_cols if c != target]
    num = numeric_columns(df)  # booleans left out of the pair matrix
    wide = len(num) > SCREEN_FROM
    matrix_pairs = [] if wide else list(itertools.combinations(num, 2))
    corr = correlations(df, list(dict.fromkeys(target_pairs + matrix_pairs)))
    n = None
    rows = []
    for c in cols:
        info = schema.get(c, {})
        top, present, u = dom.get(c, (0, 0, 0))
        if "missing_percentage" in info:
            miss = info["missing_percentage"]
        else:
            if n is None:
                n = df.count()
            miss = pct(n - present, n)
        uniq = info.get("unique_count", u)
        const = info.get("is_constant", uniq <= 1)
        domp = pct(top, present) if present else 0.0
        r = corr.get((c, target)) if target_pairs else None
        rows.append({
            "column_name": c,
            "dtype": info.get("dtype", type_name(df.schema[c].dataType)),
            "is_target": c == target,
            "missing_percentage": round_half_away(float(miss), 2),
            "unique_count": int(uniq),
            "unique_percentage": round_half_away(float(info.get("unique_percentage", 0.0)), 2),
            "is_constant": bool(const),
            "is_near_constant": bool(domp >= NEAR_CONSTANT_PCT and not const),
            "dominant_value_percentage": round_half_away(domp, 2),
            "is_identifier_candidate": bool(info.get("is_identifier_candidate", False)),
            "correlation_with_target": round_half_away(r, 4) if r is not None else None,
        })
    features = frame(df.sparkSession, rows, EVIDENCE_DDL)
    if wide:
        return features, _wide_pairs(df, num)
    pair_rows = sorted(_pair_rows({p: corr.get(p) for p in matrix_pairs}), key=lambda p: -p["absolute_correlation"])
    return features, frame(df.sparkSession, pair_rows, PAIRS_DDL)


def relevance_counters(features: DataFrame, pairs: DataFrame, target: str | None) -> DataFrame:
    """Number of identifier-like, constant, near-constant columns and high pairs."""
    f = features.agg(
        F.count_if("is_identifier_candidate").alias("identifier_like"),
        F.count_if("is_constant").alias("constant"),
        F.count_if("is_near_constant").alias("near_constant"),
    ).first()
    return frame(
        features.sparkSession,
        [{"target_column": target, "identifier_like": f["identifier_like"], "constant": f["constant"],
          "near_constant": f["near_constant"], "high_correlation_pairs": pairs.count()}],
        "target_column STRING, identifier_like BIGINT, constant BIGINT, near_constant BIGINT, high_correlation_pairs BIGINT",
    )


def check_actions(actions: list[tuple[str, str]], target: str | None) -> None:
    """R8 and the closed action set: the target can only be kept."""
    for c, a in actions:
        if a not in RELEVANCE_ACTIONS:
            raise ValueError(f"Unknown relevance action: {a}")
        if c == target and a != "Keep":
            raise ValueError(f"The target column '{c}' can only be kept")


def apply_relevance_actions(df: DataFrame, actions, target: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Drop the Drop columns in one projection; Keep / Investigate are recorded."""
    actions = list(actions.items()) if isinstance(actions, dict) else list(actions)
    check_actions(actions, target)
    actions = [(c, a) for c, a in actions if c in df.columns]
    drops = [c for c, a in actions if a == "Drop"]
    label = {"Drop": "Dropped", "Keep": "Kept", "Investigate": "Investigate"}
    summary = [{"column_name": c, "action": label[a]} for c, a in actions]
    return df.drop(*drops), frame(df.sparkSession, summary, "column_name STRING, action STRING")
