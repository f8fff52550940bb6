"""Quality classifier: a sparse ensemble of rules over text statistics.

Shallow boosted trees are grown on the statistics of labelled texts; every path
from a root to a node becomes a conjunctive rule; a lasso-penalised logistic
regression keeps few of the rules; the kept rules are compiled into one Spark
column expression, which scores every text.

The statistics cover whole texts and are computed where the texts are read. The
only thing that leaves the cluster is the statistics (not the texts) of a
labelled sample of at most ``TRAIN_ROWS`` rows, drawn by a hash of the row's
statistics and id so that it is the same on every run.

Cases: a null text counts as empty; an empty text has zero statistics and gets a
score like any other; without labels of both kinds the score is the smoothed
share of label 1 (0.5 with no label); rows repeat as they are; a doc_id labelled
more than once takes its mean label, rounded up; extra columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from frameprep.llm.common import sliced, staged

TRAIN_ROWS = 40_000
TREES, DEPTH, BINS, LEAST = 24, 3, 24, 20
PENALTY = 0.0005
KEEP_AT = 0.3

STATS = ("n_chars", "n_words", "word_len", "upper", "digits", "marks", "stops", "non_ascii", "pipes", "exclaims",
         "repeats", "distinct", "top_word", "lines_same", "line_len", "long_word", "upper_words", "capped")

_LETTERS = bytes(range(65, 91)) + bytes(range(97, 123))
_KEEP = lambda keep: bytes(b for b in range(256) if b not in keep)
_NOT_UPPER, _NOT_DIGIT = _KEEP(set(range(65, 91))), _KEEP(set(range(48, 58)))
_NOT_LETTER = _KEEP(set(_LETTERS))
_NOT_MARK = _KEEP(set(b"#$%&*+/<=>@\\^_`{|}~"))
_NOT_STOP = _KEEP(set(b".,;:!?"))
_NOT_HIGH = _KEEP(set(range(128, 256)))


def statistics(text: str | None) -> tuple[float, ...]:
    raw = (text or "").encode("utf-8", "surrogatepass")
    words, lines = raw.split(), [x for x in raw.split(b"\n") if x]
    n, k = max(1, len(raw)), max(1, len(words))
    letters = max(1, len(raw.translate(None, _NOT_LETTER)))
    counts = Counter(words)
    return (
        float(len(raw)), float(len(words)), (len(raw) - len(words)) / k,
        len(raw.translate(None, _NOT_UPPER)) / letters, len(raw.translate(None, _NOT_DIGIT)) / n,
        len(raw.translate(None, _NOT_MARK)) / n, len(raw.translate(None, _NOT_STOP)) / k, len(raw.translate(None, _NOT_HIGH)) / n,
        raw.count(b"|") / k, raw.count(b"!") / k,
        sum(map(bytes.__eq__, words, words[1:])) / k, len(counts) / k, max(counts.values(), default=0) / k,
        1 - len(set(lines)) / max(1, len(lines)), len(raw) / max(1, len(lines)), float(max(map(len, words), default=0)),
        sum(map(bytes.isupper, words)) / k, sum(w[:1].isupper() for w in words) / k,
    )


_KIND = pa.struct([(s, pa.float64()) for s in STATS])
STATS_COL = "stats"


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in sliced(batches):
        rows = [statistics(t) for t in batch.column(1).to_pylist()]
        cols = np.array(rows, dtype=float).reshape(len(rows), len(STATS)).T
        stats = pa.StructArray.from_arrays([pa.array(c) for c in cols], fields=list(_KIND))
        yield pa.RecordBatch.from_arrays([batch.column(0), stats], ["doc", STATS_COL])


def with_statistics(docs: DataFrame, carried: Column, text_col: str = "text") -> DataFrame:
    """``carried`` as column doc, and a struct of text statistics, computed where the rows are read."""
    src = docs.select(carried.alias("doc"), F.col(text_col).cast("string").alias("text"))
    stats = T.StructType([T.StructField(s, T.DoubleType()) for s in STATS])
    return src.mapInArrow(_measured, T.StructType([src.schema["doc"], T.StructField(STATS_COL, stats)]))


@dataclass(frozen=True)
class Rule:
    """All of (statistic, above, threshold): above is >, else <=."""

    tests: tuple[tuple[int, bool, float], ...]
    weight: float = 0.0

    def holds(self, x: np.ndarray) -> np.ndarray:
        ok = np.ones(len(x), bool)
        for f, above, t in self.tests:
            ok &= (x[:, f] > t) if above else (x[:, f] <= t)
        return ok

    def column(self) -> Column:
        cond = F.lit(True)
        for f, above, t in self.tests:
            c = F.col(STATS_COL)[STATS[f]]
            cond = cond & ((c > F.lit(t)) if above else (c <= F.lit(t)))
        return F.when(cond, F.lit(self.weight)).otherwise(F.lit(0.0))


@dataclass(frozen=True)
class RuleModel:
    bias: float
    rules: tuple[Rule, ...] = ()

    def score(self) -> Column:
        total = F.lit(self.bias)
        for rule in self.rules:
            total = total + rule.column()
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


def _grow(x: np.ndarray, g: np.ndarray, h: np.ndarray, edges: list[np.ndarray], rows: np.ndarray, path: tuple, depth: int, out: list) -> None:
    """Best second-order splits; every node below the root is a rule."""
    if path:
        out.append((path, rows))
    if depth == 0 or len(rows) < 2 * LEAST:
        return
    best = (1e-6, None, None)
    gs, hs = g[rows].sum(), h[rows].sum()
    for f in range(x.shape[1]):
        for t in edges[f]:
            left = x[rows, f] <= t
            n = int(left.sum())
            if n < LEAST or len(rows) - n < LEAST:
                continue
            gl, hl = g[rows][left].sum(), h[rows][left].sum()
            gain = gl * gl / (hl + 1) + (gs - gl) ** 2 / (hs - hl + 1) - gs * gs / (hs + 1)
            if gain > best[0]:
                best = (gain, f, t)
    if best[1] is None:
        return
    _, f, t = best
    left = x[rows, f] <= t
    _grow(x, g, h, edges, rows[left], path + ((f, False, float(t)),), depth - 1, out)
    _grow(x, g, h, edges, rows[~left], path + ((f, True, float(t)),), depth - 1, out)


def fit_rules(x: np.ndarray, y: np.ndarray, trees: int = TREES, penalty: float = PENALTY) -> RuleModel:
    """Rules from boosted trees, thinned by lasso logistic regression."""
    n, share = len(y), (y.sum() + 1) / (len(y) + 2) if len(y) else 0.5
    bias = float(np.log(share / (1 - share)))
    if n == 0 or y.min() == y.max():
        return RuleModel(bias)
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(x.shape[1])]
    rng, margin, found = np.random.default_rng(7), np.full(n, bias), {}
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = y - p, np.maximum(p * (1 - p), 1e-6)
        rows = np.sort(rng.choice(n, size=min(n, 6000), replace=False))
        some = [e if rng.random() < 0.6 else e[:0] for e in edges]
        nodes: list = []
        _grow(x, g, h, some, rows, (), DEPTH, nodes)
        for path, at in nodes:
            found.setdefault(path, None)
            if len(path) == DEPTH or not any(q[: len(path)] == path and len(q) > len(path) for q, _ in nodes):
                margin = margin + 0.3 * g[at].sum() / (h[at].sum() + 1) * Rule(path).holds(x)
    rules = [Rule(path) for path in found]
    if not rules:
        return RuleModel(bias)
    z = np.stack([r.holds(x) for r in rules], axis=1).astype(np.float32)
    w, b = _lasso(z, y.astype(np.float32), bias, penalty)
    kept = tuple(Rule(r.tests, float(c)) for r, c in zip(rules, w) if c != 0)
    return RuleModel(float(b), kept)


def _lasso(z: np.ndarray, y: np.ndarray, bias: float, penalty: float, steps: int = 400) -> tuple[np.ndarray, float]:
    """Accelerated proximal gradient for the L1-penalised logistic loss."""
    n, m = z.shape
    lip = 0.25 * (np.linalg.norm(z.T @ z / n, 2) + 1)
    w = v = np.zeros(m)
    b = c = bias
    t = 1.0
    for _ in range(steps):
        r = (1 / (1 + np.exp(-np.clip(z @ v + c, -30, 30))) - y) / n
        nw = v - (z.T @ r) / lip
        nw = np.sign(nw) * np.maximum(np.abs(nw) - penalty / lip, 0)
        nb = c - r.sum() / lip
        nt = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, c = nw + (t - 1) / nt * (nw - w), nb + (t - 1) / nt * (nb - b)
        w, b, t = nw, nb, nt
    return w, float(b)


def held_out(id_col: str = "doc_id") -> Column:
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0


def train_rows(stats: DataFrame, labels: DataFrame, most: int = TRAIN_ROWS) -> tuple[np.ndarray, np.ndarray]:
    """Statistics and labels of at most about ``most`` labelled rows outside the held-out fold."""
    known = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out()).groupBy("doc_id").agg(
        F.round(F.avg("quality")).cast("int").alias("quality"))
    rows = stats.join(known, "doc_id")
    share = min(1.0, most / max(1, rows.count()))
    draw = F.pmod(F.xxhash64("doc_id", F.lit("fit")), F.lit(1_000_000)) < F.lit(int(share * 1_000_000))
    got = rows.where(draw).orderBy(F.xxhash64("doc_id")).limit(most).select("quality", f"{STATS_COL}.*").toArrow()
    if not got.num_rows:
        return np.zeros((0, len(STATS))), np.zeros(0)
    return np.stack([got.column(s).to_numpy() for s in STATS], axis=1), got.column("quality").to_numpy().astype(float)


def fit_quality(stats: DataFrame, labels: DataFrame) -> RuleModel:
    return fit_rules(*train_rows(stats, labels))


def _document_stats(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return staged(with_statistics(docs, F.col(id_col).cast("long"), text_col).withColumnRenamed("doc", "doc_id"), "stats")


def score_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    stats = _document_stats(docs, id_col, text_col)
    score = fit_quality(stats, labels).score()
    return stats.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), score.alias("score")).withColumn(
        "predicted", (F.col("score") >= KEEP_AT).cast("int"))


def keep_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that the classifier does not reject, columns unchanged."""
    model = fit_quality(_document_stats(docs, id_col, text_col), labels)
    return with_statistics(docs, F.struct("*"), text_col).where(model.score() >= KEEP_AT).select("doc.*")
