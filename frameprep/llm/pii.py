"""Personal data by candidate gradient boosting, in DataFrame operations only.

Base spans (email, ip, card, phone) are found by fixed patterns and checks.
High-recall generators propose further, overlapping candidates: written-out
addresses, grouped digits, dotted numbers, assigned secrets. Every candidate is
described by format and context, and deliberately not by the base checks (check
digit, plus sign, ranges), so that the model learns what personal data look like
and not the checks again: a candidate that a base span confirms is a positive,
the others are unlabelled.

Features are small integers, so all candidates of all documents collapse into a
bounded table of feature cells with counts (one distributed aggregate). Trees are
boosted on the cells and compiled into Spark column expressions. Thresholds are
calibrated per kind on the documents that were not used to fit (a fold by
crc32): the lowest score whose confirmed share reaches ``PRECISION``. Candidates
at or above it are redacted too; where they overlap each other the better score
wins, and they never replace a base span.

Positions are code points, end exclusive. A match list and the text split at the
same pattern give positions by running lengths. Patterns use possessive
quantifiers and start at the head of a run, so long runs cost linear time.

Cases: a null text counts as empty and has no spans; without candidates nothing
is fitted and only base spans are returned; rows repeat as they are; extra
columns are ignored; an empty table gives none.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from frameprep.llm.common import staged, text_or_empty

SPAN = "array<struct<start:int,end:int,text:string>>"
KINDS = ("email", "ip", "card", "phone")
EXTRA_KINDS = (*KINDS, "secret")
PRECISION = 0.9
TREES, DEPTH, RATE = 12, 3, 0.4

_LOCAL = r"[A-Za-z0-9._%+-]"
_HEAD = lambda run: rf"(?:\G|(?<!{run}))"  # noqa: E731 - a match starts where its run does
#: fixed patterns of the base kinds
BASE = {
    "email": _HEAD(_LOCAL) + _LOCAL + r"++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": _HEAD("[0-9]") + r"[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": _HEAD("[0-9]") + r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: generators of candidates, wider than the base patterns
GENERATORS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+ ?(?:@|\(at\)|\[at\]| at ) ?[A-Za-z0-9-]{1,63}+(?: ?(?:\.|\(dot\)|\[dot\]| dot ) ?[A-Za-z0-9-]{2,63}+)++",
    "ip": r"(?<![0-9.])[0-9]{1,3}+(?:\.[0-9]{1,3}+){3}+(?![0-9])",
    "card": r"(?<![0-9])[0-9]{3,6}+(?:[ -]?[0-9]{2,7}+){1,5}+(?![0-9])",
    "phone": r"(?<![0-9A-Za-z])\+?(?:[0-9]{1,3}+[ .-])?\(?[0-9]{2,4}+\)?[ .-][0-9]{3,4}+[ .-]?[0-9]{3,4}+(?![0-9])",
    "secret": r"(?<![A-Za-z])(?:password|passwd|token|secret|api[_-]?key)[ ]?[=:][ ]?\"?[^\s\"]{8,}+",
}
_DIGIT = "[0-9]"


def _spans(text: Column, pattern: str, trigger: Column) -> Column:
    """(start, end, text) of every leftmost non-overlapping match, in code points."""
    found = F.when(trigger, F.regexp_extract_all(text, F.lit(pattern), F.lit(0)))
    gaps = F.when(trigger & (F.size(found) > 0), F.split(text, pattern, -1))
    start = F.struct(F.lit(0).alias("at"), F.array().cast(SPAN).alias("out"))

    def step(acc: Column, pair: Column) -> Column:
        begin = acc["at"] + F.length(pair["gap"])
        end = begin + F.coalesce(F.length(pair["hit"]), F.lit(0))
        span = F.array(F.struct(begin.alias("start"), end.alias("end"), pair["hit"].alias("text")))
        return F.struct(end.alias("at"), F.when(pair["hit"].isNull(), acc["out"]).otherwise(F.concat(acc["out"], span)).alias("out"))

    pairs = F.arrays_zip(found.alias("hit"), gaps.alias("gap"))
    pairs = F.transform(pairs, lambda z: F.struct(z["hit"].alias("hit"), z["gap"].alias("gap")))
    return F.coalesce(F.when(F.size(found) > 0, F.aggregate(pairs, start, step)["out"]), F.array().cast(SPAN))


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    back = F.reverse(digits)

    def add(total: Column, i: Column) -> Column:
        x = F.substring(back, i, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1)
        return total + x - F.when(x > 9, 9).otherwise(0)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def _byte(part: Column) -> Column:
    plain = F.regexp_replace(part, "^0+", "")
    return F.when(F.length(plain) <= 3, F.coalesce(plain.try_cast("int"), F.lit(0)) <= 255).otherwise(False)


def _holds(kind: str):
    def check(span: Column) -> Column:
        digits = _digits(span["text"])
        n = F.length(digits)
        if kind == "ip":
            return F.forall(F.split(span["text"], r"\."), _byte)
        if kind == "card":
            return F.when((n >= 13) & (n <= 19), _luhn(digits)).otherwise(False)
        return (n >= 9) & (n <= 15)
    return check


def base_spans(text: Column) -> dict[str, Column]:
    """Checked spans of each base kind."""
    number = text.rlike(_DIGIT)
    trigger = {"email": F.contains(text, F.lit("@")), "ip": number & F.contains(text, F.lit(".")), "card": number,
               "phone": F.contains(text, F.lit("+"))}
    out = {k: _spans(text, BASE[k], trigger[k]) for k in KINDS}
    return {k: s if k == "email" else F.filter(s, _holds(k)) for k, s in out.items()}


def _candidates(text: Column) -> Column:
    """(kind, start, end, text, before, after) of every proposal of every generator."""
    number = text.rlike(_DIGIT)
    trigger = {"email": text.rlike(r"@|\(at\)|\[at\]| at [A-Za-z0-9-]+ (?:dot )"), "secret": text.rlike("[=:]")}
    lists = []
    for kind, pattern in GENERATORS.items():
        spans = _spans(text, pattern, trigger.get(kind, number))
        lists.append(F.transform(spans, _proposal(kind, text)))
    return F.concat(*lists)


def _proposal(kind: str, text: Column):
    def build(s: Column) -> Column:
        return F.struct(
            F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["text"].alias("text"),
            F.substring(text, F.greatest(F.lit(1), s["start"] - 23), F.least(s["start"], F.lit(24))).alias("before"),
            F.substring(text, s["end"] + 1, F.lit(2)).alias("after"))
    return build


def _tag(place: int, kind: str):
    def build(s: Column) -> Column:
        return F.struct(F.lit(place).alias("k"), F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end"))
    return build


def _is_kind(kind: str):
    def check(s: Column) -> Column:
        return s["kind"] == kind
    return check


#: feature name -> number of values it can take; the cell table has their product at most
FEATURES = {"kind": 5, "digits": 6, "groups": 5, "separator": 5, "letters": 3, "length": 5, "context": 4, "edge": 3}


def _features() -> list[Column]:
    t, before, after = F.col("c.text"), F.col("c.before"), F.col("c.after")
    n = F.length(_digits(t))
    kind = sum((F.when(F.col("c.kind") == k, i).otherwise(0) for i, k in enumerate(EXTRA_KINDS)), F.lit(0))
    groups = F.least(F.size(F.regexp_extract_all(t, F.lit("[0-9]+"), F.lit(0))), F.lit(4))
    bucket = lambda x, *edges: sum((F.when(x >= e, 1).otherwise(0) for e in edges), F.lit(0))
    separator = F.when(t.rlike("@"), 4).when(t.rlike(r"\."), 3).when(t.rlike("-"), 2).when(t.rlike(" "), 1).otherwise(0)
    letters = F.when(t.rlike("[A-Za-z]{3}"), 2).when(t.rlike("[A-Za-z]"), 1).otherwise(0)
    context = F.when(before.rlike(r"(?i)(call|phone|tel|fax|mobile)\W*$"), 3).when(
        before.rlike(r"(?i)(mail|contact|write|from|card|visa|ip|host|server)\W*$"), 2).when(before.rlike(r"[\p{L}]\W*$"), 1).otherwise(0)
    edge = F.when(before.rlike(r"[\p{L}0-9]$") | after.rlike(r"^[\p{L}0-9]"), 2).when(after.rlike(r"^[.,;]"), 1).otherwise(0)
    values = [kind, bucket(n, 1, 7, 10, 13, 17), groups, separator, letters, bucket(F.length(t), 8, 12, 17, 24), context, edge]
    return [v.cast("int").alias(f) for f, v in zip(FEATURES, values)]


class Boosted:
    """Trees over integer features, boosted on weighted cells."""

    def __init__(self, x: np.ndarray, pos: np.ndarray, neg: np.ndarray):
        w = pos + neg
        self.bias = math.log((pos.sum() + 0.5) / (neg.sum() + 0.5))
        self.trees: list = []
        margin = np.full(len(x), self.bias)
        for _ in range(TREES):
            p = 1 / (1 + np.exp(-margin))
            tree = self._grow(x, pos - w * p, w * p * (1 - p), np.arange(len(x)), DEPTH)
            self.trees.append(tree)
            margin += np.array([self._leaf(tree, row) for row in x])

    def _grow(self, x, g, h, rows, depth):
        gs, hs = g[rows].sum(), h[rows].sum()
        best = (1e-6, None, None)
        for f in range(x.shape[1]) if depth else ():
            for t in np.unique(x[rows, f])[:-1]:
                left = x[rows, f] <= t
                gl, hl = g[rows][left].sum(), h[rows][left].sum()
                gain = gl * gl / (hl + 1) + (gs - gl) ** 2 / (hs - hl + 1) - gs * gs / (hs + 1)
                if gain > best[0]:
                    best = (gain, f, int(t))
        if best[1] is None:
            return float(RATE * gs / (hs + 1))
        left = x[rows, best[1]] <= best[2]
        return (best[1], best[2], self._grow(x, g, h, rows[left], depth - 1), self._grow(x, g, h, rows[~left], depth - 1))

    def _leaf(self, tree, row) -> float:
        while isinstance(tree, tuple):
            tree = tree[2] if row[tree[0]] <= tree[1] else tree[3]
        return tree

    def margin(self, row) -> float:
        return self.bias + sum(self._leaf(t, row) for t in self.trees)

    def column(self) -> Column:
        names = list(FEATURES)

        def compiled(tree) -> Column:
            if not isinstance(tree, tuple):
                return F.lit(tree)
            return F.when(F.col(names[tree[0]]) <= tree[1], compiled(tree[2])).otherwise(compiled(tree[3]))

        total = F.lit(self.bias)
        for tree in self.trees:
            total = total + compiled(tree)
        return total


def _fit(described: DataFrame) -> tuple[Boosted | None, dict[str, float]]:
    """The model and the threshold of each kind, from the table of feature cells."""
    confirmed = F.col("confirmed").cast("long")
    cells = described.groupBy(*FEATURES, "fold").agg(F.sum(confirmed).alias("pos"), F.sum(1 - confirmed).alias("neg")).collect()
    fit = [r for r in cells if not r["fold"]]
    if not fit:
        return None, {}
    x = np.array([[r[f] for f in FEATURES] for r in fit])
    model = Boosted(x, np.array([float(r["pos"]) for r in fit]), np.array([float(r["neg"]) for r in fit]))
    checked = [r for r in cells if r["fold"]] or fit
    limits = {}
    for i, kind in enumerate(EXTRA_KINDS):
        rows = sorted(((model.margin([r[f] for f in FEATURES]), r["pos"], r["neg"]) for r in checked if r["kind"] == i), reverse=True)
        pos = neg = 0
        for k, (m, a, b) in enumerate(rows):
            pos, neg = pos + a, neg + b
            if (k + 1 == len(rows) or rows[k + 1][0] < m) and pos >= PRECISION * (pos + neg) and pos:
                limits[kind] = m
    return model, limits


def _overlaps(a: Column, b: Column) -> Column:
    return (a["start"] < b["end"]) & (b["start"] < a["end"])


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, base and spans of every document: arrays of (k, kind, start, end) in
    order of kind and start; k is the kind's place in EXTRA_KINDS."""
    text = F.col("text")
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    base = base_spans(text)
    tagged = F.concat(*[F.transform(base[k], _tag(i, k)) for i, k in enumerate(KINDS)])
    rows = staged(src.select(F.monotonically_increasing_id().alias("row"), "doc_id", tagged.alias("base"),
                             _candidates(text).alias("candidates")), "pii")
    one = rows.where(F.size("candidates") > 0).select("row", "doc_id", "base", F.explode("candidates").alias("c"))
    hits = F.exists("base", lambda b: _overlaps(b, F.col("c")))
    described = staged(one.select(
        "row", "c.kind", "c.start", "c.end", *[f.alias(f"f_{n}") for n, f in zip(FEATURES, _features())], hits.alias("confirmed"),
        F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False)).alias("fold")), "described")
    named = described.select("row", F.col("kind").alias("name"), "start", "end", "confirmed", "fold",
                             *[F.col(f"f_{n}").alias(n) for n in FEATURES])
    model, limits = _fit(named)
    # a kind that no base span can confirm is proposed by its assignment alone: its generator decides
    if model is None:
        return rows.select("doc_id", "base", F.col("base").alias("spans"))
    limit = F.lit(None).cast("double")
    for kind, m in limits.items():
        limit = F.when(F.col("name") == kind, F.lit(m)).otherwise(limit)
    limit = F.when(F.col("name") == "secret", F.lit(-1e300)).otherwise(limit)
    chosen = named.where(~F.col("confirmed")).withColumn("margin", model.column()).where(F.col("margin") >= limit - 1e-9)
    place = sum((F.when(F.col("name") == k, i).otherwise(0) for i, k in enumerate(EXTRA_KINDS)), F.lit(0))
    added = chosen.groupBy("row").agg(F.collect_list(F.struct(
        place.cast("int").alias("k"), F.col("name").alias("kind"), "start", "end", "margin")).alias("added"))
    better = lambda a, b: _overlaps(a, b) & (
        (b["margin"] > a["margin"]) | ((b["margin"] == a["margin"]) & (
            (b["start"] < a["start"]) | ((b["start"] == a["start"]) & (b["k"] < a["k"])))))
    kept = F.filter("added", lambda a: ~F.exists("added", lambda b: better(a, b)))
    plain = F.transform(kept, lambda a: F.struct(a["k"].alias("k"), a["kind"].alias("kind"), a["start"].alias("start"), a["end"].alias("end")))
    joined = rows.select("row", "doc_id", "base").join(added, "row", "left")
    empty = F.array().cast("array<struct<k:int,kind:string,start:int,end:int>>")
    return joined.select("doc_id", "base", F.array_sort(F.concat("base", F.coalesce(plain, empty))).alias("spans"))


def pii_report(found: DataFrame) -> DataFrame:
    """Counts of the base kinds, digest of the base spans, all spans as text."""
    ordered = F.array_sort("base")
    said = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    counts = [F.size(F.filter("base", _is_kind(k))).cast("long").alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(said(ordered), 256).alias("base_sha256"), said(F.col("spans")).alias("spans"))
