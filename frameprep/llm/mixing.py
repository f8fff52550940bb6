"""Mixing sources to target weights by soft membership, in DataFrame operations only.

A naive-Bayes classifier learns domains from labelled rows and gives every
document a posterior over the domains, so a document counts for several at once.
Distributed projected-gradient least squares then fits one nonnegative rate per
document such that the expected tokens of each domain (sum of rate * tokens *
posterior) match the targets. A step needs one aggregate with one number per
domain; the step direction of a document is its own posterior times the
residuals, so no document vector ever leaves its row. Steps are scaled by the
domains' current totals (a diagonal preconditioner under which a step of one is
stable), so a few dozen suffice.

Training takes the texts of at most ``TRAIN_ROWS`` labelled rows (drawn by a hash
of the id, their ids are broadcast) and keeps the ``TERMS`` most frequent words:
both bounds are fixed, so the model that is broadcast is small. Posteriors, token
totals and rates cover every document.

Cases: a null text counts as empty: no tokens, posterior = the prior, its rate
moves nothing; targets of zero push a domain's documents to rate zero; rows
repeat as they are; extra columns are ignored; an empty table gives none. Rows
whose domain is not a target do not train.
"""

from __future__ import annotations

import math
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from frameprep.llm.common import release, staged, text_or_empty

TRAIN_ROWS = 10_000
TERMS = 4_000
EVIDENCE = 40.0  # tokens whose evidence a posterior may count at most
STEPS, RESTAGE = 40, 8
CLOSE = 1e-4  # stop when every domain is this near its target, relatively


def _words(text: Column) -> Column:
    return F.split(F.lower(text), r"[\s.,;:!?|]+")


def _terms(train: DataFrame, domains: list[str]) -> DataFrame:
    """term, l0.. : log P(term | domain) of the most frequent terms (at most TERMS rows)."""
    words = train.select("domain", F.explode(_words(F.col("text"))).alias("term")).where(F.col("term") != "")
    per = [F.sum(F.when(F.col("domain") == d, 1).otherwise(0)).alias(f"n{k}") for k, d in enumerate(domains)]
    counts = words.groupBy("term").agg(F.count(F.lit(1)).alias("n"), *per)
    top = staged(counts.orderBy(F.desc("n"), "term").limit(TERMS), "terms")
    sums = top.agg(*[F.sum(f"n{k}").alias(f"n{k}") for k in range(len(domains))]).first()
    return top.select("term", *[
        F.log((F.col(f"n{k}") + 0.5) / F.lit(float((sums[f"n{k}"] or 0) + 0.5 * TERMS))).alias(f"l{k}") for k in range(len(domains))])


def posteriors(docs: DataFrame, labelled: DataFrame, domains: list[str], domain_col: str, id_col: str = "doc_id",
               text_col: str = "text") -> DataFrame:
    """row, doc_id, n_tokens, p0.. : posterior of each of ``domains`` for every document.

    ``labelled`` has the ids of the rows whose ``domain_col`` may be trusted."""
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(domain_col).cast("string").alias("domain"),
                      text_or_empty(text_col).alias("text"))
    known = labelled.select(F.col(id_col).cast("long").alias("doc_id")).where("doc_id is not null").distinct()
    # a draw by hash first, so that about TRAIN_ROWS ids are sorted and not all
    share = int(1_000_000 * min(1.0, 1.2 * TRAIN_ROWS / max(1, known.count()))) + 1
    sample = known.where(F.pmod(F.xxhash64("doc_id", F.lit("fit")), F.lit(1_000_000)) < share).orderBy(
        F.xxhash64("doc_id"), "doc_id").limit(TRAIN_ROWS)
    train = src.where(F.col("domain").isin(domains)).join(F.broadcast(sample), "doc_id")
    terms = _terms(train.select("domain", "text"), domains)
    seen = {r["domain"]: r["n"] for r in train.groupBy("domain").agg(F.count(F.lit(1)).alias("n")).collect()}
    total = sum(seen.values()) + len(domains)
    # one row per word inside the scan; sums per document are formed before the shuffle
    words = src.withColumn("row", F.monotonically_increasing_id()).select(
        "row", "doc_id", F.explode(_words(F.col("text"))).alias("term")).join(F.broadcast(terms), "term", "left")
    evidence = words.groupBy("row").agg(
        F.max("doc_id").alias("doc_id"), F.sum(F.when(F.col("term") != "", 1).otherwise(0)).cast("long").alias("n_tokens"),
        *[F.coalesce(F.sum(f"l{k}"), F.lit(0.0)).alias(f"e{k}") for k in range(len(domains))],
        F.count("l0").alias("hits"))
    temper = F.least(F.lit(1.0), F.lit(EVIDENCE) / F.greatest("hits", F.lit(1)))
    score = [F.col(f"e{k}") * temper + F.lit(math.log((seen.get(d, 0) + 1) / total)) for k, d in enumerate(domains)]
    scored = evidence.select("row", "doc_id", "n_tokens", *[s.alias(f"s{k}") for k, s in enumerate(score)])
    s = [F.col(f"s{k}") for k in range(len(domains))]
    top = F.greatest(*s) if len(s) > 1 else s[0]
    weights = [F.exp(x - top) for x in s]
    whole = sum(weights[1:], weights[0])
    return staged(scored.select("row", "doc_id", "n_tokens", *[(w / whole).alias(f"p{k}") for k, w in enumerate(weights)]), "posteriors")


def fit_rates(members: DataFrame, targets: list[float], least: float = 0.0) -> DataFrame:
    """``members`` and a column ``rate``: ``least`` or more, expected domain tokens near ``targets``."""
    d = len(targets)
    p = [F.col(f"p{k}") for k in range(d)]
    sums = lambda df: [r or 0.0 for r in df.agg(*[
        F.sum(F.col("rate") * F.col("n_tokens") * x).alias(f"t{k}") for k, x in enumerate(p)]).first()]
    base = members.withColumn("rate", F.lit(1.0))
    start = sums(base)
    scale = [max(s, 1.0) for s in start]
    now, frames = base, []
    for step in range(STEPS):
        have = sums(now) if step else start
        miss = [(h - t) / s for h, t, s in zip(have, targets, scale)]
        if max(abs(h - t) / max(t, 1.0) for h, t in zip(have, targets)) < CLOSE:
            break
        move = sum((x * F.lit(m) for x, m in zip(p[1:], miss[1:])), p[0] * F.lit(miss[0]))
        now = now.withColumn("rate", F.greatest(F.lit(least), F.col("rate") - move))
        if step % RESTAGE == RESTAGE - 1:
            now = staged(now, "rates")
            release(*frames)
            frames = [now]
    return now


def soft_mix(docs: DataFrame, labelled: DataFrame, targets: Mapping[str, float], domain_col: str, total: float | None = None,
             id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, domain (the likeliest), membership (its posterior), rate of every document.

    ``targets`` are weights of the domains; ``total`` is the token total they
    share out (the tokens of ``docs`` when not given)."""
    domains = sorted(targets)
    members = posteriors(docs, labelled, domains, domain_col, id_col, text_col)
    tokens = total if total is not None else float(members.agg(F.sum("n_tokens")).first()[0] or 0)
    whole = sum(targets.values()) or 1.0
    fitted = fit_rates(members, [tokens * targets[d] / whole for d in domains])
    best = F.array_max(F.array(*[F.struct(F.col(f"p{k}").alias("p"), F.lit(d).alias("d")) for k, d in enumerate(domains)]))
    return fitted.select("doc_id", "n_tokens", best["d"].alias("domain"), best["p"].alias("membership"), "rate")


def tempered_targets(members: DataFrame, domains: list[str], power: float) -> list[float]:
    """Token targets in proportion to the domains' totals to a power under one,
    scaled so that no domain has to shrink."""
    have = members.agg(*[F.sum(F.col("n_tokens") * F.col(f"p{k}")).alias(f"t{k}") for k in range(len(domains))]).first()
    totals = [h or 0.0 for h in have]
    raw = [t ** power if t > 0 else 0.0 for t in totals]
    grow = max((t / r for t, r in zip(totals, raw) if r), default=0.0)
    return [r * grow for r in raw]


def mix_rows(docs: DataFrame, labelled: DataFrame, domain_col: str, power: float = 0.8, id_col: str = "doc_id") -> DataFrame:
    """``docs`` with every row as often as its fitted rate says; columns unchanged.

    Targets temper the domains' token totals upwards, so small domains repeat. Rates
    are at least one: no document is lost, also where documents of mixed membership
    lift a domain over its target. A row without a rate (no domains at all) stays once."""
    names = docs.select(F.col(domain_col).cast("string").alias("d")).where("d is not null").distinct().collect()
    domains = sorted(r["d"] for r in names)
    if not domains:
        return docs
    members = posteriors(docs, labelled, domains, domain_col, id_col)
    fitted = fit_rates(members, tempered_targets(members, domains, power), least=1.0)
    rates = fitted.groupBy(F.col("doc_id").alias("rated")).agg(F.avg("rate").alias("rate"))
    whole = docs.select(F.struct("*").alias("doc"), F.col(id_col).cast("long").alias("i"))
    copies = F.coalesce(copies_of(F.col("rate"), F.col("i")), F.lit(1))
    joined = whole.join(rates, F.col("i").eqNullSafe(F.col("rated")), "left").withColumn("copies", copies).where("copies > 0")
    return joined.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("doc.*")


def copies_of(rate: Column, key: Column) -> Column:
    """Whole copies with the rate as expectation; the draw is a hash of the key."""
    draw = F.pmod(F.xxhash64(key, F.lit("mix")), F.lit(1_000_003)) / F.lit(1_000_003.0)
    return F.floor(rate + draw).cast("int")
