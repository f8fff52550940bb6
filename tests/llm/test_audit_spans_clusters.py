"""Filter audit, substring dedup and centroid clustering against brute-force versions."""

import hashlib
import itertools
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from frameprep.llm import centroids, filter_audit, queries, substring_dedup
from tests.conftest import SF_SMALL
from tests.llm import fixtures as X

SPACE = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def docs(spark):
    return X.frame(spark).cache()


@pytest.fixture(scope="module")
def whole(spark):
    return [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()]


def rows_of(df):
    return Counter(tuple(r[c] for c in sorted(df.columns)) for r in df.collect())


# --- filter audit ------------------------------------------------------------------


def brute_masks(rows):
    ids = defaultdict(list)
    for i, t, _ in rows:
        ids[t or ""].append(i)
    out = Counter()
    for i, t, part in rows:
        t = t or ""
        w = SPACE.findall(t)
        smaller = any(x is not None and i is not None and x < i for x in ids[t])
        fails = (len(w) < 200, 100 * len(set(w)) < 50 * len(w), 100 * len(re.findall("[A-Z]", t)) > 2 * len(t), bool(re.search("[#$%&*|]", t)), smaller)
        out[(i, sum(f << k for k, f in enumerate(fails)), part or "")] += 1
    return out


def awkward():
    base = X.prose(300, 9)
    rows = [(i, t, f"src{k % 2}") for k, (i, t) in enumerate(X.texts())]
    rows += [(500 + k, base, None if k % 3 else "hot") for k in range(60)]
    rows += [(600, base, "hot"), (600, base, "hot"), (None, base, "hot"), (601, base + "!", "hot"), (602, base[:-1], "hot"), (3, base, None)]
    rows += [(700 + k, base + chr(65 + k % 5) + base, "x" if k % 2 else "") for k in range(20)]
    return rows


@pytest.mark.parametrize("sizes", [{}, {"trie_bytes": 1, "partition_chars": 500, "heavy": 1000, "levels": (1, 4, 30)}, {"heavy": 30, "levels": (8, 64)}])
def test_masks(spark, sizes):
    df = spark.createDataFrame([(i, t, p, 1, "x", 3) for i, t, p in awkward()], "doc_id LONG, text STRING, source STRING, ref INT, part STRING, mask INT").repartition(4)
    assert rows_of(filter_audit.filter_masks(df, **sizes)) == brute_masks(awkward())


def brute_audit(rows, good, bad):
    """One document at a time through every order, as a filter chain would run."""
    docs = [(i, m, p) for (i, m, p), n in brute_masks(rows).items() for _ in range(n)]
    out, shapley = {}, Counter()
    for p in {p for _, _, p in docs}:
        for order in itertools.permutations(range(5)):
            alive = [(i, m) for i, m, q in docs if q == p]
            lost = []
            for k, f in enumerate(order):
                removed = [(i, m) for i, m in alive if m >> f & 1]
                alive = [(i, m) for i, m in alive if not m >> f & 1]
                out[p, "".join("ABCDE"[x] for x in order), k + 1] = (
                    len(alive), len(removed), sum(m >> f & 1 for _, m in lost), sum(m == 1 << f for _, m, q in docs if q == p),
                    sum(i in good for i, _ in removed), sum(i in bad for i, _ in removed))
                lost += removed
                shapley[p, f] += len(removed)
    return {key: (*v, shapley[key[0], "ABCDE".index(key[1][key[2] - 1])]) for key, v in out.items()}


def test_audit(spark):
    rows = awkward()
    df = spark.createDataFrame(rows, "doc_id LONG, text STRING, source STRING")
    marks = [(i, i % 2, int(i % 7 == 0)) for i in range(10, 720)] + [(10, 0, 1), (None, 1, 1), (12, None, None)]
    labels = spark.createDataFrame(marks, "doc_id LONG, quality INT, toxic INT")
    got = {(r["part"], r["filter_order"], r["step"]): (r["kept"], r["removed"], r["redundant"], r["unique_fails"], r["good_lost"], r["toxic_lost"], r["shapley"])
           for r in filter_audit.audit(filter_audit.filter_masks(df), labels).collect()}
    good, bad = {i for i, q, _ in marks if q == 1 and i}, {i for i, _, t in marks if t == 1 and i}
    assert got == brute_audit(rows, good, bad)


def test_audit_of_nothing(spark):
    none = spark.createDataFrame([], "doc_id LONG, text STRING, source STRING")
    labels = spark.createDataFrame([], "doc_id LONG, quality INT, toxic INT")
    assert filter_audit.audit(filter_audit.filter_masks(none), labels).count() == 0
    some = spark.createDataFrame([(1, None, None), (2, "", "")], "doc_id LONG, text STRING, source STRING")
    assert filter_audit.audit(filter_audit.filter_masks(some), labels).where("filter_order = 'EABCD' AND step = 1").first()["removed"] == 1


def test_radix_trie():
    rnd, trie, plain = random.Random(5), filter_audit.RadixTrie(), {}
    for k in range(4000):
        t = bytes(rnd.choices(b"ab", k=rnd.randrange(14))) * rnd.choice((1, 1, 50))
        node = trie.insert(t)
        assert (node[2] is None) == (t not in plain)
        node[2] = plain.setdefault(t, k)
    assert dict(trie.terminals()) == plain
    inner = [n for n in _nodes(trie.root) if n is not trie.root]
    assert all(n[0] and (n[2] is not None or len(n[1]) > 1) for n in inner)  # no chains: it is compressed


def _nodes(node):
    yield node
    for child in node[1].values():
        yield from _nodes(child)


def test_a_hot_opening_is_split(spark):
    same = "x" * 5000
    df = spark.createDataFrame([(k, same + str(k)) for k in range(200)] + [(k, f"{k} other") for k in range(200, 300)], "ref LONG, text STRING")
    keyed = df.withColumn("prefix", filter_audit.adaptive_prefix(df))
    cells = Counter(r["prefix"] for r in keyed.collect())
    assert max(cells.values()) == 1 and len(cells) == 300


# --- substring dedup ---------------------------------------------------------------


def brute_spans(rows, window=13):
    split = [(i, SPACE.findall(t or "")) for i, t in rows]
    first = {}
    for i, w in split:
        if i is not None:
            for k in range(len(w) - window + 1):
                g = tuple(w[k:k + window])
                first[g] = min(i, first.get(g, i))
    out = Counter()
    for i, w in split:
        gone = set()
        for k in range(len(w) - window + 1):
            if i is not None and first[tuple(w[k:k + window])] < i:
                gone.update(range(k, k + window))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out[(i, hashlib.sha256(kept.encode()).hexdigest(), kept, len(gone), len(w))] += 1
    return out


def passages():
    rnd, shared = random.Random(2), [X.words(n, 900 + n) for n in (12, 13, 14, 40, 200)]
    rows = X.texts()
    for k in range(40):  # passages with contexts of their own, in many documents and many orders
        parts = rnd.sample(shared, 3)
        rows.append((1000 - 3 * k if k % 2 else 1000 + k, " ".join(" ".join(X.words(rnd.randrange(20), 5000 + 7 * k + j) + p) for j, p in enumerate(parts))))
    rows += [(2000 + k, "\t".join(X.words(60, 77)[k:k + 30]) + "\x0b\x0c\r\nend  x") for k in range(30)]  # drifting copies
    rows += [(3000, "a b " * 400), (3001, "b a " * 300), (3001, "b a " * 300 + "c"), (2999, "a " * 900), (3002, "a " * 12), (None, "a b " * 400)]
    return rows


@pytest.mark.parametrize("sizes", [{}, {"shard_words": 500, "part_bytes": 5000, "task_bytes": 5000}, {"window": 5, "shard_words": 1000}])
def test_substrings(spark, sizes):
    df = spark.createDataFrame([(i, t, "d", "s", 1) for i, t in passages()], "doc_id LONG, text STRING, doc STRING, sub STRING, at INT").repartition(5)
    assert rows_of(substring_dedup.remove_repeats(df, **sizes)) == brute_spans(passages(), sizes.get("window", 13))


def test_substrings_of_the_table(spark, whole):
    got = substring_dedup.remove_repeats(spark.read.parquet(f"{SF_SMALL}/documents.parquet"))
    want = brute_spans(whole)
    assert rows_of(got) == want and sum(r[3] for r in want) > 1000
    assert rows_of(queries.op12_substring_dedup(spark, SF_SMALL)) == Counter((i, sha, gone, n) for i, sha, _, gone, n in want.elements())


def test_substrings_when_anchors_collide(spark, monkeypatch):
    """With hashes of a few bits the first rounds send windows to wrong documents; later ones find them."""
    real = substring_dedup._anchors
    monkeypatch.setattr(substring_dedup, "_anchors", lambda h, window, turn: real(h, window, turn) & (15 if turn < 3 else -1))
    rows = passages()[-60:]
    df = spark.createDataFrame(rows, "doc_id LONG, text STRING")
    assert rows_of(substring_dedup.remove_repeats(df)) == brute_spans(rows)


def test_substrings_of_nothing(spark):
    none = spark.createDataFrame([], "doc_id LONG, text STRING")
    assert substring_dedup.remove_repeats(none).count() == 0
    with pytest.raises(ValueError):
        substring_dedup.remove_repeats(none, window=4)


def test_matching_statistics():
    rnd = random.Random(8)
    for _ in range(60):
        texts = [rnd.choices("abc", k=rnd.randrange(30)) for _ in range(3)]
        held = {tuple(t[a:b]) for t in texts for a in range(len(t)) for b in range(a + 1, len(t) + 1)}
        query = rnd.choices("abcd", k=40)
        want = [max([n for n in range(1, k + 2) if tuple(query[k + 1 - n:k + 1]) in held], default=0) for k in range(40)]
        assert substring_dedup.SuffixAutomaton(texts).matching_statistics(query) == want


# --- centroid clustering -----------------------------------------------------------


def brute_clusters(rows, k, rounds, width, scale=256):
    kept = [(i, tuple(int(np.floor(scale * float(x))) for x in v)) for i, v in rows
            if v is not None and len(v) == width and all(x is not None and np.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"2:{r[0]}".encode()).hexdigest(), np.array(r[1], "<i4").tobytes()))
    cents = [v for _, v in order[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c)), n) for n, c in enumerate(cents))
    for _ in range(rounds):
        groups = defaultdict(list)
        for _, v in kept:
            groups[near(v)[1]].append(v)
        cents = [tuple(sum(x) // len(x) for x in zip(*groups[n])) if groups[n] else c for n, c in enumerate(cents)]
    got = [(i, *near(v)) for i, v in kept]
    inertia = Counter()
    for _, d, n in got:
        inertia[n] += d
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in cents]
    return Counter((sha[n], n, inertia[n], d, sum(inertia.values()), i) for i, d, n in got)


def vectors():
    rnd = np.random.default_rng(4)
    rows = [(k, [float(x) for x in rnd.normal(k % 4, 0.3, 6)]) for k in range(300)]
    rows += [(k, [1.0, 1.0, 1.0, 1.0, 1.0, 1.0]) for k in range(300, 360)] + [(5, rows[5][1]), (5, [0.0] * 6), (5, [0.5] * 6), (None, [2.0] * 6)]
    rows += [(400, None), (401, []), (402, [1.0] * 5), (403, [1.0] * 7), (404, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (405, [float("nan")] * 6),
             (406, [float("inf")] + [0.0] * 5), (407, [-500_000.0] * 3 + [500_000.0] * 3), (408, [-1e-9] * 6)]
    return rows


@pytest.mark.parametrize("k, rounds", [(7, 3), (1, 1), (400, 2), (12, 0)])
def test_clusters(spark, k, rounds):
    df = spark.createDataFrame([(i, v, 1, "c") for i, v in vectors()], "vec_id LONG, embedding ARRAY<DOUBLE>, cluster INT, vec STRING").repartition(3)
    assert rows_of(centroids.cluster_vectors(df, k=k, rounds=rounds, width=6)) == brute_clusters(vectors(), k, rounds, 6)


def test_clusters_of_nothing_and_too_large(spark):
    schema = "vec_id LONG, embedding ARRAY<FLOAT>"
    assert centroids.cluster_vectors(spark.createDataFrame([], schema)).count() == 0
    assert centroids.cluster_vectors(spark.createDataFrame([(1, None), (2, [1.0])], schema)).count() == 0
    with pytest.raises(Exception, match="after scaling"):
        centroids.cluster_vectors(spark.createDataFrame([(1, [1e30] * 64)], schema)).count()


def test_clusters_of_the_table(spark):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{SF_SMALL}/embeddings.parquet").collect()]
    assert rows_of(queries.op13_centroid_clustering(spark, SF_SMALL)) == brute_clusters(rows, 40, 5, 64)


def test_the_search_rejects_without_measuring():
    rnd = np.random.default_rng(1)
    cents = np.floor(rnd.normal(0, 40, (40, 64)) + rnd.normal(0, 30, (40, 1))).astype(np.int64)
    x = cents[rnd.integers(0, 40, 3000)] + np.floor(rnd.normal(0, 12, (3000, 64))).astype(np.int64)
    search = centroids.EqualAverageSearch(cents)
    who, distance = search.nearest(x)
    all_distances = ((x[:, None] - cents[None]) ** 2).sum(axis=2)
    assert (who == all_distances.argmin(axis=1)).all() and (distance == all_distances.min(axis=1)).all()
    assert search.measured < 0.35 * len(x) * len(cents)
