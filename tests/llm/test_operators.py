"""Every operator against a brute-force version on awkward rows and on a whole small table."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from frameprep.llm import (byte_bpe, common, components, exact_dedup, jaccard_join, language_model, licenses, line_dedup, mixing, pii, quality,
                           queries, topk)
from tests.conftest import SF_ORACLE, SF_SMALL
from tests.llm import fixtures as X

RANKS = byte_bpe.load_ranks(public_tokenizers.path(queries.TOKENIZER))
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.fixture(scope="module")
def docs(spark):
    return X.frame(spark).cache()


@pytest.fixture(scope="module")
def whole(spark):
    return [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()]


@pytest.fixture(scope="module")
def nothing(spark):
    return X.frame(spark, [])


def rows_of(df, *names):
    return Counter(tuple(r[n] for n in names) for r in df.collect())


# --- exact dedup -------------------------------------------------------------------


def brute_dedup(rows):
    by = defaultdict(list)
    for i, t in rows:
        by[(t or "").translate(LOWER)].append(i)
    out = Counter()
    for i, t in rows:
        text = (t or "").translate(LOWER)
        ids = by[text]
        keep = max((x for x in ids if x is not None), default=None)
        out[(i, keep, len(ids), i == keep, hashlib.sha256(text.encode()).hexdigest())] += 1
    return out


@pytest.mark.parametrize("block", [3, 64, exact_dedup.BLOCK_BYTES])
def test_exact_dedup(docs, block):
    got = rows_of(exact_dedup.exact_dedup(docs, block_bytes=block) if block > 3 else exact_dedup.exact_dedup(
        docs.where(F.length("text") < 1500), block_bytes=block), "doc_id", "keep_id", "group_size", "kept", "text_sha256")
    rows = X.texts() if block > 3 else [(i, t) for i, t in X.texts() if t is not None and len(t) < 1500]
    assert got == brute_dedup(rows)


def test_exact_dedup_query(spark, whole):
    got = rows_of(queries.op10_exact_dedup(spark, SF_SMALL), "doc_id", "keep_id", "group_size", "kept", "text_sha256")
    assert got == brute_dedup(whole)


def test_block_names_survive_digests_that_collide(spark, monkeypatch):
    real = exact_dedup._digest
    monkeypatch.setattr(exact_dedup, "_digest", lambda b, salt: real(b, salt)[:1] if salt < 1 else real(b, salt))
    texts = spark.createDataFrame([(str(k),) for k in range(600)], "text STRING")
    names, salt = exact_dedup.block_names(texts)
    assert salt == 1 and names.count() == 600


def test_kept_rows(docs, nothing):
    out = exact_dedup.keep_one_per_text(docs)
    assert out.columns == docs.columns
    kept = [(r["doc_id"], r["text"]) for r in out.collect()]
    normal = [(t or "").translate(LOWER) for _, t in kept]
    assert len(normal) == len(set(normal)) == len({(t or "").translate(LOWER) for _, t in X.texts()})
    assert exact_dedup.keep_one_per_text(nothing).count() == 0 and exact_dedup.exact_dedup(nothing).count() == 0


# --- byte-level BPE ------------------------------------------------------------------


def brute_bpe(rows):
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})
    out = Counter()
    for i, t in rows:
        ids = np.array(enc.encode_ordinary(t or ""), dtype="<u4")
        out[(i, len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest())] += 1
    return out


def test_bpe_equals_the_library(spark, docs, whole, nothing):
    cols = ("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
    assert rows_of(byte_bpe.encode_digests(docs, RANKS, public_tokenizers.PATTERN), *cols) == brute_bpe(X.texts())
    assert rows_of(queries.op7_byte_bpe(spark, SF_SMALL), *cols) == brute_bpe(whole)
    assert byte_bpe.encode_digests(nothing, RANKS, public_tokenizers.PATTERN).count() == 0


def test_bpe_round_trip(docs):
    ids = byte_bpe.encode(docs, RANKS, public_tokenizers.PATTERN)
    back = byte_bpe.decode(ids, RANKS, public_tokenizers.PATTERN)
    assert Counter((r["doc_id"], bytes(r["bytes"]).decode()) for r in back.collect()) == Counter((i, t or "") for i, t in X.texts())


def test_bpe_merges_of_odd_strings():
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})
    codec, rnd = byte_bpe.Codec(RANKS, public_tokenizers.PATTERN), random.Random(3)
    odd = ["".join(rnd.choice(a) for _ in range(rnd.randrange(600))) for a in
           ("ab", "aéßñ \n\t'ts!?0129", "abcdefghij", "a", "\x1c\x1f  x.,日本語🙂", "ABCabc123 ") for _ in range(60)]
    odd += ["a" * 20_000, " " * 3000, "ab" * 7000, "", "퟿"]
    assert [np.frombuffer(p, "<u4").tolist() for p in codec.encode_all(odd)] == [enc.encode_ordinary(t) for t in odd]


# --- licences --------------------------------------------------------------------------


def brute_licenses(rows):
    out = Counter()
    for i, t in rows:
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))
        hits = [(k, label) for phrase, label in licenses.BASE_PHRASES.items() for k in range(len(w))
                if w[k:k + len(phrase.split())] == phrase.split()]
        starts = [k for k, _ in hits]
        out[(i, len(w), len(hits), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in hits})))] += 1
    return out


def test_license_scan(spark, docs, whole, nothing):
    cols = ("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")
    got = licenses.license_report(licenses.license_scan(docs))
    assert rows_of(got, *cols) == brute_licenses(X.texts())
    said = {r["doc_id"]: r for r in got.collect()}
    assert said[70]["labels"] == "apache,apache-2.0,mit" and said[71]["base_labels"] == "gpl,mit"
    assert all(0 <= r["score"] <= 1 and set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(",")) for r in said.values())
    assert rows_of(queries.op1_license_scan(spark, SF_SMALL), *cols) == brute_licenses(whole)
    assert licenses.license_report(licenses.license_scan(nothing)).count() == 0


def test_license_index_finds_stretched_texts():
    idf = defaultdict(lambda: 1.0)
    index = licenses.RareTokenIndex(list(licenses.TEMPLATES), idf)
    text = "x permission is hereby granted free of all charge to any person obtaining a copy of this software y"
    places, score = index.scan(licenses.words_of(text))
    assert {licenses.TEMPLATES[k].label for k, _ in places} == {"mit-text"} and score > 0.9
    assert index.scan(licenses.words_of("permission is hereby refused to any person"))[0] == []


def brute_alignments(template, idf, words):
    """Every start where all of the text's rarest words of the template and its key phrases stand."""
    t = template.text.encode().split()
    keys = [k.encode().split() for k in template.keys]
    shared = sorted(set(t) & set(words), key=lambda w: (-idf[w], w))
    outside = [w for w in shared if not any(w in k for k in keys)]
    rare = shared[:3]
    if set(t) - {w for k in keys for w in k}:
        if not outside:
            return []
        rare += outside[:1] if not set(outside) & set(rare) else []
    if len(rare) < min(3, len(set(t))):
        return []
    near = lambda s, slot: abs(slot - s) <= licenses.SLACK
    agree = lambda s, w: any(near(s, p - q) for q in range(len(t)) if t[q] == w for p in range(len(words)) if words[p] == w)
    stands = lambda s, k: any(words[p:p + len(k)] == k and near(s, p - next(i for i in range(len(t)) if t[i:i + len(k)] == k))
                              for p in range(len(words)))
    starts = [p - q for q in range(len(t)) if t[q] == rare[0] for p in range(len(words)) if words[p] == rare[0]]
    return [s for s in sorted(set(starts)) if all(agree(s, w) for w in rare) and all(stands(s, k) for k in keys)]


def test_license_alignments_are_intersected():
    rnd = random.Random(5)
    vocabulary = sorted({w for t in licenses.TEMPLATES for w in t.text.encode().split()})
    idf = {w: rnd.random() * 9 for w in vocabulary}
    index = licenses.RareTokenIndex(list(licenses.TEMPLATES), idf)
    found = 0
    for _ in range(600):
        words = [rnd.choice(vocabulary + [b"zz"] * 40) for _ in range(rnd.randint(0, 30))]
        for t in rnd.sample(licenses.TEMPLATES, rnd.randint(0, 2)):
            part = t.text.encode().split()
            for _ in range(rnd.choice([0, 0, 1, 2])):
                part.insert(rnd.randint(0, len(part)), b"zz") if rnd.random() < 0.6 else part.pop(rnd.randrange(len(part)))
            at = rnd.randint(0, len(words))
            words[at:at] = part
        got = {k for k, _ in index.scan(words)[0]}
        assert got == {k for k, t in enumerate(licenses.TEMPLATES) if brute_alignments(t, idf, words)}
        found += len(got)
    assert found > 200


def test_one_rare_word_gets_no_license_label():
    index = licenses.RareTokenIndex(list(licenses.TEMPLATES), defaultdict(lambda: 1.0))
    said = lambda text: {licenses.TEMPLATES[k].label for k, _ in index.scan(licenses.words_of(text))[0]}
    for text in ("redistribution", "unencumbered", "", "source and binary forms with or without modification",
                 "redistribution " + "x " * 30 + "source and binary forms with or without modification"):
        assert said(text) == set()
    assert said("Redistribution and use in source and binary forms, with or without modification, are permitted") == {"bsd"}
    assert said("GNU General Public License, version 3") == {"gpl-3.0"} and said("Apache License, Version 2.0") == {"apache-2.0"}


# --- top-k ------------------------------------------------------------------------------


def brute_top_k(rows, is_query, k):
    ok = [(i, np.floor(1024 * np.array(v, dtype=float))) for i, v in rows
          if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    width = max((len(v) for _, v in ok), default=0)
    ok = [(i, np.pad(v, (0, width - len(v)))) for i, v in ok]
    out = []
    for q, a in ok:
        if is_query(q):
            best = sorted((-int(a @ b), i) for i, b in ok if i != q)[:k]
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(best)]
    return Counter(out)


@pytest.mark.parametrize("sizes", [(7, 3), (16_384, 2_048)])
def test_top_k(spark, sizes):
    rnd = np.random.default_rng(5)
    rows = [(i, [float(x) for x in rnd.normal(size=6)]) for i in range(120)]
    rows += [(200 + i, [0.5, 0.5, -0.25, 0.0, 1.0, 0.125]) for i in range(60)]  # ties: one vector, many ids
    rows += [(400, None), (401, [None, 1.0]), (402, [float("nan")] * 6), (403, [float("inf")] * 6), (404, []), (405, [1.0, 2.0]), (None, [1.0] * 6)]
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id BIGINT, embedding ARRAY<DOUBLE>, score INT, qb STRING")
    got = topk.exact_top_k(df, F.col("vec_id") % 20 == 0, 10, candidate_block=sizes[0], query_block=sizes[1])
    assert rows_of(got, "query_id", "rank", "vec_id", "score") == brute_top_k(rows, lambda i: i % 20 == 0, 10)
    few = df.where("vec_id < 4")
    assert topk.exact_top_k(few, F.col("vec_id") == 0).count() == 3
    assert topk.exact_top_k(df.where("false"), F.col("vec_id") == 0).count() == 0


@pytest.mark.parametrize("sizes", [(25, 3), (16_384, 2_048)])
def test_top_k_with_repeated_ids(spark, sizes):
    rnd = random.Random(12)
    vec = lambda: [rnd.randrange(-3, 4) / 4 for _ in range(4)]
    rows = [(0, [1.0, 1.0, 0.0, 0.0]), (0, [1.0, 1.0, 0.0, 0.0])] + [(i, [1.0, 1.0, 0.0, 0.0]) for i in range(1, 13)]
    rows += [(20, vec()) for _ in range(15)] + [(5, [1.0, 1.0, 0.0, 0.0])] * 14 + [(40, [2.0, 2.0, 0.0, 0.0])] * 3 + [(k, vec()) for k in range(100, 160)]
    df = spark.createDataFrame(rows, "vec_id LONG, embedding ARRAY<DOUBLE>").repartition(3)
    for k in (1, 10):
        got = topk.exact_top_k(df, F.col("vec_id") % 20 == 0, k, candidate_block=sizes[0], query_block=sizes[1])
        assert rows_of(got, "query_id", "rank", "vec_id", "score") == brute_top_k(rows, lambda i: i % 20 == 0, k)


def test_top_k_stops_early_and_stays_exact(spark):
    rnd = np.random.default_rng(6)
    x = np.floor(rnd.normal(size=(3000, 5)) ** 3 * 100).astype("<i8")
    lists = topk.SortedLists(np.arange(3000), x, 10)
    queries_ = np.floor(rnd.normal(size=(100, 5)) * 50)
    for q, got in zip(queries_, lists.best(np.full(100, -1), queries_)):
        want = sorted((-int(s), i) for i, s in enumerate(x @ q.astype("<i8")))[:10]
        assert got == [(-s, i) for s, i in want]
    far = [(k, [float(k) * 1e7 + j for j in range(3)]) for k in range(40)]  # sums beyond exact floats
    df = spark.createDataFrame(far, "vec_id BIGINT, embedding ARRAY<DOUBLE>")
    best = topk.exact_top_k(df, F.col("vec_id") == 3, 2, scale=1, candidate_block=100, query_block=10).collect()
    assert {r["vec_id"] for r in best} == {38, 39}


# --- n-gram Jaccard join --------------------------------------------------------------------


def brute_links(rows, threshold=0.8):
    shingle = jaccard_join.Shingler()
    sets = [set(shingle(t).tolist()) for _, t in rows]
    root, links = list(range(len(rows))), [0] * len(rows)

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    at = defaultdict(list)
    for k, s in enumerate(sets):
        for x in s:
            at[x].append(k)
    for k, s in enumerate(sets):
        for j, n in Counter(j for x in s for j in at[x] if j > k).items():
            if n >= threshold * (len(s) + len(sets[j]) - n) - 1e-9:
                links[k], links[j] = links[k] + 1, links[j] + 1
                a, b = find(k), find(j)
                root[max(a, b)] = min(a, b)
    size = Counter(find(k) for k in range(len(rows)))
    low = {}
    for k, (i, _) in enumerate(rows):
        r = find(k)
        if i is not None:
            low[r] = min(low.get(r, i), i)
    return Counter((i, low.get(find(k)), size[find(k)], links[k]) for k, (i, _) in enumerate(rows))


CLASSES = ("doc_id", "class_id", "class_size", "n_links")


def test_jaccard_join(spark, docs, whole, nothing):
    assert rows_of(jaccard_join.jaccard_join(docs), *CLASSES) == brute_links(X.texts())
    assert rows_of(queries.op4_ngram_jaccard_join(spark, SF_SMALL), *CLASSES) == brute_links(whole)
    assert jaccard_join.jaccard_join(nothing).count() == 0


def test_jaccard_join_of_a_large_group_of_near_copies(spark, monkeypatch):
    base = X.prose(200, 7)
    rows = [(k, X.changed(X.changed(base, k), 3 * k + 1)) for k in range(150)] + [(900 + k, X.prose(150, k)) for k in range(20)]
    monkeypatch.setattr(jaccard_join, "BIN_SHINGLES", 4000)  # the group is cut into pairs of parts
    df = spark.createDataFrame(rows, "doc_id BIGINT, text STRING")
    assert rows_of(jaccard_join.jaccard_join(df), *CLASSES) == brute_links(rows)


def test_prefixes_shorten_to_the_target_recall():
    d = jaccard_join.shortest_prefix(0.8)
    assert 1 - (1 - 0.8 ** d) ** jaccard_join.TREES >= jaccard_join.RECALL
    assert jaccard_join.shortest_prefix(0.95) > d
    depths = jaccard_join.matched_depths(0.8)
    assert depths[0] == jaccard_join.DEPTH and depths[-1] == d and depths == sorted(set(depths), reverse=True)


def test_one_row_per_class(docs):
    out = jaccard_join.keep_one_per_class(docs)
    assert out.columns == docs.columns
    left = [(r["doc_id"], r["text"]) for r in out.collect()]
    ids = {i for i, _ in left}
    assert 30 in ids and not ids & {31, 32, 33, 34} and {40, 41, 42, 43, 45, 51} <= ids


def test_one_row_per_class_with_repeated_and_null_ids(spark):
    a, b = X.prose(150, 1), X.prose(90, 2)
    near, far, other = X.changed(a, 30), X.prose(80, 3), X.prose(70, 4)
    rows = [(1, a), (5, near), (5, far), (None, a), (None, near), (None, other), (7, b), (7, b), (7, X.changed(b, 20)), (9, far),
            (8, None), (8, None), (None, ""), (None, "")]
    left = Counter((r["doc_id"], r["text"]) for r in jaccard_join.keep_one_per_class(X.frame(spark, rows)).collect())
    seven = [t for i, t in left if i == 7]
    assert len(seven) == 1 and seven[0] in (b, X.changed(b, 20))
    assert left == Counter([(1, a), (5, far), (None, other), (7, seven[0]), (8, None), (8, None), (None, ""), (None, "")])


def test_components_of_long_chains(spark):
    n = 300
    edges = [(k, k + 1) for k in range(n)] + [(1000, 1001), (1001, 1002), (1002, 1000), (7, 7)]
    random.Random(1).shuffle(edges)
    got = {r["node"]: r["comp"] for r in components.components(spark.createDataFrame(edges, "a BIGINT, b BIGINT")).collect()}
    assert {got[k] for k in range(n + 1)} == {0} and {got[k] for k in (1000, 1001, 1002)} == {1000}


# --- language model ----------------------------------------------------------------------------


def brute_base(rows, held):
    token = lambda t: re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER)) + [None]
    c = Counter(w for i, t in rows if not held(i) for w in token(t))
    n, v = sum(c.values()), len(c)
    return Counter((i, held(i), len(token(t)), sum(c[w] > 0 for w in token(t)), n,
                    round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in token(t)), 4)) for i, t in rows)


def is_held(i):
    import zlib

    return i is not None and zlib.crc32(str(i).encode()) % 7 == 2


def held():
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2


@pytest.mark.parametrize("common", [40, 1 << 17])
def test_lm_base_score(docs, nothing, common):
    got = language_model.lm_score(docs, held(), steps=2, common=common)
    seen = Counter((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 4)) for r in got.collect())
    assert seen == brute_base(X.texts(), is_held)
    assert language_model.lm_score(nothing, held(), steps=1).count() == 0


def test_lm_query_beats_the_base_on_held_out_texts(spark, whole):
    got = queries.op6_lm_score(spark, SF_SMALL).collect()
    seen = Counter((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 4)) for r in got)
    assert seen == brute_base(whole, is_held)
    assert all(math.isfinite(r["score"]) and r["score"] <= 0 for r in got)
    assert sum(r["score"] for r in got if r["held_out"]) > sum(r["base_score"] for r in got if r["held_out"])


def test_lm_probabilities_sum_to_one(spark, docs):
    texts = docs.select(F.coalesce("text", F.lit("")).alias("text"))
    counts = language_model.token_counts(texts)
    vocab = language_model.vocabulary(counts, 50)
    weights = language_model.train(texts, vocab, 3)
    codes = np.array([0, 12345, language_model.START])
    assert np.allclose(np.exp(language_model._log_softmax(weights, codes)).sum(axis=1), 1)
    inside = Counter()
    for r in counts.collect():
        k = vocab.class_of(bytes(r["token"]))
        inside[k] += r["c"] if k <= language_model.OWN_CLASSES else r["c"] + 1
    for k, total in inside.items():  # with one more for the unseen token of a spelling class
        whole = vocab.class_n[k] + (vocab.class_v[k] if k > language_model.OWN_CLASSES else 0)
        assert total == whole


def test_lm_history_tells_words_of_one_class_apart(spark):
    by_class = defaultdict(list)
    for k in range(2000):
        by_class[language_model.spelling_class(b"w%d" % k)].append(f"w{k}")
    (w, x), (a, b) = [v[:2] for v in list(by_class.values())[:2]]  # w and x are of one class, a and b too
    frequent = [f"f{k}" for k in range(language_model.OWN_CLASSES + 1)] * 3
    text = " ".join(frequent + [w, a] + frequent + [x, b] + frequent)
    rows = [(k, text) for k in range(150)] + [(1000, f"{w} {a}"), (1001, f"{w} {b}"), (1002, f"{x} {b}"), (1003, f"{x} {a}")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r for r in language_model.lm_score(docs, F.col("doc_id") >= 1000).collect()}
    assert math.isclose(got[1000]["base_score"], got[1001]["base_score"])  # the same counts
    assert got[1000]["score"] + got[1002]["score"] > got[1001]["score"] + got[1003]["score"] + 0.3  # equal, were histories classes


def test_lm_probabilities_of_all_tokens_sum_to_one(spark, docs):
    texts = docs.select(F.coalesce("text", F.lit("")).alias("text"))
    counts = language_model.token_counts(texts)
    vocab = language_model.vocabulary(counts, 300)
    weights = language_model.train(texts, vocab, 2)
    every = np.arange(language_model.CLASSES)
    for history in (0, 5, 7 << language_model.WORD_BITS | 3, language_model.START):
        code = np.array([history])
        p = np.exp(language_model._log_softmax(weights, code)[0].astype(float))
        inner = np.exp(language_model._log_members(weights, np.repeat(code, language_model.CLASSES), every).astype(float))
        total, last = 0.0, language_model.MEMBERS
        for r in counts.collect():
            word = vocab.words([bytes(r["token"])])[0][0]
            k, outcome = vocab.classes[word], vocab.outcomes[word]
            share = 1.0 if k <= language_model.OWN_CLASSES else inner[k, outcome]
            total += p[k] * share * ((r["c"] + 1) / vocab.member_n[k, last] if k > language_model.OWN_CLASSES and outcome == last else 1.0)
        spelt = every > language_model.OWN_CLASSES  # one slot for the unseen tokens of each
        total += (p * inner[:, last] / vocab.member_n[:, last])[spelt].sum()
        own = {vocab.class_of(t) for t in vocab.own}
        total += sum(p[k] for k in every[~spelt] if k not in own)  # small tables leave classes without a word
        assert math.isclose(total, 1, rel_tol=1e-4)


def test_lm_context_is_worth_three_times_that_of_classes(spark):
    got = [r for r in queries.op6_lm_score(spark, SF_ORACLE).collect() if r["held_out"]]
    gain = sum(r["score"] - r["base_score"] for r in got) / sum(r["n_tokens"] for r in got)
    assert gain > 0.159  # log10 a token; histories of classes gave 0.053


def test_lm_passes_over_a_large_corpus_as_often_as_over_a_small_one(spark, docs, monkeypatch):
    texts = docs.select(F.coalesce("text", F.lit("")).alias("text"))
    vocab = language_model.vocabulary(language_model.token_counts(texts), 300)
    vocab.n = 1 << 23  # as many tokens as a larger corpus has
    seen, learner = spark.sparkContext.accumulator(0), language_model._learner

    def counted(shared, now):
        learn = learner(shared, now)

        def run(batches):
            def told():
                for batch in batches:
                    seen.add(batch.num_rows)
                    yield batch
            return learn(told())
        return run

    monkeypatch.setattr(language_model, "_learner", counted)
    language_model.train(texts, vocab, 3)
    assert seen.value == 3 * docs.count()  # once, when the passes were cut to some number of tokens


# --- quality ---------------------------------------------------------------------------------------


def test_quality_query_on_held_out_labels(spark):
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF_SMALL}/labels.parquet").collect()}
    got = queries.op8_quality(spark, SF_SMALL).collect()
    import zlib

    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in got)
    known = [(r["predicted"], labels[r["doc_id"]]) for r in got if r["doc_id"] in labels]
    assert np.mean([p == q for p, q in known]) > 0.9
    assert np.mean([p for p, q in known if q == 1]) > 0.97


def test_quality_without_labels_and_on_awkward_rows(spark, docs, nothing):
    none = spark.createDataFrame([], "doc_id BIGINT, quality INT")
    assert {round(r["score"], 6) for r in quality.score_quality(docs, none).collect()} == {0.5}
    one = quality.score_quality(docs, X.labels(spark)).collect()
    assert len(one) == len(X.texts()) and all(r["predicted"] == 1 for r in one)
    assert quality.score_quality(nothing, X.labels(spark)).count() == 0
    assert quality.keep_quality(docs, X.labels(spark)).columns == docs.columns


def test_rules_compile_to_what_they_mean(spark):
    rng = np.random.default_rng(2)
    x = rng.random((800, len(quality.STATS)))
    y = ((x[:, 3] > 0.6) & (x[:, 7] <= 0.5)).astype(float)
    model = quality.fit_rules(x, y)
    data = spark.createDataFrame([tuple(map(float, row)) for row in x[:100]], list(quality.STATS))
    got = [r["p"] for r in data.select(F.struct(*quality.STATS).alias(quality.STATS_COL)).select(model.score().alias("p")).collect()]
    want = 1 / (1 + np.exp(-(model.bias + sum(r.weight * r.holds(x[:100]) for r in model.rules))))
    assert np.allclose(got, want)
    assert np.mean((want > 0.5) == y[:100]) > 0.95 and len(model.rules) < 120


# --- personal data -----------------------------------------------------------------------------------


def luhn(digits):
    s = [int(c) for c in reversed(digits)]
    return (sum(s[::2]) + sum(sum(divmod(2 * d, 10)) for d in s[1::2])) % 10 == 0


def brute_pii(rows):
    digits = lambda s: re.sub("[^0-9]", "", s)
    rules = {
        "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
        "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(p) <= 255 for p in s.split("."))),
        "card": (r"[0-9]([\x20-]?[0-9])+", lambda s: 13 <= len(digits(s)) <= 19 and luhn(digits(s))),
        "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 9 <= len(digits(s)) <= 15),
    }
    out = {}
    for n, (i, t) in enumerate(rows):
        found = {k: [(m.start(), m.end()) for m in re.finditer(p, t or "") if ok(m[0])] for k, (p, ok) in rules.items()}
        said = ",".join(f"{k}:{a}:{b}" for k in rules for a, b in found[k])
        out[n] = (i, *[len(found[k]) for k in rules], hashlib.sha256(said.encode()).hexdigest(), said)
    return out


PII = ("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256")


def test_pii(spark, docs, whole, nothing):
    got = pii.pii_report(pii.find_pii(docs))
    want = brute_pii(X.texts())
    assert rows_of(got, *PII) == Counter(w[:6] for w in want.values())
    said = {r["doc_id"]: r["spans"] for r in got.collect() if r["doc_id"] is not None}
    for i, *_, spans in want.values():
        if i in (72, 73, 74):
            assert set(filter(None, spans.split(","))) <= set(said[i].split(","))
    assert "secret:" in said[72]
    assert rows_of(queries.op5_pii(spark, SF_SMALL), *PII) == Counter(w[:6] for w in brute_pii(whole).values())
    assert pii.pii_report(pii.find_pii(nothing)).count() == 0


def test_pii_of_random_strings_and_long_runs(spark):
    rnd = random.Random(9)
    rows = [(k, "".join(rnd.choice("a1.@+- ()é\n04") for _ in range(rnd.randrange(120)))) for k in range(400)]
    rows += [(500, "a." * 20_000), (501, "1 " * 20_000), (502, "x" * 50_000 + "@b.c"), (503, "+1" + "." * 20_000), (504, "1." * 9000)]
    got = pii.pii_report(pii.find_pii(spark.createDataFrame(rows, "doc_id BIGINT, text STRING")))
    assert rows_of(got, *PII) == Counter(w[:6] for w in brute_pii(rows).values())


def test_a_secret_runs_to_its_end(spark):
    rnd = random.Random(5)
    key = lambda n: "".join(rnd.choices("abcdefghijkLMNOPQRST0123456789_-.", k=n))
    rows = [(n, f"a token={key(n)} end") for n in (7, 8, 128, 129, 700, 60_000)] + [(9000, f'secret: "{key(400)}" end')]
    got = pii.pii_report(pii.find_pii(spark.createDataFrame(rows, "doc_id BIGINT, text STRING")))
    said = {r["doc_id"]: [x for x in (r["spans"] or "").split(",") if x.startswith("secret:")] for r in got.collect()}
    assert said == {7: [], 9000: ["secret:0:409"], **{n: [f"secret:2:{n + 8}"] for n in (8, 128, 129, 700, 60_000)}}


def test_native_operators_run_no_python(spark):
    for name in ("op2_line_dedup", "op5_pii", "op9_soft_mixing"):
        plan = queries.QUERIES[name](spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()
        assert not re.search("Python|Pandas|Arrow", plan), name


# --- mixing ------------------------------------------------------------------------------------------------


def test_mixing_meets_its_targets(spark):
    got = queries.op9_soft_mixing(spark, SF_SMALL).collect()
    lang = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()}
    assert np.mean([r["domain"] == lang[r["doc_id"]] for r in got]) > 0.9 and all(r["rate"] >= 0 for r in got)
    total = sum(r["n_tokens"] for r in got)
    have = Counter()
    for r in got:
        have[r["domain"]] += r["rate"] * r["n_tokens"]
    for d, w in queries.LANGUAGE_WEIGHTS.items():
        assert abs(have[d] / total - w) < 0.03


def test_rates_solve_the_least_squares(spark):
    rng = np.random.default_rng(8)
    p, t = rng.dirichlet([0.4, 0.4, 0.4], 200), rng.integers(1, 500, 200)
    df = spark.createDataFrame([(k, int(t[k]), *map(float, p[k])) for k in range(200)], "doc_id BIGINT, n_tokens BIGINT, p0 DOUBLE, p1 DOUBLE, p2 DOUBLE")
    targets = [float(x) for x in t.sum() * np.array([0.5, 0.3, 0.2])]
    rows = mixing.fit_rates(df, targets).collect()
    got = [sum(r["rate"] * r["n_tokens"] * r[f"p{k}"] for r in rows) for k in range(3)]
    assert np.allclose(got, targets, rtol=0.01) and min(r["rate"] for r in rows) >= 0
    gone = mixing.fit_rates(df, [float(t.sum()), 0.0, 0.0]).collect()
    assert all(r["rate"] >= 0 for r in gone) and sum(r["rate"] * r["n_tokens"] * r["p1"] for r in gone) < 0.1 * t.sum()


def test_mixing_of_awkward_rows(spark, docs, nothing):
    got = mixing.soft_mix(docs, X.labels(spark), {"en": 0.5, "de": 0.5}, "lang").collect()
    assert len(got) == len(X.texts()) and all(math.isfinite(r["rate"]) for r in got)
    assert mixing.soft_mix(nothing, X.labels(spark), {"en": 1.0}, "lang").count() == 0
    out = mixing.mix_rows(docs, X.labels(spark), "lang")
    assert out.columns == docs.columns
    assert {(r["doc_id"], r["text"]) for r in out.collect()} == set(X.texts())
    assert mixing.mix_rows(nothing, X.labels(spark), "lang").count() == 0


def test_no_document_of_a_mixed_corpus_is_lost(spark):
    rnd = random.Random(4)
    shared = [f"word{k}" for k in range(20)]
    rows = []
    for k in range(3000):
        lang = rnd.choices("abcd", weights=(60, 15, 15, 10))[0]
        own = shared if k % 10 < 3 else [f"{lang}{j}" for j in range(20)]  # 3 in 10 could be of every language
        rows.append((k, " ".join(rnd.choices(own, k=30)), lang))
    df = spark.createDataFrame(rows, "doc_id BIGINT, text STRING, lang STRING")
    got = Counter(r["doc_id"] for r in mixing.mix_rows(df, df.select("doc_id"), "lang").collect())
    assert set(got) == set(range(3000))
    count = lambda x: sum(got[k] for k, _, lang in rows if lang == x) / sum(lang == x for _, _, lang in rows)
    assert min(count("b"), count("c"), count("d")) > 1.1 > count("a") >= 1


# --- line dedup ------------------------------------------------------------------------------------------------


def brute_lines(rows, threshold=0.8):
    k = line_dedup.SHINGLE
    occ = [(i, n, x) for i, t in rows for n, x in enumerate((t or "").split("\n")) if x]
    distinct = sorted({x for _, _, x in occ})
    sets = []
    for x in distinct:
        sets.append({x[j:j + k] for j in range(max(1, len(x) - k + 1))})
    root = list(range(len(distinct)))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    at = defaultdict(list)
    for a, s in enumerate(sets):
        for x in s:
            at[x].append(a)
    for a, s in enumerate(sets):
        for b, n in Counter(b for x in s for b in at[x] if b > a).items():
            if n >= threshold * (len(s) + len(sets[b]) - n) - 1e-9:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    place = {x: find(a) for a, x in enumerate(distinct)}
    first = {}
    for i, n, x in occ:
        key = (i if i is not None else -1, n)
        first[place[x]] = min(first.get(place[x], key), key)
    out = Counter()
    for i, t in rows:
        lines = [(n, x) for n, x in enumerate((t or "").split("\n")) if x]
        mine = {n for j, n, x in occ if j == i and (i if i is not None else -1, n) != first[place[x]]}
        out[(i, len(lines), len(lines) - len(mine), tuple(sorted(mine)))] += 1
    return out


def said_lines(df):
    return Counter((r["doc_id"], r["n_lines"], r["n_kept"], tuple(r["dropped"])) for r in df.collect())


def test_line_dedup(spark, docs, nothing):
    rows = [(i, t) for i, t in X.texts() if i not in (50, 53, 61, 62, None)]
    got = line_dedup.dedup_lines(docs.where("doc_id is not null and doc_id not in (50, 53, 61, 62)"))
    assert said_lines(got) == brute_lines(rows)
    assert line_dedup.dedup_lines(docs).count() == len(X.texts())
    assert line_dedup.dedup_lines(nothing).count() == 0


def test_line_dedup_of_a_large_group(spark):
    line = " ".join(X.words(60, 3))
    rows = [(k, X.changed(line, k) + "\n" + line + f"\nown {k} " + " ".join(X.words(30, 100 + k))) for k in range(60)]
    got = line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id BIGINT, text STRING"))
    assert said_lines(got) == brute_lines(rows)
    docs = spark.createDataFrame(rows, "doc_id BIGINT, text STRING")
    texts = {r["doc_id"]: r["text"] for r in line_dedup.without_lines(docs, got).collect()}
    assert texts[5].startswith("own 5") and "\n" in texts[0]


def test_line_dedup_query_finds_nearly_all(spark, whole):
    got, want = said_lines(queries.op2_line_dedup(spark, SF_SMALL)), brute_lines(whole)
    assert sum((got & want).values()) >= 0.98 * len(whole)
    assert abs(sum(n * r[2] for r, n in got.items()) - sum(n * r[2] for r, n in want.items())) <= 0.002 * sum(n * r[1] for r, n in want.items())


def test_line_dedup_carries_texts_and_frees_its_tables(spark, monkeypatch):
    rnd, sizes, staged = random.Random(4), {}, line_dedup.staged
    lines = ["".join(rnd.choices("abcdefghij klmnopqrs", k=900)) for _ in range(150)]
    rows = [(k, line + "\n" + X.changed(line, k)) for k, line in enumerate(lines)]

    def measured(df, tag, tasks=None):
        out = staged(df, tag, tasks)
        sizes[tag] = sum(p.stat().st_size for p in Path(out._staged_path.removeprefix("file:")).rglob("*.parquet"))
        return out

    monkeypatch.setattr(line_dedup, "staged", measured)
    before = common.staged_so_far()
    got = line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id BIGINT, text STRING"))
    assert common.staged_so_far() - before <= 2  # what the result still reads
    assert sizes["sets"] < 3 * sum(len(t) for _, t in rows)  # hashes of all shingles are eight times the text
    assert said_lines(got) == brute_lines(rows)


def drifting(n, seed):
    """A path: two places change in every step, so that only neighbours are near copies."""
    rnd = random.Random(seed)
    line = list("".join(rnd.choices("abcdefghij klmnopqr", k=200)))
    out, places = ["".join(line)], [10 * k + 5 for k in range(19)]
    for k in range(n - 1):
        for p in (places[2 * k % 19], places[(2 * k + 1) % 19]):
            line[p] = rnd.choice("0123456789")
        out.append("".join(line))
    return out


@pytest.mark.parametrize("block", [3, 256])
def test_line_dedup_keeps_every_link_of_drifting_chains(spark, monkeypatch, block):
    monkeypatch.setattr(line_dedup, "BLOCK", block, raising=False)
    paths = [drifting(n, 10 * n + k) for n in (3, 4, 6, 8, 8, 20) for k in range(4)]
    rows = [(bucket, at, line) for bucket, path in enumerate(paths) for at, line in enumerate(path)]
    df = spark.createDataFrame(rows, "bucket BIGINT, at INT, text STRING").withColumn(
        "line", F.struct(F.xxhash64("text").alias("h"), F.xxhash64(F.lit(1), "text").alias("g"))).cache()
    sets = df.select("line", F.array_distinct(F.transform(line_dedup._shingles(F.col("text")), lambda x: F.xxhash64(x))).alias("set"))
    text = F.col("text")
    sigs = line_dedup._signatures(df.select(F.lit(1).alias("doc_id"), F.col("at").alias("line_no"), text.alias("line"), "line.h", "line.g"))
    members = df.select("bucket", "line", "line.h", "line.g").join(sigs, ["h", "g"]).select("bucket", "line", "sketch")
    links = line_dedup._links(members, sets, 0.8)
    comps = components.components(links).withColumnRenamed("node", "line")
    got = df.join(comps, "line", "left").groupBy("bucket").agg(F.countDistinct("comp").alias("c"), F.sum(F.isnull("comp").cast("int")).alias("alone"))
    assert {(r["c"], r["alone"]) for r in got.collect()} == {(1, 0)}


def exchanged(df):
    """Most rows that went through an exchange of the plan that ``df`` ran."""
    def walk(node):
        kind = node.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            return walk(node.executedPlan())
        if kind.endswith("QueryStageExec"):
            return walk(node.plan())
        below = [walk(node.children().apply(k)) for k in range(node.children().size())]
        return max([node.metrics().apply("shuffleRecordsWritten").value() if kind == "ShuffleExchangeExec" else 0, *below])

    df.collect()
    return walk(df._jdf.queryExecution().executedPlan())


def test_line_dedup_writes_no_pairs_of_a_large_group(spark):
    rnd, texts = random.Random(5), set()
    line = "".join(rnd.choices("abcdefghij klmnopqr", k=300))
    while len(texts) < 300:  # similarities from 0.6 to 0.95: several components, and far more pairs than lines
        other = list(line)
        for _ in range(rnd.randint(2, 5)):
            other[rnd.randrange(len(other))] = rnd.choice("0123456789")
        texts.add("".join(other))
    df = spark.createDataFrame([(1, at, x) for at, x in enumerate(sorted(texts))], "bucket BIGINT, at INT, text STRING").withColumn(
        "line", F.struct(F.xxhash64("text").alias("h"), F.xxhash64(F.lit(1), "text").alias("g"))).cache()
    sets = df.select("line", F.array_distinct(F.transform(line_dedup._shingles(F.col("text")), lambda x: F.xxhash64(x))).alias("set"))
    sigs = line_dedup._signatures(df.select(F.lit(1).alias("doc_id"), F.col("at").alias("line_no"), F.col("text").alias("line"), "line.h", "line.g"))
    members = df.select("bucket", "line", "line.h", "line.g").join(sigs, ["h", "g"]).select("bucket", "line", "sketch")
    links = line_dedup._links(members, sets, 0.8)
    assert exchanged(links) <= 8 * len(texts)  # of 44,850 pairs
    comps = {r["line"]: r["comp"] for r in df.join(components.components(links).withColumnRenamed("node", "line"), "line").collect()}
    want = brute_lines([(r["line"], r["text"]) for r in df.collect()])
    assert len(texts) - len(comps) + len(set(comps.values())) == sum(n * r[2] for r, n in want.items())


def edited(line, alphabet, rnd):
    """A near copy by edits of characters, of exact similarity 0.80 to 0.85."""
    k = line_dedup.SHINGLE
    cut = lambda x: {x[j:j + k] for j in range(len(x) - k + 1)}
    want = cut(line)
    while True:
        other = list(line)
        for _ in range(40):
            other[rnd.randrange(len(other))] = rnd.choice(alphabet)
            have = cut("".join(other))
            near = len(have & want) / len(have | want)
            if 0.8 <= near <= 0.85:
                return "".join(other)
            if near < 0.8:
                break


def planted(kind, rnd):
    thai = [chr(c) for c in range(0x0E01, 0x0E2F)]
    word = lambda letters, n=8: "".join(rnd.choices(letters, k=rnd.randint(2, n)))
    low = "bcdfghjlmnprstuvwxyz"
    if kind == "rule":
        return "".join(rnd.choices("-=*#~", k=rnd.randint(60, 126)))
    if kind == "tsv":
        return "\t".join(word(low) for _ in range(30))
    if kind == "url":
        return "https://" + "/".join(word(low) for _ in range(30))
    return word(thai, 3) + "".join(rnd.choices(thai, k=rnd.randint(160, 400)))


@pytest.mark.parametrize("kind", ["rule", "tsv", "url", "thai"])
def test_near_copies_of_every_kind_of_line_meet(spark, kind):
    rnd = random.Random(kind)
    pairs = []
    for _ in range(300):
        line = planted(kind, rnd)
        pairs += [line, edited(line, sorted(set(line)), rnd)]
    occ = spark.createDataFrame([(k // 2, k % 2, x) for k, x in enumerate(pairs)], "doc_id BIGINT, line_no INT, line STRING").select(
        "*", F.xxhash64("line").alias("h"), F.xxhash64(F.lit(1), "line").alias("g"))
    bands = defaultdict(lambda: (set(), set()))
    for r in line_dedup._signatures(occ).collect():
        bands[r["doc_id"]][r["line_no"]].update((b, r[f"b{b}"]) for b in range(line_dedup.BANDS))
    assert sum(bool(a & b) for a, b in bands.values()) >= 0.98 * 300
