"""Substring dedup with broadcast suffix automata of reference shards.

A word is removed if a window of ``window`` words covers it whose words also
start in a document with a smaller id. The dealt form matches every document
against the automaton of every shard of the reference, which is quadratic in the
corpus when the corpus is its own reference. Here a routing step says which
shard can hold the first occurrence of which window, and only that shard's
automaton is met. Rounds:

1. Every window has an anchor: in the first round the smallest hash among its
   5-word groups (equal windows have equal anchors, neighbours mostly share one),
   in later rounds a hash of the whole window. An aggregate gives the smallest
   document id of each anchor; anchors of one document alone drop out.
2. A window whose anchor first occurs in document f < own id goes, joined with its
   neighbours of the same f into a span, to the shard of f. The reference there is
   f's own spans for the same anchors.
3. In a shard's task, each reference document becomes suffix automata of at most
   ``SHARD_WORDS`` words; spans stream through them. Where the matching statistic
   reaches the window, the maximal matched span is removed.
4. Windows that were not found go on to the next round, alone. If w occurs in f, all
   its later copies were found there; if not, all its occurrences go on together,
   so no comparison is lost. The second round finds the rest unless two windows
   share a 64-bit hash; rounds go on, with another salt, until nothing is left.

Hash values only route: every removal is a match of words in an automaton.

Skew: anchors and first ids are map-side combined aggregates; spans sent to a hot
reference are dealt over parts, and its automata are built in (broadcast to) each
part; a very long reference is cut into overlapping shards. Texts cross the network
twice, compressed: to their anchors and to their removed spans.

Cases: a null or empty text has no words; windows need ``window`` words of one row;
a null id removes nothing and loses nothing; rows repeating an id are rows of
their own and do not remove each other; an empty table gives no rows; extra
columns are ignored. ``remove_repeats`` also gives the text that is kept.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from frameprep.llm.common import release, sliced, staged

WINDOW, GROUP = 13, 5
SHARD_WORDS = 50_000  # words of one automaton
PART_BYTES = 4 << 20  # of compressed spans that one part of a hot reference gets
TASK_BYTES = 2 << 20  # of compressed spans a shard's task reads, about
BROADCAST_ROWS = 100_000  # of hot references; beyond that they are joined
CACHED_WORDS = 1 << 18
_MIX, _SPREAD = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


class _Hashes(dict):
    """64-bit hash of each word, kept for the words met lately."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > CACHED_WORDS:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.array([*map(self.__getitem__, words)], np.uint64)


def _rolled(h: np.ndarray, width: int, salt: int) -> np.ndarray:
    """Hash of every run of ``width`` words."""
    out = np.full(max(0, len(h) - width + 1), salt, np.uint64)
    for j in range(width):
        out = out * _MIX + h[j:j + len(out)]
    for shift in (29, 32):
        out = (out ^ (out >> np.uint64(shift))) * _SPREAD
    return out


def _anchors(h: np.ndarray, window: int, turn: int) -> np.ndarray:
    """Anchor of every window: equal windows have equal ones."""
    if turn:
        return _rolled(h, window, turn).view(np.int64)
    groups = _rolled(h, GROUP, 0)
    out = groups[:max(0, len(h) - window + 1)].copy()
    for j in range(1, window - GROUP + 1):
        np.minimum(out, groups[j:j + len(out)], out=out)
    return out.view(np.int64)


def _words(packed: bytes, unzip: zstandard.ZstdDecompressor) -> list[bytes]:
    return unzip.decompress(packed).split() if packed else []


def _packed_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc, sub (tells rows of one id apart), at (place of the first word), words (compressed)."""
    pack = zstandard.ZstdCompressor(level=1)
    for batch in sliced(batches):
        raw = [(t or "").encode("utf-8", "surrogatepass") for t in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([
            batch.column(0), pa.array([hashlib.blake2b(t, digest_size=16).digest() for t in raw], pa.binary()),
            pa.array([0] * len(raw), pa.int32()), pa.array([pack.compress(t) if t else b"" for t in raw], pa.binary())], _PIECE_NAMES)


_ANCHOR = "anchor long, doc long"
_PIECE, _PIECE_NAMES = "doc long, sub binary, at int, words binary", ["doc", "sub", "at", "words"]


def _word_hashes(texts: pa.Array, hashes: _Hashes) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts in one array, and the text each word is of."""
    split = pc.ascii_split_whitespace(texts)
    words = split.flatten()
    full = pc.greater(pc.binary_length(words), 0)
    row = np.repeat(np.arange(len(texts)), pc.list_value_length(split).to_numpy())[full.to_numpy(zero_copy_only=False)]
    coded = words.filter(full).dictionary_encode()
    return hashes.of(coded.dictionary.cast(pa.binary()).to_pylist())[coded.indices.to_numpy()], row


def _anchor_rows(window: int, turn: int, packed: bool):
    """(anchor, doc) of all windows of texts (or packed pieces), neighbours with one anchor once."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, unzip = _Hashes(), zstandard.ZstdDecompressor()
        for batch in sliced(batches, 500):
            texts = batch.column(1)
            if packed:
                texts = pa.array([unzip.decompress(w) for w in texts.to_pylist()], pa.binary()).cast(pa.string())
            h, row = _word_hashes(pc.fill_null(texts, ""), hashes)
            anchors = _anchors(h, window, turn)
            row, end = row[:len(anchors)], row[window - 1:]
            whole = np.flatnonzero(row == end)  # windows inside one text
            anchors, row = anchors[whole], row[whole]
            new = np.ones(len(row), bool)
            new[1:] = (anchors[1:] != anchors[:-1]) | (row[1:] != row[:-1])
            yield pa.RecordBatch.from_arrays([pa.array(anchors[new]), batch.column(0).take(pa.array(row[new]))], ["anchor", "doc"])
    return run


def _runs(first: np.ndarray) -> Iterator[tuple[int, int]]:
    """Start and end of the runs of equal values."""
    cuts = np.flatnonzero(np.diff(first)) + 1
    return zip([0, *cuts.tolist()], [*cuts.tolist(), len(first)])


def _span_rows(window: int, turn: int):
    """Of each document's pieces, the runs of windows with the same first document, as compressed words."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, unzip, pack = _Hashes(), zstandard.ZstdDecompressor(), zstandard.ZstdCompressor(level=1)
        for batch in sliced(batches, 500):
            out: list[tuple] = []
            bounds = batch.column(3).offsets.to_numpy(), batch.column(4).offsets.to_numpy()
            values = batch.column(3).values.to_numpy(), batch.column(4).values.to_numpy()
            for k, (doc, sub, pieces) in enumerate(zip(*(c.to_pylist() for c in batch.columns[:3]))):
                keys, firsts = (v[b[k]:b[k + 1]] for v, b in zip(values, bounds))
                order = np.argsort(keys, kind="stable")
                keys, firsts = keys[order], firsts[order]
                for piece in pieces:
                    words = _words(piece["words"], unzip)
                    mine = _anchors(hashes.of(words), window, turn)
                    if not len(mine):
                        continue
                    place = np.minimum(np.searchsorted(keys, mine), len(keys) - 1)
                    known, first = keys[place] == mine, firsts[place]
                    for a, b in _runs(_labels(first, known)):
                        if known[a]:
                            out.append((int(first[a]), doc, sub, piece["at"] + a, pack.compress(b" ".join(words[a:b + window - 1]))))
            columns = [*zip(*out)] or [()] * len(_SPAN_SCHEMA)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _SPAN_SCHEMA)], schema=_SPAN_SCHEMA)
    return run


def _labels(first: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Values that differ where the first document or its being known differs."""
    change = np.zeros(len(first), np.int64)
    change[1:] = (known[1:] != known[:-1]) | (known[1:] & (first[1:] != first[:-1]))
    return change.cumsum()


_SPAN, _SPAN_NAMES = f"first long, {_PIECE}", ["first", *_PIECE_NAMES]
_SPAN_SCHEMA = pa.schema([("first", pa.int64()), ("doc", pa.int64()), ("sub", pa.binary()), ("at", pa.int32()), ("words", pa.binary())])


class SuffixAutomaton:
    """Suffix automaton of a list of word lists; matches do not cross from one to the next."""

    def __init__(self, texts: list[list]):
        self.next, self.link, self.size = [{}], [-1], [0]
        nxt, link, size = self.next, self.link, self.size
        for k, words in enumerate(texts):
            last = 0
            for w in itertools.chain(words, ((k,),)):  # a mark of its own ends each list
                cur = len(nxt)
                nxt.append({})
                size.append(size[last] + 1)
                link.append(0)
                p = last
                while p != -1 and w not in nxt[p]:
                    nxt[p][w] = cur
                    p = link[p]
                if p != -1:
                    q = nxt[p][w]
                    if size[p] + 1 == size[q]:
                        link[cur] = q
                    else:
                        clone = len(nxt)
                        nxt.append(nxt[q].copy())
                        size.append(size[p] + 1)
                        link.append(link[q])
                        while p != -1 and nxt[p].get(w) == q:
                            nxt[p][w] = clone
                            p = link[p]
                        link[q] = link[cur] = clone
                last = cur

    def matching_statistics(self, words: list) -> list[int]:
        """For every word, the length of the longest run ending there that the automaton holds."""
        nxt, link, size = self.next, self.link, self.size
        state = length = 0
        out = []
        for w in words:
            to = nxt[state].get(w)
            while to is None and state:
                state = link[state]
                length = size[state]
                to = nxt[state].get(w)
            if to is not None:
                state, length = to, length + 1
            out.append(length)
        return out


def _automata(texts: list[list], window: int, most: int) -> Iterator[SuffixAutomaton]:
    """Shards of a reference document: at most ``most`` words each, overlapping by a window."""
    parts, held = [], 0
    for words in texts:
        for at in range(0, max(1, len(words) - window + 1), most):
            part = words[at:at + most + window - 1]
            if parts and held + len(part) > most:
                yield SuffixAutomaton(parts)
                parts, held = [], 0
            parts.append(part)
            held += len(part)
    if parts:
        yield SuffixAutomaton(parts)


def _shard(window: int, most: int):
    """Stream the spans of a shard through the automata of its reference documents."""
    def run(references: pa.Table, spans: pa.Table) -> pa.Table:
        unzip, pack = zstandard.ZstdDecompressor(), zstandard.ZstdCompressor(level=1)
        by: dict[int, list[bytes]] = {}
        for first, packed in zip(references["reference"].to_pylist(), references["held"].to_pylist()):
            by.setdefault(first, []).append(packed)
        spans = spans.sort_by("first")
        firsts = spans["first"].to_numpy()
        out = {n: [] for n in _VERDICT_NAMES}
        for a, b in _runs(firsts) if len(firsts) else ():
            texts = [_words(p, unzip) for p in by.get(int(firsts[a]), [])]
            part = spans.slice(a, b - a).to_pylist()
            found = [np.zeros(0, bool)] * len(part)
            for automaton in _automata(texts, window, most):
                for k, span in enumerate(part):
                    hit = np.array(automaton.matching_statistics(_words(span["words"], unzip))[window - 1:]) >= window
                    found[k] = found[k] | hit if len(found[k]) else hit
            for span, hit in zip(part, found):
                words = _words(span["words"], unzip)
                hit = hit if len(hit) else np.zeros(len(words) - window + 1, bool)
                for x, y in _runs(hit):
                    rest = None if hit[x] else pack.compress(b" ".join(words[x:y + window - 1]))
                    for name, v in zip(_VERDICT_NAMES, (span["doc"], span["sub"], span["at"] + x, span["at"] + y + window - 1, rest)):
                        out[name].append(v)
        return pa.table(out, schema=_VERDICT_SCHEMA)
    return run


_VERDICT, _VERDICT_NAMES = "doc long, sub binary, at int, to int, words binary", ["doc", "sub", "at", "to", "words"]
_VERDICT_SCHEMA = pa.schema([("doc", pa.int64()), ("sub", pa.binary()), ("at", pa.int32()), ("to", pa.int32()), ("words", pa.binary())])


def _verdicts(spans: DataFrame, window: int, most: int, part_bytes: int, task_bytes: int) -> DataFrame:
    """Removed spans (words null) and what was not found, of all spans sent to their reference."""
    sent = spans.where("doc > first")
    size = F.sum(F.length("words") + F.lit(40))
    total = int(spans.agg(size.alias("b")).first()["b"] or 0)
    hot = staged(sent.groupBy("first").agg(size.alias("b")).where(F.col("b") > part_bytes).select(
        "first", F.ceil(F.col("b") / F.lit(part_bytes)).cast("int").alias("parts")), "hot", 1)
    few = hot.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    hot_side = F.broadcast(hot) if few else hot
    shards = max(1, total // task_bytes + 1)
    parts = F.coalesce("parts", F.lit(1))
    shard = F.pmod(F.xxhash64("first", "part"), F.lit(shards)).cast("int").alias("shard")
    dealt = sent.join(hot_side, "first", "left").withColumn("part", F.pmod(F.xxhash64("doc", "sub", "at"), parts).cast("int"))
    used = spans.where("doc = first").join(hot_side, "first", "left").withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1)))
    left = used.select(shard, F.col("first").alias("reference"), F.col("words").alias("held")).groupBy("shard")
    right = dealt.select(shard, *_SPAN_NAMES).groupBy("shard")
    out = staged(left.cogroup(right).applyInArrow(_shard(window, most), _VERDICT), "verdicts")
    release(hot)
    return out


def _round(anchors: DataFrame, pieces: DataFrame, window: int, turn: int, most: int, part_bytes: int, task_bytes: int) -> DataFrame:
    rows = staged(anchors, "anchors")
    firsts = staged(rows.groupBy("anchor").agg(F.min("doc").alias("first"), F.max("doc").alias("last")).where("first < last").select(
        "anchor", "first"), "firsts")
    # a group here is one document, as long as its text
    known = rows.join(firsts, "anchor").groupBy("doc").agg(F.collect_list("anchor").alias("anchors"), F.collect_list("first").alias("firsts"))
    spans = staged(pieces.join(known, "doc").select("doc", "sub", "pieces", "anchors", "firsts").mapInArrow(_span_rows(window, turn), _SPAN), "spans")
    release(rows, firsts)
    out = _verdicts(spans, window, most, part_bytes, task_bytes)
    release(spans)
    return out


def repeated_spans(docs: DataFrame, window: int = WINDOW, shard_words: int = SHARD_WORDS, part_bytes: int = PART_BYTES,
                   task_bytes: int = TASK_BYTES) -> DataFrame:
    """doc, sub (a digest that tells rows of one id apart), spans of the removed words (at, to)
    of ``docs`` (doc, text), from all rounds."""
    if window < GROUP:
        raise ValueError(f"a window has at least {GROUP} words")
    ids = docs.where("doc IS NOT NULL")
    anchors = ids.mapInArrow(_anchor_rows(window, 0, False), _ANCHOR)
    pieces = ids.mapInArrow(_packed_texts, _PIECE).select("doc", "sub", F.array(F.struct("at", "words")).alias("pieces"))
    found, turn = None, 0
    while True:
        verdicts = _round(anchors, pieces, window, turn, shard_words, part_bytes, task_bytes)
        hit = verdicts.where("words IS NULL").select("doc", "sub", "at", "to")
        found = hit if found is None else found.unionByName(hit)
        left, turn = verdicts.where("words IS NOT NULL"), turn + 1
        if left.isEmpty():
            return found.groupBy("doc", "sub").agg(F.collect_list(F.struct("at", "to")).alias("spans"))
        anchors = left.select("doc", "words").mapInArrow(_anchor_rows(window, turn, True), _ANCHOR)
        pieces = left.groupBy("doc", "sub").agg(F.collect_list(F.struct("at", "words")).alias("pieces"))


def _kept(with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unzip = zstandard.ZstdDecompressor()
        for batch in sliced(batches, 200):
            rows = []
            for doc, packed, spans in zip(*(c.to_pylist() for c in batch.columns)):
                words = _words(packed, unzip)
                gone = np.zeros(len(words) + 1, np.int64)
                for s in spans or ():
                    gone[s["at"]] += 1
                    gone[s["to"]] -= 1
                gone = gone.cumsum()[:-1] > 0
                kept = b" ".join(itertools.compress(words, ~gone)) if gone.any() else b" ".join(words)
                rows.append((doc, len(words), int(gone.sum()), hashlib.sha256(kept).hexdigest(), kept))
            cols = [*zip(*rows)] or [()] * 5
            out = [pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.string())]
            yield pa.RecordBatch.from_arrays(
                [*out, pa.array([k.decode("utf-8", "surrogatepass") for k in cols[4]], pa.string())] if with_text else out,
                ["doc_id", "n_words", "n_removed", "kept_sha256", *["kept_text"] * with_text])
    return run


def remove_repeats(docs: DataFrame, window: int = WINDOW, shard_words: int = SHARD_WORDS, part_bytes: int = PART_BYTES,
                   task_bytes: int = TASK_BYTES, id_col: str = "doc_id", text_col: str = "text", with_text: bool = True) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and (``with_text``) the kept words joined by one space."""
    texts = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).cast("string").alias("text"))
    spans = repeated_spans(texts, window, shard_words, part_bytes, task_bytes)
    rows = texts.mapInArrow(_packed_texts, _PIECE).select("doc", "sub", "words").join(spans, ["doc", "sub"], "left").select("doc", "words", "spans")
    return rows.mapInArrow(_kept(with_text), "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * with_text)


ORACLE = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
t AS (SELECT doc_id, unnest(w) AS word, unnest(range(len(w))) AS pos FROM d),
s AS (SELECT doc_id, unnest(range(len(w) - {WINDOW - 1})) AS pos, w FROM d WHERE len(w) >= {WINDOW}),
k AS (SELECT doc_id, pos, array_to_string(list_slice(w, pos + 1, pos + {WINDOW}), ' ') AS gram FROM s),
m AS (SELECT gram, min(doc_id) AS first FROM k GROUP BY gram),
g AS (SELECT k.doc_id, k.pos FROM k JOIN m ON m.gram = k.gram WHERE m.first < k.doc_id),
c AS (SELECT t.doc_id, t.word, t.pos, max(CASE WHEN g.pos IS NULL THEN 0 ELSE 1 END) OVER (
        PARTITION BY t.doc_id ORDER BY t.pos ROWS BETWEEN {WINDOW - 1} PRECEDING AND CURRENT ROW) AS gone
      FROM t LEFT JOIN g ON g.doc_id = t.doc_id AND g.pos = t.pos),
a AS (SELECT doc_id, count(*) AS n_words, sum(gone) AS n_removed, string_agg(word, ' ' ORDER BY pos) FILTER (gone = 0) AS kept FROM c GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(a.n_words, 0) AS BIGINT) AS n_words, CAST(coalesce(a.n_removed, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(a.kept, '')) AS kept_sha256
FROM d LEFT JOIN a ON a.doc_id = d.doc_id"""
