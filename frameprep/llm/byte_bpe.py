"""Byte-level BPE encoding and decoding with given ranks.

Each pre-token (a match of the split pattern) is merged by a hierarchical-bitmap
rank queue: one bucket per merge rank holds the start positions of pairs with
that rank, a tree of 64-bit words marks the non-empty buckets, and
find-first-set down the tree gives the next rank. Parts form a linked list by
position; an entry whose pair has changed meanwhile is stale and is skipped.
The next merge is always the leftmost pair of the lowest rank, so a pre-token of
a million bytes takes about n log n steps instead of n squared. The different
pre-tokens of some texts share one queue, which finds each of its ranks once.

The rank file is read once on the driver (under 1 MB, one row per token) and
broadcast. Texts are encoded where they are read: no shuffle.

Cases: a null text counts as empty and gives no tokens; bytes without a token
cannot occur (all 256 single bytes are in the ranks); ids decode to the input's
bytes exactly; rows repeat as they are; extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from frameprep.llm.common import text_or_empty

#: pre-tokens remembered per worker (a cache only: others are encoded anew)
CACHE_ENTRIES = 1 << 17
#: characters whose pre-tokens are merged together
GROUP_CHARS = 4_000_000
#: longer pre-tokens are merged one position at a time
LONG_BYTES = 256


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class RankTree:
    """The set of ranks with a non-empty bucket: a tree of 64-bit words whose lowest
    member is found by one find-first-set a level."""

    def __init__(self, max_rank: int):
        levels = 1
        while 64 ** levels <= max_rank:
            levels += 1
        self.words: list[dict[int, int]] = [{} for _ in range(levels)]

    def add(self, at: int) -> None:
        for level in self.words:
            word = at >> 6
            old = level.get(word, 0)
            level[word] = old | 1 << (at & 63)
            if old:
                return
            at = word

    def lowest(self) -> int:
        at = 0
        for level in reversed(self.words):
            word = level.get(at, 0)
            if not word:
                return -1
            at = (at << 6) | ((word & -word).bit_length() - 1)
        return at

    def remove(self, at: int) -> None:
        for level in self.words:
            word = at >> 6
            level[word] &= ~(1 << (at & 63))
            if level[word]:
                return
            at = word


class Merger:
    """Merges byte strings by rank; one queue serves a whole batch of pre-tokens.

    The pre-tokens stand end to end in one linked list that is cut between them. A
    bucket's positions are merged from the left; as soon as a merge makes a pair of
    a lower rank, the rest of the bucket waits and the lower rank comes first. So
    within each pre-token the leftmost pair of the lowest rank is always next."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks, self.max_rank = ranks, max(ranks.values(), default=0)
        get = ranks.get
        #: (left id, right id) -> id of the two together
        self.joined = {
            (x << 32) | y: r for t, r in ranks.items() for k in range(1, len(t))
            if (x := get(t[:k])) is not None and (y := get(t[k:])) is not None}
        self.keys = np.fromiter(sorted(self.joined), dtype=np.int64, count=len(self.joined))
        self.values = np.fromiter((self.joined[k] for k in self.keys.tolist()), dtype=np.int64, count=len(self.keys))
        self.byte = np.array([ranks[bytes([i])] for i in range(256)], dtype=np.int64)
        self.first = np.full((256, 256), -1, dtype=np.int64)
        for i in range(256):
            for j in range(256):
                self.first[i, j] = get(bytes([i, j]), -1)

    def merge(self, pieces: list[bytes]) -> list[bytes]:
        """Packed ids (little-endian unsigned 32-bit) of every non-empty piece. A bucket
        serves many short pieces at once, and a long piece one position at a time."""
        out: list[bytes] = [b""] * len(pieces)
        for short in (True, False):
            at = [k for k, p in enumerate(pieces) if (len(p) <= LONG_BYTES) == short]
            if at:
                run = self._merge_many if short else self._merge_long
                for k, ids in zip(at, run([pieces[k] for k in at])):
                    out[k] = ids
        return out

    def _pair_ranks(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        key = (x << 32) | y
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.values[at], -1)

    def _laid_out(self, pieces: list[bytes]):
        """Tokens, pair ranks and links of the pieces end to end, and the buckets."""
        data = np.frombuffer(b"".join(pieces), dtype=np.uint8)
        lens = np.fromiter(map(len, pieces), dtype=np.int64, count=len(pieces))
        ends, n = np.cumsum(lens), len(data)
        pair = np.full(n, -1, dtype=np.int64)
        pair[:-1] = self.first[data[:-1], data[1:]]
        pair[ends - 1] = -1
        right, left = np.arange(1, n + 1), np.arange(-1, n - 1)
        right[ends - 1] = left[ends - lens] = -1
        order = np.argsort(pair, kind="stable")
        order = order[np.searchsorted(pair[order], 0):]
        held, begin = np.unique(pair[order], return_index=True)
        tree, buckets = RankTree(self.max_rank), {}
        for rank, part in zip(held.tolist(), np.split(order, begin[1:])):
            buckets[rank] = part
            tree.add(rank)
        return self.byte[data], pair, right, left, lens, ends, tree, buckets

    @staticmethod
    def _packed(token, pair, ends: np.ndarray) -> list[bytes]:
        alive = np.asarray(pair) != -2  # the parts that were swallowed are gone
        packed = np.asarray(token)[alive].astype("<u4").tobytes()
        cut = (np.concatenate([[0], np.cumsum(alive)])[ends] * 4).tolist()
        return [packed[a:b] for a, b in zip([0, *cut], cut)]

    def _merge_many(self, pieces: list[bytes]) -> list[bytes]:
        token, pair, right, left, lens, ends, tree, first = self._laid_out(pieces)
        piece = np.repeat(np.arange(len(pieces)), lens)
        buckets = {rank: [part] for rank, part in first.items()}

        def push(ranks: np.ndarray, at: np.ndarray) -> None:
            order = np.argsort(ranks, kind="stable")
            ranks, at = ranks[order], at[order]
            cut = np.flatnonzero(ranks[1:] != ranks[:-1]) + 1
            begin = [0, *cut.tolist()]
            for rank, a, b in zip(ranks[begin].tolist(), begin, [*begin[1:], len(at)]):
                bucket = buckets.get(rank)
                if bucket is None:
                    buckets[rank] = [at[a:b]]
                    tree.add(rank)
                else:
                    bucket.append(at[a:b])

        while (rank := tree.lowest()) >= 0:
            held = buckets.pop(rank)
            tree.remove(rank)
            at = held[0] if len(held) == 1 else np.concatenate(held)
            at = np.unique(at[pair[at] == rank])  # without the stale ones
            if not len(at):
                continue
            lead = np.ones(len(at), bool)  # the leftmost of each piece; the others wait
            lead[1:] = piece[at[1:]] != piece[at[:-1]]
            if not lead.all():
                buckets[rank] = [at[~lead]]
                tree.add(rank)
                at = at[lead]
            gone = right[at]
            after, before = right[gone], left[at]
            token[at], right[at], pair[gone] = rank, after, -2
            more, back = after >= 0, before >= 0
            i, after, before = at[more], after[more], before[back]
            left[after] = i
            pair[at] = -1
            pair[i] = self._pair_ranks(np.int64(rank), token[after])
            pair[before] = self._pair_ranks(token[before], np.int64(rank))
            touched = np.concatenate([i, before])
            ranks = pair[touched]
            known = ranks >= 0
            if known.any():
                push(ranks[known], touched[known])
        return self._packed(token, pair, ends)

    def _merge_long(self, pieces: list[bytes]) -> list[bytes]:
        token, pair, right, left, _, ends, tree, first = self._laid_out(pieces)
        buckets = {rank: part.tolist() for rank, part in first.items()}
        token, pair, right, left = token.tolist(), pair.tolist(), right.tolist(), left.tolist()
        joined = self.joined.get

        def push(rank: int, at: int) -> None:
            bucket = buckets.get(rank)
            if bucket is None:
                buckets[rank] = [at]
                tree.add(rank)
            else:
                bucket.append(at)

        while (rank := tree.lowest()) >= 0:
            bucket = buckets.pop(rank)
            tree.remove(rank)
            bucket.sort()
            for k, i in enumerate(bucket):
                if pair[i] != rank:  # stale: the pair here has changed
                    continue
                j = right[i]
                after, before = right[j], left[i]
                token[i], right[i], pair[j] = rank, after, -2
                low = rank
                if after >= 0:
                    left[after] = i
                    pair[i] = new = joined((rank << 32) | token[after], -1)
                    if new >= 0:
                        push(new, i)
                        low = min(low, new)
                else:
                    pair[i] = -1
                if before >= 0:
                    pair[before] = new = joined((token[before] << 32) | rank, -1)
                    if new >= 0:
                        push(new, before)
                        low = min(low, new)
                if low < rank:
                    for at in bucket[k + 1:]:
                        push(rank, at)
                    break
        return self._packed(token, pair, ends)


class Codec:
    """Encoder and decoder of one worker."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex

        self.merger = Merger(ranks)
        self.split = regex.compile(pattern).findall
        self.token = {i: t for t, i in ranks.items()}
        self.cache: dict[str, bytes] = {}

    def encode_all(self, texts: list[str]) -> Iterator[bytes]:
        """Ids of every text as little-endian unsigned 32-bit integers."""
        group, size = [], 0
        for text in texts:
            group.append(text)
            size += len(text)
            if size >= GROUP_CHARS:
                yield from self._encode_group(group)
                group, size = [], 0
        yield from self._encode_group(group)

    def _encode_group(self, texts: list[str]) -> list[bytes]:
        cut = [self.split(t) for t in texts]
        known, whole = self.cache, self.merger.ranks.get
        new = list(set().union(*cut).difference(known)) if cut else []
        raw = [w.encode("utf-8", "surrogatepass") for w in new]
        found, open_ = {}, []
        for w, b in zip(new, raw):
            rank = whole(b)
            if rank is None:
                open_.append((w, b))
            else:
                found[w] = rank.to_bytes(4, "little")
        if open_:
            found.update(zip((w for w, _ in open_), self.merger.merge([b for _, b in open_])))
        if len(known) + len(found) <= CACHE_ENTRIES:
            known.update((w, ids) for w, ids in found.items() if len(w) <= 64)
        known_get = known.get
        return [b"".join([known_get(w) or found[w] for w in words]) for words in cut]

    def decode(self, packed: bytes) -> bytes:
        return b"".join(map(self.token.__getitem__, np.frombuffer(packed, dtype="<u4").tolist()))


_CODECS: dict[str, Codec] = {}


def _codec(shared, pattern: str, key: str) -> Codec:
    """The worker's codec, kept between its tasks."""
    if key not in _CODECS:
        _CODECS.clear()
        _CODECS[key] = Codec(shared.value, pattern)
    return _CODECS[key]


def _coder(shared, pattern: str, key: str, emit):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(shared, pattern, key)
        for batch in batches:
            yield emit(codec, batch)
    return run


def _digest_batch(codec: Codec, batch: pa.RecordBatch) -> pa.RecordBatch:
    n, ids, back = [], [], []
    for packed in codec.encode_all(batch.column(1).to_pylist()):
        n.append(len(packed) // 4)
        ids.append(hashlib.sha256(packed).hexdigest())
        back.append(hashlib.sha256(codec.decode(packed)).hexdigest())
    return pa.RecordBatch.from_arrays(
        [batch.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(back, pa.string())],
        ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])


def _id_batch(codec: Codec, batch: pa.RecordBatch) -> pa.RecordBatch:
    ids = [np.frombuffer(x, dtype="<u4").astype("int32") for x in codec.encode_all(batch.column(1).to_pylist())]
    return pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])


def _text_batch(codec: Codec, batch: pa.RecordBatch) -> pa.RecordBatch:
    back = [codec.decode(np.asarray(x or [], dtype="<u4").tobytes()) for x in batch.column(1).to_pylist()]
    return pa.RecordBatch.from_arrays([batch.column(0), pa.array(back, pa.binary())], ["doc_id", "bytes"])


def _run(docs: DataFrame, id_col: str, value, ranks: dict[bytes, int], pattern: str, emit, schema: str) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(ranks)
    key = hashlib.md5(repr((sorted(ranks.items()), pattern)).encode()).hexdigest()
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), value).mapInArrow(_coder(shared, pattern, key, emit), schema)


def encode(docs: DataFrame, ranks: dict[bytes, int], pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids (array of int) of every whole text."""
    return _run(docs, id_col, text_or_empty(text_col), ranks, pattern, _id_batch, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, ranks: dict[bytes, int], pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id, bytes of every id list."""
    return _run(encoded, id_col, F.col(ids_col), ranks, pattern, _text_batch, "doc_id long, bytes binary")


def encode_digests(docs: DataFrame, ranks: dict[bytes, int], pattern: str, id_col: str = "doc_id",
                   text_col: str = "text") -> DataFrame:
    """Round trip of every text: doc_id, n_tokens, ids_sha256, decoded_sha256."""
    return _run(docs, id_col, text_or_empty(text_col), ranks, pattern, _digest_batch,
                "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
