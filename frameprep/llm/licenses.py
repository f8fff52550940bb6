"""Licence scan by a positional rare-token index.

The index holds the licence templates: word -> (template, position). Each word
is weighted by its inverse document frequency over all scanned documents. Of the
words that a file and a template share, the file's rarest are looked up; a posting
at template position q met at file position p gives the alignment p - q. The
alignments are intersected: one stays only if every looked-up word has it (within
a few words). At least three distinct words must be looked up (all, in a template of
fewer), and one of them must lie outside the key phrases where the template has such
words. An alignment counts when the template's mandatory key phrases stand there too.

A template marked exact is a phrase: its whole text is its key phrase and no
word may shift, so every place where the phrase stands is found through its
rarest word and nothing else is.

A wording that lacks a word of its template is still found, unless that word is among
the file's rarest and stands elsewhere in the file only.

Two passes over the texts, both without a wide shuffle: document frequencies of
the template words (bounded by the templates, not by the data), then the scan.

Cases: a null text counts as empty; no words give zero counts, null places and
an empty label list; rows repeat as they are; extra columns are ignored.
"""

from __future__ import annotations

import math
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from frameprep.llm.common import sliced, text_or_empty

#: words are runs of digits, letters a-z after lower-casing, and non-ASCII bytes
_SEPARATE = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))

RARE_WORDS = 3  # words of a template that are looked up in a file
SLACK = 3  # words by which a long template may be stretched


@dataclass(frozen=True)
class Template:
    label: str
    text: str
    keys: tuple[str, ...]
    exact: bool = False


#: fixed values: phrases and labels of the base scan
BASE_PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

#: fixed values: wording of public licences and the phrases that must appear
TEMPLATES = (
    Template("agpl", "gnu affero general public license", ("affero general public license",)),
    Template("all-rights-reserved", "all rights reserved", ("all rights reserved",)),
    Template("apache-2.0", "apache license version 2 0", ("apache license", "version 2 0")),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted",
             ("source and binary forms", "with or without modification")),
    Template("cc-by", "cc by 4 0", ("cc by 4 0",)),
    Template("cc-by-nc", "cc by nc 4 0", ("cc by nc 4 0",)),
    Template("cc-by-sa", "cc by sa 4 0", ("cc by sa 4 0",)),
    Template("cc0", "cc0 1 0 universal public domain dedication", ("cc0", "public domain dedication")),
    Template("gpl-3.0", "gnu general public license version 3", ("gnu general public license", "version 3")),
    Template("isc", "permission to use copy modify and or distribute this software for any purpose",
             ("permission to use copy modify", "for any purpose")),
    Template("lgpl", "gnu lesser general public license", ("lesser general public license",)),
    Template("mit-text", "permission is hereby granted free of charge to any person obtaining a copy of this software",
             ("permission is hereby granted", "any person obtaining a copy")),
    Template("mpl-2.0", "mozilla public license version 2 0", ("mozilla public license",)),
    Template("unlicense", "this is free and unencumbered software released into the public domain",
             ("free and unencumbered software", "public domain")),
)


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_SEPARATE).split()


def _base_templates() -> list[Template]:
    return [Template(label, phrase, (phrase,), exact=True) for phrase, label in BASE_PHRASES.items()]


class RareTokenIndex:
    """Postings of all template words; lookup, intersection and key-phrase checks per file."""

    def __init__(self, templates: list[Template], idf: dict[bytes, float]):
        self.templates = templates
        self.words = [t.text.encode().split() for t in templates]
        self.weight = idf
        self.keys: list[list[tuple[int, list[bytes]]]] = []
        self.free: list[frozenset[bytes]] = []  # template words outside the key phrases
        self.postings: dict[bytes, list[tuple[int, int]]] = defaultdict(list)
        for k, (t, words) in enumerate(zip(templates, self.words)):
            phrases = [p.encode().split() for p in t.keys]
            self.keys.append([(next(i for i in range(len(words)) if words[i:i + len(p)] == p), p) for p in phrases])
            self.free.append(frozenset(words).difference(*phrases))
            for q, w in enumerate(words):
                self.postings[w].append((k, q))
        self.by_rarity = sorted(self.postings, key=lambda w: (-idf.get(w, 0.0), w))

    def looked_up(self, present: set[bytes]) -> dict[int, list[bytes]]:
        """Per template the file's rarest words of it, where they are enough to place it."""
        shared: dict[int, list[bytes]] = defaultdict(list)
        for w in self.by_rarity:
            if w in present:
                for k in {k for k, _ in self.postings[w]}:
                    shared[k].append(w)
        out = {}
        for k, found in shared.items():
            if self.templates[k].exact:
                if len(found) == len(set(self.words[k])):
                    out[k] = found[:1]
                continue
            rare = found[:RARE_WORDS]
            free = [w for w in found if w in self.free[k]]
            if self.free[k] and free and not self.free[k].intersection(rare):
                rare.append(free[0])
            if len(rare) >= min(RARE_WORDS, len(set(self.words[k]))) and (free or not self.free[k]):
                out[k] = rare
        return out

    def alignments(self, k: int, rare: list[bytes], at: dict[bytes, list[int]]) -> list[int]:
        """Starts of template ``k`` that all words of ``rare`` agree on."""
        slack = 0 if self.templates[k].exact else SLACK
        starts = [sorted({p - q for t, q in self.postings[w] if t == k for p in at[w]}) for w in rare]
        return [s for s in starts[0] if all(self._near(other, s, slack) for other in starts[1:])]

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], float]:
        """(template, start) of every verified place, and the best coverage."""
        chosen = self.looked_up(self.postings.keys() & set(words))
        wanted = {w for rare in chosen.values() for w in rare}
        at: dict[bytes, list[int]] = defaultdict(list)
        for p, w in enumerate(words):
            if w in wanted:
                at[w].append(p)
        places, best = [], 0.0
        for k, rare in sorted(chosen.items()):
            template, length = self.templates[k], len(self.words[k])
            slack, last = 0 if template.exact else SLACK, None
            for s in self.alignments(k, rare, at):
                if last is not None and not template.exact and s - last <= 2 * SLACK:
                    continue
                if not all(self._stands(words, s + q, phrase, slack) for q, phrase in self.keys[k]):
                    continue
                last = s
                places.append((k, s))
                near = set(words[max(0, s - slack):max(0, s + length + slack)])
                total = sum(self.weight.get(w, 0.0) + 1e-9 for w in self.words[k])
                best = max(best, sum(self.weight.get(w, 0.0) + 1e-9 for w in self.words[k] if w in near) / total)
        return places, min(1.0, best)

    @staticmethod
    def _near(starts: list[int], s: int, slack: int) -> bool:
        i = bisect_left(starts, s - slack)
        return i < len(starts) and starts[i] <= s + slack

    @staticmethod
    def _stands(words: list[bytes], at: int, phrase: list[bytes], slack: int) -> bool:
        return any(s >= 0 and words[s:s + len(phrase)] == phrase for s in range(at - slack, at + slack + 1))


def _frequencies(vocabulary: frozenset[bytes]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for batch in sliced(batches):
            for text in batch.column(0).to_pylist():
                seen.update(vocabulary.intersection(words_of(text)))
                seen[b""] += 1
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], ["word", "n"])
    return run


def document_frequencies(docs: DataFrame, templates: list[Template], text_col: str = "text") -> dict[bytes, int]:
    """Documents holding each template word; b'' has the number of documents.
    One row per template word at most reaches the driver."""
    vocabulary = frozenset(w for t in templates for w in t.text.encode().split())
    rows = docs.select(text_or_empty(text_col).alias("text")).mapInArrow(_frequencies(vocabulary), "word binary, n long")
    return {bytes(r["word"]): r["n"] for r in rows.groupBy("word").agg(F.sum("n").alias("n")).collect()}


def _scanner(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = RareTokenIndex(*shared.value)
        for batch in sliced(batches):
            cols: dict[str, list] = {c: [] for c in ("n_words", "places", "score")}
            for text in batch.column(1).to_pylist():
                words = words_of(text)
                places, score = index.scan(words)
                cols["n_words"].append(len(words))
                cols["places"].append([
                    {"label": index.templates[k].label, "base": index.templates[k].exact, "start": s}
                    for k, s in sorted(places, key=lambda x: (x[1], x[0]))])
                cols["score"].append(score)
            kind = pa.list_(pa.struct([("label", pa.string()), ("base", pa.bool_()), ("start", pa.int64())]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(cols["n_words"], pa.int64()), pa.array(cols["places"], kind),
                 pa.array(cols["score"], pa.float64())], ["doc_id", "n_words", "places", "score"])
    return run


def license_scan(docs: DataFrame, extra: tuple[Template, ...] = TEMPLATES, id_col: str = "doc_id",
                 text_col: str = "text") -> DataFrame:
    """doc_id, n_words, places (label, base, start in words) and score of every document."""
    templates = _base_templates() + list(extra)
    df = document_frequencies(docs, templates, text_col)
    total = df.get(b"", 0)
    idf = {w: math.log((total + 1) / (df.get(w, 0) + 1)) for t in templates for w in t.text.encode().split()}
    shared = docs.sparkSession.sparkContext.broadcast((templates, idf))
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text")).mapInArrow(
        _scanner(shared),
        "doc_id long, n_words long, places array<struct<label:string,base:boolean,start:long>>, score double")


def license_report(scan: DataFrame) -> DataFrame:
    """The scan's counts, first and last place and label lists."""
    base = F.filter("places", lambda p: p["base"])
    starts = F.transform(base, lambda p: p["start"])
    names = lambda places: F.array_join(F.array_sort(F.array_distinct(F.transform(places, lambda p: p["label"]))), ",")
    return scan.select(
        "doc_id", "n_words", F.size(base).cast("long").alias("n_base"), F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"), names(base).alias("base_labels"), names(F.col("places")).alias("labels"),
        "score")
