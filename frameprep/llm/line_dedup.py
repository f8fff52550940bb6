"""Fuzzy line dedup by MinHash, in DataFrame operations only.

Distinct lines are made of their character shingles (``SHINGLE`` characters at
every position). A line's signature has ``BANDS * ROWS`` minhashes over all of its
shingles, whatever its length: a hash for every row of a band, a mask for every band. Shingles are reduced on the partitioning that the
line aggregate already has: they are never shuffled. Beside the signature a line has a
sketch, a bitmap of its shingles: where two sketches differ by more bits than two sets at
the threshold can differ by, the pair needs no comparison (no match is lost).

Lines with an equal band meet in a bucket (a pair at 0.8 meets with probability
0.997). All pairs of a small bucket are compared. In a larger
one a leader is compared with all members, the lines that it matches are settled, and
the next of ``ROUNDS`` leaders is drawn from the others; then all pairs of lines that
the matches so far do not join are compared, in pairs of blocks. So a group of near copies
around a leader costs one comparison a line, and a chain loses no link. Every
comparison is an exact Jaccard similarity of the whole shingle sets. Distributed union-find over the matches
gives the components; of a component (its exact copies included) the occurrence with
the smallest (doc_id, line number) stays.

Cases: lines end at a newline; empty lines are always kept and join nothing; a
line shorter than a shingle has one, itself; a null text counts as empty; equal
occurrences (repeated rows) of the same doc_id and line number are one; a null
doc_id sorts first; extra columns are ignored.
"""

from __future__ import annotations

from functools import reduce
from operator import and_
from random import Random

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from frameprep.llm.common import forget, release, release_since, staged, staged_so_far, tasks_for, text_or_empty
from frameprep.llm.components import components

SHINGLE = 8
BANDS, ROWS = 8, 3
THRESHOLD = 0.8
ROUNDS = 3
SMALL = 4  # lines of a bucket whose pairs are all compared at once
BLOCK, PLACES = 512, 512  # lines of a block of a larger bucket, and the places a line that it has room for
WORDS = 4  # of 64 bits: a sketch of a line's shingles, from which a pair's difference has a lower bound
BITMAP = 1 << 23  # bits of the fixed-size filter for candidate lines
FINE = 16  # the same of the lines that are compared
TOGETHER = 8  # shingles of a line that are reduced in one row
_random = Random(2)
# one for every minhash: the bands of an order of shingles start in different eighths of it
MASKS = [((j // ROWS << 61) | _random.getrandbits(61)) - (1 << 63) for j in range(BANDS * ROWS)]


def _documents(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, n_lines and lines (number, two hashes) of every document: narrow, without texts."""
    cut = F.transform(F.split(text_or_empty(text_col), "\n"), lambda x, n: F.struct(
        n.alias("line_no"), (x == "").alias("empty"), F.xxhash64(x).alias("h"), F.xxhash64(F.lit(1), x).alias("g")))
    lines = F.transform(F.filter(cut, lambda z: ~z["empty"]), lambda z: F.struct(
        z["line_no"].alias("line_no"), z["h"].alias("h"), z["g"].alias("g")))
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), lines.alias("lines")).withColumn(
        "n_lines", F.size("lines").cast("long"))


def _occurrences(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, line_no (from 0), line, and the line's two hashes, of every line with text."""
    lines = docs.select(F.col(id_col).cast("long").alias("doc_id"),
                        F.posexplode(F.split(text_or_empty(text_col), "\n")).alias("line_no", "line"))
    return lines.where(F.col("line") != "").select(
        "doc_id", "line_no", "line", F.xxhash64("line").alias("h"), F.xxhash64(F.lit(1), "line").alias("g"))


def _shingles(line: Column) -> Column:
    """The shingles at every place; a shorter line is its own shingle."""
    found = F.regexp_extract_all(line, F.lit(f"(?s)(?=(.{{{SHINGLE}}}))"), F.lit(1))
    return F.when(F.length(line) < SHINGLE, F.array(line)).otherwise(found)


def _wide(line: Column) -> Column:
    """Four bytes a character: a shingle is a slice, whatever the alphabet, and is found without a search."""
    return F.encode(F.make_valid_utf8(line), "UTF-32")


def _hashed(lines: DataFrame, keep: list[str], together: int) -> DataFrame:
    """``keep`` and the hashes x0_0, x0_1, .. of ``together`` places a row, of ``size`` places of ``line``;
    the last row of a line has its last place several times: sets do not change by it."""
    places = lines.select(*keep, _wide(F.col("line")).alias("wide")).select(
        *keep, "wide", F.explode(F.sequence(F.lit(0), F.col("size") - 1, F.lit(together))).alias("i"))
    shingle = [F.substring("wide", 4 * F.least(F.col("i") + k, F.col("size") - 1) + 1, F.lit(4 * SHINGLE)) for k in range(together)]
    return places.select(*keep, *[F.xxhash64(x).alias(f"x0_{k}") for k, x in enumerate(shingle)])


def _marks(words: int, together: int) -> list[Column]:
    """A sketch: the bits of all hashes, in ``words`` words."""
    mark = [" | ".join(f"if((shiftright(x0_{k}, 6) & {words - 1}) = {w}, shiftleft(1L, int(x0_{k} & 63)), 0L)" for k in range(together)) for w in range(words)]
    return [F.expr(f"bit_or({bits})").alias(f"w{w}") for w, bits in enumerate(mark)]


def _set(text: Column) -> Column:
    """The hashes of a line's shingles. The text is bound once: it is not encoded again for every shingle."""
    places = lambda wide: F.sequence(F.lit(0), F.greatest(F.lit(0), (F.length(wide) / 4).cast("int") - SHINGLE))
    cut = lambda wide: F.transform(places(wide), lambda i: F.xxhash64(F.substring(wide, 4 * i + 1, F.lit(4 * SHINGLE))))
    return F.array_distinct(F.flatten(F.transform(F.array(_wide(text)), cut)))


def _signatures(occ: DataFrame) -> DataFrame:
    """h, g, n, doc_id and line_no of the first occurrence, sketch, and the bands b0.. of
    every distinct line."""
    distinct = occ.groupBy("h", "g").agg(
        F.first("line").alias("line"), F.count(F.lit(1)).alias("n"), F.min(F.struct("doc_id", "line_no")).alias("at"))
    size = F.greatest(F.lit(1), F.length("line") - (SHINGLE - 1)).alias("size")
    # what belongs to a line is a key beside its hashes: numbers only, so the reduction needs no sort
    line = ["h", "g", "n", "doc_id", "line_no", "size"]
    rows = distinct.select("h", "g", "n", "at.doc_id", "at.line_no", size, "line")
    cells = _hashed(rows, line, TOGETHER)
    for r in range(1, ROWS):  # a hash, so an independent order of all shingles, for every row of a band
        cells = cells.select("*", *[F.xxhash64(f"x{r - 1}_{k}").alias(f"x{r}_{k}") for k in range(TOGETHER)])
    low = [F.min(F.least(*[F.col(f"x{j % ROWS}_{k}").bitwiseXOR(F.lit(MASKS[j])) for k in range(TOGETHER)])).alias(f"m{j}") for j in range(BANDS * ROWS)]
    mins = cells.groupBy(*line).agg(*low, *_marks(WORDS, TOGETHER))
    bands = [F.xxhash64(F.lit(b), *[f"m{b * ROWS + r}" for r in range(ROWS)]).alias(f"b{b}") for b in range(BANDS)]
    return mins.select("h", "g", "n", "doc_id", "line_no", F.struct("size", *[f"w{w}" for w in range(WORDS)]).alias("sketch"), *bands)


def _may_match(a: str, b: str, threshold: float, words: int = WORDS) -> Column:
    """False only if two sketches show that the sets differ too much: every bit that one
    alone has is a shingle that the other has not."""
    apart = sum((F.bit_count(F.col(f"{a}.w{w}").bitwiseXOR(F.col(f"{b}.w{w}"))) for w in range(words)), F.lit(0))
    return apart <= F.lit((1 - threshold) / (1 + threshold)) * (F.col(f"{a}.size") + F.col(f"{b}.size")) + 1e-6


def _in_bitmap(lines: DataFrame, wanted: DataFrame, rows: int) -> DataFrame:
    """Rows of ``lines`` whose hash bit is set by one of the ``rows`` of ``wanted`` (a superset of the
    matching rows): a table of bits / 32768 rows of 4 KB is broadcast, 32 MB at most."""
    bits = min(max(BITMAP, 1 << (16 * rows).bit_length()), BITMAP << 5)
    bit = (F.pmod("h", F.lit(bits)) + 1).alias("bit")
    maps = wanted.select(bit).groupBy(F.bitmap_bucket_number("bit").alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("map"))
    at = F.bitmap_bit_position(F.pmod("h", F.lit(bits)) + 1)
    marked = lines.withColumn("bucket", F.bitmap_bucket_number(F.pmod("h", F.lit(bits)) + 1)).join(F.broadcast(maps), "bucket")
    byte = F.conv(F.hex(F.substring("map", (at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return marked.where(F.getbit(byte, (at % 8).cast("int")) == 1).drop("bucket", "map")


def _pairs_of(left: DataFrame, right: DataFrame, threshold: float) -> DataFrame:
    """Lines of two tables (bucket, line, sketch) that share a bucket and may match, each pair once."""
    a = left.select("bucket", F.col("line").alias("a"), F.col("sketch").alias("ka"))
    b = right.select("bucket", F.col("line").alias("b"), F.col("sketch").alias("kb"))
    both = a.join(b, "bucket").where("a <> b").where(_may_match("ka", "kb", threshold))
    return both.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _across(members: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """Components (a, b) that a match joins: lines of different ``comp`` that share a bucket. Large buckets
    are cut into blocks, and every pair of blocks is a cell: its lines go there with their texts, have their
    sets made once and are compared there, so no task holds a whole bucket and no pair is written."""
    made = "set" in sets.columns
    fine = [] if made else ["size", *[f"w{w}" for w in range(FINE)]]
    full = F.greatest(F.count(F.lit(1)) / BLOCK, F.sum("sketch.size") / (BLOCK * PLACES))
    mixed = members.groupBy("bucket").agg((F.floor(full) + 1).cast("int").alias("blocks"), (F.min("comp") != F.max("comp")).alias("mixed")).where("mixed")
    own = members.join(mixed.select("bucket", "blocks"), "bucket").groupBy("line").agg(
        F.first("comp").alias("comp"), F.collect_set(F.struct("bucket", "blocks")).alias("at"))
    what = ["line", "comp", "buckets", "set" if made else "text", *fine]
    dealt = own.join(sets, "line").select("line", "comp", F.col("at.bucket").alias("buckets"), "set" if made else "text",
                                          *[f"sketch.{c}" for c in fine], F.explode("at").alias("z"))
    dealt = dealt.select(*what, "z.bucket", "z.blocks", F.pmod(F.xxhash64("line", F.lit("block")), F.col("z.blocks")).cast("int").alias("block"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    cell = ["bucket", "p", "q"]
    dealt = dealt.select(*what, "bucket", "block", F.least("block", "other").alias("p"), F.greatest("block", "other").alias("q"))

    def side(block: str) -> DataFrame:
        there = dealt.where(F.col("block") == F.col(block)).drop("block").repartition(*cell)  # texts are dealt out, not sets
        there = there if made else there.withColumn("set", _set(F.col("text"))).drop("text")
        return there.withColumn("n", F.size("set"))

    x, y = side("p").alias("x"), side("q").alias("y")
    n = F.col("x.n") + F.col("y.n")
    tests = [(F.col("x.p") < F.col("x.q")) | (F.col("x.line") < F.col("y.line")), F.col("x.comp") != F.col("y.comp"),
             *([_may_match("x", "y", threshold, FINE)] if fine else []),
             F.least("x.n", "y.n") >= F.lit(threshold) * F.greatest("x.n", "y.n"),
             F.array_min(F.array_intersect("x.buckets", "y.buckets")) == F.col("x.bucket"),  # once, wherever else they meet
             F.size(F.array_intersect("x.set", "y.set")) * F.lit(1 + threshold) >= F.lit(threshold) * n - 1e-9]
    on = [F.col(f"x.{c}") == F.col(f"y.{c}") for c in cell]
    both = x.join(y, reduce(and_, on + tests))
    return both.select(F.least("x.comp", "y.comp").alias("a"), F.greatest("x.comp", "y.comp").alias("b")).distinct()


def _matching(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """Pairs (a, b) whose exact similarity reaches the threshold. ``sets`` has every line's ``set``, or its
    ``text`` and a fine ``sketch``: then a set is made where a pair needs it, as texts are an eighth of the bytes."""
    what = [c for c in sets.columns if c != "line"]
    side = lambda x: sets.select(F.col("line").alias(x), *[F.col(c).alias(f"{c}_{x}") for c in what])
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    of = F.col if "set" in what else lambda c: _set(F.col(c.replace("set", "text")))
    if "sketch" in what:
        both = both.where(_may_match("sketch_a", "sketch_b", threshold, FINE))

    def near(z: Column) -> Column:
        m, n = F.size(z["a"]), F.size(z["b"])
        inter = F.size(F.array_intersect(z["a"], z["b"]))
        return (F.least(m, n) >= F.lit(threshold) * F.greatest(m, n)) & (inter >= F.lit(threshold) * (m + n - inter) - 1e-9)

    return both.where(F.exists(F.array(F.struct(of("set_a").alias("a"), of("set_b").alias("b"))), near)).select("a", "b")


def _links(members: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """Matches (a, b) among lines that share a bucket (members: bucket, line, sketch): those that
    leaders find, and those of all pairs that these do not join already."""
    tasks = tasks_for(members.count())
    size = members.groupBy("bucket").agg(F.count(F.lit(1)).alias("k"))
    large = staged(members.join(size.where(F.col("k") > SMALL).select("bucket"), "bucket"), "large", tasks)
    small = members.join(size.where(F.col("k") <= SMALL).select("bucket"), "bucket")
    found, open_, others = [], large, large
    for _ in range(ROUNDS):
        if open_.isEmpty():
            break
        # a bucket's leader by a hash of the line: the buckets of a group mostly have the same
        # one, so that a line is compared with it once and not once a band
        lead = staged(open_.groupBy("bucket").agg(F.min(F.struct(F.xxhash64("line").alias("k"), "line", "sketch")).alias("m")).select(
            "bucket", "m.line", "m.sketch"), "lead", tasks)
        others = others.join(lead.select("bucket", "line"), ["bucket", "line"], "left_anti")  # a leader is compared with all: it is done
        met = staged(_matching(_pairs_of(lead, others, threshold), sets, threshold), "met", tasks)
        found.append(met)
        both = met.unionByName(met.select(F.col("b").alias("a"), F.col("a").alias("b")))
        done = lead.join(both, F.col("line") == F.col("a")).select("bucket", F.col("b").alias("line")).unionByName(lead.select("bucket", "line")).distinct()
        open_ = staged(open_.join(done, ["bucket", "line"], "left_anti"), "open", tasks)
        forget(members.sparkSession)
    out = staged(_matching(_pairs_of(small, small, threshold), sets, threshold), "met", tasks)
    forget(members.sparkSession)
    for more in found:
        out = out.unionByName(more)
    if not found:
        return out
    # followers of different leaders may match too: all pairs that are not joined so far
    comps = components(out).select(F.col("node").alias("line"), "comp")
    apart = staged(others.join(comps, "line", "left").select("bucket", "line", "sketch", F.coalesce("comp", "line").alias("comp")), "apart", tasks)
    forget(members.sparkSession)
    return out.unionByName(_across(apart, sets, threshold))


def line_classes(docs: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """h, g (a distinct line), keep_doc, keep_line: of every line that has copies or near copies."""
    occ = _occurrences(docs, id_col, text_col)
    sigs = staged(_signatures(occ), "signatures")
    forget(docs.sparkSession)
    line = F.struct("h", "g").alias("line")
    band = F.explode(F.array(*[F.xxhash64(F.lit(b), f"b{b}") for b in range(BANDS)])).alias("bucket")
    # a bucket and one hash of a line only: lines that share the hash, if any, meet as well
    keys = sigs.select("h", band).withColumn("k", F.count(F.lit(1)).over(Window.partitionBy("bucket")))
    met = staged(keys.where("k > 1").select("bucket", "h"), "met", tasks_for(sigs.count()))
    forget(docs.sparkSession)
    few = staged(met.select("h").distinct(), "wanted", tasks_for(met.count()))
    rows = few.count()
    known = _in_bitmap(sigs.select("h", "g", "sketch"), few, rows)
    members = staged(met.join(known, "h").select("bucket", line, "sketch"), "members", tasks_for(sigs.count()))
    firsts = staged(sigs.select("h", "g", "n", "doc_id", "line_no"), "firsts")
    release(sigs, met)  # what is still wanted of them is written
    forget(docs.sparkSession)
    wanted = members.select("line.h", "line.g").distinct()
    texts = _in_bitmap(occ.select("h", "g", F.col("line").alias("text")), few, rows).join(wanted, ["h", "g"])
    one = staged(texts.groupBy("h", "g").agg(F.first("text").alias("line")), "texts")
    places = F.greatest(F.lit(1), F.length("line") - (SHINGLE - 1)).alias("size")
    fine = _hashed(one.select("h", "g", places, "line"), ["h", "g", "size"], TOGETHER // 2).groupBy("h", "g", "size").agg(*_marks(FINE, TOGETHER // 2))
    sets = staged(one.join(fine, ["h", "g"]).select(
        line, F.col("line").alias("text"), F.struct("size", *[f"w{w}" for w in range(FINE)]).alias("sketch")), "sets")
    release(one)
    forget(docs.sparkSession)
    comps = components(_links(members, sets, threshold)).select("node.h", "node.g", "comp")
    named = firsts.join(comps, ["h", "g"], "left")
    alone = named.where("comp is null and n > 1").select("h", "g", F.col("doc_id").alias("keep_doc"), F.col("line_no").alias("keep_line"))
    grouped = named.where("comp is not null")
    first = grouped.groupBy("comp").agg(F.min(F.struct("doc_id", "line_no")).alias("at"))
    near = grouped.select("h", "g", "comp").join(first, "comp").select(
        "h", "g", F.col("at.doc_id").alias("keep_doc"), F.col("at.line_no").alias("keep_line"))
    return near.unionByName(alone)


def dedup_lines(docs: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_lines (with text), n_kept, dropped (line numbers, ascending) of every document."""
    mark = staged_so_far()
    classes = staged(line_classes(docs, threshold, id_col, text_col), "classes")
    release_since(mark, classes)
    rows = staged(_documents(docs, id_col, text_col), "documents")
    occ = rows.select("doc_id", F.explode("lines").alias("z")).select("doc_id", "z.line_no", "z.h", "z.g")
    same = F.col("doc_id").eqNullSafe(F.col("keep_doc")) & (F.col("line_no") == F.col("keep_line"))
    gone = occ.join(classes, ["h", "g"]).where(~same).groupBy(F.col("doc_id").alias("gone_id")).agg(
        F.array_sort(F.collect_set("line_no")).alias("dropped"))
    dropped = F.coalesce("dropped", F.array().cast("array<int>"))
    return rows.select("doc_id", "n_lines").join(gone, F.col("doc_id").eqNullSafe(F.col("gone_id")), "left").select(
        "doc_id", "n_lines", (F.col("n_lines") - F.size(dropped)).alias("n_kept"), dropped.alias("dropped"))


def without_lines(docs: DataFrame, decisions: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the dropped lines taken out of their texts; columns unchanged."""
    d = decisions.select(F.col("doc_id").alias("decided"), "dropped").dropDuplicates(["decided"])
    whole = docs.select(F.struct("*").alias("doc"), F.col(id_col).cast("long").alias("i"))
    gone = lambda n: F.coalesce(F.array_contains("dropped", n), F.lit(False))
    kept = F.array_join(F.filter(F.split(F.col("doc")[text_col], "\n"), lambda x, n: ~gone(n)), "\n")
    joined = whole.join(d, F.col("i").eqNullSafe(F.col("decided")), "left")
    return joined.withColumn("doc", F.col("doc").withField(text_col, kept)).select("doc.*")
