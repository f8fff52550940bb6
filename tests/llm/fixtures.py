"""Small tables with every awkward case: nulls, empty and very long texts, ties,
repeated rows, and extra columns named like the operators' own."""

from __future__ import annotations

import random

SCHEMA = ("doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT, name STRING, key STRING, row BIGINT, "
          "node STRING, score DOUBLE, stats STRING, copies INT, i INT, sha STRING, rate DOUBLE, doc STRING, h INT, kept STRING")
_SYLLABLES = "an ther ing ou sh ble re on is at wh ea st nd".split()


def words(n: int, seed: int) -> list[str]:
    rnd = random.Random(seed)
    return ["".join(rnd.choices(_SYLLABLES, k=rnd.randint(1, 4))) for _ in range(n)]


def prose(n: int, seed: int) -> str:
    w = words(n, seed)
    return "\n".join(" ".join(w[i:i + 12]).capitalize() + "." for i in range(0, n, 12))


def changed(text: str, at: int) -> str:
    w = text.split(" ")
    w[at % len(w)] = "zzz"
    return " ".join(w)


def texts() -> list[tuple[int | None, str | None]]:
    base = prose(150, 1)
    rows: list[tuple[int | None, str | None]] = [(k, prose(60 + 7 * k, k)) for k in range(10, 22)]
    rows += [(30, base), (31, base.upper()), (32, changed(base, 40)), (33, changed(base, 90)), (34, base + " more")]
    rows += [(40, None), (41, ""), (42, " \n "), (43, "one"), (44, "One"), (45, "one two three"), (46, "\n\n")]
    rows += [(50, prose(9000, 50)), (51, "q" * 40_000), (52, "word " * 3000), (53, prose(9000, 50) + " end")]
    rows += [(None, prose(80, 60)), (None, None), (61, prose(70, 61)), (61, prose(70, 61)), (62, prose(70, 62)), (62, prose(70, 63))]
    rows += [(70, "Released under the MIT License. Licensed under the Apache License, Version 2.0."),
             (71, "GNU General Public License, version 3\ngeneral public license mit license mit"),
             (72, "mail a.b+c@x-y.example.org. or a@b, 1.2.3.4.5.6.7.8 and 300.1.1.1 card 4111 1111-1111 1111 call +1 (462) 555-7216 password=6190852a02e4c4b9a4"),
             (73, "a@b.c_d@e.f 4111111111111112 00.0255.1.1 +12 345678 ++49 30 1234567 x@y@z.example.com"),
             (74, "é🙂 1.1.1.1 ü@x.yy ß +49 30 12345 67 4111111111111111")]
    return rows


def frame(spark, rows=None):
    rows = texts() if rows is None else rows
    langs = ("en", "de", None)
    data = [(i, t, langs[k % 3], f"src{k % 2}", len(t) if t is not None else None, "n", "k", k, "node", 0.5, "s", 3, 7, "x", 9.0, "d", 1, "y")
            for k, (i, t) in enumerate(rows)]
    return spark.createDataFrame(data, SCHEMA).repartition(3)


def labels(spark, rows=None):
    rows = texts() if rows is None else rows
    return spark.createDataFrame([(i, 1, 0) for i, _ in rows if i is not None][:20], "doc_id BIGINT, quality INT, toxic INT")
