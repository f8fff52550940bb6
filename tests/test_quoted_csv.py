"""Quoted line breaks read by many tasks, against Python's own CSV reader."""

import csv
import random

import pytest

from frameprep.sources.csv import read_csv
from frameprep.sources.records import csv_records, has_quoted_breaks, read_quoted_csv


@pytest.fixture
def small_blocks(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    yield spark
    spark.conf.unset("spark.sql.files.maxPartitionBytes")


def _rows(n, seed):
    rnd = random.Random(seed)
    bits = ["a", "b c", ",", '"', '""', "\n", "\r\n", "\n\n", ',"', '",', "'", " ", "é", '"\n"', "7"]
    return [[str(k), "".join(rnd.choices(bits, k=rnd.randrange(9))) + "z", rnd.choice(["x", 'say "hi"\n,', "long " * 150 + "\nend"] if k % 17 == 0 else ["x", "y"])] for k in range(n)]


def _write(path, rows, end="\n"):
    with open(path, "w", newline="", encoding="utf-8") as f:
        csv.writer(f, lineterminator=end).writerows([["id", "text, or so", "kind"], *rows])


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_records_of_many_blocks(small_blocks, tmp_path, end):
    rows = _rows(600, 1)
    _write(tmp_path / "a.csv", rows, end)
    _write(tmp_path / "b.csv", _rows(80, 2), end)
    spark, path = small_blocks, str(tmp_path / "*.csv")
    assert has_quoted_breaks(spark, path)
    assert spark.read.text(path).rdd.getNumPartitions() > 20
    df = read_quoted_csv(spark, path)
    assert df.columns == ["id", "text, or so", "kind"]
    got = sorted(tuple(r) for r in df.collect())
    assert got == sorted(tuple(r) for r in rows + _rows(80, 2))


def test_typed_and_in_parallel(small_blocks, tmp_path):
    rows = _rows(300, 3)
    _write(tmp_path / "a.csv", rows)
    df = read_csv(small_blocks, str(tmp_path / "a.csv"))
    assert dict(df.dtypes)["id"] == "bigint" and df.count() == 300
    assert "multiLine" not in df._jdf.queryExecution().toString()
    want = {int(a): (b, c) for a, b, c in rows}
    assert {r["id"]: (r["text, or so"], r["kind"]) for r in df.collect()} == want


def test_a_record_longer_than_blocks_and_quotes_in_plain_fields(small_blocks, tmp_path):
    (tmp_path / "a.csv").write_text('id,v\n1,"' + "line\n" * 900 + '"\n2,5" pipe\n\n3,a"b"c\n4,"x"\n5\n', encoding="utf-8")
    got = {r["id"]: r["v"] for r in read_quoted_csv(small_blocks, str(tmp_path / "a.csv")).collect()}
    assert got == {"1": "line\n" * 900, "2": '5" pipe', "3": 'a"b"c', "4": "x", "5": None}
    assert csv_records(small_blocks, str(tmp_path / "a.csv")).count() == 7  # header, five rows, an empty line


def test_files_without_breaks_and_empty_ones(spark, tmp_path):
    (tmp_path / "a.csv").write_text('id,v\n1,"a ""b"", c"\n2,d\n', encoding="utf-8")
    path = str(tmp_path / "a.csv")
    assert not has_quoted_breaks(spark, path)
    assert sorted(tuple(r) for r in read_csv(spark, path).collect()) == [(1, 'a "b", c'), (2, "d")]
    (tmp_path / "b.csv").write_text("", encoding="utf-8")
    assert csv_records(spark, str(tmp_path / "b.csv")).count() == 0
