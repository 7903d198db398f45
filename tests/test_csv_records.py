"""Quoted CSV by byte ranges against the unsplit reader and the csv module."""

import csv
import io
import random

import pytest

from riskweave.session import scratch_path
from riskweave.sources import csv_records as C


def awkward(seed, rows=400, columns=5):
    rng = random.Random(seed)
    pool = ["", "plain", "a,b", 'say "hi"', "two\nlines", "x\n\n\ny", '"', '""', "\n", ",", '",\n"', " lead", "é日本", "tail\r\nnext", "a\nb,c\n" * 20]
    return [[rng.choice(pool) if rng.random() < 0.5 else str(rng.randrange(10 ** 6)) for _ in range(columns)] for _ in range(rows)]


def write(path, rows, end="\n", quoting=csv.QUOTE_MINIMAL):
    out = io.StringIO()
    csv.writer(out, lineterminator=end, quoting=quoting).writerows(rows)
    path.write_text(out.getvalue(), newline="")
    return out.getvalue()


@pytest.fixture
def small_ranges(spark):
    keys = {"spark.sql.files.maxPartitionBytes": "700", "spark.sql.files.openCostInBytes": "1", "spark.sql.files.minPartitionNum": "1"}
    held = {k: spark.conf.getAll.get(k) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield
    for k, v in held.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


@pytest.mark.parametrize("end, quoting", [("\n", csv.QUOTE_MINIMAL), ("\r\n", csv.QUOTE_MINIMAL), ("\n", csv.QUOTE_ALL)])
def test_many_ranges_equal_the_csv_module(spark, small_ranges, tmp_path, end, quoting):
    rows = awkward(1)
    write(tmp_path / "a.csv", [list("abcde"), *rows], end, quoting)
    panel, rejected = C.read_csv(spark, str(tmp_path))
    assert C.read_lines(spark, str(tmp_path)).rdd.getNumPartitions() > 20
    got = sorted(tuple(x or "" for x in r) for r in panel.collect())
    assert panel.columns == list("abcde") and got == sorted(map(tuple, rows)) and rejected.count() == 0


def test_equals_the_unsplit_reader(spark, small_ranges, tmp_path):
    for k in range(3):
        write(tmp_path / f"{k}.csv", [list("abcde"), *awkward(k + 5, 100)])
    (tmp_path / "stray.csv").write_text('a,b,c,d,e\n5" pipe,2,3" x,4,5\n\n1,"q"tail,3,4,5\n1, "x",3,4,""\n', newline="")
    panel, _ = C.read_csv(spark, str(tmp_path))
    plain = spark.read.options(header=True, multiLine=True, **C.OPTIONS).csv(str(tmp_path))
    assert sorted(map(repr, panel.collect())) == sorted(map(repr, plain.collect()))


def test_records_without_quotes_stay_in_order_of_lines(spark, small_ranges, tmp_path):
    write(tmp_path / "a.csv", [["n", "v"], *[[i, "x" * (i % 40)] for i in range(500)]])
    lines = {r["line"]: r["record"] for r in C.read_records(spark, str(tmp_path)).collect()}
    assert len(lines) == 501 and all(lines[i + 2].startswith(f"{i},") for i in range(500))


def test_cell_longer_than_many_ranges(spark, small_ranges, tmp_path):
    long = "line of the cell, with a comma\n" * 500
    write(tmp_path / "a.csv", [["a", "b"], ["1", long], ["2", "short"], ["3", long + "end"]])
    panel, rejected = C.read_csv(spark, str(tmp_path))
    assert sorted(map(tuple, panel.collect())) == [("1", long), ("2", "short"), ("3", long + "end")] and rejected.count() == 0


def test_rejected_records_name_file_and_line(spark, small_ranges, tmp_path):
    (tmp_path / "a.csv").write_text('a,b,c\n1,"x\ny",3\n4,5\n6,7,8,9\n"1\n2",3,4,"5\n6"\n7,8,9\n', newline="")
    panel, rejected = C.read_csv(spark, str(tmp_path))
    assert sorted(map(tuple, panel.collect()), key=str) == [("1", "x\ny", "3"), ("4", "5", None), ("7", "8", "9")]
    found = sorted((r["line"], r["cells"], r["error"], r["record"]) for r in rejected.collect())
    assert found == [(4, 2, C.TOO_FEW, "4,5"), (5, 4, C.TOO_MANY, "6,7,8,9"), (6, 4, C.TOO_MANY, '"1\n2",3,4,"5\n6"')]
    assert {r["path"].rsplit("/", 1)[-1] for r in rejected.collect()} == {"a.csv"}


def test_changed_ranges_raise(spark, small_ranges, tmp_path):
    write(tmp_path / "a.csv", [["a", "b"], *[[i, "y" * 30] for i in range(300)]])
    records = C.read_records(spark, str(tmp_path))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1300")
    with pytest.raises(Exception, match="byte ranges of the input changed"):
        records.select("line").collect()


def test_header_only_and_unclosed(spark, tmp_path):
    (tmp_path / "a.csv").write_text("a,b\n")
    panel, rejected = C.read_csv(spark, str(tmp_path))
    assert panel.columns == ["a", "b"] and panel.count() == 0 and rejected.count() == 0
    (tmp_path / "a.csv").write_text('a,b\n1,2\n3,"open\nto the end')
    panel, _ = C.read_csv(spark, str(tmp_path))
    assert panel.count() == 2
