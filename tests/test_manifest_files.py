"""CSV files that are cut to splits in the middle of their fields."""

import csv
import random

import pytest

from oodspark import sources


@pytest.fixture
def small_splits(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "200b")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def made(seed, n):
    rng = random.Random(seed)
    field = lambda: rng.choice(["plain", "", "with, comma", 'a "quote"', '"', "two\nlines", "\n", "\n\n\nend", 'x"\n"y', "é ß", "long " * rng.randint(1, 80)])
    return [(str(i), field(), field()) for i in range(n)]


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_record_numbers(spark, tmp_path, small_splits, end):
    """Quotes, commas and line breaks in fields that lie across splits, of two files with their columns in another order."""
    want = {}
    for name, names in (("a", ["n", "one", "two"]), ("b", ["two", "n", "one"])):
        rows = made(name, 150)
        with open(tmp_path / f"{name}.csv", "w", newline="", encoding="utf-8") as f:
            w = csv.DictWriter(f, names, lineterminator=end)
            w.writeheader()
            w.writerows(dict(zip(("n", "one", "two"), r, strict=True)) for r in rows)
        want |= {(name, i + 2): r for i, r in enumerate(rows)}
    assert sources.csv_records(spark, str(tmp_path)).select("file").distinct().count() == 2
    assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 50
    got = sources.read_manifest(spark, str(tmp_path), line_numbers=True).collect()
    numbers = sorted((r["csv_row"], r["n"], r["one"] or "", r["two"] or "") for r in got)
    assert numbers == sorted((i, *r) for (_, i), r in want.items())


def test_odd_files(spark, tmp_path, small_splits):
    (tmp_path / "blank.csv").write_text('\n\na,b\n1,"x\n\n"\n\n\n2,y\n')
    rows = sources.read_manifest(spark, str(tmp_path / "blank.csv"), line_numbers=True).orderBy("csv_row").collect()
    assert [tuple(r) for r in rows] == [("1", "x\n\n", 2), ("2", "y", 3)]
    (tmp_path / "open.csv").write_text('a,b\n1,"never closed\n2,y\n' + "3,z\n" * 200)
    with pytest.raises(sources.SourceError, match="never closed"):
        sources.read_manifest(spark, str(tmp_path / "open.csv"))
    (tmp_path / "head.csv").write_text("a,b\n")
    assert sources.read_manifest(spark, str(tmp_path / "head.csv")).columns == ["a", "b"]
    assert sources.read_manifest(spark, str(tmp_path / "head.csv")).count() == 0
    (tmp_path / "none.csv").write_text("")
    with pytest.raises(sources.SourceError, match="empty"):
        sources.read_manifest(spark, str(tmp_path / "none.csv"))
