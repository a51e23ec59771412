"""Small helpers that the corpus operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import released, stored, tidy  # noqa: F401

#: A word is a run of characters other than space, tab, line feed, vertical tab, form feed and carriage return.
WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: Column) -> Column:
    """Array of the words of a text; empty for a null or empty text."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), GAP, -1), "")


def held_out(doc_id: Column) -> Column:
    """True for the quarter of documents that no model may learn from."""
    return F.coalesce(F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 4 == 2, F.lit(False))


#: Hashes are drawn from so many values: far more than there are rows, so that a bounded share of any table is still told apart.
DRAWN_FROM = 1 << 48


def drawn_below(rows: int, count: int) -> int:
    """The number of the DRAWN_FROM values that take about rows of count rows; all of them, if there are no more rows than that."""
    return DRAWN_FROM if count <= rows else rows * DRAWN_FROM // count


def drawn(key: Column, rows: int, count: int) -> Column:
    """Whether a row with this hash is among about rows of count."""
    return F.pmod(key, F.lit(DRAWN_FROM)) < drawn_below(rows, count)


def dropped(*tables: DataFrame) -> None:
    """Delete tables of stored() that nothing reads any more."""
    for df in tables:
        spark = df.sparkSession
        for path in df.inputFiles()[:1]:
            folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path).getParent()
            folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)
