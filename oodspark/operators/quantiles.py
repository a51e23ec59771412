"""Exact quantiles by selection: no task ever holds or sorts a whole group.

A group of many rows is narrowed first.  Its value range is cut to bins, rows are counted by bin, and running sums over
the bins tell which of them hold the two order statistics that a quantile lies between.  Their own range is cut again
until few rows are left.  Only these are sorted.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources import stored

#: Rows of a group that are sorted as they are; a group of more is narrowed.  Bins of a range.
SORTED, BINS = 200_000, 65_536
#: A range is narrowed again as long as a turn leaves less than this share of its rows.
WORTH = 0.9
#: Narrowed groups are sent to all tasks up to this number: one has SORTED rows at least, so it takes 2 * 10 ** 10 rows to be above.
SENT = 100_000


def _ranks(q: float, n: Column) -> tuple[Column, Column, Column]:
    """Position of the quantile among n values from 0, and the ranks of the two values that it lies between."""
    at = F.lit(q) * (n - 1)
    low = F.floor(at)
    return at, low, F.least(low + 1, n - 1)


def _met(rows: DataFrame, marks: DataFrame, keys: Sequence[str], also: Column | None, how: str) -> DataFrame:
    """rows joined with marks on the keys, null with null, and a further condition; columns of marks are told by names of their own."""
    if marks.count() <= SENT:
        marks = F.broadcast(marks)
    marks = marks.withColumnsRenamed({k: f"_of_{k}" for k in keys})
    on = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_of_{k}")) for k in keys] + ([also] if also is not None else []), F.lit(True))
    return rows.join(marks, on, how).drop(*[f"_of_{k}" for k in keys])


def narrowed(rows: DataFrame, wanted: Sequence[float], keys: Sequence[str]) -> DataFrame | None:
    """For each group of rows (keys, _v) with more than SORTED values, and each wanted quantile by its place i: n, and the range _lo to _hi of inside values, with before values below it, that holds what the quantile needs; None if there is no such group."""
    large = rows.groupBy(*keys).agg(F.count("_v").alias("n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi")).filter(F.col("n") > SORTED)
    if large.isEmpty():
        return None
    first = large.select("*", F.explode(F.array(*map(F.lit, range(len(wanted))))).alias("i"), F.lit(0).cast("long").alias("before"), F.col("n").alias("inside"))
    ranges = stored(first.withColumn("open", F.col("_lo") < F.col("_hi")), "quantile-ranges")
    low = F.element_at(F.array(*[_ranks(q, F.col("n"))[1] for q in wanted]), F.col("i") + 1)
    high = F.element_at(F.array(*[_ranks(q, F.col("n"))[2] for q in wanted]), F.col("i") + 1)
    group = [*keys, "i", "n"]
    while not (at := ranges.filter("open")).isEmpty():
        within = _met(rows, at.select(*group, "_lo", "_hi", "before", "inside"), keys, F.col("_v").between(F.col("_lo"), F.col("_hi")), "inner")
        share = (F.col("_v") - F.col("_lo")) / (F.col("_hi") - F.col("_lo"))
        place = F.when(F.isnan("_v"), BINS).when(F.isnan(share), 0).otherwise(F.least(F.floor(share * BINS), F.lit(BINS - 1)))
        bins = within.groupBy(*group, "before", "inside", place.alias("bin")).agg(F.count("*").alias("c"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
        # at most BINS rows of a group and quantile
        upto = F.col("before") + F.sum("c").over(Window.partitionBy(*group).orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow))
        bins = bins.withColumn("upto", upto).filter((F.col("upto") > low) & (F.col("upto") - F.col("c") <= high))
        new = bins.groupBy(*group).agg(F.min("_lo").alias("_lo"), F.max("_hi").alias("_hi"), F.min(F.col("upto") - F.col("c")).alias("before"), F.sum("c").alias("inside"), F.first("inside").alias("old"), F.max(F.col("_lo") < F.col("_hi")).alias("wide"))
        new = new.withColumn("open", F.col("wide") & (F.col("inside") > SORTED) & (F.col("inside") < WORTH * F.col("old"))).drop("old", "wide")
        ranges = stored(ranges.filter("NOT open").unionByName(new), "quantile-ranges")
    return ranges.drop("open")


def quantiles(df: DataFrame, wanted: dict[str, float], keys: Sequence[str] = (), value: str = "score") -> DataFrame:
    """keys, and a column for each name in wanted: the linearly interpolated quantile of the values of each group.

    Nulls are left out; a group without values has NULLs, and without keys there is always one row.  NaN counts as the
    largest value.  How large groups are narrowed doesn't change the result.
    """
    names, qs = list(wanted), list(wanted.values())
    rows = df.select(*keys, F.col(value).cast("double").alias("_v"))
    ranges = narrowed(rows, qs, keys)
    if ranges is None:
        counts = rows.groupBy(*keys, "_v").agg(F.count("_v").alias("c")).withColumn("marks", F.lit(None).cast("array<struct<i:int,n:long,before:long,_lo:double,_hi:double>>"))
    else:
        marks = ranges.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("i", "n", "before", "_lo", "_hi"))).alias("marks"))  # one for each quantile
        rows = _met(rows, marks, keys, None, "left")
        rows = rows.filter(F.col("marks").isNull() | F.exists("marks", lambda m: F.col("_v").between(m["_lo"], m["_hi"])))
        counts = rows.groupBy(*keys, "_v").agg(F.count("_v").alias("c"), F.first("marks").alias("marks"))
    whole = Window.partitionBy(*(keys or [F.lit(0)]))
    upwards = whole.orderBy("_v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    all_ = F.sum("c").over(whole)
    for i in range(len(qs)):
        mark = F.get("marks", F.lit(i))
        inside = F.when(F.col("marks").isNull() | F.col("_v").between(mark["_lo"], mark["_hi"]), F.col("c")).otherwise(0)
        counts = counts.withColumns({f"_n{i}": F.coalesce(mark["n"], all_), f"_upto{i}": F.coalesce(mark["before"], F.lit(0)) + F.sum(inside).over(upwards), f"_in{i}": inside > 0})
    aggs = []
    for i, q in enumerate(qs):
        at, low, high = _ranks(q, F.col(f"_n{i}"))
        reached = lambda rank, i=i: F.min(F.when(F.col(f"_in{i}") & (F.col(f"_upto{i}") > rank), F.col("_v")))
        aggs += [reached(low).alias(f"_low{i}"), reached(high).alias(f"_high{i}"), F.max(at - low).alias(f"_share{i}")]
    found = counts.groupBy(*keys).agg(*aggs)
    between = lambda i: F.col(f"_low{i}") + (F.col(f"_high{i}") - F.col(f"_low{i}")) * F.col(f"_share{i}")
    return found.select(*keys, *[F.when(F.col(f"_low{i}") == F.col(f"_high{i}"), F.col(f"_low{i}")).otherwise(between(i)).alias(name) for i, name in enumerate(names)])
