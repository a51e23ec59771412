"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import dropped, stored


def components(links: DataFrame, name: str = "links") -> DataFrame:
    """node and label of every node in links (columns a, b): the smallest node that links reach.

    Each round hooks every node to its smallest neighbour, follows the hooks and joins linked nodes into one, so rounds
    grow with the logarithm of the longest chain.  Rounds are written to the shared folder; nothing is gathered.
    """
    spark = links.sparkSession
    live = stored(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a <> b").distinct(), f"{name}-0")
    names = stored(live.select(F.col("a").alias("node")).union(live.select("b")).distinct().select("node", F.col("node").alias("label")), f"{name}-names")
    turn = 0
    while not live.isEmpty():
        turn += 1
        both = live.union(live.select("b", "a"))
        hook = both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("up"))
        for _ in range(2):  # two steps along the hooks
            over = hook.select(F.col("node").alias("up"), F.col("up").alias("far"))
            hook = hook.join(over, "up", "left").select("node", F.coalesce("far", "up").alias("up"))
        hook = stored(hook, f"{name}-hook-{turn}")
        old_names, old_live = names, live
        at = hook.select(F.col("node").alias("label"), "up")
        names = stored(names.join(at, "label", "left").select("node", F.coalesce("up", "label").alias("label")), f"{name}-names-{turn}")
        a, b = hook.select(F.col("node").alias("a"), F.col("up").alias("ua")), hook.select(F.col("node").alias("b"), F.col("up").alias("ub"))
        live = live.join(a, "a").join(b, "b").select(F.least("ua", "ub").alias("a"), F.greatest("ua", "ub").alias("b")).filter("a <> b").distinct()
        live = stored(live, f"{name}-{turn}")
        dropped(hook, old_names, old_live)
    return names
