"""Exact nearest neighbours of many vectors in a bank too large to send: balls, shells and the triangle inequality.

Some bank rows are pivots.  Every bank row belongs to the ball of its nearest pivot, and a large ball is cut to shells by
the distance to the pivot.  A vector first meets the nearest shells, which bounds its k-th distance from above.  The
distance to a pivot bounds the distance to all that lies in a shell from below, so the vector then meets only those
shells whose bound is not beyond what it has.  Vectors and bank rows come together by shell, in bounded groups.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import kernels
from ..sources import released, stored

#: Most pivots, steps in which the distances of a ball are measured, and aim for bank rows and vectors in a group of a task.
PIVOTS, GRID, BLOCK_ROWS = 1024, 64, 16_384
#: Bounds are taken this much of the largest distance wider than computed.
SLACK = 1e-7
#: Pairs of a vector and a shell that a task looks at together.
LOOKED_AT = 1 << 19
#: Most visits, each with its vector, that a task hands on together.
VISITS = 4096


def _stack(x: pd.Series) -> np.ndarray:
    return np.stack(x.to_numpy()).astype(np.float64)


def pivots_of(bank: DataFrame, count: int) -> np.ndarray:
    """The count bank rows of the smallest hash."""
    rows = bank.select("embedding", F.xxhash64("embedding").alias("h")).orderBy("h").limit(count).collect()  # PIVOTS rows at most
    return np.array([r["embedding"] for r in rows], dtype=np.float64)


def dealt(bank: DataFrame, pivots: np.ndarray, block_rows: int) -> tuple[DataFrame, pd.DataFrame]:
    """The bank with shell, part and nothing but embedding, and the shells: pivot, low and high (distances to it), n and parts (pieces of a shell of too many rows)."""

    def nearest(batches):
        for b in batches:
            if len(b):
                far = kernels.distances(_stack(b["embedding"]), pivots)
                at = far.argmin(axis=1)
                yield pd.DataFrame({"embedding": b["embedding"], "pivot": at.astype(np.int32), "far": far[np.arange(len(b)), at]})

    rows = stored(bank.select("embedding").mapInPandas(nearest, "embedding array<double>, pivot int, far double"), "bank-balls")
    steps = [i / GRID for i in range(1, GRID)]
    cuts = rows.groupBy("pivot").agg(F.count("*").alias("rows"), F.percentile_approx("far", steps, 1000).alias("cuts"))  # PIVOTS rows at most
    share = F.size(F.filter("cuts", lambda c: c < F.col("far"))) / GRID
    place = F.floor(share * F.least(F.ceil(F.col("rows") / block_rows), F.lit(GRID))).cast("int")
    shelved = rows.join(F.broadcast(cuts), "pivot").select("embedding", "pivot", "far", place.alias("place"))
    shells = shelved.groupBy("pivot", "place").agg(F.min("far").alias("low"), F.max("far").alias("high"), F.count("*").alias("n")).toPandas()  # PIVOTS * GRID rows at most
    shells = shells.sort_values(["pivot", "place"], ignore_index=True)
    shells["parts"] = -(-shells["n"] // block_rows)
    names = rows.sparkSession.createDataFrame([(int(p), int(a), i, int(c)) for i, (p, a, c) in enumerate(zip(shells["pivot"], shells["place"], shells["parts"], strict=True))], "pivot int, place int, shell int, parts int")
    named = shelved.join(F.broadcast(names), ["pivot", "place"])
    named = named.select("shell", F.pmod(F.xxhash64("embedding", F.monotonically_increasing_id()), F.col("parts")).cast("int").alias("part"), F.col("embedding").alias("vector"))
    named = stored(named, "bank-shells")
    released(rows)
    return named, shells


class Bounds:
    """Which shells a vector must meet."""

    def __init__(self, pivots: np.ndarray, shells: pd.DataFrame, k: int):
        self.pivots, self.k = pivots, k
        self.pivot, self.low, self.high, self.n = (shells[c].to_numpy() for c in ("pivot", "low", "high", "n"))

    def portions(self, points: np.ndarray):
        """Slices of points with the least and the largest distance to anything in each shell, and the shells that a point meets first: the nearest ones that hold k rows together."""
        each = max(1, LOOKED_AT // len(self.n))
        for start in range(0, len(points), each):
            far = kernels.distances(points[start : start + each], self.pivots)
            slack = SLACK * (float(far.max()) + float(self.high.max()))
            far = far[:, self.pivot]
            least = np.maximum(np.maximum(far - self.high, self.low - far) - slack, 0)
            order = np.lexsort((far + self.high, least), axis=1)
            before = np.cumsum(self.n[order], axis=1) - self.n[order]
            first = np.zeros_like(far, dtype=bool)
            np.put_along_axis(first, order, before < self.k, axis=1)
            yield slice(start, start + len(far)), least, first


def nearest(patches: DataFrame, bank: DataFrame, k: int, rows: int, block_rows: int = BLOCK_ROWS) -> tuple[DataFrame, dict[str, int]]:
    """patches (with their columns) with near, the k smallest distances to the bank of so many rows, ascending; and the number of shells, and of pairs of a patch and a bank row that were compared.

    Patches may repeat each other.
    """
    pivots = pivots_of(bank, max(1, min(PIVOTS, -(-rows // block_rows) * 4, rows)))
    balls, shells = dealt(bank.select(F.transform("embedding", lambda x: x.cast("double")).alias("embedding")), pivots, block_rows)
    bounds, sizes = Bounds(pivots, shells, k), shells["n"].to_numpy()
    named = stored(patches.withColumn("_row", F.monotonically_increasing_id()), "knn-patches")
    asked = named.select("_row", F.transform("embedding", lambda x: x.cast("double")).alias("embedding"))
    schema = "_row long, embedding array<double>, shell int"

    def visits_of(b: pd.DataFrame, wanted: np.ndarray):
        i, shell = np.nonzero(wanted)
        for start in range(0, len(i), VISITS):
            yield b.iloc[i[start : start + VISITS]].assign(shell=shell[start : start + VISITS].astype(np.int32))

    def at_first(batches):
        for b in batches:
            for part, _, first in bounds.portions(_stack(b["embedding"]) if len(b) else np.zeros((0, pivots.shape[1]))):
                yield from visits_of(b.iloc[part], first)

    def then(batches):
        for b in batches:
            most = b.pop("most").to_numpy()
            for part, least, first in bounds.portions(_stack(b["embedding"]) if len(b) else np.zeros((0, pivots.shape[1]))):
                yield from visits_of(b.iloc[part], (least <= most[part, None]) & ~first)

    def met(visits: DataFrame, turn: int) -> tuple[DataFrame, int]:
        """_row and near for each visit, and how many pairs were compared."""
        visits = stored(visits, f"knn-visits-{turn}")
        counts = {r["shell"]: r["n"] for r in visits.groupBy("shell").agg(F.count("*").alias("n")).collect()}  # a row for each shell
        plan = [(s, int(shells["parts"][s]), -(-n // block_rows)) for s, n in counts.items()]
        plan = F.broadcast(visits.sparkSession.createDataFrame(plan, "shell int, parts int, lots int"))
        left = visits.join(plan, "shell").select("_row", "embedding", "shell", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.pmod(F.xxhash64("_row"), F.col("lots")).cast("int").alias("lot"))
        right = balls.join(plan.select("shell", "lots"), "shell").select("shell", "part", "vector", F.explode(F.sequence(F.lit(0), F.col("lots") - 1)).alias("lot"))

        def compare(p: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
            if not len(p) or not len(b):
                return pd.DataFrame({"_row": [], "near": []})
            return pd.DataFrame({"_row": p["_row"], "near": list(kernels.smallest_distances(_stack(p["embedding"]), _stack(b["vector"]), k))})

        key = ["shell", "part", "lot"]
        found = stored(left.groupBy(*key).cogroup(right.groupBy(*key)).applyInPandas(compare, "_row long, near array<double>"), f"knn-near-{turn}")
        released(visits)
        return found, sum(int(sizes[s]) * n for s, n in counts.items())

    best = lambda found: found.groupBy("_row").agg(F.slice(F.array_sort(F.flatten(F.collect_list("near"))), 1, k).alias("near"))
    one, pairs = met(asked.mapInPandas(at_first, schema), 1)
    limit = best(one).select("_row", F.element_at("near", -1).alias("most"))
    two, more = met(asked.join(limit, "_row").mapInPandas(then, schema), 2)
    released(balls)
    return named.join(best(one.union(two)), "_row").drop("_row"), {"shells": len(shells), "met": pairs + more}
