"""Nearest neighbours by shifted space-filling curves.

Each curve projects the vectors to a few random directions, shifts and quantises them and takes their place on a Hilbert
curve as key.  Every curve's key range is cut into blocks of about equal count.  A query looks at the blocks around its
own on each curve, and what it finds there is merged and ranked by the exact inner product.

The window is a share of the curve, so recall doesn't fall as the table grows.  How wide it must be depends on the data:
vectors without cluster structure need nearly half of each curve (see README), clustered ones far less.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._shared import stored

CURVES, DIRECTIONS, BITS, SEED = 4, 2, 10, 7
#: Blocks of a curve, and how many neighbouring ones a query looks at.
BLOCKS, LOOKED_AT = 16, 7
#: Most candidates and queries in one group of a task; a block with more is split.
CANDIDATES, QUERIES_EACH = 8192, 4096


def hilbert(x: np.ndarray, bits: int) -> np.ndarray:
    """Place on the Hilbert curve of points with integer coordinates below 2 ** bits, a row each."""
    x = x.astype(np.int64)
    n, dims = x.shape
    for level in range(bits - 1, 0, -1):  # undo the rotations and reflections of each level
        bit, low = 1 << level, (1 << level) - 1
        for i in range(dims):
            here = (x[:, i] & bit) != 0
            swap = np.where(here, 0, (x[:, 0] ^ x[:, i]) & low)
            x[:, 0] ^= np.where(here, low, swap)
            x[:, i] ^= swap
    for i in range(1, dims):
        x[:, i] ^= x[:, i - 1]
    flip = np.zeros(n, dtype=np.int64)
    for level in range(bits - 1, 0, -1):
        flip ^= np.where(x[:, -1] >> level & 1, (1 << level) - 1, 0)
    x ^= flip[:, None]
    key = np.zeros(n, dtype=np.int64)
    for level in range(bits - 1, -1, -1):
        for i in range(dims):
            key = key << 1 | (x[:, i] >> level & 1)
    return key


def curve_keys(v: np.ndarray, curves: int, directions: int, seed: int = SEED) -> np.ndarray:
    """Keys of the rows of v on each curve.  The length of a vector doesn't matter for its place."""
    rng, dims = np.random.default_rng(seed), v.shape[1]
    v = v / np.linalg.norm(v, axis=1, keepdims=True)
    out = np.empty((len(v), curves), dtype=np.int64)
    for c in range(curves):
        axes, _ = np.linalg.qr(rng.normal(size=(dims, min(directions, dims))))
        spread = 1 / (1 + np.exp(-1.7 * np.sqrt(dims) * (v @ axes)))  # about uniform
        shifted = 0.75 * spread + rng.uniform(0, 0.25, size=axes.shape[1])
        out[:, c] = hilbert(np.minimum(shifted * (1 << BITS), (1 << BITS) - 1).astype(np.int64), BITS)
    return out


def usable(vectors: DataFrame) -> DataFrame:
    """Distinct vec_id and embedding of the rows that can take part: id not null, vector neither null, zero nor of other than finite components."""
    good = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("embedding", lambda x: x != 0)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").filter(F.col("vec_id").isNotNull() & F.coalesce(good, F.lit(False)))
    return rows.distinct()


def nearest(vectors: DataFrame, is_query, k: int, curves: int = CURVES, directions: int = DIRECTIONS, blocks: int = BLOCKS, looked_at: int = LOOKED_AT) -> DataFrame:
    """query_id, rank, vec_id and score of the k largest inner products found for each row where is_query holds.

    Columns vec_id and embedding are read.  Ties go to the smaller vec_id; fewer than k rows if there are fewer
    candidates.  Rows that share an id count as one candidate, by the best of them, and are no candidates of each other.
    looked_at >= blocks makes the search exact.  Blocks are cut by ids, not rows, and each is to have k + 1 ids at least,
    so small tables are searched whole and an id of many rows doesn't narrow the window.  Vectors of different lengths
    have no inner product: those of each length are searched among themselves, and an id's rows of all lengths are one
    candidate.
    """
    rows = usable(vectors)
    lengths = sorted(r["n"] for r in rows.select(F.size("embedding").alias("n")).distinct().collect())  # a row for each length
    found = [nearest_of_length(rows.filter(F.size("embedding") == n) if len(lengths) > 1 else rows, is_query, k, curves, directions, blocks, looked_at) for n in lengths or [0]]
    found = reduce(DataFrame.union, found).groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def nearest_of_length(vectors: DataFrame, is_query, k: int, curves: int, directions: int, blocks: int, looked_at: int) -> DataFrame:
    """query_id, vec_id and score of at least the k best found on all curves, each pair once for each group that found it."""

    def keyed(batches):
        for b in batches:
            if len(b):
                v = np.stack(b["embedding"].to_numpy()).astype(np.float64)
                yield b.assign(keys=list(curve_keys(v, curves, directions)))

    kind = dict(vectors.dtypes)["embedding"]
    rows = stored(vectors.mapInPandas(keyed, f"vec_id long, embedding {kind}, keys array<long>"), "ann-keys")
    on = rows.select("vec_id", "embedding", F.posexplode("keys").alias("curve", "key"))
    blocks = max(1, min(blocks, rows.select("vec_id").distinct().count() // (k + 1)))  # so few ids that all are wanted are one block
    at = [i / blocks for i in range(1, blocks)] or [1.0]
    cuts = {r["curve"]: r["cuts"] for r in on.groupBy("curve", "vec_id").agg(F.min("key").alias("key")).groupBy("curve").agg(F.percentile_approx("key", at, 10_000).alias("cuts")).collect()}  # a row for each curve
    cut = F.create_map(*[F.lit(x) for c in sorted(cuts) for x in (c, cuts[c])]) if cuts else F.create_map().cast("map<int,array<long>>")
    on = on.withColumn("block", F.size(F.filter(cut[F.col("curve")], lambda c: c < F.col("key"))))
    query = is_query(F.col("vec_id"))
    counts = on.groupBy("curve", "block").agg(F.count("*").alias("n"), F.count_if(query).alias("q")).collect()  # curves * blocks rows
    parts = {(r["curve"], r["block"]): -(-r["n"] // CANDIDATES) for r in counts}
    queries_in = {(r["curve"], r["block"]): r["q"] for r in counts}

    def window(block: int) -> range:
        first = min(max(block - looked_at // 2, 0), max(blocks - looked_at, 0))
        return range(first, min(first + looked_at, blocks))

    looking = {cell: max(1, -(-sum(queries_in.get((cell[0], b), 0) for b in range(blocks) if cell[1] in window(b)) // QUERIES_EACH)) for cell in parts}
    seen_by = rows.sparkSession.createDataFrame([(c, b, s, parts[c, s], looking[c, s]) for c, b in parts for s in window(b) if (c, s) in parts] or [(-1, -1, -1, 1, 1)], "curve int, block int, seen int, n_parts int, n_lots int")
    n_parts = seen_by.select("curve", F.col("seen").alias("block"), "n_parts", "n_lots").distinct()
    spread = lambda salt, n: F.pmod(F.xxhash64("vec_id", "embedding", F.lit(salt)), n).cast("int")
    # the three small tables have at most curves * blocks * looked_at rows, or a row for each group of a task
    there = on.join(F.broadcast(n_parts), ["curve", "block"]).withColumn("part", spread("part", F.col("n_parts")))
    there = there.select("vec_id", "embedding", "curve", "block", "part", F.explode(F.sequence(F.lit(0), F.col("n_lots") - 1)).alias("lot"))
    asked = on.filter(query).join(F.broadcast(seen_by), ["curve", "block"]).withColumn("lot", spread("lot", F.col("n_lots")))
    asked = asked.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"), F.col("curve").alias("c"), F.col("seen").alias("b"), F.explode(F.sequence(F.lit(0), F.col("n_parts") - 1)).alias("p"), F.col("lot").alias("l"))

    def ranked(q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        if not len(q) or not len(c):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype({"query_id": "int64", "vec_id": "int64"})
        qs, cs = (np.stack(x.to_numpy()).astype(np.float64) for x in (q["vector"], c["embedding"]))
        ids, out = c["vec_id"].to_numpy(), []
        order = np.argsort(ids, kind="stable")
        ids, cs = ids[order], cs[order]
        heads = np.flatnonzero(np.r_[True, ids[1:] != ids[:-1]])  # the first row of each id
        for start in range(0, len(q), 256):
            near = qs[start : start + 256] @ cs.T
            for i, row in enumerate(near, start):
                own = q["query_id"].iat[i]
                row[ids == own] = -np.inf
                best = np.maximum.reduceat(row, heads) if len(heads) < len(row) else row  # of each id
                least = np.partition(best, -k)[-k] if len(best) > k else -np.inf
                found = np.flatnonzero((row >= least - 1e-9 * max(1.0, abs(least))) & (row > -np.inf)) if least > -np.inf else np.flatnonzero(row > -np.inf)
                exact = (cs[found] * qs[i]).sum(axis=1)  # the same order of additions wherever the vector stands
                first = np.lexsort((ids[found], -exact))
                first = first[np.sort(np.unique(ids[found][first], return_index=True)[1])[:k]]  # the best row of each of k ids
                out.append(pd.DataFrame({"query_id": own, "vec_id": ids[found][first], "score": exact[first]}))
        return pd.concat(out, ignore_index=True)

    return asked.groupBy("c", "b", "p", "l").cogroup(there.groupBy("curve", "block", "part", "lot")).applyInPandas(ranked, "query_id long, vec_id long, score double")


def op6_hilbert_neighbours(spark, sf_dir):
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), lambda i: i % 20 == 0, 20)


QUERIES = {"op6_hilbert_neighbours": op6_hilbert_neighbours}
ORACLES: dict[str, str] = {}
