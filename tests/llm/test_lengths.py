"""Neighbours among vectors of several lengths and sizes."""

import collections

import numpy as np

from oodspark.llm import neighbours
from pyspark.sql import functions as F


def test_lengths(spark):
    """Vectors are searched among those of their length; an id with rows of two lengths is one candidate, by the best of them."""
    rng = np.random.default_rng(8)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(size=16)]) for i in range(150)]
    rows += [(i, [float(np.float32(x)) for x in rng.normal(size=4) * 10.0 ** rng.integers(-3, 4)]) for i in range(140, 260)] + [(400, [1.0, 2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumns({"rank": F.lit(1), "block": F.lit("b")})
    got = collections.defaultdict(list)
    for r in neighbours.nearest(df, lambda i: i % 20 == 0, 6, looked_at=neighbours.BLOCKS).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    want = {}
    for q in range(0, 260, 20):
        best = {}
        for a in (v for i, v in rows if i == q):
            for i, b in rows:
                if i != q and len(a) == len(b):
                    best[i] = max(best.get(i, -np.inf), float(np.dot(a, b)))
        want[q] = sorted(best.items(), key=lambda x: (-x[1], x[0]))[:6]
    assert set(got) == set(want)  # id 400 has no other of its length
    for q in want:
        assert [i for i, _ in got[q]] == [i for i, _ in want[q]] and np.allclose([s for _, s in got[q]], [s for _, s in want[q]])
