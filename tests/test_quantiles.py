"""Quantiles by selection against sorting."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from oodspark.operators import quantiles

QS = {"a": 0.95, "b": 0.5, "c": 0.001, "d": 0.25}


def plain(values, q):
    v = np.sort(np.array([x for x in values if x is not None], dtype=float))
    if not len(v):
        return None
    at = q * (len(v) - 1)
    low = int(at)
    a, b = v[low], v[min(low + 1, len(v) - 1)]
    return a if a == b else a + (b - a) * (at - low)


def shapes():
    rng = random.Random(6)
    return {
        "even": [rng.random() for _ in range(900)],
        "ties": [float(rng.randint(0, 3)) for _ in range(700)],
        "one value": [2.5] * 500,
        "two values": [1.0] * 300 + [2.0] * 300,
        "far out": [rng.random() for _ in range(500)] + [1e308, -1e308],
        "close": [1e9 + rng.random() * 1e-4 for _ in range(600)],
        "any scale": [rng.choice((-1, 1)) * 10.0 ** rng.uniform(-300, 300) for _ in range(500)],
        "few": [3.0, 1.0],
        "one": [7.0],
        "nulls": [None, None],
        None: [rng.gauss(0, 1) if i % 7 else None for i in range(800)],
        "endless": [rng.random() for _ in range(300)] + [float("inf")] * 200 + [float("-inf")] * 200,
    }


@pytest.mark.parametrize(("most", "bins"), [(200_000, 65_536), (40, 16)])
def test_quantiles(spark, monkeypatch, most, bins):
    """Groups of all shapes, null keys among them, whole and narrowed in turns."""
    monkeypatch.setattr(quantiles, "SORTED", most)
    monkeypatch.setattr(quantiles, "BINS", bins)
    rows = [(k, v) for k, values in shapes().items() for v in values]
    df = spark.createDataFrame(rows, "kind string, score double").repartition(6).persist()
    got = {r["kind"]: r for r in quantiles.quantiles(df, QS, ["kind"]).collect()}
    assert set(got) == set(shapes())
    for kind, values in shapes().items():
        for name, q in QS.items():
            want, has = plain(values, q), got[kind][name]
            assert has is want is None or has == pytest.approx(want, rel=1e-12), (kind, q)
    kept = [v for k, v in rows if k not in ("any scale", "far out", "endless")]
    one = quantiles.quantiles(df.filter("kind IS NULL OR kind NOT IN ('any scale', 'far out', 'endless')"), QS).first()
    assert [one[n] for n in QS] == pytest.approx([plain(kept, q) for q in QS.values()], rel=1e-12)
    assert quantiles.quantiles(df.limit(0), QS).collect() == [(None, None, None, None)]
    assert quantiles.quantiles(df.limit(0), QS, ["kind"]).count() == 0


def test_many_rows(spark):
    """A million rows in one group and a tenth of it in others, against Spark's own exact percentile."""
    df = spark.range(1_100_000).select(F.when(F.col("id") % 11 == 0, F.col("id") % 77).alias("k"), (F.pmod(F.xxhash64("id"), F.lit(10**12)) / 1e6 + F.when(F.col("id") % 5 == 0, 3).otherwise(0)).alias("score"))
    ranges = quantiles.narrowed(df.select("k", F.col("score").alias("_v")), [0.95], ["k"])
    assert [(r["k"], r["n"]) for r in ranges.collect()] == [(None, 1_000_000)] and ranges.first()["inside"] < 1000
    got = {r["k"]: r["p95"] for r in quantiles.quantiles(df, {"p95": 0.95}, ["k"]).collect()}
    want = {r["k"]: r["p"] for r in df.groupBy("k").agg(F.percentile("score", 0.95).alias("p")).collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], rel=1e-12) for k in want)
