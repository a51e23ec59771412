"""Nearest neighbours by balls and shells against plain distances."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from oodspark.functions import kernels
from oodspark.operators import balls, patches


def frame(spark, name, v):
    return spark.createDataFrame([(i, [float(x) for x in row]) for i, row in enumerate(v)], f"{name} long, embedding array<double>").repartition(4)


def clustered(rng, n, dims=6):
    return rng.normal(size=(12, dims))[rng.integers(0, 12, n)] * 20 + rng.normal(size=(n, dims)) * 0.3


@pytest.mark.parametrize("kind", ["clusters", "none", "copies", "line"])
def test_nearest(spark, kind):
    """Clusters, no structure, a bank of which a third is one vector, and a line; with patches that repeat each other."""
    rng = np.random.default_rng(2)
    if kind == "clusters":
        both = clustered(rng, 1500)
    elif kind == "line":
        both = np.outer(rng.uniform(-5, 5, 1500), np.ones(3))
    else:
        both = rng.normal(size=(1500, 6))
    bank, asked = both[:1200], both[1200:]
    if kind == "copies":
        bank[::3] = 0.5
        asked[::4] = 0.5
    asked = np.concatenate([asked, asked[:5]])
    found, figures = balls.nearest(frame(spark, "vec_id", asked), frame(spark, "bank_id", bank), 4, len(bank), block_rows=50)
    got = {r["vec_id"]: r["near"] for r in found.collect()}
    assert len(got) == len(asked)
    want = np.sort(kernels.distances(asked, bank), axis=1)[:, :4]
    assert np.allclose([got[i] for i in range(len(asked))], want, atol=1e-6)
    assert figures["shells"] > 20
    assert 1 - figures["met"] / (len(asked) * len(bank)) > {"clusters": 0.85, "line": 0.8, "copies": 0, "none": 0}[kind]


def test_few_rows(spark):
    """More neighbours wanted than a shell holds, and as many as there are."""
    rng = np.random.default_rng(3)
    bank, asked = rng.normal(size=(9, 2)), rng.normal(size=(5, 2))
    for k in (1, 5, 9):
        scored = patches.knn_scores(frame(spark, "vec_id", asked), frame(spark, "bank_id", bank).withColumn("embedding", F.transform("embedding", lambda x: x.cast("double"))), k, broadcast_bytes=0)
        got = {r["vec_id"]: r["patch_score"] for r in scored.collect()}
        assert np.allclose([got[i] for i in range(5)], np.sort(kernels.distances(asked, bank), axis=1)[:, :k].mean(axis=1))
        found, _ = balls.nearest(frame(spark, "vec_id", asked), frame(spark, "bank_id", bank), k, 9, block_rows=2)
        assert np.allclose([r["near"] for r in found.orderBy("vec_id").collect()], np.sort(kernels.distances(asked, bank), axis=1)[:, :k])
    with pytest.raises(patches.BankError):
        patches.knn_scores(frame(spark, "vec_id", asked), frame(spark, "bank_id", bank), 10, broadcast_bytes=0)
    assert patches.knn_scores(frame(spark, "vec_id", asked).limit(0), frame(spark, "bank_id", bank), 2, broadcast_bytes=0).count() == 0
