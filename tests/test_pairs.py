"""The layout of all pairs: how many bytes a pair takes in files, and how much of them a task makes."""

import numpy as np

from oodspark.operators import patches


def frames(spark, points, rows, dims=5):
    rng = np.random.default_rng(9)
    made = [(name, rng.normal(size=(n, dims))) for name, n in (("vec_id", points), ("bank_id", rows))]
    return [spark.createDataFrame([(1000 + 7 * i, f"at {i}", [float(x) for x in row]) for i, row in enumerate(v)], f"{name} long, place string, embedding array<double>") for name, v in made], [v for _, v in made]


def test_bytes_of_a_pair(spark, tmp_path):
    """Beside the eight bytes of a distance, ids and what else a point has take next to nothing in files."""
    (asked, bank), (points, rows) = frames(spark, 640, 1500)
    patches.knn_pairwise(asked.repartition(1), bank).write.parquet(f"{tmp_path}/pairs")
    size = sum(p.stat().st_size for p in (tmp_path / "pairs").glob("part-*"))
    got = spark.read.parquet(f"{tmp_path}/pairs").toPandas()
    assert len(got) == 640 * 1500 and not got.duplicated(["vec_id", "bank_id"]).any()
    assert size / len(got) < 8.4
    i, j = (got["vec_id"].to_numpy() - 1000) // 7, (got["bank_id"].to_numpy() - 1000) // 7
    assert np.allclose(got["distance"], np.linalg.norm(points[i] - rows[j], axis=1), rtol=1e-9, atol=0)
    assert (got["place"] == [f"at {n}" for n in i]).all()


def test_pairs_of_a_task(spark, monkeypatch):
    """More pairs are more tasks; odd sizes and no points lose nothing."""
    monkeypatch.setattr(patches, "TASK_PAIRS", 1000)
    (asked, bank), _ = frames(spark, 131, 1030)
    made = patches.knn_pairwise(asked, bank)
    assert made.rdd.getNumPartitions() >= 131 * 1030 // 1000 and made.count() == 131 * 1030
    assert patches.knn_pairwise(asked.limit(0), bank).count() == 0
