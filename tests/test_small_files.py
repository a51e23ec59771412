"""Many small files through the stream of the gate: few tasks, folders and comparisons, and the same rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from oodspark import sources, streaming
from oodspark.operators import images, patches

SET = ("spark.sql.files.openCostInBytes", "spark.sql.codegen.factoryMode", "spark.sql.subexpressionElimination.enabled", "spark.sql.sources.parallelPartitionDiscovery.parallelism")


def test_few_tasks(spark, tmp_path, monkeypatch):
    """Hundreds of files are a few tasks, batches are bounded, no file is lost or read twice, and the session is as before."""
    monkeypatch.setattr(streaming, "BATCH_FILES", 400)
    rng = np.random.default_rng(3)
    data = [(i, 2, 2, 3, [float(v) for v in rng.integers(0, 256, 12)]) for i in range(600)]
    before, bank = [spark.conf.get(k) for k in SET], rng.uniform(0, 255, size=(7, 3))
    sources.write_images(spark.createDataFrame(data, images.SCHEMA), f"{tmp_path}/in/images", flat=True)
    assert len([p for p in (tmp_path / "in").rglob("*") if p.is_dir()]) <= 1 + sources.SIDE_BY_SIDE
    files = patches.file_scores(streaming.file_stream(spark, f"{tmp_path}/in"), patches.mean_grid, "layer1", bank)
    streaming.run_available(streaming.gate_stream(files, F.lit(80.0)), f"{tmp_path}/out", f"{tmp_path}/state")
    assert [spark.conf.get(k) for k in SET] == before
    assert len(list((tmp_path / "state" / "offsets").glob("[0-9]*"))) == 2
    assert len(list((tmp_path / "out").glob("part-*"))) <= 4 * spark.sparkContext.defaultParallelism
    got = {r["filename"]: r["score"] for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert spark.read.parquet(f"{tmp_path}/out").count() == len(got) == 600
    for i, *_, p in data:
        assert got[str(i)] == pytest.approx(np.linalg.norm(np.array(p).reshape(3, 4).mean(axis=1) - bank, axis=1).min(), abs=1e-4)


@pytest.mark.parametrize("flat", [False, True])
def test_odd_names(spark, tmp_path, flat):
    """Names come back as they went in, whichever way the files lie."""
    names = ["a b.png", "c+d.png", "50%.png", "e%20f.png", 'g"h.png', "i/j.png", "_k.png", ".l.png", "name=m.png", "ü.png"]
    sources.write_files(spark.createDataFrame([(n, b"no image") for n in names], "name string, data binary"), f"{tmp_path}/in/x", flat=flat)
    (tmp_path / "in" / "y").mkdir()
    for n in ("plain e+f.png", "plain %20.png"):
        (tmp_path / "in" / "y" / n).write_bytes(b"no image")
    streaming.run_available(streaming.file_stream(spark, f"{tmp_path}/in").select("filename", "length"), f"{tmp_path}/out", f"{tmp_path}/state")
    got = spark.read.parquet(f"{tmp_path}/out").collect()
    assert sorted(r["filename"] for r in got) == sorted([*names, "plain e+f.png", "plain %20.png"])


def test_scores_of_equal_patches(spark, monkeypatch):
    """Patches that recur are compared once; each image has the score it has alone, null where it was not decoded."""
    rng = np.random.default_rng(8)
    few, bank = rng.integers(0, 256, (5, 3)).astype(float), rng.uniform(0, 255, (40, 3))
    rows, want = [], []
    for i in range(90):
        h, w = (2, 4) if i % 3 else (6, 2)
        cells = few[rng.integers(0, 5, (h // 2, w // 2))]
        rows.append((f"{i}", 9, h, w, 3, None if i % 7 == 3 else [float(v) for v in cells.repeat(2, 0).repeat(2, 1).transpose(2, 0, 1).ravel()]))
        want.append(None if i % 7 == 3 else np.sort(np.linalg.norm(cells.reshape(-1, 1, 3) - bank, axis=2))[:, :2].mean(axis=1).max())
    asked = []
    monkeypatch.setattr(patches.kernels, "smallest_distances", lambda points, *a, f=patches.kernels.smallest_distances: asked.append(len(points)) or f(points, *a))
    monkeypatch.setattr(patches, "HELD_VALUES", 64)

    class Here:
        def select(self, *_):
            return self

        def mapInArrow(self, run, _):
            return run

    table = spark.createDataFrame(rows, "filename string, length long, height int, width int, channels int, pixels array<float>").toArrow()
    got = [x for b in patches.file_scores(Here(), patches.mean_grid, "layer1", bank, 2)(iter([*table.to_batches(), table.slice(5, 40).combine_chunks().to_batches()[0]])) for x in b["score"].to_pylist()]
    assert len(got) == 130 and max(asked) <= 5
    assert got == pytest.approx(want + want[5:45], abs=1e-6)
