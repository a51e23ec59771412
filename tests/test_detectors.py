"""Detectors, the export of gate tables, gate thresholds from files and the stream of image files."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from oodspark import sources, streaming
from oodspark.operators import autoencoder, decisions, detectors, gate, images, patches


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(1)
    data = []
    for i in range(40):
        label = int(i % 4 == 3)
        for p in range(4):
            data.append((i, p // 2, p % 2, [float(v) for v in rng.normal(size=3) + 4 * label], label, "far" if label else "id", ("train", "val", "test")[i % 3]))
    return spark.createDataFrame(data, "image_id long, patch_row int, patch_col int, embedding array<double>, label int, ood_type string, role string").repartition(3).persist()


def test_detectors(rows):
    """Two detectors and a function feed the same evaluation; only one gives maps."""
    train = rows.filter("role = 'train' AND label = 0")
    near = detectors.Neighbours(train.select(F.monotonically_increasing_id().alias("bank_id"), "embedding"), 2)
    rebuilt = detectors.Reconstruction(autoencoder.fitted(train, 1))
    own = detectors.Custom(lambda r: r.groupBy("image_id").agg(F.max(F.element_at("embedding", 1)).alias("score")))
    for detector in (near, rebuilt, own):
        row = detectors.evaluated(detector, rows.filter("role <> 'train'")).first()
        assert row["auroc"] > 0.8 and row["tn"] + row["fp"] + row["fn"] + row["tp"] == 13 and row["threshold_source"] == decisions.VALIDATION
        assert detectors.evaluated(detector, rows.filter("role <> 'train'"), 1e9).first()["tp"] == 0
    assert near.maps(rows).count() == 160
    for detector in (rebuilt, own):
        with pytest.raises(detectors.DetectorError):
            detector.maps(rows)


@pytest.mark.parametrize(("change", "message"), [
    (lambda s: s.filter("image_id <> 7"), "image 7 was not scored"),
    (lambda s: s.union(s.filter("image_id = 3")), "image 3 was scored more than once"),
    (lambda s: s.union(s.filter("image_id = 3").withColumn("image_id", F.lit(99).cast("long"))), "image 99 was not asked for"),
    (lambda s: s.withColumn("score", F.when(F.col("image_id") != 5, F.col("score"))), "image 5 was not scored by a finite"),
    (lambda s: s.withColumn("score", F.when(F.col("image_id") == 5, float("nan")).otherwise(F.col("score"))), "image 5 was not scored by a finite"),
    (lambda s: s.withColumnRenamed("score", "other"), "must give"),
])
def test_refused_scores(rows, change, message):
    detector = detectors.Custom(lambda r: change(r.groupBy("image_id").agg(F.lit(1.0).alias("score"))))
    with pytest.raises(detectors.DetectorError, match=message):
        detectors.scored(detector, rows)


def test_refused_patches(rows):
    fine = detectors.Custom(lambda r: r.groupBy("image_id").agg(F.lit(1.0).alias("score")))
    with pytest.raises(detectors.DetectorError, match="lack"):
        detectors.scored(fine, rows.drop("label"))
    with pytest.raises(detectors.DetectorError, match="several ways"):
        detectors.scored(fine, rows.withColumn("label", F.when(F.col("image_id") == 4, F.col("patch_row")).otherwise(0)))


def test_export(spark, tmp_path):
    """Quotes, commas and line breaks, nulls, and a failing job that leaves the old table."""
    schema = "name string, score double, note string"
    data = [('a "b"', 0.1 + 0.2, "x, y"), ("line\nbreak", None, None), (" padded ", -1e-300, '"')]
    path = f"{tmp_path}/out.csv"
    sources.export_csv(spark.createDataFrame(data, schema).coalesce(1), path)
    assert sorted(map(str, sources.read_export(spark, path, schema).collect())) == sorted(map(str, spark.createDataFrame(data, schema).collect()))
    text = "".join(p.read_text() for p in (tmp_path / "out.csv").glob("part-*"))
    assert text.startswith('"name","score","note"\n') and '"a ""b""","0.30000000000000004","x, y"\n' in text and '"","")' not in text
    with pytest.raises(Exception, match="(?i)fails"):
        sources.export_csv(spark.range(3).select(F.raise_error(F.lit("it fails")).cast("string").alias("name")), path)
    assert sources.read_export(spark, path, schema).count() == 3
    sources.export_csv(spark.createDataFrame(data[:1], schema), path)
    assert sources.read_export(spark, path, schema).count() == 1
    assert [p.name for p in tmp_path.iterdir() if "out.csv" in p.name and len(p.name) < 10] == ["out.csv"]


def test_gate_threshold(spark, tmp_path):
    told = lambda **how: decisions.gate_threshold(spark, 0.3, **how)
    (tmp_path / "evaluation").mkdir()
    (tmp_path / "evaluation" / "metrics.json").write_text(json.dumps({"threshold": {"value": 0.42}}, indent=1))
    (tmp_path / "empty.json").write_text(json.dumps({"threshold": {"value": None}}))
    model = f"{tmp_path}/model"
    assert told() == 0.3 and told(threshold=0.9, model_path=model) == 0.9
    assert told(model_path=model) == 0.42 and told(metrics_path=f"{tmp_path}/none.json", model_path=model) == 0.3
    with pytest.raises(decisions.ThresholdError):
        told(metrics_path=f"{tmp_path}/empty.json")
    assert decisions.gate_threshold(spark, None, model_path=f"{tmp_path}/elsewhere/model") is None


def test_stream_of_files(spark, tmp_path):
    """A stream that is stopped and taken up again neither loses nor repeats a file, and scores as a table does."""
    rng = np.random.default_rng(2)
    data = [(i, 4, 4, 3, [float(v) for v in rng.integers(0, 256, 48)]) for i in range(12)]
    bank = rng.uniform(0, 255, size=(5, 3))
    folder, out = f"{tmp_path}/in", f"{tmp_path}/out"
    lots = [data[:5], data[5:6], data[6:]]
    for n, lot in enumerate(lots):
        sources.write_images(spark.createDataFrame(lot, images.SCHEMA), f"{folder}/{n}")
        sources.write_files(spark.createDataFrame([(f"broken {n}.png", b"no image")], "name string, data binary"), f"{folder}/bad-{n}")
        files = patches.file_scores(streaming.file_stream(spark, folder), patches.mean_grid, "layer1", bank, 2)
        streaming.run_available(streaming.gate_stream(files, F.lit(80.0)), out, f"{tmp_path}/state")
    got = {r["filename"]: r for r in spark.read.parquet(out).collect()}
    assert spark.read.parquet(out).count() == len(got) == 15
    for i, h, w, c, p in data:
        cells = patches.mean_grid(np.array(p).reshape(1, c, h, w))["layer1"][0].reshape(3, -1).T
        want = np.sort(np.linalg.norm(cells[:, None] - bank[None], axis=2), axis=1)[:, :2].mean(axis=1).max()
        assert got[str(i)]["score"] == pytest.approx(want, abs=1e-4) and got[str(i)]["prediction"] == int(want >= 80)
    assert {got[f"broken {n}.png"]["warning"] for n in range(3)} == {"could not be decoded"}
    with pytest.raises(patches.BankError):
        patches.file_scores(streaming.file_stream(spark, folder), patches.mean_grid, "layer1", bank, 6)
    assert gate.gate_counts(spark.read.parquet(out)).first()["total"] == 15
