import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from oodspark import sources, streaming
from oodspark.functions import kernels
from oodspark.operators import gate, images, manifest, outcomes, patches, reports

RAW = "image_path string, label string, split string, source string, ood_type string, patient_id string"


def raw(spark, rows):
    return spark.createDataFrame(rows, RAW)


GOOD = (" a.png ", "1.0", " test ", "s", "x", "p1")


@pytest.mark.parametrize(("row", "kind"), [(("  ", "x", "dev", "s", "x", ""), "image_path"), (("a", "2", "dev", "s", "x", ""), "label"), (("a", "0", "dev", "s", "x", ""), "split"), ((None, "0", "test", "s", "x", ""), "image_path"), (("a", None, "test", "s", "x", ""), "label")])
def test_violations_in_order(spark, row, kind):
    with pytest.raises(manifest.ManifestError, match=kind):
        manifest.validated(raw(spark, [GOOD, row]))


def test_manifest(spark):
    out = manifest.validated(raw(spark, [GOOD])).first()
    assert (out["image_path"], out["label"], out["split"]) == ("a.png", 1, "test")
    with pytest.raises(manifest.ManifestError, match="no rows"):
        manifest.validated(raw(spark, []))
    with pytest.raises(manifest.ManifestError, match="split"):
        manifest.require_columns(raw(spark, []).drop("split"))
    listing = spark.createDataFrame([("/r/b.png",)], "path string")
    with pytest.raises(manifest.ManifestError, match="missing"):
        manifest.validated(raw(spark, [GOOD]), listing, "/r")


def test_artifact_manifest(spark):
    df = spark.createDataFrame([("in/a b.v1.png", 0, "s1"), ("in/c.png", 0, None), ("in/d.png", 1, "s2")], "image_path string, label int, scanner string")
    rows = manifest.artifact_manifest(df, "/r/out", "/r", ("border_crop", "gaussian_noise")).collect()
    assert len(rows) == 4 and {r["patient_id"] for r in rows} == {""} and {r["label"] for r in rows} == {1}
    assert {r["image_path"] for r in rows} >= {"out/00000_a_b.v1_border_crop.png", "out/00001_c_gaussian_noise.png"}
    for bad in ({"kinds": ("blur",)}, {"kinds": ()}, {"split": "dev"}, {"limit": 0}):
        with pytest.raises(manifest.ManifestError):
            manifest.artifact_manifest(df, "/r/out", "/r", **bad)


def test_leaks(spark):
    df = spark.createDataFrame([("a", "train", "p"), ("b", "test", "p"), ("c", "train", " "), ("d", "test", " ")], "image_path string, split string, patient_id string")
    assert [r["patient_id"] for r in manifest.leaking_patients(df).collect()] == ["p"]


def vectors(spark, rows):
    return spark.createDataFrame(rows, "id long, embedding array<double>")


@pytest.mark.parametrize("size", [1 << 20, 0])
def test_knn(spark, size):
    bank = vectors(spark, [(0, [0.0, 0.0]), (1, [2.0, 0.0])])
    got = patches.knn_scores(vectors(spark, [(0, [0.0, 0.0]), (1, [1.0, 0.0]), (2, [4.0, 0.0])]), bank, 1, size)
    assert {r["id"]: r["patch_score"] for r in got.collect()} == pytest.approx({0: 0, 1: 1, 2: 2})
    got = patches.knn_scores(vectors(spark, [(0, [1.0])]), vectors(spark, [(0, [0.0]), (1, [2.0]), (2, [10.0])]), 2, size)
    assert got.first()["patch_score"] == pytest.approx(1.0)
    for k in (0, 4):
        with pytest.raises(patches.BankError):
            patches.knn_scores(vectors(spark, [(0, [1.0])]), vectors(spark, [(0, [0.0])]), k, size)


def test_coreset(spark):
    df = vectors(spark, [(i, [float(i)]) for i in range(20)])
    got = [sorted(r["id"] for r in patches.coreset(df.repartition(n), ["id"], 0.5, 6, 123).collect()) for n in (1, 3, 8)]
    assert len(got[0]) == 6 and got[0] == got[1] == got[2]
    assert patches.coreset(df, ["id"], 1.0).count() == 20
    for bad in ((0.0, None), (1.5, None), (0.5, 0)):
        with pytest.raises(patches.BankError):
            patches.coreset(df, ["id"], *bad)


def test_bank_roundtrip(spark, tmp_path):
    bank = vectors(spark, [(i, [float(i), 1.0]) for i in range(3)]).withColumnRenamed("id", "bank_id")
    sources.save_bank(bank, {"layers": ["layer2"]}, str(tmp_path / "b"))
    back, meta = sources.load_bank(spark, str(tmp_path / "b"))
    assert back.count() == 3 and meta["coreset_ratio"] == 0.1 and meta["max_patches"] is None
    with pytest.raises(sources.SourceError):
        sources.save_bank(bank.limit(0), {}, str(tmp_path / "c"))


def test_embedding_layers(spark):
    rows = [(i, "layer1", 2, 4, 4, [0.0] * 32) for i in range(2)] + [(i, "layer2", 3, 2, 2, [1.0] * 12) for i in range(2)]
    f = spark.createDataFrame(rows, "image_id long, layer string, c int, h int, w int, values array<float>")
    out = patches.embedded(f, ["layer1", "layer2"]).collect()
    assert len(out) == 32 and all(r["embedding"] == [0, 0, 1, 1, 1] for r in out)


def test_reconstruction(spark):
    df = spark.createDataFrame([(0, [0.0, 0.0], 0), (1, [2.0, 0.0], 0), (2, [9.0, 9.0], 1)], "id long, embedding array<double>, label int")
    got = {r["id"]: r["score"] for r in patches.mean_baseline(df, df).collect()}
    assert got == pytest.approx({0: 0.5, 1: 0.5, 2: (64 + 81) / 2})


def test_kernels():
    rng = np.random.default_rng(3)
    image = rng.integers(0, 256, (24, 32, 3)).astype(np.uint8)
    for kind in kernels.CORRUPTIONS:
        a, b = (kernels.corrupted(image, kind, [1, 2, 3]) for _ in range(2))
        assert a.shape == image.shape and a.dtype == np.uint8 and (a == b).all() and (a != image).any()
    with pytest.raises(ValueError):
        kernels.corrupted(image, "blur", [1])
    assert kernels.resize(np.ones((4, 4)), 7, 3, True) == pytest.approx(np.ones((7, 3)))
    p, bank = rng.normal(size=(9, 5)), rng.normal(size=(30, 5))
    full = np.sort(np.linalg.norm(p[:, None] - bank[None], axis=2), axis=1)
    assert kernels.smallest_distances(p, bank, 4, tile=7) == pytest.approx(full[:, :4])


def png(w, h, rgb):
    import struct
    import zlib

    part = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    body = b"".join(b"\0" + bytes(rgb) * w for _ in range(h))
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + part(b"IDAT", zlib.compress(body)) + part(b"IEND", b"")


def test_read_images(spark, tmp_path):
    (tmp_path / "a.png").write_bytes(png(3, 2, (10, 20, 30)))
    (tmp_path / "b.png").write_bytes(b"no image")
    rows = {r["image_path"][-5:]: r for r in sources.read_images(spark, str(tmp_path)).collect()}
    assert rows["a.png"]["pixels"] == [10] * 6 + [20] * 6 + [30] * 6 and rows["a.png"]["error"] is None
    assert rows["b.png"]["pixels"] is None and rows["b.png"]["error"]


def test_images(spark):
    df = spark.createDataFrame([(0, 1, 1, 3, [255.0, 0.0, 0.0])], images.SCHEMA)
    assert images.grey(df).first()["pixels"] == [76, 76, 76]
    assert images.normalised(images.scaled(df)).first()["pixels"] == pytest.approx([(1 - 0.485) / 0.229, -0.456 / 0.224, -0.406 / 0.225])
    with pytest.raises(ValueError):
        images.normalised(df, "other")


def test_run_reports(spark, tmp_path):
    report = {"global": {"auroc": 0.91234, "auprc": 0.8, "fpr_at_95_tpr": 0.2}, "confusion_matrix": {"tn": 1, "fp": 2, "fn": 3, "tp": 4}, "threshold": {"value": 0.5, "source": "validation_id_quantile"}, "counts": {"total": 10, "id": 3, "ood": 7}, "per_ood_type": {"a": {"auroc": 0.9, "auprc": 0.8, "fpr_at_95_tpr": 0.1, "id_count": 3, "ood_count": 7}}}
    for run, layers in (("r2", ["layer3"]), ("r1", ["layer2", "layer3"])):
        d = tmp_path / run / "evaluation"
        d.mkdir(parents=True)
        (d / "metrics.json").write_text(json.dumps(report, indent=1))
        (d / "resolved_evaluation_config.json").write_text(json.dumps({"project": {"run_name": f"{run}|x"}, "model": {"name": "m", "backbone": "b", "layers": layers}}))
        (d.parent / "resolved_config.json").write_text(json.dumps({"project": {"run_name": "not this"}}))
    root = f"file://{tmp_path}"
    found = sources.read_reports(spark, root)
    rows = reports.overall(found, root).collect()
    assert [(r["run_name"], r["layers"], r["metrics_file"], r["run_dir"]) for r in rows] == [("r1|x", "layer2+layer3", "r1/evaluation/metrics.json", "r1"), ("r2|x", "layer3", "r2/evaluation/metrics.json", "r2")]
    assert [r["ood_type"] for r in reports.per_ood(found, root).collect()] == ["a", "a"]
    text = reports.markdown(reports.overall(found, root).select("run_name", "auroc"))
    assert "r1\\|x" in text and "0.9123" in text
    (tmp_path / "none").mkdir()
    with pytest.raises(sources.SourceError):
        sources.read_reports(spark, f"file://{tmp_path}/none")
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad" / "metrics.json").write_text('{"global": ')
    with pytest.raises(Exception, match="MALFORMED"):
        sources.read_reports(spark, f"file://{tmp_path}/bad").collect()


def test_run_files(spark, tmp_path):
    """Files of many runs written at once, in folders with odd names, and which configuration counts."""
    config = lambda name: json.dumps({"project": {"run_name": name}, "model": {"name": "m", "layers": ["layer1", "layer2"]}})
    metrics = json.dumps({"global": {"auroc": 0.5}, "counts": {"total": 3}})
    files = [("a", "metrics.json", metrics), ("b b/evaluation", "metrics.json", metrics), ("b b", "resolved_config.json", config("above")), ("c=1/d%e", "metrics.json", metrics), ("c=1/d%e", "resolved_config.json", config("beside")), ("c=1/d%e", "resolved_evaluation_config.json", config("first")), ("c=1", "resolved_config.json", config("not this")), ("a", "other.json", "no JSON")]
    df = spark.createDataFrame(files, "run_dir string, file string, text string").repartition(3)
    for root in (f"{tmp_path}/runs", f"file://{tmp_path}/more"):
        sources.write_runs(df, root)
        got = {r["run_dir"]: (r["run_name"], r["metrics_file"], r["layers"], r["auroc"], r["total_count"]) for r in reports.overall(sources.read_reports(spark, root), root).collect()}
        assert got == {"a": ("a", "a/metrics.json", "", 0.5, 3), "b b": ("above", "b b/evaluation/metrics.json", "layer1+layer2", 0.5, 3), "c=1/d%e": ("first", "c=1/d%e/metrics.json", "layer1+layer2", 0.5, 3)}


def test_image_files(spark, tmp_path):
    """Images written by tasks, broken ones among them, come back with the same pixels."""
    rng = np.random.default_rng(5)
    rows = [(i, 3 + i, 2, 3, [float(v) for v in rng.integers(0, 256, 3 * 2 * (3 + i))]) for i in range(20)]
    sources.write_images(spark.createDataFrame(rows, images.SCHEMA).repartition(3), f"{tmp_path}/images/good")
    sources.write_files(spark.createDataFrame([("x y", b"no image"), ("z", b"")], "name string, data binary"), f"{tmp_path}/images/bad")
    got = sources.read_images(spark, f"{tmp_path}/images").collect()
    assert sorted((r["height"], r["pixels"]) for r in got if not r["error"]) == [(r[1], r[4]) for r in rows]
    assert sorted(r["image_path"].split("/")[-2] for r in got if r["error"]) == ["name=x%20y", "name=z"]


def test_gate_batch_and_stream(spark, tmp_path):
    rows = [("a.PNG", 5, 0.9), ("b.gif", 5, 0.9), ("c", 5, 0.1), ("d.jpg", 0, 0.1), ("e.jpg", 1 << 26, 0.1), ("f.jpg", 5, None)]
    files = spark.createDataFrame(rows, "filename string, length long, score double")
    batch = gate.gated(files, F.lit(0.5))
    assert [r["status"] for r in batch.collect()] == ["ok", "error", "ok", "error", "error", "error"]
    assert gate.gate_counts(batch).first() == (6, 1, 5)
    files.write.parquet(str(tmp_path / "in"))
    stream = lambda: spark.readStream.schema(files.schema).parquet(str(tmp_path / "in"))
    streaming.run_available(streaming.gate_stream(stream(), F.lit(0.5)), str(tmp_path / "out"), str(tmp_path / "c1"))
    assert sorted(map(str, spark.read.parquet(str(tmp_path / "out")).collect())) == sorted(map(str, batch.collect()))
    streaming.run_available(streaming.gate_stream_counts(stream(), F.lit(0.5)), str(tmp_path / "counts"), str(tmp_path / "c2"), "complete")
    assert spark.read.parquet(str(tmp_path / "counts")).first() == (6, 1, 5)


def test_no_patient_ids(spark):
    from oodspark.plans import queries

    for name in ("score_rows", "heatmap_manifest", "report_overall", "report_per_ood"):
        assert "patient_id" not in queries.QUERIES[name](spark, "/root/testdata/sf0.001").columns


def test_numbering(spark):
    """Positions are 0 to n - 1 in the order, whatever the partitions, also for a hot first column."""
    n = 1_200_000
    df = spark.range(n).selectExpr("CASE WHEN id % 3 = 0 THEN 'hot' ELSE concat('p', id % 1009) END AS image_path", "(id * 7919) % 1200007 AS doc_id").repartition(13)
    got = manifest.numbered(df, ("image_path", "doc_id")).persist()
    row = got.selectExpr("count(*) AS n", "count(DISTINCT row_idx) AS d", "min(row_idx) AS a", "max(row_idx) AS z").first()
    assert tuple(row) == (n, n, 0, n - 1)
    first = got.filter("row_idx < 1000").orderBy("row_idx").collect()
    assert [(r["image_path"], r["doc_id"]) for r in first] == [tuple(r) for r in df.orderBy("image_path", "doc_id").limit(1000).collect()]


def test_read_large_image(spark, tmp_path):
    import time

    (tmp_path / "a.png").write_bytes(png(224, 224, (1, 2, 3)))
    start = time.time()
    row = sources.read_images(spark, str(tmp_path)).first()
    assert len(row["pixels"]) == 3 * 224 * 224 and row["pixels"][0] == 1 and row["pixels"][-1] == 3 and time.time() - start < 15


def test_line_numbers(spark, tmp_path):
    path = tmp_path / "m.csv"
    path.write_text("image_path,label,split,source,ood_type\na.png,0,train,s,id\n ,0,train,s,id\n,1,test,s,x\n")
    with pytest.raises(manifest.ManifestError, match=r"CSV rows \[3, 4\]"):
        manifest.validated(sources.read_manifest(spark, str(path), line_numbers=True))


def test_report_writer(spark, tmp_path):
    assert reports.report_paths() == {"overall_markdown": "reports/generated/experiment_summary.md", "overall_csv": "reports/generated/experiment_summary.csv", "per_ood_markdown": "reports/generated/per_category_metrics.md", "per_ood_csv": "reports/generated/per_category_metrics.csv"}
    assert reports.report_paths("a/b.md")["per_ood_csv"] == "a/b_per_ood.csv"
    d = tmp_path / "runs" / "r1"
    d.mkdir(parents=True)
    (d / "metrics.json").write_text(json.dumps({"global": {"auroc": 0.5}, "per_ood_type": {"a": {"auroc": 0.9, "id_count": 3}}}))
    root = f"file://{tmp_path}/runs"
    where = reports.write_tables(sources.read_reports(spark, root), root, overall_markdown=f"{tmp_path}/out/t.md")
    assert spark.read.csv(where["overall_csv"], header=True).first()["auroc"] == "0.5"
    assert "# Per-OOD Category Metrics" in [r["value"] for r in spark.read.text(where["per_ood_markdown"]).collect()]


def test_map_checks(spark):
    maps = lambda *v: spark.createDataFrame([(x,) for x in v], "patch_score double")
    outcomes.require_maps(maps(1.0, 2.0))
    for bad in (maps(), maps(1.0, float("nan")), maps(None)):
        with pytest.raises(ValueError):
            outcomes.require_maps(bad)


def test_annotation_bounds():
    for seed in range(50):
        h, w = 30 + seed, 48
        marked = np.argwhere((kernels.corrupted(np.zeros((h, w, 3), dtype=np.uint8), "rectangle_annotation", [seed]) > 0).any(axis=2))
        (y0, x0), (y1, x1) = marked.min(axis=0), marked.max(axis=0)
        assert y0 < h // 3 and x0 < w // 3 and y1 >= h // 2 and x1 >= w // 2
