"""The registered queries: each operator on its view of the test tables."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import sources, streaming
from ..functions import kernels
from ..operators import autoencoder, decisions, detectors, gate, images, manifest, metrics, outcomes, patches, reports
from ..sources import scratch
from . import views as V

THRESHOLD = 30.0
RATIO, SEED, K = 0.5, 42, 3


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, places) for c, t in df.dtypes if t == "double"})


def scores(spark, d):
    return V.view(spark, d, V.SCORES)


def patch_view(spark, d):
    return V.view(spark, d, V.PATCHES)


def bank_of(spark, d):
    train = patch_view(spark, d).filter("role = 'train'")
    return patches.fitted_bank(train, ["vec_id"], RATIO, None, SEED).select(F.col("vec_id").alias("bank_id"), "embedding")


def scored_patches(spark, d, k=1):
    test = patch_view(spark, d).filter("role <> 'train'")
    return patches.knn_scores(test, bank_of(spark, d), k)


def scored_images(spark, d, k=1):
    return patches.image_scores(scored_patches(spark, d, k), ("image_id", "label", "ood_type", "role"))


def running(spark, d, keys=()):
    return metrics.cumulative(metrics.score_counts(scores(spark, d), keys), keys)


# metrics


def ood_metrics_global(spark, d):
    return rounded(metrics.ranking_metrics(scores(spark, d)))


def ood_metrics_by_run(spark, d):
    return rounded(metrics.ranking_metrics(scores(spark, d), ["run_name"]))


def ood_metrics_per_type(spark, d):
    return rounded(metrics.per_type_metrics(scores(spark, d)))


def ood_metrics_big(spark, d):
    return rounded(metrics.per_type_metrics(V.view(spark, d, V.BIG_SCORES)))


def ood_metrics_documents(spark, d):
    return rounded(metrics.per_type_metrics(V.view(spark, d, V.DOC_SCORES)))


def auroc(spark, d):
    return rounded(running(spark, d, ["scanner"]).groupBy("scanner").agg(metrics.auroc().alias("auroc")))


def auprc(spark, d):
    return rounded(running(spark, d, ["scanner"]).groupBy("scanner").agg(metrics.auprc().alias("auprc")))


def fpr_at_tpr(spark, d):
    return rounded(running(spark, d, ["scanner"]).groupBy("scanner").agg(metrics.fpr_at_recall(0.9).alias("fpr_at_90_tpr")))


def roc_curve(spark, d):
    return rounded(metrics.roc_curve(running(spark, d)))


def pr_curve(spark, d):
    return rounded(metrics.pr_curve(running(spark, d, ["scanner"]), ["scanner"]))


def confusion_at_threshold(spark, d):
    return metrics.confusion(scores(spark, d), F.lit(THRESHOLD), ["run_name"])


def metric_input_checks(spark, d):
    return metrics.input_checks(scores(spark, d), ["ood_type"])


# thresholds and decisions


def threshold_quantile(spark, d):
    return rounded(decisions.quantile_threshold(scores(spark, d).filter("split = 'val' AND label = 0"), 0.95))


def threshold_per_scanner(spark, d):
    return rounded(decisions.quantile_threshold(scores(spark, d).filter("split = 'val' AND label = 0"), 0.95, ["scanner"]))


def threshold_resolve(spark, d):
    s = scores(spark, d)
    return rounded(decisions.resolved_threshold(None, s.filter("split = 'val'"), s.filter("split = 'test'")))


def operating_points(spark, d):
    s = scores(spark, d)
    return rounded(decisions.operating_points(s.filter("split = 'test'"), s.filter("split = 'val'")))


def score_histogram(spark, d):
    return decisions.score_histogram(scores(spark, d), 0.0, 5.0, ["ood_type"])


def score_rows(spark, d):
    path = scratch(spark, "scores")
    sources.write_csv(reports.score_rows(scores(spark, d), F.lit(THRESHOLD)), path)
    return rounded(spark.read.schema("image_path string, label int, ood_type string, score double, prediction int, threshold double").csv(path, header=True))


def gate_view(spark, d):
    return V.view(spark, d, V.GATE)


def gate_decisions(spark, d):
    rows = gate_view(spark, d)
    limit = F.when(F.col("filename").like("%.gif"), F.lit(None).cast("double")).otherwise(F.lit(10.0))
    return rounded(decisions.decided(rows, limit).drop("length"))


EXPORT = "filename string, verdict string, score double, threshold double, prediction int, decision string, warning string"


def gate_batch(spark, d):
    """The gate's table as it is exported and read again; its status is told by the verdict."""
    path = scratch(spark, "export")
    sources.export_csv(gate.gated(gate_view(spark, d), F.lit(10.0)).drop("status"), path)
    return rounded(sources.read_export(spark, path, EXPORT).withColumn("status", F.when(F.col("verdict") == "ERROR", "error").otherwise("ok")))


def gate_counts(spark, d):
    return gate.gate_counts(gate.gated(gate_view(spark, d), F.lit(10.0)))


def _stream(spark, d):
    source = scratch(spark, "gate-source")
    gate_view(spark, d).withColumn("length", F.col("length").cast("long")).write.parquet(source)
    return spark.readStream.schema("filename string, length long, score double").parquet(source)


def gate_files(spark, d):
    """Image files that arrive in two lots, broken ones among them, through a stream that is stopped and taken up again between them."""
    folder, out, state, view = scratch(spark, "arriving"), scratch(spark, "gate-out"), scratch(spark, "gate-state"), pixel_view(spark, d)
    features = patches.extracted(view.filter("image_id % 5 = 0"), patches.mean_grid, ["layer1"])
    bank = kernels.stacked(patches.exploded(features).select("embedding").distinct().toArrow()[0].combine_chunks())  # equal vectors are equally near; file_scores() checks the size
    for lot in (0, 1):
        arrived = view.filter(f"image_id % 2 = {lot}").withColumn("image_id", F.concat(F.col("image_id").cast("string"), F.lit(".png")))
        broken = F.col("image_id").rlike("(00|50)\\.png$") | (F.col("image_id") == "0.png")
        sources.write_images(arrived.filter(~broken), f"{folder}/images-{lot}", flat=True)
        sources.write_files(arrived.filter(broken).select(F.col("image_id").alias("name"), F.lit("no image").cast("binary").alias("data")), f"{folder}/broken-{lot}", flat=True)
        files = patches.file_scores(streaming.file_stream(spark, folder), patches.mean_grid, "layer1", bank)
        streaming.run_available(streaming.gate_stream(files, F.lit(5.0)), out, state)
    return rounded(spark.read.parquet(out), 4)


def gate_stream(spark, d):
    out = scratch(spark, "gate-out")
    streaming.run_available(streaming.gate_stream(_stream(spark, d), F.lit(10.0)), out, scratch(spark, "gate-state"))
    return rounded(spark.read.parquet(out))


def gate_stream_counts(spark, d):
    out = scratch(spark, "gate-counts")
    streaming.run_available(streaming.gate_stream_counts(_stream(spark, d), F.lit(10.0)), out, scratch(spark, "gate-state"), "complete")
    return spark.read.parquet(out)


# outcomes and maps


def topk_outcomes(spark, d):
    return rounded(outcomes.top_outcomes(scores(spark, d), F.lit(THRESHOLD), 5).select("outcome", F.col("rank").cast("long").alias("rank"), "sample_index", "score"))


def heatmap_manifest(spark, d):
    top = outcomes.top_outcomes(scores(spark, d), F.lit(THRESHOLD), 5)
    return rounded(outcomes.heatmap_manifest(top, F.lit(THRESHOLD)).withColumn("rank", F.col("rank").cast("long")))


def patch_maps(spark, d):
    g = outcomes.grids(scored_patches(spark, d))
    return rounded(g.select("image_id", "height", "width", F.posexplode("values").alias("place", "patch_score")))


def heatmap_normalization(spark, d):
    return rounded(outcomes.map_limits(scored_patches(spark, d), ["role"]))


def heatmap_record(spark, d):
    """What is written beside the heat maps, through its JSON file."""
    path = scratch(spark, "record")
    top = outcomes.top_outcomes(scores(spark, d), F.lit(THRESHOLD), 5)
    sources.write_report(outcomes.normalisation_record(top, outcomes.map_limits(scored_patches(spark, d)), 5), path)
    return rounded(spark.read.schema("vmin double, vmax double, selected_count long, alpha double, cmap string, top_k int, colorbar_file string").json(path))


def heatmap_normalize(spark, d):
    maps = scored_patches(spark, d)
    return rounded(outcomes.normalised(maps, outcomes.map_limits(maps, ["role"]), ["role"]).select("vec_id", "image_id", "normalised"))


def heatmap_resize(spark, d):
    g = outcomes.resized(outcomes.grids(scored_patches(spark, d)).filter("height = 2 AND width = 2 AND size(values) = 4"), 4, 4)
    return rounded(g.select("image_id", F.posexplode("values").alias("place", "value")))


# manifests


def raw_manifest(spark, d):
    return V.view(spark, d, V.MANIFEST)


def good_manifest(spark, d):
    df = manifest.flagged(raw_manifest(spark, d)).filter("NOT bad_image_path AND NOT bad_label AND NOT bad_split")
    return manifest.cleaned(df.drop("bad_image_path", "bad_label", "bad_split"))


def manifest_load(spark, d):
    path = scratch(spark, "manifest")
    sources.write_csv(raw_manifest(spark, d).withColumn("doc_id", F.col("doc_id").cast("string")), path, quote_all=True)
    return sources.read_manifest(spark, path).groupBy("split", "label").agg(F.count("*").alias("n_rows"), F.count_distinct("image_path").alias("n_paths"))


def manifest_csv_rows(spark, d):
    """The numbers that records have in a manifest file with line breaks in its fields."""
    path = scratch(spark, "manifest")
    notes = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit('a "quoted"\n\nline, '), F.col("doc_id").cast("string"))).otherwise(F.lit(""))
    rows = raw_manifest(spark, d).select(F.col("doc_id").cast("string").alias("doc_id"), "image_path", "label", notes.alias("notes"))
    sources.write_csv(rows.repartitionByRange(1, F.col("doc_id").cast("long")).sortWithinPartitions(F.col("doc_id").cast("long")), path, quote_all=True)  # one file, as manifests are
    read = sources.read_manifest(spark, path, line_numbers=True)
    return read.select("csv_row", F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.length("notes"), F.lit(0)).alias("note_chars"))


def manifest_violations(spark, d):
    return manifest.violations(raw_manifest(spark, d))


def manifest_resolve(spark, d):
    return manifest.resolved(good_manifest(spark, d), "/root_dir").select("doc_id", "image_path", "label", "split", "resolved_image_path")


def manifest_missing_files(spark, d):
    return manifest.missing_files(manifest.resolved(good_manifest(spark, d), "/root_dir"), V.view(spark, d, V.LISTING)).select("doc_id", "resolved_image_path")


def manifest_id_subset(spark, d):
    return manifest.id_subset(good_manifest(spark, d)).select("doc_id", "label", "split")


def artifact_manifest(spark, d):
    return manifest.artifact_manifest(good_manifest(spark, d), "/root_dir/artifacts", "/root_dir", order=("image_path", "doc_id"))


def dataset_composition(spark, d):
    return manifest.composition(good_manifest(spark, d))


def leakage_patients(spark, d):
    return manifest.leaking_patients(good_manifest(spark, d))


def leakage_originals(spark, d):
    df = good_manifest(spark, d)
    made = manifest.id_subset(df).select(F.col("image_path").alias("original_path"), F.lit("test").alias("split"))
    return manifest.leaking_originals(df, made).select("original_path", "original_split")


# images


def pixel_view(spark, d):
    return V.view(spark, d, V.PIXELS)


def _long(df):
    return df.select("image_id", F.posexplode("pixels").alias("place", "value")).withColumn("value", F.round(F.col("value").cast("double"), 4))


def image_load(spark, d):
    """Images written as files by tasks, every 50th of them broken, and read again: sums by channel, and the errors."""
    path, view = scratch(spark, "images"), pixel_view(spark, d)
    sources.write_images(view.filter("image_id % 50 <> 0"), f"{path}/good")
    sources.write_files(view.filter("image_id % 50 = 0").select(F.col("image_id").cast("string").alias("name"), F.lit("no image").cast("binary").alias("data")), f"{path}/broken")
    read = sources.read_images(spark, path).withColumn("image_id", F.regexp_extract("image_path", "/name=([0-9]+)/", 1).cast("long"))
    channels = read.select("image_id", "height", "width", "channels", "error", F.posexplode_outer("pixels").alias("place", "value"))
    return channels.groupBy("image_id", F.floor(F.col("place") / 64).cast("int").alias("channel"), "error").agg(F.sum(F.col("value").cast("double")).alias("total"), F.count("value").alias("n_pixels"), F.sum(F.col("value") * F.col("place")).alias("weighted"))


def image_resize(spark, d):
    return _long(images.resized(pixel_view(spark, d), 4, antialias=False))


def image_shrink(spark, d):
    """The same with the wider filter that shrinking asks for."""
    return _long(images.resized(pixel_view(spark, d), 3))


def image_gray(spark, d):
    return _long(images.grey(pixel_view(spark, d)))


def image_normalize(spark, d):
    return _long(images.normalised(images.scaled(pixel_view(spark, d))))


def _corrupted(spark, d, *kinds):
    made = images.corrupted(V.view(spark, d, V.LARGE), kinds)
    return made.select("image_id", "kind", "height", "width", F.sha2(F.array_join(F.transform("pixels", lambda x: x.cast("int").cast("string")), ","), 256).alias("pixels_sha256"))


def artifact_apply(spark, d):
    return _corrupted(spark, d, *kernels.CORRUPTIONS)


def artifact_watermark(spark, d):
    return _corrupted(spark, d, "text_watermark")


def artifact_annotation(spark, d):
    return _corrupted(spark, d, "rectangle_annotation")


def artifact_crop(spark, d):
    return _corrupted(spark, d, "border_crop")


def artifact_noise(spark, d):
    return _corrupted(spark, d, "gaussian_noise")


def artifact_compression(spark, d):
    return _corrupted(spark, d, "jpeg_compression")


# patches, banks, neighbours, reconstruction


def feature_extract(spark, d):
    f = patches.extracted(pixel_view(spark, d), patches.mean_grid, ["layer1"])
    return f.select("image_id", "layer", "c", "h", "w", F.posexplode("values").alias("place", "value")).withColumn("value", F.round(F.col("value").cast("double"), 4))


def patch_embed(spark, d):
    p = patches.embedded(V.view(spark, d, V.FEATURES), ["layer3", "layer2"])
    return p.select("image_id", "patch_row", "patch_col", F.posexplode("embedding").alias("dim", "value")).withColumn("value", F.round("value", 5))


def patch_explode(spark, d):
    maps = V.view(spark, d, V.FEATURES)
    layers = [patches.exploded(maps.filter(F.col("layer") == name)).withColumn("layer", F.lit(name)) for name in ("layer2", "layer3")]
    return layers[0].union(layers[1]).select("layer", "image_id", "patch_row", "patch_col", F.posexplode("embedding").alias("dim", "value")).withColumn("value", F.round("value", 6))


def bank_coreset(spark, d):
    return patches.coreset(patch_view(spark, d), ["vec_id"], 0.2, None, SEED).select("vec_id")


def bank_fit(spark, d):
    return bank_of(spark, d).select("bank_id")


def bank_roundtrip(spark, d):
    path = scratch(spark, "bank")
    sources.save_bank(bank_of(spark, d), {"coreset_ratio": RATIO, "k": 1, "seed": SEED}, path)
    bank, meta = sources.load_bank(spark, path)
    return rounded(bank.select("bank_id", F.posexplode("embedding").alias("dim", "value")).withColumn("coreset_ratio", F.lit(meta["coreset_ratio"])))


def bank_summary(spark, d):
    return patches.bank_summary(patch_view(spark, d).filter("role = 'train'"), bank_of(spark, d), RATIO, 100_000, 1)


def knn_pairwise(spark, d):
    test = patch_view(spark, d).filter("role <> 'train'").select("vec_id", "embedding")
    return rounded(patches.knn_pairwise(test, bank_of(spark, d)))


def knn_score_k1(spark, d):
    return rounded(scored_patches(spark, d).select("vec_id", "patch_score"))


def knn_score_k3(spark, d):
    return rounded(scored_patches(spark, d, K).select("vec_id", "patch_score"))


def knn_score_blocks(spark, d):
    """The same as knn_score_k3, with the bank met in blocks."""
    test = patch_view(spark, d).filter("role <> 'train'").select("vec_id", "embedding")
    return rounded(patches.knn_scores(test, bank_of(spark, d), K, broadcast_bytes=0))


def image_scores(spark, d):
    return rounded(scored_images(spark, d).select("image_id", "label", "role", "score"))


def knn_global_feature(spark, d):
    p = patches.pooled(patch_view(spark, d), ("image_id", "label", "role"))
    bank = p.filter("role = 'train' AND label = 0").select(F.col("image_id").alias("bank_id"), "embedding")
    return rounded(patches.knn_scores(p.filter("role <> 'train'"), bank, 1))


def reconstruction_error(spark, d):
    e = spark.read.parquet(f"{d}/embeddings.parquet").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("x"))
    return rounded(patches.reconstruction_error(e.withColumn("x_hat", F.transform("x", lambda v: F.round(v, 1)))).select("vec_id", "score"))


def recon_mean_baseline(spark, d):
    p = patch_view(spark, d)
    return rounded(patches.mean_baseline(p.filter("role <> 'train'"), p.filter("role = 'train'")).select("vec_id", "score"))


def recon_train_loss(spark, d):
    p = patch_view(spark, d).filter("role = 'train'")
    return rounded(patches.mean_baseline(p.filter("label = 0"), p).agg(F.avg("score").alias("loss"), F.count("*").alias("n_rows")))


#: Rank and turns of the registered fits; few turns, as their SQL repeats them one by one.
RANK, TURNS = 6, 4


def _autoencoder(spark, d):
    return autoencoder.fitted(patch_view(spark, d).filter("role = 'train'").select("label", "embedding"), RANK, TURNS)


def recon_pca_baseline(spark, d):
    test = patch_view(spark, d).filter("role <> 'train'").select("vec_id", "embedding")
    path = scratch(spark, "autoencoder")
    autoencoder.saved(_autoencoder(spark, d), spark, path)
    return rounded(autoencoder.scored(test, autoencoder.loaded(spark, path)[0]))


def recon_pca_losses(spark, d):
    """Training loss before the first turn and after each."""
    losses = _autoencoder(spark, d).losses
    return rounded(spark.createDataFrame(list(enumerate(losses)), "turn int, loss double"))


def ablation_coreset(spark, d):
    p = patch_view(spark, d)
    banks = patches.coreset_ranks(p.filter("role = 'train' AND label = 0"), ["vec_id"], [0.1, 0.3, 1.0], SEED)
    return banks.groupBy("ratio").agg(F.count("*").alias("bank_size"), F.min("vec_id").alias("first_id"), F.sum("vec_id").alias("id_sum"))


def evaluate_end_to_end(spark, d):
    return rounded(detectors.evaluated(detectors.Neighbours(bank_of(spark, d)), patch_view(spark, d).filter("role <> 'train'")))


def evaluate_reconstruction(spark, d):
    """The same evaluation with the other detector."""
    return rounded(detectors.evaluated(detectors.Reconstruction(_autoencoder(spark, d)), patch_view(spark, d).filter("role <> 'train'")))


# reports


def _reports(spark, d):
    s = scores(spark, d)
    thr = decisions.quantile_threshold(s.filter("split = 'val' AND label = 0"), 0.95, ["run_name"])
    thr = thr.withColumns({"threshold_source": F.lit(decisions.VALIDATION), "quantile": F.lit(0.95)})
    return reports.metrics_report(s, thr, ["run_name"])


def metrics_report(spark, d):
    r = _reports(spark, d)
    return rounded(r.select("run_name", "global.auroc", F.col("confusion_matrix.tp").alias("tp"), F.col("threshold.value").alias("threshold"), F.col("threshold.source").alias("threshold_source"), F.col("counts.total").alias("total"), F.explode("per_ood_type").alias("ood_type", "v")).select("*", F.col("v.auroc").alias("type_auroc"), F.col("v.ood_count").alias("ood_count")).drop("v"))


def _report_files(spark, d):
    """The runs' reports and configurations, written to files by run and found again."""
    r = _reports(spark, d)
    n = F.substring("run_name", 5, 9).cast("int")
    layers = F.when(n == 4, F.lit('["layer2","layer3"]')).otherwise(F.concat(F.lit('["layer'), (n + 1).cast("string"), F.lit('"]')))
    config = lambda backbone: F.to_json(F.struct(F.struct(F.when(n != 2, F.concat(F.lit("exp|"), n.cast("string"))).alias("run_name")).alias("project"), F.struct(F.lit("patch_bank").alias("name"), F.lit(backbone).alias("backbone"), layers.alias("layers")).alias("model")))
    folder = F.concat("run_name", F.when(n % 2 == 0, "/evaluation").otherwise(""))
    file = lambda at, name, text: F.struct(at.alias("run_dir"), F.lit(name).alias("file"), text.alias("text"))
    # run 3 has no configuration, the even runs have theirs in the folder above, run 1 has two of which the first counts
    files = F.array(
        file(folder, "metrics.json", F.to_json(F.struct("global", "confusion_matrix", "threshold", "counts", "per_ood_type"))),
        F.when(n != 3, file(F.col("run_name"), "resolved_config.json", F.when(n == 1, config("not_this")).otherwise(config("resnet50")))),
        F.when(n == 1, file(folder, "resolved_evaluation_config.json", config("resnet50"))),
    )
    path = scratch(spark, "runs")
    sources.write_runs(r.select(F.explode(F.array_compact(files)).alias("f")).select("f.*"), path)
    return sources.read_reports(spark, path), path


def report_overall(spark, d):
    return rounded(reports.overall(*_report_files(spark, d)))


def report_per_ood(spark, d):
    return rounded(reports.per_ood(*_report_files(spark, d)))


def report_markdown(spark, d):
    t = reports.overall(*_report_files(spark, d)).select("run_name", "layers", "auroc", "tp", "metrics_file")
    return reports.markdown_rows(t).select("metrics_file", "line")


def report_ablation(spark, d):
    return rounded(reports.ablation(reports.overall(*_report_files(spark, d))).select("figure_label", "layer_sort", "run_name", "auroc", "tp"))


def report_pivot_auroc(spark, d):
    kinds = ["modality_shift", "semantic_outlier", "sensory_artifact"]
    return rounded(reports.auroc_pivot(reports.per_ood(*_report_files(spark, d)), kinds))


def report_confusion_long(spark, d):
    return reports.confusion_long(reports.overall(*_report_files(spark, d)))


def report_counts(spark, d):
    f, path = _report_files(spark, d)
    return reports.report_counts(reports.overall(f, path), reports.per_ood(f, path))


HIDDEN = {"scores", "patch_view", "bank_of", "scored_patches", "scored_images", "running", "rounded", "scratch", "gate_view", "raw_manifest", "good_manifest", "pixel_view"}
QUERIES = {n: f for n, f in list(globals().items()) if callable(f) and getattr(f, "__module__", "") == __name__ and n[0] != "_" and n not in HIDDEN}
