"""DuckDB SQL for the registered queries, written apart from their DataFrame forms."""

from __future__ import annotations

import numpy as np

from ..functions import kernels
from ..functions.kernels import axis_weights
from ..operators.decisions import ACCEPT, REJECT, SCORE_ONLY, TEST, VALIDATION, VERDICTS, WARNING
from ..operators.manifest import MISSING
from . import views as V
from .queries import RANK, TURNS

SV = f"sv AS {V.oracle(V.SCORES)}"
PV = f"pv AS {V.oracle(V.PATCHES_ORACLE)}"
GV = f"gv AS {V.oracle(V.GATE)}"
BANK = f"""{PV}, fit AS (SELECT *, row_number() OVER (ORDER BY md5('42:' || vec_id), vec_id) AS r, count(*) OVER () AS n FROM pv WHERE role = 'train' AND label = 0),
bank AS (SELECT vec_id AS bank_id, embedding FROM fit WHERE r <= ceil(n * 0.5))"""
NEAR = f"""{BANK}, pairs AS (SELECT p.vec_id, p.image_id, p.patch_row, p.patch_col, p.label, p.ood_type, p.role, list_distance(p.embedding, b.embedding) AS dist FROM pv p, bank b WHERE p.role <> 'train'),
ps AS (SELECT vec_id, image_id, patch_row, patch_col, label, ood_type, role, min(dist) AS patch_score FROM pairs GROUP BY ALL),
im AS (SELECT image_id, label, ood_type, role, max(patch_score) AS score FROM ps GROUP BY ALL)"""


def metrics(table: str, keys: str = "") -> str:
    """CTE c: for each group and distinct score the counts, and the running sums from the highest score down."""
    k = f"{keys}, " if keys else ""
    p = f"PARTITION BY {keys} " if keys else ""
    return f"""c0 AS (SELECT {k}score, count(*) FILTER (label = 1)::DOUBLE AS pos, count(*) FILTER (label = 0)::DOUBLE AS neg FROM {table} GROUP BY {k}score),
c AS (SELECT *, sum(pos) OVER ({p}ORDER BY score DESC) AS tp, sum(neg) OVER ({p}ORDER BY score DESC) AS fp, sum(pos) OVER ({p}) AS n_pos, sum(neg) OVER ({p}) AS n_neg FROM c0)"""


AUROC = "round(sum(neg * (tp - pos) + 0.5 * neg * pos) / max(n_pos * n_neg), 6)::DOUBLE AS auroc"
AUPRC = "round(sum(pos / n_pos * tp / (tp + fp)), 6)::DOUBLE AS auprc"
FPR = "round(min(CASE WHEN tp / n_pos >= {}::DOUBLE THEN fp / n_neg END), 6)::DOUBLE AS {}"
TRIPLE = f"{AUROC}, {AUPRC}, {FPR.format(0.95, 'fpr_at_95_tpr')}"


def per_type(view: str) -> str:
    return f"""WITH s AS {view}, t AS (SELECT DISTINCT ood_type AS k FROM s WHERE label = 1),
x AS (SELECT t.k, s.score, s.label FROM s JOIN t ON s.label = 0 OR s.ood_type = t.k), {metrics('x', 'k')}
SELECT k AS ood_type, {TRIPLE}, max(n_neg)::BIGINT AS id_count, max(n_pos)::BIGINT AS ood_count FROM c GROUP BY k"""


VAL = "SELECT quantile_cont(score, 0.95) AS t FROM sv WHERE split = 'val' AND label = 0"
CELLS = "count(*) FILTER (label = 0 AND score < {t})::BIGINT AS tn, count(*) FILTER (label = 0 AND score >= {t})::BIGINT AS fp, count(*) FILTER (label = 1 AND score < {t})::BIGINT AS fn, count(*) FILTER (label = 1 AND score >= {t})::BIGINT AS tp"
TOP = f"""{SV}, o AS (SELECT *, CASE WHEN label = 0 THEN CASE WHEN score >= 30 THEN 'fp' ELSE 'tn' END ELSE CASE WHEN score >= 30 THEN 'tp' ELSE 'fn' END END AS outcome FROM sv),
top AS (SELECT *, row_number() OVER (PARTITION BY outcome ORDER BY CASE WHEN outcome IN ('fp', 'tp') THEN -score ELSE score END, sample_index) AS rank FROM o QUALIFY rank <= 5)"""
BAD = f"""m AS {V.oracle(V.MANIFEST)}, f AS (SELECT *, trim(image_path) IN ({', '.join(repr(x) for x in MISSING)}) AS bad_path, coalesce(try_cast(trim(label) AS DOUBLE) NOT IN (0, 1), true) AS bad_label,
trim(split) NOT IN ('train', 'val', 'test') AS bad_split FROM m)"""
GOOD = f"""{BAD}, g AS (SELECT doc_id, trim(image_path) AS image_path, try_cast(trim(label) AS DOUBLE)::INT AS label, trim(split) AS split, source, ood_type, patient_id, scanner FROM f WHERE NOT bad_path AND NOT bad_label AND NOT bad_split),
h AS (SELECT *, CASE WHEN image_path LIKE '/%' THEN image_path ELSE '/root_dir/' || image_path END AS resolved_image_path FROM g)"""
GATED = f"""{GV}, e AS (SELECT *, CASE WHEN lower(regexp_extract(filename, '\\.([^./]+)$', 1)) NOT IN ('', 'png', 'jpg', 'jpeg', 'bmp', 'tif', 'tiff') THEN 'unsupported file type' WHEN length = 0 THEN 'empty file'
WHEN length > 26214400 THEN 'file too large' WHEN score IS NULL THEN 'could not be decoded' END AS err FROM gv),
ga AS (SELECT filename, CASE WHEN err IS NOT NULL THEN 'ERROR' WHEN score >= 10 THEN '{VERDICTS[REJECT]}' ELSE '{VERDICTS[ACCEPT]}' END AS verdict, CASE WHEN err IS NULL THEN score END AS score, CASE WHEN err IS NULL THEN 10.0::DOUBLE END AS threshold,
CASE WHEN err IS NULL THEN (score >= 10)::INT END AS prediction, CASE WHEN err IS NULL THEN CASE WHEN score >= 10 THEN '{REJECT}' ELSE '{ACCEPT}' END END AS decision, err AS warning, CASE WHEN err IS NULL THEN 'ok' ELSE 'error' END AS status FROM e)"""
PIX = f"px AS {V.oracle(V.PIXELS_ORACLE)}"
RUNS = f"""{SV}, {metrics('sv', 'run_name')}, mt AS (SELECT run_name, {TRIPLE} FROM c GROUP BY run_name),
th AS (SELECT run_name, quantile_cont(score, 0.95) AS threshold FROM sv WHERE split = 'val' AND label = 0 GROUP BY run_name),
cf AS (SELECT run_name, {CELLS.format(t='threshold')}, count(*) AS total_count, count(*) FILTER (label = 0) AS id_count, count(*) FILTER (label = 1) AS ood_count FROM sv JOIN th USING (run_name) GROUP BY run_name),
kt AS (SELECT DISTINCT run_name, ood_type AS k FROM sv WHERE label = 1), kx AS (SELECT kt.run_name, kt.k, sv.score, sv.label FROM sv JOIN kt ON sv.run_name = kt.run_name AND (sv.label = 0 OR sv.ood_type = kt.k)),
{metrics('kx', 'run_name, k').replace('c0 AS', 'k0 AS').replace('FROM c0', 'FROM k0').replace('c AS (SELECT *', 'kc AS (SELECT *')},
km AS (SELECT run_name AS raw, k AS ood_type, {TRIPLE}, max(n_neg)::BIGINT AS id_count, max(n_pos)::BIGINT AS ood_count FROM kc GROUP BY run_name, k),
nm AS (SELECT run_name AS raw, run_name[5:]::INT AS n, CASE WHEN n IN (2, 3) THEN run_name ELSE 'exp|' || n END AS run_name, CASE WHEN n = 3 THEN '' ELSE 'patch_bank' END AS model, CASE WHEN n = 3 THEN '' ELSE 'resnet50' END AS backbone,
  CASE n WHEN 3 THEN '' WHEN 4 THEN 'layer2+layer3' ELSE 'layer' || (n + 1) END AS layers, raw AS run_dir, raw || CASE WHEN n % 2 = 0 THEN '/evaluation' ELSE '' END || '/metrics.json' AS metrics_file FROM (SELECT run_name FROM mt)),
ov AS (SELECT nm.run_name, run_dir, model, backbone, layers, auroc, auprc, fpr_at_95_tpr, round(threshold, 6)::DOUBLE AS threshold, '{VALIDATION}' AS threshold_source, total_count, id_count, ood_count, tn, fp, fn, tp, metrics_file
  FROM nm JOIN mt ON mt.run_name = raw JOIN th ON th.run_name = raw JOIN cf ON cf.run_name = raw),
po AS (SELECT nm.run_name, model, backbone, layers, ood_type, auroc, auprc, fpr_at_95_tpr, id_count, ood_count, metrics_file FROM nm JOIN km USING (raw))"""
LABELLED = "SELECT *, CASE WHEN layers <> '' THEN layers ELSE run_name END AS figure_label FROM "


def weighted(old: int, new: int, cell: str, filtered: bool = False) -> str:
    """SUM over a grid by the weights of a bilinear resize: rows (y, x, i, j, w); filtered ones are tents as wide as the step, made here by hand."""
    a = axis_weights(old, new)
    if filtered:
        tent = [[max(0.0, 1 - abs(i - ((y + 0.5) * old / new - 0.5)) * new / old) for i in range(old)] for y in range(new)]
        a = np.array([[t / sum(row) for t in row] for row in tent])
    rows = [f"({y}, {x}, {i}, {j}, {float(a[y, i] * a[x, j])!r}::DOUBLE)" for y in range(new) for x in range(new) for i in range(old) for j in range(old) if a[y, i] * a[x, j]]
    return f"(VALUES {', '.join(rows)}) {cell}(y, x, i, j, w)"


ORACLES = {
    "ood_metrics_global": f"WITH {SV}, {metrics('sv')} SELECT {TRIPLE} FROM c",
    "ood_metrics_by_run": f"WITH {SV}, {metrics('sv', 'run_name')} SELECT run_name, {TRIPLE} FROM c GROUP BY run_name",
    "ood_metrics_per_type": per_type(V.oracle(V.SCORES)),
    "ood_metrics_big": per_type(V.oracle(V.BIG_SCORES)),
    "ood_metrics_documents": per_type(V.oracle(V.DOC_SCORES)),
    "auroc": f"WITH {SV}, {metrics('sv', 'scanner')} SELECT scanner, {AUROC} FROM c GROUP BY scanner",
    "auprc": f"WITH {SV}, {metrics('sv', 'scanner')} SELECT scanner, {AUPRC} FROM c GROUP BY scanner",
    "fpr_at_tpr": f"WITH {SV}, {metrics('sv', 'scanner')} SELECT scanner, {FPR.format(0.9, 'fpr_at_90_tpr')} FROM c GROUP BY scanner",
    "roc_curve": f"WITH {SV}, {metrics('sv')} SELECT score AS threshold, round(fp / n_neg, 6)::DOUBLE AS fpr, round(tp / n_pos, 6)::DOUBLE AS tpr FROM c UNION ALL SELECT 'inf'::DOUBLE, 0::DOUBLE, 0::DOUBLE",
    "pr_curve": f"WITH {SV}, {metrics('sv', 'scanner')} SELECT scanner, score AS threshold, round(tp / (tp + fp), 6)::DOUBLE AS precision, round(tp / n_pos, 6)::DOUBLE AS recall FROM c UNION ALL SELECT DISTINCT scanner, NULL::DOUBLE, 1::DOUBLE, 0::DOUBLE FROM c",
    "confusion_at_threshold": f"WITH {SV} SELECT run_name, {CELLS.format(t=30)} FROM sv GROUP BY run_name",
    "metric_input_checks": f"WITH {SV} SELECT ood_type, count(*) AS n_rows, count(*) FILTER (score IS NULL OR NOT isfinite(score)) AS n_bad_scores, count(*) FILTER (label IS NULL OR label NOT IN (0, 1)) AS n_bad_labels, count(*) FILTER (label = 0) AS n_id, count(*) FILTER (label = 1) AS n_ood FROM sv GROUP BY ood_type",
    "threshold_quantile": f"WITH {SV} SELECT round(t, 6)::DOUBLE AS threshold FROM ({VAL})",
    "threshold_per_scanner": f"WITH {SV} SELECT scanner, round(quantile_cont(score, 0.95), 6)::DOUBLE AS threshold FROM sv WHERE split = 'val' AND label = 0 GROUP BY scanner",
    "threshold_resolve": f"WITH {SV}, v AS ({VAL}), f AS (SELECT quantile_cont(score, 0.95) AS u FROM sv WHERE split = 'test') SELECT round(coalesce(t, u), 6)::DOUBLE AS threshold, CASE WHEN t IS NULL THEN '{TEST}' ELSE '{VALIDATION}' END AS threshold_source, 0.95::DOUBLE AS quantile FROM v, f",
    "operating_points": f"""WITH {SV}, te AS (SELECT * FROM sv WHERE split = 'test'), {metrics('te')},
p AS (SELECT 'fpr_at_95_tpr' AS policy, max(score) AS t FROM c WHERE tp / n_pos >= 0.95::DOUBLE UNION ALL SELECT 'val_id_95', t FROM ({VAL}) UNION ALL SELECT 'val_id_99', quantile_cont(score, 0.99) FROM sv WHERE split = 'val' AND label = 0)
SELECT policy, round(t, 6)::DOUBLE AS threshold, round(count(*) FILTER (label = 0 AND score >= t) / count(*) FILTER (label = 0), 6)::DOUBLE AS id_false_reject_rate, round(count(*) FILTER (label = 1 AND score >= t) / count(*) FILTER (label = 1), 6)::DOUBLE AS ood_detection_rate FROM te, p GROUP BY policy, t""",
    "score_histogram": f"WITH {SV} SELECT ood_type, floor(score / 5)::BIGINT AS bin, count(*) AS n_rows FROM sv GROUP BY ALL",
    "score_rows": f"WITH {SV} SELECT image_path, label, ood_type, round(score, 6)::DOUBLE AS score, (score >= 30)::INT AS prediction, 30::DOUBLE AS threshold FROM sv",
    "gate_decisions": f"""WITH {GV}, d AS (SELECT filename, score, CASE WHEN filename LIKE '%.gif' THEN NULL ELSE 10.0::DOUBLE END AS threshold FROM gv)
SELECT filename, round(score, 6)::DOUBLE AS score, threshold, (score >= threshold)::INT AS prediction, CASE WHEN threshold IS NULL THEN '{SCORE_ONLY}' WHEN score >= threshold THEN '{REJECT}' WHEN score < threshold THEN '{ACCEPT}' END AS decision,
CASE WHEN threshold IS NULL THEN '{VERDICTS[SCORE_ONLY]}' WHEN score >= threshold THEN '{VERDICTS[REJECT]}' WHEN score < threshold THEN '{VERDICTS[ACCEPT]}' END AS verdict, CASE WHEN threshold IS NULL THEN '{WARNING}' END AS warning FROM d""",
    "gate_batch": f"WITH {GATED} SELECT * REPLACE (round(score, 6)::DOUBLE AS score) FROM ga",
    "gate_counts": f"WITH {GATED} SELECT count(*) AS total, count(*) FILTER (status = 'ok' AND prediction = 0) AS accepted, count(*) FILTER (status = 'error' OR decision = '{REJECT}') AS rejected_or_error FROM ga",
    "topk_outcomes": f"WITH {TOP} SELECT outcome, rank, sample_index, round(score, 6)::DOUBLE AS score FROM top",
    "heatmap_manifest": f"""WITH {TOP}, s AS (SELECT *, outcome || '/' || printf('%s_%03d_sample_%05d', outcome, rank, sample_index) AS stem FROM top)
SELECT outcome, rank, sample_index, image_path, label, round(score, 6)::DOUBLE AS score, (score >= 30)::INT AS prediction, 30::DOUBLE AS threshold, stem || '_original.png' AS original_file, stem || '_heatmap.png' AS heatmap_file, stem || '_overlay.png' AS overlay_file FROM s""",
    "patch_maps": f"""WITH {NEAR}, g AS (SELECT *, count(*) OVER (PARTITION BY image_id) AS n, max(patch_row) OVER (PARTITION BY image_id) + 1 AS height, max(patch_col) OVER (PARTITION BY image_id) + 1 AS width,
row_number() OVER (PARTITION BY image_id ORDER BY patch_row, patch_col) - 1 AS place FROM ps) SELECT image_id, height::INT AS height, width::INT AS width, place::INT AS place, round(patch_score, 6)::DOUBLE AS patch_score FROM g""",
    "heatmap_normalization": f"WITH {NEAR} SELECT role, round(min(patch_score), 6)::DOUBLE AS vmin, round(CASE WHEN max(patch_score) <= min(patch_score) THEN min(patch_score) + 1 ELSE max(patch_score) END, 6)::DOUBLE AS vmax FROM ps GROUP BY role",
    "heatmap_normalize": f"WITH {NEAR}, l AS (SELECT role, min(patch_score) AS a, max(patch_score) AS b FROM ps GROUP BY role) SELECT vec_id, image_id, round(least(greatest((patch_score - a) / greatest(b - a, 1e-8), 0), 1), 6)::DOUBLE AS normalised FROM ps JOIN l USING (role)",
    "heatmap_resize": f"""WITH {NEAR}, q AS (SELECT image_id FROM ps GROUP BY 1 HAVING max(patch_row) = 1 AND max(patch_col) = 1 AND count(*) = 4) SELECT image_id, (z.y * 4 + z.x)::INT AS place, round(sum(patch_score * z.w), 6)::DOUBLE AS value
FROM ps JOIN q USING (image_id), {weighted(2, 4, 'z')} WHERE patch_row = z.i AND patch_col = z.j GROUP BY image_id, z.y, z.x""",
    "manifest_load": f"WITH {BAD} SELECT split, label, count(*) AS n_rows, count(DISTINCT image_path) AS n_paths FROM m GROUP BY ALL",
    "manifest_csv_rows": "SELECT row_number() OVER (ORDER BY doc_id) + 1 AS csv_row, doc_id, CASE WHEN doc_id % 3 = 0 THEN 18 + len(doc_id::VARCHAR) ELSE 0 END::INT AS note_chars FROM documents",
    "manifest_violations": f"WITH {BAD} SELECT 'empty' AS kind, (count(*) = 0)::BIGINT AS n_rows FROM f UNION ALL SELECT 'image_path', count(*) FILTER (bad_path) FROM f UNION ALL SELECT 'label', count(*) FILTER (bad_label) FROM f UNION ALL SELECT 'split', count(*) FILTER (bad_split) FROM f",
    "manifest_resolve": f"WITH {GOOD} SELECT doc_id, image_path, label, split, resolved_image_path FROM h",
    "manifest_missing_files": f"WITH {GOOD} SELECT doc_id, resolved_image_path FROM h WHERE resolved_image_path NOT IN (SELECT path FROM {V.oracle(V.LISTING)})",
    "manifest_id_subset": f"WITH {GOOD} SELECT doc_id, label, split FROM g WHERE label = 0",
    "artifact_manifest": f"""WITH {GOOD}, r AS (SELECT *, row_number() OVER (ORDER BY image_path, doc_id) - 1 AS i FROM g WHERE label = 0),
k AS (SELECT unnest(['text_watermark', 'rectangle_annotation', 'border_crop', 'gaussian_noise', 'jpeg_compression']) AS kind)
SELECT 'artifacts/' || printf('%05d', i) || '_' || regexp_replace(regexp_replace(regexp_extract(image_path, '([^/]*)$', 1), '\\.[^.]*$', ''), '[^A-Za-z0-9_.-]+', '_', 'g') || '_' || kind || '.png' AS image_path, 1 AS label, 'test' AS split,
'synthetic_artifact' AS source, 'sensory_artifact' AS ood_type, '' AS patient_id, scanner, kind || ' generated from held-out valid image' AS notes FROM r, k""",
    "dataset_composition": f"""WITH {GOOD} SELECT CASE WHEN grouping(split) = 1 THEN 'ALL' ELSE split END AS split, CASE WHEN grouping(label) = 1 THEN 'ALL' ELSE label::VARCHAR END AS label, CASE WHEN grouping(source) = 1 THEN 'ALL' ELSE source END AS source,
CASE WHEN grouping(ood_type) = 1 THEN 'ALL' ELSE ood_type END AS ood_type, count(*) AS n_rows FROM g GROUP BY ROLLUP (split, label, source, ood_type)""",
    "leakage_patients": f"WITH {GOOD} SELECT patient_id, count(*) FILTER (split = 'train') AS n_train, count(*) FILTER (split = 'test') AS n_test FROM g WHERE trim(patient_id) <> '' GROUP BY 1 HAVING n_train > 0 AND n_test > 0",
    "leakage_originals": f"WITH {GOOD}, o AS (SELECT DISTINCT image_path, split FROM g) SELECT g.image_path AS original_path, o.split AS original_split FROM g JOIN o USING (image_path) WHERE g.label = 0 AND o.split <> 'test'",
    "image_load": f"""WITH {PIX} SELECT image_id, ((p - 1) // 64)::INT AS channel, NULL::VARCHAR AS error, sum(pixels[p])::DOUBLE AS total, count(*) AS n_pixels, sum(pixels[p] * (p - 1))::DOUBLE AS weighted FROM px, (SELECT unnest(range(1, 193)) AS p) WHERE image_id % 50 <> 0 GROUP BY ALL
UNION ALL SELECT image_id, NULL, 'not a supported image', NULL, 0, NULL FROM px WHERE image_id % 50 = 0""",
    "image_resize": f"""WITH {PIX} SELECT image_id, (ch * 16 + z.y * 4 + z.x)::INT AS place, round(sum(pixels[ch * 64 + z.i * 8 + z.j + 1]::DOUBLE * z.w), 4)::DOUBLE AS value FROM px, (SELECT unnest(range(3)) AS ch), {weighted(8, 4, 'z')} GROUP BY image_id, ch, z.y, z.x""",
    "image_shrink": f"""WITH {PIX} SELECT image_id, (ch * 9 + z.y * 3 + z.x)::INT AS place, round(sum(pixels[ch * 64 + z.i * 8 + z.j + 1]::DOUBLE * z.w)::FLOAT::DOUBLE, 4)::DOUBLE AS value FROM px, (SELECT unnest(range(3)) AS ch), {weighted(8, 3, 'z', True)} GROUP BY image_id, ch, z.y, z.x""",
    "image_gray": f"""WITH {PIX} SELECT image_id, (ch * 64 + p)::INT AS place, ((19595 * pixels[p + 1]::INT + 38470 * pixels[p + 65]::INT + 7471 * pixels[p + 129]::INT + 32768) >> 16)::DOUBLE AS value FROM px, (SELECT unnest(range(3)) AS ch), (SELECT unnest(range(64)) AS p)""",
    "image_normalize": f"WITH {PIX} SELECT image_id, p::INT AS place, round((pixels[p + 1]::DOUBLE / 255 - [0.485, 0.456, 0.406][p // 64 + 1]::DOUBLE) / [0.229, 0.224, 0.225][p // 64 + 1]::DOUBLE, 4)::DOUBLE AS value FROM px, (SELECT unnest(range(192)) AS p)",
    "feature_extract": f"""WITH {PIX} SELECT image_id, 'layer1' AS layer, 3 AS c, 4 AS h, 4 AS w, (ch * 16 + y * 4 + x)::INT AS place, round((pixels[ch * 64 + y * 16 + x * 2 + 1] + pixels[ch * 64 + y * 16 + x * 2 + 2] + pixels[ch * 64 + y * 16 + x * 2 + 9] + pixels[ch * 64 + y * 16 + x * 2 + 10])::DOUBLE / 4, 4)::DOUBLE AS value
FROM px, (SELECT unnest(range(3)) AS ch), (SELECT unnest(range(4)) AS y), (SELECT unnest(range(4)) AS x)""",
    "patch_embed": f"""WITH e AS (SELECT vec_id AS image_id, embedding AS v FROM embeddings) SELECT image_id, y::INT AS patch_row, x::INT AS patch_col, c::INT AS dim, round(v[c * 16 + y * 4 + x + 1]::DOUBLE, 5)::DOUBLE + 0 AS value FROM e, (SELECT unnest(range(4)) AS c), (SELECT unnest(range(4)) AS y), (SELECT unnest(range(4)) AS x)
UNION ALL SELECT image_id, z.y::INT, z.x::INT, 4, round(sum(v[z.i * 8 + z.j + 1]::DOUBLE * z.w), 5)::DOUBLE + 0 FROM e, {weighted(8, 4, 'z')} GROUP BY image_id, z.y, z.x""",
    "patch_explode": "SELECT 'layer2' AS layer, vec_id AS image_id, (i // 8)::INT AS patch_row, (i % 8)::INT AS patch_col, 0 AS dim, round(embedding[i + 1]::DOUBLE, 6)::DOUBLE + 0 AS value FROM embeddings, (SELECT unnest(range(64)) AS i) UNION ALL SELECT 'layer3', vec_id, y::INT AS patch_row, x::INT AS patch_col, c::INT AS dim, round(embedding[c * 16 + y * 4 + x + 1]::DOUBLE, 6)::DOUBLE + 0 AS value FROM embeddings, (SELECT unnest(range(4)) AS c), (SELECT unnest(range(4)) AS y), (SELECT unnest(range(4)) AS x)",
    "bank_coreset": f"WITH {PV} SELECT vec_id FROM (SELECT vec_id, row_number() OVER (ORDER BY md5('42:' || vec_id), vec_id) AS r, count(*) OVER () AS n FROM pv) WHERE r <= ceil(n * 0.2)",
    "bank_fit": f"WITH {BANK} SELECT bank_id FROM bank",
    "bank_roundtrip": f"WITH {BANK} SELECT bank_id, (d - 1)::INT AS dim, round(embedding[d], 6)::DOUBLE + 0 AS value, 0.5::DOUBLE AS coreset_ratio FROM bank, (SELECT unnest(range(1, 65)) AS d)",
    "bank_summary": f"WITH {BANK} SELECT (SELECT count(DISTINCT image_id) FROM pv WHERE role = 'train' AND label = 0) AS train_id_images, count(*) AS memory_bank_patches, max(len(embedding))::INT AS feature_dim, 0.5::DOUBLE AS coreset_ratio, 100000::BIGINT AS max_patches, 1 AS k FROM bank",
    "knn_pairwise": f"WITH {BANK} SELECT p.vec_id, b.bank_id, round(list_distance(p.embedding, b.embedding), 6)::DOUBLE AS distance FROM pv p, bank b WHERE p.role <> 'train'",
    "knn_score_k1": f"WITH {NEAR} SELECT vec_id, round(patch_score, 6)::DOUBLE AS patch_score FROM ps",
    "knn_score_k3": f"WITH {NEAR} SELECT vec_id, round(avg(dist), 6)::DOUBLE AS patch_score FROM (SELECT vec_id, dist, row_number() OVER (PARTITION BY vec_id ORDER BY dist) AS r FROM pairs) WHERE r <= 3 GROUP BY vec_id",
    "image_scores": f"WITH {NEAR} SELECT image_id, label, role, round(score, 6)::DOUBLE AS score FROM im",
    "knn_global_feature": f"""WITH {PV}, u AS (SELECT image_id, label, role, d, avg(embedding[d]) AS m FROM pv, (SELECT unnest(range(1, 65)) AS d) GROUP BY ALL), im AS (SELECT image_id, label, role, list(m ORDER BY d) AS v FROM u GROUP BY ALL)
SELECT a.image_id, a.label, a.role, round(min(list_distance(a.v, b.v)), 6)::DOUBLE AS patch_score FROM im a, im b WHERE a.role <> 'train' AND b.role = 'train' AND b.label = 0 GROUP BY ALL""",
    "reconstruction_error": "SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: (x::DOUBLE - round(x::DOUBLE, 1)) * (x::DOUBLE - round(x::DOUBLE, 1)))) / len(embedding), 6)::DOUBLE AS score FROM embeddings",
    "ablation_coreset": f"""WITH {PV}, r AS (SELECT vec_id, row_number() OVER (ORDER BY md5('42:' || vec_id), vec_id) AS r, count(*) OVER () AS n FROM pv WHERE role = 'train' AND label = 0), q AS (SELECT unnest([0.1, 0.3, 1.0])::DOUBLE AS ratio)
SELECT ratio, count(*) AS bank_size, min(vec_id) AS first_id, sum(vec_id)::BIGINT AS id_sum FROM r, q WHERE r <= ceil(n * ratio) GROUP BY ratio""",
    "evaluate_end_to_end": f"""WITH {NEAR}, te AS (SELECT * FROM im WHERE role = 'test'), tv AS (SELECT quantile_cont(score, 0.95) AS t FROM im WHERE role = 'val' AND label = 0), {metrics('te')}, a AS (SELECT {TRIPLE} FROM c), b AS (SELECT {CELLS.format(t='t')} FROM te, tv)
SELECT a.*, b.*, round(t, 6)::DOUBLE AS threshold, '{VALIDATION}' AS threshold_source FROM a, b, tv""",
    "metrics_report": f"WITH {RUNS} SELECT mt.run_name, mt.auroc, tp, round(threshold, 6)::DOUBLE AS threshold, '{VALIDATION}' AS threshold_source, total_count AS total, km.ood_type, km.auroc AS type_auroc, km.ood_count FROM mt JOIN th USING (run_name) JOIN cf USING (run_name) JOIN km ON km.raw = mt.run_name",
    "report_overall": f"WITH {RUNS} SELECT * FROM ov",
    "report_per_ood": f"WITH {RUNS} SELECT * FROM po",
    "report_markdown": f"WITH {RUNS} SELECT metrics_file, '| ' || replace(run_name, '|', '\\|') || ' | ' || layers || ' | ' || printf('%.4f', auroc) || ' | ' || tp || ' | ' || metrics_file || ' |' AS line FROM ov",
    "report_ablation": f"WITH {RUNS} SELECT figure_label, coalesce(list_position(['layer1', 'layer2', 'layer3', 'layer4', 'layer2+layer3'], layers) - 1, 99)::INT AS layer_sort, run_name, auroc, tp::DOUBLE AS tp FROM ({LABELLED} ov)",
    "report_pivot_auroc": f"""WITH {RUNS} SELECT figure_label, max(auroc) FILTER (ood_type = 'modality_shift') AS modality_shift, max(auroc) FILTER (ood_type = 'semantic_outlier') AS semantic_outlier, max(auroc) FILTER (ood_type = 'sensory_artifact') AS sensory_artifact FROM ({LABELLED} po) GROUP BY figure_label""",
    "report_confusion_long": f"WITH {RUNS} UNPIVOT (SELECT run_name, tn, fp, fn, tp FROM ov) ON tn, fp, fn, tp INTO NAME cell VALUE n",
    "report_counts": f"WITH {RUNS} SELECT (SELECT count(*) FROM ov) AS run_count, (SELECT count(DISTINCT ood_type) FROM po) AS ood_type_count",
}
_MEAN = f"""WITH {PV}, mu AS (SELECT d, avg(embedding[d]) AS m FROM pv, (SELECT unnest(range(1, 65)) AS d) WHERE role = 'train' AND label = 0 GROUP BY d),
sc AS (SELECT vec_id, role, label, avg((embedding[d] - m) * (embedding[d] - m)) AS score FROM pv, mu GROUP BY ALL)"""
ORACLES |= {
    "recon_mean_baseline": f"{_MEAN} SELECT vec_id, round(score, 6)::DOUBLE AS score FROM sc WHERE role <> 'train'",
    "recon_train_loss": f"{_MEAN} SELECT round(avg(score), 6)::DOUBLE AS loss, count(*) AS n_rows FROM sc WHERE role = 'train' AND label = 0",
    "knn_score_blocks": ORACLES["knn_score_k3"],
    "gate_stream": ORACLES["gate_batch"],
    "gate_stream_counts": ORACLES["gate_counts"],
}


def basis(turn: int) -> str:
    """CTEs w{turn}, the start times the covariance so many times over, and b{turn}, its columns made orthonormal one after the other; tables (i, j, v)."""
    first = f"SELECT i, j, cos((2 * i + 1) * j * pi() / 128)::DOUBLE AS v FROM (SELECT unnest(range(64)) AS i), (SELECT unnest(range({RANK})) AS j)"
    w = f"w{turn} AS MATERIALIZED ({f'SELECT co.i, w.j, sum(co.v * w.v) AS v FROM co JOIN w{turn - 1} w ON w.i = co.k GROUP BY ALL' if turn else first})"
    steps = [w]
    for j in range(RANK):
        before = f"(SELECT * FROM b{turn}_{j - 1})" if j else "(SELECT i, j, v FROM w0 WHERE false)"
        own = f"(SELECT i, v FROM w{turn} WHERE j = {j})"
        rest = f"SELECT o.i, o.v - coalesce(sum(b.v * dot.c), 0) AS v FROM {own} o LEFT JOIN {before} b USING (i) LEFT JOIN (SELECT b.j, sum(b.v * o.v) AS c FROM {before} b JOIN {own} o USING (i) GROUP BY b.j) dot ON dot.j = b.j GROUP BY o.i, o.v"
        steps.append(f"b{turn}_{j} AS MATERIALIZED (SELECT i, j, v FROM {before} UNION ALL SELECT i, {j}, v / sqrt(sum(v * v) OVER ()) FROM ({rest}))")
    return ", ".join(steps)


_FIT = f"""WITH {PV}, un AS (SELECT vec_id, role, label, d - 1 AS i, embedding[d] AS x FROM pv, (SELECT unnest(range(1, 65)) AS d)), mu AS (SELECT i, avg(x) AS m FROM un WHERE role = 'train' AND label = 0 GROUP BY i),
ce AS MATERIALIZED (SELECT vec_id, role, label, i, x - m AS x FROM un JOIN mu USING (i)), fr AS MATERIALIZED (SELECT vec_id, i, x FROM ce WHERE role = 'train' AND label = 0),
co AS MATERIALIZED (SELECT a.i, b.i AS k, sum(a.x * b.x) / (SELECT count(DISTINCT vec_id) FROM fr) AS v FROM fr a JOIN fr b USING (vec_id) GROUP BY ALL), {', '.join(basis(t) for t in range(TURNS + 1))}"""
ORACLES |= {
    "recon_pca_baseline": f"""{_FIT}, te AS (SELECT vec_id, i, x FROM ce WHERE role <> 'train'), pr AS (SELECT vec_id, j, sum(x * v) AS c FROM te JOIN b{TURNS}_{RANK - 1} USING (i) GROUP BY ALL)
SELECT vec_id, round((s - p) / 64, 6)::DOUBLE AS score FROM (SELECT vec_id, sum(x * x) AS s FROM te GROUP BY 1) JOIN (SELECT vec_id, sum(c * c) AS p FROM pr GROUP BY 1) USING (vec_id)""",
    "recon_pca_losses": f"{_FIT} " + " UNION ALL ".join(f"SELECT {t}::INT AS turn, round(((SELECT sum(v) FROM co WHERE i = k) - (SELECT sum(x.v * co.v * y.v) FROM b{t}_{RANK - 1} x JOIN co ON co.i = x.i JOIN b{t}_{RANK - 1} y ON y.i = co.k AND y.j = x.j)) / 64, 6)::DOUBLE AS loss" for t in range(TURNS + 1)),
}


def mix(x: str) -> str:
    return f"list_reduce([({x})::BIGINT, {', '.join(map(str, range(kernels.MIXING)))}], lambda a, r: (xor(a, a >> 16) * {kernels.MIXER}) & {kernels.WIDE})"


def drawn(n: str) -> str:
    """The n-th draw of an image and kind, whose hash is the column key."""
    return mix(f"xor(key, ({n})::BIGINT)")


def ranged(n: int, low: str, high: str) -> str:
    return f"({low} + ({drawn(str(n))} * ({high} - ({low})) >> 32))"


def share(n: str) -> str:
    return f"(({drawn(n)} + 0.5::DOUBLE) / 4294967296::DOUBLE)"


def corruption(kind: str) -> str:
    """image_id, kind, height, width and pixels_sha256 of the 24 x 24 images in that kind."""
    place = list(kernels.CORRUPTIONS).index(kind)
    key = f"list_reduce([0::BIGINT, 42, image_id & {kernels.WIDE}, image_id >> 32, {place}], lambda s, v: {mix('xor(s, v)')})"
    parts = [PIX, f"im AS MATERIALIZED (SELECT image_id, pixels, {key} AS key FROM px)"]
    cells = "(SELECT unnest(range(3)) AS c), (SELECT unnest(range(24)) AS y), (SELECT unnest(range(24)) AS x)"
    pixel = lambda y, x: f"pixels[(c * 64 + (({y}) // 3) * 8 + ({x}) // 3 + 1)::INT]::INT"
    if kind == "text_watermark":
        ink = [int(r) * 44 + int(c) for r, c in zip(*np.nonzero(kernels.inked(kernels.MARK)), strict=True)]
        at = lambda shift: f"(x - px - {shift} BETWEEN 0 AND 43 AND y - py - {shift} BETWEEN 0 AND 4 AND list_contains({ink}, (y - py - {shift}) * 44 + x - px - {shift}))"
        parts.append(f"g AS MATERIALIZED (SELECT *, {ranged(0, '4', '6')} AS px, {ranged(1, '4', '6')} AS py FROM im)")
        value = f"CASE WHEN {at(0)} THEN 255 WHEN {at(2)} THEN 0 ELSE {pixel('y', 'x')} END"
    elif kind == "rectangle_annotation":
        parts.append(f"g0 AS MATERIALIZED (SELECT *, {ranged(0, '0', '8')} AS x0, {ranged(1, '0', '8')} AS y0 FROM im)")
        parts.append(f"g1 AS MATERIALIZED (SELECT *, {ranged(2, 'greatest(x0 + 1, 12)', '24')} AS x1, {ranged(3, 'greatest(y0 + 1, 12)', '24')} AS y1 FROM g0)")
        parts.append("g2 AS (SELECT *, greatest(x1 - x0, y1 - y0, 1) AS n FROM g1)")
        parts.append("g AS MATERIALIZED (SELECT *, list_transform(range(n + 1), lambda t: (y0 + (2 * t * (y1 - y0) + n) // (2 * n)) * 24 + x0 + (2 * t * (x1 - x0) + n) // (2 * n)) AS diagonal FROM g2)")
        edge = "(x BETWEEN x0 AND x1 AND y BETWEEN y0 AND y1 AND NOT (x >= x0 + 2 AND x < greatest(x1 - 1, x0 + 2) AND y >= y0 + 2 AND y < greatest(y1 - 1, y0 + 2)))"
        value = f"CASE WHEN list_contains(diagonal, y * 24 + x) THEN 255 WHEN {edge} THEN CASE WHEN c = 0 THEN 255 ELSE 0 END ELSE {pixel('y', 'x')} END"
    elif kind == "border_crop":
        parts.append(f"g AS MATERIALIZED (SELECT *, greatest(1, floor(24 * (0.08::DOUBLE + 0.1::DOUBLE * {share('0')}))::INT) AS cut FROM im)")
        value = f"CASE WHEN y < 24 - cut AND x < 24 - cut THEN {pixel('y + cut', 'x + cut')} ELSE 0 END"
    elif kind == "gaussian_noise":
        parts.append(f"g AS MATERIALIZED (SELECT *, 18 + 18 * {share('0')} AS sigma FROM im)")
        i = "2 * ((y * 24 + x) * 3 + c)"
        value = f"floor(least(greatest({pixel('y', 'x')} + sigma * sqrt(-2 * ln({share(f'1 + {i}')})) * cos(2 * pi() * {share(f'2 + {i}')}), 0), 255))::INT"
    else:
        table = lambda name, m: f"{name}(k, n, v) AS (VALUES {', '.join(f'({k}, {n}, {float(m[k, n])!r}::DOUBLE)' for k in range(8) for n in range(8))})"
        parts += [table("ba", kernels.cosines()), table("st", kernels.steps())]
        parts.append(f"s0 AS MATERIALIZED (SELECT image_id, c, y // 8 AS ty, x // 8 AS tx, y % 8 AS a, x % 8 AS b, {pixel('y', 'x')} - 128 AS v FROM im, {cells})")
        turn = lambda old, axis, way: f"SELECT image_id, c, ty, tx, {'ba.' + way + ' AS a, s.b' if axis == 'a' else 's.a, ba.' + way + ' AS b'}, sum(s.v * ba.v) AS v FROM {old} s JOIN ba ON ba.{'n' if way == 'k' else 'k'} = s.{axis} GROUP BY ALL"
        parts += [f"s1 AS MATERIALIZED ({turn('s0', 'a', 'k')})", f"s2 AS MATERIALIZED ({turn('s1', 'b', 'k')})"]
        parts.append(f"s3 AS MATERIALIZED (SELECT image_id, c, ty, tx, a, b, floor(s2.v / st.v + {kernels.UP!r}::DOUBLE) * st.v AS v FROM s2 JOIN st ON st.k = a AND st.n = b)")
        parts += [f"s4 AS MATERIALIZED ({turn('s3', 'a', 'n')})", f"s5 AS MATERIALIZED ({turn('s4', 'b', 'n')})"]
        parts.append(f"o AS (SELECT image_id, c, ty * 8 + a AS y, tx * 8 + b AS x, floor(least(greatest(v + 128 + {kernels.UP!r}::DOUBLE, 0), 255.5))::INT AS v FROM s5)")
    if kind != "jpeg_compression":
        parts.append(f"o AS (SELECT image_id, c, y, x, {value} AS v FROM g, {cells})")
    return f"WITH {', '.join(parts)} SELECT image_id, '{kind}' AS kind, 24 AS height, 24 AS width, sha256(string_agg(v::VARCHAR, ',' ORDER BY c, y, x)) AS pixels_sha256 FROM o GROUP BY image_id"


_SHORT = dict(zip(("artifact_watermark", "artifact_annotation", "artifact_crop", "artifact_noise", "artifact_compression"), kernels.CORRUPTIONS, strict=True))
ORACLES |= {name: corruption(kind) for name, kind in _SHORT.items()}
ORACLES["artifact_apply"] = " UNION ALL ".join(f"SELECT * FROM ({corruption(kind)})" for kind in kernels.CORRUPTIONS)
ORACLES["evaluate_reconstruction"] = f"""{_FIT}, te0 AS (SELECT vec_id, i, x FROM ce WHERE role <> 'train'), pr AS (SELECT vec_id, j, sum(x * v) AS c FROM te0 JOIN b{TURNS}_{RANK - 1} USING (i) GROUP BY ALL),
sc AS (SELECT vec_id, (s - p) / 64 AS score FROM (SELECT vec_id, sum(x * x) AS s FROM te0 GROUP BY 1) JOIN (SELECT vec_id, sum(c * c) AS p FROM pr GROUP BY 1) USING (vec_id)),
im AS (SELECT image_id, label, ood_type, role, avg(score) AS score FROM sc JOIN pv USING (vec_id) GROUP BY ALL), te AS (SELECT * FROM im WHERE role = 'test'),
tv AS (SELECT quantile_cont(score, 0.95) AS t FROM im WHERE role = 'val' AND label = 0), {metrics('te').replace('c AS (SELECT *', 'cc AS (SELECT *')}, a AS (SELECT {TRIPLE} FROM cc), b AS (SELECT {CELLS.format(t='t')} FROM te, tv)
SELECT a.*, b.*, round(t, 6)::DOUBLE AS threshold, '{VALIDATION}' AS threshold_source FROM a, b, tv"""
ORACLES["gate_files"] = f"""WITH {PIX}, fe AS MATERIALIZED (SELECT image_id, y, x, list((pixels[ch * 64 + y * 16 + x * 2 + 1] + pixels[ch * 64 + y * 16 + x * 2 + 2] + pixels[ch * 64 + y * 16 + x * 2 + 9] + pixels[ch * 64 + y * 16 + x * 2 + 10])::DOUBLE / 4 ORDER BY ch) AS v
FROM px, (SELECT unnest(range(3)) AS ch), (SELECT unnest(range(4)) AS y), (SELECT unnest(range(4)) AS x) GROUP BY ALL),
ne AS (SELECT a.image_id, a.y, a.x, min(list_distance(a.v, b.v)) AS s FROM fe a, fe b WHERE b.image_id % 5 = 0 GROUP BY ALL), sc AS (SELECT image_id, max(s) AS s FROM ne GROUP BY 1)
SELECT image_id || '.png' AS filename, CASE WHEN bad THEN 'ERROR' WHEN s >= 5 THEN '{VERDICTS[REJECT]}' ELSE '{VERDICTS[ACCEPT]}' END AS verdict, CASE WHEN NOT bad THEN round(s, 4)::DOUBLE END AS score, CASE WHEN NOT bad THEN 5::DOUBLE END AS threshold,
CASE WHEN NOT bad THEN (s >= 5)::INT END AS prediction, CASE WHEN NOT bad THEN CASE WHEN s >= 5 THEN '{REJECT}' ELSE '{ACCEPT}' END END AS decision, CASE WHEN bad THEN 'could not be decoded' END AS warning, CASE WHEN bad THEN 'error' ELSE 'ok' END AS status
FROM (SELECT *, image_id % 50 = 0 AS bad FROM sc)"""
ORACLES["heatmap_record"] = f"""WITH {NEAR}, {TOP} SELECT (SELECT round(min(patch_score), 6)::DOUBLE FROM ps) AS vmin, (SELECT round(CASE WHEN max(patch_score) <= min(patch_score) THEN min(patch_score) + 1 ELSE max(patch_score) END, 6)::DOUBLE FROM ps) AS vmax,
count(*) AS selected_count, 0.45::DOUBLE AS alpha, 'jet' AS cmap, 5 AS top_k, 'colorbar.png' AS colorbar_file FROM top"""
