"""Reports of one run, and tables over many runs."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .metrics import per_type_of, ranking_of, type_counts

#: Fixed order of columns.
OVERALL = ("run_name", "run_dir", "model", "backbone", "layers", "auroc", "auprc", "fpr_at_95_tpr", "threshold", "threshold_source", "total_count", "id_count", "ood_count", "tn", "fp", "fn", "tp", "metrics_file")
PER_OOD = ("run_name", "model", "backbone", "layers", "ood_type", "auroc", "auprc", "fpr_at_95_tpr", "id_count", "ood_count", "metrics_file")
#: Fixed order of layer sets; others come after.
LAYER_ORDER = ("layer1", "layer2", "layer3", "layer4", "layer2+layer3")


def score_rows(scored: DataFrame, threshold: Column) -> DataFrame:
    """image_path, label, ood_type, score, prediction and threshold: what a scores file holds, and nothing that names a patient."""
    kinds = [F.col(c) for c in ("ood_type", "category") if c in scored.columns]
    return scored.select("image_path", "label", F.coalesce(*kinds, F.lit("unknown")).alias("ood_type"), "score", (F.col("score") >= threshold).cast("int").alias("prediction"), threshold.cast("double").alias("threshold"))


def metrics_report(scored: DataFrame, thresholds: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys and the nested report of each group; thresholds has keys, threshold, threshold_source and quantile.

    The rows are read once, to count them by type, label and score; all else comes from the counts.
    """
    base = type_counts(scored, keys)
    total = ranking_of(base, keys).select(*keys, F.struct("auroc", "auprc", "fpr_at_95_tpr").alias("global"))
    up, n = F.col("score") >= F.col("threshold"), lambda which: F.sum(F.when(which, F.col("n")).otherwise(0)).cast("long")
    cell = {"tn": (0, False), "fp": (0, True), "fn": (1, False), "tp": (1, True)}
    counted = base.join(thresholds, list(keys), "left").groupBy(*keys).agg(
        F.struct(*[n((F.col("label") == y) & (up if above else ~up)).alias(c) for c, (y, above) in cell.items()]).alias("confusion_matrix"),
        F.struct(F.first("threshold").alias("value"), F.first("threshold_source").alias("source"), F.first("quantile").alias("quantile")).alias("threshold"),
        F.struct(n(F.lit(True)).alias("total"), n(F.col("label") == 0).alias("id"), n(F.col("label") == 1).alias("ood")).alias("counts"),
    )
    kinds = per_type_of(base, keys).groupBy(*keys).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("ood_type", F.struct("auroc", "auprc", "fpr_at_95_tpr", "id_count", "ood_count"))))).alias("per_ood_type"))
    return total.join(counted, list(keys), "left").join(kinds, list(keys), "left")


def _named(reports: DataFrame, runs_dir: str) -> DataFrame:
    """reports (of sources.read_reports()) with run_name, run_dir, model, backbone, layers and metrics_file."""
    root = re.sub("^([a-z0-9+.-]+:)/+", r"\1/", runs_dir.rstrip("/")) + "/"
    # a runs_dir without a scheme is below that of the session's default store
    reports = reports.withColumn("metrics_path", F.regexp_replace("metrics_path", "^[a-z0-9+.-]+:(//[^/]*)?/", "/") if root.startswith("/") else F.regexp_replace("metrics_path", "^([a-z0-9+.-]+:)/+", "$1/"))
    rel = lambda c: F.when(c.startswith(root), F.substring(c, F.lit(len(root) + 1), F.length(c))).when(c == root[:-1], ".").otherwise(c)
    folder = F.regexp_replace("metrics_path", "/[^/]*$", "")
    run = F.regexp_replace(folder, "/evaluation$", "")
    text = lambda c: F.coalesce(c, F.lit(""))
    name = F.col("config.project.run_name")
    layers = F.col("config.model.layers")
    listed = F.regexp_replace(F.array_join(F.from_json(layers, "array<string>"), "+"), '"', "")
    return reports.withColumns({
        "run_name": F.when(text(name) != "", name).otherwise(F.regexp_extract(run, "([^/]*)$", 1)), "run_dir": rel(run), "metrics_file": rel(F.col("metrics_path")),
        "model": text(F.col("config.model.name")), "backbone": text(F.col("config.model.backbone")), "layers": F.when(layers.startswith("["), listed).otherwise(text(layers)),
    })


def overall(reports: DataFrame, runs_dir: str) -> DataFrame:
    """A row for each run, ordered by run_name and metrics_file."""
    df = _named(reports, runs_dir)
    cols = {"auroc": "global.auroc", "auprc": "global.auprc", "fpr_at_95_tpr": "global.fpr_at_95_tpr", "threshold": "threshold.value", "total_count": "counts.total", "id_count": "counts.id", "ood_count": "counts.ood"} | {c: f"confusion_matrix.{c}" for c in ("tn", "fp", "fn", "tp")}
    picked = [F.coalesce("threshold.source", F.lit("")).alias(c) if c == "threshold_source" else F.col(cols.get(c, c)).alias(c) for c in OVERALL]
    return df.select(*picked).orderBy("run_name", "metrics_file")


def per_ood(reports: DataFrame, runs_dir: str) -> DataFrame:
    """A row for each run and type, ordered by run_name, ood_type and metrics_file."""
    df = _named(reports, runs_dir).select("run_name", "model", "backbone", "layers", "metrics_file", F.explode("per_ood_type").alias("ood_type", "v"))
    return df.select(*[F.col(f"v.{c}").alias(c) if c in ("auroc", "auprc", "fpr_at_95_tpr", "id_count", "ood_count") else F.col(c) for c in PER_OOD]).orderBy("run_name", "ood_type", "metrics_file")


def markdown_rows(df: DataFrame) -> DataFrame:
    """df with line: the row as a line of a Markdown table; nulls empty, reals with four decimals, pipes escaped."""
    cells = []
    for f in df.schema:
        text = F.format_string("%.4f", f.name) if f.dataType.typeName() in ("double", "float") else F.replace(F.col(f.name).cast("string"), F.lit("|"), F.lit("\\|"))
        cells.append(F.when(F.col(f.name).isNull(), "").otherwise(text))
    return df.withColumn("line", F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")))


def markdown(df: DataFrame) -> str:
    """A report table as Markdown; one blank row if there are none.  For report tables, which have a row for each run."""
    one = df.sparkSession.range(1)
    ruled = lambda texts: markdown_rows(one.select(*[F.lit(t).alias(f"c{i}") for i, t in enumerate(texts)])).first()["line"]
    lines = [r["line"] for r in markdown_rows(df).select("line").collect()]
    return "\n".join([ruled(df.columns), ruled(["---"] * len(df.columns)), *(lines or [ruled([""] * len(df.columns))])])


def report_paths(overall_markdown: str = "reports/generated/experiment_summary.md", overall_csv: str | None = None, per_ood_markdown: str | None = None, per_ood_csv: str | None = None) -> dict[str, str]:
    """Where the four report tables go: a table's CSV beside its Markdown, the per-type ones named after the overall one."""
    folder, _, name = overall_markdown.rpartition("/")
    stem = re.sub(r"(?<=.)\.[^.]*$", "", name)
    per = per_ood_markdown or f"{folder}/" * bool(folder) + ("per_category_metrics.md" if name == "experiment_summary.md" else f"{stem}_per_ood.md")
    beside = lambda path: re.sub(r"(?<=[^/])\.[^./]*$", "", path) + ".csv"
    return {"overall_markdown": overall_markdown, "overall_csv": overall_csv or beside(overall_markdown), "per_ood_markdown": per, "per_ood_csv": per_ood_csv or beside(per)}


#: Fixed titles of the Markdown files.
TITLES = {"overall": "Experiment Summary", "per_ood": "Per-OOD Category Metrics"}


def write_tables(reports: DataFrame, runs_dir: str, **paths: str) -> dict[str, str]:
    """Write the overall and the per-type table as CSV and as Markdown, by Spark's writers, to the places of report_paths(), which are returned."""
    where = report_paths(**paths)
    for kind, table in (("overall", overall(reports, runs_dir)), ("per_ood", per_ood(reports, runs_dir))):
        one = table.coalesce(1)  # a row for each run, or run and type
        one.write.mode("overwrite").csv(where[f"{kind}_csv"], header=True, escape='"', emptyValue="")
        text = f"# {TITLES[kind]}\n\n{markdown(table)}"
        one.sparkSession.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(where[f"{kind}_markdown"])
    return where


def ablation(table: DataFrame) -> DataFrame:
    """table of overall() with figure_label and layer_sort, numbers as numbers (NULL if they aren't), in figure order."""
    missing = sorted({"run_name", "layers", "auroc", "auprc", "fpr_at_95_tpr", "tn", "fp", "fn", "tp"} - set(table.columns))
    if missing:
        raise ValueError(f"table lacks columns: {', '.join(missing)}")
    rank = F.lit(99)
    for i, name in reversed(list(enumerate(LAYER_ORDER))):
        rank = F.when(F.col("layers") == name, i).otherwise(rank)
    df = table.withColumns({c: F.expr(f"try_cast({c} AS double)") for c in ("auroc", "auprc", "fpr_at_95_tpr", "tn", "fp", "fn", "tp")})
    return df.withColumns({"figure_label": F.when(F.coalesce("layers", F.lit("")) != "", F.col("layers")).otherwise(F.col("run_name")), "layer_sort": rank}).orderBy("layer_sort", "run_name")


def auroc_pivot(table: DataFrame, kinds: Sequence[str]) -> DataFrame:
    """AUROC by figure label (rows) and type (columns); of several runs with one label the first in order."""
    df = table.withColumn("figure_label", F.when(F.coalesce("layers", F.lit("")) != "", F.col("layers")).otherwise(F.col("run_name")))
    return df.groupBy("figure_label").pivot("ood_type", list(kinds)).agg(F.min_by("auroc", F.struct("run_name", "metrics_file")))


def confusion_long(table: DataFrame) -> DataFrame:
    """run_name, cell and n for each cell of each run's confusion matrix."""
    return table.select("run_name", "tn", "fp", "fn", "tp").unpivot("run_name", ["tn", "fp", "fn", "tp"], "cell", "n")


def report_counts(table: DataFrame, kinds: DataFrame) -> DataFrame:
    return table.agg(F.count("*").alias("run_count")).crossJoin(kinds.agg(F.count_distinct("ood_type").alias("ood_type_count")))  # one row each
