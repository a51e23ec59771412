"""Ranking metrics of scored tables: ROC and precision-recall points, AUROC, average precision, FPR at a recall, confusion.

Label 1 is out-of-distribution, and a higher score is more anomalous.  All functions take grouping keys, so that one job
evaluates many runs.  Scores are first reduced to counts for each distinct score; running sums over those are exact and
never put a group's scores into one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources import stored

#: Aim for distinct scores in a value range, and most ranges; running sums go range by range.
RANGE_SCORES, MOST_RANGES = 200_000, 1024


class MetricInputError(ValueError):
    """Scores or labels that no metric is defined for."""


def input_checks(scored: DataFrame, keys: Sequence[str] = (), score: str = "score", label: str = "label") -> DataFrame:
    """Counts of rows, of scores that aren't finite, of labels other than 0 and 1, and of each class."""
    s, y = F.col(score).cast("double"), F.col(label)
    bad = s.isNull() | F.isnan(s) | (F.abs(s) == float("inf"))
    aggs = [F.count("*").alias("n_rows"), F.count_if(bad).alias("n_bad_scores"), F.count_if(y.isNull() | ~y.isin(0, 1)).alias("n_bad_labels"), F.count_if(y == 0).alias("n_id"), F.count_if(y == 1).alias("n_ood")]
    return scored.groupBy(*keys).agg(*aggs)


def require_valid(scored: DataFrame, keys: Sequence[str] = (), both_classes: bool = True, score: str = "score", label: str = "label") -> None:
    """Raise MetricInputError if any group fails input_checks()."""
    c = input_checks(scored, keys, score, label)
    wrong = (F.col("n_rows") == 0) | (F.col("n_bad_scores") > 0) | (F.col("n_bad_labels") > 0)
    if both_classes:
        wrong = wrong | (F.col("n_id") == 0) | (F.col("n_ood") == 0)
    found = c.filter(wrong).limit(5).collect()
    if found or c.isEmpty():
        raise MetricInputError("scores must be finite, labels 0 or 1" + ", both present" * both_classes + f": {[r.asDict() for r in found] or 'no rows'}")


def score_counts(scored: DataFrame, keys: Sequence[str] = (), score: str = "score", label: str = "label") -> DataFrame:
    """keys, score, pos and neg: how many rows of either class have each score."""
    one = lambda v: F.sum(F.when(F.col(label) == v, 1.0).otherwise(0.0))
    return scored.groupBy(*keys, F.col(score).cast("double").alias("score")).agg(one(1).alias("pos"), one(0).alias("neg"))


def range_of(score: Column, cuts: Sequence[float]) -> Column:
    """How many of the ascending cuts a score reaches, looked up in two steps."""
    if not cuts:
        return F.lit(0)
    step = max(1, int(len(cuts) ** 0.5))
    array = lambda xs: F.array(*[F.lit(float(c)) for c in xs])
    reached = lambda xs: F.size(F.filter(xs, lambda c: c <= score))
    block = reached(array(cuts[::step]))
    within = F.array(*[array(cuts[i : i + step]) for i in range(0, len(cuts), step)])
    return F.when(block == 0, 0).otherwise((block - 1) * step + reached(F.get(within, block - 1)))


def cumulative(counts: DataFrame, keys: Sequence[str] = (), cuts: Sequence[float] | None = None, keep: bool = True) -> DataFrame:
    """counts with tp and fp, the running sums of pos and neg from the highest score down, and n_pos and n_neg, the totals.

    Scores are cut to ranges by value, so equal scores stay together; sums run inside the ranges and the totals of the
    higher ranges are added.  With keep the counts are written once to the shared folder; without it they should be little
    work over a table that already is there.  cuts are the borders; by default they are approximate quantiles of the scores,
    as many as the number of counts asks for, and what they are doesn't change the result.
    """
    counts = stored(counts, "score-counts") if keep else counts
    if cuts is None:
        ranges = min(-(-counts.count() // RANGE_SCORES), MOST_RANGES)
        cuts = sorted(set(counts.approxQuantile("score", [i / ranges for i in range(1, ranges)], 0.25 / ranges))) if ranges > 1 else []
    rows = counts.withColumn("_range", range_of(F.col("score"), cuts))
    down = Window.partitionBy(*keys, "_range").orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    totals = rows.groupBy(*keys, "_range").agg(F.sum("pos").alias("_p"), F.sum("neg").alias("_n"))
    # a row for each range of a group
    above = Window.partitionBy(*keys).orderBy(F.desc("_range")).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*keys)
    totals = totals.select(*keys, "_range", F.coalesce(F.sum("_p").over(above), F.lit(0.0)).alias("_p"), F.coalesce(F.sum("_n").over(above), F.lit(0.0)).alias("_n"), F.sum("_p").over(whole).alias("n_pos"), F.sum("_n").over(whole).alias("n_neg"))
    rows = rows.withColumn("tp", F.sum("pos").over(down)).withColumn("fp", F.sum("neg").over(down))
    on = rows["_range"] == totals["_range"]
    for k in keys:
        on = on & rows[k].eqNullSafe(totals[k])
    out = rows.join(totals, on)
    return out.select(*[rows[k] for k in keys], rows["score"], "pos", "neg", (F.col("tp") + F.col("_p")).alias("tp"), (F.col("fp") + F.col("_n")).alias("fp"), "n_pos", "n_neg")


def roc_curve(running: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """keys, threshold, fpr and tpr from cumulative(): a point for each score, and (0, 0) at an infinite threshold."""
    points = running.select(*keys, F.col("score").alias("threshold"), F.try_divide("fp", "n_neg").alias("fpr"), F.try_divide("tp", "n_pos").alias("tpr"))
    start = running.select(*keys).distinct() if keys else running.sparkSession.range(1).select()
    return points.union(start.select(*keys, F.lit(float("inf")), F.lit(0.0), F.lit(0.0)))


def pr_curve(running: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """keys, threshold, precision and recall from cumulative(); the end point (1, 0) has no threshold."""
    points = running.select(*keys, F.col("score").alias("threshold"), (F.col("tp") / (F.col("tp") + F.col("fp"))).alias("precision"), F.try_divide("tp", "n_pos").alias("recall"))
    end = running.select(*keys).distinct() if keys else running.sparkSession.range(1).select()
    return points.union(end.select(*keys, F.lit(None).cast("double"), F.lit(1.0), F.lit(0.0)))


def auroc() -> Column:
    """Pairs won and half the ties, over all pairs.  NULL if a class is missing."""
    pairs = F.max(F.col("n_pos") * F.col("n_neg"))
    return F.when(pairs > 0, F.try_divide(F.sum(F.col("neg") * (F.col("tp") - F.col("pos")) + 0.5 * F.col("neg") * F.col("pos")), pairs))


def auprc() -> Column:
    """Average precision: precision at each score, weighted by the recall it adds.  NULL if a class is missing."""
    return F.when(F.max(F.least("n_pos", "n_neg")) > 0, F.sum(F.try_divide("pos", "n_pos") * F.col("tp") / (F.col("tp") + F.col("fp"))))


def fpr_at_recall(target: float = 0.95) -> Column:
    """Least false positive rate among the points of at least that recall.  NULL if a class is missing."""
    if not 0 < target <= 1:
        raise MetricInputError("target recall must be above 0 and at most 1")
    return F.when(F.max(F.least("n_pos", "n_neg")) > 0, F.min(F.when(F.try_divide("tp", "n_pos") >= target, F.try_divide("fp", "n_neg"))))


def ranking_metrics(scored: DataFrame, keys: Sequence[str] = (), score: str = "score", label: str = "label", cuts: Sequence[float] | None = None) -> DataFrame:
    """keys, auroc, auprc and fpr_at_95_tpr.  A group of one class has NULLs."""
    running = cumulative(score_counts(scored, keys, score, label), keys, cuts)
    return running.groupBy(*keys).agg(auroc().alias("auroc"), auprc().alias("auprc"), fpr_at_recall().alias("fpr_at_95_tpr"))


def type_counts(scored: DataFrame, keys: Sequence[str] = (), kind: str = "ood_type", score: str = "score", label: str = "label") -> DataFrame:
    """keys, kind (null unless the label is 1), label, score and n, the number of such rows, from one pass over the rows and stored."""
    y = F.col(label)
    rows = scored.groupBy(*keys, F.when(y == 1, F.col(kind)).alias(kind), y.alias("label"), F.col(score).cast("double").alias("score"))
    return stored(rows.agg(F.count("*").cast("double").alias("n")), "type-counts")


def per_type_metrics(scored: DataFrame, keys: Sequence[str] = (), kind: str = "ood_type", score: str = "score", label: str = "label", cuts: Sequence[float] | None = None) -> DataFrame:
    """The metrics of each type of label-1 rows against all label-0 rows of its group, with id_count and ood_count.

    Label-0 rows are counted by score once and the counts, not the rows, are used for each type; their own type is
    ignored.
    """
    return per_type_of(type_counts(scored, keys, kind, score, label), keys, kind, cuts)


def per_type_of(base: DataFrame, keys: Sequence[str] = (), kind: str = "ood_type", cuts: Sequence[float] | None = None) -> DataFrame:
    """per_type_metrics() from type_counts()."""
    of_type = base.filter("label = 1").select(*keys, kind, "score", F.col("n").alias("pos"))
    plain = base.filter("label = 0").select(*keys, "score", F.col("n").alias("neg"))
    types = of_type.select(*keys, kind).distinct()
    each = plain.join(types, list(keys)) if keys else plain.crossJoin(types)  # distinct scores, for each of a few types
    both = of_type.select(*keys, kind, "score", "pos", F.lit(0.0).alias("neg")).unionByName(each.select(*keys, kind, "score", F.lit(0.0).alias("pos"), "neg"))
    counts = both.groupBy(*keys, kind, "score").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    running = cumulative(counts, [*keys, kind], cuts)
    return running.groupBy(*keys, kind).agg(auroc().alias("auroc"), auprc().alias("auprc"), fpr_at_recall().alias("fpr_at_95_tpr"), F.max("n_neg").cast("long").alias("id_count"), F.max("n_pos").cast("long").alias("ood_count"))


def ranking_of(base: DataFrame, keys: Sequence[str] = (), cuts: Sequence[float] | None = None) -> DataFrame:
    """ranking_metrics() from type_counts()."""
    of = lambda v: F.sum(F.when(F.col("label") == v, F.col("n")).otherwise(0.0))
    running = cumulative(base.groupBy(*keys, "score").agg(of(1).alias("pos"), of(0).alias("neg")), keys, cuts, keep=False)
    return running.groupBy(*keys).agg(auroc().alias("auroc"), auprc().alias("auprc"), fpr_at_recall().alias("fpr_at_95_tpr"))


def confusion(scored: DataFrame, threshold: Column, keys: Sequence[str] = (), score: str = "score", label: str = "label") -> DataFrame:
    """keys, tn, fp, fn and tp; a score equal to the threshold is a rejection.  One class alone is fine."""
    up, y = F.col(score) >= threshold, F.col(label)
    return scored.groupBy(*keys).agg(F.count_if((y == 0) & ~up).alias("tn"), F.count_if((y == 0) & up).alias("fp"), F.count_if((y == 1) & ~up).alias("fn"), F.count_if((y == 1) & up).alias("tp"))
