import numpy as np
import pytest
from pyspark.sql import functions as F

from oodspark.operators import decisions, metrics, outcomes

SCHEMA = "label int, score double"


def table(spark, labels, scores):
    return spark.createDataFrame(list(zip(labels, map(float, scores), strict=True)), SCHEMA)


@pytest.mark.parametrize(
    ("labels", "scores", "want"),
    [([0, 0, 1, 1], [0.1, 0.2, 0.8, 0.9], (1, 1, 0)), ([0, 0, 1, 1], [0.1, 0.4, 0.35, 0.8], (0.75, 5 / 6, 0.5)), ([0, 1, 0, 1], [0.5, 0.5, 0.2, 0.8], (0.875, 5 / 6, 0.5))],
)
def test_hand_values(spark, labels, scores, want):
    row = metrics.ranking_metrics(table(spark, labels, scores)).first()
    assert [row[c] for c in ("auroc", "auprc", "fpr_at_95_tpr")] == pytest.approx(want)


def test_ranges_dont_matter(spark):
    rng = np.random.default_rng(5)
    rows = [(int(y), float(s), f"g{g}") for y, s, g in zip(rng.integers(0, 2, 400), rng.integers(0, 37, 400), rng.integers(0, 3, 400), strict=True)]
    df = spark.createDataFrame(rows, "label int, score double, g string").repartition(3)
    got = [{tuple(r) for r in metrics.ranking_metrics(df, ["g"], cuts=cuts).select("g", *[F.round(c, 9) for c in ("auroc", "auprc", "fpr_at_95_tpr")]).collect()} for cuts in (None, [], [3.0, 3.5, 20.0, 36.0], [-1.0, 99.0])]
    assert all(x == got[0] for x in got) and len(got[0]) == 3


def test_one_class(spark):
    df = table(spark, [0, 0, 0], [0.1, 0.3, 0.5])
    assert tuple(metrics.confusion(df, F.lit(0.4)).first()) == (2, 1, 0, 0)
    assert metrics.ranking_metrics(df).first()["auroc"] is None
    with pytest.raises(metrics.MetricInputError):
        metrics.require_valid(df)
    metrics.require_valid(df, both_classes=False)


@pytest.mark.parametrize(("labels", "scores"), [([0, 2], [0.1, 0.2]), ([0, 1], [0.1, float("nan")]), ([0, 1], [0.1, float("inf")]), ([], [])])
def test_bad_input(spark, labels, scores):
    with pytest.raises(metrics.MetricInputError):
        metrics.require_valid(table(spark, labels, scores))
    with pytest.raises(metrics.MetricInputError):
        metrics.fpr_at_recall(0)


def test_per_type(spark):
    df = spark.createDataFrame([(0, 0.1, "id"), (0, 0.2, "x"), (1, 0.8, "a"), (1, 0.9, "b")], "label int, score double, ood_type string")
    got = {r["ood_type"]: (r["auroc"], r["id_count"], r["ood_count"]) for r in metrics.per_type_metrics(df).collect()}
    assert got == {"a": (1, 2, 1), "b": (1, 2, 1)}


def test_curves(spark):
    run = metrics.cumulative(metrics.score_counts(table(spark, [0, 0, 1, 1], [0.1, 0.4, 0.35, 0.8])))
    assert sorted((r["fpr"], r["tpr"]) for r in metrics.roc_curve(run).collect()) == [(0, 0), (0, 0.5), (0.5, 0.5), (0.5, 1), (1, 1)]
    assert metrics.pr_curve(run).filter("threshold IS NULL").select("precision", "recall").first() == (1, 0)


def test_thresholds(spark):
    df = table(spark, [0] * 4, [0.1, 0.2, 0.3, 0.4])
    assert decisions.quantile_threshold(df, 0.5).first()[0] == pytest.approx(0.25)
    for q in (0, 1):
        with pytest.raises(decisions.ThresholdError):
            decisions.quantile_threshold(df, q)
    with pytest.raises(decisions.ThresholdError):
        decisions.require_calibratable(df.limit(0))
    assert decisions.resolved_threshold(0.7, df, df).first()["threshold_source"] == decisions.CONFIGURED
    assert decisions.resolved_threshold(None, df.limit(0), df).first()["threshold_source"] == decisions.TEST


def test_precedence():
    report = {"threshold": {"value": 0.42}}
    assert (decisions.precedence(0.9, report, 0.33), decisions.precedence(None, report, 0.33), decisions.precedence(None, None, 0.33), decisions.precedence(None, None, None)) == (0.9, 0.42, 0.33, None)
    with pytest.raises(decisions.ThresholdError):
        decisions.precedence(None, {"threshold": {"value": None}}, 0.33)


def test_decisions(spark):
    row = decisions.decided(table(spark, [0], [0.5]), F.lit(0.5)).first()
    assert (row["decision"], row["prediction"], row["warning"]) == (decisions.REJECT, 1, None)
    row = decisions.decided(spark.createDataFrame([(0, None)], SCHEMA), F.lit(0.5)).first()
    assert row["prediction"] is None and row["decision"] is None and row["verdict"] is None and row["warning"] is None
    row = decisions.decided(table(spark, [0], [0.75]), F.lit(None).cast("double")).first()
    assert (row["decision"], row["prediction"]) == (decisions.SCORE_ONLY, None) and row["warning"]


def test_top_outcomes(spark):
    rows = list(enumerate(zip([0, 0, 1, 1, 0, 1], [0.1, 0.9, 0.2, 0.8, 0.7, 0.05], strict=True)))
    df = spark.createDataFrame([(i, y, s) for i, (y, s) in rows], "sample_index long, label int, score double")
    got = {r["outcome"]: r["sample_index"] for r in outcomes.top_outcomes(df, F.lit(0.5), 1).collect()}
    assert got == {"fp": 1, "fn": 5, "tp": 3, "tn": 0}
    assert outcomes.top_outcomes(df, F.lit(0.5), 0).count() == 0


def test_maps(spark):
    df = spark.createDataFrame([(1, 0, 0, 0.0), (1, 0, 1, 5.0), (1, 1, 0, 5.0), (1, 1, 1, 10.0)], "image_id long, patch_row int, patch_col int, patch_score double")
    got = outcomes.normalised(df, outcomes.map_limits(df)).orderBy("patch_row", "patch_col").collect()
    assert [r["normalised"] for r in got] == [0, 0.5, 0.5, 1]
    assert outcomes.map_limits(df.filter("patch_score = 5")).first() == (5.0, 6.0)
    big = outcomes.resized(outcomes.grids(df), 6, 8).first()
    assert (big["height"], big["width"], len(big["values"])) == (6, 8, 48)
