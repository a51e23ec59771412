"""Thresholds calibrated on in-distribution scores, and the decisions they give."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .metrics import cumulative, input_checks, score_counts
from .quantiles import quantiles

#: Decisions, verdicts and the warning of a score without a threshold.
REJECT, ACCEPT, SCORE_ONLY = "reject_ood_or_invalid", "accept_valid_faf", "score_only_no_threshold"
VERDICTS = {REJECT: "REJECT: OOD / invalid input", ACCEPT: "ACCEPT: likely valid FAF", SCORE_ONLY: "SCORE ONLY"}
WARNING = "There is no threshold, so nothing was decided: give a value, or the report of an evaluation."
#: Where a threshold comes from.
CONFIGURED, VALIDATION, TEST = "configured_threshold", "validation_id_quantile", "test_id_quantile"


class ThresholdError(ValueError):
    """A threshold that can't be computed."""


def quantile_threshold(id_scores: DataFrame, quantile: float = 0.95, keys: Sequence[str] = (), score: str = "score") -> DataFrame:
    """keys and threshold: the linearly interpolated quantile of the scores, exact at any number of them."""
    if not 0 < quantile < 1:
        raise ThresholdError("quantile must lie between 0 and 1")
    return quantiles(id_scores, {"threshold": quantile}, keys, score)


def require_calibratable(id_scores: DataFrame, score: str = "score") -> None:
    """Raise ThresholdError if there are no scores or some aren't finite."""
    c = input_checks(id_scores.withColumn("_one", F.lit(0)), (), score, "_one").first()
    if not c or not c["n_rows"] or c["n_bad_scores"]:
        raise ThresholdError("calibration scores must be there and finite")


def resolved_threshold(configured: float | None, validation: DataFrame | None, test_id: DataFrame, quantile: float = 0.95) -> DataFrame:
    """One row: threshold, threshold_source and quantile.

    A configured value comes first, then the quantile of the validation rows of label 0, then that of all test rows of
    the in-distribution manifest, whatever their labels.
    """
    fallback = quantile_threshold(test_id, quantile).select(F.col("threshold").alias("_t"))
    row = fallback
    if validation is not None:
        row = row.crossJoin(quantile_threshold(validation.filter("label = 0"), quantile).select(F.col("threshold").alias("_v")))  # one row each
    else:
        row = row.withColumn("_v", F.lit(None).cast("double"))
    c = F.lit(configured).cast("double")
    source = F.when(c.isNotNull(), CONFIGURED).when(F.col("_v").isNotNull(), VALIDATION).otherwise(TEST)
    return row.select(F.coalesce(c, "_v", "_t").alias("threshold"), source.alias("threshold_source"), F.lit(float(quantile)).alias("quantile"))


def precedence(explicit: float | None, metrics: dict | None, config: float | None) -> float | None:
    """Threshold of the gate: an explicit one, else that of a metrics report, else that of the configuration.

    A report without a threshold value is an error; no report at all is not.
    """
    if explicit is not None:
        return float(explicit)
    if metrics is not None:
        value = (metrics.get("threshold") or {}).get("value")
        if value is None:
            raise ThresholdError("the metrics report has no threshold value")
        return float(value)
    return None if config is None else float(config)


def gate_threshold(spark: SparkSession, config: float | None = None, threshold: float | None = None, metrics_path: str | None = None, model_path: str | None = None) -> float | None:
    """The precedence() of an explicit threshold, a metrics report in a file, and a configured one.

    The report is that of metrics_path, else the one in the folder evaluation beside the model.  A report that isn't there is
    passed over; one without a threshold value is an error.
    """
    if threshold is None and (metrics_path or model_path):
        path = metrics_path or model_path.rstrip("/").rpartition("/")[0] + "/evaluation/metrics.json"
        try:
            text = spark.read.text(path, wholetext=True).first()
        except AnalysisException as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
        else:
            return precedence(None, json.loads(text["value"] if text else "{}"), config)
    return precedence(threshold, None, config)


def prediction(score: Column, threshold: Column) -> Column:
    return (score >= threshold).cast("int")


def decided(scored: DataFrame, threshold: Column) -> DataFrame:
    """scored with threshold, prediction, decision, verdict and warning.  Without a threshold only the score is told.

    A null score with a threshold has no prediction, decision or verdict: it is neither accepted nor rejected.
    """
    t, s = threshold.cast("double"), F.col("score")
    decision = F.when(t.isNull(), SCORE_ONLY).when(s >= t, REJECT).when(s < t, ACCEPT)
    verdict = F.when(t.isNull(), VERDICTS[SCORE_ONLY]).when(s >= t, VERDICTS[REJECT]).when(s < t, VERDICTS[ACCEPT])
    return scored.withColumns({"threshold": t, "prediction": prediction(s, t), "decision": decision, "verdict": verdict, "warning": F.when(t.isNull(), WARNING)})


def operating_points(scored: DataFrame, calibration: DataFrame, shares: Sequence[float] = (0.95, 0.99), target: float = 0.95) -> DataFrame:
    """policy, threshold, id_false_reject_rate and ood_detection_rate for each quantile policy and for FPR at the target recall."""
    running = cumulative(score_counts(scored))
    reach = running.filter(F.try_divide("tp", "n_pos") >= target).agg(F.max("score").alias("threshold")).select(F.lit(f"fpr_at_{round(target * 100)}_tpr").alias("policy"), "threshold")
    wanted = {f"val_id_{round(q * 100)}": q for q in shares}
    policies = reach.union(quantiles(calibration.filter("label = 0"), wanted).unpivot([], list(wanted), "policy", "threshold"))
    up = F.col("score") >= F.col("threshold")
    rate = lambda y: F.try_divide(F.count_if((F.col("label") == y) & up), F.count_if(F.col("label") == y))
    # a row for each policy
    return scored.select("score", "label").crossJoin(F.broadcast(policies)).groupBy("policy", "threshold").agg(rate(0).alias("id_false_reject_rate"), rate(1).alias("ood_detection_rate"))


def score_histogram(scored: DataFrame, low: float, width: float, keys: Sequence[str] = ()) -> DataFrame:
    """keys, bin and n_rows: how many scores lie in each bin of that width from low on."""
    return scored.groupBy(*keys, F.floor((F.col("score") - low) / width).cast("long").alias("bin")).agg(F.count("*").alias("n_rows"))
