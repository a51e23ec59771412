"""What any detector gives to an evaluation: one finite score for each image, checked, and maps if it can."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from typing import Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources import stored
from . import autoencoder, decisions, metrics, patches


class DetectorError(ValueError):
    """A detector whose scores don't fit the images, or that can't give what is asked of it."""


class Detector(Protocol):
    """Tables of patches (image_id, patch_row, patch_col, embedding) go in."""

    def scores(self, rows: DataFrame) -> DataFrame:
        """image_id and score, once for each image of rows."""

    def maps(self, rows: DataFrame) -> DataFrame:
        """image_id, patch_row, patch_col and patch_score."""


@dataclass(frozen=True)
class Neighbours:
    """Distance of the farthest patch to its nearest k rows of a bank (embedding)."""

    bank: DataFrame
    k: int = 1

    def maps(self, rows: DataFrame) -> DataFrame:
        return patches.knn_scores(rows.select("image_id", "patch_row", "patch_col", "embedding"), self.bank, self.k)

    def scores(self, rows: DataFrame) -> DataFrame:
        return patches.image_scores(self.maps(rows))


@dataclass(frozen=True)
class Reconstruction:
    """Mean squared error of an autoencoder over all patches of an image; there are no maps."""

    model: autoencoder.Autoencoder

    def scores(self, rows: DataFrame) -> DataFrame:
        return autoencoder.scored(rows.select("image_id", "embedding"), self.model).groupBy("image_id").agg(F.avg("score").alias("score"))

    def maps(self, rows: DataFrame) -> DataFrame:
        raise DetectorError("a reconstruction has no patch maps")


@dataclass(frozen=True)
class Custom:
    """A user's function from a table of patches to image_id and score."""

    function: Callable[[DataFrame], DataFrame]

    def scores(self, rows: DataFrame) -> DataFrame:
        return self.function(rows)

    def maps(self, rows: DataFrame) -> DataFrame:
        raise DetectorError("this detector gives scores only")


def scored(detector: Detector, rows: DataFrame, about: tuple[str, ...] = ("label", "ood_type", "role")) -> DataFrame:
    """image_id, the columns about it, and score: each image of rows scored exactly once, with a finite score, and no other.

    The detector runs once, its scores are stored and the check is one join of the counts by image from both sides.
    """
    missing = {"image_id", *about} - set(rows.columns)
    if missing:
        raise DetectorError(f"patches lack columns: {', '.join(sorted(missing))}")
    found = detector.scores(rows)
    if not {"image_id", "score"} <= set(found.columns):
        raise DetectorError("a detector must give image_id and score")
    found = stored(found.select("image_id", F.col("score").cast("double").alias("score")), "detector-scores")
    images = stored(rows.select("image_id", *about).distinct(), "detector-images")
    bad = F.count_if(F.col("score").isNull() | F.isnan("score") | (F.abs("score") == float("inf")))
    given = found.groupBy(F.col("image_id").alias("given_id")).agg(F.count("*").alias("n"), bad.alias("bad"))
    asked = images.groupBy("image_id").agg(F.count("*").alias("kinds"))
    both = asked.join(given, F.col("image_id").eqNullSafe(F.col("given_id")), "full")
    wrong = F.when(F.col("kinds").isNull(), "not asked for").when(F.col("n").isNull(), "not scored").when(F.col("kinds") > 1, "described in several ways").when(F.col("n") > 1, "scored more than once").when(F.col("bad") > 0, "not scored by a finite number")
    examples = both.select(F.coalesce("image_id", "given_id").alias("id"), wrong.alias("wrong")).filter("wrong IS NOT NULL").limit(5).collect()
    if examples:
        raise DetectorError("; ".join(f"image {r['id']} was {r['wrong']}" for r in examples))
    return images.join(found, "image_id")


def evaluated(detector: Detector, rows: DataFrame, configured: float | None = None, quantile: float = 0.95) -> DataFrame:
    """One row: ranking metrics and confusion on the test images, threshold and threshold_source.

    rows have role val or test, and label.  The threshold is the configured one, else the quantile of validation images
    of label 0, else that of such test images.
    """
    images = stored(scored(detector, rows), "detector-evaluated")
    test = images.filter("role = 'test'")
    t = decisions.resolved_threshold(configured, images.filter("role = 'val'"), test.filter("label = 0"), quantile).first()
    both = metrics.ranking_metrics(test).crossJoin(metrics.confusion(test, F.lit(t["threshold"])))  # one row each
    return both.withColumns({"threshold": F.lit(t["threshold"]), "threshold_source": F.lit(t["threshold_source"])})
