"""Top cases of each outcome, and anomaly maps."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import kernels

#: Fixed order of outcomes.
OUTCOMES = ("fp", "fn", "tp", "tn")


def outcome(threshold: Column) -> Column:
    up, y = F.col("score") >= threshold, F.col("label")
    return F.when((y == 0) & up, "fp").when((y == 1) & ~up, "fn").when((y == 1) & up, "tp").when((y == 0) & ~up, "tn")


def top_outcomes(scored: DataFrame, threshold: Column, k: int, keys: Sequence[str] = (), index: str = "sample_index") -> DataFrame:
    """scored with outcome and rank, the first k of each outcome: the highest scores of fp and tp, the lowest of fn and tn, ties by index."""
    if k < 0:
        raise ValueError("k must not be negative")
    rows = scored.withColumn("outcome", outcome(threshold))
    order = F.when(F.col("outcome").isin("fp", "tp"), -F.col("score")).otherwise(F.col("score"))
    rank = F.row_number().over(Window.partitionBy(*keys, "outcome").orderBy(order, index))
    return rows.withColumn("rank", rank).filter(F.col("rank") <= k)


def heatmap_manifest(top: DataFrame, threshold: Column, index: str = "sample_index") -> DataFrame:
    """The rows of a heatmap manifest: 8 columns of the case and the names of its three files."""
    stem = F.format_string("%s/%s_%03d_sample_%05d", "outcome", "outcome", "rank", index)
    files = {f"{kind}_file": F.concat(stem, F.lit(f"_{kind}.png")) for kind in ("original", "heatmap", "overlay")}
    rows = top.withColumns({"threshold": threshold.cast("double"), "prediction": (F.col("score") >= threshold).cast("int")} | files)
    return rows.select("outcome", "rank", index, "image_path", "label", "score", "prediction", "threshold", *files)


def map_limits(maps: DataFrame, keys: Sequence[str] = (), value: str = "patch_score") -> DataFrame:
    """keys, vmin and vmax of patch scores; a flat map gets vmax = vmin + 1."""
    low, high = F.min(value).cast("double"), F.max(value).cast("double")
    return maps.groupBy(*keys).agg(low.alias("vmin"), F.when(high <= low, low + 1.0).otherwise(high).alias("vmax"))


def require_maps(maps: DataFrame, value: str = "patch_score") -> None:
    """Raise ValueError if there are no maps, or values that are null or not finite."""
    x = F.col(value).cast("double")
    row = maps.agg(F.count("*").alias("n"), F.count_if(x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))).alias("bad")).first()
    if not row["n"]:
        raise ValueError("there are no anomaly maps")
    if row["bad"]:
        raise ValueError(f"{row['bad']} values of anomaly maps are not finite")


def normalisation_record(top: DataFrame, limits: DataFrame, top_k: int, alpha: float = 0.45, cmap: str = "jet") -> DataFrame:
    """One row beside a heatmap manifest: vmin, vmax, alpha, cmap, top_k, how many cases were chosen, and the colour bar's file."""
    return limits.select("vmin", "vmax").crossJoin(top.agg(F.count("*").alias("selected_count"))).withColumns({"alpha": F.lit(alpha), "cmap": F.lit(cmap), "top_k": F.lit(top_k), "colorbar_file": F.lit("colorbar.png")})  # one row each


def normalised(maps: DataFrame, limits: DataFrame, keys: Sequence[str] = (), value: str = "patch_score", eps: float = 1e-8) -> DataFrame:
    """maps with normalised: the value scaled to the limits and clipped to 0..1."""
    rows = maps.join(limits, list(keys)) if keys else maps.crossJoin(F.broadcast(limits))  # one row
    scaled = (F.col(value) - F.col("vmin")) / F.greatest(F.col("vmax") - F.col("vmin"), F.lit(eps))
    return rows.withColumn("normalised", F.least(F.greatest(scaled, F.lit(0.0)), F.lit(1.0)))


def grids(maps: DataFrame, value: str = "patch_score") -> DataFrame:
    """image_id, height, width and values (by row, then column) of the patch maps."""
    cells = F.array_sort(F.collect_list(F.struct("patch_row", "patch_col", F.col(value).cast("double").alias("v"))))
    out = maps.groupBy("image_id").agg((F.max("patch_row") + 1).cast("int").alias("height"), (F.max("patch_col") + 1).cast("int").alias("width"), cells.alias("cells"))
    return out.select("image_id", "height", "width", F.transform("cells", lambda c: c["v"]).alias("values"))


def resized(maps: DataFrame, height: int, width: int) -> DataFrame:
    """grids() brought to a size by bilinear interpolation; a grid that lacks patches gives null."""
    if height <= 0 or width <= 0:
        raise ValueError("sizes must be positive")

    def run(batches):
        for b in batches:
            got = [kernels.resize(np.asarray(v, dtype=np.float64).reshape(h, w), height, width).ravel() if len(v) == h * w else None for h, w, v in zip(b["height"], b["width"], b["values"], strict=True)]
            yield pd.DataFrame({"image_id": b["image_id"], "height": height, "width": width, "values": got})

    return maps.select("image_id", "height", "width", "values").mapInPandas(run, "image_id long, height int, width int, values array<double>")
